import json

import pytest

from factloom.sources import resolution as R

PACKAGES = {
    "/app": {"name": "app", "version": "1.0.0", "exports": {".": "./main.js", "./tools": "./lib/tools.js"}, "imports": {"#own": "./lib/own.js", "#far": "legacy", "#far/*": "legacy/*", "#core": "fs", "#lost": "./gone.js", "#both": {"import": "./lib/a.mjs", "require": "./lib/a.cjs"}}},
    "/app/node_modules/legacy": {"name": "legacy", "main": "./out/start"},
    "/app/node_modules/plain": {"main": {"not": "text"}},
    "/app/node_modules/mapped": {
        "name": "mapped", "version": "2.1.0", "main": "never.js",
        "exports": {
            ".": {"import": "./esm/index.mjs", "require": "./cjs/index.cjs", "default": "./esm/index.mjs"}, "./deep/*": "./src/*.js", "./deep/very/*": "./src/other/*.js", "./deep/private/*": None, "./*.css": "./style/*.css",
            "./list": ["bad target", {"browser": "./browser.js", "node": "./src/node.js"}], "./none": ["./gone.js", None], "./escape/*": "./src/../*", "./first": ["./gone.js", "./src/node.js"], "./nested": {"node": {"import": "./esm/index.mjs"}, "default": "./src/node.js"},
            "./numbers": {"0": "./src/node.js"}, "./direct": "./src/node.js",
        },
    },
    "/app/node_modules/mixed": {"exports": {".": "./x.js", "import": "./x.js"}},
    "/app/node_modules/text": {"exports": "./only.js"},
    "/app/node_modules/sugar": {"exports": {"require": "./r.js", "import": "./i.js"}},
    "/app/node_modules/@scope/in": {"name": "@scope/in", "main": "lib"},
    "/app/sub/node_modules/legacy": {"name": "legacy"},
    "/app/sub": {"name": "sub"},
    "/app/node_modules/broken": "{not json",
}
FILES = """main.js lib/tools.js lib/own.js lib/a.mjs lib/a.cjs lib/a/index.js lib/data.json lib/add.node lib/types.d.ts lib/t.ts lib/t.js lib/view.tsx lib/n.mts sub/x.js sub/y/index.js
node_modules/legacy/out/start.js node_modules/legacy/extra.js node_modules/legacy/dir/index.js node_modules/plain/index.js node_modules/mapped/esm/index.mjs node_modules/mapped/cjs/index.cjs node_modules/mapped/src/one.js
node_modules/mapped/src/very/two.js node_modules/mapped/src/other/two.js node_modules/mapped/src/private/p.js node_modules/mapped/src/node.js node_modules/mapped/style/s.css node_modules/mapped/inner/z.js
node_modules/text/only.js node_modules/text/more.js node_modules/sugar/r.js node_modules/sugar/i.js node_modules/@scope/in/lib/index.js node_modules/@scope/in/lib/q.js sub/node_modules/legacy/index.js
node_modules/broken/index.js node_modules/mixed/x.js node_modules/bare/index.js""".split()
M, C = "module", "commonjs"
#: (importing file, specifier, mode): (file, outcome); worked out by hand from the public resolution algorithms.
WANT = {
    ("main.js", "./lib/tools.js", M): ("lib/tools.js", "file"),
    ("main.js", "./lib/tools", C): ("lib/tools.js", "file"),
    ("main.js", "./lib/tools", M): ("lib/tools.js", "file"),  # imports are tried as requires in the end
    ("main.js", "./lib/a", C): ("lib/a/index.js", "file"),
    ("lib/a/index.js", "..", C): (None, "unresolved"),
    ("sub/y/index.js", "..", C): (None, "unresolved"),
    ("sub/x.js", "./y/", C): ("sub/y/index.js", "file"),
    ("lib/a/index.js", "../../main.js", C): ("main.js", "file"),
    ("main.js", "./lib/data.json", C): (None, "skipped"),
    ("main.js", "./lib/data", C): (None, "skipped"),
    ("main.js", "./lib/add", C): (None, "skipped"),
    ("main.js", "./lib/none", C): (None, "unresolved"),
    ("main.js", "/app/main.js", C): (None, "unresolved"),
    ("main.js", "fs", C): (None, "builtin"),
    ("main.js", "node:test", M): (None, "builtin"),
    ("main.js", "fs/promises", M): (None, "builtin"),
    ("main.js", "file:///app/lib/a.mjs?x#y", M): ("lib/a.mjs", "file"),
    ("main.js", "https://a.b/c.js", M): (None, "skipped"),
    ("main.js", "ftp://a.b/c.js", M): (None, "unresolved"),
    ("main.js", "", C): (None, "unresolved"),
    ("main.js", "legacy", C): ("node_modules/legacy/out/start.js", "file"),
    ("main.js", "legacy", M): ("node_modules/legacy/out/start.js", "file"),
    ("main.js", "legacy/extra", C): ("node_modules/legacy/extra.js", "file"),
    ("main.js", "legacy/extra.js", M): ("node_modules/legacy/extra.js", "file"),
    ("main.js", "legacy/dir", C): ("node_modules/legacy/dir/index.js", "file"),
    ("sub/x.js", "legacy", C): ("sub/node_modules/legacy/index.js", "file"),
    ("sub/x.js", "legacy/extra", C): ("node_modules/legacy/extra.js", "file"),  # the nearer folder has no such file
    ("main.js", "plain", C): ("node_modules/plain/index.js", "file"),
    ("main.js", "bare", M): ("node_modules/bare/index.js", "file"),
    ("main.js", "broken", C): ("node_modules/broken/index.js", "file"),
    ("main.js", "mapped", M): ("node_modules/mapped/esm/index.mjs", "file"),
    ("main.js", "mapped", C): ("node_modules/mapped/cjs/index.cjs", "file"),
    ("main.js", "mapped/deep/one", C): ("node_modules/mapped/src/one.js", "file"),
    ("main.js", "mapped/deep/very/two", M): ("node_modules/mapped/src/other/two.js", "file"),
    ("main.js", "mapped/deep/private/p", M): (None, "missing"),
    ("main.js", "mapped/deep/../node", M): (None, "missing"),
    ("main.js", "mapped/s.css", M): (None, "skipped"),
    ("main.js", "mapped/list", M): ("node_modules/mapped/src/node.js", "file"),
    ("main.js", "mapped/none", M): (None, "missing"),
    ("main.js", "mapped/first", M): ("node_modules/mapped/src/node.js", "file"),
    ("main.js", "mapped/first", C): (None, "missing"),  # the first valid target is not there
    ("main.js", "mapped/escape/x", M): (None, "missing"),
    ("main.js", "mapped/nested", M): ("node_modules/mapped/esm/index.mjs", "file"),
    ("main.js", "mapped/nested", C): ("node_modules/mapped/src/node.js", "file"),
    ("main.js", "mapped/numbers", M): (None, "missing"),
    ("main.js", "mapped/src/one.js", C): (None, "missing"),
    ("node_modules/mapped/inner/z.js", "mapped/direct", M): ("node_modules/mapped/src/node.js", "file"),  # by its own name
    ("lib/own.js", "app/tools", C): ("lib/tools.js", "file"),
    ("lib/own.js", "app", M): ("main.js", "file"),
    ("sub/x.js", "app", M): (None, "missing"),
    ("main.js", "mixed", C): (None, "missing"),
    ("main.js", "text", C): ("node_modules/text/only.js", "file"),
    ("main.js", "text/more.js", C): (None, "missing"),
    ("main.js", "sugar", C): ("node_modules/sugar/r.js", "file"),
    ("main.js", "sugar", M): ("node_modules/sugar/i.js", "file"),
    ("main.js", "@scope/in", C): ("node_modules/@scope/in/lib/index.js", "file"),
    ("main.js", "@scope/in/lib/q", C): ("node_modules/@scope/in/lib/q.js", "file"),
    ("main.js", "@scope", C): (None, "missing"),
    ("main.js", "absent/x", C): (None, "missing"),
    ("main.js", "#own", C): ("lib/own.js", "file"),
    ("main.js", "#far", M): ("node_modules/legacy/out/start.js", "file"),
    ("main.js", "#far/extra.js", M): ("node_modules/legacy/extra.js", "file"),
    ("main.js", "#core", M): (None, "builtin"),
    ("main.js", "#lost", M): (None, "unresolved"),
    ("main.js", "#both", M): ("lib/a.mjs", "file"),
    ("main.js", "#both", C): ("lib/a.cjs", "file"),
    ("main.js", "#/x", M): (None, "unresolved"),
    ("main.js", "#no", M): (None, "unresolved"),
    ("sub/x.js", "#own", M): (None, "unresolved"),  # another package's map
    ("lib/t.ts", "./t.js", M): ("lib/t.ts", "file"),
    ("lib/t.ts", "./view", M): ("lib/view.tsx", "file"),
    ("lib/t.ts", "./types", M): (None, "skipped"),
    ("lib/t.ts", "./n.mjs", M): ("lib/n.mts", "file"),
    ("lib/tools.js", "./t", C): ("lib/t.js", "file"),
}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(f"/app/{f}", b"") for f in FILES] + [(f"{d}/package.json", (p if isinstance(p, str) else json.dumps(p)).encode()) for d, p in PACKAGES.items()]
    files = spark.createDataFrame(rows, "path string, content binary")
    return files.select("path").cache(), R.manifests(files).cache()


def test_resolution(spark, tree):
    asked = spark.createDataFrame([(f"/app/{f}", s, m) for f, s, m in WANT] * 2, "path string, spec string, mode string")
    got = {(r["path"][5:], r["spec"], r["mode"]): (r["target"] and r["target"][5:], r["outcome"]) for r in R.resolve(asked, *tree).collect()}
    assert {k: v for k, v in got.items() if v != WANT[k]} == {} and len(got) == len(WANT)


def test_packages(spark, tree):
    files, packages = tree
    of = {r["path"][5:]: r["dir"] for r in R.owners(files, packages).collect()}
    assert of["sub/x.js"] == "/app/sub" and of["node_modules/mapped/src/one.js"] == "/app/node_modules/mapped" and of["node_modules/bare/index.js"] == "/app"
    infos = {r["dir"]: (r["key"], r["main"]) for r in R.package_infos(files, packages).collect()}
    assert infos["/app/node_modules/legacy"] == ("legacy@?", "out/start.js") and infos["/app/node_modules/mapped"] == ("mapped@2.1.0", None)
    assert infos["/app/node_modules/@scope/in"] == ("@scope/in@?", "lib/index.js") and infos["/app/node_modules/broken"][0] == "<anonymous>@?"
    out = {r["path"][5:] for r in R.exported_files(files, R.targets(packages)).collect()}
    assert "node_modules/mapped/src/one.js" in out and "node_modules/mapped/src/very/two.js" not in out and "node_modules/text/more.js" not in out


def test_nothing_to_resolve(spark, tree):
    none = spark.createDataFrame([], "path string, spec string, mode string")
    assert R.resolve(none, *tree).count() == 0
    asked = spark.createDataFrame([("/a.js", "./b", "commonjs"), ("/a.js", "b", "module"), (None, "b", "module"), ("/a.js", None, "module")], "path string, spec string, mode string")
    files = spark.createDataFrame([("/b.js", None)], "path string, content binary")
    got = {(r["spec"], r["target"], r["outcome"]) for r in R.resolve(asked, files.select("path"), R.manifests(files)).collect()}
    assert got == {("./b", "/b.js", "file"), ("b", None, "missing")}


def test_a_name_is_resolved_once_for_all_folders_that_see_the_same_packages(spark, monkeypatch):
    """Also where a folder in between has packages of its own, and where a package asks for its own name."""
    m = [("/app/node_modules/x/package.json", '{"name": "x", "exports": "./x.js"}'), ("/app/p/node_modules/x/package.json", '{"name": "x", "main": "own.js"}'), ("/app/s/package.json", '{"name": "x", "exports": "./self.js"}')]
    manifests = spark.createDataFrame(m, "path string, content string")
    dirs = [f"/app/d{i}" for i in range(20)]
    paths = ["/app/node_modules/x/x.js", "/app/p/node_modules/x/own.js", "/app/s/self.js", "/app/s/t/a.js", "/app/p/q/a.js", *[f"{d}/a.js" for d in dirs]]
    files = spark.createDataFrame([(p,) for p in paths], "path string").union(manifests.select("path"))
    asking, size = [f"{d}/a.js" for d in dirs] + ["/app/p/q/a.js", "/app/s/t/a.js"], []
    plain = R.bare
    monkeypatch.setattr(R, "bare", lambda wanted, *rest: size.append(wanted.count()) or plain(wanted, *rest))
    asked = spark.createDataFrame([(p, "x", "commonjs") for p in asking for _ in range(2)], "path string, spec string, mode string")
    got = {r["path"]: (r["target"], r["outcome"]) for r in R.resolve(asked, files, R.manifests(manifests)).collect()}
    want = {p: ("/app/node_modules/x/x.js", "file") for p in asking} | {"/app/p/q/a.js": ("/app/p/node_modules/x/own.js", "file"), "/app/s/t/a.js": ("/app/s/self.js", "file")}
    assert got == want and size == [3]
