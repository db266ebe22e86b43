import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import compare, fixpoint, paths, pointsto, reports, sinks, vulnerabilities
from factloom.patterns import language as L
from factloom.patterns.compiler import Matcher
from factloom.sources import readers


def graph(seed, n, m):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def reach(edges, seeds):
    out, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_components(spark, seed):
    e = graph(seed, 30, 45)
    df = spark.createDataFrame(e, "src long, dst long")
    got = {r["node"] for r in fixpoint.closure(df, spark.createDataFrame([(0,), (1,)], "node long")).collect()}
    assert got == reach(e, {0, 1})
    nodes = {x for p in e for x in p}
    r = {x: reach(e, {x}) for x in nodes}
    scc = {x: min(y for y in nodes if y in r[x] and x in r[y]) for x in nodes}
    assert {x["node"]: x["component"] for x in fixpoint.strong_components(df).collect()} == scc
    both = e + [(b, a) for a, b in e]
    assert {x["node"]: x["label"] for x in fixpoint.connected_labels(df, spark.createDataFrame([(x,) for x in nodes], "node long")).collect()} == {x: min(reach(both, {x})) for x in nodes}


def test_condensation_keeps_the_solution(spark):
    e = graph(5, 20, 40)
    edges = spark.createDataFrame(e, "src long, dst long")
    pts = spark.createDataFrame([(0, "a"), (3, "b"), (7, "c")], "var_id long, tok_id string")
    full = {tuple(r) for r in pointsto.propagate(pts, edges).select("var_id", "tok_id").collect()}
    rep = fixpoint.strong_components(edges, pts.select(F.col("var_id").alias("node")))
    small = pointsto.propagate(*pointsto.condense(pts, edges, rep))
    back = rep.join(small, rep["component"] == small["var_id"]).select("node", "tok_id")
    assert {tuple(r) for r in back.collect()} == full


@pytest.mark.parametrize("seed", [3, 4])
def test_labels_spread_over_cycles(spark, seed):
    e = graph(seed, 25, 40)
    seeds = [("a", 0), ("b", 3), ("b", 0), ("c", 99)]  # 99 is in no edge
    got = fixpoint.spread(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame(seeds, "k string, node long"), ("k",))
    want = sorted((k, y) for k in "abc" for y in reach(e, {n for l, n in seeds if l == k}))
    assert sorted((r["k"], r["node"]) for r in got.collect()) == want


def test_labels_spread_without_edges(spark):
    none, seeds = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, node long")
    key = lambda r: (r["k"], r["node"])
    assert {key(r) for r in fixpoint.spread(none, seeds, ("k",)).collect()} == {("a", 1), ("b", None)}
    assert fixpoint.spread(none, seeds.limit(0), ("k",)).collect() == []


def facts(spark, **rows):
    return {k: spark.createDataFrame(v, pointsto.SCHEMAS[k]) for k, v in rows.items()}


def solved(spark, **rows):
    s = pointsto.solve_points_to(spark, facts(spark, **rows))
    pts = {}
    for r in s["pts"].collect():
        pts.setdefault(r["var"], set()).add(r["tok"])
    return pts, {(r["call"], r["fn"]) for r in s["edge"].collect()}


def test_points_to_properties_and_prototypes(spark):
    pts, _ = solved(
        spark,
        token=[("o", "object", None), ("p", "object", None), ("v", "object", None), ("w", "object", None)],
        pts=[("n:x", "o"), ("n:v", "v"), ("n:w", "w"), ("n:y", "p")],
        inherits=[("o", "p")], read=[("n:x", "f", "n:r"), ("n:x", "g", "n:s")], write=[("n:x", "f", "n:v"), ("n:y", "g", "n:w")],
    )
    assert pts["n:r"] == {"v"} and pts["n:s"] == {"w"}


def test_points_to_calls(spark):
    pts, edges = solved(
        spark,
        token=[("f", "function", 1), ("o", "object", None), ("a", "object", None), ("C", "function", 0)],
        pts=[("n:o", "o"), ("P:o:m", "f"), ("n:a", "a"), ("n:C", "C")], subset=[("A:f:0", "R:f")],
        call=[("c1", None, "n:o", "m", "n:r", False), ("c2", "n:C", None, None, "n:i", True)], arg=[("c1", 0, "n:a"), ("c1", 1, "n:a")],
    )
    assert edges == {("c1", "f"), ("c2", "C")}
    assert pts["n:r"] == {"a"} and pts["T:f"] == {"o"} and pts["n:i"] == {"new C"}


def test_points_to_accessors_and_arrays(spark):
    pts, _ = solved(
        spark,
        token=[("g", "function", 0), ("s", "function", 1), ("o", "object", None), ("v", "object", None), ("arr", "array", None)],
        pts=[("n:o", "o"), ("G:o:x", "g"), ("R:g", "v"), ("S:o:y", "s"), ("n:v", "v"), ("n:arr", "arr"), ("P:arr:3", "v")],
        read=[("n:o", "x", "n:r"), ("n:arr", "%ARRAY_ALL", "n:e")], write=[("n:o", "y", "n:v")],
    )
    assert pts["n:r"] == {"v"} and pts["A:s:0"] == {"v"} and pts["n:e"] == {"v"} and pts["T:g"] == {"o"}


def test_points_to_setters_of_bases_reached_later(spark):
    pts, _ = solved(
        spark,
        token=[("s", "function", 1), ("t", "function", 1), ("o", "object", None), ("v", "object", None)],
        pts=[("n:a", "o"), ("S:o:y", "s"), ("n:v", "v"), ("n:t", "t"), ("n:o", "o")],
        subset=[("n:a", "n:b"), ("n:b", "n:c"), ("n:t", "n:u"), ("n:u", "S:o:z")], write=[("n:c", "y", "n:v"), ("n:o", "z", "n:v")],
    )
    assert pts["A:s:0"] == {"v"} and pts["T:s"] == {"o"}  # the base arrives after the setter
    assert pts["A:t:0"] == {"v"} and pts["T:t"] == {"o"}  # the setter after the base


def test_semi_naive_equals_naive(spark):
    e = graph(9, 12, 20)
    rules = [fixpoint.Rule("step", ("path", "edge"), lambda r: {"path": r["path"].join(r["edge"].toDF("b", "c"), "b").select("a", F.col("c").alias("b"))})]
    edge = spark.createDataFrame(e, "a long, b long")
    got = {tuple(x) for x in fixpoint.solve({"path": edge, "edge": edge}, rules)["path"].collect()}
    assert got == {(a, y) for a in {a for a, _ in e} for b in {b for x, b in e if x == a} for y in reach(e, {b})}


@pytest.mark.parametrize("text", [
    "call <a>.f", "write <a>.b.c", "read {<a>,<b>}.f.g", "read <a>?**.p", "call <a>?**.q base:T", "read <a{,/**/*}>?**.p base:T", "read <a>()?.json", "call <a>.filter()",
    'call <a>.foo 0:Foo 1:string 2:"bar" 3:function2 5:42 6:{number,null}', "read <a>.{do,catch}", "callPromise <a>.b [1,2] -1.x:any", "read (<a>.b\\<c>).d", "component <a>.B", "importD <x>",
])
def test_pattern_round_trip(text):
    assert str(L.parse(text)) == text and L.parse(str(L.parse(text))) == L.parse(text)


@pytest.mark.parametrize("text", ["", "call", "read <a>", "read <a>.f extra", "import <a>.b", "call <a", "call <a>.f [1"])
def test_pattern_errors(text):
    with pytest.raises(L.PatternError):
        L.parse(text)


def test_pattern_versions():
    rows = L.convert([{"semanticPatchId": "x", "version": 1, "semanticPatch": {"detectionPattern": "read <a>.b"}}, {"semanticPatchId": "x", "version": 2, "enabled": False, "semanticPatch": {"detectionPattern": "read <a>.b"}}, {"id": "y", "pattern": "import <a>"}])
    assert [r["id"] for r in L.newest(rows)] == ["y"]


def test_pattern_levels(spark):
    # x = import a; x.f at node 2 (certain), and at node 3 whose base also holds another object
    sites = spark.createDataFrame([("module", None, "a", 1, 10, None, 7), ("read", 10, "f", 2, 11, 100, 7), ("read", 10, "f", 3, 11, 101, 7), ("call", 11, None, 4, 12, 102, 7), ("read", 10, "default", 5, 13, 100, 7)], "kind string, base_ap long, prop string, node_id long, bp long, sub_var long, encl long")
    pts = spark.createDataFrame([(100, "t", 10), (101, "t", 10), (101, "o", None), (102, "u", 11)], "var_id long, tok_id string, ap_id long")
    m = Matcher(sites, pts)
    got = {(r["node_id"], r["certain"]) for r in m.detect(L.parse("read <a>.f")).collect()}
    assert got == {(2, True), (3, False)}
    assert {(r["node_id"], r["certain"]) for r in m.detect(L.parse("call <a>.f")).collect()} == {(4, True), (4, False)}  # one place may be in both levels; only a disjunction settles it
    assert {r["node_id"] for r in m.detect(L.parse("import a")).collect()} == {1, 5}
    assert {r["node_id"] for r in m.detect(L.parse("read (<a>.f\\<a>.f).g")).collect()} == set()
    nodes = spark.createDataFrame([(4, False, True, False, False, 2, False, False)], "node_id long, is_default_import boolean, maybe_promise boolean, is_new boolean, unused boolean, n_args int, has_spread boolean, import_local boolean")
    assert m.detect(L.parse("call <a>.f [3,]"), nodes).count() == 0
    assert {tuple(r["uncertainties"]) for r in m.detect(L.parse("callPromise <a>.f [1,2]"), nodes).collect()} == {("maybePromiseMatch",), ("accessPath", "maybePromiseMatch")}


def call_graph_file(tmp_path, name, functions, calls, f2f, c2f, **more):
    p = tmp_path / name
    p.write_text(json.dumps({"entries": ["a.js"], "files": ["a.js"], "functions": functions, "calls": calls, "fun2fun": f2f, "call2fun": c2f, "ignore": [], "time": "t"} | more))
    return str(p)


def test_compare_call_graphs(spark, tmp_path):
    fs, cs = ["0:1:1:9:1", "0:2:1:3:1", "0:2:5:3:1"], ["0:5:1:5:4", "0:6:1:6:4"]
    a = readers.call_graph(spark, call_graph_file(tmp_path, "a.json", fs, cs, [[0, 1], [0, 2]], [[0, 1], [1, 2]]))
    b = readers.call_graph(spark, call_graph_file(tmp_path, "b.json", {str(i): x for i, x in enumerate(fs)}, {"10": cs[0], "11": cs[1]}, [[0, 1]], [[10, 1]]))
    r = compare.compare(a, b).first().asDict()
    # Functions 1 and 2 end alike, so each is an image of the other.
    assert (r["fun_found"], r["fun_total"], r["call_found"], r["call_total"]) == (2, 2, 1, 2)
    assert r["precision"] == pytest.approx(0.75) and r["recall"] == pytest.approx(0.5)
    assert (r["reachable_found"], r["reachable_total"]) == (3, 3)
    out = json.loads(sinks.call_graph_json(b.files, b.functions, b.calls, b.fun2fun, b.call2fun).first()["json"])
    assert out["files"] == ["a.js"] and out["calls"] == cs and out["call2fun"] == [[0, 1]]


def test_merge_is_idempotent(spark):
    f = spark.createDataFrame([(g, i, loc) for g in (0, 1) for i, loc in enumerate(["x", "y", "z"])], "g int, id int, loc string")
    e = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 1, 2), (0, 0, 9)], "g int, src int, dst int")
    fs, es = compare.merge(f, e)
    assert {tuple(r) for r in fs.collect()} == {("x", 0), ("y", 1), ("z", 2)}
    assert {tuple(r) for r in es.collect()} == {(0, 1), (1, 2)}


def test_k_shortest_paths(spark):
    g = spark.createDataFrame([("v", "s", "a", 1.0), ("v", "s", "b", 2.0), ("v", "a", "target", 1.0), ("v", "a", "b", 0.5), ("v", "b", "target", 1.0)], "g string, src string, dst string, weight double")
    best = paths.best_paths(g, spark.createDataFrame([("v", "s")], "g string, source string"), 5).collect()
    assert [(r["weight"], tuple(r["path"])) for r in sorted(best, key=lambda r: r["rank"])] == [(2.0, ("s", "a", "target")), (2.5, ("s", "a", "b", "target")), (3.0, ("s", "b", "target"))]
    edges = spark.createDataFrame([("v", "s", "a", 1.0), ("v", "a", "target", 4.0)], "vuln_id string, src string, dst string, weight double")
    r = vulnerabilities.call_stacks(edges, spark.createDataFrame([("v", "s")], "vuln_id string, source string")).first()
    assert (r["frames"], r["confidence"]) == (["s", "a"], 0.2)
    # Edges that leave the way, and those of another vulnerability, change nothing.
    more = edges.union(spark.createDataFrame([("v", "a", "dead", 0.1), ("v", "x", "target", 0.1), ("u", "s", "target", 0.1), ("u", "a", "target", 0.1)], edges.schema))
    assert [(r["frames"], r["weight"]) for r in vulnerabilities.call_stacks(more, spark.createDataFrame([("v", "s")], "vuln_id string, source string")).collect()] == [(["s", "a"], 5.0)]


def test_affected_packages(spark):
    p = spark.createDataFrame([(1, "a", "1.0.0"), (2, "a", "2.0.0"), (3, "a", None), (4, "b", "1.0.0-rc.1")], "pkg_id int, name string, version string")
    adv = spark.createDataFrame([("N", "a", "<2.0.0", None, None), ("O", "b", None, [], [[{"introduced": "0"}, {"fixed": "1.0.0"}]])], "vuln_id string, name string, range string, versions array<string>, ranges array<array<map<string,string>>>")
    assert {tuple(r) for r in vulnerabilities.affected_packages(p, adv).collect()} == {(1, "N"), (3, "N"), (4, "O")}


def test_module_resolution(spark):
    files = spark.createDataFrame([("/p/a.js",), ("/p/lib/index.ts",), ("/p/lib/b.mjs",)], "path string")
    specs = spark.createDataFrame([("/p/a.js", "./lib"), ("/p/lib/b.mjs", "../a"), ("/p/a.js", "./none"), ("/p/a.js", "pkg")], "path string, spec string")
    got = {(r["spec"], r["target"]) for r in readers.resolve_modules(specs, files).collect()}
    assert got == {("./lib", "/p/lib/index.ts"), ("../a", "/p/a.js"), ("./none", None)}
    dirs = readers.nearest_package(files, spark.createDataFrame([("/p",), ("/p/lib",)], "dir string"))
    assert {tuple(r) for r in dirs.collect()} == {("/p/a.js", "/p"), ("/p/lib/index.ts", "/p/lib"), ("/p/lib/b.mjs", "/p/lib")}


def test_source_scan(spark, tmp_path):
    (tmp_path / "a.js").write_text("const x = require('m1'); import y from \"m2\"; import('m3')")
    (tmp_path / "tool").write_text("#!/usr/bin/env node\nrequire('m4')")
    (tmp_path / "t.d.ts").write_text("import 'no'")
    files = readers.source_files(spark, str(tmp_path))
    assert {r["spec"] for r in readers.module_strings(files).collect()} == {"m1", "m2", "m3", "m4"}


def test_hint_stream(spark, tmp_path):
    from factloom.streaming import hints

    src = tmp_path / "hints"
    src.mkdir()
    body = {"modules": ["m.js"], "functions": ["0:1:1:2:2"], "reads": [{"loc": "0:3:1:3:4", "prop": "p", "valLoc": "0:1:1:2:2", "valType": "Function"}], "writes": [], "requires": [], "evals": []}
    for n in ("a", "b"):
        (src / f"{n}.json").write_text(json.dumps(body))
    q = hints.stream(spark, str(src), "reads").writeStream.format("memory").queryName("got_reads").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from got_reads").collect()] == [("m.js:3:1:3:4", "p", "m.js:1:1:2:2", "Function")]
    seen = []
    hints.ingest(spark, str(src), str(tmp_path / "ck"), lambda rel, n: seen.append(rel["functions"].count())).awaitTermination()
    assert sum(seen) == 1


def test_graphviz(spark):
    nodes = spark.createDataFrame([("f", "m", 'a"b')], "id string, parent string, label string")
    edges = spark.createDataFrame([("f", "f")], "src string, dst string")
    lines = [r["line"] for r in sinks.graphviz(nodes, edges).collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and '"f" -> "f"' in lines[2]


def test_reports_on_empty_tables(spark):
    empty = spark.createDataFrame([], "call_id long, fn_id long")
    calls = spark.createDataFrame([(1, True, False)], "call_id long, is_native boolean, is_external boolean")
    assert [tuple(r) for r in reports.zero_callee_calls(calls, empty).collect()] == [(True, False, 1)]
    assert reports.callee_histogram(empty).count() == 0


def test_functions_without_callers(spark):
    fn = spark.createDataFrame([(1,), (2,), (3,)], "fn_id long")
    edge = spark.createDataFrame([(1, 2), (1, 2), (2, 2)], "src long, dst long")
    assert sorted(r["fn_id"] for r in reports.zero_caller_functions(fn, edge).collect()) == [1, 3]


def test_labels_that_start_together_travel_once(spark):
    ring, labels = 30, 50
    edges = spark.createDataFrame([(i, (i + 1) % ring) for i in range(ring)] + [(0, 100), (100, 101), (101, 102)], "src long, dst long")
    seeds = spark.createDataFrame([(k, k % ring) for k in range(labels)] + [(k, 101) for k in range(labels)] + [(99, 102)], "k long, node long")
    got = fixpoint.shared(edges, seeds, ("k",))
    assert got.reached.count() == 5  # the ring's class reaches four components, the other label one
    want = {(n, k) for n in [*range(ring), 100, 101, 102] for k in range(labels)} | {(102, 99)}
    assert sorted((r["node"], r["k"]) for r in got.rows().collect()) == sorted(want)
    assert {r["node"]: r["n"] for r in got.sizes().collect()} == {n: sum(m == n for m, _ in want) for n, _ in want}
    nodes, sets, n = got.grouped()
    assert n == 2 and {(r["node"], r["k"]) for r in got.expanded(nodes.join(sets, "_set")).collect()} == want


def test_labels_travel_as_bits_of_words(spark):
    """Layers without cycles, in which every label starts at nodes of its own."""
    width, layers, labels = 12, 5, 150
    pairs = [(10 * width * d + i, 10 * width * (d + 1) + j) for d in range(layers - 1) for i in range(width) for j in range(width) if (i + j + d) % 4]
    starts = [(k, 10 * width * (k % 3) + k % width) for k in range(labels)] + [(k, 10 * width + (k * k + 1) % width) for k in range(labels)] + [(k, 9999) for k in range(0, labels, 70)]
    got = fixpoint.shared(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(starts, "k long, node long"), ("k",))
    want, more = set(), {(n, k) for k, n in starts}
    while more:
        want |= more
        more = {(b, k) for n, k in more for a, b in pairs if a == n} - want
    assert sorted((r["node"], r["k"]) for r in got.rows().collect()) == sorted(want)
    nodes = {n for n, _ in want}
    assert {r["node"]: r["n"] for r in got.sizes().collect()} == {n: sum(m == n for m, _ in want) for n in nodes}
    assert got.packed.count() <= len(nodes) * -(-labels // fixpoint.WORD) < got.reached.count()
    some = spark.createDataFrame([(n,) for n in sorted(nodes)[::7]], "node long")
    assert sorted((r["node"], r["k"]) for r in got.among(some).collect()) == sorted((n, k) for n, k in want if n in sorted(nodes)[::7])
    of, sets, n = got.grouped()
    assert {(r["node"], r["k"]) for r in got.expanded(of.join(sets, "_set")).collect()} == want and n == len({frozenset(k for m, k in want if m == x) for x in nodes})
