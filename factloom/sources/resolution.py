"""Which file a module specifier means, as joins: package manifests, `exports` and `imports` maps, node_modules folders.

Everything is a relation: files(path), manifests (one row a package.json), targets (one row a leaf of an `exports` or
`imports` map, in the order in which a resolver tries them) and requests (path, spec, mode). A request meets the folders
above it by a join on its ancestors, a map's keys by equality or, for patterns, within its own manifest; the best match is
an aggregate. Requests are first reduced to what decides about them: a path to where it leads, a name to the nearest folder
with packages installed, so that a module that everyone imports is resolved once for all folders that see the same packages.

Modes are `module` (import and export) and `commonjs` (require). What `module` cannot resolve is tried as `commonjs`. Files
of TypeScript are looked up with its own extensions first; the compiler's path mappings are not modelled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import cut
from .readers import EXTENSIONS

#: Fixed values of the public module system.
CONDITIONS = {"module": ("node", "import", "default"), "commonjs": ("node", "require", "default")}
BUILTINS = (
    "assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns dns/promises domain events fs fs/promises http http2 https "
    "inspector inspector/promises module net os path path/posix path/win32 perf_hooks process punycode querystring readline readline/promises repl stream stream/consumers "
    "stream/promises stream/web string_decoder sys timers timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib"
).split()
LOADABLE = (".js", ".json", ".node")
TYPED = (".ts", ".tsx", ".d.ts")
#: What a resolver rejects in a target or in what a pattern's star stands for.
BAD_SEGMENT = r"(?i)(^|[\\/])(\.{1,2}|node_modules)([\\/]|$)"
MANIFEST = "name string, version string, main string, exports string, imports string"


def normal(path: Column) -> Column:
    """An absolute path without empty, . and .. segments."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != ".") & (p != ""))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def ancestors(dir_: Column) -> Column:
    """The folder itself and all above it, the nearest first; the root is ''."""
    parts = F.split(dir_, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def manifests(files: DataFrame) -> DataFrame:
    """dir, name, version, main, exports, imports of files(path, content) named package.json; the maps are JSON texts. What
    is not JSON gives nulls, as does a main that is no string."""
    text = F.col("content").cast("string")
    x = files.where(F.col("path").endswith("/package.json")).select(folder(F.col("path")).alias("dir"), F.from_json(text, MANIFEST).alias("m")).select("dir", "m.*")
    return x.withColumn("main", F.when(~F.col("main").rlike(r"^[\[{]"), F.col("main")))


def targets(packages: DataFrame) -> DataFrame:
    """dir, kind (exports or imports), key, place, guard, conditions, target, bad: the leaves of all maps.

    place orders a key's leaves as they are tried. A leaf whose target is invalid ends the search, but for an enclosing
    array: guard is the place of the innermost array's item. bad leaves are errors of the manifest, which end it for good.
    An object with and without keys that start with a dot is invalid and has no leaves.
    """
    as_map = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
    dotted = lambda e: e["key"].startswith(".")
    x = packages.where("exports is not null").select("dir", F.lit("exports").alias("kind"), F.col("exports").alias("value"))
    x = x.withColumn("keys", F.when(F.col("value").startswith("{"), as_map(F.col("value"))))
    mixed = F.exists("keys", dotted) & F.exists("keys", lambda e: ~dotted(e))
    x = x.where(F.col("keys").isNull() | ~mixed)
    several = F.col("keys").isNotNull() & F.exists("keys", dotted)
    opened = F.when(several, F.col("keys")).otherwise(F.array(F.struct(F.lit(".").alias("key"), F.col("value").alias("value"))))
    tops = x.select("dir", "kind", F.explode(opened).alias("e"))
    y = packages.where("imports like '{%'").select("dir", F.lit("imports").alias("kind"), F.explode(as_map(F.col("imports"))).alias("e")).where("e.key like '#%'")
    ints, texts = F.array().cast("array<int>"), F.array().cast("array<string>")
    at = tops.union(y).select("dir", "kind", "e.key", ints.alias("place"), ints.alias("guard"), texts.alias("conditions"), F.col("e.value").alias("target"), F.lit(False).alias("bad"))
    done = []
    while True:  # one round a level of nesting
        nested = F.coalesce(F.col("target").rlike(r"^[\[{]"), F.lit(False)) & ~F.col("bad")
        done.append(at.where(~nested))
        deep = cut(at.where(nested))
        if deep.isEmpty():
            return reduce(DataFrame.union, done)
        listed = F.col("target").startswith("[")
        items = F.when(listed, F.transform(F.from_json("target", "array<string>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))).otherwise(as_map(F.col("target")))
        deep = deep.select("dir", "kind", "key", "place", "guard", "conditions", listed.alias("listed"), items.alias("items"))
        wrong = ~F.col("listed") & F.exists("items", lambda e: e["key"].rlike("^[0-9]+$"))
        deep = deep.withColumn("wrong", wrong).select("*", F.posexplode("items").alias("i", "e")).where("not wrong or i = 0")
        place = F.concat("place", F.array("i"))
        at = deep.select(
            "dir", "kind", "key", place.alias("place"), F.when(F.col("listed"), place).otherwise(F.col("guard")).alias("guard"),
            F.when(F.col("listed"), F.col("conditions")).otherwise(F.concat("conditions", F.array("e.key"))).alias("conditions"), F.col("e.value").alias("target"), F.col("wrong").alias("bad"),
        )


def map_keys(wanted: DataFrame, leaves: DataFrame) -> DataFrame:
    """wanted(dir, kind, sub, ..) with key, star: the map key that sub matches, an exact one or the pattern with the longest
    text before its star; star is what that stands for."""
    keys = leaves.select("dir", "kind", "key").distinct()
    x = wanted.where("sub not like '%/' or sub = './'").join(keys, ["dir", "kind"])
    head, tail = F.substring_index("key", "*", 1), F.substring_index("key", "*", -1)
    stars = F.length("key") - F.length(F.replace("key", F.lit("*")))
    exact = (F.col("key") == F.col("sub")) & (stars == 0)
    fits = (stars == 1) & (F.col("sub") != head) & F.col("sub").startswith(head) & F.col("sub").endswith(tail) & (F.length("sub") >= F.length("key"))
    x = x.where(exact | fits).withColumn("star", F.when(stars == 1, F.expr("substr(sub, length(substring_index(key, '*', 1)) + 1, length(sub) - length(key) + 1)")))
    order = F.struct(exact, F.length(head), F.length("key"))
    return x.groupBy(*wanted.columns).agg(F.max_by(F.struct("key", "star"), order).alias("k")).select(*wanted.columns, "k.*")


def map_targets(wanted: DataFrame, leaves: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(dir, kind, sub, mode) with target and bare: what the map of the manifest at dir gives for sub. bare: the target
    is a specifier itself. Nothing found: both null."""
    allowed = reduce(lambda a, m: F.when(F.col("mode") == m, F.array(*map(F.lit, CONDITIONS[m]))).otherwise(a), CONDITIONS, F.array(F.lit("default")))
    x = map_keys(wanted, leaves).join(leaves, ["dir", "kind", "key"]).withColumn("allowed", allowed)
    x = x.where(F.col("bad") | F.forall("conditions", lambda c: F.array_contains("allowed", c)))
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    inside = F.col("target").startswith("./")
    own = ~F.col("target").startswith("../") & ~F.col("target").startswith("/") & ~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (F.col("kind") == "imports")
    filled = F.when(F.col("star").isNull(), F.col("target")).otherwise(F.replace("target", F.lit("*"), F.col("star")))
    x = x.withColumn("file", F.when(inside, F.concat("dir", F.expr("'/'"), F.substring(filled, 3, 100000))))
    x = x.join(files.select(F.col("path").alias("file"), F.lit(True).alias("there")), "file", "left")
    status = (
        F.when(F.col("bad"), "error").when(F.col("target").isNull(), "none").when(~inside & own, "bare").when(~inside, "invalid")
        .when(decoded(F.substring("target", 3, 100000)).rlike(BAD_SEGMENT), "invalid").when(F.col("star").isNotNull() & decoded(F.col("star")).rlike(BAD_SEGMENT), "error")
        # A require takes the first target that is valid, an import the first one that exists.
        .when((F.col("mode") == "commonjs") | F.col("there"), "file").otherwise("none")
    )
    leaf = F.struct("place", status.alias("status"), F.when(F.col("status") == "error", F.array().cast("array<int>")).otherwise(F.col("guard")).alias("guard"), "file", filled.alias("spec"), "there")
    x = x.withColumn("status", status).groupBy(*wanted.columns).agg(F.sort_array(F.collect_list(leaf)).alias("l"))
    stopped = lambda v, i: F.exists(F.slice("l", F.lit(1), i), lambda w: w["status"].isin("invalid", "error") & (F.slice(v["place"], F.lit(1), F.size(w["guard"])) == w["guard"]))
    x = x.withColumn("hit", F.get(F.filter("l", lambda v, i: v["status"].isin("file", "bare") & ~stopped(v, i)), F.lit(0)))
    return wanted.join(x.select(*wanted.columns, F.when((F.col("hit.status") == "file") & F.col("hit.there"), F.col("hit.file")).alias("target"), F.when(F.col("hit.status") == "bare", F.col("hit.spec")).alias("bare")), wanted.columns, "left")


def package_name(spec: str) -> Column:
    """The package that a specifier names."""
    return F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)


def _nearest(dirs: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    """dir, name: the nearest folder of marked(dir) at or above dir."""
    x = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias(name)).join(marked.select(F.col("dir").alias(name)), name)
    return x.groupBy("dir").agg(F.max_by(name, F.length(name)).alias(name))


def scopes(dirs: DataFrame, packages: DataFrame) -> DataFrame:
    """dir, scope: the nearest manifest at or above dir; a node_modules folder in between hides what is above it."""
    return _nearest(dirs, packages, "scope").where(~F.expr("substr(dir, length(scope) + 1)").rlike("(^|/)node_modules(/|$)"))


def installed(files: DataFrame, packages: DataFrame) -> DataFrame:
    """at, host, mapped: the folders of packages in node_modules, the folder above that, and whether they have exports."""
    there = files.select(F.explode(ancestors(folder(F.col("path")))).alias("at")).where(F.col("at").rlike(r"(^|/)node_modules/(@[^/]+/)?[^@/][^/]*$")).distinct()
    there = there.join(packages.select(F.col("dir").alias("at"), F.col("exports").isNotNull().alias("mapped")), "at", "left")
    return there.select("at", F.regexp_replace("at", r"/?node_modules/(@[^/]+/)?[^@/][^/]*$", "").alias("host"), F.coalesce("mapped", F.lit(False)).alias("mapped"))


def placed(wanted: DataFrame, packages: DataFrame, there: DataFrame) -> DataFrame:
    """wanted(dir, spec, ..) with scope, itself and origin. What a name means depends on the folder that asks only by the nearest
    folder with packages installed, its origin, from which bare() searches; unless the package asks for its own name."""
    dirs = cut(wanted.select("dir").distinct())
    own = scopes(dirs, packages).join(packages.select(F.col("dir").alias("scope"), F.when(F.col("exports").isNotNull(), F.col("name")).alias("own")), "scope")
    home = _nearest(dirs, there.select(F.col("host").alias("dir")).distinct(), "home")
    places = cut(dirs.join(own, "dir", "left").join(home, "dir", "left"))
    itself = F.coalesce(F.col("own") == package_name("spec"), F.lit(False))
    x = wanted.join(places, "dir").withColumn("itself", itself)
    return x.withColumn("origin", F.when(F.col("itself"), F.col("dir")).otherwise(F.coalesce("home", F.lit("")))).drop("own", "home")


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, dir: the package that a file belongs to: the nearest manifest above it that is a package's root (within
    node_modules only one directly below such a folder, or below a scope's folder there)."""
    root = ~F.col("dir").contains("node_modules") | F.col("dir").rlike(r"(^|/)node_modules/(@[^/]+/)?[^/]+$")
    x = files.select("path", F.explode(ancestors(folder(F.col("path")))).alias("dir")).join(packages.where(root).select("dir"), "dir")
    return x.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def package_infos(files: DataFrame, packages: DataFrame) -> DataFrame:
    """dir, key (name@version), name, version, main (a file, relative to dir) of every package."""
    named = packages.select("dir", F.coalesce("name", F.lit("<anonymous>")).alias("name"), "version", "main")
    found = first_file(named.where("main is not null").select("dir", F.concat("dir", F.lit("/"), "main").alias("at")), files, packages, ("dir",), loadable=LOADABLE)
    main = found.select("dir", F.expr("substr(target, length(dir) + 2)").alias("file"))
    return named.drop("main").join(main, "dir", "left").select("dir", F.concat("name", F.lit("@"), F.coalesce("version", F.lit("?"))).alias("key"), "name", "version", F.col("file").alias("main"))


def exported_files(files: DataFrame, leaves: DataFrame) -> DataFrame:
    """path, dir: files that any leaf of a package's exports names, a star standing for what has no slash."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("rest", r"([\\.+?()\[\]{}^$|])", r"\\$1"), r"\*", "[^/]*"), F.when(F.col("rest").endswith("/") | (F.col("rest") == ""), ".*").otherwise(""), F.lit("$"))
    x = leaves.where("kind = 'exports' and target like './%'").select("dir", F.substring("target", 3, 100000).alias("rest")).distinct().select("dir", pattern.alias("p"))
    below = files.select("path", F.explode(ancestors(folder(F.col("path")))).alias("dir"))
    return below.join(x, "dir").where("substr(path, length(dir) + 2) rlike p").select("path", "dir").distinct()


def first_file(wanted: DataFrame, files: DataFrame, packages: DataFrame, key: tuple[str, ...], *, loadable: tuple[str, ...], typed: Column | None = None) -> DataFrame:
    """key.., target: the first of the places where a require looks for wanted(key.., at): the file, with an extension, the
    main file of a folder, its index. Rows for which typed holds look for TypeScript's files first."""
    at = (wanted if "only_folder" in wanted.columns else wanted.withColumn("only_folder", F.lit(False))).withColumn("at", normal(F.col("at")))
    mains = packages.where("main is not null").select(F.col("dir").alias("at"), F.col("main"))
    at = at.join(mains, "at", "left").withColumn("typed", typed if typed is not None else F.lit(False))
    main = normal(F.concat("at", F.lit("/"), "main"))
    swapped = F.regexp_replace("at", r"\.([mc]?)js(x?)$", ".$1ts$2")
    none = F.lit(None).cast("string")
    of_file = [F.when(F.col("typed") & (swapped != F.col("at")), swapped).otherwise(none), F.when(F.col("typed") & F.col("at").rlike(r"\.jsx?$"), F.regexp_replace("at", r"\.jsx?$", ".tsx")).otherwise(none)]
    of_file += [F.col("at")] + [F.when(F.col("typed"), F.concat("at", F.lit(e))).otherwise(none) for e in TYPED] + [F.concat("at", F.lit(e)) for e in loadable]
    of_folder = [main] + [F.concat(main, F.lit(e)) for e in loadable] + [F.concat(main, F.lit(f"/index{e}")) for e in loadable]
    of_folder += [F.when(F.col("typed"), F.concat("at", F.lit(f"/index{e}"))).otherwise(none) for e in TYPED] + [F.concat("at", F.lit(f"/index{e}")) for e in loadable]
    tries = F.array(*[F.when(~F.col("only_folder"), c) for c in of_file], *of_folder)
    x = at.select(*key, F.posexplode(tries).alias("_turn", "_file")).where("_file is not null").join(files.select(F.col("path").alias("_file")), "_file", "left_semi")
    return x.groupBy(*key).agg(F.min_by("_file", "_turn").alias("target"))


def bare(wanted: DataFrame, files: DataFrame, packages: DataFrame, leaves: DataFrame, there: DataFrame) -> DataFrame:
    """origin, itself, spec, mode, target of wanted(origin, itself, spec, mode) that name packages (see placed), for one mode
    each: the package itself if it exports under its own name, else the nearest node_modules folders. A package that has exports
    decides; one without is searched, and the search goes on upwards where it has no such file."""
    x = wanted.withColumn("name", package_name("spec")).where(F.col("name").rlike(r"^[^.\\%][^\\%]*$"))
    x = x.withColumn("sub", F.concat(F.lit("."), F.expr("substr(spec, length(name) + 1)")))
    key = ["origin", "itself", "spec", "mode"]
    own = x.where("itself")
    scope = scopes(own.select(F.col("origin").alias("dir")).distinct(), packages).withColumnRenamed("dir", "origin")
    itself = own.join(scope, "origin").select(*key, "sub", F.lit(-1).alias("i"), F.col("scope").alias("at"), F.lit(True).alias("mapped"))
    up = x.select(*key, "sub", "name", F.posexplode(ancestors(F.col("origin"))).alias("i", "a")).withColumn("at", F.concat("a", F.lit("/node_modules/"), "name"))
    near = itself.unionByName(up.join(there, "at").select(*key, "sub", "i", "at", "mapped"))
    maps = near.where("mapped").select(F.col("at").alias("dir"), F.lit("exports").alias("kind"), "sub", "mode").distinct()
    by_map = map_targets(maps, leaves, files).select(F.col("dir").alias("at"), "sub", "mode", "target")
    out = near.where("mapped").join(by_map, ["at", "sub", "mode"], "left").select(*key, "i", "target", (F.col("i") >= 0).alias("last"))
    plain = near.where("not mapped").withColumn("place", F.concat("at", F.expr("substr(sub, 2)")))
    # An import without a map takes the file as it is named, the main file or index.js.
    strict = plain.where("mode = 'module'").join(packages.select(F.col("dir").alias("at"), "main"), "at", "left")
    options = F.when(F.col("sub") == ".", F.array(normal(F.concat("at", F.lit("/"), "main")), F.concat("at", F.lit("/index.js")))).otherwise(F.array(normal(F.col("place"))))
    strict = strict.select(*key, "i", F.posexplode(options).alias("o", "path")).join(files.select("path"), "path", "left_semi").groupBy(*key, "i").agg(F.min_by("path", "o").alias("target"))
    loose = first_file(plain.where("mode = 'commonjs'").select(*key, "i", F.col("place").alias("at"), (F.col("sub") == ".").alias("only_folder")), files, packages, (*key, "i"), loadable=LOADABLE)
    out = out.unionByName(strict.union(loose).withColumn("last", F.lit(True)).select(out.columns))
    out = out.where("target is not null or last")
    return out.groupBy(*key).agg(F.min_by(F.struct("target"), "i").alias("t")).select(*key, "t.target")


def resolve(requests: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, spec, mode, target, outcome for requests(path, spec, mode) among files(path), which are absolute paths.

    outcome: file; builtin; skipped (JSON, native add-ons, declarations, other extensions, data and web addresses);
    missing (a name that no folder has: it stands for a module not installed); unresolved (a path that leads nowhere,
    an absolute one, an import map without that name). target is null but for files.
    """
    files = files.select("path").distinct()
    leaves, there = cut(targets(packages)), cut(installed(files, packages))
    # Requests are told once a row; what they need is told once for all that need the same: key.
    asked = cut(requests.select("path", "spec", "mode").where("path is not null and spec is not null and mode is not null"))
    core = F.regexp_replace("spec", "^node:", "")
    kind = (
        F.when(F.col("spec").startswith("node:") | core.isin(BUILTINS), "builtin").when(F.col("spec").startswith("file:"), "file").when(F.col("spec").rlike("^(data|https?):"), "skipped")
        .when(F.col("spec").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.col("spec").startswith("/") | (F.col("spec") == ""), "none")
        .when(F.col("spec").rlike(r"^\.\.?(/|$)"), "relative").when(F.col("spec").startswith("#"), F.when((F.col("spec") == "#") | F.col("spec").startswith("#/") | F.col("scope").isNull(), "none").otherwise("imports"))
        .otherwise("bare")
    )
    key = ["kind", "origin", "itself", "what", "by", "typed"]
    of = lambda *kinds: F.col("kind").isin(*kinds)
    folder_only = F.col("spec").rlike(r"(/|^\.|/\.|^\.\.|/\.\.)$")
    asked = placed(asked.withColumn("dir", folder(F.col("path"))), packages, there).withColumn("kind", kind).select(
        "path", "spec", "mode", "kind",
        F.when(of("relative"), normal(F.concat("dir", F.lit("/"), "spec"))).when(of("imports"), F.col("scope")).when(of("bare"), F.col("origin")).otherwise("").alias("origin"),
        (of("bare") & F.col("itself")).alias("itself"),
        F.when(of("relative"), F.when(folder_only, "/").otherwise("")).when(of("imports", "bare", "file"), F.col("spec")).otherwise("").alias("what"),
        F.when(of("imports", "bare"), F.col("mode")).otherwise("").alias("by"), (of("relative") & F.col("path").rlike(r"\.[mc]?tsx?$")).alias("typed"),
    )
    each = cut(asked.select(*key).distinct())

    place = ("origin", "what", "typed")
    relative = first_file(each.where(of("relative")).select(*place, F.col("origin").alias("at"), (F.col("what") == "/").alias("only_folder")), files, packages, place, loadable=LOADABLE, typed=F.col("typed"))
    relative = each.where(of("relative")).join(relative, [*place]).select(*key, "target")
    address = each.where(of("file")).withColumn("target", F.expr("regexp_replace(what, '^file:(//[^/]*)?', '')")).withColumn("target", F.coalesce(F.try_url_decode("target"), "target"))
    address = address.where(~F.col("what").rlike("(?i)%2f|%5c")).withColumn("target", F.regexp_replace("target", "[?#].*$", "")).join(files.withColumnRenamed("path", "target"), "target", "left_semi").select(*key, "target")

    # Names and import maps: as asked for, then as a require.
    named = each.where(of("bare", "imports")).select("kind", "origin", "itself", F.col("what").alias("spec"), F.explode(F.when(F.col("by") == "module", F.array(F.lit("module"), F.lit("commonjs"))).otherwise(F.array("by"))).alias("mode")).distinct()
    mapped = map_targets(named.where(of("imports")).select(F.col("origin").alias("dir"), F.lit("imports").alias("kind"), F.col("spec").alias("sub"), "mode"), leaves, files)
    mapped = cut(mapped.select("dir", F.col("sub"), "mode", "target", "bare"))
    through = cut(placed(mapped.where("bare is not null").select("dir", "sub", "mode", F.col("bare").alias("spec")), packages, there))
    wanted = ["origin", "itself", "spec", "mode"]
    found = cut(bare(named.where(of("bare")).select(*wanted).union(through.select(*wanted)).distinct(), files, packages, leaves, there))
    through = through.join(found, wanted, "left").select("dir", "sub", "mode", F.col("target").alias("t"))
    private = mapped.join(through, ["dir", "sub", "mode"], "left").select(
        F.lit("imports").alias("kind"), F.col("dir").alias("origin"), F.lit(False).alias("itself"), F.col("sub").alias("what"), "mode", F.coalesce("target", "t").alias("target"),
        (F.col("target").isNull() & F.col("bare").isin(BUILTINS)).alias("core"),
    )
    modes = private.union(found.select(F.lit("bare"), "origin", "itself", "spec", "mode", "target", F.lit(False)))
    tried = each.join(modes, ["kind", "origin", "itself", "what"]).where("by = mode or (by = 'module' and mode = 'commonjs')")
    best = tried.where("target is not null or core").groupBy(*key).agg(F.max_by(F.struct("target", "core"), F.col("by") == F.col("mode")).alias("b")).select(*key, "b.target", "b.core")

    hit = relative.union(address).withColumn("core", F.lit(False)).union(best)
    out = each.join(hit, key, "left")
    known = F.col("target").rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$") & ~F.col("target").endswith(".d.ts")
    outcome = (
        F.when((F.col("kind") == "builtin") | F.col("core"), "builtin").when(F.col("kind") == "skipped", "skipped").when(F.col("target").isNotNull() & known, "file")
        .when(F.col("target").isNotNull(), "skipped").when(F.col("kind") == "bare", "missing").otherwise("unresolved")
    )
    out = cut(out.select(*key, F.when(known, F.col("target")).alias("target"), outcome.alias("outcome")))
    # Equal requests need the same, so that one shuffle makes them distinct and brings them their answers.
    return asked.repartition(*key).distinct().join(out, key).select("path", "spec", "mode", "target", "outcome")
