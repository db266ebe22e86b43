"""Readers of call graphs, hints, patterns, advisories and source files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_location
from ..operators.compare import CallGraph
from ..patterns.language import convert, newest, parse

CALL_GRAPH = "entries array<string>, files array<string>, functions string, calls string, fun2fun array<array<int>>, call2fun array<array<int>>, ignore array<string>, time string, ignoreDependencies boolean, includePackages array<string>, excludePackages array<string>"
HINTS = "modules array<string>, functions array<string>, reads array<struct<loc:string,prop:string,valLoc:string,valType:string>>, writes array<struct<type:string,loc:string,baseLoc:string,baseType:string,prop:string,valLoc:string,valType:string>>, requires array<struct<loc:string,str:string>>, evals array<struct<loc:string,str:string>>"
ADVISORIES = "osv struct<id:string,summary:string,affected:array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>>, npm struct<name:string,range:string,url:string,title:string>, loc struct<file:string,start:struct<line:int,column:int>,end:struct<line:int,column:int>>, patterns array<string>"
#: Directories that a listing never enters, and extensions of source files.
SKIP_DIRS = ("node_modules", ".git", ".idea", ".vscode", "bower_components")
EXTENSIONS = (".js", ".jsx", ".es", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")


def _numbered(text: Column) -> Column:
    """A JSON array, or an object with numbers for keys → array of (id, loc)."""
    listed = F.transform(F.from_json(text, "array<string>"), lambda x, i: F.struct(i.cast("int").alias("id"), x.alias("loc")))
    keyed = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].cast("int").alias("id"), e["value"].alias("loc")))
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(keyed)


def call_graphs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a file: g (its path) and the fields of CALL_GRAPH, functions and calls as text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("g"), F.from_json("value", CALL_GRAPH).alias("j")).select("g", "j.*")


def relations(graphs: DataFrame) -> dict[str, DataFrame]:
    """files, functions, calls, fun2fun, call2fun, ignore of call_graphs(), each with g. Locations are 0-based in columns;
    a location's file number is replaced by the file's name."""
    files = graphs.select("g", F.posexplode("files").alias("file_no", "file"))

    def places(name: str) -> DataFrame:
        x = graphs.select("g", F.explode(_numbered(F.col(name))).alias("e")).select("g", "e.id", "e.loc", parse_location(F.col("e.loc")).alias("p")).where("p is not null")
        x = x.select("g", "id", "loc", F.col("p.file").cast("int").alias("file_no"), "p.sl", "p.sc", "p.el", "p.ec")
        return x.join(files, ["g", "file_no"]).drop("file_no")

    pairs = lambda name: graphs.select("g", F.explode(name).alias("e")).select("g", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")).distinct()
    ignore = graphs.select("g", F.explode("ignore").alias("loc")).select("g", parse_location(F.col("loc")).alias("p")).select("g", F.col("p.file").cast("int").alias("file_no"), "p.sl", "p.sc").join(files, ["g", "file_no"]).drop("file_no")
    return {"files": files, "functions": places("functions"), "calls": places("calls"), "fun2fun": pairs("fun2fun"), "call2fun": pairs("call2fun"), "ignore": ignore}


def call_graph(spark: SparkSession, path: str) -> CallGraph:
    raw = call_graphs(spark, path)
    r = {k: v.drop("g") for k, v in relations(raw).items()}
    one = raw.select("ignoreDependencies", F.col("includePackages").isNotNull().alias("i"), F.col("excludePackages").isNotNull().alias("e")).first()
    lists = lambda there, c: raw.select(F.explode(c).alias("name")) if there else None
    return CallGraph(r["functions"], r["calls"], r["fun2fun"], r["call2fun"], r["ignore"], r["files"], lists(one["i"], "includePackages"), lists(one["e"], "excludePackages"), bool(one["ignoreDependencies"]))


def hints(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """functions, reads, writes, requires, evals, without repeats; module numbers of locations become names."""
    raw = spark.read.schema(HINTS).json(paths, multiLine=True).withColumn("g", F.input_file_name())
    return hint_relations(raw)


def hint_relations(raw: DataFrame) -> dict[str, DataFrame]:
    named = lambda loc: F.when(loc.rlike(r"^\d+:"), F.concat(F.get("modules", F.regexp_extract(loc, r"^(\d+):", 1).cast("int")), F.regexp_replace(loc, r"^\d+", ""))).otherwise(loc)
    out = {"functions": raw.select("modules", F.explode("functions").alias("loc")).select(named(F.col("loc")).alias("loc")).distinct()}
    for name in ("reads", "writes", "requires", "evals"):
        x = raw.select("modules", F.explode(name).alias("e"))
        fields = [f for f in x.schema["e"].dataType.names]
        out[name] = x.select(*[(named(F.col(f"e.{f}")) if f.lower().endswith("loc") else F.col(f"e.{f}")).alias(f) for f in fields]).distinct()
    return out


def advisories(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """vuln_id, name, range, versions, ranges, patterns: one row for each affected package."""
    raw = spark.read.schema(ADVISORIES).json(paths, multiLine=True)
    events = "array<array<map<string,string>>>"
    npm = raw.where("npm is not null").select(F.coalesce("npm.url", "npm.title", "npm.name").alias("vuln_id"), "npm.name", "npm.range", F.lit(None).cast("array<string>").alias("versions"), F.lit(None).cast(events).alias("ranges"), "patterns")
    osv = raw.where("osv is not null").select(F.col("osv.id").alias("vuln_id"), F.explode("osv.affected").alias("a"), "patterns")
    return npm.union(osv.select("vuln_id", "a.package.name", F.lit(None).cast("string"), "a.versions", F.expr("transform(a.ranges, r -> r.events)"), "patterns"))


def patterns(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Pattern rows of all files in order: id, pattern and its syntax tree, newest versions only. A handful of rows."""
    rows = []
    for path in paths:
        rows += json.loads(spark.read.text(path, wholetext=True).first()[0])
    return [r | {"tree": parse(r["pattern"])} for r in newest(convert(rows))]


def source_files(spark: SparkSession, root: str, exclude: list[str] | None = None, tests: bool = True) -> DataFrame:
    """path, content of source files below root: by extension or a node shebang; declaration files, hidden and dependency
    directories and, if asked for, tests are left out, as is what a glob in exclude matches."""
    from ..functions.scalars import glob_to_regex

    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    x = x.where(~F.col("path").rlike("/(" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")/") & ~F.col("path").endswith(".d.ts"))
    known = F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")
    x = x.where(known | is_node_script(F.col("content")))
    if not tests:
        x = x.where(~F.col("path").rlike(r"/(tests?|__tests__|specs?)/|\.(test|spec)\.[^/]+$"))
    for g in exclude or []:
        x = x.where(~F.col("path").rlike(glob_to_regex("**/" + g)))
    return x


def is_node_script(content: Column) -> Column:
    first = F.substring_index(F.decode(F.substring(content, 1, 256), "UTF-8"), "\n", 1)
    return first.startswith("#!") & first.contains("node")


def module_strings(files: DataFrame) -> DataFrame:
    """path, spec: what a source text requires or imports by a constant string. A scan of the text, not a parse: strings
    in comments count too."""
    text = F.decode("content", "UTF-8")
    q = r"['\"]([^'\"\n]+)['\"]"
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p + q), F.lit(1)) for p in (r"\brequire\s*\(\s*", r"\bimport\s*\(\s*", r"\bfrom\s+", r"\bimport\s+")])
    return files.select("path", F.explode(F.array_distinct(found)).alias("spec"))


def resolve_modules(specs: DataFrame, files: DataFrame) -> DataFrame:
    """path, spec, target for relative specifiers(path, spec) among files(path): as it is, with an extension, or an index
    file; what is not found has a null target."""
    parts = F.filter(F.split(F.concat(F.regexp_replace("path", "/[^/]*$", "/"), "spec"), "/"), lambda p: p != ".")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    base = specs.where(F.col("spec").rlike(r"^\.\.?(/|$)")).select("path", "spec", F.array_join(walked, "/").alias("base"))
    tries = [""] + list(EXTENSIONS) + [f"/index{e}" for e in EXTENSIONS]
    options = base.select("path", "spec", F.posexplode(F.array(*[F.concat("base", F.lit(t)) for t in tries])).alias("o", "target"))
    hit = options.join(files.select(F.col("path").alias("target")), "target", "left_semi").groupBy("path", "spec").agg(F.min_by("target", "o").alias("target"))
    return base.select("path", "spec").join(hit, ["path", "spec"], "left")


def nearest_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, dir: the deepest packages(dir) above each file: a join on every ancestor directory."""
    ups = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("dir"))
    return ups.join(packages.select("dir"), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
