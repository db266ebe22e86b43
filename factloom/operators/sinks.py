"""Writers: call graphs, matches, reachable packages, visualiser data, Graphviz, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_location
from .compare import number


def call_graph_json(files: DataFrame, functions: DataFrame, calls: DataFrame, fun2fun: DataFrame, call2fun: DataFrame) -> DataFrame:
    """One row, one column json: a call graph with ids numbered from 0 in the order of their old ids; edges whose ends
    have no location are left out. files(file), functions/calls(id, file, sl, sc, el, ec)."""
    f = number(files.select("file").distinct(), "file", "no")

    def placed(rows: DataFrame) -> DataFrame:
        x = number(rows.join(f, "file").select("id", format_location(F.col("no").cast("string"), F.col("sl"), F.col("sc"), F.col("el"), F.col("ec")).alias("loc")), "id", "new")
        return x

    fs, cs = placed(functions), placed(calls)
    ends = lambda e, a, b: e.join(a.select(F.col("id").alias("src"), F.col("new").alias("s")), "src").join(b.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst").select(F.array("s", "d").alias("e")).distinct()
    lists = [
        f.agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "file"))), lambda x: x["file"]).alias("files")),
        fs.agg(F.transform(F.sort_array(F.collect_list(F.struct("new", "loc"))), lambda x: x["loc"]).alias("functions")),
        cs.agg(F.transform(F.sort_array(F.collect_list(F.struct("new", "loc"))), lambda x: x["loc"]).alias("calls")),
        ends(fun2fun, fs, fs).agg(F.sort_array(F.collect_list("e")).alias("fun2fun")),
        ends(call2fun, cs, fs).agg(F.sort_array(F.collect_list("e")).alias("call2fun")),
    ]
    out = lists[0]
    for x in lists[1:]:
        out = out.crossJoin(x)  # one row each: the file is one JSON value by its format
    return out.select(F.to_json(F.struct("*")).alias("json"))


def tokens_json(pts: DataFrame) -> DataFrame:
    """json: one line for each variable with its tokens."""
    return pts.groupBy("var_id").agg(F.sort_array(F.collect_list("tok_id")).alias("tokens")).select(F.to_json(F.struct("var_id", "tokens")).alias("json"))


def reachable_json(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """json: reachable packages, once for each name and version, and modules of packages that are no entries."""
    p = packages.select("name", F.nullif("version", F.lit("")).alias("version")).distinct().agg(F.sort_array(F.collect_list(F.struct("name", "version"))).alias("packages"))
    m = modules.where("not coalesce(is_entry, false)").select("name").distinct().agg(F.sort_array(F.collect_list("name")).alias("modules"))
    return p.crossJoin(m).select(F.to_json(F.struct("*")).alias("json"))  # one row each


def graph_elements(packages: DataFrame, modules: DataFrame, functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested nodes(id, parent, label, kind, n, weight) and edges(src, dst, kind) of a call-graph picture. packages(id,
    label, n), modules and functions (with parent); weights are relative to the largest count of the level."""
    from .reports import normalised

    level = lambda df, kind: df.select("id", F.col("parent") if "parent" in df.columns else F.lit(None).cast("string").alias("parent"), "label", F.lit(kind).alias("kind"), "n")
    nodes = level(packages, "package").union(level(modules, "module")).union(level(functions, "function"))
    return normalised(nodes, "kind"), edges.select("src", "dst", F.lit("call").alias("kind")).distinct()


def graphviz(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT file in order: clusters for parents, nodes in them, edges between; columns (o, line)."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', r'\\\\"'), F.lit('"'))
    inner = nodes.where("parent is not null").groupBy("parent").agg(F.sort_array(F.collect_list(F.concat(F.lit("    "), q("id"), F.lit(" [label="), q("label"), F.lit("];")))).alias("l"))
    clusters = inner.select(F.lit(1).alias("o"), F.concat(F.lit('  subgraph "cluster_'), "parent", F.lit('" {\n'), F.array_join("l", "\n"), F.lit("\n  }")).alias("line"))
    arrows = edges.select("src", "dst").distinct().select(F.lit(2).alias("o"), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "o int, line string")
    return ends.union(clusters).union(arrows).orderBy("o", "line")


def html(template: str, data: DataFrame, mark: str = "$DATA") -> str:
    """The template with the one JSON value of data in place of mark."""
    return template.replace(mark, data.first()["json"].replace("</", "<\\/"))


def diagnostics(**relations: DataFrame) -> DataFrame:
    """One row with the number of rows of each relation."""
    out = None
    for name, df in relations.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def write_lines(df: DataFrame, path: str, column: str = "json") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
