"""Comparing and merging call graphs.

A call graph is a set of relations, each with a column `g` that names the graph where several are handled together:
functions(id, file, sl, sc, el, ec), calls(the same), fun2fun(src, dst), call2fun(src, dst), ignore(file, sl, sc).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import closure

START, END = ["file", "sl", "sc"], ["file", "el", "ec"]


@dataclass
class CallGraph:
    functions: DataFrame
    calls: DataFrame
    fun2fun: DataFrame
    call2fun: DataFrame
    ignore: DataFrame
    files: DataFrame
    include: DataFrame | None = None
    exclude: DataFrame | None = None
    ignore_dependencies: bool = False


def same_place(a: DataFrame, b: DataFrame) -> DataFrame:
    """id1, id2 of rows with an equal start or an equal end: two equi-joins, since one condition with OR has no hash plan."""
    one = lambda key: a.select(F.col("id").alias("id1"), *key).join(b.select(F.col("id").alias("id2"), *key), key).select("id1", "id2")
    return one(START).union(one(END)).distinct()


def ignored(a: CallGraph, b: CallGraph) -> DataFrame:
    return a.ignore.select(*START).union(b.ignore.select(*START)).distinct()


def match_functions(a: CallGraph, b: CallGraph) -> DataFrame:
    skip = ignored(a, b)
    return same_place(a.functions.join(skip, START, "left_anti"), b.functions.join(skip, START, "left_anti"))


def included(file: Column, known: Column, other: CallGraph, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Whether the other graph covers a file: it is known, one of its files, and packages are included and not excluded."""
    inside = lambda names: F.array_contains(F.lit(names), F.regexp_extract(file, r".*node_modules/((?:@[^/]+/)?[^/]+)/", 1))
    own = ~file.contains("node_modules/")
    test = F.lit(True)
    if exclude is not None:
        test = ~inside(exclude)
    if include is not None:
        test = inside(include) & test
    if other.ignore_dependencies:
        test = own
    return known & (own | test)


def edges_found(e1: DataFrame, e2: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """e1(src, dst) with found: whether some image under sources and targets (id1, id2) is an edge of e2."""
    m = e1.join(sources.select(F.col("id1").alias("src"), F.col("id2").alias("s2")), "src").join(targets.select(F.col("id1").alias("dst"), F.col("id2").alias("d2")), "dst")
    hit = m.join(e2.select(F.col("src").alias("s2"), F.col("dst").alias("d2")), ["s2", "d2"], "left_semi").select("src", "dst").distinct().withColumn("found", F.lit(True))
    return e1.join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("found"))


def found_counts(e1: DataFrame, e2: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    return edges_found(e1, e2, sources, targets).agg(F.count_if("found").alias("found"), F.count(F.lit(1)).alias("total"))


def per_call(c1: DataFrame, c2: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """src, n1, n2, hits: for every call of c1, its callees, the callees that c2 has for its images, and both."""
    back = c2.join(calls.select(F.col("id2").alias("src"), F.col("id1").alias("s1")), "src").join(functions.select(F.col("id2").alias("dst"), F.col("id1").alias("d1")), "dst")
    e2 = back.select(F.col("s1").alias("src"), F.col("d1").alias("dst")).distinct().withColumn("b", F.lit(1))
    e1 = c1.select("src", "dst").distinct().withColumn("a", F.lit(1))
    both = e1.join(e2, ["src", "dst"], "full")
    return both.groupBy("src").agg(F.count("a").alias("n1"), F.count("b").alias("n2"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("hits")).where("n1 > 0")


def precision_recall(calls: DataFrame) -> DataFrame:
    """Means over calls; a call without predicted callees has precision 1; without any call both are 0."""
    return calls.agg(
        F.coalesce(F.avg(F.when(F.col("n2") == 0, 1.0).otherwise(F.col("hits") / F.col("n2"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.col("hits") / F.col("n1")), F.lit(0.0)).alias("recall"),
    )


def compare(a: CallGraph, b: CallGraph) -> DataFrame:
    """One row: found and total function and call edges of a in b, per-call precision and recall, reachable functions."""
    skip = ignored(a, b).withColumn("_i", F.lit(1))
    starts = lambda rows: rows.join(skip, START, "left").select("id", "file", F.col("_i").isNotNull().alias("skip"))
    f, c = match_functions(a, b), same_place(a.calls, b.calls)
    files = b.files.select("file").distinct().withColumn("_k", F.lit(True))
    # Packages named on a command line: short lists.
    names = lambda df: None if df is None else [r[0] for r in df.collect()]
    inc, exc = names(b.include), names(b.exclude)

    def counts(edges: DataFrame, other: DataFrame, sources: DataFrame, src_rows: DataFrame, check_source: bool) -> DataFrame:
        got = edges_found(edges, other, sources, f)
        s, d = starts(src_rows).toDF("src", "sf", "ss"), starts(a.functions).toDF("dst", "df", "ds")
        x = got.join(s, "src").join(d, "dst").where(~F.col("ds") & ~(F.col("ss") & F.lit(check_source)))
        x = x.join(files.toDF("sf", "sk"), "sf", "left").join(files.toDF("df", "dk"), "df", "left")
        miss = included(F.col("sf"), F.col("sk").isNotNull(), b, inc, exc) & included(F.col("df"), F.col("dk").isNotNull(), b, inc, exc)
        return x.agg(F.count_if("found").alias("found"), F.count_if(F.col("found") | miss).alias("total"))

    fun, call = counts(a.fun2fun, b.fun2fun, f, a.functions, True), counts(a.call2fun, b.call2fun, c, a.calls, False)
    metric = precision_recall(per_call(a.call2fun, b.call2fun, c, f))
    roots = module_roots(b)
    reach = closure(b.fun2fun, roots)
    image = f.join(reach.select(F.col("node").alias("id2")), "id2", "left_semi").select("id1").distinct()
    mine = closure(a.fun2fun, module_roots(a)).select(F.col("node").alias("id1"))
    reached = mine.join(image, "id1", "left").count(), mine.join(image, "id1", "left_semi").count()
    one = lambda df, p: df.toDF(*[f"{p}_{x}" for x in df.columns])
    return one(fun, "fun").crossJoin(one(call, "call")).crossJoin(metric).select("*", F.lit(reached[1]).alias("reachable_found"), F.lit(reached[0]).alias("reachable_total"))  # one row each


def module_roots(g: CallGraph) -> DataFrame:
    """node: for every file outside node_modules the function that starts at its beginning and ends last."""
    x = g.functions.where("sl = 1 and sc = 0 and not contains(file, 'node_modules/')")
    return x.groupBy("file").agg(F.max_by("id", F.struct("el", "ec", "id")).alias("node")).select("node")


def merge(functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of graphs: functions(g, id, loc) and edges(g, src, dst) → (loc, id) and (src, dst) with ids in the order of
    first appearance (g, id). Edges with unknown ends are dropped."""
    first = functions.groupBy("loc").agg(F.min(F.struct("g", "id")).alias("o"))
    ranked = first.orderBy("o").select("loc", "o")
    numbered = number(ranked, "o", "new")
    ids = functions.join(numbered.select("loc", "new"), "loc").select("g", "id", "new")
    ends = edges.join(ids.select("g", F.col("id").alias("src"), F.col("new").alias("s")), ["g", "src"]).join(ids.select("g", F.col("id").alias("dst"), F.col("new").alias("d")), ["g", "dst"])
    return numbered.select("loc", F.col("new").alias("id")), ends.select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def number(rows: DataFrame, order: str, to: str) -> DataFrame:
    """rows with consecutive numbers from 0 in the given order: ranges of the order are numbered apart, and the counts of
    the ranges before, one row each, are added."""
    from pyspark.sql import Window

    from .fixpoint import cut

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    return ranked.join(F.broadcast(counts.select("_p", "_b")), "_p").withColumn(to, (F.col("_r") + F.col("_b")).cast("long")).drop("_p", "_r", "_b")  # a row a partition
