"""The k lightest loop-free paths of many graphs at once, as joins.

What a partial path has cost and the least that is left, known from a search backwards, bound it from below. The best
partial paths of each source go on together, a step each, until as many whole paths come before them as are asked for. How
many go on is limited, and the first that is left behind is kept: where it could still become an answer, the source is
searched again with more, and at last by sets, whose work is polynomial: all paths of a source to its target are split into
those that begin with a root and do not go on to some banned nodes. The best path of each open set is known; the best of
these is the next answer, and its set is split along it.

Rows of a small graph meet in one partition, in which several steps need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixpoint import HOPS, SHORT, _compact, _together, cut, union

TARGET = "target"
#: Weights are counted in whole units of this size, so that sums do not depend on their order and ties are ties.
UNIT = 1_000_000_000
#: Edges up to which the rows of a graph are kept in one partition.
WHOLE = 100_000
#: Partial paths of a source that go on at once: at first, and where these were too few. Steps of them in one job.
WIDTHS, STEPS = (16, 256), 4


@contextmanager
def _meeting(spark: SparkSession) -> Iterator[None]:
    """Within, rows that are dealt by a part of the columns that they are joined by need no further shuffle."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def distances_back(edges: DataFrame) -> DataFrame:
    """g, node, h: the least weight from a node to TARGET over edges(g, src, dst, m), of nodes that reach it. m >= 0."""
    parts = [cut(edges.where(F.col("dst") == TARGET).select("g", F.col("dst").alias("node"), F.lit(0).cast("long").alias("h")).distinct())]
    last, n = parts[0], SHORT
    while True:
        steps, at = [], last
        for i in range(HOPS):
            at = at.withColumnRenamed("node", "dst").join(edges, ["g", "dst"]).groupBy("g", F.col("src").alias("node")).agg(F.min(F.col("h") + F.col("m")).alias("h"))
            steps.append(at.withColumn("step", F.lit(i)))
        new = union(steps).groupBy("g", "node").agg(F.min(F.struct("h", "step")).alias("x")).select("g", "node", "x.*")
        old = union(parts).groupBy("g", "node").agg(F.min("h").alias("_old"))
        made, sizes, _ = _together({"at": new.join(old, ["g", "node"], "left").where("_old is null or h < _old").select("g", "node", "h", "step")}, n)
        if not made:
            return old.withColumnRenamed("_old", "h")
        parts, n = _compact([*parts, made["at"].drop("step")]), sizes["at"]
        # What earlier hops of the round found has been followed in it.
        last = made["at"].where(F.col("step") == HOPS - 1).drop("step")


def _best_of_sets(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """sets(g, root, sums, banned, most) with the lightest loop-free path each holds and its sums, if it weighs at most
    `most` (null: any). edges(g, src, dst, m, h): h is the least weight left after the edge. Of equal weights the least
    path. sums: the weight from the start to each node of a path, or root."""
    key, best = ["g", "root", "node"], ["w", "path", "sums"]
    parts = [sets.select("g", "root", F.element_at("root", -1).alias("node"), F.element_at("sums", -1).alias("w"), F.col("root").alias("path"), "sums")]
    last, n, first = parts[0], SHORT, True
    while True:
        state = union(parts)
        ended = state.where(F.col("node") == TARGET).groupBy("g", "root").agg(F.min("w").alias("_ended"))
        limits = sets.join(ended, ["g", "root"], "left").select("g", "root", "banned", F.least("most", "_ended").alias("limit"))  # least() skips nulls
        steps, at = [], last.join(limits, ["g", "root"])
        for i in range(HOPS):
            x = at.withColumnRenamed("node", "src").join(edges, ["g", "src"]).where(~F.array_contains("path", F.col("dst"))).withColumn("w", F.col("w") + F.col("m"))
            x = x.where(F.col("limit").isNull() | (F.col("w") + F.col("h") <= F.col("limit")))
            if first and i == 0:
                x = x.where(~F.array_contains("banned", F.col("dst")))
            x = x.select("g", "root", F.col("dst").alias("node"), "limit", F.struct("w", F.concat("path", F.array("dst")).alias("path"), F.concat("sums", F.array("w")).alias("sums")).alias("x"))
            at = x.groupBy(*key).agg(F.min("x").alias("x"), F.first("limit").alias("limit")).select(*key, "x.*", "limit")  # one limit a root
            steps.append(at.drop("limit").withColumn("step", F.lit(i)))
        new = union(steps).groupBy(*key).agg(F.min(F.struct(*best, "step")).alias("x"))
        old = state.groupBy(*key).agg(F.min(F.struct(*best)).alias("_old"))
        better = new.join(old, key, "left").where(F.col("_old").isNull() | (F.struct(*[F.col(f"x.{c}") for c in best]) < F.col("_old"))).select(*key, "x.*")
        made, sizes, _ = _together({"at": better}, n)
        if not made:
            break
        parts, n, first = _compact([*parts, made["at"].drop("step")]), sizes["at"], False
        # What earlier hops of the round found has been followed in it.
        last = made["at"].where(F.col("step") == HOPS - 1).drop("step")
        if last.isEmpty():
            break
    ends = union(parts).where(F.col("node") == TARGET).groupBy("g", "root").agg(F.min(F.struct(*best)).alias("x"))
    return sets.select("g", "root", "banned").join(ends, ["g", "root"]).select("g", "root", "banned", "x.*")


def best_paths(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """g, source, rank (from 0), weight, path (with source and TARGET), sums (weights up to each node): the k lightest loop-free paths, all if fewer, from
    each of sources(g, source) to the node TARGET over edges(g, src, dst, weight); of equal weights the least path comes
    first. g, a graph, is any type that can be compared; nodes are strings. Weights are rounded to billionths; edges with a
    null, and loops, are left out, of parallel edges the lightest counts, negative weights are not allowed. A source that
    does not reach its target, or is it, has no row.

    Graphs of more than WHOLE edges are spread over all tasks, by graph and node. For an answer of n nodes a search by sets
    looks through up to n of them, each over no more than the nodes within its bound."""
    m = F.round(F.col("weight") * UNIT).cast("long")
    plain = edges.select("g", "src", "dst", m.alias("m")).dropna().where("src <> dst")
    plain = plain.withColumn("m", F.when(F.col("m") < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col("m")))
    plain = cut(plain.groupBy("g", "src", "dst").agg(F.min("m").alias("m")).where(F.col("src") != TARGET))
    starts = cut(sources.select("g", F.col("source").alias("node")).dropna().where(F.col("node") != TARGET).distinct())
    plain = plain.join(starts.select("g").distinct(), "g", "left_semi")
    large = cut(plain.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("g"))
    if large.isEmpty():
        return _best_paths(plain, starts, k, whole=True)
    spread = _best_paths(plain.join(large, "g", "left_semi"), starts.join(large, "g", "left_semi"), k, whole=False)
    return spread.union(_best_paths(plain.join(large, "g", "left_anti"), starts.join(large, "g", "left_anti"), k, whole=True))


def _best_paths(plain: DataFrame, starts: DataFrame, k: int, *, whole: bool) -> DataFrame:
    """best_paths() of plain(g, src, dst, m) from starts(g, node)."""
    deal = lambda x: x.repartition("g") if whole else x
    with _meeting(plain.sparkSession):
        plain = cut(deal(plain))
        back = cut(distances_back(deal(plain)))
        left = cut(deal(plain).join(deal(back).withColumnRenamed("node", "dst"), ["g", "dst"]).select("g", "src", "dst", "m", "h"))
        starts, found = cut(starts.join(back, ["g", "node"])), []
        for width in WIDTHS:
            ends, starts = _followed(starts, left, k, width, whole=whole)
            found.append(ends)
            if starts.isEmpty():
                break
    rank = F.row_number().over(Window.partitionBy("g", "source").orderBy("w", "path")) - 1
    out = union(found).select("g", "source", rank.alias("rank"), (F.col("w") / UNIT).alias("weight"), "path", F.transform("sums", lambda x: x / UNIT).alias("sums"))
    return out if starts.isEmpty() else out.union(_by_sets(starts, left, k))


def _followed(starts: DataFrame, edges: DataFrame, k: int, width: int, *, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The k best paths (g, source, w, path, sums) from starts(g, node, h), and those starts that need more than `width`
    partial paths at once. edges(g, src, dst, m, h): h is the least weight left after the edge.

    f bounds what a partial path leads to, and whatever continues it comes after it by (f, path). So k whole paths before it
    rule it out. One beyond the width stays in its place, without a node; it is ruled out in the same way, or the source is
    not done."""
    zero = F.array(F.lit(0).cast("long"))
    at = starts.select("g", F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("w"), F.col("h").alias("f"), F.array("node").alias("path"), zero.alias("sums"))
    edges = edges.select("g", F.col("src").alias("node"), "dst", "m", "h")
    edges = edges.repartition("g").hint("shuffle_hash") if whole else edges
    ended, live = F.col("node") == TARGET, F.coalesce(F.col("node") != TARGET, F.lit(False))
    before = Window.partitionBy("g", "source").orderBy("f", "path").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        at = at.repartition("g") if whole else at
        for _ in range(STEPS if whole else HOPS):
            on, w = F.col("dst").isNotNull(), F.col("w") + F.col("m")
            x = at.join(edges, ["g", "node"], "left").where(~live | (on & ~F.array_contains("path", F.col("dst"))))
            x = x.select(
                "g", "source", F.coalesce("dst", "node").alias("node"), F.when(on, w).otherwise(F.col("w")).alias("w"), F.when(on, w + F.col("h")).otherwise(F.col("f")).alias("f"),
                F.when(on, F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"), F.when(on, F.concat("sums", F.array(w))).otherwise(F.col("sums")).alias("sums"),
            )
            x = x.withColumns({"_ended": F.coalesce(F.count_if(ended).over(before), F.lit(0)), "_live": F.coalesce(F.count_if(live).over(before), F.lit(0))})
            x = x.where((F.col("_ended") < k) & (~live | (F.col("_live") <= width)))
            at = x.withColumn("node", F.when(~live | (F.col("_live") < width), F.col("node"))).drop("_ended", "_live")
        at = cut(at)
        if at.where(live).isEmpty():
            break
    more = cut(at.where("node is null").select("g", F.col("source").alias("node")).distinct())
    ends = at.where(ended).join(more.withColumnRenamed("node", "source"), ["g", "source"], "left_anti")
    return ends.select("g", "source", "w", "path", "sums"), starts.join(more, ["g", "node"], "left_semi")


def _by_sets(starts: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """best_paths() from starts(g, node, h) by sets of paths. left(g, src, dst, m, h) as for _best_of_sets()."""
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    # The first answer weighs what the search backwards found.
    sets = starts.select("g", F.array("node").alias("root"), F.array(zero).alias("sums"), none.alias("banned"), F.col("h").alias("most"))
    shape = sets.select("g", F.lit("").alias("source"), F.lit(0).alias("rank"), F.lit(0.0).alias("weight"), none.alias("path"), F.array(F.lit(0.0)).alias("sums")).limit(0)
    found, rest = [], []
    for rank in range(k):
        sets = cut(sets)
        new = [] if sets.isEmpty() else [_best_of_sets(sets, left).withColumn("source", F.element_at("root", 1))]
        if not new and not rest:
            break
        # What can still be an answer: the next one, and as many more as are asked for.
        order = Window.partitionBy("g", "source").orderBy("w", "path")
        ranked = cut(union(new + rest).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k - rank))
        now, more = ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").drop("_r")
        found.append(now.select("g", "source", F.lit(rank).alias("rank"), (F.col("w") / UNIT).alias("weight"), "path", F.transform("sums", lambda x: x / UNIT).alias("sums")))
        rest = [more]
        # With enough other paths in hand, no path heavier than the last of them is wanted.
        most = more.groupBy("g", "source").agg(F.when(F.count(F.lit(1)) >= k - rank - 1, F.max("w")).alias("most"))
        sets = _split(now).join(most, ["g", "source"], "left").select("g", "root", "sums", "banned", "most")
        if rank + 1 < k and ranked.isEmpty():
            break
    return union(found) if found else shape


def _split(now: DataFrame) -> DataFrame:
    """g, source, root, sums, banned: the sets that together hold what the sets of now held, without their path."""
    turns = now.withColumn("i", F.explode(F.sequence(F.size("root"), F.size("path") - 1)))
    return turns.selectExpr("g", "source", "slice(path, 1, i) AS root", "slice(sums, 1, i) AS sums", "if(i = size(root), concat(banned, array(path[i])), array(path[i])) AS banned")
