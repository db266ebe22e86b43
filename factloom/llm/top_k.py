"""Exact top-k search by inner product over an M-tree that is spread out as Spark tables.

Vectors that are equal are one object. Objects are put in order by their nearest of a few pivots and their distance to
it, cut into subtrees of bounded size, and each subtree's pages are rows of a table; the subtrees' roots form the level
above. A query first searches the subtree whose router is nearest, then, with the score it has to beat, every other
subtree that its lower bound does not rule out. Queries travel in blocks and subtrees are bounded, so that no task holds
more than one of each. Nothing is approximate: pivots only shape the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Queries are the rows whose id this divides; results of each; parts of one in a component.
EVERY, K, SCALE = 50, 5, 256
#: Objects of a subtree, queries of a block, subtrees of a block of the level above, pivots.
SUBTREE, QUERIES, ROOTS, PIVOTS = 8192, 512, 1024, 64
#: Squared lengths below this keep every score within 64 bits.
LONGEST = float(1 << 62)
PAGES = "shard long, page int, leaf boolean, vectors binary, own binary, radii binary, keys binary, least binary, router binary, radius double"


@dataclass
class Index:
    pages: DataFrame
    #: object, vec_id: every row.
    members: DataFrame
    m2: int
    dims: int
    subtrees: int


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Rows with a null id, a null vector, null or non-finite components, or
    a squared length of 2^62 or more take no part; rows that are equal count once."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    x = x.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    x = x.where(F.aggregate("x", F.lit(0.0), lambda a, c: a + (scale * c + 1) * (scale * c + 1)) < LONGEST)
    return x.select("vec_id", F.transform("x", lambda c: F.floor(scale * c)).alias("v")).distinct()


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of different length are filled up with zeros."""
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def build(vectors: DataFrame, *, subtree: int = SUBTREE, pivots: int = PIVOTS) -> Index:
    """vectors: vec_id long, v array<long>."""
    spark = vectors.sparkSession
    length2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    objects = vectors.groupBy("v").agg(F.min("vec_id").alias("least")).select(F.monotonically_increasing_id().alias("object"), "v", "least", length2.alias("v2"))
    objects = C.stored(objects, "objects")
    members = C.stored(vectors.join(objects.select("object", "v"), "v").select("object", "vec_id"), "members")
    n, m2, dims = objects.agg(F.count("*"), F.max("v2"), F.max(F.size("v"))).first()
    m2, dims, subtrees = m2 or 0, dims or 0, max(1, -(-n // subtree))
    # A bounded number of vectors, whatever the table's size.
    some = objects.orderBy(F.xxhash64("object"), "object").limit(min(pivots, subtrees * 4)).select("v").collect()
    centres = _matrix([r["v"] for r in some], dims)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .mtree import apart, lifted

        heads = lifted(centres, m2)
        for b in batches:
            x = lifted(_matrix(b.v, dims), m2)
            d = np.stack([apart(x, h) for h in heads], axis=1)
            yield b.assign(pivot=d.argmin(axis=1), d=d.min(axis=1))

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from .mtree import grow

        def write(rows: pd.DataFrame, number: int) -> pd.DataFrame:
            x = _matrix(rows.v, dims)
            made, router, radius = grow(x, rows.object.to_numpy(np.int64), rows.least.to_numpy(np.int64), m2)
            raw = lambda f, kind: [f(p).astype(kind).tobytes() for p in made]
            last = len(made) - 1
            return pd.DataFrame({
                "shard": (TaskContext.get().partitionId() << 32) + number, "page": range(len(made)), "leaf": [p.leaf for p in made], "vectors": raw(lambda p: p.vectors, "<i4"),
                "own": raw(lambda p: p.own, "<f8"), "radii": raw(lambda p: p.radii, "<f8"), "keys": raw(lambda p: p.keys, "<i8"), "least": raw(lambda p: p.least, "<i8"),
                "router": [x[router].astype("<i4").tobytes() if i == last else None for i in range(len(made))], "radius": [radius if i == last else None for i in range(len(made))],
            })

        held, number = [], 0
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= subtree:
                rows = pd.concat(held, ignore_index=True)
                for i in range(0, len(rows) - subtree + 1, subtree):
                    yield write(rows[i : i + subtree], number)
                    number += 1
                held = [rows[len(rows) // subtree * subtree :]]
        if held and sum(map(len, held)):
            yield write(pd.concat(held, ignore_index=True), number)

    if not n:
        return Index(spark.createDataFrame([], PAGES), members, 0, 0, 0)
    with C.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(C.ARROW_ROWS)):
        placed = objects.select("object", "v", "least").mapInPandas(place, "object long, v array<long>, least long, pivot int, d double")
        order = ["pivot", "d", "object"]
        made = placed.repartitionByRange(subtrees, *order).sortWithinPartitions(*order).select("object", "v", "least").mapInPandas(pages, PAGES)
        made = C.stored(made, "pages")
    return Index(made, members, m2, dims, made.where("router is not null").count())


def search(index: Index, queries: DataFrame, k: int, *, block: int = QUERIES, roots: int = ROOTS) -> DataFrame:
    """ask, object, least, score: the k best objects of queries(ask long, v array<long>), which are distinct, by score, then
    least. Also counted: computed, the vectors that were compared (as `computed` on one row a query and subtree)."""
    spark, m2 = queries.sparkSession, index.m2
    asked, wide, most = queries.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).first()
    dims = max(index.dims, wide or 0)
    exact = np.float64 if (most or 0) * m2 < float(1 << 105) else np.int64
    q_blocks, r_blocks = max(1, -(-asked // block)), max(1, -(-index.subtrees // roots))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = queries.select("ask", "v", F.pmod(F.xxhash64("ask"), F.lit(q_blocks)).cast("int").alias("q"))
    heads = index.pages.where("router is not null").select("shard", "router", "radius", F.pmod(F.xxhash64("shard"), F.lit(r_blocks)).cast("int").alias("r"))

    def distances(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances of queries to roots, and the queries' squared lengths."""
        q = _matrix(left.v, dims).astype(np.float64)
        x = _matrix([np.frombuffer(r, "<i4") for r in right.router], dims).astype(np.float64)
        q2 = np.einsum("ij,ij->i", q, q)
        return np.sqrt(np.maximum(0.0, q2[:, None] + m2 - 2.0 * (q @ x.T))), q2, right.radius.to_numpy()

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"ask": [], "shard": [], "d": []})
        d, _, _ = distances(left, right)
        at = d.argmin(axis=1)
        return pd.DataFrame({"ask": left.ask, "shard": right.shard.to_numpy()[at], "d": d.min(axis=1)})

    def within(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from .mtree import Search

        if left.empty or right.empty:
            return pd.DataFrame({"ask": [], "shard": [], "d": []})
        d, q2, radii = distances(left, right)
        s = Search([], 0.0, m2, k)
        reach = np.array([s.reach(a, None if pd.isna(b) else int(b)) for a, b in zip(q2, left.floor)])
        i, j = np.nonzero((d - radii <= reach[:, None]) & (right.shard.to_numpy()[None, :] != left.home.to_numpy()[:, None]))
        return pd.DataFrame({"ask": left.ask.to_numpy()[i], "shard": right.shard.to_numpy()[j], "d": d[i, j]})

    def pairs(asks: DataFrame, run) -> DataFrame:
        """ask, shard, d: blocks of queries meet blocks of roots."""
        left, right = asks.withColumn("r", every(r_blocks)), heads.withColumn("q", every(q_blocks))
        return left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(run, "ask long, shard long, d double")

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from .mtree import Page, Search

        names = ["ask", "object", "least", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names})
        right = right.sort_values("page")
        read = lambda raw, kind: np.frombuffer(raw, kind)
        pages = [Page(leaf, _wider(read(v, "<i4").reshape(len(o) // 8, -1), dims).astype(exact), read(o, "<f8"), read(r, "<f8"), read(key, "<i8"), read(e, "<i8")) for leaf, v, o, r, key, e in zip(right.leaf, right.vectors, right.own, right.radii, right["keys"], right.least)]
        s, out = Search(pages, float(right.radius.iloc[-1]), m2, k, exact), []
        for ask, v, d, floor in zip(left.ask, _matrix(left.v, dims), left.d, left.floor):
            out += [(ask, key, least, score) for score, least, key in s.run(v, d, None if pd.isna(floor) else int(floor))]
        return pd.DataFrame(out, columns=names)

    def visit(found: DataFrame, floors: DataFrame) -> DataFrame:
        """found(ask, shard, d): subtrees to look into, floors(ask, floor): the score to beat or equal."""
        left = found.join(floors, "ask").join(queries, "ask")
        right = index.pages.join(left.select("shard", F.col("q").alias("of")).distinct(), "shard")
        return left.groupBy("shard", "q").cogroup(right.groupBy("shard", "of")).applyInPandas(look, "ask long, object long, least long, score long")

    best = Window.partitionBy("ask").orderBy(F.desc("score"), "least", "object")
    with C.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(C.ARROW_ROWS)):
        home = C.stored(pairs(queries, nearest).groupBy("ask").agg(F.min(F.struct("d", "shard")).alias("h")).select("ask", "h.shard", "h.d"), "homes")
        first = C.stored(visit(home, queries.select("ask", F.lit(None).cast("long").alias("floor"))), "first")
        floors = first.groupBy("ask").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        floors = C.stored(queries.select("ask").join(floors, "ask", "left"), "floors")
        asks = queries.join(floors, "ask").join(home.select("ask", F.col("shard").alias("home")), "ask")
        more = C.stored(pairs(asks, within), "more")
        second = C.stored(visit(more, floors), "second")
    return first.union(second).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def _wider(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, subtree: int = SUBTREE, block: int = QUERIES, roots: int = ROOTS) -> DataFrame:
    """query_id, rank, vec_id, score: of each of queries(query_id, v) the k rows of vectors(vec_id, v) with the largest inner
    products, ties to smaller ids, rows with the query's own id left out.

    Fewer rows than k give all of them; no rows or no queries none. Shorter vectors count as filled up with zeros. Rows that
    share an id but not a vector are rows of their own; queries that do so are ranked together.
    """
    index = build(vectors, subtree=subtree)
    asks = C.stored(queries.select("v").distinct().select(F.monotonically_increasing_id().alias("ask"), "v"), "asks")
    # One more than asked for, as the query's own row is among them. Of objects that tie, those with the least ids go first,
    # and of an object's rows so do its least ids: the k + 1 best rows are among the k + 1 least rows of k + 1 objects.
    found = C.stored(search(index, asks, k + 1, block=block, roots=roots).select("ask", "object", "score"), "found")
    least = Window.partitionBy("object").orderBy("vec_id")
    rows = index.members.join(found.select("object").distinct(), "object", "left_semi").withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n")
    of_query = queries.join(asks, "v").select("query_id", "ask")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = of_query.join(found, "ask").join(rows, "object").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    vectors = C.stored(quantised(C.table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "v"), K)


SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
