"""MinHash near-dedup: one-permutation sketches, banded buckets, star-shaped candidates, exact confirmation.

Texts with one shingle set are one node. Every bucket of a band proposes one edge from each member to the bucket's
centre, so candidates grow with the rows of buckets and never with their square. Confirmed links are contracted into
components, and buckets that still span several components get new centres as long as that pays. What then still spans
several components is joined exactly by prefixes of rare shingles, so that no link between members of a bucket is lost
however large the bucket is. Full sets confirm every link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: 32 bands of 4 of 128 bins: a pair at 0.8 shares no band with a chance of 5e-8.
BINS, BANDS = 128, 32
#: Parity bits of a set: each shingle turns one over, so that bits in which two sets differ bound their difference from below.
PARITY = 512
SHINGLE, PERCENT = 5, 80
#: Rounds of stars go on while one comparison in so many gives a link; the exact join does the rest.
WORTH = 4


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint's estimated size is that of its plan, which joins of loops square again and again; a file's is its own."""
    return C.stored(df, "round")


def _keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _differ(x: str, y: str) -> str:
    """SQL: no more than the number of shingles that are in one of two sets only, from their parity bits."""
    return " + ".join(f"bit_count({x}.m{i} ^ {y}.m{i})" for i in range(PARITY // 64))


def _near(x_n: str, y_n: str, x: str, y: str, percent: int) -> str:
    """SQL: sizes and parity bits leave room for a link."""
    return f"100 * least({x_n}, {y_n}) >= {percent} * greatest({x_n}, {y_n}) and {100 + percent} * ({_differ(x, y)}) <= {100 - percent} * ({x_n} + {y_n})"


def signatures(docs: DataFrame, size: int, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), node (binary, of the set; null if empty), n, keys (one a band), m (parity bits)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .shingles import Sketch, parity, shingle_set

        sketch = Sketch(bins, bands)
        for b in batches:
            nodes, sizes, keys, bits = [], [], [], []
            for text in b.text:
                s = shingle_set(text, size)
                sizes.append(len(s))
                nodes.append(md5(s.tobytes()).digest() if len(s) else None)
                keys.append(sketch.keys(s) if len(s) else None)
                bits.append(parity(s, PARITY) if len(s) else None)
            yield pd.DataFrame({"doc_id": b.doc_id, "t1": b.t1, "t2": b.t2, "node": nodes, "n": sizes, "keys": keys, "m": bits})

    return docs.select("doc_id", *_keys(), "text").mapInPandas(sign, "doc_id long, t1 long, t2 long, node binary, n long, keys array<long>, m array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, n, s (sorted hashes) for nodes(node, rep: struct of doc_id, t1, t2), from their texts."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .shingles import shingle_set

        for b in batches:
            s = [shingle_set(t, size).view(np.int64) for t in b.text]
            yield pd.DataFrame({"node": b.node, "n": [len(x) for x in s], "s": s})

    wanted = nodes.select("node", F.col("rep.doc_id").alias("_d"), F.col("rep.t1").alias("t1"), F.col("rep.t2").alias("t2"))
    x = docs.select("doc_id", *_keys(), "text").join(wanted, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("_d")))
    return x.select("node", "text").mapInPandas(make, "node binary, n long, s array<long>")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) → node, label: the least node that links reach. Least labels spread along links and jump to their own
    labels, so rounds follow the logarithm of a component's length."""
    both = _kept(links.union(links.select("b", "a")).toDF("a", "b").where("a != b").distinct())
    label = _kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        jump = label.select(F.col("node").alias("via"), F.col("label").alias("to"))
        new = _kept(step.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("to", "via")).alias("label")))
        label = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return label
        C.tidy(links.sparkSession)


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels(node, label) after links(a, b) between labels."""
    top = components(links)
    if labels is None:
        return top
    up = top.select(F.col("node").alias("label"), F.col("label").alias("up"))
    moved = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return _kept(moved.union(top.join(labels, "node", "left_anti").select("node", "label")))


def _grow(buckets: DataFrame, confirmed: Callable[[DataFrame], DataFrame], percent: int, worth: int) -> tuple[DataFrame, DataFrame | None]:
    """The bucket rows still to do, and labels(node, label) of the nodes that confirmed links join (None without any).

    In a round every bucket's centre is compared with all members of other components, and then leaves the bucket: none of
    its pairs there is left. A bucket of m nodes is thus done after m - 1 rounds, and at once when it is of one component.
    A node's rank as a centre is the same in all buckets, so that a group's buckets propose the same few centres. Rounds
    end when fewer than one comparison in `worth` gives a link."""
    labels, todo = None, buckets.select("b", "node", "n", "m")
    while True:
        own = todo.withColumn("label", F.col("node")) if labels is None else todo.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mid = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("m").alias("m"), F.col("label").alias("label")))
        centres = own.groupBy("b").agg(mid.alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("b", "c")
        paired = _kept(own.join(centres, "b").where("node != c.node"))
        near = paired.where("label != c.label").where(_near("n", "c.n", "m", "c.m", percent))
        edges = _kept(near.select(F.col("node").alias("a"), F.col("label").alias("la"), F.col("c.node").alias("b"), F.col("c.label").alias("lb")).distinct())
        links, todo = confirmed(edges), paired.select("b", "node", "n", "m")
        found = links.count()
        if found:
            labels = merge(labels, links)
            C.tidy(buckets.sparkSession)
        if worth * found <= edges.count():
            return todo, labels


def _prefixes(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """left(node, label, m) → g, node, label, n, m, room: the shingles g of a node that may be the first one a link shares,
    rarest first among all of left; room counts the node's shingles from g on."""
    sets = sets.join(left, "node").select("node", "label", "n", "m", "s")
    tokens = sets.select("node", F.explode("s").alias("g"))
    # Shingles of a single node come before all others and pair nothing: only their number counts.
    shared = tokens.join(tokens.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "g")
    shared = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("o"))
    x = shared.join(sets.drop("s"), "node").withColumn("most", F.size("o")).withColumn("least", F.expr(f"cast(({percent} * n + 99) div 100 as int)")).where("most >= least")
    x = x.select("node", "label", "n", "m", "most", F.posexplode(F.expr("slice(o, 1, most - least + 1)")).alias("p", "e"))
    return x.select(F.col("e.g").alias("g"), "node", "label", "n", "m", (F.col("most") - F.col("p")).alias("room"))


def _finish(buckets: DataFrame, labels: DataFrame | None, sets: DataFrame, confirmed: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame | None:
    """labels after all links between nodes of buckets that still span several labels: an exact set join. Two linked sets
    have their first common shingle in both prefixes, with room for the overlap they need after it."""
    own = buckets.withColumn("label", F.col("node")) if labels is None else buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spans = own.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("b")
    left = _kept(own.join(spans, "b").groupBy("node", "label").agg(F.first("m").alias("m")))
    if left.isEmpty():
        return labels
    pre = C.stored(_prefixes(left, sets, percent), "prefixes")
    # At least one node of a pair is outside the most frequent label of its shingle: members of that do not meet each other.
    top = pre.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("k"))
    pre = C.stored(pre.join(top.where("k > 1").select("g", F.col("top.label").alias("top")), "g").withColumn("out", F.col("label") != F.col("top")), "prefixes")
    x, y = (pre.select("g", "out", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "label", "n", "m", "room")]) for side in "xy")
    fits = f"x_label != y_label and {100 + percent} * least(x_room, y_room) >= {percent} * (x_n + y_n) and {_near('x_n', 'y_n', 'x_m', 'y_m', percent)}"
    pairs = x.join(y.where("out").drop("out"), "g").where(fits).where("not out or x_node < y_node")
    edges = _kept(pairs.select(F.col("x_node").alias("a"), F.col("x_label").alias("la"), F.col("y_node").alias("b"), F.col("y_label").alias("lb")).distinct())
    links = confirmed(edges)
    return labels if links.isEmpty() else merge(labels, links)


def link(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, worth: int = WORTH) -> DataFrame:
    """docs(doc_id long, text) → doc_id, t1, t2, n_shingles, component_id, kept; one row for each input row.

    component_id is the least doc_id in the component; kept says that the row's doc_id is it. A null, empty or wordless
    text has no shingles and is a component of its own. Rows that share a doc_id are kept or dropped by that id; a null
    doc_id is never the least unless all are null. An empty table gives no rows.
    """
    C.arrow_rows(docs.sparkSession)
    signed = C.stored(signatures(docs, size), "signatures")
    some = signed.where("n > 0")
    bits = F.struct(*[F.first(F.col("m")[i]).alias(f"m{i}") for i in range(PARITY // 64)])
    nodes = C.stored(some.groupBy("node").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), bits.alias("m")), "nodes")
    rows = nodes.select("node", F.explode("keys").alias("b"))
    full = rows.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("b")
    buckets = C.stored(rows.join(full, "b").join(nodes.select("node", "n", "m"), "node"), "buckets")
    sets = C.stored(shingle_sets(docs, buckets.select("node").distinct().join(nodes.select("node", "rep"), "node"), size), "sets")

    def confirmed(edges: DataFrame) -> DataFrame:
        """edges(a, la, b, lb) → links between labels la and lb."""
        x = edges.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a")
        x = x.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
        x = x.withColumn("i", F.size(F.array_intersect("sa", "sb"))).where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i")))
        return _kept(x.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())

    with C.interpreted(docs.sparkSession):
        todo, labels = _grow(buckets, confirmed, percent, worth)
        labels = _finish(todo, labels, sets, confirmed, percent)
    # The least doc_id of each node, then of each component: a row a node, however many copies it has.
    least = some.groupBy("node").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        of = least.join(labels, "node").groupBy("label").agg(F.min("least").alias("top"))
        least = least.join(labels.join(of, "label").select("node", "top"), "node", "left").select("node", F.coalesce("top", "least").alias("least"))
    out = signed.select("doc_id", "t1", "t2", "n", "node").join(least, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, with their own columns. Of rows that share the kept doc_id, all stay."""
    gone = link(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size=size, percent=percent).where("not kept")
    gone = gone.select("doc_id").distinct().withColumnRenamed("doc_id", "_d")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_d"]), "left_anti")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return link(docs, size=4).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS far FROM d UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.far),
c AS (SELECT node, min(far) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
