"""Source divergence audit: how far the word distributions of a language's sources lie from each other.

Terms are counted once per (lang, source, term), added up in the tasks that read the texts. The kept terms of a language
are dealt into blocks, its sources likewise, and each (term block, two source blocks) becomes a dense int64 matrix of
sources by terms in one task: broadcasting gives the differences of all its pairs, a heap of the strongest terms is kept
for each source. Partial pair matrices are summed and heaps merged by Spark. A tile is as large as its two block sizes
say, whatever the number of sources and terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Terms in fewer of a language's documents are left out; terms listed of a source; added to each count; parts of one.
MIN_DOCS, TOP, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: About so many terms and sources in a tile.
TERMS, SOURCES = 2048, 256
#: Counts that a worker holds before it hands them on.
HELD = 400_000
COUNTS = "lang string, source string, term binary, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term (bytes), n (occurrences), docs (documents with it); a row with a null term for every group, whose
    docs are all its documents. Terms are runs of letters A-Z and characters beyond ASCII, lower-cased in A-Z."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .texts import ascii_table, pieces

        keep = ascii_table({c: 0x20 for c in range(128) if not (0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A)})
        found, within, size = defaultdict(Counter), defaultdict(Counter), Counter()

        def flush():
            for g, n_docs in size.items():
                n, d = found[g], within[g]
                # Both count the same terms, and a dictionary keeps the order of first insertion only per dictionary.
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0]] * len(terms), pa.string()), pa.array([g[1]] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([n_docs, *map(d.__getitem__, n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            found.clear(), within.clear(), size.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                g = (lang, source)
                size[g] += 1
                seen: set[bytes] = set()
                for part in pieces(text.translate(keep)):
                    words = part.split()
                    found[g].update(words)
                    seen.update(words)
                within[g].update(seen)
            if sum(map(len, found.values())) > HELD:
                yield from flush()
        yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return plain.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, terms: int, prior: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + prior) / (total + prior * terms)), by long division in steps of a thousand, exact in 64
    bits while the denominator is below 9e15. scale is a power of a thousand."""
    below = total + prior * terms
    rest, out = counts + prior, np.zeros(np.broadcast_shapes(counts.shape, np.shape(below)), np.int64)
    while scale > 1:
        rest = rest * 1000
        out, rest, scale = out * 1000 + rest // below, rest % below, scale // 1000
    return 1 + out


def pair_sums(a: np.ndarray, b: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Of rows i of a and j of b the sum of absolute differences, some rows of a at a time."""
    step = max(1, cells // max(1, b.size))
    return np.concatenate([np.zeros((0, len(b)), np.int64)] + [np.abs(a[i : i + step, None, :] - b[None, :, :]).sum(axis=2) for i in range(0, len(a), step)])


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, prior: int = PRIOR, scale: int = SCALE, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: item is each other source of the language, value the summed
    difference of their term shares, all ranks. Part `term`: item is a term that the source uses more than its language
    does, value the difference, the first `top` ranks.

    A null lang, source or text counts as ''. Groups without kept terms give shares of the prior alone; a language without
    kept terms gives pairs of value 0 and no terms; one with a single source no pairs. Every row is a document, repeated
    ones too. No documents: no rows. Other columns are ignored. scale must be a power of a thousand.
    """
    spark = docs.sparkSession
    with C.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(C.ARROW_ROWS)):
        counted = C.stored(count_terms(docs), "term-counts")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = C.stored(kept.select("lang", "term", "n"), "kept-terms")
    used = C.stored(counted.where("term is not null").join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "used-terms")
    # A row a group and a row a language.
    groups = counted.where("term is null").select("lang", "source").join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    size = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("n_terms")), "lang", "left")
    size = size.select("lang", F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.ceil(F.col("n_sources") / sources).alias("s_blocks"), F.greatest(F.lit(1), F.ceil(F.col("n_terms") / terms)).alias("t_blocks"))
    groups, size = C.stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups"), C.stored(size, "languages")

    t_block = F.pmod(F.xxhash64("term"), F.col("t_blocks"))
    s_block = F.pmod(F.xxhash64("source"), F.col("s_blocks"))
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def meet(x: DataFrame, *cols: str) -> DataFrame:
        """A source block's rows go to the tiles of all pairs that it is in."""
        x = x.withColumn("b", s_block).withColumn("o", blocks("s_blocks"))
        return x.select("lang", "t", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", *cols)

    cells = meet(used.join(size, "lang").withColumn("t", t_block), "source", "term", "n")
    columns = kept.join(size, "lang").withColumn("t", t_block).withColumn("i", blocks("s_blocks")).withColumn("j", F.explode(F.sequence("i", F.col("s_blocks") - 1)))
    columns = columns.select("lang", "t", "i", "j", F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("source"), "term", "n")
    rows = meet(groups.join(size, "lang").withColumn("t", blocks("t_blocks")), "source", "total", "lang_total", "n_terms")

    def table(lang: str, out: list[tuple]) -> pd.DataFrame:
        """out: (sources, part, items, values)."""
        join = lambda k, kind: np.concatenate([np.empty(0, kind), *(x[k] for x in out)]).astype(kind)
        part = np.repeat(np.array([x[1] for x in out], object), [len(x[0]) for x in out])
        return pd.DataFrame({"lang": np.full(len(part), lang, object), "source": join(0, object), "part": part, "item": join(2, object), "value": join(3, np.int64)})

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: kept terms (without a source) and counts; right: the sources of both blocks."""
        if right.empty:  # no source fell into either block
            return table("", [])
        lang, i, j = right.lang.iloc[0], right.i.iloc[0], right.j.iloc[0]
        wide, lang_total = int(right.n_terms.iloc[0]), int(right.lang_total.iloc[0])
        head = left[left.source.isna()]
        names = head.term.to_numpy(object)
        at = {t: k for k, t in enumerate(names)}
        matrix = np.zeros((len(right), len(names)), np.int64)
        body = left[left.source.notna()]
        line = {s: k for k, s in enumerate(right.source)}
        matrix[[line[s] for s in body.source], [at[t] for t in body.term]] = body.n
        p = shares(matrix, right.total.to_numpy(np.int64)[:, None], wide, prior, scale) if len(names) else matrix
        one, other = (np.flatnonzero(right.b.to_numpy() == k) for k in (i, j))
        sums = pair_sums(p[one], p[other])
        source = right.source.to_numpy(object)
        a, b = np.meshgrid(one, other, indexing="ij")
        out = []
        for x, y in ((a, b), (b, a))[: 1 if i == j else 2]:
            apart = (x != y).ravel()
            out.append((source[x.ravel()[apart]], "pair", np.array([s.encode() for s in source[y.ravel()[apart]]], object), sums.ravel()[apart]))
        if i == j and len(names):
            more = p - shares(head.n.to_numpy(np.int64), np.int64(lang_total), wide, prior, scale)
            more[matrix == 0] = 0
            for k in range(len(right)):
                best = np.flatnonzero(more[k] > 0)
                if len(best) > top:
                    best = best[more[k, best] >= np.partition(more[k, best], -top)[-top]]
                best = sorted(best, key=lambda c: (-more[k, c], names[c]))[:top]
                out.append((np.full(len(best), source[k], object), "term", names[best], more[k, best]))
        return table(lang, out)

    key = ["lang", "t", "i", "j"]
    made = cells.unionByName(columns).groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(tile, "lang string, source string, part string, item binary, value long")
    made = C.stored(made, "tiles")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = made.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    heads = made.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(heads).withColumn("item", F.col("item").cast("string"))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gt AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
gp AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v.v) AS p FROM gt JOIN v USING (lang)),
lt AS (SELECT lang, term, sum(n) AS n FROM gt GROUP BY ALL),
lp AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v.v) AS q FROM lt JOIN v USING (lang)),
diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM gp a JOIN gp b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(diff.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN diff ON diff.lang = a.lang AND diff.source = a.source AND diff.item = b.source),
terms AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, p - q AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50"""
