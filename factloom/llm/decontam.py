"""Benchmark decontamination: a prefix-filtered join between the windows of benchmark items and whole documents.

A window is `size` consecutive words of an item, or the whole item if it is shorter. Windows are matched exactly, so
of a window's words, ordered by how rare they are in the corpus, the first one alone is a necessary prefix: a document
that contains the window contains that word. Document words are joined on it, the word's place in the window bounds
where the window would have to start and whether it fits into the document, and the words there are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SIZE = 10
#: Word characters: digits, a-z after lower-casing, and everything beyond ASCII.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Prefix words are sent to all executors only up to this many rows of about 150 bytes; beyond, they are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return C.words_of(C.ascii_lower(F.coalesce(text, F.lit(""))), APART)


def windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, window (array of words), one row each; items without words have none."""
    w = F.col("_w")
    starts = F.when(F.size(w) > size, F.sequence(F.lit(1), F.size(w) - size + 1)).when(F.size(w) > 0, F.array(F.lit(1)))
    x = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("_w"))
    return x.select("item_id", "_w", F.explode(starts).alias("_s")).select("item_id", F.slice("_w", F.col("_s"), size).alias("window")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prefixes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found(window) → window, n, word, at: each window's rarest word in the corpus and its place (0-based)."""
    places = found.select("window", F.posexplode("window").alias("at", "word"))
    known = places.select("word").distinct()
    n = known.count()
    known = _small(known, n)
    df = docs.select(F.explode("_w").alias("word")).join(known, "word").groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    ranked = places.join(_small(df, n), "word", "left")  # df has a row for each known word at most
    order = F.struct(F.coalesce("f", F.lit(0)), "word", "at")
    return ranked.groupBy("window").agg(F.min(order).alias("p")).select("window", F.size("window").alias("n"), F.col("p.word").alias("word"), F.col("p.at").alias("at"))


def matches(docs: DataFrame, items: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, _k, n_words); places (doc_id, _k, window, at); items (item_id, window). _k: hash of the text, so
    that rows with one doc_id and different texts are kept apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_k"), words(text).alias("_w"))
    own = C.cut(windows(items, size, item_id, item_text))
    distinct = own.select("window").distinct()
    keys = C.cut(prefixes(plain, distinct))
    many = keys.count() > BROADCAST_ROWS
    start = F.col("_p") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.size("_w")) & (F.slice("_w", start + 1, F.col("n")) == F.col("window"))
    if many:  # words alone are shuffled, and a document's words meet the places found in it again
        at = plain.select("doc_id", "_k", F.posexplode("_w").alias("_p", "word")).join(keys, "word")
        at = at.withColumnsRenamed({"doc_id": "_d", "_k": "_h"})
        hit = plain.distinct().join(at, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h"))).where(fits)
    else:  # a row is copied only where a prefix word stands
        hit = plain.select("doc_id", "_k", F.posexplode("_w").alias("_p", "word"), "_w").join(F.broadcast(keys), "word").where(fits)
    hit = hit.select("doc_id", "_k", "window", start.alias("at"))
    return plain.select("doc_id", "_k", F.size("_w").cast("long").alias("n_words")), hit, own


def contamination(docs: DataFrame, items: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of item_id as text), contaminated; one row for each input row.

    n_hit counts the words inside any occurrence of a window. Null or wordless texts have no words and no hits; items
    without words are in no document; rows equal in doc_id and text get equal results; items that share an item_id are
    one item. A null item_id counts as the text "null", a null doc_id is kept. Other columns are not read.
    """
    base, hit, own = matches(docs, items, size=size, id_col=id_col, text_col=text_col, item_id=item_id, item_text=item_text)
    hit = C.stored(hit.withColumn("n", F.size("window")).withColumn("win", F.sha2(F.to_json("window"), 256)).drop("window").distinct(), "decontam")
    # Windows of one document are merged in its row: first the widest one at each place, then a running end.
    spans = hit.groupBy("doc_id", "_k", "at").agg(F.max("n").alias("n")).groupBy("doc_id", "_k").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), lambda a, x: F.struct(
        F.greatest(a["end"], x["at"] + x["n"]).alias("end"),
        (a["total"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(x["at"], a["end"]))).alias("total")), lambda a: a["total"].cast("long"))
    names = own.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.sha2(F.to_json("window"), 256).alias("win")).distinct()
    names = _small(names, names.count())
    which = hit.select("doc_id", "_k", "win").distinct().join(names, "win").select("doc_id", "_k", "item").distinct()
    which = which.groupBy("doc_id", "_k").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = spans.select("doc_id", "_k", covered.alias("n_hit")).join(which, ["doc_id", "_k"])
    found = found.withColumnsRenamed({"doc_id": "_d", "_k": "_h"})
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")
    return out.select("doc_id", "_k", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, size: int = SIZE) -> DataFrame:
    """docs without the rows in which a window of an item occurs, with their own columns."""
    bad = contamination(docs, items, size=size).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_h"]), "left_anti")


def op5(spark, sf_dir: str) -> DataFrame:
    out = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + 9] AS g, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, s, n, w[s:s + n - 1] AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
hit AS (SELECT DISTINCT doc_id, item_id, s, dg.n FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
