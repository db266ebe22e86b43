"""Winnowing over line hashes: later repeats of runs of lines are deleted.

Lines with a word are hashed. A gram starts at every line and is the fewest lines with GRAM words or more. Of the grams
that start within SPAN - GRAM words of a line, the least one is a fingerprint. Any run of SPAN words or more that occurs
twice therefore has a common fingerprint in both places: its first window lies inside the run and decides alike.
Each later occurrence of a fingerprint is joined with the earliest one, in order of (doc_id, text hash, line), so that a
gram's occurrences never meet in pairs; the match is extended line by line both ways, within SPAN words that travel with
the fingerprint, which reaches the next common fingerprint or the end of the run. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, SPAN = 40, 50


def _lines(text: Column) -> Column:
    """The lines with a word: hashes h and h2, and the number of words w."""
    rows = F.transform(F.split(text, "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("h2"), F.size(C.words_of(x)).alias("w")))
    return F.filter(rows, lambda x: x["w"] > 0)


def _grams(lines: Column, gram: int) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("g2"))

    def add(a: Column, x: Column) -> Column:
        more = F.struct((a["n"] + 1).alias("n"), (a["words"] + x["w"]).alias("words"), F.xxhash64(a["g"], x["h"]).alias("g"), F.xxhash64(a["g2"], x["h2"], F.lit(2)).alias("g2"))
        return F.when(a["words"] < gram, more).otherwise(a)

    def of(x: Column, k: Column) -> Column:
        one = F.struct(F.lit(1).alias("n"), x["w"].alias("words"), F.xxhash64(F.lit(0).cast("long"), x["h"]).alias("g"), F.xxhash64(F.lit(0).cast("long"), x["h2"], F.lit(2)).alias("g2"))
        made = F.when(x["w"] >= gram, one).otherwise(F.aggregate(F.slice(lines, k + 1, gram), start, add))
        return F.struct(k.alias("k"), x["w"].alias("w"), made.alias("m"))

    return F.transform(lines, of)


def _chosen(grams: Column, gram: int, span: int) -> Column:
    """The places of the fingerprints: the least gram (the first of equal ones) of each line's window."""
    reach = span - gram
    none = F.struct(F.lit(0).alias("before"), F.lit(None).cast("struct<g:bigint,g2:bigint,k:int>").alias("best"))

    def least(a: Column, x: Column) -> Column:
        own = F.when((a["before"] <= reach) & (x["m"]["words"] >= gram), F.struct(x["m"]["g"].alias("g"), x["m"]["g2"].alias("g2"), x["k"].alias("k")))
        best = F.when(own.isNull() | (a["best"] <= own), a["best"]).otherwise(own)
        return F.struct((a["before"] + x["w"]).alias("before"), best.alias("best"))

    at = F.transform(grams, lambda x, k: F.when(x["w"] > reach, F.when(x["m"]["words"] >= gram, k)).otherwise(F.aggregate(F.slice(grams, k + 1, reach + 1), none, least, lambda a: a["best"]["k"])))
    return F.array_distinct(F.filter(at, lambda k: k.isNotNull()))


def _context(lines: Column, span: int) -> Column:
    """Hashes of the first lines, up to the one that brings the words to span."""
    start = F.struct(F.lit(0).alias("words"), F.array().cast("array<bigint>").alias("h"))
    step = lambda a, x: F.when(a["words"] < span, F.struct((a["words"] + x["w"]).alias("words"), F.concat(a["h"], F.array(x["h"])).alias("h"))).otherwise(a)
    return F.aggregate(lines, start, step, lambda a: a["h"])


def fingerprints(docs: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """docs(_d, _k, text) → _d, _k, at (place among the lines with words), n (lines), g, g2, left, right."""

    def of(lines: Column) -> Column:
        def with_grams(grams: Column) -> Column:
            def one(k: Column) -> Column:
                m = grams[k]["m"]
                back = F.when(k > 0, F.reverse(F.slice(lines, F.greatest(k - span + 1, F.lit(1)), F.least(k, F.lit(span))))).otherwise(F.slice(lines, 1, 0))
                return F.struct(k.alias("at"), m["n"].alias("n"), m["g"].alias("g"), m["g2"].alias("g2"), _context(back, span).alias("left"), _context(F.slice(lines, k + m["n"] + 1, span), span).alias("right"))

            return F.transform(_chosen(grams, gram, span), one)

        return C.let(_grams(lines, gram), with_grams)

    made = docs.select("_d", "_k", C.let(_lines(F.col("text")), of).alias("f"))
    return made.select("_d", "_k", F.explode("f").alias("f")).select("_d", "_k", "f.*")


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def repeats(docs: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """docs(_d, _k, text) → _d, _k, runs: sorted array of (lo, hi), the places of lines to delete."""
    marks = C.stored(fingerprints(docs, gram, span).distinct(), "fingerprints")
    first = marks.groupBy("g", "g2").agg(F.min(F.struct("_d", "_k", "at", "n", "left", "right")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    later = marks.join(first, ["g", "g2"]).where(F.struct("_d", "_k", "at") > F.struct("f._d", "f._k", "f.at"))
    lo, hi = F.col("at") - _common(F.col("left"), F.col("f.left")), F.col("at") + F.col("n") - 1 + _common(F.col("right"), F.col("f.right"))
    return later.groupBy("_d", "_k").agg(F.sort_array(F.collect_set(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))).alias("runs"))


def dedup(docs: DataFrame, *, gram: int = GRAM, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their own columns, text without repeated runs, and _removed: the deleted lines' numbers (0-based).

    Documents are ordered by id, then by a hash of the text; a null id comes first. A repeated run of `span` words or
    more loses at least its fingerprints' grams and what extends them; one below `gram` words stays. Blank lines stay. Rows
    equal in id and text are one document and stay alike. A null text stays null; a text all of whose lines are deleted
    becomes empty, and its row stays. An empty table gives no rows. Column names starting with an underscore are reserved.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_d"), F.xxhash64(text).alias("_k")]
    found = repeats(docs.select(*key, text.alias("text")), gram, span)
    x = docs.withColumns({"_d": key[0], "_k": key[1]}).join(found.withColumnRenamed("runs", "_runs"), ["_d", "_k"], "left")

    def gone(lines: Column) -> Column:
        full = F.filter(F.transform(lines, lambda v, i: F.when(v.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
        return C.let(full, lambda at: F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(F.col("_runs"), lambda r: F.sequence(r["lo"], r["hi"]))), lambda k: at[k]))))

    x = x.withColumn("_removed", F.when(F.col("_runs").isNotNull(), gone(F.split(text, "\n"))).otherwise(F.array().cast("array<int>")))
    left = C.let(F.split(text, "\n"), lambda v: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col("_removed")), lambda i: v[i]), "\n"))
    return x.withColumn(text_col, F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(left)).drop("_d", "_k", "_runs")


def op9(spark, sf_dir: str) -> DataFrame:
    out = dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")))
    return out.select("doc_id", "n_lines", F.size("_removed").cast("long").alias("n_removed"), F.array_join(F.transform("_removed", lambda i: i.cast("string")), ",").alias("removed"), "text")
