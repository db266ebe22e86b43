"""Quality rules whose cutoffs are chosen from labelled holdouts under a bound on false rejections.

Text statistics are computed in the row, with DataFrame functions only. For each rule and stratum a grid of cutoffs is
tested from the laxest to the strictest: a cutoff is accepted if the exact binomial test rejects, at a level shared out
over all rules and strata (Bonferroni), the hypothesis that it drops more than `alpha` of the stratum's good rows; the
first cutoff that fails ends the sequence, so the order itself needs no further correction. With all rules the share of
good rows dropped in a stratum is therefore at most rules x alpha, with confidence 1 - delta over all strata together.
A stratum with too few labelled rows to accept any cutoff rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of good rows that one rule may drop, and the chance that any of the guarantees fails.
ALPHA, DELTA = 0.01, 0.05
#: Rule → (expression over the statistics, cutoffs from lax to strict). A row is rejected if the value is above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "marks_per_word": ("n_marks / greatest(n_words, 1)", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
}


def _covered(hashes: Column, n_words: Column, window: int) -> Column:
    """Words in windows whose hash occurs twice or more. Windows are compared by 64-bit hashes of their words, within one text."""
    pairs = C.let(
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])), lambda x: x["i"])),
    )
    # A running (end, total): each window adds the words beyond the last one's end.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        pairs, start,
        lambda a, i: F.struct((i + window).alias("end"), (a["total"] + (i + window) - F.greatest(i, a["end"])).cast("long").alias("total")),
        lambda a: a["total"],
    )


def statistics(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks (long).

    A null or blank text has zero everywhere. Columns of these names are replaced; _t, _w and _h must not exist.
    """
    text = F.col("_t")
    unlike = lambda drop: (F.length(text) - F.length(F.translate(text, drop, ""))).cast("long")
    x = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    lines = F.filter(F.split("_t", "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]"))
    words = C.let(C.words_of(text), lambda w: F.struct(
        F.size(w).alias("n"),
        F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, window)))).alias("h"),
    ))
    x = x.withColumn("_w", words)
    distinct = F.size(F.array_distinct("_w.h")) == F.size("_w.h")
    lined = C.let(lines, lambda v: F.struct(F.size(v).alias("n"), F.size(F.array_distinct(v)).alias("d")))
    x = x.withColumn("_h", lined)
    return x.withColumns({
        "n_words": F.col("_w.n").cast("long"),
        "word_chars": F.length(F.translate(text, C.BLANKS, "")).cast("long"),
        "n_symbols": unlike(SYMBOLS),
        "n_dup_lines": (F.col("_h.n") - F.col("_h.d")).cast("long"),
        "n_repeat_words": F.when(F.col("_w.h").isNull() | distinct, F.lit(0).cast("long")).otherwise(_covered(F.col("_w.h"), F.col("_w.n"), window)),
        "n_lines": F.col("_h.n").cast("long"),
        "n_capitals": unlike(C.UPPER),
        "n_marks": unlike("!?"),
    }).drop("_t", "_w", "_h")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly but for rounding: a sum of terms from their logarithms."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))
    step = lambda a, i: C.let(a["log"] + F.log((n - i + 1) / i) + odds, lambda g: F.struct(g.alias("log"), (a["sum"] + F.exp(g)).alias("sum")))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: F.least(a["sum"], F.lit(1.0))))


def thresholds(labelled: DataFrame, *, stratum: str, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """labelled: rows of statistics() with `stratum` and boolean `good`. Returns stratum, rule, cutoff, n, k: the strictest
    accepted cutoff of each rule (rows without one are absent), the good rows it was judged on and those it drops."""
    good = labelled.where("good")
    # One counter for each cutoff: the corpus is aggregated once, to one row a stratum.
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.expr(e) > c).alias(f"{name}_{i}") for name, (e, cuts) in rules.items() for i, c in enumerate(cuts)],
    )
    grid = counts.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{name}_{i}").alias("k")) for name, (_, cuts) in rules.items() for i, c in enumerate(cuts)])).alias("g")).select("stratum", "n", "g.*")
    strata = counts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    level = F.lit(delta / len(rules)) / F.col("strata")
    # The mean is above k wherever a test can pass, so that long sums are not taken for hopeless cutoffs.
    passed = F.when(F.col("k") > F.col("n") * alpha, F.lit(False)).otherwise(binomial_tail(F.col("n"), F.col("k"), alpha) <= level)
    tested = grid.join(F.broadcast(strata)).withColumn("passed", passed)  # strata is one row
    so_far = F.min(F.col("passed").cast("int")).over(Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    kept = tested.withColumn("ok", so_far == 1).where("ok")
    return kept.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n", "k"), "step").alias("b")).select("stratum", "rule", "b.*")


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", quality: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, statistics, base_failed, kept, rejected_by (array of rule names).

    base_failed: fewer than 20 words, or over 30 % of words in repeated windows. The thresholds come from labels with
    quality 1 that pass the base. A label without a document, or with a null quality, is not used; a doc_id labelled
    more than once is good if one of its labels is. A null stratum is one of its own. Other columns are not read.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("\u0000")).alias("stratum"), F.col(text_col).alias("text"))
    stats = C.stored(statistics(plain).drop("text").withColumn("base_failed", base), "statistics")
    marks = labels.where(F.col(quality) == 1).select(F.col(id_col).alias("doc_id")).distinct()
    found = thresholds(stats.where("not base_failed").join(marks, "doc_id").withColumn("good", F.lit(True)), stratum="stratum", alpha=alpha, delta=delta)
    cuts = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))  # one row a stratum, one entry a rule
    rejected = F.filter(F.array(*[F.when(F.expr(e) > F.col("cuts")[name], F.lit(name)) for name, (e, _) in RULES.items()]), lambda r: r.isNotNull())
    return stats.join(cuts, "stratum", "left").withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cuts")


def op3(spark, sf_dir: str) -> DataFrame:
    out = judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))


_VALUE = "CASE rule " + " ".join(f"WHEN '{name}' THEN {e}" for name, (e, _) in RULES.items()) + " END"
_GRID = ", ".join(f"({o}, '{name}', {i}, {c})" for o, (name, (_, cuts)) in enumerate(RULES.items()) for i, c in enumerate(cuts))
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(text, '') AS x FROM documents),
d AS (SELECT doc_id, lang, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) u(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), unnest(range(i, i + 8)) u(p) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT d.doc_id, lang, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(x) - length(translate(x, '{SYMBOLS}', '')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, length(x) - length(translate(x, '{C.UPPER}', '')) AS n_capitals, length(x) - length(translate(x, '!?', '')) AS n_marks
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
grid(o, rule, step, cutoff) AS (VALUES {_GRID}),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER ({_VALUE} > cutoff) AS k FROM good, grid GROUP BY ALL),
p AS (SELECT lang, rule, step, cutoff, CASE WHEN k > n * {ALPHA} THEN 0 WHEN k >= n THEN 0 WHEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / {len(RULES)} / (SELECT count(DISTINCT lang) FROM good) THEN 1 ELSE 0 END AS ok FROM k),
a AS (SELECT lang, rule, arg_max(cutoff, step) AS cutoff FROM (SELECT *, min(ok) OVER (PARTITION BY lang, rule ORDER BY step) AS so_far FROM p) WHERE so_far = 1 GROUP BY lang, rule),
j AS (SELECT b.doc_id, string_agg(a.rule, ',' ORDER BY (SELECT min(o) FROM grid WHERE grid.rule = a.rule)) AS rejected_by FROM b JOIN a ON a.lang = b.lang WHERE {_VALUE.replace('CASE rule', 'CASE a.rule')} > a.cutoff GROUP BY b.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN j ON j.doc_id = b.doc_id
"""
