"""Secret scans over every version of every blob, each scanned once for each version of the rules.

A ledger keeps, for every (blob, rules version) scanned so far, the spans found. New versions of files are
content-addressed; only pairs that the ledger lacks are scanned and appended; findings are joined back to all paths.
DataFrame functions only: spans come from the lengths of what a pattern matches and of what stands between.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost non-overlapping matches are candidates, and those whose `group` has `least` code points count.
    hint: a cheaper pattern that every text with a counting match contains."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


#: The base rules and what the scanner adds, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", 0, 20),
    # Runs below 24 characters do not count, and a run is taken whole, so that only longer ones need to be matched at all.
    Rule("hex", r"[0-9a-f]{24,}", "[0-9a-f]{24}"),
    # A class and not a repeated group stands between: Java's engine recurses for every repeat of a group.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]*:[^\x00-\x20/:@]{3,}@", r"://[^\x00-\x20/]*@"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]*\.eyJ"),
)
RULES_VERSION = "1.2"
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points, end exclusive."""
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    both = F.zip_with(match, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b"), F.length(m).alias("n")))
    # zip_with goes on to the last piece between, which no match follows.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("got"))

    def step(a: Column, x: Column) -> Column:
        begin, end = a["at"] + x["b"], a["at"] + x["b"] + x["n"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(a["got"], F.array(span))).otherwise(a["got"]).alias("got"))

    keep = F.transform(F.filter(both, lambda x: x["m"].isNotNull()), lambda x: F.struct(x["b"].alias("b"), x["n"].alias("n"), _keep(rule, x["m"]).alias("ok")))
    return F.when(text.rlike(rule.hint), F.aggregate(keep, start, step, lambda a: a["got"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def _keep(rule: Rule, m: Column) -> Column:
    return F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then in the order of the rules."""
    return F.sort_array(F.flatten(F.array(*[_spans(text, r, i) for i, r in enumerate(rules)])))


LEDGER = f"blob_id string, rules_version string, spans array<{SPAN}>"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: str, *, path_col: str = "path", content_col: str = "content", rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """versions: a row for each historical version of a file. Returns path, blob_id, spans of every row, and appends what
    was scanned to the ledger (a folder of Parquet files).

    A null content is an empty blob; a null path is kept; rows that share path and content are kept as they are. An empty
    table gives no rows. Other columns are not read. An append that is repeated after a failure adds rows that say the
    same, which reading merges.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(content_col), F.lit(""))
    named = versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("_text"))
    known = _ledger(spark, ledger).where(F.col("rules_version") == rules_version).select("blob_id").distinct()
    # One text for each blob, with partial results where rows are read: a hot blob's copies do not travel.
    unseen = named.select("blob_id", "_text").groupBy("blob_id").agg(F.max("_text").alias("_text")).join(known, "blob_id", "left_anti")
    found = unseen.select("blob_id", F.lit(rules_version).alias("rules_version"), spans(F.col("_text"), rules).cast(f"array<{SPAN}>").alias("spans"))
    found.write.mode("append").parquet(ledger)
    all_found = _ledger(spark, ledger).where((F.col("rules_version") == rules_version) & (F.size("spans") > 0)).dropDuplicates(["blob_id"])
    none = F.array().cast(f"array<{SPAN}>")
    return named.drop("_text").join(all_found.select("blob_id", "spans"), "blob_id", "left").select("path", "blob_id", F.coalesce("spans", none).alias("spans"))


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4(spark, sf_dir: str) -> DataFrame:
    out = scan(C.table(spark, sf_dir, "documents"), C.fresh_dir(spark, "ledger"), path_col="doc_id", content_col="text")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
