"""Proportional stratified interleaving of rows into shards, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Rows that one rank bucket should hold, about.
BUCKET_ROWS = 20_000


def _prefix(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """counts(by, bucket, n) → with `before`, the rows of the buckets before. A window holds one row a bucket, never rows of data."""
    w = Window.partitionBy(*by).orderBy(bucket) if by else Window.orderBy(bucket)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def interleave(docs: DataFrame, *, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", stratum_col: str = "source", extra: dict[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, extra columns, pos, shard, slot: rows are ranked within each stratum in a seeded shuffle, sorted by
    (rank - 1/2) / rows of the stratum, and cut into n_shards runs whose row counts differ by one at most.

    A null stratum is a stratum of its own; a null id shuffles as the text "null". Rows that share an id are ordered by
    their extra columns, and equal rows are interchangeable. An empty table gives no rows. Other columns are not read.
    A stratum may hold any share of the rows: ranks come from hash buckets and their running counts, so no task needs
    more than a bucket.
    """
    extra = extra or {}
    total = docs.count()
    n_buckets = buckets or max(64, -(-total // BUCKET_ROWS))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.when(F.col(stratum_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(stratum_col).cast("string"))).alias("_s"),
        h.alias("_h"),
        *[v.alias(f"_x_{k}") for k, v in extra.items()],
    ).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(1 << 32)))
    ties = ["_h", "_id", *[f"_x_{k}" for k in extra]]

    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("n"))
    counts = _prefix(counts, ["_s"], "_b").withColumn("_n", F.sum("n").over(Window.partitionBy("_s"))).select("_s", "_b", "before", "_n")
    ranked = (
        rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_b").orderBy(*ties)))
        .join(counts, ["_s", "_b"])
        .withColumn("_f", (2 * (F.col("_r") + F.col("before")) - 1) / (2 * F.col("_n")))
        .drop("before", "_r", "_b", "_n")
        .withColumn("_b", F.floor(F.col("_f") * n_buckets))
    )
    places = _prefix(ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("n")), [], "_b").select("_b", "before")
    pos = ranked.withColumn("_p", F.row_number().over(Window.partitionBy("_b").orderBy("_f", "_s", *ties)) - 1).join(places, "_b").withColumn("_p", F.col("_p") + F.col("before"))
    shard = F.floor(F.col("_p") * n_shards / F.lit(max(total, 1)))
    exact = F.when((shard + 1) * total <= F.col("_p") * n_shards, shard + 1).when(shard * total > F.col("_p") * n_shards, shard - 1).otherwise(shard)
    return pos.withColumn("_k", exact).select(
        F.col("_id").alias(id_col), *[F.col(f"_x_{k}").alias(k) for k in extra],
        F.col("_p").alias("pos"), F.col("_k").cast("int").alias("shard"), (F.col("_p") - F.expr(f"(_k * {total} + {n_shards - 1}) div {n_shards}")).alias("slot"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    out = interleave(C.table(spark, sf_dir, "documents"), extra={"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
