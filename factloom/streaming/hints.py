"""Hints as a stream: files that appear in a folder are read, repeats are dropped, and each batch is handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import HINTS, hint_relations


def stream(spark: SparkSession, folder: str, kind: str = "reads", files_a_trigger: int = 100) -> DataFrame:
    """A streaming relation of one kind of hint, each hint once: the state holds a row for each distinct hint."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    parsed = raw.select(F.from_json("value", HINTS).alias("j")).select("j.*")
    named = lambda loc: F.when(loc.rlike(r"^\d+:"), F.concat(F.get("modules", F.regexp_extract(loc, r"^(\d+):", 1).cast("int")), F.regexp_replace(loc, r"^\d+", ""))).otherwise(loc)
    if kind == "functions":
        return parsed.select("modules", F.explode("functions").alias("loc")).select(named(F.col("loc")).alias("loc")).dropDuplicates()
    x = parsed.select("modules", F.explode(kind).alias("e"))
    return x.select(*[(named(F.col(f"e.{f}")) if f.lower().endswith("loc") else F.col(f"e.{f}")).alias(f) for f in x.schema["e"].dataType.names]).dropDuplicates()


def ingest(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[dict[str, DataFrame], int], None], **trigger):
    """foreachBatch over arriving hint files: handle gets the batch's relations and its number."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    parsed = raw.select(F.from_json("value", HINTS).alias("j")).select("j.*")
    return parsed.writeStream.foreachBatch(lambda df, n: handle(hint_relations(df), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
