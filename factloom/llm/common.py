"""What the corpus operators share: table access, the shared folder, and in-row expression helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANKS_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch. Texts can be long, so the default of 10,000 rows would not bound a worker's memory.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set (local tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if sc.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(own := tempfile.mkdtemp(prefix="factloom-"))
    return f"file://{own}"


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """As cut(), but as compressed Parquet: for tables that are wide or read more than once."""
    df.write.parquet(path := fresh_dir(df.sparkSession, tag))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a loop: lets Spark drop the shuffles and checkpoints of frames that nothing holds any more,
    and the driver's heap shrink again. Without it both grow with the number of rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """key has this value meanwhile, and its former one afterwards."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def interpreted(spark: SparkSession):
    """Many short jobs: no generated classes for each of their stages, which would fill the driver's memory."""
    return setting(spark, "spark.sql.codegen.wholeStage", "false")


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, though body may use it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, blanks: str = BLANKS_RE) -> Column:
    """Array of the maximal runs of characters outside blanks; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), blanks), lambda w: w != "")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
