"""Solving as facts arrive: a solution in a folder that grows by batches, each batch counted exactly once.

A version of the solution is written whole into a folder of its own, and a last small file says that it is complete and
which batch made it. A batch that is not newer than the newest complete version has been counted and is skipped; a batch
that broke off left no such file and is done again. Any split of the same facts into batches gives the same solution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.fixpoint import Rule, Solution, solve


class Kept:
    """The newest complete version of a solution below root; schemas: relation → columns as text."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def last(self) -> int | None:
        """The newest batch that is counted."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        here = hadoop.Path(self.root)
        files = here.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(here):
            return None
        names = [s.getPath() for s in files.listStatus(here)]
        done = [int(p.getName()) for p in names if p.getName().isdigit() and files.exists(hadoop.Path(p, "complete/_SUCCESS"))]
        return max(done, default=None)

    def read(self, batch: int) -> Solution:
        return Solution({k: self.spark.read.schema(s).parquet(f"{self.root}/{batch}/{k}") for k, s in self.schemas.items()})

    def write(self, batch: int, solution: Solution) -> None:
        for k, s in self.schemas.items():
            rows = solution[k] if k in solution else self.spark.createDataFrame([], s)
            rows.write.mode("overwrite").parquet(f"{self.root}/{batch}/{k}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/{batch}/complete")

    def take(self, batch: int, facts: dict[str, DataFrame], rules: list[Rule], **options) -> Solution:
        """The solution with facts, if the batch is new; otherwise as it is."""
        last = self.last()
        if last is not None and batch <= last:
            return self.read(last)
        empty = {k: self.spark.createDataFrame([], s) for k, s in self.schemas.items()}
        known = None if last is None else self.read(last)
        found = solve({**({} if known else empty), **facts}, rules, known=known, **options)
        if found.pending or found.waiting:
            raise ValueError("a kept solution must be a whole one")
        self.write(batch, found)
        return self.read(batch)


def maintain(facts: DataFrame, relations: Callable[[DataFrame], dict[str, DataFrame]], rules: list[Rule], kept: Kept, checkpoint: str, **trigger):
    """A streaming query that keeps the solution up to date. relations: a batch's rows → facts by relation."""

    def batch(rows: DataFrame, number: int) -> None:
        kept.take(number, relations(rows), rules)

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
