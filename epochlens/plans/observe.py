"""What a run has done: job descriptions for the scheduler's lists, and totals observed while the data pass."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DESCRIPTION = "spark.job.description"


@contextmanager
def described(spark: SparkSession, text: str) -> Iterator[None]:
    """Jobs started inside carry the text; what was set before comes back."""
    sc = spark.sparkContext
    before = sc.getLocalProperty(DESCRIPTION)
    sc.setJobDescription(text)
    try:
        yield
    finally:
        sc.setLocalProperty(DESCRIPTION, before)


class Totals:
    """Named totals of tables as they are materialised: no table is read once more to count it."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame, **sums: Column) -> DataFrame:
        self.seen[name] = Observation(name)
        named = [F.coalesce(value, F.lit(0)).alias(key) for key, value in sums.items()]
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *named)

    def read(self) -> dict[str, dict]:
        """All totals; a watched table must have been materialised."""
        return {name: dict(one.get) for name, one in self.seen.items()}
