"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import materialise  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The named columns alone, under internal names, so that extra columns of the input can't clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


class Memo(dict):
    """What was worked out for words seen already, by word. It is emptied when what it holds passes `limit` bytes, by a rough count, and what takes more than a
    256th of that is not kept at all, so junk can't fill a worker's memory."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.used = limit, 0

    def keep(self, key, value, size: int):
        if size <= self.limit >> 8:
            if self.used + size > self.limit:
                self.empty()
            self.used += size
            self[key] = value
        return value

    def empty(self) -> None:
        self.clear()
        self.used = 0
