"""Writing tables: dated history, latest copy, and publication behind a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import materialise


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", partition_by: tuple[str, ...] = (),
                gzip: bool = False, options: dict[str, str] | None = None) -> None:
    """parquet, csv, json or text lines; partitions are overwritten one by one when the mode is overwrite. `options` are the format's own."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.option("header", "true").option("encoding", "UTF-8")
    if gzip:
        w = w.option("compression", "gzip")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.options(**(options or {})).format(fmt).save(path)


def publish_if_ready(df: DataFrame, root: str, snapshot_date: str, formal: bool) -> dict[str, bool]:
    """History always; `working` only when there are rows; `latest` only when the formal gate passed."""
    df = materialise(df, "publish")
    stamped = df.withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
    write_table(stamped, f"{root}/history", partition_by=("snapshot_date",))
    some = not df.limit(1).isEmpty()
    if some:
        write_table(df, f"{root}/working")
    if some and formal:
        write_table(df, f"{root}/latest")
    return {"history": True, "working": some, "latest": some and formal}
