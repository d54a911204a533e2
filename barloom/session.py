"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on.

    Rows of the feature panel are wide. Whole-stage methods over them pass the JVM's 8,000-byte limit for
    compiled methods and are then interpreted, which costs three to five times; per-operator code is split
    into small methods. The field limit sends only such wide plans that way. The session's zone is left alone: rules
    that read hours or days take the business zone as a parameter.
    """
    spark.conf.set("spark.sql.codegen.maxFields", "40")
    return spark


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName("barloom")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", memory)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: the session's checkpoint setting. Only where that is unset and everything runs on one
    machine (a local master) a fresh local folder is taken, once per application."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="barloom-shared-")
    return _FALLBACK[app]


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Used where several later branches read the same wide panel, so that it is computed once, keeps
    column pruning and push-down, and survives the loss of executors.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
