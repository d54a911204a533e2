"""Structured Streaming forms of the intraday operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from barloom.functions.scalars import BUSINESS_TZ, business_clock, flag
from barloom.operators.market import breadth_counts
from barloom.session import materialise, shared_dir

# Reason of a reject.
NO_KEY = "交易ID缺失"


def read_ticks(spark: SparkSession, folder: str, name: str = "*.parquet") -> DataFrame:
    """Stream over landed parquet files; the schema comes from the files' footers."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    # A watermark needs a zoned timestamp; stored local times are read in the session's zone.
    local = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def stream_bars_5m(ticks: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tumbling OHLCV bars per symbol (ticks: symbol, ts, event_id, price, volume). The watermark bounds the state."""
    t = ticks.withWatermark("ts", lateness)
    order = F.struct("ts", "event_id")
    b = t.groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return b.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def stream_latest(ticks: DataFrame) -> DataFrame:
    """Latest tick per symbol; state is one row per symbol (update or complete mode)."""
    s = ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "event_id", "price", "volume"), F.struct("ts", "event_id")).alias("r"))
    return s.select("symbol", "r.ts", "r.event_id", "r.price", "r.volume")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ExitAlerts(StatefulProcessor):
    """Bars of a symbol wait in its state, by slot of time, until the watermark has passed their slot; then a timer flushes the slot in order of time.

    Whatever order and amount bars come in, the rule sees them in order, and a task holds one Arrow batch and one slot. A bar that comes behind
    bars already flushed is too late and is left out. Equal bars count once. Times are micros since the epoch, so no zone is in play.
    """

    def __init__(self, slot: int):
        self.slot = slot

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "at array<long>, close array<double>, stop array<double>")
        self.last = handle.getValueState("last", "at long, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        for frame in rows:
            frame = frame if last is None else frame[frame["at"] > last[0]]
            for slot, part in frame.groupby(frame["at"] // self.slot):
                new = [part[c].tolist() for c in ("at", "close", "stop")]
                old = self.waiting.getValue((int(slot),))
                self.waiting.updateValue((int(slot),), tuple(new if old is None else [[*a, *b] for a, b in zip(old, new)]))
                self.handle.registerTimer((int(slot) + 1) * self.slot // 1000 - 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = (expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000 // self.slot - 1
        waiting = self.waiting.getValue((slot,))
        if waiting is None:
            return
        self.waiting.removeKey((slot,))
        last, hits = self.last.get(), []
        before = None if last is None else last[1]
        for at, close, stop in sorted(set(zip(*waiting))):
            if before is not None and close < stop and before < stop:
                hits.append((key[0], at, close, stop))
            before = close
        self.last.update((at, before))
        if hits:
            yield pd.DataFrame(hits, columns=["symbol", "at", "close", "stop"])

    def close(self) -> None:
        pass


def stream_exit_alerts(bars5m: DataFrame, stops: DataFrame, slot: str = "5 minutes") -> DataFrame:
    """An alert when two consecutive five-minute closes are under the stop. bars5m: symbol, ts, close, a stream with a watermark, such as that of
    `stream_bars_5m`, whose watermark is passed on, so that ticks become alerts in one query. A slot (whole milliseconds) is flushed once the watermark has
    passed it; a state access costs some tenths of a millisecond, so a long history is caught up faster with a wider slot."""
    bars5m.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    j = bars5m.filter(F.col("close").isNotNull()).join(stops.filter(F.col("stop").isNotNull()).select("symbol", "stop"), "symbol")
    j = j.select("symbol", F.unix_micros("ts").alias("at"), "close", "stop")
    micros = int(pd.Timedelta(slot).total_seconds() * 1000) * 1000
    out = j.groupBy("symbol").transformWithStateInPandas(ExitAlerts(micros), "symbol string, at long, close double, stop double", "append", "eventTime")
    return out.select("symbol", F.timestamp_micros("at").alias("ts"), "close", "stop")


class BucketStore:
    """A stored table in buckets by hash of its keys. A batch reads and writes the buckets it touches and no others.

    A bucket has two slots. Each holds a whole version of the bucket and the number of the batch that wrote it; a batch reads the newer slot among
    earlier batches' and writes the other one. So files do not pile up, and a batch that runs again after a failure, even halfway through its
    write, finds what it found the first time. Null keys are values like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        empty = spark.createDataFrame([], schema).withColumns({"_batch": F.lit(-1).cast("long"), "_bucket": F.lit(0), "_slot": F.lit(0)})
        empty.write.mode("ignore").partitionBy("_bucket", "_slot").parquet(path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, buckets: list[int] | None = None) -> DataFrame:
        """Both slots of the given buckets (all, if none are given); only their folders are read."""
        full = StructType([*self.schema.fields, StructField("_batch", LongType()), StructField("_bucket", IntegerType()), StructField("_slot", IntegerType())])
        stored = self.spark.read.schema(full).parquet(self.path)
        return stored if buckets is None else stored.filter(F.col("_bucket").isin(buckets))

    def latest(self, before: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows with _bucket and _slot as the batches before `before` left them."""
        rows = self.versions(buckets).filter(F.col("_batch") < before)
        newest = rows.groupBy("_bucket").agg(F.max(F.struct("_batch", "_slot")).alias("_n")).select("_bucket", F.col("_n._batch").alias("_batch"))
        return rows.join(newest, ["_bucket", "_batch"], "left_semi").drop("_batch")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Replaces the rows with the batch's keys, which come up once in it, and keeps the others."""
        new = materialise(batch.withColumn("_bucket", self.bucket()), "upsert")
        touched = [b for (b,) in new.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        old = self.latest(number, touched)
        slots = old.groupBy("_bucket").agg(F.max("_slot").alias("_old"))
        same = [old[k].eqNullSafe(new[k]) for k in self.keys]
        kept = old.join(new.select(*self.keys), reduce(and_, same), "left_anti").drop("_slot")
        rows = kept.unionByName(new).join(slots, "_bucket", "left").withColumns({"_batch": F.lit(number).cast("long"), "_slot": 1 - F.coalesce("_old", F.lit(1))})
        rows = materialise(rows.drop("_old"), "upsert").repartition("_bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_slot").parquet(self.path)


def stream_ingest(rows: DataFrame, name: str = "ingest", key: str = "txn_id", buckets: int = 64) -> str:
    """Append each content id once to a stored ledger; returns its path. Rows without an id go to a table of rejects beside it, with the reason.

    A batch keeps the ids that no earlier batch has stored, however late they come. Stored ids lie in buckets by their hash (BucketStore), so a batch
    reads two files at most per bucket it touches, however many batches there were. It writes its rows under its own number, so that a batch run
    again after a failure replaces what it wrote."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], rows.schema).write.parquet(f"{root}/table/batch=-1")
    spark.createDataFrame([], rows.schema).withColumn("reject_reason", F.lit("")).write.parquet(f"{root}/rejects/batch=-1")
    ids = BucketStore(spark, f"{root}/ids", StructType([rows.schema[key]]), (key,), buckets)

    def step(batch: DataFrame, number: int) -> None:
        batch.filter(F.col(key).isNull()).withColumn("reject_reason", F.lit(NO_KEY)).write.mode("overwrite").parquet(f"{root}/rejects/batch={number}")
        given = materialise(batch.filter(F.col(key).isNotNull()).dropDuplicates([key]), "ingest-batch")
        touched = [b for (b,) in given.select(ids.bucket()).distinct().collect()]
        new = given.join(ids.latest(number, touched).select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{root}/table/batch={number}")
        ids.upsert(given.select(key), number)

    rows.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return f"{root}/table"


def late_data_rule(rows: DataFrame, start: str, end: str, ts: str = "ts", tz: str = BUSINESS_TZ) -> tuple[DataFrame, DataFrame]:
    """(rows inside the decision window by event time on the business clock, side output of the others)."""
    inside = flag(F.date_format(business_clock(ts, tz), "HH:mm").between(start, end))
    return rows.filter(inside), rows.filter(~inside)


def run_to_table(df: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> str:
    """Drain the available input into a parquet table in the shared folder; returns its path.

    A complete result replaces the table. An update result replaces the rows with its keys, bucket by bucket (BucketStore), and what they come to is written
    out once the input is drained."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        w.format("parquet").option("path", f"{root}/table").start().awaitTermination()
        return f"{root}/table"
    if mode == "update":
        if not keys:
            raise ValueError("update mode needs the keys of its rows")
        store = BucketStore(spark, f"{root}/buckets", df.schema, keys)
        w.foreachBatch(store.upsert).start().awaitTermination()
        store.latest(1 << 62).select(*df.columns).write.parquet(f"{root}/table")
        return f"{root}/table"
    spark.createDataFrame([], df.schema).write.parquet(f"{root}/table--1")
    last = [-1]

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table-{number}")
        last[0] = number

    w.foreachBatch(step).start().awaitTermination()
    return f"{root}/table-{last[0]}"


def stream_breadth(ticks: DataFrame, previous: DataFrame, name: str = "breadth") -> str:
    """Two stages per batch: latest tick per symbol, then breadth against the previous prices."""
    root = f"{shared_dir(ticks.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def step(batch: DataFrame, _id: int) -> None:
        x = batch.join(previous.select("symbol", F.col("price").alias("_p")), "symbol")
        x = x.withColumn("pct", (F.col("price") / F.nullif(F.col("_p"), F.lit(0.0)) - 1) * 100).withColumn("scope", F.lit("all"))
        breadth_counts(x, ("scope",)).write.mode("overwrite").parquet(f"{root}/table")
    q = (stream_latest(ticks).writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
         .outputMode("complete").foreachBatch(step).start())
    q.awaitTermination()
    return f"{root}/table"
