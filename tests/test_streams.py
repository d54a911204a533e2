"""Streams over landed files: exit alerts in order of time, ingest by id, upserts by key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.streaming import streams

T0 = dt.datetime(2026, 1, 5, 1, 30)


def at(i):
    return T0 + dt.timedelta(minutes=5 * i)


def plain_alerts(bars, stops):
    out = []
    for symbol, stop in stops.items():
        own = sorted({(t, c) for s, t, c in bars if s == symbol})
        out += [(symbol, t, c) for (_, b), (t, c) in zip(own, own[1:]) if b < stop and c < stop]
    return sorted(out)


@pytest.mark.parametrize("zone,slot", [("UTC", "5 minutes"), ("Asia/Shanghai", "1 hour")])
def test_alerts_of_history_late_and_equal_bars(spark, tmp_path, zone, slot):
    """A first batch with all history in disorder, equal bars, then bars of the next batch, the first of them late."""
    rnd = random.Random(2)
    bars = [(s, at(i), round(10 + rnd.gauss(0, 0.3), 2)) for s in ("a", "b", "c") for i in range(60)]
    bars += rnd.sample(bars, 20)
    rnd.shuffle(bars)
    later = [("a", at(70), 9.0), ("a", at(71), 9.0), ("z", at(90), 1.0)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        schema = "symbol string, ts timestamp, close double"
        for n, rows in enumerate((bars, later, [("a", at(3), 1.0), ("z", at(200), 1.0)])):
            spark.createDataFrame([(s, t.replace(tzinfo=dt.timezone.utc), c) for s, t, c in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={n}"))
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in/part=*")).select("symbol", "ts", "close")
        stops = spark.createDataFrame([("a", 10.0), ("b", 9.9), ("c", None)], "symbol string, stop double")
        path = streams.run_to_table(streams.stream_exit_alerts(src.withWatermark("ts", "10 minutes"), stops, slot), "alerts")
        got = spark.read.parquet(path).select("symbol", F.unix_seconds("ts").alias("t"), "close").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want = plain_alerts(bars + later, {"a": 10.0, "b": 9.9})
    assert sorted((r.symbol, r.t, r.close) for r in got) == [(s, int(t.replace(tzinfo=dt.timezone.utc).timestamp()), c) for s, t, c in want]
    assert len(want) > 10


def test_ingest_rejects_rows_without_id_and_reads_touched_buckets(spark, tmp_path):
    schema = "txn_id string, qty long"
    for n, rows in enumerate(([("a", 1), ("b", 2), (None, 3), (None, 4)], [("c", 5), ("a", 6)], [("b", 7), (None, 8), ("d", 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    path = streams.stream_ingest(src)
    assert sorted((r.txn_id, r.qty) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 5), ("d", 9)]
    rejects = spark.read.parquet(path.removesuffix("table") + "rejects").collect()
    assert sorted(r.qty for r in rejects) == [3, 4, 8] and {r.reject_reason for r in rejects} == {streams.NO_KEY}


def test_bucket_store(spark, tmp_path):
    """Versions alternate between two slots, a batch that runs again gives the same, untouched buckets are left alone."""
    schema = spark.createDataFrame([], "k string, v long").schema
    store = streams.BucketStore(spark, str(tmp_path / "s"), schema, ("k",), 4)
    state = {}
    for n in range(6):
        rows = [(f"k{(n * 7 + i) % 11}", n * 100 + i) for i in range(5)] + ([(None, n)] if n % 2 else [])
        state |= dict(rows)
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2 if n in (2, 5) else 1):
            store.upsert(batch, n)
        assert {r.k: r.v for r in store.latest(1 << 62).collect()} == state
    files = [f for f in (tmp_path / "s").rglob("*.parquet") if f.stat().st_size]
    assert len(files) <= 2 * 4 + 2
    before = {f: f.stat().st_mtime_ns for f in files}
    store.upsert(spark.createDataFrame([("k0", -1)], schema), 7)
    gone = {f.parent.parent.name for f in before if not f.exists()}
    assert len(gone) <= 1
