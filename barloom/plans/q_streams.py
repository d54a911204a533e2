"""Queries that drive the streaming operators over the landed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.plans.catalog import query, r6
from barloom.plans.q_market import MIN
from barloom.streaming import streams


def ticks(spark, sf, key="event_type"):
    e = streams.read_ticks(spark, sf, "events.parquet")
    return e.select(F.col(key).cast("string").alias("symbol"), "ts", "event_id", F.round(10 + F.col("value") / 100, 4).alias("price"),
                    (100 + F.col("event_id") % 50).alias("volume"))


DONE = "WHERE ts + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("stream_bars_5m", f"WITH {MIN} " + r6(f"SELECT symbol, ts, open, high, low, close, volume FROM mb {DONE}", "open high low close"))
def _(spark, sf):
    p = streams.run_to_table(streams.stream_bars_5m(ticks(spark, sf)), "bars5m")
    return spark.read.parquet(p).drop("bar_end")


@query("stream_latest", "SELECT CAST(user_id AS VARCHAR) AS symbol, max((ts, event_id)).event_id AS event_id FROM (SELECT user_id, ts, event_id FROM events) GROUP BY 1"
       .replace("max((ts, event_id)).event_id", "arg_max(event_id, (ts, event_id))"))
def _(spark, sf):
    p = streams.run_to_table(streams.stream_latest(ticks(spark, sf, "user_id")), "latest", "complete")
    return spark.read.parquet(p).select("symbol", "event_id")


@query("stream_exit_alerts", f"""WITH {MIN}, b AS (SELECT * FROM mb {DONE}), x AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM b)
  SELECT symbol, ts, close FROM x WHERE close < 10.3 AND pc < 10.3""")
def _(spark, sf):
    stops = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.lit(10.3).alias("stop")).distinct()
    p = streams.run_to_table(streams.stream_exit_alerts(streams.stream_bars_5m(ticks(spark, sf)), stops), "alerts")
    return spark.read.parquet(p).select("symbol", "ts", "close")


@query("stream_ingest", """SELECT event_id, user_id, 'stored' AS state FROM events WHERE event_id % 50 > 0 UNION ALL
  SELECT event_id, user_id, '交易ID缺失' FROM events, range(2) WHERE event_id % 50 = 0""")
def _(spark, sf):
    e = streams.read_ticks(spark, sf, "events.parquet").select("event_id", "user_id", "ts")
    twice = e.unionByName(streams.read_ticks(spark, sf, "events.parquet").select("event_id", "user_id", "ts"))
    rows = twice.withColumn("txn_id", F.when(F.col("event_id") % 50 > 0, F.sha2(F.concat_ws("|", "event_id", "user_id", "ts"), 256)))
    path = streams.stream_ingest(rows)
    rejects = spark.read.parquet(path.removesuffix("table") + "rejects")
    return (spark.read.parquet(path).select("event_id", "user_id", F.lit("stored").alias("state"))
            .unionByName(rejects.select("event_id", "user_id", F.col("reject_reason").alias("state"))))


@query("stream_late_data", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%H:%M') BETWEEN '14:32' AND '14:55' AS on_time FROM events")
def _(spark, sf):
    e = streams.read_ticks(spark, sf, "events.parquet").select("event_id", "ts")
    on, late = streams.late_data_rule(e, "14:32", "14:55")
    a = spark.read.parquet(streams.run_to_table(on, "ontime")).select("event_id", F.lit(True).alias("on_time"))
    return a.unionByName(spark.read.parquet(streams.run_to_table(late, "late")).select("event_id", F.lit(False).alias("on_time")))


@query("stream_breadth", """WITH l AS (SELECT user_id, arg_max(round(10 + value/100, 4), (ts, event_id)) AS p FROM events GROUP BY 1), f AS (SELECT user_id, arg_min(round(10 + value/100, 4), (ts, event_id)) AS q FROM events GROUP BY 1)
  SELECT 'all' AS scope, count(*) AS valid, count_if(p > q) AS up, count_if(p < q) AS down, count_if(p = q) AS flat FROM l JOIN f USING (user_id)""")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    prev = e.groupBy(F.col("user_id").cast("string").alias("symbol")).agg(
        F.min_by(F.round(10 + F.col("value") / 100, 4), F.struct("ts", "event_id")).alias("price"))
    return spark.read.parquet(streams.stream_breadth(ticks(spark, sf, "user_id"), prev))
