"""Streaming twins of batch queries over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..streaming import live
from .bind import query, table

#: Files of one day lie side by side in the log, so a row is at most a day behind those read before it.
_LATE = "1 day"


def _log(spark, d):
    """The events as a folder that a stream can watch: day after day, then a row without key whose time closes all windows. Days are
    put apart first, so that none of them is looked for among all events."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    dated = events.filter("ts IS NOT NULL").withColumn("_day", F.to_date("ts"))
    dated.write.partitionBy("_day").parquet(f"{base}/days")
    for (k,) in dated.select("_day").distinct().orderBy("_day").collect():
        spark.read.schema(events.schema).parquet(f"{base}/days/_day={k}").write.mode("append").parquet(f"{base}/in")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
    end.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema)).write.mode("append").parquet(f"{base}/in")
    return live.read_log(spark, f"{base}/in", events.schema), base


def _inventory(spark, d):
    log, base = _log(spark, d)
    out = live.run_available(live.live_inventory(log, ts="ts", kind="event_type", late=_LATE), f"{base}/out", f"{base}/state")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _sessions(spark, d):
    log, base = _log(spark, d)
    return live.run_available(live.live_sessions(log, key="user_id", ts="ts", late=_LATE), f"{base}/out", f"{base}/state")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_inventory(spark, d):
    return _inventory(spark, d)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_inventory_all(spark, d):
    return _inventory(spark, d)


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 43200000000 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n_events FROM s GROUP BY user_id, no""")
def stream_sessions(spark, d):
    """Every session as the stream closed it."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _sessions(spark, d).select("user_id", stamp("session_start").alias("first"), stamp(F.col("session_end") - F.expr("INTERVAL 12 HOURS")).alias("last"), F.col("n").alias("n_events"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 43200000000 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g), f AS (SELECT user_id, no, count(*) AS n FROM s GROUP BY 1, 2)
  SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events FROM f GROUP BY 1""")
def stream_sessions_all(spark, d):
    return _sessions(spark, d).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("""WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view')),
  f AS (SELECT user_id, ts, k, ts AS kept, true AS keep FROM o WHERE k = 1
    UNION ALL SELECT o.user_id, o.ts, o.k, CASE WHEN o.ts - f.kept >= INTERVAL 6 HOUR THEN o.ts ELSE f.kept END, o.ts - f.kept >= INTERVAL 6 HOUR
    FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
  SELECT user_id, epoch_us(ts) AS t_us FROM f WHERE keep AND NOT EXISTS (
    SELECT 1 FROM events x WHERE x.user_id = f.user_id AND x.event_type = 'purchase' AND x.ts BETWEEN f.ts AND f.ts + INTERVAL 6 HOUR)""")
def stream_waits(spark, d):
    """Views that no purchase answers within six hours, by timers over the days of the log."""
    log, base = _log(spark, d)
    with live.state_store(spark):
        waits = live.live_waits(log, key="user_id", ts="ts", kind="event_type", trigger="view", request="purchase", min_gap_s=21_600, lookahead_s=21_600, late=_LATE)
        out = live.run_available(waits, f"{base}/out", f"{base}/state")
    return out.select(F.col("key").alias("user_id"), F.col("t").alias("t_us"))
