"""As-of look-ups, windows, sessions, chains and range joins over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, chains, decisions, joins, windows
from .bind import RUNS, TL, events, micros, purchases, query, r6, timeline

DAY, HALF_DAY = 86_400, 43_200
KW = dict(keys=["user_id"], probe_ts="ts", event_ts="ts")

_SHARE = RUNS + """,
e0 AS (SELECT p.*, coalesce(in1 + CASE WHEN st = 1 THEN epoch_us(p.ts) - epoch_us(r.ts) ELSE 0 END, 0) AS i0, coalesce(ch, 0) AS c0
  FROM p ASOF LEFT JOIN run r ON p.user_id = r.user_id AND p.ts >= r.ts),
q AS (SELECT p.event_id, p.user_id, w, p.ts - to_seconds(w) AS t FROM p, (VALUES (21600), (86400), (259200)) AS g(w)),
e1 AS (SELECT q.event_id, q.w, coalesce(in1 + CASE WHEN st = 1 THEN epoch_us(q.t) - epoch_us(r.ts) ELSE 0 END, 0) AS i1, coalesce(ch, 0) AS c1
  FROM q ASOF LEFT JOIN run r ON q.user_id = r.user_id AND q.t >= r.ts),
s AS (SELECT e0.event_id, e0.ts, e1.w, (i0 - i1) / 1e6 / w AS share, c0 - c1 AS changes FROM e0 JOIN e1 USING (event_id))"""


def _stats(spark, d, spans):
    return windows.window_stats(
        purchases(spark, d), timeline(spark, d), key="user_id", probe_id="event_id", probe_ts="ts", event_ts="ts", state="st", windows_s=spans
    )


@query(f"WITH {_SHARE} SELECT isodow(ts)::INTEGER AS weekday, count(*) AS n, round(avg(share), 6) AS avg_share FROM s WHERE w = 86400 GROUP BY 1")
def w1_state_share_by_weekday(spark, d):
    day = (F.weekday("ts") + 1).alias("weekday")
    return _stats(spark, d, [DAY]).groupBy(day).agg(F.count("*").alias("n"), r6(F.avg(f"share_{DAY}"), "avg_share"))


@query(f"""WITH {_SHARE} SELECT event_id,
  round(max(share) FILTER (w = 21600), 6) AS share_6h, round(max(share) FILTER (w = 86400), 6) AS share_24h, round(max(share) FILTER (w = 259200), 6) AS share_72h,
  (max(changes) FILTER (w = 21600))::BIGINT AS changes_6h, (max(changes) FILTER (w = 86400))::BIGINT AS changes_24h, (max(changes) FILTER (w = 259200))::BIGINT AS changes_72h
  FROM s GROUP BY event_id""")
def w1_window_stats(spark, d):
    s = _stats(spark, d, [21600, 86400, 259200])
    names = ((21600, "6h"), (86400, "24h"), (259200, "72h"))
    return s.select("event_id", *(r6(f"share_{w}", f"share_{n}") for w, n in names), *(F.col(f"changes_{w}").alias(f"changes_{n}") for w, n in names))


@query(f"WITH {TL} SELECT p.event_id, coalesce(tl.st, 0) AS state FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts")
def j1_state_as_of(spark, d):
    return asof.state_at(purchases(spark, d), timeline(spark, d), key="user_id", probe_ts="ts", event_ts="ts", state="st", default=0).select("event_id", "state")


@query(f"""WITH {TL} SELECT p.event_id, coalesce(tl.st, 0) AS state, f.event_type AS next_kind FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts
  JOIN (SELECT p.event_id, tl.event_type FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts < tl.ts) f USING (event_id)""")
def j1_state_as_of_in_bins(spark, d):
    """For keys that hold a large part of all rows."""
    kw = dict(keys=["user_id"], probe_ts="ts", event_ts="ts", bin_s=HALF_DAY)
    back = asof.as_of(purchases(spark, d), timeline(spark, d), values={"state": "st"}, **kw).fillna({"state": 0})
    both = asof.as_of(back, timeline(spark, d), values={"next_kind": "event_type"}, forward=True, inclusive=False, **kw)
    return both.select("event_id", "state", "next_kind")


@query(f"""WITH {TL} SELECT p.event_id, CASE WHEN tl.st = 1 AND tl.event_type <> 'click' THEN tl.event_type END AS occupier
  FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts""")
def j2_occupier_as_of(spark, d):
    out = asof.occupier_at(purchases(spark, d), timeline(spark, d), key="user_id", probe_ts="ts", event_ts="ts", state="st", train="event_type", placeholders=["click"])
    return out.select("event_id", "occupier")


@query(f"""WITH {TL} SELECT p.event_id, tl.event_type AS kind, round((epoch_us(p.ts) - epoch_us(tl.ts)) / 1e6, 6) AS age_s
  FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts""")
def j3_occupant_and_age(spark, d):
    out = asof.value_and_age(purchases(spark, d), timeline(spark, d), value=F.col("event_type"), **KW)
    return out.select("event_id", F.col("value_at").alias("kind"), r6("age_s", "age_s"))


@query(f"""WITH {TL}, l AS (SELECT p.event_id, tl.event_type, max(tl.ts) AS seen FROM p JOIN tl ON p.user_id = tl.user_id AND tl.ts < p.ts GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seen DESC, event_type) AS k FROM l)
  SELECT p.event_id, string_agg(event_type, '>' ORDER BY k) AS recent FROM p LEFT JOIN r ON p.event_id = r.event_id AND k <= 2 GROUP BY p.event_id""")
def j4_last_distinct(spark, d):
    out = asof.last_distinct(
        purchases(spark, d), timeline(spark, d), keys=["user_id"], probe_ts="ts", event_ts="ts", element="event_type", n=2
    )
    return out.select("event_id", F.when(F.col("recent").isNotNull(), F.array_join("recent", ">")).alias("recent"))


@query("""WITH q AS (SELECT event_id, ts FROM events WHERE event_type = 'error'), l AS (SELECT q.event_id, e.user_id, max(e.ts) AS seen FROM q JOIN events e ON e.event_type = 'view' AND e.ts < q.ts AND e.ts >= q.ts - INTERVAL 3 DAY GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seen DESC, user_id) AS k FROM l)
  SELECT q.event_id, coalesce(string_agg(user_id::VARCHAR, '>' ORDER BY k), '') AS recent FROM q LEFT JOIN r ON q.event_id = r.event_id AND k <= 3 GROUP BY 1""")
def j4_last_distinct_dense(spark, d):
    """The last three users that viewed anything: one key with all views, in bins of six hours. Three users view within three days."""
    one = F.lit(1).alias("one")
    views = events(spark, d, "view").select(one, "ts", F.col("user_id").alias("viewer"))
    probes = events(spark, d, "error").select(one, "event_id", F.col("ts").alias("t"))
    out = asof.last_distinct(probes, views, keys=["one"], probe_ts="t", event_ts="ts", element="viewer", n=3, bin_s=21_600)
    return out.select("event_id", F.coalesce(F.array_join(F.transform("recent", lambda x: x.cast("string")), ">"), F.lit("")).alias("recent"))


@query(f"""WITH {TL}, h AS (SELECT p.event_id, (epoch_us(p.ts) - epoch_us(tl.ts)) / 1e6 AS lead FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts > tl.ts)
  SELECT count(*) AS n, count(*) FILTER (lead IS NULL) AS n_none, round(avg(lead), 6) AS avg_lead FROM h""")
def j5_strict_as_of(spark, d):
    out = asof.value_and_age(purchases(spark, d), timeline(spark, d), value=F.col("st"), inclusive=False, **KW)
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("age_s").isNull()).alias("n_none"), r6(F.avg("age_s"), "avg_lead"))


@query(f"""WITH {TL}, h AS (SELECT p.event_id, (epoch_us(tl.ts) - epoch_us(p.ts)) / 1e6 AS lag FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts < tl.ts)
  SELECT event_id, CASE WHEN lag <= 43200 THEN round(lag, 6) END AS lag_s FROM h""")
def j6_forward_as_of(spark, d):
    return asof.next_lag(purchases(spark, d), timeline(spark, d), most_s=HALF_DAY, **KW).select("event_id", r6("lag_s", "lag_s"))


@query(f"""WITH {TL}, v AS (SELECT user_id, ts, value FROM tl WHERE event_type = 'error'),
  a AS (SELECT p.event_id, p.user_id, p.ts, v.value AS nxt FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts)
  SELECT a.event_id, round(coalesce(nxt, v.value), 6) AS value_at FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.ts >= v.ts""")
def j11_next_else_previous(spark, d):
    errors = events(spark, d, "error").select("user_id", "ts", "value")
    return asof.next_else_previous(purchases(spark, d), errors, value=F.col("value"), **KW).select("event_id", r6("value_at", "value_at"))


@query(f"""WITH {TL} SELECT p.event_id, round(coalesce(CASE WHEN epoch_us(p.ts) - epoch_us(tl.ts) <= 21600000000 THEN tl.value END, 0), 6) AS value_at
  FROM p ASOF LEFT JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts""")
def j12_fresh_value(spark, d):
    out = asof.fresh_value(purchases(spark, d).drop("value"), timeline(spark, d), value=F.col("value"), most_age_s=21600, **KW)
    return out.select("event_id", r6("value_at", "value_at"))


@query(f"""WITH {TL} SELECT p.event_id, count(tl.ts) AS n_in_window FROM p LEFT JOIN tl
  ON p.user_id = tl.user_id AND tl.ts <= p.ts AND tl.ts > p.ts - INTERVAL 24 HOUR GROUP BY 1""")
def j15_recent_count(spark, d):
    return asof.count_in_window(purchases(spark, d), timeline(spark, d), window_s=DAY, **KW).select("event_id", "n_in_window")


_NEAR = "(SELECT count(*) FROM events x WHERE x.ts BETWEEN e.ts - INTERVAL {0} MINUTE AND e.ts + INTERVAL {0} MINUTE) - 1"


@query(f"SELECT e.event_id, {_NEAR.format(60)} AS n_near FROM events e")
def j16_neighbours(spark, d):
    return windows.neighbours_within(events(spark, d), ts="ts", span_s=3600).select("event_id", "n_near")


@query("""SELECT a.event_id, count(b.event_id) - 1 AS n_near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 60 HOUR AND a.ts + INTERVAL 60 HOUR GROUP BY 1""")
def j16_neighbours_of_days(spark, d):
    """A span of two and a half days, among the user's own events."""
    return windows.neighbours_within(events(spark, d), ts="ts", span_s=216_000, keys=["user_id"]).select("event_id", "n_near")


@query(f"""SELECT CASE WHEN n = 0 THEN 'alone' WHEN n < 3 THEN 'small_burst' WHEN n < 10 THEN 'burst_3_to_9' ELSE 'burst_10plus' END AS class, count(*) AS n
  FROM (SELECT {_NEAR.format(5)} AS n FROM events e) GROUP BY 1""")
def j16_burst_classes(spark, d):
    out = windows.neighbours_within(events(spark, d), ts="ts", span_s=300)
    return out.groupBy(windows.burst_class(F.col("n_near")).alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {TL}, d AS (SELECT user_id, ts::DATE AS day, ts, event_type FROM tl),
  q AS (SELECT event_id, user_id, ts::DATE AS day, ts FROM p)
  SELECT q.event_id, d.event_type AS kind FROM q ASOF LEFT JOIN d ON q.user_id = d.user_id AND q.day = d.day AND q.ts >= d.ts""")
def j17_same_day_as_of(spark, d):
    day = F.to_date("ts")
    out = asof.as_of(
        purchases(spark, d).withColumn("day", day), timeline(spark, d).withColumn("day", day), keys=["user_id", "day"],
        probe_ts="ts", event_ts="ts", values={"kind": F.col("event_type")},
    )
    return out.select("event_id", "kind")


_SESS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS nw,
  CASE WHEN lag(ts) OVER w < TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS cut
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER w AS session_no, sum(greatest(nw, cut)) OVER w AS hard_no FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def _sessions(spark, d, **kw):
    return windows.sessions(events(spark, d), keys=["user_id"], ts="ts", gap_s=HALF_DAY, tie=["event_id"], **kw)


@query(f"WITH {_SESS} SELECT event_id, user_id || ':' || session_no AS session_id FROM s")
def w3_sessions(spark, d):
    return _sessions(spark, d).select("event_id", F.concat_ws(":", "user_id", "session_no").alias("session_id"))


@query(f"WITH {_SESS} SELECT event_id, user_id || ':' || hard_no AS session_id FROM s")
def w4_sessions_in_bins(spark, d):
    """For keys that hold a large part of all rows."""
    return _sessions(spark, d, boundaries=["2024-01-15"], bin_s=DAY).select("event_id", F.concat_ws(":", "user_id", "session_no").alias("session_id"))


@query(f"WITH {_SESS} SELECT user_id, count(DISTINCT hard_no) AS n_sessions FROM s GROUP BY 1")
def w4_bounded_sessions(spark, d):
    return _sessions(spark, d, boundaries=["2024-01-15"]).groupBy("user_id").agg(F.count_distinct("session_no").alias("n_sessions"))


@query("""WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events)
  SELECT CASE WHEN gap <= 3600 THEN 0 WHEN gap <= 21600 THEN 1 WHEN gap <= 86400 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def w5_gap_buckets(spark, d):
    return windows.gap_buckets(events(spark, d), keys=["user_id"], ts="ts", edges_s=[3600, 21600, 86400])


@query("""WITH x AS (SELECT g AS gap_s, user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, CASE WHEN gap > g THEN 1 ELSE 0 END AS nw,
      CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS side
    FROM events, (VALUES (7200), (43200), (86400)) AS t(g) WINDOW w AS (PARTITION BY g, user_id ORDER BY ts)),
  y AS (SELECT *, sum(nw) OVER (PARTITION BY gap_s, user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM x),
  z AS (SELECT gap_s, user_id, no, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span, count(*) AS n, sum(nw) AS cut, count(*) FILTER (side <> first_side) AS leak
    FROM (SELECT *, min(side) OVER (PARTITION BY gap_s, user_id, no) AS first_side FROM y) GROUP BY 1, 2, 3)
  SELECT gap_s, count(*) AS n_sessions, round(quantile_cont(span, 0.5), 6) AS median_span_s, round(quantile_cont(span, 0.99), 4) AS p99_span_s, round(max(span), 6) AS max_span_s,
    round(avg(CASE WHEN span > 86400 THEN 1.0 ELSE 0.0 END), 6) AS share_over_day, round(sum(CASE WHEN span > 86400 THEN n ELSE 0 END) / sum(n), 6) AS share_rows_over_day,
    sum(cut)::BIGINT AS n_cut, sum(leak)::BIGINT AS n_leaking FROM z GROUP BY 1""")
def w5_gap_sweep(spark, d):
    """One sort of the log for all gaps; two boundary times."""
    forest = windows.gap_forest(events(spark, d), keys=["user_id"], ts="ts", gaps_s=[7200, 43200, 86400], boundaries=["2024-01-12", "2024-01-20"])
    s = windows.gap_sweep(forest)
    rounded = (r6(c, c) for c in ("median_span_s", "max_span_s", "share_over_day", "share_rows_over_day"))
    return s.select("gap_s", "n_sessions", *rounded, F.round("p99_span_s", 4).alias("p99_span_s"), "n_cut", "n_leaking")


_THROTTLED = """WITH RECURSIVE o AS (SELECT event_id, {key} AS key, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS k FROM {log}),
  f AS (SELECT event_id, key, ts, k, ts AS kept, true AS keep FROM o WHERE k = 1
    UNION ALL SELECT o.event_id, o.key, o.ts, o.k, CASE WHEN o.ts - f.kept >= INTERVAL {gap} THEN o.ts ELSE f.kept END, o.ts - f.kept >= INTERVAL {gap}
    FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
  SELECT event_id, key AS {name} FROM f WHERE keep"""


@query(_THROTTLED.format(key="user_id", name="user_id", log="events", gap="12 HOUR"))
def w6_throttle(spark, d):
    return windows.throttle(events(spark, d), keys=["user_id"], ts="ts", min_gap_s=HALF_DAY, tie=["event_id"]).select("event_id", "user_id")


@query(_THROTTLED.format(key="event_type", name="event_type", log="(SELECT event_id, event_type, CASE WHEN event_id % 50 > 0 THEN ts END AS ts FROM events) WHERE ts IS NOT NULL", gap="30 MINUTE"))
def w6_throttle_dense(spark, d):
    """Five keys that hold all events, whose gaps seldom restart the rule; every fiftieth event has no time."""
    rows = events(spark, d).withColumn("ts", F.when(F.col("event_id") % 50 > 0, F.col("ts")))
    return windows.throttle(rows, keys=["event_type"], ts="ts", min_gap_s=1800, tie=["event_id"]).select("event_id", "event_type")


_ONE = "ev AS (SELECT event_id, user_id, ts, event_type, value, CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END AS st FROM events)"


def _states(spark, d):
    return events(spark, d).withColumn("st", F.col("event_type").isin("view", "click").cast("int"))


@query(f"""WITH {_ONE}, q AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'error'),
  a AS (SELECT q.event_id, q.user_id, q.ts, (SELECT min(ts) FROM ev WHERE ev.user_id = q.user_id AND st = 1 AND ev.ts >= q.ts) AS t1 FROM q),
  b AS (SELECT *, (SELECT min(ts) FROM ev WHERE ev.user_id = a.user_id AND st = 0 AND ev.ts > a.t1) AS t2 FROM a),
  c AS (SELECT *, (SELECT min(ts) FROM ev WHERE ev.user_id = b.user_id AND st = 1 AND ev.ts > b.t2) AS t3 FROM b)
  SELECT event_id, CASE WHEN t3 > t2 THEN round((epoch_us(t3) - epoch_us(t2)) / 1e6, 6) END AS headway_s FROM c""")
def w7_next_headway(spark, d):
    probes = events(spark, d, "error").select("event_id", "user_id", "ts")
    out = chains.next_headway(probes, _states(spark, d), key="user_id", probe_ts="ts", event_ts="ts", state="st")
    return out.select("event_id", r6("headway_s", "headway_s"))


@query(f"""WITH {_ONE}, q AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'purchase'),
  a AS (SELECT q.*, (SELECT min(ts) FROM ev WHERE ev.user_id = q.user_id AND event_type = 'signup' AND ev.ts >= q.ts) AS rel FROM q),
  b AS (SELECT a.*, CASE WHEN rel IS NOT NULL THEN (SELECT count(*) FROM ev WHERE ev.user_id = a.user_id AND event_type = 'error' AND ev.ts BETWEEN a.ts AND a.rel) END AS n_used FROM a)
  SELECT event_id, coalesce(n_used, -1) AS n_used, CASE WHEN rel IS NULL THEN 'unknown' WHEN n_used > 0 THEN 'used'
    WHEN epoch_us(rel) - epoch_us(ts) < 21600000000 THEN 'unused_cancelled' ELSE 'unused_timeout' END AS outcome FROM b""")
def w8_lifecycle(spark, d):
    out = chains.lifecycle(
        purchases(spark, d), events(spark, d, "signup"), events(spark, d, "error"), key="user_id", probe_ts="ts", event_ts="ts", cancel_s=21600
    )
    return out.select("event_id", F.coalesce("n_used", F.lit(-1)).alias("n_used"), "outcome")


@query(f"""WITH {_ONE}, q AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'purchase'),
  a AS (SELECT q.*, (epoch_us((SELECT min(ts) FROM ev WHERE ev.user_id = q.user_id AND event_type = 'view' AND ev.ts >= q.ts)) - epoch_us(q.ts)) / 1e6 AS lead FROM q)
  SELECT CASE WHEN lead IS NULL THEN -1 WHEN lead <= 3600 THEN 0 WHEN lead <= 21600 THEN 1 WHEN lead <= 86400 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM a GROUP BY 1""")
def w9_lead_buckets(spark, d):
    from ..functions.parse import bucket

    out = chains.lead_time(purchases(spark, d), events(spark, d, "view"), key="user_id", probe_ts="ts", event_ts="ts")
    return out.groupBy(bucket(F.col("lead_s"), [3600, 21600, 86400]).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ONE}, c AS (SELECT user_id, ts, st FROM (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM ev) WHERE was IS NULL OR was <> st),
  g AS (SELECT user_id, CASE WHEN st = 1 AND lag(st) OVER w = 0 THEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 END AS gap_s FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  SELECT user_id, count(*) AS n, round(quantile_cont(gap_s, 0.05), 6) AS p5, round(quantile_cont(gap_s, 0.5), 6) AS p50 FROM g WHERE gap_s > 0 GROUP BY 1""")
def w10_clear_gaps(spark, d):
    q = chains.quantiles_by(chains.clear_gaps(_states(spark, d), key="user_id", ts="ts", state="st"), ["user_id"], "gap_s", [0.05, 0.5])
    return q.select("user_id", "n", r6("p5", "p5"), r6("p50", "p50"))


@query(f"""WITH {_ONE}, o AS (SELECT user_id % 10 AS k, user_id, ts FROM ev WHERE st = 1),
  h AS (SELECT k, CASE WHEN lag(user_id) OVER w <> user_id THEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 END AS h FROM o WINDOW w AS (PARTITION BY k ORDER BY ts))
  SELECT k, count(*) AS n, round(quantile_cont(h, 0.5), 6) AS p50 FROM h WHERE h > 0 AND h < 86400 GROUP BY 1""")
def w11_onset_headways(spark, d):
    rows = _states(spark, d).withColumn("k", F.col("user_id") % 10)
    q = chains.quantiles_by(chains.onset_headways(rows, key="k", ts="ts", state="st", train="user_id", most_s=DAY), ["k"], "headway_s", [0.5])
    return q.select("k", "n", r6("p50", "p50"))


@query(f"""WITH {_ONE}, h AS (SELECT user_id, (epoch_us((SELECT min(ts) FROM ev y WHERE y.user_id = x.user_id AND y.st = 0 AND y.ts > x.ts)) - epoch_us(x.ts)) / 1e6 AS d FROM ev x WHERE st = 1)
  SELECT user_id, count(*) AS n, round(avg(d) + 1e-7, 4) AS avg_s FROM h WHERE d < 86400 GROUP BY 1""")
def w11_durations(spark, d):
    rows = chains.durations(_states(spark, d), key="user_id", ts="ts", state="st", most_s=DAY)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("duration_s") + 1e-7, 4).alias("avg_s"))


@query("""WITH s AS (SELECT user_id, ts::DATE AS day, (epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view'))) / 1e6 AS dwell FROM events GROUP BY 1, 2)
  SELECT user_id, day::VARCHAR AS day, round(dwell, 6) AS dwell_s FROM s WHERE dwell BETWEEN 0 AND 86400""")
def w11_dwell(spark, d):
    rows = events(spark, d).withColumn("day", F.to_date("ts"))
    out = chains.dwell(rows, keys=["user_id", "day"], ts="ts", kind="event_type", arrival="view", departure="purchase", most_s=DAY)
    return out.select("user_id", F.col("day").cast("string").alias("day"), r6("dwell_s", "dwell_s"))


@query("""WITH s AS (SELECT user_id, event_id % 7 + 1 AS platform, (user_id % 10)::VARCHAR AS cls, (epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view'))) / 1e6 AS dwell FROM events GROUP BY 1, 2)
  SELECT platform, cls, count(*) AS n, round(quantile_cont(dwell, 0.05), 4) AS p5, round(quantile_cont(dwell, 0.5), 4) AS p50, round(quantile_cont(dwell, 0.95), 4) AS p95 FROM s WHERE dwell BETWEEN 0 AND 864000 GROUP BY 1, 2""")
def w11_dwell_by_class(spark, d):
    rows = events(spark, d).withColumn("platform", F.col("event_id") % 7 + 1)
    out = chains.dwell_by_class(rows, train="user_id", platform="platform", cls=(F.col("user_id") % 10).cast("string"), ts="ts", kind="event_type", arrival="view", departure="purchase", at=[0.05, 0.5, 0.95], most_s=864_000)
    return out.select("platform", "cls", "n", *(F.round(c, 4).alias(c) for c in ("p5", "p50", "p95")))


@query("""SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_type) AS path FROM events
  WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1 HAVING count(*) >= 2""")
def w12_ordered_paths(spark, d):
    inside = events(spark, d).filter("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'")
    out = chains.ordered_paths(inside, keys=["user_id"], ts="ts", element="event_type")
    return out.select("user_id", F.array_join("path", ">").alias("path"))


@query(f"""WITH {_SESS}, f AS (SELECT user_id, session_no, min(ts) AS start FROM s GROUP BY 1, 2),
  i AS (SELECT *, row_number() OVER (ORDER BY start, user_id, session_no) - 1 AS session_idx FROM f)
  SELECT event_id, session_idx, (row_number() OVER w - 1)::INTEGER AS position, row_number() OVER w = count(*) OVER (PARTITION BY s.user_id, s.session_no) AS is_last
  FROM s JOIN i USING (user_id, session_no) WINDOW w AS (PARTITION BY s.user_id, s.session_no ORDER BY ts, event_id)""")
def w13_session_index(spark, d):
    s = _sessions(spark, d)
    idx = windows.session_index(s, session=["user_id", "session_no"], start="ts")
    placed = windows.positions(s, session=["user_id", "session_no"], order=["ts", "event_id"])
    return placed.join(idx, ["user_id", "session_no"]).select("event_id", "session_idx", "position", "is_last")


@query(f"""WITH {_SESS} SELECT event_id, coalesce(lead(event_id) OVER w, event_id) AS next_event_id, lead(event_id) OVER w IS NULL AS done
  FROM s WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, event_id)""")
def w14_transitions(spark, d):
    out = windows.transitions(_sessions(spark, d), session=["user_id", "session_no"], order=["ts", "event_id"], columns=["event_id"])
    return out.select("event_id", "next_event_id", "done")


def _positioned(spark, d):
    return windows.positions(_sessions(spark, d), session=["user_id", "session_no"], order=["ts", "event_id"])


_POS = _SESS + ", q AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) - 1 AS k FROM s)"


@query(f"WITH {_POS} SELECT user_id, session_no::BIGINT AS session_no, round(sum(pow(0.95, k) * value) + 1e-9, 4) AS episode_return FROM q GROUP BY 1, 2")
def w15_episode_return(spark, d):
    out = windows.discounted_return(_positioned(spark, d), session=["user_id", "session_no"], position="position", reward="value", gamma=0.95)
    return out.select("user_id", "session_no", F.round(F.col("episode_return") + 1e-9, 4).alias("episode_return"))


@query(f"""WITH {_POS} SELECT a.event_id, round(sum(pow(0.95, b.k - a.k) * b.value) + 1e-9, 4) AS to_go
  FROM q a JOIN q b ON a.user_id = b.user_id AND a.session_no = b.session_no AND b.k >= a.k GROUP BY a.event_id""")
def w15_return_to_go(spark, d):
    rows = _positioned(spark, d)
    out = windows.return_to_go(rows, session=["user_id", "session_no"], position="position", reward="value", gamma=0.95)
    return rows.join(out, ["user_id", "session_no", "position"]).select("event_id", F.round(F.col("to_go") + 1e-9, 4).alias("to_go"))


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events)
  SELECT a.event_id, round(sum(pow(0.9, b.k - a.k) * b.value) + 1e-9, 4) AS to_go FROM q a JOIN q b ON a.event_type = b.event_type AND b.k BETWEEN a.k AND a.k + 300 GROUP BY 1""")
def w15_return_to_go_long(spark, d):
    """Five long sessions, in bins of 128 positions; terms over 300 rows ahead are below the rounding."""
    rows = windows.positions(events(spark, d), session=["event_type"], order=["ts", "event_id"])
    out = windows.return_to_go(rows, session=["event_type"], position="position", reward="value", gamma=0.9, bin_rows=128)
    return rows.join(out, ["event_type", "position"]).select("event_id", F.round(F.col("to_go") + 1e-9, 4).alias("to_go"))


@query(f"""WITH {_POS}, moved AS (SELECT user_id, session_no, ts, event_id, CASE WHEN event_id % 97 = 0 THEN k + 1 ELSE k END AS k, CASE WHEN event_id % 89 = 0 THEN ts - INTERVAL 20 HOUR ELSE ts END AS t FROM q),
  pairs AS (SELECT k, t, lag(k) OVER w AS pk, lag(t) OVER w AS pt FROM moved WINDOW w AS (PARTITION BY user_id, session_no ORDER BY k, t))
  SELECT count(*) FILTER (pk IS NULL AND k <> 0) AS bad_start, count(*) FILTER (k - pk <> 1) AS bad_step, count(*) FILTER (t < pt) AS bad_time, count(*) FILTER (k = pk) AS repeated FROM pairs""")
def w16_order_checks(spark, d):
    """Sessions with planted faults: places moved and times set back."""
    rows = _positioned(spark, d).withColumn("position", F.when(F.col("event_id") % 97 == 0, F.col("position") + 1).otherwise(F.col("position")))
    rows = rows.withColumn("ts", F.when(F.col("event_id") % 89 == 0, F.col("ts") - F.expr("INTERVAL 20 HOURS")).otherwise(F.col("ts")))
    return windows.order_faults(rows, session=["user_id", "session_no"], position="position", ts="ts")


@query(f"""WITH {_SESS} SELECT event_id, coalesce(string_agg(event_type, '>') OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM s""")
def w17_prior_values(spark, d):
    """Every row's history, cut from its session's one list."""
    by = dict(session=["user_id", "session_no"], order=["ts", "event_id"])
    rows = _sessions(spark, d)
    lists = windows.value_lists(rows, value="event_type", **by)
    out = windows.prior_counts(rows, **by).join(lists, by["session"])
    return out.select("event_id", F.array_join(F.slice("values", F.lit(1), F.col("n_prior")), ">").alias("prior"))


@query(f"""WITH {_SESS} SELECT event_id, coalesce(string_agg(event_type, '>') OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS prior FROM s""")
def w17_last_values(spark, d):
    out = windows.prior_values(_sessions(spark, d), session=["user_id", "session_no"], order=["ts", "event_id"], value="event_type", most=3)
    return out.select("event_id", F.array_join("prior", ">").alias("prior"))


_REPORTS = "rep AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'), q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"


@query(f"""WITH {_REPORTS}, a AS (SELECT q.*, rep.ts AS t0, rep.value AS v0 FROM q ASOF LEFT JOIN rep ON q.user_id = rep.user_id AND q.ts >= rep.ts),
  b AS (SELECT a.*, rep.ts AS t1, rep.value AS v1 FROM a ASOF LEFT JOIN rep ON a.user_id = rep.user_id AND a.ts < rep.ts),
  c AS (SELECT *, count(*) OVER (PARTITION BY user_id, t0, t1) AS n FROM b)
  SELECT event_id, n AS n_sharing, CASE WHEN epoch_us(ts) - epoch_us(t0) <= 86400000000 AND epoch_us(t1) - epoch_us(ts) <= 86400000000 THEN round((v1 - v0) / n, 6) END AS change FROM c""")
def j7_bracket_change(spark, d):
    reports = events(spark, d, "view").select("user_id", "ts", "value")
    probes = purchases(spark, d).drop("value")
    out = joins.bracket_changes(probes, reports, keys=["user_id"], probe_ts="ts", report_ts="ts", value="value", window_s=DAY)
    return out.select("event_id", "n_sharing", r6("change", "change"))


@query(f"""WITH {_REPORTS}, a AS (SELECT q.*, rep.ts AS t0 FROM q ASOF LEFT JOIN rep ON q.user_id = rep.user_id AND q.ts >= rep.ts),
  b AS (SELECT a.*, rep.ts AS t1 FROM a ASOF LEFT JOIN rep ON a.user_id = rep.user_id AND a.ts < rep.ts)
  SELECT CASE WHEN t0 IS NULL AND t1 IS NULL THEN 'no_report' WHEN t0 IS NULL THEN 'no_before' WHEN t1 IS NULL THEN 'no_after'
    WHEN epoch_us(ts) - epoch_us(t0) > 86400000000 THEN 'before_far' WHEN epoch_us(t1) - epoch_us(ts) > 86400000000 THEN 'after_far' ELSE 'ok' END AS reason, count(*) AS n
  FROM b GROUP BY 1""")
def j7b_bracket_faults(spark, d):
    reports = events(spark, d, "view").select("user_id", "ts", "value")
    out = joins.bracket_changes(purchases(spark, d).drop("value"), reports, keys=["user_id"], probe_ts="ts", report_ts="ts", value="value", window_s=DAY)
    return out.groupBy(joins.bracket_faults(out, probe_ts="ts", window_s=DAY).alias("reason")).agg(F.count("*").alias("n"))


_SPANS = _SESS + """, iv AS (SELECT user_id, session_no, min(ts) AS a, max(ts) AS b FROM s WHERE event_type <> 'error' GROUP BY 1, 2),
q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')"""


def _spans(spark, d):
    return joins.intervals(_sessions(spark, d).filter("event_type <> 'error'"), keys=["user_id", "session_no"], ts="ts")


@query(f"""WITH {_SPANS}, m AS (SELECT q.event_id, iv.session_no, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(epoch_us(q.ts) - (epoch_us(a) + epoch_us(b)) / 2.0), a, b, session_no) AS k
    FROM q JOIN iv ON q.user_id = iv.user_id AND q.ts BETWEEN iv.a - INTERVAL 30 MINUTE AND iv.b + INTERVAL 30 MINUTE)
  SELECT q.event_id, coalesce(m.session_no, -1)::BIGINT AS session_no FROM q LEFT JOIN m ON q.event_id = m.event_id AND m.k = 1""")
def j8_nearest_interval(spark, d):
    probes = events(spark, d, "error").select("event_id", "user_id", "ts")
    out = joins.interval_join(probes, _spans(spark, d), key="user_id", probe_id="event_id", probe_ts="ts", span_id=["session_no"], buffer_s=1800)
    return out.select("event_id", F.coalesce("session_no", F.lit(-1)).alias("session_no"))


@query(f"""WITH {_SPANS}, m AS (SELECT q.event_id, iv.session_no, row_number() OVER (PARTITION BY q.event_id ORDER BY a, b, session_no) AS k
    FROM q JOIN iv ON q.user_id = iv.user_id AND q.ts BETWEEN iv.a AND iv.b)
  SELECT q.event_id, coalesce(m.session_no, -1)::BIGINT AS session_no FROM q LEFT JOIN m ON q.event_id = m.event_id AND m.k = 1""")
def j8b_first_interval(spark, d):
    probes = events(spark, d, "error").select("event_id", "user_id", "ts")
    out = joins.interval_join(probes, _spans(spark, d), key="user_id", probe_id="event_id", probe_ts="ts", span_id=["session_no"], nearest=False)
    return out.select("event_id", F.coalesce("session_no", F.lit(-1)).alias("session_no"))


@query("""SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts BETWEEN e.ts AND e.ts + INTERVAL 6 HOUR)""")
def j9_no_follow_up(spark, d):
    out = joins.no_follow_up(events(spark, d, "view"), events(spark, d, "purchase"), keys=["user_id"], trigger_ts="ts", request_ts="ts", within_s=21600)
    return out.select("event_id")


@query("""WITH m AS (SELECT e.event_id, x.event_id AS other_id, row_number() OVER (PARTITION BY e.event_id ORDER BY x.ts, x.event_id) AS k
    FROM events e JOIN events x ON x.ts > e.ts AND x.ts <= e.ts + INTERVAL 15 MINUTE AND x.user_id <> e.user_id WHERE e.event_type = 'purchase')
  SELECT p.event_id, coalesce(string_agg(other_id::VARCHAR, ',' ORDER BY k), '') AS upcoming
  FROM (SELECT event_id FROM events WHERE event_type = 'purchase') p LEFT JOIN m ON p.event_id = m.event_id AND k <= 5 GROUP BY 1""")
def j10_upcoming(spark, d):
    schedule = events(spark, d).select(F.col("ts").alias("sts"), F.col("user_id").alias("other_user"), F.col("event_id").alias("other_id"))
    out = joins.upcoming(
        purchases(spark, d), schedule, probe_id="event_id", probe_ts="ts", schedule_ts="sts", exclude=("user_id", "other_user"),
        columns=["other_id"], ahead_s=900, k=5,
    )
    ids = F.transform("outlook", lambda s: s["other_id"].cast("string"))
    return out.select("event_id", F.coalesce(F.array_join(ids, ","), F.lit("")).alias("upcoming"))


@query("""WITH m AS (SELECT e.event_id, x.event_id AS other_id, row_number() OVER (PARTITION BY e.event_id ORDER BY x.ts DESC) AS k
    FROM events e JOIN events x ON x.user_id = e.user_id AND x.ts <= e.ts WHERE e.event_type = 'error')
  SELECT event_id, k AS rank, other_id FROM m WHERE k <= 16""")
def j14_last_events(spark, d):
    log = events(spark, d).select("user_id", "ts", F.col("event_id").alias("other_id"))
    out = joins.last_events(
        events(spark, d, "error").select("event_id", "user_id", "ts"), log, keys=["user_id"], probe_id="event_id", probe_ts="ts", event_ts="ts",
        columns=["other_id"], k=16,
    )
    return out.select("event_id", "rank", "other_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS sample_id, event_type, user_id, round(value, 4) AS value, length(props)::INTEGER AS n_props FROM events")
def d6_surrogate_key(spark, d):
    return decisions.surrogate_key(events(spark, d), ["ts", "event_id"]).select("event_id", "sample_id", "event_type", "user_id", F.round("value", 4).alias("value"), F.length("props").alias("n_props"))


@query("""WITH n AS (SELECT e.event_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts >= e.ts) AS nx, ts FROM events e WHERE event_type = 'view')
  SELECT t AS threshold_s, count(*) FILTER (nx IS NULL OR epoch_us(nx) - epoch_us(ts) > t * 1000000::BIGINT) AS n_kept FROM n, (VALUES (3600), (21600), (86400)) AS g(t) GROUP BY 1""")
def d4_lookahead_sweep(spark, d):
    return decisions.lookahead_sweep(
        events(spark, d, "view"), events(spark, d, "purchase"), keys=["user_id"], trigger_ts="ts", request_ts="ts", thresholds_s=[3600, 21600, 86400]
    )


@query("""SELECT user_id, epoch_us(min(ts) - INTERVAL 30 MINUTE) AS t_first, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS t_last, arg_min(event_type, ts) AS event_type FROM events GROUP BY 1""")
def d5_pass_intervals(spark, d):
    out = decisions.pass_intervals(events(spark, d), key="user_id", ts="ts", buffer_s=1800, columns=["event_type"])
    return out.select("user_id", micros("t_first", "t_first"), micros("t_last", "t_last"), "event_type")


@query("""WITH RECURSIVE occ AS (SELECT event_id, user_id::VARCHAR AS train, floor(value * 10)::BIGINT % 7 AS signal, ts FROM events WHERE event_type = 'view'),
  o AS (SELECT *, row_number() OVER (PARTITION BY train, signal ORDER BY ts, event_id) AS k FROM occ),
  f AS (SELECT train, signal, ts, k, ts AS kept, true AS keep FROM o WHERE k = 1
    UNION ALL SELECT o.train, o.signal, o.ts, o.k, CASE WHEN o.ts - f.kept >= INTERVAL 12 HOUR THEN o.ts ELSE f.kept END, o.ts - f.kept >= INTERVAL 12 HOUR
    FROM f JOIN o ON o.train = f.train AND o.signal = f.signal AND o.k = f.k + 1),
  req AS (SELECT user_id::VARCHAR AS train, floor(value * 10)::BIGINT % 7 AS signal, ts FROM events WHERE event_type = 'purchase'),
  w AS (SELECT f.train, f.signal, f.ts FROM f WHERE keep AND NOT EXISTS (SELECT 1 FROM req WHERE req.train = f.train AND req.signal = f.signal AND req.ts BETWEEN f.ts AND f.ts + INTERVAL 6 HOUR))
  SELECT label, count(*) AS n, count(DISTINCT focal_train) AS n_trains FROM (
    SELECT 'wait' AS label, train AS focal_train FROM w UNION ALL SELECT 'set', train FROM req) GROUP BY 1""")
def d3_decision_points(spark, d):
    keyed = events(spark, d).withColumns({"train": F.col("user_id").cast("string"), "signal": F.floor(F.col("value") * 10) % 7})
    occupied, asked = keyed.filter("event_type = 'view'"), keyed.filter("event_type = 'purchase'")
    approach = keyed.select("signal").distinct().select(F.col("signal").alias("element"), F.col("signal").alias("home"))
    sets = decisions.set_triggers(asked, train="train", signal="signal", ts="ts", route="event_type")
    waits = decisions.wait_triggers(
        occupied.withColumnRenamed("signal", "element"), approach, asked, train="train", element="element", ts="ts", signal="home",
        request_train="train", request_signal="signal", request_ts="ts", min_gap_s=HALF_DAY, lookahead_s=21600, valid=F.lit(True),
    )
    points = decisions.decision_points(sets, waits)
    return points.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("focal_train").alias("n_trains"))
