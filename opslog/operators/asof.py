"""As-of look-ups by one union, one shuffle and one sort.

Probes and events are put in one table, sorted per key by time, and each probe takes the last (or next) event's
value in that order. Nothing fans out, and a partition spills like any sort. Where events and probes share a time,
`inclusive` decides whether the event counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import recent_elements


def as_of(
    probes: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str],
    probe_ts: str,
    event_ts: str,
    values: dict[str, str | Column],
    inclusive: bool = True,
    forward: bool = False,
    tie: str | None = None,
    null_values: bool = True,
    bin_s: int | None = None,
) -> DataFrame:
    """Every probe with, for each name in values, that expression over its last event at (or before) the probe.

    forward takes the first event at or after instead. tie orders events of one time (file order, say). With
    null_values False, an event whose value is null is passed over, for each value by itself. Probes without an event
    get nulls. Probe columns named like a value are replaced. bin_s is for keys that hold a large part of all rows: work is
    then dealt by key and bin of time, see _as_of_in_bins.
    """
    if bin_s is not None:
        if not null_values:
            for n, v in values.items():
                there = events.filter((F.expr(v) if isinstance(v, str) else v).isNotNull())
                probes = _as_of_in_bins(
                    probes, there, keys=keys, probe_ts=probe_ts, event_ts=event_ts, values={n: v}, inclusive=inclusive, forward=forward, tie=tie, bin_s=bin_s
                )
            return probes
        return _as_of_in_bins(
            probes, events, keys=keys, probe_ts=probe_ts, event_ts=event_ts, values=values, inclusive=inclusive, forward=forward,
            tie=tie, bin_s=bin_s,
        )
    kept = [c for c in probes.columns if c not in values]
    payload = F.struct(*(F.col(c) for c in kept))
    made = {n: (F.expr(v) if isinstance(v, str) else v) for n, v in values.items()}
    found = F.struct(*(v.alias(n) for n, v in made.items()))
    before = inclusive != forward
    p = probes.select(
        *keys, F.col(probe_ts).alias("_ts"), F.lit(1 if before else 0).alias("_kind"),
        F.lit(None).cast("long").alias("_tie"), payload.alias("_probe"),
    )
    e = events.select(
        *keys, F.col(event_ts).alias("_ts"), F.lit(0 if before else 1).alias("_kind"),
        (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("_tie"), found.alias("_found"),
    )
    both = p.unionByName(e, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("_ts", "_kind", "_tie")
    frame = order.rowsBetween(0, W.unboundedFollowing) if forward else order.rowsBetween(W.unboundedPreceding, 0)
    pick = F.first if forward else F.last
    if null_values:
        picked = pick("_found", ignorenulls=True).over(frame)
        out = both.withColumn("_hit", picked).filter(F.col("_probe").isNotNull())
        return out.select("_probe.*", *(F.col("_hit")[n].alias(n) for n in made))
    for n in made:
        both = both.withColumn(f"_v_{n}", pick(F.col("_found")[n], ignorenulls=True).over(frame))
    out = both.filter(F.col("_probe").isNotNull())
    return out.select("_probe.*", *(F.col(f"_v_{n}").alias(n) for n in made))


def time_bin(ts: Column, bin_s: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (bin_s * 1_000_000))


def time_slot(keys: Sequence[str], ts: Column, bin_s: int) -> Column:
    """Key and bin of time in one struct, which is never null: rows without a key or a time have slots like others, and joins by slot
    keep them."""
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), time_bin(ts, bin_s).alias("bin"))


def slots_of_key(keys: Sequence[str], slot: str = "_slot"):
    """The slots of each key in order of time; one row a slot."""
    return W.partitionBy(*(F.col(slot)[f"k{i}"] for i in range(len(keys)))).orderBy(F.col(slot)["bin"])


def _as_of_in_bins(probes, events, *, keys, probe_ts, event_ts, values, inclusive, forward, tie, bin_s) -> DataFrame:
    """The same look-up without a task per key: first within (key, bin); probes that meet nothing there take the last
    event of the last earlier bin that has one (the first of the next, forward), from a table with a row per key and bin."""
    kept = [c for c in probes.columns if c not in values]
    made = {n: (F.expr(v) if isinstance(v, str) else v) for n, v in values.items()}
    order = F.struct(F.col(event_ts).alias("t"), *([F.col(tie).alias("o")] if tie else []))
    dealt = events.withColumn("_slot", time_slot(keys, F.col(event_ts), bin_s)).withColumn("_found", F.struct(*(v.alias(n) for n, v in made.items())))
    asked = probes.select(*kept, time_slot(keys, F.col(probe_ts), bin_s).alias("_slot"))
    near = as_of(
        asked, dealt, keys=["_slot"], probe_ts=probe_ts, event_ts=event_ts, values={"_near": F.col("_found")}, inclusive=inclusive,
        forward=forward, tie=tie,
    )
    edge = (F.min_by if forward else F.max_by)("_found", order)
    edges = dealt.groupBy("_slot").agg(edge.alias("_edge"))
    places = asked.select("_slot").distinct()
    parts = [*(F.col("_slot")[f"k{i}"].alias(f"_k{i}") for i in range(len(keys))), F.col("_slot")["bin"].alias("_bin")]
    far = as_of(
        places.select("_slot", *parts), edges.select("_edge", *parts), keys=[f"_k{i}" for i in range(len(keys))], probe_ts="_bin",
        event_ts="_bin", values={"_far": F.col("_edge")}, inclusive=False, forward=forward,
    )
    both = near.join(far.select("_slot", "_far"), "_slot", "left").withColumn("_hit", F.coalesce("_near", "_far"))
    return both.select(*kept, *(F.col("_hit")[n].alias(n) for n in made))


def previous_in_key(rows: DataFrame, *, keys: Sequence[str], ts: str, tie: Sequence[str] = (), columns: dict[str, str], bin_s: int | None = None) -> DataFrame:
    """Adds for each name of columns that column of the key's row before, null for the first. With bin_s, work is dealt by key and
    bin of time, and the last row of the bin before comes from a table with a row per key and bin. A null key is a key, and rows
    without a time come first."""
    found = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    if bin_s is None:
        order = W.partitionBy(*keys).orderBy(ts, *tie)
        return rows.withColumn("_prev", F.lag(found).over(order)).select(*rows.columns, *(F.col("_prev")[n].alias(n) for n in columns))
    dealt = rows.withColumn("_slot", time_slot(keys, F.col(ts), bin_s))
    ends = dealt.groupBy("_slot").agg(F.max_by(found, F.struct(ts, *tie)).alias("_end"))
    ends = ends.select("_slot", F.lag("_end").over(slots_of_key(keys)).alias("_before"))
    lag = F.lag(found).over(W.partitionBy("_slot").orderBy(ts, *tie))
    both = dealt.withColumn("_prev", lag).join(ends, "_slot").withColumn("_prev", F.coalesce("_prev", "_before"))
    return both.select(*rows.columns, *(F.col("_prev")[n].alias(n) for n in columns))


def running_in_key(rows: DataFrame, *, keys: Sequence[str], ts: str, tie: Sequence[str] = (), sums: dict[str, str], bin_s: int | None = None) -> DataFrame:
    """Adds for each name of sums that column's sum over the key's rows up to this one; null values add nothing. bin_s, null keys and
    times as in previous_in_key."""
    if bin_s is None:
        upto = W.partitionBy(*keys).orderBy(ts, *tie).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    dealt = rows.withColumn("_slot", time_slot(keys, F.col(ts), bin_s))
    before = slots_of_key(keys).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("_slot").agg(*(F.sum(c).alias(f"_b_{n}") for n, c in sums.items()))
    offsets = totals.select("_slot", *(F.sum(f"_b_{n}").over(before).alias(f"_o_{n}") for n in sums))
    upto = W.partitionBy("_slot").orderBy(ts, *tie).rowsBetween(W.unboundedPreceding, 0)
    both = dealt.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(offsets, "_slot")
    whole = lambda n: F.coalesce(F.col(n) + F.col(f"_o_{n}"), F.col(n), F.col(f"_o_{n}"))
    return both.select(*rows.columns, *(whole(n).alias(n) for n in sums))


def seconds(later: Column, earlier: Column) -> Column:
    """later - earlier in seconds, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def state_at(probes, events, *, key, probe_ts, event_ts, state, default=None, **settings) -> DataFrame:
    """The state of an asset at the probe; `default` before its first event."""
    out = as_of(probes, events, keys=[key], probe_ts=probe_ts, event_ts=event_ts, values={"state": state}, **settings)
    return out if default is None else out.fillna({"state": default})


def occupier_at(probes, events, *, key, probe_ts, event_ts, state, train, placeholders=(), bin_s=None) -> DataFrame:
    """The train of the last event if that event occupied the asset and names a real train, else null."""
    out = as_of(
        probes, events, keys=[key], probe_ts=probe_ts, event_ts=event_ts, bin_s=bin_s,
        values={"_state": F.col(state), "_train": F.col(train)},
    )
    real = (F.col("_state") == 1) & ~F.coalesce(F.col("_train").cast("string").isin(*placeholders), F.lit(False))
    return out.withColumn("occupier", F.when(real, F.col("_train"))).drop("_state", "_train")


def value_and_age(probes, events, *, keys, probe_ts, event_ts, value, inclusive=True, bin_s=None) -> DataFrame:
    """The last value and its age in seconds; both null before the first event."""
    out = as_of(
        probes, events, keys=keys, probe_ts=probe_ts, event_ts=event_ts, inclusive=inclusive, bin_s=bin_s,
        values={"value_at": value, "_at": F.col(event_ts)},
    )
    return out.withColumn("age_s", seconds(F.col(probe_ts), F.col("_at"))).drop("_at")


def fresh_value(probes, events, *, keys, probe_ts, event_ts, value, most_age_s, default=0.0, bin_s=None) -> DataFrame:
    """The last value unless it is older than most_age_s (or there is none): then the default."""
    out = value_and_age(probes, events, keys=keys, probe_ts=probe_ts, event_ts=event_ts, value=value, bin_s=bin_s)
    fresh = F.when(F.col("age_s") <= most_age_s, F.col("value_at"))
    return out.withColumn("value_at", F.coalesce(fresh, F.lit(default))).drop("age_s")


def next_lag(probes, events, *, keys, probe_ts, event_ts, most_s, bin_s=None) -> DataFrame:
    """Seconds to the next event strictly after the probe, null beyond most_s."""
    out = as_of(
        probes, events, keys=keys, probe_ts=probe_ts, event_ts=event_ts, values={"_next": F.col(event_ts)},
        forward=True, inclusive=False, bin_s=bin_s,
    )
    lag = seconds(F.col("_next"), F.col(probe_ts))
    return out.withColumn("lag_s", F.when(lag <= most_s, lag)).drop("_next")


def next_else_previous(probes, events, *, keys, probe_ts, event_ts, value, bin_s=None) -> DataFrame:
    """The next non-null value at or after the probe, else the last one before."""
    kw = dict(keys=keys, probe_ts=probe_ts, event_ts=event_ts, null_values=False, bin_s=bin_s)
    ahead = as_of(probes, events, values={"_next": value}, forward=True, **kw)
    both = as_of(ahead, events, values={"_last": value}, **kw)
    return both.withColumn("value_at", F.coalesce("_next", "_last")).drop("_next", "_last")


def count_in_window(probes, events, *, keys, probe_ts, event_ts, window_s, bin_s=None) -> DataFrame:
    """Events in (t - window, t] of the probe's key."""
    ones = events.select(*keys, event_ts).withColumn("_one", F.lit(1).cast("long"))
    counted = running_in_key(ones, keys=keys, ts=event_ts, sums={"_n": "_one"}, bin_s=bin_s)
    kw = dict(keys=keys, event_ts=event_ts, tie="_n", bin_s=bin_s)
    now = as_of(probes, counted, probe_ts=probe_ts, values={"_now": F.col("_n")}, **kw)
    start = now.withColumn("_start", F.col(probe_ts) - F.expr(f"INTERVAL {int(window_s)} SECONDS"))
    out = as_of(start, counted, probe_ts="_start", values={"_before": F.col("_n")}, **kw)
    n_in = F.coalesce("_now", F.lit(0)) - F.coalesce("_before", F.lit(0))
    return out.withColumn("n_in_window", n_in).drop("_now", "_before", "_start")


def last_distinct(probes, events, *, keys, probe_ts, event_ts, element, n, bin_s=None) -> DataFrame:
    """Adds recent: the last n distinct elements before the probe, latest first, null if there are none.

    Every event carries the list as of itself, made by one pass over each key's events in order; probes take the last list.
    """
    lists = recent_elements(events, keys=keys, ts=event_ts, element=element, n=n, name="recent", bin_s=bin_s)
    return as_of(probes, lists, keys=keys, probe_ts=probe_ts, event_ts=event_ts, values={"recent": F.col("recent")}, inclusive=False, tie="no", bin_s=bin_s)


def last_change(probes, events, *, key, probe_ts, event_ts, state, bin_s=None) -> DataFrame:
    """Adds change_age_s: whole seconds since the asset's state last changed (from the implied 0 at first), 0 when it never did."""
    was = previous_in_key(events.select(key, event_ts, state), keys=[key], ts=event_ts, columns={"_was": state}, bin_s=bin_s)
    changes = was.filter(F.col(state) != F.coalesce("_was", F.lit(0))).select(key, event_ts)
    out = as_of(probes, changes, keys=[key], probe_ts=probe_ts, event_ts=event_ts, values={"_changed": F.col(event_ts)}, bin_s=bin_s)
    age = F.floor(seconds(F.col(probe_ts), F.col("_changed"))).cast("long")
    return out.withColumn("change_age_s", F.coalesce(age, F.lit(0))).drop("_changed")
