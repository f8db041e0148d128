"""Labels from chains of events: headways, lifecycles, lead times, dwell and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks
from .asof import as_of, previous_in_key, running_in_key, seconds


def _following(key: str | Sequence[str], ts: str):
    keys = [key] if isinstance(key, str) else list(key)
    return W.partitionBy(*keys).orderBy(ts).rowsBetween(1, W.unboundedFollowing)


def chain_times(events: DataFrame, *, key: str, ts: str, state: str, bin_s: int | None = None) -> DataFrame:
    """key, at (of a 1), next_0 after it and next_1 after that 0: three links of the chain, per event in one sort.

    bin_s: for keys that hold a large part of all rows; the links are then two look-ups dealt by key and bin of time.
    """
    if bin_s is not None:
        kw = dict(keys=[key], event_ts=ts, forward=True, inclusive=False, bin_s=bin_s)
        ones, zeros = (events.filter(F.col(state) == k).select(key, ts) for k in (1, 0))
        first = as_of(ones.select(key, F.col(ts).alias("at")), zeros, probe_ts="at", values={"next_0": F.col(ts)}, **kw)
        return as_of(first, ones, probe_ts="next_0", values={"next_1": F.col(ts)}, **kw).select(key, "at", "next_0", "next_1")
    after = _following(key, ts)
    one = F.when(F.col(state) == 1, F.col(ts))
    rows = events.select(key, ts, state, F.first(one, ignorenulls=True).over(after).alias("_next_1"))
    zero = F.when(F.col(state) == 0, F.struct(F.col(ts).alias("t"), F.col("_next_1").alias("n")))
    rows = rows.withColumn("_zero", F.first(zero, ignorenulls=True).over(after))
    return rows.filter(F.col(state) == 1).select(
        key, F.col(ts).alias("at"), F.col("_zero.t").alias("next_0"), F.col("_zero.n").alias("next_1")
    )


def next_headway(probes: DataFrame, events: DataFrame, *, key: str, probe_ts: str, event_ts: str, state: str, bin_s: int | None = None) -> DataFrame:
    """Adds headway_s: after the first 1 at or after the probe, the time from the next 0 to the 1 after it, if positive."""
    chain = chain_times(events, key=key, ts=event_ts, state=state, bin_s=bin_s)
    hit = as_of(
        probes, chain, keys=[key], probe_ts=probe_ts, event_ts="at", forward=True,
        values={"_z": F.col("next_0"), "_n": F.col("next_1")}, bin_s=bin_s,
    )
    gap = seconds(F.col("_n"), F.col("_z"))
    return hit.withColumn("headway_s", F.when(gap > 0, gap)).drop("_z", "_n")


def lifecycle(
    probes: DataFrame, releases: DataFrame, uses: DataFrame, *, key: str, probe_ts: str, event_ts: str, cancel_s=60, bin_s: int | None = None
) -> DataFrame:
    """Adds release_ts, n_used and outcome.

    The release is the first one at or after the probe; uses in [probe, release] are a difference of running counts.
    used, else unused_cancelled before cancel_s, else unused_timeout; unknown without a release.
    """
    kw = dict(keys=[key], bin_s=bin_s)
    out = as_of(probes, releases, probe_ts=probe_ts, event_ts=event_ts, forward=True, values={"release_ts": F.col(event_ts)}, **kw)
    ones = uses.select(key, F.col(event_ts).alias("_at")).withColumn("_one", F.lit(1))
    running = running_in_key(ones, keys=[key], ts="_at", sums={"_n": "_one"}, bin_s=bin_s)
    out = as_of(out, running, probe_ts=probe_ts, event_ts="_at", inclusive=False, tie="_n", values={"_before": F.col("_n")}, **kw)
    out = as_of(out, running, probe_ts="release_ts", event_ts="_at", tie="_n", values={"_upto": F.col("_n")}, **kw)
    used = F.coalesce("_upto", F.lit(0)) - F.coalesce("_before", F.lit(0))
    out = out.withColumn("n_used", F.when(F.col("release_ts").isNotNull(), used))
    held = seconds(F.col("release_ts"), F.col(probe_ts))
    outcome = (
        F.when(F.col("release_ts").isNull(), "unknown").when(F.col("n_used") > 0, "used")
        .when(held < cancel_s, "unused_cancelled").otherwise("unused_timeout")
    )
    return out.withColumn("outcome", outcome).drop("_before", "_upto")


def lead_time(probes: DataFrame, events: DataFrame, *, key: str, probe_ts: str, event_ts: str, bin_s: int | None = None) -> DataFrame:
    """Adds lead_s: seconds to the first event at or after the probe."""
    hit = as_of(probes, events, keys=[key], probe_ts=probe_ts, event_ts=event_ts, forward=True, bin_s=bin_s, values={"_at": F.col(event_ts)})
    return hit.withColumn("lead_s", seconds(F.col("_at"), F.col(probe_ts))).drop("_at")


def clear_gaps(events: DataFrame, *, key: str, ts: str, state: str, bin_s: int | None = None) -> DataFrame:
    """key, gap_s: from each change to 0 to the following change to 1, where positive. Repeated states are no change."""
    kw = dict(keys=[key], ts=ts, bin_s=bin_s)
    rows = previous_in_key(events.select(key, ts, state), columns={"_was": state}, **kw)
    changes = rows.filter(F.col("_was").isNull() | (F.col("_was") != F.col(state))).select(key, ts, state)
    pairs = previous_in_key(changes, columns={"_was": state, "_at": ts}, **kw)
    gap = F.when((F.col(state) == 1) & (F.col("_was") == 0), seconds(F.col(ts), F.col("_at")))
    return pairs.select(key, gap.alias("gap_s")).filter("gap_s > 0")


def onset_headways(events: DataFrame, *, key: str, ts: str, state: str, train: str, most_s: float, bin_s: int | None = None) -> DataFrame:
    """key, headway_s: between consecutive onsets of different trains, in (0, most_s)."""
    onsets = events.filter(F.col(state) == 1).select(key, ts, train)
    pairs = previous_in_key(onsets, keys=[key], ts=ts, columns={"_train": train, "_at": ts}, bin_s=bin_s)
    gap = F.when(F.col("_train") != F.col(train), seconds(F.col(ts), F.col("_at")))
    return pairs.select(key, gap.alias("headway_s")).filter((F.col("headway_s") > 0) & (F.col("headway_s") < most_s))


def durations(events: DataFrame, *, key: str, ts: str, state: str, start=1, end=0, most_s: float, bin_s: int | None = None) -> DataFrame:
    """key, duration_s: from each start state to the next end state, below most_s."""
    begin, stop = (events.filter(F.col(state) == s).select(key, ts) for s in (start, end))
    hit = as_of(begin, stop.withColumnRenamed(ts, "_end"), keys=[key], probe_ts=ts, event_ts="_end", forward=True, inclusive=False, values={"_stop": F.col("_end")}, bin_s=bin_s)
    return hit.select(key, seconds(F.col("_stop"), F.col(ts)).alias("duration_s")).filter(F.col("duration_s") < most_s)


def running_times(routes: DataFrame, *, route: str, columns: dict[str, str]) -> DataFrame:
    """route and running times in seconds under new names, from a table of measured runs: the median of each column by route."""
    return ranks.quantiles_by(routes, [route], {n: (c, 0.5) for n, c in columns.items()})


def dwell(reports: DataFrame, *, keys: Sequence[str], ts: str, kind: str, arrival: str, departure: str, most_s=3600) -> DataFrame:
    """keys..., dwell_s: first departure minus first arrival per key, in [0, most_s]."""
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(ts)))
    stays = reports.groupBy(*keys).agg(seconds(first(departure), first(arrival)).alias("dwell_s"))
    return stays.filter((F.col("dwell_s") >= 0) & (F.col("dwell_s") <= most_s))


def dwell_by_class(reports: DataFrame, *, train: str, platform: str, cls: Column, ts: str, kind: str, arrival: str, departure: str, at: Sequence[float], most_s=3600) -> DataFrame:
    """platform, cls, n, p<percent>...: exact quantiles of dwells per platform and class of train. Rows without a train, platform or
    time are no reports."""
    known = reports.filter(F.col(train).isNotNull() & F.col(platform).isNotNull() & F.col(ts).isNotNull()).withColumn("cls", cls)
    stays = dwell(known, keys=[train, platform, "cls"], ts=ts, kind=kind, arrival=arrival, departure=departure, most_s=most_s)
    return quantiles_by(stays, [platform, "cls"], "dwell_s", at)


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key."""
    return ranks.quantiles_by(df, keys, {f"p{round(100 * q)}": (value, q) for q in at}, [F.count("*").alias("n")])


def ordered_paths(events: DataFrame, *, keys: Sequence[str], ts: str, element: str, state: str | None = None, least=2) -> DataFrame:
    """keys..., path: the elements of each key in time order, if there are at least `least`."""
    rows = events.filter(F.col(state) == 1) if state else events
    listed = F.transform(F.array_sort(F.collect_list(F.struct(ts, element))), lambda s: s[element])
    return rows.groupBy(*keys).agg(listed.alias("path")).filter(F.size("path") >= least)
