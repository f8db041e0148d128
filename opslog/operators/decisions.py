"""Decision triggers, rewards, flags and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse
from .joins import no_follow_up
from .ranks import numbered, quantiles
from .windows import throttle

#: Reward of each outcome of a set route.
OUTCOME_REWARD = {"used": 1.0, "unused_cancelled": -1.0, "unused_timeout": -0.5, "unknown": 0.0}


def set_triggers(requests: DataFrame, *, train: str, signal: str, ts: str, route: str) -> DataFrame:
    return requests.select(
        F.col(train).alias("focal_train"), F.col(signal).alias("focal_signal"), F.col(ts).alias("t"),
        F.lit("set").alias("label"), F.col(route).alias("chosen_route_id"), F.lit("request").alias("trigger_type"),
    )


def wait_triggers(
    occupations: DataFrame, approach: DataFrame, requests: DataFrame, *, train: str, element: str, ts: str,
    signal: str, request_train: str, request_signal: str, request_ts: str, min_gap_s: int, lookahead_s: int,
    placeholders: Sequence[str] = (), valid: Column | None = None, bin_s: int | None = None,
) -> DataFrame:
    """Waits: a train occupies an approach element of a signal, at most one per min_gap_s and (train, signal), and nothing
    is requested for it in [t, t + lookahead_s]."""
    ok = parse.is_valid_id(F.col(train), placeholders) if valid is None else valid
    near = occupations.filter(ok).join(approach.withColumnRenamed("element", element), element)
    seen = near.select(F.col(train).alias("focal_train"), F.col(signal).alias("focal_signal"), F.col(ts).alias("t"), element)
    thin = throttle(seen, keys=["focal_train", "focal_signal"], ts="t", min_gap_s=min_gap_s, tie=["t", element])
    asked = requests.select(
        F.col(request_train).alias("focal_train"), F.col(request_signal).alias("focal_signal"), F.col(request_ts).alias("_rt")
    )
    waits = no_follow_up(thin, asked, keys=["focal_train", "focal_signal"], trigger_ts="t", request_ts="_rt", within_s=lookahead_s, bin_s=bin_s)
    return waits.select(
        "focal_train", "focal_signal", "t", F.lit("wait").alias("label"),
        F.lit(None).cast("string").alias("chosen_route_id"), F.lit("occupation").alias("trigger_type"),
    )


def decision_points(sets: DataFrame, waits: DataFrame) -> DataFrame:
    return sets.unionByName(waits)


def lookahead_sweep(triggers: DataFrame, requests: DataFrame, *, keys: Sequence[str], trigger_ts: str, request_ts: str, thresholds_s: Sequence[int], bin_s: int | None = None) -> DataFrame:
    """threshold_s, n_kept: one as-of for all thresholds."""
    from .asof import as_of, seconds

    hit = as_of(triggers, requests, keys=keys, probe_ts=trigger_ts, event_ts=request_ts, forward=True, values={"_next": F.col(request_ts)}, bin_s=bin_s)
    lag = F.coalesce(seconds(F.col("_next"), F.col(trigger_ts)), F.lit(float("inf")))
    counts = hit.agg(*(F.count_if(lag > s).alias(str(s)) for s in thresholds_s))
    pairs = F.array(*(F.struct(F.lit(s).alias("threshold_s"), F.col(f"`{s}`").alias("n_kept")) for s in thresholds_s))
    return counts.select(F.inline(pairs))


def pass_intervals(events: DataFrame, *, key: str, ts: str, buffer_s: int, columns: Sequence[str] = ()) -> DataFrame:
    """key, t_first, t_last widened by the buffer, and the first value of further columns by time."""
    wide = F.expr(f"INTERVAL {buffer_s} SECONDS")
    return events.groupBy(key).agg(
        (F.min(ts) - wide).alias("t_first"), (F.max(ts) + wide).alias("t_last"),
        *(F.min_by(c, ts).alias(c) for c in columns),
    )


def rewards(
    df: DataFrame, *, label: str, distance: str, outcome: str, delay: str, headway: str, weights: dict[str, float],
    clip_s: float, headway_limit_s: float, half_most: float, tenth_most: float,
) -> DataFrame:
    """Adds gate, the four raw and weighted components and r_total. Unmeasured parts (null) count 0."""
    is_set = F.col(label) == "set"
    gate = F.when(is_set, parse.distance_gate(F.col(distance), half_most, tenth_most)).otherwise(1.0)
    clipped = F.greatest(F.lit(-float(clip_s)), F.least(F.lit(float(clip_s)), F.col(delay))) / 60
    known = F.coalesce(F.col(outcome), F.lit("unknown"))
    raw = {
        "delay": F.when(F.col(delay).isNotNull(), -gate * clipped).otherwise(0.0),  # least() passes over nulls
        "throughput": F.when(is_set, parse_lookup(known)).otherwise(0.0),
        "headway": F.when(F.col(headway) < headway_limit_s, -1.0).otherwise(0.0),
        "wait": F.when(is_set, 0.0).otherwise(-1.0),
    }
    out = df.withColumn("gate", gate)
    for n, c in raw.items():
        out = out.withColumn(f"r_{n}_raw", c).withColumn(f"r_{n}", F.lit(weights[n]) * F.col(f"r_{n}_raw"))
    return out.withColumn("r_total", sum(F.col(f"r_{n}") for n in raw))


def parse_lookup(outcome: Column) -> Column:
    flat = [F.lit(x) for pair in OUTCOME_REWARD.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), outcome), F.lit(0.0))


def thresholds(df: DataFrame, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact percentiles: name -> (column, share)."""
    return quantiles(df, specs)


def increasing_edges(df: DataFrame, column: str, shares: Sequence[float], step: float = 1.0) -> DataFrame:
    """edge_no, edge: percentiles, each at least `step` above the one before."""
    found = quantiles(df, {f"e{k}": (column, s) for k, s in enumerate(shares)})
    edges = found.select(F.array(*found.columns).alias("e"))
    start = F.array().cast("array<double>")
    fold = F.aggregate("e", start, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.greatest(x, F.element_at(acc, -1) + step)).otherwise(x))))
    return edges.select(F.posexplode(fold).alias("edge_no", "edge"))


def surrogate_key(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """sample_id from a total order, to be written once and joined by ever after."""
    return numbered(df, order, "sample_id")


def f_advance(first_occupiers: Column, focal: Column) -> Column:
    """Any candidate's first element occupied by another train."""
    return F.exists(first_occupiers, lambda o: o.isNotNull() & (o != focal))


def f_call_on(options: Column) -> Column:
    """Any candidate (cls, platform_occupied) of class C into an occupied platform."""
    return F.exists(options, lambda o: (o["cls"] == "C") & o["platform_occupied"])


def f_platform_dev(planned: Column, platforms: Column) -> Column:
    """Planned platform known, some candidate platform known, none of them the planned one."""
    known = F.filter(platforms, lambda p: p.isNotNull())
    return planned.isNotNull() & (F.size(known) > 0) & ~F.coalesce(F.array_contains(known, planned), F.lit(False))


def f_priority_compete(n_others: Column) -> Column:
    return n_others >= 1


def f_late_train(seconds_late: Column) -> Column:
    return F.when(seconds_late >= 60, seconds_late).otherwise(0)


def f_unusual_id(train: Column) -> Column:
    return ~F.coalesce(train.rlike(parse.HEADCODE), F.lit(False))


def f_trts_pressed(planned_pressed: Column, current_pressed: Column) -> Column:
    return F.coalesce(planned_pressed, F.lit(False)) | F.coalesce(current_pressed, F.lit(False))


def f_freight_class(digit: Column) -> Column:
    return F.coalesce(digit.isin("4", "6"), F.lit(False))


def all_flags(**flags: Column) -> Column:
    """One struct of the named flags with their names as provenance."""
    return F.struct(*(c.alias(n) for n, c in flags.items()), F.array(*(F.lit(n) for n in flags)).alias("sources"))


def stratum(checks: Sequence[tuple[str, Column]], other: str = "other") -> Column:
    """The first stratum whose condition holds."""
    out = None
    for name, c in checks:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(other)


def stratum_weights(df: DataFrame, *, stratum_col: str, is_train: Column) -> DataFrame:
    """stratum, n_train, weight = 1 / sqrt(share of training rows)."""
    counts = df.groupBy(stratum_col).agg(F.count_if(is_train).alias("n_train"))
    total = F.sum("n_train").over(W.partitionBy())
    return counts.select(stratum_col, "n_train", F.when(F.col("n_train") > 0, 1 / F.sqrt(F.col("n_train") / total)).alias("weight"))


def decision_events(log: DataFrame, *, kind: str, request: str, ts: str, route: str, train: str) -> DataFrame:
    """Requests only, with the route's and the train id's parts as columns of their own."""
    rows = log.filter(F.col(kind) == request).select(F.col(ts).alias("t"), F.col(route).alias("route_id"), F.col(train).alias("focal_train"))
    parts = rows.withColumns({"_r": parse.route_parts(F.col("route_id")), "_h": parse.headcode_parts(F.col("focal_train"))})
    return parts.select("t", "route_id", "focal_train", "_r.*", "_h.*")


def decision_summary(points: DataFrame, *, label: str, train: str, signal: str, ts: str) -> DataFrame:
    """One row: decisions, of each label, distinct trains and signals, first and last time."""
    return points.agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == "set").alias("n_set"), F.count_if(F.col(label) == "wait").alias("n_wait"),
        F.count_distinct(train).alias("n_trains"), F.count_distinct(signal).alias("n_signals"), F.min(ts).alias("first"), F.max(ts).alias("last"),
    )


def reward_job(
    points: DataFrame, *, key: str, train: str, ts: str, signal: str, element: str, label: str, route: str, reports: DataFrame, positions: DataFrame,
    distances: DataFrame, outcomes: DataFrame, headways: DataFrame, weights: dict[str, float], bracket_s: float, bin_s: int | None = None, **limits,
) -> DataFrame:
    """Rewards of decision points from what was recorded around them, one row for each point.

    distance: hops from the train's same-day element to the signal (distances: element, signal, hops); delay: the change
    between the reports that bracket the point; outcome and headway: attached by the point's key (unique in both). Parts that were not
    measured stay null and count 0.
    """
    from ..sources.io import attached
    from .asof import as_of
    from .joins import bracket_changes

    day = F.to_date(ts)
    at = as_of(
        points.withColumn("_day", day), positions.select(train, element, F.col("ts").alias("_at"), F.to_date("ts").alias("_day")), keys=[train, "_day"],
        probe_ts=ts, event_ts="_at", values={"_element": F.col(element)}, bin_s=bin_s,
    ).drop("_day")
    near = at.join(distances.select(F.col("element").alias("_element"), F.col("signal").alias(signal), F.col("hops").alias("distance")), ["_element", signal], "left")
    delayed = bracket_changes(near.drop("_element"), reports, keys=[train], probe_ts=ts, report_ts="ts", value="value", window_s=bracket_s, bin_s=bin_s)
    full = attached(attached(delayed.withColumnRenamed("change", "delay"), outcomes, key=key, columns=["outcome"]), headways, key=key, columns=["headway_s"])
    return rewards(full, label=label, distance="distance", outcome="outcome", delay="delay", headway="headway_s", weights=weights, **limits)


def reapplied(stored_rewards: DataFrame, *, label: str, weights: dict[str, float], **limits) -> DataFrame:
    """Rewards with other weights and limits from the features of a stored reward table; its old rewards are replaced."""
    features = stored_rewards.drop(*(c for c in stored_rewards.columns if c.startswith("r_") or c == "gate"))
    return rewards(features, label=label, distance="distance", outcome="outcome", delay="delay", headway="headway_s", weights=weights, **limits)
