"""Temporal and range joins beyond the as-of look-up, and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import stored
from .asof import as_of, running_in_key, seconds
from .ranks import numbered, numbered_runs  # noqa: F401  (numbered is part of this module for its users)


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def intervals(events: DataFrame, *, keys: Sequence[str], ts: str) -> DataFrame:
    """keys..., t_first, t_last."""
    return events.groupBy(*keys).agg(F.min(ts).alias("t_first"), F.max(ts).alias("t_last"))


def interval_join(
    probes: DataFrame, spans: DataFrame, *, key: str, probe_id: str, probe_ts: str, span_id: Sequence[str],
    buffer_s: float = 0, nearest: bool = True, bin_s: int = 86_400,
) -> DataFrame:
    """Every probe with at most one span of its key that holds it: the nearest centre, or the first by start.

    Spans (t_first, t_last, widened by buffer_s) are dealt into bins of time, so a key with many spans meets only those
    near the probe. Probes without a span get nulls.
    """
    reach, width = int(buffer_s * 1e6), int(bin_s * 1e6)
    s = spans.select(
        F.col(key).alias("_key"), *span_id, "t_first", "t_last",
        (_micros(F.col("t_first")) - reach).alias("_lo"), (_micros(F.col("t_last")) + reach).alias("_hi"),
    )
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    t = _micros(F.col(probe_ts))
    p = probes.select(probe_id, F.col(key).alias("_key"), t.alias("_t")).withColumn("_bin", F.floor(F.col("_t") / width))
    met = p.join(s, ["_key", "_bin"]).filter(F.col("_t").between(F.col("_lo"), F.col("_hi")))
    centre = (_micros(F.col("t_first")) + _micros(F.col("t_last"))) / 2
    first = [F.abs(F.col("_t") - centre)] if nearest else []
    order = W.partitionBy(probe_id).orderBy(*first, "t_first", "t_last", *span_id)
    best = met.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select(probe_id, *span_id, "t_first", "t_last")
    return probes.join(best, probe_id, "left")


def bracket_changes(
    probes: DataFrame, reports: DataFrame, *, keys: Sequence[str], probe_ts: str, report_ts: str, value: str, window_s: float, bin_s: int | None = None
) -> DataFrame:
    """Adds before_ts, after_ts, n_sharing and change.

    The last report at or before the probe and the first after it, both within window_s, bracket it; the change of value
    between them is divided by the number of probes in the same bracket. No bracket, no change.
    """
    kw = dict(keys=list(keys), probe_ts=probe_ts, event_ts=report_ts, bin_s=bin_s)
    took = as_of(probes, reports, values={"before_ts": F.col(report_ts), "_v0": F.col(value)}, **kw)
    both = as_of(took, reports, values={"after_ts": F.col(report_ts), "_v1": F.col(value)}, forward=True, inclusive=False, **kw)
    near = (seconds(F.col(probe_ts), F.col("before_ts")) <= window_s) & (seconds(F.col("after_ts"), F.col(probe_ts)) <= window_s)
    sharing = F.count("*").over(W.partitionBy(*keys, "before_ts", "after_ts"))
    out = both.withColumn("_near", F.coalesce(near, F.lit(False))).withColumn("n_sharing", sharing)
    return out.withColumn("change", F.when(F.col("_near"), (F.col("_v1") - F.col("_v0")) / F.col("n_sharing"))).drop("_v0", "_v1", "_near")


def bracket_changes_in_runs(
    probes: DataFrame, reports: DataFrame, *, key: str, probe_id: str, probe_ts: str, report_ts: str, value: str, window_s: float, run_gap_s: float, bin_s: int | None = None
) -> DataFrame:
    """bracket_changes inside runs: a key's reports are cut where they pause for over run_gap_s, a probe belongs to the run with the
    nearest centre among those that hold it widened by window_s, and only that run's reports bracket it. run_no is null without one."""
    from .windows import sessions

    named = sessions(reports.select(F.col(key), F.col(report_ts), F.col(value)), keys=[key], ts=report_ts, gap_s=run_gap_s, name="run_no", bin_s=bin_s)
    spans = intervals(named, keys=[key, "run_no"], ts=report_ts)
    near = interval_join(probes, spans, key=key, probe_id=probe_id, probe_ts=probe_ts, span_id=["run_no"], buffer_s=window_s).drop("t_first", "t_last")
    return bracket_changes(near, named, keys=[key, "run_no"], probe_ts=probe_ts, report_ts=report_ts, value=value, window_s=window_s, bin_s=bin_s)


def clusters_of_unmatched(matched: DataFrame, *, span: str, key: str, ts: str, gap_s: float, tie: Sequence[str] = ()) -> DataFrame:
    """The probes that interval_join left without a span, with cluster_no: they are sessions of their own by gaps."""
    from .windows import sessions

    return sessions(matched.filter(F.col(span).isNull()), keys=[key], ts=ts, gap_s=gap_s, tie=tie, name="cluster_no")


def approach_distances(probes: DataFrame, positions: DataFrame, distances: DataFrame, *, key: str, probe_ts: str, event_ts: str, element: str, signal: str, bin_s: int | None = None) -> DataFrame:
    """hops, n: how far from the signal a probe's train was, by its last element before the probe (no same-day rule)."""
    at = as_of(probes, positions, keys=[key], probe_ts=probe_ts, event_ts=event_ts, values={"_element": F.col(element)}, bin_s=bin_s)
    near = at.join(distances.select(F.col("element").alias("_element"), F.col("signal").alias(signal), "hops"), ["_element", signal])
    return near.groupBy("hops").agg(F.count("*").alias("n"))


def bracket_faults(bracketed: DataFrame, *, probe_ts: str, window_s: float) -> Column:
    """Why a probe has no change: no_report, no_before, no_after, before_far, after_far, or ok."""
    return (
        F.when(F.col("before_ts").isNull() & F.col("after_ts").isNull(), "no_report")
        .when(F.col("before_ts").isNull(), "no_before").when(F.col("after_ts").isNull(), "no_after")
        .when(seconds(F.col(probe_ts), F.col("before_ts")) > window_s, "before_far")
        .when(seconds(F.col("after_ts"), F.col(probe_ts)) > window_s, "after_far")
        .otherwise("ok")
    )


def no_follow_up(triggers: DataFrame, requests: DataFrame, *, keys: Sequence[str], trigger_ts: str, request_ts: str, within_s: float, bin_s: int | None = None) -> DataFrame:
    """Triggers without a request of the same keys in [t, t + within_s]."""
    hit = as_of(triggers, requests, keys=keys, probe_ts=trigger_ts, event_ts=request_ts, forward=True, values={"_next": F.col(request_ts)}, bin_s=bin_s)
    late = F.col("_next").isNull() | (seconds(F.col("_next"), F.col(trigger_ts)) > within_s)
    return hit.filter(late).drop("_next")


def upcoming(
    probes: DataFrame, schedule: DataFrame, *, probe_id: str, probe_ts: str, schedule_ts: str, exclude: tuple[str, str],
    columns: Sequence[str], ahead_s: int, k: int,
) -> DataFrame:
    """Adds outlook: the next k schedule rows in (t, t + ahead_s] of others, as structs in time order.

    The schedule is numbered by time and cut into runs of one id. A probe takes its place as of its time and meets the k
    numbers after it in its place's run and the first k rows of the 2k runs that follow. Neighbouring runs differ in id, so
    those hold k rows of others, however dense the schedule is and however many of its rows are the probe's own.
    """
    own, other = exclude
    cols = [f"_c_{c}" for c in columns]
    s = schedule.filter(F.col(other).isNotNull()).select(
        F.col(schedule_ts).alias("_st"), F.col(other).alias("_other"), *(F.col(c).alias(n) for c, n in zip(columns, cols))
    )
    rows = stored(numbered_runs(s, ["_st", *cols, "_other"], "_other", "_n", "_run"), "runs")
    first = rows.groupBy("_run").agg(F.min("_n").alias("_first"))
    at = as_of(
        probes.select(probe_id, probe_ts, F.col(own).alias("_own")), rows, keys=[], probe_ts=probe_ts, event_ts="_st", tie="_n",
        values={"_place": F.col("_n"), "_at": F.col("_run")}, bin_s=max(int(ahead_s), 1),
    ).select(probe_id, probe_ts, "_own", F.coalesce("_place", F.lit(0)).alias("_place"), F.coalesce("_at", F.lit(0)).alias("_at"))
    same = at.withColumn("_n", F.explode(F.sequence(F.col("_place") + 1, F.col("_place") + k))).join(rows, "_n").filter("_run = _at")
    heads = rows.join(first, "_run").filter(F.col("_n") - F.col("_first") < k).drop("_first")
    later = at.withColumn("_run", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + 2 * k))).join(heads, "_run")
    ahead = seconds(F.col("_st"), F.col(probe_ts))
    met = same.unionByName(later).filter((ahead > 0) & (ahead <= ahead_s) & (F.col("_own") != F.col("_other")))
    top = met.withColumn("_k", F.row_number().over(W.partitionBy(probe_id).orderBy("_n"))).filter(F.col("_k") <= k)
    row = F.struct("_k", ahead.alias("in_s"), *(F.col(n).alias(c) for c, n in zip(columns, cols)))
    lists = top.groupBy(probe_id).agg(F.sort_array(F.collect_list(row)).alias("outlook"))
    return probes.join(lists, probe_id, "left")


def last_events(
    probes: DataFrame, events: DataFrame, *, keys: Sequence[str], probe_id: str, probe_ts: str, event_ts: str,
    columns: Sequence[str], k: int, bin_s: int | None = None,
) -> DataFrame:
    """probe_id, rank (1 = latest), columns...: the last k events of the key at or before the probe.

    Events are numbered per key; a probe takes the number as of its time and meets the one or two blocks of k numbers that
    hold its last k events, so each probe meets 2k rows at most. bin_s: for keys that hold a large part of all rows.
    """
    seq = events.select(*keys, event_ts, *columns).withColumn("_one", F.lit(1))
    seq = running_in_key(seq, keys=keys, ts=event_ts, tie=columns, sums={"_seq": "_one"}, bin_s=bin_s).drop("_one")
    at = as_of(
        probes.select(probe_id, probe_ts, *keys), seq.select(*keys, event_ts, "_seq"), keys=keys, probe_ts=probe_ts, event_ts=event_ts, tie="_seq",
        values={"_pos": F.col("_seq")}, bin_s=bin_s,
    ).filter("_pos IS NOT NULL")
    block = lambda c: F.floor((c - 1) / k)
    asks = at.withColumn("_block", F.explode(F.array(block(F.col("_pos")), block(F.col("_pos")) - 1))).select(probe_id, *keys, "_pos", "_block")
    rows = seq.withColumn("_block", block(F.col("_seq")))
    met = asks.join(rows, [*keys, "_block"]).filter((F.col("_seq") <= F.col("_pos")) & (F.col("_seq") > F.col("_pos") - k))
    return met.select(probe_id, (F.col("_pos") - F.col("_seq") + 1).cast("int").alias("rank"), event_ts, *columns)


def conflicts(requests: DataFrame, events: DataFrame, *, request_id: str, ts: str, elements: str, element: str, event_ts: str, state: str, train: str, focal: str, bin_s: int | None = None) -> DataFrame:
    """request_id, n_elements, n_occupied, n_by_other, first_occupied: each request's elements with their latest state."""
    one = requests.select(request_id, F.col(ts).alias("_rt"), F.col(focal).alias("_focal"), F.posexplode(elements).alias("_pos", element))
    hit = as_of(one, events, keys=[element], probe_ts="_rt", event_ts=event_ts, values={"_st": F.col(state), "_tr": F.col(train)}, bin_s=bin_s)
    on = F.coalesce(F.col("_st") == 1, F.lit(False))
    return hit.groupBy(request_id).agg(
        F.count("*").alias("n_elements"), F.count_if(on).alias("n_occupied"),
        F.count_if(on & (F.col("_tr") != F.col("_focal"))).alias("n_by_other"),
        F.min(F.when(on, F.col("_pos"))).alias("first_occupied"),
    )


def coverage_of(decisions: DataFrame, *, chosen: str, candidates: str) -> DataFrame:
    """One row: decisions, those whose chosen action is among the candidates, and the share."""
    there = F.coalesce(F.array_contains(candidates, F.col(chosen)), F.lit(False))
    return decisions.agg(F.count("*").alias("n"), F.count_if(there).alias("n_covered"), F.avg(there.cast("double")).alias("share"))


def coverage_misses(decisions: DataFrame, *, decision: str, chosen: str, candidates: str, prefix: str | None = None, sample: int = 10) -> DataFrame:
    """decision, chosen, reason: up to `sample` decisions whose chosen action is no candidate, the least ids first.

    reason: no_candidates, aliased (a candidate is the same without the prefix, a regular expression), or other.
    """
    there = F.coalesce(F.array_contains(candidates, F.col(chosen)), F.lit(False))
    reason = F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, "no_candidates")
    if prefix:
        plain = lambda x: F.regexp_replace(x.cast("string"), f"^(?:{prefix})", "")
        reason = reason.when(F.array_contains(F.transform(candidates, plain), plain(F.col(chosen))), "aliased")
    return decisions.filter(~there).orderBy(decision).limit(sample).select(decision, chosen, reason.otherwise("other").alias("reason"))


def aliased_keys(left: DataFrame, right: DataFrame, key: str, *, prefix: str) -> DataFrame:
    """key, other: keys of left that right lacks, with right's keys that are the same without the prefix (a regular expression)."""
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), f"^(?:{prefix})", "")
    gone = missing_keys(left, right, key).withColumn("_plain", plain(key))
    others = right.select(F.col(key).alias("other")).distinct().withColumn("_plain", plain("other"))
    return gone.join(others, "_plain").select(key, "other")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def rule_leads(decisions: DataFrame, rules: DataFrame, predicates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """rules with _lead (the number of the condition that fewest decisions meet), _value (one row for each of its values) and
    _n (decisions with that value); and the counts (_lead, _value, _n) of the values that rules name."""
    names, of = list(predicates), list(predicates.values())
    numbered_ = stored(rules.withColumn("_rule", F.monotonically_increasing_id()), "rules")
    asks = F.array(*(F.struct(F.lit(k).alias("_lead"), F.col(c).cast("string").alias("_value")) for k, c in enumerate(of)))
    counts = decisions.select(F.inline(asks)).groupBy("_lead", "_value").agg(F.count("*").alias("_n"))
    values = F.array(*(F.struct(F.lit(k).alias("_lead"), F.array_distinct(F.transform(n, lambda x: x.cast("string"))).alias("_values")) for k, n in enumerate(names)))
    conditions = numbered_.select("_rule", F.inline(values)).filter("_values IS NOT NULL").select("_rule", "_lead", F.explode_outer("_values").alias("_value"))
    met = stored(conditions.join(counts, ["_lead", "_value"], "left").fillna({"_n": 0}), "rule-values")
    total = met.groupBy("_rule", "_lead").agg(F.sum("_n").alias("_met"))
    lead = total.groupBy("_rule").agg(F.min(F.struct("_met", "_lead"))["_lead"].alias("_lead"))
    free = F.struct(F.lit(len(names)).alias("_lead"), F.lit("").alias("_value"), F.lit(0).cast("long").alias("_n"))
    led = numbered_.join(lead.join(met, ["_rule", "_lead"]).select("_rule", F.struct("_lead", "_value", "_n").alias("_at")), "_rule", "left")
    return led.select(*rules.columns, F.coalesce("_at", free).alias("_at")).select(*rules.columns, "_at.*"), met.select("_lead", "_value", "_n").distinct()


def rule_matches(decisions: DataFrame, rules: DataFrame, *, predicates: dict[str, str]) -> DataFrame:
    """Decisions with every rule whose conditions all hold; a null condition always holds.

    predicates: rule array column to decision column. A rule is found by the values of that of its conditions which the fewest
    decisions meet, by an equal join; its other conditions are looked at then. A decision enters once for each of its values that
    leads a rule, and once for rules without conditions. Values with over a thousandth of all decisions are split over parts, and
    their rules repeated in each.
    """
    names, of = list(predicates), list(predicates.values())
    led, counts = rule_leads(decisions, rules, predicates)
    led = stored(led, "rule-leads")
    n = decisions.count()
    parts = F.least(F.lit(64), F.ceil(F.col("_n") * 1000 / max(1, n))).cast("int")
    leading = led.select("_lead", "_value").distinct().join(counts, ["_lead", "_value"], "left").fillna({"_n": n})
    hot = F.broadcast(leading.withColumn("_parts", parts).filter("_parts > 1").drop("_n"))  # at most 1000 values a condition, and the free rules
    asks = F.array(*(F.struct(F.lit(k).alias("_lead"), F.col(c).cast("string").alias("_value")) for k, c in enumerate(of)), F.struct(F.lit(len(of)).alias("_lead"), F.lit("").alias("_value")))
    used = [r[0] for r in led.select("_lead").distinct().collect()]  # at most one number a predicate
    asked = decisions.select("*", F.inline(F.filter(asks, lambda a: a["_lead"].isin(used) if used else F.lit(False))))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    asked = asked.join(hot, ["_lead", "_value"], "left").withColumn("_part", spread).drop("_parts")
    keyed = led.drop("_n").join(hot, ["_lead", "_value"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    holds = F.lit(True)
    for name, c in predicates.items():
        holds = holds & (F.col(name).isNull() | F.coalesce(F.array_contains(name, F.col(c)), F.lit(False)))
    met = asked.join(keyed, ["_lead", "_value", "_part"]).filter(holds)
    return met.select(*decisions.columns, *rules.columns)


def with_fallback(df: DataFrame, sidecars: Sequence[tuple[DataFrame, str]], *, value: str, default) -> DataFrame:
    """value from the first sidecar (unique by its key) that has it, else the default."""
    names = []
    for k, (side, key) in enumerate(sidecars):
        names.append(f"_v{k}")
        df = df.join(side.select(key, F.col(value).alias(f"_v{k}")), key, "left")
    return df.withColumn(value, F.coalesce(*names, F.lit(default))).drop(*names)
