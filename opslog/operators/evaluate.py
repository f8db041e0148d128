"""Metrics, rule compliance, overrides, bootstrap intervals and run summaries over tables of predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import quantiles


def _metrics(truth: str, predicted: str) -> list[Column]:
    hit = F.col(truth) == F.col(predicted)
    is_set, says_wait = F.col(truth) > 0, F.col(predicted) == 0
    mean = lambda c, where=None: F.avg(F.when(where, c.cast("double")) if where is not None else c.cast("double"))
    return [
        F.count("*").alias("n"), mean(hit).alias("top1"), mean(hit, is_set).alias("top1_set"),
        mean(~is_set, says_wait).alias("wait_precision"), mean(says_wait, ~is_set).alias("wait_recall"),
        mean(says_wait).alias("wait_rate_predicted"), mean(~is_set).alias("wait_rate_true"),
    ]


def metrics(df: DataFrame, *, truth: str, predicted: str) -> DataFrame:
    """One row; action 0 is wait."""
    return df.agg(*_metrics(truth, predicted))


def metrics_by(df: DataFrame, *, stratum: str, truth: str, predicted: str) -> DataFrame:
    """Per stratum and overall (null stratum named 'overall'), in one pass by rollup."""
    out = df.rollup(stratum).agg(*_metrics(truth, predicted), F.grouping(stratum).alias("_g"))
    return out.withColumn(stratum, F.when(F.col("_g") == 1, "overall").otherwise(F.col(stratum))).drop("_g")


def margins(df: DataFrame, *, best: str, other: str) -> DataFrame:
    """One row: n, mean, p5, p95 and the share at or above 0 of best - other."""
    gap = df.select((F.col(best) - F.col(other)).alias("g"))
    sums = gap.agg(F.count("g").alias("n"), F.avg("g").alias("mean"), F.avg((F.col("g") >= 0).cast("double")).alias("share_ok"))
    return sums.join(F.broadcast(quantiles(gap, {"p5": ("g", 0.05), "p95": ("g", 0.95)}))).select("n", "mean", "p5", "p95", "share_ok")  # one row each


def baselines(df: DataFrame, *, n_options: str, chosen_index: str, preferred_index: str) -> DataFrame:
    """One row: expected accuracy of a uniform choice, of the preferred option (else the first), of the first option, and of
    always taking the most common index."""
    rows = df.filter(F.col(chosen_index) > 0)
    first, preferred = F.col(chosen_index) == 1, F.col(chosen_index) == F.coalesce(F.col(preferred_index), F.lit(1))
    sums = rows.agg(
        F.count("*").alias("n"), F.avg(1 / F.greatest(F.col(n_options), F.lit(1))).alias("uniform"),
        F.avg(preferred.cast("double")).alias("preferred"), F.avg(first.cast("double")).alias("first"),
    )
    common = rows.groupBy(chosen_index).agg(F.count("*").alias("_c")).agg((F.max("_c") / F.sum("_c")).alias("majority"))
    return sums.crossJoin(common)  # one row each


def platform_verdict(platform: Column, preferred: Column, options: Column) -> Column:
    """Against a set of acceptable platforms, given those of the other candidates."""
    return (
        F.when(platform.isNull(), "undetermined").when(F.array_contains(preferred, platform), "compliant")
        .when(F.arrays_overlap(preferred, F.filter(options, lambda p: p.isNotNull())), "non-compliant")
        .otherwise("preferred-unavailable")
    )


def route_verdict(route: Column, preferred: Column, acceptable: Column, options: Column) -> Column:
    """Against one preferred route; a sanctioned alternative is right only while the preferred one is not on offer."""
    return (
        F.when(route == preferred, "compliant").when(F.array_contains(options, preferred), "non-compliant")
        .when(F.array_contains(acceptable, route), "compliant").otherwise("preferred-unavailable")
    )


def compliance(matched: DataFrame, *, decision: str, kind: str, specificity: str, verdict: Column, rule: str) -> DataFrame:
    """decision, hard_status, rule: the verdict of the rule that ranks first: route choices, then the smallest set."""
    order = W.partitionBy(decision).orderBy((F.col(kind) != "route_choice").cast("int"), specificity, rule)
    ranked = matched.withColumn("hard_status", verdict).withColumn("_k", F.row_number().over(order))
    return ranked.filter("_k = 1").select(decision, "hard_status", rule)


def soft_conflict(matched: DataFrame, *, decision: str, platforms: str) -> DataFrame:
    """decision, n_soft, conflict, accepted: conflict if two of the sets share nothing, else their union is accepted."""
    sets = matched.groupBy(decision).agg(F.count("*").alias("n_soft"), F.collect_list(platforms).alias("_s"))
    clash = F.exists("_s", lambda a: F.exists("_s", lambda b: ~F.arrays_overlap(a, b)))
    union = F.array_sort(F.array_distinct(F.flatten("_s")))
    return sets.select(decision, "n_soft", clash.alias("conflict"), union.alias("accepted"))


def status_rollup(df: DataFrame, *, group: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Counts per group and overall of each status, and the compliant share of rendered verdicts."""
    counts = [F.count_if(F.col(status) == s).alias(s.replace("-", "_")) for s in statuses]
    out = df.rollup(group).agg(F.count("*").alias("n"), *counts, F.grouping(group).alias("_g"))
    out = out.withColumn(group, F.when(F.col("_g") == 1, "overall").otherwise(F.col(group))).drop("_g")
    rendered = F.col("compliant") + F.col("non_compliant")
    return out.withColumn("compliant_rate", F.when(rendered > 0, F.col("compliant") / rendered))


def override_sweep(
    df: DataFrame, *, human: str, model: str, faithfulness: str, delta: str, status: str, deltas: Sequence[float], least_faithful: float
) -> DataFrame:
    """delta_min, mode, verdict, n over a grid of thresholds and modes: agreement, consider or silent."""
    grid = F.array(*(F.struct(F.lit(float(d)).alias("delta_min"), F.lit(m).alias("mode")) for d in deltas for m in ("refined", "literal")))
    rows = df.select("*", F.inline(grid))
    by_rule = F.when(F.col("mode") == "literal", F.col(status) == "compliant").otherwise(F.col(status) != "non-compliant")
    pass_all = (F.col(delta) > F.col("delta_min")) & by_rule & (F.col(faithfulness) > least_faithful)
    verdict = F.when(F.col(human) == F.col(model), "agreement").when(F.coalesce(pass_all, F.lit(False)), "consider").otherwise("silent")
    return rows.groupBy("delta_min", "mode", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def divergence(df: DataFrame, *, safe: str, change: str, tolerance: float) -> DataFrame:
    """kind, n, share: unsafe, indeterminate, improving, worse or neutral by given outcome columns."""
    kind = (
        F.when(F.col(safe).isNull() | F.col(change).isNull(), "indeterminate").when(~F.col(safe), "unsafe")
        .when(F.col(change) > tolerance, "improving").when(F.col(change) < -tolerance, "worse").otherwise("neutral")
    )
    n = df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def across_runs(runs: DataFrame, *, run: str, columns: Sequence[str], sample_std: bool = False) -> DataFrame:
    """metric, n, mean, std, min, max over runs (population std unless asked otherwise)."""
    std = F.stddev_samp if sample_std else F.stddev_pop
    long = runs.unpivot([run], list(columns), "metric", "value")
    return long.groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), std("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def run_summary(log: DataFrame, *, run: str, step: str, score: str, gate: float) -> DataFrame:
    """run, last_step, last_score, best_step, best_score, passed."""
    return log.groupBy(run).agg(
        F.max(step).alias("last_step"), F.max_by(score, step).alias("last_score"),
        F.max_by(F.col(step), F.struct(F.col(score), -F.col(step))).alias("best_step"), F.max(score).alias("best_score"),
        (F.max(score) >= gate).alias("passed"),
    )


def phase_gates(log: DataFrame, *, run: str, phase: str, score: str, gates: dict[str, float]) -> DataFrame:
    """run, phase, best_score, gate, passed: each run's best score in every phase against the phase's gate."""
    limit = F.try_element_at(F.create_map(*(F.lit(x) for p in gates.items() for x in p)), F.col(phase))
    best = log.groupBy(run, phase).agg(F.max(score).alias("best_score"))
    return best.withColumn("gate", limit).withColumn("passed", F.coalesce(F.col("best_score") >= F.col("gate"), F.lit(True)))


def with_interval(across: DataFrame, z: float = 1.96) -> DataFrame:
    """across_runs of sample deviations with low and high: mean -+ z deviations over the root of the number of runs."""
    half = F.lit(z) * F.col("std") / F.sqrt("n")
    return across.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def digest(*parts: Column) -> Column:
    """The md5 of the columns as text, which every engine has: draws are read from its first 12 hex digits."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends only on the given columns."""
    return (F.conv(F.substring(digest(*parts), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson_of(drawn: Column) -> Column:
    """The Poisson(1) draw of a digest: how many steps of the distribution are at or below its uniform.

    Steps are compared as hex digits, which order as the numbers do, so a draw needs no conversion, and the first step above the
    uniform ends it, so most draws take two comparisons. drawn should be a column, not an expression to evaluate again.
    """
    out, total, term = None, 0.0, math.exp(-1)
    for k in range(12):
        total += term
        below = drawn < f"{math.ceil(total * (1 << 48) - 0.5):012x}"
        out = F.when(below, k) if out is None else out.when(below, k)
        term /= k + 1
    return out.otherwise(12)


def poisson_weight(*parts: Column) -> Column:
    """A Poisson(1) draw that depends only on the given columns."""
    return poisson_of(digest(*parts))


def bootstrap(df: DataFrame, *, cluster: Sequence[str], value: str, replicates: int = 200, seed: int = 7, level: float = 0.95, strata: Sequence[str] = ()) -> DataFrame:
    """strata..., estimate, low, high of the mean of value by a cluster bootstrap.

    Rows are summed per cluster first; each replicate weighs clusters by Poisson(1) draws, all replicates in one grouped
    pass. With a cluster per row this is the plain bootstrap; for a paired one, value is the difference. A draw does not depend on
    the stratum, so the sums of a cluster's strata travel together, and it is made once for all of them.
    """
    sums = df.groupBy(*strata, *cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    parts = F.collect_list(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(strata)), "_s", "_n"))
    shared = bool(strata) and not set(strata) & set(cluster)
    drawn = sums.groupBy(*cluster).agg(parts.alias("_parts")) if shared else sums
    drawn = drawn.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("_d", digest(F.lit(seed), F.col("_b"), *(F.col(c) for c in cluster))).withColumn("_w", poisson_of(F.col("_d")))
    if shared:
        one = drawn.select("_b", "_w", F.explode("_parts").alias("_p"))
        drawn = one.select("_b", "_w", *(F.col("_p")[f"k{i}"].alias(c) for i, c in enumerate(strata)), "_p._s", "_p._n")
    means = drawn.groupBy(*strata, "_b").agg(
        (F.sum(F.col("_w") * F.col("_s")) / F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0))).alias("_m"),
        (F.sum("_s") / F.sum("_n")).alias("_e"),
    )
    tail = (1 - level) / 2
    return means.groupBy(*strata).agg(F.first("_e").alias("estimate"), F.percentile("_m", tail).alias("low"), F.percentile("_m", 1 - tail).alias("high"))


def component_difference(df: DataFrame, *, pairs: dict[str, tuple[str, str]], total: tuple[str, str]) -> DataFrame:
    """component, difference for each (new, old) pair of columns; residual = total difference minus their sum."""
    diffs = df.agg(*(F.avg(F.col(a) - F.col(b)).alias(n) for n, (a, b) in pairs.items()), F.avg(F.col(total[0]) - F.col(total[1])).alias("_t"))
    rest = F.col("_t") - sum(F.col(n) for n in pairs)
    rows = [F.struct(F.lit(n).alias("component"), F.col(n).alias("difference")) for n in pairs]
    return diffs.select(F.inline(F.array(*rows, F.struct(F.lit("residual").alias("component"), rest.alias("difference")))))


def attribution_rollup(df: DataFrame, *, decision: str, key: str, weight: str, k: int) -> DataFrame:
    """key, n_top, mean_weight, coverage: how often a key is among a decision's k heaviest."""
    order = W.partitionBy(decision).orderBy(F.col(weight).desc(), key)
    top = df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k)
    per = top.groupBy(key).agg(F.count("*").alias("n_top"), F.avg(weight).alias("mean_weight"))
    total = df.agg(F.count_distinct(decision).alias("_d"))
    return per.crossJoin(total).select(key, "n_top", "mean_weight", (F.col("n_top") / F.col("_d")).alias("coverage"))  # one row


def faithfulness(actual: Column, predicted: Column) -> Column:
    """1 - |actual - predicted| / |predicted|, null for a prediction of 0."""
    return 1 - F.abs(actual - predicted) / F.nullif(F.abs(predicted), F.lit(0.0))
