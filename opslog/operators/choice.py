"""Sampling by hash, conditional-logit estimation and Shapley values as grouped sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import stored
from .evaluate import digest, hashed_uniform, poisson_of


def sample_rows(df: DataFrame, *, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows by the order of a seeded hash of their key: the same ones every time."""
    return df.orderBy(hashed_uniform(F.lit(seed), *(F.col(c) for c in key)), *key).limit(n)


def _least_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread: Column) -> DataFrame:
    """The n first rows of each group by order: first of each of 64 parts of it, then of what those keep, so a group that holds
    all rows is sorted in 64 tasks, and 64 n rows of it in one."""
    first = W.partitionBy(*group, F.pmod(spread, F.lit(64))).orderBy(*order)
    few = df.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= n)
    return few.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def sample_per_group(df: DataFrame, *, group: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows of each group, or all if it has fewer, by the order of a seeded hash of their key."""
    keys = [F.col(c) for c in key]
    return _least_per_group(df, group, [hashed_uniform(F.lit(seed), *keys), *keys], n, F.xxhash64(*keys))


def sample_weighted(df: DataFrame, *, group: Sequence[str], key: Sequence[str], weight: str, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement, drawn in turn with chances in proportion to weight, by exponential keys: the
    least -ln(u) / weight. Rows whose weight is null or not over 0 are never drawn."""
    keys = [F.col(c) for c in key]
    at = -F.ln(F.greatest(hashed_uniform(F.lit(seed), *keys), F.lit(1e-300))) / F.col(weight)
    return _least_per_group(df.filter(F.col(weight) > 0), group, [at, *keys], n, F.xxhash64(*keys))


#: Strata whose means are broadcast; with more of them they are joined by a shuffle.
FEW_STRATA = 100_000


def resample_balanced(df: DataFrame, *, stratum: str, key: Sequence[str], seed: int) -> DataFrame:
    """Rows with replacement, weights 1/sqrt(stratum share): as many in expectation as before."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(W.partitionBy())
    weight = F.sqrt(total / F.col("_n"))
    scaled = counts.select(stratum, weight.alias("_w"), "_n", total.alias("_all")).withColumn("_sum", F.sum(F.col("_w") * F.col("_n")).over(W.partitionBy()))
    mean = scaled.select(stratum, (F.col("_all") * F.col("_w") / F.col("_sum")).alias("_mean"))
    whole = F.floor("_mean").cast("int")
    u = hashed_uniform(F.lit(seed), *(F.col(c) for c in key))
    digests = F.transform(F.sequence(F.lit(0), whole), lambda i: digest(F.lit(seed), i, *(F.col(c) for c in key)))
    # one Poisson(1) draw per whole unit of the mean and one with the rest as its chance
    times = F.aggregate(
        F.transform(digests, lambda h, i: F.when(i < whole, poisson_of(h)).otherwise((u < F.col("_mean") - whole).cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    few = counts.count() <= FEW_STRATA
    joined = df.join(F.broadcast(mean) if few else mean, stratum).withColumn("_times", times).filter("_times > 0")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_mean", "_times")


def design(df: DataFrame, *, decision: Sequence[str], columns: Sequence[str], chosen: str, weight: str | None = None, cluster: Sequence[str] = (), replicates: int = 0, seed: int = 7, subsets: Sequence[Column] = ()) -> DataFrame:
    """One row for each decision, stored: rows (chosen, features) of its alternatives and its weights, the own one first and
    then one for each bootstrap replicate: a Poisson(1) draw of its cluster times the own one; then one for each subset: the own one
    where its condition holds for a row of the decision, else 0. Every later pass reads this table only."""
    row = F.struct(F.col(chosen).cast("double").alias("y"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    own = F.max(weight).cast("double") if weight else F.lit(1.0)
    per = df.groupBy(*dict.fromkeys([*decision, *cluster])).agg(F.array_sort(F.collect_list(row)).alias("rows"), own.alias("own"), *(F.max(F.coalesce(c, F.lit(False))).alias(f"in_{k}") for k, c in enumerate(subsets)))
    weights = F.array("own")
    if replicates:
        digests = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda b: digest(F.lit(seed), b, *(F.col(c) for c in cluster)))
        weights = F.concat(weights, F.transform(digests, lambda h: F.col("own") * poisson_of(h)))
    if subsets:
        weights = F.concat(weights, F.array(*(F.when(F.col(f"in_{k}"), F.col("own")).otherwise(0.0) for k in range(len(subsets)))))
    return stored(per.select("rows", weights.alias("weights")), "design")


def _pass(table: DataFrame, w: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood [b], gradient [b, k] and Hessian [b, k, k] for each row of w, under the weights from `first` on.

    Tasks send these sums only; a batch of decisions is a few matrix products.
    """
    n, k = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, 1 + k + k * k))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0)
            flat, starts = rows.flatten(), rows.offsets.to_numpy()[:-1] - rows.offsets[0].as_py()
            y = flat.field("y").to_numpy(zero_copy_only=False)
            x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), k)
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, first : first + n]
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)]))
            u = x @ w.T
            e = np.exp(u - np.maximum.reduceat(u, starts)[of])
            p = e / np.add.reduceat(e, starts)[of]
            total[:, 0] += (own[of] * np.where(y[:, None] == 1, np.log(p), 0)).sum(axis=0)
            total[:, 1 : 1 + k] += ((y[:, None] - p) * own[of]).T @ x
            for b in range(n):
                px = p[:, b : b + 1] * x
                mean = np.add.reduceat(px, starts)
                h = (px * own[of, b : b + 1]).T @ x - (mean * own[:, b : b + 1]).T @ mean
                total[b, 1 + k :] += h.reshape(-1)
        b, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(b.reshape(-1)), pa.array(i.reshape(-1)), pa.array(total.reshape(-1))], names=["b", "i", "v"])

    sums = table.mapInArrow(run, "b long, i long, v double").groupBy("b", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((n, 1 + k + k * k))
    out[sums.column(0).to_numpy(), sums.column(1).to_numpy()] = sums.column(2).to_numpy()
    return out[:, 0], out[:, 1 : 1 + k], out[:, 1 + k :].reshape(n, k, k)


def _fit(table: DataFrame, n: int, k: int, first: int, l2: float, rounds: int, tolerance: float) -> np.ndarray:
    """Damped Newton steps for n sets of weights at once: a pass serves all of them, each with a step length of its own."""
    w = np.zeros((n, k))
    goal = lambda ll, w: ll - 0.5 * l2 * (w * w).sum(axis=1)
    ll, grad, hess = _pass(table, w, first)
    at, active = goal(ll, w), np.ones(n, bool)
    for _ in range(rounds):
        step = np.stack([np.linalg.solve(h + l2 * np.eye(k), g - l2 * x) if k else x for h, g, x in zip(hess, grad, w)])
        scale = active.astype(float)
        while True:
            new = w + scale[:, None] * step
            ll, g, h = _pass(table, new, first)
            worse = active & (scale > 0) & ~(goal(ll, new) >= at - 1e-12 * np.maximum(1.0, np.abs(at)))
            if not worse.any():
                break
            scale[worse] = np.where(scale[worse] > 1e-4, scale[worse] / 2, 0.0)
        gain = goal(ll, new) - at
        w, grad, hess, at = new, g, h, goal(ll, new)
        active &= gain >= tolerance * np.maximum(1.0, np.abs(at))
        if not active.any():
            break
    return w


def fit_choice(df: DataFrame, *, decision: Sequence[str], columns: Sequence[str], chosen: str, l2: float = 1e-3, rounds: int = 20, weight: str | None = None, tolerance: float = 1e-8) -> dict[str, float]:
    """Conditional logit by damped Newton steps. Only K + K^2 sums reach the driver each round."""
    table = design(df, decision=decision, columns=columns, chosen=chosen, weight=weight)
    return dict(zip(columns, _fit(table, 1, len(columns), 0, l2, rounds, tolerance)[0].tolist()))


def bootstrap_choice(df: DataFrame, *, decision: Sequence[str], columns: Sequence[str], chosen: str, cluster: Sequence[str], replicates: int, seed: int = 7, weight: str | None = None, l2: float = 1e-3, rounds: int = 20, tolerance: float = 1e-8) -> list[dict[str, float]]:
    """Fits under Poisson(1) cluster weights, one per replicate, all of them in the same passes."""
    table = design(df, decision=decision, columns=columns, chosen=chosen, weight=weight, cluster=cluster, replicates=replicates, seed=seed)
    return [dict(zip(columns, w)) for w in _fit(table, replicates, len(columns), 1, l2, rounds, tolerance).tolist()]


def fit_subsets(df: DataFrame, *, decision: Sequence[str], columns: Sequence[str], chosen: str, subsets: dict[str, Column], weight: str | None = None, l2: float = 1e-3, rounds: int = 20, tolerance: float = 1e-8) -> dict[str, dict[str, float]]:
    """A fit for each subset of decisions, all of them in the same passes over one table. A subset without decisions needs l2 > 0."""
    table = design(df, decision=decision, columns=columns, chosen=chosen, weight=weight, subsets=list(subsets.values()))
    fitted = _fit(table, len(subsets), len(columns), 1, l2, rounds, tolerance).tolist() if subsets else []
    return {name: dict(zip(columns, w)) for name, w in zip(subsets, fitted)}


def subset_rows(df: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """The rows of each named condition, with the subset's name: designs that overlap are made in one pass."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in subsets.items())))
    return df.withColumn("subset", F.explode(names))


def normalised(weights: dict[str, float], by: str = "l1") -> dict[str, float]:
    size = sum(map(abs, weights.values())) if by == "l1" else max(map(abs, weights.values()), default=0)
    return {n: v / size if size else 0.0 for n, v in weights.items()}


def chosen_means(df: DataFrame, *, columns: Sequence[str], chosen: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., feature, mean_chosen, mean_other."""
    long = df.unpivot([*by, chosen], list(columns), "feature", "value")
    mean = lambda k: F.avg(F.when(F.col(chosen) == k, F.col("value")))
    return long.groupBy(*by, "feature").agg(mean(1).alias("mean_chosen"), mean(0).alias("mean_other"))


def shapley(values: DataFrame, *, game: Sequence[str], mask: str, value: str, players: int) -> DataFrame:
    """game..., player, phi from a complete table of coalition values (mask: bit i set if player i is in).

    Each coalition meets itself plus one player: an equi-join, weighted by |S|! (n-|S|-1)! / n!.
    """
    from math import factorial

    weights = [factorial(s) * factorial(players - s - 1) / factorial(players) for s in range(players)]
    w = F.array(*(F.lit(x) for x in weights))
    small = values.select(*game, F.col(mask).alias("_s"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(players - 1))).alias("player"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("player")).cast("long")
    small = small.filter(F.col("_s").bitwiseAND(bit) == 0).withColumn("_t", F.col("_s").bitwiseOR(bit))
    big = values.select(*game, F.col(mask).cast("long").alias("_t"), F.col(value).alias("_v2"))
    both = small.join(big, [*game, "_t"])
    return both.groupBy(*game, "player").agg(F.sum(F.get(w, F.bit_count("_s")) * (F.col("_v2") - F.col("_v"))).alias("phi"))
