"""Inventories, distributions, invariant gates and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import numbered, quantiles_by, running


def counts_by(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """The columns of all sets, grp (which set), n: several group-bys in one pass by grouping sets."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(
        F.count("*").alias("n"), F.grouping_id(*columns).alias("grouping")
    )
    return out


def value_shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def group_quantiles(df: DataFrame, keys: Sequence[str], outer: Sequence[str], at: Sequence[float]) -> DataFrame:
    """Two levels: rows per key, then quantiles of those counts per outer group."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return quantiles_by(per_key, outer, {f"p{round(100 * q)}": ("n_rows", q) for q in at}, [F.count("*").alias("n_keys")])


def normalisation(df: DataFrame, columns: Sequence[str], is_train: Column) -> DataFrame:
    """feature, n, mean, std (population; 0 becomes 1) over training rows."""
    rows = df.filter(is_train).select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("feature", "v"))
    std = F.stddev_pop("v")
    return rows.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """value, idx: distinct values numbered from 1 in sorted order."""
    return numbered(df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct(), ["value"], "idx")


def session_split(df: DataFrame, *, session: Sequence[str], ts: str, split) -> DataFrame:
    """Each session's split by its first time; split is a function of a time column."""
    return df.groupBy(*session).agg(F.min(ts).alias("start"), F.count("*").alias("n")).withColumn("split", split(F.col("start")))


def concentration(df: DataFrame, *, key: str, is_odd: Column, support: int) -> DataFrame:
    """key, n, n_odd, share_odd and share_of_all_odd for keys of at least `support` rows."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(is_odd).alias("n_odd"))
    total = F.sum("n_odd").over(W.partitionBy())
    out = out.withColumn("share_odd", F.col("n_odd") / F.col("n")).withColumn("share_of_all_odd", F.col("n_odd") / total)
    return out.filter(F.col("n") >= support)


def modes(df: DataFrame, *, group: str, value: str) -> DataFrame:
    """group, mode (the smallest of equals), mode_n, n, mode_share."""
    per = df.groupBy(group, value).agg(F.count("*").alias("n"))
    top = per.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.col("n").desc(), value)))
    return top.groupBy(group).agg(
        F.max(F.when(F.col("_r") == 1, F.col(value))).alias("mode"), F.max("n").alias("mode_n"), F.sum("n").alias("n")
    ).withColumn("mode_share", F.col("mode_n") / F.col("n"))


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    """bucket, n, pct."""
    n = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def top_and_bottom(df: DataFrame, *, by: str, tie: str, n: int) -> DataFrame:
    top = df.orderBy(F.col(by).desc(), tie).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy(F.col(by).asc(), tie).limit(n).withColumn("side", F.lit("bottom")))


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank of a column, from running totals of its values' counts."""
    counts = running(df.groupBy(column).agg(F.count("*").alias("_n")), [column], "_n", "_upto")
    return df.join(counts.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the rank correlation of two columns, over rows where both are known."""
    rows = df.select(a, b).dropna()
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def preset_sweep(df: DataFrame, *, components: Sequence[str], presets: dict[str, Sequence[float]], session: Sequence[str]) -> DataFrame:
    """preset, session..., total: sessions' summed rewards under each set of weights."""
    totals = df.groupBy(*session).agg(*(F.sum(c).alias(c) for c in components))
    each = F.array(*(F.struct(F.lit(n).alias("preset"), sum(F.col(c) * float(w) for c, w in zip(components, ws)).alias("total")) for n, ws in presets.items()))
    return totals.select(*session, F.inline(each))


def coverage_by(df: DataFrame, groups: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Share of non-null values per group."""
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNotNull().cast("double")).alias(f"cov_{c}") for c in columns))


def gates(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """gate, n_bad, rate, status: PASS while the share of violations is at most the limit. One pass over df."""
    sums = df.agg(F.count("*").alias("_n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{k}") for k, (c, _) in enumerate(checks.values())))
    rows = F.array(*(
        F.struct(F.lit(n).alias("gate"), F.col(f"_{k}").alias("n_bad"), (F.col(f"_{k}") / F.greatest("_n", F.lit(1))).alias("rate"),
                 F.when(F.col(f"_{k}") <= F.lit(limit) * F.col("_n"), "PASS").otherwise("FAIL").alias("status"))
        for k, (n, (_, limit)) in enumerate(checks.items())
    ))
    return sums.select(F.inline(rows))


def outlier_months(monthly: DataFrame, *, month: str, value: str, k: float = 3.0) -> DataFrame:
    """month, value, median, mad, is_outlier: beyond k robust deviations (1.4826 * MAD). monthly has a row per month."""
    whole = W.partitionBy()
    rows = monthly.select(month, value, F.median(value).over(whole).alias("median"))
    rows = rows.withColumn("mad", F.median(F.abs(F.col(value) - F.col("median"))).over(whole))
    return rows.withColumn("is_outlier", F.abs(F.col(value) - F.col("median")) > k * 1.4826 * F.col("mad"))


def block_digests(df: DataFrame, *, key: str, columns: Sequence[str], blocks: int = 4096) -> DataFrame:
    """block, n, digest: rows and the xor of row hashes of each block of keys; small enough to be kept beside a table's version."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")
    row = F.xxhash64(F.lit(1), key, *(x for c in columns for x in (F.col(c).isNull(), F.col(c))))
    return df.groupBy(block).agg(F.count("*").alias("n"), F.bit_xor(row).alias("digest"), F.sum(row.cast("decimal(38,0)")).alias("total"))


def version_diff(
    old: DataFrame, new: DataFrame, *, key: str, columns: Sequence[str], allowed: Column, blocks: int = 4096, old_digests: DataFrame | None = None, new_digests: DataFrame | None = None
) -> DataFrame:
    """column, n_changed, n_forbidden: changes of new against old, and those outside the allowed rows.

    Digests per block of keys are compared first, those given or newly made (one pass without a join); only rows of blocks that
    differ are joined. With both given and no change, neither table is read but for the empty rest. Keys are unique; rows
    without a partner in the other version are no changes.
    """
    settings = dict(key=key, columns=columns, blocks=blocks)
    a = old_digests if old_digests is not None else block_digests(old, **settings)
    b = new_digests if new_digests is not None else block_digests(new, **settings)
    same = a.join(b.toDF("block", "_n", "_digest", "_total"), "block", "full").withColumn("same", (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")) & (F.col("total") == F.col("_total")))
    changed_blocks = [r[0] for r in same.filter(~F.coalesce("same", F.lit(False))).select("block").collect()]  # at most `blocks` numbers
    inside = F.pmod(F.xxhash64(key), F.lit(blocks)).isin(changed_blocks) if len(changed_blocks) < blocks else F.lit(True)
    if not changed_blocks:
        inside = F.lit(False)
    both = old.filter(inside).select(key, *(F.col(c).alias(f"_o_{c}") for c in columns)).join(new.filter(inside), key)
    changed = {c: ~F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in columns}
    sums = both.agg(*(x for c, d in changed.items() for x in (F.count_if(d).alias(f"_a_{c}"), F.count_if(d & ~allowed).alias(f"_b_{c}"))))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("n_changed"), F.col(f"_b_{c}").alias("n_forbidden")) for c in columns))))


def expectations(measures: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """name, actual, expected, ok: one-row measures against (operator, value) pairs."""
    ops = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
    rows = [
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("actual"), F.lit(float(v)).alias("expected"), F.coalesce(ops[o](F.col(n), F.lit(v)), F.lit(False)).alias("ok"))
        for n, (o, v) in wanted.items()
    ]
    return measures.select(F.inline(F.array(*rows)))


def recomputed_mismatch(df: DataFrame, *, stored: str, again: Column, cause: Column) -> DataFrame:
    """cause, n, n_mismatch."""
    return df.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"), F.count_if(~F.col(stored).eqNullSafe(again)).alias("n_mismatch"))


def banned_fields(df: DataFrame, banned: Sequence[str]) -> list[str]:
    """Paths of schema fields, at any depth, that may not exist."""
    found = []

    def walk(kind, path):
        for f in getattr(kind, "fields", ()):
            if f.name in banned:
                found.append(f"{path}{f.name}")
            walk(f.dataType, f"{path}{f.name}.")
        if hasattr(kind, "elementType"):
            walk(kind.elementType, path)

    walk(df.schema, "")
    return found


def leak_checks(*, center_type: Column | None = None, center: Column | None = None, current: Column | None = None,
                token_ages: Column | None = None, outlook_ids: Column | None = None, focal: Column | None = None,
                focal_marks: Column | None = None, flag_source: Column | None = None, allowed_source: str = "") -> Column:
    """array<string> of the causality checks a snapshot breaks."""
    checks = []
    if center_type is not None:
        wrong = (center_type != "track") | (current.isNotNull() & ~center.eqNullSafe(current))
        checks.append(("subgraph_center", wrong))
    if token_ages is not None:
        checks.append(("temporal_causality", F.exists(token_ages, lambda a: a < 0)))
    if outlook_ids is not None:
        checks.append(("schedule_outlook", F.array_contains(outlook_ids, focal)))
    if focal_marks is not None:
        checks.append(("one_focal_train", F.size(F.filter(focal_marks, lambda m: m)) != 1))
    if flag_source is not None:
        checks.append(("flags_source", flag_source != allowed_source))
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks)))


#: Fields that a node of each kind may not have, and that an outlook row may not have.
NODE_MARKS = {
    "signal": ("is_focal_signal", "is_focal", "is_focal_node"),
    "route": ("is_focal_route", "is_focal", "is_focal_node", "is_chosen"),
    "track": ("is_focal_track",),
}
OUTLOOK_SIGNALS = ("planned_end_signal", "planned_signal")
FLAG_SOURCES = ("planned_platform", "current_platform", "both")
PLATFORMS = (1, 7)
CHECKS = ("subgraph_center", "no_focal_graph_flags", "banned_fields", "schedule_outlook", "flags_source", "temporal_causality", "one_focal_train")


def snapshot_violations(
    df: DataFrame, *, center: str, current: Column, nodes: dict[str, str], tokens: str, age: str, outlook: str, platform: str, flags_source: Column, trains: str,
    is_focal: str = "is_focal", banned: Sequence[str] = (), skip: Sequence[str] = (),
) -> Column:
    """array<string>: which of the seven causality checks (CHECKS, but for those in skip) a snapshot breaks, in that order.

    center: a struct (type, id), to be the train's current track; nodes: kind to array column; tokens with an age that may not be
    below 0; an outlook whose platforms are whole numbers in PLATFORMS and that names no signal; trains of which one is focal. Marks,
    banned names and a platform of another type are faults of the schema, so of every row. A null array or value breaks nothing,
    but for the one focal train, which must be there.
    """
    kind = {c: df.schema[c].dataType.elementType for c in [*nodes.values(), outlook]}
    state = df.select(center, *nodes.values(), tokens, outlook, trains)
    marked = any(set(NODE_MARKS.get(k, ())) & set(kind[c].names) for k, c in nodes.items())
    named = bool(set(OUTLOOK_SIGNALS) & set(kind[outlook].names))
    whole = kind[outlook][platform].dataType.typeName() in ("byte", "short", "integer", "long") if platform in kind[outlook].names else True
    outside = F.exists(outlook, lambda o: ~o[platform].between(*PLATFORMS)) if whole and platform in kind[outlook].names else F.lit(not whole)
    wrong = {
        "subgraph_center": ~F.col(center)["type"].eqNullSafe(F.lit("track")) | (current.isNotNull() & ~F.col(center)["id"].eqNullSafe(current)),
        "no_focal_graph_flags": F.lit(marked),
        "banned_fields": F.lit(bool(banned_fields(state, banned))),
        "schedule_outlook": F.lit(named) | F.coalesce(outside, F.lit(False)),
        "flags_source": ~flags_source.isin(*FLAG_SOURCES),
        "temporal_causality": F.exists(tokens, lambda t: t[age] < 0),
        "one_focal_train": F.coalesce(F.size(F.filter(trains, lambda t: F.coalesce(t[is_focal], F.lit(False)))), F.lit(0)) != 1,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(wrong[c], F.lit(False)), F.lit(c)) for c in CHECKS if c not in skip)))


def leak_report(df: DataFrame, violations: Column, *, key: str, per_group: Sequence[str] = (), sample: int | None = None, seed: int = 42, examples: int = 3) -> DataFrame:
    """check, n_rows, n_bad, share, examples: one row for each of CHECKS, over all rows or a seeded sample per group (full or sampled
    audit); examples: the least keys that break the check."""
    from .choice import sample_per_group

    rows = df if sample is None else sample_per_group(df, group=per_group, key=[key], n=sample, seed=seed)
    audited = rows.select(key, violations.alias("_v"))
    total = audited.agg(F.count("*").alias("n_rows"))
    bad = audited.select(key, F.explode("_v").alias("check"))
    least = W.partitionBy("check").orderBy(key)
    few = bad.withColumn("_k", F.row_number().over(least)).filter(F.col("_k") <= examples).groupBy("check").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    counts = bad.groupBy("check").agg(F.count("*").alias("n_bad"))
    names = total.select("n_rows", F.explode(F.array(*map(F.lit, CHECKS))).alias("check"))
    out = names.join(counts, "check", "left").join(few, "check", "left").fillna({"n_bad": 0})
    return out.select("check", "n_rows", "n_bad", (F.col("n_bad") / F.greatest("n_rows", F.lit(1))).alias("share"), F.coalesce("examples", F.array().cast(few.schema["examples"].dataType)).alias("examples"))


def assert_no_leak(df: DataFrame, violations: Column) -> None:
    """Raises on the first row with violations."""
    bad = df.select(violations.alias("v")).filter(F.size("v") > 0).take(1)
    if bad:
        raise ValueError(f"leak: {', '.join(bad[0]['v'])}")
