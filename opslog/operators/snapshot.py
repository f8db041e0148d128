"""Nested decision snapshots: every part is a flat table keyed by the decision, nested and joined at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import as_of, state_at
from .ranks import quantiles_by
from .windows import window_stats


def centers(decisions: DataFrame, positions: DataFrame, *, key: str, ts: str, element: str, bin_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions with their train's current element, and the skipped ones that have none, with the reason."""
    located = as_of(decisions, positions, keys=[key], probe_ts=ts, event_ts="ts", values={"center": F.col(element)}, null_values=False, bin_s=bin_s)
    return located.filter("center IS NOT NULL"), located.filter("center IS NULL").drop("center").withColumn("reason", F.lit("no_center"))


def nested(rows: DataFrame, *, key: str, name: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """key, name, n_name: the rows of each key as an array of structs in a fixed order."""
    row = F.struct(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.struct(*columns).alias("_v"))  # flat, as structs inside are slow to compare
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["_v"])
    return rows.groupBy(key).agg(listed.alias(name)).withColumn(f"n_{name}", F.size(name))


def element_nodes(
    asked: DataFrame, events: DataFrame, *, key: str, element: str, ts: str, event_ts: str, state: str, windows_s: Sequence[int], static: DataFrame | None = None,
    train: str | None = None, bin_s: int | None = None,
) -> DataFrame:
    """asked (key, element, ts, ...) with the element's state, its window shares and changes, and static columns.

    One row per decision and element of its subgraph; serves tracks and signals alike. train: a column of events; occupier is then the
    train of the element's last event if that occupied it. State, occupier and windows come from one sort.
    """
    now = {"state": state, **({"occupier": train} if train else {})}
    rows = window_stats(asked, events, key=element, probe_id=key, probe_ts=ts, event_ts=event_ts, state=state, windows_s=windows_s, now=now, bin_s=bin_s).fillna({"state": 0})
    if train:
        rows = rows.withColumn("occupier", F.when(F.col("state") == 1, F.col("occupier")))
    return rows if static is None else rows.join(static, element, "left")


def on_paths(nodes: DataFrame, paths: DataFrame, *, key: str, element: str, name: str = "on_path") -> DataFrame:
    """nodes with a flag: whether the element lies on a path of its decision, or of its centre, whose column is then the key (paths: key, elements;
    any number a key)."""
    parts = paths.select(key, F.explode("elements").alias(element)).distinct().withColumn(name, F.lit(True))
    return nodes.join(parts, [key, element], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def train_nodes(asked: DataFrame, *, key: str, focal: str, train: str, columns: Sequence[str], cap: int) -> DataFrame:
    """key, trains: the focal train first, then the others by id, `cap` at most, each with is_focal."""
    rows = asked.withColumn("is_focal", F.col(train) == F.col(focal)).withColumn("_late", (~F.col("is_focal")).cast("int"))
    out = nested(rows, key=key, name="trains", columns=[train, "is_focal", *columns], order=["_late", train])
    return out.withColumn("trains", F.slice("trains", 1, cap)).withColumn("n_trains", F.size("trains"))


def other_trains(occupiers: DataFrame, *, key: str, train: str, focal: str, cap: int) -> DataFrame:
    """key, others: distinct occupiers of the subgraph but the focal train, sorted, `cap` at most."""
    real = occupiers.filter(F.col(train).isNotNull() & (F.col(train) != F.col(focal)))
    return real.groupBy(key).agg(F.slice(F.sort_array(F.collect_set(train)), 1, cap).alias("others"))


def assemble(decisions: DataFrame, parts: Sequence[DataFrame], *, key: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The decisions with every part (unique by key) joined on; missing parts take the defaults.

    All joins are on the one key, so the decisions are shuffled once.
    """
    for part in parts:
        decisions = decisions.join(part, key, "left")
    return decisions.withColumns({c: F.coalesce(F.col(c), v) for c, v in (defaults or {}).items()})


def route_nodes(asked: DataFrame, locks: DataFrame, occupancy: DataFrame, *, key: str, route: str, element: str, ts: str, event_ts: str, state: str, bin_s: int | None = None) -> DataFrame:
    """asked (key, route, ts, elements) with locked, the route's own state, and n_occupied of its elements, both as of ts. Elements
    without any event are free, and are not looked up."""
    rows = state_at(asked, locks, key=route, probe_ts=ts, event_ts=event_ts, state=state, default=0, bin_s=bin_s).withColumnRenamed("state", "locked")
    parts = rows.select(key, route, ts, F.explode("elements").alias(element)).join(occupancy.select(element).distinct(), element, "left_semi")
    on = state_at(parts, occupancy, key=element, probe_ts=ts, event_ts=event_ts, state=state, default=0, bin_s=bin_s)
    return rows.join(on.groupBy(key, route).agg(F.count_if(F.col("state") == 1).alias("n_occupied")), [key, route], "left").fillna({"n_occupied": 0})


def flag_inputs(candidates: DataFrame, occupancy: DataFrame, *, key: str, route: str, first: str, platform: str, cls: str, ts: str, event_ts: str, state: str, train: str, element: str, bin_s: int | None = None) -> DataFrame:
    """key, occupiers, options: of each decision's candidates (key, route, first, platform, cls, ts) the trains on their first
    elements, and (cls, platform_occupied) structs, both in the order of routes. An element counts as held by its last event's train
    if that occupied it."""
    kw = dict(keys=[element], probe_ts=ts, event_ts=event_ts, bin_s=bin_s)
    hit = as_of(candidates.withColumn(element, F.col(first)), occupancy, values={"_st": F.col(state), "_train": F.col(train)}, **kw)
    holder = F.when(F.col("_st") == 1, F.col("_train"))
    there = as_of(hit.withColumn("_own", holder).withColumn(element, F.col(platform)), occupancy, values={"_pst": F.col(state)}, **kw)
    row = F.struct(F.col(route).alias("r"), F.col("_own").alias("o"), F.col(cls).alias("cls"), F.coalesce(F.col("_pst") == 1, F.lit(False)).alias("platform_occupied"))
    listed = there.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_l"))
    return listed.select(key, F.transform("_l", lambda x: x["o"]).alias("occupiers"), F.transform("_l", lambda x: F.struct(x["cls"].alias("cls"), x["platform_occupied"].alias("platform_occupied"))).alias("options"))


def dynamic_edges(positions: DataFrame, berths: DataFrame, nodes: DataFrame, *, key: str, train: str, element: str, signal: str) -> DataFrame:
    """key, kind, src, dst: each train to its current element and to the signal whose berth it holds, as far as those are nodes
    of the decision's subgraph. positions: key, train, element; berths: key, signal, train; nodes: key, node."""
    there = nodes.select(key, F.col("node"))
    at = positions.filter(F.col(element).isNotNull()).select(key, F.lit("at").alias("kind"), F.col(train).alias("src"), F.col(element).alias("dst"))
    held = berths.filter(F.col(train).isNotNull()).select(key, F.lit("holds").alias("kind"), F.col(train).alias("src"), F.col(signal).alias("dst"))
    return at.unionByName(held).join(there.withColumnRenamed("node", "dst"), [key, "dst"], "left_semi").select(key, "kind", "src", "dst").distinct()


def value_audit(df: DataFrame, *, lists: dict[str, str], flags: Sequence[str] = ()) -> DataFrame:
    """part, n, n_null, min_size, max_size, mean_size, mean_value: sizes of nested lists and the mean of one number in them (lists: column
    to field), and for flags the share that is true as mean_value."""
    out = None
    for c, f in lists.items():
        size = F.size(c)
        values = F.aggregate(F.transform(c, lambda x: F.coalesce(x[f].cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        part = df.agg(
            F.lit(c).alias("part"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.min(size).cast("long").alias("min_size"),
            F.max(size).cast("long").alias("max_size"), F.avg(size).alias("mean_size"), (F.sum(values) / F.nullif(F.sum(size), F.lit(0))).alias("mean_value"),
        )
        out = part if out is None else out.unionByName(part)
    for c in flags:
        part = df.agg(F.lit(c).alias("part"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), *(F.lit(None).cast(t).alias(n) for n, t in (("min_size", "long"), ("max_size", "long"), ("mean_size", "double"))), F.avg(F.col(c).cast("double")).alias("mean_value"))
        out = part if out is None else out.unionByName(part)
    return out


def value_quantiles(df: DataFrame, *, lists: dict[str, str], shares: Sequence[float]) -> DataFrame:
    """part, n, q_<percent>...: exact, linearly interpolated quantiles of a number in nested lists (lists: column to field). Values
    are counted and ranked by running totals, so no task holds a list's values of all rows."""
    rows = None
    for c, f in lists.items():
        part = df.select(F.lit(c).alias("part"), F.explode(c).alias("_x")).select("part", F.col("_x")[f].cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    specs = {f"q_{round(100 * q)}": ("value", q) for q in shares}
    return quantiles_by(rows.filter("value IS NOT NULL"), ["part"], specs, [F.count("*").alias("n")])


def value_sketches(df: DataFrame, *, lists: dict[str, str], k: int = 400) -> DataFrame:
    """part, n, sketch: KLL sketches of the same values, one pass with partial sketches that merge; they can be kept and merged with
    those of other tables. A quantile's rank is off by about 1.7 / k of n with a chance of a hundredth (0.4 % for k = 400)."""
    rows = None
    for c, f in lists.items():
        part = df.select(F.lit(c).alias("part"), F.explode(c).alias("_x")).select("part", F.col("_x")[f].cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.filter("value IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """part, n, q_<percent>... read from sketches."""
    return sketches.select("part", "n", *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"q_{round(100 * q)}") for q in shares))
