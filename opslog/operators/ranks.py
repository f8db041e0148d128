"""Global numbers, running totals and exact quantiles, without a task that sees all rows.

Rows are dealt to range partitions in the given order and written once, each with its place; everything else is read from that
table, so that numbers of rows and sizes of partitions can't come from two different deals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import spare, stored

#: monotonically_increasing_id has the partition's number above these bits and the row's place below.
_BITS = 33


def _dealt(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str, str]:
    """The rows in partitions by order, stored, with columns for the partition and the place in it."""
    part, place = spare(df.columns, "part"), spare(df.columns, "place")
    at = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, at), "dealt")
    return rows.withColumns({part: F.shiftright(place, _BITS), place: F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))}), part, place


def _with_offsets(rows: DataFrame, part: str, total: Column, off: str) -> DataFrame:
    """off: the total over all partitions before; one row per partition is summed and broadcast."""
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(part).agg(total.alias(off))
    return rows.join(F.broadcast(sums.select(part, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(off))), part)


def numbered(df: DataFrame, order: Sequence[str], name="seq") -> DataFrame:
    """Adds a running number from 1 in the given total order; a column of that name is replaced."""
    kept = [c for c in df.columns if c != name]
    rows, part, place = _dealt(df.select(*kept), order)
    off = spare(rows.columns, "off")
    return _with_offsets(rows, part, F.count("*"), off).select(*kept, (F.col(off) + F.col(place) + 1).alias(name))


def running(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows up to this one in the given total order."""
    kept = [c for c in df.columns if c != name]
    rows, part, place = _dealt(df.select(*kept), order)
    off = spare(rows.columns, "off")
    upto = F.sum(value).over(W.partitionBy(part).orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    return _with_offsets(rows.withColumn(name, upto), part, F.sum(value), off).select(*kept, (F.col(off) + F.col(name)).alias(name))


def numbered_runs(df: DataFrame, order: Sequence[str], value: str, name="seq", run="run") -> DataFrame:
    """Adds a running number from 1 in the given total order, and the number of the run of rows with one value it lies in.

    Both come from one stored deal: a row's value before it is that of its partition, for a partition's first row that of the last
    one before; numbers and runs of earlier partitions are a row a partition."""
    kept = [c for c in df.columns if c not in (name, run)]
    rows, part, place = _dealt(df.select(*kept), order)
    last, new, n_off, r_off = (spare(rows.columns, c) for c in ("last", "new", "n_off", "r_off"))
    parts = W.orderBy(part)
    ends = rows.groupBy(part).agg(F.max_by(F.struct(value), place).alias(last))
    ends = ends.select(part, F.lag(last).over(parts).alias(last))  # one row a partition
    inside = W.partitionBy(part).orderBy(place)
    before = F.coalesce(F.lag(F.struct(value)).over(inside), F.col(last))
    fresh = ~F.coalesce(before[value].eqNullSafe(F.col(value)) & before.isNotNull(), F.lit(False))
    flagged = rows.join(F.broadcast(ends), part).withColumn(new, fresh.cast("long")).drop(last)
    upto = parts.rowsBetween(W.unboundedPreceding, -1)
    sums = flagged.groupBy(part).agg(F.count("*").alias(n_off), F.sum(new).alias(r_off))
    sums = sums.select(part, *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in (n_off, r_off)))
    own = F.sum(new).over(inside.rowsBetween(W.unboundedPreceding, 0))
    placed = flagged.withColumn(run, own).join(F.broadcast(sums), part)
    return placed.select(*kept, (F.col(n_off) + F.col(place) + 1).alias(name), (F.col(r_off) + F.col(run)).alias(run))


def quantiles(df: DataFrame, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles: name -> (column, share). Null for a column without values.

    A column's distinct values are counted and ranked by running totals; no buffer holds them all.
    """
    out = None
    for column in dict.fromkeys(c for c, _ in specs.values()):
        counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).filter("v IS NOT NULL")
        ranked = running(counts, ["v"], "n", "upto")
        total = ranked.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("total"))
        own = []
        for name, (c, share) in specs.items():
            if c == column:
                at = F.lit(float(share)) * (F.col("total") - 1)
                low, high = (F.min(F.when(F.col("upto") > f(at), F.col("v").cast("double"))) for f in (F.floor, F.ceil))
                own.append((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name))
        one = ranked.join(F.broadcast(total)).agg(*own)  # total is one row
        out = one if out is None else out.join(F.broadcast(one))
    return out.select(*specs)


def quantiles_by(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, float]], more: Sequence[Column] = ()) -> DataFrame:
    """keys..., more..., and exact, linearly interpolated quantiles of each group: name -> (column, share).

    As in quantiles, distinct values are counted and take their places from running totals, so that a group with a large part of all
    rows has no buffer of its values; a row per group is joined to them. A null key is a key; a group without values has nulls.
    df is read once more for each column.
    """
    grouped = df.withColumn("_group", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))))
    out = grouped.groupBy("_group").agg(F.count("*").alias("_rows"), *more).drop("_rows")
    for column in dict.fromkeys(c for c, _ in specs.values()):
        counts = grouped.groupBy("_group", F.col(column).alias("v")).agg(F.count("*").alias("n")).filter("v IS NOT NULL")
        ranked = running(counts, ["_group", "v"], "n", "upto")
        ends = ranked.groupBy("_group").agg(F.min(F.col("upto") - F.col("n")).alias("before"), F.max("upto").alias("last"))
        placed = ranked.join(ends, "_group")
        own = []
        for name, (c, share) in specs.items():
            if c == column:
                at = F.lit(float(share)) * (F.col("last") - F.col("before") - 1)
                low, high = (F.min(F.when(F.col("upto") - F.col("before") > f(at), F.col("v").cast("double"))) for f in (F.floor, F.ceil))
                own.append((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name))
        out = out.join(placed.groupBy("_group").agg(*own), "_group", "left")
    return out.select(*(F.col("_group")[f"k{i}"].alias(k) for i, k in enumerate(keys)), *(c for c in out.columns if c != "_group"))
