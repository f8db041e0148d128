"""Sequential rules over sorted rows: each task reads its keys' rows in order and carries a small state along.

For rules in which a row depends on what was decided for the row before. Memory is a batch and the state, however long a key is; a
key's rows are in one task, so rules that can restart should put what restarts them among the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import spare, stored


def sorted_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], run: Callable, schema) -> DataFrame:
    """run over the Arrow batches of partitions that hold whole keys, sorted by keys and order.

    Batches have two more columns, the last ones: hashes of the key, which together tell keys apart. Rows are dealt by one of them and
    not by the keys: after a join on the keys Spark leaves out a deal by the keys, and may then read that join's shuffle map by map, or
    split its large partitions, as it can't see that run needs keys whole.
    """
    a, b = spare(df.columns, "key_a"), spare(df.columns, "key_b")
    own = [F.col(k) for k in keys]
    marked = df.withColumns({a: F.xxhash64(*own), b: F.xxhash64(F.lit(1), *own)}).repartition(a)
    return marked.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def starts(batch: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where keys begin in the batch (the first row only if it is of another key than `last`), and its last row's key."""
    pair = [batch.column(batch.num_columns - k).to_numpy() for k in (2, 1)]
    new = np.r_[last is None or (pair[0][0], pair[1][0]) != last, (pair[0][1:] != pair[0][:-1]) | (pair[1][1:] != pair[1][:-1])]
    return new, (pair[0][-1], pair[1][-1])


def keep_apart(events: DataFrame, *, keys: Sequence[str], time: str, order: Sequence[str], gap: int, after: str | None = None) -> DataFrame:
    """Rows at least `gap` after the last row kept of their key. time: a whole-number column, not null. after: a column with the
    time last kept before the key's first row, null where there is none."""
    n = len(events.columns)
    at, entry = events.columns.index(time), events.columns.index(after) if after else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept_at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(at).to_numpy()
            new, last = starts(batch, key)
            edges = np.r_[0, np.flatnonzero(new[1:]) + 1, len(times)]
            kept = []
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                begins = bool(k or new[0])
                if begins and entry is not None:
                    kept_at = batch.column(entry)[a].as_py()
                fresh = begins and (entry is None or kept_at is None)
                at_row = a if fresh else a + int(np.searchsorted(times[a:b], kept_at + gap))
                while at_row < b:
                    kept.append(at_row)
                    kept_at = int(times[at_row])
                    at_row += int(np.searchsorted(times[at_row:b], kept_at + gap))
            key = last
            yield batch.take(pa.array(kept, pa.int64())).select(range(n))

    return sorted_scan(events, keys, order, run, events.schema)


def last_kept(times: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, last): a step function from the earliest time at which a row may be kept to the last time then kept.

    times: those of one bin, sorted; what was kept before the bin ends its reach before start + gap. Each row's successor is the
    first row at least gap later; pointers to successors are doubled until all point to the end of their chain. An earliest time
    of at most upto[k], and over upto[k - 1], ends at last[k].
    """
    times = np.unique(times)
    entries = min(len(times), int(np.searchsorted(times, start + gap)) + 1)
    after = np.searchsorted(times, times + gap)
    point = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        further = point[point]
        if (further == point).all():
            break
        point = further
    ends = times[point[:entries]]
    steps = np.flatnonzero(np.r_[ends[1:] != ends[:-1], True])
    return times[steps], ends[steps]


def bin_steps(timed: DataFrame, *, slot: str, time: str, width: int, gap: int) -> DataFrame:
    """slot, upto, last: the step function of last_kept for each bin. A task holds the times of one bin."""
    chosen = timed.select(slot, time)
    schema = f"{slot} {chosen.schema[slot].dataType.simpleString()}, upto long, last long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, name = None, [], None

        def steps() -> pa.RecordBatch:
            times = np.concatenate(held)
            upto, last = last_kept(times, int(times[0]) // width * width, gap)
            held.clear()
            return pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(len(upto), np.int64))), pa.array(upto), pa.array(last)], names=[slot, "upto", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(1).to_numpy()
            new, key = starts(batch, key)
            edges = np.r_[0, np.flatnonzero(new[1:]) + 1, len(times)]
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if (k or new[0]) and held:
                    yield steps()
                if k or new[0]:
                    name = batch.column(0).slice(a, 1)
                held.append(times[a:b])
        if held:
            yield steps()

    return sorted_scan(chosen, [slot], [time], run, schema)


def entries(steps: DataFrame, *, slot: str, gap: int) -> DataFrame:
    """slot, after: the time last kept before each bin, null for none, from the bins' step functions.

    A key's steps are read in order with the last kept time as the only state; there are as many as chains in a bin that end
    apart, not as many as rows."""
    parts = [f.name for f in steps.schema[slot].dataType.fields]
    rows = steps.select(slot, F.struct(*(F.col(slot)[p].alias(p) for p in parts if p != "bin")).alias("_key"), F.col(slot)["bin"].alias("_bin"), "upto", "last")
    kind = steps.schema[slot].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, now, open_ = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            new, key = starts(batch, key)
            firsts, befores = [], []
            for row, (first, bin_, upto, last) in enumerate(zip(new.tolist(), *(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                if first:
                    kept, now = None, None
                if bin_ != now:
                    now, open_ = bin_, True
                    firsts.append(row)
                    befores.append(kept)
                if open_ and (kept is None or upto >= kept + gap):
                    kept, open_ = last, False
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(firsts, pa.int64())), pa.array(befores, pa.int64())], names=[slot, "after"])

    return sorted_scan(rows, ["_key"], ["_bin", "upto"], run, f"{slot} {kind}, after long")


def affine_scan(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str | Column], add: str, times: str) -> DataFrame:
    """rows with add, times and `before` replaced: in the order of each key, y = add + times * (y of the row before; 0 at first).

    add becomes y, times the product of all factors up to the row, so that y for another start is y + times * start; before is
    the y of the row before. Rows of a batch are composed as affine maps, in as many steps as doublings of the batch.
    """
    schema = rows.withColumn("before", F.col(add)).schema
    at = [rows.columns.index(c) for c in (add, times)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last_y, last_w = None, 0.0, 1.0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, key = starts(batch, key)
            y, w = (batch.column(k).to_numpy().astype(np.float64) for k in at)
            place = np.arange(len(y))
            begin = np.maximum.accumulate(np.where(new, place, 0))
            step = 1
            while step < len(y):
                own = np.flatnonzero(place - step >= begin)
                y[own], w[own] = y[own] + w[own] * y[own - step], w[own] * w[own - step]
                step *= 2
            if not new[0]:
                head = int(np.argmax(new)) if new.any() else len(y)
                y[:head] += w[:head] * last_y
                w[:head] *= last_w
            before = np.where(new, 0.0, np.r_[last_y, y[:-1]])
            last_y, last_w = float(y[-1]), float(w[-1])
            made = {at[0]: pa.array(y), at[1]: pa.array(w)}
            yield pa.RecordBatch.from_arrays([*(made.get(k, batch.column(k)) for k in range(len(rows_columns))), pa.array(before)], names=[*rows_columns, "before"])

    rows_columns = rows.columns
    return sorted_scan(rows, keys, order, run, schema)


def discounted(rows: DataFrame, *, keys: Sequence[str], position: str, value: str, gamma: float, bin_rows: int = 4096) -> DataFrame:
    """keys..., position, to_go: value plus gamma times the next row's, from the last position of each key back.

    Work is dealt by key and bin of positions: a bin's rows are composed into one affine map, the maps of a key's bins, one for
    bin_rows positions, are composed from the last back, and what comes from later bins is then added inside. No task has more rows of
    a key than a bin, but for the one row of each bin. A null value is 0.
    """
    slot = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.floor(F.col(position) / bin_rows).alias("bin"))
    chosen = rows.select(*keys, position, slot.alias("_slot"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_y"), F.lit(float(gamma)).alias("_w"))
    inner = stored(affine_scan(chosen, keys=["_slot"], order=[F.col(position).desc()], add="_y", times="_w").drop("before"), "to-go")
    maps = inner.groupBy("_slot").agg(F.min_by(F.struct("_y", "_w"), position).alias("_map"))
    parts = F.struct(*(F.col("_slot")[f"k{i}"].alias(f"k{i}") for i in range(len(keys))))
    maps = maps.select("_slot", parts.alias("_key"), F.col("_slot")["bin"].alias("_bin"), F.col("_map._y").alias("_y"), F.col("_map._w").alias("_w"))
    ahead = affine_scan(maps, keys=["_key"], order=[F.col("_bin").desc()], add="_y", times="_w").select("_slot", F.col("before").alias("_ahead"))
    return inner.join(ahead, "_slot").select(*keys, position, (F.col("_y") + F.col("_w") * F.col("_ahead")).alias("to_go"))


def recent_elements(events: DataFrame, *, keys: Sequence[str], ts: str, element: str, n: int, name="recent", bin_s: int | None = None) -> DataFrame:
    """keys..., ts, no (the event's place in its task) and the last n distinct elements up to each event, latest first (of one
    time, the smaller first).

    bin_s: work is dealt by key and bin of time. The lists of a bin's own events are made by themselves, those before each bin
    from the last list of every bin before, and an event's list is its own followed by what its bin began with."""
    if bin_s is not None:
        from .asof import time_slot

        slot = time_slot(keys, F.col(ts), bin_s)
        own = stored(recent_elements(events.withColumn("_slot", slot), keys=["_slot"], ts=ts, element=element, n=n, name=name), "recent")
        ends = own.groupBy("_slot").agg(F.max_by(name, "no").alias(name))
        joined = own.join(_lists_before(ends, name, n), "_slot")
        whole = F.slice(F.array_union(name, F.coalesce("_before", F.array().cast(own.schema[name].dataType))), 1, n)
        return joined.select(*(F.col("_slot")[f"k{i}"].alias(k) for i, k in enumerate(keys)), ts, "no", whole.alias(name))
    chosen = events.select(*keys, ts, F.col(element).alias(name))
    kind = chosen.schema[name].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "no long", f"`{name}` array<{kind}>"])
    at, names = len(chosen.columns) - 1, [*chosen.columns[:-1], "no", name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, no = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, key = starts(batch, key)
            out = []
            for first, x in zip(new.tolist(), batch.column(at).to_pylist()):
                state = [x, *(y for y in ([] if first else state) if y != x)][:n]
                out.append(state)
            lists, numbers = pa.array(out, pa.list_(batch.column(at).type)), pa.array(np.arange(no, no + len(out)))
            no += len(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), numbers, lists], names=names)

    return sorted_scan(chosen, keys, [ts, F.col(name).desc()], run, schema)


def _lists_before(ends: DataFrame, name: str, n: int) -> DataFrame:
    """_slot, _before: the last n distinct elements before each bin, from the last list of every bin; a key's bins are read in order
    with one list as the state."""
    parts = [f.name for f in ends.schema["_slot"].dataType.fields if f.name != "bin"]
    rows = ends.select("_slot", F.struct(*(F.col("_slot")[p].alias(p) for p in parts)).alias("_key"), F.col("_slot")["bin"].alias("_bin"), name)
    schema = f"_slot {ends.schema['_slot'].dataType.simpleString()}, _before {ends.schema[name].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            new, key = starts(batch, key)
            out = []
            for first, own in zip(new.tolist(), batch.column(3).to_pylist()):
                state = [] if first else state
                out.append(state)
                state = [*own, *(x for x in state if x not in own)][:n]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.column(3).type)], names=["_slot", "_before"])

    return sorted_scan(rows, ["_key"], ["_bin"], run, schema)
