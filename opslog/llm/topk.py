"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are turned by an orthogonal matrix fitted on a bounded sample, which leaves inner products as they are and puts most of
their spread in few dimensions. Each task keeps its rows in blocks with one sorted list per turned dimension. A query walks each
list from the end that its own component favours, from depth k on in doubling steps, the lists first whose next step lowers the
bound most for the rows read. It scores the rows it meets, exactly, and stops once no row further down all lists can reach its
k-th result: such a row is at most the lists' frontier in each dimension, and no longer than the block's longest row.

How much is scored depends on the vectors: little of what is clustered, all of what is spread evenly. A query that could not
stop even with a quarter of every list read scores its block in one matrix product with others of its kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import long_id, new_path, quoted, stored

#: Queries that are looked at together.
CHUNK = 256

#: Rows on which the turning matrix is fitted; it only decides how much is scored, never what is found.
FIT_ROWS = 4096


class Best:
    """The k best (score, id) of each query so far, ties to smaller ids; floors are scores that the k-th best reaches."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.floors = np.full(n, -np.inf) if floors is None else floors.copy()

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores [query of which, row] of rows with these ids."""
        least = self.floors[which]
        if scores.shape[1] > self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            least = np.maximum(least, kth)
        q, r = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        have = self.scores[which]
        hq, hk = np.nonzero(have > -np.inf)
        q, s, i = np.r_[q, hq], np.r_[scores[q, r], have[hq, hk]], np.r_[ids[r], self.ids[which][hq, hk]]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        q, s, i, rank = q[kept], s[kept], i[kept], rank[kept]
        self.scores[which[q], rank], self.ids[which[q], rank] = s, i
        self.floors[which] = np.maximum(self.floors[which], self.scores[which, self.k - 1])


def reach(size: np.ndarray, most: np.ndarray, longest: float) -> np.ndarray:
    """For each row of size (not negative), the largest size @ x with x <= most in each place and a length of at most `longest`.

    The best x is size times a common factor, cut off at most; a place with the smaller most / size is cut off first.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        order = np.argsort(np.where(size > 0, most / size, np.inf), axis=1)
    a, b = np.take_along_axis(size, order, 1), np.take_along_axis(np.where(size > 0, most, 0.0), order, 1)
    none = np.zeros((len(a), 1))
    cut_length, cut_product = np.cumsum(np.hstack([none, b**2]), axis=1), np.cumsum(np.hstack([none, a * b]), axis=1)
    rest = np.cumsum((a**2)[:, ::-1], axis=1)[:, ::-1]
    factor = np.sqrt(np.maximum(longest**2 - cut_length[:, :-1], 0.0) / np.where(rest > 0, rest, np.inf))
    free = (factor * a <= b) & (a > 0)
    first = free.argmax(axis=1)
    some = np.arange(len(a))
    held = cut_product[some, first] + factor[some, first] * rest[some, first]
    return np.where(free.any(axis=1), held, cut_product[:, -1])


class SortedLists:
    """A block of vectors with its rows sorted by each turned dimension. turn: an orthogonal matrix, None for none."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray | None = None, k: int = 5):
        self.rows, self.ids, self.vectors, self.turn, self.k = rows, ids, vectors, turn, k
        turned = vectors if turn is None else vectors @ turn
        order = np.argsort(turned, axis=0, kind="stable")
        values = np.take_along_axis(turned, order, axis=0)
        # [end, dimension, depth]: from the largest value down, and from the smallest up
        self.order = np.stack([order[::-1].T, order.T])
        self.values = np.stack([values[::-1].T, values.T])
        self.longest = float(np.sqrt((vectors**2).sum(axis=1)).max(initial=0.0))
        #: More than what rounding can add to a bound, for a query of length 1.
        self.margin = 1e-9 * (1.0 + self.longest)
        self.by_row = np.argsort(rows)
        #: Rows at the ends of the lists, which all queries score; without dimensions every row is one.
        self.first = np.unique(self.order[:, :, : min(k, len(rows))]) if vectors.shape[1] else np.arange(len(rows))

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best, which: np.ndarray) -> np.ndarray:
        """Adds to best what this block has for the queries and returns how many rows each one scored; own: the row number of each,
        which it does not find."""
        n = len(self.rows)
        at = np.minimum(np.searchsorted(self.rows, own, sorter=self.by_row), n - 1)
        place = np.where(self.rows[self.by_row[at]] == own, self.by_row[at], -1)
        turned = queries if self.turn is None else queries @ self.turn
        size, end = np.abs(turned), (turned < 0).astype(np.int64)
        margin = self.margin * (1.0 + np.sqrt((queries**2).sum(axis=1)))
        self._score(np.arange(len(which)), self.first, queries, place, best, which)
        scored = np.full(len(which), n, np.int64)
        if len(self.first) == n:
            return scored - (place >= 0)
        rest = np.ones(n, bool)
        rest[self.first] = False
        quarter = self.values[:, :, max(0, n // 4 - 1)]
        lowest = reach(size, np.where(end == 0, quarter[0], -quarter[1]), self.longest) + margin
        whole = lowest >= best.floors[which]
        if whole.any():
            self._score(np.flatnonzero(whole), np.flatnonzero(rest), queries, place, best, which)
        for q in np.flatnonzero(~whole).tolist():
            scored[q] = self._walk(queries[q], size[q], end[q], float(margin[q]), int(place[q]), best, which[q : q + 1])
        return scored - (place >= 0)

    def _score(self, some: np.ndarray, rows: np.ndarray, queries: np.ndarray, place: np.ndarray, best: Best, which: np.ndarray) -> None:
        """All queries of `some` score all rows of `rows` (ascending), but for their own."""
        if not len(rows):
            return
        scores = queries[some] @ self.vectors[rows].T
        column = np.minimum(np.searchsorted(rows, place[some]), len(rows) - 1)
        mine = (place[some] >= 0) & (rows[column] == place[some])
        scores[mine, column[mine]] = -np.inf
        best.add(which[some], scores, self.ids[rows])

    def _walk(self, query: np.ndarray, size: np.ndarray, end: np.ndarray, margin: float, own: int, best: Best, which: np.ndarray) -> int:
        n, dims = self.vectors.shape
        every, met = np.arange(dims), np.zeros(n, bool)
        met[self.first] = True
        if own >= 0:
            met[own] = True
        depth = np.full(dims, min(self.k, n), np.int64)
        while True:
            frontier = self.values[end, every, depth - 1]
            signed = np.where(end == 0, frontier, -frontier)
            if (depth == n).any() or reach(size[None], signed[None], self.longest)[0] + margin < best.floors[which[0]]:
                return int(met.sum())
            # what doubling a list's depth takes off the bound, for each row that it reads
            ahead = self.values[end, every, np.minimum(2 * depth, n) - 1]
            gain = size * np.abs(frontier - ahead) / depth
            walk = np.argpartition(-gain, max(0, dims // 8 - 1))[: max(1, dims // 8)]
            to = np.minimum(2 * depth[walk], n)
            fresh = np.unique(np.concatenate([self.order[end[d], d, a:b] for d, a, b in zip(walk.tolist(), depth[walk].tolist(), to.tolist())]))
            depth[walk] = to
            fresh = fresh[~met[fresh]]
            if len(fresh):
                met[fresh] = True
                best.add(which, (self.vectors[fresh] @ query)[None, :], self.ids[fresh])


def turns(sample: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each length of sample.vector: the axes of the sample's spread, the widest first."""
    by_length: dict[int, list] = {}
    for (vector,) in sample.select("vector").collect():
        by_length.setdefault(len(vector), []).append(vector)
    return {d: np.linalg.eigh((x := np.array(v, float)).T @ x)[1][:, ::-1] for d, v in by_length.items() if d and len(v) >= d}


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _query_blocks(queries: DataFrame, most: int) -> Iterator[dict]:
    """Blocks of at most `most` queries: their row numbers, ids and vectors by length."""
    held = []

    def block():
        by_length = {}
        for k, (_, _, v) in enumerate(held):
            by_length.setdefault(len(v), []).append(k)
        return {
            "rows": np.array([r for r, _, _ in held], np.int64), "ids": np.array([i for _, i, _ in held], np.int64),
            "vectors": {d: (np.array(ks), np.array([held[k][2] for k in ks], float)) for d, ks in by_length.items()},
        }

    for row in queries.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == most:
            yield block()
            held = []
    if held:
        yield block()


def _searcher(shared, k: int, block_rows: int):
    """Each task's k best rows of every query in shared.value, which holds turning matrices by length too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = Best(len(asked["ids"]), k, asked.get("floors"))

        def search(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = rows.column(2).combine_chunks()
            numbers, ids, ends = rows.column(0).to_numpy(), rows.column(1).to_numpy(), lists.offsets.to_numpy()
            sizes, flat = np.diff(ends), lists.values.to_numpy().astype(float)
            for d, (which, vectors) in asked["vectors"].items():
                pick = np.flatnonzero(sizes == d)
                if len(pick):
                    block = SortedLists(numbers[pick], ids[pick], flat[ends[pick][:, None] + np.arange(d)], asked["turns"].get(d), k)
                    for a in range(0, len(which), CHUNK):
                        some = which[a : a + CHUNK]
                        block.search(vectors[a : a + CHUNK], asked["rows"][some], best, some)

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(at, block_rows))
                n += held[-1].num_rows
                if n >= block_rows:
                    search(held)
                    held, n = [], 0
        if n:
            search(held)
        q, rank = np.nonzero(best.scores > -np.inf)
        for a in range(0, len(q), 20_000):
            x, y = q[a : a + 20_000], rank[a : a + 20_000]
            made = (asked["rows"][x], asked["ids"][x], best.ids[x, y], best.scores[x, y].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, made)], names=["query_row", "query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    table: DataFrame,
    is_query: Column,
    *,
    id_col="vec_id",
    vector_col="embedding",
    k=5,
    scale=256,
    block_rows=16_384,
    query_block=32_768,
    seed_rows=16_384,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k highest inner products of floor(scale * x) components
    over all other rows, ties to smaller ids; all rows if there are fewer. Scores are exact below 2^53.

    The whole-number vectors are stored once. Queries come to the driver and go to the tasks one block of query_block after
    another, and each block's result is appended to one table; every block is one pass over the rows, which are never shuffled.
    Where there are many more rows than seed_rows, a block is first held against seed_rows of them, and tasks then send only
    what reaches the k-th best of those. The lists' directions are fitted on at most FIT_ROWS rows. Rows with null ids and null
    or non-finite vectors take no part; vectors meet those of their own length only, and empty ones each other with a score of 0.
    Rows of one id are rows like others: only a query's own row is left out.
    """
    spark, share = table.sparkSession, table.sparkSession.sparkContext.broadcast
    whole = F.transform(quoted(vector_col).cast("array<double>"), lambda x: F.floor(x * scale))
    chosen = table.filter(quoted(id_col).isNotNull() & _valid(quoted(vector_col))).select(
        F.monotonically_increasing_id().alias("row"), long_id(table, id_col).alias("vec_id"), whole.alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = stored(chosen, "vectors")
    candidates, schema = rows.select("row", "vec_id", "vector"), "query_row long, query_id long, vec_id long, score long"
    n, seeds = rows.count(), None
    if n > 8 * seed_rows:
        seeds = stored(candidates.orderBy(F.xxhash64("row")).limit(seed_rows), "seeds")
    matrices = turns(candidates.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, n // FIT_ROWS))) == 0).limit(FIT_ROWS))
    path = new_path(spark, "nearest")
    final = spark.createDataFrame([], schema + ", rank int")
    final.write.parquet(path)
    for block in _query_blocks(rows.filter("asks").select("row", "vec_id", "vector"), query_block):
        block["turns"] = matrices
        if seeds is not None:
            shared = share(block)
            sure = _ranked(seeds.mapInArrow(_searcher(shared, k, block_rows), schema), k).filter(F.col("rank") == k)
            sure = sure.select("query_row", "score").toArrow()  # a row per query of the block at most
            shared.destroy()
            by_row = np.argsort(block["rows"])
            block["floors"] = np.full(len(by_row), -np.inf)
            at = by_row[np.searchsorted(block["rows"], sure.column(0).to_numpy(), sorter=by_row)]
            block["floors"][at] = sure.column(1).to_numpy()
        shared = share(block)
        _ranked(candidates.mapInArrow(_searcher(shared, k, block_rows), schema), k).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(final.schema).parquet(path).select("query_id", "rank", "vec_id", "score")
