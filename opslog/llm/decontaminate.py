"""Benchmark decontamination with an FM-index over each training shard.

Texts become word ids over the benchmark's vocabulary; words that no benchmark item holds cannot be part of a
match, so a shard's index covers the stretches between them that are long enough for the shortest window. The index
is the Burrows-Wheeler transform of those stretches in a wavelet matrix of ranks, with every eighth suffix position
sampled. All distinct windows of the items are searched backwards at once, their places are found by walking to the
next sample, and overlapping places merge into spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, long_id, map_texts, quoted, slices, stored, whole_text, words_of

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are not yet told apart are sorted again."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    sorted_rank = rank[order]
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_rank)) + 1]
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))  # a rank is the first place of its group
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_at = np.flatnonzero(sizes[rank[order]] > 1)
        if not len(open_at):
            return order
        suffixes = order[open_at]
        later = suffixes + width
        second = np.where(later < n, rank[np.minimum(later, n - 1)], -1)
        by = np.lexsort((second, rank[suffixes]))
        suffixes, second = suffixes[by], second[by]
        first = rank[suffixes]
        order[open_at] = suffixes
        new = np.r_[True, (np.diff(first) != 0) | (np.diff(second) != 0)]
        rank[suffixes] = np.maximum.accumulate(np.where(new, open_at, 0))
        width *= 2


class WaveletMatrix:
    """Ranks of symbols over a sequence, for whole arrays of questions at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of symbols[i] stand before position at[i]."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[at]
            bit = ones[at + 1] - a
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + a, at - a)
        return out


class FMIndex:
    """Counts and locates sequences of symbols > 0 in a text of symbols >= 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.r_[text + 1, 0].astype(np.int64)  # an end of its own keeps the walk from row to row a cycle
        order = suffix_order(text)
        last = text[order - 1]
        self.bwt = WaveletMatrix(last, max(1, int(text.max()).bit_length()))
        counts = np.bincount(text)
        self.before = np.r_[0, np.cumsum(counts)]
        kept = order % sample == 0
        self.kept, self.places = np.r_[0, np.cumsum(kept)].astype(np.int32), order[kept]
        self.is_kept = kept

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern (rows of a matrix of one length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        alive, a, b, first = np.arange(len(patterns)), None, None, True
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column].astype(np.int64) + 1
            there = symbol < len(self.before) - 1
            alive, symbol = alive[there], symbol[there]
            if first:
                a, b, first = self.before[symbol], self.before[symbol + 1], False
            else:
                a, b = (self.before[symbol] + self.bwt.rank(symbol, x[there]) for x in (a, b))
            found = a < b
            alive, a, b = alive[found], a[found], b[found]
        lo[alive], hi[alive] = a, b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.is_kept[rows[todo]]
            done = todo[here]
            out[done] = self.places[self.kept[rows[done]]] + steps[done]
            todo = todo[~here]
            symbol = self.bwt.access(rows[todo])
            rows[todo] = self.before[symbol] + self.bwt.rank(symbol, rows[todo])
            steps[todo] += 1
        return out


class Phrases:
    """The distinct windows of benchmark items over their own vocabulary, as a matrix of word ids for each length."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        vocabulary: dict[bytes, int] = {}
        words, starts, owners = [], {}, {}
        at = 0
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text or "")]
            if ids:
                n = min(width, len(ids))
                words.append(np.array(ids, np.int32))
                starts.setdefault(n, []).append(np.arange(at, at + len(ids) - n + 1))
                owners.setdefault(n, []).append(np.full(len(ids) - n + 1, number[name]))
                at += len(ids)
        self.words = list(vocabulary)  # ids count from 1
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.matrices, self.holders = {}, {}
        for n in starts:
            rows = flat[np.concatenate(starts[n])[:, None] + np.arange(n)]
            distinct, of = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(of.reshape(-1) * len(self.names) + np.concatenate(owners[n]))
            window, owner = np.divmod(pairs, len(self.names))
            self.matrices[n] = distinct
            self.holders[n] = np.searchsorted(window, np.arange(len(distinct) + 1)), owner.astype(np.int32)
        self.shortest = min(starts, default=0)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents with those that overlap or touch made one, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * wide + end)
    new = np.r_[True, doc[1:] * wide + start[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return doc[new], start[new], reach[last] - doc[new] * wide


def _taken(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... as many as counts[i], in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def find(phrases: Phrases, ids_of: dict[bytes, int], texts: list[bytes]):
    """Words of each text of a shard; then (text, start, end) of merged spans in words, and (text, item number), in order."""
    get, sizes, runs, homes = ids_of.get, np.zeros(len(texts), np.int32), [], []
    for k, text in enumerate(texts):
        words = text.translate(ALNUM_BYTES).split()
        sizes[k] = len(words)
        if not phrases.shortest or len(words) < phrases.shortest:
            continue
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, ids > 0, 0].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= phrases.shortest:
                runs += [ids[a:b], np.zeros(1, np.int64)]
                homes.append((k, a, b - a + 1))
    spans, items = [], []
    if homes:
        index = FMIndex(np.concatenate(runs))
        doc, first, size = (np.array(x) for x in zip(*homes))
        begin = np.cumsum(size) - size
        for n, patterns in phrases.matrices.items():
            lo, hi = index.search(patterns)
            which = np.repeat(np.arange(len(patterns)), hi - lo)
            places = index.locate(_taken(lo, hi - lo))
            run = np.searchsorted(begin, places, "right") - 1
            starts = first[run] + places - begin[run]
            spans.append((doc[run], starts, starts + n))
            hit = np.unique(np.stack([doc[run], which]), axis=1)
            ends, owners = phrases.holders[n]
            many = ends[hit[1] + 1] - ends[hit[1]]
            items.append(np.repeat(hit[0], many) * len(phrases.names) + owners[_taken(ends[hit[1]], many)])
    none = np.zeros(0, np.int64)
    spans = merged(*(np.concatenate(x) for x in zip(*spans))) if spans else (none, none, none)
    return sizes, spans, np.divmod(np.unique(np.concatenate(items)), len(phrases.names)) if items else (none, none)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded text, so that what goes to the tasks is bounded however many items there are."""
    block, held = [], 0
    for row in benchmark.select(quoted(item_col).cast("string"), whole_text(text_col)).toLocalIterator():
        block.append((row[0] or "", row[1]))
        held += len(row[1])
        if held >= most_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


SPANS = "array<struct<start: int, end: int>>"


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col="doc_id",
    text_col="text",
    item_col="item_id",
    item_text_col="text",
    width=10,
    shard_bytes=4_000_000,
    block_bytes=16_000_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, the columns of `keep`, n_words, spans (merged, in words), items (sorted as strings), one row per document row.

    Documents stay where they are: a shard is shard_bytes of consecutive texts of one partition, at least one text. Items go
    to the tasks in blocks of block_bytes. For more than one block the texts are stored with row numbers and read once for
    each, one block after another, with each block's hits written before the next is sent; results are the same for any
    block_bytes. A null text has no words. Items of one id count once, a null id is the empty string; repeated document rows
    have one result each, whatever their ids.
    """
    keep = list(keep or ())
    spark, share = docs.sparkSession, docs.sparkSession.sparkContext.broadcast
    chosen = docs.select(long_id(docs, id_col).alias("_doc"), whole_text(text_col).alias("_text"), *map(quoted, keep))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        kept = "".join(f", `{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
        found = map_texts(chosen, _searcher(share(Phrases(first, width)), shard_bytes), f"_doc long{kept}, n_words int, spans {SPANS}, items array<string>")
        return found.withColumnRenamed("_doc", "doc_id")
    rows = stored(chosen.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    sizes = hits = None
    for items in chain([first, second], blocks):
        shared = share(Phrases(items, width))
        found = map_texts(rows.select("_row", "_text"), _searcher(shared, shard_bytes), f"_row long, n_words int, spans {SPANS}, items array<string>")
        if sizes is None:
            found = stored(found, "hits")
            sizes = found.select("_row", "n_words")
        part = found.filter(F.size("spans") > 0).drop("n_words")
        part = part if hits is None else stored(part, "hits")
        hits = part if hits is None else hits.unionByName(part)
        shared.destroy()
    grouped = hits.groupBy("_row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = rows.drop("_text").join(sizes, "_row").join(map_texts(grouped, _merge, f"_row long, spans {SPANS}, items array<string>"), "_row", "left")
    none = F.array().cast
    return joined.select(
        F.col("_doc").alias("doc_id"), *map(quoted, keep), "n_words", F.coalesce("spans", none(SPANS)).alias("spans"),
        F.coalesce("items", none("array<string>")).alias("items"),
    )


_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """One list for each of n rows, of the values whose row is in `of` (ascending)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _span_lists(n: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.ListArray:
    ends = [pa.array(x.astype(np.int32)) for x in (start, end)]
    return _lists(doc, n, pa.StructArray.from_arrays(ends, names=["start", "end"])).cast(_KIND)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        spans = merged(doc, flat.field("start").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), _span_lists(len(lists), *spans), batch.column(2)], names=["_row", "spans", "items"])


def _searcher(shared, shard_bytes: int):
    """Searches shards of batches of (key, text, others); gives key, others, n_words, spans, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        ids_of = {w: k for k, w in enumerate(phrases.words, 1)}
        names = pa.array(phrases.names, pa.string())
        for batch in slices(batches, 1, shard_bytes, 10_000):
            n, spans, (doc, item) = find(phrases, ids_of, batch.column(1).cast(pa.binary()).to_pylist())
            others = [batch.column(0), *(batch.column(k) for k in range(2, batch.num_columns))]
            items = _lists(doc, batch.num_rows, names.take(pa.array(item)))
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(n), _span_lists(batch.num_rows, *spans), items],
                names=[batch.schema.names[0], *batch.schema.names[2:], "n_words", "spans", "items"],
            )

    return run


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    plain = np.frombuffer(raw.translate(ALNUM_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[0, plain, 0].astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : begins[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]])


def _cut(batch: pa.RecordBatch, k: int, sizes: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """The batch with the spans cut out of the texts in column k, without rows of which no word is left."""
    if not len(doc):
        return batch
    hit = np.bincount(doc, end - start, len(sizes))
    texts, edges = batch.column(k).cast(pa.binary()).to_pylist(), np.searchsorted(doc, np.arange(len(sizes) + 1)).tolist()
    for row in np.flatnonzero(hit).tolist():
        a, b = edges[row], edges[row + 1]
        texts[row] = cut_spans(texts[row], list(zip(start[a:b].tolist(), end[a:b].tolist())))
    columns = batch.columns
    columns[k] = pa.array(texts, pa.binary()).view(pa.string())
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array((hit == 0) | (hit < sizes)))


def without_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", width=10,
    shard_bytes=4_000_000, block_bytes=16_000_000,
) -> DataFrame:
    """docs with every contaminated span cut from text_col; documents of which no word is left are dropped,
    unless they had none. Other rows and columns are as they were. Of one block of items, in one pass."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    k = docs.columns.index(text_col)
    inner = docs.withColumn(text_col, quoted(text_col).cast("string")).toDF(*names)
    long_id(docs, id_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks, [])
    if next(blocks, None) is None:
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(first, width))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            ids_of = {w: n for n, w in enumerate(phrases.words, 1)}
            for batch in slices(batches, k, shard_bytes, 10_000):
                n, spans, _ = find(phrases, ids_of, [x or b"" for x in batch.column(k).cast(pa.binary()).to_pylist()])
                yield _cut(batch, k, n, *spans)

        return map_texts(inner, search, inner.schema).toDF(*docs.columns)

    settings = {"item_col": item_col, "item_text_col": item_text_col, "width": width, "shard_bytes": shard_bytes, "block_bytes": block_bytes}
    found = contaminated_spans(inner, benchmark, id_col=names[docs.columns.index(id_col)], text_col=names[k], keep=names, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, k):
            lists = batch.column(len(names) + 1)
            doc, flat = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
            spans = (flat.field(side).to_numpy().astype(np.int64) for side in ("start", "end"))
            yield _cut(batch.select(names), k, batch.column(len(names)).to_numpy(), doc, *spans)

    return map_texts(found.select(*names, "n_words", "spans"), run, inner.schema).toDF(*docs.columns)
