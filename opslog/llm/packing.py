"""Best-fit packing of documents into fixed-length training sequences.

Every bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). A piece
goes to the open bin that suits it best under all of them, by the norm of what would be left or by the weighted
dot product of the piece with what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_id, map_texts, quoted, slices, spare, stored, whole_text
from .tokenize import BYTE_BPE, encoder, with_end

END_ID = 2


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have the full length."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def token_pieces(
    docs: DataFrame, *, id_col="doc_id", text_col="text", max_tokens=1024, tokenizer=BYTE_BPE, end_id=END_ID, specials_as_text=False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; texts are not shuffled.

    A null or empty text has the end id alone. A null id, like a repeated row, is a document of its own. Strings of the
    tokenizer's added tokens become those tokens' ids, as the library has it, or ordinary text with specials_as_text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, specials_as_text)
        for batch in slices(batches, 1, 4 << 20, 20_000):
            ids, starts = with_end(*encode(batch.column(1)), end_id)
            raw, sizes = memoryview(ids.astype("<u4")).cast("B"), np.diff(starts)
            each = np.maximum(1, -(-sizes // max_tokens))
            doc = np.repeat(np.arange(len(sizes)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            first = sizes - (each - 1) * max_tokens  # what the full pieces leave
            start = np.where(piece > 0, first[doc] + (piece - 1) * max_tokens, 0)
            length = np.where(piece > 0, max_tokens, first[doc])
            at = 4 * (starts[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(chosen, run, "doc_id long, piece int, start long, length long, ids_crc32 long", rows=4000)


class Bins:
    """Open bins grouped by state, that is by what is left of each capacity; bins of one state are alike."""

    def __init__(self, caps: np.ndarray, weights: np.ndarray, by: str):
        self.caps, self.weights, self.by = caps, weights, by
        self.left = np.empty((64, len(caps)))
        self.count = np.zeros(64, np.int64)
        self.members: list[list[int]] = []
        self.index: dict[tuple, int] = {}
        self.opened = 0

    def _put(self, left: np.ndarray, bins: list[int]) -> None:
        key = tuple(left)
        k = self.index.get(key)
        if k is None:
            k = self.index[key] = len(self.members)
            if k == len(self.count):
                self.left = np.concatenate([self.left, np.empty_like(self.left)])
                self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            self.left[k] = left
            self.members.append([])
        self.members[k] += bins
        self.count[k] += len(bins)

    def forget(self, smallest: np.ndarray) -> None:
        """Drops states that no later piece fits; later pieces are at least this large in every dimension."""
        n = len(self.members)
        keep = np.flatnonzero((self.count[:n] > 0) & (self.left[:n] >= smallest).all(axis=1))
        members = [self.members[k] for k in keep]
        self.left[: len(keep)], self.count[: len(keep)] = self.left[keep], self.count[keep]
        self.count[len(keep) :] = 0
        self.members = members
        self.index = {tuple(self.left[k]): k for k in range(len(keep))}

    def place(self, size: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(bin, pieces put there) for n pieces of one size, each as best-fit would place it."""
        while n:
            m = len(self.members)
            left = self.left[:m]
            fits = np.flatnonzero((self.count[:m] > 0) & (left >= size).all(axis=1))
            if not len(fits):
                per = max(1, int((self.caps // size).min()))
                whole, rest = divmod(n, per)
                for many, bins in ((per, whole), (rest, 1 if rest else 0)):
                    made = list(range(self.opened, self.opened + bins))
                    self.opened += bins
                    yield from ((b, many) for b in made)
                    if bins:
                        self._put(self.caps - many * size, made)
                return
            if self.by == "norm":
                score = (self.weights * ((left[fits] - size) / self.caps) ** 2).sum(axis=1)
                best = fits[score.argmin()]
                per = int((left[best] // size).min())
            else:
                best = fits[(self.weights * (size / self.caps) * (left[fits] / self.caps)).sum(axis=1).argmax()]
                per = 1
            was, bins = left[best].copy(), self.members[best]
            whole = min(len(bins), n // per)
            taken = [bins.pop() for _ in range(whole)]
            rest = n - whole * per if bins and n - whole * per < per else 0
            last = [bins.pop()] if rest else []
            self.count[best] = len(bins)
            for many, which in ((per, taken), (rest, last)):
                if which:
                    yield from ((b, many) for b in which)
                    self._put(was - many * size, which)
                    n -= many * len(which)


def best_fit(
    lengths: np.ndarray, *, max_tokens: int, max_docs: int, max_attention: float, weights=(1.0, 0.0, 0.0), by="norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, longest pieces first. A piece over a capacity gets a bin of its own."""
    caps = np.array([max_tokens, max_docs, max_attention], float)
    bins, n = Bins(caps, np.array(weights, float), by), len(lengths)
    order = np.argsort(-lengths, kind="stable")
    which = np.empty(n, np.int64)
    sizes, counts = np.unique(lengths, return_counts=True)
    at = 0
    for size, count in zip(sizes[::-1], counts[::-1]):
        vector = np.array([size, 1, float(size) ** 2])
        if (vector > caps).any():
            which[order[at : at + count]] = bins.opened + np.arange(count)
            bins.opened += count
            at += count
            continue
        for b, many in bins.place(vector, int(count)):
            which[order[at : at + many]] = b
            at += many
        bins.forget(np.array([sizes[0], 1, float(sizes[0]) ** 2]))
    by_bin = np.lexsort((np.arange(n), which))
    ends = np.cumsum(lengths[by_bin])
    starts = ends - lengths[by_bin]
    new = np.r_[True, np.diff(which[by_bin]) != 0] if n else np.zeros(0, bool)
    offsets = np.empty(n, np.int64)
    offsets[by_bin] = starts - np.maximum.accumulate(np.where(new, starts, 0)) if n else starts
    return which, offsets


def pack(
    pieces: DataFrame,
    *,
    length_col="length",
    max_tokens=1024,
    max_docs=1024,
    max_attention=1024.0**2,
    weights=(1.0, 0.0, 0.0),
    by="norm",
    group_rows=65_536,
) -> DataFrame:
    """pieces with sequence_id and offset (columns of these names are replaced).

    A piece over a capacity, and one as long as a sequence, is a sequence by itself. The others are dealt by their position
    into groups of about group_rows, so that no task holds more however many there are, and each group is packed by
    itself: at most the last few bins of a group are looser than they would be in one group. pieces should be a stored
    table, as row positions must be the same whenever they are read. An empty table gives an empty result. Null lengths
    count as 0.
    """
    extra = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    row, group = spare(extra, "row_no"), spare(extra, "group_no")
    rows = pieces.select(*map(quoted, extra)).withColumn(row, F.monotonically_increasing_id())
    size = F.coalesce(quoted(length_col), F.lit(0))
    alone = (size >= max_tokens) | (size.cast("double") * size > max_attention)
    full = rows.filter(alone).select(
        *map(quoted, extra), (-1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = rows.filter(~alone)
    groups = max(1, -(-part.count() // group_rows))
    columns = [f for f in pieces.schema.fields if f.name in extra]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, kind="stable")
        lengths = pdf[length_col].fillna(0).to_numpy(np.int64)
        bins, offsets = best_fit(
            lengths, max_tokens=max_tokens, max_docs=max_docs, max_attention=max_attention, weights=weights, by=by
        )
        pdf["sequence_id"] = pdf[group].iloc[0] * (1 << 32) + bins
        pdf["offset"] = offsets
        return pdf[[*extra, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    packed = (
        part.withColumn(group, F.pmod(F.xxhash64(row), F.lit(groups)).cast("long"))
        .groupBy(group)
        .applyInPandas(run, f"{schema}, sequence_id long, offset long")
    )
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, *, max_tokens=1024, max_attention=None, tokens: dict | None = None, **settings) -> DataFrame:
    """Tokenizes, cuts and packs documents: one row per piece, with its sequence and its place there.

    Pieces are cut so short that one alone keeps both the token and the attention capacity. max_attention None is the
    square of max_tokens, which a sequence of that many tokens can't exceed. tokens: settings of token_pieces.
    """
    most = float(max_tokens) ** 2 if max_attention is None else float(max_attention)
    longest = max(1, min(max_tokens, isqrt(int(most))))
    pieces = stored(token_pieces(docs, max_tokens=longest, **(tokens or {})), "pieces")
    return pack(pieces, max_tokens=max_tokens, max_attention=most, **settings)
