"""Toxic spans and document scores from a linear-chain conditional random field.

Labels exist for documents only, so tokens are labelled from them: in a toxic training document, a word is toxic when
it, or a beginning of it, occurs almost only in toxic training documents. The field has two tags; a word's emission
is the sum of hashed weights of the word, its beginnings and its end. Forward-backward marginals give each word's
probability; a document's score is a logistic function of their maximum, their sum and their noisy-or. A document is one
chain, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, long_id, map_texts, quoted, slices, stored, whole_text, words_of
from .crf import in_blocks, marginals

BITS = 18
LABEL_BITS = 22
SPAN = "array<struct<start: int, end: int>>"


def features(word: bytes) -> list[int]:
    parts = [b"w" + word, b"e" + word[-3:], *(b"b" + word[:k] for k in range(3, 8) if len(word) >= k)]
    return [zlib.crc32(p) & ((1 << BITS) - 1) for p in parts]


@dataclass
class Model:
    weights: np.ndarray  # float32 per hashed feature
    bias: float
    steps: np.ndarray  # log potentials of tag pairs, [from, to]
    calibration: np.ndarray  # weights of doc_features, the constant last

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Log odds of tag 1 for each word by itself."""
        if not words:
            return np.zeros(0)
        flat, of = _flat([features(w) for w in words])
        return np.bincount(of, self.weights[flat], len(words)) + self.bias


def doc_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: greatest marginal, log of their sum, noisy-or, all squeezed to be near [0, 1]; and a constant."""
    out = np.zeros((len(sizes), 4))
    out[:, 3] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full, 0] = np.maximum.reduceat(p, starts)
        out[full, 1] = np.log1p(np.add.reduceat(p, starts))
        out[full, 2] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 0.999999)), starts))
    return out


def _beginnings(word: bytes) -> list[int]:
    """Hashed names of a word and of its beginnings, from which tokens are labelled."""
    parts = [word + b" ", *(word[:k] for k in range(3, 8) if len(word) >= k)]
    return [zlib.crc32(p) & ((1 << LABEL_BITS) - 1) for p in parts]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values in turn and the list each is of."""
    sizes = [len(x) for x in lists]
    return np.fromiter((v for x in lists for v in x), np.int64, sum(sizes)), np.repeat(np.arange(len(lists)), sizes)


def _toxic_words(docs: list[np.ndarray], toxic: np.ndarray, words: list[bytes], least_share: float = 0.01, share: float = 0.95) -> np.ndarray:
    """Whether each word, or a beginning of it, stands almost only in toxic documents (both labels weighted alike).

    Occurrences count once for each pair of neighbours, so that copies of a document add nothing; a mark needs as many as a
    hundredth of the toxic documents, five at least.
    """
    parts = [_beginnings(w) for w in words]
    names, owner = _flat(parts)
    ids = np.concatenate(docs).astype(np.uint64)
    before, after = np.roll(ids, 1), np.roll(ids, -1)
    context = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (ids << np.uint64(40)) ^ (after * np.uint64(0xC2B2AE3D27D4EB4F))
    y = np.repeat(toxic > 0, [len(d) for d in docs])
    counts = []
    for chosen in (y, ~y):
        first = np.unique(context[chosen], return_index=True)[1]
        per_word = np.bincount(ids[chosen][first].astype(np.int64), minlength=len(words))
        counts.append(np.bincount(names, per_word[owner], 1 << LABEL_BITS))
    bad, good = counts
    balance = max(1, (~y).sum()) / max(1, y.sum())
    marks = (bad >= max(5, least_share * toxic.sum())) & (bad * balance >= share * (bad * balance + good))
    return np.array([marks[p].any() for p in parts])


def fit_field(texts: Iterable[str], toxic: Sequence[float], *, rounds: int = 20, rate: float = 0.3, l2: float = 1e-4) -> Model:
    """Maximum likelihood by full-batch Adam; gradients are expected minus labelled counts. toxic is read after the texts."""
    size = 1 << BITS
    vocabulary: dict[bytes, int] = {}
    docs = []
    for text in texts:
        own = words_of(text)
        docs.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in own), np.int32, len(own)))
    toxic = np.array(toxic, float)
    words = list(vocabulary)
    if not words:
        return Model(np.zeros(size, np.float32), -4.0, np.zeros((2, 2)), np.array([0.0, 0, 0, -4]))
    sizes = np.array([len(d) for d in docs])
    ids = np.concatenate(docs)
    y = _toxic_words(docs, toxic, words)[ids] & np.repeat(toxic > 0, sizes)
    inner = np.ones(len(ids), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    now = np.flatnonzero(inner)
    pairs = np.bincount(2 * y[now - 1].astype(int) + y[now], minlength=4).reshape(2, 2)
    flat, owner = (x.astype(np.int32) for x in _flat([features(w) for w in words]))
    theta = np.zeros(size + 5)  # weights, bias, steps
    theta[size] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emission = (np.bincount(owner, theta[flat], len(words)) + theta[size]).astype(np.float32)[ids]
        p, expected = in_blocks(emission, sizes, theta[size + 1 :].reshape(2, 2))
        wrong = np.bincount(ids, p - y, len(words))
        grad = np.concatenate([np.bincount(flat, wrong[owner], size), [wrong.sum()], (expected - pairs).reshape(-1)])
        grad = grad / len(ids) * 1000 + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(theta[:size].astype(np.float32), float(theta[size]), theta[size + 1 :].reshape(2, 2), np.zeros(4))
    p, _ = in_blocks(model.emissions(words)[ids], sizes, model.steps, counts=False)
    model.calibration = _fit_logistic(doc_features(p, sizes), toxic)
    return model


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1) -> np.ndarray:
    """Newton's method; a few features."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + l2 * w)
    return w


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", fit_clean=3000, fit_toxic=1500, fit_chars=16_000_000
) -> Model:
    """Fits the field on a bounded sample: the fit_clean and fit_toxic training rows that come first by the hash of their id,
    as far as their whole texts have fit_chars together (a text that would go beyond is left out). Rows of fold 0 are never
    read. Null labels are left out; of several texts of one id the least is taken. Texts come to the driver one partition at a time and are kept as word numbers."""
    rows = labels.select(quoted(id_col).alias("_id"), quoted(label_col).cast("int").alias("_y")).filter((fold("_id") != 0) & F.col("_y").isin(0, 1))
    sample = None
    for y, most in ((0, fit_clean), (1, fit_toxic)):
        some = rows.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        sample = some if sample is None else sample.union(some)
    texts = docs.select(quoted(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    # at most fit_clean + fit_toxic rows
    joined = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # one text an id, whatever repeats
    found = stored(joined.withColumn("_size", F.char_length("_text")), "training")
    upto = F.sum("_size").over(W.orderBy(F.xxhash64("_id"), "_id", "_size").rowsBetween(W.unboundedPreceding, 0))
    sizes = found.select("_id", "_size", upto.alias("_upto")).filter(F.col("_upto") <= fit_chars).select("_id", "_size").distinct()  # rows of the sample
    chosen = found.join(F.broadcast(sizes), ["_id", "_size"]).coalesce(4).sortWithinPartitions("_id", "_text").select("_text", "_y")
    toxic: list[float] = []

    def each() -> Iterator[str]:
        for text, y in chosen.toLocalIterator():
            toxic.append(y)
            yield text

    return fit_field(each(), toxic)


class _Emissions:
    """Log odds of words, those of the words met so far kept up to a bound."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, words: list[list[bytes]]) -> np.ndarray:
        every = list(chain.from_iterable(words))
        new = list(set(every) - self.known.keys())
        own = dict(zip(new, self.model.emissions(new).tolist()))
        known = self.known | own if len(self.known) + len(own) > self.most else None
        if known is None:
            self.known.update(own)
            known = self.known
        return np.fromiter(map(known.__getitem__, every), float, len(every))


def _offsets(raw: bytes, hits: np.ndarray) -> list[dict]:
    """Spans of consecutive hit words in code points."""
    plain = np.frombuffer(raw.translate(ALNUM_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[0, plain, 0].astype(np.int8)))
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    runs = np.flatnonzero(np.diff(np.r_[0, hits, 0].astype(np.int8)))
    return [
        {"start": int(points[edges[2 * a]]), "end": int(points[edges[2 * b - 1]])}
        for a, b in zip(runs[::2].tolist(), runs[1::2].tolist())
    ]


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", at_least=0.5) -> DataFrame:
    """doc_id, score, spans (code points, end exclusive, of words with marginals of at_least) of every whole text.

    The text alone enters a score. Null and empty texts get the score of a document without words; rows may repeat.
    Texts are not shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        emissions = _Emissions(field)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, 1, 2 << 20, 5000):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            words = [t.translate(ALNUM_BYTES).split() for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            p, _ = marginals(emissions(words), sizes, field.steps, counts=False)
            x = doc_features(p, sizes) @ field.calibration
            ends = np.cumsum(sizes)
            hit = p >= at_least
            toxic = np.flatnonzero(np.diff(np.r_[0, np.r_[0, np.cumsum(hit)][ends]]))
            spans: list[list] = [[] for _ in texts]
            for k in toxic.tolist():
                spans[k] = _offsets(texts[k], hit[ends[k] - sizes[k] : ends[k]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))), pa.array(spans, kind)],
                names=["doc_id", "score", "spans"],
            )

    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(chosen, run, f"doc_id long, score double, spans {SPAN}")


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    scored = score(docs, fit(docs, labels, **settings))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
