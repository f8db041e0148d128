"""Spelling variants by Bloom-guided neighbourhoods.

Every word's edits are generated and probed in blocked Bloom filters of the vocabulary, one shard per word length. Only edits
that a filter holds are shuffled, to an exact join with the vocabulary that removes what the filters found by chance. Being
near is symmetric, so each pair is generated once: by deletions from its longer word, or by replacements with a later letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom, bloom_of, mix
from .common import long_id, map_texts, slices, stored, texts_of, whole_text

#: By code point: A-Z become a-z, other letters up to U+00FF stay, all else is a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

#: Distinct words that a task counts before it hands them on.
HELD = 200_000

#: Shards: one for each length below this, then one for each power of two.
SINGLE = 64


def words_in(text: str) -> list[bytes]:
    """Maximal runs of letters, one byte a code point (U+00FF is the last letter), A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode("utf-8")


def slipped(word: bytes, seed: int, every: int) -> bytes:
    """The word, without one letter if `every` divides its checksum. seed: the checksum of what stands before the word."""
    h = zlib.crc32(_utf8(word), seed)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars=5, min_count=3, slip_every: int | None = None) -> DataFrame:
    """word, n: words of at least min_chars code points with at least min_count occurrences in all texts.

    slip_every: plants slips of the pen first, see `slipped`; the checksum is that of "<id>:<word>" (of ":<word>" for a null id).
    Tasks hand on sums of at most HELD words, which a grouping adds up, so a word that fills the corpus is a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                own = Counter(words_in(text))
                seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in own.items():
                    if slip_every:
                        word = slipped(word, seed, slip_every)
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield rows()
        yield rows()

    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    counts = map_texts(chosen, run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _shard(length: int) -> int:
    return length if length < SINGLE else SINGLE + (length // SINGLE).bit_length()


def _factors(n: int) -> np.ndarray:
    """An odd factor for each place in a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def by_length(words: list[bytes], most_cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, letters [word, place]) for words of one length, about most_cells letters at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, most_cells // max(1, int(length)))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            yield own, np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(len(own), int(length))


def word_hashes(letters: np.ndarray) -> np.ndarray:
    """A hash for each row of letters, a mixed sum in which each place has its own factor."""
    return mix((letters.astype(np.uint64) * _factors(letters.shape[1])).sum(axis=1, dtype=np.uint64))


def filter_keys(words: DataFrame) -> DataFrame:
    """shard, h of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_ = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            shard, h = np.zeros(len(words_), np.int32), np.zeros(len(words_), np.uint64)
            for at, letters in by_length(words_, 1 << 20):
                shard[at], h[at] = _shard(letters.shape[1]), word_hashes(letters)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h.view(np.int64))], names=["shard", "h"])

    return words.select("word").mapInArrow(run, "shard int, h long")


def _deletions(letters: np.ndarray, bloom: BlockedBloom) -> tuple[np.ndarray, np.ndarray]:
    """(row, letters) of the words without one letter that the filter holds; of a run of one letter only the last goes."""
    n, length = letters.shape
    if length < 2:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.uint8)
    factors, codes = _factors(length), letters.astype(np.uint64)
    before = np.cumsum(codes * factors, axis=1, dtype=np.uint64) - codes * factors
    moved = codes * np.r_[np.uint64(0), factors[:-1]]
    after = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - moved
    last = np.ones(letters.shape, bool)
    last[:, :-1] = letters[:, :-1] != letters[:, 1:]
    row, place = np.nonzero(bloom.holds(_shard(length - 1), mix(before + after)) & last)
    keep = np.arange(length)[None, :] != place[:, None]
    return row, letters[row][keep].reshape(len(row), length - 1)


def _replacements(letters: np.ndarray, alphabet: np.ndarray, bloom: BlockedBloom) -> tuple[np.ndarray, np.ndarray]:
    """(row, letters) of the words with one letter replaced by a later one of the alphabet that the filter holds."""
    length = letters.shape[1]
    factors, codes = _factors(length), letters.astype(np.uint64)
    whole = (codes * factors).sum(axis=1, dtype=np.uint64)
    rows, made = [], []
    for letter in alphabet:
        row, place = np.nonzero(letters < letter)
        h = whole[row] + (np.uint64(letter) - codes[row, place]) * factors[place]
        held = bloom.holds(_shard(length), mix(h))
        row, place = row[held], place[held]
        other = letters[row]
        other[np.arange(len(row)), place] = letter
        rows.append(row)
        made.append(other)
    return np.concatenate(rows), np.concatenate(made)


def near_candidates(words: DataFrame, bloom: BlockedBloom, alphabet: list[str]) -> DataFrame:
    """word, n, other: edits of the words that the filter holds, true ones and some that it holds by chance."""
    letters_ = np.array(sorted(c.encode("latin-1")[0] for c in alphabet), np.uint8)
    shared = words.sparkSession.sparkContext.broadcast((bloom, letters_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, own_alphabet = shared.value
        for batch in batches:
            words_ = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for at, letters in by_length(words_, 1 << 17):
                for row, made in (_deletions(letters, filters), _replacements(letters, own_alphabet, filters)):
                    if len(row):
                        of = pa.array(at[row])
                        others = pa.array([bytes(x).decode("latin-1") for x in made], pa.string())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), others], names=["word", "n", "other"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_words(words: DataFrame, *, most_filtered: int = 50_000_000, bits: int = 24) -> DataFrame:
    """a, n_a, b, n_b: every pair of words (word, n; distinct) that one inserted, deleted or replaced code point tells apart, once.

    words should be a stored table. Filters hold at most most_filtered words at a time (150 MB); a larger vocabulary is dealt to
    parts by hash, whose filters are broadcast and probed one after another.
    """
    parts = max(1, -(-words.count() // most_filtered))
    alphabet = [r[0] for r in words.select(F.explode(F.split("word", ""))).filter("col <> ''").distinct().collect()]  # letters up to U+00FF
    out = None
    for k in range(parts):
        part = words if parts == 1 else words.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == k)
        bloom = bloom_of(filter_keys(part), bits=bits, most_bytes=most_filtered * bits // 8)
        held = near_candidates(words, bloom, alphabet) if alphabet else words.selectExpr("word", "n", "word AS other").limit(0)
        met = held.join(part.select(F.col("word").alias("other"), F.col("n").alias("n_b")), "other")
        met = met.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("other").alias("b"), "n_b")
        out = met if out is None else out.unionByName(met)
    return out


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (word, form) from each word ends. Forms must not run in circles.

    Each round doubles the reach of every word's pointer; a form has at least twice its word's count, so six rounds follow any
    chain that 2^64 occurrences allow.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.drop("moved")


def spelling_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars=5, min_count=3, ratio=2, slip_every: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: the vocabulary with each word's usual form.

    A word's form is its near word of the largest n (of equals the smallest in code-point order) if that is at least `ratio` times
    its own n; root follows forms to the last and is the word itself where there is none. Null and empty texts have no words; a
    null doc_id only changes planted slips. Every row counts, repeated ones too. An empty table gives an empty result; other
    columns are not read. A word has at most 91 near words a place, so no group of them is unbounded.
    """
    words = stored(vocabulary(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_count=min_count, slip_every=slip_every), "vocabulary")
    pairs = near_words(words)
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")),
    )
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other"))
    near = pairs.select(F.inline(ways)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("n_other"))
    common = F.col("n_other") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("other")).alias("form"), F.when(common, F.col("n_other")).alias("form_n")
    )
    formed = stored(formed, "forms")
    roots = roots_of(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
