"""N-gram Jaccard join by parity sketches, exact.

A set's tokens are dealt to p blocks by their hashes, and each block is the XOR of its tokens' hashes: a token that only one of
two sets holds changes one block, so two sets that differ in d tokens agree in p - d blocks at least. Sizes are cut into bands
whose ends are the similarity apart, so linked sets lie in one band or in two neighbours; a band has its own p, a few more than
the most tokens that linked sets of it can differ in. Every set makes keys of its blocks by the rules of its own band and of
the band below, and linked sets share a key.

What keys bring together is cut down by sizes and by a second sketch, one bit a token, whose Hamming distance is at most the
number of differing tokens. The rest is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_of, mix
from .common import join_counted, long_id, map_texts, slices, stored, texts_of, whole_text
from .components import components
from .near_copies import centres, likely_pairs, similar, texts_apart
from .simhash import shingle_hashes

#: Longs in the sketch of one bit a token.
SKETCH = 16


class Bands:
    """starts[k]: the least size in band k; most[k]: tokens in which linked sets can differ whose smaller one is in band k;
    blocks[k]: its number of blocks."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * 100 // percent + 1)
        last = [s - 1 for s in starts[1:]]
        self.starts = np.array(starts[:-1], np.int64)
        self.most = np.array([(100 - percent) * (a + a * 100 // percent) // (100 + percent) for a in last], np.int64)
        self.blocks = self.most + 1 + np.maximum(1, self.most // 50)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1


def block_keys(tokens: np.ndarray, ends: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the blocks of each set under the rules of its `band` (below 0: none). ends: where each set's tokens end.

    Blocks without a token agree in unrelated sets. They are left out, unless a set has so many of them that they could be all
    that it shares with another.
    """
    sizes = np.diff(ends, prepend=0)
    there = (band >= 0) & (bands.most[band] > 0) & (sizes > 0)
    blocks = np.where(there, bands.blocks[band], 0)
    first = np.cumsum(blocks) - blocks
    of = np.repeat(np.arange(len(sizes)), sizes)
    used = there[of]
    of, own = of[used], mix(tokens[used])
    at = (own >> np.uint64(32)) * blocks[of].astype(np.uint64) >> np.uint64(32)
    sums = np.zeros(int(blocks.sum()), np.uint64)
    np.bitwise_xor.at(sums, first[of] + at.astype(np.int64), mix(own ^ np.uint64(0x9E3779B97F4A7C15)))
    holder = np.repeat(np.arange(len(sizes)), blocks)
    place = np.arange(len(holder)) - first[holder]
    empty = np.bincount(holder[sums == 0], minlength=len(sizes))
    kept = (sums != 0) | (empty >= blocks - bands.most[band])[holder]
    keys = mix(sums ^ mix((place.astype(np.uint64) << np.uint64(10)) + band[holder].astype(np.uint64) + np.uint64(1)))
    return holder[kept], keys[kept]


def bit_sketches(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[set, SKETCH] longs, in which each token of a set turns one bit over."""
    sizes = np.diff(ends, prepend=0)
    h = mix(tokens ^ np.uint64(0xD6E8FEB86659FD93))
    out = np.zeros(len(sizes) * SKETCH, np.uint64)
    word = np.repeat(np.arange(len(sizes)) * SKETCH, sizes) + (h >> np.uint64(60)).astype(np.int64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (h & np.uint64(63)))
    return out.reshape(-1, SKETCH)


def _sets(texts: list[str], shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct hashes of each text, and a 128-bit name for each set: [text, 2]."""
    sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in texts]
    names = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
    return sets, np.frombuffer(names, "<i8").reshape(-1, 2)


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, *, percent: int, id_col="doc_id", text_col="text", shingle=4) -> DataFrame:
    """doc_id, n (size of the set), node and c2 (the set's name), bits, keys. Texts are not shuffled."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=500):
            sets, names = _sets(texts_of(batch.column(1)), shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens, ends = np.concatenate(sets), np.cumsum(sizes)
            band = np.where(sizes > 0, bands.of(sizes), -1)
            both = [block_keys(tokens, ends, b, bands) for b in (band, band - 1)]
            of, keys = (np.concatenate(x) for x in zip(*both))
            order = np.argsort(of, kind="stable")
            made = _lists(of[order], keys[order], len(sets))
            bits = pa.FixedSizeListArray.from_arrays(pa.array(bit_sketches(tokens, ends).reshape(-1).view(np.int64)), SKETCH).cast(pa.list_(pa.int64()))
            columns = [batch.column(0), pa.array(sizes), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), bits, made]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "node", "c2", "bits", "keys"])

    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(chosen, run, "doc_id long, n long, node long, c2 long, bits array<long>, keys array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """key, node: distinct rows of keys that sets of two names hold, and a few more.

    Keys are counted without their sets first: one shuffle, summed before it. Those of two sets go into a Bloom filter of bounded
    size, and only rows that it holds are shuffled with their sets.
    """
    ends = rows.select("node", F.explode("keys").alias("h")).groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = stored(ends.filter("lo <> hi").select(F.lit(0).alias("shard"), "h"), "shared-keys")
    bloom = rows.sparkSession.sparkContext.broadcast(bloom_of(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            held = np.flatnonzero(bloom.value.holds(0, keys.view(np.uint64)))
            of = np.repeat(np.arange(len(sizes)), sizes)[held]
            yield pa.RecordBatch.from_arrays([pa.array(keys[held]), batch.column(0).take(pa.array(of))], names=["key", "node"])

    return map_texts(rows.select("node", "keys"), run, "key long, node long").distinct()


def sets_of(docs: DataFrame, asked: DataFrame, *, id_col="doc_id", text_col="text", shingle=4) -> DataFrame:
    """node, shingles of the nodes asked for (node, least: a doc_id that holds it). Only texts whose id a Bloom filter of bounded
    size holds are cut into shingles, and only their sets are shuffled."""
    ids = asked.filter("least IS NOT NULL").select(F.lit(0).alias("shard"), F.xxhash64("least").alias("h"))
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = bloom.value.holds(0, whole.column(2).to_numpy().view(np.uint64)) | whole.column(0).is_null().to_numpy(zero_copy_only=False)
            for batch in slices([whole.take(pa.array(np.flatnonzero(held)))], 1, 1 << 20):
                sets, names = _sets(texts_of(batch.column(1)), shingle)
                made = _lists(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0].copy()), made], names=["node", "shingles"])

    id_ = long_id(docs, id_col)
    chosen = docs.select(id_.alias("doc_id"), whole_text(text_col).alias("text"), F.xxhash64(id_).alias("h"))
    made = map_texts(chosen, run, "node long, shingles array<long>")
    return made.join(asked.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def close_enough(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sizes and bit sketches do not rule out."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "uv")
    both = F.col("n_u") + F.col("n_v")
    sized = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    apart = F.aggregate(F.zip_with("bits_u", "bits_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "u").join(b, "v").filter(sized & (apart * (100 + percent) <= (100 - percent) * both)).select("u", "v")


def jaccard_groups(docs: DataFrame, *, percent: int = 85, id_col="doc_id", text_col="text", shingle=4) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    Words are runs without ASCII blanks, A-Z lower-cased; a document's set is that of its distinct runs of `shingle` words, of all
    its words if they are fewer. Two documents link when 100 * intersection >= percent * union; component_id is the smallest
    doc_id that links reach, the own one included. Null, empty and blank texts have no set and link with nothing, not with one
    another either. Documents of one set enter once. Repeated rows stay; a null id is never a component_id unless its component
    has no other. An empty table gives an empty result; other columns are not read.

    In each key's sets, every set meets the one with the most company and the first; where sets of a key are then still in
    different components, all their pairs are settled by an exact join on their rarest shingles. So work grows with the rows
    of keys and not with the square of a group, and no link between components is lost. Shingles are 64-bit hashes, and sets are
    told apart by 64 bits in joins.
    """
    rows = stored(sketches(docs, percent=percent, id_col=id_col, text_col=text_col, shingle=shingle), "parity")
    full = rows.filter("n > 0")
    nodes = full.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = stored(nodes, "nodes")
    keyed = stored(shared_keys(full), "keyed")
    counts = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n")), "buckets")
    inner = stored(join_counted(keyed, counts, ["key"], "rows", keyed.count()).select(F.lit(0).alias("band"), "key", "n", "node"), "inner")
    tops = stored(centres(inner).withColumn("rows", F.col("n")), "centres")
    met = join_counted(inner.drop("n"), tops, ["band", "key"], "rows", inner.count())
    met = met.select("node", F.explode(F.array("hub", "lo")).alias("other")).filter("node <> other")
    pairs = stored(met.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct(), "pairs")
    asked = stored(nodes.join(inner.select("node").distinct(), "node", "left_semi").select("node", "least"), "asked")
    sets = stored(sets_of(docs, asked, id_col=id_col, text_col=text_col, shingle=shingle), "sets")
    links = similar(stored(close_enough(pairs, nodes, percent), "close"), sets, percent / 100)
    roots = stored(components(links), "roots")
    apart = stored(texts_apart(inner, roots), "apart")
    if not apart.isEmpty():
        mass = apart.groupBy("root").agg(F.count("*").alias("mass"))
        open_sets = stored(sets.join(apart.join(mass, "root"), "node"), "open_sets")
        likely = stored(close_enough(likely_pairs(open_sets, percent / 100), nodes, percent), "pairs")
        found = similar(likely, open_sets, percent / 100)
        between = found.join(apart.toDF("u", "_u"), "u").join(apart.toDF("v", "_v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        joined = components(between).toDF("root", "_least")
        every = roots.unionByName(apart).distinct()
        roots = every.join(joined, "root", "left").select("node", F.coalesce("_least", "root").alias("root"))
    named = nodes.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "root").select("node", "copies", "component_id"), "named")
    grouped = join_counted(full.select("doc_id", "n", "node"), named, ["node"], "copies", rows.count())
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return grouped.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
