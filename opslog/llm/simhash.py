"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into segments of four bits and mapped to the vector of their bit counts. The Manhattan distance
of two such vectors is at most their Hamming distance, so fingerprints within 3 bits are within 3 in the vector, and within 1 in
at least one half of it. Each half is a cell of a grid of its own: a fingerprint meets those of its own cell and of the cells
one step up, which finds every pair within 1 once, whichever of the two lies lower. Of what meets, only pairs whose whole
vectors are within 3 leave the join; those are then verified on the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, long_id, map_texts, slices, stored, texts_of, whole_text
from .components import components

SEED = 42
#: For each byte, eight counters of eight bits with its bits.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str, n: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(n)))), repeat(SEED)))


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per document from the hashes of all documents in turn: bits set in over half of its hashes."""
    prints = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return prints
    counts = counts[full]
    starts = np.cumsum(counts) - counts
    # eight-bit counters hold 255 hashes: longer documents are summed in chunks
    chunks = -(-counts // 255)
    first = np.cumsum(chunks) - chunks
    chunk_starts = np.repeat(starts, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, byte]], chunk_starts)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        packed = np.packbits(2 * bits > counts[:, None], axis=1, bitorder="little")[:, 0]
        prints[full] |= packed.astype(np.uint64) << np.uint64(8 * byte)
    return prints


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long). Texts without words have fp 0. Texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [np.array(shingle_hashes(t, shingle), np.uint64) for t in texts_of(batch.column(1))]
            prints = majority_bits(np.concatenate(each), np.array([len(x) for x in each], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(chosen, run, "doc_id long, fp long")


def segment_counts(half: Column, segment_bits: int) -> Column:
    """The bit counts of a 32-bit half's segments of 1, 2, 4 or 8 bits, each count where its segment is: counts of neighbours are
    added until a segment is one."""
    out = half
    for width, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F)):
        if width < segment_bits:
            out = out.bitwiseAND(F.lit(mask)) + F.shiftrightunsigned(out, width).bitwiseAND(F.lit(mask))
    return out


def manhattan(a: Column, b: Column, segment_bits: int) -> Column:
    """The distance of two vectors of segment counts."""
    if segment_bits == 1:
        return F.bit_count(a.bitwiseXOR(b))
    full = F.lit((1 << segment_bits) - 1)
    at = lambda c, k: F.shiftrightunsigned(c, k).bitwiseAND(full)
    out = F.lit(0)
    for k in range(0, 32, segment_bits):
        out = out + F.abs(at(a, k) - at(b, k))
    return out


def _steps_up(cell: Column, segment_bits: int) -> Column:
    """What to add to a cell for each of the cells one step up: segments that are not full have one."""
    steps = F.array(*(F.lit(1 << k).cast("long") for k in range(0, 32, segment_bits)))
    full = lambda s: cell.bitwiseAND(s * ((1 << segment_bits) - 1)) == s * segment_bits
    return F.filter(steps, lambda s: ~full(s))


def _inside_hot_cells(raised: DataFrame, cells: DataFrame, most: int, segment_bits: int) -> DataFrame:
    """u, v, step: pairs that meet in a cell, are within 1 in a quarter of the bits beside it as well, and within `most` in all.

    The half beside the cell differs in at most 3 bits, so one of its two quarters differs in at most 1. A fingerprint meets
    its own quarter and the sixteen one bit away. No cell and quarter have more than 65,536 fingerprints.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(16)))
    quarters = lambda of: F.array(
        *(F.struct(F.lit(k).alias("quarter"), F.shiftrightunsigned(of, 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("bits")) for k in (0, 1))
    )
    asked = raised.select("u", "half", "step", "cell", "near", F.inline(quarters(F.col("rest")))).withColumn("bits", F.explode(F.transform(flips, lambda f: F.col("bits").bitwiseXOR(f))))
    keys = ["half", "cell", "quarter", "bits"]
    there = cells.select("v", "half", "cell", "beside", F.inline(quarters(F.col("rest")))).toDF("v", "_half", "_cell", "beside", "_quarter", "_bits")
    together = manhattan(F.col("near"), F.col("beside"), segment_bits) + (F.col("step") != 0).cast("int") <= most
    for k in keys:
        together = together & (F.col(k) == F.col(f"_{k}"))
    return asked.join(there, together).select("u", "v", "step")


def near_links(prints: DataFrame, *, most: int = 3, segment_bits: int = 4, hot_cell: int = 2000) -> DataFrame:
    """u, v: every pair of different values of prints.fp (distinct, not null) within `most` <= 3 bits.

    Cells with more than hot_cell fingerprints are split by the bits beside them, see _inside_hot_cells; the links are the same.
    """
    if not 0 <= most <= 3:
        raise ValueError("two halves find pairs of at most 3 differing bits")
    if segment_bits not in (1, 2, 4, 8):
        raise ValueError("segments have 1, 2, 4 or 8 bits")
    met = grid_join(prints, most=most, segment_bits=segment_bits, hot_cell=hot_cell)
    within = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most
    return met.filter(((F.col("step") != 0) | (F.col("u") < F.col("v"))) & within).select("u", "v").distinct()


def grid_join(prints: DataFrame, *, most: int, segment_bits: int, hot_cell: int) -> DataFrame:
    """u, v, step: candidates, the pairs that meet in a cell of a half's grid and whose vectors are within `most`; a pair can come
    twice, once from each half, and of equal cells in both orders."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = F.array(
        *(
            F.struct(F.lit(k).alias("half"), segment_counts(own, segment_bits).alias("cell"), rest.alias("rest"), segment_counts(rest, segment_bits).alias("beside"))
            for k, own, rest in ((0, low, high), (1, high, low))
        )
    )
    cells = prints.select(F.col("fp").alias("v"), F.inline(halves))
    up = F.concat(F.array(F.lit(0).cast("long")), _steps_up(F.col("cell"), segment_bits))
    raised = cells.withColumnsRenamed({"v": "u", "beside": "near"}).withColumn("step", F.explode(up)).withColumn("cell", F.col("cell") + F.col("step"))
    there = cells.select("v", F.col("half").alias("_half"), F.col("cell").alias("_cell"), "beside")
    apart = manhattan(F.col("near"), F.col("beside"), segment_bits) + (F.col("step") != 0).cast("int")
    together = (F.col("half") == F.col("_half")) & (F.col("cell") == F.col("_cell")) & (apart <= most)
    hot = stored(cells.groupBy("half", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > hot_cell).drop("n"), "hot-cells")
    if hot.isEmpty():
        return raised.join(there, together).select("u", "v", "step")
    split = lambda df, how: df.join(hot, ["half", "cell"], how)
    cold = split(cells, "left_anti").select("v", F.col("half").alias("_half"), F.col("cell").alias("_cell"), "beside")
    met = raised.join(cold, together).select("u", "v", "step")
    return met.unionByName(_inside_hot_cells(split(raised, "left_semi"), split(cells, "left_semi"), most, segment_bits))


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=3, most=3, segment_bits=4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Copies share a fingerprint and enter the links once. Null and empty texts have fingerprint zero and are linked
    like any other. Repeated rows stay, one result row each; a null id is never a component_id unless its
    component has no other. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(near_links(classes.select("fp"), most=most, segment_bits=segment_bits)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "n", "component_id"), "named")
    return join_counted(prints, named, ["fp"], "n", prints.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
