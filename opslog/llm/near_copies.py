"""Near copies by 5-word shingles at a Jaccard similarity of 0.8: the pipeline's near-duplicate stage.

Two texts of that similarity differ in 4 to 18 of 64 SimHash bits, where unrelated texts begin too, so fingerprints within 3
bits find only the closest copies. The stage therefore takes those pairs and adds MinHash bands as candidates, each of which is
verified by the exact similarity of the two shingle sets. A bucket's texts first meet its centre and first text; where texts of
a bucket are then still apart, an exact join on the rarest shingles of each finds every pair among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, long_id, map_texts, quoted, slices, spare, stored, texts_of, whole_text
from .components import components
from .simhash import majority_bits, near_links, shingle_hashes

BANDS, ROWS = 20, 5

#: Counters for how common shingles are; two shingles in one counter only make the order of shingles less telling.
SLOTS = 1 << 20


def _constants(n: int) -> list[tuple[np.uint64, np.uint64]]:
    """(mask, odd multiplier) of each permutation, from a fixed hash."""
    h = [xxhash.xxh64_intdigest(b"%d" % k, 7) for k in range(2 * n)]
    return [(np.uint64(h[2 * k]), np.uint64(h[2 * k + 1] | 1)) for k in range(n)]


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[document, band] keys from the shingle hashes of all documents in turn; each document has at least one."""
    starts = np.cumsum(counts) - counts
    keys = np.zeros((len(counts), BANDS), np.uint64)
    for k, (mask, factor) in enumerate(_constants(BANDS * ROWS)):
        mixed = (hashes ^ mask) * factor
        least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
        band = k // ROWS
        keys[:, band] = (keys[:, band] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, band] ^= keys[:, band] >> np.uint64(32)
    return keys


def _copies(texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """A 128-bit hash of each text's words: texts alike in it are copies."""
    digests = [xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())) for t in texts]
    c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, same: what tells a row's text within one id."""
    return docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.xxhash64(whole_text(text_col)).alias("same"))


def sketches(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=5) -> DataFrame:
    """doc_id, same, c1, c2 (hash of the words), fp, bands. Texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            each = [np.array(shingle_hashes(t, shingle) or [0], np.uint64) for t in texts]
            hashes, counts = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            keys = band_keys(hashes, counts).view(np.int64)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * BANDS
            prints = majority_bits(hashes, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *_copies(texts), pa.array(prints), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
                names=["doc_id", "same", "c1", "c2", "fp", "bands"],
            )

    return map_texts(_named(docs, id_col, text_col), run, "doc_id long, same long, c1 long, c2 long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=5) -> DataFrame:
    """c1, c2, shingles: the distinct hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            texts = texts_of(batch.column(1))
            sets = [np.unique(np.array(shingle_hashes(t, shingle) or [0], np.uint64)).view(np.int64) for t in texts]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([*_copies(texts), lists], names=["c1", "c2", "shingles"])

    return map_texts(_named(docs, id_col, text_col), run, "c1 long, c2 long, shingles array<long>")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of sets.shingles fall in each of SLOTS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    found = map_texts(sets.select("shingles"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return counts


def rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """node, root, mass, n, shingle, at, indexed: each text's n shingles from the rarest on, as many as a pair needs.

    Of two texts of that similarity, the first shingle they share in this order is among the rows of both, and is indexed in
    the one with fewer shingles.
    """
    shared = sets.sparkSession.sparkContext.broadcast(slot_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                lists = batch.column(3)
                flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sizes = np.diff(ends)
                probed = np.minimum(sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1, sizes)
                indexed = sizes - np.ceil(2 * similarity / (1 + similarity) * sizes - 1e-6).astype(np.int64) + 1
                chosen = []
                for k, p in enumerate(probed):
                    h = flat[ends[k] : ends[k + 1]]
                    chosen.append(h[np.lexsort((h, counts[h & (SLOTS - 1)]))[:p]])
                of = np.repeat(np.arange(len(sizes)), probed)
                at = np.arange(len(of)) - np.repeat(np.cumsum(probed) - probed, probed)
                taken = [batch.column(c).take(pa.array(of)) for c in range(3)]
                more = map(pa.array, (sizes[of].astype(np.int64), np.concatenate(chosen), at.astype(np.int64), at < indexed[of]))
                yield pa.RecordBatch.from_arrays([*taken, *more], names=["node", "root", "mass", "n", "shingle", "at", "indexed"])

    schema = "node long, root long, mass long, n long, shingle long, at long, indexed boolean"
    return map_texts(sets.select("node", "root", "mass", "shingles"), run, schema)


def likely_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: pairs of sets (node, root, mass, shingles) with different roots, all pairs of that similarity among them.

    Exact: a pair left out shares too few shingles. Only an indexed row of the smaller set meets rows of others, so what many
    texts have in common seldom meets at all. In the texts of one shingle those of the root with the most texts do not meet
    each other, so a large group that is linked already costs no more than its rows for each text outside it.
    """
    rare = stored(rare_shingles(sets, similarity), "rare")
    tops = rare.groupBy("shingle").agg(
        F.max(F.struct("mass", "root"))["root"].alias("top"), F.min("root").alias("_a"), F.max("root").alias("_b")
    )
    mixed = stored(rare.join(tops.filter("_a <> _b").select("shingle", "top"), "shingle"), "mixed")
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    can = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.root") != F.col("y.root"))
        & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node"))
        & (F.col("x.n") >= similarity * F.col("y.n") - 1e-6)
        & ((1 + similarity) * most >= similarity * (F.col("x.n") + F.col("y.n")) - 1e-6)
    )
    out = None
    for x, y in (("indexed AND root <> top", "true"), ("indexed AND root = top", "root <> top")):
        part = mixed.filter(x).alias("x").join(mixed.filter(y).alias("y"), can).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have that similarity."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").filter(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


def centres(inner: DataFrame) -> DataFrame:
    """band, key, n, hub, lo: for each bucket the text with the most neighbours in all its buckets, and the first text.

    Variants of one text share more buckets with it than with one another, so the hub is likely to be that text.
    """
    degree = inner.groupBy("node").agg(F.sum("n").alias("degree"))
    most = F.max(F.struct("degree", "node"))["node"]
    return inner.join(degree, "node").groupBy("band", "key", "n").agg(most.alias("hub"), F.min("node").alias("lo"))


def texts_apart(inner: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root: the texts of each bucket of three or more that links have not brought together.

    Where hub and first text are one, the other texts of a bucket of three have not met either."""
    rooted = stored(inner.filter("n > 2").join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    apart = rooted.groupBy("band", "key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b")
    return rooted.join(apart.select("band", "key"), ["band", "key"], "left_semi").select("node", "root").distinct()


def near_copy_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=5, similarity=0.8) -> DataFrame:
    """doc_id, same, root: every row with the number of its group of near copies; same tells texts of one id apart.

    Copies enter once, as a text with a number of its own. In a bucket of equal bands, or of equal fingerprints, each text is
    compared with the bucket's centre and first text; then every pair that no links connect yet is settled by
    likely_pairs. So no pair that shares a bucket is left out; with 20 bands of 5 rows a pair of similarity 0.8 shares one with
    a chance of 0.9996. Null and empty texts are copies of one another; an empty table gives an empty result.
    """
    rows = stored(sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle), "sketches")
    grouped = rows.groupBy("c1", "c2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n_rows"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
    )
    texts = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "texts")
    heads = stored(texts.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    close = (
        near_links(heads.select("fp"))
        .join(heads.select(F.col("fp").alias("u"), F.col("head").alias("hu")), "u")
        .join(heads.select(F.col("fp").alias("v"), F.col("head").alias("hv")), "v")
        .select(F.greatest("hu", "hv").alias("u"), F.least("hu", "hv").alias("v"))
    )
    banded = texts.select("node", F.posexplode(F.array_append("bands", F.col("fp"))).alias("band", "key"))
    shared = stored(banded.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n")), "buckets")
    inner = stored(join_counted(banded, shared, ["band", "key"], "rows", texts.count() * (BANDS + 1)), "inner")
    tops = stored(centres(inner).withColumn("rows", F.col("n")), "centres")
    met = join_counted(inner.drop("n"), tops, ["band", "key"], "rows", inner.count())
    met = met.select("node", F.explode(F.array("hub", "lo")).alias("other")).filter("node <> other")
    pairs = stored(met.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).union(close).distinct(), "pairs")
    asked = texts.join(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "node", "left_semi").select("c1", "c2", "node", "least")
    own = docs.join(asked.select(F.col("least").alias(spare(docs.columns, "least"))), quoted(id_col).eqNullSafe(F.col(spare(docs.columns, "least"))), "left_semi")
    made = shingle_sets(own, id_col=id_col, text_col=text_col, shingle=shingle).join(asked, ["c1", "c2"])
    sets = stored(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    roots = stored(components(similar(pairs, sets, similarity)), "roots")
    apart = stored(texts_apart(inner, roots), "apart")
    if not apart.isEmpty():
        mass = apart.groupBy("root").agg(F.count("*").alias("mass"))
        open_sets = stored(sets.join(apart.join(mass, "root"), "node"), "open_sets")
        found = similar(stored(likely_pairs(open_sets, similarity), "pairs"), open_sets, similarity)
        between = found.join(apart.toDF("u", "_u"), "u").join(apart.toDF("v", "_v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        joined = components(between).toDF("root", "_least")
        every = roots.unionByName(apart).distinct()
        roots = every.join(joined, "root", "left").select("node", F.coalesce("_least", "root").alias("root"))
    named = stored(
        texts.select("c1", "c2", "n_rows", "node").join(roots, "node", "left").select("c1", "c2", "n_rows", F.coalesce("root", "node").alias("root")), "named"
    )
    return join_counted(rows.select("doc_id", "same", "c1", "c2"), named, ["c1", "c2"], "n_rows", rows.count()).select("doc_id", "same", "root")


def _in_order(docs: DataFrame, name: str):
    """A column to order rows by; kinds that have no order, such as maps, by their text."""
    kind = docs.schema[name].dataType
    return quoted(name) if isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DatetimeType)) else quoted(name).cast("string")


def drop_near_copies(docs: DataFrame, *, id_col="doc_id", text_col="text", **settings) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, a null one last.

    Where the group has several texts of that id, the one with the smallest hash stays; of rows alike in id and text the
    first by their other columns stays.
    """
    groups = stored(near_copy_groups(docs, id_col=id_col, text_col=text_col, **settings), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "same")
    first = groups.groupBy("root").agg(F.min(place).alias("first"))
    hits = groups.groupBy("root", "doc_id", "same").agg(F.count("*").alias("n"))
    marked = stored(hits.join(first, "root").select("doc_id", "same", "n", (F.col("first") == place).alias("stays")), "marked")
    id_, same = spare(docs.columns, "near_id"), spare(docs.columns, "near_same")
    rows = docs.withColumns({id_: long_id(docs, id_col), same: F.xxhash64(whole_text(text_col))})

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left[id_].eqNullSafe(right["doc_id"]) & (left[same] == right["same"]), how)

    left = joined(rows, marked.filter(~F.col("stays")).select("doc_id", "same"), "left_anti")
    repeated = marked.filter("stays AND n > 1").select("doc_id", "same")
    if not repeated.isEmpty():
        order = [_in_order(docs, c) for c in docs.columns if c != text_col]
        salt, number = spare(rows.columns, "near_salt"), spare(rows.columns, "near_no")
        one = joined(left, repeated, "left_semi").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(64)))
        for part in ([id_, same, salt], [id_, same]):  # the first of each 64th of the repeats, then of those
            one = one.withColumn(number, F.row_number().over(W.partitionBy(*part).orderBy(*order))).filter(F.col(number) == 1)
        left = joined(left, repeated, "left_anti").unionByName(one.drop(number, salt))
    return left.select(*map(quoted, docs.columns))
