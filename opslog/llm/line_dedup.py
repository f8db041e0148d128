"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, last_doc), bucketed and sorted by the hash, one file a bucket, and no hash is in two runs. A
batch of documents is grouped by hash and merge-anti-joined with the runs: hashes in none of them become the batch's own run,
the others are noted as later appearances, in runs of their own. Two runs of a level are merged into one of the next, so n
batches are rewritten log(n) times. As a bucket is one sorted file, the planner takes its order as it is: runs are merged
without being shuffled, sorted or broadcast. Only what is written as a new run is sorted, which for a merge is in order already.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_counted, long_id, map_texts, new_path, quoted, slices, stored, texts_of, whole_text

BLANKS = b" \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, None when the key is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _ids(docs: DataFrame, id_col: str, text_col: str) -> list:
    """doc_id, copy: what tells a document's text; rows alike in both lose the same lines."""
    return [long_id(docs, id_col).alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("copy")]


def line_hashes(docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars=20, keep=()) -> DataFrame:
    """doc_id, copy, the columns of keep, h1, h2: each document's distinct line keys of at least min_chars code points."""
    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"), *_ids(docs, id_col, text_col)[1:], *keep)
    kept = [f for f in chosen.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = []
            for text in texts_of(batch.column(1)):
                own = {line_hash(line, min_chars) for line in text.encode("utf-8", "surrogatepass").split(b"\n")}
                own.discard(None)
                each.append(own)
            pairs = np.frombuffer(b"".join(h for own in each for h in own), "<i8").reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            columns = [batch.column(f.name).take(of) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(pairs[:, k].copy()) for k in (0, 1))], names=[*(f.name for f in kept), *HASH])

    return map_texts(chosen, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", h1 long, h2 long")


#: Lets the planner trust the order of a bucket that is one sorted file.
TRUST_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def trusted_order(spark: SparkSession) -> Iterator[None]:
    """The session with TRUST_ORDER on; its own setting comes back afterwards."""
    before = spark.conf.getAll.get(TRUST_ORDER)
    spark.conf.set(TRUST_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.unset(TRUST_ORDER) if before is None else spark.conf.set(TRUST_ORDER, before)


class LineRuns:
    """The levels of runs, and those of later appearances. Their names are the only state on the driver: log(batches).

    A context: on leaving it, all runs are dropped and deleted, whatever happened inside. Joins of runs are to be planned and run
    inside it, where the order of their files is trusted.
    """

    def __init__(self, spark: SparkSession, *, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.firsts: list[str | None] = []
        self.again: list[str | None] = []
        self.paths: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        self.trust = trusted_order(self.spark)
        self.trust.__enter__()
        return self

    def __exit__(self, *error) -> None:
        try:
            self.clear()
        finally:
            self.trust.__exit__(None, None, None)

    def clear(self) -> None:
        for name in list(self.paths):
            self._drop(name)

    def _write(self, rows: DataFrame) -> str:
        """rows (already dealt by hash to as many partitions as there are buckets) as a run: one file a bucket."""
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        self.paths[name] = path
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self.paths.pop(name))

    def _runs(self, levels: list[str | None]) -> list[DataFrame]:
        return [self.spark.table(name) for name in levels if name]

    def _push(self, levels: list[str | None], run: str) -> None:
        """Puts a run at level 0; two of a level are merged into one of the next by a join of their buckets."""
        at = 0
        while at < len(levels) and levels[at]:
            both = [run, levels[at]]
            run = self._write(merged(*map(self.spark.table, both)))
            levels[at] = None
            for name in both:
                self._drop(name)
            at += 1
        if at == len(levels):
            levels.append(None)
        levels[at] = run

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows whose hash is in no run: the merge-anti-join that a new batch starts with. lines: a table laid out like a run."""
        for run in self._runs(self.firsts):
            lines = lines.hint("merge").join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """One batch: (doc_id, h1, h2), at most once per document and line. What is new becomes a run."""
        counted = lines.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))  # summed before it is shuffled
        own = self._write(counted.repartition(self.buckets, *HASH))
        if not any(self.firsts):
            self._push(self.firsts, own)
            return
        batch = self.spark.table(own)
        new = self._write(self.unseen(batch))
        seen = self._write(batch.hint("merge").join(self.spark.table(new).select(*HASH).hint("merge"), HASH, "left_anti"))
        self._drop(own)
        self._push(self.firsts, new)
        self._push(self.again, seen)

    def frequent(self, min_docs: int) -> DataFrame:
        """h1, h2, n_docs, last_doc of lines in at least min_docs documents of all batches."""
        out = None
        for run in self._runs(self.firsts):
            for k, more in enumerate(self._runs(self.again)):
                run = run.hint("merge").join(more.toDF(*HASH, f"n_{k}", f"last_{k}").hint("merge"), HASH, "left")
            n = sum((F.coalesce(c, F.lit(0)) for c in run.columns if c.startswith("n_")), F.lit(0))
            last = [c for c in run.columns if c.startswith("last_")]
            part = run.select(*HASH, n.alias("n_docs"), (F.greatest(*last) if len(last) > 1 else F.col(last[0])).alias("last_doc"))
            part = part.filter(F.col("n_docs") >= min_docs)
            out = part if out is None else out.unionByName(part)
        return out


def merged(run: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs as one: a merge join of their buckets, which leaves each bucket in its task."""
    b = other.toDF(*HASH, "n_more", "last_more").hint("merge")
    n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
    return run.hint("merge").join(b, HASH, "full").select(*HASH, n.alias("n_docs"), F.greatest("last_doc", "last_more").alias("last_doc"))


def repeated_lines(
    docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars=20, min_docs=3, batch_docs=50_000_000, least_batches=4
) -> DataFrame:
    """doc_id, copy, _drop: the hashes of the lines that each document loses (documents that lose none are not there).

    The documents come in batches of about batch_docs by the hash of their id, so that rows of one id are in one batch, at least
    least_batches; the result does not depend on their number.
    """
    spark, id_ = docs.sparkSession, long_id(docs, id_col)
    n_rows, twice = docs.count(), not docs.select(id_.alias("doc_id")).groupBy("doc_id").count().filter("count > 1").isEmpty()
    batches = max(least_batches, -(-n_rows // batch_docs))
    dealt = F.pmod(F.xxhash64(id_), F.lit(batches)).cast("int").alias("batch")
    path = new_path(spark, "lines")
    line_hashes(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, keep=[dealt]).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, copy long, h1 long, h2 long, batch int").parquet(path)
    with LineRuns(spark) as runs:
        for b in range(batches):
            own = lines.filter(F.col("batch") == b).select("doc_id", *HASH)
            runs.add(own.distinct() if twice else own)  # rows of one id hold a line once; rows of different ids are not alike anyway
        frequent = stored(runs.frequent(min_docs), "frequent-lines")
    held = join_counted(lines.drop("batch"), frequent, HASH, "n_docs", lines.count())
    lost = held.filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id", "copy").agg(F.collect_set(F.struct(*HASH)).alias("_drop"))


def dedup_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", **settings) -> DataFrame:
    """docs with text_col cleaned and the columns n_lines, n_dropped, kept_sha256 added (such columns of docs are replaced).

    A key of at least min_chars code points that min_docs documents or more hold keeps its lines only in the largest
    doc_id holding it. A document is an id: rows of one id count once and lose or keep a line alike, each in its own text; rows
    without an id count as one more document, which is never the largest. A null or empty text is one empty line and becomes an
    empty text. Every row gives a row; an empty table stays empty; extra columns pass through.
    """
    min_chars = settings.get("min_chars", 20)
    repeated = repeated_lines(docs, id_col=id_col, text_col=text_col, **settings)
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped", "kept_sha256")]
    inner = [f"c{k}" for k in range(len(others))]
    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(others, inner)), whole_text(text_col).alias("text"), *_ids(docs, id_col, text_col))
    same = rows["doc_id"].eqNullSafe(repeated["doc_id"]) & (rows["copy"] == repeated["copy"])
    joined = rows.join(repeated, same, "left").select(*inner, rows["text"], "_drop")
    at = len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            drops, kept, n, lost, sha = batch.column(at + 1), [], [], [], []
            flat, ends = drops.flatten(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(drops), 0).to_numpy(zero_copy_only=False))]
            raw_drops = np.stack([flat.field(k).to_numpy() for k in (0, 1)], axis=1).astype("<i8").tobytes()
            for text, a, b in zip(texts_of(batch.column(at)), ends[:-1].tolist(), ends[1:].tolist()):
                raw = text.encode("utf-8", "surrogatepass")
                lines = raw.split(b"\n")
                n.append(len(lines))
                if b > a:
                    gone = {raw_drops[16 * k : 16 * k + 16] for k in range(a, b)}
                    lines = [x for x in lines if line_hash(x, min_chars) not in gone]
                    raw = b"\n".join(lines)
                lost.append(n[-1] - len(lines))
                kept.append(raw.decode("utf-8", "surrogatepass"))
                sha.append(hashlib.sha256(raw).hexdigest())
            made = [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), *made], names=[*inner, "text", "n_lines", "n_dropped", "kept_sha256"])

    fields = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in [*inner, "text"])
    clean = map_texts(joined, run, f"{fields}, n_lines long, n_dropped long, kept_sha256 string")
    return clean.toDF(*others, text_col, "n_lines", "n_dropped", "kept_sha256")
