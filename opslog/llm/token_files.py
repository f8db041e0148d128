"""Token ids as Parquet: list columns in document order, with encodings, row groups and page indexes under control.

Files are ordered by doc_id, so the statistics of row groups and pages let a reader fetch the ids of a few documents,
or the metadata columns alone, without touching the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import long_id, map_texts, slices, whole_text
from .tokenize import BYTE_BPE, encoder, with_end

END_ID = 0


def _writer_options(encoding: str, row_group_mb: int, page_kb: int) -> dict[str, str]:
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    return {
        "compression": "zstd",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "2000",
    }


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    id_col="doc_id",
    text_col="text",
    tokenizer=BYTE_BPE,
    end_id=END_ID,
    specials_as_text=False,
    encoding="dictionary",
    row_group_mb=32,
    page_kb=256,
) -> None:
    """Writes doc_id, block, start_in_block, n_tokens and tokens in ascending doc_id order; a block is one file.

    Null and empty texts have the end id alone. Null ids come first; rows of one id are kept side by side in the order in which
    they are read, and an id that many rows share fills several files. Strings of the tokenizer's added tokens become those
    tokens' ids, or ordinary text with specials_as_text. The one shuffle is the range partitioning of the texts by doc_id;
    ids are made after it.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("block", pa.int32()),
            ("start_in_block", pa.int64()),
            ("n_tokens", pa.int64()),
            ("tokens", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(tokenizer, specials_as_text), 0
        for batch in slices(batches, 1, 4 << 20, 20_000):
            ids, starts = with_end(*encode(batch.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32)))
            columns = [batch.column(0), batch.column(2), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            before += int(starts[-1])

    ordered = (
        docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange("doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
        .select("doc_id", "text", F.spark_partition_id().alias("block"))
    )
    ids = map_texts(ordered, run, "doc_id long, block int, start_in_block long, n_tokens long, tokens array<int>", rows=4000)
    ids.write.options(**_writer_options(encoding, row_group_mb, page_kb)).parquet(path)


def read_documents(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, n_tokens and tokens of the documents in [first, last]; other row groups and pages are skipped."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df.select("doc_id", "n_tokens", "tokens")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """block, block_start: ids in all blocks before. Reads two metadata columns; a row per file."""
    sums = spark.read.parquet(path).groupBy("block").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("block_start"))


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the files have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "block", "start_in_block", "n_tokens", "ids_crc32"],
            )

    read = spark.read.parquet(path).select("doc_id", "block", "start_in_block", "tokens")
    rows = map_texts(read, run, "doc_id long, block int, start_in_block long, n_tokens long, ids_crc32 long")
    # a row per file: far below any limit of a broadcast
    return rows.join(F.broadcast(block_starts(spark, path)), "block").select(
        "doc_id", (F.col("start_in_block") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32"
    )
