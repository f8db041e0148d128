"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslog.llm import decontaminate, language_id, line_dedup, near_copies, packing
from opslog.llm.common import stored, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence settles, row by row: what a decision rests on besides the pages of an id (its
    text, declared language and source) tells rows of one id, or of none, apart."""
    same = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    decided = language_id.identify(docs, table(spark, sf_dir, "pages"), keep=[same.alias("_same"), F.col("source").alias("_source")])
    kept = decided.filter("kept").select(F.col("doc_id").alias("_id"), "_same", F.col("declared").alias("_lang"), "_source").distinct()
    alike = docs["doc_id"].eqNullSafe(kept["_id"]) & (same == kept["_same"]) & docs["lang"].eqNullSafe(kept["_lang"]) & docs["source"].eqNullSafe(kept["_source"])
    return docs.join(kept, alike, "left_semi")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the last document holding them; documents left without any text go.

    n_chars is counted anew where the text changed."""
    clean = line_dedup.dedup_lines(docs)
    gone = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.filter(~gone).withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id: 5-word shingles at a similarity of 0.8,
    found by SimHash and MinHash and verified."""
    return near_copies.drop_near_copies(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated spans are cut out; documents of nothing else go."""
    clean = decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, 8 documents and three quarters of the attention cost of one undivided sequence at most."""
    return packing.pack_documents(docs, max_docs=8, max_attention=0.75 * 1024**2, weights=(1.0, 0.25, 0.25))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontaminate", cut_benchmark_passages),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no tokenizer, XXH64 or fitted models; the tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
