"""The pipeline's stages, each on what the stage before it kept."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from opslog.llm import common, simhash
from opslog.llm.common import stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, DATA), name)
        kept[name] = (before.toPandas(), docs.toPandas())
        if name != "pack":
            assert docs.columns == columns and docs.dtypes == before.dtypes, name

    before, after = kept["language_id"]
    assert len(after) >= 0.98 * len(before)

    before, after = kept["line_dedup"]
    lines = after.text.str.split("\n").explode().str.strip(" \t\n\x0b\x0c\r").str.lower()
    often = lines[lines.str.len() >= 20].groupby(level=0).unique().explode().value_counts()
    assert (often < 3).all()

    before, after = kept["near_dedup"]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in after.text]
    assert not any(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert after.doc_id.is_unique and set(after.doc_id) <= set(before.doc_id)

    before, after = kept["decontaminate"]
    b = pd.read_parquet(f"{DATA}/benchmark.parquet")
    windows = set()
    for t in b.text:
        w = common.words_of(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    n_before = {d: t for d, t in zip(before.doc_id, before.text)}
    for d, t in zip(after.doc_id, after.text):
        w = common.words_of(n_before[d])
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w))):
            assert t == n_before[d]

    _, packed = kept["pack"]
    assert set(packed.doc_id) == set(after.doc_id)
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()
    assert np.isclose(packed.length.sum(), packed.groupby("doc_id").apply(lambda g: (g.start + g.length).max(), include_groups=False).sum())


def test_odd_rows_pass_through(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, text, "en", "s", 3), (2, text, "en", "s", 3), (2, text, "en", "s", 3), (3, None, "en", None, None), (None, text, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit(1))
    for docs_in in (docs, docs.filter("false")):
        now = docs_in
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, DATA), name)
        assert now.count() <= docs_in.count()
