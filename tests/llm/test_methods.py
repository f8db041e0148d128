"""What the methods promise: early stops, real segments, merges without sorts, identity of rows, bounds per language."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opslog.llm import common, language_id, line_dedup, near_copies, queries, simhash, topk, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
LINE = "a line that is long enough to count"


# --- top-k ------------------------------------------------------------------------------------------------------------------------------


def scored_share(vectors, k=5, every=50):
    """The share of rows that a query scores in one block; results are held against brute force."""
    whole = np.floor(256 * vectors)
    n, asked = len(whole), np.arange(0, len(whole), every)
    turn = np.linalg.eigh(whole.T @ whole)[1][:, ::-1]
    best = topk.Best(len(asked), k)
    scored = topk.SortedLists(np.arange(n), np.arange(n), whole, turn).search(whole[asked], asked, best, np.arange(len(asked)))
    every_score = whole[asked] @ whole.T
    every_score[np.arange(len(asked)), asked] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(n), every_score.shape), -every_score), axis=1)[:, :k]
    assert (best.ids == order).all() and (best.scores == np.take_along_axis(every_score, order, 1)).all()
    return float(scored.mean()) / (n - 1)


def test_queries_stop_early_on_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 64))
    clustered = centres[rng.integers(0, 8, 8000)] * rng.uniform(0.5, 1.5, (8000, 1)) + 0.05 * rng.normal(size=(8000, 64))
    decaying = (rng.normal(size=(4000, 64)) * np.exp(-np.arange(64) / 4)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    assert scored_share(clustered, every=200) < 0.5 and scored_share(decaying) < 0.5


def test_spread_vectors_are_scored_whole_and_right():
    assert scored_share(np.random.default_rng(2).normal(size=(1000, 24))) <= 1.0


def test_reach_is_a_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size, most = np.abs(rng.normal(size=6)) * rng.integers(0, 2, 6), rng.normal(size=6)
        x = np.minimum(rng.normal(size=(400, 6)) * 2, most)
        longest = float(np.sqrt((x**2).sum(1)).max())
        bound = topk.reach(size[None], most[None], longest)[0]
        assert (x @ size).max() <= bound + 1e-9 and bound <= size @ most + 1e-9


def test_empty_vectors_meet_each_other(spark):
    df = spark.createDataFrame([(1, []), (2, []), (3, [1.0]), (4, None), (5, [None])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.lit(True)).collect()) == [(1, 1, 2, 0), (2, 1, 1, 0)]


# --- SimHash ----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_the_embedding_is_a_lower_bound(spark, bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 32, 300)
    b = a ^ sum(rng.integers(0, 2, 300) << int(k) for k in rng.integers(0, 32, 9))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    counts = [simhash.segment_counts(F.col(c), bits) for c in "ab"]
    got = df.select("a", "b", counts[0].alias("x"), simhash.manhattan(*counts, bits).alias("d")).collect()
    full = (1 << bits) - 1
    for r in got:
        of = lambda v: [(v >> k & full).bit_count() for k in range(0, 32, bits)]
        assert [r.x >> k & full for k in range(0, 32, bits)] == of(r.a)
        assert r.d == sum(abs(x - y) for x, y in zip(of(r.a), of(r.b))) <= (r.a ^ r.b).bit_count()


def test_few_candidates_leave_the_grid(spark):
    """Of two million pairs of unrelated fingerprints about as many leave the join as have vectors within 3."""
    rng = np.random.default_rng(11)
    prints = np.unique(rng.integers(0, 1 << 63, 2000))
    df = spark.createDataFrame(pd.DataFrame({"fp": prints}))
    met = simhash.grid_join(df, most=3, segment_bits=4, hot_cell=2000).filter("u <> v").select(F.least("u", "v"), F.greatest("u", "v")).distinct().count()
    nibbles = np.stack([(prints[:, None] >> np.arange(k, k + 4)) & 1 for k in range(0, 64, 4)], 1).sum(-1)
    near = sum(int((np.abs(nibbles[k] - nibbles[k + 1 :]).sum(1) <= 3).sum()) for k in range(len(prints)))
    assert met == near < 200


# --- lines ------------------------------------------------------------------------------------------------------------------------------


def test_runs_are_merged_without_sort_or_broadcast(spark):
    """With the planner's own limit for broadcasts, which these runs are far below."""
    before = spark.conf.getAll.get(line_dedup.TRUST_ORDER)
    with pytest.raises(RuntimeError), line_dedup.LineRuns(spark, buckets=4) as runs:
        for b in range(3):
            runs.add(spark.range(50).select(F.lit(b).cast("long").alias("doc_id"), (F.col("id") + 25 * b).alias("h1"), F.col("id").alias("h2")))
        names = [n for n in runs.firsts if n]
        tables = [spark.table(n) for n in names]
        for df in (runs.unseen(tables[0]), line_dedup.merged(tables[0], tables[1]), runs.frequent(2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan
            assert not any(x in plan for x in ("Exchange", "Sort [", "Broadcast")), plan
        assert all(len(spark.table(n).inputFiles()) <= 4 for n in names)
        raise RuntimeError("a run that fails")
    assert not any(spark.catalog.tableExists(n) for n in names) and not runs.paths
    assert spark.conf.getAll.get(line_dedup.TRUST_ORDER) == before


def test_repeated_rows_are_one_document_in_query_and_sql(spark, tmp_path):
    rows = [(1, LINE), (1, LINE), (2, LINE), (3, f"{LINE}\nx"), (4, f"{LINE}s"), (4, f"y\n{LINE}s"), (5, f"{LINE}s"), (None, f"{LINE}s"), (None, f"{LINE}s"), (6, None), (7, f"{LINE}z"), (7, f"{LINE}z"), (None, f"{LINE}z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, duck.execute(queries.ORACLE["op3_line_dedup"]).fetchall()))
    got = sorted(str(tuple(r)) for r in queries.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect())
    assert got == want
    dropped = df.select("doc_id").count() - line_dedup.dedup_lines(df).filter("n_dropped = 0").count()
    assert dropped == 3 + 2 + 2  # LINE is kept in 3, LINEs in 5; LINEz has two documents only


# --- near copies and the pipeline -------------------------------------------------------------------------------------------------------


def test_bucket_of_three_whose_centre_is_its_first_text(spark):
    """Text 0 is hub and first text of {0, 1, 2}: 1 and 2 have not met."""
    rows = [(0, 1, 3, 0), (0, 1, 3, 1), (0, 1, 3, 2), (0, 2, 2, 0), (0, 2, 2, 5), (0, 3, 2, 0), (0, 3, 2, 6)]
    inner = spark.createDataFrame(rows, "band int, key long, n long, node long")
    top = {r.key: (r.hub, r.lo) for r in near_copies.centres(inner).collect()}
    assert top[1] == (0, 0)
    roots = spark.createDataFrame([], "node long, root long")
    apart = {r.node for r in near_copies.texts_apart(inner, roots).collect()}
    assert {1, 2} <= apart and 5 not in apart


def test_repeats_of_rows_with_a_map(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"a": 1}), (1, text, {"b": 2}), (2, text + " x", None)], "doc_id long, text string, m map<string, int>")
    assert [(r.doc_id, r.text) for r in near_copies.drop_near_copies(df).collect()] == [(1, text)]


def test_rows_without_an_id_keep_their_language(spark):
    """A row is kept or rejected by its own decision, whatever its id."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") < 40, None).when(F.col("doc_id") < 60, 60).otherwise(F.col("doc_id")))
    noise = spark.createDataFrame([(60, "zq xj qqq 00 11 ## zzxxqq", None, None)], "doc_id long, text string, lang string, source string")
    odd = odd.unionByName(noise, allowMissingColumns=True)
    same = F.xxhash64(F.coalesce("text", F.lit("")))
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    decided = language_id.identify(odd, pages, keep=[same.alias("mark")])
    want = sorted((str(r.doc_id), r.mark) for r in decided.filter("kept").collect())
    got = corpus_pipeline.keep_known_languages(spark, odd, DATA)
    assert sorted((str(r.doc_id), r.mark) for r in got.select("doc_id", same.alias("mark")).collect()) == want
    assert sum(k == "None" for k, _ in want) > 30 and got.columns == odd.columns


# --- language and toxicity --------------------------------------------------------------------------------------------------------------


def test_language_without_declared_languages(spark):
    """The declared language is evidence too: without it, text, pages and sources alone find it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model_from = docs.filter("doc_id % 2 = 0")
    blind = docs.filter("doc_id % 2 = 1").withColumnRenamed("lang", "truth").withColumn("lang", F.lit(None).cast("string"))
    both = model_from.withColumn("truth", F.col("lang")).unionByName(blind)
    got = language_id.identify(both, spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), keep=[F.col("truth")]).filter("declared IS NULL AND kept").toPandas()
    assert len(got) > 400 and (got.language == got.truth).mean() > 0.98


def test_a_rare_language_has_a_model(spark):
    common_ = [(k, f"der und die das nicht ein {k}", "de") for k in range(400)]
    rare = [(1000 + k, f"kaj la estas ne unu {k}", "eo") for k in range(3)]
    df = spark.createDataFrame([(*r, None) for r in common_ + rare], "doc_id long, text string, lang string, source string")
    model = language_id.fit_text(df, fit_rows=20)
    assert model.languages == ["de", "eo"]
    got = language_id.identify(df.withColumn("lang", F.when(F.col("doc_id") != 1001, F.col("lang"))), fit_rows=20).filter("doc_id = 1001").first()
    assert got.language == "eo"


def test_toxic_recall(spark):
    """On rows of fold 0, which the fit never reads."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("toxic IS NOT NULL AND held_out").select("predicted", "toxic").toPandas()
    toxic = got[got.toxic == 1]
    assert (toxic.predicted == 1).mean() >= 0.9
    assert (got[got.toxic == 0].predicted == 1).mean() <= 0.02


def test_a_sessions_own_batches_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, mark = spark.conf.getAll.get(name), common._BATCHES.pop(spark.sparkContext.applicationId, None)
    spark.conf.set(name, "123")
    try:
        common.map_texts(spark.range(3), lambda b: b, "id long").count()
        assert spark.conf.get(name) == "123"
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)
        if mark:
            common._BATCHES[spark.sparkContext.applicationId] = mark


def test_a_labelled_table_of_ones_own(spark):
    """Hosts made letter by letter, split by host: those to block are drawn hosts of digits and consonants with numbered landing pages."""
    rng = np.random.default_rng(21)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = []
    for k in range(700):
        if k % 2:
            host, path = f"{draw('bcdfghjklmnpqrstvwxz0123456789', 11)}.{rng.choice(['com', 'net', 'info'])}", f"/l{rng.integers(1e6)}?c={k}"
        else:
            host, path = "".join(draw("bdlmnrst", 1) + draw("aeiou", 1) for _ in range(4)) + f".{rng.choice(['com', 'net', 'info'])}", f"/{draw('aeioulmnrst', 6)}/{k}"
        rows += [(f"http://{host}{path}", k % 2, k)] * 2
    rows += [(None, 1, -1), ("http://x.com/", None, -1)]
    df = spark.createDataFrame(rows, "url string, blocked int, k int")
    seen, unseen = df.filter("k % 5 > 1 OR k < 0"), df.filter("k % 5 <= 1 AND k >= 0").select(F.col("k").alias("page_id"), "url", "blocked")
    model = url_filter.fit_labelled(seen, fit_rows=300)
    got = url_filter.judge(unseen, [], model=model).join(unseen.select("page_id", "blocked").distinct(), "page_id").toPandas()
    block = got[got.blocked == 1]
    assert (block.verdict == "block").mean() >= 0.9 and (got[got.blocked == 0].verdict == "block").mean() <= 0.05
