"""Global numbers of wide rows over many partitions, exact quantiles and the rules that read sorted rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslog.operators import decisions, evaluate, quality, ranks, scan, windows

LINES = "/root/testdata/sf0.1/lineitem.parquet"


@pytest.fixture(params=[32, 200])
def many(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_wide_rows_keep_their_numbers(many):
    """All of lineitem with a wide column; partitions of both widths must not lose or repeat a number."""
    lines = many.read.parquet(LINES).withColumn("wide", F.repeat(F.lit("x"), 200))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    n = lines.count()
    out = decisions.surrogate_key(lines, order)
    got = out.agg(F.count("*"), F.count_distinct("sample_id"), F.min("sample_id"), F.max("sample_id"), F.sum(F.length("wide"))).first()
    assert tuple(got) == (n, n, 1, n, 200 * n)
    dates = out.groupBy("l_shipdate").agg(F.min("sample_id").alias("a"), F.max("sample_id").alias("b"), F.count("*").alias("n")).toPandas().sort_values("l_shipdate")
    assert (dates.b - dates.a + 1 == dates.n).all() and (dates.a.to_numpy()[1:] == dates.b.to_numpy()[:-1] + 1).all()


def test_session_index_and_ranks_over_many_partitions(many):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 900, 5000), "t": rng.integers(0, 300, 5000), "v": rng.integers(0, 40, 5000)})
    df = many.createDataFrame(pdf)
    idx = windows.session_index(df, session=["k"], start="t").toPandas().set_index("k").session_idx
    first = pdf.groupby("k").t.min().reset_index().sort_values(["t", "k"])
    assert idx[first.k].tolist() == list(range(len(first)))
    got = quality.average_rank(df, "v", "r").select("v", "r").distinct().toPandas().set_index("v").r
    want = pdf.v.rank().groupby(pdf.v).first()
    assert (got.sort_index() == want.sort_index()).all()


def test_quantiles_are_exact(spark):
    x = np.r_[np.random.default_rng(1).normal(size=501), np.zeros(99)]
    df = spark.createDataFrame([(float(v), float(-v) if k % 3 else None) for k, v in enumerate(x)], "a double, b double").repartition(5)
    got = ranks.quantiles(df, {"p0": ("a", 0.0), "p33": ("a", 0.333), "p100": ("a", 1.0), "b": ("b", 0.5)}).first()
    b = [-v for k, v in enumerate(x) if k % 3]
    assert np.allclose([got.p0, got.p33, got.p100, got.b], [x.min(), np.quantile(x, 0.333), x.max(), np.median(b)])
    assert ranks.quantiles(df.filter("false"), {"p": ("a", 0.5)}).first().p is None
    m = evaluate.margins(df.fillna(0.0), best="a", other="b").first()
    assert m.n == 600 and np.isclose(m.p5, np.quantile([v - (0.0 if k % 3 == 0 else -v) for k, v in enumerate(x)], 0.05))


def test_quantiles_of_groups(many):
    rng = np.random.default_rng(2)
    rows = [(("hot", "a", None)[min(2, int(k) // 6)], float(v)) for k, v in zip(rng.integers(0, 8, 3000), rng.integers(0, 900, 3000))]
    rows += [("empty", None), ("one", 4.0), ("a", None)]
    df = many.createDataFrame(rows, "g string, v double").repartition(9)
    specs = {"p0": ("v", 0.0), "p37": ("v", 0.37), "p50": ("v", 0.5), "p100": ("v", 1.0)}
    got = {r.g: r for r in ranks.quantiles_by(df, ["g"], specs, [F.count("*").alias("n")]).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert r.n == sum(k == g for k, _ in rows)
        want = np.quantile(own, [0, 0.37, 0.5, 1]) if own else [None] * 4
        assert np.allclose([r.p0, r.p37, r.p50, r.p100], want) if own else [r.p0, r.p37, r.p50, r.p100] == want
    assert ranks.quantiles_by(df.filter("false"), ["g"], specs).count() == 0


def test_rules_over_sorted_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), int(t), int(e)) for k, t, e in zip(rng.integers(0, 5, 4000), rng.choice(10**6, 4000, replace=False), rng.integers(0, 6, 4000))]
    df = spark.createDataFrame(rows, "k long, t long, e long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # keys span batches
    try:
        kept = {tuple(r) for r in scan.keep_apart(df, keys=["k"], time="t", order=["t"], gap=900).collect()}
        back = {(r.k, r.t): r.to_go for r in scan.discounted(df, keys=["k"], position="t", value="e", gamma=0.9).collect()}
        lists = {(r.k, r.t): r.recent for r in scan.recent_elements(df, keys=["k"], ts="t", element="e", n=3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want, to_go, recent = set(), {}, {}
    for key in range(5):
        last, state, ahead = None, [], 0.0
        own = sorted(r for r in rows if r[0] == key)
        for k, t, e in own:
            if last is None or t - last >= 900:
                want.add((k, t, e))
                last = t
            state = [e, *(x for x in state if x != e)][:3]
            recent[(k, t)] = state
        for k, t, e in reversed(own):
            ahead = e + 0.9 * ahead
            to_go[(k, t)] = ahead
    assert kept == want and lists == recent
    assert back.keys() == to_go.keys() and np.allclose([back[x] for x in to_go], list(to_go.values()))


def test_order_faults_are_found(spark):
    rows = [("a", 0, 10), ("a", 1, 20), ("a", 3, 15), ("b", 1, 5), ("b", 1, 6), ("c", 0, 1)]
    got = windows.order_faults(spark.createDataFrame(rows, "s string, p int, t int"), session=["s"], position="p", ts="t").first()
    assert tuple(got) == (1, 2, 1, 1)
