"""Tables patched by day, sketches, registry tables, encoder arrays, the seven leak checks and the stream of waits."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslog.functions import parse
from opslog.operators import joins, quality, snapshot
from opslog.sources import io
from opslog.streaming import live

T = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def files(path):
    return {f: os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}, {
        f: d for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def test_only_touched_days_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [(k, T(k), float(k)) for k in range(24 * 6)] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, v double")
    df.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    times, places = files(path)
    counts = io.patch_days(spark, path, day="day", ts="ts", start="2024-01-02 06:00:00", end="2024-01-04", patches={"v": F.lit(None).cast("double")}).collect()
    assert (counts[0].n_inside, counts[0].n_changed) == (42, 42)
    now, _ = files(path)
    for f, t in times.items():
        touched = any(d in places[f] for d in ("2024-01-02", "2024-01-03"))
        assert (now.get(f) == t) != touched
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {k: None if t and T(30) <= t < T(72) else v for k, t, v in rows}
    with pytest.raises(ValueError):
        io.patch_days(spark, path, day="day", ts="ts", start="2024-01-02", end="2024-01-04", patches={"ts": F.col("ts")})


def test_sketches_are_within_their_error(spark):
    values = np.random.default_rng(3).gamma(2.0, 5.0, 20_000)
    df = spark.createDataFrame([(values[k : k + 40].tolist(),) for k in range(0, 20_000, 40)] + [(None,), ([],)], "xs array<double>")
    df = df.select(F.transform("xs", lambda x: F.struct(x.alias("v"))).alias("xs")).repartition(5)
    shares = [0.01, 0.5, 0.99]
    exact = snapshot.value_quantiles(df, lists={"xs": "v"}, shares=shares).first()
    near = snapshot.sketch_quantiles(snapshot.value_sketches(df, lists={"xs": "v"}), shares).first()
    ranks = np.sort(values)
    for q in shares:
        name = f"q_{round(100 * q)}"
        assert exact[name] == pytest.approx(np.quantile(values, q))
        assert abs(np.searchsorted(ranks, near[name]) / len(ranks) - q) < 0.012
    assert exact.n == near.n == 20_000


def test_registry_tables(spark):
    names = ["SDC5061", "SDC5061A", "SXX1", "RDW12AB-3(M)", "RDC7Q(PS)", "RDC7(M)", "T12", "TAB1", "LPLAT1ATRS(N)", "LPLAT1CTRS(N)", "", "zz"]
    lines = spark.createDataFrame([(f" 1  {n}",) for n in names] + [(None,), ("x T12 ",)], "value string")
    got = {k: sorted(map(tuple, df.collect())) for k, df in io.registry_tables(io.registry_assets(lines)).items()}
    assert got["signal"] == [("SDC5061", "DC", "5061"), ("SDC5061A", "DC", "5061A")]
    assert got["route"] == [("RDC7Q(PS)", "DC", "7", "Q", None, "PS"), ("RDW12AB-3(M)", "DW", "12A", "B", "3", "M")]
    assert got["track"] == [("T12", "numeric"), ("TAB1", "alpha")]
    assert got["trts"] == [("LPLAT1ATRS(N)", 1, "A", "N")]


def test_node_arrays(spark):
    node = "struct<id: string, x: double, on: boolean, p: int, c: string>"
    rows = [(1, [("a", 3.0, True, 2, "k"), ("b", None, None, None, "?")], [("a", "b"), ("b", "z")]), (2, [], []), (3, None, None)]
    df = spark.createDataFrame(rows, f"n int, nodes array<{node}>, edges array<struct<src: string, dst: string>>")
    made = parse.node_arrays(F.col("nodes"), ident="id", numbers={"x": (1.0, 2.0)}, flags=["on"], platforms=["p"], categories={"c": F.array(F.lit("j"), F.lit("k"))}, slots=3)
    got = df.select("n", made.alias("e"), "edges").select("n", "e", parse.edge_arrays(F.col("edges"), F.col("e.ids"), F.col("e.ids")).alias("g")).orderBy("n").collect()
    assert (got[0].e.ids, got[0].e.cont, got[0].e.binary, got[0].e.cat) == (["a", "b"], [[1.0], [0.0]], [[1, 0, 0, 1], [0, 0, 0, 0]], [[2], [0]])
    assert (got[0].g.src, got[0].g.dst) == ([0], [1])
    for r in got[1:]:
        assert r.e.ids == [] and r.e.cont == [] and r.g.src == []


SNAPSHOT = dict(center=("track", "t1"), tracks=[("t1",)], signals=[("s1",)], tokens=[(0.0,), (3.0,)], outlook=[(1,), (None,)], trains=[("f", True), ("g", False)], source="both")
KINDS = "center struct<type: string, id: string>, tracks array<struct<id: string>>, signals array<struct<id: string>>, tokens array<struct<age: double>>, outlook array<struct<planned_platform: int>>, trains array<struct<id: string, is_focal: boolean>>, source string"


def violations(spark, kinds=KINDS, skip=(), banned=("label",), **changes):
    row = SNAPSHOT | changes
    df = spark.createDataFrame([tuple(row.values())], kinds)
    bad = quality.snapshot_violations(
        df, center="center", current=F.lit("t1"), nodes={"track": "tracks", "signal": "signals"}, tokens="tokens", age="age", outlook="outlook", platform="planned_platform",
        flags_source=F.col("source"), trains="trains", banned=banned, skip=skip,
    )
    return df.select(bad.alias("v")).first().v


def test_seven_checks(spark):
    assert violations(spark) == []
    assert violations(spark, tokens=None, outlook=None, source=None) == []
    assert violations(spark, center=("signal", "t1")) == violations(spark, center=("track", "t2")) == ["subgraph_center"]
    assert violations(spark, KINDS.replace("signals array<struct<id: string>>", "signals array<struct<is_focal: boolean>>"), signals=[(True,)]) == ["no_focal_graph_flags"]
    assert violations(spark, banned=("age",)) == ["banned_fields"]
    assert violations(spark, outlook=[(8,)]) == ["schedule_outlook"]
    assert violations(spark, KINDS.replace("planned_platform: int", "planned_platform: string"), outlook=[("S1",)]) == ["schedule_outlook"]
    assert violations(spark, source="focal_signal") == ["flags_source"]
    assert violations(spark, tokens=[(-0.5,)]) == ["temporal_causality"]
    assert violations(spark, trains=[("f", True), ("g", True)]) == violations(spark, trains=None) == ["one_focal_train"]
    assert violations(spark, tokens=[(-0.5,)], skip=("temporal_causality",)) == []


def test_sampled_leak_report(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("g"), F.array().cast("array<string>").alias("v"))
    bad = F.when(F.col("id") % 10 == 0, F.array(F.lit("temporal_causality"))).otherwise(F.col("v"))
    full = {r.check: r for r in quality.leak_report(df, bad, key="id").collect()}
    assert len(full) == 7 and full["temporal_causality"].n_bad == 10 and full["temporal_causality"].examples == [0, 10, 20] and full["banned_fields"].examples == []
    assert {r.n_rows for r in quality.leak_report(df, bad, key="id", per_group=["g"], sample=5).collect()} == {10}


def test_coverage_misses(spark):
    rows = [(1, "a", ["a"]), (2, "b", ["a"]), (3, "DCa", ["a"]), (4, "x", []), (5, "x", None), (6, None, ["a"])]
    df = spark.createDataFrame(rows, "k int, c string, o array<string>")
    got = joins.coverage_misses(df, decision="k", chosen="c", candidates="o", prefix="DC")
    assert {r.k: r.reason for r in got.collect()} == {2: "other", 3: "aliased", 4: "no_candidates", 5: "no_candidates", 6: "other"}


def test_stream_of_waits_restarts(spark, tmp_path):
    """Rows out of order within a file, a restart from the checkpoint, rows without key or time, and a late row that is dropped."""
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    schema = "user_id long, ts timestamp_ntz, kind string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)

    def run():
        stream = live.read_log(spark, log, schema, files_per_trigger=1)
        with live.state_store(spark):
            waits = live.live_waits(stream, key="user_id", ts="ts", kind="kind", trigger="view", request="buy", min_gap_s=7200, lookahead_s=3600, late="2 hours")
            return sorted((r.key, r.t // 3_600_000_000 - 473_352) for r in live.run_available(waits, out, state).collect())

    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    add([(1, T(3), "view"), (1, T(1), "view"), (1, T(2), "view"), (2, T(1), "view"), (2, T(2), "buy"), (None, T(1), "view"), (3, None, "view"), (1, T(1), "other")])
    assert run() == []
    add([(1, T(20), "view")])
    assert run() == [(1, 1), (1, 3)]  # of views at 1, 2 and 3 the second is too near, and 2's view was answered
    add([(2, T(5), "view"), (None, T(60), None)])  # 5 is behind the watermark
    assert run() == [(1, 1), (1, 3), (1, 20)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
