"""Small literal cases for semantics that SQL comparisons do not pin."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslog.operators import asof, chains, choice, decisions, evaluate, graph, joins, quality, snapshot, windows

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def timeline(spark, rows):
    return spark.createDataFrame([("a", at(t), s) for t, s in rows], "k string, ts timestamp_ntz, st int")


def probes(spark, *times):
    return spark.createDataFrame([(i, "a", at(t)) for i, t in enumerate(times)], "id int, k string, ts timestamp_ntz")


def test_state_timeline(spark):
    tl = timeline(spark, [(100, 1), (200, 0), (300, 1)])
    out = asof.state_at(probes(spark, 50, 100, 200, 999), tl, key="k", probe_ts="ts", event_ts="ts", state="st", default=0)
    assert [r.state for r in out.orderBy("id").collect()] == [0, 1, 0, 1]


def test_strict_as_of_leaves_out_equal_times(spark):
    tl = timeline(spark, [(100, 1), (200, 0)])
    out = asof.as_of(probes(spark, 200), tl, keys=["k"], probe_ts="ts", event_ts="ts", values={"v": "st"}, inclusive=False)
    assert out.first().v == 1


@pytest.mark.parametrize("end,window,share,changes", [(200, 150, 100 / 150, 1), (210, 100, 1.0, 0), (90, 50, 0.0, 0)])
def test_window_stats(spark, end, window, share, changes):
    tl = timeline(spark, [(100, 1)])
    out = windows.window_stats(probes(spark, end), tl, key="k", probe_id="id", probe_ts="ts", event_ts="ts", state="st", windows_s=[window]).first()
    assert out[f"share_{window}"] == pytest.approx(share) and out[f"changes_{window}"] == changes


def test_empty_timeline(spark):
    tl = timeline(spark, [])
    out = windows.window_stats(probes(spark, 10), tl, key="k", probe_id="id", probe_ts="ts", event_ts="ts", state="st", windows_s=[60]).first()
    assert (out.share_60, out.changes_60) == (0.0, 0)
    assert asof.occupier_at(probes(spark, 10), tl, key="k", probe_ts="ts", event_ts="ts", state="st", train="k").first().occupier is None


def test_gap_sessions(spark):
    df = probes(spark, 36000, 36300, 79200)
    out = windows.sessions(df, keys=["k"], ts="ts", gap_s=1800).orderBy("id").collect()
    assert [r.session_no for r in out] == [0, 0, 1]
    placed = windows.positions(windows.sessions(df, keys=["k"], ts="ts", gap_s=1800), session=["k", "session_no"], order=["ts"]).orderBy("id").collect()
    assert [(r.position, r.is_last) for r in placed] == [(0, False), (1, True), (0, True)]


def test_hard_boundary(spark):
    out = windows.sessions(probes(spark, 0, 60), keys=["k"], ts="ts", gap_s=1800, boundaries=["2024-01-01 00:00:30"])
    assert [r.session_no for r in out.orderBy("id").collect()] == [0, 1]


def test_throttle(spark):
    out = windows.throttle(probes(spark, 0, 4, 9, 10, 15, 21), keys=["k"], ts="ts", min_gap_s=10)
    assert [r.id for r in out.orderBy("id").collect()] == [0, 3, 5]


def test_returns(spark):
    df = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 1.0)], "pass_id string, pos int, r double")
    assert windows.discounted_return(df, session=["pass_id"], position="pos", reward="r", gamma=0.95).first().episode_return == pytest.approx(1.95)
    to_go = windows.return_to_go(df, session=["pass_id"], position="pos", reward="r", gamma=0.95)
    assert {r.pos: round(r.to_go, 6) for r in to_go.collect()} == {0: 1.95, 1: 1.0}


def test_headway_and_lifecycle(spark):
    tl = timeline(spark, [(10, 1), (20, 0), (50, 1), (70, 0)])
    out = chains.next_headway(probes(spark, 5, 15, 60), tl, key="k", probe_ts="ts", event_ts="ts", state="st").orderBy("id").collect()
    assert [r.headway_s for r in out] == [30.0, None, None]
    rel, use = timeline(spark, [(100, 0)]), timeline(spark, [(40, 1)])
    life = chains.lifecycle(probes(spark, 0, 50, 90, 101), rel, use, key="k", probe_ts="ts", event_ts="ts", cancel_s=20).orderBy("id").collect()
    assert [r.outcome for r in life] == ["used", "unused_timeout", "unused_cancelled", "unknown"]


def test_approach_elements(spark):
    df = spark.createDataFrame([("r", ["S"], ["a", "b", "c"]), ("q", ["S", "U"], ["d"]), ("e", ["V"], [])], "r string, ends array<string>, els array<string>")
    got = lambda k: sorted(map(tuple, graph.approach_elements(df, ends="ends", elements="els", k=k).collect()))
    assert got(2) == [("S", "b"), ("S", "c"), ("S", "d"), ("U", "d")]
    assert got(0) == []


def test_feasible(spark):
    df = spark.createDataFrame([([("r2", "forward", 3), ("r1", "reverse", 4), ("r3", None, 4)],)], "o array<struct<route_id: string, direction: string, platform: int>>")
    one = lambda **kw: df.select(graph.feasible("o", **kw)).first()[0]
    assert one(direction=F.lit("forward")) == ["r2", "r3"]
    assert one(prior=F.array(F.lit("r2"))) == ["r1", "r3"]
    assert one(planned=F.lit(4)) == ["r1", "r3", "r2"]


def test_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("s", "a")], "seed string, node string")
    assert {r.node: r.hops for r in graph.hops(edges, seeds, most=2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_last_events(spark):
    log = spark.createDataFrame([("a", at(i), i) for i in range(20)], "k string, ts timestamp_ntz, e int")
    out = joins.last_events(probes(spark, 10), log, keys=["k"], probe_id="id", probe_ts="ts", event_ts="ts", columns=["e"], k=5)
    assert [(r.rank, r.e) for r in out.orderBy("rank").collect()] == [(1, 10), (2, 9), (3, 8), (4, 7), (5, 6)]


def test_outlook_excludes_self_and_past(spark):
    plan = spark.createDataFrame([(at(60), "a", 4), (at(120), "b", 4), (at(-5), "b", 1)], "sts timestamp_ntz, o string, platform int")
    out = joins.upcoming(probes(spark, 0), plan, probe_id="id", probe_ts="ts", schedule_ts="sts", exclude=("k", "o"), columns=["platform"], ahead_s=900, k=5).first()
    assert [(x.in_s, x.platform) for x in out.outlook] == [(120.0, 4)]


def test_rewards_sum_and_nulls(spark):
    df = spark.createDataFrame([("set", 1, "used", 120.0, 100.0), ("wait", None, None, None, None)], "l string, d int, o string, dl double, h double")
    out = decisions.rewards(df, label="l", distance="d", outcome="o", delay="dl", headway="h", weights={"delay": 1.0, "throughput": 0.5, "headway": 1.0, "wait": 0.3}, clip_s=1800, headway_limit_s=147, half_most=6, tenth_most=16)
    assert [round(r.r_total, 6) for r in out.collect()] == [-2.5, -0.3]


def test_verdicts(spark):
    df = spark.range(1)
    v = lambda p, opts: df.select(evaluate.platform_verdict(F.lit(p).cast("int"), F.array(F.lit(3)), F.array(*map(F.lit, opts)))).first()[0]
    assert [v(3, [1]), v(1, [3]), v(1, [2]), v(None, [3])] == ["compliant", "non-compliant", "preferred-unavailable", "undetermined"]
    r = lambda x, opts: df.select(evaluate.route_verdict(F.lit(x), F.lit("p"), F.array(F.lit("q")), F.array(*map(F.lit, opts)))).first()[0]
    assert [r("p", ["p"]), r("q", ["p"]), r("q", ["q"]), r("z", ["z"])] == ["compliant", "non-compliant", "compliant", "preferred-unavailable"]


def test_leak_audit(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([-1.0],)], "ages array<double>")
    bad = quality.leak_checks(token_ages=F.col("ages"))
    assert [r[0] for r in df.select(bad).collect()] == [[], ["temporal_causality"]]
    with pytest.raises(ValueError):
        quality.assert_no_leak(df, bad)
    assert quality.banned_fields(df.select(F.struct(F.lit(1).alias("is_focal_signal")).alias("n")), ["is_focal_signal"]) == ["n.is_focal_signal"]


def test_bootstrap_covers_estimate_and_repeats(spark):
    df = spark.range(2000).withColumn("v", (F.col("id") % 10).cast("double")).withColumn("c", F.col("id") % 100)
    a = evaluate.bootstrap(df, cluster=["c"], value="v", replicates=100).first()
    assert a.low <= a.estimate <= a.high and a == evaluate.bootstrap(df, cluster=["c"], value="v", replicates=100).first()


def test_choice_fit_recovers_sign_and_shapley_adds_up(spark):
    rows = [(i, j, float(j), int(j == (2 if i % 4 else 0))) for i in range(60) for j in range(3)]
    df = spark.createDataFrame(rows, "d int, j int, x double, y int")
    w = choice.fit_choice(df.drop("j"), decision=["d"], columns=["x"], chosen="y")
    assert w["x"] > 0
    v = spark.createDataFrame([(1, m, float(m)) for m in range(8)], "g int, m long, v double")
    phi = choice.shapley(v, game=["g"], mask="m", value="v", players=3)
    assert phi.agg(F.sum("phi")).first()[0] == pytest.approx(7.0)


def test_snapshot_skips_decisions_without_center(spark):
    where = spark.createDataFrame([("a", at(10), "T1")], "k string, ts timestamp_ntz, tc string")
    kept, skipped = snapshot.centers(probes(spark, 5, 15), where, key="k", ts="ts", element="tc")
    assert [r.id for r in kept.collect()] == [1] and [(r.id, r.reason) for r in skipped.collect()] == [(0, "no_center")]


def test_global_numbers_have_no_gaps(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id"))
    out = joins.numbered(df, ["x"])
    assert out.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first() == (1, 1000, 1000)


def test_poisson_draws_are_the_inverse_distribution(spark):
    import hashlib
    import math

    def drawn(key):
        u = (int(hashlib.md5(f"7|{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        total, k = math.exp(-1), 0
        while u >= total:
            k += 1
            total += math.exp(-1) / math.factorial(k)
        return k

    rows = spark.range(5000).select("id", evaluate.poisson_weight(F.lit(7), F.col("id")).alias("w")).collect()
    assert all(r.w == drawn(r.id) for r in rows)


def test_weights_are_normalised():
    weights = {"a": 3.0, "b": -1.0}
    assert choice.normalised(weights) == {"a": 0.75, "b": -0.25}
    assert choice.normalised(weights, "max") == {"a": 1.0, "b": -1 / 3}
    assert choice.normalised({"a": 0.0}) == {"a": 0.0} and choice.normalised({}, "max") == {}


def test_bins_keep_rows_without_key_or_time(spark):
    """Work dealt by key and bin of time gives what it gives by key, null keys, times and values included."""
    rows = [(k, None if t is None else at(t), v) for k in ("a", None) for t, v in ((None, 1), (5, None), (50, 4), (61, None), (300, 7), (301, None), (900, 2))]
    log = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v int")
    asks = spark.createDataFrame([(i, k, None if t is None else at(t)) for i, (k, t) in enumerate((k, t) for k in ("a", "b", None) for t in (None, 1, 62, 299, 1500))], "id int, k string, t timestamp_ntz")

    def both(run):
        one, binned = (sorted(map(str, run(b).collect())) for b in (None, 60))
        assert one == binned
        return one

    assert len(both(lambda b: asof.previous_in_key(log, keys=["k"], ts="ts", columns={"was": "v"}, bin_s=b))) == len(rows)
    assert len(both(lambda b: asof.running_in_key(log, keys=["k"], ts="ts", sums={"total": "v"}, bin_s=b))) == len(rows)
    assert len(both(lambda b: windows.sessions(log, keys=["k"], ts="ts", gap_s=100, bin_s=b))) == len(rows)
    for forward in (False, True):
        for null_values in (False, True):
            got = both(lambda b: asof.as_of(asks, log, keys=["k"], probe_ts="t", event_ts="ts", values={"last": "v"}, forward=forward, null_values=null_values, bin_s=b))
            assert len(got) == 15


def test_bootstrap_draws_once_for_all_strata_of_a_cluster(spark):
    """Draws are made before a cluster's strata are told apart; intervals are those of each stratum by itself."""
    rows = spark.range(400).selectExpr("id % 50 AS c", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS s", "cast(id * id % 97 AS double) AS v")
    out = evaluate.bootstrap(rows, cluster=["c"], value="v", replicates=20, strata=["s"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode(_parts") < plan.index("md5(")
    for got in out.collect():
        alone = evaluate.bootstrap(rows.filter(F.col("s").eqNullSafe(F.lit(got.s))), cluster=["c"], value="v", replicates=20).first()
        assert [round(got[k], 9) for k in ("estimate", "low", "high")] == [round(alone[k], 9) for k in ("estimate", "low", "high")]
