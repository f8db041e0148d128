"""Rules that carry over bins of a key: throttling, returns, gaps, neighbours, hops; against brute force, also where one key has all rows."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslog.operators import choice, graph, joins, quality, scan, snapshot, windows

ORIGIN = dt.datetime(2024, 1, 1)
AT = lambda s: ORIGIN + dt.timedelta(seconds=s)


@pytest.fixture
def wide(spark):
    """A session that deals to many partitions and keeps them apart."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def kept_by_rule(times, gap):
    out, last = [], None
    for t in sorted(t for t in times if t is not None):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("bin_gaps", [1, 3, 64])
def test_throttle_by_bins(wide, bin_gaps):
    rng = random.Random(1)
    rows = [(k, AT(rng.randint(0, 40_000))) for k in ("a", "b", None) for _ in range(700)] + [("a", None), (None, None)]
    got = windows.throttle(wide.createDataFrame(rows, "k string, t timestamp_ntz"), keys=["k"], ts="t", min_gap_s=60, bin_gaps=bin_gaps).collect()
    for key in ("a", "b", None):
        assert sorted(r.t for r in got if r.k == key) == kept_by_rule([t for k, t in rows if k == key], dt.timedelta(seconds=60))


def test_throttle_where_a_sort_merge_join_becomes_a_broadcast(wide):
    """The plan changes once the sizes of both sides are known; a bin's rows must then still lie in one task."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "20KB", "adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0"}
    old = {k: wide.conf.get(f"spark.sql.{k}", None) for k in conf}
    try:
        for k, v in conf.items():
            wide.conf.set(f"spark.sql.{k}", v)
        rng = random.Random(2)
        rows = [(k, AT(rng.randint(0, 40_000))) for k in "abc" for _ in range(4000)]
        got = windows.throttle(wide.createDataFrame(rows, "k string, t timestamp_ntz"), keys=["k"], ts="t", min_gap_s=60).collect()
    finally:
        for k, v in old.items():
            wide.conf.unset(f"spark.sql.{k}") if v is None else wide.conf.set(f"spark.sql.{k}", v)
    for key in "abc":
        assert sorted(r.t for r in got if r.k == key) == kept_by_rule([t for k, t in rows if k == key], dt.timedelta(seconds=60))


def test_throttle_splits_one_dense_key(wide):
    """No gap restarts the rule, one key has all rows, and no task thins over a quarter of them."""
    n = 20_000
    rows = wide.range(n).select(F.lit("k").alias("k"), (F.lit(ORIGIN).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 7)).alias("t"))
    out = windows.throttle(rows, keys=["k"], ts="t", min_gap_s=30, bin_gaps=64)
    parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(p["count"] for p in parts) == n // 5
    assert max(p["count"] for p in parts) <= n // 5 // 4


def test_last_kept_is_a_step_function():
    rng = np.random.default_rng(5)
    for _ in range(50):
        times, gap, start = np.sort(rng.integers(1000, 3000, 40)), 90, 1000
        upto, last = scan.last_kept(times, start, gap)
        for entry in range(start - gap, start):
            earliest = entry + gap
            kept, at = None, earliest
            for t in times:
                if t >= at:
                    kept, at = t, t + gap
            k = np.searchsorted(upto, earliest)
            assert (int(last[k]) if k < len(last) else None) == kept


@pytest.mark.parametrize("bin_rows", [1, 7, 4096])
def test_return_to_go_by_bins(wide, bin_rows):
    rng = random.Random(2)
    rows = [(s, p, rng.choice([None, 1.0, -2.5, 4.0])) for s, n in (("a", 900), ("b", 1), (None, 30)) for p in range(n)]
    df = wide.createDataFrame(rows, "s string, p int, r double").repartition(5)
    got = {(r.s, r.p): r.to_go for r in windows.return_to_go(df, session=["s"], position="p", reward="r", gamma=0.97, bin_rows=bin_rows).collect()}
    ahead = {}
    for s, p, r in reversed(rows):
        ahead[s] = (r or 0.0) + 0.97 * ahead.get(s, 0.0)
        assert got[s, p] == pytest.approx(ahead[s])
    assert len(got) == len(rows)


def test_neighbours_are_counted_in_frames_that_grow(spark):
    """A frame with two moving ends is counted anew for each row, which is quadratic in rows per span."""
    rows = spark.range(8).select((F.lit(ORIGIN).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 7)).alias("t"))
    out = windows.neighbours_within(rows, ts="t", span_s=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("specifiedwindowframe(") == plan.count("specifiedwindowframe(RangeFrame, unboundedpreceding$()") > 0
    assert sorted((r.t, r.n_near) for r in out.collect()) == [(AT(7 * k), len([x for x in range(8) if x != k and abs(x - k) * 7 <= 20])) for k in range(8)]


@pytest.mark.parametrize("hours", [1, 20, 36, 72])
def test_neighbours_of_any_span(spark, hours):
    rng = random.Random(3)
    rows = [(k, AT(3600 * h)) for k, h in enumerate((0, 30, 30, 55, 90, 91, 170))] + [(100 + k, AT(rng.randint(0, 10 * 86400))) for k in range(60)] + [(999, None)]
    got = {r.k: r.n_near for r in windows.neighbours_within(spark.createDataFrame(rows, "k int, t timestamp_ntz"), ts="t", span_s=3600 * hours).collect()}
    span = dt.timedelta(hours=hours)
    assert got == {k: 0 if t is None else sum(u is not None and abs(t - u) <= span for _, u in rows) - 1 for k, t in rows}


def test_probes_of_one_id_stay_apart(spark):
    events = spark.createDataFrame([("x", AT(100), 1), ("x", AT(200), 0)], "a string, ts timestamp_ntz, st int")
    probes = spark.createDataFrame([(1, "x", AT(150)), (1, "x", AT(250)), (1, "x", AT(250)), (1, "x", None)], "id int, a string, t timestamp_ntz")
    got = windows.window_stats(probes, events, key="a", probe_id="id", probe_ts="t", event_ts="ts", state="st", windows_s=[100]).collect()
    assert sorted((r.t or AT(0), r.share_100, r.changes_100) for r in got if r.t) == [(AT(150), 0.5, 1), (AT(250), 0.5, 1), (AT(250), 0.5, 1)]
    assert [(r.share_100, r.changes_100) for r in got if r.t is None] == [(None, None)]
    asked = spark.createDataFrame([("a|b", "c", AT(9)), ("a", "b|c", AT(9))], "key string, element string, t timestamp_ntz")
    on = spark.createDataFrame([("c", AT(1), 1)], "element string, ts timestamp_ntz, st int")
    nodes = snapshot.element_nodes(asked, on, key="key", element="element", ts="t", event_ts="ts", state="st", windows_s=[8])
    assert sorted((r.key, r.state, r.share_8) for r in nodes.collect()) == [("a", 0, 0.0), ("a|b", 1, 1.0)]


@pytest.mark.parametrize("bin_s", [None, 1000])
def test_gap_forest(spark, bin_s):
    rng = random.Random(4)
    rows = [(k, AT(rng.choice([0, 5, 5, 40, 300, 3000]) + rng.randint(0, 20_000))) for k in ("a", "b", None) for _ in range(120)] + [("a", None)]
    cut = AT(9_000)
    forest = windows.gap_forest(spark.createDataFrame(rows, "k string, t timestamp_ntz").repartition(3), keys=["k"], ts="t", gaps_s=[700, 60, 200], boundaries=[str(cut)], bin_s=bin_s)
    got = sorted((r.gap_s, str(r.k), r.first, r["last"], r.n_rows, r.n_leaking, r.gap_before or 0.0) for r in forest.collect())
    want = []
    for gap in (60, 200, 700):
        for key in ("a", "b", None):
            own, group, before = sorted(t for k, t in rows if k == key and t), [], None
            for t in [*own, None]:
                if group and (t is None or (t - group[-1]).total_seconds() > gap):
                    leak = sum((x >= cut) != (group[0] >= cut) for x in group)
                    want.append((gap, str(key), group[0], group[-1], len(group), leak, (group[0] - before).total_seconds() if before else 0.0))
                    before, group = group[-1], []
                group.append(t)
    assert got == sorted(want)


def test_hops_of_many_seeds(spark):
    rng = random.Random(5)
    edges = {(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(220)}
    seeds = [(f"s{k}", rng.randint(0, 130)) for k in range(150)] + [("s1", 7), (None, 3)]
    got = {(r.seed, r.node): r.hops for r in graph.hops(spark.createDataFrame(sorted(edges), "src int, dst int"), spark.createDataFrame(seeds, "seed string, node int"), most=6).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    want = {}
    for seed in {s for s, _ in seeds}:
        front = {n for s, n in seeds if s == seed}
        for k in range(7):
            front = {n for n in front if (seed, n) not in want}
            want |= {(seed, n): k for n in front}
            front = {b for a in front for b in near[a]}
    assert got == want


def test_prior_values_once_a_session(spark):
    df = spark.createDataFrame([("a", k, f"v{k}") for k in range(6)] + [("a", 6, None), ("b", 0, "x")], "s string, o int, v string")
    by = dict(session=["s"], order=["o"])
    both = windows.prior_counts(df, **by).join(windows.value_lists(df, value="v", **by), "s").select("s", "o", F.slice("values", F.lit(1), F.col("n_prior")).alias("p"))
    assert {(r.s, r.o): r.p for r in both.collect()} == {("b", 0): [], **{("a", k): [f"v{i}" for i in range(k)] for k in range(7)}}
    last = windows.prior_values(df, value="v", most=2, **by).filter("o = 5").first()
    assert last.prior == ["v3", "v4"]


def test_rules_are_found_by_their_rarest_condition(spark):
    rng = random.Random(6)
    decisions = [(k, "common" if k % 10 else "rare", rng.randint(0, 6), rng.choice([None, "x", "y"])) for k in range(400)]
    rules = [("r1", ["common", "rare"], [3], None), ("r2", None, None, None), ("r3", ["common"], None, ["x"]), ("r4", [], None, None), ("r5", ["common"], [1, 2, 2], ["y", "x"]), ("r6", ["none"], None, None)]
    d = spark.createDataFrame(decisions, "k int, a string, b int, c string")
    r = spark.createDataFrame(rules, "rule string, `as` array<string>, bs array<int>, cs array<string>")
    predicates = {"as": "a", "bs": "b", "cs": "c"}
    fits = lambda values, v: values is None or v in values
    want = {(k, n) for k, a, b, c in decisions for n, x, y, z in rules if fits(x, a) and fits(y, b) and fits(z, c)}
    got = joins.rule_matches(d, r, predicates=predicates).select("k", "rule").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    led = {x.rule: x._lead for x in joins.rule_leads(d, r, predicates)[0].collect()}
    assert led["r1"] == 1 and led["r3"] == 2 and led["r5"] != 0 and led["r2"] == 3


def test_samples_of_one_large_group(wide):
    df = wide.range(5000).select(F.lit("g").alias("g"), "id", (F.col("id") % 2 * 9 + 1).alias("w"))
    got = choice.sample_per_group(df, group=["g"], key=["id"], n=100, seed=1)
    every = df.orderBy(choice.hashed_uniform(F.lit(1), F.col("id")), "id").limit(100)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in every.collect())
    heavy = [r.id % 2 for r in choice.sample_weighted(df, group=["g"], key=["id"], weight="w", n=400, seed=1).collect()]
    assert len(heavy) == 400 and 0.8 < sum(heavy) / 400 < 0.98
    assert choice.sample_weighted(df.withColumn("w", F.lit(None).cast("int")), group=["g"], key=["id"], weight="w", n=4, seed=1).count() == 0


def test_version_diff_by_blocks(spark):
    old = spark.createDataFrame([(k, float(k), None) for k in range(300)], "k long, v double, s string")
    new = old.withColumn("v", F.when(F.col("k") == 7, 0.0).otherwise(F.col("v"))).withColumn("s", F.when(F.col("k") == 9, "x"))
    settings = dict(key="k", columns=["v", "s"], allowed=F.col("k") == 7)
    assert [tuple(r) for r in quality.version_diff(old, new, **settings).collect()] == [("v", 1, 0), ("s", 1, 1)]
    same = quality.version_diff(old, old, **settings, old_digests=(d := quality.block_digests(old, key="k", columns=["v", "s"])), new_digests=d)
    assert [tuple(r) for r in same.collect()] == [("v", 0, 0), ("s", 0, 0)]
    assert "Scan" not in same._jdf.queryExecution().executedPlan().toString() or "LocalTableScan" in same._jdf.queryExecution().executedPlan().toString()


def test_every_look_up_takes_bins(spark):
    """Keys with all rows: the same results with bins as without, for whoever looks up as of a time."""
    from opslog.operators import asof, chains, decisions

    rng = random.Random(8)
    log = spark.createDataFrame([(rng.choice(["k", "k", "k", None, "j"]), AT(rng.randint(0, 9000)), rng.randint(0, 1), rng.choice(["a", "b", "0"]), rng.choice([None, 1.0, 2.0])) for _ in range(300)], "k string, ts timestamp_ntz, st int, tr string, v double").dropDuplicates(["k", "ts"])
    probes = spark.createDataFrame([(n, rng.choice(["k", "k", "j", None]), AT(rng.randint(-10, 9100)), [rng.choice("jk")], "a") for n in range(120)], "n int, k string, t timestamp_ntz, els array<string>, focal string")
    kw = dict(keys=["k"], probe_ts="t", event_ts="ts")
    one = dict(key="k", probe_ts="t", event_ts="ts")
    calls = {
        "occupier": lambda b: asof.occupier_at(probes, log, state="st", train="tr", placeholders=["0"], bin_s=b, **one),
        "age": lambda b: asof.value_and_age(probes, log, value="v", bin_s=b, **kw),
        "fresh": lambda b: asof.fresh_value(probes, log, value="v", most_age_s=60, bin_s=b, **kw),
        "next": lambda b: asof.next_lag(probes, log, most_s=90, bin_s=b, **kw),
        "else": lambda b: asof.next_else_previous(probes, log, value="v", bin_s=b, **kw),
        "lead": lambda b: chains.lead_time(probes, log, bin_s=b, **one),
        "bracket": lambda b: joins.bracket_changes(probes, log, keys=["k"], probe_ts="t", report_ts="ts", value="v", window_s=100, bin_s=b),
        "runs": lambda b: joins.bracket_changes_in_runs(probes, log.filter("k IS NOT NULL"), key="k", probe_id="n", probe_ts="t", report_ts="ts", value="v", window_s=100, run_gap_s=80, bin_s=b),
        "none": lambda b: joins.no_follow_up(probes, log, keys=["k"], trigger_ts="t", request_ts="ts", within_s=30, bin_s=b),
        "conflicts": lambda b: joins.conflicts(probes.withColumnRenamed("t", "rt"), log.withColumnRenamed("k", "e"), request_id="n", ts="rt", elements="els", element="e", event_ts="ts", state="st", train="tr", focal="focal", bin_s=b),
        "nodes": lambda b: snapshot.element_nodes(probes, log, key="n", element="k", ts="t", event_ts="ts", state="st", windows_s=[50, 500], bin_s=b),
        "sweep": lambda b: decisions.lookahead_sweep(probes, log, keys=["k"], trigger_ts="t", request_ts="ts", thresholds_s=[30, 60], bin_s=b),
    }
    plain = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    for name, call in calls.items():
        whole = plain(call(None))
        assert whole and plain(call(700)) == whole, name


@pytest.mark.parametrize("bin_s", [None, 50, 4000])
def test_recent_elements_by_bins(spark, bin_s):
    rng = random.Random(9)
    rows = [(rng.choice(["k", None]), AT(t), rng.choice("abcde")) for t in rng.sample(range(3000), 300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, e string").repartition(4)
    got = {(r.k, r.ts): r.recent for r in scan.recent_elements(df, keys=["k"], ts="ts", element="e", n=3, bin_s=bin_s).collect()}
    for key in ("k", None):
        state = []
        for k, t, e in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            state = [e, *(x for x in state if x != e)][:3]
            assert got[k, t] == state


def test_numbered_runs(spark):
    from opslog.operators import ranks

    rng = random.Random(10)
    rows = [(k, rng.choice(["a", "a", "b", None])) for k in range(500)]
    df = spark.createDataFrame(rng.sample(rows, 500), "k int, v string").repartition(6)
    run, last = 0, object()
    want = {}
    for n, (k, v) in enumerate(rows, 1):
        run += v != last
        last = v
        want[k] = (n, run)
    assert {r.k: (r.seq, r.run) for r in ranks.numbered_runs(df, ["k"], "v").collect()} == want


def test_scratch_deletes_what_was_stored(spark):
    from opslog.functions import shared

    kept = shared.write_table(spark.range(3), "kept")
    with shared.scratch(spark):
        inner = shared.write_table(spark.range(4), "inner")
        assert spark.read.parquet(inner).count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner)
    assert spark.read.parquet(kept).count() == 3
    shared.discard(spark, kept)


def test_subsets_are_fitted_together(spark):
    rng = random.Random(11)
    rows = [(d, d % 3, float(x), int(x == (rng.random() < 0.3 + 0.2 * (d % 3)))) for d in range(600) for x in (0, 1)]
    df = spark.createDataFrame(rows, "d int, g int, x double, y int")
    kw = dict(decision=["d"], columns=["x"], chosen="y", l2=1e-3)
    both = choice.fit_subsets(df, subsets={f"g{k}": F.col("g") == k for k in range(3)} | {"all": F.lit(True), "none": F.lit(None).cast("boolean")}, **kw)
    for k in range(3):
        assert both[f"g{k}"]["x"] == pytest.approx(choice.fit_choice(df.filter(F.col("g") == k), **kw)["x"], abs=1e-6)
    assert both["all"]["x"] == pytest.approx(choice.fit_choice(df, **kw)["x"], abs=1e-6) and both["none"]["x"] == 0


def test_network_from_steps_equals_that_from_arrays(spark):
    """Equal edges whatever the order of a pair, loops and repeats; an edge is dealt once, and no route's array is gathered."""
    paths = {1: [3, 1, 2], 2: [2, 1, 1, 3], 3: [5], 4: [7, None, 8, 9], 5: [9, 8]}
    routes = spark.createDataFrame(list(paths.items()), "route int, elements array<int>")
    rows = spark.createDataFrame([(r, k, e) for r, p in paths.items() for k, e in enumerate(p)], "route int, no int, element int")
    marked = graph.steps(rows, route="route", order=["no"], element="element")
    assert sorted((r.route, r.element) for r in marked.filter("is_first").collect()) == [(r, p[0]) for r, p in sorted(paths.items())]
    got = graph.both_ways(marked.select("element", "next_element"))
    want = sorted({e for p in paths.values() for a, b in zip(p, p[1:]) if a and b and a != b for e in ((a, b), (b, a))})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.connects(routes, elements="elements").collect())) == want
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    assert graph.connects(routes, elements="elements")._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_subgraph_keeps_no_more_of_a_group_than_its_cap(spark):
    rows = spark.range(40).selectExpr("1 AS c", "id AS node", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS kind", "cast(id / 10 AS int) AS hops")
    out = graph.subgraph(rows, center="c", node="node", node_type="kind", caps={"a": 3, "b": 1}, most_hops=2)
    assert sorted(r.node for r in out.collect()) == [0, 1, 2, 4]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
