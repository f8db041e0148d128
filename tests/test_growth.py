"""What a query's work may grow with: rows of windows, routes of a network, rounds of a search, keys of a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opslog.operators import graph, snapshot, windows
from opslog.plans import bind
from opslog.streaming import live

DATA = "/root/testdata/sf0.001"
AT = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize("bin_s", [None, 300])
def test_windows_and_occupier_from_one_sort(spark, bin_s):
    """The number of windows costs no rows, and ties are told by their order; against brute force."""
    rng = random.Random(5)
    log = [(k, AT(rng.choice([0, 50, 51, 400, 900]) + 7 * rng.randint(0, 90)), rng.randint(0, 1), n, rng.randint(1, 5)) for n, k in enumerate(rng.choices(["a", "b"], k=200))]
    asked = [(n, k, AT(rng.randint(-20, 1700))) for n, k in enumerate(rng.choices(["a", "b", "c"], k=80))]
    events = spark.createDataFrame(log, "k string, ts timestamp_ntz, st int, no int, tr int")
    probes = spark.createDataFrame(asked, "n int, k string, t timestamp_ntz")
    spans = [30, 100, 1000]
    out = windows.window_stats(probes, events, key="k", probe_id="n", probe_ts="t", event_ts="ts", state="st", windows_s=spans, tie="no", now={"train": "tr"}, bin_s=bin_s)
    if bin_s is None:
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.n: r for r in out.collect()}
    assert len(got) == len(asked)
    for n, k, t in asked:
        mine = sorted((ts, no, st, tr) for key, ts, st, no, tr in log if key == k)

        def upto(end, mine=mine):
            on, changes, was, at = 0.0, 0, 0, None
            for ts, _, st, _ in mine:
                if ts > end:
                    break
                on += (ts - at).total_seconds() if was else 0
                changes, was, at = changes + (st != was), st, ts
            return on + ((end - at).total_seconds() if was else 0), changes

        assert got[n].train == next((tr for ts, _, _, tr in reversed(mine) if ts <= t), None)
        for w in spans:
            (on, ch), (on0, ch0) = upto(t), upto(t - dt.timedelta(seconds=w))
            assert got[n][f"share_{w}"] == pytest.approx((on - on0) / w) and got[n][f"changes_{w}"] == ch - ch0
    nodes = snapshot.element_nodes(probes, events.dropDuplicates(["k", "ts"]), key="n", element="k", ts="t", event_ts="ts", state="st", windows_s=spans, train="tr", bin_s=bin_s).collect()
    assert all((r.occupier is None) == (r.state == 0) for r in nodes) and {r.state for r in nodes} == {0, 1}


def test_steps_of_routes_through_elements(spark):
    """The whole routes over some elements, and no others."""
    few = spark.createDataFrame([(3,), (7,), (10**9,)], "element long")
    whole = {tuple(r) for r in bind.route_steps(spark, DATA).collect()}
    over = {r[0] for r in whole if r[2] in (3, 7)}
    assert over and {tuple(r) for r in bind.route_steps(spark, DATA, few).collect()} == {r for r in whole if r[0] in over}


def test_hops_of_many_groups(spark):
    """More seed groups than a row of the search has bits: distances and their totals, against brute force; and rows of a round."""
    rng = random.Random(6)
    edges = {(rng.randint(0, 79), rng.randint(0, 79)) for _ in range(120)}
    edges |= {(b, a) for a, b in edges}
    seeds = [(f"s{rng.randint(0, 699)}", rng.choice([*range(80), 500])) for _ in range(1500)]
    big = 1 << 40  # a sum of nodes beyond what a double holds exactly
    want = {}
    for name in {s for s, _ in seeds}:
        level = dict.fromkeys((n for s, n in seeds if s == name), 0)
        for k in range(1, 5):
            level |= {b: k for a, b in edges if level.get(a) == k - 1 and b not in level}
        want |= {(name, n + big): k for n, k in level.items()}
    e = spark.createDataFrame([(a + big, b + big) for a, b in sorted(edges)], "src long, dst long")
    s = spark.createDataFrame([(name, n + big) for name, n in seeds], "seed string, node long")
    assert len({name for name, _ in seeds}) > 64 * graph.LANES
    assert {(r.seed, r.node): r.hops for r in graph.hops(e, s, most=4).collect()} == want
    totals = {}
    for (name, n), k in want.items():
        had = totals.get((name, k), (0, 0))
        totals[name, k] = had[0] + 1, had[1] + n
    assert {(r.seed, r.hops): (r.n, r.nodes) for r in graph.hop_totals(e, s, most=4).collect()} == totals


def test_waits_of_many_keys_share_states(spark, tmp_path, monkeypatch):
    """Keys of several blocks, below zero too, in several triggers: one call into Python a block, and the waits of brute force."""
    rng = random.Random(7)
    keys = [*range(-3, 40), 255, 256, 5000]
    rows = sorted({(rng.choice(keys), 60 * rng.randint(0, 3000), rng.choice(["view", "view", "buy", "other"])) for _ in range(1500)}, key=lambda r: r[1])
    log = spark.createDataFrame([(k, AT(s), kind) for k, s, kind in rows], "user_id long, ts timestamp_ntz, kind string")
    path = str(tmp_path / "log")
    for lo in (0, 60_000, 120_000):
        log.filter(F.col("ts").between(AT(lo), AT(lo + 59_999))).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(None, AT(900_000), None)], log.schema).coalesce(1).write.mode("append").parquet(path)
    with live.state_store(spark):
        stream = live.read_log(spark, path, log.schema, files_per_trigger=1)
        waits = live.live_waits(stream, key="user_id", ts="ts", kind="kind", trigger="view", request="buy", min_gap_s=7200, lookahead_s=3600, late="2 hours")
        plan = waits._jdf.queryExecution().analyzed().toString()
        got = sorted((r.key, r.t // 1_000_000 - 1_704_067_200) for r in live.run_available(waits, str(tmp_path / "out"), str(tmp_path / "state")).collect())
    assert "shiftright" in plan
    want = []
    for key in keys:
        last, buys = None, [s for k, s, kind in rows if k == key and kind == "buy"]
        for s in sorted(s for k, s, kind in rows if k == key and kind == "view"):
            if last is None or s - last >= 7200:
                last = s
                want += [] if any(s <= b <= s + 3600 for b in buys) else [(key, s)]
    assert got == sorted(want) and len(got) > 100
