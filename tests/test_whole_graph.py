"""Hop distances and subgraphs over all routes, against brute force."""

from collections import Counter, defaultdict

import pandas as pd

from opslog.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_whole_network(spark):
    lines, orders, customers = (pd.read_parquet(f"{DATA}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    nation = orders.merge(customers, left_on="o_custkey", right_on="c_custkey").set_index("o_orderkey").c_nationkey
    near, starts = defaultdict(set), defaultdict(set)
    for order, g in lines.sort_values(["l_linenumber", "l_partkey", "l_suppkey"]).groupby("l_orderkey"):
        if order in nation.index:
            parts = g.l_partkey.tolist()
            starts[nation[order]].add(parts[0])
            for a, b in zip(parts, parts[1:]):
                if a != b:
                    near[a].add(b)
                    near[b].add(a)
    hops, inside = {}, {}
    for seed, front in starts.items():
        level = dict.fromkeys(front, 0)
        for k in range(1, 31):
            front = {b for a in front for b in near[a]} - level.keys()
            level |= dict.fromkeys(front, k)
        hops |= {(seed, k): n for k, n in Counter(level.values()).items()}
        kept = set()
        for odd, cap in ((0, 20), (1, 5)):
            kept |= set(sorted((x for x in level if x % 2 == odd and level[x] <= 3), key=lambda x: (level[x], x))[:cap])
        inside[seed] = (len(kept), sum(len(near[a] & kept) for a in kept))
    got = catalog.QUERIES["g9_hops_all"](spark, DATA).collect()
    assert {(r.seed, r.hops): r.n for r in got} == hops
    got = catalog.QUERIES["g10_g11_subgraph_all"](spark, DATA).collect()
    assert {r.seed: (r.n_nodes, r.n_edges) for r in got} == inside
