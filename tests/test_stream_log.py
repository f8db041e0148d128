"""Streams whose log has more files than one trigger reads, written from rows in no order of time."""

import functools

import duckdb
import pytest

from opslog.plans import catalog, stream_plans
from opslog.streaming import live

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_sessions", "stream_sessions_all", "stream_inventory_all"])
def test_many_files(spark, monkeypatch, name):
    monkeypatch.setattr(stream_plans, "table", lambda s, d, t: s.read.parquet(f"{d}/{t}.parquet").filter("ts >= '2024-01-23' AND ts < '2024-01-26'").repartition(4))
    monkeypatch.setattr(live, "read_log", functools.partial(live.read_log, files_per_trigger=1))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{DATA}/events.parquet' where ts >= '2024-01-23' and ts < '2024-01-26'")
    want = c.execute(catalog.ORACLE[name]).df()
    columns = list(want.columns)
    got = catalog.QUERIES[name](spark, DATA).toPandas()[columns]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
