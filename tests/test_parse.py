import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslog.functions import parse
from opslog.sources import io

VALID_ROUTES = {
    "RTD5044A(M)": ("TD", "5044", "A", None, "M"),
    "RDC5061B-2(C)": ("DC", "5061", "B", "2", "C"),
    "REC5475AB(S)": ("EC", "5475A", "B", None, "S"),
    " RDY12C(PS) ": ("DY", "12", "C", None, "PS"),
    "RDW7A(SP)": ("DW", "7", "A", None, "SP"),
}
INVALID_ROUTES = ["", "RXX5044A(M)", "RTD5044(M)", "RTD5044A(X)", "TD5044A(M)", "RTD5044A", None]


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_routes(spark):
    ids = [*VALID_ROUTES, *INVALID_ROUTES]
    got = one(spark, [(i,) for i in ids], "id string", parse.route_parts(F.col("id")))
    assert [tuple(g[0]) for g in got] == [*VALID_ROUTES.values(), *[(None,) * 5] * len(INVALID_ROUTES)]


@pytest.mark.parametrize("code,parts", [("1S49", ("1", "S", "49")), ("9Z00", ("9", "Z", "00")), ("1s49", None), ("AS49", None), ("1S4", None), (None, None)])
def test_headcodes(spark, code, parts):
    assert tuple(one(spark, [(code,)], "c string", parse.headcode_parts(F.col("c")))[0][0]) == (parts or (None,) * 3)


def test_ids_and_types(spark):
    rows = [("STD5044", "Signal"), ("RTD5044A(M)", "Route"), ("LPLAT3ATRS(N)", "TRTS"), ("TABC1", "Track"), ("???", "Unknown")]
    assert [x[0] for x in one(spark, [(a,) for a, _ in rows], "c string", parse.asset_type(F.col("c")))] == [b for _, b in rows]
    assert one(spark, [("STD5044",)], "c string", parse.strip_signal_prefix(F.col("c"))) == [("5044",)]
    got = one(spark, [("1S49",), ("XXXX",), ("a",), (None,)], "c string", parse.is_valid_id(F.col("c"), ["XXXX"]))
    assert [g[0] for g in got[:3]] == [True, False, False]


def test_platform_and_buckets(spark):
    got = one(spark, [("3",), ("99",), (" 7.0 ",), ("x",), (None,)], "c string", parse.number_in_range(F.col("c"), 1, 7))
    assert [g[0] for g in got] == [3, None, 7, None, None]
    got = one(spark, [(5.0,), (5.1,), (None,)], "c double", parse.bucket(F.col("c"), [5, 50]))
    assert [g[0] for g in got] == [0, 1, -1]


def test_clock_fix_is_applied_once(spark):
    t = dt.datetime(2024, 3, 31, 12)
    df = spark.createDataFrame([(t, t), (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))], "ts timestamp_ntz, ref timestamp_ntz")
    kw = dict(times=["ts"], reference="ref", start=dt.datetime(2024, 3, 31), end=dt.datetime(2024, 10, 27))
    twice = parse.clock_fix(parse.clock_fix(df, **kw), **kw).orderBy("ref").collect()
    assert [(r.ts, r.clock_fixed) for r in twice] == [(dt.datetime(2024, 1, 1), False), (dt.datetime(2024, 3, 31, 11), True)]


def test_actions(spark):
    rows = [(["a", "b"], "b", "set"), (["a"], "z", "set"), (["a"], None, "set"), (["a"], "a", "wait")]
    schema = "c array<string>, x string, l string"
    got = one(spark, rows, schema, parse.action_index(F.col("c"), F.col("x"), F.col("l")), parse.with_chosen(F.col("c"), F.col("x")))
    assert got == [(2, ["a", "b"]), (2, ["a", "z"]), (-1, ["a"]), (0, ["a"])]


def test_local_edges(spark):
    rows = [(["n", "m"], [("n", "m"), ("m", "q")])]
    got = one(spark, rows, "nodes array<string>, e array<struct<src: string, dst: string>>", parse.local_edges(F.col("e"), F.col("nodes")))
    assert [tuple(x) for x in got[0][0]] == [(0, 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "dim.csv").write_text("# note\nid,platform\nA,1\n,2\nB,\n")
    df = io.read_dimension(spark, str(tmp_path / "dim.csv"), "id string, platform int", ["id"], {"platform": 0})
    assert sorted(map(tuple, df.collect())) == [("A", 1), ("B", 0)]
    (tmp_path / "routes.csv").write_text("id,route,start,end,track\n1,R1,S1,S2,\"['TA', 'TB']\"\n")
    assert io.read_routes(spark, str(tmp_path / "routes.csv")).first().track == ["TA", "TB"]
    assets = spark.createDataFrame([(0, "﻿STD1")], "key int, value string")
    assert tuple(io.asset_index(assets).first()) == (1, "STD1", "Signal")
    lines = spark.createDataFrame([("x STD1",), ("y  STD1",), ("",), ("z Qq",)], "value string")
    assert [tuple(r) for r in io.registry_assets(lines).collect()] == [("S", "STD1")]


def test_nested_sink_enforces_schema(spark, tmp_path):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "a", 2.0)], "x int, y string, z double")
    io.write_nested(df, T.StructType.fromDDL("y string, x long"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).dtypes == [("y", "string"), ("x", "bigint")]
    with pytest.raises(Exception):
        io.write_nested(df, T.StructType.fromDDL("missing string"), str(tmp_path / "bad"))


def test_an_index_gives_its_action(spark):
    rows = [(["a", "b"], 0), (["a", "b"], 2), (["a"], 2), (["a"], -1), (None, 1), (["a"], None)]
    got = one(spark, rows, "c array<string>, i int", parse.action_of_index(F.col("c"), F.col("i")))
    assert [r[0] for r in got] == [None, "b", None, None, None, None]
