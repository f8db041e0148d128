"""How the operators' log, timeline and routes are bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir, *kinds: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.filter(F.col("event_type").isin(*kinds)) if kinds else df


def timeline(spark, sf_dir) -> DataFrame:
    """user_id, ts, st: 1 after a view or click, 0 after any other event but a purchase."""
    df = table(spark, sf_dir, "events").filter("event_type <> 'purchase'")
    return df.select("user_id", "ts", F.col("event_type").isin("view", "click").cast("int").alias("st"), "event_type", "value")


def purchases(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts", "value")


def signals(spark, sf_dir) -> DataFrame:
    """route_id, signal and what else an order has: the customer's nation as signal."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    nation = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("signal"))
    return orders.join(nation, "c_custkey").drop("c_custkey")


def routes(spark, sf_dir) -> DataFrame:
    """Orders as routes: route_id, its parts in line order as elements, the customer's nation as signal."""
    lines = table(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    path = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["l_partkey"])
    paths = lines.groupBy(F.col("l_orderkey").alias("route_id")).agg(path.alias("elements"))
    return paths.join(signals(spark, sf_dir), "route_id")


def route_steps(spark, sf_dir, through: DataFrame | None = None) -> DataFrame:
    """The same routes, a row an element: route_id, signal, element, next_element, is_first. through: elements (element); only routes
    over one of them then, which are found by a look at all lines, so that no others are dealt and sorted."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_partkey").alias("element"), "l_linenumber", "l_suppkey")
    named = signals(spark, sf_dir).select("route_id", "signal")
    if through is not None:
        over = stored(lines.select("route_id", "element").join(through, "element", "left_semi").select("route_id").distinct(), "over")
        lines, named = lines.join(over, "route_id", "left_semi"), named.join(over, "route_id", "left_semi")
    ahead = graph.steps(lines, route="route_id", order=["l_linenumber", "element", "l_suppkey"], element="element")
    return ahead.join(named, "route_id").select("route_id", "signal", "element", "next_element", "is_first")


def network(spark, sf_dir) -> DataFrame:
    """src, dst: consecutive parts of an order, in both directions."""
    return graph.both_ways(route_steps(spark, sf_dir).select("element", "next_element"))


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


def micros(ts: str, name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)).alias(name)


TL = """tl AS (SELECT user_id, ts, CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END AS st, event_type, value
  FROM events WHERE event_type <> 'purchase'),
p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')"""

RUNS = TL + """,
pre AS (SELECT *, lag(st, 1, 0) OVER w AS was, lag(ts) OVER w AS pts FROM tl WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
run AS (SELECT user_id, ts, st,
  sum(CASE WHEN was = 1 THEN epoch_us(ts) - epoch_us(pts) ELSE 0 END) OVER w AS in1,
  sum(CASE WHEN st <> was THEN 1 ELSE 0 END) OVER w AS ch
  FROM pre WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))"""

ROUTES = """routes AS (
  SELECT l.route_id, l.elements, c.c_nationkey AS signal, o.o_orderstatus, o.o_totalprice
  FROM (SELECT l_orderkey AS route_id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS elements
        FROM lineitem GROUP BY l_orderkey) l
  JOIN orders o ON o.o_orderkey = l.route_id JOIN customer c ON c.c_custkey = o.o_custkey)"""
