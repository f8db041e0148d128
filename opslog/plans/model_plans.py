"""Sources, sinks, labels, nested parts and audits of the decision model over the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import parse
from ..functions.shared import shared_dir, stored
from ..operators import asof, chains, decisions, evaluate, graph, joins, quality, ranks, snapshot, windows
from ..sources import io
from .bind import ROUTES, TL, events, purchases, query, r6, routes, table, timeline
from .time_plans import _ONE, _SHARE, DAY, HALF_DAY, _sessions, _states, _stats

_FIX = "CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN ts - INTERVAL 1 HOUR ELSE ts END"


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT event_type, sum(epoch_us({_FIX}) // 1000000 % 100000)::BIGINT AS digest, count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') AS n_fixed FROM events GROUP BY 1")
def s4_movements(spark, d):
    """Written raw and read with the clock fix, then written as read and read again: fixed once."""
    kw = dict(times=["ts"], reference="ts_raw", start=datetime(2024, 1, 10), end=datetime(2024, 1, 20))
    raw, once = _path(spark, "movements"), _path(spark, "movements")
    events(spark, d).withColumn("ts_raw", F.col("ts")).write.parquet(raw)
    io.read_movements(spark, raw, **kw).write.parquet(once)
    m = io.read_movements(spark, once, **kw)
    secs = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1_000_000)
    return m.groupBy("event_type").agg(F.sum(secs % 100000).alias("digest"), F.count_if("clock_fixed").alias("n_fixed"))


@query("""SELECT count(*) AS n_rows, 1.0::DOUBLE AS share_usual_length, round(avg(CASE WHEN regexp_matches(substr(c_name, 3, 4), '^[0-9][A-Z][0-9]{2}$') THEN 1.0 ELSE 0.0 END), 6) AS share_headcode, count(DISTINCT c_nationkey) AS n_platforms FROM customer""")
def s4_load_diagnostics(spark, d):
    c = table(spark, d, "customer").withColumn("id", F.rpad("c_name", 18, "x"))
    out = io.load_diagnostics(c, id_col="id", platform_col="c_nationkey", id_length=18)
    return out.select("n_rows", "share_usual_length", r6("share_headcode", "share_headcode"), "n_platforms")


@query("""WITH m AS (SELECT 'x9' || (c_custkey % 10)::VARCHAR || chr((65 + c_custkey % 26)::INTEGER) || lpad((c_custkey % 100)::VARCHAR, 2, '0') || repeat('M', (c_custkey % 4)::INTEGER) AS id, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey END AS platform FROM customer)
  SELECT count(*) AS n_rows, round(avg(CASE WHEN length(id) = 8 THEN 1.0 ELSE 0.0 END), 6) AS share_usual_length, round(avg(CASE WHEN regexp_matches(substr(id, 3, 4), '^[0-9][A-Z][0-9]{2}$') THEN 1.0 ELSE 0.0 END), 6) AS share_headcode, count(DISTINCT platform) AS n_platforms FROM m""")
def s4_mixed_ids(spark, d):
    """Ids of four lengths, all but a few of them with a headcode inside, and rows without a platform."""
    k = F.col("c_custkey")
    parts = F.concat(F.lit("x9"), (k % 10).cast("string"), F.char((65 + k % 26).cast("int")), F.lpad((k % 100).cast("string"), 2, "0"), F.repeat(F.lit("M"), (k % 4).cast("int")))
    c = table(spark, d, "customer").select(parts.alias("id"), F.when(k % 6 > 0, F.col("c_nationkey")).alias("platform"))
    out = io.load_diagnostics(c, id_col="id", platform_col="platform", id_length=8)
    return out.select("n_rows", r6("share_usual_length", "share_usual_length"), r6("share_headcode", "share_headcode"), "n_platforms")


@query("SELECT l_orderkey::VARCHAR AS id, count(*)::INTEGER AS n FROM lineitem GROUP BY 1")
def s5_route_lists(spark, d):
    """Elements as text of a list of quoted names, in CSV, and back."""
    path = _path(spark, "routes")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_list(F.concat(F.lit("'T"), "l_partkey", F.lit("'"))).alias("e"))
    text = lines.select("id", F.lit("r").alias("route"), F.lit("s").alias("start"), F.lit("e").alias("end"), F.concat(F.lit("["), F.array_join("e", ", "), F.lit("]")).alias("track"))
    text.write.option("header", True).option("escape", '"').csv(path)
    return io.read_routes(spark, path).select("id", F.size("track").alias("n"))


@query("SELECT s_suppkey AS key, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, 'none') AS name FROM supplier WHERE s_suppkey % 7 <> 0")
def s6_dimension_file(spark, d):
    """A dimension with comment lines, gaps to fill and rows without their key."""
    path = _path(spark, "dimension")
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey")).alias("key"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"))
    s.write.option("header", True).csv(path)
    return io.read_dimension(spark, path, "key long, name string", ["key"], {"name": "none"})


@query("SELECT s_suppkey AS key, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, 'none') AS name FROM supplier WHERE s_suppkey % 7 <> 0")
def s6_commented_file(spark, d):
    """The same dimension with a byte order mark, and a comment before every fifth line that would be a row without its mark."""
    path, k = _path(spark, "dimension"), F.col("s_suppkey")
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = F.concat_ws(",", cell(F.when(k % 7 != 0, k)), cell(F.when(k % 3 != 0, F.col("s_name"))))
    note = F.concat(F.lit("# "), k.cast("string"), F.lit(",a comment, with commas"))
    lines = table(spark, d, "supplier").select(k.alias("at"), F.posexplode(F.when(k % 5 == 0, F.array(note, row)).otherwise(F.array(row))).alias("no", "value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit(0).alias("no"), F.lit("\ufeffkey,name").alias("value"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("at", "no").select("value").write.text(path)  # a dimension is one small file
    return io.read_dimension(spark, path, "key long, name string", ["key"], {"name": "none"})


@query("""SELECT CASE p_size % 4 WHEN 0 THEN 'Signal' WHEN 1 THEN 'Route' WHEN 2 THEN 'TRTS' ELSE 'Track' END AS asset_type, count(*) AS n, sum(p_partkey + 1)::BIGINT AS idx FROM part GROUP BY 1""")
def s7_asset_index(spark, d):
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("STD"), k)).when(F.col("p_size") % 4 == 1, F.concat(F.lit("RTD"), k, F.lit("A(M)"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("LPLAT"), k, F.lit("ATRS(N)"))).otherwise(F.concat(F.lit("T"), k))
    a = io.asset_index(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("\ufeff"), name).alias("value")))
    return a.groupBy("asset_type").agg(F.count("*").alias("n"), F.sum("idx").cast("long").alias("idx"))


@query("SELECT 'R' || s_suppkey AS id, 2::INTEGER AS n_items FROM supplier WHERE s_nationkey > 3")
def s9_physical_features(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_nationkey") > 3, F.col("s_acctbal")).alias("length_m"), F.lit("['A1', 'B2']").alias("items"))
    return io.physical_features(s, id_col="id", list_col="items", required=["length_m"]).select("id", "n_items")


@query("SELECT l_orderkey, count(*)::INTEGER AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1")
def s10_nested_sink(spark, d):
    path = _path(spark, "nested")
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("nodes")).withColumn("extra", F.lit(1))
    io.write_nested(n, n.select("l_orderkey", "nodes").schema, path)
    back = spark.read.parquet(path)
    return back.select("l_orderkey", F.size("nodes").alias("n"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x["l_partkey"]).alias("parts"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s11_summary_files(spark, d):
    """A summary as JSON lines and as CSV, both read back."""
    a, b = _path(spark, "summary"), _path(spark, "summary")
    s = stored(events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), "summary")
    io.write_summary(s, a)
    io.write_summary(s, b, form="csv")
    schema = "event_type string, n long"
    return spark.read.schema(schema).json(a).intersect(spark.read.schema(schema).option("header", True).csv(b))


@query("SELECT count(*) AS n, count(*) AS n_in_order FROM events WHERE event_type IN ('view', 'click')")
def s12_token_stream(spark, d):
    t = io.write_tokens(events(spark, d, "view", "click").select("ts", "event_id"), _path(spark, "tokens"), ts="ts", tie=["event_id"])
    files = t.select(F.input_file_name().alias("f"), "ts").groupBy("f").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    apart = files.withColumn("before", F.max("b").over(windows.W.orderBy("f").rowsBetween(windows.W.unboundedPreceding, -1)))  # a row per file
    return apart.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("before").isNull() | (F.col("before") <= F.col("a")), F.col("n")).otherwise(0)).alias("n_in_order"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE event_type IN ('view', 'click')")
def s12_token_places(spark, d):
    """Each token's place in the written stream, counted over its files in the order of their names."""
    path = _path(spark, "tokens")
    io.write_tokens(events(spark, d, "view", "click").select("ts", "event_id"), path, ts="ts", tie=["event_id"])
    lain = spark.read.parquet(path).select("event_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return ranks.numbered(lain, ["file", "at"], "place").select("event_id", "place")


@query("""WITH x AS (SELECT *, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AS i FROM events)
  SELECT 'value' AS "column", count(*) FILTER (i) AS n_inside, count(*) FILTER (i AND value <> 0) AS n_changed, round(sum(value), 4) AS before, round(sum(CASE WHEN i THEN 0 ELSE value END), 4) AS after FROM x""")
def s15_patch_counts(spark, d):
    out = io.patch_counts(events(spark, d), ts="ts", start="2024-01-10", end="2024-01-12", patches={"value": F.lit(0.0)})
    return out.select("column", "n_inside", "n_changed", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query("SELECT count(*) AS n_rules, count(*) AS n_parquet, count(*) AS n_csv FROM part WHERE p_size < 20")
def s16_rule_files(spark, d):
    """One rule for each part, its conditions and preference nested."""
    p = table(spark, d, "part").filter("p_size < 20")
    rules = p.select(F.col("p_partkey").cast("string").alias("rule_id"), F.struct(F.array("p_brand").alias("brands"), F.array("p_type").alias("types")).alias("match"), F.array("p_size").alias("preference"))
    return io.write_rules(rules, _path(spark, "rules"), json_columns=["match", "preference"])


@query("SELECT p_partkey::VARCHAR AS rule_id, p_brand AS brand, p_type || '\"' AS type, p_size::BIGINT AS preference, 2 AS n_forms FROM part WHERE p_size < 20")
def s16_rule_contents(spark, d):
    """Rules with quotes in their values, as read back from both forms of file."""
    path, p = _path(spark, "rules"), table(spark, d, "part").filter("p_size < 20")
    rules = p.select(F.col("p_partkey").cast("string").alias("rule_id"), F.struct(F.array("p_brand").alias("brands"), F.array(F.concat("p_type", F.lit('"'))).alias("types")).alias("match"), F.array("p_size").alias("preference"))
    io.write_rules(rules, path, json_columns=["match", "preference"])
    schema = "rule_id string, match string, preference string"
    forms = spark.read.schema(schema).parquet(f"{path}/parquet").unionByName(spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{path}/csv"))
    match, wish = F.from_json("match", "brands array<string>, types array<string>"), F.from_json("preference", "array<bigint>")
    return forms.groupBy("rule_id", match["brands"][0].alias("brand"), match["types"][0].alias("type"), wish[0].alias("preference")).agg(F.count("*").cast("int").alias("n_forms"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'unknown' END AS meaning FROM orders")
def p4_class_meaning(spark, d):
    return table(spark, d, "orders").select("o_orderkey", parse.lookup(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "unknown").alias("meaning"))


@query("""SELECT user_id % 5000 AS k, count(*) AS n, count(*) FILTER (user_id % 2 = 0) AS n_td, sum(event_id % 100)::BIGINT AS serials FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def p10_decision_events(spark, d):
    """Purchases as requests: their routes and train ids are parsed, other events left out."""
    number = F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    log = events(spark, d).withColumns({"route": F.concat(F.when(F.col("user_id") % 2 == 0, "RTD").otherwise("RDC"), (F.col("user_id") % 5000).cast("string"), F.lit("A(M)")), "train": F.concat(F.lit("1C"), number)})
    out = decisions.decision_events(log, kind="event_type", request="purchase", ts="ts", route="route", train="train")
    return out.groupBy(F.col("signal_no").cast("long").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("prefix") == "TD").alias("n_td"), F.sum(F.col("serial").cast("long")).alias("serials"))


@query(f"""WITH {ROUTES}, pos AS (SELECT route_id, unnest(elements) AS e, unnest(range(len(elements))) AS k FROM routes),
  pl AS (SELECT route_id, arg_max(p_size, k) AS p FROM pos JOIN part ON e = p_partkey WHERE p_size > 10 GROUP BY 1)
  SELECT r.route_id, p AS end_platform, signal + 100 AS end_signal, list_has_any(elements, [1, 2, 3, 5, 8, 13, 21]) AS on_branch, elements[1] AS "first", elements[-1] AS last FROM routes r LEFT JOIN pl USING (route_id)""")
def p19_route_attributes(spark, d):
    r = routes(spark, d).withColumn("ends", F.array(F.col("signal") + 100, F.col("signal") + 200))
    platforms = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("element"), F.col("p_size").alias("platform"))
    return graph.route_attributes(r, platforms, route="route_id", elements="elements", ends="ends", branch=[1, 2, 3, 5, 8, 13, 21])


@query(f"""WITH {ROUTES}, n AS (SELECT route_id, elements, list_sort(list_distinct(elements))[1:4] AS nodes FROM routes),
  e AS (SELECT route_id, nodes, elements[k] AS a, elements[k + 1] AS b FROM n, unnest(range(1, 20)) AS t(k) WHERE k < len(elements)),
  i AS (SELECT route_id, list_position(nodes, a) - 1 AS i, list_position(nodes, b) - 1 AS j FROM e)
  SELECT n.route_id, len(nodes)::INTEGER AS n_nodes, count(i.i)::INTEGER AS n_edges, coalesce(sum(i * 10 + j), 0)::BIGINT AS digest FROM n LEFT JOIN i ON i.route_id = n.route_id AND i >= 0 AND j >= 0 GROUP BY 1, 2""")
def p21_local_edges(spark, d):
    r = routes(spark, d).withColumn("nodes", F.slice(F.array_sort(F.array_distinct("elements")), 1, 4))
    pairs = F.transform(F.slice("elements", 2, F.greatest(F.size("elements") - 1, F.lit(0))), lambda x, i: F.struct(F.get("elements", i).alias("src"), x.alias("dst")))
    local = parse.local_edges(pairs, F.col("nodes"))
    return r.withColumn("e", local).select("route_id", F.size("nodes").alias("n_nodes"), F.size("e").alias("n_edges"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x["src"] * 10 + x["dst"]).alias("digest"))


@query(f"WITH {ROUTES} SELECT CASE WHEN o_orderstatus = 'P' THEN 'aux' ELSE 'named' END AS part, count(*) AS n, sum(len(elements))::BIGINT AS n_elements FROM routes GROUP BY 1")
def g1_split_named(spark, d):
    r = routes(spark, d).withColumn("name", F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderstatus")))
    named, aux = graph.split_named(r, name="name", elements="elements")
    both = named.withColumn("part", F.lit("named")).unionByName(aux.withColumn("part", F.lit("aux")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_elements").alias("n_elements"))


@query(f"WITH {ROUTES}, n AS (SELECT element, count(DISTINCT route_id) AS n_routes FROM (SELECT route_id, unnest(elements) AS element FROM routes) GROUP BY 1) SELECT element, n_routes FROM n ORDER BY n_routes DESC, element LIMIT 10")
def g5_top_elements(spark, d):
    n = graph.element_index(routes(spark, d), route="route_id", elements="elements").select("element", "n_routes")
    return graph.top_n(n, F.col("n_routes").desc(), "element", n=10)


@query(f"""WITH {ROUTES}, n AS (SELECT element, count(DISTINCT route_id) AS n_routes FROM (SELECT route_id, unnest(elements) AS element FROM routes) GROUP BY 1)
  SELECT p_partkey AS element, coalesce(n_routes, 0) AS n_routes, coalesce(CASE WHEN p_size > 10 THEN p_size END, -1) AS platform FROM part LEFT JOIN n ON element = p_partkey""")
def g6_track_nodes(spark, d):
    p = table(spark, d, "part")
    n = graph.element_index(routes(spark, d), route="route_id", elements="elements").select("element", "n_routes")
    sizes = p.filter("p_size > 10").select(F.col("p_partkey").alias("element"), F.col("p_size").alias("platform"))
    return graph.with_attributes(p.select(F.col("p_partkey").alias("element")), [(n, "element"), (sizes, "element")], {"n_routes": 0, "platform": -1})


@query(f"""WITH {ROUTES}, e AS (SELECT DISTINCT 'signal' AS t, signal AS a, 'track' AS u, elements[1] AS b FROM routes UNION SELECT DISTINCT 'track', elements[1], 'track', elements[2] FROM routes WHERE len(elements) > 1)
  SELECT t AS kind, a AS node, count(*)::INTEGER AS n, sum(b)::BIGINT AS total FROM e GROUP BY 1, 2""")
def g8_neighbours(spark, d):
    r = routes(spark, d).withColumn("starts", F.array("signal"))
    step = r.filter(F.size("elements") > 1).select(F.element_at("elements", 1).alias("src"), F.element_at("elements", 2).alias("dst")).distinct()
    start = graph.protects(r, starts="starts", elements="elements").select(F.col("src").cast("long").alias("src"), "dst")
    adjacent = stored(graph.adjacency(("signal", "track", start), ("track", "track", step)), "adjacency")
    out = graph.neighbours(adjacent, adjacent.select(F.col("src_type").alias("kind"), F.col("src").alias("node")), node_type="kind", node="node")
    return out.select("kind", "node", F.col("n_neighbours").alias("n"), F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, x: a + x["node"]).alias("total"))


@query(f"""WITH {ROUTES}, e AS (SELECT DISTINCT route_id AS src, elements[1] AS dst FROM routes), n AS (SELECT p_partkey AS node FROM part WHERE p_size > 5)
  SELECT 'starts' AS edge, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, count(*) FILTER (dst NOT IN (SELECT node FROM n)) AS n_lost, round(count(DISTINCT src) / (SELECT count(*) FROM orders), 6) AS coverage FROM e""")
def g17_checks(spark, d):
    r = routes(spark, d)
    e = r.select(F.col("route_id").alias("src"), F.element_at("elements", 1).alias("dst")).distinct()
    nodes = {"route": table(spark, d, "orders").select(F.col("o_orderkey").alias("node")), "track": table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("node"))}
    return graph.graph_checks(nodes, {"starts": (e, "route", "track")}).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {TL}, c AS (SELECT user_id, ts FROM (SELECT *, lag(st, 1, 0) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM tl) WHERE st <> was)
  SELECT p.event_id, coalesce((epoch_us(p.ts) - epoch_us(c.ts)) // 1000000, 0)::BIGINT AS change_age_s FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def w2_last_change(spark, d):
    kw = dict(key="user_id", probe_ts="ts", event_ts="ts", state="st")
    out = asof.last_change(purchases(spark, d), timeline(spark, d), **kw)
    return out.join(asof.last_change(purchases(spark, d), timeline(spark, d), bin_s=DAY, **kw).select("event_id", F.col("change_age_s").alias("in_bins")), "event_id").filter("change_age_s = in_bins").select("event_id", "change_age_s")


@query(f"WITH {_SHARE} SELECT event_id, round(max(share) FILTER (w = 86400), 6) AS share_24h, (max(changes) FILTER (w = 86400))::BIGINT AS changes_24h FROM s GROUP BY event_id")
def w1b_merged_prefixes(spark, d):
    """Signals that are logged under several prefixes are one asset; dealt by bins of time."""
    prefix = F.when(F.col("event_type") == "view", "STD").when(F.col("event_type") == "click", "SDC").otherwise("SEC")
    log = timeline(spark, d).withColumn("signal", parse.strip_signal_prefix(F.concat(prefix, F.col("user_id").cast("string"))))
    probes = purchases(spark, d).withColumn("signal", F.col("user_id").cast("string"))
    s = windows.window_stats(probes, log, key="signal", probe_id="event_id", probe_ts="ts", event_ts="ts", state="st", windows_s=[DAY], bin_s=DAY)
    return s.select("event_id", r6(f"share_{DAY}", "share_24h"), F.col(f"changes_{DAY}").alias("changes_24h"))


@query(f"""WITH {_ONE}, h AS (SELECT user_id, (epoch_us((SELECT min(ts) FROM ev y WHERE y.user_id = x.user_id AND y.st = 1 AND y.ts > x.ts)) - epoch_us(x.ts)) / 1e6 AS d FROM ev x WHERE st = 0)
  SELECT user_id, count(*) AS n, round(avg(d) + 1e-7, 4) AS avg_s FROM h WHERE d < 86400 GROUP BY 1""")
def w11c_clearing_lag(spark, d):
    rows = chains.durations(_states(spark, d), key="user_id", ts="ts", state="st", start=0, end=1, most_s=DAY, bin_s=HALF_DAY)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("duration_s") + 1e-7, 4).alias("avg_s"))


@query(f"""WITH {_ONE}, q AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'error'),
  a AS (SELECT q.event_id, q.user_id, q.ts, (SELECT min(ts) FROM ev WHERE ev.user_id = q.user_id AND st = 1 AND ev.ts >= q.ts) AS t1 FROM q),
  b AS (SELECT *, (SELECT min(ts) FROM ev WHERE ev.user_id = a.user_id AND st = 0 AND ev.ts > a.t1) AS t2 FROM a),
  c AS (SELECT *, (SELECT min(ts) FROM ev WHERE ev.user_id = b.user_id AND st = 1 AND ev.ts > b.t2) AS t3 FROM b)
  SELECT event_id, CASE WHEN t3 > t2 THEN round((epoch_us(t3) - epoch_us(t2)) / 1e6, 6) END AS headway_s FROM c""")
def w7_next_headway_in_bins(spark, d):
    """For keys that hold a large part of all rows."""
    probes = events(spark, d, "error").select("event_id", "user_id", "ts")
    out = chains.next_headway(probes, _states(spark, d), key="user_id", probe_ts="ts", event_ts="ts", state="st", bin_s=HALF_DAY)
    return out.select("event_id", r6("headway_s", "headway_s"))


@query("""WITH m AS (SELECT e.event_id, x.event_id AS other_id, row_number() OVER (PARTITION BY e.event_id ORDER BY x.ts DESC) AS k
    FROM events e JOIN events x ON x.user_id = e.user_id AND x.ts <= e.ts WHERE e.event_type = 'error')
  SELECT event_id, k::INTEGER AS rank, other_id FROM m WHERE k <= 16""")
def j14_last_events_in_bins(spark, d):
    log = events(spark, d).select("user_id", "ts", F.col("event_id").alias("other_id"))
    out = joins.last_events(events(spark, d, "error").select("event_id", "user_id", "ts"), log, keys=["user_id"], probe_id="event_id", probe_ts="ts", event_ts="ts", columns=["other_id"], k=16, bin_s=DAY)
    return out.select("event_id", "rank", "other_id")


@query("SELECT l_linenumber, round(quantile_cont(l_quantity, 0.5), 6) AS fast_s, round(quantile_cont(l_extendedprice, 0.5), 6) AS slow_s FROM lineitem GROUP BY 1")
def w11e_running_times(spark, d):
    out = chains.running_times(table(spark, d, "lineitem"), route="l_linenumber", columns={"fast_s": "l_quantity", "slow_s": "l_extendedprice"})
    return out.select("l_linenumber", r6("fast_s", "fast_s"), r6("slow_s", "slow_s"))


_RUNS_SQL = """rep AS (SELECT user_id, ts, value, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 172800000000 THEN 1 ELSE 0 END AS nw FROM events WHERE event_type = 'view')),
q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), sp AS (SELECT user_id, run, min(ts) AS a, max(ts) AS b FROM rep GROUP BY 1, 2),
m AS (SELECT q.event_id, run, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - (epoch_us(a) + epoch_us(b)) / 2.0), a, b, run) AS k FROM q JOIN sp ON sp.user_id = q.user_id AND q.ts BETWEEN a - INTERVAL 24 HOUR AND b + INTERVAL 24 HOUR),
n AS (SELECT q.*, m.run FROM q LEFT JOIN m ON m.event_id = q.event_id AND k = 1),
x AS (SELECT n.*, r0.ts AS t0, r0.value AS v0 FROM n ASOF LEFT JOIN rep r0 ON n.user_id = r0.user_id AND n.run = r0.run AND n.ts >= r0.ts),
y AS (SELECT x.*, r1.ts AS t1, r1.value AS v1 FROM x ASOF LEFT JOIN rep r1 ON x.user_id = r1.user_id AND x.run = r1.run AND x.ts < r1.ts),
z AS (SELECT *, count(*) OVER (PARTITION BY user_id, run, t0, t1) AS n FROM y)"""


def _in_runs(spark, d):
    reports = events(spark, d, "view").select("user_id", "ts", "value")
    return joins.bracket_changes_in_runs(purchases(spark, d).drop("value"), reports, key="user_id", probe_id="event_id", probe_ts="ts", report_ts="ts", value="value", window_s=DAY, run_gap_s=2 * DAY)


@query(f"WITH {_RUNS_SQL} SELECT event_id, coalesce(run, -1)::BIGINT AS run_no, CASE WHEN epoch_us(ts) - epoch_us(t0) <= 86400000000 AND epoch_us(t1) - epoch_us(ts) <= 86400000000 THEN round((v1 - v0) / n, 6) END AS change FROM z")
def j7_bracket_in_runs(spark, d):
    return _in_runs(spark, d).select("event_id", F.coalesce("run_no", F.lit(-1)).alias("run_no"), r6("change", "change"))


@query(f"""WITH {_RUNS_SQL} SELECT strftime(ts, '%Y-%m') AS month, CASE WHEN t0 IS NULL AND t1 IS NULL THEN 'no_report' WHEN t0 IS NULL THEN 'no_before' WHEN t1 IS NULL THEN 'no_after'
    WHEN epoch_us(ts) - epoch_us(t0) > 86400000000 THEN 'before_far' WHEN epoch_us(t1) - epoch_us(ts) > 86400000000 THEN 'after_far' ELSE 'ok' END AS reason, count(*) AS n,
    round(quantile_cont((epoch_us(ts) - epoch_us(t0)) / 1e6, 0.5), 4) AS median_before_s, round(quantile_cont((epoch_us(t1) - epoch_us(ts)) / 1e6, 0.9), 4) AS p90_after_s FROM z GROUP BY 1, 2""")
def j7b_faults_by_month(spark, d):
    b = _in_runs(spark, d)
    before, after = asof.seconds(F.col("ts"), F.col("before_ts")), asof.seconds(F.col("after_ts"), F.col("ts"))
    rows = b.select(
        F.date_format("ts", "yyyy-MM").alias("month"), joins.bracket_faults(b, probe_ts="ts", window_s=DAY).alias("reason"), before.alias("before"), after.alias("after")
    )
    out = ranks.quantiles_by(stored(rows, "faults"), ["month", "reason"], {"median_before_s": ("before", 0.5), "p90_after_s": ("after", 0.9)}, [F.count("*").alias("n")])
    return out.select("month", "reason", "n", F.round("median_before_s", 4).alias("median_before_s"), F.round("p90_after_s", 4).alias("p90_after_s"))


@query("""WITH sp AS (SELECT user_id, min(ts) AS a, min(ts) + INTERVAL 10 DAY AS b FROM events GROUP BY 1), q AS (SELECT event_id, e.user_id, ts FROM events e JOIN sp ON sp.user_id = e.user_id WHERE event_type = 'error' AND NOT ts BETWEEN a AND b),
  g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000 THEN 1 ELSE 0 END AS nw FROM q)
  SELECT event_id, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster_no FROM g""")
def j8_unmatched_clusters(spark, d):
    spans = events(spark, d).groupBy("user_id").agg(F.min("ts").alias("t_first"), (F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("t_last"), F.lit(0).alias("span"))
    probes = events(spark, d, "error").select("event_id", "user_id", "ts")
    m = joins.interval_join(probes, spans, key="user_id", probe_id="event_id", probe_ts="ts", span_id=["span"])
    return joins.clusters_of_unmatched(m, span="span", key="user_id", ts="ts", gap_s=DAY, tie=["event_id"]).select("event_id", "cluster_no")


@query(f"""WITH {TL}, h AS (SELECT p.event_id, tl.event_type AS e, ['view', 'click', 'error', 'signup'][1 + p.event_id % 4] AS s FROM p ASOF JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts)
  SELECT (CASE WHEN e = s THEN 0 ELSE 1 END)::INTEGER AS hops, count(*) AS n FROM h GROUP BY 1""")
def j17b_approach_distances(spark, d):
    """Event types as elements; every type follows every other somewhere in the log."""
    t = timeline(spark, d)
    w = windows.W.partitionBy("user_id").orderBy("ts")
    edges = t.select(F.lag("event_type").over(w).alias("src"), F.col("event_type").alias("dst")).filter("src <> dst").distinct()
    seeds = t.select(F.col("event_type").alias("seed"), F.col("event_type").alias("node")).distinct()
    distances = graph.hops(edges, seeds, most=5).select(F.col("seed").alias("signal"), F.col("node").alias("element"), "hops")
    kinds = F.array(*(F.lit(k) for k in ("view", "click", "error", "signup")))
    probes = purchases(spark, d).withColumn("signal", F.get(kinds, (F.col("event_id") % 4).cast("int")))
    return joins.approach_distances(probes, t, distances, key="user_id", probe_ts="ts", event_ts="ts", element="event_type", signal="signal")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 12)")
def j18_missing_keys(spark, d):
    return joins.missing_keys(table(spark, d, "lineitem"), table(spark, d, "supplier").filter("s_nationkey > 12").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' || o_custkey % 9 ELSE (o_custkey % 9)::VARCHAR END AS chosen, list_filter([(o_custkey % 9)::VARCHAR, (o_orderkey % 7)::VARCHAR], lambda x: o_orderkey % 11 > 0) AS options FROM orders),
  m AS (SELECT * FROM o WHERE NOT list_contains(options, chosen) ORDER BY o_orderkey LIMIT 40)
  SELECT o_orderkey, chosen, CASE WHEN len(options) = 0 THEN 'no_candidates' WHEN list_contains(options, regexp_replace(chosen, '^X', '')) THEN 'aliased' ELSE 'other' END AS reason FROM m""")
def j18_misses(spark, d):
    """The first forty chosen actions that are no candidates, with the reason: ids with another prefix, no candidates at all, or other."""
    key = F.col("o_orderkey")
    own = (F.col("o_custkey") % 9).cast("string")
    options = F.filter(F.array(own, (key % 7).cast("string")), lambda x: key % 11 > 0)
    o = table(spark, d, "orders").select("o_orderkey", F.when(key % 5 == 0, F.concat(F.lit("X"), own)).otherwise(own).alias("chosen"), options.alias("options"))
    return joins.coverage_misses(o, decision="o_orderkey", chosen="chosen", candidates="options", prefix="X", sample=40)


@query("""WITH a AS (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN 'X' || l_suppkey ELSE l_suppkey::VARCHAR END AS name FROM lineitem), b AS (SELECT s_suppkey::VARCHAR AS name FROM supplier)
  SELECT a.name, b.name AS other FROM a JOIN b ON regexp_replace(a.name, '^(X|DC)', '') = regexp_replace(b.name, '^(X|DC)', '') WHERE a.name NOT IN (SELECT name FROM b)""")
def j18_aliased_keys(spark, d):
    key = F.col("l_suppkey").cast("string")
    left = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("X"), key)).otherwise(key).alias("name"))
    return joins.aliased_keys(left, table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("name")), "name", prefix="X|DC")


@query("SELECT o_orderkey, coalesce(round(q, 4), -1) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j22_attach(spark, d):
    side = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 4).alias("quantity"))
    out = io.attached(table(spark, d, "orders"), side, key="o_orderkey", columns=["quantity"])
    return out.select("o_orderkey", F.coalesce("quantity", F.lit(-1.0)).alias("quantity"))


@query("""SELECT event_id, NOT regexp_matches(code, '^[0-9][A-Z][0-9]{2}$') AS f_unusual_id, CASE WHEN event_id % 5 = 0 THEN false ELSE event_id % 3 = 0 END OR CASE WHEN event_id % 7 = 0 THEN false ELSE event_id % 2 = 0 END AS f_trts_pressed
  FROM (SELECT event_id, (event_id % 10)::VARCHAR || chr((65 + user_id % 30)::INTEGER) || '07' AS code FROM events)""")
def f6_f7_flags(spark, d):
    k = F.col("event_id")
    code = F.concat((k % 10).cast("string"), F.chr(65 + F.col("user_id") % 30), F.lit("07"))
    pressed = decisions.f_trts_pressed(F.when(k % 5 != 0, k % 3 == 0), F.when(k % 7 != 0, k % 2 == 0))
    return events(spark, d).select("event_id", decisions.f_unusual_id(code).alias("f_unusual_id"), pressed.alias("f_trts_pressed"))


_R3 = f"""{TL}, pt AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 2 = 0 THEN 'set' ELSE 'wait' END AS label, ['view', 'click', 'error', 'signup'][1 + event_id % 4] AS signal FROM p),
dy AS (SELECT user_id, ts, ts::DATE AS day, event_type FROM tl), q AS (SELECT pt.*, pt.ts::DATE AS day FROM pt),
a AS (SELECT q.*, dy.event_type AS e FROM q ASOF LEFT JOIN dy ON q.user_id = dy.user_id AND q.day = dy.day AND q.ts >= dy.ts),
rep AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
x AS (SELECT a.*, rep.ts AS t0, rep.value AS v0 FROM a ASOF LEFT JOIN rep ON a.user_id = rep.user_id AND a.ts >= rep.ts),
y AS (SELECT x.*, rep.ts AS t1, rep.value AS v1 FROM x ASOF LEFT JOIN rep ON x.user_id = rep.user_id AND x.ts < rep.ts),
z AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(t0) <= 86400000000 AND epoch_us(t1) - epoch_us(ts) <= 86400000000 THEN (v1 - v0) / count(*) OVER (PARTITION BY user_id, t0, t1) END AS delay FROM y),
w AS (SELECT *, CASE WHEN label = 'wait' THEN 1.0 WHEN e IS NULL THEN 0.0 WHEN e = signal THEN 1.0 ELSE 0.1 END AS gate,
  CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS o, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 300 END AS h FROM z)"""


def _reward_job(spark, d):
    """Hops stand for 0 where the element is the signal, else 10: past the half and inside the tenth."""
    k = F.col("event_id")
    kinds = F.array(*(F.lit(x) for x in ("view", "click", "error", "signup")))
    points = purchases(spark, d).drop("value").withColumns({"label": F.when(k % 2 == 0, "set").otherwise("wait"), "signal": F.get(kinds, (k % 4).cast("int"))})
    names = spark.range(4).select(F.get(kinds, F.col("id").cast("int")).alias("element"))
    distances = names.join(names.withColumnRenamed("element", "signal"), F.lit(True)).withColumn("hops", F.when(F.col("element") == F.col("signal"), 0).otherwise(10))  # sixteen rows
    outcomes = points.select("event_id", F.when(k % 3 == 0, "used").when(k % 3 == 1, "unused_cancelled").otherwise("unknown").alias("outcome"))
    headways = points.filter(k % 4 != 0).select("event_id", (k % 300).alias("headway_s"))
    return decisions.reward_job(
        points, key="event_id", train="user_id", ts="ts", signal="signal", element="event_type", label="label", route="signal", reports=events(spark, d, "view").select("user_id", "ts", "value"),
        positions=timeline(spark, d).select("user_id", "ts", "event_type"), distances=distances, outcomes=outcomes, headways=headways, bracket_s=DAY,
        weights={"delay": 1.0, "throughput": 0.5, "headway": 1.0, "wait": 0.3}, clip_s=1800, headway_limit_s=147, half_most=6, tenth_most=16,
    )


@query(f"""WITH {_R3} SELECT event_id, round(CASE WHEN delay IS NULL THEN 0 ELSE -gate * greatest(-1800, least(1800, delay)) / 60 END + CASE WHEN label = 'set' THEN 0.5 * o ELSE -0.3 END + CASE WHEN h < 147 THEN -1 ELSE 0 END + 0.0, 5) + 0.0 AS r_total FROM w""")
def r3_reward_job(spark, d):
    return _reward_job(spark, d).select("event_id", (F.round("r_total", 5) + 0.0).alias("r_total"))


@query(f"""WITH {_R3} SELECT event_id, round(CASE WHEN delay IS NULL THEN 0 ELSE -2 * gate * greatest(-30, least(30, delay)) / 60 END + CASE WHEN label = 'set' THEN o ELSE -0.1 END + CASE WHEN h < 60 THEN -1 ELSE 0 END + 0.0, 5) + 0.0 AS r_total FROM w""")
def r4_reapplied(spark, d):
    kept = stored(_reward_job(spark, d), "rewards")
    out = decisions.reapplied(kept, label="label", weights={"delay": 2.0, "throughput": 1.0, "headway": 1.0, "wait": 0.1}, clip_s=30, headway_limit_s=60, half_most=6, tenth_most=16)
    return out.select("event_id", (F.round("r_total", 5) + 0.0).alias("r_total"))


@query("""SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_set, count(*) FILTER (event_type = 'view') AS n_wait, count(DISTINCT user_id) AS n_trains, count(DISTINCT user_id % 17) AS n_signals,
  strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events WHERE event_type IN ('purchase', 'view')""")
def a3_decision_summary(spark, d):
    p = events(spark, d, "purchase", "view").withColumns({"label": F.when(F.col("event_type") == "purchase", "set").otherwise("wait"), "signal": F.col("user_id") % 17})
    s = decisions.decision_summary(p, label="label", train="user_id", signal="signal", ts="ts")
    return s.select("n", "n_set", "n_wait", "n_trains", "n_signals", F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.date_format("last", "yyyy-MM-dd").alias("last_day"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice > 150000 AS dear, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
  SELECT 'lines' AS part, count(*) AS n, count(*) FILTER (n = 0) AS n_null, min(n) FILTER (n > 0) AS min_size, max(n) AS max_size, round(avg(n) FILTER (n > 0), 6) AS mean_size, round((SELECT avg(l_quantity) FROM l), 6) AS mean_value FROM o
  UNION ALL SELECT 'dear', count(*), 0, NULL, NULL, NULL, round(avg(CASE WHEN dear THEN 1.0 ELSE 0.0 END), 6) FROM o""")
def a13_value_audit(spark, d):
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_quantity", "l_tax")).alias("lines"))
    whole = table(spark, d, "orders").withColumn("dear", F.col("o_totalprice") > 150000).join(lists, "o_orderkey", "left")
    a = snapshot.value_audit(whole, lists={"lines": "l_quantity"}, flags=["dear"])
    return a.select("part", "n", "n_null", "min_size", "max_size", r6("mean_size", "mean_size"), r6("mean_value", "mean_value"))


@query("""WITH l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), v AS (SELECT 'lines' AS part, l_quantity AS v FROM l UNION ALL SELECT 'taxes', l_tax FROM l)
  SELECT part, count(*) AS n, round(quantile_cont(v, 0.05), 6) AS q_5, round(quantile_cont(v, 0.5), 6) AS q_50, round(quantile_cont(v, 0.99), 6) AS q_99 FROM v GROUP BY 1""")
def a13_value_quantiles(spark, d):
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_quantity")).alias("lines"), F.collect_list(F.struct("l_tax")).alias("taxes"))
    whole = table(spark, d, "orders").join(lists, "o_orderkey", "left")
    q = snapshot.value_quantiles(whole, lists={"lines": "l_quantity", "taxes": "l_tax"}, shares=[0.05, 0.5, 0.99])
    return q.select("part", "n", *(r6(c, c) for c in ("q_5", "q_50", "q_99")))


@query("""WITH m AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [2, 3] ELSE [4, 1] END AS s FROM lineitem),
  c AS (SELECT l_orderkey, bool_or(s = [1, 2]) AS a, bool_or(s = [2, 3]) AS b, bool_or(s = [4, 1]) AS c, count(*) AS n FROM m GROUP BY 1)
  SELECT l_orderkey, n AS n_soft, b AND c AS conflict, array_to_string(list_sort(list_distinct(list_concat(list_concat(CASE WHEN a THEN [1, 2] ELSE [] END, CASE WHEN b THEN [2, 3] ELSE [] END), CASE WHEN c THEN [4, 1] ELSE [] END))), ',') AS accepted FROM c""")
def a24_soft_rules(spark, d):
    sets = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("l_linenumber") % 3 == 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(4), F.lit(1)))
    out = evaluate.soft_conflict(table(spark, d, "lineitem").withColumn("s", sets), decision="l_orderkey", platforms="s")
    return out.select("l_orderkey", "n_soft", "conflict", F.array_join(F.transform("accepted", lambda x: x.cast("string")), ",").alias("accepted"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = o_orderkey % 4 THEN 'compliant' WHEN o_orderkey % 4 < 2 THEN 'non-compliant' WHEN o_custkey % 4 = 3 THEN 'compliant' ELSE 'preferred-unavailable' END AS verdict FROM orders""")
def a24_route_verdict(spark, d):
    v = evaluate.route_verdict(F.col("o_custkey") % 4, F.col("o_orderkey") % 4, F.array(F.lit(3).cast("long")), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    return table(spark, d, "orders").select("o_orderkey", v.alias("verdict"))


@query("""SELECT user_id, event_type AS phase, round(max(value), 4) AS best_score, CASE event_type WHEN 'view' THEN 90.0 WHEN 'click' THEN 150.0 END::DOUBLE AS gate,
  CASE event_type WHEN 'view' THEN max(value) >= 90 WHEN 'click' THEN max(value) >= 150 ELSE true END AS passed FROM events GROUP BY 1, 2""")
def a29_phase_gates(spark, d):
    out = evaluate.phase_gates(events(spark, d), run="user_id", phase="event_type", score="value", gates={"view": 90.0, "click": 150.0})
    return out.select("user_id", F.col("event_type").alias("phase"), F.round("best_score", 4).alias("best_score"), "gate", "passed")


@query("""WITH r AS (SELECT l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY 1)
  SELECT 'q' AS metric, count(*) AS n, round(avg(q), 4) AS mean, round(stddev_samp(q), 4) AS std, round(avg(q) - 1.96 * stddev_samp(q) / sqrt(count(*)), 4) AS low, round(avg(q) + 1.96 * stddev_samp(q) / sqrt(count(*)), 4) AS high FROM r""")
def a29_intervals(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("run")).agg(F.avg("l_quantity").alias("q"))
    out = evaluate.with_interval(evaluate.across_runs(r, run="run", columns=["q"], sample_std=True))
    return out.select("metric", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "low", "high")))


_N = f"""{TL}, c AS (SELECT event_id, user_id, ts FROM p), k AS (SELECT * FROM (VALUES ('view'), ('click'), ('error'), ('signup')) AS g(kind)),
o AS (SELECT c.event_id, c.user_id, k.kind, (SELECT arg_max(x.user_id, x.ts) FROM events x WHERE x.event_type = k.kind AND x.ts <= c.ts) AS holder, (SELECT arg_max(x.value, x.ts) > 50 FROM events x WHERE x.event_type = k.kind AND x.ts <= c.ts) AS on_ FROM c, k)"""


def _holders(spark, d):
    """Who used each kind last, as of every purchase: event types as elements, users as trains."""
    points = purchases(spark, d).select("event_id", "user_id", "ts").withColumn("kind", F.explode(F.array(*(F.lit(k) for k in ("view", "click", "error", "signup")))))
    log = events(spark, d).filter("event_type <> 'purchase'").select(F.col("event_type").alias("kind"), F.col("ts").alias("ets"), (F.col("value") > 50).cast("int").alias("st"), F.col("user_id").alias("holder"))
    return points, log


@query(f"WITH {_N} SELECT event_id, coalesce(array_to_string(list_sort(list_distinct(list(holder) FILTER (on_ AND holder <> user_id)))[1:3], ','), '') AS others FROM o GROUP BY 1")
def j20_other_trains(spark, d):
    points, log = _holders(spark, d)
    held = asof.as_of(points, log, keys=["kind"], probe_ts="ts", event_ts="ets", values={"st": "st", "holder": "holder"}, bin_s=HALF_DAY)
    some = snapshot.other_trains(held.withColumn("holder", F.when(F.col("st") == 1, F.col("holder"))), key="event_id", train="holder", focal="user_id", cap=3)
    out = purchases(spark, d).select("event_id").join(some, "event_id", "left")
    return out.select("event_id", F.coalesce(F.array_join(F.transform("others", lambda x: x.cast("string")), ","), F.lit("")).alias("others"))


@query(f"""WITH {_N}, a AS (SELECT p.event_id, p.user_id, tl.event_type AS e FROM p ASOF JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts)
  SELECT event_id, 'at' AS kind, user_id AS src, e AS dst FROM a WHERE e IN ('view', 'error') UNION ALL SELECT event_id, 'holds', holder, kind FROM o WHERE on_ AND kind IN ('view', 'error')""")
def j21_dynamic_edges(spark, d):
    points, log = _holders(spark, d)
    held = asof.as_of(points, log, keys=["kind"], probe_ts="ts", event_ts="ets", values={"st": "st", "holder": "holder"}, bin_s=HALF_DAY)
    berths = held.select("event_id", F.when(F.col("st") == 1, F.col("holder")).alias("train"), F.col("kind").alias("signal"))
    at = asof.as_of(purchases(spark, d), timeline(spark, d), keys=["user_id"], probe_ts="ts", event_ts="ts", values={"element": F.col("event_type")})
    nodes = purchases(spark, d).select("event_id", F.explode(F.array(F.lit("view"), F.lit("error"))).alias("node"))
    return snapshot.dynamic_edges(at.select("event_id", F.col("user_id").alias("train"), "element"), berths, nodes, key="event_id", train="train", element="element", signal="signal")


@query(f"""WITH {_N}, s AS (SELECT event_id, user_id, sum(CASE WHEN kind IN ('view', 'click') AND on_ THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN kind IN ('error', 'signup') AND on_ THEN 1 ELSE 0 END) AS n2 FROM o GROUP BY 1, 2)
  SELECT event_id, route, CASE WHEN route = 'a' THEN n1 ELSE n2 END::BIGINT AS n_occupied, coalesce((SELECT arg_max(x.value, x.ts) > 50 FROM events x WHERE x.user_id = s.user_id AND x.event_type <> 'purchase' AND x.ts <= (SELECT ts FROM p WHERE p.event_id = s.event_id)), false) AND route = 'a' AS locked FROM s, (VALUES ('a'), ('b')) AS r(route)""")
def n4_route_nodes(spark, d):
    """Two routes of two kinds each; the lock of a route is the user's own last state."""
    routes_ = F.array(F.struct(F.lit("a").alias("route"), F.array(F.lit("view"), F.lit("click")).alias("elements")), F.struct(F.lit("b").alias("route"), F.array(F.lit("error"), F.lit("signup")).alias("elements")))
    asked = purchases(spark, d).select("event_id", "user_id", "ts", F.inline(routes_)).withColumn("lock", F.concat_ws(":", "user_id", "route"))
    _, log = _holders(spark, d)
    locks = events(spark, d).filter("event_type <> 'purchase'").select(F.concat_ws(":", "user_id", F.lit("a")).alias("lock"), F.col("ts").alias("ets"), (F.col("value") > 50).cast("int").alias("st"))
    out = snapshot.route_nodes(asked, locks, log.withColumnRenamed("kind", "element"), key="event_id", route="lock", element="element", ts="ts", event_ts="ets", state="st")
    return out.select("event_id", "route", F.col("n_occupied").cast("long").alias("n_occupied"), (F.col("locked") == 1).alias("locked"))


@query(f"""WITH {_N} SELECT event_id, count(*) FILTER (kind IN ('view', 'click') AND on_ AND holder <> user_id) > 0 AS f_advance, bool_or(kind = 'error' AND coalesce(on_, false)) AS f_call_on FROM o GROUP BY 1""")
def n6_flag_inputs(spark, d):
    """Two candidate routes: their first elements are view and click, the platform of the second one (class C) is error."""
    routes_ = F.array(F.struct(F.lit("a").alias("route"), F.lit("view").alias("first"), F.lit("signup").alias("platform"), F.lit("M").alias("cls")), F.struct(F.lit("b").alias("route"), F.lit("click").alias("first"), F.lit("error").alias("platform"), F.lit("C").alias("cls")))
    asked = purchases(spark, d).select("event_id", "user_id", "ts", F.inline(routes_))
    _, log = _holders(spark, d)
    f = snapshot.flag_inputs(asked.drop("user_id"), log.withColumnRenamed("kind", "element"), key="event_id", route="route", first="first", platform="platform", cls="cls", ts="ts", event_ts="ets", state="st", train="holder", element="element")
    whole = purchases(spark, d).select("event_id", "user_id").join(f, "event_id")
    return whole.select("event_id", F.coalesce(decisions.f_advance(F.col("occupiers"), F.col("user_id")), F.lit(False)).alias("f_advance"), decisions.f_call_on(F.col("options")).alias("f_call_on"))


@query("""WITH x AS (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, n FROM x WHERE k IS NOT NULL""")
def a2_line_counts(spark, d):
    return quality.value_shares(table(spark, d, "lineitem"), "l_linenumber").select(F.col("l_linenumber").alias("k"), "n")
