"""Scalar expressions, reshaping, sidecars and set operations over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import parse
from ..functions.shared import shared_dir, stored
from ..operators import decisions
from ..sources import io
from .bind import events, micros, query, r6, table

_ROUTE_TEXT = "'R' || CASE l_suppkey % 3 WHEN 0 THEN 'TD' WHEN 1 THEN 'DC' ELSE 'XX' END || l_partkey || CASE l_linenumber % 2 WHEN 0 THEN 'A' ELSE 'B' END || CASE WHEN l_quantity > 25 THEN '-' || l_linenumber ELSE '' END || '(' || CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'N' THEN 'C' ELSE 'S' END || ')'"
_ROUTE_RE = r"^R(DW|TD|DC|EC|DY)(\d+[A-Za-z]*)([A-Z]+)(?:-(\d+))?\((M|C|S|W|PS|SP)\)$"


def _lines(spark, d):
    return table(spark, d, "lineitem")


@query(f"""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_ROUTE_TEXT} AS id FROM lineitem)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(f"nullif(regexp_extract(id, '{_ROUTE_RE}', {k}), '') AS {n}" for k, n in enumerate(('prefix', 'signal_no', 'letter', 'sub', 'cls'), 1))} FROM x""")
def p1_route_id(spark, d):
    text = F.expr(_ROUTE_TEXT)
    parts = parse.route_parts(text)
    return _lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", parts.alias("p")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p.*")


@query("""WITH x AS (SELECT o_orderkey, (o_custkey % 10)::VARCHAR || chr((65 + o_orderkey % 30)::INTEGER) || lpad((o_orderkey % 120)::VARCHAR, 2, '0') AS code FROM orders)
  SELECT o_orderkey, nullif(regexp_extract(code, '^([0-9])([A-Z])(\\d{2})$', 1), '') AS class_digit, nullif(regexp_extract(code, '^([0-9])([A-Z])(\\d{2})$', 2), '') AS dest,
    nullif(regexp_extract(code, '^([0-9])([A-Z])(\\d{2})$', 3), '') AS serial,
    CASE WHEN NOT regexp_matches(code, '^([0-9])([A-Z])(\\d{2})$') THEN 'non_standard' WHEN code[1] IN ('7','8') THEN 'other' ELSE code[1] END AS label FROM x""")
def p2_headcode(spark, d):
    number = (F.col("o_orderkey") % 120).cast("string")
    code = F.concat((F.col("o_custkey") % 10).cast("string"), F.chr(65 + F.col("o_orderkey") % 30), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(F.substring(number, 1, 2)))
    rows = table(spark, d, "orders").select("o_orderkey", parse.headcode_parts(code).alias("p")).select("o_orderkey", "p.*")
    return rows.withColumn("label", parse.class_label(F.col("class_digit")))


@query("SELECT c_custkey, substr(c_name, 3, 4) AS headcode FROM customer WHERE length(substr(c_name, 3, 4)) = 4")
def p3_headcode_of_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", parse.headcode_of_long_id(F.col("c_name")).alias("headcode")).filter("headcode IS NOT NULL")


@query("""SELECT n_name, regexp_matches(n_name, '^[0-9A-Z]{3,4}$') AND n_name <> 'IRAN' AS valid, regexp_replace('STD' || n_nationkey, '^S(DC|DW|DY|EC|TD)', '') AS tail,
  CASE WHEN n_nationkey % 4 = 0 THEN 'Signal' WHEN n_nationkey % 4 = 1 THEN 'Route' WHEN n_nationkey % 4 = 2 THEN 'TRTS' ELSE 'Track' END AS kind FROM nation""")
def p5_p7_ids(spark, d):
    key = F.col("n_nationkey").cast("string")
    name = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("STD"), key)).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("RTD"), key, F.lit("A(M)"))).when(
        F.col("n_nationkey") % 4 == 2, F.concat(F.lit("LPLAT"), key, F.lit("ATRS(N)"))).otherwise(F.concat(F.lit("T"), key))
    return table(spark, d, "nation").select(
        "n_name", parse.is_valid_id(F.col("n_name"), ["IRAN"]).alias("valid"),
        parse.strip_signal_prefix(F.concat(F.lit("STD"), key)).alias("tail"), parse.asset_type(name).alias("kind"),
    )


@query("""SELECT event_id, (user_id % 700)::SMALLINT AS asset_idx, (user_id % 2)::TINYINT AS token_state FROM events WHERE event_type IN ('view', 'click') AND event_id % 7 <> 0""")
def p8_change_tokens(spark, d):
    text = F.format_string("[(%d, %d)]", F.col("user_id") % 700, F.col("user_id") % 2)
    rows = events(spark, d).withColumn("change", F.when(F.col("event_id") % 7 == 0, "[(0)]").otherwise(text))
    return parse.change_tokens(rows, type_col="event_type", types=("view", "click")).select("event_id", "asset_idx", "token_state")


@query("""SELECT event_id, epoch_us(CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN ts - INTERVAL 1 HOUR ELSE ts END) AS ts_us,
  ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS clock_fixed FROM events""")
def p9_clock_fix(spark, d):
    kw = dict(times=["ts"], reference="ref", start=datetime(2024, 1, 10), end=datetime(2024, 1, 20))
    once = parse.clock_fix(events(spark, d).withColumn("ref", F.col("ts")), **kw)
    return parse.clock_fix(once, **kw).select("event_id", micros("ts", "ts_us"), "clock_fixed")  # a second application changes nothing


@query("""SELECT event_id, CASE WHEN k BETWEEN 1 AND 7 THEN k ELSE -1 END AS platform, abs(value) * 60 * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS late_s
  FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)""")
def p11_p12_platform_lateness(spark, d):
    k = F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" "))
    late = parse.signed_lateness_s(F.col("value"), F.col("event_type"), late="view", early="click")
    return events(spark, d).select("event_id", F.coalesce(parse.number_in_range(k, 1, 7), F.lit(-1)).alias("platform"), late.alias("late_s"))


@query("""SELECT event_id, CASE WHEN value <= 2 THEN 1.0 WHEN value <= 6 THEN 0.5 WHEN value <= 16 THEN 0.1 ELSE 0.0 END::DOUBLE AS gate,
  CASE WHEN value <= 5 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 100 THEN 2 ELSE 3 END AS bucket,
  CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END AS split,
  CASE WHEN ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::UBIGINT / 4294967295.0 < 0.7 THEN 'train' WHEN ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::UBIGINT / 4294967295.0 < 0.85 THEN 'val' ELSE 'test' END AS hashed
  FROM events""")
def p15_p18_gate_bucket_split(spark, d):
    return events(spark, d).select(
        "event_id", parse.distance_gate(F.col("value"), 6, 16).alias("gate"), parse.bucket(F.col("value"), [5, 50, 100]).alias("bucket"),
        parse.time_split(F.col("ts"), datetime(2024, 1, 20), datetime(2024, 1, 25)).alias("split"),
        parse.hash_split(F.col("event_id"), [("train", 0.7), ("val", 0.15), ("test", 0.15)]).alias("hashed"),
    )


_OPTS = """o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS opts, max(l_partkey) AS best, min(l_linenumber) AS ln FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_OPTS}, c AS (SELECT l_orderkey, opts, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN -1 ELSE best END AS chosen, CASE WHEN l_orderkey % 11 = 0 THEN 'wait' ELSE 'set' END AS label FROM o)
  SELECT l_orderkey, CASE WHEN label = 'wait' THEN 0 WHEN chosen IS NULL THEN -1 WHEN list_position(opts, chosen) > 0 THEN list_position(opts, chosen) ELSE len(opts) + 1 END::INTEGER AS idx,
    (len(opts) + CASE WHEN chosen IS NOT NULL AND NOT list_contains(opts, chosen) THEN 1 ELSE 0 END)::INTEGER AS n_after,
    CASE WHEN len(opts) >= 2 THEN 'forward' END AS direction FROM c""")
def p13_p14_actions(spark, d):
    o = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("opts"), F.max("l_partkey").alias("best"))
    key = F.col("l_orderkey")
    chosen = F.when(key % 5 == 0, None).when(key % 7 == 0, F.lit(-1)).otherwise(F.col("best"))
    o = o.withColumns({"chosen": chosen, "label": F.when(key % 11 == 0, "wait").otherwise("set")})
    return o.select(
        "l_orderkey", parse.action_index(F.col("opts"), F.col("chosen"), F.col("label")).alias("idx"),
        F.size(parse.with_chosen(F.col("opts"), F.col("chosen"))).alias("n_after"), parse.direction(F.col("opts")).alias("direction"),
    )


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(greatest(-5, least(5, (l_quantity - 25.0) / 10.0)), 6) AS z,
  array_to_string([CASE WHEN k = l_linenumber THEN '1' ELSE '0' END FOR k IN range(8)], '') AS hot, round(ln(1 + l_extendedprice), 6) AS log_price FROM lineitem""")
def p20_scaling(spark, d):
    hot = F.array_join(F.transform(parse.one_hot(F.col("l_linenumber"), 8), lambda x: x.cast("string")), "")
    return _lines(spark, d).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(parse.zscore(F.col("l_quantity"), 25.0, 10.0), "z"), hot.alias("hot"),
        r6(F.log1p("l_extendedprice"), "log_price"),
    )


@query("""WITH p AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS e FROM lineitem GROUP BY 1)
  SELECT l_orderkey, array_to_string([coalesce(e[k], -1)::VARCHAR FOR k IN range(1, 5)], ',') AS first4, array_to_string([CASE WHEN k <= len(e) THEN '1' ELSE '0' END FOR k IN range(1, 5)], '') AS mask FROM p""")
def p22_pad(spark, d):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    p = _lines(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["l_partkey"]).alias("e"))
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    return p.select(
        "l_orderkey", F.array_join(text(parse.padded(F.col("e"), F.lit(-1).cast("long"), 4)), ",").alias("first4"),
        F.array_join(text(parse.pad_mask(F.col("e"), 4)), "").alias("mask"),
    )


@query("""WITH x AS (SELECT DISTINCT regexp_extract(trim(line), '(\\S+)$', 1) AS name FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
  SELECT substr(name, 1, 1) AS kind, count(*) AS n FROM x WHERE substr(name, 1, 1) IN ('S','R','T','L','P') GROUP BY 1""")
def s8_registry(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return io.registry_assets(lines).groupBy("kind").agg(F.count("*").alias("n"))


_REGISTRY = """l AS (SELECT p_partkey, CASE p_partkey % 6
    WHEN 0 THEN 'SDC' || p_partkey || chr((65 + p_size % 26)::INTEGER) WHEN 1 THEN 'RDW' || p_partkey || 'XY-' || p_size || '(M)' WHEN 2 THEN 'REC' || p_partkey || 'Q(PS)'
    WHEN 3 THEN 'T' || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END || p_partkey WHEN 4 THEN 'LPLAT' || p_size || CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'B' END || 'TRS(S)' ELSE 'SXX' || p_partkey END AS name FROM part)"""


@query(rf"""WITH {_REGISTRY}, x AS (SELECT DISTINCT name FROM l),
  s AS (SELECT 'signal' AS kind, name, regexp_extract(name, '^S(DC|DW|DY|EC|TD)(\d+\w*)$', 1) || '|' || regexp_extract(name, '^S(DC|DW|DY|EC|TD)(\d+\w*)$', 2) AS fields FROM x WHERE regexp_matches(name, '^S(DC|DW|DY|EC|TD)(\d+\w*)$')),
  r AS (SELECT 'route' AS kind, name, regexp_replace(name, '^R(DW|TD|DC|EC|DY)(\d+\w*)([A-Z]+)(-(\d+))?\((M|C|S|W|PS)\)$', '\1|\2|\3|\5|\6') AS fields FROM x WHERE regexp_matches(name, '^R(DW|TD|DC|EC|DY)(\d+\w*)([A-Z]+)(-(\d+))?\((M|C|S|W|PS)\)$')),
  t AS (SELECT 'track' AS kind, name, CASE WHEN regexp_matches(name, '^.+[A-Za-z]') THEN 'alpha' ELSE 'numeric' END AS fields FROM x WHERE name LIKE 'T%'),
  q AS (SELECT 'trts' AS kind, name, regexp_replace(name, '^LPLAT(\d+)([AB])TRS\(([NS])\)$', '\1|\2|\3') AS fields FROM x WHERE regexp_matches(name, '^LPLAT(\d+)([AB])TRS\(([NS])\)$'))
  SELECT * FROM s UNION ALL SELECT * FROM r UNION ALL SELECT * FROM t UNION ALL SELECT * FROM q""")
def s8_registry_tables(spark, d):
    """Registry lines with a name for each part: signals, routes with and without sub, tracks, latches and names of no format."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    name = (
        F.when(key % 6 == 0, text("SDC", key, F.char((65 + size % 26).cast("int")))).when(key % 6 == 1, text("RDW", key, "XY-", size, "(M)"))
        .when(key % 6 == 2, text("REC", key, "Q(PS)")).when(key % 6 == 3, text("T", F.when(size % 2 == 0, "A").otherwise(""), key))
        .when(key % 6 == 4, text("LPLAT", size, F.when(size % 3 == 0, "A").otherwise("B"), "TRS(S)")).otherwise(text("SXX", key))
    )
    lines = table(spark, d, "part").select(F.concat_ws("  ", key.cast("string"), "p_brand", name).alias("value"))
    out = None
    for kind, df in io.registry_tables(io.registry_assets(lines)).items():
        first, *fields = df.columns
        part = df.select(F.lit(kind).alias("kind"), F.col(first).alias("name"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields)).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s1_s2_s3_csv_to_parquet(spark, d):
    """Events to CSV, read back with a declared schema and column subset, cached as zstd Parquet, read pruned."""
    import uuid

    base = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    log = events(spark, d).select("event_id", "ts", "event_type", F.col("value").cast("string").alias("value"))
    log.write.option("header", True).csv(f"{base}/csv")
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    typed = io.read_events(spark, f"{base}/csv", schema, ["event_type", "value"])
    io.cache_as_parquet(typed, f"{base}/cache")
    cached = io.read_columns(spark, f"{base}/cache", ["event_type", "value"])
    return cached.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT count(*) FILTER (o_orderkey IS NOT NULL) AS n_matched, count(*) FILTER (o_orderkey IS NULL) AS n_unmatched
  FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey""")
def s14_sidecar_coverage(spark, d):
    side = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("reward"))
    return io.coverage(io.fill_from_sidecar(_lines(spark, d).withColumn("reward", F.lit(0.0)), side, key="l_orderkey", columns=["reward"]))


@query("""SELECT event_type, round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' THEN 0 ELSE value END), 4) AS total FROM events GROUP BY 1""")
def s15_patch_window(spark, d):
    fixed = io.patch_in_window(events(spark, d), ts="ts", start="2024-01-10", end="2024-01-12", patches={"value": F.lit(0.0)})
    return fixed.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12' THEN value * 2 ELSE value END), 4) AS total,
  CASE WHEN ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-11' THEN 1 ELSE 0 END AS rewritten FROM events GROUP BY ALL""")
def s15_patch_days(spark, d):
    """A table with a folder for each day, patched in place: only the window's days get new files."""
    import uuid

    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    events(spark, d).withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    names = lambda: spark.read.parquet(path).select("day", F.input_file_name().alias("file")).distinct()
    before = stored(names(), "files")
    io.patch_days(spark, path, day="day", ts="ts", start="2024-01-10 06:00:00", end="2024-01-12", patches={"value": F.col("value") * 2})
    kept = names().join(before, ["day", "file"]).select("day").distinct().withColumn("rewritten", F.lit(0))
    days = spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return days.join(kept, "day", "left").select(F.col("day").cast("string").alias("day"), "n", "total", F.coalesce("rewritten", F.lit(1)).alias("rewritten"))


@query("""WITH p AS (SELECT l_orderkey, list({'id': l_partkey, 'q': l_quantity, 'f': l_returnflag, 'n': l_linenumber} ORDER BY l_linenumber, l_partkey, l_suppkey) AS nodes FROM lineitem GROUP BY 1)
  SELECT l_orderkey, array_to_string(list_transform(nodes, lambda x: x.id::VARCHAR), ',') AS ids, round(list_sum(list_transform(nodes, lambda x: greatest(-5, least(5, (x.q - 25.0) / 15.0)))) + 1e-9, 4) AS z,
    array_to_string(list_transform(nodes, lambda x: CASE WHEN x.n % 2 = 0 THEN '1' ELSE '0' END || array_to_string([CASE WHEN k = x.n THEN '1' ELSE '0' END FOR k IN range(8)], '')), ',') AS bits,
    array_to_string(list_transform(nodes, lambda x: coalesce(list_position(['A', 'R'], x.f), 0)::VARCHAR), ',') AS cats,
    coalesce(array_to_string(list_transform(list_filter(range(1, len(nodes)), lambda i: list_position(list_transform(nodes, lambda x: x.id), nodes[i].id) > 0), lambda i: (list_position(list_transform(nodes, lambda x: x.id), nodes[i].id) - 1)::VARCHAR || '>' ||
      (list_position(list_transform(nodes, lambda x: x.id), nodes[i + 1].id) - 1)::VARCHAR), ','), '') AS edges FROM p""")
def p21_node_arrays(spark, d):
    """Each order's lines as nodes, and edges from line to line; one edge of each order has an unknown end."""
    row = F.struct("l_linenumber", F.col("l_partkey").alias("id"), "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") % 2 == 0).alias("even"))
    p = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("nodes"))
    made = parse.node_arrays(F.col("nodes"), ident="id", numbers={"q": (25.0, 15.0)}, flags=["even"], platforms=["n"], categories={"f": F.array(F.lit("A"), F.lit("R"))})
    steps = F.zip_with(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes")), lambda a, b: F.struct(a["id"].alias("src"), b["id"].alias("dst")))
    p = p.withColumn("enc", made).withColumn("steps", F.array_append(steps, F.struct(F.element_at("nodes", 1)["id"].alias("src"), F.lit(-1).cast("long").alias("dst"))))
    e = p.withColumn("edges", parse.edge_arrays(F.col("steps"), F.col("enc.ids"), F.col("enc.ids")))
    text = lambda c, f=lambda x: x.cast("string"): F.array_join(F.transform(c, f), ",")
    z = F.aggregate(F.transform("enc.cont", lambda x: x[0]), F.lit(0.0), lambda a, x: a + x)
    ends = F.array_join(F.zip_with("edges.src", "edges.dst", lambda a, b: F.concat_ws(">", a.cast("string"), b.cast("string"))), ",")
    return e.select("l_orderkey", text("enc.ids").alias("ids"), F.round(z + 1e-9, 4).alias("z"), text("enc.binary", lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), "")).alias("bits"), text("enc.cat", lambda x: x[0].cast("string")).alias("cats"), ends.alias("edges"))


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
  SELECT user_id, count(*) AS n, sum((k + 1) * (event_id % 1000))::BIGINT AS digest FROM p GROUP BY 1""")
def s13_canonical_order(spark, d):
    """Positions as found in the written files: a session's rows numbered anew in the order in which they lie there."""
    import uuid

    from ..operators import windows

    path = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    io.write_in_order(events(spark, d).select("user_id", "ts", "event_id"), path, order=["user_id", "ts", "event_id"])
    lain = spark.read.parquet(path).select("user_id", "event_id", F.concat(F.input_file_name(), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")).alias("at"))
    placed = windows.positions(lain, session=["user_id"], order=["at"])
    return placed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("position") + 1) * (F.col("event_id") % 1000)).alias("digest"))


@query("""SELECT e.error, count(*) AS n FROM (
    SELECT unnest(list_filter([CASE WHEN o_totalprice > 200000 THEN 'dear' END, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'closed' END], lambda x: x IS NOT NULL)) AS error FROM orders) e GROUP BY 1""")
def s17_row_errors(spark, d):
    errors = io.row_errors({"dear": F.col("o_totalprice") > 200000, "closed": (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0)})
    return table(spark, d, "orders").select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(-g * greatest(-30.0, least(30.0, (o_totalprice - 150000) / 60.0)), 6) + 0.0 AS r_delay, CASE WHEN s THEN 0.5 * t ELSE 0 END::DOUBLE AS r_throughput,
    CASE WHEN o_custkey % 300 < 147 THEN -1.0 ELSE 0.0 END::DOUBLE AS r_headway, CASE WHEN s THEN 0.0 ELSE -0.3 END::DOUBLE AS r_wait,
    round(-g * greatest(-30.0, least(30.0, (o_totalprice - 150000) / 60.0)) + CASE WHEN s THEN 0.5 * t ELSE 0 END + CASE WHEN o_custkey % 300 < 147 THEN -1.0 ELSE 0.0 END + CASE WHEN s THEN 0.0 ELSE -0.3 END, 6) AS r_total
  FROM (SELECT *, o_orderkey % 2 = 0 AS s, CASE WHEN o_orderkey % 2 = 1 THEN 1.0 WHEN o_custkey % 20 <= 2 THEN 1.0 WHEN o_custkey % 20 <= 6 THEN 0.5 WHEN o_custkey % 20 <= 16 THEN 0.1 ELSE 0.0 END AS g,
    CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -1.0 ELSE -0.5 END AS t FROM orders)""")
def r1_rewards(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "set").otherwise("wait").alias("label"), (F.col("o_custkey") % 20).alias("distance"),
        F.when(F.col("o_orderstatus") == "F", "used").when(F.col("o_orderstatus") == "O", "unused_cancelled").otherwise("unused_timeout").alias("outcome"),
        (F.col("o_totalprice") - 150000).alias("delay"), (F.col("o_custkey") % 300).alias("headway"),
    )
    out = decisions.rewards(
        o, label="label", distance="distance", outcome="outcome", delay="delay", headway="headway", clip_s=1800, headway_limit_s=147, half_most=6, tenth_most=16,
        weights={"delay": 1.0, "throughput": 0.5, "headway": 1.0, "wait": 0.3},
    )
    return out.select("o_orderkey", *((F.round(c, 6) + 0.0).alias(c) for c in ("r_delay", "r_throughput", "r_headway", "r_wait", "r_total")))


@query("""SELECT round(quantile_cont(l_quantity, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_discount, 0.99), 6) AS p99 FROM lineitem""")
def r2_thresholds(spark, d):
    t = decisions.thresholds(_lines(spark, d), {"p5": ("l_quantity", 0.05), "p50": ("l_extendedprice", 0.5), "p90": ("l_extendedprice", 0.9), "p99": ("l_discount", 0.99)})
    return t.select(*(r6(c, c) for c in t.columns))


@query("""WITH RECURSIVE q AS (SELECT unnest(quantile_cont(l_linenumber, [0.2, 0.4, 0.6, 0.8])) AS e, unnest(range(4)) AS k FROM lineitem),
  f AS (SELECT k, e AS edge FROM q WHERE k = 0 UNION ALL SELECT q.k, greatest(q.e, f.edge + 1) FROM f JOIN q ON q.k = f.k + 1)
  SELECT k::INTEGER AS edge_no, round(edge, 6) AS edge FROM f""")
def r5_bucket_edges(spark, d):
    return decisions.increasing_edges(_lines(spark, d), "l_linenumber", [0.2, 0.4, 0.6, 0.8]).select("edge_no", r6("edge", "edge"))


@query("""WITH x AS (SELECT o.o_orderkey, o_custkey, list(l_suppkey) AS occ, list(l_linenumber) AS plats, bool_or(l_returnflag = 'A' AND l_linestatus = 'F') AS co, count(*) AS n FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT o_orderkey, len(list_filter(occ, lambda s: s <> o_custkey % 100)) > 0 AS f_advance, co AS f_call_on, NOT list_contains(plats, (o_custkey % 7)::INTEGER) AS f_platform_dev,
    n >= 3 AS f_priority_compete, CASE WHEN o_custkey % 200 >= 60 THEN o_custkey % 200 ELSE 0 END AS f_late_train, o_custkey % 10 IN (4, 6) AS f_freight_class FROM x""")
def f_flags(spark, d):
    x = table(spark, d, "orders").join(_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey").agg(
        F.collect_list("l_suppkey").alias("occ"), F.collect_list("l_linenumber").alias("plats"), F.count("*").alias("n"),
        F.collect_list(F.struct(F.when(F.col("l_returnflag") == "A", "C").otherwise("M").alias("cls"), (F.col("l_linestatus") == "F").alias("platform_occupied"))).alias("opts"),
    )
    flags = decisions.all_flags(
        f_advance=decisions.f_advance(F.col("occ"), F.col("o_custkey") % 100), f_call_on=decisions.f_call_on(F.col("opts")),
        f_platform_dev=decisions.f_platform_dev((F.col("o_custkey") % 7).cast("int"), F.col("plats")),
        f_priority_compete=decisions.f_priority_compete(F.col("n") - 2), f_late_train=decisions.f_late_train(F.col("o_custkey") % 200),
        f_freight_class=decisions.f_freight_class((F.col("o_custkey") % 10).cast("string")),
    )
    return x.select("o_orderkey", flags.alias("f")).select("o_orderkey", "f.*").drop("sources")


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 3 <> 0 AS tr, CASE WHEN o_orderstatus = 'P' THEN 'p' WHEN o_totalprice > 250000 THEN 'dear' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'other' END AS stratum FROM orders),
  c AS (SELECT stratum, count(*) FILTER (tr) AS n_train FROM s GROUP BY 1)
  SELECT stratum, n_train, CASE WHEN n_train > 0 THEN round(1 / sqrt(n_train / (sum(n_train) OVER ())), 6) END AS weight FROM c""")
def a7_strata(spark, d):
    s = decisions.stratum([("p", F.col("o_orderstatus") == "P"), ("dear", F.col("o_totalprice") > 250000), ("urgent", F.col("o_orderpriority").startswith("1"))])
    w = decisions.stratum_weights(table(spark, d, "orders").withColumn("stratum", s), stratum_col="stratum", is_train=F.col("o_orderkey") % 3 != 0)
    return w.select("stratum", "n_train", r6("weight", "weight"))


@query("""SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def set_operations(spark, d):
    """Distinct, except, intersect and union all of keys."""
    have = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    common = asked.intersect(have)
    return asked.distinct().unionByName(common).exceptAll(common).join(have, "k", "left_anti")


@query("""SELECT n_name, s_name, c_acct FROM (SELECT n_nationkey, n_name FROM nation) JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
  JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) AS c_acct FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def s6_dimension_join(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("s_name"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("c_acct"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return stored(n.join(s, "k").join(c, "k").select("n_name", "s_name", "c_acct"), "dimension")
