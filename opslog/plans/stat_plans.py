"""Inventories, statistics, evaluation and sampling over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choice, evaluate, joins, quality, windows
from .bind import events, query, r6, table


def _lines(spark, d):
    return table(spark, d, "lineitem")


@query("""SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, GROUPING(event_type, strftime(ts, '%Y-%m')) AS grouping
  FROM events GROUP BY GROUPING SETS ((event_type), (strftime(ts, '%Y-%m')), (event_type, strftime(ts, '%Y-%m')), ())""")
def a1_inventory(spark, d):
    rows = events(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return quality.counts_by(rows, [["event_type"], ["month"], ["event_type", "month"], []])


@query("""SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, round(avg(l_quantity), 6) AS avg_quantity, round(stddev_samp(l_extendedprice), 4) AS std_price,
  round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share_discounted FROM lineitem GROUP BY 1""")
def a2_describe(spark, d):
    return _lines(spark, d).groupBy((F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early")).agg(
        F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_parts"), r6(F.avg("l_quantity"), "avg_quantity"),
        F.round(F.stddev_samp("l_extendedprice"), 4).alias("std_price"), r6(F.avg((F.col("l_discount") > 0.05).cast("double")), "share_discounted"),
    )


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def a2_value_shares(spark, d):
    return quality.value_shares(events(spark, d), "event_type").select("event_type", "n", r6("share", "share"))


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT event_type, count(*) AS n_keys, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM k GROUP BY 1""")
def a4_group_quantiles(spark, d):
    q = quality.group_quantiles(events(spark, d), ["user_id", "event_type"], ["event_type"], [0.1, 0.5, 0.9])
    return q.select("event_type", "n_keys", *(r6(c, c) for c in ("p10", "p50", "p90")))


@query("""SELECT f AS feature, count(v) AS n, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 6) AS std
  FROM (SELECT unnest(['quantity', 'price', 'flat']) AS f, unnest([l_quantity, l_extendedprice, 1.0]) AS v FROM lineitem WHERE l_orderkey % 5 <> 0) GROUP BY 1""")
def a5_normalisation(spark, d):
    rows = _lines(spark, d).select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.lit(1.0).alias("flat"))
    n = quality.normalisation(rows, ["quantity", "price", "flat"], F.col("l_orderkey") % 5 != 0)
    return n.select("feature", "n", r6("mean", "mean"), r6("std", "std"))


@query("SELECT p_type AS value, row_number() OVER (ORDER BY p_type)::INTEGER AS idx FROM (SELECT DISTINCT p_type FROM part)")
def a5_vocabulary(spark, d):
    return quality.vocabulary(table(spark, d, "part"), "p_type")


@query("""WITH s AS (SELECT user_id, min(ts) AS start, count(*) AS n FROM events GROUP BY 1)
  SELECT CASE WHEN start < TIMESTAMP '2024-01-02' THEN 'train' WHEN start < TIMESTAMP '2024-01-03' THEN 'val' ELSE 'test' END AS split, count(*) AS n_sessions, sum(n)::BIGINT AS n_rows FROM s GROUP BY 1""")
def a6_session_split(spark, d):
    from datetime import datetime

    from ..functions.parse import time_split

    s = quality.session_split(events(spark, d), session=["user_id"], ts="ts", split=lambda t: time_split(t, datetime(2024, 1, 2), datetime(2024, 1, 3)))
    return s.groupBy("split").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_rows"))


@query("""WITH k AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_odd FROM events GROUP BY 1)
  SELECT user_id, n, n_odd, round(n_odd / n, 6) AS share_odd, round(n_odd / (SELECT sum(n_odd) FROM k), 6) AS share_of_all_odd FROM k WHERE n >= 60""")
def a8_concentration(spark, d):
    c = quality.concentration(events(spark, d), key="user_id", is_odd=F.col("event_type") == "error", support=60)
    return c.select("user_id", "n", "n_odd", r6("share_odd", "share_odd"), r6("share_of_all_odd", "share_of_all_odd"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
  SELECT user_id, max(event_type) FILTER (k = 1) AS mode, max(n) AS mode_n, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS mode_share FROM r GROUP BY 1""")
def a9_modes(spark, d):
    m = quality.modes(events(spark, d), group="user_id", value="event_type")
    return m.select("user_id", "mode", "mode_n", "n", r6("mode_share", "mode_share"))


@query("""SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS pct FROM lineitem GROUP BY 1""")
def a10_histogram(spark, d):
    from ..functions.parse import bucket

    return quality.histogram(_lines(spark, d), bucket(F.col("l_quantity"), [10, 25])).select("bucket", "n", r6("pct", "pct"))


@query("""WITH u AS (SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1)
  (SELECT *, 'top' AS side FROM u ORDER BY total DESC, user_id LIMIT 5) UNION ALL (SELECT *, 'bottom' FROM u ORDER BY total, user_id LIMIT 5)""")
def a11_top_bottom(spark, d):
    u = events(spark, d).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return quality.top_and_bottom(u, by="total", tie="user_id", n=5)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
  SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def a11_a32_spearman(spark, d):
    return quality.spearman(_lines(spark, d), "l_quantity", "l_extendedprice").select("n", r6("rho", "rho"))


@query("""WITH t AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_tax) AS x FROM lineitem GROUP BY 1)
  SELECT l_orderkey, p AS preset, round(q * a + x * b, 4) AS total FROM t, (VALUES ('plain', 1.0, 1.0), ('taxed', 0.5, 20.0)) AS g(p, a, b)""")
def a11_preset_sweep(spark, d):
    s = quality.preset_sweep(_lines(spark, d), components=["l_quantity", "l_tax"], presets={"plain": [1, 1], "taxed": [0.5, 20]}, session=["l_orderkey"])
    return s.select("l_orderkey", "preset", F.round("total", 4).alias("total"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, round(avg(CASE WHEN l_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS cov_line
  FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def a12_coverage(spark, d):
    has = _lines(spark, d).filter("l_discount > 0.08").select(F.col("l_orderkey").alias("line")).distinct()
    o = table(spark, d, "orders").join(has, F.col("o_orderkey") == F.col("line"), "left")
    return quality.coverage_by(o, [F.col("o_orderstatus").alias("status")], ["line"]).select("status", "n", r6("cov_line", "cov_line"))


@query("""SELECT 'positive' AS gate, 0::BIGINT AS n_bad, 0.0::DOUBLE AS rate, 'PASS' AS status FROM (SELECT count(*) FROM lineitem)
  UNION ALL SELECT 'cheap', count(*) FILTER (l_extendedprice > 30000), round(count(*) FILTER (l_extendedprice > 30000) / count(*), 6), CASE WHEN count(*) FILTER (l_extendedprice > 30000) <= 0.01 * count(*) THEN 'PASS' ELSE 'FAIL' END FROM lineitem""")
def a14_gates(spark, d):
    g = quality.gates(_lines(spark, d), {"positive": (F.col("l_quantity") <= 0, 0.0), "cheap": (F.col("l_extendedprice") > 30000, 0.01)})
    return g.select("gate", "n_bad", r6("rate", "rate"), "status")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT *, median(v) OVER () AS med FROM m), b AS (SELECT *, median(abs(v - med)) OVER () AS mad FROM a)
  SELECT month, round(v, 2) AS v, abs(v - med) > 3 * 1.4826 * mad AS is_outlier FROM b""")
def a15_outlier_months(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return quality.outlier_months(m, month="month", value="v").select("month", F.round("v", 2).alias("v"), "is_outlier")


@query("""SELECT 'o_totalprice' AS "column", count(*) FILTER (o_orderkey % 10 < 3) AS n_changed, count(*) FILTER (o_orderkey % 10 = 0) AS n_forbidden FROM orders""")
def a16_version_diff(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = old.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 < 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return quality.version_diff(old, new, key="o_orderkey", columns=["o_totalprice"], allowed=F.col("o_orderkey") % 10 > 0)


@query("""SELECT l_linestatus AS cause, count(*) AS n, count(*) FILTER ((l_returnflag = 'N') <> (l_quantity > 25)) AS n_mismatch FROM lineitem GROUP BY 1""")
def a17_mismatch(spark, d):
    rows = _lines(spark, d).withColumn("stored", F.col("l_returnflag") == "N")
    return quality.recomputed_mismatch(rows, stored="stored", again=F.col("l_quantity") > 25, cause=F.col("l_linestatus"))


@query("""SELECT 'n' AS name, count(*)::DOUBLE AS actual, 1.0::DOUBLE AS expected, count(*) >= 1 AS ok FROM events UNION ALL SELECT 'kinds', count(DISTINCT event_type), 5.0, count(DISTINCT event_type) = 5 FROM events""")
def a18_expectations(spark, d):
    m = events(spark, d).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return quality.expectations(m, {"n": (">=", 1), "kinds": ("==", 5)})


@query("""WITH x AS (SELECT o.o_orderkey, o_custkey, list(l_linenumber - 2) AS ages, list(l_suppkey) AS ids FROM orders o JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
  SELECT o_orderkey, array_to_string(list_filter([CASE WHEN len(list_filter(ages, lambda a: a < 0)) > 0 THEN 'temporal_causality' END, CASE WHEN list_contains(ids, o_custkey % 100) THEN 'schedule_outlook' END], lambda v: v IS NOT NULL), ',') AS violations FROM x""")
def a19_leak_audit(spark, d):
    x = table(spark, d, "orders").join(_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey").agg(
        F.collect_list(F.col("l_linenumber") - 2).alias("ages"), F.collect_list("l_suppkey").alias("ids")
    )
    bad = quality.leak_checks(token_ages=F.col("ages"), outlook_ids=F.col("ids"), focal=F.col("o_custkey") % 100)
    return x.select("o_orderkey", F.array_join(bad, ",").alias("violations"))


_AUDITED = """x AS (SELECT o_orderkey, o_orderkey % 50 = 0 AS off_center, o_orderkey % 41 AS source, list(l_linenumber - 2) AS ages, list(l_suppkey % 9) AS platforms, count(*) FILTER (l_linenumber % 4 = 1) AS n_focal
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
  v AS (SELECT *, [CASE WHEN off_center THEN 'subgraph_center' END, CASE WHEN len(list_filter(platforms, lambda p: p NOT BETWEEN 1 AND 7)) > 0 THEN 'schedule_outlook' END, CASE WHEN source = 0 THEN 'flags_source' END,
    CASE WHEN len(list_filter(ages, lambda a: a < 0)) > 0 THEN 'temporal_causality' END, CASE WHEN n_focal <> 1 THEN 'one_focal_train' END] AS bad FROM x)"""


@query(f"""WITH {_AUDITED}, k AS (SELECT unnest(['subgraph_center', 'no_focal_graph_flags', 'banned_fields', 'schedule_outlook', 'flags_source', 'temporal_causality', 'one_focal_train']) AS "check"),
  b AS (SELECT o_orderkey, unnest(bad) AS "check" FROM v), t AS (SELECT count(*) AS n FROM v), c AS (SELECT "check", count(*) AS n_bad, min(o_orderkey) AS least FROM b WHERE "check" IS NOT NULL GROUP BY 1)
  SELECT k."check", t.n AS n_rows, coalesce(n_bad, 0) + CASE k."check" WHEN 'banned_fields' THEN t.n ELSE 0 END AS n_bad, coalesce(least, CASE k."check" WHEN 'banned_fields' THEN (SELECT min(o_orderkey) FROM v) ELSE -1 END) AS first_bad
  FROM k CROSS JOIN t LEFT JOIN c ON k."check" = c."check" """)
def a19_leak_report(spark, d):
    """All seven checks over nested snapshots of orders with planted faults; one field of the tokens is banned."""
    rows = table(spark, d, "orders").join(_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(
        F.collect_list(F.struct((F.col("l_linenumber") - 2).alias("age_s"), F.col("l_partkey").alias("chosen_route"))).alias("tokens"),
        F.collect_list(F.struct((F.col("l_suppkey") % 9).alias("planned_platform"))).alias("outlook"),
        F.collect_list(F.struct(F.col("l_suppkey").alias("train"), (F.col("l_linenumber") % 4 == 1).alias("is_focal"))).alias("trains"),
        F.collect_list(F.struct(F.col("l_partkey").alias("id"))).alias("tracks"),
    )
    key = F.col("o_orderkey")
    rows = rows.withColumn("center", F.struct(F.lit("track").alias("type"), F.when(key % 50 == 0, key + 1).otherwise(key).alias("id")))
    bad = quality.snapshot_violations(
        rows, center="center", current=key, nodes={"track": "tracks"}, tokens="tokens", age="age_s", outlook="outlook", platform="planned_platform",
        flags_source=F.when(key % 41 == 0, "focal_signal").otherwise("both"), trains="trains", banned=["chosen_route"],
    )
    report = quality.leak_report(rows, bad, key="o_orderkey", examples=1)
    return report.select("check", "n_rows", "n_bad", F.coalesce(F.get("examples", F.lit(0)), F.lit(-1)).alias("first_bad"))


_PRED = "p AS (SELECT l_linestatus AS stratum, l_linenumber % 3 AS truth, CASE WHEN l_quantity > 20 THEN l_linenumber % 3 ELSE (l_linenumber + 1) % 3 END AS pred FROM lineitem)"
_METRICS = """count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) FILTER (truth > 0), 6) AS top1_set,
  round(avg(CASE WHEN truth = 0 THEN 1.0 ELSE 0.0 END) FILTER (pred = 0), 6) AS wait_precision, round(avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END) FILTER (truth = 0), 6) AS wait_recall,
  round(avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END), 6) AS wait_rate_predicted, round(avg(CASE WHEN truth = 0 THEN 1.0 ELSE 0.0 END), 6) AS wait_rate_true"""


def _predictions(spark, d):
    n = F.col("l_linenumber")
    return _lines(spark, d).select(F.col("l_linestatus").alias("stratum"), (n % 3).alias("truth"), F.when(F.col("l_quantity") > 20, n % 3).otherwise((n + 1) % 3).alias("pred"), "l_orderkey", "l_extendedprice", "l_discount")


def _rounded(df, *names):
    return df.select(*names, *(r6(c, c) for c in df.columns if c not in names))


@query(f"WITH {_PRED} SELECT {_METRICS} FROM p")
def a20_metrics(spark, d):
    return _rounded(evaluate.metrics(_predictions(spark, d), truth="truth", predicted="pred"), "n")


@query(f"WITH {_PRED} SELECT coalesce(stratum, 'overall') AS stratum, {_METRICS} FROM p GROUP BY ROLLUP (stratum)")
def a21_metrics_by_stratum(spark, d):
    return _rounded(evaluate.metrics_by(_predictions(spark, d), stratum="stratum", truth="truth", predicted="pred"), "stratum", "n")


@query("""WITH g AS (SELECT l_extendedprice - 1000 * l_quantity AS g FROM lineitem) SELECT count(g) AS n, round(avg(g), 4) AS mean, round(quantile_cont(g, 0.05), 4) AS p5, round(quantile_cont(g, 0.95), 4) AS p95, round(avg(CASE WHEN g >= 0 THEN 1.0 ELSE 0.0 END), 6) AS share_ok FROM g""")
def a22_margins(spark, d):
    m = evaluate.margins(_lines(spark, d).withColumn("other", 1000 * F.col("l_quantity")), best="l_extendedprice", other="other")
    return m.select("n", *(F.round(c, 4).alias(c) for c in ("mean", "p5", "p95")), r6("share_ok", "share_ok"))


@query("""WITH x AS (SELECT l_orderkey, count(*) AS n_options, (l_orderkey % 3 + 1)::INTEGER AS chosen, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE (l_orderkey % 2 + 1)::INTEGER END AS preferred FROM lineitem GROUP BY 1)
  SELECT count(*) AS n, round(avg(1.0 / n_options), 6) AS uniform, round(avg(CASE WHEN chosen = coalesce(preferred, 1) THEN 1.0 ELSE 0.0 END), 6) AS preferred, round(avg(CASE WHEN chosen = 1 THEN 1.0 ELSE 0.0 END), 6) AS "first",
    round((SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM x GROUP BY chosen)), 6) AS majority FROM x""")
def a23_baselines(spark, d):
    key = F.col("l_orderkey")
    x = _lines(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n_options"))
    x = x.withColumns({"chosen": key % 3 + 1, "pref": F.when(key % 4 != 0, key % 2 + 1)})
    return _rounded(evaluate.baselines(x, n_options="n_options", chosen_index="chosen", preferred_index="pref"), "n")


_RULES = [("r1", ["Brand#11", "Brand#12"], None, [1, 2, 3]), ("r2", None, [1, 2, 3, 4, 5], [4, 5]), ("r3", ["Brand#11"], [10, 20], [10])]


@query("""WITH r AS (SELECT * FROM (VALUES ('r1', ['Brand#11', 'Brand#12'], NULL::INTEGER[], [1, 2, 3]), ('r2', NULL, [1, 2, 3, 4, 5], [4, 5]), ('r3', ['Brand#11'], [10, 20], [10])) AS t(rule_id, brands, sizes, platforms)),
  m AS (SELECT p_partkey, p_size % 12 AS platform, rule_id, platforms FROM part, r WHERE (brands IS NULL OR list_contains(brands, p_brand)) AND (sizes IS NULL OR list_contains(sizes, p_size))),
  k AS (SELECT *, CASE WHEN list_contains(platforms, platform) THEN 'compliant' WHEN list_contains(platforms, (p_partkey % 12)::INTEGER) THEN 'non-compliant' ELSE 'preferred-unavailable' END AS v, row_number() OVER (PARTITION BY p_partkey ORDER BY len(platforms), rule_id) AS k FROM m)
  SELECT p_partkey, v AS hard_status, rule_id FROM k WHERE k = 1""")
def j19_a24_compliance(spark, d):
    rules = spark.createDataFrame(_RULES, "rule_id string, brands array<string>, sizes array<int>, platforms array<int>")
    p = table(spark, d, "part").withColumn("platform", F.col("p_size") % 12)
    m = joins.rule_matches(p, rules, predicates={"brands": "p_brand", "sizes": "p_size"})
    m = m.withColumns({"kind": F.lit("platform_set"), "n_platforms": F.size("platforms")})
    verdict = evaluate.platform_verdict(F.col("platform"), F.col("platforms"), F.array((F.col("p_partkey") % 12).cast("int")))
    return evaluate.compliance(m, decision="p_partkey", kind="kind", specificity="n_platforms", verdict=verdict, rule="rule_id")


@query("""WITH s AS (SELECT p_brand AS cell, CASE p_size % 3 WHEN 0 THEN 'compliant' WHEN 1 THEN 'non-compliant' ELSE 'no-rule' END AS st FROM part)
  SELECT coalesce(cell, 'overall') AS cell, count(*) AS n, count(*) FILTER (st = 'compliant') AS compliant, count(*) FILTER (st = 'non-compliant') AS non_compliant, count(*) FILTER (st = 'no-rule') AS no_rule,
    round(count(*) FILTER (st = 'compliant') / nullif(count(*) FILTER (st <> 'no-rule'), 0), 6) AS compliant_rate FROM s GROUP BY ROLLUP (cell)""")
def a25_status_rollup(spark, d):
    st = F.when(F.col("p_size") % 3 == 0, "compliant").when(F.col("p_size") % 3 == 1, "non-compliant").otherwise("no-rule")
    out = evaluate.status_rollup(table(spark, d, "part").select(F.col("p_brand").alias("cell"), st.alias("st")), group="cell", status="st", statuses=["compliant", "non-compliant", "no-rule"])
    return out.select("cell", "n", "compliant", "non_compliant", "no_rule", r6("compliant_rate", "compliant_rate"))


@query("""WITH x AS (SELECT l_linenumber % 2 AS h, l_suppkey % 2 AS m, l_discount * 10 AS f, l_tax * 20 AS dl, CASE l_returnflag WHEN 'A' THEN 'compliant' WHEN 'N' THEN 'no-rule' ELSE 'non-compliant' END AS st FROM lineitem)
  SELECT d AS delta_min, mode, CASE WHEN h = m THEN 'agreement' WHEN dl > d AND f > 0.5 AND (CASE WHEN mode = 'literal' THEN st = 'compliant' ELSE st <> 'non-compliant' END) THEN 'consider' ELSE 'silent' END AS verdict, count(*) AS n
  FROM x, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) AS g(d), (VALUES ('refined'), ('literal')) AS k(mode) GROUP BY 1, 2, 3""")
def a26_override_sweep(spark, d):
    st = F.when(F.col("l_returnflag") == "A", "compliant").when(F.col("l_returnflag") == "N", "no-rule").otherwise("non-compliant")
    x = _lines(spark, d).select((F.col("l_linenumber") % 2).alias("h"), (F.col("l_suppkey") % 2).alias("m"), (F.col("l_discount") * 10).alias("f"), (F.col("l_tax") * 20).alias("dl"), st.alias("st"))
    return evaluate.override_sweep(x, human="h", model="m", faithfulness="f", delta="dl", status="st", deltas=[0.25, 0.75], least_faithful=0.5)


@query("""WITH x AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag <> 'R' END AS ok, l_quantity - 25 AS c FROM lineitem), k AS (SELECT CASE WHEN ok IS NULL THEN 'indeterminate' WHEN NOT ok THEN 'unsafe' WHEN c > 5 THEN 'improving' WHEN c < -5 THEN 'worse' ELSE 'neutral' END AS kind FROM x)
  SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share FROM k GROUP BY 1""")
def a27_divergence(spark, d):
    x = _lines(spark, d).select(F.when(F.col("l_linenumber") != 1, F.col("l_returnflag") != "R").alias("ok"), (F.col("l_quantity") - 25).alias("c"))
    return evaluate.divergence(x, safe="ok", change="c", tolerance=5).select("kind", "n", r6("share", "share"))


@query("""WITH r AS (SELECT l_linenumber AS run, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1), u AS (SELECT unnest(['q', 'p']) AS metric, unnest([q, p]) AS v FROM r)
  SELECT metric, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max FROM u GROUP BY 1""")
def a28_across_runs(spark, d):
    r = _lines(spark, d).groupBy(F.col("l_linenumber").alias("run")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    return evaluate.across_runs(r, run="run", columns=["q", "p"]).select("metric", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS l, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS b FROM events)
  SELECT user_id, max(event_id) AS last_step, max(value) FILTER (event_id = (SELECT max(x.event_id) FROM events x WHERE x.user_id = r.user_id)) AS last_score, max(event_id) FILTER (b = 1) AS best_step, max(value) AS best_score, max(value) >= 100 AS passed FROM r GROUP BY 1""")
def a29_run_summary(spark, d):
    return evaluate.run_summary(events(spark, d), run="user_id", step="event_id", score="value", gate=100)


_THRESHOLDS = [sum(2.718281828459045**-1 / __import__("math").factorial(j) for j in range(k + 1)) for k in range(12)]


def _poisson_sql(text: str) -> str:
    """The Poisson(1) draw of evaluate.poisson_weight from the md5 of a text."""
    u = f"((('0x' || substr(md5({text}), 1, 12))::UBIGINT + 0.5) / 281474976710656.0)"
    return "CASE " + " ".join(f"WHEN {u} < {t!r} THEN {k}" for k, t in enumerate(_THRESHOLDS)) + " ELSE 12 END"


@query(f"""WITH s AS (SELECT l_returnflag, l_orderkey, sum(l_discount) AS s, count(l_discount) AS n FROM lineitem GROUP BY 1, 2),
  dr AS (SELECT l_returnflag, b, s, n, {_poisson_sql("'7|' || b || '|' || l_orderkey")} AS w FROM s, range(1, 101) AS t(b)),
  m AS (SELECT l_returnflag, b, sum(w * s) / nullif(sum(w * n), 0) AS m, sum(s) / sum(n) AS e FROM dr GROUP BY 1, 2)
  SELECT l_returnflag, round(any_value(e), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1""")
def a30_bootstrap(spark, d):
    out = evaluate.bootstrap(_lines(spark, d), cluster=["l_orderkey"], value="l_discount", replicates=100, strata=["l_returnflag"])
    return out.select("l_returnflag", *(r6(c, c) for c in ("estimate", "low", "high")))


@query("""SELECT 'price' AS component, round(avg(l_extendedprice - 1000 * l_quantity), 4) AS difference FROM lineitem UNION ALL SELECT 'tax', round(avg(l_tax - l_discount), 4) FROM lineitem
  UNION ALL SELECT 'residual', round(avg((l_extendedprice + l_tax + 1) - (1000 * l_quantity + l_discount)) - avg(l_extendedprice - 1000 * l_quantity) - avg(l_tax - l_discount), 4) FROM lineitem""")
def a31_components(spark, d):
    x = _lines(spark, d).withColumns({"b": 1000 * F.col("l_quantity"), "t": F.col("l_extendedprice") + F.col("l_tax") + 1}).withColumn("u", F.col("b") + F.col("l_discount"))
    out = evaluate.component_difference(x, pairs={"price": ("l_extendedprice", "b"), "tax": ("l_tax", "l_discount")}, total=("t", "u"))
    return out.select("component", F.round("difference", 4).alias("difference"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_extendedprice AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS k FROM lineitem)
  SELECT l_partkey, count(*) AS n_top, round(avg(w) + 1e-7, 4) AS mean_weight, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS coverage FROM r WHERE k <= 2 GROUP BY 1""")
def a33_attribution(spark, d):
    out = evaluate.attribution_rollup(_lines(spark, d), decision="l_orderkey", key="l_partkey", weight="l_extendedprice", k=2)
    return out.select("l_partkey", "n_top", F.round(F.col("mean_weight") + 1e-7, 4).alias("mean_weight"), r6("coverage", "coverage"))


_U = lambda text: f"((('0x' || substr(md5({text}), 1, 12))::UBIGINT + 0.5) / 281474976710656.0)"


@query(f"""WITH u AS (SELECT event_id, event_type, {_U("'3|' || event_id")} AS u FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY u, event_id) AS k, row_number() OVER (ORDER BY u, event_id) AS g FROM u)
  SELECT event_type, count(*) FILTER (k <= 20) AS n, sum(event_id) FILTER (k <= 20)::BIGINT AS ids, count(*) FILTER (g <= 50) AS n_first, coalesce(sum(event_id) FILTER (g <= 50), 0)::BIGINT AS first_ids FROM r GROUP BY 1""")
def m1_m2_samples(spark, d):
    per = choice.sample_per_group(events(spark, d), group=["event_type"], key=["event_id"], n=20, seed=3).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    few = choice.sample_rows(events(spark, d), key=["event_id"], n=50, seed=3).groupBy("event_type").agg(F.count("*").alias("n_first"), F.sum("event_id").alias("first_ids"))
    return per.join(few, "event_type", "left").select("event_type", "n", "ids", F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("first_ids", F.lit(0)).alias("first_ids"))


@query(f"""WITH k AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), w AS (SELECT *, sqrt(sum(c) OVER () / c) AS w, sum(c) OVER () AS a FROM k), m AS (SELECT event_type, c, a * w / sum(w * c) OVER () AS mean FROM w),
  t AS (SELECT event_type, c, CASE WHEN {_U("'3|' || event_id")} < mean - floor(mean) THEN 1 ELSE 0 END + coalesce(list_sum(list_transform(range(floor(mean)::BIGINT), lambda i: {_poisson_sql("'3|' || i || '|' || event_id")})), 0) AS times FROM events JOIN m USING (event_type))
  SELECT event_type, least(max(c), 20)::BIGINT AS n, sum(times)::BIGINT AS n_resampled FROM t GROUP BY 1""")
def m1_m3_sampling(spark, d):
    per = choice.sample_per_group(events(spark, d), group=["event_type"], key=["event_id"], n=20, seed=3).groupBy("event_type").agg(F.count("*").alias("n"))
    again = choice.resample_balanced(events(spark, d), stratum="event_type", key=["event_id"], seed=3).groupBy("event_type").agg(F.count("*").alias("n_resampled"))
    return per.join(again, "event_type")


@query(f"""WITH u AS (SELECT event_id, event_type, -ln({_U("'5|' || event_id")}) / (value + 1) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k, event_id) AS n FROM u)
  SELECT event_type, event_id FROM r WHERE n <= 30""")
def m3_weighted_sample(spark, d):
    """Thirty events of each kind without replacement, with chances in proportion to their values."""
    rows = events(spark, d).withColumn("w", F.col("value") + 1)
    return choice.sample_weighted(rows, group=["event_type"], key=["event_id"], weight="w", n=30, seed=5).select("event_type", "event_id")


@query("""WITH p AS (SELECT o_orderpriority AS cell, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS share FROM orders GROUP BY 1)
  SELECT cell, round(ln(share / (1 - share)), 4) AS weight FROM p""")
def m4_m6_closed_form(spark, d):
    """Two alternatives that differ in one constant: the fitted weight of each subset is the log odds of the share chosen."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 150000).cast("int").alias("dear"))
    rows = o.withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("chosen", (F.col("x") == F.col("dear")).cast("int"))
    cells = [r[0] for r in o.select("o_orderpriority").distinct().collect()]  # five priorities
    fits = choice.fit_subsets(rows, decision=["o_orderkey"], columns=["x"], chosen="chosen", subsets={c: F.col("o_orderpriority") == c for c in cells}, l2=0.0)
    out = [(c, w["x"]) for c, w in fits.items()]
    return spark.createDataFrame(out, "cell string, weight double").select("cell", F.round("weight", 4).alias("weight"))


@query(f"""WITH w AS (SELECT b, o_totalprice > 150000 AS dear, {_poisson_sql("'7|' || b || '|' || o_custkey")} AS w FROM orders, range(1, 21) AS t(b)),
  s AS (SELECT b, sum(w) FILTER (dear) AS yes, sum(w) FILTER (NOT dear) AS no FROM w GROUP BY 1) SELECT b::INTEGER AS replicate, round(ln(yes / no), 4) AS weight FROM s""")
def m5_bootstrap_closed_form(spark, d):
    """The same with weights drawn for customers: 20 replicates fitted in the same passes."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 150000).cast("int").alias("dear"))
    rows = o.withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("chosen", (F.col("x") == F.col("dear")).cast("int"))
    fits = choice.bootstrap_choice(rows, decision=["o_orderkey"], columns=["x"], chosen="chosen", cluster=["o_custkey"], replicates=20, l2=0.0)
    return spark.createDataFrame([(b, w["x"]) for b, w in enumerate(fits, 1)], "replicate int, weight double").select("replicate", F.round("weight", 4).alias("weight"))


@query("""WITH b AS (SELECT *, l_extendedprice = max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS c FROM lineitem), s AS (SELECT 'final' AS subset, * FROM b WHERE l_linestatus = 'F' UNION ALL SELECT 'returned', * FROM b WHERE l_returnflag = 'R')
  SELECT subset, round(avg(l_quantity) FILTER (c), 6) AS mean_chosen, round(avg(l_quantity) FILTER (NOT c), 6) AS mean_other FROM s GROUP BY 1""")
def m6_subset_means(spark, d):
    best = F.max("l_extendedprice").over(windows.W.partitionBy("l_orderkey"))
    rows = _lines(spark, d).withColumn("chosen", (F.col("l_extendedprice") == best).cast("int")).withColumn("l_quantity", F.col("l_quantity").cast("double"))
    sets = choice.subset_rows(rows, {"final": F.col("l_linestatus") == "F", "returned": F.col("l_returnflag") == "R"})
    return choice.chosen_means(sets, columns=["l_quantity"], chosen="chosen", by=["subset"]).select("subset", r6("mean_chosen", "mean_chosen"), r6("mean_other", "mean_other"))


@query("""SELECT l_linenumber, count(*) AS n, round(avg(1 - abs(l_extendedprice - 1000 * l_quantity) / abs(nullif(1000 * l_quantity, 0))), 6) AS faithfulness FROM lineitem GROUP BY 1""")
def m8_faithfulness(spark, d):
    x = _lines(spark, d).withColumn("f", evaluate.faithfulness(F.col("l_extendedprice"), 1000.0 * F.col("l_quantity")))
    return x.groupBy("l_linenumber").agg(F.count("*").alias("n"), r6(F.avg("f"), "faithfulness"))


@query("""WITH RECURSIVE d AS (SELECT l_orderkey AS o, l_quantity / 50 AS x, l_discount AS z, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) = 1 AS y FROM lineitem),
  n AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
    SELECT i + 1, a + ((hz + 0.001) * gx - hxz * gz) / det, b + ((hx + 0.001) * gz - hxz * gx) / det FROM (
      SELECT i, a, b, sum(gx) - 0.001 * a AS gx, sum(gz) - 0.001 * b AS gz, sum(hx) AS hx, sum(hz) AS hz, sum(hxz) AS hxz, (sum(hx) + 0.001) * (sum(hz) + 0.001) - sum(hxz) * sum(hxz) AS det FROM (
        SELECT i, a, b, o, sum(x) FILTER (y) - sum(e * x) / sum(e) AS gx, sum(z) FILTER (y) - sum(e * z) / sum(e) AS gz, sum(e * x * x) / sum(e) - (sum(e * x) / sum(e)) ** 2 AS hx,
          sum(e * z * z) / sum(e) - (sum(e * z) / sum(e)) ** 2 AS hz, sum(e * x * z) / sum(e) - sum(e * x) / sum(e) * sum(e * z) / sum(e) AS hxz
        FROM (SELECT n.i, n.a, n.b, d.o, d.x, d.z, d.y, exp(n.a * d.x + n.b * d.z) AS e FROM n, d WHERE n.i < 8) GROUP BY i, a, b, o) GROUP BY i, a, b))
  SELECT 'quantity' AS feature, round(a, 6) AS weight FROM n WHERE i = 8 UNION ALL SELECT 'discount', round(b, 6) FROM n WHERE i = 8""")
def m4_choice_fit(spark, d):
    rows = _lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") / 50).alias("quantity"), F.col("l_discount").alias("discount"), "l_extendedprice")
    best = F.max(F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")).over(windows.W.partitionBy("l_orderkey"))
    own = F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    rows = rows.withColumn("chosen", (own == best).cast("int")).select("l_orderkey", "quantity", "discount", "chosen")
    w = choice.fit_choice(rows, decision=["l_orderkey"], columns=["quantity", "discount"], chosen="chosen", rounds=8, tolerance=1e-13)
    return spark.createDataFrame([(n, round(v, 6)) for n, v in w.items()], "feature string, weight double")


@query("""WITH g AS (SELECT l_suppkey AS game, m::BIGINT AS mask, bit_count(m) * sum(l_quantity) + m * 0.5 AS v FROM lineitem, range(8) AS t(m) GROUP BY 1, 2, m),
  p AS (SELECT a.game, i AS player, (b.v - a.v) * [1/3.0, 1/6.0, 1/3.0][bit_count(a.mask)::INTEGER + 1] AS x FROM g a, range(3) AS k(i) JOIN g b ON b.game = a.game AND b.mask = a.mask | (1::BIGINT << i) WHERE a.mask & (1::BIGINT << i) = 0)
  SELECT game, player::INTEGER AS player, round(sum(x), 4) AS phi FROM p GROUP BY 1, 2""")
def m7_shapley(spark, d):
    total = _lines(spark, d).groupBy(F.col("l_suppkey").alias("game")).agg(F.sum("l_quantity").alias("q"))
    v = total.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    v = v.withColumn("v", F.bit_count("mask") * F.col("q") + F.col("mask") * 0.5)
    return choice.shapley(v, game=["game"], mask="mask", value="v", players=3).select("game", "player", F.round("phi", 4).alias("phi"))


@query("""WITH q AS (SELECT l_partkey, l_suppkey, min(l_shipdate) AS t FROM lineitem GROUP BY 1, 2) SELECT count(*) AS n, count(*) FILTER (l_suppkey % 2 = 0) AS n_covered, round(avg(CASE WHEN l_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM q""")
def j18_coverage(spark, d):
    q = _lines(spark, d).groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("t"))
    c = joins.coverage_of(q.withColumn("options", F.filter(F.array("l_suppkey"), lambda x: x % 2 == 0)), chosen="l_suppkey", candidates="options")
    return c.select("n", "n_covered", r6("share", "share"))


@query("""WITH tl AS (SELECT user_id AS e, ts, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS st, event_type AS train FROM events WHERE event_type <> 'purchase'),
  rq AS (SELECT event_id, ts, (user_id + k) % 150 AS e, k FROM events, range(3) AS t(k) WHERE event_type = 'purchase'),
  h AS (SELECT rq.*, tl.st, tl.train FROM rq ASOF LEFT JOIN tl ON rq.e = tl.e AND rq.ts >= tl.ts)
  SELECT event_id, count(*) AS n_elements, count(*) FILTER (st = 1) AS n_occupied, count(*) FILTER (st = 1 AND train <> 'view') AS n_by_other, coalesce(min(k) FILTER (st = 1), -1)::INTEGER AS first_occupied FROM h GROUP BY 1""")
def j13_conflicts(spark, d):
    tl = events(spark, d).filter("event_type <> 'purchase'").select(F.col("user_id").alias("e"), F.col("ts").alias("ets"), F.col("event_type").isin("view", "click").cast("int").alias("st"), F.col("event_type").alias("train"))
    rq = events(spark, d, "purchase").select("event_id", "ts", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.col("user_id") + k) % 150).alias("els"), F.lit("view").alias("focal"))
    out = joins.conflicts(rq, tl, request_id="event_id", ts="ts", elements="els", element="e", event_ts="ets", state="st", train="train", focal="focal")
    return out.withColumn("first_occupied", F.coalesce("first_occupied", F.lit(-1)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'closed' END, CASE WHEN p_size > 40 THEN 'large' END, 'none') AS tag
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def j23_fallback(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("closed").alias("tag"))
    p = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.lit("large").alias("tag"))
    out = joins.with_fallback(_lines(spark, d), [(o, "l_orderkey"), (p, "l_partkey")], value="tag", default="none")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tag")


