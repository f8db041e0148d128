"""One nested snapshot per purchase: centre, tokens, outlook, kinds as nodes, flags and audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import asof, decisions, graph, joins, quality, snapshot
from .bind import TL, events, purchases, query, route_steps, table, timeline
from .graph_plans import _CONNECTS

_KINDS = "view", "click", "error", "signup"


def _tokens(points, log):
    """The last eight events of the user, with their ages."""
    recent = log.select("user_id", "ts", F.col("event_id").alias("token_id"), F.col("event_type").alias("token_kind"))
    tokens = joins.last_events(points.select("event_id", "user_id", "ts"), recent, keys=["user_id"], probe_id="event_id", probe_ts="ts", event_ts="ts", columns=["token_id", "token_kind"], k=8)
    return snapshot.nested(tokens.join(points.select("event_id", F.col("ts").alias("_t")), "event_id").withColumn("age_s", F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_t")) / 1e6),
                           key="event_id", name="tokens", columns=["token_id", "token_kind", "age_s"], order=["rank"])


def _outlook(points, log):
    """The next five events of other users within 15 minutes."""
    plan = log.select(F.col("ts").alias("sts"), F.col("user_id").alias("other_user"), F.col("event_id").alias("other_id"))
    return joins.upcoming(points.select("event_id", "ts", "user_id"), plan, probe_id="event_id", probe_ts="ts", schedule_ts="sts", exclude=("user_id", "other_user"), columns=["other_id", "other_user"], ahead_s=900, k=5)


def build(spark, d):
    log = events(spark, d)
    points, _ = snapshot.centers(purchases(spark, d), timeline(spark, d).select("user_id", "ts", "event_type"), key="user_id", ts="ts", element="event_type")
    tokens, outlook = _tokens(points, log), _outlook(points, log)
    asset = F.concat_ws(":", "user_id", "event_type")
    states = log.filter("event_type <> 'purchase'").select(asset.alias("asset"), F.col("ts").alias("ets"), (F.col("value") > 50).cast("int").alias("st"))
    kinds = points.select("event_id", "ts", F.explode(F.transform(F.array(*map(F.lit, _KINDS)), lambda k: F.concat_ws(":", F.col("user_id"), k))).alias("asset"))
    nodes = snapshot.element_nodes(kinds, states, key="event_id", element="asset", ts="ts", event_ts="ets", state="st", windows_s=[86400])
    nodes = snapshot.nested(nodes, key="event_id", name="nodes", columns=["asset", "state", "share_86400", "changes_86400"], order=["asset"])
    empty_tokens = F.array().cast("array<struct<token_id: bigint, token_kind: string, age_s: double>>")
    whole = snapshot.assemble(points, [tokens, outlook.select("event_id", "outlook"), nodes], key="event_id", defaults={"tokens": empty_tokens})
    flags = decisions.all_flags(
        f_late_train=decisions.f_late_train(F.round("value").cast("int")), f_priority_compete=decisions.f_priority_compete(F.coalesce(F.size("outlook"), F.lit(0))),
        f_freight_class=decisions.f_freight_class((F.col("user_id") % 10).cast("string")),
    )
    audit = quality.leak_checks(token_ages=F.transform("tokens", lambda t: t["age_s"]), outlook_ids=F.transform("outlook", lambda o: o["other_user"]), focal=F.col("user_id"))
    return whole.withColumn("flags", flags).withColumn("violations", audit)


@query(f"""WITH {TL}, c AS (SELECT p.event_id, p.user_id, p.ts, tl.event_type AS center FROM p ASOF JOIN tl ON p.user_id = tl.user_id AND p.ts >= tl.ts),
  k AS (SELECT c.event_id, x.event_id AS token_id, row_number() OVER (PARTITION BY c.event_id ORDER BY x.ts DESC) AS k FROM c JOIN events x ON x.user_id = c.user_id AND x.ts <= c.ts),
  o AS (SELECT c.event_id, row_number() OVER (PARTITION BY c.event_id ORDER BY x.ts, x.event_id) AS k FROM c JOIN events x ON x.ts > c.ts AND x.ts <= c.ts + INTERVAL 15 MINUTE AND x.user_id <> c.user_id),
  n AS (SELECT c.event_id, g.kind, (SELECT CASE WHEN arg_max(x.value, x.ts) > 50 THEN 1 ELSE 0 END FROM events x WHERE x.user_id = c.user_id AND x.event_type = g.kind AND x.ts <= c.ts) AS st FROM c, (VALUES ('view'), ('click'), ('error'), ('signup')) AS g(kind))
  SELECT c.event_id, c.center, (SELECT string_agg(token_id::VARCHAR, ',' ORDER BY k) FROM k WHERE k.event_id = c.event_id AND k <= 8) AS tokens, (SELECT count(*) FROM o WHERE o.event_id = c.event_id AND k <= 5)::INTEGER AS n_outlook,
    (SELECT sum(coalesce(st, 0)) FROM n WHERE n.event_id = c.event_id)::BIGINT AS n_on, 0::INTEGER AS n_violations FROM c""")
def n1_snapshots(spark, d):
    s = build(spark, d)
    ids = F.transform("tokens", lambda t: t["token_id"].cast("string"))
    on = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + n["state"])
    return s.select("event_id", "center", F.array_join(ids, ",").alias("tokens"), F.coalesce(F.size("outlook"), F.lit(0)).alias("n_outlook"), on.alias("n_on"), F.size("violations").alias("n_violations"))


#: How many parts are elements: an event lies at the part that its number falls on.
_ELEMENTS = 2000


def network_parts(spark, d, windows_s=(86400,), paths=None):
    """points, skipped and the parts of each snapshot over the network of parts: nodes and edges of the subgraph around the
    user's last part, users there, and how users, parts and signals hang together. Parts of odd numbers are signals. paths(points,
    steps): center, elements of the candidate routes, steps being those of the routes over a centre.

    Only edges from centres, and then those inside subgraphs, are made: of the routes over their parts."""
    log = events(spark, d).withColumn("element", F.col("event_id") % _ELEMENTS + 1)
    reports = log.filter("event_type <> 'purchase'")
    places = reports.select("user_id", "ts", "element")
    points, skipped = snapshot.centers(purchases(spark, d), places, key="user_id", ts="ts", element="element")
    points = stored(points, "points")
    centres = stored(points.select(F.col("center").alias("element")).distinct(), "centres")
    steps = stored(route_steps(spark, d, centres), "steps")
    ends = ["element", "next_element"]
    net = stored(graph.both_ways(steps.select(ends)).join(centres, F.col("src") == F.col("element"), "left_semi"), "connects")
    near = graph.hops(net, centres.select(F.col("element").alias("seed"), F.col("element").alias("node")), most=1, edges_stored=True).withColumn("kind", F.when(F.col("node") % 2 == 0, "track").otherwise("signal"))
    around = stored(graph.subgraph(near, center="seed", node="node", node_type="kind", caps={"track": 6, "signal": 3}, most_hops=1), "subgraphs")
    inside = stored(around.select(F.col("node").alias("element")).distinct(), "inside")
    pairs = route_steps(spark, d, inside).select(ends).join(inside, "element", "left_semi").join(inside.withColumnRenamed("element", "next_element"), "next_element", "left_semi")
    edges = snapshot.nested(graph.edges_inside(graph.both_ways(pairs.select(ends)), around, center="seed", node="node"), key="seed", name="edges", columns=["src", "dst"], order=["src", "dst"])
    asked = points.select("event_id", "user_id", "ts", F.col("center").alias("seed")).join(around.select("seed", "node", "kind", "hops"), "seed")
    states = reports.select(F.col("element").alias("node"), F.col("ts").alias("ets"), (F.col("value") > 50).cast("int").alias("st"), F.col("user_id").alias("holder"))
    rows = snapshot.element_nodes(asked, states, key="event_id", element="node", ts="ts", event_ts="ets", state="st", windows_s=windows_s, train="holder")
    if paths is not None:
        rows = snapshot.on_paths(rows, paths(points, steps).withColumnRenamed("center", "seed"), key="seed", element="node")
    rows = stored(rows, "nodes")
    columns = ["node", "hops", "state", *(f"{c}_{w}" for c in ("share", "changes") for w in windows_s), *(["on_path"] if paths is not None else [])]
    tracks = snapshot.nested(rows.filter("kind = 'track'"), key="event_id", name="tracks", columns=columns, order=["hops", "node"])
    berths = rows.filter("kind = 'signal'")
    signals = snapshot.nested(berths, key="event_id", name="signals", columns=[*columns, "occupier"], order=["hops", "node"])
    others = stored(snapshot.other_trains(rows, key="event_id", train="occupier", focal="user_id", cap=3), "others")
    own = points.select("event_id", "ts", F.col("user_id").alias("focal"))
    users = own.withColumn("user_id", F.col("focal")).unionByName(own.join(others, "event_id").withColumn("user_id", F.explode("others")).drop("others"))
    placed = stored(asof.as_of(users, places, keys=["user_id"], probe_ts="ts", event_ts="ts", values={"element": F.col("element")}), "placed")
    trains = snapshot.train_nodes(placed, key="event_id", focal="focal", train="user_id", columns=["element"], cap=4)
    moving = snapshot.dynamic_edges(
        placed.select("event_id", F.col("user_id").alias("train"), "element"), berths.select("event_id", F.col("node").alias("signal"), F.col("occupier").alias("train")),
        rows.select("event_id", "node"), key="event_id", train="train", element="element", signal="signal",
    )
    moving = snapshot.nested(moving, key="event_id", name="dynamic_edges", columns=["kind", "src", "dst"], order=["kind", "src", "dst"])
    parts = [tracks, signals, others, trains, moving, _tokens(points, log), _outlook(points, log).select("event_id", "outlook")]
    return points, skipped, parts, edges


@query(f"""WITH {TL}, {_CONNECTS}, lg AS (SELECT *, event_id % {_ELEMENTS} + 1 AS e FROM events WHERE event_type <> 'purchase'),
  c AS (SELECT p.event_id, p.user_id, p.ts, lg.e AS center FROM p ASOF LEFT JOIN lg ON p.user_id = lg.user_id AND p.ts >= lg.ts),
  hop AS (SELECT seed, node, min(h) AS hops FROM (SELECT center AS seed, center AS node, 0 AS h FROM c WHERE center IS NOT NULL UNION SELECT center, dst, 1 FROM c JOIN con ON src = center) GROUP BY 1, 2),
  nk AS (SELECT *, row_number() OVER (PARTITION BY seed, node % 2 ORDER BY hops, node) AS k FROM hop), n AS (SELECT seed, node FROM nk WHERE k <= CASE WHEN node % 2 = 0 THEN 6 ELSE 3 END),
  ed AS (SELECT a.seed, count(*) AS n FROM n a JOIN con ON con.src = a.node JOIN n b ON b.seed = a.seed AND b.node = con.dst GROUP BY 1),
  q AS (SELECT c.event_id, c.user_id, c.ts, n.node FROM c JOIN n ON n.seed = c.center),
  h AS (SELECT q.*, CASE WHEN lg.value > 50 THEN 1 ELSE 0 END AS st, CASE WHEN lg.value > 50 THEN lg.user_id END AS holder FROM q ASOF LEFT JOIN lg ON q.node = lg.e AND q.ts >= lg.ts),
  hs AS (SELECT event_id, count(*) AS n_nodes, sum(st) AS n_on, list_sort(list_distinct(list(holder) FILTER (holder <> user_id)))[1:3] AS others FROM h GROUP BY 1),
  tr AS (SELECT event_id, ts, user_id AS train FROM c WHERE center IS NOT NULL UNION ALL SELECT c.event_id, c.ts, unnest(others) FROM hs JOIN c ON c.event_id = hs.event_id),
  ps AS (SELECT tr.event_id, tr.train, lg.e FROM tr ASOF LEFT JOIN lg ON tr.train = lg.user_id AND tr.ts >= lg.ts),
  dy AS (SELECT event_id, count(*) AS n FROM (SELECT ps.event_id, 'at' AS kind, train AS src, e AS dst FROM ps JOIN h ON h.event_id = ps.event_id AND h.node = ps.e UNION SELECT event_id, 'holds', holder, node FROM h WHERE node % 2 = 1 AND holder IS NOT NULL) GROUP BY 1),
  tk AS (SELECT c.event_id, least(count(*), 8) AS n FROM c JOIN events x ON x.user_id = c.user_id AND x.ts <= c.ts WHERE center IS NOT NULL GROUP BY 1),
  ol AS (SELECT c.event_id, least(count(*), 5) AS n FROM c JOIN events x ON x.ts > c.ts AND x.ts <= c.ts + INTERVAL 15 MINUTE AND x.user_id <> c.user_id WHERE center IS NOT NULL GROUP BY 1)
  SELECT c.event_id, coalesce(center, -1) AS center, CASE WHEN center IS NULL THEN 'no_center' ELSE '' END AS reason, coalesce(n_nodes, 0)::INTEGER AS n_nodes, coalesce(n_on, 0)::INTEGER AS n_on, coalesce(ed.n, 0)::INTEGER AS n_edges,
    coalesce(array_to_string(others, ','), '') AS others, coalesce(dy.n, 0)::INTEGER AS n_dynamic, coalesce(tk.n, 0)::INTEGER AS n_tokens, coalesce(ol.n, 0)::INTEGER AS n_outlook,
    CASE WHEN center IS NULL THEN 0 ELSE 1 + coalesce(len(others), 0) END::INTEGER AS n_trains
  FROM c LEFT JOIN hs ON hs.event_id = c.event_id LEFT JOIN ed ON ed.seed = center LEFT JOIN dy ON dy.event_id = c.event_id LEFT JOIN tk ON tk.event_id = c.event_id LEFT JOIN ol ON ol.event_id = c.event_id""")
def n1_network_snapshots(spark, d):
    """Snapshots with all their parts, and the purchases skipped for want of a centre with the reason."""
    points, skipped, parts, edges = network_parts(spark, d)
    whole = snapshot.assemble(points, parts, key="event_id").join(edges.withColumnRenamed("seed", "center"), "center", "left").withColumn("reason", F.lit(""))
    rows = whole.unionByName(skipped, allowMissingColumns=True)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    on = F.aggregate(F.concat(*(F.transform(F.coalesce(c, F.array()), lambda n: n["state"]) for c in ("tracks", "signals"))), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "event_id", F.coalesce("center", F.lit(-1)).alias("center"), "reason", (size("tracks") + size("signals")).alias("n_nodes"), on.alias("n_on"),
        size("edges").alias("n_edges"), F.coalesce(F.array_join(F.transform("others", lambda x: x.cast("string")), ","), F.lit("")).alias("others"),
        size("dynamic_edges").alias("n_dynamic"), size("tokens").alias("n_tokens"), size("outlook").alias("n_outlook"), size("trains").alias("n_trains"),
    )


#: The windows of a node's history, in seconds.
_WINDOWS = 21_600, 86_400, 172_800, 345_600, 604_800


def _few_routes(spark, d, points, steps):
    """center, route_id, elements: the first four orders by number whose first part is the centre of a decision, stored. Orders are
    numbered by their first parts alone; only the lines of those four are gathered. steps: those of the routes over a centre."""
    first = Window.partitionBy("center").orderBy("route_id")
    starts = steps.filter("is_first").select(F.col("element").alias("center"), "route_id")
    wanted = starts.join(points.select("center").distinct(), "center", "left_semi").withColumn("_k", F.row_number().over(first)).filter("_k <= 4")
    few = stored(wanted.select("center", "route_id"), "few")
    lines = table(spark, d, "lineitem").withColumn("route_id", F.col("l_orderkey")).join(few.select("route_id").distinct(), "route_id", "left_semi")
    path = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda r: r["l_partkey"])
    return stored(few.join(lines.groupBy("route_id").agg(path.alias("elements")), "route_id").select("center", "route_id", "elements"), "routes")


def _candidates(points, few):
    """event_id, ts, center, route_id, elements: a row for each decision and route from its centre."""
    return points.select("event_id", "ts", "center").join(few, "center")


def _share_sql(w):
    return f"round(sum(share) FILTER (w = {w}), 4) AS share_{w}, (sum(changes) FILTER (w = {w}))::BIGINT AS changes_{w}"


@query(f"""WITH {TL}, {_CONNECTS}, lg AS (SELECT *, event_id % {_ELEMENTS} + 1 AS e, CASE WHEN value > 50 THEN 1 ELSE 0 END AS st FROM events WHERE event_type <> 'purchase'),
  c AS (SELECT p.event_id, p.user_id, p.ts, p.value, lg.e AS center FROM p ASOF LEFT JOIN lg ON p.user_id = lg.user_id AND p.ts >= lg.ts),
  cc AS (SELECT * FROM c WHERE center IS NOT NULL),
  hop AS (SELECT seed, node, min(h) AS hops FROM (SELECT center AS seed, center AS node, 0 AS h FROM cc UNION SELECT center, dst, 1 FROM cc JOIN con ON src = center) GROUP BY 1, 2),
  nk AS (SELECT *, row_number() OVER (PARTITION BY seed, node % 2 ORDER BY hops, node) AS k FROM hop), n AS (SELECT seed, node FROM nk WHERE k <= CASE WHEN node % 2 = 0 THEN 6 ELSE 3 END),
  ed AS (SELECT a.seed, count(*) AS n FROM n a JOIN con ON con.src = a.node JOIN n b ON b.seed = a.seed AND b.node = con.dst GROUP BY 1),
  q AS (SELECT cc.event_id, cc.user_id, cc.ts, n.node FROM cc JOIN n ON n.seed = cc.center),
  pre AS (SELECT *, lag(st, 1, 0) OVER w AS was, lag(ts) OVER w AS pts FROM lg WINDOW w AS (PARTITION BY e ORDER BY ts)),
  run AS (SELECT e, ts, st, user_id, sum(CASE WHEN was = 1 THEN epoch_us(ts) - epoch_us(pts) ELSE 0 END) OVER w AS in1, sum(CASE WHEN st <> was THEN 1 ELSE 0 END) OVER w AS ch FROM pre WINDOW w AS (PARTITION BY e ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT q.*, coalesce(run.st, 0) AS st, CASE WHEN run.st = 1 THEN run.user_id END AS holder, coalesce(in1 + CASE WHEN st = 1 THEN epoch_us(q.ts) - epoch_us(run.ts) ELSE 0 END, 0) AS i0, coalesce(ch, 0) AS c0 FROM q ASOF LEFT JOIN run ON q.node = run.e AND q.ts >= run.ts),
  back AS (SELECT event_id, node, w, ts - to_seconds(w) AS t FROM q, (VALUES {", ".join(f"({w})" for w in _WINDOWS)}) AS g(w)),
  b AS (SELECT back.event_id, back.node, back.w, coalesce(in1 + CASE WHEN st = 1 THEN epoch_us(back.t) - epoch_us(run.ts) ELSE 0 END, 0) AS i1, coalesce(ch, 0) AS c1 FROM back ASOF LEFT JOIN run ON back.node = run.e AND back.t >= run.ts),
  ws AS (SELECT b.event_id, b.w, (i0 - i1) / 1e6 / b.w AS share, c0 - c1 AS changes FROM b JOIN h USING (event_id, node)),
  wn AS (SELECT event_id, {", ".join(_share_sql(w) for w in _WINDOWS)} FROM ws GROUP BY 1),
  hs AS (SELECT event_id, count(*) AS n_nodes, sum(st) AS n_on, list_sort(list_distinct(list(holder) FILTER (holder <> user_id)))[1:3] AS others FROM h GROUP BY 1),
  tr AS (SELECT event_id, ts, user_id AS focal, user_id AS train FROM cc UNION ALL SELECT cc.event_id, cc.ts, cc.user_id, unnest(others) FROM hs JOIN cc ON cc.event_id = hs.event_id),
  ps AS (SELECT tr.event_id, tr.train, lg.e FROM tr ASOF LEFT JOIN lg ON tr.train = lg.user_id AND tr.ts >= lg.ts),
  dy AS (SELECT event_id, count(*) AS n FROM (SELECT ps.event_id, 'at' AS kind, train AS src, e AS dst FROM ps JOIN h ON h.event_id = ps.event_id AND h.node = ps.e UNION SELECT event_id, 'holds', holder, node FROM h WHERE node % 2 = 1 AND holder IS NOT NULL) GROUP BY 1),
  cand AS (SELECT cc.event_id, cc.user_id, cc.ts, r.route_id, r.elements FROM cc JOIN (SELECT *, row_number() OVER (PARTITION BY elements[1] ORDER BY route_id) AS k FROM routes) r ON r.elements[1] = cc.center AND r.k <= 4),
  pn AS (SELECT h.event_id, count(*) AS n FROM h JOIN (SELECT DISTINCT event_id, unnest(elements) AS node FROM cand) USING (event_id, node) GROUP BY 1),
  ce AS (SELECT event_id, route_id, user_id, ts, unnest(elements) AS e, unnest(range(len(elements))) AS k, len(elements) AS len FROM cand),
  cs AS (SELECT ce.*, coalesce(run.st, 0) AS st, run.user_id AS holder FROM ce ASOF LEFT JOIN run ON ce.e = run.e AND ce.ts >= run.ts),
  rn AS (SELECT event_id, count(DISTINCT route_id) AS n_routes, count(*) FILTER (st = 1) AS n_occupied, count(*) FILTER (st = 1 AND k = len - 1) AS n_locked,
      bool_or(k = 0 AND st = 1 AND holder <> user_id) AS f_advance, bool_or(k = len - 1 AND st = 1 AND route_id % 5 = 0) AS f_call_on FROM cs GROUP BY 1),
  tk AS (SELECT cc.event_id, least(count(*), 8) AS n, count(*) FILTER (x.ts > cc.ts) AS ahead FROM cc JOIN events x ON x.user_id = cc.user_id AND x.ts <= cc.ts GROUP BY 1),
  ol AS (SELECT cc.event_id, least(count(*), 5) AS n FROM cc JOIN events x ON x.ts > cc.ts AND x.ts <= cc.ts + INTERVAL 15 MINUTE AND x.user_id <> cc.user_id GROUP BY 1),
  fo AS (SELECT event_id, count(*) FILTER (train = focal) AS n_focal, count(*) AS n FROM tr GROUP BY 1)
  SELECT c.event_id, coalesce(center, -1) AS center, CASE WHEN center IS NULL THEN 'no_center' ELSE '' END AS reason, coalesce(n_nodes, 0)::INTEGER AS n_nodes, coalesce(n_on, 0)::INTEGER AS n_on, coalesce(pn.n, 0)::INTEGER AS n_on_path,
    coalesce(ed.n, 0)::INTEGER AS n_edges, coalesce(array_to_string(others, ','), '') AS others, coalesce(dy.n, 0)::INTEGER AS n_dynamic, coalesce(tk.n, 0)::INTEGER AS n_tokens, coalesce(ol.n, 0)::INTEGER AS n_outlook, coalesce(fo.n, 0)::INTEGER AS n_trains,
    {", ".join(f"coalesce(share_{w}, 0) AS share_{w}, coalesce(changes_{w}, 0) AS changes_{w}" for w in _WINDOWS)},
    coalesce(n_routes, 0)::INTEGER AS n_routes, coalesce(n_locked, 0)::INTEGER AS n_locked, coalesce(n_occupied, 0)::INTEGER AS n_occupied,
    coalesce(f_advance, false) AS f_advance, coalesce(f_call_on, false) AS f_call_on, coalesce(len(others), 0) >= 1 AS f_priority_compete, CASE WHEN round(value) >= 60 AND center IS NOT NULL THEN round(value)::INTEGER ELSE 0 END AS f_late_train,
    CASE WHEN center IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN tk.ahead > 0 THEN 'temporal_causality' END, CASE WHEN n_focal <> 1 THEN 'one_focal_train' END], lambda v: v IS NOT NULL), ',') END AS violations
  FROM c LEFT JOIN hs ON hs.event_id = c.event_id LEFT JOIN wn ON wn.event_id = c.event_id LEFT JOIN pn ON pn.event_id = c.event_id LEFT JOIN ed ON ed.seed = center LEFT JOIN dy ON dy.event_id = c.event_id
    LEFT JOIN rn ON rn.event_id = c.event_id LEFT JOIN tk ON tk.event_id = c.event_id LEFT JOIN ol ON ol.event_id = c.event_id LEFT JOIN fo ON fo.event_id = c.event_id""")
def n1_whole_snapshots(spark, d):
    """Snapshots in one row set: subgraph nodes with five windows and path flag, edges, trains, dynamic edges, tokens, outlook, route
    nodes, flags and the seven checks; skipped purchases with the reason."""
    few = {}
    points, skipped, parts, edges = network_parts(spark, d, _WINDOWS, lambda at, steps: few.setdefault("routes", _few_routes(spark, d, at, steps)))
    options = stored(_candidates(points, few["routes"]).join(points.select("event_id", F.col("user_id").alias("focal")), "event_id"), "options")
    log = events(spark, d).filter("event_type <> 'purchase'").withColumn("element", F.col("event_id") % _ELEMENTS + 1)
    states = log.select("element", F.col("ts").alias("ets"), (F.col("value") > 50).cast("int").alias("st"), F.col("user_id").alias("train"))
    last = options.withColumn("lock", F.element_at("elements", -1))
    locks = last.select("route_id", F.col("lock").alias("element")).distinct().join(states, "element").select("route_id", "ets", "st")
    nodes = snapshot.route_nodes(last, locks, states, key="event_id", route="route_id", element="element", ts="ts", event_ts="ets", state="st")
    route_part = snapshot.nested(nodes, key="event_id", name="routes", columns=["route_id", "locked", "n_occupied"], order=["route_id"])
    asked = last.select("event_id", "ts", "route_id", F.col("center").alias("first"), F.col("lock").alias("platform"), F.when(F.col("route_id") % 5 == 0, "C").otherwise("M").alias("cls"))
    inputs = snapshot.flag_inputs(asked, states, key="event_id", route="route_id", first="first", platform="platform", cls="cls", ts="ts", event_ts="ets", state="st", train="train", element="element")
    whole = snapshot.assemble(points, [*parts, route_part, inputs], key="event_id").join(edges.withColumnRenamed("seed", "center"), "center", "left").withColumn("reason", F.lit(""))
    whole = whole.withColumns({
        "flags": decisions.all_flags(
            f_advance=F.coalesce(decisions.f_advance(F.col("occupiers"), F.col("user_id")), F.lit(False)), f_call_on=F.coalesce(decisions.f_call_on(F.col("options")), F.lit(False)),
            f_priority_compete=decisions.f_priority_compete(F.coalesce(F.size("others"), F.lit(0))), f_late_train=decisions.f_late_train(F.round("value").cast("int")),
        ),
        "middle": F.struct(F.lit("track").alias("type"), F.col("center").alias("id")),
        "plan": F.transform("outlook", lambda o: F.struct((o["other_user"] % 7 + 1).alias("planned_platform"))),
    })
    audit = quality.snapshot_violations(
        whole, center="middle", current=F.col("center"), nodes={"track": "tracks", "signal": "signals", "route": "routes"}, tokens="tokens", age="age_s", outlook="plan", platform="planned_platform",
        flags_source=F.lit("both"), trains="trains", banned=["chosen_route_id", "label", "r_total"],
    )
    rows = whole.withColumn("violations", audit).unionByName(skipped, allowMissingColumns=True)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    sums = {"state": "int", "on_path": "int", **{f"{x}_{w}": kind for x, kind in (("share", "double"), ("changes", "bigint")) for w in _WINDOWS}}
    zero = F.struct(*(F.lit(0).cast(kind).alias(c) for c, kind in sums.items()))
    add = lambda a, n: F.struct(*((a[c] + n[c].cast(kind)).alias(c) for c, kind in sums.items()))
    rows = rows.withColumn("_tracks", F.aggregate(F.coalesce("tracks", F.array()), zero, add)).withColumn("_sums", F.aggregate(F.coalesce("signals", F.array()), F.col("_tracks"), add))
    total = lambda c: F.col("_sums")[c]
    windows_ = [c for w in _WINDOWS for c in (F.round(total(f"share_{w}"), 4).alias(f"share_{w}"), total(f"changes_{w}").alias(f"changes_{w}"))]
    on_route = lambda f: F.aggregate(F.transform(F.coalesce("routes", F.array()), lambda r: r[f].cast("int")), F.lit(0), lambda a, x: a + x)
    flag = lambda f, default: F.coalesce(F.col("flags")[f], F.lit(default)).alias(f)
    return rows.select(
        "event_id", F.coalesce("center", F.lit(-1)).alias("center"), "reason", (size("tracks") + size("signals")).alias("n_nodes"), total("state").alias("n_on"),
        total("on_path").alias("n_on_path"), size("edges").alias("n_edges"), F.coalesce(F.array_join(F.transform("others", lambda x: x.cast("string")), ","), F.lit("")).alias("others"),
        size("dynamic_edges").alias("n_dynamic"), size("tokens").alias("n_tokens"), size("outlook").alias("n_outlook"), size("trains").alias("n_trains"), *windows_,
        size("routes").alias("n_routes"), on_route("locked").alias("n_locked"), on_route("n_occupied").alias("n_occupied"), flag("f_advance", False), flag("f_call_on", False), flag("f_priority_compete", False), flag("f_late_train", 0),
        F.coalesce(F.array_join("violations", ","), F.lit("")).alias("violations"),
    )
