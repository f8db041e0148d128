"""Time-weighted state windows, sessions, throttling, returns and order checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import stored
from .asof import as_of, previous_in_key, running_in_key, seconds, slots_of_key, time_slot
from .ranks import numbered, quantiles_by
from .scan import bin_steps, discounted, entries, keep_apart


def state_prefix(events: DataFrame, *, key: str, ts: str, state: str, tie: str | None = None, carry: dict[str, str] | None = None, bin_s: int | None = None) -> DataFrame:
    """Per event: state after it, seconds in state 1 up to it and changes up to it, and its number in its key. The state before is 0.
    carry: names to columns of the event that are kept."""
    ties = [tie] if tie else []
    kept = [F.col(c).alias(n) for n, c in (carry or {}).items()]
    rows = events.select(key, F.col(ts).alias("_at"), F.col(state).alias("_state"), *ties, *kept).withColumn("_ts", F.col("_at"))
    rows = previous_in_key(rows, keys=[key], ts="_at", tie=ties, columns={"_was": "_state", "_before": "_ts"}, bin_s=bin_s)
    was = F.coalesce("_was", F.lit(0))
    dwell = F.when(was == 1, seconds(F.col("_at"), F.col("_before"))).otherwise(0.0)
    steps = rows.withColumns({"_dwell": dwell, "_step": (F.col("_state") != was).cast("long"), "_one": F.lit(1).cast("long")}).select(key, "_at", "_state", *ties, *(carry or {}), "_dwell", "_step", "_one")
    return running_in_key(steps, keys=[key], ts="_at", tie=ties, sums={"_in_1": "_dwell", "_changes": "_step", "_nth": "_one"}, bin_s=bin_s).drop("_dwell", "_step", "_one")


def window_stats(
    probes: DataFrame, events: DataFrame, *, key: str, probe_id: str, probe_ts: str, event_ts: str, state: str,
    windows_s: Sequence[int], tie: str | None = None, now: dict[str, str] | None = None, bin_s: int | None = None,
) -> DataFrame:
    """For each window W: share_W, the fraction of [t-W, t] in state 1, and changes_W, the changes in (t-W, t].

    Running sums of dwell and changes are made once. A window's far end is a frame that ends W before the probe: all frames only
    grow along a key, so the windows share one shuffle and one sort, and cost no rows. now: names to columns of the last event at
    the probe, which that sort finds too; probe columns of these names are replaced. bin_s: for keys that hold a large part of all
    rows; every end of every window is then a probe of an as-of join in bins. Every probe row gives one row: probe_id may repeat, or
    name several columns. A probe without a time has no share and no changes.
    """
    now = now or {}
    probes = probes.drop(*now)
    prefix = state_prefix(events, key=key, ts=event_ts, state=state, tie=tie, carry={f"_c_{n}": c for n, c in now.items()}, bin_s=bin_s)
    if bin_s is not None:
        return _window_stats_in_bins(probes, prefix, key=key, probe_ts=probe_ts, windows_s=windows_s, tie=tie, now=now, bin_s=bin_s)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last = F.struct("_nth", "_at", F.col("_state").alias("_st"), F.col("_in_1").alias("_in"), F.col("_changes").alias("_ch"), *(f"_c_{n}" for n in now))
    asked = probes.select(key, micros(probe_ts).alias("_t"), F.struct(*probes.columns).alias("_row"))
    both = asked.unionByName(prefix.select(key, micros("_at").alias("_t"), last.alias("_found")), allowMissingColumns=True)
    by = W.partitionBy(key).orderBy("_t")
    ends = {w: F.max("_found").over(by.rangeBetween(W.unboundedPreceding, -int(w * 1_000_000))) for w in (0, *windows_s)}
    hit = both.withColumns({f"_hit_{w}": e for w, e in ends.items()}).filter("_row IS NOT NULL").drop("_found")
    t, timed = F.col("_row")[probe_ts], F.col("_t").isNotNull()
    stats = []
    for w in ends:
        found = F.col(f"_hit_{w}")
        stats.append((f"_in_{w}", F.when(timed, _inside(found, t - F.make_dt_interval(secs=F.lit(int(w)))))))
        stats.append((f"_ch_{w}", F.when(timed, F.coalesce(found["_ch"], F.lit(0)))))
    told = hit.withColumns(dict(stats))
    return told.select(
        "_row.*", *(F.col("_hit_0")[f"_c_{n}"].alias(n) for n in now),
        *(((F.col("_in_0") - F.col(f"_in_{w}")) / w).alias(f"share_{w}") for w in windows_s), *((F.col("_ch_0") - F.col(f"_ch_{w}")).alias(f"changes_{w}") for w in windows_s),
    )


def _inside(found: Column, end: Column) -> Column:
    """Seconds in state 1 up to end, from the last event there (its state, time and running sum); 0 without one."""
    held = F.when(found["_st"] == 1, seconds(end, found["_at"])).otherwise(0.0)
    return F.coalesce(found["_in"] + held, F.lit(0.0))


def _window_stats_in_bins(probes: DataFrame, prefix: DataFrame, *, key: str, probe_ts: str, windows_s: Sequence[int], tie: str | None, now: dict[str, str], bin_s: int) -> DataFrame:
    """The same with the ends of the windows as probes, dealt by key and bin of time."""
    numbered_ = stored(probes.withColumn("_no", F.monotonically_increasing_id()), "probes")
    ends = F.array(F.lit(0), *(F.lit(int(w)) for w in windows_s))
    back = F.col(probe_ts) - F.make_dt_interval(secs=F.col("_back"))
    places = numbered_.select(key, "_no", F.struct(*probes.columns).alias("_row"), probe_ts, F.explode(ends).alias("_back"))
    hit = as_of(
        places.withColumn("_end", back), prefix, keys=[key], probe_ts="_end", event_ts="_at", tie=tie, bin_s=bin_s,
        values={"_in": F.col("_in_1"), "_ch": F.col("_changes"), "_st": F.col("_state"), "_when": F.col("_at"), **{f"_c_{n}": F.col(f"_c_{n}") for n in now}},
    )
    held = F.when(F.col("_st") == 1, seconds(F.col("_end"), F.col("_when"))).otherwise(0.0)
    hit = hit.withColumn("_in", F.coalesce(F.col("_in") + held, F.lit(0.0))).withColumn("_ch", F.coalesce("_ch", F.lit(0)))
    hit = hit.withColumns({c: F.when(F.col("_end").isNotNull(), F.col(c)) for c in ("_in", "_ch")})
    at = lambda c, w: F.max(F.when(F.col("_back") == w, F.col(c)))
    stats = [at(f"_c_{n}", 0).alias(n) for n in now]
    stats += [((at("_in", 0) - at("_in", w)) / w).alias(f"share_{w}") for w in windows_s]
    stats += [(at("_ch", 0) - at("_ch", w)).alias(f"changes_{w}") for w in windows_s]
    return hit.groupBy("_no").agg(F.first("_row").alias("_row"), *stats).select(
        "_row.*", *now, *(f"share_{w}" for w in windows_s), *(f"changes_{w}" for w in windows_s)
    )


def sessions(
    events: DataFrame, *, keys: Sequence[str], ts: str, gap_s: float, tie: Sequence[str] = (),
    boundaries: Sequence[str] = (), name="session_no", bin_s: int | None = None,
) -> DataFrame:
    """Adds a running session number per key: a gap over gap_s starts a session, and so does crossing a boundary time.

    With bin_s, work is dealt by key and bin of time, for keys that hold a large part of all rows: the end of the bin before
    and the sessions begun in earlier bins come from a table with a row per key and bin.
    """
    if bin_s is None:
        order = W.partitionBy(*keys).orderBy(ts, *tie)
        marked = events.withColumn("_new", _starts(F.col(ts), F.lag(ts).over(order), gap_s, boundaries))
        return marked.withColumn(name, F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    rows = events.withColumn("_slot", time_slot(keys, F.col(ts), bin_s))
    order, slots = W.partitionBy("_slot").orderBy(ts, *tie), slots_of_key(keys)
    ends = rows.groupBy("_slot").agg(F.max(ts).alias("_end")).select("_slot", F.lag("_end").over(slots).alias("_before"))
    last = F.coalesce(F.lag(ts).over(order), F.col("_before"))
    marked = rows.join(ends, "_slot").withColumn("_new", _starts(F.col(ts), last, gap_s, boundaries)).drop("_before")
    begun = F.coalesce(F.sum("_sum").over(slots.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = marked.groupBy("_slot").agg(F.sum("_new").alias("_sum")).select("_slot", begun.alias("_begun"))
    own = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return marked.join(sums, "_slot").withColumn(name, own + F.col("_begun")).select(*events.columns, name)


def _starts(t: Column, last: Column, gap_s: float, boundaries: Sequence[str]) -> Column:
    """1 where a session starts after the row at `last`, null last counting as none."""
    new = seconds(t, last) > gap_s
    for b in boundaries:
        cut = F.lit(b).cast("timestamp_ntz")
        new = new | ((last < cut) & (t >= cut))
    return F.coalesce(new, F.lit(False)).cast("int")


def positions(df: DataFrame, *, session: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds position (from 0) and is_last within each session; the last row by position, also among equal times."""
    by = W.partitionBy(*session)
    return df.withColumn("position", F.row_number().over(by.orderBy(*order)) - 1).withColumn(
        "is_last", F.col("position") == F.count("*").over(by) - 1
    )


def session_index(df: DataFrame, *, session: Sequence[str], start: str) -> DataFrame:
    """session..., session_idx: a dense number from 0 over all sessions by (first time, session)."""
    firsts = df.groupBy(*session).agg(F.min(start).alias("_first"))
    return numbered(firsts, ["_first", *session], "_no").select(*session, (F.col("_no") - 1).alias("session_idx"))


def gap_buckets(events: DataFrame, *, keys, ts, edges_s: Sequence[int]) -> DataFrame:
    """Gaps between consecutive events of a key by right-closed buckets: bucket, n."""
    gap = seconds(F.col(ts), F.lag(ts).over(W.partitionBy(*keys).orderBy(ts)))
    bucket = F.when(F.col("gap") <= edges_s[0], 0)
    for k, edge in enumerate(edges_s[1:], 1):
        bucket = bucket.when(F.col("gap") <= edge, k)
    rows = events.select(gap.alias("gap")).filter("gap IS NOT NULL")
    return rows.groupBy(bucket.otherwise(len(edges_s)).alias("bucket")).agg(F.count("*").alias("n"))


def gap_forest(
    events: DataFrame, *, keys: Sequence[str], ts: str, gaps_s: Sequence[int], boundaries: Sequence[str] = (), bin_s: int | None = None
) -> DataFrame:
    """gap_s, keys..., first, last, gap_before, n_rows, n_leaking: the sessions of every gap, as levels of a forest.

    Only the sessions of the smallest gap are made from the log, in one sort; those of each greater gap are unions of the level
    below, read from its stored table. gap_before: seconds since the key's session before, null for the first. n_leaking: rows on
    another side of a boundary time than the session's first row. Rows without a time are in no session.
    """
    gaps = sorted(gaps_s)
    cuts = [F.lit(b).cast("timestamp_ntz") for b in boundaries]
    rows = events.filter(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("first"))
    rows = rows.withColumn("last", F.col("first"))
    rows = previous_in_key(rows, keys=keys, ts="first", columns={"_end": "last"}, bin_s=bin_s).withColumn("gap_before", seconds(F.col("first"), F.col("_end")))
    side = sum(((F.col("first") >= c).cast("int") for c in cuts), F.lit(0))
    level = rows.withColumns({f"_n{k}": (side == k).cast("long") for k in range(len(cuts) + 1)}).drop("_end")
    sides = [f"_n{k}" for k in range(len(cuts) + 1)]
    out = None
    for gap in gaps:
        new = F.coalesce(F.col("gap_before") > gap, F.lit(True))
        marked = level.withColumns({"_new": new.cast("long"), "_old": (~new).cast("int")})
        told = running_in_key(marked, keys=keys, ts="first", tie=["_old"], sums={"_no": "_new"}, bin_s=bin_s)  # of equal times the one that cuts comes first
        head = F.min_by(F.struct("gap_before"), F.struct("first", "_old"))["gap_before"]
        joined = told.groupBy(*keys, "_no").agg(F.min("first").alias("first"), F.max("last").alias("last"), head.alias("gap_before"), *(F.sum(c).alias(c) for c in sides))
        level = stored(joined.drop("_no"), "gap-level")
        whole = sum((F.col(c) for c in sides), F.lit(0))
        own = F.get(F.array(*sides), side)
        part = level.select(F.lit(gap).alias("gap_s"), *keys, "first", "last", "gap_before", whole.alias("n_rows"), (whole - own).alias("n_leaking"))
        out = part if out is None else out.unionByName(part)
    return out


def gap_sweep(forest: DataFrame) -> DataFrame:
    """For each gap of a gap_forest: sessions, median, 99th percentile and greatest of their spans in seconds, the shares of sessions
    and of rows whose session spans over a day, transitions that the gap cuts, and rows that leak over a boundary."""
    spans = forest.withColumn("span", seconds(F.col("last"), F.col("first")))
    long_ = F.col("span") > 86400
    sums = [
        F.count("*").alias("n_sessions"), F.max("span").alias("max_span_s"), F.avg(long_.cast("double")).alias("share_over_day"),
        (F.sum(F.when(long_, F.col("n_rows")).otherwise(0)) / F.sum("n_rows")).alias("share_rows_over_day"),
        F.count("gap_before").alias("n_cut"), F.sum("n_leaking").alias("n_leaking"),
    ]
    return quantiles_by(spans, ["gap_s"], {"median_span_s": ("span", 0.5), "p99_span_s": ("span", 0.99)}, sums)


def throttle(events: DataFrame, *, keys: Sequence[str], ts: str, min_gap_s: int, tie: Sequence[str] = (), bin_gaps: int = 64) -> DataFrame:
    """Keeps an event if at least min_gap_s passed since the last kept one of its key. Rows without a time are not kept; of rows
    with one time the first by tie counts.

    A key's rows are dealt in bins of bin_gaps gaps. A bin turns the time last kept before it into the time last kept in it; that
    step function is made for each bin by itself, the functions of a key's bins are followed in order, and each bin is then thinned
    from its own entry. No task has more rows of a key than those of a bin.
    """
    gap, timed = int(min_gap_s * 1_000_000), events.filter(F.col(ts).isNotNull())
    if gap <= 0:
        return timed
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.floor(at / (gap * bin_gaps)).alias("bin"))
    rows = timed.withColumns({"_t": at, "_slot": slot})
    steps = bin_steps(rows, slot="_slot", time="_t", width=gap * bin_gaps, gap=gap)
    entered = rows.join(entries(steps, slot="_slot", gap=gap), "_slot")
    return keep_apart(entered, keys=["_slot"], time="_t", order=["_t", *tie], gap=gap, after="after").select(*events.columns)


def transitions(df: DataFrame, *, session: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds next_<column> and done: the next row of the session; on the last row itself, with done."""
    by = W.partitionBy(*session).orderBy(*order)
    out = df.withColumn("done", F.lead(F.lit(1)).over(by).isNull())
    for c in columns:
        out = out.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(by), F.col(c)))
    return out


def discounted_return(df: DataFrame, *, session: Sequence[str], position: str, reward: str, gamma: float) -> DataFrame:
    """session..., episode_return: the sum of gamma^position * reward."""
    return df.groupBy(*session).agg(F.sum(F.pow(F.lit(gamma), F.col(position)) * F.col(reward)).alias("episode_return"))


def return_to_go(df: DataFrame, *, session: Sequence[str], position: str, reward: str, gamma: float, bin_rows: int = 4096) -> DataFrame:
    """session..., position, to_go: reward plus gamma times the next row's return, from the session's end back, in bins of positions."""
    return discounted(df, keys=session, position=position, value=reward, gamma=gamma, bin_rows=bin_rows)


def order_faults(df: DataFrame, *, session: Sequence[str], position: str, ts: str) -> DataFrame:
    """One row: sessions that do not start at 0, positions that do not follow, times that go back, repeated keys."""
    by = W.partitionBy(*session).orderBy(position, ts)
    rows = df.select(
        (F.lag(position).over(by).isNull() & (F.col(position) != 0)).alias("bad_start"),
        (F.col(position) - F.lag(position).over(by) != 1).alias("bad_step"),
        (F.col(ts) < F.lag(ts).over(by)).alias("bad_time"),
        (F.col(position) == F.lag(position).over(by)).alias("repeated"),
    )
    return rows.agg(*(F.count_if(F.col(c)).alias(c) for c in rows.columns))


def prior_values(df: DataFrame, *, session: Sequence[str], order: Sequence[str], value: str, most: int) -> DataFrame:
    """Adds prior, the array of the session's last `most` earlier values in order."""
    by = W.partitionBy(*session).orderBy(*order).rowsBetween(-most, -1)
    return df.withColumn("prior", F.collect_list(value).over(by))


def value_lists(df: DataFrame, *, session: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """session..., values: each session's values in order, once; with n_prior of prior_counts, slice(values, 1, n_prior) is what
    came before a row, so the whole history takes a value a row and not a list a row. A null value keeps its place."""
    row = F.struct(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(value).alias("_v"))
    return df.groupBy(*session).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_v"]).alias("values"))


def prior_counts(df: DataFrame, *, session: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds n_prior: the rows of the session before this one. order must be total."""
    return df.withColumn("n_prior", F.row_number().over(W.partitionBy(*session).orderBy(*order)) - 1)


def neighbours_within(events: DataFrame, *, ts: str, span_s: int, keys: Sequence[str] = ()) -> DataFrame:
    """Adds n_near: other events within span_s before or after, 0 for rows without a time.

    Work is dealt in bins as wide as the span, and each row goes to its own bin and the one on either side, which hold all it
    can be near to; so no window spans more than three spans, whatever the span. Rows up to the far end less rows before the near
    one: both counts only grow along a bin, while a frame with two moving ends would be counted anew for each row."""
    reach = int(span_s * 1_000_000)
    width = max(reach, 1)
    rows = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.floor(F.col("_t") / width)
    dealt = rows.filter("_t IS NOT NULL").withColumn("_bin", F.explode(F.sequence(own - 1, own + 1)))
    by = W.partitionBy("_bin", *keys).orderBy("_t")
    upto = lambda end: F.count("*").over(by.rangeBetween(W.unboundedPreceding, end))
    counted = dealt.withColumn("n_near", upto(reach) - upto(-reach - 1) - 1).filter(F.col("_bin") == own)
    return counted.unionByName(rows.filter("_t IS NULL").withColumn("n_near", F.lit(0).cast("long")), allowMissingColumns=True).drop("_t", "_bin")


def burst_class(n_near: Column) -> Column:
    """Fixed names: alone, small_burst (1 or 2 others near), burst_3_to_9, burst_10plus."""
    return F.when(n_near == 0, "alone").when(n_near < 3, "small_burst").when(n_near < 10, "burst_3_to_9").otherwise("burst_10plus")
