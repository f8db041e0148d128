"""Typed readers and writers of event logs, dimensions and nested snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..functions.shared import stored

EVENTS = (
    "time timestamp_ntz, type string, id string, state tinyint, change string, trainid_filled string, "
    "from_berth string, to_berth string, descr string, timegap float, Panel_Request string"
)
ROUTES = "id string, route string, start string, end string, track string"
ASSETS = "key int, value string"


def read_events(spark: SparkSession, path: str, schema: T.StructType | str = EVENTS, columns: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """CSV with declared types; a subset of columns and a row limit if asked."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.select(*columns) if columns else df
    return df if rows is None else df.limit(rows)


def cache_as_parquet(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes zstd Parquet unless it is there already (or force), and reads it."""
    df.write.option("compression", "zstd").mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def load_diagnostics(movements: DataFrame, *, id_col: str, platform_col: str, id_length=10) -> DataFrame:
    """One row: rows, share of ids of the usual length, share with a headcode, distinct platforms."""
    code = parse.headcode_of_long_id(F.col(id_col))
    return movements.agg(
        F.count("*").alias("n_rows"),
        F.avg((F.char_length(id_col) == id_length).cast("double")).alias("share_usual_length"),
        F.avg(F.coalesce(code.rlike(parse.HEADCODE), F.lit(False)).cast("double")).alias("share_headcode"),
        F.count_distinct(platform_col).alias("n_platforms"),
    )


def list_literal(c: Column, item=r"'([A-Z0-9]+)'") -> Column:
    """array<string> from the text of a list of quoted names."""
    return F.regexp_extract_all(c, F.lit(item), F.lit(1))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(ROUTES).option("header", True).option("escape", '"').csv(path)
    return df.withColumn("track", list_literal(F.col("track")))


def read_dimension(spark: SparkSession, path: str, schema, required: Sequence[str], defaults: dict) -> DataFrame:
    """CSV with # comments; rows lacking a required value go, other gaps get defaults."""
    df = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    return df.dropna(subset=list(required)).fillna(defaults)


def asset_index(df: DataFrame, *, key="key", name="value") -> DataFrame:
    """Asset dictionary: byte order marks stripped, keys counted from 1, type by name."""
    clean = F.trim(F.regexp_replace(name, "﻿", ""))
    return df.select((F.col(key) + 1).alias("idx"), clean.alias("name"), parse.asset_type(clean).alias("asset_type"))


def registry_assets(lines: DataFrame, *, column="value", first="SRTLP") -> DataFrame:
    """kind, name: the distinct last words of registry lines that begin with a known letter."""
    name = F.element_at(F.split(F.trim(column), r"\s+"), -1)
    return lines.select(name.alias("name")).filter(F.substring("name", 1, 1).isin(*first)).distinct().select(
        F.substring("name", 1, 1).alias("kind"), "name"
    )


#: Fixed formats of registry names: signals, routes and train-ready latches.
SIGNAL_NAME = r"^S(DC|DW|DY|EC|TD)([0-9]+\w*)$"
ROUTE_NAME = r"^R(DW|TD|DC|EC|DY)([0-9]+\w*)([A-Z]+)(?:-([0-9]+))?\((M|C|S|W|PS)\)$"
LATCH_NAME = r"^LPLAT([0-9]+)([AB])TRS\(([NS])\)$"


def registry_tables(assets: DataFrame) -> dict[str, DataFrame]:
    """signal, route, track and trts: tables of the registry's assets (kind, name), by the formats of their names.

    signal: full_name, prefix, signal_id; route: route_id, prefix, signal_no, letter, sub, cls; track: track_id, naming_pattern
    (alpha if a letter follows the first, else numeric); trts: trts_id, platform_id, sub_section, direction. Names of another
    format are left out, but for tracks, which have none. A route's letter is the last one before the sub or class; sub is null
    where there is none.
    """
    part = lambda pattern, k: F.regexp_extract("name", pattern, k)
    of = lambda kind, pattern: assets.filter((F.col("kind") == kind) & F.col("name").rlike(pattern))
    letters = F.substring("name", 2, F.lit(1 << 20)).rlike("\\p{L}")
    return {
        "signal": of("S", SIGNAL_NAME).select(F.col("name").alias("full_name"), part(SIGNAL_NAME, 1).alias("prefix"), part(SIGNAL_NAME, 2).alias("signal_id")),
        "route": of("R", ROUTE_NAME).select(
            F.col("name").alias("route_id"), part(ROUTE_NAME, 1).alias("prefix"), part(ROUTE_NAME, 2).alias("signal_no"), part(ROUTE_NAME, 3).alias("letter"),
            F.nullif(part(ROUTE_NAME, 4), F.lit("")).alias("sub"), part(ROUTE_NAME, 5).alias("cls"),
        ),
        "track": assets.filter("kind = 'T'").select(F.col("name").alias("track_id"), F.when(letters, "alpha").otherwise("numeric").alias("naming_pattern")),
        "trts": of("L", LATCH_NAME).select(
            F.col("name").alias("trts_id"), part(LATCH_NAME, 1).cast("int").alias("platform_id"), part(LATCH_NAME, 2).alias("sub_section"), part(LATCH_NAME, 3).alias("direction")
        ),
    }


def physical_features(df: DataFrame, *, id_col: str, list_col: str, required: Sequence[str], prefix="R") -> DataFrame:
    """Trimmed and prefixed ids, incomplete rows left out, list items counted."""
    full = df.dropna(subset=[id_col, *required])
    return full.withColumn(id_col, F.concat(F.lit(prefix), F.trim(id_col))).withColumn("n_items", F.size(list_literal(F.col(list_col))))


def write_nested(df: DataFrame, schema: T.StructType, path: str) -> None:
    """Writes exactly the schema: a missing column fails, other columns are left out."""
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)).write.parquet(path)


def write_summary(summary: DataFrame, path: str, form: str = "json") -> None:
    """Small result tables as json (lines) or csv."""
    writer = summary.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def write_in_order(df: DataFrame, path: str, *, order: Sequence[str]) -> None:
    """Global order by range partitions, each sorted; memory is bounded by a partition's sort, which spills."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def fill_from_sidecar(df: DataFrame, sidecar: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """df with columns taken from the sidecar where it has the key, and the flag matched."""
    side = sidecar.select(F.col(key).alias("_key"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_s_{c}") for c in columns))
    joined = df.join(side, df[key] == side["_key"], "left")
    kept = [c for c in df.columns if c not in columns]
    return joined.select(*kept, *(F.col(f"_s_{c}").alias(c) for c in columns), F.coalesce("_there", F.lit(False)).alias("matched"))


def coverage(filled: DataFrame) -> DataFrame:
    return filled.agg(F.count_if(F.col("matched")).alias("n_matched"), F.count_if(~F.col("matched")).alias("n_unmatched"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique, with their number of rows; empty for a proper sidecar."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def patch_in_window(df: DataFrame, *, ts: str, start: str, end: str, patches: dict[str, Column]) -> DataFrame:
    """Columns replaced only for rows in [start, end)."""
    inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return df.withColumns({c: F.when(inside, v).otherwise(F.col(c)) for c, v in patches.items()})


def patch_days(spark: SparkSession, path: str, *, day: str, ts: str, start: str, end: str, patches: dict[str, Column]) -> DataFrame:
    """Patches rows in [start, end) of a table partitioned by `day` (the date of ts), in place, and returns patch_counts of it.

    Only the window's days are read and written: by dynamic partition overwrite, after the patched rows have been stored, so that
    no file is read and replaced in one job. A day's files are swapped when all of them are written; those of other days keep
    their names and times. A column may become null; the partition column may not be patched. counts are taken before the swap.
    """
    if {day, ts} & set(patches):
        raise ValueError(f"{day} and {ts} place a row and can't be patched")
    whole = spark.read.parquet(path)
    last = F.to_date(F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND"))
    touched = whole.filter(F.col(day).between(F.to_date(F.lit(start).cast("timestamp_ntz")), last))
    counts = stored(patch_counts(touched, ts=ts, start=start, end=end, patches=patches), "patch-counts")
    fixed = stored(patch_in_window(touched, ts=ts, start=start, end=end, patches=patches).select(*whole.columns), "patched")
    fixed.repartition(day).write.option("partitionOverwriteMode", "dynamic").partitionBy(day).mode("overwrite").parquet(path)
    return counts


def rule_rows(rules: DataFrame, *, json_columns: Sequence[str]) -> DataFrame:
    """Nested columns as JSON text."""
    return rules.withColumns({c: F.to_json(F.col(c)) for c in json_columns})


def row_errors(checks: dict[str, Column]) -> Column:
    """The names of the checks whose violation holds, as an array."""
    return F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in checks.items())))


def read_movements(spark: SparkSession, path: str, *, times: Sequence[str], reference: str, start, end) -> DataFrame:
    """The cached table of reports with the clock fix applied, once: rows already marked as fixed are left as they are."""
    return parse.clock_fix(spark.read.parquet(path), times=times, reference=reference, start=start, end=end)


def write_tokens(tokens: DataFrame, path: str, *, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """A token stream in order of time, written once and read from there."""
    write_in_order(tokens, path, order=[ts, *tie])
    return tokens.sparkSession.read.schema(tokens.schema).parquet(path)


def patch_counts(df: DataFrame, *, ts: str, start: str, end: str, patches: dict[str, Column]) -> DataFrame:
    """column, n_inside, n_changed, before, after: what patch_in_window does to each column (sums where the column is a number)."""
    inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    rows = []
    for c, v in patches.items():
        new = F.when(inside, v).otherwise(F.col(c))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.count_if(inside).alias("n_inside"), F.count_if(~new.eqNullSafe(F.col(c))).alias("n_changed"),
            F.sum(F.col(c).cast("double")).alias("before"), F.sum(new.cast("double")).alias("after"),
        ))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def write_rules(rules: DataFrame, path: str, *, json_columns: Sequence[str]) -> DataFrame:
    """Rules with nested columns as JSON text, written as Parquet and CSV; one row: how many went in and came back from each."""
    flat = rule_rows(rules, json_columns=json_columns)
    flat.write.parquet(f"{path}/parquet")
    flat.write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    spark = rules.sparkSession
    back = {"parquet": spark.read.schema(flat.schema).parquet(f"{path}/parquet"), "csv": spark.read.schema(flat.schema).option("header", True).option("escape", '"').csv(f"{path}/csv")}
    out = flat.agg(F.count("*").alias("n_rules"))
    for name, df in back.items():
        same = df.intersectAll(flat).agg(F.count("*").alias(f"n_{name}"))
        out = out.join(F.broadcast(same))  # one row each
    return out


def attached(df: DataFrame, side: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """df with columns of a side table that is unique by key; raises if it is not, so the number of rows stays."""
    twice = duplicate_keys(side, key).take(1)
    if twice:
        raise ValueError(f"{key} {twice[0][0]} is in the side table {twice[0][1]} times")
    return df.join(side.select(key, *columns), key, "left")
