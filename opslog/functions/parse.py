"""Scalar expressions over ids, texts, times and arrays (Column in, Column out)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the formats of ids
ROUTE_ID = r"^R(DW|TD|DC|EC|DY)(\d+[A-Za-z]*)([A-Z]+)(?:-(\d+))?\((M|C|S|W|PS|SP)\)$"
HEADCODE = r"^([0-9])([A-Z])(\d{2})$"
VALID_ID = r"^[0-9A-Z]{3,4}$"
SIGNAL_PREFIX = r"^S(DC|DW|DY|EC|TD)"
ASSET_TYPES = (
    ("Signal", r"^S(DC|DW|DY|EC|TD)\d+\w*$"),
    ("Route", r"^R(DW|TD|DC|EC|DY)\d+\w*[A-Z]+(?:-\d+)?\((M|C|S|W|PS|SP)\)$"),
    ("TRTS", r"^LPLAT\d+[AB]TRS\([NS]\)$"),
    ("Track", r"^T[A-Z0-9]+$"),
)
CHANGE = r"^\[\((\d+),\s*(\d+)\)\]$"
STATE_EVENT_TYPES = ("Track", "Signal", "Route", "Panel_Request", "TRTS")


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), pattern, k), F.lit(""))


def route_parts(c: Column) -> Column:
    """Struct of prefix, signal_no, letter, sub, cls; all null when the id does not have the form."""
    names = ("prefix", "signal_no", "letter", "sub", "cls")
    return F.struct(*(_group(c, ROUTE_ID, k).alias(n) for k, n in enumerate(names, 1)))


def headcode_parts(c: Column) -> Column:
    names = ("class_digit", "dest", "serial")
    return F.struct(*(_group(c, HEADCODE, k).alias(n) for k, n in enumerate(names, 1)))


def headcode_of_long_id(c: Column) -> Column:
    """Characters 3 to 6, null unless there are four."""
    code = F.substring(c, 3, 4)
    return F.when(F.char_length(code) == 4, code)


def class_label(digit: Column, folded: Sequence[str] = ("7", "8")) -> Column:
    """Class digit, with the folded ones as 'other' and nulls as 'non_standard'."""
    return F.when(digit.isNull(), "non_standard").when(digit.isin(*folded), "other").otherwise(digit)


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Code to description by a literal map."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), c), F.lit(default))


def is_valid_id(c: Column, placeholders: Sequence[str] = ()) -> Column:
    ok = F.coalesce(c.rlike(VALID_ID), F.lit(False))
    return ok & ~c.isin(*placeholders) if placeholders else ok


def strip_signal_prefix(c: Column) -> Column:
    return F.regexp_replace(c, SIGNAL_PREFIX, "")


def asset_type(c: Column) -> Column:
    out = None
    for name, pattern in ASSET_TYPES:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise("Unknown")


def change_tokens(events: DataFrame, *, type_col="type", change_col="change", types=STATE_EVENT_TYPES) -> DataFrame:
    """State events with asset_idx and state from texts like [(444, 1)]; other rows are left out."""
    found = events.filter(F.col(type_col).isin(*types) & F.col(change_col).rlike(CHANGE))
    return found.select(
        "*",
        F.regexp_extract(change_col, CHANGE, 1).cast("smallint").alias("asset_idx"),
        F.regexp_extract(change_col, CHANGE, 2).cast("tinyint").alias("token_state"),
    )


def clock_fix(df: DataFrame, *, times: Sequence[str], reference: str, start: datetime, end: datetime, hours=-1) -> DataFrame:
    """Shifts the times of rows whose reference lies in [start, end) and marks them; rows marked before stay."""
    inside = (F.col(reference) >= F.lit(start)) & (F.col(reference) < F.lit(end))
    done = F.coalesce(F.col("clock_fixed"), F.lit(False)) if "clock_fixed" in df.columns else F.lit(False)
    due = F.coalesce(inside, F.lit(False)) & ~done
    shifted = {c: F.when(due, F.col(c) + F.expr(f"INTERVAL {hours} HOURS")).otherwise(F.col(c)) for c in times}
    return df.withColumn("_due", due).withColumns(shifted | {"clock_fixed": due | done}).drop("_due")


def number_in_range(c: Column, low: int, high: int) -> Column:
    """A number from lenient text, null outside [low, high]."""
    n = F.trim(c).try_cast("double").try_cast("int")
    return F.when(n.between(low, high), n)


def signed_lateness_s(variation_min: Column, status: Column, late="LATE", early="EARLY") -> Column:
    sign = F.when(status == late, 1).when(status == early, -1).otherwise(0)
    return F.abs(variation_min) * 60 * sign


def direction(elements: Column) -> Column:
    """'forward' if the first element sorts before or with the last, null for fewer than two."""
    ahead = F.try_element_at(elements, F.lit(1)) <= F.try_element_at(elements, F.lit(-1))
    return F.when(F.size(elements) >= 2, F.when(ahead, "forward").otherwise("reverse"))


def action_index(candidates: Column, chosen: Column, label: Column) -> Column:
    """0 for wait, the place of the chosen candidate from 1 (past the end when absent), -1 for a set without a route."""
    at = F.array_position(candidates, chosen)
    return (
        F.when(label == "wait", 0)
        .when(chosen.isNull(), -1)
        .when(at > 0, at.cast("int"))
        .otherwise(F.size(candidates) + 1)
    )


def with_chosen(candidates: Column, chosen: Column) -> Column:
    absent = chosen.isNotNull() & ~F.array_contains(candidates, chosen)
    return F.when(absent, F.array_append(candidates, chosen)).otherwise(candidates)


def action_of_index(candidates: Column, index: Column) -> Column:
    return F.when(index > 0, F.get(candidates, index - 1))


def distance_gate(d: Column, half_most: float, tenth_most: float) -> Column:
    return (
        F.when(d <= 2, 1.0).when(d <= half_most, 0.5).when(d <= tenth_most, 0.1).otherwise(0.0)
    )


def bucket(c: Column, edges: Sequence[float]) -> Column:
    """Number of the right-closed bucket; -1 for null."""
    out = F.when(c.isNull(), -1)
    for k, e in enumerate(edges):
        out = out.when(c <= e, k)
    return out.otherwise(len(edges))


def time_split(t: Column, train_end: datetime, validation_end: datetime) -> Column:
    return F.when(t < F.lit(train_end), "train").when(t < F.lit(validation_end), "val").otherwise("test")


def hash_split(key: Column, shares: Sequence[tuple[str, float]]) -> Column:
    """Split by the first 32 bits of the key's md5 over their range."""
    u = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)
    out, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def zscore(c: Column, mean: float, std: float, clip: float = 5.0) -> Column:
    z = (c - mean) / (std or 1.0)
    return F.when(c.isNull(), 0.0).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def one_hot(c: Column, n: int) -> Column:
    """n numbers, one of them 1; none for nulls and values outside."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce((k == c).cast("int"), F.lit(0)))


def padded(values: Column, pad: Column, k: int) -> Column:
    """The first k values, filled up with pad."""
    return F.slice(F.concat(values, F.array_repeat(pad, k)), 1, k)


def pad_mask(values: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (i <= F.size(values)).cast("int"))


def local_edges(edges: Column, nodes: Column) -> Column:
    """(src, dst) structs as positions in nodes, from 0; edges with an unknown end are left out."""
    at = F.transform(edges, lambda e: F.struct((F.array_position(nodes, e["src"]) - 1).alias("src"), (F.array_position(nodes, e["dst"]) - 1).alias("dst")))
    return F.filter(at, lambda e: (e["src"] >= 0) & (e["dst"] >= 0))


def vocabulary_index(c: Column, vocabulary: Column) -> Column:
    """Place in a sorted vocabulary from 1; 0 for nulls and unknown values."""
    return F.coalesce(F.array_position(vocabulary, c.cast("string")).cast("int"), F.lit(0))


def node_arrays(
    nodes: Column, *, ident: str, numbers: dict[str, tuple[float, float]], flags: Sequence[str] = (), platforms: Sequence[str] = (), categories: dict[str, Column] | None = None, slots: int = 8
) -> Column:
    """A struct of parallel arrays of an array of node structs: ids, cont, binary and cat, one entry a node.

    cont: each number's z-score (numbers: field to mean and deviation), clipped, 0 for null; binary: each flag as 0 or 1, then each
    platform as one of `slots` places; cat: each category's place in its vocabulary (an array column), 0 if unknown. A null array
    is an empty one.
    """
    flag = lambda n, f: F.coalesce(n[f].cast("boolean"), F.lit(False)).cast("int")
    hot = lambda n, f: one_hot(n[f].cast("int"), slots)
    return F.struct(
        F.coalesce(F.transform(nodes, lambda n: n[ident].cast("string")), F.array().cast("array<string>")).alias("ids"),
        F.coalesce(F.transform(nodes, lambda n: F.array(*(zscore(n[f].cast("double"), m, s) for f, (m, s) in numbers.items()))), F.array().cast("array<array<double>>")).alias("cont"),
        F.coalesce(F.transform(nodes, lambda n: F.concat(F.array(*(flag(n, f) for f in flags)).cast("array<int>"), *(hot(n, f) for f in platforms))), F.array().cast("array<array<int>>")).alias("binary"),
        F.coalesce(F.transform(nodes, lambda n: F.array(*(vocabulary_index(n[f], v) for f, v in (categories or {}).items())).cast("array<int>")), F.array().cast("array<array<int>>")).alias("cat"),
    )


def edge_arrays(edges: Column, src_ids: Column, dst_ids: Column) -> Column:
    """A struct of two parallel arrays, the local places (from 0) of edges' ends in the ids of their kinds; edges with an end that is not
    there are left out."""
    at = F.transform(edges, lambda e: F.struct((F.array_position(src_ids, e["src"].cast("string")) - 1).alias("src"), (F.array_position(dst_ids, e["dst"].cast("string")) - 1).alias("dst")))
    kept = F.filter(at, lambda e: (e["src"] >= 0) & (e["dst"] >= 0))
    empty = F.array().cast("array<bigint>")
    return F.struct(F.coalesce(F.transform(kept, lambda e: e["src"]), empty).alias("src"), F.coalesce(F.transform(kept, lambda e: e["dst"]), empty).alias("dst"))
