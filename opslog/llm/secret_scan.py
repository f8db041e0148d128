"""Secrets in texts: sure patterns, and weak parts that count only with what completes a credential.

A scan finds assignments, access keys and hex strings, which always count, and weak parts: identifiers (user names,
client ids), endpoints (addresses with a scheme) and tokens (long mixed strings). Sure and weak parts of each role
open scopes around them, merged per document; an interval join of weak parts with the scopes of the other roles
tells which of them stand together. A weak part is reported when its complement is near:

    a token with an identifier, an identifier with a secret, an endpoint with both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_id, map_texts, slices, stored, texts_of, whole_text

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_USER = re.compile(r"""(?i:\b(?:user(?:name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", re.ASCII)
_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+]{1,15}://[^\s"'<>]{4,}""", re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")

#: Kinds in the order in which spans of one start are listed, with their roles.
KINDS = ("assign", "access", "hex", "user", "endpoint", "token")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "endpoint": "endpoint", "token": "secret"}
WEAK = ("user", "endpoint", "token")
_SPAN = "struct<start: int, kind_no: int, end: int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the sure parts in code points, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that do not overlap a sure one."""
    found = [(m.start(), 3, m.end()) for m in _USER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    found += [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if _mixed(m[0])]
    out, k = [], 0
    ends: list[int] = []
    for a, _, b in base:  # base spans of different kinds may nest: keep the furthest end so far
        ends.append(max(b, ends[-1] if ends else 0))
    for s in sorted(found):
        while k < len(base) and base[k][0] < s[2]:
            k += 1
        if not k or ends[k - 1] <= s[0]:
            out.append(s)
    return out


def scopes(spans: list[tuple[int, int, int]], reach: int) -> list[tuple[str, int, int]]:
    """(role, from, to): merged intervals that lie within `reach` of a part of that role."""
    out: list[list] = []
    for role in sorted(set(ROLE.values())):
        start = len(out)
        for a, k, b in spans:
            if ROLE[KINDS[k]] == role:
                if len(out) > start and a - reach <= out[-1][2]:
                    out[-1][2] = max(out[-1][2], b + reach)
                else:
                    out.append([role, a - reach, b + reach])
    return [tuple(x) for x in out]


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", reach=200) -> DataFrame:
    """doc_id, base, weak, scopes: one row per document; texts are read whole and not shuffled."""
    span = pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("end", pa.int32())])
    scope = pa.struct([("role", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bases, weaks, around = [], [], []
            for text in texts_of(batch.column(1)):
                base = base_spans(text)
                weak = weak_spans(text, base)
                bases.append([{"start": a, "kind_no": k, "end": b} for a, k, b in base])
                weaks.append([{"start": a, "kind_no": k, "end": b} for a, k, b in weak])
                near = scopes(sorted(base + weak), reach) if weak else []
                around.append([{"role": r, "lo": a, "hi": b} for r, a, b in near])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bases, pa.list_(span)), pa.array(weaks, pa.list_(span)), pa.array(around, pa.list_(scope))],
                names=["doc_id", "base", "weak", "scopes"],
            )

    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return map_texts(chosen, 
        run, f"doc_id long, base array<{_SPAN}>, weak array<{_SPAN}>, scopes array<struct<role: string, lo: int, hi: int>>"
    )


def linked(parts: DataFrame, *, bin_width=1024) -> DataFrame:
    """row, spans: the weak parts of each row that stand with their complement. parts: row, weak, scopes.

    An interval join per row and bin of bin_width code points. Scopes of one role are disjoint in a row, so a part meets at most one of
    each role however many parts a document has.
    """
    kinds = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    weak = parts.select("row", F.explode("weak").alias("s")).withColumn("bin", F.floor(F.col("s.start") / bin_width))
    near = parts.select("row", F.inline("scopes")).select(
        "row", "role", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / bin_width), F.floor(F.col("hi") / bin_width))).alias("bin"),
    )
    met = weak.join(near, ["row", "bin"]).filter(
        (F.col("lo") <= F.col("s.start"))
        & (F.col("s.start") <= F.col("hi"))
        & (F.col("role") != kinds[F.col("s.kind_no")])
    )
    roles = met.groupBy("row", "s").agg(F.collect_set("role").alias("roles"))
    has = lambda r: F.array_contains("roles", r)
    token, user, endpoint = (F.col("s.kind_no") == KINDS.index(k) for k in ("token", "user", "endpoint"))
    kept = (token & has("identifier")) | (user & has("secret")) | (endpoint & has("identifier") & has("secret"))
    return roles.filter(kept).groupBy("row").agg(F.collect_list("s").alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of (start, kind number, end) spans, in that order, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(
        ",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"], s["end"]))
    )


def secrets(docs: DataFrame, *, id_col="doc_id", text_col="text", reach=200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document.

    Null and empty texts have no spans: counts of zero and empty listings. Repeated rows are scanned each by itself.
    """
    found = stored(
        scan(docs, id_col=id_col, text_col=text_col, reach=reach).withColumn("row", F.monotonically_increasing_id()),
        "secrets",
    )
    links = linked(found.filter((F.size("weak") > 0) & (F.size("scopes") > 1)).select("row", "weak", "scopes"))
    rows = found.select("row", "doc_id", "base").join(links, "row", "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long")
    every = F.concat("base", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")))
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(every).alias("spans"),
    )
