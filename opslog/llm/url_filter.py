"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

The regression learns from a small table of labelled addresses and knows nothing of the pages it judges. The default table is
made by a rule: every word below gives a few addresses, in which the rest (prefix, second word, suffix, path) is dealt alike
to both labels, so that only the words tell them apart; as many with names put together from pieces of allowed words stand for
the names without a meaning that most hosts have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_id, map_texts, quoted, slices, texts_of

BITS = 16
SIZES = (3, 4, 5)
_BASE, _MIX = 257, 0x9E3779B97F4A7C15
_SEED = {"host": 1, "path": 2}

#: Words of addresses to block, and of addresses to allow.
BLOCK_WORDS = """
ads adserver advert adclick banner popup popunder track tracker tracking pixel beacon affiliate clickbait casino slots poker
roulette jackpot bets betting gamble bonus pills viagra cialis pharma-discount cheap-meds adult xxx porn sex cams escort
warez torrent crack keygen serial-key nulled spam linkfarm backlinks seo-links prize winner giveaway phish malware trojan
ransom scam hack-tool
""".split()
ALLOW_WORDS = """
library news journal university school physics history museum gallery garden cooking recipes travel hiking railway weather
statistics forum astronomy medicine hospital council townhall theatre concert orchestra poetry letters publisher books archive
wiki encyclopedia docs manual compiler software research science botany wildlife bakery market football cricket chess painting
cathedral village farming harbour climate energy theory atlas thesis lantern
""".split()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def labelled_addresses(times: int = 6) -> tuple[list[str], list[int]]:
    """The default training table, with 1 for addresses to block: twice `times` addresses for each word."""
    urls, blocked = [], []
    for label, words in ((0, ALLOW_WORDS), (1, BLOCK_WORDS)):
        for k, word in enumerate(words):
            for t in range(times * (1 + label)):
                other = words[(k + 7 * t + 1) % len(words)]
                name = (word, f"{word}-{other}", f"{other}{word}")[t % 3]
                prefix = ("", "www.", "m.", "blog.")[(k + t) % 4]
                suffix = ("com", "net", "org", "info", "example")[(k + 2 * t) % 5]
                path = (f"/{('en', 'de', 'fr', 'es')[(k + t) % 4]}/{37 * k + 11 * t}", f"/{other}/{k}.html", "/")[(k + t) % 3]
                urls.append(f"http{'s' * (t % 2)}://{prefix}{name}.{suffix}{path}")
                blocked.append(label)
                if not label:
                    third = words[(k + 3 * t + 5) % len(words)]
                    urls.append(f"http://{prefix}{word[:3]}{other[-4:-1]}{third[1:4]}.{suffix}{path.replace(other, third)}")
                    blocked.append(0)
    return urls, blocked


def buckets(parts: list[bytes], which: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all parts (hosts or paths, each marked at both ends), and the part each is of."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
    data = np.frombuffer(b"".join(b"^" + x + b"$" for x in parts), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(parts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the part's end
    found, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), np.uint64(_SEED[which] * 16 + n))
        for k in range(n):
            code = code * np.uint64(_BASE) + data[at + k]
        found.append((code * np.uint64(_MIX)) >> np.uint64(64 - BITS))
        owners.append(of[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def grams(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all addresses, and the address each is of."""
    (a, of_a), (b, of_b) = buckets(hosts, "host"), buckets(paths, "path")
    return np.concatenate([a, b]), np.concatenate([of_a, of_b])


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """Log odds of block: the bias and the summed weights over the root of their number."""
        found, of = grams(hosts, paths)
        n = np.maximum(1, np.bincount(of, minlength=len(hosts)))
        return self.bias + np.bincount(of, self.weights[found], len(hosts)) / np.sqrt(n)


def fit(urls: list[str], blocked: list[int], *, rounds=600, rate=5.0, l2=1e-4) -> UrlModel:
    """Gradient descent over a table small enough for the driver, n-gram counts over the root of their number."""
    parts = [split_url(u) for u in urls]
    flat, owner = grams(*([p[k].encode("utf-8", "replace") for p in parts] for k in (0, 1)))
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(urls))))
    y, w, bias = np.array(blocked, float), np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(owner, w[flat], len(urls)) * norm + bias)))
        wrong = (p - y) / len(urls)
        w -= rate * (np.bincount(flat, (wrong * norm)[owner], len(w)) + l2 * w)
        bias -= rate * wrong.sum()
    return UrlModel(w.astype(np.float32), float(bias))


def fit_labelled(labelled: DataFrame, *, url_col="url", label_col="blocked", fit_rows=20_000, **settings) -> UrlModel:
    """A model of a labelled table of one's own: address, and whether to block it (1 or true). A bounded sample is fitted: of each label
    the fit_rows addresses that come first by their hash. Null addresses and labels are left out; repeats count once.

    `judge` takes it as `model`. Parts of hosts that no labelled address has can't tell; see the README for what the default table
    finds of unseen words.
    """
    known = labelled.select(quoted(url_col).cast("string").alias("url"), quoted(label_col).cast("int").alias("y")).filter("url IS NOT NULL AND y IN (0, 1)").distinct()
    sample = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("url"), "url").limit(fit_rows).collect()]  # 2 * fit_rows addresses at most
    return fit([r["url"] for r in sample], [r["y"] for r in sample], **settings)


def default_model() -> UrlModel:
    return fit(*labelled_addresses())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, host, path) rules that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, model: UrlModel | None = None, id_col="page_id", url_col="url"
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block; null where a rule decides).

    Rules are a short list that becomes one expression. A null address, or one without ://, has an empty host and path
    and is judged by the model on those. Odds of exactly one block. Repeated rows stay; only id and address are read; nothing
    is shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20, 5000):
            open_rows = pc.is_null(batch.column(3)).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(open_rows))
            hosts, paths = ([x.encode("utf-8", "replace") for x in texts_of(some.column(k))] for k in (1, 2))
            scores = np.zeros(batch.num_rows)
            if len(hosts):
                scores[open_rows] = shared.value.scores(hosts, paths)
            columns = [*(batch.column(k) for k in range(batch.num_columns)), pa.array(scores, mask=~open_rows)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score"])

    url = quoted(url_col)
    parts = pages.select(long_id(pages, id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("verdict"))
    scored = map_texts(ruled, run, "page_id long, host string, path string, rule string, verdict string, score double")
    own = F.when(F.col("score") >= 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
