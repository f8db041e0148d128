"""Language by Bayesian fusion of text, declared language, markup, address suffix and host.

Text likelihoods are byte trigram frequencies per language over hashed buckets. Every page of a document adds its markup
language, the suffix of its host and the host itself. Host priors are grouped counts of text decisions, smoothed from
all documents to the domain and from the domain to the host; a document without a page has its source in their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, long_id, map_texts, quoted, slices, stored, texts_of, whole_text

BUCKETS = 1 << 16


def trigrams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of each text in turn, and how many each has."""
    sizes = np.array([max(0, len(x) - 2) for x in raw], np.int64)
    joined = np.frombuffer(b"".join(x for x in raw if len(x) > 2), np.uint8).astype(np.uint32)
    if not len(joined):
        return np.zeros(0, np.int64), sizes
    code = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
    buckets = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    ends = np.cumsum(sizes[sizes > 0] + 2)
    inside = np.ones(len(buckets), bool)
    inside[ends[:-1] - 2] = False
    inside[ends[:-1] - 1] = False
    return buckets[inside], sizes


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


#: Parts in which a language's documents are ranked, so that no task ranks all of a common one.
FIT_PARTS = 64


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # float32, [language, bucket]


def fit_text(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", fit_rows=8000) -> TextModel:
    """Trigram frequencies from a bounded sample: of each language fit_rows documents (rounded up to FIT_PARTS) at most, so that a rare language has a model
    as a common one has: those that come first by the hash of id and text in each of FIT_PARTS parts of the language."""
    labelled = docs.filter(quoted(lang_col).isNotNull()).select(
        quoted(id_col).alias("_id"), quoted(lang_col).alias("_lang"), whole_text(text_col).alias("_text")
    )
    mark, part = F.xxhash64("_id", "_text"), F.pmod(F.xxhash64("_id", "_text"), F.lit(FIT_PARTS)).alias("_part")
    first = W.partitionBy("_lang", "_part").orderBy("_mark")
    marks = labelled.select("_lang", mark.alias("_mark"), part).withColumn("_no", F.row_number().over(first)).filter(F.col("_no") <= -(-fit_rows // FIT_PARTS))
    last = stored(marks.groupBy("_lang", "_part").agg(F.max("_mark").alias("_last")), "fit-marks")  # FIT_PARTS rows a language
    sample = labelled.withColumns({"_mark": mark, "_part": part}).join(last, ["_lang", "_part"]).filter("_mark <= _last").select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = trigrams([_raw(text)])[0]
                sums[lang] = sums.get(lang, 0) + np.bincount(found, minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    # at most languages * BUCKETS rows
    counts = (
        map_texts(sample, count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counts["lang"].unique())
    table = np.full((max(1, len(languages)), BUCKETS), 0.05)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    log_p = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return TextModel(languages or ["und"], log_p)


def text_scores(docs: DataFrame, model: TextModel, *, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """doc_id, the kept columns, grams, log_p (per language, summed over the whole text). Texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), whole_text(text_col).alias("_text"), *keep)
    names = [c for c in chosen.columns if c not in ("doc_id", "_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value.log_p

        for batch in slices(batches, 1, 1 << 20):
            raw = [_raw(t) for t in texts_of(batch.column(1))]
            out = np.zeros((len(raw), len(log_p)))
            buckets, grams = trigrams(raw)
            full = np.flatnonzero(grams)
            starts = (np.cumsum(grams) - grams)[full]
            for k, row in enumerate(log_p):
                if len(full):
                    out[full, k] = np.add.reduceat(row[buckets], starts, dtype=np.float64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(raw) + 1, dtype=np.int32) * len(log_p)), pa.array(out.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(k) for k in range(2, batch.num_columns)), pa.array(grams), lists],
                names=["doc_id", *names, "grams", "log_p"],
            )

    kept = "".join(f", `{c}` {chosen.schema[c].dataType.simpleString()}" for c in names)
    return map_texts(chosen, run, f"doc_id long{kept}, grams long, log_p array<double>")


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, markup, suffix, domain, host of the pages whose address ends in a document's number, pages that agree in all of
    them taken once. Addresses without host or number give nothing."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    markup = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    found = pages.select(
        F.regexp_extract("url", r"://[^?#]*/(\d{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)", 1).try_cast("long").alias("doc_id"),
        F.nullif(markup, F.lit("")).alias("markup"),
        host.alias("host"),
    ).filter(F.col("doc_id").isNotNull() & (F.col("host") != ""))
    suffix, domain = F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)
    return found.distinct().select("doc_id", "markup", suffix.alias("suffix"), domain.alias("domain"), "host")


def _agreement(said: Column, lang: str, n: int, trust: float) -> Column:
    """log P(what was said | lang): trusted to be right with that probability; nothing said counts as nothing."""
    said = F.lower(F.substring(said, 1, 2))
    return (
        F.when(said.isNull(), F.lit(0.0))
        .when(said == lang[:2].lower(), F.lit(float(np.log(trust))))
        .otherwise(F.lit(float(np.log((1 - trust) / max(1, n - 1)))))
    )


def _counts(n: int, name: str) -> Column:
    """Rows by their text's best language, as an array."""
    return F.array(*(F.sum((F.col("best") == k).cast("long")).cast("double") for k in range(n))).alias(name)


def _summed(name: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(name)[k]) for k in range(n))).alias(name)


def _smooth(counts: str, parent: Column, smoothing: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, p: (c + smoothing * p) / (total + smoothing))


def host_evidence(places: DataFrame, decided: DataFrame, share: Column, n: int, smoothing: float) -> DataFrame:
    """host, n_pages, evidence: log P(language | host) and log P(suffix | language), both against the share of all documents.

    places: page_evidence; decided: doc_id, best. Counts go up from hosts to domains and suffixes, so documents are met once.
    """
    met = places.select("doc_id", "host", "domain", "suffix").join(decided, "doc_id", "left")
    hosts = stored(met.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n_pages"), _counts(n, "by_host")), "hosts")
    total = hosts.count()
    out = hosts
    for key, name in (("domain", "by_domain"), ("suffix", "by_suffix")):
        sums = hosts.groupBy(key).agg(F.count("*").alias("n"), _summed("by_host", n).alias(name))
        out = join_counted(out, stored(sums, "tally"), [key], "n", total)
    prior = _smooth("by_host", _smooth("by_domain", share, smoothing), smoothing)
    evidence = F.zip_with(
        F.zip_with(prior, _smooth("by_suffix", share, smoothing), lambda a, b: F.log(a) + F.log(b)), share, lambda x, s: x - 2 * F.log(s)
    )
    return out.select("host", "n_pages", evidence.alias("evidence"))


def identify(
    docs: DataFrame,
    pages: DataFrame | None = None,
    *,
    id_col="doc_id",
    text_col="text",
    lang_col="lang",
    source_col="source",
    fit_rows=8000,
    text_grams=60,
    trust_declared=0.9,
    trust_markup=0.95,
    smoothing=20.0,
    least=0.8,
    keep=(),
) -> DataFrame:
    """doc_id, declared, language, probability, kept, and the columns of `keep`, expressions over docs with names of their own.

    The text counts as at most text_grams independent trigrams, so that the other evidence can matter. All pages of a document
    count, pages that agree in host and markup once. A document is kept when its best language has a probability of `least`
    and its text fits that language better than no language at all (uniform trigrams). Of languages with equal evidence the
    first by name is taken. Null and empty texts have no trigrams: they are decided by the other evidence and not kept. Null
    declared languages, sources and pages count as nothing said. Rows may repeat; an empty table stays empty.
    """
    model = fit_text(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, fit_rows=fit_rows)
    n = len(model.languages)
    scored = text_scores(
        docs, model, id_col=id_col, text_col=text_col, keep=[quoted(lang_col).alias("declared"), quoted(source_col).alias("source"), *keep]
    )
    carried = [c for c in scored.columns if c not in ("doc_id", "declared", "source", "grams", "log_p")]
    best = (F.array_position("log_p", F.array_max("log_p")) - 1).cast("int")
    rows = stored(scored.withColumn("best", F.when(F.col("grams") > 0, best)), "evidence")
    n_rows, *whole = rows.agg(F.count("*"), *(F.sum((F.col("best") == k).cast("long")) for k in range(n))).first()
    totals = np.array([x or 0 for x in whole], float) + 1.0
    share = F.array(*(F.lit(float(x)) for x in totals / totals.sum()))
    nothing = F.lit(None).cast("array<double>")
    if pages is None:
        rows = rows.withColumn("of_pages", nothing)
    else:
        places = stored(page_evidence(pages), "places")
        hosts = stored(host_evidence(places, rows.select("doc_id", "best"), share, n, smoothing), "host-evidence")
        met = join_counted(places.select("doc_id", "markup", "host"), hosts, ["host"], "n_pages", places.count())
        said = F.array(*(F.col("evidence")[k] + _agreement(F.col("markup"), lang, n, trust_markup) for k, lang in enumerate(model.languages)))
        per = met.select("doc_id", said.alias("of_pages")).groupBy("doc_id").agg(_summed("of_pages", n))
        rows = stored(rows.join(per, "doc_id", "left"), "evidence")
    without = rows.filter(F.col("of_pages").isNull())
    tally = without.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), _counts(n, "by_source"))
    prior = _smooth("by_source", _smooth("by_source", share, smoothing), smoothing)
    of_source = tally.select("source", "n", F.zip_with(prior, share, lambda a, s: F.log(a) - F.log(s)).alias("of_source"))
    rows = rows.filter(F.col("of_pages").isNotNull()).withColumn("of_source", nothing).unionByName(
        join_counted(without, stored(of_source, "sources"), ["source"], "n", n_rows, "left"), allowMissingColumns=True
    )
    weight = F.least(F.lit(1.0), F.lit(float(text_grams)) / F.greatest("grams", F.lit(1)))
    other = F.coalesce("of_pages", "of_source")
    sums = [
        F.col("log_p")[k] * weight
        + _agreement(F.col("declared"), lang, n, trust_declared)
        + F.coalesce(other[k], F.lit(0.0))
        + F.log(share[k])
        for k, lang in enumerate(model.languages)
    ]
    rows = rows.withColumn("fused", F.array(*sums)).withColumn("top", F.array_max("fused"))
    mass = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    place = F.array_position("fused", F.col("top")).cast("int")
    fits = F.element_at("log_p", place) > F.col("grams") * float(-np.log(BUCKETS))
    return rows.select(
        "doc_id",
        "declared",
        F.element_at(F.array(*(F.lit(x) for x in model.languages)), place).alias("language"),
        (1 / mass).alias("probability"),
        ((F.col("grams") > 0) & (1 / mass >= least) & fits).alias("kept"),
        *carried,
    )
