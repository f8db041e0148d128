"""The training-data operators against brute force, and on nulls, empty texts, ties, repeats and empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opslog.llm import (
    common,
    components,
    crf,
    decontaminate,
    language_id,
    line_dedup,
    near_copies,
    packing,
    queries,
    secret_scan,
    simhash,
    token_files,
    tokenize,
    topk,
    toxicity,
    url_filter,
)

DATA = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog and runs away from it"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and extra columns with names that operators use inside."""
    rows = [(1, None), (2, ""), (3, LONG), (4, LONG), (4, LONG), (5, (LONG + "\n") * 4000), (6, " \t "), (None, LONG)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, n_lines string, drop int").withColumns(
        {"h1": F.lit(1), "fp": F.lit("z"), "piece": F.lit(0), "spans": F.lit("s"), "lang": F.lit("en"), "source": F.lit("s1"), "score": F.lit("q")}
    )


@pytest.fixture
def none(odd):
    return odd.filter("false")


def rows(df):
    return df.toPandas()


# --- tokens ---------------------------------------------------------------------------------------------------------


def test_columns_encode_like_the_library(tokenizer):
    """Short odd texts: blanks of every kind, contractions, accents, control characters and the tokenizer's added token."""
    rng = np.random.default_rng(3)
    letters = [*"ab éß ².,'\n\t  s1½ :—日́\r\x0b\x85 (\"`_re-x \x1c\x00\u2003", "<|endoftext|>", " 's", "'ll"]
    encode = tokenize.Encoder(most=50)
    for _ in range(40):
        texts = ["".join(rng.choice(letters, rng.integers(0, 18))) for _ in range(200)]
        ids, starts = encode(pa.array(texts, pa.string()))
        for text, a, b in zip(texts, starts[:-1], starts[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_and_other_tokenizers(tokenizer):
    text = "x <|endoftext|> y"
    assert tokenize.Encoder()(pa.array([text]))[0].tolist() == [87, 220, 50256, 331]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert tokenize.Encoder(specials_as_text=True)(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello  World, it's 12", "", "<|startoftext|>Été\n"]
    ids, starts = tokenize.Encoder("word_bpe_49k.json")(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_bytes_that_are_no_text():
    broken = pa.array([b"ab \xff\xfe c", b"\xc3"], pa.binary()).view(pa.string())
    assert common.texts_of(broken) == ["ab \ufffd\ufffd c", "\ufffd"]
    ids, starts = tokenize.Encoder()(broken)
    assert starts[0] == 0 and starts[-1] == len(ids)


def test_ids_other_than_whole_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", "text", "en", "s")], "doc_id string, text string, lang string, source string")
    calls = (
        lambda: packing.pack_documents(df), lambda: token_files.write_tokens(df, "unused"), lambda: line_dedup.dedup_lines(df),
        lambda: toxicity.score(df, None), lambda: language_id.text_scores(df, None), lambda: simhash.near_duplicates(df),
        lambda: decontaminate.contaminated_spans(df, df), lambda: secret_scan.secrets(df), lambda: near_copies.drop_near_copies(df),
        lambda: topk.top_k(df.select("doc_id", F.array(F.lit(1.0)).alias("v")), F.lit(True), id_col="doc_id", vector_col="v"),
        lambda: url_filter.judge(df, [], id_col="doc_id", url_col="text"),
    )
    for call in calls:
        with pytest.raises(TypeError, match="whole numbers"):
            call()


def test_token_files_round_trip(spark, documents, tokenizer):
    got = rows(queries.op2_token_files(spark, DATA)).sort_values("doc_id")
    start = 0
    for text, r in zip(documents.text.fillna(""), got.itertuples()):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_select(spark, odd, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_files.write_tokens(odd, path, encoding=encoding)
    some = token_files.read_documents(spark, path, 3, 4).orderBy("doc_id").collect()
    assert [r.doc_id for r in some] == [3, 4, 4] and some[0].tokens == some[1].tokens
    digest = rows(token_files.read_digest(spark, path))
    assert len(digest) == 8 and digest[digest.doc_id == 2].n_tokens.item() == 1


def test_token_files_as_they_lie(spark, tmp_path):
    """Encodings, row groups and page indexes as asked for, and what a selective read can leave out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(3)
    for encoding, wanted in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = str(tmp_path / encoding)
        token_files.write_tokens(docs, path, encoding=encoding, row_group_mb=1, page_kb=16)
        groups, last = [], -1
        for f in sorted((tmp_path / encoding).glob("*.parquet")):
            meta = pq.ParquetFile(f).metadata
            names = [meta.schema.column(k).path for k in range(meta.num_columns)]
            for g in range(meta.num_row_groups):
                columns = {n: meta.row_group(g).column(k) for k, n in enumerate(names)}
                tokens, ids = columns["tokens.list.element"], columns["doc_id"]
                assert wanted in tokens.encodings or (wanted == "RLE_DICTIONARY" and "PLAIN_DICTIONARY" in tokens.encodings)
                assert tokens.has_offset_index and ids.has_column_index and ids.has_offset_index
                assert ids.statistics.min > last  # ascending, so a range of ids is in few row groups
                last = ids.statistics.max
                groups.append((ids.statistics.min, ids.statistics.max, tokens.total_compressed_size))
        first, end = groups[1][0], groups[1][1]
        assert len(groups) >= 4 and sum(lo <= end and hi >= first for lo, hi, _ in groups) == 1
        some = token_files.read_documents(spark, path, first, end)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan and f"GreaterThanOrEqual(doc_id,{first})" in plan
        assert some.count() == docs.filter(F.col("doc_id").between(first, end)).count()
        plan = token_files.block_starts(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "n_tokens" in plan and "tokens:array" not in plan


# --- packing --------------------------------------------------------------------------------------------------------


def check_packing(p, most=1024):
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= most
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all()


def test_packing_round_trip(spark, documents, tokenizer):
    p = rows(queries.op1_best_fit_packing(spark, DATA))
    check_packing(p)
    by = dict(list(p.groupby("doc_id")))
    for doc, text in zip(documents.doc_id, documents.text.fillna("")):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(by[doc].sort_values("piece").itertuples()):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert p.sequence_id.nunique() <= np.ceil(p.length.sum() / 1024) * 1.02 + 1


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_packing_keeps_every_capacity(by):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    bins, _ = packing.best_fit(lengths, max_tokens=100, max_docs=4, max_attention=4000, weights=(1, 0.5, 0.5), by=by)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and ((own.astype(float) ** 2).sum() <= 4000 or len(own) == 1)


def test_best_fit_is_best_fit():
    lengths = np.random.default_rng(2).integers(1, 65, 300)
    bins, _ = packing.best_fit(lengths, max_tokens=64, max_docs=64, max_attention=64.0**2)
    left: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= x]
        if fits:
            left[left.index(min(fits))] -= x
        else:
            left.append(64 - x)
    assert len(np.unique(bins)) == len(left)


def test_groups_cost_no_sequences(spark):
    """131,072 pieces in one, two and eight groups, against the least number that their tokens need."""
    lengths = np.random.default_rng(8).integers(1, 1024, 1 << 17)
    df = common.stored(spark.createDataFrame(pd.DataFrame({"length": lengths})), "lengths")
    n = [packing.pack(df, group_rows=rows).select("sequence_id").distinct().count() for rows in (1 << 17, 1 << 16, 1 << 14)]
    least = -(-int(lengths.sum()) // 1024)
    assert max(n) <= 1.003 * min(n) and n[0] <= 1.01 * max(least, (lengths > 512).sum())


def test_capacities_bind(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    p = rows(packing.pack_documents(docs, max_docs=3, max_attention=0.75 * 1024**2, weights=(1.0, 0.25, 0.25)))
    check_packing(p)
    by = p.assign(cost=p.length.astype(float) ** 2).groupby("sequence_id").agg(n=("length", "size"), cost=("cost", "sum"))
    assert by.n.max() == 3 and 0.7 * 1024**2 < by.cost.max() <= 0.75 * 1024**2
    loose = rows(packing.pack_documents(docs))
    assert loose.groupby("sequence_id").size().max() > 3 and loose.length.sum() == p.length.sum()


def test_packing_edge_rows(odd, none):
    p = rows(packing.pack_documents(odd))
    check_packing(p)
    assert p[p.doc_id == 1].length.tolist() == [1] and len(p[p.doc_id == 4]) == 2
    assert rows(packing.pack_documents(none)).empty


def test_packing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, 7, k, k % 3 + 1, -1) for k in range(20)], "row_no int, group_no int, _row int, length long, offset int")
    p = rows(packing.pack(common.stored(df, "p"), max_tokens=4))
    check_packing(p, 4)
    assert sorted(p.row_no) == list(range(20)) and (p.group_no == 7).all() and (p.offset >= 0).all() and (p.row_no == p._row).all()


# --- lines ----------------------------------------------------------------------------------------------------------


def brute_lines(docs):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    held = {}
    for doc, text in docs:
        for k in {key(x) for x in text.split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, []).append(doc)
    for doc, text in docs:
        lines = text.split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == doc]
        yield doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_lines_against_brute_force(spark, documents):
    got = {tuple(r) for r in queries.op3_line_dedup(spark, DATA).collect()}
    assert got == set(brute_lines(list(zip(documents.doc_id, documents.text.fillna("")))))


def test_line_edges(odd, none):
    got = rows(line_dedup.dedup_lines(odd)).set_index("doc_id")
    assert got.loc[2, "n_lines"] == 1 and got.loc[1, "text"] == "" and "h1" in got.columns
    assert got.loc[5, "n_dropped"] == 0 and got.loc[3, "n_dropped"] == 1  # the largest doc_id keeps its lines
    assert rows(line_dedup.dedup_lines(none)).empty


def test_lines_keep_columns_of_any_name(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(k, f"{line}\nown {k}", k, "x") for k in range(4)], "doc_id long, text string, _drop long, `_doc.x` string")
    df = df.withColumn("copy", F.lit("c")).withColumn("h1", F.lit(1))
    got = rows(line_dedup.dedup_lines(df)).sort_values("doc_id")
    assert got.text.tolist() == ["own 0", "own 1", "own 2", f"{line}\nown 3"] and got._drop.tolist() == [0, 1, 2, 3]
    assert list(got.columns) == ["doc_id", "_drop", "_doc.x", "copy", "h1", "text", "n_lines", "n_dropped", "kept_sha256"]


def test_lines_do_not_depend_on_batches(spark, documents):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = set(brute_lines(list(zip(documents.doc_id, documents.text.fillna("")))))
    for least in (1, 7):
        got = line_dedup.dedup_lines(df, least_batches=least).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
        assert {tuple(r) for r in got.collect()} == want


def test_rows_of_one_id_lose_their_own_lines(spark):
    one, two = "first line that is long enough", "second line that is long enough"
    texts = [(1, one), (1, two), (1, f"{one}\n{two}"), (2, one), (3, one), (4, two), (None, two), (None, one), (5, two)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([(1, "", 1, 1), (1, "", 1, 1), (1, "", 2, 2), (2, "", 1, 1), (3, one, 1, 0), (4, "", 1, 1), (-1, "", 1, 1), (-1, "", 1, 1), (5, two, 1, 0)])


def test_runs_are_merged_and_new_lines_found(spark):
    runs = line_dedup.LineRuns(spark, buckets=3)
    lines = lambda *x: spark.createDataFrame([(d, h, h) for d, h in x], "doc_id long, h1 long, h2 long")
    seen = set()
    for b in range(6):
        assert runs.unseen(lines((b, 1), (b, 100 + b))).count() == (2 if b == 0 else 1)
        runs.add(lines((b, 1), (b, 100 + b), (b, b % 2)) if b != 1 else lines((b, 1), (b, 101)))
        held = [r.h1 for name in filter(None, runs.firsts) for r in spark.table(name).collect()]
        assert len(held) == len(set(held)) and seen <= set(held)  # no hash is in two runs
        seen = set(held)
    assert [bool(x) for x in runs.firsts] == [False, True, True] and len(runs.paths) == 2 + sum(map(bool, runs.again))
    assert sorted((r.h1, r.n_docs, r.last_doc) for r in runs.frequent(3).collect()) == [(0, 3, 4), (1, 8, 5)]
    runs.clear()
    assert not runs.paths


def test_no_run_is_shuffled(spark):
    """The plans of a batch's look-up and of the result have no exchange over the runs."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = line_dedup.LineRuns(spark, buckets=4)
        for b in range(3):
            runs.add(spark.range(50).select(F.lit(b).cast("long").alias("doc_id"), (F.col("id") + 25 * b).alias("h1"), F.col("id").alias("h2")))
        batch = spark.table(next(filter(None, runs.firsts)))
        for df in (runs.unseen(batch), runs.frequent(2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        runs.clear()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- toxicity -------------------------------------------------------------------------------------------------------


def slow_chain(e, steps):
    """Log Z, marginals and expected pairs of one chain, by recursion in log space."""
    add, n = np.logaddexp, len(e)
    node = [(0.0, x) for x in e]
    a, b = [node[0]], [(0.0, 0.0)]
    for t in range(1, n):
        a.append(tuple(add(a[-1][0] + steps[0, j], a[-1][1] + steps[1, j]) + node[t][j] for j in (0, 1)))
    for t in range(n - 1, 0, -1):
        b.append(tuple(add(*(steps[i, j] + node[t][j] + b[-1][j] for j in (0, 1))) for i in (0, 1)))
    b.reverse()
    z, pairs = add(*a[-1]), np.zeros((2, 2))
    for t in range(1, n):
        pairs += [[math.exp(a[t - 1][i] + steps[i, j] + node[t][j] + b[t][j] - z) for j in (0, 1)] for i in (0, 1)]
    return z, [math.exp(a[t][1] + b[t][1] - z) for t in range(n)], pairs


@pytest.mark.parametrize("segment", [3, 256])
def test_marginals_of_whole_chains(monkeypatch, segment):
    monkeypatch.setattr(crf, "SEGMENT", segment)
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 3, 0, 700, 256, 257, 512, 13, 5, 0])
    e, steps = rng.normal(-1, 3, sizes.sum()), rng.normal(size=(2, 2)) * 2
    got, pairs = crf.marginals(e, sizes, steps)
    own = [slow_chain(x, steps) for x in np.split(e, np.cumsum(sizes)[:-1]) if len(x)]
    assert np.allclose(got, np.concatenate([p for _, p, _ in own])) and np.allclose(pairs, sum(w for _, _, w in own))
    for words in (1, 300, 10**6):
        parts, sums = crf.in_blocks(e, sizes, steps, words=words)
        assert np.allclose(parts, got, atol=1e-6) and np.allclose(sums, pairs)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    e, steps = rng.normal(size=5), rng.normal(size=(2, 2))
    total, p = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> t) & 1 for t in range(5)]
        w = np.exp(sum(e[t] * y[t] for t in range(5)) + sum(steps[y[t - 1], y[t]] for t in range(1, 5)))
        total += w
        p += w * np.array(y)
    assert np.allclose(crf.marginals(e, np.array([5]), steps)[0], p / total)


def test_gradient_of_the_field():
    """Expected minus labelled counts are the derivative of the log likelihood."""
    rng = np.random.default_rng(1)
    e, steps, y = rng.normal(size=9), rng.normal(size=(2, 2)), rng.integers(0, 2, 9)

    def loss(e, steps):
        gold = sum(e[t] * y[t] for t in range(9)) + sum(steps[y[t - 1], y[t]] for t in range(1, 9))
        return slow_chain(e, steps)[0] - gold

    p, pairs = crf.marginals(e, np.array([9]), steps)
    gold = np.zeros((2, 2))
    for t in range(1, 9):
        gold[y[t - 1], y[t]] += 1
    for k in range(9):
        d = np.eye(9)[k] * 1e-5
        assert np.isclose((loss(e + d, steps) - loss(e - d, steps)) / 2e-5, p[k] - y[k], atol=1e-6)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert np.isclose((loss(e, steps + d) - loss(e, steps - d)) / 2e-5, (pairs - gold)[i, j], atol=1e-6)


def test_scores_against_brute_force(spark, documents):
    """Every score of the query's model by plain recursion over the whole text, the longest ones too."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = rows(toxicity.score(docs, model)).set_index("doc_id")
    used = documents.assign(n=documents.text.fillna("").str.len()).sort_values("n")
    for doc, text in zip(used.doc_id[::7].tolist() + used.doc_id.tolist()[-2:], used.text.fillna("")[::7].tolist() + used.text.tolist()[-2:]):
        words, at, places = [], None, []
        for k, c in enumerate(text + " "):
            if c.isascii() and not c.isalnum():
                if at is not None:
                    words.append("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text[at:k]).encode())
                    places.append((at, k))
                    at = None
            elif at is None:
                at = k
        e = []
        for w in words:
            parts = [b"w" + w, b"e" + w[-3:]] + [b"b" + w[:k] for k in range(3, 8) if len(w) >= k]
            e.append(sum(float(model.weights[zlib.crc32(x) % (1 << 18)]) for x in parts) + model.bias)
        p = slow_chain(e, model.steps)[1] if e else []
        none = 1.0
        for x in p:
            none *= 1 - min(x, 0.999999)
        x = np.array([max(p), math.log1p(sum(p)), 1 - none, 1.0] if p else [0, 0, 0, 1.0]) @ model.calibration
        assert np.isclose(got.score[doc], 1 / (1 + math.exp(-min(30, max(-30, x)))), atol=1e-6)
        hit = [places[k] for k in range(len(p)) if p[k] >= 0.5]
        covered = [k for s in got.spans[doc] for k in range(s["start"], s["end"])]
        assert {k for a, b in hit for k in range(a, b)} <= set(covered)
        assert len(got.spans[doc]) == sum(1 for k in range(len(p)) if p[k] >= 0.5 and (k == 0 or p[k - 1] < 0.5))


def test_training_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_field", lambda texts, toxic: seen.extend(texts))
    docs = spark.createDataFrame([(k, "word " * (k + 1)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, fit_chars=2000)
    assert 500 < sum(map(len, seen)) <= 2000 and all(len(t) % 5 == 0 for t in seen)
    assert not any(zlib.crc32(str(len(t) // 5 - 1).encode()) % 5 == 0 for t in seen)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = rows(queries.op4_toxicity(spark, d)).merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(x).encode()) % 5 == 0 for x in held.doc_id]).all()
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held.predicted[held.toxic == 0].mean() < 0.01
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()


def test_toxic_offsets_and_edges(spark, odd, none):
    toxic = [(i, f"été {'abc' * (i % 3 + 1)} vile{i % 2} word {i}") for i in range(60)]
    clean = [(100 + i, f"été {'abc' * (i % 3 + 1)} nice{i % 2} word {i}") for i in range(60)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in toxic + clean], "doc_id long, toxic int")
    got = rows(toxicity.classify(docs, labels)).set_index("doc_id")
    assert (got.predicted[got.index < 100] == 1).all() and (got.predicted[got.index >= 100] == 0).all()
    text = dict(toxic)[5]
    assert [text[s["start"] : s["end"]] for s in got.spans[5]] == ["vile1"]
    edge = rows(toxicity.classify(odd, labels))
    assert len(edge) == 8 and edge.score.notna().all() and not edge[edge.doc_id.isna()].held_out.any()
    assert rows(toxicity.classify(none, labels)).empty
    assert len(rows(toxicity.classify(odd, labels.filter("false")))) == 8


# --- language -------------------------------------------------------------------------------------------------------


def test_language_on_documents(spark, documents):
    got = rows(queries.op5_language_id(spark, DATA))
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    assert (got.language == got.declared).mean() > 0.98 and got.kept.mean() > 0.98


def test_evidence_corrects_and_rejects(spark, odd, none):
    en, de = "the house and the garden of the old man in the town", "der alte mann und das haus mit dem garten in der stadt"
    docs = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s") for i in range(40)]
    docs += [(100, de * 3, "en", "s"), (101, None, "en", "s"), (102, "", None, None), (103, "qxz7 0x9f8e7d " * 30, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://a.example.de/x/100", '<html lang="de">'), (2, None, None), (3, "nothing", "")], "page_id long, url string, html string")
    got = rows(language_id.identify(df, pages)).set_index("doc_id")
    assert got.language[100] == "de" and got.kept[got.index < 40].all()
    assert not got.kept[[101, 102, 103]].any()
    assert len(rows(language_id.identify(odd))) == 8 and rows(language_id.identify(none)).empty


def slow_languages(docs, pages, smoothing=20.0, grams_most=60, trust=(0.9, 0.95)):
    """The fusion in plain Python: (language, probability) of each row of (doc_id, text, lang, source)."""
    grams = lambda t: [((t[k] << 16 | t[k + 1] << 8 | t[k + 2]) * 2654435761 % 2**32) >> 16 for k in range(len(t) - 2)]
    of = [grams((t or "").encode().lower()) for _, t, _, _ in docs]
    langs = sorted({x for _, _, x, _ in docs if x})
    n, counts = len(langs), {x: Counter() for x in langs}
    for g, (_, _, lang, _) in zip(of, docs):
        if lang:
            counts[lang].update(g)
    sizes = {x: sum(counts[x].values()) + 0.05 * 65536 for x in langs}
    text = [[sum(math.log((counts[x][b] + 0.05) / sizes[x]) for b in g) for x in langs] for g in of]
    best = [max(range(n), key=lambda k: (row[k], -k)) if g else None for row, g in zip(text, of)]
    total = [1 + sum(b == k for b in best) for k in range(n)]
    share = [x / sum(total) for x in total]
    places = defaultdict(set)
    for doc, markup, host in pages:
        places[doc].add((markup, host))
    up = {"host": lambda h: h, "domain": lambda h: ".".join(h.split(".")[-2:]), "suffix": lambda h: h.split(".")[-1]}
    by = {kind: defaultdict(lambda: [0] * n) for kind in up}
    by_source = defaultdict(lambda: [0] * n)
    for (doc, _, _, source), b in zip(docs, best):
        if b is None:
            continue
        if not places.get(doc):
            if source:
                by_source[source][b] += 1
        for _, host in places.get(doc, ()):
            for kind, f in up.items():
                by[kind][f(host)][b] += 1
    smooth = lambda c, parent: [(x + smoothing * p) / (sum(c) + smoothing) for x, p in zip(c, parent)]
    agree = lambda said, lang, t: 0 if not said else math.log(t) if said[:2].lower() == lang[:2] else math.log((1 - t) / max(1, n - 1))
    for (doc, _, declared, source), row, g in zip(docs, text, of):
        sums = [x * min(1, grams_most / max(1, len(g))) + agree(declared, lang, trust[0]) + math.log(s) for x, lang, s in zip(row, langs, share)]
        for markup, host in places.get(doc, ()):
            prior = smooth(by["host"][host], smooth(by["domain"][up["domain"](host)], share))
            suffix = smooth(by["suffix"][up["suffix"](host)], share)
            for k, lang in enumerate(langs):
                sums[k] += agree(markup, lang, trust[1]) + math.log(prior[k] / share[k]) + math.log(suffix[k] / share[k])
        if not places.get(doc) and source:
            own = smooth(by_source[source], smooth(by_source[source], share))
            sums = [x + math.log(o / s) for x, o, s in zip(sums, own, share)]
        top = max(sums)
        yield langs[sums.index(top)], 1 / sum(math.exp(x - top) for x in sums)


def test_language_against_brute_force(spark):
    """Documents with no page, one and several (two alike), sources, nulls, empty texts and repeated rows."""
    words = {"en": "the house and garden of old man in town".split(), "de": "der alte mann und das haus mit dem garten".split(), "fr": "le vieil homme et la maison avec son jardin".split()}
    rng = np.random.default_rng(2)
    docs, pages = [], []
    for k in range(90):
        lang = ("en", "de", "fr")[k % 3]
        text = " ".join(rng.choice(words[lang], rng.integers(2, 40)))
        docs.append((k, text, None if k % 7 == 0 else lang if k % 11 else "en", None if k % 13 == 0 else f"s{k % 4}"))
        for j in range(k % 4):
            host = f"{'abc'[(k + j) % 3]}.{('site', 'news')[k % 2]}.{(lang, 'com')[j % 2]}"
            pages.append((k, None if j == 1 else lang, host))
    docs += [(200, None, "de", "s1"), (201, "", None, None), (5, docs[5][1], "de", "s1"), (None, "das haus", None, "s2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    raw = [(i, f"http://{host.upper()}/p/{doc}{'.html' if i % 2 else ''}?x=1", f"<html lang='{m}'>" if m else "<p>") for i, (doc, m, host) in enumerate(pages * 2)]
    web = spark.createDataFrame([*raw, (900, None, None), (901, "nothing", "<html lang=fr>")], "page_id long, url string, html string").repartition(3)
    got = sorted((str(r.doc_id), r.language, round(r.probability, 4), str(r.declared)) for r in language_id.identify(df, web).collect())
    want = sorted((str(d[0]), x, round(p, 4), str(d[2])) for d, (x, p) in zip(docs, slow_languages(docs, pages)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-3 for g, w in zip(got, want))
    alone = sorted((str(r.doc_id), r.language) for r in language_id.identify(df).collect())
    assert alone == sorted((str(d[0]), x) for d, (x, _) in zip(docs, slow_languages(docs, [])))


def test_equal_languages_go_by_name(spark):
    docs = [(k, "abc abd", x, None) for k, x in enumerate(("fr", "de", "fr", "de"))] + [(9, "abc abd", None, None)]
    got = language_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).filter("doc_id = 9").first()
    assert got.language == "de"


# --- near duplicates ------------------------------------------------------------------------------------------------


def slow_print(text, n=3):
    w = text.encode().lower().split()
    s = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def slow_groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_against_brute_force(spark, documents):
    got = rows(queries.op6_simhash(spark, DATA)).set_index("doc_id")
    prints = [slow_print(t) for t in documents.text.fillna("")]
    ids = documents.doc_id.tolist()
    assert [int(got.fingerprint[i], 16) for i in ids] == prints
    linked = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert [got.component_id[i] for i in ids] == [ids[r] for r in slow_groups(len(ids), linked)]


def test_near_links_find_every_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * 2
    prints = {int(b) for b in base} | {0, (1 << 64) - 1}
    for b in base:
        for _ in range(20):
            x = int(b)
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            prints.add(x)
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    got = {frozenset(int(np.int64(x).view(np.uint64)) for x in r) for r in simhash.near_links(df).collect()}
    assert got == want


def test_segments_and_hot_cells_change_no_link(spark):
    """Many fingerprints that share a half, so that their cells are split by the bits beside them."""
    rng = np.random.default_rng(9)
    prints = {int(x) for x in rng.integers(0, 1 << 20, 400)} | {int(x) << 32 | 77 for x in rng.integers(0, 1 << 14, 300)}
    prints |= {p ^ (1 << int(k)) for p, k in zip(list(prints), rng.integers(0, 64, 300))} | {p ^ 0b1011 << int(k) for p, k in zip(list(prints), rng.integers(0, 58, 200))}
    prints = {p & (1 << 64) - 1 for p in prints}
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    for settings in ({}, {"hot_cell": 20}, {"segment_bits": 2}, {"segment_bits": 2, "hot_cell": 5}):
        got = {frozenset(int(np.int64(x).view(np.uint64)) for x in r) for r in simhash.near_links(df, **settings).collect()}
        assert got == want, settings


def test_simhash_edges(odd, none):
    got = rows(simhash.near_duplicates(odd))
    assert len(got) == 8 and set(got[got.doc_id.isin([1, 2, 6])].component_id) == {1}
    assert set(got[got.doc_id.isin([3, 4]) | got.doc_id.isna()].component_id) == {3}
    assert rows(simhash.near_duplicates(none)).empty


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {500: 500, 501: 500}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 10)
    links = [(0, k) for k in range(1, 400)] + [(1000, 1000 - k) for k in range(1, 300)] + [(700, 701), (1000, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: 0 for a, b in links for x in (a, b)}
    monkeypatch.setattr(components, "FEW", 10)
    links = [(2 * k, 2 * k + 2) for k in range(60)] + [(5000, 2 * k + 1) for k in range(500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2 * k: 0 for k in range(61)} | {2 * k + 1: 1 for k in range(500)} | {5000: 1}


def test_near_copies_inside_a_family(spark):
    """Pairs at 0.85 in a family whose other texts, first and last in its buckets, are at 0.66 to one another."""
    frame = [f"frame{k}" for k in range(240)]

    def text(doc, pair=None):
        shared = [f"pair{pair}x{k}" for k in range(36)] if pair is not None else [f"own{doc}y{k}" for k in range(36)]
        return " ".join(frame + shared + [f"doc{doc}z{k}" for k in range(24)])

    texts = {k: text(k) for k in [*range(60), *range(1000, 1060)]}
    texts |= {500 + 2 * p + k: text(500 + 2 * p + k, p) for p in range(40) for k in range(2)}
    sets = {d: set(simhash.shingle_hashes(t, 5)) for d, t in texts.items()}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near == {(500 + 2 * p, 501 + 2 * p) for p in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert groups_of(near_copies.near_copy_groups(df)) == {d: d - (d % 2 if 500 <= d < 580 else 0) for d in texts}


def groups_of(df):
    """The smallest doc_id of each document's group."""
    got = rows(df)
    return dict(zip(got.doc_id, got.groupby("root").doc_id.transform("min")))


def test_near_copies_against_brute_force(spark, documents):
    texts, ids = documents.text.fillna("").tolist(), documents.doc_id.tolist()
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    roots = slow_groups(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if alike(sets[a], sets[b])])
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert groups_of(near_copies.near_copy_groups(df)) == {ids[k]: ids[r] for k, r in enumerate(roots)}
    kept = rows(near_copies.drop_near_copies(df))
    assert sorted(kept.doc_id) == sorted({ids[r] for r in roots}) and list(kept.columns) == df.columns
    assert set(kept.text.fillna("")) <= set(texts)


def test_one_row_of_each_group_stays(spark):
    """Ids that stand for several texts, null ids, repeated rows, and columns that are called like the operator's own."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    data = [(7, a, 1), (7, b, 2), (7, a, 0), (8, a.upper() + " end", 3), (None, b, 4), (None, c, 6), (None, c, 5), (9, "", 7), (10, None, 8)]
    df = spark.createDataFrame(data, "doc_id long, text string, root long").withColumn("near_id", F.lit("x")).repartition(3)
    got = sorted((str(r.doc_id), r.text, r.root) for r in near_copies.drop_near_copies(df).collect())
    assert got == sorted([("7", a, 0), ("7", b, 2), ("None", c, 5), ("9", "", 7)])
    assert rows(near_copies.drop_near_copies(df.filter("false"))).empty


# --- decontamination ------------------------------------------------------------------------------------------------


def slow_spans(text, items, width=10):
    w, hit, found = common.words_of(text), set(), set()
    for item, t in items:
        own = common.words_of(t or "")
        n = min(width, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(item))
    return hit, found


def test_decontamination_against_brute_force(spark, documents):
    got = rows(queries.op7_decontamination(spark, DATA)).set_index("doc_id")
    b = pd.read_parquet(f"{DATA}/benchmark.parquet")
    for doc, text in zip(documents.doc_id, documents.text.fillna("")):
        hit, found = slow_spans(text, list(zip(b.item_id, b.text)))
        r = got.loc[doc]
        assert (r.n_words, r.n_hit, r.n_items) == (len(common.words_of(text)), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_index_on_random_texts():
    rng = np.random.default_rng(4)
    for _ in range(30):
        text = rng.integers(0, 4, rng.integers(1, 200))
        index = decontaminate.FMIndex(text)
        patterns = rng.integers(1, 6, (20, 3))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            want = [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_blocks_of_items_give_the_same(spark, odd, none):
    texts = [(1, f"a b {LONG} c d"), (2, "short item here"), (3, None), (2, "short item here"), (4, "alpha beta two three"), (4, "alpha beta two four"), (None, LONG), (None, "x y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = [("x", LONG), ("y", "short item here"), ("z", None), ("w", LONG[4:]), ("x", LONG), ("v", "alpha beta"), ("u", "two three"), ("v", "four"), (None, "x y")]
    items = spark.createDataFrame(items, "item_id string, text string")

    def results(**settings):
        got = rows(decontaminate.digest(decontaminate.contaminated_spans(docs, items, **settings)))
        return sorted(map(str, got.itertuples(index=False)))

    one = results()
    assert len(one) == 8 and all(results(block_bytes=n) == one for n in (1, 20, 70))
    got = rows(decontaminate.digest(decontaminate.contaminated_spans(docs, items, block_bytes=1)))
    assert sorted(got[got.doc_id == 4].n_hit) == [3, 4] and sorted(got[got.doc_id == 4].n_items) == [1, 2]
    assert got[got.doc_id == 1].n_hit.item() == 14 and got[got.doc_id == 1].n_items.item() == 2
    for n in (16_000_000, 1):
        clean = rows(decontaminate.without_contamination(docs, items, block_bytes=n))
        assert clean[clean.doc_id == 1].text.item().split() == ["a", "b", "c", "d"] and 2 not in set(clean.doc_id) and 3 in set(clean.doc_id)
        assert [t.split() for t in clean[clean.doc_id == 4].text] == [["two"]]
    assert len(rows(decontaminate.contaminated_spans(odd, items))) == 8
    assert rows(decontaminate.contaminated_spans(none, items)).empty
    assert not rows(decontaminate.digest(decontaminate.contaminated_spans(odd, items.filter("false")))).contaminated.any()


# --- top k ----------------------------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[100:150] = v[7]  # ties
    data = [(i, [float(x) for x in v[i]]) for i in range(700)]
    data += [(700, None), (750, [float("nan")] * 8), (800, [1.0, None] * 4), (None, [1.0] * 8), (850, []), (900, [1.0, 2.0]), (901, [3.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = rows(topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, query_block=5, seed_rows=70))
    again = rows(topk.top_k(df, F.col("vec_id") % 50 == 0))
    order = ["query_id", "rank"]
    assert got.sort_values(order).values.tolist() == again.sort_values(order).values.tolist()
    whole = np.floor(v.astype(float) * 256)
    for q in range(0, 700, 50):
        s = whole @ whole[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == best and own.score.tolist() == s[best].astype(int).tolist()
    assert got[got.query_id == 900][["vec_id", "score"]].values.tolist() == [[901, 256 * 3 * 256 + 512 * 256]]
    assert not set(got.query_id) & {700, 750, 800, 850}
    assert rows(topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0)).empty


def test_rows_of_one_id_are_rows_like_others(spark):
    data = [(0, [2.0, 1.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0]), (2, [5.0, -1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=2, scale=1).collect())
    assert got == [(0, 1, 2, 9), (0, 1, 2, 15), (0, 2, 0, 6), (0, 2, 0, 6)]


# --- URLs -----------------------------------------------------------------------------------------------------------


def test_url_verdicts(spark):
    urls = [
        ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("HTTP://Example.ORG/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://other.org/en/1", "other.org", "/en/1", "org/", "allow"),
        ("http://notexample.org/es/1#f", "notexample.org", "/es/1", "org/", "allow"),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("http://org", "org", "", None, None),
        ("a://b?c://d/e", "b", "", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    df = spark.createDataFrame([(k, u[0], "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(df, queries.URL_RULES).orderBy("page_id").collect()
    for r, (url, host, path, rule, verdict) in zip(got, urls):
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert url_filter.split_url(url) == (host, path)
    assert rows(url_filter.judge(df.filter("false"), queries.URL_RULES)).empty


def slow_url_score(model, host, path):
    total, n = 0.0, 0
    for seed, part in ((1, host), (2, path)):
        data = b"^" + part.encode() + b"$"
        for size in (3, 4, 5):
            for k in range(len(data) - size + 1):
                code = seed * 16 + size
                for byte in data[k : k + size]:
                    code = (code * 257 + byte) % 2**64
                total += float(model.weights[(code * 0x9E3779B97F4A7C15 % 2**64) >> 48])
                n += 1
    return model.bias + total / math.sqrt(max(1, n))


def test_url_scores_against_brute_force(spark):
    """Every page of the table that no rule decides, by a plain sum over its n-grams, and odd addresses."""
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    model = url_filter.default_model()
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x://"), (-4, "http://é.net/ü" * 2000), (-5, "http://A.net")], "page_id long, url string")
    urls = dict(zip(pages.page_id, pages.url)) | {r.page_id: r.url for r in odd.collect()}
    got = url_filter.judge(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").unionByName(odd), queries.URL_RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = (urls[r.page_id] or "").split("://", 1)[1] if "://" in (urls[r.page_id] or "") else ""
        rest = rest.split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        assert (r.host, r.path) == (host, slash + path)
        fits = [(len(h + p), f"{h}{p}", v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
        if fits:
            assert (r.rule, r.verdict, r.score) == (*max(fits)[1:], None)
        else:
            score = slow_url_score(model, host, slash + path)
            assert r.rule is None and abs(r.score - score) < 1e-4 and r.verdict == ("block" if r.score >= 0 else "allow")


def test_url_model_is_the_regression():
    """A few rounds of the fit, in plain Python."""
    urls, blocked = ["http://ads.net/x", "http://news.org/a", "b://pills.com"], [1, 0, 1]
    model = url_filter.fit(urls, blocked, rounds=5, rate=0.7, l2=0.01)
    slow = url_filter.UrlModel(np.zeros(1 << url_filter.BITS), 0.0)
    found = [url_filter.grams([h.encode()], [p.encode()])[0] for h, p in map(url_filter.split_url, urls)]
    for _ in range(5):
        p = [1 / (1 + math.exp(-slow_url_score(slow, *url_filter.split_url(u)))) for u in urls]
        gradient = np.zeros(len(slow.weights))
        for x, y, own in zip(p, blocked, found):
            for g in own:
                gradient[g] += (x - y) / 3 / math.sqrt(len(own))
        slow.weights = slow.weights - 0.7 * (gradient + 0.01 * slow.weights)
        slow.bias -= 0.7 * sum(x - y for x, y in zip(p, blocked)) / 3
    assert np.allclose(model.weights, slow.weights, atol=1e-6) and abs(model.bias - slow.bias) < 1e-9


def test_url_model_on_words_held_out():
    """The default table without a fifth of the words, judged on the addresses of those words."""
    urls, blocked = url_filter.labelled_addresses()
    words = url_filter.BLOCK_WORDS + url_filter.ALLOW_WORDS
    right = wrong = missed = 0
    for fold in range(5):
        held = [any(w in u for w in words[fold::5]) for u in urls]
        model = url_filter.fit([u for u, h in zip(urls, held) if not h], [y for y, h in zip(blocked, held) if not h])
        own = [(url_filter.split_url(u), y) for u, y, h in zip(urls, blocked, held) if h]
        scores = model.scores([p[0].encode() for p, _ in own], [p[1].encode() for p, _ in own])
        right += sum(s >= 0 for s, (_, y) in zip(scores, own) if y)
        missed += sum(s < 0 for s, (_, y) in zip(scores, own) if y)
        wrong += sum(s >= 0 for s, (_, y) in zip(scores, own) if not y)
    assert right > 1.5 * missed and wrong < 0.02 * len(urls)


def test_url_model_on_unseen_addresses():
    m = url_filter.default_model()
    bad = ["http://m.ads-track.example.test/en/40021", "https://www.casino-king.test/bonus", "http://cheap-pills-now.test/order"]
    good = ["https://blog.gardenlife.test/en/13278", "http://news.cityjournal.test/de/14759", "https://wiki.trains.test/article/3"]
    parts = [url_filter.split_url(u) for u in bad + good]
    scores = m.scores([h.encode() for h, _ in parts], [p.encode() for _, p in parts])
    assert (scores[:3] > 0).all() and (scores[3:] < 0).all()


# --- secrets --------------------------------------------------------------------------------------------------------


def test_base_spans():
    text = "é Password: 'abcdef' token=ab secret=token=xyz123 AKIA123 AKIA" + "A1" * 9 + " " + "0a" * 13 + " zz" + "f" * 23
    got = [(k, text[a:b]) for a, k, b in secret_scan.base_spans(text)]
    assert got == [(0, "Password: 'abcdef"), (0, "secret=token=xyz123"), (1, "AKIA" + "A1" * 9), (2, "0a" * 13)]


def test_linking(spark, odd, none):
    token = "aB3" * 8
    docs = [
        (1, f"user: alice01 {token} https://db.example.test/x"),
        (2, f"just {token} alone"),
        (3, f"user: alice01 {'x ' * 400} {token}"),
        (4, "see https://db.example.test/x only"),
        (5, "password=hunter22 login=bob77 https://db.example.test/x"),
    ]
    got = rows(secret_scan.secrets(spark.createDataFrame(docs, "doc_id long, text string"))).set_index("doc_id")
    kinds = {i: [x.split(":")[0] for x in s.split(",") if x] for i, s in got.spans.items()}
    assert kinds == {1: ["user", "token", "endpoint"], 2: [], 3: [], 4: [], 5: ["assign", "user", "endpoint"]}
    assert got.n_assign[5] == 1 and got.base_sha256[5] == hashlib.sha256(b"assign:0:17").hexdigest()
    edge = rows(secret_scan.secrets(odd))
    assert len(edge) == 8 and (edge.spans == "").all() and rows(secret_scan.secrets(none)).empty


def slow_base(text):
    """(start, kind, end) of the sure parts, character by character."""
    out, i, n = [], 0, len(text)
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    while i < n:
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if lower.startswith(w, i)), None)
        k = i + len(word) if word else n
        if k < n and text[k] in "\"'":
            k += 1
        while k < n and text[k] == " ":
            k += 1
        if k < n and text[k] in ":=":
            k += 1
            while k < n and text[k] == " ":
                k += 1
            if k < n and text[k] in "\"'":
                k += 1
            end = k
            while end < n and text[end] in alnum + "+/_.=-":
                end += 1
            if end > k:
                if end - k >= 6:
                    out.append((i, 0, end))
                i = end
                continue
        i += 1
    for kind, letters, least in ((1, alnum[:26] + alnum[52:], 20), (2, "abcdef0123456789", 24)):
        i = 0
        while i < n:
            if text[i] not in letters or (kind == 1 and not text.startswith("AKIA", i)):
                i += 1
                continue
            end = i
            while end < n and text[end] in letters:
                end += 1
            if end - i >= least:
                out.append((i, kind, end))
            i = end
    return sorted(out)


def test_secrets_against_a_scan_by_hand(spark, documents):
    got = rows(queries.op10_secret_scan(spark, DATA)).set_index("doc_id")
    for doc, text in zip(documents.doc_id, documents.text.fillna("")):
        base = slow_base(text)
        n = Counter(k for _, k, _ in base)
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        r = got.loc[doc]
        assert (r.n_assign, r.n_access, r.n_hex) == (n[0], n[1], n[2])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_linking_against_every_pair(spark):
    """Random texts of parts and fillers; a weak part counts by the roles of all parts near it, looked at one by one."""
    rng = np.random.default_rng(4)
    parts = ["user: alice01 ", "login=bob77 ", "aB3" * 8 + " ", "https://db.example.test/x ", "password=hunter22 ", "AKIA" + "B7" * 10 + " ", "0a" * 14 + " ", "é " * 40, "x " * 90, "\n" * 60]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(150)]
    role = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "endpoint": "endpoint", "token": "secret"}
    kinds = list(role)
    got = rows(secret_scan.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))).set_index("doc_id")
    some = 0
    for doc, text in enumerate(texts):
        base = slow_base(text)
        weak = [s for s in secret_scan.weak_spans(text, base)]
        want = list(base)
        for a, k, b in weak:
            near = {role[kinds[k2]] for a2, k2, b2 in base + weak if a2 - 200 <= a <= b2 + 200 and role[kinds[k2]] != role[kinds[k]]}
            if (kinds[k] == "token" and "identifier" in near) or (kinds[k] == "user" and "secret" in near) or (kinds[k] == "endpoint" and {"identifier", "secret"} <= near):
                want.append((a, k, b))
                some += 1
        assert got.spans[doc] == ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(want)), text
    assert some > 200
