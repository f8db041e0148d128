"""Structure repair, spelling variants and the n-gram Jaccard join against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslog.llm import bloom, parity, queries, spelling, turns
from opslog.llm.simhash import shingle_hashes

DATA = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# --- conversations ------------------------------------------------------------------------------------------------------------------

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAME = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, turns) by trying every edit of every row, the least (cost, audit) for each state; rows: (role, text, fault)."""

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, t) in list(out.items()):
                for r in "ua":
                    if r in NEXT[s]:
                        new = (c + 2, a + "I", [*t, (NAME[r], "")])
                        if NEXT[s][r] not in out or new[:2] < out[NEXT[s][r]][:2]:
                            out[NEXT[s][r]] = new
        return out

    states = {0: (0, "", [])}
    for role, text, fault in rows:
        reached = defaultdict(list)
        # the cheapest way to a state before a row may pass through insertions, so all of them are kept here
        every = [(s, v) for s, v in states.items()]
        for s, (c, a, t) in list(every):
            front = [(s, (c, a, t))]
            for _ in range(2):
                front = [(NEXT[x][r], (v[0] + 2, v[1] + "I", [*v[2], (NAME[r], "")])) for x, v in front for r in "ua" if r in NEXT[x]]
                every += front
        for s, (c, a, t) in every:
            reached[s].append((c + 3, a + "D", t))
            if fault in ("", "truncated"):
                extra = int(fault == "truncated")
                if role[:1] in NEXT[s]:
                    reached[NEXT[s][role[:1]]].append((c + extra, a + "K", [*t, (role, text)]))
                for r in "ua":
                    if r in NEXT[s]:
                        reached[NEXT[s][r]].append((c + 2 + extra, a + "R", [*t, (NAME[r], text)]))
        states = {s: min(v, key=lambda x: x[:2]) for s, v in reached.items()}
    ends = inserted(states)
    return min((ends[s] for s in (0, 3) if s in ends), key=lambda x: x[:2])


def slow_repair(rows):
    """The digest of one conversation; rows: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, kept = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults)]) if rows else (0, "", [])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def digests(rows, spark, **settings):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"cost": F.lit("x"), "place": F.lit(1)}).repartition(3)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turns.digest(turns.repair(df, **settings), df).collect()}


def drawn(seed, n_conversations, most):
    rng, rows = random.Random(seed), []
    for conv in range(n_conversations):
        for turn in sorted(rng.sample(range(3 * most), rng.randint(1, most))):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["one.", "two", " \t", "three!", "x?", "", f"t{rng.randint(0, 9)}."])))
    return rows


@pytest.mark.parametrize("settings", [{}, {"rounds": 1, "rules": 3}, {"rounds": 12, "rules": 5}])
def test_repair_against_brute_force(spark, settings):
    rows = drawn(1, 60, 14)
    got = digests(rows, spark, **settings)
    for conv in range(60):
        assert got[conv] == slow_repair([r[1:] for r in rows if r[0] == conv]), conv


def test_a_conversation_of_many_pieces(spark, monkeypatch):
    """Pieces of eight rows: one conversation has hundreds, and is cut between partitions as well."""
    monkeypatch.setattr(turns, "PIECE_BITS", 3)
    rng = random.Random(2)
    long_ = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", " ", "again."])) for t in range(1500)]
    got = digests([*long_, *drawn(3, 5, 9)], spark)
    assert got[7] == slow_repair([r[1:] for r in long_])
    assert all(got[k] == slow_repair([r[1:] for r in drawn(3, 5, 9) if r[0] == k]) for k in range(5))


def test_conversations_of_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "a."), (1, 5, "assistant", "b."), (1, 5, "assistant", "b."), (None, 1, None, None), (None, None, "user", "q?"), (2, None, None, "")]
    got = digests(rows, spark)
    assert got[1] == slow_repair([(None, "user", "a."), (5, "assistant", "b."), (5, "assistant", "b.")]) and got[1][6] == "KKD"
    assert got[None] == slow_repair([(None, "user", "q?"), (1, " ", " ")])
    assert got[2] == slow_repair([(None, " ", "")]) and got[2][:2] == (0, 1)
    assert digests([], spark) == {}
    edited = turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    left = sorted((r.conv_id or 0, r.place, r.step, r.role, r.text) for r in turns.repaired_turns(edited).collect())
    assert [x[3:] for x in left if x[0] == 1] == [("user", "a."), ("assistant", "b.")]


def test_damage(spark):
    rows = [(c, t, r, x) for c in (0, 1, None) for t in (*range(40), None) for r, x in [("assistant", "a.b!c? d")]]
    got = defaultdict(list)
    for r in turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, "abc d")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(code, [(role, text)])
        assert got[c, t] == want


def test_every_original_conversation_is_there(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    gone = turns.digest(turns.repair(df.filter("conv_id > 3")), df).filter("conv_id <= 3").collect()
    assert len(gone) == df.filter("conv_id <= 3").select("conv_id").distinct().count()
    assert {tuple(r[c] for c in COLUMNS) for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_rules_share_their_matrices():
    """A rule's matrix is that of the symbols below it, and encoding keeps every symbol."""
    grammar = turns.Grammar()
    rng = random.Random(4)
    strings = ["".join(rng.choice("uuaaAsbd") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    plain = turns.Grammar()
    for _ in range(4):
        now, of = grammar.encode(strings)
        code, inside = turns.pair_codes(now, of)
        top = [c for c, n in Counter(code[inside].tolist()).most_common(9) if n > 1]
        grammar.add(np.array(top))
    now, of = grammar.encode(strings)
    assert len(now) < 0.6 * sum(map(len, strings))
    spell = lambda s: turns.SYMBOLS[s] if s < len(turns.SYMBOLS) else "".join(spell(int(x)) for x in grammar.parts[s])
    assert ["".join(spell(int(s)) for s in now[of == k]) for k in range(len(strings))] == strings
    a, b = grammar.matrices(now, of, len(strings)), plain.matrices(*plain.encode(strings), len(strings))
    assert (a[0] == b[0]).all()
    reached = a[0] < turns.NEVER
    assert (np.where(reached, a[1], -1).argmax(-1) == np.where(reached, b[1], -1).argmax(-1)).all()


# --- spelling -------------------------------------------------------------------------------------------------------------------------


def slow_spelling(docs, every):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    known = {w: n for w, n in counts.items() if n >= 3}
    near = defaultdict(set)
    for a in known:
        for b in known:
            if a < b and abs(len(a) - len(b)) <= 1:
                short, long_ = sorted((a, b), key=len)
                one = any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_))) if len(a) != len(b) else sum(x != y for x, y in zip(a, b)) == 1
                if one:
                    near[a].add(b)
                    near[b].add(a)
    out = {}
    for w, n in known.items():
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form = best if best and known[best] >= 2 * n else None
        out[w] = (form, n, len(near[w]), known.get(form))
    roots = {}
    for w in known:
        at = w
        while out[at][0]:
            at = out[at][0]
        roots[w] = at
    return {w: (form, roots[w], *rest) for w, (form, *rest) in out.items()}


def spelled(df, **settings):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(df, **settings).collect()}


def test_spelling_against_brute_force(spark):
    rng = random.Random(5)
    base = ["lantern", "grüßen", "École", "banana", "aaaaaa", "windmill", "w×rter", "z" * 40]
    docs = []
    for k in range(300):
        words = []
        for _ in range(20):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e", "ü", "Z"])
            words.append("".join(w))
        docs.append((k if k % 17 else None, " ".join(words) + rng.choice(["", "\n", "1中-x"])))
    docs += [(900, None), (901, ""), (902, "tower " * 5000), (902, "tower"), (903, "towerłtower T0WER ab cd")]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(4)
    for every in (None, 7):
        assert spelled(df, slip_every=every) == slow_spelling(docs, every)
    assert spelled(df.filter("false")) == {} and spelled(spark.createDataFrame([(1, "ab")], "doc_id long, text string")) == {}


def test_a_vocabulary_in_parts(spark, monkeypatch):
    rows = [(f"word{a}{b}", 10 + (a == "a")) for a in "abcdefgh" for b in "stuvwxyz"] + [("wordz", 3), ("wordzz", 9)]
    words = spark.createDataFrame(rows, "word string, n long")
    whole = {(min(r.a, r.b), max(r.a, r.b)) for r in spelling.near_words(words).collect()}
    parts = [(min(r.a, r.b), max(r.a, r.b)) for r in spelling.near_words(words, most_filtered=20).collect()]
    assert len(parts) == len(set(parts)) and set(parts) == whole and len(whole) > 400


def test_filters_hold_their_keys_within_their_bytes(spark):
    rng = np.random.default_rng(6)
    keys = rng.integers(-(1 << 63), 1 << 63, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"shard": (np.arange(20_000) % 3).astype(np.int32), "h": keys}))
    f = bloom.bloom_of(df)
    held = np.concatenate([f.holds(s, keys[s::3].view(np.uint64)) for s in range(3)])
    others = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert held.all() and f.holds(1, others).mean() < 0.02 and not f.holds(9, others).any()
    small = bloom.bloom_of(df, most_bytes=8192)
    assert small.words.nbytes <= 8192 + 3 * 8 * bloom.LEAST_BLOCKS and small.holds(0, keys[::3].view(np.uint64)).all()
    assert not bloom.bloom_of(df.filter("false")).holds(0, others).any()


# --- n-gram Jaccard -------------------------------------------------------------------------------------------------------------------


def slow_jaccard(docs, percent=85):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(words[k : k + 4]) for k in range(len(words) - 3)) if len(words) > 3 else frozenset([b" ".join(words)] if words else []))
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        r = find(k)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((str(d), len(s), str(least.get(find(k)))) for k, ((d, _), s) in enumerate(zip(docs, sets)))


def families(seed):
    """Groups of texts that differ in a few words each, chains of near texts, and texts with a passage in common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, passage = [], [word() for _ in range(60)]
    for size in (5, 7, 9, 14, 30, 80, 200):
        text = [word() for _ in range(size)]
        for _ in range(14):
            new = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(new))
                new[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            docs.append(" ".join(new))
            if rng.random() < 0.3:
                text = new
    for _ in range(30):
        docs.append(" ".join(passage + [word() for _ in range(rng.randint(5, 60))]))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_against_brute_force(spark, seed):
    texts = families(seed)
    docs = [(k * 3 % 1009, t) for k, t in enumerate(texts)]
    docs += [(5000, None), (5001, ""), (5002, " \t\n"), (None, texts[3]), (None, "only one null"), (5003, "a"), (5004, "A"), (5005, texts[0].upper()), (3, texts[1]), (5006, (texts[60] + " ") * 300)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, node int, keys int").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in parity.jaccard_groups(df).collect())
    assert got == slow_jaccard(docs)


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert parity.jaccard_groups(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, parity.jaccard_groups(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_a_key(percent):
    """The pigeonhole holds for every pair at the very limit, also across bands, and the bit sketch never overestimates."""
    rng, bands = np.random.default_rng(percent), parity.Bands(percent)
    for size in [*range(1, 60), 100, 250, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            more = int(rng.integers(0, len(a) * 100 // percent - len(a) + 1))
            union = len(a) + more
            lost = (union * (100 - percent) // 100) - more
            b = np.unique(np.r_[a[: len(a) - max(0, lost)], rng.integers(0, 1 << 63, more).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if not both or 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            keys = []
            for s in (a, b):
                band = bands.of(np.array([len(s)]))
                keys.append({int(k) for x in (band, band - 1) for k in parity.block_keys(s, np.array([len(s)]), x, bands)[1]})
            assert keys[0] & keys[1], (size, len(b))
            bits = [parity.bit_sketches(s, np.array([len(s)]))[0] for s in (a, b)]
            assert sum(int(x ^ y).bit_count() for x, y in zip(*bits)) <= len(np.setxor1d(a, b))


# --- the queries ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_line_dedup", "op11_structure_repair", "op12_spelling_variants", "op13_ngram_jaccard"])
def test_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = duck.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    plain = lambda df: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).values)
    assert plain(got) == plain(want)
    assert shingle_hashes("", 4) == []
