"""Conversation structure repair: the cheapest edits to a legal order of roles, by dynamic programming over a grammar.

Rows are dealt by conversation and turn, so a long conversation is in many partitions, and cut into pieces of at most PIECE rows.
A piece is a string of symbols, one for each row's role and fault. Frequent pairs of symbols become rules (Re-Pair, many pairs a
round), and each symbol and rule has one transfer matrix over the states of the legal order: the least cost from state to state,
and the rope of its audit, which is the state between its two parts. Matrices of rules are made bottom-up from those of their
parts, once for all conversations; a piece's matrix is the min-plus product of its few symbols' and a conversation's path
follows from its pieces' matrices.

Audits are compared without being written out. Of one symbol string and one start state, audits that end in different states
differ, and as each ends with the letter of the last row, none begins with another. So the audits of a matrix row have a strict
order, kept as ranks, and that of a product follows from the ranks of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_id, quoted, stored

#: Rows of a piece at most: two to this power.
PIECE_BITS = 12

#: Symbols: role initials (x: any other), capital where the row is truncated; b and d: blank and duplicate, which must go.
SYMBOLS = "suaxSUAXbd"

#: States of a legal order (s?(ua)+)?: nothing yet, after s, after u, after a; and what an order may end with.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
#: What is inserted in each state, and what it takes to end there.
FILL = "uuau"
ENDING = ("", "II", "I", "")
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
NEVER = 1 << 40

BLANKS = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


def inserted(state: int, n: int) -> int:
    """The state after n inserted turns."""
    for _ in range(n):
        state = NEXT[FILL[state]][state]
    return state


def _edits(symbol: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, next state) of the edits of one row: up to two insertions before it, then what becomes of it."""
    for n in range(3):
        now, base = inserted(state, n), n * COST["I"]
        yield base + COST["D"], "I" * n + "D", now
        if symbol not in "bd":
            extra = int(symbol.isupper())
            if now in NEXT.get(symbol.lower(), {}):
                yield base + COST["K"] + extra, "I" * n + "K", NEXT[symbol.lower()][now]
            yield base + COST["R"] + extra, "I" * n + "R", NEXT[FILL[now]][now]


def symbol_matrices() -> tuple[np.ndarray, np.ndarray, list[dict[tuple[int, int], str]]]:
    """costs and ranks [symbol, from, to], and the audits of each symbol by states."""
    costs, ranks, audits = np.full((len(SYMBOLS), 4, 4), NEVER), np.zeros((len(SYMBOLS), 4, 4), np.int64), []
    for k, symbol in enumerate(SYMBOLS):
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for i in range(4):
            for cost, audit, j in _edits(symbol, i):
                best[i, j] = min(best.get((i, j), (NEVER, "")), (cost, audit))
            order = sorted(range(4), key=lambda j: best.get((i, j), (0, "~"))[1])
            for j in range(4):
                ranks[k, i, j] = order.index(j)
                costs[k, i, j] = best.get((i, j), (NEVER, ""))[0]
        audits.append({at: audit for at, (_, audit) in best.items()})
    return costs, ranks, audits


def product(a_cost, a_rank, b_cost, b_rank) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """costs, ranks and states between [.., from, to] of two arrays of matrices, a first.

    Of equal costs the least audit wins, which is the one with the least first part, as first parts of different states differ.
    """
    total = a_cost[..., :, :, None] + b_cost[..., None, :, :]
    key = total * 4 + a_rank[..., :, :, None]
    via = key.argmin(axis=-2)
    cost = np.minimum(np.take_along_axis(total, via[..., None, :], -2)[..., 0, :], NEVER)
    rows = np.take_along_axis(a_rank, via, -1) * 4 + np.take_along_axis(b_rank, via, -2)
    return cost, rows.argsort(-1).argsort(-1), via


class Grammar:
    """Rules of pairs of symbols, round by round, with their matrices. Symbols from len(SYMBOLS) on are rules."""

    def __init__(self):
        self.cost, self.rank, self.audits = symbol_matrices()
        self.via = np.zeros(self.cost.shape, np.int64)
        self.parts = np.zeros((len(SYMBOLS), 2), np.int64)
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, pairs: np.ndarray) -> None:
        """A round of rules for pairs (left << 32 | right, all different), whose matrices are products of their parts'."""
        pairs = np.sort(pairs)
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        made = product(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        self.rounds.append((pairs, len(self.parts) + np.arange(len(pairs))))
        self.cost, self.rank, self.via = (np.concatenate(x) for x in zip((self.cost, self.rank, self.via), made))
        self.parts = np.concatenate([self.parts, np.stack([left, right], 1)])

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all strings in turn after all rounds, and each one's string."""
        letters = np.frombuffer("".join(strings).encode(), np.uint8)
        codes = np.zeros(256, np.int64)
        codes[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
        now, of = codes[letters], np.repeat(np.arange(len(strings)), [len(s) for s in strings])
        for pairs, names in self.rounds:
            code, inside = pair_codes(now, of)
            at = np.searchsorted(pairs, code)
            hit = inside & (pairs[np.minimum(at, len(pairs) - 1)] == code)
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place)) if len(hit) else place
            taken = hit & (run % 2 == 1)  # of pairs that overlap, every other one from the left
            now = now.copy()
            now[:-1][taken] = names[at[taken]]
            stays = np.r_[True, ~taken][: len(now)]
            now, of = now[stays], of[stays]
        return now, of

    def matrices(self, now: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """costs and ranks of each of n strings: all strings take their next symbol together."""
        sizes = np.bincount(of, minlength=n)
        first = np.cumsum(sizes) - sizes
        cost, rank = np.full((n, 4, 4), NEVER), np.zeros((n, 4, 4), np.int64)
        cost[:, range(4), range(4)] = 0
        rank[:] = np.arange(4)
        for t in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > t)
            own = now[first[on] + t]
            cost[on], rank[on], _ = product(cost[on], rank[on], self.cost[own], self.rank[own])
        return cost, rank

    def path(self, symbols: list[int], start: int, end: int) -> list[tuple[int, int]]:
        """The states around each symbol of the best way from start to end."""
        cost, rank = np.full(4, NEVER), np.arange(4)
        cost[start] = 0
        back = []
        for s in symbols:
            total = cost[:, None] + self.cost[s]
            via = (total * 4 + rank[:, None]).argmin(0)
            cost = np.minimum(total[via, range(4)], NEVER)
            rank = (rank[via] * 4 + self.rank[s][via, range(4)]).argsort().argsort()
            back.append(via)
        out = []
        for via in reversed(back):
            out.append((int(via[end]), end))
            end = int(via[end])
        return out[::-1]

    def audit(self, symbol: int, i: int, j: int, memo: dict) -> list[str]:
        """The edits of each row of a symbol from state i to j: its rope written out, shared through memo."""
        if symbol < len(SYMBOLS):
            return [self.audits[symbol][i, j]]
        found = memo.get((symbol, i, j))
        if found is None:
            k = int(self.via[symbol, i, j])
            found = self.audit(int(self.parts[symbol, 0]), i, k, memo) + self.audit(int(self.parts[symbol, 1]), k, j, memo)
            memo[symbol, i, j] = found
        return found


def pair_codes(now: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """left << 32 | right of each two neighbours, and whether both are of one string."""
    return (now[:-1] << 32) | now[1:], of[:-1] == of[1:]


def learn(pieces: DataFrame, *, rounds=8, rules=1024) -> Grammar:
    """Re-Pair over the distinct strings of pieces.symbols, weighed by their pieces: each round makes rules of the most frequent pairs.

    At most `rules` pairs a round reach the driver, and a rule spans at most 2^rounds rows; what has no rule stays as it is, so the
    bounds cost sharing and never results.
    """
    strings = stored(pieces.groupBy("symbols").agg(F.count("*").alias("n")), "strings")
    grammar = Grammar()
    spark = pieces.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(grammar)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                now, of = shared.value.encode(batch.column(0).to_pylist())
                code, inside = pair_codes(now, of)
                found, at = np.unique(code[inside], return_inverse=True)
                n = np.bincount(at, weights=batch.column(1).to_numpy()[of[:-1][inside]], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

        counts = strings.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        top = counts.orderBy(F.desc("n"), "pair").limit(rules).toArrow().column(0).to_numpy()
        if not len(top):
            break
        grammar.add(top)
    return grammar


def deal(rows: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id, turn, role, text, place, kind: the rows in order of conversation and turn, stored with their places.

    Null turns come first; rows of one turn are in the order of role, first 64 code points and hash of the text. Places rise with
    that order, with gaps between partitions. kind: the row's symbol but for duplicates.
    """
    own = rows.select(
        long_id(rows, conv_id).alias("conv_id"), long_id(rows, turn).alias("turn"),
        F.coalesce(quoted(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(quoted(text).cast("string"), F.lit(" ")).alias("text"),
    )
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    kind = F.when(trimmed == "", "b").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), known).otherwise(F.upper(known))
    marked = own.withColumns({"kind": kind, "_head": F.left("text", F.lit(64)), "same": F.md5("text"), "_row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_head", "same", "_row"]
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(placed.drop("_head", "_row"), "turns")


def cut(dealt: DataFrame) -> DataFrame:
    """conv_id, at, symbols: pieces of the conversations. at: the place of a piece's first row; its rows' places follow one another.

    A row is a duplicate unless its place is the least of its conversation, role and text. Those places are put beside the rows
    in blocks of 2^PIECE_BITS places, so that nothing is dealt by conversation.
    """
    firsts = dealt.filter("kind <> 'b'").groupBy("conv_id", "role", "same").agg(F.min("place").alias("place"))
    rows = dealt.select("place", F.lit(1).alias("is_row"), "conv_id", F.col("conv_id").isNull().alias("no_id"), "kind")
    both = rows.unionByName(firsts.select("place", F.lit(0).alias("is_row")), allowMissingColumns=True)
    block = F.shiftright("place", PIECE_BITS).alias("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_at = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            place, is_row = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 1
            new = np.r_[first_at, np.where(is_row[:-1], -1, place[:-1])] == place
            first_at = -1 if is_row[-1] else int(place[-1])
            rows = np.flatnonzero(is_row)
            if not len(rows):
                continue
            own, ids = place[rows], batch.column(2).take(pa.array(rows))
            code = np.frombuffer("".join(batch.column(4).take(pa.array(rows)).to_pylist()).encode(), np.uint8)
            code = np.where(new[rows] | (code == ord("b")), code, ord("d")).astype(np.uint8)
            key, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            starts = np.r_[True, (key[1:] != key[:-1]) | (none[1:] != none[:-1]) | (own[1:] != own[:-1] + 1) | (own[1:] >> PIECE_BITS != own[:-1] >> PIECE_BITS)]
            at = np.flatnonzero(starts)
            letters = code.tobytes().decode()
            strings = [letters[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(letters)])]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(own[at]), pa.array(strings)], names=["conv_id", "at", "symbols"])

    dealt_out = both.repartition(block).sortWithinPartitions("place", "is_row")
    return dealt_out.select("place", "is_row", "conv_id", "no_id", "kind").mapInArrow(run, "conv_id long, at long, symbols string")


def _small(values: np.ndarray, kind) -> pa.Array:
    flat = values.reshape(len(values), -1)
    ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(flat.reshape(-1).astype(kind)))


def _roles(edit: str, symbol: str, state: int) -> tuple[str, int]:
    """The role initials that a row's edits leave, - for a deleted row, and the state after them."""
    out = ""
    for letter in edit:
        if letter == "D":
            out += "-"
        else:
            role = symbol.lower() if letter == "K" else FILL[state]
            out, state = out + role, NEXT[role][state]
    return out, state


def edits(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """place, symbol, edit, roles: what becomes of each row: letters of edits and, of equal length, the role initials they leave.

    Each piece has its matrix first. Then the pieces of a conversation are read twice in order, from the last to find the best way
    on from each state, and from the first to follow it; both carry one state, whatever the number of pieces.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 2000) for k in range(0, whole.num_rows, 2000)):
                cost, rank = shared.value.matrices(*shared.value.encode(batch.column(2).to_pylist()), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, _small(cost, np.int64), _small(rank, np.int8)], names=[*batch.schema.names, "cost", "rank"])

    def look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ahead = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            costs, ranks = (batch.column(c).flatten().to_numpy().astype(np.int64).reshape(-1, 4, 4) for c in (3, 4))
            go, last = np.zeros((len(ids), 4), np.int8), []
            for k, conv in enumerate(ids):
                last.append(key is None or key[0] != conv)
                if last[-1]:
                    key, ahead = (conv,), np.array([COST["I"] * len(x) for x in ENDING])
                total = costs[k] + ahead
                go[k] = (total * 4 + ranks[k]).argmin(1)
                ahead = np.minimum(total.min(1), NEVER)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _small(go, np.int8), pa.array(last, pa.bool_())], names=["conv_id", "at", "symbols", "go", "last"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, memo, rules = None, START, {}, shared.value
        for batch in batches:
            ids, at, strings, last = (batch.column(c).to_pylist() for c in (0, 1, 2, 4))
            go = batch.column(3).flatten().to_numpy().reshape(-1, 4)
            now, of = rules.encode(strings)
            ends = np.cumsum(np.bincount(of, minlength=len(ids)))
            places, symbols, made, left = [], [], [], []
            for k, conv in enumerate(ids):
                if key is None or key[0] != conv:
                    key, state = (conv,), START
                own, start = now[ends[k - 1] if k else 0 : ends[k]].tolist(), state
                state = int(go[k, state])
                rows = [e for s, (i, j) in zip(own, rules.path(own, start, state)) for e in rules.audit(s, i, j, memo)]
                if last[k]:
                    rows[-1] += ENDING[state]
                for symbol, edit in zip(strings[k], rows):
                    roles, start = _roles(edit, symbol, start)
                    left.append(roles)
                places.append(np.arange(at[k], at[k] + len(rows)))
                symbols.extend(strings[k])
                made.extend(rows)
                if len(memo) > 20_000:
                    memo.clear()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(symbols), pa.array(made), pa.array(left)], names=["place", "symbol", "edit", "roles"])

    base = "conv_id long, at long, symbols string"
    measured = pieces.mapInArrow(measure, f"{base}, cost array<long>, rank array<tinyint>").repartition("conv_id")
    back = measured.sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(look_back, f"{base}, go array<tinyint>, last boolean")
    return back.sortWithinPartitions("conv_id", "at").mapInArrow(follow, "place long, symbol string, edit string, roles string")


def repair(rows: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text", rounds=8, rules=1024) -> DataFrame:
    """conv_id, turn, role, text, place, symbol, edit, roles: every row with its fault and the edits that repair its conversation.

    Faults: blank, duplicate (role and text seen earlier in the conversation), truncated; the first that holds counts. Edits: Keep
    (free), Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go), Insert an empty user or assistant turn
    anywhere (2); a truncated row that stays adds 1. The role initials left are (s?(ua)+)?. Of the cheapest ways, the one whose
    letters are ASCII-least is taken. Insertions stand before the row they are listed with, or after the conversation's last row.

    Null roles and texts are one space; a null conv_id is one more conversation; rows without a turn come first. A role without
    letters fits nowhere and is reroled or deleted. Other columns are not carried; an empty table gives an empty result.
    """
    dealt = deal(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    pieces = stored(cut(dealt), "pieces")
    found = edits(pieces, learn(pieces, rounds=rounds, rules=rules))
    return dealt.select("conv_id", "turn", "role", "text", "place").join(found, "place")


def repaired_turns(edited: DataFrame) -> DataFrame:
    """conv_id, place, step, role, text: the turns of the repaired conversations, in the order of place and step."""
    letters = edited.select("*", F.posexplode(F.split("edit", "")).alias("step", "letter")).filter("letter <> '' AND letter <> 'D'")
    initial = F.substring("roles", F.col("step") + 1, F.lit(1))
    named: Column = F.when(F.col("letter") == "K", F.col("role"))
    for k, name in NAMES.items():
        named = named.when(initial == k, name)
    return letters.select("conv_id", "place", "step", named.alias("role"), F.when(F.col("letter") == "I", "").otherwise(F.col("text")).alias("text"))


class _Tally:
    """One conversation's figures while its rows go by."""

    def __init__(self):
        self.turns, self.least, self.most, self.distinct = None, None, None, 0
        self.faults, self.illegal, self.cost, self.before = {"b": 0, "d": 0, "t": 0}, 0, 0, None
        self.audit, self.sha, self.started = [], hashlib.sha256(), False

    def add(self, turn, role: str, text: str, symbol: str, edit: str, roles: str) -> None:
        if turn is not None:
            self.distinct += self.most is None or turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        fault = symbol if symbol in "bd" else "t" if symbol.isupper() else ""
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.audit.append(edit)
        for letter, new in zip(edit, roles):
            self.cost += COST[letter] + (fault == "t" and letter in "KR")
            if letter != "D":
                line = f"{role if letter == 'K' else NAMES[new]}:{'' if letter == 'I' else text}"
                self.sha.update((("\n" if self.started else "") + line).encode("utf-8", "surrogatepass"))
                self.started = True

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def digest(edited: DataFrame, conversations: DataFrame, *, conv_id="conv_id") -> DataFrame:
    """One row for each conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation are read in order once, with counters and a running hash. A SHA-256 has no parts, so one task reads
    all texts of a conversation here, in constant memory but for the audit, which the result holds; repair itself does not.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tally, done = None, None, []

        def rows() -> pa.RecordBatch:
            ids, figures = [d[0] for d in done], list(zip(*(d[1] for d in done)))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(f, k) for f, k in zip(figures, kinds))], names=["conv_id", *names])
            done.clear()
            return out

        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if key is None or key[0] != conv:
                        if key is not None:
                            done.append((key[0], tally.row()))
                        key, tally = (conv,), _Tally()
                    tally.add(*row)
                if len(done) >= 1000:
                    yield rows()
        if key is not None:
            done.append((key[0], tally.row()))
        if done:
            yield rows()

    ordered = edited.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "turn", "role", "text", "symbol", "edit", "roles")
    made = ordered.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    every = conversations.select(long_id(conversations, conv_id).alias("conv_id")).distinct()
    own = made.withColumnRenamed("conv_id", "_conv")
    joined = every.join(own, every["conv_id"].eqNullSafe(own["_conv"]), "left")
    zero = {**{c: 0 for c in names[:6]}, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.drop("_conv").fillna(zero, list(zero))


def damaged(rows: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id, turn, role, text with planted faults, by the crc32 of "conv_id:turn" modulo 20: 0 drops a row, 1 empties its text,
    2 takes its [.!?] away, 3 repeats it, 4 makes it a user's. A null is one space, in the checksum too."""
    key = F.concat_ws(":", *(F.coalesce(long_id(rows, c).cast("string"), F.lit(" ")) for c in (conv_id, turn)))
    own = rows.select(
        long_id(rows, conv_id).alias("conv_id"), long_id(rows, turn).alias("turn"), (F.crc32(key.cast("binary")) % 20).alias("_code"),
        F.coalesce(quoted(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(quoted(text).cast("string"), F.lit(" ")).alias("text"),
    )
    code = F.col("_code")
    new_text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    hit = own.withColumns({"text": new_text, "role": F.when(code == 4, "user").otherwise(F.col("role"))})
    return hit.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select("conv_id", "turn", "role", "text")
