"""Forward-backward over linear chains of two tags, all chains of a slice at once and each of them whole.

With two tags a message is one ratio. Chains are laid out in segments that advance side by side, step by step; the product of
a segment's steps carries the messages over it, so that a long chain costs no more per word than a short one.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 256


def _products(odds: np.ndarray, longer: np.ndarray, begins: np.ndarray, step: np.ndarray) -> np.ndarray:
    """[4, segment]: the product of each segment's steps, row by row; a chain begins with its word alone."""
    (s00, s01), (s10, s11) = step
    p = np.zeros((4, odds.shape[1]))
    p[0], p[3] = 1.0, 1.0
    for t, n in enumerate(longer):
        a, b, c, d = p[:, :n]
        o = odds[t, :n]
        new = np.stack([a * s00 + b * s10, (a * s01 + b * s11) * o, c * s00 + d * s10, (c * s01 + d * s11) * o])
        if t == 0:
            one = np.ones(n)
            new = np.where(begins[:n], np.stack([one, o, one, o]), new)
        p[:, :n] = new / new.sum(axis=0)
    return p


def marginals(emission: np.ndarray, sizes: np.ndarray, steps: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(tag 1) of each word of chains that lie one after another, and the expected counts of tag pairs [2, 2] if asked.

    emission: log odds of tag 1 of each word; steps: log potentials of tag pairs [from, to].
    """
    n_words = int(sizes.sum())
    if not n_words:
        return np.zeros(0), np.zeros((2, 2))
    step = np.exp(steps)
    (s00, s01), (s10, s11) = step
    odds = np.exp(np.clip(emission, -30, 30).astype(float))
    each = -(-sizes // SEGMENT)
    base = np.cumsum(each) - each
    chain = np.repeat(np.arange(len(sizes)), each)
    number = np.arange(len(chain)) - base[chain]
    start = (np.cumsum(sizes) - sizes)[chain] + number * SEGMENT
    length = np.minimum(SEGMENT, sizes[chain] - number * SEGMENT)
    order = np.argsort(-length, kind="stable")  # the longest first: those that go on are the first ones
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    start, length, begins, several = start[order], length[order], number[order] == 0, (each > 1)[chain[order]]
    longer = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    of = np.repeat(np.arange(len(length)), length)
    at = np.arange(n_words) - np.repeat(np.cumsum(length) - length, length)
    word = start[of] + at
    grid = np.ones((len(longer), len(length)))
    grid[at, of] = odds[word]

    enter, leave = np.ones(len(length)), np.ones(len(length))  # forward ratio before, backward ratio at the end of a segment
    if several.any():
        own = np.flatnonzero(several)
        column = np.full(len(length), -1)
        column[own] = np.arange(len(own))
        p = _products(grid[:, own], np.searchsorted(own, longer), begins[own], step)
        docs, k = np.flatnonzero(each > 1), 0
        while len(docs := docs[each[docs] > k + 1]):
            here, there = place[base[docs] + k], place[base[docs] + k + 1]
            a, b, c, d = p[:, column[here]]
            enter[there] = (b + enter[here] * d) / (a + enter[here] * c)
            here, there = place[base[docs] + each[docs] - 1 - k], place[base[docs] + each[docs] - 2 - k]
            a, b, c, d = p[:, column[here]]
            leave[there] = (c + leave[here] * d) / (a + leave[here] * b)
            k += 1

    ahead, back = np.empty_like(grid), np.empty_like(grid)
    r = np.where(begins, grid[0], grid[0] * (s01 + s11 * enter) / (s00 + s10 * enter))
    ahead[0] = r
    for t in range(1, len(longer)):
        r = r[: longer[t]]
        r = grid[t, : len(r)] * (s01 + s11 * r) / (s00 + s10 * r)
        ahead[t, : len(r)] = r
    q = leave
    for t in range(len(longer) - 1, -1, -1):
        if t + 1 < len(longer):
            n = longer[t + 1]
            u = grid[t + 1, :n] * q[:n]
            q[:n] = (s10 + s11 * u) / (s00 + s01 * u)
        back[t, : longer[t]] = q[: longer[t]]
    f, g = np.empty(n_words), np.empty(n_words)
    f[word], g[word] = ahead[at, of], back[at, of]
    both = f * g
    if not counts:
        return both / (1 + both), np.zeros((2, 2))
    inner = np.ones(n_words, bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    now = np.flatnonzero(inner)
    on, was = odds[now] * g[now], f[now - 1]
    w = np.stack([np.full(len(now), s00), s01 * on, s10 * was, s11 * on * was])
    return both / (1 + both), (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)


def in_blocks(emission: np.ndarray, sizes: np.ndarray, steps: np.ndarray, counts: bool = True, words: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
    """marginals of many chains, about that many words at a time, which bounds what the layout needs."""
    ends = np.cumsum(sizes)
    edges = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + words, words) if len(ends) else [], "left"))
    edges = np.unique(np.r_[0, edges, len(sizes)])
    out, pairs = np.empty(int(sizes.sum()), np.float32), np.zeros((2, 2))
    for a, b in zip(edges[:-1], edges[1:]):
        lo, hi = (int(ends[k - 1]) if k else 0 for k in (a, b))
        out[lo:hi], own = marginals(emission[lo:hi], sizes[a:b], steps, counts)
        pairs += own
    return out, pairs
