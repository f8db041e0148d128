"""Token ids with the tokenizers library, a column of texts at a time.

A byte-level BPE tokenizer cuts a text into pieces before it merges anything: a blank starts a piece when something other
than white space follows, and ASCII letters, digits, marks and line breaks part from one another. So the texts of a slice are
cut there, all at once on their bytes; each distinct piece is encoded once by the library, and its ids are taken for every
place. The cuts are a subset of the tokenizer's own, which is all that equal ids need. A worker keeps the pieces it has met, up
to a bound. Tokenizers of another kind, and texts that hold one of the tokenizer's added tokens, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on every core already

from tokenizers import Tokenizer  # noqa: E402

BYTE_BPE = "byte_bpe_50k.json"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces that the tokenizer's pre-tokenization leaves whole, so that the model alone can encode them.
_SINGLE = re.compile(rf" ?(?:[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)|[\t\n]")

# classes of bytes: 1 letter, 2 digit, 3 mark but the apostrophe, 4 white space but the blank, 5 blank, 6 apostrophe, 0 others
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[9:14] = 4
_CLASS[32] = 5
_CLASS[39] = 6
#: Bytes after which a blank may be no start: white space, and those that begin white space beyond ASCII.
_NO_START = np.zeros(256, bool)
_NO_START[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: [class before, class after]: a piece always ends between the two.
_CUT = np.zeros((7, 7), bool)
for _a, _b in ((1, "2346"), (2, "1346"), (3, "124"), (4, "1236")):
    _CUT[_a, [int(x) for x in _b]] = True
_CUT[[1, 2, 3], 5] = True
_VISIBLE = np.array([0, 1, 1, 1, 0, 0, 1], bool)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that lie one after another, with each text's start and the end of all."""
    flags = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        kind = _CLASS[data]
        flags[1:-1] = _CUT[kind[:-1], kind[1:]]
        same = np.ones(len(data), bool)  # whether the next byte is of the same text
        same[np.maximum(starts, 1) - 1] = False
        flags[:-2] |= (kind[:-1] == 4) & _VISIBLE[kind[1:]] & same[:-1]  # the last of several line breaks stands alone
        at = np.flatnonzero((kind[:-1] == 5) & same[:-1])
        flags[at[~_NO_START[data[at + 1]]]] = True
    flags[starts] = True
    return np.flatnonzero(flags)


def _piecewise(spec: dict) -> bool:
    """Whether the tokenizer is byte-level BPE with the usual expression and nothing before or after it."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    return (
        spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        and pre.get("use_regex", True) and model.get("type") == "BPE" and plain
    )


class Encoder:
    """Encodes columns of texts as the library does with add_special_tokens=False.

    specials_as_text: strings of added tokens in a text are then ordinary text. most: pieces kept, which bounds memory.
    """

    def __init__(self, name: str = BYTE_BPE, specials_as_text: bool = False, most: int = 200_000):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = specials_as_text
        self.piecewise = _piecewise(json.loads(self.tokenizer.to_str()))
        added = {} if specials_as_text else self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.known: dict[bytes, bytes] = {}
        self.most = most
        self.letters = _byte_letters()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in found]

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        others, tokenize = [], self.tokenizer.model.tokenize
        for k, raw in enumerate(pieces):
            text = raw.decode("utf-8", "replace")
            if self.piecewise and _SINGLE.fullmatch(text):
                ids = [t.id for t in tokenize(raw.decode("latin-1").translate(self.letters))]
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append((k, text))
        for (k, _), ids in zip(others, self._library([text for _, text in others])):
            out[k] = ids
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in turn, and how many each has."""
        keys = pieces.cast(pa.binary()).to_pylist()
        found = list(map(self.known.get, keys))
        missing = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(missing, self._new([keys[k] for k in missing])):
            found[k] = ids
            if len(self.known) < self.most and len(keys[k]) <= 48:
                self.known[keys[k]] = ids
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin, with the end of all. texts: strings without nulls."""
        texts = pa.concat_arrays([texts.cast(pa.string())])  # one that begins at the start of its buffers
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        base, end = int(starts[0]), int(starts[-1])
        if base == end:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data, starts = np.frombuffer(texts.buffers()[2], np.uint8)[base:end], starts - base
        at = cuts(data, starts) if self.piecewise else np.unique(starts)
        if self.piecewise and self.added:
            holds = np.zeros(len(texts), bool)
            for x in self.added:
                holds |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
            if holds.any():  # their texts stay whole
                text_of = np.searchsorted(starts, at, "right") - 1
                inside = text_of < len(texts)
                drop = np.zeros(len(at), bool)
                drop[inside] = holds[text_of[inside]] & (at[inside] != starts[text_of[inside]])
                at = at[~drop]
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        ids, sizes = self._pieces(coded.dictionary)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))
        flat = lists.take(coded.indices).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(sizes[coded.indices.to_numpy()])]
        return flat, ends[np.searchsorted(at, starts)]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


@lru_cache(maxsize=2)
def encoder(name: str = BYTE_BPE, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    return Encoder(name, specials_as_text)
