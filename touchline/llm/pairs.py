"""A hashed table of mergeable token pairs, looked up for whole numpy arrays at a time."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing with linear probing; at most a quarter of the slots are used."""

    def __init__(self, left, right, rank, merged):
        keys = np.asarray(left, np.int64) << 20 | np.asarray(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        left_over, slot = np.arange(len(keys)), self._slot(keys)
        while len(left_over):
            free = self.keys[slot] == -1
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            at, of = slot[put], left_over[put]
            self.keys[at], self.rank[at], self.merged[at] = keys[of], rank[of], merged[of]
            left_over, slot = left_over[~put], (slot[~put] + 1) & (size - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left, right):
        """Rank (NONE if the pair does not merge) and slot of each pair."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return np.where(self.keys[slot] == keys, self.rank[slot], NONE), slot


@lru_cache(maxsize=4)
def rank_file(path: str):
    """Tokens by id, id by token, and the pairs whose joined bytes are a token (rank = its id)."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    left, right, rank = [], [], []
    for token, i in ids.items():
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), rank.append(i)
    tokens = {i: t for t, i in ids.items()}
    single = np.array([ids[bytes([b])] for b in range(256)], np.int32)
    return tokens, ids, single, PairTable(left, right, rank, rank)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by its public rule:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def merge_file(path: str):
    """Id of each byte, the merge table and the special strings of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    single = np.zeros(256, np.int32)
    for letter, byte in byte_letters().items():
        single[byte] = vocab[letter]
    table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
    return single, table, [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
