"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Pieces of similar length form the rows of a padded matrix of token ids. In every round each row merges
its leftmost pair of lowest rank; the ranks right and left of the merge are looked up anew, the row is
compacted by one column, and rows without a pair left leave the matrix. Pieces above ``LONG`` bytes
(a text without spaces, say) would need a round per byte over a very wide row; they use the same rule
on a linked list with a heap, which gives the same ids in n log n steps.

Defined results: null text encodes as empty (no ids, empty bytes); repeated rows are encoded each; a null
doc_id stays null; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from touchline.llm.common import chunks, text_of
from touchline.llm.pairs import NONE, PairTable, rank_file

LONG = 512
CELLS = 500_000
#: Distinct pieces whose ids a worker keeps; beyond it the memory starts anew.
KNOWN = 80_000


def merge_rows(rows: np.ndarray, table: PairTable) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, final ids) of a matrix of token ids padded with -1."""
    number = np.arange(len(rows))
    width = rows.shape[1]
    rows = np.concatenate([rows, np.full((len(rows), 1), -1, np.int32)], axis=1)

    def ranks(left, right):
        r, _ = table.lookup(np.maximum(left, 0), np.maximum(right, 0))
        return np.where((left < 0) | (right < 0), NONE, r)

    rank = np.full((len(rows), width + 1), NONE, np.int32)
    rank[:, :width] = ranks(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), width)
    columns = np.arange(width + 1)
    while len(rows):
        at = rank.argmin(axis=1)
        every = np.arange(len(rows))
        best = rank[every, at]
        done = best == NONE
        for i in np.flatnonzero(done):
            yield int(number[i]), rows[i][rows[i] >= 0]
        keep = ~done
        rows, rank, number, at, best = rows[keep], rank[keep], number[keep], at[keep], best[keep]
        if not len(rows):
            return
        every = np.arange(len(rows))
        rows[every, at] = best
        take = np.minimum(columns + (columns > at[:, None]), width)
        rows, rank = np.take_along_axis(rows, take, axis=1), np.take_along_axis(rank, take, axis=1)
        rank[every, at] = ranks(rows[every, at], rows[every, np.minimum(at + 1, width)])
        before = np.flatnonzero(at > 0)
        rank[before, at[before] - 1] = ranks(rows[before, at[before] - 1], rows[before, at[before]])


def merge_long(piece: np.ndarray, table: PairTable) -> np.ndarray:
    """The same merges on one long piece: a heap of (rank, place) over a linked list."""
    ids = piece.tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs: dict[tuple[int, int], int] = {}

    def rank(a, b):
        if (r := pairs.get((a, b))) is None:
            r = pairs[a, b] = int(table.lookup(np.array([a]), np.array([b]))[0][0])
        return r

    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) != NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := rank(r, ids[after[i]])) != NONE:
                heapq.heappush(heap, (x, i, r, ids[after[i]]))
        if before[i] >= 0 and (x := rank(ids[before[i]], r)) != NONE:
            heapq.heappush(heap, (x, before[i], ids[before[i]], r))
    return np.array([x for x in ids if x >= 0], np.int32)


def encode_pieces(pieces: list[bytes], path: str) -> list[np.ndarray]:
    """Token ids of each piece."""
    _, ids, single, table = rank_file(path)
    out: list[np.ndarray | None] = [None] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if (whole := ids.get(piece)) is not None:
            out[i] = np.array([whole], np.int32)
        elif len(piece) > LONG:
            out[i] = merge_long(single[np.frombuffer(piece, np.uint8)], table)
        else:
            buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
    for width, members in buckets.items():
        step = max(1, CELLS // width)
        for a in range(0, len(members), step):
            part = members[a : a + step]
            lengths = np.array([len(pieces[i]) for i in part])
            rows = np.full((len(part), width), -1, np.int32)
            rows[np.arange(width) < lengths[:, None]] = single[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            for row, result in merge_rows(rows, table):
                out[part[row]] = result
    return out


def decode(ids, path: str) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(rank_file(path)[0].__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of the decoded bytes and, on demand, the ids themselves.

    No shuffle: a task encodes its own rows. ``keep`` names string columns that go along.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + "".join(f", `{c}` string" for c in keep)

    def run(frames):
        find = regex.compile(public_tokenizers.PATTERN).findall
        known: dict[str, tuple[str, list[int], bytes]] = {}
        for frame in frames:
            for a, b in chunks(frame):
                part = frame.iloc[a:b]
                split = [find(t) for t in part["text"]]
                if len(known) > KNOWN:
                    known.clear()
                new = list({p for pieces in split for p in pieces}.difference(known))
                for i in range(0, len(new), 100_000):
                    some = new[i : i + 100_000]
                    for piece, ids in zip(some, encode_pieces([p.encode() for p in some], ranks_path)):
                        ids = ids.tolist()
                        known[piece] = (" ".join(map(str, ids)), ids, decode(ids, ranks_path))
                rows: dict[str, list] = {"doc_id": part["doc_id"].astype("Int64"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"token_ids": []} if with_ids else {})
                for pieces in split:
                    got = [known[p] for p in pieces]
                    rows["n_tokens"].append(sum(len(g[1]) for g in got))
                    rows["ids_sha256"].append(hashlib.sha256(" ".join(g[0] for g in got).encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(b"".join(g[2] for g in got)).hexdigest())
                    if with_ids:
                        rows["token_ids"].append(np.concatenate([np.array(g[1], np.int32) for g in got]) if got else np.zeros(0, np.int32))
                yield pd.DataFrame(rows | {c: part[c] for c in keep})

    return text_of(docs).mapInPandas(run, schema) if not keep else docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text", *[f"cast(`{c}` as string) `{c}`" for c in keep]).mapInPandas(run, schema)
