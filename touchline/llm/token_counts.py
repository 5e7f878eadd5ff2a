"""Token counts by rank-synchronous array merging.

A batch of pre-tokens is one flat array of symbols plus the owner of each symbol. In every round each
sequence takes its lowest-rank pair and merges all its occurrences at once; sequences without a pair
left are counted and dropped. Merging a rank everywhere at once equals merging it left to right one
by one, because a pair that holds a merged symbol has a higher rank than the merge that made it.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; a null
doc_id stays null; texts of any length are counted whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import chunks, text_of
from touchline.llm.pairs import NONE, PairTable, merge_file

#: Distinct pre-tokens whose counts a worker keeps; beyond it the memory starts anew.
KNOWN = 150_000


def surviving_symbols(pieces: list[bytes], single: np.ndarray, table: PairTable) -> np.ndarray:
    """Symbols left in each piece when no pair merges any more."""
    counts = np.zeros(len(pieces), np.int64)
    symbols = single[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    if not len(symbols):
        return counts
    while True:
        rank = np.full(len(symbols), NONE, np.int32)
        slot = np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside], slot[inside] = table.lookup(symbols[inside], symbols[inside + 1])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lengths = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        counts[owner[starts[done]]] = lengths[done]
        if done.all():
            return counts
        here = (rank == np.repeat(lowest, lengths)) & (rank != NONE)
        # Pairs that overlap (aaa) merge from the left: every second one of a run.
        run = np.arange(len(here)) - np.maximum.accumulate(np.where(here, -1, np.arange(len(here))))
        here &= run % 2 == 1
        symbols = np.where(here, table.merged[slot], symbols)
        keep = ~np.r_[False, here[:-1]] & ~np.repeat(done, lengths)
        symbols, owner = symbols[keep], owner[keep]


def count_text_tokens(texts, path: str, known: dict[str, int]) -> list[int]:
    """Tokens of each text; ``known`` keeps the counts of pre-tokens seen before."""
    single, table, special = merge_file(path)
    find = regex.compile(public_tokenizers.PATTERN).findall
    cut = regex.compile("|".join(regex.escape(s) for s in special)).split if special else None
    split, extra = [], []
    for text in texts:
        parts = cut(text) if cut and any(s in text for s in special) else [text]
        split.append([p for part in parts for p in find(part)])
        extra.append(len(parts) - 1)
    if len(known) > KNOWN:
        known.clear()
    new = list({p for pieces in split for p in pieces}.difference(known))
    for i in range(0, len(new), 100_000):
        part = new[i : i + 100_000]
        known.update(zip(part, surviving_symbols([p.encode() for p in part], single, table).tolist()))
    return [sum(map(known.__getitem__, pieces)) + n for pieces, n in zip(split, extra)]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; no shuffle."""

    def run(frames):
        known: dict[str, int] = {}
        for frame in frames:
            for a, b in chunks(frame):
                part = frame.iloc[a:b]
                n = count_text_tokens(part["text"], tokenizer_path, known)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(t.encode()) for t in part["text"]], "n_tokens": n})

    return text_of(docs).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
