"""Quality rules on repetition, read from a suffix array over the words of each text.

The words of a batch of texts form one array, numbered apart in each text, so that no repeat crosses
texts. Prefix doubling sorts all suffixes by their first 1, 2, 4, ... words; only suffixes that
are not yet alone in their rank are sorted again. Longest common prefixes of neighbours in the sorted
order follow from the ranks of all doublings, largest first. The neighbours with the longest prefix give
the longest repeat at each place: the intervals of equal prefixes are the maximal repeated substrings, and
the union of their spans of ``window`` words or more is the repeated part of the text.

Rules: the base rules of the contract, and a text is dropped if the repeated part exceeds
``max_fraction`` of its words or one repeat is longer than ``max_repeat`` words.

Defined results: null or empty text has no words and fails the base rule; repeated rows are judged each;
a null doc_id stays null; texts of any length are judged whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from touchline.llm.common import chunks, text_of

SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, longest_repeat long"
)


def suffix_order(words: np.ndarray):
    """Order of all suffixes of an int array and the ranks after each doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    levels, step = [rank], 1
    while True:
        held = rank[order]
        alone = np.r_[True, held[1:] != held[:-1]] & np.r_[held[1:] != held[:-1], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, levels
        # A rank is the place where its group begins in the order, so groups are refined in place.
        first = np.r_[True, held[1:] != held[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        base = np.empty(n, np.int64)
        base[order] = start
        at = order[open_]
        after = np.where(at + step < n, base[np.minimum(at + step, n - 1)] + 1, 0)
        sorted_ = np.lexsort((after, base[at]))
        order = order.copy()
        order[open_] = at[sorted_]
        group, tail = base[at][sorted_], after[sorted_]
        changed = np.r_[True, (group[1:] != group[:-1]) | (tail[1:] != tail[:-1])]
        rank = base
        rank[at[sorted_]] = np.maximum.accumulate(np.where(changed, open_, 0))
        levels.append(rank)
        step *= 2


def longest_repeats(words: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring that begins there and occurs elsewhere too."""
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order, levels = suffix_order(words)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        fits = np.flatnonzero(np.maximum(left, right) + common < n)
        same = fits[rank[left[fits] + common[fits]] == rank[right[fits] + common[fits]]]
        common[same] += 1 << level
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def judge(texts, window: int, max_fraction: float, max_repeat: int) -> dict[str, np.ndarray]:
    """All measures of a batch of texts."""
    split = [t.encode().split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    codes = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))[0].astype(np.int64) if n_words.sum() else np.zeros(0, np.int64)
    # Words are numbered apart in each text, and each text is closed by a word of its own, so that no
    # repeat is found in another text or runs on into it.
    owner = np.repeat(np.arange(len(split)), n_words + 1)
    words = np.insert(codes + 1, np.cumsum(n_words), 0) + owner * (len(codes) + 1)
    repeat = longest_repeats(words)
    hit = np.flatnonzero(repeat >= window)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + repeat[hit], -1)
    covered = np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(split))
    longest = np.zeros(len(split), np.int64)
    np.maximum.at(longest, owner, repeat)
    blank = str.maketrans("", "", " \t\n\x0b\x0c\r")
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.encode().strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    failed = (n_words < 20) | (100 * covered > 30 * n_words)
    return {
        "n_words": n_words, "word_chars": np.array([len(t.translate(blank)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64), "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": covered, "base_failed": failed,
        "kept": ~failed & (covered <= max_fraction * n_words) & (longest <= max_repeat), "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, window: int = 8, max_fraction: float = 0.3, max_repeat: int = 200) -> DataFrame:
    """The measures and the verdict of every row; no shuffle."""

    def run(frames):
        for frame in frames:
            for a, b in chunks(frame, 1_000_000):
                part = frame.iloc[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), **judge(part["text"].tolist(), window, max_fraction, max_repeat)})

    return text_of(docs).mapInPandas(run, SCHEMA)
