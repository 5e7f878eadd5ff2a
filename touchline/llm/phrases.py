"""Phrase collocations, counted in burstable tries of hash containers.

A task numbers the words it meets and keeps a trie for each language and phrase length, keyed by word numbers. The
trie is shallow: its leaves are containers, hash tables that each hold the phrases of a range of first words. One that
grows beyond ``burst`` entries bursts in two between two first words, or between two second words where it holds
only one first word, and no deeper. When a task holds more than ``hold`` entries, the largest containers are
spilled whole, each as a run sorted by its words, until half of the entries are left; the rest follows at the task's
end. The runs are exchanged by prefix (language, first two words, and one of ``slices`` of the third, so that a
pair that begins a third of all phrases is dealt on) and merged by adding up the counts inside a prefix partition.

Words and pairs are counted first. A phrase of three words can only be frequent if both of its pairs are, so
tasks leave out those whose pairs are not in a table of bits, which is of fixed size and broadcast. Bits that several
pairs share let more through and never lose any.

Counts are exact and cover every occurrence; only after the merge are phrases below ``least`` left out, which no
candidate needs: the parts of a phrase occur at least as often as the phrase.

Scale: a task's memory is bounded by ``hold`` entries, ``vocabulary`` words and one document's phrases; nothing is
gathered per phrase beyond one row for each task that met it. Scores are exact decimals. The list of a
language is limited while it is sorted, so that no task orders all of its phrases.

Defined results: null text counts as empty, null lang as ``und``; a word is whatever stands between blanks and
tabs inside a piece, of any length; repeated rows count each; an empty table, or a language without candidates,
gives no rows; ids and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from touchline.session import cut_lineage

#: A word, or one of the characters that end a piece.
_TOKENS = re.compile("[^\x20\x09.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]")
_ENDS = ".,;:!?\x0a\x0b\x0c\x0d"
#: Bits of a word number inside a packed phrase of at most three words; number 0 ends a piece.
BITS = 21
#: Words counted together; with ``vocabulary`` words before them, fewer than 2 ** BITS.
SEGMENT = 400_000
#: The sieve of frequent pairs has 2 ** SIEVE bits, 8 MB.
SIEVE = 26
#: Entries of spilled runs handed over together.
BATCH = 50_000
_RUN = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64())])


class Numbers(dict):
    """Word numbers in order of first use."""

    def __init__(self):
        super().__init__(dict.fromkeys(_ENDS, 0))
        self.words: list[str | None] = [None]
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def hashed(self) -> np.ndarray:
        """A hash of every word so far, by number."""
        new = self.words[len(self.hashes) :]
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxh64_intdigest, new), np.uint64, len(new))])
        return self.hashes


def sieve_place(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of pairs of words, given by their hashes, in the sieve of frequent pairs."""
    mixed = (first ^ np.uint64(xxh64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15) + second
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SIEVE)


class Trie:
    """Counts of phrases of ``length`` words, packed with the first word on top.

    A container is a hash table for the phrases from its bound up to the next one. One that grows beyond ``burst``
    bursts at a change of the first word near its middle, or of the second word where it holds one first word only.
    """

    def __init__(self, length: int, burst: int):
        self.length, self.burst = length, burst
        self.bounds, self.boxes = [0], [Counter()]

    def add(self, phrases: np.ndarray) -> int:
        """Counts ``phrases``, which are in rising order; gives the number of new entries."""
        cuts = [*np.searchsorted(phrases, self.bounds).tolist(), len(phrases)]
        new = 0
        for k in range(len(self.boxes) - 1, -1, -1):
            if cuts[k] < cuts[k + 1]:
                before = len(self.boxes[k])
                self.boxes[k].update(phrases[cuts[k] : cuts[k + 1]].tolist())
                new += len(self.boxes[k]) - before
                if len(self.boxes[k]) > self.burst:
                    self._split(k)
        return new

    def _split(self, k: int) -> None:
        held = np.sort(np.fromiter(self.boxes[k], np.int64, len(self.boxes[k])))
        for depth in range(1, self.length):
            prefix = held >> (BITS * (self.length - depth))
            changes = np.flatnonzero(np.diff(prefix)) + 1
            if len(changes):
                bound = int(prefix[changes[np.argmin(np.abs(changes - len(held) // 2))]]) << (BITS * (self.length - depth))
                low, high = Counter(), Counter()
                for phrase, count in self.boxes[k].items():
                    (low if phrase < bound else high)[phrase] = count
                self.boxes[k : k + 1], self.bounds[k + 1 : k + 1] = [low, high], [bound]
                return

    def __len__(self) -> int:
        return sum(map(len, self.boxes))

    def largest(self, entries: int):
        """Empties containers, largest first, until ``entries`` are taken; each as (phrases, counts) in order."""
        for k in sorted(range(len(self.boxes)), key=lambda k: len(self.boxes[k]), reverse=True):
            own = self.boxes[k]
            if entries <= 0 or not own:
                return
            phrases, counts = np.fromiter(own.keys(), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own))
            order = np.argsort(phrases)
            entries -= len(own)
            self.boxes[k] = Counter()
            yield phrases[order], counts[order]


class TaskCounts:
    """What a task holds: word numbers, and for each language its words so far and a trie for each length.

    With a ``sieve``, phrases of three words count only if both of their pairs are in it.
    """

    def __init__(self, lengths: tuple[int, ...], sieve: np.ndarray | None, hold: int, vocabulary: int, burst: int):
        self.lengths, self.length, self.sieve = lengths, max(lengths), sieve
        self.hold, self.vocabulary, self.burst = hold, vocabulary, burst
        self.numbers = Numbers()
        self.tries: dict[tuple[str, int], Trie] = {}
        self.words: dict[str, int] = {}
        self.held = 0

    def count(self, lang: str, texts: list[str]):
        """Counts the texts and spills what there is no room for. Long texts go in parts that overlap by a phrase."""
        words = _TOKENS.findall("\n".join(texts).encode().lower().decode())
        for start in range(0, len(words), SEGMENT):
            part = words[start : start + SEGMENT + self.length - 1]
            own = min(SEGMENT, len(words) - start)
            ids = np.zeros(own + self.length, np.int64)
            ids[: len(part)] = list(map(self.numbers.__getitem__, part))
            phrase, whole = np.zeros(own, np.int64), np.ones(own, bool)
            for k in range(self.length):
                word = ids[k : k + own]
                whole, phrase = whole & (word > 0), (phrase << BITS) | word
                if k == 0:
                    self.words[lang] = self.words.get(lang, 0) + int(whole.sum())
                if k + 1 in self.lengths:
                    counted = whole if self.sieve is None or k < 2 else whole & self._sifted(lang, ids, own)
                    trie = self.tries.setdefault((lang, k + 1), Trie(k + 1, self.burst))
                    self.held += trie.add(np.sort(phrase[counted]))
            if len(self.numbers) > self.vocabulary:
                yield from self.spill(self.held)
                self.numbers = Numbers()
            elif self.held > self.hold:
                yield from self.spill(self.held // 2)

    def _sifted(self, lang: str, ids: np.ndarray, own: int) -> np.ndarray:
        word = self.numbers.hashed()[ids[: own + 2]]
        place = sieve_place(lang, word[:-1], word[1:])
        held = (self.sieve[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return held[:-1] & held[1:]

    def spill(self, entries: int):
        """Runs of ``entries`` entries, or of all that is held, several to a batch."""
        words = pa.array(self.numbers.words, pa.string())
        for lang, length in sorted(self.tries, key=lambda x: len(self.tries[x]), reverse=True):
            waiting, n = [], 0
            for run in self.tries[lang, length].largest(entries):
                waiting.append(run)
                n, entries, self.held = n + len(run[0]), entries - len(run[0]), self.held - len(run[0])
                if n >= BATCH:
                    yield self._batch(lang, length, words, waiting)
                    waiting, n = [], 0
            if waiting:
                yield self._batch(lang, length, words, waiting)

    @staticmethod
    def _batch(lang: str, length: int, words: pa.Array, waiting: list) -> pa.RecordBatch:
        phrases, counts = np.concatenate([r[0] for r in waiting]), np.concatenate([r[1] for r in waiting])
        parts = [words.take(pa.array((phrases >> (BITS * (length - 1 - k))) & ((1 << BITS) - 1))) for k in range(length)]
        parts += [pa.nulls(len(phrases), pa.string())] * (3 - length)
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(phrases), np.int64))), *parts, pa.array(counts)], schema=_RUN)

    def rest(self):
        """At the end of a task: all that is left, and the words of each language."""
        yield from self.spill(self.held)
        none = pa.nulls(len(self.words), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(self.words), pa.string()), none, none, none, pa.array(list(self.words.values()), pa.int64())], schema=_RUN)


def runs(docs: DataFrame, lengths: tuple[int, ...], sieve=None, hold: int = 1_000_000, vocabulary: int = 400_000, burst: int = 16_384, chunk: int = 400_000) -> DataFrame:
    """(lang, w1, w2, w3, n): the sorted runs that tasks spill, a phrase being in several; without words, all of a language.

    ``sieve``: a broadcast table of bits, see ``pair_sieve``.
    """

    def run(batches):
        state, texts, chars = TaskCounts(lengths, sieve and sieve.value, hold, vocabulary, burst), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
                chars += len(text)
                if chars >= chunk:
                    for k, own in texts.items():
                        yield from state.count(k, own)
                    texts, chars = {}, 0
        for k, own in texts.items():
            yield from state.count(k, own)
        yield from state.rest()

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, n long")


def merged(spilled: DataFrame, least: int, slices: int = 8) -> DataFrame:
    """The runs exchanged by prefix and added up there; phrases below ``least`` go, and the rest is stored."""
    split = spilled.withColumn("slice", F.pmod(F.hash("w3"), F.lit(slices))).repartition("lang", "w1", "w2", "slice")
    counted = split.groupBy("lang", "w1", "w2", "w3", "slice").agg(F.sum("n").alias("f"))
    return cut_lineage(counted.where((F.col("f") >= least) | F.col("w1").isNull()).drop("slice"), "phrases")


def pair_sieve(pairs: DataFrame):
    """A broadcast table of 2 ** SIEVE bits, whatever the number of ``pairs`` (lang, w1, w2), in which each has its bit."""

    def places(batches):
        for batch in batches:
            lang, w1, w2 = (batch.column(c).to_pylist() for c in ("lang", "w1", "w2"))
            found = [int(sieve_place(k, np.uint64([xxh64_intdigest(v)]), np.uint64([xxh64_intdigest(w)]))[0]) for k, v, w in zip(lang, w1, w2)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["place"])

    words = pairs.select("lang", "w1", "w2").mapInArrow(places, "place long").groupBy(F.shiftright("place", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()  # 2 ** (SIEVE - 6) rows at most
    table = np.zeros(1 << (SIEVE - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return pairs.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def phrase_counts(docs: DataFrame, least: int = 10, **bounds) -> DataFrame:
    """(lang, w1, w2, w3, f) of all phrases that occur ``least`` times; without words, f is all word occurrences of a language."""
    short = merged(runs(docs, (1, 2), **bounds), least)
    sieve = pair_sieve(short.where("w2 is not null"))
    long = merged(runs(docs, (3,), sieve, **bounds).where("w1 is not null"), least)
    return short.unionByName(long)


def _cut(k: int, left: str, right: str) -> Column:
    """(score, k, l, r) of the cut after k words. Decimals keep the score exact up to counts of 14 digits."""
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(14,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")
    return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000, **bounds) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of two or three words of each language.

    A phrase is left out if a longer one that holds it occurs at least ``inside`` percent as often.
    """
    table = phrase_counts(docs, least, **bounds)
    total = table.where("w1 is null").select("lang", F.col("f").alias("n"))
    one = table.where("w1 is not null and w2 is null")
    two, three = table.where("w2 is not null and w3 is null"), table.where("w3 is not null").withColumnRenamed("f", "a")
    word = lambda w, f: one.select("lang", F.col("w1").alias(w), F.col("f").alias(f))
    pair = lambda v, w, f: two.select("lang", F.col("w1").alias(v), F.col("w2").alias(w), F.col("f").alias(f))
    triples = (
        three.join(pair("w1", "w2", "f12"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "f23"), ["lang", "w2", "w3"])
        .join(word("w1", "f1"), ["lang", "w1"]).join(word("w3", "f3"), ["lang", "w3"])
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array_min(F.array(_cut(1, "f1", "f23"), _cut(2, "f12", "f3"))).alias("cut"))
    )
    held = three.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = held.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("longer"))
    pairs = (
        pair("w1", "w2", "a").join(longer, ["lang", "w1", "w2"], "left").where(f"longer is null or 100 * longer < {inside} * a")
        .join(word("w1", "f1"), ["lang", "w1"]).join(word("w2", "f2"), ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", _cut(1, "f1", "f2").alias("cut"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase"))
    best = pairs.unionByName(triples).withColumn("rank", place).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
