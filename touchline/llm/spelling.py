"""Grouping of spelling variants by PartEnum signatures of letter multisets.

A word's letters, each with how often it occurs, are a binary vector: dimension (letter, j) is set if the letter
occurs at least j times. One inserted or deleted letter changes one dimension, a replaced one at most two, so near
words have vectors at a Hamming distance of at most two. PartEnum deals the letters over ``FIRST`` partitions of
``SECOND`` parts each. Of two vectors that differ in at most two dimensions, at least one first-level
partition differs in at most 2 div FIRST dimensions, i.e. at most that many of its parts differ, so the
projections onto some choice of the other parts agree: each choice in each partition gives one signature.
Since the lengths of near words differ by one at most, a signature carries its word's length or one more, so that
words of equal or neighbouring lengths meet. Near words also agree in their first or in their last three
letters (six letters at least, one edit), so a signature carries either; a signature shared by very many words
does not make all of them candidates. Signatures are joined by equality, and candidates verified by edit distance.

Scale: words are counted with partial aggregation, all in built-in functions; what follows works on the distinct
words that are frequent enough, dealt by signature. A signature never stands for pairs written out without a
join, and the words of a text are never gathered beyond the text. The way from a word to its root at least
multiplies n by five at each step, so ``DOUBLINGS`` rounds that double the known distance reach the end of any.
All joins are sort-merge joins, said by hints: Spark takes the size of the words' files for that of their signatures,
of which each word has 40, and would gather these on the driver for a broadcast.

Defined results: null text has no words; a null doc_id counts as the empty text in the checksum; texts of any
length are read whole; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import cut_lineage

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First-level partitions and the parts of each; letters are dealt in turn, frequent ones first, to even the parts.
FIRST, SECOND = 1, 5
ORDER = "esanirtoludcmpgvbfhqyxjkzw" + "".join(map(chr, range(0xC0, 0x100)))
#: The distance doubles each round: 2 ** 5 steps multiply n by 5 ** 32, more than a long holds.
DOUBLINGS = 5


def word_counts(docs: DataFrame, rate: int = 199) -> DataFrame:
    """(word, n): the runs of letters of all texts, in lower case, with a letter deleted from one in ``rate`` of them."""
    low = F.translate(F.col("run"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select(low.alias("run"), F.crc32(F.concat("doc_id", F.lit(":"), low)).alias("h"))
    place = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
    word = F.when(F.pmod("h", F.lit(rate)) == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(docs: DataFrame, letters: int = 6, least: int = 5, rate: int = 199) -> DataFrame:
    return word_counts(docs, rate).where((F.col("n") >= least) & (F.char_length("word") >= letters))


def signatures(word: Column) -> Column:
    """All signatures of a word as an array of strings."""
    parts = [ORDER[i :: FIRST * SECOND] for i in range(FIRST * SECOND)]
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    projection = [F.regexp_replace(letters, f"[^{p}]", "") for p in parts]
    chosen = []
    for i in range(FIRST):
        own = range(i, FIRST * SECOND, FIRST)
        for kept in combinations(own, SECOND - 2 // FIRST):
            chosen.append(F.concat_ws("|", F.lit(".".join(map(str, kept))), *[projection[k] for k in kept]))
    ends = F.array(F.concat(F.lit("<"), F.left(word, F.lit(3))), F.concat(F.lit(">"), F.right(word, F.lit(3))))
    length = F.char_length(word)
    lengths = F.array(length.cast("string"), (length + 1).cast("string"))
    return F.flatten(F.transform(F.array(*chosen), lambda s: F.flatten(F.transform(ends, lambda e: F.transform(lengths, lambda n: F.concat_ws(" ", s, e, n))))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) with a before b: all pairs of ``words`` (word, n) that one inserted, deleted or replaced letter tells apart."""
    signed = words.select("word", "n", F.explode(signatures(F.col("word"))).alias("signature"))
    left = signed.select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = signed.select("signature", F.col("word").alias("b"), F.col("n").alias("n_b"))
    close = left.join(right.hint("merge"), "signature").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return close.select("a", "b", "n_a", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the way from each word of ``forms`` (word, form)."""
    way = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = way.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return way


def variants(docs: DataFrame, letters: int = 6, least: int = 5, ratio: int = 5, rate: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word of at least ``letters`` letters and ``least`` occurrences."""
    words = cut_lineage(frequent_words(docs, letters, least, rate), "words")
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )).alias("s")).select("s.*")
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    large = -F.col("best.m") >= ratio * F.col("n")
    chosen = cut_lineage(best.select("word", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")), "near")
    out = words.join(chosen.hint("merge"), "word", "left").join(roots(chosen.where("form is not null")).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
