"""Spelling variants of words: a symmetric-delete join, and the common form that each word stands for.

1. Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts,
   A-Z lower-cased, counted before and after the shuffle.
2. Every word gives a hash of itself and of each of its distinct single deletions;
   words meet in an equi-join on these keys. Two words at distance one share exactly
   one key (the shorter word, or what both leave without the replaced letter), so that
   no pair comes twice. A key has at most as many words as there are letters times
   places in it: no key is hot, whatever the texts.
3. Pairs that meet are verified: exactly one inserted, deleted or replaced code point.
   Words of more than ``CARRIED`` code points meet by digest and are fetched for that,
   as a long word has many keys.
4. A word's form is its near word of largest count (ties: the smallest in code-point
   order) where that is at least ``ratio`` times the word's. Counts grow along forms,
   so that they end; each round follows twice as many steps as the one before.

Null and empty texts have no words, a null doc_id counts as an empty one. Repeated
rows count each. Words of any length are compared. Empty tables give no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import INVERSE, arrow_batch, materialise, mix, powers, prefix_hash, ready, rows_at

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of the longest word that goes with each of its keys.
CARRIED = 64
#: Code points whose keys are made at once.
TOGETHER = 1 << 17

KEYS = "key long, name string, n long"


def runs(docs: DataFrame, least: int) -> DataFrame:
    """doc_id and each run of at least ``least`` letters, A-Z lower-cased: a row for each occurrence."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    ready(docs.sparkSession)
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(run: Column, doc_id: Column, every: int) -> Column:
    """The run without the code point h % length where ``every`` divides h, the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, least_length: int, least_n: int) -> DataFrame:
    """word and n of those of enough code points and occurrences."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def key_hashes(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of each word and of its distinct single deletions; word k has the points from begins[k] to begins[k + 1]."""
    lengths = np.diff(begins)
    sums, inverse = prefix_hash(points), powers(len(points) + 1)[1]
    a, b = begins[:-1], begins[1:]
    whole = mix((sums[b] - sums[a]) * inverse[a] + lengths.astype(np.uint64))
    word = np.repeat(np.arange(len(lengths)), lengths)
    # of a run of equal code points only the first is deleted
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(first)
    word = word[at]
    left = sums[at] - sums[a[word]] + (sums[b[word]] - sums[at + 1]) * INVERSE
    less = mix(left * inverse[a[word]] + (lengths[word] - 1).astype(np.uint64))
    return np.concatenate([whole, less]), np.concatenate([np.arange(len(lengths)), word])


def keyed(words: DataFrame) -> DataFrame:
    """A row (key, name, n) for each word (word, name, n) and each of its distinct single deletions."""

    def keys(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
                points = np.frombuffer("".join(texts[at:to]).encode("utf-32-le"), "<u4")
                hashes, word = key_hashes(points, np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]).astype(np.int64))
                yield arrow_batch(KEYS, [hashes.view(np.int64), *(batch.column(c).slice(at, to - at).take(rows_at(word)) for c in ("name", "n"))])
                at = to

    return words.select("word", "name", "n").mapInArrow(keys, KEYS)


def meeting(words: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n; a < b) of the names of words (word, name, n) that share a key."""
    keys = materialise(keyed(words), "spelling-keys")
    left, right = keys.select("key", F.col("name").alias("a"), F.col("n").alias("a_n")), keys.select("key", F.col("name").alias("b"), F.col("n").alias("b_n"))
    return left.join(right, "key").filter("a < b").drop("key")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair (a, a_n, b, b_n; in some order) of ``words`` (word, n) that differ by exactly one code point, once."""
    one = F.levenshtein("a", "b", 1) == 1
    short = meeting(words.filter(F.length("word") <= CARRIED).withColumn("name", F.col("word"))).filter(one)
    long = materialise(words.filter(F.length("word") >= CARRIED).withColumn("name", F.md5("word")), "long-words")
    met = meeting(long).withColumnsRenamed({"a": "a_name", "b": "b_name"})
    met = met.join(long.select(F.col("name").alias("a_name"), F.col("word").alias("a")), "a_name").join(long.select(F.col("name").alias("b_name"), F.col("word").alias("b")), "b_name")
    met = met.filter(F.greatest(F.length("a"), F.length("b")) > CARRIED).filter(one)
    return short.select("a", "a_n", "b", "b_n").union(met.select("a", "a_n", "b", "b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and the last form that it leads to, for ``forms`` (word, form) without circles."""
    found = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = materialise(found.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return found
        found = moved.drop("moved")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n for ``words`` (word, n), each word once."""
    words = materialise(words, "words")
    both = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    leads = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))
    known = materialise(known, "forms")
    return known.join(roots(known.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """``variants`` of the words of whole ``docs``, some misspelt by the rule of ``misspelt``."""
    words = runs(docs, least_length).select(misspelt(F.col("run"), F.col("doc_id"), every).alias("word"))
    return variants(counted(words, least_length, least_n), ratio)
