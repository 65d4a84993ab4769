"""Benchmark decontamination by winnowing.

Of the hashes of every ``K`` consecutive words, the smallest in each run of
``WINDOW - K + 1`` is a fingerprint, on both sides. A window of ``WINDOW`` words
holds exactly one such run, so every shared window shares a fingerprint at the
same place: nothing that long is missed. An item with fewer words is one window
of its own length; its hash stands against that of every run of as many words.

1. The benchmark's fingerprints and windows are tables. A bitmap of the
   fingerprints' hashes, of bounded size, goes to all tasks, so that documents
   only hand on fingerprints that the benchmark may have, with the words around.
2. Fingerprints of both sides are joined by hash.
3. Hits are extended: the windows around each are compared with the benchmark's
   windows word for word, by a join on the words themselves.
4. What is found is summed up for each text, and joined to the documents by a
   128-bit key of the text. Windows that the same items share are one set of items.

A null text has no words: zero counts, never contaminated. Repeated rows get
repeated results; rows of one item_id are one item. Null item_ids count as an
item written ``null``. An empty benchmark or table is no error. Only the named
columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import LOWERED, TYPES, WordBatch, add_by_text, bitmap, chunks, materialise, maybe_in, ready, release, text_key

WINDOW = 13
K = 5


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the last smallest hash in each run of ``width``; all of shorter input's smallest."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    width = min(width, n)
    runs = n - width + 1
    best = np.arange(runs)
    least = hashes[:runs].copy()
    for j in range(1, width):
        later = hashes[j : j + runs]
        better = later <= least
        least[better] = later[better]
        best[better] = np.flatnonzero(better) + j
    return np.unique(best)


def fingerprints(batch: WordBatch, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the fingerprints for windows of ``size`` words: winnowed for full windows, all for short ones."""
    grams, valid = batch.grams(K if size == window else size)
    if not len(grams):
        return np.empty(0, np.int64), grams
    if size == window:
        # each text's fingerprints depend on its own words: runs across a border are harmless extras
        at = winnow(np.where(valid, grams, np.uint64(0xFFFFFFFFFFFFFFFF)), window - K + 1)
        at = at[valid[at]]
    else:
        at = np.flatnonzero(valid)
    return at, grams[at]


def words_of(batch: WordBatch, lo: int, hi: int) -> list[str]:
    """Lower-cased words ``lo`` to ``hi`` of a batch."""
    text = batch.low[batch.start[lo] : batch.end[hi - 1]].tobytes().decode("utf-8", "replace") if hi > lo else ""
    return [w for w in text.split("\0") if w]


def benchmark_tables(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints: size, hash; windows: window, items; sets: items, item_id)."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").distinct()

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in batches:
            names = rows.column("item_id").to_pylist()
            for lo, _, encoded in chunks(rows.column("text").to_pylist()):
                batch, out = WordBatch(encoded), []
                for d, (n, first) in enumerate(zip(batch.count.tolist(), batch.first.tolist(), strict=False)):
                    size = min(window, n)
                    if size:
                        words = words_of(batch, first, first + n)
                        own = WordBatch([encoded[d]])
                        out += [(names[lo + d], size, None, " ".join(words[i : i + size])) for i in range(n - size + 1)]
                        out += [(names[lo + d], size, h, None) for h in fingerprints(own, size, window)[1].view(np.int64).tolist()]
                columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, TYPES[t](pa)) for c, t in zip(columns, ("string", "int", "long", "string"), strict=True)], ["item_id", "size", "hash", "window"])

    ready(benchmark.sparkSession)
    rows = materialise(items.mapInArrow(index, "item_id string, size int, hash long, window string"), "benchmark")
    marks = materialise(rows.filter(F.col("hash").isNotNull()).select("size", "hash").distinct(), "fingerprints")
    owned = materialise(rows.filter(F.col("window").isNotNull()).select("window", "item_id").distinct(), "owned")
    both = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(3), "item_id")).alias("x"))
    windows = materialise(owned.groupBy("window").agg(F.md5(F.to_json(both)).alias("items")), "windows")
    shown = windows.groupBy("items").agg(F.min("window").alias("window"))
    return marks, windows, materialise(owned.join(shown, "window").select("items", "item_id"), "item-sets")


def word_counts(texts: list[str | None]) -> tuple[np.ndarray]:
    """The number of words of each text."""
    out = []
    for _, _, encoded in chunks(texts):
        inside = np.concatenate([[False], LOWERED[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)] != 0])
        first = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.cumsum([len(x) + 1 for x in encoded])
        out.append(np.diff(np.searchsorted(first, ends), prepend=0))
    return (np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64),)


def document_hits(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """text key and number of words, size, first word and words around of each document fingerprint that the benchmark has."""
    sizes = sorted(r["size"] for r in marks.select("size").distinct().collect())  # at most ``window`` rows
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(marks.select("hash")))

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = sent.value
        for rows in batches:
            for lo, _, encoded in chunks(rows.column("text").to_pylist()):
                batch = WordBatch(encoded)
                row, n_words, size_of, hashes, places, around = [], [], [], [], [], []
                for size in sizes:
                    at, found = fingerprints(batch, size, window)
                    some = np.flatnonzero(maybe_in(held, found)) if len(found) else at[:0]
                    full = size == window
                    for p, h in zip(at[some].tolist(), found[some].view(np.int64).tolist(), strict=True):
                        d = int(batch.doc[p])
                        a = max(int(batch.first[d]), p - (size - K)) if full else p
                        b = min(int(batch.first[d + 1]), p + size)
                        if b - a >= size:
                            row.append(lo + d), n_words.append(int(batch.count[d])), size_of.append(size), hashes.append(h), places.append(a - int(batch.first[d])), around.append(words_of(batch, a, b))
                if row:
                    keys = rows.column("text_key").take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(n_words, pa.int64()), pa.array(size_of, pa.int32()), pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), pa.array(around, pa.list_(pa.string()))], ["text_key", "n_words", "size", "hash", "at", "words"])
        release()

    return docs.select(text_key(F.col("text")).alias("text_key"), "text").mapInArrow(look, "text_key binary, n_words long, size int, hash long, at long, words array<string>").join(marks, ["size", "hash"])


def found_in_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """text_key, n_words, n_hit, n_items and items_sha256 of each different text of ``docs`` that holds a window of the benchmark."""
    marks, windows, sets = benchmark_tables(benchmark, window)
    hits = document_hits(docs, marks, window)
    each = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda i: F.struct((F.col("at") + i).alias("start"), F.array_join(F.slice(F.col("words"), i + 1, F.col("size")), " ").alias("window")))
    places = hits.select("text_key", "n_words", "size", F.explode(each).alias("w")).select("text_key", "n_words", "size", "w.start", "w.window").distinct()
    found = materialise(places.join(windows, "window").select("text_key", "n_words", "start", "size", "items"), "places")
    # bounded by the words of a text: distinct places, then distinct words
    spans = found.select("text_key", "n_words", "start", "size").distinct().groupBy("text_key", "n_words").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))).cast("long")
    items = found.select("text_key", "items").distinct().join(sets, "items").groupBy("text_key").agg(F.sort_array(F.collect_set("item_id")).alias("names"))
    named = items.select("text_key", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    return spans.select("text_key", "n_words", covered.alias("n_hit")).join(named, "text_key")


def is_contaminated(n_words: Column, n_hit: Column, share: float) -> Column:
    return (n_hit > 0) & (round(1 / share) * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (doc_id) and how many words stand in benchmark windows; contaminated from ``share`` of the words on."""
    keep = keep or ["doc_id"]
    found = materialise(found_in_texts(docs, benchmark, window).drop("n_words"), "found")
    counted = add_by_text(docs.select(F.struct(*keep).alias("row"), text_key(F.col("text")).alias("text_key"), "text"), word_counts, "n_words long", ["row", "text_key"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(found, "text_key", "left").select(
        "row.*", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), is_contaminated(F.col("n_words"), n_hit, share).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """``docs`` without the contaminated ones; only the keys of contaminated texts are joined with them."""
    found = found_in_texts(docs, benchmark, window)
    bad = materialise(found.filter(is_contaminated(F.col("n_words"), F.col("n_hit"), share)).select("text_key"), "contaminated")
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), text_key(F.col("text")).alias("text_key"))
    return row.join(bad, "text_key", "left_anti").select("row.*")
