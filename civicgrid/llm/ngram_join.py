"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two link at a Jaccard similarity of
``threshold`` or more. Texts of one shingle set are one class, compared once.

1. Every class gets ``BANDS`` x ``ROWS`` MinHash values. Classes that share a
   band are candidates, in the first band that they share and nowhere else; a pair
   at 0.8 shares none of 24 bands of 4 with probability 3e-6, a pair at 0.85 with
   less than 1e-7.
2. Candidates compare their MinHash values step by step. With a uniform prior,
   m matches in n leave the similarity a Beta(m + 1, n - m + 1); a pair is dropped
   when its probability of reaching the threshold is below ``TOLERANCE``.
3. Classes of a surviving pair go on, with their shingle sets, to the task of the
   bucket that the pair was found in. It verifies the surviving pairs exactly, and
   only these.

Buckets are split into pairs of blocks, by rows and by the size of what is
verified, so that no task holds more than two blocks; links leave a task as
counts and as spanning edges, never as all pairs. Members, counts and edges are
joined on the executors.

Result: a row for each row of ``docs``: doc_id, class_id (the smallest doc_id
that links reach), n_links (other rows linked directly, copies included), kept
(doc_id = class_id). A text of fewer than five words is one shingle; a null
text or one without words links with nothing. A row of a null doc_id has class
and count null and is kept. Repeated rows are copies of each other. Ids of any
type that has an order stay as they are. An empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import WordBatch, add_by_text, arrow_batch, bitmap, block_pairs, chunks, linked_classes, materialise, maybe_in, mix, rows_at, spanning, whole_groups

SHINGLE = 5
BANDS, ROWS = 24, 4
#: The bits of a bucket that name its band.
BAND = np.uint64(31)
TOLERANCE = 1e-7
STEP = 16
#: Rows of a block, and the shingles of its classes.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Rows of a tile of pairs that are compared at once, and columns of one product.
TILE, COLUMNS = 512, 4096

_A = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(encoded: list[bytes]) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    batch = WordBatch(encoded)
    grams, valid = batch.grams(SHINGLE)
    out = []
    for d, n in enumerate(batch.count):
        first = batch.first[d]
        if n >= SHINGLE:
            out.append(np.unique(grams[first : first + n - SHINGLE + 1]))
        elif n:
            short = np.uint64(n)
            for h in batch.hash[first : first + n]:
                short = mix(np.array([short]) * np.uint64(31) + h)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS * ROWS values of 32 bits for each non-empty set."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(values * _A[k] + _B[k], starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A hash for each band, whose lowest bits are the band's number."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(values), 1))
    for r in range(ROWS):
        out = mix(out + values[:, r::ROWS].astype(np.uint64) + np.uint64(r))
    return (out & ~BAND | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n values a pair stays with at least m matches.

    P(similarity >= t | m of n) under a uniform prior is P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs (i, j) stay; those that drop out are compared no further."""
    alive, matches, done = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for n, least in limits:
        matches = matches + (signatures[i[alive], done:n] == signatures[j[alive], done:n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches, done = alive[stay], matches[stay], n
        if not len(alive):
            break
    return alive


def surviving_pairs(bands: np.ndarray, signatures: np.ndarray, of_right: np.ndarray, within: bool, band: int, limits: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs (i, j) of one bucket whose first common band is ``band``, a tile of pairs at a time: ``within`` one block, or across two, ``of_right`` being the rows of the second."""
    left, right = np.flatnonzero(~of_right | within), np.flatnonzero(of_right)
    for lo in range(0, len(left), TILE):
        for at in range(lo if within else 0, len(left) if within else len(right), TILE):
            a, b = left[lo : lo + TILE], (left if within else right)[at : at + TILE]
            fresh = np.ones((len(a), len(b)), bool)
            for k in range(band):
                fresh &= bands[a, k][:, None] != bands[b, k][None, :]
            if within and at == lo:
                fresh = np.triu(fresh, 1)
            i, j = np.nonzero(fresh)
            some = survivors(signatures, a[i], b[j], limits)
            if len(some):
                yield a[i[some]], b[j[some]]


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) of shingle sets reach ``percent``.

    Where few pairs are asked of many rows, each is intersected; else all are
    counted by products of the rows' indicator vectors, some columns at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(rows):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        at = np.full(len(sets), -1)
        at[rows] = np.arange(len(rows))
        values, column = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), sizes[rows])
        shared = np.flatnonzero(np.bincount(column)[column] > 1)
        shared = shared[np.argsort(column[shared], kind="stable")]
        column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
        both = np.zeros((len(rows), len(rows)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, (lo, lo + COLUMNS))
            part = np.zeros((len(rows), COLUMNS), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            both += part @ part.T
        common = both[at[i], at[j]].astype(np.int64)
    return 100 * common >= percent * (sizes[i] + sizes[j] - common)


def signature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, shingle_set, number of shingles, bands and the low 16 bits of each MinHash value."""

    def signed(texts: list[str | None]) -> tuple[list, ...]:
        keys, sizes, bands, signatures = [], [], [], []
        for _, _, encoded in chunks(texts):
            sets = shingle_sets(encoded)
            some = [s for s in sets if len(s)]
            values = minhash(some) if some else np.empty((0, BANDS * ROWS), np.uint32)
            banded, short = iter(band_keys(values)), iter(mix(values.astype(np.uint64)).astype("<u2"))
            for s in sets:
                keys.append(set_key(s))
                sizes.append(len(s))
                bands.append(next(banded).tobytes() if len(s) else None)
                signatures.append(next(short).tobytes() if len(s) else None)
        return keys, sizes, bands, signatures

    return add_by_text(docs, signed, "shingle_set binary, shingles int, bands binary, signature binary", ["doc_id"], 2000)


def banded(classes: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(key, bucket) of the classes; ``among``: only buckets that a bitmap may hold."""
    sent = None if among is None else classes.sparkSession.sparkContext.broadcast(among)

    def explode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            buckets = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
            row = np.repeat(np.arange(batch.num_rows), BANDS)
            if sent is not None:
                some = maybe_in(sent.value, mix(buckets.view(np.uint64)))
                buckets, row = buckets[some], row[some]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(buckets)], ["key", "bucket"])

    return classes.select("key", "bands").mapInArrow(explode, "key binary, bucket long")


def mixed(column: str) -> Column:
    """A column's 64 bits mixed once more, as bitmaps take them."""

    @F.pandas_udf("long")
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series(mix(values.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return apply(column)


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, bucket, members) for the buckets that may hold a new pair."""
    # two sums of hashes tell the sets of members apart
    sums = banded(classes).select("bucket", F.xxhash64("key").alias("x"), F.xxhash64(F.lit(5), "key").alias("y")).groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("members > 1")
    # where a later band has the same members, all its pairs meet in an earlier one
    first = sums.groupBy("members", "x", "y").agg(F.min(F.struct(F.col("bucket").bitwiseAND(int(BAND)).alias("band"), "bucket")).alias("b")).select("b.bucket", "members")
    # a table of its own, so that the join with it may be split where a bucket is very large
    buckets = materialise(first, "buckets")
    return banded(classes, bitmap(buckets.select(mixed("bucket").alias("hash")))).join(buckets, "bucket")


def similarity_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    percent, limits = round(100 * threshold), least_matches(threshold)
    plain = docs.select("doc_id", "text")
    signed = materialise(signature_rows(plain), "signatures")
    with_set = signed.filter(F.col("doc_id").isNotNull() & F.col("shingle_set").isNotNull())
    classes = with_set.groupBy(F.col("shingle_set").alias("key")).agg(F.count("*").alias("weight"), F.min("doc_id").alias("first_id"), F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
    classes = materialise(classes, "classes")
    keys, carried = ["bucket", "left", "right"], ["block", "key", "weight", "bands", "signature"]
    members = materialise(bucket_members(classes).join(classes.select("key", "weight", "shingles", "bands", "signature"), "key"), "members")
    sizes = materialise(members.groupBy("bucket").agg(F.sum("shingles").alias("size")), "sizes")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
    dealt = block_pairs(members.join(sizes, "bucket"), "key", blocks).select(*keys, *carried)

    def of_group(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
        right = (group["block"] == group["right"]).to_numpy()
        return np.frombuffer(b"".join(group["bands"]), "<i8").reshape(len(group), BANDS), np.frombuffer(b"".join(group["signature"]), "<u2").reshape(len(group), -1), right, bool(group["left"].iloc[0] == group["right"].iloc[0]), int(group["bucket"].iloc[0]) & int(BAND)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, keys):
            stays = np.zeros(len(rows), bool)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo > 1:
                    for i, j in surviving_pairs(*of_group(rows.iloc[lo:hi]), limits):
                        stays[lo + i] = stays[lo + j] = True
            yield rows[stays]

    schema = "bucket long, left int, right int, block int, key binary, weight long, bands binary, signature binary"
    kept = materialise(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(prune, schema), "survivors")
    # texts of classes with survivors are told by a bitmap of bounded size and leave the tasks as shingles; no other text moves
    wanted = kept.select("key").distinct().join(classes.select("key", "first_id"), "key")
    held = plain.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("first_id").alias("hash"))))

    def with_shingles(batches: Iterator) -> Iterator:
        for batch in batches:
            some = np.flatnonzero(maybe_in(held.value, batch.column("hash").to_numpy().view(np.uint64)))
            for _, _, encoded in chunks(batch.column("text").take(rows_at(some)).to_pylist()):
                sets = shingle_sets(encoded)
                yield arrow_batch("key binary, shingles binary", [[set_key(s) for s in sets], [s.tobytes() for s in sets]])

    found = plain.select(F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(with_shingles, "key binary, shingles binary")
    whole = found.filter(F.col("key").isNotNull()).dropDuplicates(["key"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, keys):
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                group = rows.iloc[lo:hi]
                n, weight = hi - lo, group["weight"].to_numpy(np.int64)
                sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
                count, tied = np.zeros(n, np.int64), []
                for i, j in surviving_pairs(*of_group(group), limits):
                    linked = exact_links(sets, i, j, percent)
                    i, j = i[linked], j[linked]
                    count += (np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)).astype(np.int64)
                    root = spanning(n, i, j)
                    tied.append((np.flatnonzero(root != np.arange(n)), root))
                some = np.flatnonzero(count)
                if len(some):
                    root = spanning(n, np.concatenate([x for x, _ in tied]), np.concatenate([r[x] for x, r in tied]))
                    names = group["key"].to_numpy()
                    yield pd.DataFrame({"a": names[some], "b": names[root[some]], "n": count[some]})

    checked = kept.join(whole, "key").repartition(*keys).sortWithinPartitions(*keys)
    links = materialise(checked.select(*keys, *carried, "shingles").mapInPandas(verify, "a binary, b binary, n long"), "links")
    by_set = linked_classes(classes, links).withColumnRenamed("key", "shingle_set")
    known = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("shingle_set")).alias("shingle_set"))
    out = known.join(by_set, "shingle_set", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
