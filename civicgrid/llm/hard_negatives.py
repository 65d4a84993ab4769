"""Hard negatives by bit-sliced integer products.

Components become integers, floor(scale * x), and a row's score for an anchor is
their integer inner product. An anchor's positives are the best other rows of its
label; the negatives of a positive are the best rows of other labels whose score
is from ``at_least`` to ``at_most`` per cent of the positive's.

1. Anchors meet rows in blocks: a task has at most about ``ANCHORS`` anchors and
   ``ROWS`` rows, of one label for the positives and of all for the negatives. No
   label and no copy makes a task larger, as blocks go by the hash of a row.
2. In a task the rows' components are taken apart into bit planes, the sign first.
   After each plane an anchor's product with it is added, and what the lower planes
   can still add lies between the sums of the anchor's negative and of its positive
   components times their weight: every score has an interval.
3. A pair is dropped once its interval can't qualify: for positives when it ends below
   the wanted number of lower ends; for negatives when it meets no window, or ends
   below the wanted number of intervals that lie in the window for certain. What is
   left after the last plane has its exact score. Ties are never dropped.
4. Each task's best come together by anchor, and the best of them stay.

A row with a null id, a null label, a null vector or a null or non-finite component
takes no part, nor does one with a component that no long holds after scaling.
Rows that are equal in id, label and vector count once; a row never meets one of its
own id. Vectors of different lengths don't meet; those without components have score
0. Scores outside the range of a long are exact inside a task, but such pairs are
left out of the result. Labels of any plain type are told apart by their text. An
empty table gives no rows. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicgrid.llm.common import arrow_batch, materialise, ready, whole_groups

ROWS, ANCHORS = 8192, 1024
#: Anchors whose pairs with a block of rows are held at once.
AT_ONCE = 64
#: Pairs whose components are multiplied at once where few are left.
PAIRS = 1 << 14

INTEGERS = "vec_id long, label string, size int, key binary, ints binary"


def integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, number of components, a key of the row, and its integers in 2, 4 or 8 bytes each; one row for equal ones."""

    def convert(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, labels, lists = batch.column("vec_id"), batch.column("label").to_pylist(), batch.column("embedding")
            out = [[], [], [], [], []]
            for vec_id, label, found in zip(ids.to_pylist(), labels, lists, strict=True):
                if vec_id is None or label is None or found.values is None:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * found.values.to_numpy(zero_copy_only=False).astype(np.float64))
                most = np.abs(x).max(initial=0.0)
                if not most < 2.0**63:  # not a number, or too large
                    continue
                ints = x.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8").tobytes()
                key = hashlib.blake2b(b"%d %d " % (vec_id, len(x)) + ints + label.encode(), digest_size=16).digest()
                for column, value in zip(out, (vec_id, label, len(x), key, ints), strict=True):
                    column.append(value)
            yield arrow_batch(INTEGERS, out)

    ready(vectors.sparkSession)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(convert, INTEGERS).dropDuplicates(["key"])


def matrix(ints, size: int) -> np.ndarray:
    """Rows of integers, whatever their widths."""
    return np.stack([np.frombuffer(x, f"<i{len(x) // size if size else 2}") for x in ints]).astype(np.int64)


def plane_products(a: np.ndarray, plane: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows ``i`` of ``a`` with rows ``j`` of a bit plane: a matrix product while many pairs are left."""
    if 4 * len(i) >= len(a) * len(plane) and a.dtype != object:
        return (a.astype(np.float64) @ plane.T.astype(np.float64))[i, j].astype(np.int64)
    out = np.zeros(len(i), a.dtype)
    for at in range(0, len(i), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = (a[i[some]] * plane[j[some]]).sum(axis=1)
    return out


def sliced_scores(a: np.ndarray, x: np.ndarray, allowed: np.ndarray, qualify: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the allowed pairs of rows of ``a`` and ``x`` that ``qualify(i, low, high)`` lets through to the last bit plane of ``x``."""
    bits = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 0).bit_length() + 1
    most = int(np.abs(a).max(initial=0)) if a.size else 0
    if a.shape[1] * most >= 2**53 or a.shape[1] * most << bits >= 2**62:
        a, x = a.astype(object), x.astype(object)
    less, more = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    i, j = np.nonzero(allowed)
    score = np.zeros(len(i), a.dtype)
    for k in range(bits - 1, -1, -1):
        if 4 * len(i) < allowed.size:  # rows of which no pair is left go
            some, j = np.unique(j, return_inverse=True)
            x, names = x[some], some if k == bits - 1 else names[some]
        elif k == bits - 1:
            names = np.arange(len(x))
        weight = -(1 << k) if k == bits - 1 else 1 << k
        score = score + plane_products(a, (x >> k) & 1, i, j) * weight
        rest = (1 << k) - 1
        kept = qualify(i, score + rest * less[i], score + rest * more[i])
        i, j, score = i[kept], j[kept], score[kept]
    return i, names[j], score


def segments(i: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(anchor, its pairs) of pairs in the order of anchors."""
    names, starts = np.unique(i, return_index=True)
    for name, lo, hi in zip(names.tolist(), starts.tolist(), np.append(starts, len(i))[1:].tolist(), strict=True):
        yield name, slice(lo, hi)


def nth_largest(values: np.ndarray, n: int):
    return np.partition(values, len(values) - n)[len(values) - n]


def among_best(n: int) -> Callable:
    """Intervals that may be among the ``n`` best of their anchor that a long holds."""

    def qualify(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = low < 2**63
        for _, s in segments(i):
            certain = low[s][high[s] < 2**63]
            if len(certain) > n:
                kept[s] &= high[s] >= nth_largest(certain, n)
        return kept

    return qualify


def among_windows(windows: list[list[tuple[int, int]]], n: int) -> Callable:
    """Intervals that may be among the ``n`` best in one of their anchor's ``windows``."""

    def qualify(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(i), bool)
        for anchor, s in segments(i):
            for first, last in windows[anchor]:
                certain = low[s][(low[s] >= first) & (high[s] <= last)]
                least = max(first, nth_largest(certain, n)) if len(certain) >= n else first
                kept[s] |= (high[s] >= least) & (low[s] <= last)
        return kept

    return qualify


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best that a long holds: highest score first, then smallest id."""
    fit = np.flatnonzero((scores >= -(2**63)) & (scores < 2**63))
    return fit[np.lexsort((ids[fit], ~scores[fit].astype(np.int64)))[:n]] if len(fit) else fit


def window(score: int, at_least: int, at_most: int) -> tuple[int, int]:
    """Scores s with at_least * score <= 100 * s <= at_most * score; empty where the first is larger than the last."""
    return -(-at_least * score // 100), at_most * score // 100


def dealt(rows: DataFrame, anchors: DataFrame, sizes: DataFrame, by: list[str], columns: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of ``anchors`` (anchor is true) beside blocks of ``rows``, each pair of blocks of one value of ``by`` together; ``carried``: further columns of anchors."""
    sizes = sizes.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / ROWS)).cast("int").alias("row_blocks"), F.ceil(F.sum("n_anchors") / ANCHORS).cast("int").alias("anchor_blocks"))
    own = lambda n: F.pmod(F.xxhash64("key", F.lit(23)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, by).withColumn("anchor_block", own(F.col("anchor_blocks"))).withColumn("row_block", every("row_blocks"))
    right = rows.join(sizes.filter("anchor_blocks > 0"), by).withColumn("row_block", own(F.col("row_blocks"))).withColumn("anchor_block", every("anchor_blocks"))
    keys = [*by, "row_block", "anchor_block"]
    both = left.select(*keys, F.lit(True).alias("anchor"), *columns, *carried).unionByName(right.select(*keys, F.lit(False).alias("anchor"), *columns), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, F.col("anchor").desc(), "vec_id", "key")


def compared(blocks: DataFrame, keys: list[str], search: Callable, schema: str) -> DataFrame:
    """What ``search(anchors, rows)`` (two frames of one group, at most ``AT_ONCE`` anchors) gives for every group of ``keys``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held, starts in whole_groups(batches, keys):
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                group = held.iloc[lo:hi]
                anchors, rows = group[group["anchor"]], group[~group["anchor"]]
                if len(anchors) and len(rows):
                    size = int(rows["size"].iloc[0])
                    a, x = matrix(anchors["ints"], size), matrix(rows["ints"], size)
                    for at in range(0, len(anchors), AT_ONCE):
                        found = search(anchors.iloc[at : at + AT_ONCE], a[at : at + AT_ONCE], rows, x)
                        yield pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    return blocks.mapInPandas(run, schema)


def first_of(rows: DataFrame, by: list[str], score: str, other: str, n: int) -> DataFrame:
    """The ``n`` best of each ``by`` with their place."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), other, "other_key")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, at_least: int = 50, at_most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives of each anchor and positive."""
    rows = materialise(integer_rows(vectors, scale).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), "integers")
    anchors = rows.filter("is_anchor")
    sizes = materialise(rows.groupBy("label", "size").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("n_anchors")), "label-sizes")
    columns = ["vec_id", "key", "ints"]

    def search_same(anchors, a, rows, x):
        ids, own, names = rows["vec_id"].to_numpy(np.int64), anchors["vec_id"].to_numpy(np.int64), rows["key"].to_numpy()
        i, j, score = sliced_scores(a, x, own[:, None] != ids[None, :], among_best(positives))
        out = []
        for k, s in segments(i):
            for p in best(score[s], ids[j[s]], positives).tolist():
                out.append((anchors["key"].iloc[k], int(own[k]), int(ids[j[s][p]]), names[j[s][p]], int(score[s][p])))
        return out

    by = ["label", "size"]
    found = compared(dealt(rows, anchors, sizes, by, columns), [*by, "row_block", "anchor_block"], search_same, "anchor_key binary, anchor_id long, positive_id long, other_key binary, positive_score long")
    chosen = first_of(found, ["anchor_key"], "positive_score", "positive_id", positives).withColumnRenamed("rank", "positive_rank")
    listed = chosen.groupBy(F.col("anchor_key").alias("key")).agg(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score")).alias("positives"))
    asked = materialise(anchors.join(listed, "key"), "positives")

    def search_other(anchors, a, rows, x):
        ids, own, names = rows["vec_id"].to_numpy(np.int64), anchors["vec_id"].to_numpy(np.int64), rows["key"].to_numpy()
        allowed = (own[:, None] != ids[None, :]) & (anchors["label"].to_numpy()[:, None] != rows["label"].to_numpy()[None, :])
        listed = [[(p, window(p["positive_score"], at_least, at_most)) for p in some] for some in anchors["positives"]]
        i, j, score = sliced_scores(a, x, allowed, among_windows([[w for _, w in some if w[0] <= w[1]] for some in listed], negatives))
        out = []
        for k, s in segments(i):
            for p, (first, last) in listed[k]:
                inside = np.flatnonzero((score[s] >= first) & (score[s] <= last))
                for q in inside[best(score[s][inside], ids[j[s][inside]], negatives)].tolist():
                    out.append((anchors["key"].iloc[k], int(own[k]), int(p["positive_rank"]), int(p["positive_id"]), int(p["positive_score"]), int(ids[j[s][q]]), names[j[s][q]], int(score[s][q])))
        return out

    schema = "anchor_key binary, anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, other_key binary, negative_score long"
    wanted = sizes.join(asked.groupBy("label", "size").agg(F.count("*").alias("asked")), ["label", "size"], "left").select("label", "size", "n", F.coalesce("asked", F.lit(0)).alias("n_anchors"))
    blocks = dealt(rows, asked, wanted, ["size"], [*columns, "label"], ("positives",))
    found = compared(blocks, ["size", "row_block", "anchor_block"], search_other, schema)
    return first_of(found, ["anchor_key", "positive_rank"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
