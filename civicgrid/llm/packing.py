"""Best-fit packing by large-item matching.

Pieces above one third of the capacity fit at most twice in a sequence: a greedy
matching, largest first, gives each the largest partner that still fits. Smaller
pieces then go, largest first, to the tightest gap that holds them, and open a
new sequence only where there is none.

Pieces of one length are alike, so the plan is made on the number of pieces of
each length: at most ``capacity`` numbers whatever the corpus, summed on the
executors. It says for each length which run of ranks goes to which run of
sequences; every piece then finds its place by its rank among those of its
length. Ranks are dealt by (length, salt), a salt for every ``RANKED`` pieces of a
length, so that no task ranks many more than that.

Null texts are empty documents with only the end id; a null doc_id stays null.
Repeated rows are packed each on their own. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicgrid.llm.common import arrow_batch, materialise, ready, rows_at
from civicgrid.llm.tokenizing import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
RANKED = 1000


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place all pieces.

    ``counts``: number of pieces by length. The work depends on the number of
    different lengths and gaps, at most ``capacity`` each, not on the pieces.
    """
    left = {length: n for length, n in counts.items() if n}
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used.get(length, 0), n, sequence, offset))
        used[length] = used.get(length, 0) + n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((sequence, n))

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect_left(large, min(capacity - length, length) + 1) - 1
            while at >= 0 and (not left[large[at]] or large[at] == length and left[length] < 2):
                at -= 1
            if at < 0:
                n = left[length]
                place(length, n, sequences, 0)
                leave(capacity - length, sequences, n)
            else:
                partner = large[at]
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                place(length, n, sequences, 0)
                place(partner, n, sequences, length)
                leave(capacity - length - partner, sequences, n)
            sequences += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                n = -(-left[length] // (capacity // length))
                leave(capacity, sequences, n)
                sequences += n
                at = bisect_left(order, length)
            gap = order[at]
            sequence, held = gaps[gap].pop()
            n = min(held, left[length])
            if n < held:
                gaps[gap].append((sequence + n, held - n))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            place(length, n, sequence, capacity - gap)
            leave(gap - length, sequence, n)
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` and cut what is longer than ``capacity``."""

    def cut_up(batches: Iterator) -> Iterator:
        tail, coder, size = np.array([end_id], "<u4").tobytes(), encoder(tokenizer), 4 * capacity
        for batch in batches:
            row, rest = [], []
            for i, ids in enumerate(coder.encode(batch.column("text").to_pylist())):
                ids += tail
                cuts = range(0, len(ids), size)
                row += [i] * len(cuts)
                rest += [(k, k * capacity, len(ids[x : x + size]) // 4, zlib.crc32(ids[x : x + size])) for k, x in enumerate(cuts)]
            yield arrow_batch(PIECES, [batch.column("doc_id").take(rows_at(row)), *zip(*rest, strict=True)] if row else [[]] * 5)

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, whose ``length`` is 1 to ``capacity``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(plan_packing(counts, capacity))
    table = np.array(runs, np.int64).reshape(-1, 5)
    often = [F.lit(x).cast("long") for length, n in counts.items() if n > RANKED for x in (length, -(-n // RANKED))]
    salts = F.coalesce(F.try_element_at(F.create_map(*often), F.col("length")), F.lit(1)) if often else F.lit(1)
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), salts).cast("int"))
    by_salt = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = by_salt.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")

    def look_up(batches: Iterator) -> Iterator:
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            run = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            yield arrow_batch(PACKED, [*batch.columns[:5], run[:, 3] + rank - run[:, 1], run[:, 4]])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(look_up, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """A row for each piece of each document and its place in the packed sequences."""
    return pack(materialise(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
