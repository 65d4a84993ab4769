"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors of one label link at a cosine of ``threshold`` or more, in double precision.

1. Equal vectors of a label are one class, compared once.
2. Spherical k-means on a bounded sample of a label's classes gives a centre for
   every ``CELL`` of them, at least two and ``MAX_CENTRES`` at most, none nearer than
   2 r (below) to another; each class belongs to the cell of its nearest centre. Cells
   with more than ``SPLIT`` classes are split again in the same way, so that their
   number grows with the vectors.
3. Linked vectors x, y are at most r = sqrt(2 - 2 threshold) apart. If they are in
   cells a and b, one of them is at most r / 2 from the plane between the two
   centres, and a vector also visits every cell to whose plane it is that near: no
   pair is lost at a border. Where both would meet in either cell, they count in
   the lower one.
4. Vectors of a cell that are at most r / 2 from its centre all link with each other:
   they are the cell's core, and are counted by a sum.
5. All other pairs of a cell are dealt in pairs of blocks, of which one at least has
   vectors outside the core; a task multiplies two blocks and gives counts and
   spanning edges. Components come from the edges, and one vector of each is kept.

A vector that is null, zero or holds null or non-finite components, and one of a
null label, links with nothing; vectors of different lengths don't link. Labels
of any plain type are told apart by their text. A null vec_id is its own
component, null. Repeated rows link with each other. An empty table gives no
rows. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import arrow_batch, group_starts, linked_classes, materialise, ready, spanning, whole_groups

#: Sampled vectors for the centres of one cell.
MAX_SAMPLE = 20_000
MAX_CENTRES = 1024
CELL = 1024
SPLIT = 4 * CELL
BLOCK = 1024
LEVELS = 6
#: Rows that one task assigns to the cells below one cell.
DEALT = 50_000

UNITS = "vec_id long, label string, key binary, cell binary, unit binary"
ROWS = "cell binary, key binary, weight long, unit binary, here array<int>, home array<int>, visits array<array<int>>, core boolean"


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` unit centres of the unit rows of ``x``; a centre without rows stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def far_apart(centres: np.ndarray, least: float) -> np.ndarray:
    """The centres that are at least ``least`` from each one kept before: nearer ones would be visited by all of each other's vectors."""
    kept = [0]
    for k in range(1, len(centres)):
        if np.linalg.norm(centres[kept] - centres[k], axis=1).min() >= least:
            kept.append(k)
    return centres[kept]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, a key of (label, vector), the first cell (label and length) and the vector at length 1; key is null for what links with nothing."""

    def scale(batches: Iterator) -> Iterator:
        for batch in batches:
            keys, cells, units = [], [], []
            labels = batch.column("label").to_pylist()
            for label, values in zip(labels, batch.column("embedding").to_pylist(), strict=True):
                v = np.array([np.nan if c is None else c for c in values], np.float64) if values is not None else np.empty(0)
                size = np.abs(v).max(initial=0.0)
                if label is None or not size or not np.isfinite(v).all():
                    keys.append(None), cells.append(None), units.append(None)
                else:
                    scaled = v / size
                    units.append((scaled / np.sqrt((scaled * scaled).sum())).tobytes())
                    keys.append(hashlib.blake2b((v + 0.0).tobytes() + label.encode(), digest_size=16).digest())
                    cells.append(hashlib.blake2b(b"%d " % len(v) + label.encode(), digest_size=16).digest())
            yield arrow_batch(UNITS, [batch.column("vec_id"), batch.column("label"), keys, cells, units])

    ready(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(scale, UNITS)


def cells_of(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's own cell, which cells it visits, and whether it is so near its own centre that all such rows link."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[home]
    gap = near[np.arange(len(x)), home][:, None] - near
    visits = gap <= reach / 2 * apart + 1e-9
    visits[np.arange(len(x)), home] = False
    return home, visits, np.linalg.norm(x - centres[home], axis=1) <= reach / 2 - 1e-9


def cell_centres(rows: DataFrame, large: DataFrame, reach: float, least: int) -> DataFrame:
    """cell, n and centres of those cells in ``large`` (cell, n) that have at least ``least`` centres."""
    rate = F.least(F.lit(1.0), F.lit(float(MAX_SAMPLE)) / F.col("n"))
    sample = rows.join(large, "cell").filter(F.pmod(F.xxhash64("key", F.lit(13)), F.lit(1_000_003)) < F.lit(1_000_003) * rate)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(u) for u in group.sort_values("key")["unit"]])
        wanted = max(2, -(-int(group["n"].iloc[0]) // CELL))
        centres = far_apart(spherical_kmeans(x, min(MAX_CENTRES, len(x), wanted)), 2 * reach)
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], "centres": [centres.tobytes()]}).iloc[: len(centres) + 1 - least]

    return sample.select("cell", "n", "key", "unit").groupBy("cell").applyInPandas(fit, "cell binary, centres binary").join(large, "cell")


def split_cells(rows: DataFrame, centres: DataFrame, reach: float) -> DataFrame:
    """``rows`` of the cells in ``centres`` (cell, n, centres), each in the cells below that it belongs to or visits."""
    salts = F.ceil(F.col("n") / DEALT).cast("int")
    columns = [x.split()[0] for x in ROWS.split(", ")]
    dealt = rows.join(centres.select("cell", "n"), "cell").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(17)), salts).cast("int")).select(*columns, "salt", F.lit(None).cast("binary").alias("centres"))
    first = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    first = first.select("cell", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ROWS.split(", ")[1:]], "salt", "centres")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = None
        for batch in batches:
            starts = np.append(group_starts(batch, ["cell", "salt"]), len(batch))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                group = batch.iloc[lo:hi]
                if group["centres"].iloc[0] is not None:
                    below = np.frombuffer(group["centres"].iloc[0])
                    group = group.iloc[1:]
                for at in range(0, len(group), 256):
                    some = group.iloc[at : at + 256]
                    x = np.stack([np.frombuffer(u) for u in some["unit"]])
                    own, visits, near = cells_of(x, below.reshape(-1, x.shape[1]), reach)
                    visits[np.arange(len(x)), own] = True
                    row, to = np.nonzero(visits)
                    visits[np.arange(len(x)), own] = False
                    listed = [np.flatnonzero(v).tolist() for v in visits]
                    out = some.iloc[row][["key", "weight", "unit"]]
                    parent, here, home, seen = (some[c].to_numpy()[row] for c in ("cell", "here", "home", "visits"))
                    out.insert(0, "cell", [hashlib.blake2b(p + b"%d" % t, digest_size=16).digest() for p, t in zip(parent, to.tolist(), strict=True)])
                    out["here"] = [[*h, t] for h, t in zip(here, to.tolist(), strict=True)]
                    out["home"] = [[*h, int(own[r])] for h, r in zip(home, row.tolist(), strict=True)]
                    out["visits"] = [[*[list(v) for v in s], listed[r]] for s, r in zip(seen, row.tolist(), strict=True)]
                    out["core"] = [bool(near[r]) and a == b for r, a, b in zip(row.tolist(), out["here"], out["home"], strict=True)]
                    yield out

    keys = ["cell", "salt"]
    return dealt.unionByName(first).repartition(*keys).sortWithinPartitions(*keys, F.col("centres").isNull()).mapInPandas(assign, ROWS)


def counted_here(here: np.ndarray, home: np.ndarray, visits: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows of one cell count in it, by the cells of every level on the way to it.

    ``here``: the cell's number at each level; ``home`` and ``visits``: of each row
    and level. Two rows at home count; of one at home and a visitor whose home is
    lower, only if the first doesn't visit that home in its turn.
    """
    ok = np.ones(len(i), bool)
    for level, cell in enumerate(here.tolist()):
        own = home[:, level]
        homes, at = np.unique(own, return_inverse=True)
        seen = np.zeros((len(own), len(homes)), bool)
        place = {h: k for k, h in enumerate(homes.tolist())}
        for r, listed in enumerate(visits):
            for h in listed[level]:
                if h in place:
                    seen[r, place[h]] = True
        one = lambda x, y: (own[x] == cell) & ((own[y] >= cell) | ~seen[x, at[y]])  # noqa: B023, E731
        ok &= one(i, j) | one(j, i)
    return ok


def vector_classes(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id (smallest vec_id reached), kept (it is that one)."""
    units = materialise(unit_vectors(vectors), "units")
    whole = units.filter(F.col("key").isNotNull() & F.col("vec_id").isNotNull())
    classes = materialise(whole.groupBy("key", "cell").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"), F.any_value("unit").alias("unit")), "vector-classes")
    reach = float(np.sqrt(2 - 2 * threshold))
    none = F.array().cast("array<int>")
    rows = classes.select("cell", "key", "weight", "unit", none.alias("here"), none.alias("home"), F.array().cast("array<array<int>>").alias("visits"), F.lit(False).alias("core"))
    whole_cells = classes.select("cell").limit(0)
    for level in range(LEVELS + 1):
        # tables of their own, so that joins with them may be split where a cell is large
        sizes = materialise(rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("core").alias("in_core")).filter("n > 1"), "sizes")
        large = sizes.filter(F.col("n") > (SPLIT if level else 1)).join(whole_cells, "cell", "left_anti")
        if level == LEVELS or large.isEmpty():
            break
        centres = materialise(cell_centres(rows, large, reach, 2 if level else 1), "centres")
        whole_cells = materialise(large.join(centres, "cell", "left_anti").select("cell").union(whole_cells), "whole-cells")
        kept = rows.join(centres, "cell", "left_anti").select(*[x.split()[0] for x in ROWS.split(", ")])
        rows = materialise(kept.union(split_cells(rows, centres, reach)), "cells")
    keys = ["cell", "left", "right"]
    # blocks of the core come first; each meets the blocks outside it, and those meet each other
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    inner, outer = blocks(F.col("in_core")), blocks(F.col("n") - F.col("in_core"))
    own = lambda n: F.pmod(F.xxhash64("key", F.lit(7)), F.greatest(n, F.lit(1))).cast("int")
    block = F.when(F.col("core"), own(inner)).otherwise(inner + own(outer))
    dealt = rows.join(sizes, "cell").withColumn("block", block).filter(outer > 0).withColumn("other", F.explode(F.sequence(F.when(F.col("core"), inner).otherwise(0), inner + outer - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "here", "home", "visits", "key", "weight", "unit")
    cores = rows.filter("core").groupBy("cell").agg(F.sum("weight").alias("all"), F.min("key").alias("b"))
    core_links = rows.filter("core").join(cores, "cell").select(F.col("key").alias("a"), "b", (F.col("all") - F.col("weight")).alias("n")).filter("n > 0")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, keys):
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                group = rows.iloc[lo:hi]
                x, block, n = np.stack([np.frombuffer(u) for u in group["unit"]]), group["block"].to_numpy(), hi - lo
                linked = np.triu(x @ x.T >= threshold, 1)
                if group["left"].iloc[0] != group["right"].iloc[0]:
                    linked &= block[:, None] != block[None, :]
                i, j = np.nonzero(linked)
                if len(i) and len(group["here"].iloc[0]):
                    ok = counted_here(np.array(group["here"].iloc[0]), np.stack(group["home"].to_list()), group["visits"].to_list(), i, j)
                    i, j = i[ok], j[ok]
                if len(i):
                    weight, names = group["weight"].to_numpy(np.int64), group["key"].to_numpy()
                    count = (np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)).astype(np.int64)
                    some = np.flatnonzero(count)
                    yield pd.DataFrame({"a": names[some], "b": names[spanning(n, i, j)[some]], "n": count[some]})

    links = materialise(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a binary, b binary, n long").union(core_links), "vector-links")
    by_key = linked_classes(classes, links)
    known = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"))
    out = known.join(by_key, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
