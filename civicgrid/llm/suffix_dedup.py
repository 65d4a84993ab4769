"""Repeated passages by suffix arrays, sorted by linear grouping construction.

Removed is every byte inside a string of ``length`` bytes that starts at two or
more places, in one document or in several, judged on the input.

1. Each such window has an anchor: the last smallest hash of the ``ANCHOR``-byte
   strings in it. Equal windows have equal anchors at the same place, so windows
   are dealt by their anchor's hash and only those of one anchor can be equal.
   Neighbouring windows of one anchor form a segment; anchors that occur once
   are dropped, equal segments are kept once with their number.
2. The different segments of an anchor are aligned on it. Columns where the same
   segments agree are one symbol, so that a segment becomes a short string.
3. A generalised suffix array over those strings, by ``suffix_array``, puts
   suffixes that agree longest next to each other; a window is repeated if its
   suffix shares ``length`` bytes with a neighbour, or its segment occurs again.
   A segment that is an anchor's only one needs no order: it occurs twice.
4. Groups of more than ``GROUP`` segments are first halved again and again by
   where their windows start: each half has a longer common part, whose hash
   deals them anew, down to single windows. A half that occurs again is repeated
   as a whole in every segment that has it; one of its rows goes on, for others
   to be compared with, so that a group has as many rows as different halves.

What is decided where: segments that are equal as a whole, halves that are, and
the only segment of an anchor are told apart by 64 bits or more of hash and occur
twice or not; which parts of different segments repeat, the suffix array says.

Null texts are empty; texts shorter than ``length`` keep all. Repeated rows are
repeats of each other, so both lose what is long enough. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import TYPES, group_starts, materialise, mix, powers, prefix_hash, release, whole_groups

LENGTH = 200
ANCHOR = 48
GROUP = 2000
SYMBOLS = 60_000

ANCHORED = "doc_id long, text_hash long, anchor long, segment long, start int, windows int, before int"
PIECE = "anchor long, segment long, first int, windows int, before int, weight long, bytes binary, part long"


def suffix_array(text: list[int]) -> list[int]:
    """Positions of all suffixes in order, for a text of ranks 0.. whose last is the only 0.

    Groups hold the suffixes of one Lyndon prefix, known so far. From the highest
    on, each group finds its members' previous smaller suffixes; those that the
    group follows equally often leave their own groups for new ones right above.
    Then the groups' order is emitted: each suffix places the one before it, and
    that one's previous smaller ones, at the front of their groups.
    """
    n = len(text)
    if n == 0:
        return []
    sizes = [0] * (max(text) + 1)
    for c in text:
        sizes[c] += 1
    start_of, total = [], 0
    for size in sizes:
        start_of.append(total)
        total += size
    group = [start_of[c] for c in text]  # a group's name is its first slot
    end = [0] * (n + 1)
    slot, fill, members = [0] * n, start_of[:], [0] * n
    for i, c in enumerate(text):
        slot[i] = fill[c]
        members[fill[c]] = i
        fill[c] += 1
    for c, size in enumerate(sizes):
        if size:
            end[start_of[c]] = start_of[c] + size
    smaller = [-1] * n
    top = n
    while top > 0:
        here = group[members[top - 1]]
        if top - here == 1:
            i = members[here]
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and (last := end[group[j]] - 1) > group[j]:
                other, at = members[last], slot[j]
                members[at], members[last] = other, j
                slot[other], slot[j] = at, last
                end[group[j]], end[last] = last, last + 1
                group[j] = last
            top = here
            continue
        followed: dict[int, int] = {}
        for i in sorted(members[here:top]):
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        times: dict[int, list[int]] = {}
        for j, k in followed.items():
            times.setdefault(k, []).append(j)
        for k in sorted(times, reverse=True):
            moved: dict[int, int] = {}
            for j in times[k]:
                own = group[j]
                last = moved.get(own, end[own]) - 1
                moved[own] = last
                other, at = members[last], slot[j]
                members[at], members[last] = other, j
                slot[other], slot[j] = at, last
            for own, first in moved.items():
                if first > own:
                    upper = end[own]
                    end[own], end[first] = first, upper
                    for at in range(first, upper):
                        group[members[at]] = first
        top = here
    front, placed, order = group, [False] * n, [-1] * n
    cursor = list(range(n + 1))
    order[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            g = front[j]
            order[cursor[g]] = j
            cursor[g] += 1
            placed[j] = True
            j = smaller[j]
    return order


def segments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first window, number of windows, anchor's offset) of each segment."""
    width = length - ANCHOR + 1
    codes = np.frombuffer(data, np.uint8)
    if len(codes) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    sums, inverse = prefix_hash(codes.astype(np.uint16) + 1), powers(len(codes) + 1)[1]
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(codes) - ANCHOR + 1])
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = hashes & ~low | (low - np.arange(len(hashes), dtype=np.uint64))  # equal hashes: the last
    runs, span = len(hashes) - width + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:runs], least[width - span : width - span + runs])
    chosen = (low - (least & low)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    after = np.append(first[1:], runs)
    anchor, windows = chosen[first], after - first
    whole = mix((sums[after + length - 1] - sums[first]) * inverse[first] + windows.astype(np.uint64))
    return hashes[anchor].view(np.int64), mix(whole ^ (anchor - first).astype(np.uint64)).view(np.int64), first, windows, anchor - first


def align(rows: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each row in each column, first column of each run of alike columns, first column of each row).

    Rows are aligned on their anchors. Rows of one class have the same byte there.
    """
    lead = before.max() - before
    width = int(max(lead + np.array([len(r) for r in rows])))
    grid = np.repeat(256 + np.arange(len(rows), dtype=np.int32)[:, None], width, axis=1)  # outside a row nothing agrees
    for r, (row, at) in enumerate(zip(rows, lead, strict=True)):
        grid[r, at : at + len(row)] = np.frombuffer(row, np.uint8)
    if len(rows) == 2:
        label = np.zeros(grid.shape, np.int32)
        label[1] = grid[0] != grid[1]
    else:
        order = np.argsort(grid, axis=0, kind="stable")
        ordered = np.take_along_axis(grid, order, axis=0)
        new = np.ones(grid.shape, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        leader = np.take_along_axis(order, np.maximum.accumulate(np.where(new, np.arange(len(rows))[:, None], 0), axis=0), axis=0)
        label = np.empty(grid.shape, np.int32)
        np.put_along_axis(label, order, leader.astype(np.int32), axis=0)
    change = np.ones(width, bool)
    change[1:] = (label[:, 1:] != label[:, :-1]).any(axis=0)
    return label, np.flatnonzero(change), lead


class Strings:
    """Strings of weighted symbols of many groups, for one suffix array."""

    def __init__(self):
        self.symbols: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.columns: list[np.ndarray] = []
        #: The first column of each row.
        self.lead: list[int] = []
        self.size, self.next = 0, 0

    def add(self, rows: list[bytes], before: np.ndarray) -> None:
        label, runs, lead = align(rows, before)
        widths = np.diff(np.append(runs, label.shape[1]))
        named = np.arange(len(runs), dtype=np.int64) * len(rows) + self.next
        for r, row in enumerate(rows):
            inside = (runs + widths > lead[r]) & (runs < lead[r] + len(row))
            self.symbols.append(named[inside] + label[r, runs[inside]])
            self.widths.append(widths[inside])
            self.columns.append(runs[inside])
            self.size += int(inside.sum()) + 1
        self.next += len(runs) * len(rows)
        self.lead.extend(lead.tolist())

    def longest(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each row the columns of its symbols, their widths and the most bytes that each suffix shares with another."""
        last = np.cumsum([len(s) + 1 for s in self.symbols]) - 1
        text, width = np.empty(self.size, np.int64), np.zeros(self.size, np.int64)
        body = np.ones(self.size, bool)
        body[last] = False
        text[body], width[body] = np.concatenate(self.symbols), np.concatenate(self.widths)
        text[~body] = -1 - np.arange(len(last))  # every end is another symbol, the last the smallest
        ranks = np.unique(text, return_inverse=True)[1]
        order = np.array(suffix_array(ranks.tolist()), np.int64)
        shared = np.zeros(self.size, np.int64)
        a, b, total, step = order[:-1], order[1:], np.zeros(self.size - 1, np.int64), 0
        live = np.arange(self.size - 1)
        while len(live):
            live = live[text[a[live] + step] == text[b[live] + step]]
            total[live] += width[a[live] + step]
            step += 1
        np.maximum.at(shared, a, total)
        np.maximum.at(shared, b, total)
        at, out = 0, []
        for columns, widths in zip(self.columns, self.widths, strict=True):
            out.append((columns, widths, shared[at : at + len(columns)]))
            at += len(columns) + 1
        return out


def repeated_windows(columns: np.ndarray, widths: np.ndarray, shared: np.ndarray, lead: int, windows: int, length: int) -> np.ndarray:
    """Which of a row's windows share ``length`` bytes: a suffix that starts inside a run shares the run's length less its offset."""
    left = np.repeat(shared + columns, widths) - np.concatenate([np.arange(c, c + w) for c, w in zip(columns, widths, strict=True)]) if len(columns) else np.empty(0, np.int64)
    skip = lead - int(columns[0]) if len(columns) else 0
    return left[skip : skip + windows] >= length


def spans(mask: np.ndarray) -> np.ndarray:
    """(first, after) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def anchored(docs: DataFrame, length: int) -> DataFrame:
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                anchor, segment, first, windows, before = segments(b"" if text is None else text.encode("utf-8", "replace"), length)
                if len(anchor):
                    held.append((np.full(len(anchor), doc_id), np.full(len(anchor), text_hash), anchor, segment, first.astype(np.int32), windows.astype(np.int32), before.astype(np.int32)))
                    size += len(anchor)
                if size > 100_000:
                    yield pd.DataFrame(dict(zip(NAMES, map(np.concatenate, zip(*held, strict=True)), strict=True)))
                    held, size = [], 0
            if held:
                yield pd.DataFrame(dict(zip(NAMES, map(np.concatenate, zip(*held, strict=True)), strict=True)))
        release()

    return docs.mapInPandas(cut_up, ANCHORED)


NAMES = [x.split()[0] for x in ANCHORED.split(", ")]


def keyed(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and what tells rows of one doc_id apart; equal rows share a key and all that is found for it."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text", *more)


def halve(pieces: DataFrame, length: int) -> DataFrame:
    """Split each piece by where its windows start, relative to the anchor; the bytes that all windows of a half share name its group."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                lo, hi, half = -row.before, row.windows - row.before, row.reach // 2
                middle = row.lowest + half
                for low, high, reach in ((row.lowest, middle, half), (middle, row.lowest + row.reach, row.reach - half)):
                    a, b = max(lo, low), min(hi, high)
                    if a < b:
                        # bytes from the last window's start to the first one's end, for windows of the whole half
                        s, e = max(high - 1 - lo, 0), low + length - lo
                        core = row.bytes[s : max(e, s)]
                        data = row.bytes[a - lo : b - lo + length - 1]
                        name = hashlib.blake2b(core + b"%d %d" % (low, max(lo, low) if e - s <= 0 else 0), digest_size=8).digest()
                        out.append((row.anchor, row.segment, row.first + a - lo, b - a, row.before - (a - lo), row.weight, data, int.from_bytes(name, "little", signed=True), low, reach))
            yield pd.DataFrame(out, columns=["anchor", "segment", "first", "windows", "before", "weight", "bytes", "part", "lowest", "reach"])

    return pieces.mapInPandas(split, PIECE + ", lowest int, reach int")


def repeated_segments(pieces: DataFrame, length: int) -> DataFrame:
    """anchor, segment, and the spans of bytes that repeat, for the segments of whole groups (anchor, part)."""
    keys = ["anchor", "part"]

    columns = ["segment", "first", "windows", "before", "weight", "bytes"]

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in whole_groups(batches, keys):
            starts = np.append(group_starts(rows, keys), len(rows))
            plain = {c: rows[c].to_numpy() for c in columns}
            held, begun = Strings(), 0
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                held.add(plain["bytes"][lo:hi], plain["before"][lo:hi])
                if held.size >= SYMBOLS or hi == len(rows):
                    yield found(held, rows["anchor"].to_numpy()[begun:hi], {c: v[begun:hi] for c, v in plain.items()})
                    held, begun = Strings(), hi

    def found(held: Strings, anchor: np.ndarray, of: dict[str, np.ndarray]) -> pd.DataFrame:
        row, lo, hi = [], [], []
        for r, (shared, skip) in enumerate(zip(held.longest(), held.lead, strict=True)):
            windows = int(of["windows"][r])
            mask = repeated_windows(*shared, int(skip), windows, length) if of["weight"][r] == 1 else np.ones(windows, bool)
            for a, b in spans(mask):
                row.append(r)
                lo.append(int(of["first"][r] + a))
                hi.append(int(of["first"][r] + b + length - 1))
        return pd.DataFrame({"anchor": anchor[row], "segment": of["segment"][row], "lo": lo, "hi": hi})

    dealt = pieces.select("anchor", "part", "segment", "first", "windows", "before", "weight", "bytes").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(sort, "anchor long, segment long, lo int, hi int")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text_hash and, as ``spans``, the bytes of each keyed document that repeat."""
    anchors = anchored(docs, length)
    anchors = materialise(anchors, "anchors")
    # counts by anchor are tables of their own: joined straight after its aggregation, a frequent anchor's rows can't be split over tasks
    often = materialise(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "often")
    again = materialise(anchors.join(often, "anchor"), "anchors-again")
    distinct = again.groupBy("anchor", "segment").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "text_hash", "start")).alias("at"), F.any_value("windows").alias("windows"), F.any_value("before").alias("before"))
    groups = materialise(distinct.groupBy("anchor").agg(F.count("*").alias("members")), "groups")
    distinct = materialise(distinct.join(groups, "anchor"), "segments")
    alone = distinct.filter("members = 1").select("anchor", "segment", F.lit(0).alias("lo"), (F.col("windows") + length - 1).alias("hi"))
    wanted = distinct.filter("members > 1").groupBy("at.doc_id", "at.text_hash").agg(F.collect_list(F.struct("anchor", "segment", "at.start", "windows", "before", "weight", "members")).alias("wanted"))

    # cut inside the array, so that a text is not copied for each of its pieces
    piece = lambda w: F.struct(w["anchor"].alias("anchor"), w["segment"].alias("segment"), F.lit(0).alias("first"), w["windows"].alias("windows"), w["before"].alias("before"), w["weight"].alias("weight"), F.substring(F.col("data"), w["start"] + 1, w["windows"] + length - 1).alias("bytes"), w["members"].alias("members"))
    # repeated rows would each bring the same pieces
    fetched = docs.dropDuplicates(["doc_id", "text_hash"]).join(wanted, ["doc_id", "text_hash"]).select(F.col("text").cast("binary").alias("data"), "wanted").select(F.explode(F.transform("wanted", piece)).alias("p")).select("p.*")
    pieces = materialise(fetched, "pieces")
    found = [repeated_segments(pieces.filter(F.col("members") <= GROUP).withColumn("part", F.lit(0).cast("long")), length)]
    large = pieces.filter(F.col("members") > GROUP).drop("members").withColumn("part", F.lit(0).cast("long")).withColumn("lowest", F.lit(-(length - ANCHOR)))
    large = materialise(large.withColumn("reach", F.lit(length - ANCHOR + 1)), "large")
    while not large.isEmpty():
        halves = materialise(halve(large, length), "halves")
        inside = ["anchor", "part", "lowest", F.md5("bytes").alias("same"), "before"]
        # equal halves are one, which occurs as often as all of them; one row stands for them from here on
        sums = materialise(halves.groupBy(*inside).agg(F.sum("weight").alias("times"), F.min("segment").alias("chosen")), "sums")
        sizes = materialise(sums.groupBy("anchor", "part").agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
        sized = materialise(halves.withColumn("same", F.md5("bytes")).join(sums, ["anchor", "part", "lowest", "same", "before"]).filter("times > 1 OR segment = chosen"), "sized")
        found.append(sized.filter("times > 1").select("anchor", "segment", F.col("first").alias("lo"), (F.col("first") + F.col("windows") + length - 1).alias("hi")))
        # others' spans are known: only a half that occurs once has spans to be found
        standing = sized.filter("segment = chosen").withColumn("weight", F.col("times")).drop("same", "times", "chosen")
        unsure = materialise(standing.join(sizes, ["anchor", "part"]), "unsure")
        found.append(repeated_segments(unsure.filter(F.col("members") <= GROUP), length))
        large = materialise(unsure.filter((F.col("members") > GROUP) & (F.col("reach") > 1)).drop("members"), "large")
    results = alone
    for part in found:
        results = results.unionByName(part)
    results = materialise(results, "repeated")
    return again.join(results, ["anchor", "segment"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (doc_id), the remaining bytes and text (without cut characters' rests), n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    keep = keep or ["doc_id"]
    carried = keyed(docs, F.struct(*keep).alias("row"))
    marked = carried.join(repeats(keyed(docs), length), ["doc_id", "text_hash"], "left").select("row", "text", "spans")
    made = "kept binary, kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def remove(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = b"" if text is None else text.encode("utf-8", "replace")
                gone = np.zeros(len(data) + 1, np.int32)
                for s in found or ():
                    gone[s["lo"]] += 1
                    gone[s["hi"]] -= 1
                mask = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                out.append((kept, kept.decode("utf-8", "ignore"), len(data), int(mask.sum()), len(spans(mask)), hashlib.sha256(kept).hexdigest()))
            types = [TYPES[x.split()[1]](pa) for x in made.split(", ")]
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], ["row", *[x.split()[0] for x in made.split(", ")]])
        release()

    row = marked.schema["row"].dataType.simpleString()
    return marked.mapInArrow(remove, f"row {row}, {made}").select("row.*", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256")
