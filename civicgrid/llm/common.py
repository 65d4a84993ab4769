"""Helpers shared by the corpus operators: tables, shared storage, word batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.session import let_workers_import

#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 500_000
#: Bytes that Spark puts into one Arrow batch, unless the session says otherwise: whole texts are large rows.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Workers give large arrays back to the system at once, and keep no more than some MB otherwise: settings of their allocators (glibc's and Arrow's).
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> SparkSession:
    """Workers find this package and keep no memory they don't use, and no Arrow batch holds many more bytes than ``BATCH_BYTES`` (settings that are there stand)."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return let_workers_import(spark)


def release() -> None:
    """Give back to the system what this worker's allocator holds free, as a task ends; does nothing where it can't be asked."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``, with its scheme.

    Only a local session, whose tasks run in the driver, may leave it out: it gets
    a temporary folder. Elsewhere that is an error, as each machine would write to
    a disk of its own.
    """
    context = ready(spark).sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints/civicgrid"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    path = context._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Schemes that Spark's file systems and Arrow's name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def open_store(folder: str):
    """(Arrow file system, path) for the files that tasks write themselves; ``folder`` has the scheme that Spark resolved.

    Raises where Arrow has no such file system, and for a path without a scheme,
    which each machine would take for its own disk.
    """
    from pyarrow import fs

    scheme, found, rest = folder.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"{folder}: a path with its scheme is needed")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    except Exception as error:
        raise ValueError(f"files can't be written to {folder}: Arrow has no file system for it") from error


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def crc_bucket(col, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(col.cast("string")) % n


def chunks(texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, encoded texts) of consecutive runs of about ``limit`` bytes; null counts as empty."""
    start, held, total = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "replace")
        if held and total + len(data) > limit:
            yield start, i, held
            start, held, total = i, [], 0
        held.append(data)
        total += len(data) + 1
    if held:
        yield start, start + len(held), held


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
HELD_POWERS = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table_of_powers(base: np.uint64, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n``; a worker keeps those below ``HELD_POWERS``."""
    if n > HELD_POWERS:
        return _table_of_powers(BASE, n), _table_of_powers(INVERSE, n)
    if len(_powers[0]) < n:
        _powers[:] = [_table_of_powers(base, n) for base in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running sums of code * BASE**i, with a leading zero."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * powers(len(codes))[0], out=out[1:])
    return out


def _lowered() -> np.ndarray:
    """Byte to lower-cased byte, 0 where it is no part of a word ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z)."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        out[b] = c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0
    return out


LOWERED = _lowered()


class WordBatch:
    """Words of several texts: ``start``, ``end`` (offsets in ``low``), ``doc`` and 64-bit ``hash`` of each; ``first`` word of each text."""

    def __init__(self, encoded: list[bytes]):
        buf = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        self.low = LOWERED[buf]
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[1:] = self.low != 0
        change = np.diff(inside)
        self.start = np.flatnonzero(change == 1)
        self.end = np.flatnonzero(change == -1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(buf))
        sums = prefix_hash(self.low)
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(len(buf))[1][self.start])
        begins = np.zeros(len(encoded) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in encoded], out=begins[1:])
        self.begins = begins
        self.first = np.searchsorted(self.start, begins)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(encoded)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the ``k`` words from each word on; valid where they lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * BASE + self.hash[j : j + n]
        return mix(out), self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id in ``edges`` (a, b) reaches.

    Alternating large and small stars: each round moves neighbours to the smallest
    one known, so that the number of rounds grows with the logarithm of the longest
    path. What each id moves to is a table of its own, so that the joins with it
    start from exchanges that Spark may split where an id has very many edges. An
    edge to an id that has no smaller neighbour stays as it is.
    """
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct()
    pairs = materialise(pairs, "edges")
    before = None
    while True:
        down = materialise(pairs.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m")), "least")
        large = materialise(pairs.join(down, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), "large")
        least = materialise(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "least")
        # an id of one smaller neighbour is placed; others bring their neighbours together
        several = large.join(least.filter("n > 1"), "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = materialise(least.select("hi", F.col("m").alias("lo")).union(several).distinct(), "edges")
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(pairs.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())


def block_pairs(rows: DataFrame, id_col: str, blocks: Column) -> DataFrame:
    """Deal rows to tasks that together see every pair of a group once.

    ``blocks`` is the number of blocks that a row's group is split into, by the
    hash of ``id_col``; ``left`` and ``right`` name the two blocks that a task
    compares and ``block`` the row's own. No task holds more than about two blocks.
    """
    dealt = rows.withColumn("_g", F.greatest(blocks, F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col("_g")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("_g", "other")


def whole_groups(batches: Iterator, keys: list[str]) -> Iterator[tuple]:
    """(rows, starts) of a task's rows sorted by ``keys``: each chunk holds whole groups, ``starts`` their first rows and the end.

    Holds one Arrow batch and one unfinished group at a time.
    """
    import pandas as pd

    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        starts = group_starts(rows, keys)
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], starts
        rest = rows.iloc[starts[-1] :].reset_index(drop=True) if len(rows) else rows
    if rest is not None and len(rest):
        yield rest, np.append(group_starts(rest, keys), len(rest))
    rest = None
    release()


def group_starts(rows, keys: list[str]) -> np.ndarray:
    """First row of each run of equal ``keys``."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = np.logical_or.reduce([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in keys])
    return np.flatnonzero(new)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def linked_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """key, class_id and n_links of ``classes`` (key, weight, first_id) under ``links`` (a, b, n).

    ``n`` counts rows linked to ``a`` in one task and ``b`` is connected with it;
    class_id is the smallest first_id that links reach. The rows of a class link
    with each other.
    """
    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    counts = materialise(counts, "counts")
    roots = components(links.select("a", "b")).withColumnRenamed("id", "key")
    placed = materialise(classes.select("key", "weight", "first_id").join(roots, "key", "left").join(counts, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    lowest = materialise(placed.groupBy("root").agg(F.min("first_id").alias("class_id")), "lowest")
    return placed.join(lowest, "root").select("key", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def add_by_text(df: DataFrame, function, added: str, keep: list[str], at_once: int = 1 << 20) -> DataFrame:
    """``keep`` columns of ``df`` as they are, and what ``function`` (texts -> one list for each column) makes of ``text``, at most ``at_once`` rows at a time."""
    names = [x.split()[0] for x in added.split(", ")]
    carried = [*keep] if "text" in keep else [*keep, "text"]

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (whole.slice(at, at_once) for whole in batches for at in range(0, max(1, whole.num_rows), at_once)):
            made = function(batch.column("text").to_pylist())
            columns = [batch.column(k) for k in keep] + [pa.array(m, TYPES[x.split()[1]](pa)) for m, x in zip(made, added.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])
        release()

    ready(df.sparkSession)
    plain = df.select(*carried)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name in keep]
    return plain.mapInArrow(apply, ", ".join([*kept, added]))


TYPES = {"string": lambda pa: pa.string(), "double": lambda pa: pa.float64(), "long": lambda pa: pa.int64(), "int": lambda pa: pa.int32(), "boolean": lambda pa: pa.bool_(), "binary": lambda pa: pa.binary()}


def arrow_batch(schema: str, columns: list):
    """A record batch of ``schema`` ("name type, ..."); columns are Arrow arrays, which stay as they are, or sequences. Ids never pass through floats."""
    import pyarrow as pa

    fields = [x.split() for x in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, TYPES[kind](pa)) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def rows_at(rows):
    """Row numbers, to take from Arrow columns."""
    import pyarrow as pa

    return pa.array(rows, pa.int64())


#: Bits of a bitmap for each hash, their bounds (powers of two), and those of one of its parts.
BITS_EACH, LEAST_BITS, MOST_BITS, PART_BITS = 16, 1 << 16, 1 << 26, 1 << 16


def bitmap_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each hash, one row for each hash."""
    return np.stack([hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)], axis=1).astype(np.int64)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Which ``hash`` values (long) occur, one byte for eight bits: at most ``MOST_BITS`` bits whatever the rows, so that it may go to all tasks.

    Built in parts on the executors. What isn't in it doesn't occur; what is in it may.
    """
    import pandas as pd

    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * hashes.count()).bit_length()))

    def parts(batches: Iterator) -> Iterator:
        for batch in batches:
            at = np.unique(bitmap_places(batch["hash"].to_numpy(np.int64).view(np.uint64), bits))
            yield pd.DataFrame({"part": (at // PART_BITS).astype(np.int32), "bit": (at % PART_BITS).astype(np.int32)})

    def pack(group):
        held = np.zeros(PART_BITS, np.uint8)
        held[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [group["part"].iloc[0]], "bytes": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    found = hashes.mapInPandas(parts, "part int, bit int").distinct().groupBy("part").applyInPandas(pack, "part int, bytes binary")
    for r in found.collect():  # at most MOST_BITS / PART_BITS rows
        at = r["part"] * PART_BITS // 8
        out[at : at + PART_BITS // 8] = np.frombuffer(r["bytes"], np.uint8)
    return out


def maybe_in(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in a bitmap."""
    at = bitmap_places(hashes, 8 * len(held))
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
