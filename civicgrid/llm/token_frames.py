"""Token-ID files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file is a run of zstandard frames, then two skippable frames:

* document index: for each frame its first and last doc_id (signed 64 bit) and its number of documents (32 bit);
* seek table in zstandard's seekable format: for each frame its compressed size, decompressed size and the low
  32 bits of the xxh64 of its decompressed bytes; then the number of frames, a descriptor byte (bit 7: checksums)
  and the magic number 0x8F92EAB1.

A frame's content: the number n of documents (32 bit), n doc_ids (64 bit), n lengths (32 bit), then all ids (unsigned
32 bit), everything little-endian. Readers take the footer, the table and the index, and decompress only the frames
that hold a requested document.

Null texts are empty documents: only the end id. Repeated doc_ids stay separate documents, in the order of a hash of
their texts, then of the texts, so that every run writes the same bytes. Rows of a null doc_id have
no place in an order by doc_id and raise no error: they are written first, with id -2**63 as their number, and read
back as null. An empty table gives no files and no rows. Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicgrid.llm.common import arrow_batch, materialise, open_store, ready, shared_path
from civicgrid.llm.tokenizing import encoder

SKIPPABLE, INDEX_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_BYTES = 1 << 20
NULL_ID = -(1 << 63)
_ENTRY, _INDEX = struct.Struct("<III"), struct.Struct("<qqI")

WRITTEN = "file string, part int, frame int, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def frame_content(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join((struct.pack("<I", len(ids)), np.array(ids, "<i8").tobytes(), np.array([len(t) // 4 for t in tokens], "<u4").tobytes(), *tokens))


def parse_frame(data: bytes) -> Iterator[tuple[int, bytes]]:
    n = struct.unpack_from("<I", data)[0]
    ids, lengths = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n)
    ends = 4 + 12 * n + 4 * np.cumsum(lengths, dtype=np.int64)
    for i in range(n):
        yield int(ids[i]), data[ends[i] - 4 * int(lengths[i]) : ends[i]]


class FrameWriter:
    """Writes one file; ``out`` is any binary file object."""

    def __init__(self, out, level: int = 1, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.ids, self.tokens, self.size = [], [], 0
        self.counts: list[tuple[int, int]] = []

    def add(self, doc_id: int, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.size += len(tokens) + 12
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.ids:
            return
        raw = frame_content(self.ids, self.tokens)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((self.ids[0], self.ids[-1], len(self.ids)))
        self.counts.append((len(self.ids), sum(map(len, self.tokens)) // 4))
        self.ids, self.tokens, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_INDEX.pack(*x) for x in self.index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(_ENTRY.pack(*x) for x in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Random access to one file; ``source`` is seekable."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        table = end - 17 - 12 * n
        self.entries = list(_ENTRY.iter_unpack(self._at(table + 8, 12 * n)))
        self.index = list(_INDEX.iter_unpack(self._at(table - _INDEX.size * n, _INDEX.size * n)))
        self.offsets = [0, *np.cumsum([e[0] for e in self.entries]).tolist()]

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> Iterator[tuple[int, bytes]]:
        import xxhash
        import zstandard

        packed, size, check = self.entries[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[k], packed), max_output_size=size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return parse_frame(raw)

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, bytes]]:
        """Only the wanted documents; other frames aren't touched."""
        for k, (lo, hi, _) in enumerate(self.index):
            if any(lo <= w <= hi for w in wanted):
                yield from ((d, t) for d, t in self.frame(k) if d in wanted)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file for each range of doc_ids; returns a row for each frame.

    Ranges follow one another by the number in the file's name. A task writes
    under a name of its own and renames at its end, so a task that runs again
    replaces the file by the same bytes.
    """

    open_store(folder)  # fails before any task does

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        task, writer, out = TaskContext.get(), None, None
        store, root = open_store(folder)
        part = task.partitionId()
        file = f"tokens-{part:06d}.bin"
        own = f"{root}/{file}.{task.taskAttemptId()}"
        coder = encoder(tokenizer)
        tail = struct.pack("<I", end_id)
        for batch in batches:
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own)
                writer = FrameWriter(out)
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist()), strict=True):
                writer.add(doc_id, tokens + tail)
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, f"{root}/{file}")
            n = len(writer.counts)
            yield arrow_batch(WRITTEN, [[file] * n, [part] * n, range(n), [x for x, _ in writer.counts], [x for _, x in writer.counts]])

    ready(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    ranges = plain.repartitionByRange(partitions, "doc_id", "tie") if partitions else plain.repartitionByRange("doc_id", "tie")
    return ranges.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(write, WRITTEN)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest's frames with ``start``, the ids in all frames before. A row for each file goes through one task, a file's frames through another."""
    by_file = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    in_file = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_tokens")
    return manifest.withColumn("in_file", in_file).join(by_file.select("part", "before"), "part").withColumn("start", F.col("before") + F.col("in_file")).drop("before", "in_file")


def read_token_files(frames: DataFrame, folder: str) -> DataFrame:
    """A row for each document of ``frames`` (file, frame, start): the ids before it, and its own."""

    def read(batches: Iterator) -> Iterator:
        store, root = open_store(folder)
        for batch in batches:
            wanted: dict[str, list[tuple[int, int]]] = {}
            for file, frame, start in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "start")), strict=True):
                wanted.setdefault(file, []).append((frame, start))
            for file, some in wanted.items():
                with store.open_input_file(f"{root}/{file}") as source:
                    reader = FrameReader(source)
                    for frame, start in some:
                        ids, tokens = zip(*reader.frame(frame), strict=True)
                        sizes = np.array([len(t) // 4 for t in tokens], np.int64)
                        yield arrow_batch(READ, [[None if d == NULL_ID else d for d in ids], start + np.cumsum(sizes) - sizes, sizes, [zlib.crc32(t) for t in tokens], tokens])

    ready(frames.sparkSession)
    return frames.select("file", "frame", "start").mapInArrow(read, READ)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all of ``docs``, read the files back: doc_id, start, n_tokens, ids_crc32.

    Where a frame starts stands in the row that its reader gets, from the manifest
    (a row for each megabyte); the rest the reader counts within the frame.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    manifest = materialise(write_token_files(docs, tokenizer, folder, end_id), "token-manifest")
    frames = with_starts(manifest).repartition(spark.sparkContext.defaultParallelism * 4, "part", "frame")
    return read_token_files(frames, folder).drop("ids")
