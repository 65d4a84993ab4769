"""A table in buckets by key: a batch rewrites only the buckets that its keys are in.

A version is a small manifest that names the folder of each bucket. A writer merges
its batch into copies of the touched buckets, and then publishes the next manifest
under the next number. Only one writer can take a number: one that finds it taken
goes on from the version that took it, and merges again only if that one touched a
bucket of its own. Readers see one version; nothing that it names is changed.

A key occurs once. Of several rows of a key in a batch the last by ``order`` counts;
without an order they must not differ in anything. Null keys are equal. A batch with
a number that its stream has written already changes nothing, so that a stream that
starts again writes each of its batches once. What two versions differ in is read
from the buckets in which they do.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (``spark.checkpoint.dir``); local sessions may leave it out."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints/civicgrid"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for what is read several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """What a store needs of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole under a name that must not be taken; whether it was free."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        try:
            if self.root.startswith("file:"):
                local = "/" + self.root.removeprefix("file:").lstrip("/")
                try:
                    os.link(f"{local}/{draft}", f"{local}/{name}")
                except FileExistsError:
                    return False
                return True
            return not self.fs.exists(self.path(name)) and bool(self.fs.rename(self.path(draft), self.path(name)))
        finally:
            self.delete(draft)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Superseded(Exception):
    """Another writer published a version in between."""


@dataclass
class Version:
    """One version: where each bucket is, and how far each stream has come."""

    number: int
    keys: list[str]
    schema: str
    buckets: int
    by: list[str]
    places: dict[str, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def differing(self, other: Version) -> list[int]:
        return sorted(int(b) for b in self.places.keys() | other.places.keys() if self.places.get(b) != other.places.get(b))


class BucketedStore:
    """A table in ``folder``; ``create`` makes an empty one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int = 64, by: list[str] | None = None) -> BucketedStore:
        """An empty store; a bucket should hold some 100 MB of the rows that are to come. ``by``: those of the keys that buckets go by, so that all rows of one value are in one."""
        store = cls(spark, folder)
        if not store._publish(Version(0, keys, schema.json(), buckets, by or keys)):
            raise FileExistsError(folder)
        return store

    # versions

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        number = max(self.numbers()) if number is None else number
        return Version(**json.loads(self.files.read(f"versions/{number:012d}.json")))

    def _publish(self, version: Version) -> bool:
        return self.files.publish(f"versions/{version.number:012d}.json", json.dumps(version.__dict__))

    # reading

    def _at(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        places = [f"{self.files.root}/{p}" for b, p in version.places.items() if buckets is None or int(b) in set(buckets)]
        schema = StructType.fromJson(json.loads(version.schema))
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of a version, the last if none is named."""
        return self._at(self.version(number))

    def lookup(self, wanted: DataFrame, number: int | None = None) -> DataFrame:
        """The rows of the keys in ``wanted``, or of the values that buckets go by if it has only those, from their buckets only."""
        version = self.version(number)
        columns = version.keys if set(version.keys) <= set(wanted.columns) else version.by
        keys = self._typed(wanted, version, columns).distinct()
        asked = self._touched(keys, version)
        same = [F.col(f"w.{k}").eqNullSafe(F.col(f"r.{k}")) for k in columns]
        return self._at(version, asked).alias("r").join(keys.alias("w"), same, "left_semi")

    def changes(self, before: int, after: int) -> DataFrame:
        """key columns, ``old`` and ``new`` row (null where there is none) of what two versions differ in, read from the buckets that differ."""
        first, last = self.version(before), self.version(after)
        some = first.differing(last)
        row = lambda v, name: self._at(v, some).select(*first.keys, F.struct("*").alias(name))
        old, new = row(first, "old").alias("o"), row(last, "new").alias("n")
        both = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in first.keys], "full_outer")
        return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in first.keys], "old", "new")

    # writing

    @staticmethod
    def _bucket(version: Version) -> Column:
        return F.pmod(F.xxhash64(*version.by), F.lit(version.buckets)).cast("int")

    def _touched(self, keys: DataFrame, version: Version) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(version)).distinct().collect())  # at most one row for each bucket

    @staticmethod
    def _typed(rows: DataFrame, version: Version, columns: list[str]) -> DataFrame:
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(version.schema)).fields}
        return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])

    def upsert(self, batch: DataFrame, order: Column | None = None, stream: str = "", batch_id: int | None = None) -> Version:
        """Insert or replace the rows of ``batch``."""
        return self.apply(batch, F.lit(False), order, stream, batch_id)

    def delete(self, keys: DataFrame, stream: str = "", batch_id: int | None = None) -> Version:
        """Remove the rows of the keys in ``keys``."""
        return self.apply(keys, F.lit(True), None, stream, batch_id)

    def apply(self, batch: DataFrame, gone: Column, order: Column | None = None, stream: str = "", batch_id: int | None = None, after: int | None = None) -> Version:
        """Remove the keys of rows that are ``gone`` and insert or replace the others; raises ``Superseded`` where that can't follow version ``after`` directly, if one is named."""
        base = self.version()
        schema = StructType.fromJson(json.loads(base.schema))
        columns = schema.names
        missing = [c for c in base.keys if c not in batch.columns]
        if missing:
            raise ValueError(f"the batch lacks the key {', '.join(missing)}")
        full = batch.withColumns({c: F.lit(None) for c in columns if c not in batch.columns})
        rows = full.select(F.struct(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns]).alias("row"), gone.alias("gone"), (order if order is not None else F.lit(0)).alias("nth"))
        by_key = rows.groupBy(*[F.col(f"row.{k}").alias(k) for k in base.keys])
        if order is None:
            if not by_key.agg((F.count_distinct(F.to_json("row")) > 1).alias("several")).filter("several").isEmpty():
                raise ValueError("rows of one key differ: name the order that tells which is the last")
        last = by_key.agg(F.max_by(F.struct("row", "gone"), F.col("nth")).alias("last")).select("last.*").persist()  # read twice
        try:
            touched = self._touched(last.select("row.*"), base)
            written: dict[str, str] | None = None
            while True:
                if batch_id is not None and base.streams.get(stream, -1) >= batch_id:
                    return base
                if after is not None and base.number != after:
                    raise Superseded(f"version {base.number} came after {after}")
                if written is None:
                    written = self._merged(last, touched, base)
                places = {b: p for b, p in base.places.items() if int(b) not in touched} | written
                streams = base.streams | ({stream: batch_id} if batch_id is not None else {})
                new = Version(base.number + 1, base.keys, base.schema, base.buckets, base.by, places, streams)
                if self._publish(new):
                    return new
                before, base = base, self.version()
                if set(before.differing(base)) & set(touched):
                    written = None
        finally:
            last.unpersist()

    def _merged(self, last: DataFrame, touched: list[int], base: Version) -> dict[str, str]:
        """Write the touched buckets with the batch merged in; where each is now, if it has rows."""
        stored = self._at(base, touched).select(F.struct("*").alias("row"), F.lit(False).alias("gone"), F.lit(0).alias("new"))
        both = stored.unionByName(last.withColumn("new", F.lit(1)))
        keys = [F.col(f"row.{k}").alias(k) for k in base.keys]
        placed = both.select(*keys, "row", "gone", "new").withColumn("_bucket", self._bucket(base)).repartition("_bucket")
        merged = placed.groupBy("_bucket", *base.keys).agg(F.max_by(F.struct("row", "gone"), "new").alias("last")).filter("NOT last.gone")
        folder = f"data/{uuid.uuid4().hex}"
        merged.select("_bucket", "last.row.*").write.partitionBy("_bucket").parquet(f"{self.files.root}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("_bucket=")}

    def vacuum(self, keep: int = 2) -> None:
        """Delete the versions before the last ``keep``, and the folders that none of those names; no writer may be at work."""
        numbers = sorted(self.numbers())
        kept = [self.version(n) for n in numbers[-keep:]]
        named = {p for v in kept for p in v.places.values()}
        for n in numbers[:-keep]:
            self.files.delete(f"versions/{n:012d}.json")
        for folder in self.files.names("data"):
            inside = [f"data/{folder}/{n}" for n in self.files.names(f"data/{folder}") if n.startswith("_bucket=")]
            for place in inside:
                if place not in named:
                    self.files.delete(place)
            if not named & set(inside):
                self.files.delete(f"data/{folder}")


def store_sink(store: BucketedStore, stream: str, order: Column | None = None):
    """A ``foreachBatch`` sink that keeps ``store``: each batch of the stream counts once, whatever is run again."""

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch, order, stream, number)

    return write
