"""Substring search through an index of three-letter runs, kept up to date with its texts.

The index has a row for each different run of three characters of a text, in buckets
by run, with how many texts have it in another small table. A search looks its runs
up, takes the texts that have its rarest few, and tests those for the whole needle.
Texts are stored in buckets by id, so that a search reads the buckets of its runs and
of the texts that they lead to. Letters count in lower case; needles of fewer than
three characters are looked for in all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.operators.directory import RECORDS_SQL, records
from civicgrid.operators.incremental import MaintainedAggregate
from civicgrid.operators.registry import Registry
from civicgrid.sources.store import BucketedStore, scratch, settled

registry = Registry()

RUN = 3
#: Runs of a needle that are intersected.
RAREST = 4


def runs(text: Column) -> Column:
    """The different runs of a text in lower case."""
    low = F.lower(text)
    return F.when(F.length(low) >= RUN, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (RUN - 1)), lambda i: F.substring(low, i, F.lit(RUN))))).otherwise(F.array().cast("array<string>"))


class TextIndex:
    """Texts (id, text) of any number of saves, and the index of their runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.texts, self.postings = BucketedStore(spark, f"{folder}/texts"), BucketedStore(spark, f"{folder}/postings")
        self.counts = MaintainedAggregate(self.postings, BucketedStore(spark, f"{folder}/counts"), ["run"], [], lambda side: F.col(side).isNotNull())

    @classmethod
    def create(cls, spark: SparkSession, folder: str, id_type: str = "long", buckets: int = 64) -> TextIndex:
        """An empty index; a bucket should hold some 100 MB of the texts that are to come."""
        empty = lambda schema: spark.createDataFrame([], schema).schema
        BucketedStore.create(spark, f"{folder}/texts", empty(f"id {id_type}, text string"), ["id"], buckets)
        BucketedStore.create(spark, f"{folder}/postings", empty(f"run string, id {id_type}"), ["run", "id"], buckets, ["run"])
        BucketedStore.create(spark, f"{folder}/counts", empty("run string, n long"), ["run"], max(1, buckets // 16))
        return cls(spark, folder)

    def save(self, new: DataFrame, gone: DataFrame | None = None) -> None:
        """Insert or replace texts (id, text) and remove those of the ids in ``gone``; the index follows."""
        self.texts.upsert(new)
        if gone is not None:
            self.texts.delete(gone)
        self.refresh()

    def refresh(self) -> None:
        """Bring the index to the texts' last version: only runs that a text gained or lost are written."""
        last, seen = self.texts.version().number, self.postings.version().streams.get("texts", 0)
        if seen < last:
            changes = self.texts.changes(seen, last)
            none = F.array().cast("array<string>")
            old, new = F.coalesce(runs(F.col("old.text")), none), F.coalesce(runs(F.col("new.text")), none)
            moved = changes.select("id", F.explode(F.concat(F.transform(F.array_except(old, new), lambda r: F.struct(r.alias("run"), F.lit(True).alias("gone"))), F.transform(F.array_except(new, old), lambda r: F.struct(r.alias("run"), F.lit(False).alias("gone"))))).alias("m"))
            moved = settled(moved.select("m.run", "id", "m.gone"), "runs")
            self.postings.apply(moved, F.col("gone"), stream="texts", batch_id=last)
        self.counts.refresh()

    def rarest(self, needle: str) -> list[str]:
        """The needle's rarest runs; none if one of them is in no text."""
        own = sorted({needle.lower()[i : i + RUN] for i in range(len(needle) - RUN + 1)})
        found = self.counts.totals.lookup(self.spark.createDataFrame([(r,) for r in own], "run string"))
        known = {r["run"]: r["n"] for r in found.collect()}  # as many as the needle has runs
        return sorted(own, key=lambda r: (known[r], r))[:RAREST] if len(known) == len(own) else []

    def candidates(self, needle: str) -> DataFrame:
        """The ids of texts that have the needle's rarest runs."""
        chosen = self.rarest(needle)
        rows = self.postings.lookup(self.spark.createDataFrame([(r,) for r in chosen], "run string"))
        return rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen)).select("id")

    def search(self, needle: str) -> DataFrame:
        """id and text of the texts that hold ``needle``, whatever its case."""
        rows = self.texts.read() if len(needle.lower()) < RUN else self.texts.lookup(self.candidates(needle))
        return rows.filter(F.contains(F.lower("text"), F.lit(needle.lower())))


def _index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The names and texts of all records, of which some come in later and some go."""
    rows = records(spark, sf_dir).select("id", F.concat_ws(" ", "name", "description", "location", "contact").alias("text"))
    index = TextIndex.create(spark, scratch(spark, "texts"), "long", 16)
    index.save(rows.withColumn("text", F.when(F.col("id") % 4 == 0, "to come").otherwise(F.col("text"))))
    index.save(rows.filter("id % 4 = 0"), rows.filter("id % 9 = 5").select("id"))
    return index


_TEXTS = f"WITH {RECORDS_SQL}, t AS (SELECT id, concat_ws(' ', name, description, location, contact) AS text FROM records WHERE id % 9 <> 5)"


@registry.add(f"{_TEXTS} SELECT id, text FROM t WHERE contains(lower(text), 'near blue') UNION ALL SELECT id, text FROM t WHERE contains(lower(text), 'sk 7') UNION ALL SELECT id, text FROM t WHERE contains(lower(text), 'zzz') UNION ALL SELECT id, text FROM t WHERE contains(lower(text), '9,')")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four searches in records through the index, one of them too short for it."""
    index = _index(spark, sf_dir)
    return index.search("NEAR Blue").union(index.search("sk 7")).union(index.search("zzz")).union(index.search("9,"))


QUERIES, ORACLE = registry.queries, registry.oracle
