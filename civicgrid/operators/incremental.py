"""Results that follow a store's changes: duplicate candidates, counts and sums, distinct values.

A save gives a new version of a ``BucketedStore``. What depends on it is brought up
to date from the rows in which two versions differ, and from the buckets of what
those rows touch; nothing reads the whole store again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators import dedup
from civicgrid.operators.directory import RECORDS_SQL, records
from civicgrid.operators.registry import Registry
from civicgrid.sources.store import BucketedStore, Superseded, Version, scratch, settled

registry = Registry()
R = f"WITH {RECORDS_SQL}"


# duplicate candidates ---------------------------------------------------------


def shown(row: str) -> Column:
    """There is a row and it isn't hidden."""
    return F.col(row).isNotNull() & ~F.coalesce(F.col(f"{row}.hidden"), F.lit(False))


def refreshed_candidates_of(found: DataFrame, store: BucketedStore, before: int, after: int, detect: Callable[..., DataFrame]) -> DataFrame:
    """``found`` candidates (winner, loser, similarity, signal) of version ``before``, brought to version ``after``.

    Candidates with a changed record go, and those of an address that a changed record
    has or had; changed records are compared with all of their cities, and the groups of
    those addresses are formed again. The store (keys city and key, buckets by city)
    holds the columns that ``detect`` reads, and ``hidden``.
    """
    changes = settled(store.changes(before, after), "changes")
    changed = changes.select("key").distinct()
    rows = settled(store.lookup(changes.select("city").distinct(), after).filter(~F.coalesce("hidden", F.lit(False))), "touched-cities")
    sides = changes.select(F.explode(F.array("old", "new")).alias("r")).filter(shown("r"))
    kept = found.join(changed.withColumnRenamed("key", "winner"), "winner", "left_anti").join(changed.withColumnRenamed("key", "loser"), "loser", "left_anti")
    if "website" not in rows.columns:
        return kept.unionByName(detect(rows, changed=changed))
    addresses = sides.select("r.city", T.normal_url(F.col("r.website")).alias("url")).filter("url <> ''").distinct()
    members = dedup.at_addresses(rows, addresses).select(F.col("key").alias("loser"), F.lit("url_match").alias("signal")).distinct()
    kept = kept.join(members, ["loser", "signal"], "left_anti")
    return kept.unionByName(detect(rows, changed=changed, addresses=addresses))


# counts, sums and distinct values ----------------------------------------------


#: What is summed up: columns by their names, or names with what a row (``old`` or ``new``) adds.
Sums = list[str] | dict[str, Callable[[str], Column]]


def contributions(changes: DataFrame, group: list[str], sums: Sums, counted: Callable[[str], Column] = shown) -> DataFrame:
    """What ``changes`` (old, new) add to the count ``n`` and to ``sums`` of each ``group``: old rows count against, new ones for it.

    A null counts as nothing in a sum.
    """
    of = sums if isinstance(sums, dict) else {s: lambda side, s=s: F.col(f"{side}.{s}") for s in sums}
    sides = [changes.filter(counted(side)).select(*[F.col(f"{side}.{g}").alias(g) for g in group], F.lit(sign).cast("long").alias("n"), *[(F.coalesce(value(side), F.lit(0)) * sign).alias(s) for s, value in of.items()]) for side, sign in (("old", -1), ("new", 1))]
    both = sides[0].unionByName(sides[1])
    return both.groupBy(*group).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])


class MaintainedAggregate:
    """Count and sums of each group of a store's rows, as a store of its own whose touched groups alone are rewritten.

    The last version of the rows that is counted in is the number of the last batch of
    the stream ``rows`` in the aggregate's manifest: a delta counts once.
    """

    def __init__(self, rows: BucketedStore, totals: BucketedStore, group: list[str], sums: Sums, counted: Callable[[str], Column] = shown):
        self.rows, self.totals, self.group, self.sums, self.counted = rows, totals, group, sums, counted

    @classmethod
    def create(cls, rows: BucketedStore, folder: str, group: list[str], sums: Sums, buckets: int = 16, counted: Callable[[str], Column] = shown) -> MaintainedAggregate:
        start = contributions(rows.changes(0, 0), group, sums, counted)
        return cls(rows, BucketedStore.create(rows.spark, folder, start.schema, group, buckets), group, sums, counted)

    def refresh(self, to: int | None = None) -> Version:
        """Count in what has changed since the last refresh, up to version ``to`` of the rows (the last)."""
        last = self.rows.version().number if to is None else to
        while True:
            base = self.totals.version()
            seen = base.streams.get("rows", 0)
            if seen >= last:
                return base
            delta = settled(contributions(self.rows.changes(seen, last), self.group, self.sums, self.counted), "delta")
            both = self.totals.lookup(delta.select(*self.group), base.number).unionByName(delta)
            merged = both.groupBy(*self.group).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in self.sums])
            try:
                return self.totals.apply(merged, F.col("n") == 0, stream="rows", batch_id=last, after=base.number)
            except Superseded:
                continue

    def read(self) -> DataFrame:
        return self.totals.read()


def distinct_counts(values: DataFrame, group: list[str]) -> DataFrame:
    """How many different values each group has, from the maintained counts (group, value, n)."""
    return values.groupBy(*group).agg(F.count("*").alias("values"), F.sum("n").alias("n"))


# queries ----------------------------------------------------------------------

COLUMNS = ["city", "key", "id", "name", "topic", "website", "description", "meeting_schedule", "location", "contact", "social_links", "hidden"]


def saved_store(spark: SparkSession, sf_dir: str) -> BucketedStore:
    """The directory in a store: a first version, a second one after a run that changes addresses and hides records, a third one without some."""
    rows = T.with_record_key(records(spark, sf_dir), "c", ["name", "city", "topic"])
    first = rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in COLUMNS if c != "key"]), "id").alias("r")).select("key", "r.*").select(*COLUMNS)
    store = BucketedStore.create(spark, scratch(spark, "directory"), first.schema, ["city", "key"], 16, ["city"])
    first = settled(first, "records")
    store.upsert(first)
    moved = first.filter("id % 9 = 4").withColumns({"website": F.concat(F.lit("http://site.example/"), F.col("id") % 53), "hidden": F.col("hidden") | (F.col("id") % 2 == 0), "description": F.lit("moved")})
    store.upsert(moved)
    store.delete(first.filter("id % 25 = 7"))
    return store


_SAVED = f"""{R}, was AS (SELECT *, {dedup.key_sql('name', 'city', 'topic')} AS key FROM records QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1), saved AS (SELECT id, key, city, topic, name, CASE WHEN id % 9 = 4 THEN 'moved' ELSE description END AS description,
  CASE WHEN id % 9 = 4 THEN 'http://site.example/' || (id % 53) ELSE website END AS website, hidden OR (id % 9 = 4 AND id % 2 = 0) AS hidden, meeting_schedule, location, contact, social_links FROM was WHERE id % 25 <> 7)"""


@registry.add(f"{_SAVED} SELECT key, city, website, description, hidden FROM saved")
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory as its store has it after three batches, of which the later ones rewrote only their buckets."""
    return saved_store(spark, sf_dir).read().select("key", "city", "website", "description", "hidden")


@registry.add(f"""{_SAVED} SELECT w.key, CASE WHEN s.key IS NULL THEN 'deleted' ELSE 'changed' END AS kind FROM was w LEFT JOIN saved s ON s.key = w.key
WHERE s.key IS NULL OR s.website IS DISTINCT FROM w.website OR s.hidden <> w.hidden OR s.description IS DISTINCT FROM w.description""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last two batches changed, from the buckets in which the versions differ."""
    kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").otherwise("changed")
    return saved_store(spark, sf_dir).changes(1, 3).select("key", kind.alias("kind"))


@registry.add(f"{_SAVED} SELECT city, key, name FROM saved WHERE city IN ('Brand#11', 'Brand#7')")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of two cities, from their buckets."""
    return saved_store(spark, sf_dir).lookup(spark.createDataFrame([("Brand#11",), ("Brand#7",)], "city string")).select("city", "key", "name")


@registry.add(f"{_SAVED} SELECT city, topic, count(*) AS n, CAST(sum(id) AS BIGINT) AS id FROM saved WHERE NOT hidden GROUP BY ALL")
def maintained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible records of each city and topic: counted once, then kept up to date from the changes alone."""
    kept = MaintainedAggregate.create(saved_store(spark, sf_dir), scratch(spark, "totals"), ["city", "topic"], ["id"])
    kept.refresh(1)
    kept.refresh()
    return kept.read()


@registry.add(f"{_SAVED} SELECT city, count(DISTINCT coalesce(website, '')) AS \"values\", count(*) AS n FROM saved WHERE NOT hidden GROUP BY city")
def maintained_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different addresses of each city's visible records, none being one too, from maintained counts of each address."""
    kept = MaintainedAggregate.create(saved_store(spark, sf_dir), scratch(spark, "addresses"), ["city", "website"], [])
    kept.refresh(2)
    kept.refresh()
    return distinct_counts(kept.read(), ["city"])


def _known(side: str, field: str) -> Column:
    return (F.coalesce(F.col(f"{side}.{field}"), F.lit("")) != "").cast("long")


#: What a profile of records counts.
PROFILE = {
    "has_website": lambda side: _known(side, "website"),
    "has_contact": lambda side: _known(side, "contact"),
    "has_description": lambda side: (F.length(F.col(f"{side}.description")) > 20).cast("long"),
    "has_any": lambda side: F.greatest(*[_known(side, f) for f in ("website", "contact", "description")]),
    "links": lambda side: F.size(f"{side}.social_links").cast("long"),
}


@registry.add(f"""{_SAVED} SELECT city, count(*) AS n, count(*) FILTER (coalesce(website, '') <> '') AS has_website, count(*) FILTER (coalesce(contact, '') <> '') AS has_contact, count(*) FILTER (length(description) > 20) AS has_description,
  count(*) FILTER (coalesce(website, '') <> '' OR coalesce(contact, '') <> '' OR coalesce(description, '') <> '') AS has_any, CAST(sum(len(social_links)) AS BIGINT) AS links FROM saved WHERE NOT hidden GROUP BY city""")
def maintained_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete each city's visible records are, kept up to date from the changes."""
    kept = MaintainedAggregate.create(saved_store(spark, sf_dir), scratch(spark, "profile"), ["city"], PROFILE)
    kept.refresh(1)
    kept.refresh(2)
    kept.refresh()
    return kept.read()


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = saved_store(spark, sf_dir)
    find = partial(dedup.community_candidates, copies=False)
    found = settled(find(store.read(1).filter(~F.col("hidden"))), "found")
    return refreshed_candidates_of(found, store, 1, 3, find)


@registry.add(f"""{_SAVED}, k AS (SELECT key, id, city, topic, trim(rtrim(lower(coalesce(website, '')), '/')) AS url, {dedup.RICH_SQL} AS rich FROM saved WHERE NOT hidden),
g AS (SELECT *, count(DISTINCT topic) OVER (PARTITION BY city, url) AS topics, first_value(key) OVER (PARTITION BY city, url ORDER BY rich DESC, topic, id) AS winner FROM k WHERE url NOT IN ('', 'n/a'))
SELECT winner, key AS loser FROM g WHERE topics > 1 AND key <> winner""")
def refreshed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one city and address under different topics: found once, then kept up to date from the changes."""
    return _refreshed(spark, sf_dir).filter("signal = 'url_match'").select("winner", "loser")


@registry.add()
def refreshed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates among communities, by address and by name: found once, then kept up to date from the changes."""
    return _refreshed(spark, sf_dir)


QUERIES, ORACLE = registry.queries, registry.oracle
