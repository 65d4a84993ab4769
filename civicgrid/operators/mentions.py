"""Other cities named in a record's texts: the scan, its candidates' state, and the marked snippets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.functions.names import LEAST, NameIndex, without_overlaps
from civicgrid.operators.directory import RECORDS_SQL, records
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table

registry = Registry()
R = f"WITH {RECORDS_SQL}"

#: The texts that are scanned, in this order.
SCANNED = ("name", "description", "location", "meeting_schedule", "contact", "history", "join_process")
#: Names that go to all tasks at once; a larger dictionary is scanned in parts.
MOST_NAMES = 200_000

HITS = "key string, city string, place int, field string, start int, stop int, mentioned string, snippet string, matched string"


def name_parts(cities: DataFrame, most: int = MOST_NAMES) -> Iterator[list[str]]:
    """The different names of a city table (``city``) in parts of about ``most``, dealt by hash; what a part holds goes to all tasks."""
    names = cities.select(F.trim("city").alias("city")).filter(F.length("city") >= LEAST).distinct()
    parts = max(1, -(-names.count() // most))
    for part in range(parts):
        yield sorted(r["city"] for r in names.filter(F.pmod(F.xxhash64("city"), F.lit(parts)) == part).collect())


def name_hits(rows: DataFrame, names: list[str], around: int, alone: bool) -> DataFrame:
    """Every place where a text of ``rows`` (key, city and texts) has one of ``names``: the longest there and, if they are ``alone``, none that overlaps an earlier one."""
    fields = [c for c in SCANNED if c in rows.columns]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = NameIndex(names)
        for batch in batches:
            texts = [t for c in fields for t in batch[c]]
            n, keys, cities, out = len(batch), batch["key"].to_list(), batch["city"].to_list(), []
            found = index.hits(texts)
            for k, start, stop, name in without_overlaps(found) if alone else found:
                text, a, b = texts[k], max(0, start - around), stop + around
                snippet = "…" * (a > 0) + text[a:b].strip() + "…" * (b < len(text))
                out.append((keys[k % n], cities[k % n], SCANNED.index(fields[k // n]), fields[k // n], start, stop, name, snippet, text[start:stop]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HITS.split(", ")])

    return rows.select(F.col("key").cast("string").alias("key"), "city", *fields).filter(F.col("city") != "").mapInPandas(look, HITS)


def apart(hits: DataFrame) -> DataFrame:
    """Hits of several parts of a dictionary without those that overlap an earlier or longer one of their text."""

    def choose(text: pd.DataFrame) -> pd.DataFrame:
        found = [(0, s, e, m, k) for k, (s, e, m) in enumerate(zip(text["start"], text["stop"], text["mentioned"], strict=True))]
        return text.iloc[[k for *_, k in without_overlaps(found)]]

    return hits.groupBy("key", "place").applyInPandas(choose, HITS)


def find_mentions(rows: DataFrame, cities: DataFrame | list[str], around: int = 60, most: int = MOST_NAMES) -> DataFrame:
    """key, mentioned, field, snippet and matched text: each other city that a record (key, city and texts) names, where it does so first.

    ``cities``: the city table, or the names themselves. The own city, and one that
    it begins with or that begins with it, is no mention. The key tells records apart.
    """
    parts = [cities] if isinstance(cities, list) else list(name_parts(cities, most))
    hits = reduce(DataFrame.unionByName, [name_hits(rows, names, around, len(parts) == 1) for names in parts])
    hits = hits if len(parts) == 1 else apart(hits)
    own, other = F.lower("city"), F.lower("mentioned")
    first = F.min_by(F.struct("field", "snippet", "matched"), F.struct("place", "start"))
    return hits.filter(~other.startswith(own) & ~own.startswith(other)).groupBy("key", "mentioned").agg(first.alias("at")).select("key", "mentioned", "at.field", "at.snippet", "at.matched")


def with_mentions(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` candidates (key, mentioned, field, snippet, matched, resolution) and those of ``found`` that aren't there in any state."""
    new = found.dropDuplicates(["key", "mentioned"]).join(known.select("key", "mentioned"), ["key", "mentioned"], "left_anti")
    return known.unionByName(new.withColumn("resolution", F.lit(None).cast("string")))


def dismiss_stale(known: DataFrame, rows: DataFrame) -> DataFrame:
    """``known`` with those dismissed whose record (key and texts) is gone or names the city no more."""
    fields = [c for c in SCANNED if c in rows.columns]
    texts = rows.select(F.col("key").cast("string").alias("key"), F.lower(F.concat_ws(" ", *fields)).alias("_text"))
    stale = F.col("_text").isNull() | ~F.col("_text").contains(F.lower("mentioned"))
    return known.join(texts, "key", "left").withColumn("resolution", F.when(F.col("resolution").isNull() & stale, "auto_dismissed").otherwise(F.col("resolution"))).select(*known.columns)


def scan(known: DataFrame, rows: DataFrame, cities: DataFrame | list[str]) -> DataFrame:
    """The candidates after stale ones are dismissed and new ones come in."""
    return with_mentions(dismiss_stale(known, rows), find_mentions(rows, cities))


def highlighted(snippet: Column, matched: Column) -> list[Column]:
    """A snippet before, in and after its first match, whatever its case; all of it before where there is none."""
    at = F.when(matched != "", F.instr(F.lower(snippet), F.lower(matched))).otherwise(0)
    found = F.coalesce(at, F.lit(0)) > 0
    return [
        F.when(found, F.substring(snippet, F.lit(1), at - 1)).otherwise(F.coalesce(snippet, F.lit(""))).alias("before"),
        F.when(found, F.substring(snippet, at, F.length(matched))).otherwise("").alias("match"),
        F.when(found, F.substring(snippet, at + F.length(matched), F.length(snippet))).otherwise("").alias("after"),
    ]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible records whose colours stand for cities."""
    rows = records(spark, sf_dir).filter(~F.col("hidden"))
    return rows.select(F.col("id").alias("key"), F.element_at(F.split("name", " "), 1).alias("city"), F.concat_ws(" ", F.element_at(F.split("name", " "), 2), F.lit("group")).alias("name"), "description", "location", "meeting_schedule", "contact")


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("city"))


_scan_sql = f"""{R}, r AS (SELECT id, split_part(name, ' ', 1) AS city, concat_ws(' ', split_part(name, ' ', 2), 'group') AS name, description, location, contact FROM records WHERE NOT hidden), c AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS mentioned FROM part WHERE length(split_part(p_name, ' ', 1)) >= 3),
t AS (SELECT id, city, 1 AS place, 'name' AS field, name AS text FROM r UNION ALL SELECT id, city, 2, 'description', description FROM r UNION ALL SELECT id, city, 3, 'location', location FROM r UNION ALL SELECT id, city, 5, 'contact', contact FROM r),
m AS (SELECT CAST(id AS VARCHAR) AS key, mentioned, arg_min(field, place) AS field FROM t JOIN c ON regexp_matches(text, '(?i)(^|[^a-z0-9_])' || mentioned || '[a-z0-9_]{{0,4}}($|[^a-z0-9_])') WHERE NOT starts_with(mentioned, city) AND NOT starts_with(city, mentioned) GROUP BY 1, 2)"""


@registry.add(f"{_scan_sql} SELECT * FROM m")
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that name another city of the city table in one of their texts."""
    return find_mentions(_rows(spark, sf_dir), _cities(spark, sf_dir)).select("key", "mentioned", "field")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("id % 3 = 0")
    return rows.select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 2 == 0, F.split_part("name", F.lit(" "), F.lit(1))).otherwise("weekly").alias("mentioned"), F.lit("name").alias("field"), F.lit("").alias("snippet"), F.lit("").alias("matched"), F.when(F.col("id") % 5 == 0, "kept").alias("resolution"))


@registry.add(f"""{_scan_sql}, k AS (SELECT CAST(id AS VARCHAR) AS key, CASE WHEN id % 2 = 0 THEN split_part(name, ' ', 1) ELSE 'weekly' END AS mentioned, CASE WHEN id % 5 = 0 THEN 'kept' END AS resolution FROM records WHERE id % 3 = 0),
x AS (SELECT CAST(r.id AS VARCHAR) AS key, lower(concat_ws(' ', r.name, r.description, r.location, s.meeting_schedule, r.contact)) AS text FROM r JOIN records s ON s.id = r.id)
SELECT k.key, k.mentioned, CASE WHEN resolution IS NULL AND (x.text IS NULL OR NOT contains(x.text, lower(k.mentioned))) THEN 'auto_dismissed' ELSE resolution END AS resolution FROM k LEFT JOIN x ON x.key = k.key
UNION ALL SELECT m.key, m.mentioned, NULL FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.key = m.key AND k.mentioned = m.mentioned)""")
def mention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates after a scan: stale ones dismissed, each pair of record and city once."""
    return scan(_known(spark, sf_dir), _rows(spark, sf_dir), _cities(spark, sf_dir)).select("key", "mentioned", "resolution")


@registry.add("""SELECT conv_id, turn, CASE WHEN i > 0 THEN substr(text, 1, i - 1) ELSE text END AS before, CASE WHEN i > 0 THEN substr(text, i, length(w)) ELSE '' END AS match, CASE WHEN i > 0 THEN substr(text, i + length(w)) ELSE '' END AS after
FROM (SELECT *, CASE WHEN w <> '' THEN instr(lower(text), w) ELSE 0 END AS i FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN '' ELSE 'on' END AS w FROM conversations))""")
def mention_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets split at what was found in them."""
    matched = F.when(F.col("turn") % 3 == 0, "").otherwise("ON")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *highlighted(F.col("text"), matched))


QUERIES, ORACLE = registry.queries, registry.oracle
