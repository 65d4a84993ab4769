"""The directory's entities, read from the tables that carry them.

communities: documents with labels (city = source, topic = lang, hidden = toxic);
members: customers by nation, region and market segment; venues: suppliers;
history, outclicks, pageviews and provider calls: events; runs: conversations;
search results: orders with their line items; pages: parts or web pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.session import let_workers_import


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return let_workers_import(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def communities(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """One row per record: id, city, topic, hidden, quality, n_chars and, if asked for, its description."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", *(["text"] if text else []))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    out = docs.join(labels, "doc_id", "left").withColumnsRenamed({"doc_id": "id", "source": "city", "lang": "topic", "text": "description"})
    return out.withColumn("hidden", F.coalesce("toxic", F.lit(0)) == 1).drop("toxic")


COMMUNITIES_SQL = """communities AS (
  SELECT d.doc_id AS id, d.source AS city, d.lang AS topic, d.n_chars, d.text AS description, l.quality, coalesce(l.toxic, 0) = 1 AS hidden
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listed people: id, name, city (nation), country (region), topic (segment), score; hidden below a balance of 0."""
    cities = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    rows = table(spark, sf_dir, "customer").join(cities, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "city", "country", F.col("c_mktsegment").alias("topic"), F.col("c_acctbal").alias("score"), (F.col("c_acctbal") < 0).alias("hidden"))


MEMBERS_SQL = """members AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS city, r_name AS country, c_mktsegment AS topic, c_acctbal AS score, c_acctbal < 0 AS hidden
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as venues: id, name, city and an array of the brands of parts they were ordered for, as welcomed topics."""
    brands = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    topics = brands.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("topics"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.join(topics, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


VENUES_SQL = """venue_topics AS (
  SELECT l_suppkey, list_sort(list(DISTINCT p_brand)) AS topics FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey
), venues AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS city, coalesce(topics, []) AS topics
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN venue_topics ON l_suppkey = s_suppkey)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


EVENTS_SQL = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
