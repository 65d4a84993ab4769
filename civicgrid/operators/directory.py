"""Directory records with all their fields, derived from ``part`` by expressions, and what a run brings in anew.

The fields hold what the rules are about: placeholders, leaked JSON, links
without a scheme, e-mail addresses without ``@``, repeated tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.operators.roles import table

#: Fixed names of the derived fields; the SQL below gives the same.
FIELDS = {
    "id": "p_partkey",
    "name": "concat(p_name, CASE WHEN p_partkey % 6 = 0 THEN '\", 0.9, true, 5' ELSE '' END)",
    "city": "p_brand",
    "topic": "p_type",
    "website": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('http://Site.example/', p_partkey % 97, '/') WHEN 2 THEN 'n/a' ELSE concat(' site.example/', p_partkey % 53) END",
    "description": "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' ELSE concat(p_type, ' ', p_name) END",
    "location": "CASE WHEN p_partkey % 2 = 0 THEN concat('near ', p_name) ELSE '' END",
    "contact": "CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE concat('desk ', p_size) END",
    "meeting_schedule": "CASE WHEN p_size < 10 THEN NULL ELSE 'weekly' END",
    "email": "CASE p_partkey % 5 WHEN 0 THEN 'a@b.example' WHEN 1 THEN 'no mail' END",
    "phone": "CASE p_partkey % 3 WHEN 0 THEN concat('06 ', p_size) WHEN 1 THEN 'call me' END",
    "leader": "CASE WHEN p_partkey % 4 = 0 THEN concat('Ana Kis, chair; Dr. Bo Nagy, Ede Tar (', p_type, ')') WHEN p_partkey % 4 = 1 THEN concat('Éva ', p_name) END",
    "source_url": "concat('http://src.example/', p_size)",
    "hidden": "p_retailprice < 905 OR p_partkey % 10 = 3",
}
ARRAYS = {
    "social_links": ["concat('https://s.example/', p_partkey % 11)", "concat(' http://t.example/', p_partkey % 3)", "concat('page ', p_partkey % 3)"],
    "source_urls": ["concat('http://src.example/', p_partkey % 13)", "concat('http://src.example/', p_partkey % 29)"],
    "tags": ["' red '", "'red'", "''", "p_type", "p_brand", "p_name", "concat('t', p_partkey % 5)", "'u'", "'v'", "'w'", "'x'"],
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {k}" for k, e in FIELDS.items()], *[f"array({', '.join(e)}) AS {k}" for k, e in ARRAYS.items()])


RECORDS_SQL = "records AS (SELECT " + ", ".join([f"{e} AS {k}" for k, e in FIELDS.items()] + [f"[{', '.join(e)}] AS {k}" for k, e in ARRAYS.items()]) + " FROM part)"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as named people of a community."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Ana "), F.substring("c_name", 17, 2), F.lit(" Kis")))
    role = F.element_at(F.array(*map(F.lit, ("leader", "Boss", "coach", "member"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer")
    return rows.select(
        F.col("c_custkey").alias("id"), name.alias("name"), role.alias("role"), F.concat(F.lit("city "), F.col("c_nationkey")).alias("city"), F.col("c_mktsegment").alias("topic"),
        F.concat(F.lower("c_mktsegment"), F.lit(" circle "), (F.col("c_custkey") % 4)).alias("community_name"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("balance "), F.floor("c_acctbal"))).alias("bio"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("x.example")).alias("website"), F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.lit("p@q")).alias("email"),
        F.array(F.concat(F.lit("https://p.example/"), F.col("c_custkey") % 7), F.lit("me")).alias("social_links"), F.concat(F.lit("http://src.example/"), F.col("c_nationkey")).alias("source_url"),
        F.array(F.concat(F.lit("http://src.example/"), F.col("c_custkey") % 9)).alias("source_urls"), F.when(F.col("c_custkey") % 3 == 1, F.lit("leader_field")).alias("origin"))


PEOPLE_SQL = """people AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Ana ' || substr(c_name, 17, 2) || ' Kis' END AS name, ['leader', 'Boss', 'coach', 'member'][c_custkey % 4 + 1] AS role,
  'city ' || c_nationkey AS city, c_mktsegment AS topic, lower(c_mktsegment) || ' circle ' || (c_custkey % 4) AS community_name, CASE WHEN c_acctbal > 0 THEN 'balance ' || CAST(floor(c_acctbal) AS BIGINT) END AS bio,
  CASE WHEN c_custkey % 2 = 0 THEN 'x.example' END AS website, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'p@q' END AS email, ['https://p.example/' || (c_custkey % 7), 'me'] AS social_links,
  'http://src.example/' || c_nationkey AS source_url, ['http://src.example/' || (c_custkey % 9)] AS source_urls, CASE WHEN c_custkey % 3 = 1 THEN 'leader_field' END AS origin FROM customer)"""
