"""Queries that apply the text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table

registry = Registry()


@registry.add("SELECT page_id, left(sha256(url), 16) AS url_hash FROM pages")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_hash(F.col("url")).alias("url_hash"))


@registry.add("SELECT c_custkey AS id, left(sha256(lower(c_name) || '|' || lower(n_name)), 12) AS entity_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), T.entity_id(F.col("c_name"), F.col("n_name")).alias("entity_id"))


@registry.add("SELECT c_custkey AS id, 'c2:' || left(sha256(lower(trim(c_name)) || chr(31) || lower(n_name) || chr(31) || lower(c_mktsegment)), 24) AS record_key FROM customer JOIN nation ON n_nationkey = c_nationkey")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record keys of name, city and topic; the names here are ASCII, so SQL can check them."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return T.with_record_key(rows, "c", ["c_name", "n_name", "c_mktsegment"], "record_key").select(F.col("c_custkey").alias("id"), "record_key")


@registry.add("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_by_letters(table(spark, sf_dir, "part"), T.slug, ["p_name"], lambda rows, way: rows.select(F.col("p_partkey").alias("id"), way(F.col("p_name")).alias("slug")))


@registry.add("SELECT event_id, CASE WHEN lower(trim(event_type)) NOT IN ('error', 'n/a', 'none') THEN event_type END AS kind FROM events")
def null_like_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand for nothing become null; in this table ``error`` does."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.null_like(kind).alias("kind"))


_WORDS = ("Nincs megadva", " N/A ", "nem ismert", "UNKNOWN", "none", "not provided", "Not available", "-", "–", "na", "ismeretlen", "keine Angabe", "unbekannt", "known", "n.a.", "")


@registry.add(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 16 >= 13 THEN {list(_WORDS)}[p_partkey % 16 + 1] END AS text FROM part")
def null_like_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen words that stand for nothing, and some that don't."""
    text = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % 16 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.null_like(text).alias("text"))


@registry.add("""WITH t AS (SELECT p_partkey AS id, list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> '') AS tags FROM part)
SELECT id, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i)[1:8], ',') AS tags FROM t""")
def tags_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.normal_tags(F.split("p_type", " ")), ",").alias("tags"))


@registry.add("SELECT page_id, rtrim(lower(url), '/') AS url, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS website, CASE WHEN starts_with(url, 'https://') THEN 1 ELSE 0 END AS secure FROM pages")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.normal_url(url).alias("url"), T.with_scheme(url).alias("website"), F.size(F.filter(F.array(url), lambda x: x.startswith("https://"))).alias("secure"))


@registry.add("SELECT conv_id, turn, CASE WHEN contains(text, '@') THEN 1 ELSE 0 END AS email, CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS phone, CASE WHEN regexp_matches(upper(left(text, 1)), '[A-Z]') THEN upper(left(text, 1)) ELSE '#' END AS initial FROM conversations")
def contact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.valid_email(text).isNotNull().cast("int").alias("email"), T.valid_phone(text).isNotNull().cast("int").alias("phone"), T.initial(text).alias("initial"))


@registry.add("SELECT page_id, '{\"@type\":\"Organization\",\"name\":\"page ' || page_id || '\",\"url\":\"' || url || '\"}' AS jsonld FROM pages")
def jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linked-data object for each page."""
    thing = F.struct(F.lit("Organization").alias("@type"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"), "url")
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(thing).alias("jsonld"))


def _platform_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(h, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in T.PLATFORMS.items())
    return f"SELECT page_id, CASE {cases} ELSE left(h, 28) END AS platform FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[.]', '') AS h FROM pages)"


@registry.add(_platform_sql())
def platform_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for the site that a link goes to."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), "^www[.]", "")
    return table(spark, sf_dir, "pages").select("page_id", T.platform(host).alias("platform"))


@registry.add("SELECT o_orderkey AS id, CASE WHEN s < 60 THEN printf('%.1fs', CAST(s AS DOUBLE)) ELSE printf('%dm %ds', s // 60, s % 60) END AS took FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS s FROM orders)")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.duration(F.floor(F.col("o_totalprice") / 100)).alias("took"))


@registry.add("SELECT o_orderkey AS id, hour(o_orderdate) * 60 + minute(o_orderdate) >= 1320 OR hour(o_orderdate) * 60 + minute(o_orderdate) < 360 AS inside FROM orders")
def daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a time falls in the nightly window from 22:00 to 06:00, which crosses midnight."""
    minute = F.hour("o_orderdate") * 60 + F.minute("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((minute >= 1320) | (minute < 360)).alias("inside"))


@registry.add("""SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN CASE WHEN json_extract(props, '$.k') IS NULL THEN 'empty' ELSE 'ok' END ELSE 'error' END AS status, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def payload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-state unwrapping of a JSON payload: broken, empty and filled stay apart."""
    parsed = F.from_json("props", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    status = F.when(F.col("p").isNull() | F.col("p._corrupt_record").isNotNull(), "error").when(F.col("p.k").isNull(), "empty").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", status.alias("status"), F.col("p.k").alias("k"))


@registry.add()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_text("html").alias("text"))


@registry.add()
def leader_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People named in free text, one row each."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.leaders(F.col("text"))).alias("pos", "p"))
    return rows.select("conv_id", "turn", "pos", "p.name", "p.role")


@registry.add()
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line differences between each turn and the one before it."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", T.line_diff("before", "text").alias("diff"))


QUERIES, ORACLE = registry.queries, registry.oracle
