"""Where records come from and how they are shown: enrichment pools, requests to models and their answers, source pages, reports, site scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators.directory import RECORDS_SQL, records
from civicgrid.operators.lifecycle import PG, cached_pages
from civicgrid.operators.records import SEPARATOR, joined, known_text
from civicgrid.operators.ranks import with_places
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table

registry = Registry()
R = f"WITH {RECORDS_SQL}"


def enrichment_pool(rows: DataFrame, pages: DataFrame, cities: list[str], cutoff: str, limit: int, least: int = 300) -> DataFrame:
    """The first ``limit`` visible records (key, place, city, hidden, long_description, enrich_attempted_at, source_url, source_urls) of ``cities`` that have no long text, weren't tried after ``cutoff`` and name a source, each with the first of its cached texts (url_hash, text) of ``least`` characters: the limit is the batch's."""
    empty = F.array().cast("array<string>")
    urls = F.when(F.size(F.coalesce("source_urls", empty)) > 0, F.col("source_urls")).when(known_text(F.col("source_url")).isNotNull(), F.array("source_url")).otherwise(empty)
    open_rows = rows.withColumn("urls", urls).filter(~F.col("hidden") & F.col("city").isin(cities) & known_text(F.col("long_description")).isNull() & (F.coalesce("enrich_attempted_at", F.lit("")) <= cutoff) & (F.size("urls") > 0))
    some = open_rows.orderBy("place").limit(limit)
    sources = some.select("key", F.posexplode("urls").alias("pos", "url")).select("key", "pos", T.url_hash(F.col("url")).alias("url_hash"))
    texts = sources.join(pages.filter(F.length("text") >= least), "url_hash").groupBy("key").agg(F.min_by("text", "pos").alias("raw_text"))
    return some.join(texts, "key", "left").select("key", "place", "city", "urls", "raw_text")


@registry.add(f"""WITH {PG.removeprefix('WITH ')}, {RECORDS_SQL}, o AS (SELECT id AS key, source_urls FROM records WHERE NOT hidden AND city IN ('Brand#7', 'Brand#8') AND id % 4 <> 0 AND id % 5 <> 0 ORDER BY id LIMIT 60),
s AS (SELECT key, source_urls, i, raw_text FROM o, unnest([1, 2]) u(i) LEFT JOIN pages_of p ON p.url = source_urls[i] AND length(raw_text) >= 60)
SELECT key, array_to_string(any_value(source_urls), '{SEPARATOR}') AS urls, length(arg_min(raw_text, i) FILTER (raw_text IS NOT NULL)) AS n_text FROM s GROUP BY key""")
def enrichment_pool_of_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two cities with their cached texts."""
    k = F.col("id")
    rows = records(spark, sf_dir).select(k.alias("key"), k.alias("place"), "city", "hidden", F.when(k % 4 == 0, "done").otherwise(" ").alias("long_description"), F.when(k % 5 == 0, "2026-02-01").when(k % 5 == 1, "2025-12-01").alias("enrich_attempted_at"), "source_url", "source_urls")
    pages = cached_pages(spark, sf_dir).select("url_hash", F.col("data.raw_text").alias("text"))
    out = enrichment_pool(rows, pages, ["Brand#7", "Brand#8"], "2026-01-01", 60, 60)
    return out.select("key", joined("urls"), F.length("raw_text").alias("n_text"))


def filled_prompt(template: str, text: Column, most: int, **fields: Column) -> Column:
    """A model's request: the template's ``{name}`` fields filled, ``{text}`` with the first ``most`` characters of the page, as a model takes no more."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.replace(out, F.lit("{text}"), F.left(F.coalesce(text, F.lit("")), F.lit(most)))


def answer_of(response: Column) -> Column:
    """The content of a chat response's first choice."""
    return F.get_json_object(response, "$.choices[0].message.content")


@registry.add(f"""{PG} SELECT url, 'City ' || city || ', ' || topic || ': ' || left(coalesce(raw_text, ''), 50) AS prompt, CASE WHEN k % 3 > 0 THEN '{{"n":' || k || '}}' END AS answer FROM pages_of""")
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each page, and the content of the responses."""
    rows = cached_pages(spark, sf_dir)
    k = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    content = F.to_json(F.struct(k.alias("n")))
    response = F.when(k % 3 == 0, "{}").otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))))
    return rows.select("url", filled_prompt("City {city}, {topic}: {text}", F.col("data.raw_text"), 50, city=F.col("city"), topic=F.col("topic")).alias("prompt"), answer_of(response).alias("answer"))


def source_pages(pages: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pages of ``hashes`` (url_hash) that are 16 hex digits, with what was asked of a model: url, prompt and the text's beginning."""
    wanted = hashes.filter(F.col("url_hash").rlike("^[0-9a-f]{16}$")).select("url_hash").distinct()
    prompt = F.format_string("%s/%s by %s (%s)", "city", "topic", F.coalesce("data.extract_model", F.lit("-")), F.coalesce("data.extract_fingerprint", F.lit("-")))
    return pages.join(wanted, "url_hash").select("url_hash", "url", prompt.alias("prompt"), F.substring("data.raw_text", 1, 40).alias("start"))


@registry.add(f"""{PG} SELECT url_hash, url, city || '/' || topic || ' by ' || coalesce(extract_model, '-') || ' (' || coalesce(extract_fingerprint, '-') || ')' AS prompt, left(raw_text, 40) AS start FROM pages_of WHERE k % 3 = 1""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source pages of records, whose addresses are checked first."""
    asked = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 1, T.url_hash(F.concat(F.lit("http://src.example/"), "p_partkey"))).when(F.col("p_partkey") % 3 == 2, "../etc").alias("url_hash"))
    return source_pages(cached_pages(spark, sf_dir), asked)


def open_reports(reports: DataFrame, rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """Reports (id, name, city, topic) with the public address of their record, null where it is gone or hidden, and whether it is a false positive already."""
    keys = ["name", "city", "topic"]
    address = F.concat(F.lit("/"), T.slug(F.col("city")), F.lit("/"), T.slug(F.col("name")))
    shown = rows.filter(~F.col("hidden")).select(*keys, address.alias("url")).dropDuplicates(keys)
    known = flagged.select(*keys, F.lit(True).alias("_f")).distinct()
    return reports.join(shown, keys, "left").join(known, keys, "left").select("id", *keys, "url", F.coalesce("_f", F.lit(False)).alias("flagged"))


@registry.add(f"""{R}, s AS (SELECT DISTINCT name, city, topic FROM records WHERE NOT hidden), f AS (SELECT DISTINCT name, city, topic FROM records WHERE id % 30 = 0)
SELECT r.id, CASE WHEN s.name IS NOT NULL THEN '/' || trim(regexp_replace(lower(r.city), '[^a-z0-9]+', '-', 'g'), '-') || '/' || trim(regexp_replace(lower(r.name), '[^a-z0-9]+', '-', 'g'), '-') END AS url, f.name IS NOT NULL AS flagged
FROM records r LEFT JOIN s ON s.name = r.name AND s.city = r.city AND s.topic = r.topic LEFT JOIN f ON f.name = r.name AND f.city = r.city AND f.topic = r.topic WHERE r.id % 6 = 0""")
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reports as the moderators see them."""
    rows = records(spark, sf_dir)
    return open_reports(rows.filter("id % 6 = 0").select("id", "name", "city", "topic"), rows, rows.filter("id % 30 = 0")).select("id", "url", "flagged")


@registry.add(f"""{R}, e AS (SELECT name, city, id FROM records WHERE id % 6 = 0 ORDER BY id DESC LIMIT 30) SELECT string_agg(name || ' (' || city || ')', chr(10) ORDER BY id DESC) AS examples, count(*) AS n FROM e""")
def report_examples(spark: SparkSession, sf_dir: str, most: int = 30) -> DataFrame:
    """The newest reports as a list for a model: 30 is the list's length."""
    newest = records(spark, sf_dir).filter("id % 6 = 0").orderBy(F.desc("id")).limit(most)
    line = F.struct((-F.col("id")).alias("o"), F.concat("name", F.lit(" ("), "city", F.lit(")")).alias("t"))
    return newest.agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda r: r["t"]), "\n").alias("examples"), F.count("*").alias("n"))


def site_cities(cities: DataFrame, site: str, home: str, other: tuple[str, ...] = ()) -> DataFrame:
    """Cities (city, country, place) of a site: the home country's, those of the countries that other sites have, or all the rest."""
    if site == "hu":
        return cities.filter(F.col("country") == home)
    return cities.filter(~F.col("country").isin(home, *other))


def cities_by_slug(cities: DataFrame) -> DataFrame:
    """slug, city and locale: the first configured city of each slug."""
    return cities.withColumn("slug", T.slug(F.col("city"))).groupBy("slug").agg(F.min_by(F.struct("city", "locale"), "place").alias("c")).select("slug", "c.city", "c.locale")


@registry.add("""WITH c AS (SELECT n_name AS city, r_name AS country, n_nationkey AS place FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT 'hu' AS site, city FROM c WHERE country = 'EUROPE' UNION ALL SELECT 'intl', city FROM c WHERE country NOT IN ('EUROPE', 'ASIA')""")
def cities_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cities each site shows."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.col("n_nationkey").alias("place"))
    return site_cities(rows, "hu", "EUROPE").select(F.lit("hu").alias("site"), "city").union(site_cities(rows, "intl", "EUROPE", ("ASIA",)).select(F.lit("intl"), "city"))


@registry.add("WITH c AS (SELECT p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END AS city, p_type AS locale, p_partkey AS place, replace(p_name, ' ', '-') AS slug FROM part) SELECT slug, arg_min(city, place) AS city, arg_min(locale, place) AS locale FROM c GROUP BY slug")
def slug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city and locale that each address leads to."""
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "!").otherwise("")).alias("city"), F.col("p_type").alias("locale"), F.col("p_partkey").alias("place"))
    return cities_by_slug(rows)


def related(rows: DataFrame, most: int = 6) -> DataFrame:
    """city, place, name and total: the first ``most`` visible communities of each city, as a page of a venue or a person there shows them, and how many there are: the limit is the block's."""
    named = rows.filter(~F.coalesce("hidden", F.lit(False)) & (F.trim("name") != "") & (F.trim("city") != ""))
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("city").orderBy("name", "id"))).filter(F.col("place") <= most)
    return first.join(named.groupBy("city").agg(F.count("*").alias("total")), "city").select("city", F.col("place").cast("long").alias("place"), "id", "name", "total")


@registry.add(f"WITH {RECORDS_SQL} SELECT city, row_number() OVER (PARTITION BY city ORDER BY name, id) AS place, id, name, count(*) OVER (PARTITION BY city) AS total FROM records WHERE NOT hidden QUALIFY place <= 6")
def related_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages of venues and people show of their city."""
    return related(records(spark, sf_dir))


@registry.add(f"WITH {RECORDS_SQL}, n AS (SELECT id, CASE id % 3 WHEN 0 THEN translate(name, 'aeou', 'áéöü') WHEN 1 THEN upper(name) ELSE name END AS name FROM records) SELECT id, row_number() OVER (ORDER BY strip_accents(lower(name)), id) AS place FROM n")
def folded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of names in one order, whatever their case and accents."""
    k = F.col("id") % 3
    rows = records(spark, sf_dir).select("id", F.when(k == 0, F.translate("name", "aeou", "áéöü")).when(k == 1, F.upper("name")).otherwise(F.col("name")).alias("name"))
    folded = T.split_by_letters(rows, T.folded, ["name"], lambda df, way: df.select("id", way(F.col("name")).alias("folded")))
    return with_places(folded, [F.col("folded"), F.col("id")]).select("id", "place")


QUERIES, ORACLE = registry.queries, registry.oracle
