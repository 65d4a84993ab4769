"""Listings: filters, searches, ranking, top-k, pagination, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import COMMUNITIES_SQL, EVENTS_SQL, MEMBERS_SQL, VENUES_SQL, communities, events, members, table, venues

registry = Registry()
C, M, E, V = f"WITH {COMMUNITIES_SQL}", f"WITH {MEMBERS_SQL}", f"WITH {EVENTS_SQL}", f"WITH {VENUES_SQL}"


def visible() -> Column:
    return ~F.col("hidden")



def escape_like(text: str) -> str:
    """A text that LIKE with ``ESCAPE '\\'`` takes literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


@registry.add(f"{C} SELECT id, city, topic, n_chars FROM communities WHERE NOT hidden")
def visible_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible records in order of city, topic, id."""
    return communities(spark, sf_dir).filter(visible()).select("id", "city", "topic", "n_chars").orderBy("city", "topic", "id")


@registry.add(f"{C} SELECT id, n_chars FROM communities WHERE city = 'src0' AND topic = 'en' AND NOT hidden")
def pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(spark, sf_dir).filter((F.col("city") == "src0") & (F.col("topic") == "en") & visible()).select("id", "n_chars").orderBy("id")


@registry.add(f"{M} SELECT id, name, topic FROM members WHERE city = 'PERU' AND NOT hidden")
def city_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).filter((F.col("city") == "PERU") & visible()).select("id", "name", "topic").orderBy("topic", "id")


@registry.add("SELECT id, city FROM (SELECT c_custkey AS id, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def in_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a list of ids of any length, as a semi-join."""
    wanted = events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("user_id").alias("id"))
    return members(spark, sf_dir).select("id", "city").join(wanted, "id", "left_semi")


@registry.add(f"{V} SELECT id, name, city FROM venues WHERE list_contains(topics, 'Brand#13')")
def tag_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues(spark, sf_dir).filter(F.array_contains("topics", "Brand#13")).select("id", "name", "city")


@registry.add(f"{V} SELECT DISTINCT city, t AS topic FROM venues, unnest(topics) u(t)")
def venues_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities and topics of venues, by lateral unnest and distinct."""
    return venues(spark, sf_dir).select("city", F.explode("topics").alias("topic")).distinct()


@registry.add(f"{V} SELECT t AS topic, min(id) AS venue FROM venues, unnest(topics) u(t) GROUP BY t")
def first_venue_for_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first venue whose topics hold each topic."""
    return venues(spark, sf_dir).select("id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.min("id").alias("venue"))



@registry.add("""WITH u AS (SELECT 'member' AS entity, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'venue', s_suppkey, s_name FROM supplier UNION ALL SELECT 'topic', p_partkey, p_name FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY name, id) AS rn FROM u WHERE name ILIKE '%0001%' ESCAPE '\\') SELECT entity, id, name FROM f WHERE rn <= 20""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search over three entities, 20 of each: the limit is the feature."""
    parts = [(table(spark, sf_dir, t).select(F.lit(e).alias("entity"), F.col(i).alias("id"), F.col(n).alias("name"))) for t, e, i, n in (("customer", "member", "c_custkey", "c_name"), ("supplier", "venue", "s_suppkey", "s_name"), ("part", "topic", "p_partkey", "p_name"))]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("name").ilike(f"%{escape_like('0001')}%"))
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("entity").orderBy("name", "id"))).filter("rn <= 20").drop("rn")


@registry.add(f"{C} SELECT id FROM communities WHERE NOT hidden AND contains(lower(description), 'été')")
def unicode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-folded substring search of the whole text."""
    return communities(spark, sf_dir, text=True).filter(visible() & F.lower("description").contains("été")).select("id")


@registry.add("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that haven't expired at the reference time."""
    rows = events(spark, sf_dir).filter((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-31").cast("timestamp") - F.expr("INTERVAL 14 DAYS")))
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id")


@registry.add("SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS similarity FROM orders WHERE o_orderstatus IN ('O', 'P')")
def open_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided candidates, most similar first."""
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("similarity")).orderBy(F.desc("similarity"), "id")


@registry.add(f"{C} SELECT count(*) FILTER (quality = 1) AS joinable, count(*) FILTER (quality IS DISTINCT FROM 1) AS removed FROM communities")
def joinable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(spark, sf_dir).agg(F.count_if(F.col("quality") == 1).alias("joinable"), F.count_if(~F.col("quality").eqNullSafe(1)).alias("removed"))


@registry.add(f"{C} SELECT id FROM communities WHERE NOT contains(description, 'http') AND NOT contains(description, '@') AND coalesce(quality, 0) >= 0.7")
def needs_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No link, no contact, and confidence of 0.7 or more, unknown counting as 0."""
    text = F.col("description")
    return communities(spark, sf_dir, text=True).filter(~text.contains("http") & ~text.contains("@") & (F.coalesce("quality", F.lit(0)) >= 0.7)).select("id")


@registry.add("SELECT p_partkey AS page, p_size AS quality FROM part WHERE p_type LIKE 'STANDARD%' AND p_size < 20 ORDER BY p_size, p_partkey LIMIT 200")
def upgrade_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 worst pages below the threshold within scope: the filter comes before the limit."""
    return table(spark, sf_dir, "part").filter(F.col("p_type").startswith("STANDARD") & (F.col("p_size") < 20)).select(F.col("p_partkey").alias("page"), F.col("p_size").alias("quality")).orderBy("quality", "page").limit(200)


@registry.add("""WITH first_source AS (SELECT l_orderkey AS id, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) FILTER (p_retailprice >= 950) AS source FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT id, source FROM first_source WHERE source IS NOT NULL""")
def enrichment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record the first of its ordered sources that is cached and long enough."""
    pages = table(spark, sf_dir, "part").filter("p_retailprice >= 950").select("p_partkey")
    sources = table(spark, sf_dir, "lineitem").join(pages, F.col("l_partkey") == F.col("p_partkey"))
    return sources.groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("source"))


PAGE_SIZE = 100


@registry.add(f"{M}, r AS (SELECT id, name, row_number() OVER (ORDER BY name, id) AS rn, count(*) OVER () AS n FROM members WHERE NOT hidden) SELECT id, name FROM r WHERE rn > (least(greatest(3, 1), CAST(ceil(n / {PAGE_SIZE}.0) AS BIGINT)) - 1) * {PAGE_SIZE} AND rn <= least(greatest(3, 1), CAST(ceil(n / {PAGE_SIZE}.0) AS BIGINT)) * {PAGE_SIZE}")
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of the listing, clamped to the pages there are."""
    rows = members(spark, sf_dir).filter(visible()).select("id", "name")
    pages = max(1, -(-rows.count() // PAGE_SIZE))
    return rows.orderBy("name", "id").offset((min(max(3, 1), pages) - 1) * PAGE_SIZE).limit(PAGE_SIZE)


@registry.add(f"{M}, c AS (SELECT city, country, count(*) AS n FROM members WHERE NOT hidden GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, city) AS rn, sum(n) OVER (PARTITION BY country) AS total FROM c) SELECT country, city, n, total::BIGINT AS total, dense_rank() OVER (ORDER BY total DESC, country) AS place FROM r WHERE rn <= 3")
def top_cities_per_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest cities of each country, countries ranked by all their records."""
    counts = members(spark, sf_dir).filter(visible()).groupBy("city", "country").agg(F.count("*").alias("n"))
    by_country = Window.partitionBy("country")
    ranked = counts.withColumns({"rn": F.row_number().over(by_country.orderBy(F.desc("n"), "city")), "total": F.sum("n").over(by_country)}).filter("rn <= 3")
    return ranked.select("country", "city", "n", "total", F.dense_rank().over(Window.orderBy(F.desc("total"), "country")).cast("long").alias("place"))


@registry.add(f"{M}, r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, id) AS rn FROM members) SELECT city, id, score FROM r WHERE rn <= 10")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten records of each city: the cap is the feature."""
    ranked = members(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("score"), "id")))
    return ranked.filter("rn <= 10").select("city", "id", "score")


@registry.add(f"{M}, r AS (SELECT id, topic = 'BUILDING' AS same_topic, row_number() OVER (PARTITION BY topic = 'BUILDING' ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY topic = 'BUILDING') AS total FROM members WHERE city = 'PERU') SELECT id, same_topic, total FROM r WHERE rn <= 6")
def related_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city's records of the same topic and of others, six of each, with the totals."""
    rows = members(spark, sf_dir).filter("city = 'PERU'").withColumn("same_topic", F.col("topic") == "BUILDING")
    split = Window.partitionBy("same_topic")
    return rows.withColumns({"rn": F.row_number().over(split.orderBy(F.desc("score"), "id")), "total": F.count("*").over(split)}).filter("rn <= 6").select("id", "same_topic", "total")


@registry.add(f"{C} SELECT city, arg_min(id, topic || '/' || lpad(CAST(id AS VARCHAR), 12, '0')) AS id, max(n_chars) AS last_mod FROM communities WHERE NOT hidden GROUP BY city")
def lastmod_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each city by topic and id."""
    return communities(spark, sf_dir).filter(visible()).groupBy("city").agg(F.min_by("id", F.struct("topic", "id")).alias("id"), F.max("n_chars").alias("last_mod"))


@registry.add("SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY user_id")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("seq"))


@registry.add(f"{M} SELECT 'city' AS facet, city AS value, count(*) AS n FROM members GROUP BY city UNION ALL SELECT 'country', country, count(*) FROM members GROUP BY country UNION ALL SELECT 'topic', topic, count(*) FROM members GROUP BY topic")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet values and counts in one pass over grouping sets."""
    rows = members(spark, sf_dir).unpivot("id", ["city", "country", "topic"], "facet", "value")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


_BLOCKED = ("example.net", "ththre.example.com")
_HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


@registry.add(f"SELECT page_id, {_HOST_SQL} AS host FROM pages WHERE NOT ({' OR '.join(f'''({_HOST_SQL} = '{d}' OR ends_with({_HOST_SQL}, '.{d}'))''' for d in _BLOCKED)})")
def blocked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages outside a list of blocked domains and their subdomains."""
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    blocked = F.exists(F.array(*map(F.lit, _BLOCKED)), lambda d: (F.col("host") == d) | F.col("host").endswith(F.concat(F.lit("."), d)))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).filter(~blocked)


_SAFE = r"^https?://[^/?#@\s:]+\.[a-z]{2,}(:(80|443))?([/?#]\S*)?$"
_LOCAL = r"^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|\[)"


@registry.add(f"SELECT page_id, length(url) <= 2048 AND regexp_matches(url, '{_SAFE}') AND NOT regexp_matches(url, '{_LOCAL}') AS safe FROM pages")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public web addresses: scheme, no white space, no user part, usual ports, no local or private host."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ((F.length(url) <= 2048) & url.rlike(_SAFE) & ~url.rlike(_LOCAL)).alias("safe"))


@registry.add("SELECT event_id FROM events WHERE contains(lower('' || event_id || '|' || event_type || '|' || user_id || '|' || props), 'k\": 7') AND event_type = 'view'")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of one level whose whole text holds a needle."""
    whole = F.lower(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"), "props"))
    return table(spark, sf_dir, "events").filter((F.col("event_type") == "view") & whole.contains('k": 7')).select("event_id")


@registry.add("SELECT event_id FROM events WHERE event_id > 5000 AND event_type = 'error' ORDER BY event_id DESC LIMIT 500")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 lines after a sequence number, oldest first."""
    return events(spark, sf_dir).filter((F.col("event_id") > 5000) & (F.col("event_type") == "error")).select("event_id").orderBy(F.desc("event_id")).limit(500).orderBy("event_id")


@registry.add("SELECT day, string_agg(event_id || ':' || event_type, ',' ORDER BY ts DESC, event_id DESC) AS newest FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY day")
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest changes of each day, newest first."""
    rows = events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    latest = rows.withColumn("rn", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("event_id")))).filter("rn <= 5")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id", "event_type"))), lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["event_type"]))
    return latest.groupBy("day").agg(F.array_join(parts, ",").alias("newest"))


@registry.add("WITH m AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN starts_with(lower(p_name), 'part 1') THEN 0 ELSE 1 END AS rank FROM part WHERE contains(lower(p_name), 'part 1')) SELECT id, name FROM m ORDER BY rank, id LIMIT 8")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight suggestions, prefix matches before infix ones."""
    name = F.lower("p_name")
    found = table(spark, sf_dir, "part").filter(name.contains("part 1")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(name.startswith("part 1"), 0).otherwise(1).alias("rank"))
    return found.orderBy("rank", "id").limit(8).drop("rank")


_ASKED = ("PERU", "UNITED", "FRA", "IA", "XYZ", "JORDAN")


@registry.add(f"""WITH q(asked) AS (VALUES {', '.join(f"('{x}')" for x in _ASKED)}), m AS (SELECT asked, n_name, n_name = asked AS exact, starts_with(n_name, asked) AS prefix FROM q JOIN nation ON contains(n_name, asked)),
t AS (SELECT asked, max(n_name) FILTER (exact) AS e, count(*) FILTER (prefix) AS np, max(n_name) FILTER (prefix) AS p, count(*) AS ni, max(n_name) AS i FROM m GROUP BY asked)
SELECT q.asked, coalesce(e, CASE WHEN np = 1 THEN p WHEN np = 0 AND ni = 1 THEN i END) AS city FROM q LEFT JOIN t ON t.asked = q.asked""")
def resolve_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name is the exact city, else the only one with that prefix, else the only one that holds it."""
    asked = spark.createDataFrame([(x,) for x in _ASKED], "asked string")
    cities = table(spark, sf_dir, "nation").select("n_name")
    found = cities.join(F.broadcast(asked), F.col("n_name").contains(F.col("asked")))  # six names
    prefix = F.col("n_name").startswith(F.col("asked"))
    tiers = found.groupBy("asked").agg(F.max(F.when(F.col("n_name") == F.col("asked"), F.col("n_name"))).alias("e"), F.count_if(prefix).alias("np"), F.max(F.when(prefix, F.col("n_name"))).alias("p"), F.count("*").alias("ni"), F.max("n_name").alias("i"))
    return asked.join(tiers, "asked", "left").select("asked", F.coalesce("e", F.when(F.col("np") == 1, F.col("p")).when((F.col("np") == 0) & (F.col("ni") == 1), F.col("i"))).alias("city"))


_PRIORITY = ("EUROPE", "ASIA")


@registry.add(f"SELECT n_name AS city, r_name AS country, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 99 END, n_nationkey) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def priority_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities of named countries first, in the names' order, then the rest as configured."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rank = F.array_position(F.array(*map(F.lit, _PRIORITY)), F.col("r_name"))
    return rows.select(F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.row_number().over(Window.orderBy(F.when(rank == 0, 99).otherwise(rank), "n_nationkey")).cast("long").alias("place"))


@registry.add("SELECT user_id, sha256(CAST(user_id AS VARCHAR)) AS h FROM (SELECT DISTINCT user_id FROM events) ORDER BY h LIMIT 40")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable sample in hash order: the limit is the feature."""
    return events(spark, sf_dir).select("user_id").distinct().withColumn("h", F.sha2(F.col("user_id").cast("string"), 256)).orderBy("h").limit(40)


@registry.add(f"{M} SELECT city, sum(CASE WHEN topic = 'BUILDING' THEN 1 ELSE 0 END)::BIGINT AS measured, CASE WHEN count(*) FILTER (topic = 'BUILDING') > 0 THEN round(avg(score) FILTER (topic = 'BUILDING'), 4) END AS score FROM members GROUP BY city")
def measured_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured entries first, best first; the unmeasured have no score rather than a bad one."""
    score = F.avg(F.when(F.col("topic") == "BUILDING", F.col("score")))
    rows = members(spark, sf_dir).groupBy("city").agg(F.count_if(F.col("topic") == "BUILDING").alias("measured"), F.round(score, 4).alias("score"))
    return rows.orderBy((F.col("measured") > 0).desc(), F.desc_nulls_last("score"), "city")


@registry.add("WITH p AS (SELECT o_orderkey, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_orderkey AS job, o_orderstatus AS state FROM p WHERE o_orderstatus <> 'F' OR rn <= 30")
def job_queue_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting and running jobs, and the last 30 that ended."""
    done = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", done.alias("rn")).filter("o_orderstatus <> 'F' OR rn <= 30").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("state"))


@registry.add(f"{M} SELECT country, count(DISTINCT city) AS cities, string_agg(DISTINCT city, ',' ORDER BY city) AS names FROM members GROUP BY country")
def dashboard_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries and their cities in order."""
    return members(spark, sf_dir).groupBy("country").agg(F.countDistinct("city").alias("cities"), F.array_join(F.array_sort(F.collect_set("city")), ",").alias("names"))


@registry.add(f"""{M} SELECT id, name FROM members WHERE (topic = 'BUILDING') AND (NOT hidden) AND score BETWEEN 1000 AND 5000 AND city IS NOT NULL AND (country = 'ASIA' OR country = 'EUROPE')""")
def composed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional filters put together; those that aren't asked for add nothing."""
    asked = {"topic": "BUILDING", "hidden": False, "low": 1000, "high": 5000, "countries": ["ASIA", "EUROPE"], "name": None}
    parts = [F.col("topic") == asked["topic"], F.col("hidden") == asked["hidden"], F.col("score").between(asked["low"], asked["high"]), F.col("country").isin(asked["countries"]), F.col("name").contains(asked["name"]) if asked["name"] else None]
    rows = members(spark, sf_dir)
    for part in parts:
        rows = rows if part is None else rows.filter(part)
    return rows.select("id", "name")


QUERIES, ORACLE = registry.queries, registry.oracle
