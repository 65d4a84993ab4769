"""Incremental work planning: joins of pairs with cached pages, done pairs, remainders, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import EVENTS_SQL, MEMBERS_SQL, events, members, table
from civicgrid.plans.passes import universe_of

registry = Registry()
M, E = f"WITH {MEMBERS_SQL}", f"WITH {EVENTS_SQL}"
CURRENT = "Brand#13"
MAX_PAGES = 3

#: A pair is an order, its URL list the parts of its line items in order, a page a part with its brand as fingerprint.
URLS_SQL = "urls AS (SELECT l_orderkey AS pair, l_partkey AS url, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem)"


def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair and the ordered array of its URLs; pairs without any have an empty one."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("urls"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair")).join(lists, "pair", "left").select("pair", F.coalesce("urls", F.array().cast("array<bigint>")).alias("urls"))


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows: pair, number in the list, url."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("url"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("fingerprint"), F.col("p_size").alias("quality"))


@registry.add(f"WITH {URLS_SQL} SELECT o_orderkey AS pair, count(url) AS urls, count(p_partkey) AS cached, count(*) FILTER (p_brand = '{CURRENT}') AS current FROM orders LEFT JOIN urls ON pair = o_orderkey LEFT JOIN part ON p_partkey = url GROUP BY o_orderkey")
def pair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair its URLs, those that are cached and those extracted by the current version."""
    rows = listed_urls(spark, sf_dir).join(pages(spark, sf_dir), "url", "left").groupBy("pair").agg(F.count("*").alias("urls"), F.count("fingerprint").alias("cached"), F.count_if(F.col("fingerprint") == CURRENT).alias("current"))
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair")).join(rows, "pair", "left")
    return every.select("pair", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("urls", "cached", "current")])


@registry.add(f"""WITH {URLS_SQL}, t AS (SELECT o_orderkey AS pair, count(url) AS n, count(p_partkey) AS known, coalesce(bool_and(p_brand <= '{CURRENT}') FILTER (p_partkey IS NOT NULL), true) AS ok FROM orders LEFT JOIN urls ON pair = o_orderkey AND pos < {MAX_PAGES} LEFT JOIN part ON p_partkey = url AND p_size > 5 GROUP BY o_orderkey)
SELECT pair FROM t WHERE n = 0 OR (known > 0 AND ok)""")
def done_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose known pages are all current: an empty list is done, one without any known page isn't."""
    place = Window.partitionBy("pair").orderBy("number", "url")
    first = listed_urls(spark, sf_dir).withColumn("n", F.row_number().over(place)).filter(F.col("n") <= MAX_PAGES)
    known = first.join(pages(spark, sf_dir).filter("quality > 5"), "url", "left")
    state = known.groupBy("pair").agg(F.count("fingerprint").alias("known"), F.bool_and(F.when(F.col("fingerprint").isNotNull(), F.col("fingerprint") <= CURRENT)).alias("ok"))
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair")).join(state, "pair", "left")
    return every.filter(F.col("known").isNull() | ((F.col("known") > 0) & F.col("ok"))).select("pair")


@registry.add("""WITH linked AS (SELECT DISTINCT l_suppkey AS city, l_partkey AS page FROM lineitem WHERE l_returnflag = 'R')
SELECT city, page FROM linked UNION ALL SELECT NULL, p_partkey FROM part WHERE p_partkey NOT IN (SELECT page FROM linked)""")
def attribution_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with every pair that found them, and those that no pair found."""
    linked = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("city"), F.col("l_partkey").alias("page")).distinct()
    rest = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page")).join(linked, "page", "left_anti")
    return linked.unionByName(rest.withColumn("city", F.lit(None).cast("long")))


@registry.add(f"WITH {URLS_SQL} SELECT pair, pos, url, p_brand AS fingerprint FROM urls JOIN part ON p_partkey = url WHERE p_size > 10")
def ordered_pair_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached pages of each pair at their places in its list."""
    place = F.row_number().over(Window.partitionBy("pair").orderBy("number", "url")) - 1
    rows = listed_urls(spark, sf_dir).withColumn("pos", place.cast("long"))
    return rows.join(pages(spark, sf_dir).filter("quality > 10"), "url").select("pair", "pos", "url", "fingerprint")


def cached_pages_of(pairs: DataFrame, searched: DataFrame, listed: DataFrame, cached: DataFrame) -> DataFrame:
    """pair, pos, url of the cached pages of ``pairs`` (pair): of those that were ``searched`` (pair) the pages in their list (pair, pos, url), in its order; of the others those that the cache (url, pair) has under the pair itself, without an order."""
    known = cached.filter(F.col("url").isNotNull())
    from_list = listed.join(pairs, "pair", "left_semi").join(searched, "pair", "left_semi").join(known.select("url"), "url")
    own = known.join(pairs, "pair", "left_semi").join(searched, "pair", "left_anti")
    return from_list.select("pair", "pos", "url").unionByName(own.select("pair", F.lit(None).cast(from_list.schema["pos"].dataType).alias("pos"), "url"))


@registry.add(f"WITH {URLS_SQL} SELECT pair, pos, url FROM urls JOIN part ON p_partkey = url WHERE p_size > 10 AND pair % 10 <> 0 UNION ALL SELECT o_orderkey, NULL, p_partkey FROM orders JOIN part ON p_partkey % 997 = o_orderkey WHERE p_size > 10 AND o_orderkey % 10 = 0")
def pages_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached pages of each pair; pairs that were never searched have those that name them."""
    place = F.row_number().over(Window.partitionBy("pair").orderBy("number", "url")) - 1
    listed = listed_urls(spark, sf_dir).withColumn("pos", place.cast("long"))
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"))
    cached = pages(spark, sf_dir).filter("quality > 10").select("url", (F.col("url") % 997).alias("pair"))
    return cached_pages_of(pairs, pairs.filter("pair % 10 <> 0"), listed, cached)


_UNIVERSE_SQL = "u AS (SELECT n_name AS city, topic, n_regionkey FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS topic FROM customer)), universe AS (SELECT city, topic FROM u WHERE n_regionkey <> 2 OR topic IN ('BUILDING', 'MACHINERY'))"


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities x topics, those of the core tier only with the core topics."""
    cities = table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.when(F.col("n_regionkey") == 2, "core").otherwise("full").alias("tier"))
    return universe_of(cities, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("topic")).distinct(), ["BUILDING", "MACHINERY"])


@registry.add(f"WITH {_UNIVERSE_SQL} SELECT city, topic FROM universe")
def work_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe(spark, sf_dir)


@registry.add(f"{M}, {_UNIVERSE_SQL} SELECT city, topic FROM universe EXCEPT SELECT city, topic FROM members WHERE score > 5000 AND score < 5600")
def work_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe less what is done."""
    done = members(spark, sf_dir).filter("score > 5000 AND score < 5600").select("city", "topic")
    return universe(spark, sf_dir).join(done, ["city", "topic"], "left_anti")


@registry.add(f"{M}, {_UNIVERSE_SQL} SELECT city, topic FROM universe EXCEPT SELECT city, topic FROM members WHERE score > 9000 EXCEPT SELECT city, topic FROM members WHERE score < -900")
def uncovered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe less what is covered and less what is done."""
    rows = members(spark, sf_dir)
    return universe(spark, sf_dir).join(rows.filter("score > 9000").select("city", "topic"), ["city", "topic"], "left_anti").join(rows.filter("score < -900").select("city", "topic"), ["city", "topic"], "left_anti")


@registry.add("SELECT n_name AS city FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 3")
def foreign_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "nation")
    return cities.select(F.col("n_name").alias("city")).subtract(cities.filter("n_regionkey = 3").select("n_name"))


@registry.add("""WITH p AS (SELECT 1 AS part, n_nationkey AS ord, '/' || lower(n_name) AS loc FROM nation UNION ALL SELECT 2, r_regionkey, '/' || lower(r_name) FROM region UNION ALL SELECT 3, s_suppkey, '/' || lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT loc, min(CAST(part AS BIGINT) * 1000000000 + ord) AS place FROM p GROUP BY loc""")
def sitemap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered union of location lists, each location where it comes first."""
    nation = table(spark, sf_dir, "nation")
    loc = lambda c: F.concat(F.lit("/"), F.lower(c))
    parts = nation.select(F.lit(1).alias("part"), F.col("n_nationkey").cast("long").alias("ord"), loc("n_name").alias("loc"))
    parts = parts.unionByName(table(spark, sf_dir, "region").select(F.lit(2).alias("part"), F.col("r_regionkey").cast("long").alias("ord"), loc("r_name").alias("loc")))
    parts = parts.unionByName(table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit(3).alias("part"), F.col("s_suppkey").alias("ord"), loc("n_name").alias("loc")))
    return parts.groupBy("loc").agg(F.min(F.col("part").cast("long") * 1_000_000_000 + F.col("ord")).alias("place"))


@registry.add("""WITH r AS (SELECT o_custkey AS pair, o_orderkey AS query, l_partkey AS url, l_linenumber AS rank, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderkey, l_linenumber) AS seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY query, rank, url) AS place FROM r WHERE seen = 1) SELECT pair, url, place FROM n WHERE place <= 10""")
def search_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a pair's queries in turn, each URL once, ten for each pair: the stop is the feature."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("query"), F.col("l_partkey").alias("url"), F.col("l_linenumber").alias("rank"))
    first = rows.groupBy("pair", "url").agg(F.min(F.struct("query", "rank")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy("at.query", "at.rank", "url")).cast("long")).filter("place <= 10").select("pair", "url", "place")


@registry.add("""WITH s AS (SELECT c_custkey AS id, 'city-' || (c_custkey % 400) AS slug, n_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT *, count(*) OVER (PARTITION BY slug) AS n, slug || '-' || lower(region) AS longer FROM s), d AS (SELECT *, count(*) OVER (PARTITION BY longer) AS m FROM c)
SELECT id, CASE WHEN n = 1 THEN slug WHEN m = 1 THEN longer END AS slug FROM d WHERE n = 1 OR m = 1""")
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug that several claim gets the region's name; what still collides goes."""
    rows = members(spark, sf_dir).select("id", F.concat(F.lit("city-"), (F.col("id") % 400).cast("string")).alias("slug"), "city")
    named = rows.withColumns({"n": F.count("*").over(Window.partitionBy("slug")), "longer": F.concat_ws("-", "slug", F.lower("city"))}).withColumn("m", F.count("*").over(Window.partitionBy("longer")))
    return named.filter("n = 1 OR m = 1").select("id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.col("longer")).alias("slug"))


@registry.add("""WITH a AS (SELECT c_mktsegment AS provider, list(DISTINCT n_name) AS configured FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9500 GROUP BY 1), b AS (SELECT c_mktsegment AS provider, list(DISTINCT n_name) AS live FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < -800 GROUP BY 1)
SELECT provider, CASE WHEN live IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(configured, lambda x: NOT list_contains(live, x))), ',') END AS gone, array_to_string(list_sort(list_filter(coalesce(live, []), lambda x: NOT list_contains(configured, x))), ',') AS new FROM a LEFT JOIN b USING (provider)""")
def model_list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured against live names, both differences; a live list that is missing proves nothing gone."""
    rows = members(spark, sf_dir)
    configured = rows.filter("score > 9500").groupBy(F.col("topic").alias("provider")).agg(F.collect_set("city").alias("configured"))
    live = rows.filter("score < -800").groupBy(F.col("topic").alias("provider")).agg(F.collect_set("city").alias("live"))
    both = configured.join(live, "provider", "left")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select("provider", F.when(F.col("live").isNull(), "").otherwise(text(F.array_except("configured", "live"))).alias("gone"), F.coalesce(text(F.array_except("live", "configured")), F.lit("")).alias("new"))


@registry.add(f"{E}, seen AS (SELECT user_id, min(ts) AS first_ts, min(event_id) AS first_id FROM ev GROUP BY user_id) SELECT e.event_type, count(DISTINCT s.user_id) AS n FROM seen s JOIN ev e ON e.user_id = s.user_id AND e.event_id = s.first_id WHERE s.first_ts >= TIMESTAMP '2024-01-10' GROUP BY e.event_type")
def recently_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities first seen since a day, by what they were first seen with: one row per entity before any count."""
    first = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("event_type", "event_id").alias("event_type"))
    return first.filter(F.col("first_ts") >= "2024-01-10").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))


@registry.add(f"{E} SELECT n_name AS city, count(*) AS clicks, count(DISTINCT user_id) AS visitors FROM ev LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON c_custkey = user_id WHERE event_type = 'click' GROUP BY n_name ORDER BY clicks DESC, city NULLS FIRST LIMIT 15")
def outclicks_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks joined to a dimension with one row for each id, so that none counts twice; the 15 largest."""
    dim = members(spark, sf_dir).select(F.col("id").alias("user_id"), "city").dropDuplicates(["user_id"])
    clicks = events(spark, sf_dir).filter("event_type = 'click'").join(dim, "user_id", "left")
    return clicks.groupBy("city").agg(F.count("*").alias("clicks"), F.countDistinct("user_id").alias("visitors")).orderBy(F.desc("clicks"), F.asc_nulls_first("city")).limit(15)


@registry.add("SELECT o_orderkey AS candidate, c_name AS winner, s_name AS loser FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each candidate, where they still exist."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate"), "o_custkey")
    winner, loser = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("winner")), table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("loser"))
    return rows.join(winner, F.col("c_custkey") == F.col("o_custkey"), "left").join(loser, F.col("s_suppkey") == F.col("o_custkey"), "left").select("candidate", "winner", "loser")


@registry.add("SELECT o_orderkey AS candidate, CASE WHEN o_orderstatus = 'P' THEN 'manual' WHEN c_custkey IS NULL OR s_suppkey IS NULL OR c_nationkey <> s_nationkey THEN 'auto_dismissed' ELSE 'open' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 100")
def stale_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are dismissed when a side is gone or they no longer agree; manual ones are exempt."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    found = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("o_orderkey") % 100, "left")
    gone = F.col("c_custkey").isNull() | F.col("s_suppkey").isNull() | (F.col("c_nationkey") != F.col("s_nationkey"))
    return found.select(F.col("o_orderkey").alias("candidate"), F.when(F.col("o_orderstatus") == "P", "manual").when(gone, "auto_dismissed").otherwise("open").alias("state"))


_LAT, _LNG = 47.5, 19.0
_COORDS_SQL = "SELECT n_name AS city, CAST((n_nationkey * 37 % 120) - 60 AS DOUBLE) AS lat, CAST((n_nationkey * 71 % 340) - 170 AS DOUBLE) AS lng FROM nation"


@registry.add(f"WITH c AS ({_COORDS_SQL}) SELECT city, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat - {_LAT}) / 2), 2) + cos(radians({_LAT})) * cos(radians(lat)) * pow(sin(radians(lng - {_LNG}) / 2), 2))), 3) AS km FROM c ORDER BY km, city LIMIT 6")
def nearby_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest cities by great-circle distance."""
    lat, lng = (F.col("n_nationkey") * 37 % 120) - 60.0, (F.col("n_nationkey") * 71 % 340) - 170.0
    half = F.pow(F.sin(F.radians(lat - _LAT) / 2), F.lit(2)) + F.cos(F.radians(F.lit(_LAT))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lng - _LNG) / 2), F.lit(2))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.round(2 * 6371 * F.asin(F.sqrt(half)), 3).alias("km")).orderBy("km", "city").limit(6)


@registry.add(f"{M}, t AS (SELECT city, count(*) AS n FROM members WHERE NOT hidden GROUP BY city), c AS ({_COORDS_SQL}) SELECT c.city, lat, lng, coalesce(n, 0) AS n FROM c LEFT JOIN t ON t.city = c.city")
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities with coordinates and their counts."""
    counts = members(spark, sf_dir).filter(~F.col("hidden")).groupBy("city").agg(F.count("*").alias("n"))
    lat, lng = (F.col("n_nationkey") * 37 % 120) - 60.0, (F.col("n_nationkey") * 71 % 340) - 170.0
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), lat.alias("lat"), lng.alias("lng")).join(counts, "city", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@registry.add("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') AND max(event_id) FILTER (event_type = 'error') > coalesce(max(event_id) FILTER (event_type = 'purchase'), -1) THEN 'wait' WHEN count(*) FILTER (event_type = 'view') > 10 THEN 'extract' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'collect' ELSE 'idle' END AS action FROM events GROUP BY user_id""")
def next_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a worker does next: precedence of four conditions."""
    kind, last = F.col("event_type"), lambda k: F.max(F.when(F.col("event_type") == k, F.col("event_id")))
    broken = F.bool_or(kind == "error") & (last("error") > F.coalesce(last("purchase"), F.lit(-1)))
    return events(spark, sf_dir).groupBy("user_id").agg(F.when(broken, "wait").when(F.count_if(kind == "view") > 10, "extract").when(F.count_if(kind == "click") > 0, "collect").otherwise("idle").alias("action"))


@registry.add("SELECT count(DISTINCT o_orderkey) AS pairs, count(DISTINCT l_orderkey) AS searched, count(DISTINCT l_partkey) AS pages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def backlog_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").agg(F.countDistinct("o_orderkey").alias("pairs"), F.countDistinct("l_orderkey").alias("searched"), F.countDistinct("l_partkey").alias("pages"))


@registry.add("""SELECT p_partkey AS page, CASE WHEN l.page IS NULL THEN 'missing' WHEN p_brand <> 'Brand#13' THEN 'stale' ELSE 'hit' END AS state FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS page FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01') l ON l.page = p_partkey""")
def cache_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached result counts only under the current fingerprint."""
    cached = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= "1995-01-01").select(F.col("l_partkey").alias("page")).distinct().withColumn("there", F.lit(True))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), "p_brand").join(cached, "page", "left")
    return rows.select("page", F.when(F.col("there").isNull(), "missing").when(F.col("p_brand") != CURRENT, "stale").otherwise("hit").alias("state"))


@registry.add("""WITH k AS (SELECT l_partkey AS page FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 48 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)
SELECT p_partkey AS page, CASE WHEN p_partkey IN (SELECT page FROM k) THEN NULL ELSE p_brand END AS fingerprint FROM part""")
def invalidated_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by any of three sources lose their fingerprint."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    keys = items.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("page")).union(part.filter("p_size > 48").select("p_partkey")).union(items.filter("l_suppkey = 7").select("l_partkey")).distinct().withColumn("drop", F.lit(True))
    return part.select(F.col("p_partkey").alias("page"), "p_brand").join(keys, "page", "left").select("page", F.when(F.col("drop").isNull(), F.col("p_brand")).alias("fingerprint"))


QUERIES, ORACLE = registry.queries, registry.oracle
