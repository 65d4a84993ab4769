"""Serving, moderation and routing views: selection by precedence, validation, prompts, collation, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.operators.ranks import with_places
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import EVENTS_SQL, MEMBERS_SQL, VENUES_SQL, events, members, table, venues

registry = Registry()
M, E, V = f"WITH {MEMBERS_SQL}", f"WITH {EVENTS_SQL}", f"WITH {VENUES_SQL}"


#: How accented vowels are ordered, behind all words of the plain vowel.
AFTER = {"á": "a\x7f", "é": "e\x7f", "í": "i\x7f", "ó": "o}", "ö": "o~", "ő": "o\x7f", "ú": "u}", "ü": "u~", "ű": "u\x7f"}


def collation_key(name: Column) -> Column:
    """Hungarian order: an accented vowel comes after every word of the plain one."""
    key = F.lower(name)
    for letter, place in AFTER.items():
        key = F.replace(key, F.lit(letter), F.lit(place))
    return key


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


#: Vowels that take an accent in the listing's names, by the last digit of the id.
ACCENTS = {1: ("a", "á"), 2: ("o", "ö"), 3: ("o", "ő"), 4: ("u", "ü"), 5: ("e", "é"), 6: ("i", "í"), 7: ("u", "ű"), 8: ("o", "ó")}


def _accented_sql(name: str, number: str) -> str:
    cases = " ".join(f"WHEN {k} THEN replace({name}, '{a}', '{b}')" for k, (a, b) in ACCENTS.items())
    return f"CASE {number} % 10 {cases} ELSE {name} END"


def _key_sql(name: str) -> str:
    key = f"lower({name})"
    for letter, place in AFTER.items():
        key = f"replace({key}, '{letter}', '{place[0]}' || chr({ord(place[1])}))"
    return key


@registry.add(f"""WITH n AS (SELECT p_partkey AS id, p_brand AS city, {_accented_sql("p_name || ' ' || p_type", 'p_partkey')} AS name FROM part), k AS (SELECT *, {_key_sql('name')} AS k FROM n) SELECT id, city, name, row_number() OVER (ORDER BY city, k, id) AS place FROM k""")
def collated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with accents in their names in the listing's own order."""
    name = F.concat_ws(" ", "p_name", "p_type")
    for digit, (plain, accent) in ACCENTS.items():
        name = F.when(F.col("p_partkey") % 10 == digit, F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(plain), F.lit(accent))).otherwise(name)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("city"), name.alias("name"))
    return with_places(rows, [F.col("city"), collation_key(F.col("name")), F.col("id")]).select("id", "city", "name", "place")


@registry.add("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'i cannot|sorry|as an ai') THEN 'refused' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 60 OR length(text) >= 200 THEN 'ok' ELSE 'short' END AS state, left(split_part(text, '.', 1), 140) AS lead FROM conversations""")
def text_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts that are refusals or too short; the first sentence, 140 characters at most, as lead."""
    text = F.col("text")
    state = F.when(F.lower(text).rlike("i cannot|sorry|as an ai"), "refused").when((words(text) >= 60) | (F.length(text) >= 200), "ok").otherwise("short")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("state"), F.left(F.split_part(text, F.lit("."), F.lit(1)), F.lit(140)).alias("lead"))


@registry.add("""SELECT n_name AS city, string_agg(s_name, '; ' ORDER BY s_suppkey) AS section FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 0 OR s_suppkey <= 3 GROUP BY n_name""")
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each city the text of the rules that hold there."""
    rows = table(spark, sf_dir, "supplier").filter("s_acctbal < 0 OR s_suppkey <= 3").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("city")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda r: r["s_name"]), "; ").alias("section"))


_REQUESTS = ("auto", "Brand#13", "Brand#13:STANDARD TIN", "Brand#99", "STANDARD TIN")


@registry.add(f"""WITH q(asked) AS (VALUES {', '.join(f"('{r}')" for r in _REQUESTS)}), p AS (SELECT p_partkey AS id, p_brand AS provider, p_brand || ':' || p_type AS exact, p_size AS quality FROM part),
m AS (SELECT asked, id, CASE WHEN exact = asked THEN 1 WHEN provider = asked THEN 2 WHEN asked = 'auto' THEN 3 END AS tier, quality FROM q, p),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY tier, quality DESC, id) AS rn FROM m WHERE tier IS NOT NULL) SELECT q.asked, id AS model, tier FROM q LEFT JOIN r ON r.asked = q.asked AND rn = 1""")
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for each request: provider and model, else the provider's best, or the best of all for ``auto``."""
    best = F.max_by(F.col("p_partkey"), F.struct("p_size", -F.col("p_partkey"))).alias("model")
    part = table(spark, sf_dir, "part")
    exact = part.groupBy(F.concat_ws(":", "p_brand", "p_type").alias("asked")).agg(best).withColumn("tier", F.lit(1))
    provider = part.groupBy(F.col("p_brand").alias("asked")).agg(best).withColumn("tier", F.lit(2))
    auto = part.agg(best).select(F.lit("auto").alias("asked"), "model", F.lit(3).alias("tier"))
    asked = spark.createDataFrame([(r,) for r in _REQUESTS], "asked string")
    return asked.join(exact.unionByName(provider).unionByName(auto), "asked", "left")


@registry.add("SELECT n_name AS city, arg_min(r_name, n_nationkey) AS region FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_name")
def first_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region known for each name."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy(F.col("n_name").alias("city")).agg(F.min_by("r_name", "n_nationkey").alias("region"))


@registry.add(f"""{M}, k AS (SELECT id, city, lower(regexp_replace(topic, '[^A-Za-z]', '', 'g')) AS key FROM members), n AS (SELECT city, key, count(*) AS n, min(id) AS id FROM k GROUP BY ALL)
SELECT o_orderkey AS edit, CASE WHEN n.n = 1 THEN n.id END AS target FROM orders JOIN members m ON m.id = o_custkey LEFT JOIN n ON n.city = m.city AND n.key = lower(regexp_replace(m.topic, '[^A-Za-z]', '', 'g'))""")
def edit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit's record by loose match of name and city, only where that is one record."""
    loose = F.lower(F.regexp_replace("topic", "[^A-Za-z]", ""))
    rows = members(spark, sf_dir).select("id", "city", loose.alias("key"))
    unique = rows.groupBy("city", "key").agg(F.count("*").alias("n"), F.min("id").alias("target"))
    edits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit"), F.col("o_custkey").alias("id"))
    return edits.join(rows, "id").join(unique, ["city", "key"], "left").select("edit", F.when(F.col("n") == 1, F.col("target")).alias("target"))


@registry.add("""WITH b AS (SELECT p_brand AS provider, max(p_size) AS quality, count(*) AS models, bool_or(p_retailprice > 1900) AS paced FROM part GROUP BY 1)
SELECT 0 AS place, 'auto' AS model, max(quality) AS quality, false AS paced FROM b UNION ALL SELECT row_number() OVER (ORDER BY quality DESC, provider), provider, quality, paced FROM b""")
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``auto`` first, then all providers best first."""
    by_provider = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(F.max("p_size").alias("quality"), F.bool_or(F.col("p_retailprice") > 1900).alias("paced"))
    ranked = by_provider.withColumn("place", F.row_number().over(Window.orderBy(F.desc("quality"), "model")).cast("long"))
    auto = by_provider.agg(F.max("quality").alias("quality")).select(F.lit("auto").alias("model"), "quality", F.lit(False).alias("paced"), F.lit(0).cast("long").alias("place"))
    return auto.unionByName(ranked)


@registry.add("SELECT page_id, i AS place, CASE i WHEN 0 THEN 'home' ELSE parts[i] END AS crumb FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages), unnest(generate_series(0, len(parts))) g(i)")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps to each page, from the start page on."""
    parts = F.filter(F.split(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.concat(F.array(F.lit("home")), parts)).alias("place", "crumb"))
    return rows.withColumn("place", F.col("place").cast("long"))


@registry.add(f"{V}, n AS (SELECT id, t FROM venues, unnest(topics) u(t)), d AS (SELECT t, count(*) AS df FROM n GROUP BY t) SELECT n.id AS venue, count(*) AS topics, max(df) AS widest FROM n JOIN d ON d.t = n.t GROUP BY n.id")
def venue_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each venue's topics looked up in one join, not one query each."""
    listed = venues(spark, sf_dir).select(F.col("id").alias("venue"), F.explode("topics").alias("t"))
    return listed.join(listed.groupBy("t").agg(F.count("*").alias("df")), "t").groupBy("venue").agg(F.count("*").alias("topics"), F.max("df").alias("widest"))


@registry.add(f"""{E}, r AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS down, count(*) FILTER (event_type = 'signup') AS limited, sum(k) AS used FROM ev GROUP BY 1) SELECT user_id, CASE WHEN down > 2 THEN 'down' WHEN limited > 2 THEN 'rate limited' WHEN used > 600 THEN 'quota' END AS reason FROM r""")
def stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a run stopped: down before rate limited before quota, or null."""
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("down"), F.count_if(F.col("event_type") == "signup").alias("limited"), F.sum("k").alias("used"))
    return rows.select("user_id", F.when(F.col("down") > 2, "down").when(F.col("limited") > 2, "rate limited").when(F.col("used") > 600, "quota").alias("reason"))


@registry.add("""WITH s AS (SELECT l_orderkey AS page, max(l_quantity) AS old_quality, max(l_extendedprice) / 2000 AS new_quality FROM lineitem GROUP BY 1) SELECT page, new_quality > old_quality AS accepted, greatest(old_quality, new_quality) AS quality FROM s""")
def quality_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new extraction is taken only if it is strictly better."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.max("l_quantity").alias("old"), (F.max("l_extendedprice") / 2000).alias("new"))
    return rows.select("page", (F.col("new") > F.col("old")).alias("accepted"), F.greatest("old", "new").alias("quality"))


@registry.add("""WITH v AS (SELECT l_orderkey AS page, count(*) FILTER (l_returnflag = 'N') AS communities, count(*) FILTER (l_returnflag = 'R') AS venues FROM lineitem GROUP BY 1) SELECT count(*) AS pages, count(*) FILTER (communities > 0) AS asked, coalesce(sum(venues) FILTER (communities > 0), 0)::BIGINT AS venues FROM v""")
def cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues are only asked for where a page gave communities."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("v"))
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.col("c") > 0).alias("asked"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("v"))), F.lit(0)).alias("venues"))


@registry.add("""SELECT o_orderkey AS run, round(CAST(60.0 / nullif(o_custkey % 90, 0) AS DOUBLE), 4) AS pace, CASE WHEN hour(o_orderdate) < 6 THEN 'night' ELSE 'day' END AS part FROM orders""")
def pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between calls at a provider's rate, null without one, and the part of the day."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.round(F.try_divide(F.lit(60.0), F.col("o_custkey") % 90), 4).alias("pace"), F.when(F.hour("o_orderdate") < 6, "night").otherwise("day").alias("part"))


QUERIES, ORACLE = registry.queries, registry.oracle
