"""Rules for requests, searches and addresses: page views that count, safe URLs, searches with their fall-backs, import names, site and language."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from civicgrid.functions import text as T
from civicgrid.operators.directory import PEOPLE_SQL, RECORDS_SQL, people, records
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table

registry = Registry()
R, P = f"WITH {RECORDS_SQL}", f"WITH {PEOPLE_SQL}"

#: What names a client that is no reader, and paths that are no pages.
BOTS = ("bot", "spider", "crawl", "curl", "wget", "python-", "headless", "facebookexternalhit", "preview", "monitor", "lighthouse")
UNTRACKED = ("/admin", "/static", "/api", "/healthz", "/robots", "/sitemap", "/set-lang", "/unsubscribe", "/source")


def counted(method: Column, status: Column, path: Column, content_type: Column, agent: Column) -> Column:
    """Whether a request is a page view: a reader got a page."""
    known = F.lower(F.coalesce(agent, F.lit("")))
    utility = F.exists(F.array(*map(F.lit, UNTRACKED)), lambda p: path.startswith(p))
    robot = F.exists(F.array(*map(F.lit, BOTS)), lambda b: known.contains(b))
    return F.coalesce((method == "GET") & (status < 400) & ~utility & F.coalesce(content_type, F.lit("")).contains("text/html") & (known != "") & ~robot, F.lit(False))


def visitor(day: Column, address: Column, agent: Column) -> Column:
    """A day's hash of a reader: 16 hex digits."""
    return F.substring(F.sha2(F.concat_ws("|", day, F.coalesce(address, F.lit("")), F.lower(agent)), 256), 1, 16)


AGENTS = ("Mozilla/5.0", "GoogleBot/2.1", "curl/8", "", "Safari HeadlessChrome", "Opera")
PATHS = ("/en/city", "/admin/x", "/source/1", "/", "/robots.txt", "/people")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: agent, path, status and type by their numbers."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", pick(("GET", "GET", "GET", "POST"), F.col("event_id")).alias("method"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), pick(PATHS, k).alias("path"),
        F.when(F.col("event_type") != "purchase", "text/html; charset=utf-8").otherwise("application/json").alias("content_type"), pick(AGENTS, F.col("user_id")).alias("agent"), F.concat(F.lit("10.0.0."), F.col("user_id") % 9).alias("address"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LOG_SQL = f"""req AS (SELECT event_id, ts, ['GET', 'GET', 'GET', 'POST'][event_id % 4 + 1] AS method, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, {_list(PATHS)}[CAST(json_extract(props, '$.k') AS BIGINT) % 6 + 1] AS path,
  CASE WHEN event_type <> 'purchase' THEN 'text/html; charset=utf-8' ELSE 'application/json' END AS content_type, {_list(AGENTS)}[user_id % 6 + 1] AS agent, '10.0.0.' || (user_id % 9) AS address FROM events),
page AS (SELECT *, method = 'GET' AND status < 400 AND len(list_filter({_list(UNTRACKED)}, lambda p: starts_with(path, p))) = 0 AND contains(content_type, 'text/html') AND agent <> '' AND len(list_filter({_list(BOTS)}, lambda b: contains(lower(agent), b))) = 0 AS counted FROM req)"""


@registry.add(f"WITH {_LOG_SQL} SELECT event_id, counted FROM page")
def counted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that count as page views."""
    return request_log(spark, sf_dir).select("event_id", counted(F.col("method"), F.col("status"), F.col("path"), F.col("content_type"), F.col("agent")).alias("counted"))


@registry.add(f"WITH {_LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, path, count(*) AS views, count(DISTINCT left(sha256(strftime(ts, '%Y-%m-%d') || '|' || address || '|' || lower(agent)), 16)) AS visitors FROM page WHERE counted GROUP BY 1, 2")
def pageview_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and different readers of each page and day."""
    rows = request_log(spark, sf_dir).filter(counted(F.col("method"), F.col("status"), F.col("path"), F.col("content_type"), F.col("agent"))).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.groupBy("day", "path").agg(F.count("*").alias("views"), F.countDistinct(visitor(F.col("day"), F.col("address"), F.col("agent"))).alias("visitors"))


# addresses --------------------------------------------------------------------


@F.pandas_udf(BooleanType())
def global_address(hosts: pd.Series) -> pd.Series:
    """Whether an IP literal is a public one."""

    def public(host: str) -> bool:
        try:
            return ipaddress.ip_address(host.strip("[]")).is_global
        except ValueError:
            return False

    return hosts.map(public, na_action="ignore")


#: Endings of names that no public host has.
LOCAL = (".localhost", ".local", ".internal")


def public_url(url: Column) -> Column:
    """Whether a URL may be fetched: length, no white space, http(s), a host that is public, no user, a port within its range. No name is looked up."""
    parts = r"^(https?)://([^/?#]*)"
    scheme, net = F.regexp_extract(url, parts, 1), F.regexp_extract(url, parts, 2)
    host = F.lower(F.regexp_replace(F.regexp_extract(net, r"^(\[[^\]]*\]|[^:\[]*)", 1), r"\.$", ""))
    port = F.regexp_extract(net, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    literal = host.rlike(r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$")
    named = host.contains(".") & (host != "localhost") & ~F.exists(F.array(*map(F.lit, LOCAL)), lambda e: host.endswith(e))
    in_range = (port == "") | (port.rlike("^[0-9]{1,5}$") & port.try_cast("int").between(1, 65535))
    ok = (F.length(url).between(1, 2048)) & ~url.rlike(r"[\s\x00-\x1f]") & (scheme != "") & (host != "") & ~net.contains("@") & in_range
    return F.coalesce(ok & F.when(literal, global_address(F.when(literal, host))).otherwise(named), F.lit(False))


_HOSTS = ("a.example", "localhost", "10.0.0.8", "8.8.8.8", "u:p@b.example", "c.example:80", "d.example:99999", "e", "f.local", "[::1]", "[2001:4860:4860::8888]", "G.Example.", "h.example:x")
_SAFE = ("a.example", "8.8.8.8", "c.example:80", "[2001:4860:4860::8888]", "G.Example.")


@registry.add(f"SELECT p_partkey AS id, host IN ({', '.join(repr(h) for h in _SAFE)}) AND p_partkey % 17 NOT IN (3, 5) AS safe FROM (SELECT p_partkey, {_list(_HOSTS)}[p_partkey % 13 + 1] AS host FROM part)")
def public_urls_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many odd URLs may be fetched."""
    host = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("p_partkey") % 13 + 1).cast("int"))
    url = F.concat(F.when(F.col("p_partkey") % 17 == 3, "ftp").otherwise("https"), F.lit("://"), host, F.when(F.col("p_partkey") % 17 == 5, "/a b").otherwise("/x"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), public_url(url).alias("safe"))


# searches ---------------------------------------------------------------------


def holds(column: Column, query: str) -> Column:
    """A text holds the query, whatever its case and what wildcards it has."""
    return F.contains(F.lower(column), F.lit(query.lower()))


def search_all(tables: dict[str, DataFrame], query: str, limit: int = 20) -> DataFrame:
    """entity, city, id and name of the first ``limit`` rows of each table (id, city, name, perhaps description) whose name or description holds ``query``, by city and id; nothing for a blank query."""
    found = None
    for entity, rows in tables.items():
        hit = holds(F.col("name"), query)
        if "description" in rows.columns:
            hit = hit | F.coalesce(holds(F.col("description"), query), F.lit(False))
        some = rows.filter(hit if query.strip() else F.lit(False)).orderBy("city", "id").limit(limit).select(F.lit(entity).alias("entity"), "city", "id", "name")
        found = some if found is None else found.unionByName(some)
    return found


_first = lambda e, t, w: f"SELECT * FROM (SELECT '{e}' AS entity, city, id, name FROM {t} WHERE {w} ORDER BY city, id LIMIT 20)"


@registry.add(f"{R}, {PEOPLE_SQL} {_first('communities', 'records', '''NOT hidden AND (contains(lower(name), 'widget') OR contains(lower(coalesce(description, '')), 'widget'))''')} UNION ALL {_first('venues', 'records', '''contains(lower(name), 'widget') OR contains(lower(coalesce(description, '')), 'widget')''')} UNION ALL {_first('persons', 'people', '''contains(lower(name), 'widget')''')}")
def search_names_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over three kinds of records by name or description."""
    rows = records(spark, sf_dir)
    return search_all({"communities": rows.filter(~F.col("hidden")), "venues": rows, "persons": people(spark, sf_dir).drop("description")}, "Widget")


@registry.add(f"{R} SELECT id, name FROM records WHERE contains(lower(name), 'ring') ORDER BY name, id LIMIT 20")
def admin_search(spark: SparkSession, sf_dir: str, query: str = "RING", limit: int = 20) -> DataFrame:
    """The first 20 names that hold a query of two characters or more: the limit is the list's."""
    rows = records(spark, sf_dir).select("id", "name")
    return rows.filter(holds(F.col("name"), query) if len(query) >= 2 else F.lit(False)).orderBy("name", "id").limit(limit)


#: Parts that the communities of one name in a city are dealt into.
SPREAD = 64


def of_venues(venues: DataFrame, communities: DataFrame) -> DataFrame:
    """venue, community: those that a venue (id, name, city, community_ids) lists and that are visible, else those of its city whose location holds its name.

    A location is searched once for each different name of its city's venues. What is found is
    dealt out before it meets the venues, so that no task gets all pairs of a city.
    """
    visible = communities.filter(~F.col("hidden"))
    listed = venues.select(F.col("id").alias("venue"), F.explode("community_ids").alias("community")).distinct().join(visible.select(F.col("id").alias("community")), "community").select("venue", "community")
    rest = venues.join(listed.select(F.col("venue").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("venue"), "city", F.lower("name").alias("_name"))
    names = rest.select("city", "_name").distinct()
    told = visible.select(F.col("id").alias("community"), "city", F.lower("location").alias("_where")).join(names, "city").filter(F.contains("_where", F.col("_name")))
    dealt = told.withColumn("_part", F.pmod(F.xxhash64("community"), F.lit(SPREAD)).cast("int")).drop("_where")
    near = dealt.join(rest.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).hint("merge"), ["city", "_name", "_part"])
    return listed.unionByName(near.select("venue", "community"))


@registry.add(f"""{R}, v AS (SELECT s_suppkey AS id, ['ring', 'small', 'widget', 'gear', 'none'][s_suppkey % 5 + 1] AS name, 'Brand#' || (s_suppkey % 25 + 1) AS city, CASE WHEN s_suppkey % 3 = 0 THEN [s_suppkey, s_suppkey + 1] ELSE [3, 13] END AS ids FROM supplier), ok AS (SELECT * FROM records WHERE NOT hidden),
l AS (SELECT DISTINCT v.id AS venue, ok.id AS community FROM v, unnest(ids) u(c) JOIN ok ON ok.id = c)
SELECT * FROM l UNION ALL SELECT v.id, ok.id FROM v JOIN ok ON ok.city = v.city AND contains(lower(ok.location), v.name) WHERE v.id NOT IN (SELECT venue FROM l)""")
def venue_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities of each venue, by its list or by what they say of their place."""
    name = F.element_at(F.array(*map(F.lit, ("ring", "small", "widget", "gear", "none"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    ids = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.col("s_suppkey"), F.col("s_suppkey") + 1)).otherwise(F.array(F.lit(3).cast("long"), F.lit(13).cast("long")))
    venues = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("city"), ids.alias("community_ids"))
    return of_venues(venues, records(spark, sf_dir))


@registry.add(f"""{P}, g AS (SELECT DISTINCT community_name AS name FROM people) SELECT p.id, g.name AS community FROM people p JOIN g ON regexp_replace(lower(g.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(p.community_name), '[^a-z0-9]', '', 'g')""")
def community_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of each community, its name being matched by letters and digits alone."""
    rows = people(spark, sf_dir)
    groups = rows.select(F.col("community_name").alias("community")).distinct().select("community", T.match_key(F.concat(F.lit(" "), F.upper("community"), F.lit("!"))).alias("k"))
    return rows.select("id", T.match_key("community_name").alias("k")).join(groups, "k").select("id", "community")


# names and languages ----------------------------------------------------------


def import_names(names: Column, drop: str = "(?i)^(unnamed|test)|district$", trim: str = "(?i)^(city of|municipality of|greater) ") -> Column:
    """A city's name as it is imported: without what stands before it, null where it is no city."""
    return F.when(~names.rlike(drop), F.trim(F.regexp_replace(names, trim, "")))


@registry.add("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM part")
def imported_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under the rules for imports."""
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" District"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("City of "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), import_names(raw).alias("name"))


def site_of(host: Column, sites: dict[str, str], default: str) -> Column:
    """The site that a host belongs to, without its port."""
    name = F.lower(F.split_part(host, F.lit(":"), F.lit(1)))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sites.items() for x in pair]), name), F.lit(default))


def language_of(cookie: Column, accepted: Column, known: tuple[str, ...], default: str) -> Column:
    """The chosen language if it is known, else the first accepted one that is, else the default."""
    wanted = F.transform(F.split(F.lower(F.coalesce(accepted, F.lit(""))), ","), lambda x: F.left(F.trim(F.split_part(x, F.lit(";"), F.lit(1))), F.lit(2)))
    first = F.get(F.filter(wanted, lambda x: x.isin(*known)), F.lit(0))
    return F.coalesce(F.when(cookie.isin(*known), cookie), first, F.lit(default))


@registry.add("""SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'hu' WHEN 1 THEN 'intl' ELSE 'main' END AS site, CASE WHEN event_id % 4 = 0 THEN 'de' WHEN event_id % 4 = 1 THEN 'en' WHEN event_id % 4 = 2 THEN 'hu' ELSE 'en' END AS language FROM events""")
def request_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site and language of each request."""
    host = F.element_at(F.array(*map(F.lit, ("A.hu:443", "b.example", "c.example:80"))), (F.col("user_id") % 3 + 1).cast("int"))
    kind = F.col("event_id") % 4
    cookie, accepted = F.when(kind == 0, "de").when(kind == 1, "xx"), F.when(kind == 1, "fr-FR, EN;q=0.8, de").when(kind == 2, "hu-HU,hu")
    return table(spark, sf_dir, "events").select("event_id", site_of(host, {"a.hu": "hu", "b.example": "intl"}, "main").alias("site"), language_of(cookie, accepted, ("hu", "en", "de"), "en").alias("language"))


def topic_label(topic: Column, labels: dict[str, str]) -> Column:
    """A topic's label, else its name in words."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, topic), F.initcap(F.replace(topic, F.lit("_"), F.lit(" "))))


@registry.add("""WITH t AS (SELECT DISTINCT lower(p_type) || '_' || p_size % 3 AS topic FROM part), l AS (SELECT topic, CASE WHEN topic = 'economy_0' THEN 'Cheap' ELSE upper(left(topic, 1)) || substr(replace(topic, '_', ' '), 2) END AS label FROM t) SELECT topic, label, replace(topic, '_', '-') AS slug, topic AS back FROM l""")
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their labels and slugs, and the topic that a slug leads back to."""
    topics = table(spark, sf_dir, "part").select(F.concat_ws("_", F.lower("p_type"), (F.col("p_size") % 3).cast("string")).alias("topic")).distinct()
    rows = topics.select("topic", topic_label(F.col("topic"), {"economy_0": "Cheap"}).alias("label"), F.replace("topic", F.lit("_"), F.lit("-")).alias("slug"))
    back = topics.select(F.replace("topic", F.lit("_"), F.lit("-")).alias("slug"), F.col("topic").alias("back"))
    return rows.join(back, "slug").select("topic", "label", "slug", "back")


def search_variants(name: Column) -> Column:
    """A name and its forms without accents and without blanks or hyphens, each once."""
    plain = T.folded(name)
    return F.array_distinct(F.array(F.lower(name), plain, F.regexp_replace(plain, "[ -]", "")))


@registry.add("SELECT p_partkey AS id, array_to_string(list_distinct_ordered, '|') AS variants FROM (SELECT p_partkey, [lower(replace(p_name, 'a', 'á')), lower(p_name), replace(lower(p_name), ' ', '')] AS v, list_filter(v, lambda x, i: list_position(v, x) = i) AS list_distinct_ordered FROM part)")
def city_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under which spellings each name is found."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(search_variants(F.replace("p_name", F.lit("a"), F.lit("á"))), "|").alias("variants"))


#: Letters that listings fold besides accents.
FOLDED = {"ß": "ss", "đ": "d", "ø": "o", "æ": "ae", "ł": "l"}


def list_form(name: Column) -> Column:
    """A name as listings compare it."""
    out = T.folded(name)
    for letter, plain in FOLDED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


@registry.add("SELECT p_partkey AS id, replace(replace(replace(replace(lower(p_name), 'a', 'a'), 'e', 'ss'), 'i', 'o'), 'r', 'l') AS form FROM part")
def listing_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with accents and special letters as listings compare them."""
    odd = F.col("p_name")
    for plain, letter in (("e", "ß"), ("i", "Ø"), ("r", "ł"), ("a", "Á")):
        odd = F.replace(odd, F.lit(plain), F.lit(letter))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), list_form(odd).alias("form"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its ``{name}`` fields filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


@registry.add("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand || ': ' || p_name WHEN 1 THEN 'In ' || p_brand ELSE 'missing_2' END AS line FROM part")
def template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line in each row's language, else in the default one, else the key itself."""
    texts = spark.createDataFrame([("hu", "key_0", "{city}: {name}"), ("en", "key_1", "In {city}")], "lang string, key string, text string")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", F.concat(F.lit("key_"), (F.col("p_partkey") % 3).cast("string")).alias("key"))
    own = texts.filter("lang = 'hu'").select("key", F.col("text").alias("own"))
    other = texts.filter("lang = 'en'").select("key", F.col("text").alias("other"))
    text = F.coalesce("own", "other", F.replace("key", F.lit("key_"), F.lit("missing_")))
    return rows.join(own, "key", "left").join(other, "key", "left").select(F.col("p_partkey").alias("id"), filled(text, {"city": F.col("p_brand"), "name": F.col("p_name")}).alias("line"))


QUERIES, ORACLE = registry.queries, registry.oracle
