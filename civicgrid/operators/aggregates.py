"""Counts, profiles, roll-ups and timelines of the directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import COMMUNITIES_SQL, EVENTS_SQL, MEMBERS_SQL, communities, events, members, table

registry = Registry()
C, M, E = f"WITH {COMMUNITIES_SQL}", f"WITH {MEMBERS_SQL}", f"WITH {EVENTS_SQL}"


def visible() -> Column:
    return ~F.col("hidden")

#: The reports' reference day, as the events end on 30 January 2024.
NOW = "2024-01-31 00:00:00"
HOME = ("FRANCE", "GERMANY", "RUSSIA")


@registry.add(f"{C} SELECT city, topic, count(*) AS n FROM communities WHERE NOT hidden GROUP BY city, topic")
def city_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible records by city and topic."""
    return communities(spark, sf_dir).filter(visible()).groupBy("city", "topic").agg(F.count("*").alias("n")).orderBy("city", "topic")


@registry.add(f"{C} SELECT city, chr(123) || string_agg(topic || '=' || n, ', ' ORDER BY topic) || chr(125) AS topics FROM (SELECT city, topic, count(*) AS n FROM communities WHERE NOT hidden GROUP BY ALL) GROUP BY city")
def city_topic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form: one row per city, topics and counts as text of a map."""
    counts = city_topic_counts(spark, sf_dir).groupBy("city").agg(F.array_sort(F.collect_list(F.struct("topic", "n"))).alias("t"))
    return counts.select("city", F.concat(F.lit("{"), F.array_join(F.transform("t", lambda x: F.concat(x["topic"], F.lit("="), x["n"].cast("string"))), ", "), F.lit("}")).alias("topics"))


@registry.add(f"{C} SELECT topic, count(*) AS n FROM communities WHERE NOT hidden GROUP BY topic")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(spark, sf_dir).filter(visible()).groupBy("topic").agg(F.count("*").alias("n"))


@registry.add(f"{C} SELECT topic, count(*) AS n FROM communities WHERE NOT hidden AND city IN ('src0', 'src1', 'src2') GROUP BY topic")
def topic_counts_for_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(spark, sf_dir).filter(visible() & F.col("city").isin("src0", "src1", "src2")).groupBy("topic").agg(F.count("*").alias("n"))


@registry.add(f"{C} SELECT city, count(*) AS n FROM communities WHERE NOT hidden GROUP BY city")
def city_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(spark, sf_dir).filter(visible()).groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city")


@registry.add(f"{C} SELECT count(*) AS n FROM communities WHERE NOT hidden")
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(spark, sf_dir).filter(visible()).agg(F.count("*").alias("n"))


@registry.add("SELECT n_name AS city, count(DISTINCT s_suppkey) AS venues, count(DISTINCT c_custkey) AS persons FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def venue_person_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues and persons by city: each side is summed before they meet, so that neither multiplies the other."""
    tagged = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("venues").alias("kind")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("persons").alias("kind")))
    counts = tagged.groupBy("k").pivot("kind", ["venues", "persons"]).count()
    return table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("k"), "left").select(F.col("n_name").alias("city"), F.coalesce("venues", F.lit(0)).alias("venues"), F.coalesce("persons", F.lit(0)).alias("persons"))


@registry.add("""WITH a AS (SELECT l_partkey AS page, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS page, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT coalesce(a.page, b.page) AS page, coalesce(a.n, 0) AS venues, coalesce(b.n, 0) AS persons FROM a FULL OUTER JOIN b ON a.page = b.page""")
def counts_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts by page merged in one shuffle: rows of either kind, counted side by side."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' OR l_linestatus = 'O'")
    return rows.groupBy(F.col("l_partkey").alias("page")).agg(F.count_if(F.col("l_returnflag") == "R").alias("venues"), F.count_if(F.col("l_linestatus") == "O").alias("persons"))


@registry.add(f"""{C} SELECT count(*) AS total, count(*) FILTER (NOT hidden) AS visible, count(*) FILTER (quality IS NULL) AS unmeasured, count(*) FILTER (quality = 0) AS poor,
count(*) FILTER (trim(description) = '') AS no_text, count(*) FILTER (length(description) < 200) AS short_text, count(*) FILTER (description LIKE '%@%') AS with_contact FROM communities""")
def backlog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven conditional counts in one pass."""
    text = F.col("description")
    return communities(spark, sf_dir, text=True).agg(
        F.count("*").alias("total"), F.count_if(visible()).alias("visible"), F.count_if(F.col("quality").isNull()).alias("unmeasured"), F.count_if(F.col("quality") == 0).alias("poor"),
        F.count_if(F.trim(text) == "").alias("no_text"), F.count_if(F.length(text) < 200).alias("short_text"), F.count_if(text.contains("@")).alias("with_contact"),
    )


@registry.add("WITH q AS (SELECT o_orderkey, list(l_partkey) AS urls FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT count(*) AS pairs, sum(len(list_filter(urls, lambda u: u IS NOT NULL)))::BIGINT AS queries FROM q")
def work_cost_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work totals: pairs and the summed lengths of their URL arrays."""
    urls = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.collect_list("l_partkey").alias("urls"))
    return urls.agg(F.count("*").alias("pairs"), F.sum(F.size("urls")).alias("queries"))


@registry.add("SELECT p_brand AS fingerprint, count(*) AS pages, sum(CASE WHEN p_size >= 25 THEN 1 ELSE 0 END)::BIGINT AS matched, count(*) FILTER (p_type LIKE 'STANDARD%') AS scoped FROM part GROUP BY p_brand")
def scope_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums by extraction fingerprint."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("fingerprint")).agg(F.count("*").alias("pages"), F.count_if(F.col("p_size") >= 25).alias("matched"), F.count_if(F.col("p_type").startswith("STANDARD")).alias("scoped"))


@registry.add(f"""{C} SELECT count(*) AS total, count(DISTINCT city) AS cities, count(DISTINCT topic) AS topics, count(*) FILTER (length(description) > 50) AS has_description, count(*) FILTER (quality = 1) AS good,
count(*) FILTER (contains(description, '@')) AS has_contact, count(*) FILTER (contains(description, 'http')) AS has_website, count(DISTINCT CASE WHEN quality = 1 THEN city END) AS good_cities, count(*) FILTER (contains(description, '@') OR length(description) > 50) AS has_any FROM communities WHERE NOT hidden""")
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine conditional and distinct aggregates of visible records."""
    text, good = F.col("description"), F.col("quality") == 1
    return communities(spark, sf_dir, text=True).filter(visible()).agg(
        F.count("*").alias("total"), F.countDistinct("city").alias("cities"), F.countDistinct("topic").alias("topics"), F.count_if(F.length(text) > 50).alias("has_description"), F.count_if(good).alias("good"),
        F.count_if(text.contains("@")).alias("has_contact"), F.count_if(text.contains("http")).alias("has_website"), F.countDistinct(F.when(good, F.col("city"))).alias("good_cities"), F.count_if(text.contains("@") | (F.length(text) > 50)).alias("has_any"),
    )


@registry.add(f"{C} SELECT city, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM communities WHERE NOT hidden GROUP BY city ORDER BY n DESC, city LIMIT 20")
def quality_by_city_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report: the limit is the feature."""
    return communities(spark, sf_dir).filter(visible()).groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).orderBy(F.desc("n"), "city").limit(20)


@registry.add(f"{C} SELECT topic AS model, quality, count(*) AS n FROM communities GROUP BY topic, quality ORDER BY n DESC, model, quality NULLS FIRST LIMIT 15")
def quality_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by model and quality, unknown quality as a group; the 15 largest."""
    return communities(spark, sf_dir).groupBy(F.col("topic").alias("model"), "quality").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model", F.asc_nulls_first("quality")).limit(15)


@registry.add("SELECT 'suggestions' AS kind, count(*) AS n FROM events WHERE event_type = 'signup' UNION ALL SELECT 'reports', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'requests', count(*) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'total', count(*) FROM events WHERE event_type IN ('signup', 'error', 'purchase')")
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox counts by kind and their total, by one roll-up."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "suggestions", "error", "reports", "purchase", "requests")])[F.col("event_type")]
    rows = events(spark, sf_dir).filter(F.col("event_type").isin("signup", "error", "purchase")).select(kind.alias("kind"))
    return rows.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


@registry.add(f"{E} SELECT user_id, count(*) AS clicks, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS recent FROM ev WHERE event_type = 'click' GROUP BY user_id ORDER BY clicks DESC, user_id LIMIT 15")
def outclick_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 most clicked, with the last week's share."""
    recent = F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return events(spark, sf_dir).filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks"), F.count_if(recent).alias("recent")).orderBy(F.desc("clicks"), "user_id").limit(15)


@registry.add(f"{E} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY event_type")
def outclick_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@registry.add(f"{E} SELECT strftime(ts, '%Y-%m-%d') AS day, 'site' || (k % 3) AS site, count(*) AS pageviews, count(DISTINCT user_id) AS visitors FROM ev WHERE event_type = 'view' GROUP BY ALL")
def traffic_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views and different visitors by day and site."""
    site = F.concat(F.lit("site"), (F.col("k") % 3).cast("string"))
    return events(spark, sf_dir).filter("event_type = 'view'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), site.alias("site")).agg(F.count("*").alias("pageviews"), F.countDistinct("user_id").alias("visitors"))


def timeline(spark: SparkSession, sf_dir: str, unit: str, first: str, last: str, step: str, label: str) -> DataFrame:
    """Events of each type and first-seen users on a spine of time buckets, empty ones included."""
    rows = events(spark, sf_dir).select(F.date_trunc(unit, "ts").alias("bucket"), "event_type")
    firsts = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("ts")).select(F.date_trunc(unit, "ts").alias("bucket"), F.lit("first_seen").alias("event_type"))
    kinds = ["click", "error", "purchase", "signup", "view", "first_seen"]
    counts = rows.unionByName(firsts).groupBy("bucket").pivot("event_type", kinds).count()
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr(step))).alias("bucket"))
    return spine.join(counts, "bucket", "left").select(F.date_format("bucket", label).alias("bucket"), *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def timeline_sql(unit: str, first: str, last: str, step: str, label: str) -> str:
    return f"""WITH spine AS (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', {step})) AS b), c AS (SELECT date_trunc('{unit}', ts) AS b, event_type FROM events UNION ALL SELECT date_trunc('{unit}', min(ts)), 'first_seen' FROM events GROUP BY user_id)
SELECT strftime(spine.b, '{label}') AS bucket, {', '.join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ('click', 'error', 'purchase', 'signup', 'view', 'first_seen'))} FROM spine LEFT JOIN c ON c.b = spine.b GROUP BY 1"""


@registry.add(timeline_sql("hour", "2024-01-30 00:00:00", "2024-01-30 23:00:00", "INTERVAL 1 HOUR", "%Y-%m-%d %H"))
def activity_timeline_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 hours."""
    return timeline(spark, sf_dir, "hour", "2024-01-30 00:00:00", "2024-01-30 23:00:00", "INTERVAL 1 HOUR", "yyyy-MM-dd HH")


@registry.add(timeline_sql("day", "2024-01-24 00:00:00", "2024-01-30 00:00:00", "INTERVAL 1 DAY", "%Y-%m-%d"))
def activity_timeline_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days."""
    return timeline(spark, sf_dir, "day", "2024-01-24 00:00:00", "2024-01-30 00:00:00", "INTERVAL 1 DAY", "yyyy-MM-dd")


@registry.add(timeline_sql("month", "2023-02-01 00:00:00", "2024-01-01 00:00:00", "INTERVAL 1 MONTH", "%Y-%m"))
def activity_timeline_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve months."""
    return timeline(spark, sf_dir, "month", "2023-02-01 00:00:00", "2024-01-01 00:00:00", "INTERVAL 1 MONTH", "yyyy-MM")


_HOME_SQL = ", ".join(f"'{c}'" for c in HOME)


@registry.add(f"""{M}, s AS (SELECT *, CASE WHEN city IN ({_HOME_SQL}) THEN 'home' ELSE 'intl' END AS scope FROM members)
SELECT metric, sum(n) FILTER (scope = 'home')::BIGINT AS home, sum(n) FILTER (scope = 'intl')::BIGINT AS intl, sum(n)::BIGINT AS total FROM (
SELECT 'records' AS metric, scope, count(*) AS n FROM s GROUP BY scope UNION ALL SELECT 'visible', scope, count(*) FILTER (NOT hidden) FROM s GROUP BY scope
UNION ALL SELECT 'cities', scope, count(DISTINCT city) FROM s GROUP BY scope UNION ALL SELECT 'pairs', scope, count(DISTINCT city || '/' || topic) FROM s GROUP BY scope) GROUP BY metric""")
def daily_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by scope (home cities, the rest, both), from one aggregation by scope."""
    scoped = members(spark, sf_dir).withColumn("scope", F.when(F.col("city").isin(*HOME), "home").otherwise("intl"))
    wide = scoped.groupBy("scope").agg(F.count("*").alias("records"), F.count_if(visible()).alias("visible"), F.countDistinct("city").alias("cities"), F.countDistinct("city", "topic").alias("pairs"))
    rows = wide.unpivot("scope", ["records", "visible", "cities", "pairs"], "metric", "n").groupBy("metric").pivot("scope", ["home", "intl"]).agg(F.sum("n"))
    return rows.withColumn("total", F.coalesce("home", F.lit(0)) + F.coalesce("intl", F.lit(0)))


@registry.add("SELECT conv_id AS run_id, count(*) AS steps, sum(length(text))::BIGINT AS work, count(*) FILTER (role = 'user') AS asked, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def run_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and the first entry over each run's nested log, an array of structs."""
    logs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("log"))
    total = F.aggregate("log", F.lit(0).cast("long"), lambda acc, x: acc + x["size"])
    return logs.select("run_id", F.size("log").cast("long").alias("steps"), total.alias("work"), F.size(F.filter("log", lambda x: x["role"] == "user")).cast("long").alias("asked"), F.get("log", F.lit(0))["role"].alias("first_role"))


@registry.add(f"""{E} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, count(*) AS calls, sum(k)::BIGINT AS tokens, strftime(max(ts) FILTER (k >= 80), '%Y-%m-%d %H:%M:%S') AS blocked_until, arg_max(user_id, event_id) FILTER (k >= 50) AS last_error, min(k) AS seen_limit FROM ev GROUP BY ALL""")
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily ledger: calls, tokens, latest block, last error that is known, lowest limit seen."""
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("provider")).agg(
        F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.date_format(F.max(F.when(F.col("k") >= 80, F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("blocked_until"),
        F.max_by(F.when(F.col("k") >= 50, F.col("user_id")), F.when(F.col("k") >= 50, F.col("event_id"))).alias("last_error"), F.min("k").alias("seen_limit"),
    )


_LIMITS = {"click": 120, "view": 200, "error": 40, "purchase": 30, "signup": 25}


@registry.add(f"""WITH lim(provider, rpd) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in _LIMITS.items())}), used AS (SELECT event_type, count(*) AS calls FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT provider, CAST(floor(rpd * 0.95) AS BIGINT) AS budget, coalesce(calls, 0) AS used, greatest(0, CAST(floor(rpd * 0.95) AS BIGINT) - coalesce(calls, 0)) AS remaining FROM lim LEFT JOIN used ON provider = event_type""")
def ledger_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget (95 % of the daily limit), used and remaining calls by provider; unused providers included."""
    limits = spark.createDataFrame(list(_LIMITS.items()), "provider string, rpd int")
    used = events(spark, sf_dir).filter(F.col("ts") >= "2024-01-30").groupBy("event_type").agg(F.count("*").alias("calls"))
    budget, spent = F.floor(F.col("rpd") * 0.95), F.coalesce("calls", F.lit(0))
    return limits.join(used, F.col("provider") == F.col("event_type"), "left").select("provider", budget.alias("budget"), spent.alias("used"), F.greatest(F.lit(0), budget - spent).alias("remaining"))


@registry.add(f"{E} SELECT max(value) FILTER (event_type <> 'error') AS best, max(value) FILTER (event_type <> 'error') - 10 AS threshold FROM ev")
def upgrade_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quality with budget left, and the quality below which an upgrade pays."""
    best = F.max(F.when(F.col("event_type") != "error", F.col("value")))
    return events(spark, sf_dir).agg(best.alias("best"), (best - 10).alias("threshold"))


@registry.add(f"""{E}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(DISTINCT user_id) AS pages, count(*) FILTER (event_type = 'error') AS refused FROM ev GROUP BY 1)
SELECT day, round(calls / nullif(pages, 0), 4) AS calls_per_page, CAST(floor(100.0 * refused / nullif(calls, 0)) AS BIGINT) AS refused_percent, greatest(0, calls - pages) AS over_collected FROM d""")
def report_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of the daily report with zero guards."""
    days = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("pages"), F.count_if(F.col("event_type") == "error").alias("refused"))
    return days.select("day", F.round(F.try_divide("calls", "pages"), 4).alias("calls_per_page"), F.floor(F.try_divide(F.lit(100.0) * F.col("refused"), "calls")).alias("refused_percent"), F.greatest(F.lit(0), F.col("calls") - F.col("pages")).alias("over_collected"))


@registry.add(f"{M}, c AS (SELECT city, topic, count(*) AS n FROM members WHERE NOT hidden GROUP BY ALL) SELECT city, count(*) FILTER (topic <> 'FURNITURE') AS topics, (sum(n) - coalesce(sum(n) FILTER (topic = 'FURNITURE'), 0))::BIGINT AS popular FROM c GROUP BY city")
def popularity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities by different topics and records, the catch-all topic left out."""
    counts = members(spark, sf_dir).filter(visible()).groupBy("city", "topic").agg(F.count("*").alias("n"))
    other = F.col("topic") == "FURNITURE"
    return counts.groupBy("city").agg(F.count_if(~other).alias("topics"), (F.sum("n") - F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0))).alias("popular")).orderBy(F.desc("topics"), F.desc("popular"), "city")


@registry.add(f"{M}, c AS (SELECT country, city, count(*) AS n FROM members WHERE NOT hidden GROUP BY ALL) SELECT country, count(*) AS cities, sum(n)::BIGINT AS n FROM c GROUP BY country")
def country_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).filter(visible()).groupBy("country").agg(F.countDistinct("city").alias("cities"), F.count("*").alias("n"))


@registry.add(f"{M} SELECT t.topic, count(m.id) AS n FROM (SELECT DISTINCT topic FROM members) t LEFT JOIN members m ON m.topic = t.topic AND m.city = 'PERU' AND m.score > 9000 GROUP BY t.topic")
def topic_counts_with_zeroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All topics of the dimension with a city's counts, zeroes included."""
    rows = members(spark, sf_dir)
    found = rows.filter((F.col("city") == "PERU") & (F.col("score") > 9000)).groupBy("topic").agg(F.count("*").alias("n"))
    return rows.select("topic").distinct().join(found, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"))


@registry.add(f"{M}, a AS (SELECT count(*) AS total, count(*) FILTER (NOT hidden) AS matched FROM members) SELECT preset, CAST(ceil((total - matched) * share) AS BIGINT) AS needed FROM a, (VALUES ('all', 1.0), ('half', 0.5), ('tenth', 0.1)) p(preset, share)")
def run_scope_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a run still needs, for each preset share."""
    needed = members(spark, sf_dir).agg((F.count("*") - F.count_if(visible())).alias("left"))
    presets = F.array(*[F.struct(F.lit(p).alias("preset"), F.lit(s).alias("share")) for p, s in (("all", 1.0), ("half", 0.5), ("tenth", 0.1))])
    return needed.select("left", F.explode(presets).alias("p")).select("p.preset", F.ceil(F.col("left") * F.col("p.share").cast("decimal(3,1)")).cast("long").alias("needed"))


@registry.add("SELECT o_custkey AS run, sum(greatest(0, n - hits))::BIGINT AS worked FROM (SELECT o_custkey, o_orderkey, count(*) AS n, 2 * count(*) FILTER (l_returnflag = 'R') AS hits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey")
def pages_worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found less cache hits, never below zero for a pair, by run."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (2 * F.count_if(F.col("l_returnflag") == "R")).alias("hits"))
    return table(spark, sf_dir, "orders").join(pairs, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("run")).agg(F.sum(F.greatest(F.lit(0), F.col("n") - F.col("hits"))).alias("worked"))


@registry.add("SELECT l_orderkey AS run, CASE WHEN bool_or(l_returnflag = 'R') THEN 'aborted' WHEN bool_or(l_returnflag = 'A') THEN 'failed' ELSE 'ok' END AS outcome FROM lineitem GROUP BY l_orderkey")
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aborted if any pair was, else failed if any was, else ok."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.when(F.bool_or(flag == "R"), "aborted").when(F.bool_or(flag == "A"), "failed").otherwise("ok").alias("outcome"))


@registry.add(f"{E} SELECT event_type AS provider, count(*) AS calls, round(sum(value) / nullif(count(*), 0), 4) AS average, round(count(*) / nullif(date_diff('minute', min(ts), max(ts)), 0), 6) AS per_minute FROM ev GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, average and rate by provider with zero guards."""
    minutes = F.floor(F.unix_timestamp(F.date_trunc("minute", F.max("ts"))) / 60) - F.floor(F.unix_timestamp(F.date_trunc("minute", F.min("ts"))) / 60)
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("calls"), F.round(F.try_divide(F.sum("value"), F.count("*")), 4).alias("average"), F.round(F.try_divide(F.count("*"), minutes), 6).alias("per_minute"))


@registry.add("SELECT max(o_orderkey) AS last_run, arg_max(o_orderstatus, o_orderkey) AS last_mode, max(o_orderkey) FILTER (o_orderstatus = 'F') AS last_success FROM orders")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last run, its mode, and the last that succeeded."""
    return table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last_run"), F.max_by("o_orderstatus", "o_orderkey").alias("last_mode"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("last_success"))


@registry.add(f"{M} SELECT DISTINCT city, topic FROM members WHERE score > 0")
def covered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).filter("score > 0").select("city", "topic").distinct()


@registry.add(f"{C} SELECT city, topic, id, count(*) OVER (PARTITION BY city, topic) AS n, max(length(trim(description))) OVER (PARTITION BY city, topic) < 500 AS thin FROM communities WHERE NOT hidden")
def sitemap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the whole sitemap, each with how many its pair has and whether all of them are thin."""
    rows = communities(spark, sf_dir, text=True).filter(visible()).select("id", "city", "topic", F.length(F.trim("description")).alias("size"))
    groups = rows.groupBy("city", "topic").agg(F.count("*").alias("n"), (F.max("size") < 500).alias("thin"))
    return rows.select("city", "topic", "id").join(groups, ["city", "topic"])


@registry.add(f"{M} SELECT coalesce(city, 'all') AS city, coalesce(topic, 'all') AS topic, count(*) AS n FROM members GROUP BY CUBE (city, topic)")
def count_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every combination of city and topic, totals included."""
    return members(spark, sf_dir).cube("city", "topic").agg(F.count("*").alias("n")).select(F.coalesce("city", F.lit("all")).alias("city"), F.coalesce("topic", F.lit("all")).alias("topic"), "n")


@registry.add(f"{E}, f AS (SELECT user_id, min(ts) AS ts FROM ev GROUP BY user_id) SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS new_users FROM f GROUP BY 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entities by the day of their first change."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("ts")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("new_users"))


@registry.add(f"{E}, o AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation FROM ev) SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, generation, count(*) FILTER (event_type = 'error') AS n FROM o GROUP BY ALL) GROUP BY user_id")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of failures by provider, reset by each success."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events(spark, sf_dir).withColumn("generation", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(order))
    return marked.groupBy("user_id", "generation").agg(F.count_if(F.col("event_type") == "error").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


QUERIES, ORACLE = registry.queries, registry.oracle
