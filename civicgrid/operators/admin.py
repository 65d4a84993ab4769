"""Rules of the administration: listings with optional filters, prompts, model choice, budgets, windows, forms, configuration, the daily summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.operators.directory import RECORDS_SQL, records
from civicgrid.operators.lifecycle import PG, cached_pages
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table

registry = Registry()
R = f"WITH {RECORDS_SQL}"

NONE = "__none__"
PAGE_SIZE = 100


def tri_state(there: Column, asked: str | None) -> Column:
    """``1`` asks for rows that have it, ``0`` for those that don't, nothing for all."""
    return there if asked == "1" else ~there if asked == "0" else F.lit(True)


def chosen(column: Column, asked: str | None) -> Column:
    """Equality with what is asked; ``__none__`` asks for rows without a value."""
    if not asked:
        return F.lit(True)
    return F.coalesce(column, F.lit("")) == ("" if asked == NONE else asked)


def page_of(rows: DataFrame, order: list[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """The rows of one page, its number clamped to the pages that there are: the limit is a page's."""
    last = max(1, -(-rows.count() // size))
    number = min(max(number, 1), last)
    first = rows.orderBy(*order).limit(number * size)  # so many rows at most are ranked
    return first.withColumn("_n", F.row_number().over(Window.orderBy(*order))).filter(F.col("_n") > (number - 1) * size).drop("_n")


def cache_listing(pages: DataFrame, counts: DataFrame, asked: dict[str, str]) -> DataFrame:
    """``pages`` (url, city, topic, scraped_at, extract_model, enrich_model) with the venues and people found on each (``counts``: url, venues, persons), under eight optional filters."""
    zero = F.lit(0).cast("long")
    rows = pages.join(counts, "url", "left").withColumns({c: F.coalesce(c, zero) for c in ("venues", "persons")})
    get = asked.get
    wanted = chosen(F.col("city"), get("city")) & chosen(F.col("topic"), get("topic")) & tri_state(F.col("scraped_at").isNotNull(), get("scraped")) & chosen(F.col("extract_model"), get("model"))
    wanted = wanted & tri_state(F.col("enrich_model").isNotNull(), get("enriched")) & chosen(F.col("enrich_model"), get("enrich_model")) & tri_state(F.col("venues") > 0, get("venue")) & tri_state(F.col("persons") > 0, get("person"))
    return rows.filter(wanted)


@registry.add(f"""{PG}, c AS (SELECT 'http://src.example/' || l_partkey AS url, count(*) FILTER (l_returnflag = 'A') AS venues, count(*) FILTER (l_returnflag = 'R') AS persons FROM lineitem GROUP BY 1)
SELECT p.url, p.city, coalesce(venues, 0) AS venues, coalesce(persons, 0) AS persons FROM pages_of p LEFT JOIN c ON c.url = p.url WHERE scraped_at IS NOT NULL AND extract_model IS NULL AND coalesce(persons, 0) > 0 ORDER BY p.url LIMIT 100""")
def cache_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of scraped pages without a model on which people were found."""
    pages = cached_pages(spark, sf_dir).select("url", "city", "topic", "data.scraped_at", "data.extract_model", "data.enrich_model")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("http://src.example/"), F.col("l_partkey")).alias("url")).agg(F.count_if(F.col("l_returnflag") == "A").alias("venues"), F.count_if(F.col("l_returnflag") == "R").alias("persons"))
    rows = cache_listing(pages, counts, {"scraped": "1", "model": NONE, "person": "1", "venue": ""})
    return page_of(rows.select("url", "city", "venues", "persons"), ["url"], 0)


def sections(venues: DataFrame) -> DataFrame:
    """Each city's venues (city, name, id) with the city's place among the sections: largest first, then by name."""
    sizes = venues.groupBy("city").agg(F.count("*").alias("n"))
    placed = sizes.withColumn("section", F.row_number().over(Window.orderBy(F.desc("n"), "city")))  # a row for each city
    return venues.join(placed, "city")


@registry.add(f"""{R}, s AS (SELECT city, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, city) AS section FROM records WHERE NOT hidden GROUP BY city) SELECT section, r.city, r.id, n FROM records r JOIN s ON s.city = r.city WHERE NOT hidden""")
def venue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The venue listing in its sections."""
    out = sections(records(spark, sf_dir).filter(~F.col("hidden")).select("city", "name", "id"))
    return out.select(F.col("section").cast("long").alias("section"), "city", "id", "n")


@registry.add(f"""{R}, f AS (SELECT city, topic, min(CAST(strptime('2026-01-01', '%Y-%m-%d') AS TIMESTAMP) + INTERVAL 1 HOUR * CAST(id % 700 AS INTEGER)) AS first_seen, arg_min(name, id) FILTER (NOT hidden) AS name, min(id) FILTER (NOT hidden) AS id FROM records GROUP BY ALL)
SELECT city, topic, name, id FROM f WHERE id IS NOT NULL ORDER BY first_seen DESC, id LIMIT 20""")
def newest_records(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """The entities first seen last, each by its first visible row: the limit is the list's."""
    rows = records(spark, sf_dir).withColumn("seen", F.timestamp_add("HOUR", F.col("id") % 700, F.lit("2026-01-01 00:00:00").cast("timestamp")))
    shown = F.when(~F.col("hidden"), F.col("id"))
    first = rows.groupBy("city", "topic").agg(F.min("seen").alias("seen"), F.min_by("name", shown).alias("name"), F.min(shown).alias("id"))
    return first.filter("id IS NOT NULL").orderBy(F.desc("seen"), "id").limit(limit).select("city", "topic", "name", "id")


# prompts and models -----------------------------------------------------------


def prompt_section(examples: DataFrame, kind: str, city: str = "", topic: str = "") -> DataFrame:
    """The section text that false positives (id, name, reason, city, topic, kind) give a prompt: examples of ``kind`` for the pair, and for extraction the rules that hold everywhere. One row, null without any."""
    fits = (F.col("kind") == kind) & (F.col("city") == city if city else F.lit(True)) & (F.col("topic") == topic if topic else F.lit(True))
    rule = (F.col("kind") == "extraction_rule") if kind == "extraction" else F.lit(False)
    lines = lambda when, text: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("id", text.alias("t"))))), lambda r: r["t"])
    sums = examples.filter(fits | rule).agg(lines(fits, F.concat(F.lit('- "'), "name", F.lit('": '), "reason")).alias("examples"), lines(rule, F.col("reason")).alias("rules"))
    head = F.when(F.size("examples") > 0, F.concat(F.lit("Not to be taken:\n"), F.array_join("examples", "\n")))
    tail = F.when(F.size("rules") > 0, F.concat(F.lit("Rules:\n"), F.array_join("rules", "\n")))
    return sums.select(F.nullif(F.concat_ws("\n\n", head, tail), F.lit("")).alias("section"))


@registry.add(f"""{R}, e AS (SELECT id, name, CASE WHEN id % 50 = 0 THEN 'rule ' || id ELSE 'why ' || id END AS reason, city, topic, CASE WHEN id % 50 = 0 THEN 'extraction_rule' ELSE 'extraction' END AS kind FROM records WHERE hidden)
SELECT concat_ws(chr(10) || chr(10), 'Not to be taken:' || chr(10) || (SELECT string_agg('- "' || name || '": ' || reason, chr(10) ORDER BY id) FROM e WHERE kind = 'extraction' AND city = 'Brand#7'), 'Rules:' || chr(10) || (SELECT string_agg(reason, chr(10) ORDER BY id) FROM e WHERE kind = 'extraction_rule')) AS section""")
def pair_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One city's section of the extraction prompt."""
    k = F.col("id") % 50 == 0
    rows = records(spark, sf_dir).filter("hidden").select("id", "name", "city", "topic", F.concat(F.when(k, "rule ").otherwise("why "), "id").alias("reason"), F.when(k, "extraction_rule").otherwise("extraction").alias("kind"))
    return prompt_section(rows, "extraction", "Brand#7")


def prompt_fingerprint(override: Column, default: Column, model: Column) -> Column:
    """12 hex digits of the prompt in force, an empty override falling back to the default, and its model."""
    prompt = F.when(override != "", override).otherwise(default)
    return F.substring(F.sha2(F.concat(prompt, model), 256), 1, 12)


@registry.add(f"{R} SELECT id, left(sha256(CASE WHEN coalesce(location, '') <> '' THEN location ELSE topic END || city), 12) AS fingerprint FROM records")
def prompt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of prompts with and without an override."""
    return records(spark, sf_dir).select("id", prompt_fingerprint(F.col("location"), F.col("topic"), F.col("city")).alias("fingerprint"))


AUTO = ("auto", "", "default", "router")


def select_models(requests: DataFrame, fleet: DataFrame) -> DataFrame:
    """asked and the model that answers each request (``asked``): any model by its own name, a provider's best, provider:model, or the best of all; null where none is meant. ``fleet``: place (best first), provider, model."""
    best = lambda keys: fleet.groupBy(*keys).agg(F.min_by(F.struct("provider", "model"), "place").alias("m"))
    tiers = [best([F.col("model").alias("want")]), best([F.col("provider").alias("want")]), best([F.concat_ws(":", "provider", "model").alias("want")])]
    asked = requests.select("asked", F.trim("asked").alias("want"))
    for k, tier in enumerate(tiers):
        asked = asked.join(tier.withColumnRenamed("m", f"m{k}"), "want", "left")
    auto = fleet.agg(F.min_by(F.struct("provider", "model"), "place").alias("auto"))
    out = asked.crossJoin(F.broadcast(auto))  # one row
    m = F.when(F.lower("want").isin(*AUTO), F.col("auto")).otherwise(F.coalesce("m0", "m1", "m2"))
    return out.select("asked", m["provider"].alias("provider"), m["model"].alias("model"))


_ASKED = ("auto", " Router ", "m3:free", "Brand#13", "Brand#13:m5", "Brand#99", "Brand#1:m1", "Brand#7:m3:free")
_FLEET = "f AS (SELECT p_brand AS provider, 'm' || p_size || CASE WHEN p_size = 3 THEN ':free' ELSE '' END AS model, min(p_partkey) AS place FROM part GROUP BY ALL)"


@registry.add(f"""WITH {_FLEET}, q(asked) AS (VALUES {', '.join(f"('{a}')" for a in _ASKED)}), w AS (SELECT asked, trim(asked) AS want FROM q)
SELECT asked, CASE WHEN lower(want) IN ('auto', '', 'default', 'router') THEN (SELECT arg_min(provider, place) FROM f) WHEN want IN (SELECT model FROM f) THEN (SELECT arg_min(provider, place) FROM f WHERE model = want) WHEN want IN (SELECT provider FROM f) THEN want ELSE (SELECT arg_min(provider, place) FROM f WHERE provider || ':' || model = want) END AS provider,
  CASE WHEN lower(want) IN ('auto', '', 'default', 'router') THEN (SELECT arg_min(model, place) FROM f) WHEN want IN (SELECT model FROM f) THEN want ELSE (SELECT arg_min(model, place) FROM f WHERE provider = want OR provider || ':' || model = want) END AS model FROM w""")
def request_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for each request."""
    name = F.concat(F.lit("m"), "p_size", F.when(F.col("p_size") == 3, ":free").otherwise(""))
    fleet = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("provider"), name.alias("model")).agg(F.min("p_partkey").alias("place"))
    return select_models(spark.createDataFrame([(a,) for a in _ASKED], "asked string"), fleet)


def usable(providers: DataFrame, paid_allowed: bool) -> DataFrame:
    """A row for each model of the providers (provider, enabled, key, paid, models) that are enabled, have a key and models, and cost nothing unless that is allowed."""
    ok = F.col("enabled") & (F.coalesce("key", F.lit("")) != "") & (F.size("models") > 0) & (F.lit(paid_allowed) | ~F.col("paid"))
    return providers.filter(ok).select("provider", "paid", F.posexplode("models").alias("place", "model"))


@registry.add("""WITH p AS (SELECT s_suppkey AS provider, s_acctbal > 0 AS enabled, CASE WHEN s_suppkey % 4 > 0 THEN 'k' ELSE '' END AS key, s_suppkey % 3 = 0 AS paid, [s_name || ' a', s_name || ' b'][1:s_suppkey % 3] AS models FROM supplier) SELECT provider, unnest(models) AS model FROM p WHERE enabled AND key <> '' AND NOT paid AND len(models) > 0""")
def usable_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that a run may use."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("provider"), (F.col("s_acctbal") > 0).alias("enabled"), F.when(k % 4 > 0, "k").otherwise("").alias("key"), (k % 3 == 0).alias("paid"), F.slice(F.array(F.concat("s_name", F.lit(" a")), F.concat("s_name", F.lit(" b"))), F.lit(1), (k % 3).cast("int")).alias("models"))
    return usable(rows, False).select("provider", "model")


HEADROOM = 0.95
UNBOUNDED = 1 << 30
#: Tokens that a call needs, and how little is left when a provider counts as out of tokens.
LEAST_TOKENS = 2000


def budgets(providers: DataFrame, ledger: DataFrame, now: float) -> DataFrame:
    """Each provider's day: ``providers`` (provider, rpd, tpd, rpm, paid, quality) with ``ledger`` (provider, calls, tokens, observed_limit, blocked_until, last_call): budget, remaining, tokens left, seconds to wait, and what it can do now."""
    zero = F.lit(0).cast("long")
    rows = providers.join(ledger, "provider", "left")
    limit = F.coalesce(F.when(F.col("observed_limit") > 0, F.col("observed_limit")), F.col("rpd"))
    budget = F.greatest(F.floor(limit * HEADROOM), zero)
    remaining = F.greatest(budget - F.coalesce("calls", zero), zero)
    left = F.when(F.coalesce("tpd", zero) > 0, F.greatest(F.floor(F.col("tpd") * HEADROOM) - F.coalesce("tokens", zero), zero)).otherwise(F.lit(UNBOUNDED).cast("long"))
    wait = F.coalesce(F.greatest(F.coalesce(F.try_divide(F.lit(60.0), F.when(F.col("rpm") > 0, F.col("rpm"))), F.lit(0.0)) - (F.lit(now) - F.col("last_call")), F.lit(0.0)), F.lit(0.0))
    state = F.when(F.coalesce("blocked_until", F.lit(0.0)) > now, "rate limited").when((remaining == 0) | (left <= LEAST_TOKENS), "no budget").when(wait > 0, "paced").otherwise("live")
    return rows.select("provider", budget.alias("budget"), remaining.alias("remaining"), left.alias("tokens_left"), F.round(wait, 4).alias("wait"), state.alias("state"))


_PROVIDERS = """pr AS (SELECT s_suppkey AS provider, CAST(s_suppkey * 3 % 40 AS BIGINT) AS rpd, CASE WHEN s_suppkey % 2 = 0 THEN 9000 END AS tpd, s_suppkey % 7 AS rpm FROM supplier),
le AS (SELECT user_id AS provider, count(*) AS calls, CAST(floor(sum(value)) AS BIGINT) * 10 AS tokens, max(CASE WHEN user_id % 5 = 0 THEN 25 END) AS observed, max(CASE WHEN event_type = 'error' THEN epoch(ts) + 60 END) AS blocked, max(epoch(ts)) AS last_call FROM events GROUP BY 1),
j AS (SELECT pr.provider, greatest(CAST(floor(coalesce(observed, rpd) * 0.95) AS BIGINT), 0) AS budget, coalesce(calls, 0) AS calls, CASE WHEN tpd > 0 THEN greatest(CAST(floor(tpd * 0.95) AS BIGINT) - coalesce(tokens, 0), 0) ELSE 1073741824 END AS tokens_left, coalesce(greatest(coalesce(60.0 / nullif(rpm, 0), 0) - (1704700000 - last_call), 0), 0) AS wait, coalesce(blocked, 0) > 1704700000 AS blocked FROM pr LEFT JOIN le ON le.provider = pr.provider)"""


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    providers = table(spark, sf_dir, "supplier").select(k.alias("provider"), (k * 3 % 40).alias("rpd"), F.when(k % 2 == 0, F.lit(9000)).cast("long").alias("tpd"), (k % 7).alias("rpm"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ledger = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("provider")).agg(F.count("*").alias("calls"), (F.floor(F.sum("value")) * 10).alias("tokens"), F.max(F.when(F.col("user_id") % 5 == 0, 25)).alias("observed_limit"), F.max(F.when(F.col("event_type") == "error", at + 60)).alias("blocked_until"), F.max(at).alias("last_call"))
    return budgets(providers, ledger, 1704700000.0)


@registry.add(f"""WITH {_PROVIDERS} SELECT provider, budget, greatest(budget - calls, 0) AS remaining, tokens_left, round(wait, 4) AS wait, CASE WHEN blocked THEN 'rate limited' WHEN greatest(budget - calls, 0) = 0 OR tokens_left <= 2000 THEN 'no budget' WHEN wait > 0 THEN 'paced' ELSE 'live' END AS state FROM j""")
def provider_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider can still do today."""
    return _budgets(spark, sf_dir)


@registry.add(f"""WITH {_PROVIDERS}, s AS (SELECT CASE WHEN blocked THEN 'rate limited' WHEN greatest(budget - calls, 0) = 0 OR tokens_left <= 2000 THEN 'no budget' WHEN wait > 0 THEN 'paced' ELSE 'live' END AS state FROM j) SELECT state, count(*) AS n FROM s GROUP BY state""")
def fleet_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many providers are in which state."""
    return _budgets(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def next_action(running: Column, paused: Column, quota: Column, ready: Column) -> Column:
    """What a worker does next: it waits while it runs or is paused, extracts if there is budget and work, and else collects."""
    return F.when(running | paused, "wait").when(quota & ready, "extract").otherwise("collect")


@registry.add(f"""WITH {_PROVIDERS} SELECT provider, CASE WHEN provider % 9 = 0 OR wait > 0 THEN 'wait' WHEN greatest(budget - calls, 0) > 0 AND tokens_left > 5000 THEN 'extract' ELSE 'collect' END AS action FROM j""")
def worker_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next action of a worker at each provider."""
    return _budgets(spark, sf_dir).select("provider", next_action(F.col("provider") % 9 == 0, F.col("wait") > 0, F.col("remaining") > 0, F.col("tokens_left") > 5000).alias("action"))


@registry.add("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (event_type = 'error') AS fails, count(*) FILTER (event_type = 'view') AS fetched, count(*) FILTER (event_type = 'purchase') AS done FROM events GROUP BY 1)
SELECT day, CASE WHEN done > 0 THEN round((calls - fails) / done, 4) END AS per_page, CASE WHEN done > 0 THEN CAST(floor(500 / ((calls - fails) / done)) AS BIGINT) END AS capacity, CASE WHEN done > 0 THEN round(fetched / done, 4) END AS over_collected, fails * 100 // calls AS refused FROM d""")
def report_figures(spark: SparkSession, sf_dir: str, budget: int = 500) -> DataFrame:
    """A day's ratios: successful calls for a page, pages that the budget allows, pages fetched for one done, refused calls in per cent; null without a page."""
    kind = F.col("event_type")
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.count_if(kind == "error").alias("fails"), F.count_if(kind == "view").alias("fetched"), F.count_if(kind == "purchase").alias("done"))
    each = F.try_divide(F.col("calls") - F.col("fails"), F.col("done"))
    return days.select("day", F.round(each, 4).alias("per_page"), F.floor(F.try_divide(F.lit(float(budget)), each)).alias("capacity"), F.round(F.try_divide("fetched", "done"), 4).alias("over_collected"), F.floor(F.col("fails") * 100 / F.col("calls")).alias("refused"))


# windows ----------------------------------------------------------------------


def minute_of(clock: Column) -> Column:
    """Minutes since midnight of HH:MM, null where it isn't that."""
    ok = clock.rlike(r"^\s*\d{1,2}:\d{1,2}\s*$")
    part = lambda k: F.trim(F.split_part(F.when(ok, clock), F.lit(":"), F.lit(k))).try_cast("int")
    return F.when((part(1) < 24) & (part(2) < 60), part(1) * 60 + part(2))


def next_window_end(start: Column, clock: Column) -> Column:
    """The first HH:MM after ``start``, null where the clock can't be read."""
    midnight = F.date_trunc("day", start)
    today = F.timestamp_add("MINUTE", minute_of(clock), midnight)
    return F.when(today > start, today).otherwise(F.timestamp_add("DAY", F.lit(1), today))


def within_window(now: Column, first: Column, last: Column) -> Column:
    """Whether a time lies in a daily window, which may cross midnight; a window that can't be read is open."""
    minute, a, b = F.hour(now) * 60 + F.minute(now), minute_of(first), minute_of(last)
    inside = F.when(a <= b, (minute >= a) & (minute < b)).otherwise((minute >= a) | (minute < b))
    return F.when(a.isNull() | b.isNull(), True).otherwise(inside)


def cron_fields(expression: Column, fallback: str) -> Column:
    """The five fields of a cron expression, those of ``fallback`` where there aren't five."""
    fields = F.split(F.trim(expression), r"\s+")
    return F.when(F.size(fields) == 5, fields).otherwise(F.array(*map(F.lit, fallback.split())))


def cron_start(fields: Column, fallback: str = "16:30") -> Column:
    """HH:MM at which a cron expression starts, ``fallback`` where minute or hour is no number."""
    hour, minute = (F.get(fields, F.lit(k)).try_cast("int") for k in (1, 0))
    return F.coalesce(F.when(hour.isNotNull() & minute.isNotNull(), F.format_string("%02d:%02d", hour, minute)), F.lit(fallback))


_CLOCKS = ("22:00", "06:30", "bad", "23:59", "0:05")


@registry.add(f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 MINUTE * CAST(o_custkey * 7 % 1440 AS INTEGER) AS t, {list(_CLOCKS)}[o_orderkey % 5 + 1] AS a, {list(_CLOCKS)}[o_orderkey % 3 + 1] AS b FROM orders), m AS (SELECT *, TRY_CAST(split_part(a, ':', 1) AS INT) * 60 + TRY_CAST(split_part(a, ':', 2) AS INT) AS am, TRY_CAST(split_part(b, ':', 1) AS INT) * 60 + TRY_CAST(split_part(b, ':', 2) AS INT) AS bm, hour(t) * 60 + minute(t) AS now FROM o)
SELECT id, CASE WHEN am IS NULL OR bm IS NULL THEN true WHEN am <= bm THEN now >= am AND now < bm ELSE now >= am OR now < bm END AS inside, strftime(CASE WHEN date_trunc('day', t) + INTERVAL 1 MINUTE * am > t THEN date_trunc('day', t) + INTERVAL 1 MINUTE * am ELSE date_trunc('day', t) + INTERVAL 1 MINUTE * (am + 1440) END, '%Y-%m-%d %H:%M') AS ends, CASE id % 3 WHEN 0 THEN '10:05' WHEN 1 THEN '16:30' ELSE '16:30' END AS starts FROM m""")
def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each time lies in its window, when the window ends, and when its schedule starts."""
    pick = lambda n: F.element_at(F.array(*map(F.lit, _CLOCKS)), (F.col("o_orderkey") % n + 1).cast("int"))
    t = F.timestamp_add("MINUTE", F.col("o_custkey") * 7 % 1440, F.col("o_orderdate").cast("timestamp"))
    cron = F.element_at(F.array(F.lit("5 10 * * *"), F.lit("*/5 * * * *"), F.lit("5 10")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    starts = cron_start(cron_fields(cron, "30 16 * * *"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), within_window(t, pick(5), pick(3)).alias("inside"), F.date_format(next_window_end(t, pick(5)), "yyyy-MM-dd HH:mm").alias("ends"), starts.alias("starts"))


# forms ------------------------------------------------------------------------

#: Which changes may be suggested for what, and which of them need a new value.
CHANGES = {"community": ("wrong_city", "wrong_topic", "name_correction", "archive", "delete"), "venue": ("wrong_info", "closed", "name_correction")}
VALUED = ("wrong_city", "wrong_topic", "name_correction")


def form_verdict(entity: Column, name: Column, change: Column, value: Column) -> Column:
    """``ok``, or what is wrong with a suggested edit."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    allowed = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in CHANGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), entity), F.array().cast("array<string>"))
    return (
        F.when(blank(name) | blank(change), "missing_fields").when(~F.coalesce(entity.isin(*CHANGES), F.lit(False)), "invalid_entity_type").when(~F.array_contains(allowed, change), "invalid_change_type")
        .when(change.isin(*VALUED) & (F.trim(F.coalesce(value, F.lit(""))) == ""), "missing_new_value").otherwise("ok")
    )


_KINDS, _TYPES = ("community", "venue", "person"), ("wrong_city", "name_correction", "closed", "archive", "")


@registry.add(f"""WITH f AS (SELECT o_orderkey AS form, {list(_KINDS)}[o_orderkey % 3 + 1] AS entity, {list(_TYPES)}[o_custkey % 5 + 1] AS change, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'x' END AS name FROM orders)
SELECT form, CASE WHEN name = '' OR change = '' THEN 'missing_fields' WHEN entity = 'person' THEN 'invalid_entity_type' WHEN entity = 'community' AND change = 'closed' OR entity = 'venue' AND change IN ('wrong_city', 'archive') THEN 'invalid_change_type' WHEN change IN ('wrong_city', 'name_correction') AND trim(value) = '' THEN 'missing_new_value' ELSE 'ok' END AS verdict FROM f""")
def form_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each suggested edit."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    value, name = F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("x")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("form"), form_verdict(pick(_KINDS, F.col("o_orderkey")), name, pick(_TYPES, F.col("o_custkey")), value).alias("verdict"))


#: today's fields of a pair's log with their defaults.
PAIR_LOG = "city string, topic string, queries array<string>, search_cache_hit boolean, urls_found int, fetched_urls array<string>, fetch_failed int, cache_hits_scrape int, cache_hits_extract int, records_extracted int, search_failed boolean, search_error string, extract_failed int, extract_error string, aborted boolean"


def pair_logs(runs: DataFrame, column: str = "search_log") -> DataFrame:
    """A row for each pair in the runs' JSON logs, with today's defaults for fields that older versions lack."""
    keep = [c for c in runs.columns if c != column]
    rows = runs.select(*keep, F.posexplode(F.from_json(column, f"array<struct<{PAIR_LOG.replace(' ', ':').replace(',:', ',')}>>")).alias("pos", "p")).select(*keep, "pos", "p.*")
    zeros = {"int": F.lit(0), "boolean": F.lit(False), "array<string>": F.array().cast("array<string>")}
    kinds = dict(x.split(" ") for x in PAIR_LOG.split(", "))
    return rows.withColumns({c: F.coalesce(c, zeros[k]) for c, k in kinds.items() if k in zeros})


@registry.add("SELECT o_orderkey AS run, CASE WHEN o_custkey % 2 = 0 THEN 'X' END AS city, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 50 AS INT) ELSE 0 END AS urls_found, o_custkey % 3 = 0 AS search_failed, 0 AS extract_failed, 0 AS queries FROM orders")
def pair_log_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of several versions under today's schema."""
    k = F.col("o_custkey")
    old = F.to_json(F.struct(F.when(k % 2 == 0, "X").alias("city"), F.when(k % 2 == 0, k % 50).alias("urls_found"), F.when(k % 3 == 0, True).alias("search_failed")))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("["), old, F.lit("]")).alias("search_log"))
    return pair_logs(runs).select("run", "city", "urls_found", "search_failed", "extract_failed", F.size("queries").alias("queries"))


# the daily summary --------------------------------------------------------------


def daily_summary(parts: dict[str, DataFrame], home: list[str]) -> DataFrame:
    """metric, scope and value of counted parts (city, n): ``hu`` for the home country's cities, ``intl`` for all others, without a city too."""
    rows = None
    for metric, df in parts.items():
        scope = F.when(F.coalesce("city", F.lit("")).isin(home), "hu").otherwise("intl")
        one = df.groupBy(scope.alias("scope")).agg(F.sum("n").alias("value")).select(F.lit(metric).alias("metric"), "scope", "value")
        rows = one if rows is None else rows.unionByName(one)
    return rows


_HOME = ("Brand#1", "Brand#2", "Brand#3", "Brand#4")
_S = f"CASE WHEN coalesce(city, '') IN {_HOME} THEN 'hu' ELSE 'intl' END"
_H = "h AS (SELECT l_partkey AS id, l_linenumber = 1 AS created, l_shipdate AS at_time, l_orderkey * 10 + l_linenumber AS row FROM lineitem), first AS (SELECT id, min(at_time) AS fs FROM h WHERE created GROUP BY id)"
_BETWEEN = "{0} >= TIMESTAMP '1996-01-01' AND {0} < TIMESTAMP '1996-07-01'"


@registry.add(f"""{PG}, {RECORDS_SQL}, {_H}, x AS (
SELECT 'new_communities' AS metric, city, count(DISTINCT r.id) AS n FROM records r JOIN first USING (id) WHERE NOT hidden AND {_BETWEEN.format('fs')} GROUP BY city UNION ALL
SELECT 'changed_communities', city, count(DISTINCT r.id) FROM records r JOIN h USING (id) WHERE NOT created AND {_BETWEEN.format('at_time')} GROUP BY city UNION ALL
SELECT 'change_rows', city, count(DISTINCT row) FROM records r JOIN h USING (id) WHERE NOT created AND {_BETWEEN.format('at_time')} GROUP BY city UNION ALL
SELECT 'new_venues', city, count(DISTINCT r.id) FROM records r JOIN first USING (id) WHERE {_BETWEEN.format('fs')} GROUP BY city UNION ALL
SELECT 'pages_scraped', city, count(*) FROM pages_of WHERE scraped_at >= '2026-01-05' AND scraped_at < '2026-01-12' GROUP BY city UNION ALL
SELECT 'stock_communities', city, count(*) FROM records WHERE NOT hidden GROUP BY city UNION ALL SELECT 'stock_venues', city, count(*) FROM records GROUP BY city UNION ALL
SELECT 'stock_pages_cached', city, count(*) FROM pages_of GROUP BY city UNION ALL SELECT 'stock_pages_extracted', city, count(*) FROM pages_of WHERE extract_fingerprint IS NOT NULL GROUP BY city UNION ALL
SELECT 'covered_pairs', city, count(DISTINCT topic) FROM records GROUP BY city)
SELECT metric, {_S} AS scope, sum(n)::BIGINT AS value FROM x GROUP BY ALL""")
def summary_of_day(spark: SparkSession, sf_dir: str, start: str = "1996-01-01", end: str = "1996-07-01") -> DataFrame:
    """A span's news and the stock, at home and abroad."""
    rows, pages = records(spark, sf_dir), cached_pages(spark, sf_dir).select("city", "data.scraped_at", "data.extract_fingerprint")
    history = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") == 1).alias("created"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    first = history.filter("created").groupBy("id").agg(F.min("at").alias("fs")).filter(inside("fs"))
    changed = rows.join(history.filter(~F.col("created") & inside("at")), "id").groupBy("city").agg(F.countDistinct("id").alias("ids"), F.countDistinct("row").alias("rows"))
    by_city = lambda df: df.groupBy("city").agg(F.count("*").alias("n"))
    return daily_summary({
        "new_communities": by_city(rows.filter(~F.col("hidden")).join(first, "id")), "changed_communities": changed.select("city", F.col("ids").alias("n")), "change_rows": changed.select("city", F.col("rows").alias("n")), "new_venues": by_city(rows.join(first, "id")),
        "pages_scraped": by_city(pages.filter("scraped_at >= '2026-01-05' AND scraped_at < '2026-01-12'")), "stock_communities": by_city(rows.filter(~F.col("hidden"))), "stock_venues": by_city(rows), "stock_pages_cached": by_city(pages),
        "stock_pages_extracted": by_city(pages.filter("extract_fingerprint IS NOT NULL")), "covered_pairs": rows.groupBy("city").agg(F.countDistinct("topic").alias("n")),
    }, list(_HOME))


@registry.add(f"{R} SELECT id, row_number() OVER (ORDER BY id % 7 <> 0, id) AS place FROM records WHERE hidden")
def manual_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open candidates in the order in which they are kept: manual ones first, then the oldest."""
    rows = records(spark, sf_dir).filter("hidden").select("id", F.when(F.col("id") % 7 == 0, "manual").otherwise("fuzzy_name").alias("signal"))
    from civicgrid.operators.ranks import with_places

    return with_places(rows, [F.col("signal") != "manual", F.col("id")]).select("id", "place")


QUERIES, ORACLE = registry.queries, registry.oracle
