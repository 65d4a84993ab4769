"""Passes over the work: plans, page states, extraction through a cache, gates, enrichment, what a run saves.

A pass is a chain of joins over tables. What calls a model is a function of
tables that the caller gives (pages in, answers out); ``answers`` here stands for
its stored results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators.dedup import save_pairs
from civicgrid.operators.lifecycle import leaders_as_people, upsert_records, without_stale_leaders
from civicgrid.operators.records import clean_communities, clean_people, clean_venues, joined, once, output_rows, output_state
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table
from civicgrid.sources.store import settled

registry = Registry()
MAX_PAGES = 3
MIN_TEXT = 20
CONFIDENCE = 0.7


def universe_of(cities: DataFrame, topics: DataFrame, core: list[str]) -> DataFrame:
    """All pairs of ``cities`` (city, tier) and ``topics`` (topic): those of the core tier only with ``core`` topics, unless there are none. Topics are few by nature; Spark sends them to the tasks."""
    allowed = (F.col("tier") != "core") | F.col("topic").isin(core) if core else F.lit(True)
    return cities.crossJoin(topics).filter(allowed).select("city", "topic")


def plan(universe: DataFrame, searched: DataFrame, done: DataFrame) -> DataFrame:
    """city, topic and what a run does with a pair: nothing if it is done, ``extract`` if it was searched, else ``search``."""
    keys = ["city", "topic"]
    marks = universe.join(searched.select(*keys, F.lit(True).alias("s")).distinct(), keys, "left").join(done.select(*keys, F.lit(True).alias("d")).distinct(), keys, "left")
    return marks.filter(F.col("d").isNull()).select(*keys, F.when(F.col("s"), "extract").otherwise("search").alias("step"))


def coverage(states: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair's counts with whether it is done."""
    return states.join(done.select(*keys, F.lit(True).alias("_d")).distinct(), keys, "left").withColumn("is_done", F.coalesce("_d", F.lit(False))).drop("_d")


def first_results(urls: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """The first ``most`` results of each pair: pair, pos, url, an address once. Rows are dealt out by pair alone, once for both steps."""
    once = urls.repartition("pair").groupBy("pair", "url").agg(F.min("pos").alias("pos"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("pair").orderBy("pos", "url"))).filter(F.col("n") <= most).select("pair", "pos", "url")


def offered(first: DataFrame, pages: DataFrame, least: int = MIN_TEXT) -> DataFrame:
    """Cached pages (url, text, fingerprint, records) of these results with a text of ``least`` characters, once for all pairs that found them."""
    return pages.filter(F.length("text") >= least).join(first.select("url").distinct(), "url", "left_semi")


def page_states(found: DataFrame, current: str, answers: DataFrame) -> DataFrame:
    """``found`` pages with ``state`` and ``body``, which no pair changes: ``hit`` where the cache holds records of the current fingerprint, else ``ok``, ``empty``, ``failed`` (an answer that can't be used) or ``deferred`` (no answer yet)."""
    hit = (F.col("fingerprint") == current) & F.col("records").isNotNull()
    asked = found.join(answers.select("url", "body"), "url", "left")
    told = once(output_state(F.col("body"), "communities"), lambda t: F.when(t.isin("ok", "empty"), t).otherwise("failed"))
    state = F.when(hit, "hit").when(F.col("body").isNull(), "deferred").otherwise(told)
    return asked.withColumns({"state": F.coalesce(state, F.lit("deferred")), "body": F.when(F.coalesce(hit, F.lit(False)), F.col("records")).otherwise(F.col("body"))})


#: How often a pair's pages are offered that had no turn.
ROUNDS = 3


def after_rounds(pages: DataFrame, answers: DataFrame, stops: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pages`` (pair, url) with what came of at most ``rounds`` rounds: state, attempt, body and the reason of a stop.

    ``answers``: pair, url, attempt and body, null where the attempt failed; ``stops``: pair,
    attempt and reason, of rounds after which nothing could go on. A round takes what no
    round before has answered. A page is ``done``, or ``failed`` if its answer is none, or
    ``stopped`` if it had no turn before its pair stopped; ``deferred`` if it never had one
    though the pair went on to the end. Later answers of a page don't count.
    """
    ended = stops.filter(F.col("attempt") <= rounds).groupBy("pair").agg(F.min(F.struct("attempt", "reason")).alias("end"))
    held = pages.select("pair", "url").distinct().join(ended, "pair", "left").withColumn("last", F.coalesce("end.attempt", F.lit(rounds)))
    told = answers.groupBy("pair", "url").agg(F.min(F.struct("attempt", F.col("body").isNull().alias("failed"), "body")).alias("a"))
    both = held.join(told, ["pair", "url"], "left")
    answered = F.coalesce(F.col("a.attempt") <= F.col("last"), F.lit(False))
    state = F.when(answered, F.when(F.col("a.failed"), "failed").otherwise("done")).when(F.col("end").isNotNull(), "stopped").otherwise("deferred")
    return both.select("pair", "url", state.alias("state"), F.when(answered, F.col("a.attempt")).alias("attempt"), F.when(answered, F.col("a.body")).alias("body"), F.when(~answered, F.col("end.reason")).alias("reason"))


def extracted(states: DataFrame) -> DataFrame:
    """Valid, joinable records of the usable pages: url, the page's state and the record's fields."""
    rows = output_rows(states.filter(F.col("state").isin("hit", "ok")).select("url", "city", "topic", "state", "body"), "communities")
    valid = clean_communities(rows.withColumns({"source_url": F.col("url").cast("string"), "source_urls": F.array(F.col("url").cast("string"))}))
    return valid.filter("joinable")


def needs_help(record: str = "") -> Column:
    """A record is worth a search of its own: sure enough, and with neither address nor contact nor links."""
    empty = lambda c: F.coalesce(F.col(f"{record}{c}"), F.lit("")) == ""
    return (F.coalesce(F.col(f"{record}confidence"), F.lit(0.0)) >= CONFIDENCE) & empty("website") & empty("contact") & (F.coalesce(F.size(f"{record}social_links"), F.lit(0)) <= 0)


def first_help(records: DataFrame, results: DataFrame) -> DataFrame:
    """``records`` (key, website, contact, social_links) with what the first helpful of their two best results (key, pos, website, contact, social_links) adds: only fields that are empty are filled.

    Results are in order of ``place`` if they have that column, else of ``pos``.
    """
    links = F.coalesce("social_links", F.array().cast("array<string>"))
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    helps = results.filter("pos < 2").withColumn("social_links", links).filter(known("website") | known("contact") | (F.size("social_links") > 0))
    best = helps.groupBy("key").agg(F.min_by(F.struct("website", "contact", "social_links"), "place" if "place" in results.columns else "pos").alias("e"))
    both = records.join(best, "key", "left")
    filled = {c: F.when(~known(c) & (F.coalesce(F.col(f"e.{c}"), F.lit("")) != ""), F.col(f"e.{c}")).otherwise(F.col(c)) for c in ("website", "contact")}
    filled["social_links"] = F.when((F.coalesce(F.size("social_links"), F.lit(0)) <= 0) & F.col("e").isNotNull(), F.col("e.social_links")).otherwise(F.col("social_links"))
    return both.withColumns(filled).select(*records.columns)


@dataclass
class Directory:
    """The tables that a pass reads and writes anew."""

    communities: DataFrame
    venues: DataFrame
    people: DataFrame
    pages: DataFrame


#: What each kind of extraction leaves on its page.
MARKS = {"communities": "fingerprint", "venues": "venue_fingerprint", "persons": "person_fingerprint"}


def due_pages(states: DataFrame, named: DataFrame, kind: str, current: dict[str, str], answers: dict[str, DataFrame]) -> DataFrame:
    """Pages (once each) with a community whose ``kind`` isn't extracted under the current fingerprint, with the answer's body and state."""
    once = states.select("url", "city", "topic", MARKS[kind]).dropDuplicates(["url"]).join(named.select("url").distinct(), "url", "left_semi")
    due = once.filter(~F.coalesce(F.col(MARKS[kind]) == current[kind], F.lit(False)))
    return due.join(answers[kind].select("url", "body"), "url").withColumn("state", output_state(F.col("body"), kind))


def one_of_each(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """``rows`` with their record key, the one of the first address for each."""
    keyed = T.with_record_key(rows, prefix, columns)
    others = [c for c in keyed.columns if c != "key"]
    return keyed.groupBy("key").agg(F.min_by(F.struct(*others), F.struct("source_url", "name")).alias("r")).select("key", "r.*")


def fitted(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[c for c in like.columns if c in rows.columns])


def sourced(pages: DataFrame, kind: str) -> DataFrame:
    """The items of the pages' usable answers, each with its page as source."""
    rows = output_rows(pages.filter(F.col("state") == "ok").select("url", "city", "topic", "body"), kind)
    return rows.withColumns({"source_url": F.col("url").cast("string"), "source_urls": F.array(F.col("url").cast("string"))})


class Extraction:
    """What a pass over the pages of the pairs (``urls``) takes from them, through the cache.

    A page is read once, however many pairs found it. The tables are made when they are
    asked for, so that none waits for another that it doesn't need. ``current`` and
    ``answers`` (url, body) go by communities, venues and persons.
    """

    def __init__(self, urls: DataFrame, old: Directory, current: dict[str, str], answers: dict[str, DataFrame], now: str, helpers: DataFrame | None = None):
        self.old, self.current, self.now, self.helpers = old, current, now, helpers
        self.first = first_results(urls)
        self.states = settled(page_states(offered(self.first, old.pages), current["communities"], answers["communities"]), "states")
        self.records = settled(extracted(self.states), "records")
        self.venue_pages, self.people_pages = (due_pages(self.states, self.records, kind, current, answers) for kind in ("venues", "persons"))

    def pair_states(self) -> DataFrame:
        """The pages of each pair: pair, pos, url, the page's columns, state and body."""
        return self.first.join(self.states, "url")

    def communities(self) -> DataFrame:
        """Found communities replace those of their pairs; new ones that are sure enough and lack something are helped."""
        found = one_of_each(self.records, "c", ["name", "city", "topic"]).withColumn("hidden", F.lit(False))
        if self.helpers is not None:
            wanting = (F.col("state") == "ok") & needs_help()
            found = settled(found, "found")
            found = first_help(found.filter(wanting), self.helpers).unionByName(found.filter(~wanting))
        return save_pairs(self.old.communities, fitted(found, self.old.communities))

    def venues(self) -> DataFrame:
        venues = one_of_each(clean_venues(sourced(self.venue_pages, "venues")), "v", ["name", "city"])
        return upsert_records(self.old.venues, fitted(venues, self.old.venues), self.now)

    def people(self) -> DataFrame:
        """Leaders that communities name replace those of earlier passes: all leaders of a community that names some, else only those that a leader field gave."""
        identity = ["name", "city", "role", "community_name"]
        people = one_of_each(clean_people(sourced(self.people_pages, "persons")).withColumn("origin", F.lit(None).cast("string")), "p", identity)
        leaders = one_of_each(leaders_as_people(self.records), "p", identity)
        with_people = upsert_records(self.old.people, fitted(people, self.old.people), self.now)
        named = self.records.select("city", F.col("name").alias("community_name")).distinct()
        leading = leaders.select("city", "community_name").distinct()
        cleared = without_stale_leaders(without_stale_leaders(with_people, leading), named.join(leading, ["city", "community_name"], "left_anti"), True)
        return upsert_records(cleared, fitted(leaders, self.old.people), self.now)

    def pages(self) -> DataFrame:
        """The page cache with the marks of what was extracted."""
        done = {kind: pages.filter(F.col("state").isin("ok", "empty")).select("url").distinct().withColumn(f"_{kind}", F.lit(True)) for kind, pages in (("communities", self.states), ("venues", self.venue_pages), ("persons", self.people_pages))}
        marked = self.old.pages
        for kind, urls_done in done.items():
            marked = marked.join(urls_done, "url", "left").withColumn(MARKS[kind], F.when(F.col(f"_{kind}"), self.current[kind]).otherwise(F.col(MARKS[kind])))
        return marked.select(*self.old.pages.columns)


def full_pass(urls: DataFrame, old: Directory, current: dict[str, str], answers: dict[str, DataFrame], now: str, helpers: DataFrame | None = None) -> tuple[Directory, DataFrame]:
    """(the directory after the pass, the states of its pages).

    The pages of the pairs are extracted through the cache. Joinable records stay; new
    ones that are sure enough and lack something are helped by ``helpers``, without which
    it is the pass over cached pages alone. Pages that name a community give venues and
    people.
    """
    run = Extraction(urls, old, current, answers, now, helpers)
    return Directory(run.communities(), run.venues(), run.people(), run.pages()), run.pair_states()


def record_pass(key: str, old: Directory, current: dict[str, str], answers: dict[str, DataFrame], now: str) -> tuple[Directory, DataFrame]:
    """A pass over the sources of one community alone, whose pages are extracted again whatever their cache holds."""
    sources = old.communities.filter(F.col("key") == key).select(F.col("key").alias("pair"), F.posexplode(F.array_distinct(F.concat(F.array("source_url"), F.coalesce("source_urls", F.array().cast("array<string>"))))).alias("pos", "url"))
    urls = sources.select("pair", "pos", F.col("url").cast(old.pages.schema["url"].dataType).alias("url"))
    fresh = old.pages.join(urls.select("url").distinct().withColumn("_again", F.lit(True)), "url", "left")
    forced = fresh.withColumns({m: F.when(F.col("_again").isNull(), F.col(m)) for m in MARKS.values()}).select(*old.pages.columns)
    return full_pass(urls, Directory(old.communities, old.venues, old.people, forced), current, answers, now)


def enrichment_batch(rows: DataFrame, results: DataFrame, limit: int, valid: Callable[[Column, Column], Column]) -> DataFrame:
    """key and outcome of a batch: of the first 3 x ``limit`` candidates (key, place, text) in order, ``no_source``, ``failed`` (no answer), ``skipped`` (not valid) or ``enriched``, until ``limit`` are enriched: the limit is the batch's."""
    pool = rows.orderBy("place").limit(3 * limit)
    asked = pool.join(results, "key", "left")
    outcome = F.when(F.coalesce(F.length("text"), F.lit(0)) < 300, "no_source").when(F.col("long").isNull(), "failed").when(valid(F.col("short"), F.col("long")), "enriched").otherwise("skipped")
    told = asked.select("key", "place", outcome.alias("outcome"))
    so_far = F.count_if(F.col("outcome") == "enriched").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))  # at most 3 x limit rows
    return told.withColumn("before", so_far).filter(F.col("before") < limit).select("key", "outcome")


# the given tables in these roles ------------------------------------------------

CURRENT = {"communities": "fp1", "venues": "vf1", "persons": "pf1"}
NOW = "2026-02-01"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("pos"), F.col("l_partkey").alias("url"))


def _body(name: Column, tag: str) -> Column:
    item = F.struct(name.alias("name"), (F.col("p_size") % 10 / 10 + 0.1).alias("confidence"), (F.col("p_partkey") % 6 > 0).alias("joinable"), F.lit(tag).alias("fee"), F.when(F.col("p_partkey") % 5 < 2, F.concat(F.lit("Éva Nagy; Bo "), F.initcap(F.element_at(F.split("p_name", " "), 1)))).alias("leader"))
    return F.to_json(F.struct(F.array(item).alias("communities")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("url"), F.col("p_brand").alias("city"), F.col("p_type").alias("topic"), F.repeat("p_name", (k % 5).cast("int")).alias("text"), F.concat(F.lit("fp"), k % 3).alias("fingerprint"), F.when(k % 4 > 0, _body(F.concat(F.lit("Cached "), "p_name"), "old")).alias("records"), F.when(k % 5 == 0, "vf1").when(k % 5 == 1, "vf0").alias("venue_fingerprint"), F.when(k % 6 == 1, "pf1").alias("person_fingerprint"))


def _answers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    body = F.when(k % 8 == 1, "oops").when(k % 8 == 2, "{}").otherwise(_body(F.concat(F.lit("New "), "p_name"), "new"))
    said = lambda text, n: F.concat(F.lit(text), F.col("p_size") % n)
    venues = F.to_json(F.struct(F.array(F.struct(said("Hall ", 5).alias("name"), F.concat(F.lit("Main street "), k).alias("address")), F.struct(said("Yard ", 3).alias("name"), F.lit("n/a").alias("address"))).alias("venues")))
    persons = F.to_json(F.struct(F.array(F.struct(said("Ana Kis ", 4).alias("name"), F.lit("coach").alias("role"), F.concat(F.lit("New "), "p_name").alias("community_name")), F.struct(F.lit("Solo").alias("name"), F.lit("coach").alias("role"), F.lit("x").alias("community_name")), F.struct(F.lit("Ede Tar").alias("name"), F.lit("leader").alias("role"), F.concat(F.lit("New "), "p_name").alias("community_name"))).alias("persons")))
    return {
        "communities": part.filter("p_partkey % 7 <> 0").select(k.alias("url"), body.alias("body")),
        "venues": part.filter("p_partkey % 9 <> 0").select(k.alias("url"), F.when(k % 10 == 3, "oops").otherwise(venues).alias("body")),
        "persons": part.filter("p_partkey % 10 <> 0").select(k.alias("url"), persons.alias("body")),
    }


def _directory(spark: SparkSession, sf_dir: str) -> Directory:
    """What earlier passes left: some of the same communities, hidden or not, halls of some cities, leaders of some communities."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    none, links = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    sources = F.array(F.concat(F.lit("old "), k))
    kept = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("New "), "p_name").alias("name"), F.col("p_brand").alias("city"), F.col("p_type").alias("topic"), F.lit("http://kept.example").alias("website"), none.alias("contact"), links.alias("social_links"), k.cast("string").alias("source_url"), sources.alias("source_urls"), (k % 2 == 0).alias("hidden"))
    communities = one_of_each(kept, "c", ["name", "city", "topic"])
    halls = part.filter("p_size % 5 < 3").select(F.concat(F.lit("Hall "), F.col("p_size") % 5).alias("name"), F.col("p_brand").alias("city"), F.lit("kept").alias("address"), F.concat(F.lit("old "), k).alias("source_url"), sources.alias("source_urls"), F.lit("2025").alias("updated_at"))
    leaders = part.filter("p_partkey % 4 = 0").select(F.lit("Old Leader").alias("name"), F.col("p_brand").alias("city"), F.when(k % 12 == 0, "coach").otherwise("leader").alias("role"), F.concat(F.lit("New "), "p_name").alias("community_name"), F.when(k % 8 == 0, "leader_field").alias("origin"), none.alias("bio"), F.concat(F.lit("old "), k).alias("source_url"), sources.alias("source_urls"), F.lit("2025").alias("updated_at"))
    venues, people = one_of_each(halls, "v", ["name", "city"]), one_of_each(leaders, "p", ["name", "city", "role", "community_name"])
    return Directory(communities, venues, people, _pages(spark, sf_dir))


def _pass(spark: SparkSession, sf_dir: str) -> Extraction:
    k = F.col("p_partkey")
    helpers = table(spark, sf_dir, "part").select(F.concat(F.lit("New "), "p_name").alias("name"), F.col("p_brand").alias("city"), F.col("p_type").alias("topic"), (k % 3).alias("pos"), F.lit("http://help.example").alias("website"), F.lit(None).cast("string").alias("contact"), F.lit(None).cast("array<string>").alias("social_links"))
    helpers = T.with_record_key(helpers, "c", ["name", "city", "topic"]).drop("name", "city", "topic")
    return Extraction(_urls(spark, sf_dir), _directory(spark, sf_dir), CURRENT, _answers(spark, sf_dir), NOW, helpers)


_STATES = f"""u AS (SELECT l_orderkey AS pair, l_partkey AS url, min(l_linenumber * 10 + l_partkey % 10) AS pos FROM lineitem GROUP BY 1, 2), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY pair ORDER BY pos, url) <= {MAX_PAGES}),
s AS (SELECT pair, pos, url, p.*, CASE WHEN url % 3 = 1 AND url % 4 > 0 THEN 'hit' WHEN url % 7 = 0 THEN 'deferred' WHEN url % 8 = 1 THEN 'failed' WHEN url % 8 = 2 THEN 'empty' ELSE 'ok' END AS state FROM f JOIN part p ON p_partkey = url WHERE length(p_name) * (url % 5) >= {MIN_TEXT})"""


@registry.add(f"WITH {_STATES} SELECT pair, pos, url, state FROM s")
def extraction_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each page of a run: from the cache, extracted, empty, failed or deferred."""
    first = first_results(_urls(spark, sf_dir))
    states = page_states(offered(first, _pages(spark, sf_dir)), CURRENT["communities"], _answers(spark, sf_dir)["communities"])
    return first.join(states.select("url", "state"), "url").select("pair", F.col("pos").cast("long").alias("pos"), "url", "state")


@registry.add(f"""WITH {_STATES} SELECT pair, url, CASE state WHEN 'hit' THEN 'Cached ' ELSE 'New ' END || p_name AS name, p_brand AS city, p_type AS topic, CASE state WHEN 'hit' THEN 'old' ELSE 'new' END AS fee FROM s WHERE state IN ('hit', 'ok') AND url % 6 > 0""")
def gated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the same run that pass its gates."""
    first = first_results(_urls(spark, sf_dir))
    states = page_states(offered(first, _pages(spark, sf_dir)), CURRENT["communities"], _answers(spark, sf_dir)["communities"])
    return first.join(extracted(states), "url").select("pair", "url", "name", "city", "topic", "fee")


@registry.add()
def full_pass_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities after a full pass."""
    return _pass(spark, sf_dir).communities().select("key", "name", "city", "topic", "website", "hidden")


_NAMED = f"""{_STATES}, c AS (SELECT url, CASE state WHEN 'hit' THEN 'Cached ' ELSE 'New ' END || p_name AS name, p_brand AS city, p_type AS topic, any_value(p_name) AS p_name FROM s WHERE state IN ('hit', 'ok') AND url % 6 > 0 GROUP BY ALL), n AS (SELECT DISTINCT url FROM c)"""


@registry.add(f"""WITH {_NAMED}, p AS (SELECT p_partkey AS url, p_brand AS city, p_size FROM part WHERE p_partkey IN (FROM n) AND p_partkey % 5 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 10 <> 3),
i AS (SELECT 'Hall ' || (p_size % 5) AS name, city, 'Main street ' || url AS address, CAST(url AS VARCHAR) AS url FROM p UNION ALL SELECT 'Yard ' || (p_size % 3), city, NULL, CAST(url AS VARCHAR) FROM p), w AS (SELECT name, city, min(url) AS url, arg_min(struct_pack(a := address), url).a AS address FROM i GROUP BY ALL),
o AS (SELECT 'Hall ' || (p_size % 5) AS name, p_brand AS city, min('old ' || p_partkey) AS url FROM part WHERE p_size % 5 < 3 GROUP BY ALL)
SELECT coalesce(w.name, o.name) AS name, coalesce(w.city, o.city) AS city, CASE WHEN w.name IS NULL THEN 'kept' ELSE w.address END AS address, concat_ws(' | ', w.url, o.url) AS source_urls, CASE WHEN w.name IS NULL THEN '2025' ELSE '{NOW}' END AS updated_at FROM w FULL OUTER JOIN o ON o.name = w.name AND o.city = w.city""")
def full_pass_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The venues after the same pass: those of pages that name a community join the stored ones."""
    return _pass(spark, sf_dir).venues().select("name", "city", "address", joined("source_urls"), "updated_at")


@registry.add(f"""WITH {_NAMED}, p AS (SELECT p_partkey AS url, p_brand AS city, p_size, p_name FROM part WHERE p_partkey IN (FROM n) AND p_partkey % 6 <> 1 AND p_partkey % 10 <> 0),
e AS (SELECT DISTINCT 'Ana Kis ' || (p_size % 4) AS name, city, 'coach' AS role, 'New ' || p_name AS community_name FROM p UNION SELECT 'Ede Tar', city, 'leader', 'New ' || p_name FROM p),
l AS (SELECT DISTINCT unnest(['Éva Nagy', 'Bo ' || upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2)]) AS name, city, 'leader' AS role, name AS community_name FROM c WHERE url % 5 < 2),
o AS (SELECT 'Old Leader' AS name, p_brand AS city, CASE WHEN p_partkey % 12 = 0 THEN 'coach' ELSE 'leader' END AS role, 'New ' || p_name AS community_name, arg_min(struct_pack(a := CASE WHEN p_partkey % 8 = 0 THEN 'leader_field' END), 'old ' || p_partkey).a AS origin FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL),
b AS (SELECT name, city, role, community_name, NULL AS origin FROM e UNION ALL SELECT name, city, role, community_name, origin FROM o),
k AS (SELECT * FROM b WHERE NOT (role = 'leader' AND (city, community_name) IN (SELECT (city, community_name) FROM l)) AND NOT (role = 'leader' AND origin IS NOT DISTINCT FROM 'leader_field' AND (city, community_name) IN (SELECT (city, name) FROM c)))
SELECT * FROM k UNION ALL SELECT name, city, role, community_name, 'leader_field' FROM l""")
def full_pass_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people after the same pass: those of pages, and the leaders that communities name."""
    return _pass(spark, sf_dir).people().select("name", "city", "role", "community_name", "origin")


@registry.add(f"""WITH {_NAMED}, d AS (SELECT DISTINCT url FROM s WHERE state IN ('ok', 'empty')) SELECT p_partkey AS url, CASE WHEN p_partkey IN (FROM d) THEN 'fp1' ELSE 'fp' || (p_partkey % 3) END AS fingerprint,
CASE WHEN p_partkey % 5 = 0 OR (p_partkey IN (FROM n) AND p_partkey % 9 <> 0 AND p_partkey % 10 <> 3) THEN 'vf1' WHEN p_partkey % 5 = 1 THEN 'vf0' END AS venue_fingerprint, CASE WHEN p_partkey % 6 = 1 OR (p_partkey IN (FROM n) AND p_partkey % 10 <> 0) THEN 'pf1' END AS person_fingerprint FROM part""")
def full_pass_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page cache after the same pass: what was extracted is marked, what failed is tried again."""
    return _pass(spark, sf_dir).pages().select("url", *MARKS.values())


@registry.add("""WITH p AS (SELECT DISTINCT l_orderkey AS pair, l_partkey AS url FROM lineitem), a AS (SELECT l_orderkey AS pair, l_partkey AS url, CAST(l_linenumber % 4 + 1 AS BIGINT) AS attempt, CASE WHEN l_returnflag <> 'R' THEN 'answer ' || l_suppkey END AS body FROM lineitem WHERE l_linenumber % 5 > 0),
e AS (SELECT o_orderkey AS pair, o_orderkey % 5 + 1 AS attempt, o_orderstatus AS reason FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 < 3), f AS (SELECT pair, url, min({'n': attempt, 'failed': body IS NULL, 'body': body}) AS a FROM a GROUP BY ALL),
j AS (SELECT p.pair, p.url, f.a, e.attempt AS stop, e.reason, f.a IS NOT NULL AND f.a.n <= coalesce(e.attempt, 3) AS answered FROM p LEFT JOIN f ON f.pair = p.pair AND f.url = p.url LEFT JOIN e ON e.pair = p.pair)
SELECT pair, url, CASE WHEN answered THEN CASE WHEN a.failed THEN 'failed' ELSE 'done' END WHEN stop IS NOT NULL THEN 'stopped' ELSE 'deferred' END AS state, CASE WHEN answered THEN a.n END AS attempt, CASE WHEN answered THEN a.body END AS body, CASE WHEN NOT answered THEN reason END AS reason FROM j""")
def extraction_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three rounds over the pages of each pair come to, where some pairs stop early."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pages = items.select(F.col("l_orderkey").alias("pair"), F.col("l_partkey").alias("url"))
    answers = items.filter("l_linenumber % 5 > 0").select(F.col("l_orderkey").alias("pair"), F.col("l_partkey").alias("url"), (F.col("l_linenumber") % 4 + 1).cast("long").alias("attempt"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("answer "), "l_suppkey")).alias("body"))
    stops = orders.filter("o_orderkey % 3 = 0 AND o_orderkey % 5 < 3").select(F.col("o_orderkey").alias("pair"), (F.col("o_orderkey") % 5 + 1).alias("attempt"), F.col("o_orderstatus").alias("reason"))
    return after_rounds(pages, answers, stops)


@registry.add("""WITH r AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN 'own' END AS website, CASE p_partkey % 5 WHEN 0 THEN 'desk' ELSE '' END AS contact FROM part), e AS (SELECT l_partkey AS key, l_linenumber - 1 AS pos, CASE WHEN l_discount > 0.05 THEN 'http://' || l_suppkey END AS website, CASE WHEN l_tax > 0.04 THEN 'tel ' || l_suppkey END AS contact, l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber <= 3),
h AS (SELECT key, arg_min({'w': website, 'c': contact}, pos * 1000000000000 + l_orderkey * 1000000 + l_suppkey * 100 + l_quantity) AS b FROM e WHERE pos < 2 AND (website IS NOT NULL OR contact IS NOT NULL) GROUP BY key)
SELECT r.key, coalesce(website, b.w) AS website, CASE WHEN contact <> '' THEN contact ELSE coalesce(b.c, contact) END AS contact FROM r LEFT JOIN h ON h.key = r.key""")
def record_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what the first helpful result adds."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("key"), F.when(k % 3 == 0, "own").alias("website"), F.when(k % 5 == 0, "desk").otherwise("").alias("contact"), F.array().cast("array<string>").alias("social_links"))
    items = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    place = (F.col("l_linenumber") - 1) * F.lit(1000000000000) + F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity")
    results = items.select(F.col("l_partkey").alias("key"), F.when(F.col("l_discount") > 0.05, F.concat(F.lit("http://"), "l_suppkey")).alias("website"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("tel "), "l_suppkey")).alias("contact"), F.lit(None).cast("array<string>").alias("social_links"), (F.col("l_linenumber") - 1).alias("pos"), place.alias("place"))
    return first_help(rows, results).select("key", "website", "contact")


@registry.add("""WITH c AS (SELECT doc_id AS key, text, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE source = 'src0'), p AS (SELECT * FROM c WHERE place <= 30), o AS (SELECT key, place, CASE WHEN length(coalesce(text, '')) < 300 THEN 'no_source' WHEN key % 7 = 0 THEN 'failed' WHEN key % 5 > 0 THEN 'enriched' ELSE 'skipped' END AS outcome FROM p),
b AS (SELECT *, coalesce(sum(CAST(outcome = 'enriched' AS INT)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM o) SELECT key, outcome FROM b WHERE n < 10""")
def enrichment_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of ten enrichments."""
    rows = table(spark, sf_dir, "documents").filter("source = 'src0'").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("place"), "text")
    results = rows.filter("key % 7 <> 0").select("key", F.lit("s").alias("short"), F.when(F.col("key") % 5 > 0, "long enough").otherwise("no").alias("long"))
    return enrichment_batch(rows, results, 10, lambda short, long: F.length(long) > 5)


@registry.add("""WITH u AS (SELECT n_name AS city, topic, n_regionkey FROM nation, (SELECT DISTINCT c_mktsegment AS topic FROM customer)), a AS (SELECT city, topic FROM u WHERE n_regionkey <> 2 OR topic = 'BUILDING'), m AS (SELECT n_name AS city, c_mktsegment AS topic, max(c_acctbal) AS best, min(c_acctbal) AS least FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT a.city, a.topic, CASE WHEN best > 5000 THEN 'extract' ELSE 'search' END AS step FROM a LEFT JOIN m ON m.city = a.city AND m.topic = a.topic WHERE coalesce(least, 0) > -900""")
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run does with each pair of the universe."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    cities = nation.select(F.col("n_name").alias("city"), F.when(F.col("n_regionkey") == 2, "core").otherwise("full").alias("tier"))
    pairs = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city"), F.col("c_mktsegment").alias("topic")).agg(F.max("c_acctbal").alias("best"), F.min("c_acctbal").alias("least"))
    return plan(universe_of(cities, customer.select(F.col("c_mktsegment").alias("topic")).distinct(), ["BUILDING"]), pairs.filter("best > 5000"), pairs.filter("least <= -900"))


@registry.add("""WITH s AS (SELECT l_orderkey AS pair, count(*) AS pages, count(*) FILTER (p_brand = 'Brand#13') AS current FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT o_orderkey AS pair, coalesce(pages, 0) AS pages, coalesce(current, 0) AS current, coalesce(pages > 0 AND pages = current, false) AS is_done FROM orders LEFT JOIN s ON pair = o_orderkey""")
def coverage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's pages, those of the current version, and whether it is done."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    counts = items.groupBy(F.col("l_orderkey").alias("pair")).agg(F.count("*").alias("pages"), F.count_if(F.col("p_brand") == "Brand#13").alias("current"))
    zero = F.lit(0).cast("long")
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair")).join(counts, "pair", "left").select("pair", F.coalesce("pages", zero).alias("pages"), F.coalesce("current", zero).alias("current"))
    return coverage(states, counts.filter("pages = current"), ["pair"])


@registry.add("""WITH s AS (SELECT l_orderkey AS pair, count(*) AS pages, count(*) FILTER (p_brand <= 'Brand#13') AS current FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), d AS (SELECT count(*) AS done FROM s WHERE pages = current) SELECT count(*) AS pairs, count(pair) AS searched, coalesce(sum(pages), 0)::BIGINT AS pages, any_value(done) AS done, count(*) - any_value(done) AS left_to_do FROM orders LEFT JOIN s ON pair = o_orderkey, d""")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole backlog: pairs, those searched, their pages, those done and those left."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = items.groupBy("l_orderkey").agg(F.count("*").alias("pages"), F.count_if(F.col("p_brand") <= "Brand#13").alias("current"))
    every = table(spark, sf_dir, "orders").select("o_orderkey").join(pairs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    done = F.count_if(F.col("pages") == F.col("current"))
    return every.agg(F.count("*").alias("pairs"), F.count("pages").alias("searched"), F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("pages"), done.alias("done"), (F.count("*") - done).alias("left_to_do"))


QUERIES, ORACLE = registry.queries, registry.oracle
