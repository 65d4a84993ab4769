"""Keyed changes of state as whole-table transformations: appends, imports, documents, enrichment marks, invalidation, deletes, moderation.

Each takes a table and what is to change and gives the new table, for one writer
to swap in. Times come in as values, so that a job that runs again gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators.directory import PEOPLE_SQL, RECORDS_SQL, people, records
from civicgrid.operators.records import SEPARATOR, clean_people, joined, known_text
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table
from civicgrid.sources.pages import pages_by_urls, write_pages
from civicgrid.sources.store import scratch

registry = Registry()
R, P = f"WITH {RECORDS_SQL}", f"WITH {PEOPLE_SQL}"
NOW = "2026-01-02 03:04:05"
EMPTY = "array<string>"


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``old`` replaced by ``new`` ones of the same key, of which the last by ``order`` counts; columns that ``new`` lacks keep their values."""
    one = new if order is None else new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    given = [c for c in one.columns if c not in keys and c in old.columns]
    marked = one.select(*keys, F.struct(F.lit(True).alias("_there"), *given).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(marked, keys, "full_outer")
    out = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns]
    return both.select(*out)


def append_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, each key once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True).select(*old.columns)


def delete_rows(old: DataFrame, where: Column) -> DataFrame:
    """``old`` without the rows for which ``where`` is true; unknown is not true."""
    return old.filter(~F.coalesce(where, F.lit(False)))


def run_states(events: DataFrame) -> DataFrame:
    """A row for each run of start and finish ``events`` (run, kind, at, pages, failed): the first start, the last finish, what it says; a run without one is running."""
    last = F.max_by(F.struct("at", "pages", "failed"), F.when(F.col("kind") == "finish", F.col("at"))).alias("f")
    runs = events.groupBy("run").agg(F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started"), last, F.bool_or(F.col("kind") == "finish").alias("ended"))
    state = F.when(~F.col("ended"), "running").when(F.col("f.failed") > 0, "failed").otherwise("ok")
    return runs.select("run", "started", F.when(F.col("ended"), F.col("f.at")).alias("finished"), F.when(F.col("ended"), F.col("f.pages")).alias("pages"), state.alias("state"))


@registry.add("""WITH e AS (SELECT user_id AS run, CASE WHEN event_type IN ('click', 'view') THEN 'start' ELSE 'finish' END AS kind, ts AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS pages, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM events WHERE user_id % 7 <> 0 OR event_type = 'view'),
g AS (SELECT run, min(t) FILTER (kind = 'start') AS started, max(t) FILTER (kind = 'finish') AS finished, arg_max(pages, t) FILTER (kind = 'finish') AS pages, arg_max(failed, t) FILTER (kind = 'finish') AS failed FROM e GROUP BY run)
SELECT run, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(finished, '%Y-%m-%d %H:%M:%S') AS finished, pages, CASE WHEN finished IS NULL THEN 'running' WHEN failed > 0 THEN 'failed' ELSE 'ok' END AS state FROM g""")
def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from their start and finish events."""
    kind = F.when(F.col("event_type").isin("click", "view"), "start").otherwise("finish")
    rows = table(spark, sf_dir, "events").filter("user_id % 7 <> 0 OR event_type = 'view'")
    out = run_states(rows.select(F.col("user_id").alias("run"), kind.alias("kind"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("pages"), (F.col("event_type") == "error").cast("int").alias("failed")))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started", "finished")})


@registry.add("""WITH o AS (SELECT p_partkey AS version, p_name AS prompt FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS version, upper(p_name) AS prompt FROM part WHERE p_partkey % 2 = 0) SELECT version, prompt FROM o UNION ALL SELECT version, prompt FROM n WHERE version NOT IN (SELECT version FROM o)""")
def imported_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that only adds versions that aren't there."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version"), F.col("p_name").alias("prompt"))
    return append_missing(rows.filter("version % 3 <> 0"), rows.filter("version % 2 = 0").withColumn("prompt", F.upper("prompt")), ["version"])


@registry.add("""WITH o AS (SELECT DISTINCT p_name AS name, p_brand AS city, 'old' AS reason, 1 AS seen FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_name AS name, p_brand AS city, max(p_partkey) AS k FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL)
SELECT coalesce(o.name, n.name) AS name, coalesce(o.city, n.city) AS city, CASE WHEN n.k IS NULL THEN reason ELSE 'new ' || k END AS reason, seen FROM o FULL OUTER JOIN n ON o.name = n.name AND o.city = n.city""")
def upserted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table after an import by upsert: the last of the incoming rows counts, other columns stay."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("city"), "p_partkey")
    old = rows.filter("p_partkey % 3 <> 0").select("name", "city").distinct().select("name", "city", F.lit("old").alias("reason"), F.lit(1).alias("seen"))
    new = rows.filter("p_partkey % 4 = 0").select("name", "city", F.concat(F.lit("new "), F.col("p_partkey")).alias("reason"), "p_partkey")
    return upsert_rows(old, new, ["name", "city"], "p_partkey")


# cached pages -----------------------------------------------------------------

PAGE = ("raw_text", "scraped_at", "records", "extract_fingerprint", "extract_model", "enrich_model", "enrich_count", "person_fingerprint", "persons")
#: What goes when an extraction is invalidated, and when people are asked for anew.
EXTRACTION = ("records", "extract_fingerprint", "extract_model", "enrich_model", "enrich_count")
PERSONS = ("person_fingerprint", "persons")


def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cached pages: url, hash, pair and the document as a struct."""
    k = F.col("p_partkey")
    records_of = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.concat(F.col("p_name"), F.lit(" "), i.cast("string"))))
    data = F.struct(
        F.when(k % 5 > 0, F.repeat(F.concat("p_name", F.lit(" ")), (k % 40).cast("int"))).alias("raw_text"), F.when(k % 5 > 0, F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd")).alias("scraped_at"), records_of.alias("records"),
        F.when(k % 4 > 0, F.concat(F.lit("fp"), (k % 3).cast("string"))).alias("extract_fingerprint"), F.when(k % 4 > 1, F.col("p_type")).alias("extract_model"), F.when(k % 6 == 2, F.col("p_type")).alias("enrich_model"), (k % 7).alias("enrich_count"),
        F.when(k % 3 == 0, F.lit("pf")).alias("person_fingerprint"), F.when(k % 3 == 0, F.array("p_name")).alias("persons"))
    url = F.concat(F.lit("http://src.example/"), k)
    return table(spark, sf_dir, "part").select(url.alias("url"), T.url_hash(url).alias("url_hash"), F.col("p_brand").alias("city"), F.col("p_type").alias("topic"), data.alias("data"))


_PAGES = """pages_of AS (SELECT p_partkey AS k, 'http://src.example/' || p_partkey AS url, left(sha256('http://src.example/' || p_partkey), 16) AS url_hash, p_brand AS city, p_type AS topic, CASE WHEN p_partkey % 5 > 0 THEN repeat(p_name || ' ', CAST(p_partkey % 40 AS INTEGER)) END AS raw_text,
  CASE WHEN p_partkey % 5 > 0 THEN strftime(DATE '2026-01-01' + CAST(p_partkey % 28 AS INTEGER), '%Y-%m-%d') END AS scraped_at, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS n_records, CASE WHEN p_partkey % 4 > 0 THEN 'fp' || p_partkey % 3 END AS extract_fingerprint,
  CASE WHEN p_partkey % 4 > 1 THEN p_type END AS extract_model, CASE WHEN p_partkey % 6 = 2 THEN p_type END AS enrich_model, CASE WHEN p_partkey % 3 = 0 THEN 'pf' END AS person_fingerprint, p_name FROM part)"""
PG = f"WITH {_PAGES}"


@registry.add(f"{PG} SELECT url_hash, city, topic, scraped_at, extract_model, coalesce(n_records, 0) AS n_records, raw_text IS NOT NULL AS has_text FROM pages_of")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's index: fields of the documents, but no text and no record leaves the scan."""
    return cached_pages(spark, sf_dir).select("url_hash", "city", "topic", "data.scraped_at", "data.extract_model", F.coalesce(F.when(F.col("data.records").isNotNull(), F.size("data.records")), F.lit(0)).cast("long").alias("n_records"), F.col("data.raw_text").isNotNull().alias("has_text"))


@registry.add(f"{PG} SELECT url_hash, url, length(raw_text) AS n FROM pages_of WHERE scraped_at IS NOT NULL AND raw_text <> ''")
def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with their texts."""
    return cached_pages(spark, sf_dir).filter("data.scraped_at IS NOT NULL AND data.raw_text <> ''").select("url_hash", "url", F.length("data.raw_text").alias("n"))


@registry.add(f"{PG} SELECT url, city, raw_text FROM pages_of WHERE url_hash = left(sha256('http://src.example/11'), 16)")
def page_lookup(spark: SparkSession, sf_dir: str, url: str = "http://src.example/11") -> DataFrame:
    """One page by its hash."""
    return cached_pages(spark, sf_dir).filter(F.col("url_hash") == T.url_hash(F.lit(url))).select("url", "city", "data.raw_text")


@registry.add(f"{PG} SELECT url, city, topic, raw_text FROM pages_of WHERE k IN (11, 30, 77)")
def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of a cache whose files lie in the order of their hash."""
    pages = cached_pages(spark, sf_dir).select("url_hash", "url", "city", "topic", "data.raw_text", "data.scraped_at")
    folder = scratch(spark, "pages")
    write_pages(pages, folder, 4, 100_000)
    return pages_by_urls(spark, folder, [f"http://src.example/{k}" for k in (11, 30, 77)]).select("url", "city", "topic", "raw_text")


@registry.add(f"""{R}, {PEOPLE_SQL} SELECT 'community' AS entity, id, name FROM records WHERE id = 7 UNION ALL SELECT 'venue', id, name FROM records WHERE left(sha256(lower(name) || '|' || lower(city)), 12) = (SELECT left(sha256(lower(name) || '|' || lower(city)), 12) FROM records WHERE id = 8) UNION ALL SELECT 'person', id, name FROM people WHERE id = 9""")
def entity_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of records by their keys."""
    rows = records(spark, sf_dir)
    keyed = rows.withColumn("key", T.entity_id(F.col("name"), F.col("city")))
    venue = keyed.join(F.broadcast(keyed.filter("id = 8").select("key")), "key", "left_semi").select(F.lit("venue").alias("entity"), "id", "name")  # one key
    return rows.filter("id = 7").select(F.lit("community").alias("entity"), "id", "name").union(venue).union(people(spark, sf_dir).filter("id = 9").select(F.lit("person").alias("entity"), "id", "name"))


def update_documents(pages: DataFrame, updates: DataFrame, drop: tuple[str, ...] = (), create: bool = False) -> DataFrame:
    """``pages`` (url_hash and data) after ``updates`` (url_hash, data with some of the fields): given fields are set, ``drop`` ones emptied first; unknown pages come in with ``create``."""
    fields = pages.schema["data"].dataType.fieldNames()
    given = updates.schema["data"].dataType.fieldNames()
    both = pages.join(updates.select("url_hash", F.col("data").alias("_u"), F.lit(True).alias("_hit")), "url_hash", "full_outer" if create else "left")
    kind = {f.name: f.dataType for f in pages.schema["data"].dataType.fields}
    base = {f: F.when(F.col("_hit"), F.lit(None).cast(kind[f])).otherwise(F.col(f"data.{f}")) if f in drop else F.col(f"data.{f}") for f in fields}
    after = F.struct(*[(F.when(F.col("_hit"), F.col(f"_u.{f}")).otherwise(base[f]) if f in given else base[f]).alias(f) for f in fields])
    return both.withColumn("data", after).select(*pages.columns)


def invalidate_extractions(pages: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """``pages`` without what was extracted from them, all or those of ``hashes`` (url_hash); their texts stay."""
    every = pages.select("url_hash") if hashes is None else hashes.select("url_hash").distinct()
    return update_documents(pages, every.withColumn("data", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema["data"].dataType.fields if f.name in EXTRACTION])))


@registry.add(f"""{PG}, s AS (SELECT k % 11 = 0 AS hit, * FROM pages_of) SELECT url_hash, CASE WHEN hit THEN 'new text ' || k ELSE raw_text END AS raw_text, CASE WHEN NOT hit THEN extract_fingerprint END AS extract_fingerprint, extract_model FROM s
UNION ALL SELECT left(sha256('http://new.example/'), 16), 'new text', NULL, NULL""")
def updated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after new texts came in: their fingerprints go, other fields stay."""
    pages = cached_pages(spark, sf_dir)
    number = F.regexp_extract("url", "([0-9]+)$", 1)
    new = pages.filter(number.cast("long") % 11 == 0).select("url_hash", F.struct(F.concat(F.lit("new text "), number).alias("raw_text")).alias("data"))
    extra = spark.range(1).select(T.url_hash(F.lit("http://new.example/")).alias("url_hash"), F.struct(F.lit("new text").alias("raw_text")).alias("data"))
    return update_documents(pages, new.union(extra), ("extract_fingerprint",), True).select("url_hash", "data.raw_text", "data.extract_fingerprint", "data.extract_model")


@registry.add(f"""{PG}, hit AS (SELECT url_hash FROM pages_of WHERE city = 'Brand#7' AND topic = 'ECONOMY' UNION SELECT left(sha256('http://src.example/' || l_partkey), 16) FROM lineitem WHERE l_orderkey = 5 UNION SELECT left(sha256('http://src.example/3'), 16))
SELECT url_hash, CASE WHEN url_hash NOT IN (FROM hit) THEN extract_fingerprint END AS extract_fingerprint, CASE WHEN url_hash NOT IN (FROM hit) THEN n_records END AS n_records, length(raw_text) AS n_text, person_fingerprint FROM pages_of""")
def invalidated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair's extractions go: by the pages' own pair, by its search results, by a submitted address."""
    pages = cached_pages(spark, sf_dir)
    found = table(spark, sf_dir, "lineitem").filter("l_orderkey = 5").select(T.url_hash(F.concat(F.lit("http://src.example/"), F.col("l_partkey"))).alias("url_hash"))
    hashes = pages.filter("city = 'Brand#7' AND topic = 'ECONOMY'").select("url_hash").union(found).union(spark.range(1).select(T.url_hash(F.lit("http://src.example/3")).alias("url_hash")))
    out = invalidate_extractions(pages, hashes)
    return out.select("url_hash", "data.extract_fingerprint", F.when(F.col("data.records").isNotNull(), F.size("data.records")).cast("long").alias("n_records"), F.length("data.raw_text").alias("n_text"), "data.person_fingerprint")


@registry.add(f"""{PG} SELECT url_hash, CASE WHEN k % 5 = 1 THEN 'fp new' ELSE extract_fingerprint END AS extract_fingerprint, CASE WHEN k % 5 = 1 THEN 1 ELSE n_records END AS n_records, CASE WHEN k % 4 = 2 THEN 'helper' WHEN k % 5 <> 1 THEN enrich_model END AS enrich_model,
  CASE WHEN k % 4 = 2 THEN (CASE WHEN k % 5 = 1 THEN 0 ELSE k % 7 END) + 1 WHEN k % 5 <> 1 THEN k % 7 END AS enrich_count, CASE WHEN k % 3 = 1 THEN 'pf new' ELSE person_fingerprint END AS person_fingerprint, CASE WHEN k % 3 = 1 THEN 'Ana Kis' WHEN k % 3 = 0 THEN p_name END AS person FROM pages_of""")
def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after the writes of each stage: an extraction, which empties what enrichment left; people; marks of enrichment, which count on."""
    pages = cached_pages(spark, sf_dir)
    number = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    part = lambda df, n, rest, *fields: df.filter(number % n == rest).select("url_hash", F.struct(*fields).alias("data"))
    saved = update_documents(pages, part(pages, 5, 1, F.array(F.lit("one")).alias("records"), F.lit("fp new").alias("extract_fingerprint")), ("enrich_model", "enrich_count"))
    saved = update_documents(saved, part(saved, 3, 1, F.array(F.lit("Ana Kis")).alias("persons"), F.lit("pf new").alias("person_fingerprint")))
    saved = update_documents(saved, part(saved, 4, 2, F.lit("helper").alias("enrich_model"), (F.coalesce("data.enrich_count", F.lit(0)) + 1).alias("enrich_count")))
    return saved.select("url_hash", "data.extract_fingerprint", F.size("data.records").cast("long").alias("n_records"), "data.enrich_model", F.col("data.enrich_count").cast("long").alias("enrich_count"), "data.person_fingerprint", F.get("data.persons", F.lit(0)).alias("person"))


# records ----------------------------------------------------------------------


def enriched(rows: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """``rows`` (key, short_description, long_description, enrich_attempted_at, updated_at and more) after ``results`` (key, short, long): both texts are set and the record counts as changed; a result without a long text only marks the attempt."""
    both = rows.join(results.select("key", F.col("short").alias("_s"), F.col("long").alias("_l"), F.lit(True).alias("_hit")), "key", "left")
    ok, tried = known_text(F.col("_l")).isNotNull(), F.coalesce("_hit", F.lit(False))
    set_to = {"short_description": (ok, F.col("_s")), "long_description": (ok, F.col("_l")), "updated_at": (ok, F.lit(now)), "enrich_attempted_at": (tried & ~ok, F.lit(now))}
    return both.withColumns({c: F.when(F.coalesce(when, F.lit(False)), value).otherwise(F.col(c)) for c, (when, value) in set_to.items()}).select(*rows.columns)


@registry.add(f"""{R} SELECT id AS key, CASE WHEN id % 4 = 0 THEN 'short ' || id END AS short_description, CASE WHEN id % 4 = 0 THEN 'long ' || id END AS long_description, CASE WHEN id % 4 = 1 THEN '{NOW}' ELSE 'never' END AS enrich_attempted_at, CASE WHEN id % 4 = 0 THEN '{NOW}' ELSE 'old' END AS updated_at FROM records""")
def enrichment_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after a round of enrichment: written, tried in vain, not asked."""
    none = F.lit(None).cast("string")
    rows = records(spark, sf_dir).select(F.col("id").alias("key"), none.alias("short_description"), none.alias("long_description"), F.lit("never").alias("enrich_attempted_at"), F.lit("old").alias("updated_at"))
    results = rows.filter("key % 4 < 2").select("key", F.concat(F.lit("short "), F.col("key")).alias("short"), F.when(F.col("key") % 4 == 0, F.concat(F.lit("long "), F.col("key"))).otherwise(" ").alias("long"))
    return enriched(rows, results, NOW)


#: Fields that change without any content changing.
VOLATILE = ("extracted_at", "enrich_attempted_at")
#: Fields that an extraction doesn't write and so mustn't lose.
PRESERVED = ("short_description", "long_description")


def content(row: Column, fields: list[str], arrays: tuple[str, ...]) -> Column:
    """What a record says, empty being unknown, as one value."""
    return F.struct(*[(F.when(F.size(row[f]) > 0, row[f]) if f in arrays else F.when(row[f].cast("string") != "", row[f].cast("string"))).alias(f) for f in fields if f not in VOLATILE])


def upsert_records(old: DataFrame, new: DataFrame, now: str, arrays: tuple[str, ...] = ("source_urls", "social_links", "tags")) -> DataFrame:
    """Records (key, source_url, source_urls, updated_at and fields) after an extraction brought ``new`` ones.

    Sources are joined, the new ones first; enriched texts stay where none came in;
    the date moves only where the content changed. Other records stay as they are.
    """
    fields = [c for c in old.columns if c not in ("key", "updated_at")]
    none = F.array().cast(EMPTY)
    both = old.select("key", "updated_at", F.struct(*fields).alias("o")).join(new.select("key", F.struct(*[c for c in fields if c in new.columns]).alias("n")), "key", "full_outer")
    sources = lambda s: T.with_source(F.coalesce(F.col(f"{s}.source_urls"), none), F.col(f"{s}.source_url"))
    urls = F.when(F.col("o").isNull(), F.col("n.source_urls")).otherwise(F.array_distinct(F.concat(sources("n"), sources("o"))))
    taken = {f: F.col(f"n.{f}") if f in new.columns else F.lit(None).cast(old.schema[f].dataType) for f in fields}
    taken["source_urls"] = urls
    for f in PRESERVED:
        if f in fields:
            taken[f] = F.coalesce(known_text(taken[f]), F.col(f"o.{f}"))
    merged = both.withColumn("m", F.when(F.col("n").isNull(), F.col("o")).otherwise(F.struct(*[taken[f].alias(f) for f in fields])))
    same = F.col("o").isNotNull() & content(F.col("m"), fields, arrays).eqNullSafe(content(F.col("o"), fields, arrays))
    return merged.select("key", "m.*", F.when(F.col("n").isNull() | (same & F.col("updated_at").isNotNull()), F.col("updated_at")).otherwise(F.lit(now)).alias("updated_at")).select(*old.columns)


def field_changes(old: DataFrame, new: DataFrame, fields: list[str], label: str = "name") -> DataFrame:
    """key, field, old_value, new_value: a row for each field that differs, empty being unknown, and a marker with the name for each new record."""
    text = lambda side, f: F.when(known_text(_as_text(side, f, old)).isNotNull(), _as_text(side, f, old))
    both = new.select("key", F.struct(*fields, label).alias("n")).join(old.select("key", F.struct(*fields).alias("o")), "key", "left")
    rows = [F.struct(F.lit(f).alias("field"), text("o", f).alias("old_value"), text("n", f).alias("new_value"), (F.col("o").isNotNull() & ~text("o", f).eqNullSafe(text("n", f))).alias("keep")) for f in fields]
    rows.append(F.struct(F.lit("__created__").alias("field"), F.lit(None).cast("string").alias("old_value"), F.col(f"n.{label}").alias("new_value"), F.col("o").isNull().alias("keep")))
    return both.select("key", F.explode(F.array(*rows)).alias("c")).filter("c.keep").select("key", "c.field", "c.old_value", "c.new_value")


def _as_text(side: str, field: str, like: DataFrame) -> Column:
    kind = like.schema[field].dataType.typeName()
    column = F.col(f"{side}.{field}")
    if kind == "array":
        return F.when(F.size(column) > 0, F.to_json(column))
    return column.cast("string")


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, sf_dir).select(F.col("id").alias("key"), "name", "description", "source_url", "source_urls", "social_links")
    old = rows.filter("key % 3 <> 0").withColumns({"short_description": F.when(F.col("key") % 2 == 0, F.lit("kept")), "extracted_at": F.lit("then"), "updated_at": F.lit("2025-12-31 00:00:00"), "source_urls": F.expr("CASE WHEN key % 10 = 2 THEN array(source_url, element_at(source_urls, 1)) ELSE source_urls END")})
    new = rows.filter("key % 5 < 3").withColumns({"description": F.when(F.col("key") % 5 == 1, F.lit("changed")).otherwise(F.col("description")), "extracted_at": F.lit("now"), "source_urls": F.expr("CASE WHEN key % 10 = 2 THEN array(source_url, element_at(source_urls, 1)) ELSE source_urls END"), "social_links": F.when(F.col("key") % 5 == 0, F.array().cast(EMPTY)).otherwise(F.col("social_links"))})
    return old, new


_OLD_NEW = f"""{R}, rr AS (SELECT id AS key, name, description, source_url, CASE WHEN id % 10 = 2 THEN [source_url, source_urls[1]] ELSE source_urls END AS source_urls, social_links FROM records),
o AS (SELECT *, CASE WHEN key % 2 = 0 THEN 'kept' END AS short_description FROM rr WHERE key % 3 <> 0), n AS (SELECT * REPLACE (CASE WHEN key % 5 = 1 THEN 'changed' ELSE description END AS description, CASE WHEN key % 5 = 0 THEN [] ELSE social_links END AS social_links) FROM rr WHERE key % 5 < 3)"""
_all = lambda t: f"CASE WHEN list_contains({t}.source_urls, {t}.source_url) THEN {t}.source_urls ELSE list_concat([{t}.source_url], {t}.source_urls) END"


@registry.add(f"""{_OLD_NEW}, j AS (SELECT coalesce(o.key, n.key) AS key, o.key IS NULL AS fresh, n.key IS NULL AS untouched, CASE WHEN n.key IS NULL THEN o.description ELSE n.description END AS description, short_description, CASE WHEN n.key IS NULL THEN o.source_urls WHEN o.key IS NULL THEN n.source_urls ELSE list_concat({_all('n')}, {_all('o')}) END AS every, o.source_urls AS before, o.description AS said, n.social_links AS links, o.social_links AS linked FROM o FULL OUTER JOIN n ON o.key = n.key),
u AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS urls FROM j)
SELECT key, description, short_description, array_to_string(CASE WHEN untouched OR fresh THEN every ELSE urls END, '{SEPARATOR}') AS source_urls, CASE WHEN untouched OR (NOT fresh AND nullif(said, '') IS NOT DISTINCT FROM nullif(description, '') AND urls = before AND links = linked) THEN '2025-12-31 00:00:00' ELSE '{NOW}' END AS updated_at FROM u""")
def upserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after an extraction: dates move only with the content."""
    out = upsert_records(*_old_new(spark, sf_dir), NOW)
    return out.select("key", "description", "short_description", joined("source_urls"), "updated_at")


@registry.add(f"""{_OLD_NEW}, j AS (SELECT n.key, n.name, o.key IS NULL AS fresh, o.description AS od, n.description AS nd, o.social_links AS ol, n.social_links AS nl FROM n LEFT JOIN o ON o.key = n.key)
SELECT key, '__created__' AS field, NULL AS old_value, name AS new_value FROM j WHERE fresh UNION ALL SELECT key, 'description', od, nd FROM j WHERE NOT fresh AND od IS DISTINCT FROM nd
UNION ALL SELECT key, 'social_links', CAST(to_json(ol) AS VARCHAR), CASE WHEN len(nl) > 0 THEN CAST(to_json(nl) AS VARCHAR) END FROM j WHERE NOT fresh AND ol <> nl""")
def record_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history rows of the same extraction."""
    old, new = _old_new(spark, sf_dir)
    return field_changes(old, new, ["description", "social_links"])


# deletes ----------------------------------------------------------------------


def reset_city(tables: dict[str, DataFrame], city: str) -> dict[str, DataFrame]:
    """All tables without the rows of one city."""
    return {name: delete_rows(rows, F.col("city") == city) for name, rows in tables.items()}


def without_stale_leaders(persons: DataFrame, communities: DataFrame, only_derived: bool = False) -> DataFrame:
    """``persons`` without the leaders of some communities (city, community_name), perhaps only those that were derived from a leader field."""
    leads = F.coalesce((F.col("role") == "leader") & ((F.col("origin") == "leader_field") if only_derived else F.lit(True)), F.lit(False))
    hit = communities.select("city", "community_name").distinct().withColumn("_hit", F.lit(True))
    return persons.join(hit, ["city", "community_name"], "left").filter(~(leads & F.coalesce("_hit", F.lit(False)))).select(*persons.columns)


@registry.add(f"""{R}, {PEOPLE_SQL} SELECT 'communities' AS entity, count(*) AS n FROM records WHERE city <> 'Brand#7' UNION ALL SELECT 'people', count(*) FROM people WHERE city <> 'Brand#7' UNION ALL SELECT 'visible', count(*) FROM records WHERE NOT (city = 'Brand#7' AND topic = 'ECONOMY') AND NOT hidden""")
def city_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after a city is reset, and after a pair is deleted."""
    rows = records(spark, sf_dir)
    tables = reset_city({"communities": rows, "people": people(spark, sf_dir)}, "Brand#7") | {"visible": delete_rows(rows, (F.col("city") == "Brand#7") & (F.col("topic") == "ECONOMY") | F.col("hidden"))}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    return counts[0].union(counts[1]).union(counts[2])


@registry.add(f"{P} SELECT id, role FROM people WHERE NOT (role = 'leader' AND origin IS NOT DISTINCT FROM 'leader_field' AND community_name LIKE 'building%')")
def leaders_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People after the derived leaders of some communities were cleared."""
    rows = people(spark, sf_dir)
    return without_stale_leaders(rows, rows.filter("community_name LIKE 'building%'"), True).select("id", "role")


def leaders_as_people(communities: DataFrame) -> DataFrame:
    """People named in the leader fields of ``communities`` (community_id, name, city, topic, leader, source_url), in the people's own form."""
    rows = communities.filter(known_text(F.col("leader")).isNotNull()).select("community_id", F.col("name").alias("community_name"), "city", "topic", "source_url", F.explode(T.leaders(F.col("leader"))).alias("p"))
    out = rows.select("community_id", "community_name", "city", "topic", "source_url", F.col("p.name").alias("name"), F.lit("leader").alias("role"), known_text(F.col("p.role")).alias("bio"), F.lit("leader_field").alias("origin"), F.array().cast(EMPTY).alias("source_urls"))
    return clean_people(out)


@registry.add(f"""{R}, l AS (SELECT id, name, topic, city, source_url, unnest([{{'n': 'Ana Kis', 'r': 'chair'}}, {{'n': 'Dr. Bo Nagy', 'r': ''}}, {{'n': 'Ede Tar', 'r': ''}}]) AS p FROM records WHERE id % 4 = 0 UNION ALL SELECT id, name, topic, city, source_url, {{'n': 'Éva ' || name, 'r': ''}} FROM records WHERE id % 4 = 1 AND NOT contains(name, ','))
SELECT id, p.n AS name, nullif(p.r, '') AS bio FROM l WHERE id % 6 <> 0""")
def derived_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People from leader fields."""
    rows = records(spark, sf_dir).filter("id % 6 <> 0").withColumn("leader", F.regexp_replace("leader", r"\([A-Z ]+\)$", "")).withColumnRenamed("id", "community_id")
    return leaders_as_people(rows).select(F.col("community_id").alias("id"), "name", "bio")


# moderation -------------------------------------------------------------------


def approve_reports(rows: DataFrame, reports: DataFrame, false_positives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, open reports, false positives) after reports (id, name, city, topic, approved) were judged: an approved one hides its record, becomes a false positive and goes."""
    keys = ["name", "city", "topic"]
    approved = reports.filter("approved")
    hit = approved.select(*keys, F.lit(True).alias("_hit")).distinct()
    hidden = rows.join(hit, keys, "left").withColumn("hidden", F.col("hidden") | F.coalesce("_hit", F.lit(False))).select(*rows.columns)
    return hidden, delete_rows(reports, F.col("approved")), append_missing(false_positives, approved.select(*keys), keys)


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = records(spark, sf_dir).select("id", "name", "city", "topic", "hidden")
    reports = rows.filter("id % 9 = 0").select("id", "name", "city", "topic", F.when(F.col("id") % 2 == 0, True).when(F.col("id") % 7 == 0, F.lit(None).cast("boolean")).otherwise(False).alias("approved"))
    return approve_reports(rows, reports, rows.filter("id % 18 = 0 AND id < 100").select("name", "city", "topic").distinct())


@registry.add(f"""{R}, a AS (SELECT DISTINCT name, city, topic FROM records WHERE id % 18 = 0) SELECT id, hidden OR (name, city, topic) IN (SELECT (name, city, topic) FROM a) AS hidden, id % 9 = 0 AND id % 2 <> 0 AS reported FROM records""")
def moderated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after moderation, and whether a report of them is still open."""
    rows, reports, _ = _judged(spark, sf_dir)
    return rows.join(reports.select("id", F.lit(True).alias("open")), "id", "left").select("id", "hidden", F.coalesce("open", F.lit(False)).alias("reported"))


@registry.add(f"{R} SELECT DISTINCT name, city, topic FROM records WHERE id % 18 = 0")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The false positives after the same moderation."""
    return _judged(spark, sf_dir)[2]


def merged_by_model(rows: DataFrame, answers: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` (key, loser, source_urls and ``fields``) with what a model wrote for a merge (``answers``: key and ``fields``): its texts replace others where it gave any. The call itself is the caller's."""
    both = rows.join(answers.select("key", *[F.col(f).alias(f"_{f}") for f in fields]), "key", "left")
    return both.withColumns({f: F.coalesce(known_text(F.col(f"_{f}")), F.col(f)) for f in fields}).select(*rows.columns)


@registry.add(f"{R} SELECT id AS key, CASE WHEN id % 5 = 0 THEN 'better ' || id ELSE description END AS description, contact FROM records")
def model_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after a model's answers for some of them."""
    rows = records(spark, sf_dir).select(F.col("id").alias("key"), "description", "contact")
    answers = rows.filter("key % 5 < 2").select("key", F.when(F.col("key") % 5 == 0, F.concat(F.lit("better "), F.col("key"))).otherwise("").alias("description"), F.lit(None).cast("string").alias("contact"))
    return merged_by_model(rows, answers, ["description", "contact"])


def person_pages(rows: DataFrame) -> DataFrame:
    """A row for each person (name, city) and community (community_name, topic): roles in their order, the first known bio and site, links in order of appearance."""
    first = lambda c: F.min_by(known_text(F.col(c)), F.when(known_text(F.col(c)).isNotNull(), F.col("id"))).alias(c)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(c).alias("x")))), lambda r: r["x"])
    return rows.groupBy("name", "city", "community_name", "topic").agg(F.array_distinct(ordered("role")).alias("roles"), first("bio"), first("website"), F.array_distinct(F.flatten(ordered("social_links"))).alias("social_links"))


@registry.add(f"""{P}, g AS (SELECT name, city, community_name, topic, list(role ORDER BY id) AS r, flatten(list(social_links ORDER BY id)) AS l, arg_min(bio, id) FILTER (bio <> '') AS bio FROM people GROUP BY ALL)
SELECT name, city, community_name, topic, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS roles, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '{SEPARATOR}') AS social_links, bio FROM g""")
def person_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People's pages."""
    return person_pages(people(spark, sf_dir)).select("name", "city", "community_name", "topic", F.array_join("roles", ",").alias("roles"), joined("social_links"), "bio")


@registry.add("SELECT s_suppkey AS id, s_name AS name, n_name AS city FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def all_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All venues in order."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("city")).orderBy("city", "id")


def people_of(rows: DataFrame, city: str, topic: str | None = None) -> DataFrame:
    """People of a city in order of topic and id, of a topic in order of id."""
    some = rows.filter(F.col("city") == city)
    return some.orderBy("topic", "id") if topic is None else some.filter(F.col("topic") == topic).orderBy("id")


@registry.add(f"{P} SELECT id, name, topic FROM people WHERE city = 'city 3' UNION ALL SELECT id, name, topic FROM people WHERE city = 'city 4' AND topic = 'BUILDING'")
def people_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of a city, and of a city and topic."""
    rows = people(spark, sf_dir).select("id", "name", "topic", "city")
    return people_of(rows, "city 3").union(people_of(rows, "city 4", "BUILDING")).select("id", "name", "topic")


@registry.add(f"""{P}, h AS (SELECT user_id AS person, count(*) AS changes, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1) SELECT id, name, coalesce(changes, 0) AS changes, last FROM people LEFT JOIN h ON person = id""")
def people_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All people with the number of their changes and the last one."""
    changes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("changes"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))
    return people(spark, sf_dir).join(changes, "id", "left").select("id", "name", F.coalesce("changes", F.lit(0).cast("long")).alias("changes"), "last")


QUERIES, ORACLE = registry.queries, registry.oracle
