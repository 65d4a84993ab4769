"""Sources and sinks: JSON folders, nested search responses, logs, catalogues, dated snapshots, sitemaps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMUNITY = "name string, city string, topic string, locale string, website string, description string, contact string, location string, meeting_schedule string, fee string, tags array<string>, social_links array<string>, source_url string, extracted_at timestamp, hidden boolean"
PAGE = "url string, city string, topic string, scraped_at timestamp, raw_text string, extract_fingerprint string, records array<struct<name:string,locale:string>>, persons_data map<string,array<struct<name:string,role:string>>>"
RESPONSE = "tasks array<struct<status_code:int,result:array<struct<items:array<struct<type:string,url:string,title:string,description:string,rank_absolute:int>>>>>>"


def json_folder(spark: SparkSession, path: str, schema: str, many: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, broken files' lines) of the JSON files at ``path``; ``stem`` is the file's name without its ending.

    Whole documents by default, one to a line with ``many``. What doesn't parse is set apart instead of failing.
    """
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", not many)
    # an explicit projection keeps the corrupt column next to others, as Spark asks for
    rows = reader.json(path).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?(\.gz)?$", 1))
    names = [c for c in rows.columns if c not in ("_corrupt_record", "stem")]
    broken = F.col("_corrupt_record").isNotNull()
    return rows.filter(~broken).select(*names, "stem"), rows.filter(broken).select(*names[:1], "_corrupt_record", "stem")


def search_results(responses: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Organic results of nested search responses in their order, those without an address left out."""
    keep = keep or []
    parsed = responses.select(*keep, F.from_json(body, RESPONSE).alias("r"))
    tasks = parsed.select(*keep, F.explode("r.tasks").alias("t")).select(*keep, F.explode("t.result").alias("x"))
    items = tasks.select(*keep, F.posexplode("x.items").alias("pos", "i"))
    return items.filter((F.col("i.type") == "organic") & (F.coalesce("i.url", F.lit("")) != "")).select(*keep, "pos", "i.url", "i.title", F.col("i.description").alias("snippet"))


LOG = "seq long, ts timestamp, level string, event string, extra map<string,string>"


def matching_lines(rows: DataFrame, level: str | None, needle: str | None) -> DataFrame:
    """Log lines of a level with a text anywhere in them."""
    if level:
        rows = rows.filter(F.upper("level") == level.upper())
    return rows.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(needle.lower()))) if needle else rows


def rotated_files(spark: SparkSession, path: str) -> list[list[str]]:
    """The files at ``path`` from the newest on: a log without a number first, then its rotations by their numbers; of several logs those of one age together."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    ages: dict[int, list[str]] = {}
    for name in (s.getPath().toString() for s in found):
        number = re.search(r"\.(\d+)(\.gz)?$", name)
        ages.setdefault(int(number[1]) if number else 0, []).append(name)
    return [sorted(ages[age]) for age in sorted(ages)]


def log_lines(spark: SparkSession, path: str, level: str | None = None, needle: str | None = None, limit: int = 500) -> DataFrame:
    """The newest ``limit`` lines (1 to 5000) of rotated JSON-lines logs that match, oldest first.

    Files are read from the newest on, twice as many at each step, until they hold as many
    lines: a rotated file has no line that is newer than one of a file after it. Where one
    log's lines overlap another's, only those of the same number of rotations are compared.
    """
    limit, files, step, rows = min(max(limit, 1), 5000), rotated_files(spark, path), 1, None
    while files:
        some, files = [f for age in files[:step] for f in age], files[step:]
        read = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(some)
        older = matching_lines(read, level, needle).orderBy(F.desc("ts"), F.desc("seq")).limit(limit)
        found = older.collect()  # at most 5000 lines, which are the result
        rows, limit, step = (rows or []) + found, limit - len(found), 2 * step
        if limit <= 0:
            break
    return spark.createDataFrame(rows or [], LOG).orderBy("ts", "seq")


def log_text(event: Column, extra: Column) -> Column:
    """A line with its extras as k=v."""
    pairs = F.transform(F.array_sort(F.map_entries(extra)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("  ", event, F.array_join(pairs, " "))


def model_catalogue(providers: DataFrame) -> DataFrame:
    """A row for each usable model (provider, models array<struct<model,quality string>>): qualities within 0 to 100, malformed rows dropped, best first."""
    rows = providers.select("provider", F.explode("models").alias("m")).select("provider", "m.model", F.expr("try_cast(m.quality AS int)").alias("quality"))
    usable = rows.filter(F.col("model").isNotNull() & (F.trim("model") != "") & F.col("quality").isNotNull())
    return usable.withColumn("quality", F.least(F.greatest("quality", F.lit(0)), F.lit(100))).orderBy(F.desc("quality"), "provider", "model")


def topic_terms(spark: SparkSession, topics: dict[str, dict[str, list[str]]], locale: str, fallback: str = "en") -> DataFrame:
    """Search terms of configured topics in a locale, else in the fallback."""
    rows = spark.createDataFrame(list(topics.items()), "topic string, terms map<string,array<string>>")
    return rows.select("topic", F.coalesce(F.try_element_at("terms", F.lit(locale)), F.try_element_at("terms", F.lit(fallback)), F.array().cast("array<string>")).alias("terms"))


def search_queries(terms: Column, name: Column, local_name: Column) -> Column:
    """Two terms with the city's first name and the first term with its second, each query once."""
    main = F.transform(F.slice(terms, 1, 2), lambda t: F.concat_ws(" ", t, name))
    second = F.when((F.size(terms) > 0) & local_name.isNotNull() & (local_name != name), F.array(F.concat_ws(" ", F.get(terms, F.lit(0)), local_name))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(main, second))


def site_traffic(rows: DataFrame, sites: dict[str, str]) -> DataFrame:
    """Host rows of an analytics export summed by site; hosts of no site go."""
    site = F.create_map(*[F.lit(x) for pair in sites.items() for x in pair])[F.col("host")] if sites else F.lit(None).cast("string")
    return rows.withColumn("site", site).filter(F.col("site").isNotNull()).groupBy("site").agg(F.sum("pageviews").alias("pageviews"), F.sum("visitors").alias("visitors"))


def largest_cities(rows: DataFrame, least: int) -> DataFrame:
    """Cities of a catalogue export (name, population, point as WKT): the largest of each name, with coordinates."""
    lng, lat = (F.round(F.regexp_extract("point", r"Point\((-?[\d.]+) (-?[\d.]+)\)", k).try_cast("double"), 4) for k in (1, 2))
    known = rows.withColumn("population", F.col("population").try_cast("long")).filter(F.col("population") >= least)
    return known.groupBy("name").agg(F.max("population").alias("population"), F.max_by("point", "population").alias("point")).select("name", "population", lat.alias("lat"), lng.alias("lng"))


def merge_documents(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``: a store's state after an upsert."""
    rows = old.unionByName(new)
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def write_snapshot(df: DataFrame, folder: str) -> str:
    """Write a new immutable snapshot beside the earlier ones; readers switch by the returned path."""
    path = f"{folder}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def xml_text(column: Column) -> Column:
    """A text as XML writes it."""
    for letter, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        column = F.replace(column, F.lit(letter), F.lit(name))
    return column


def sitemap_lines(locations: DataFrame, base: str) -> DataFrame:
    """One XML line for each location, ready for a text sink; the date is left out where none is known."""
    dated = F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit(""))
    return locations.select(F.concat(F.lit("<url><loc>"), xml_text(F.concat(F.lit(base), F.col("loc"))), F.lit("</loc>"), dated, F.lit("</url>")).alias("value"))


def append_views(folder: str, views: DataFrame) -> None:
    """Raw page views are appended, partitioned by day; counters are sums over them."""
    views.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)


#: What a configuration has unless it says otherwise.
DEFAULTS = {"search_ttl_days": 7, "skip_scraped": True, "skip_extracted": True, "extract_concurrency": 1, "search_concurrency": 1, "enrich_communities": True, "max_text_chars": 8000, "max_output_tokens": 1500, "temperature": 0.1}


def configuration(spark: SparkSession, cities: dict, topics: dict, settings: dict) -> tuple[DataFrame, DataFrame, dict]:
    """(cities, topics, settings) of parsed configuration documents, with defaults; in test mode only the cities that it names. Raises for documents of another shape."""
    for name, document, key in (("cities", cities, "cities"), ("topics", topics, "topics")):
        if not isinstance(document, dict) or not isinstance(document.get(key), list):
            raise ValueError(f"{name}: a mapping with a list {key!r} is needed")
    if not isinstance(settings, dict):
        raise ValueError("settings: a mapping is needed")
    pipeline = settings.get("pipeline", {})
    rows = [(c["name"], c.get("country", ""), str(c["locale"]), c.get("search_variants", [c["name"]]), str(c.get("topic_tier", "full")), k) for k, c in enumerate(cities["cities"])]
    places = spark.createDataFrame(rows, "city string, country string, locale string, search_variants array<string>, tier string, place int")
    if pipeline.get("test_mode", False):
        places = places.filter(F.col("city").isin(pipeline.get("test_cities", [])))
    terms = spark.createDataFrame([(t["name"], {str(k): list(v) for k, v in t["search_terms"].items()}) for t in topics["topics"]], "topic string, terms map<string,array<string>>")
    given = {k: v for part in settings.values() if isinstance(part, dict) for k, v in part.items() if v is not None}
    return places, terms, DEFAULTS | {"core_topics": []} | given


def backfilled(pages: DataFrame, document: str, columns: dict[str, str]) -> DataFrame:
    """``pages`` with ``columns`` (name: type) that they lack or don't have filled, from the JSON ``document`` of each."""
    have = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    read = {c: F.get_json_object(document, f"$.{c}").try_cast(kind) for c, kind in columns.items()}
    return pages.withColumns({c: F.coalesce(F.col(c), value) if c in have else value for c, value in read.items()})
