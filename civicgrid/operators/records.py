"""Record rules: validation and cleaning of communities, venues and people, model output to typed rows, linked data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators.directory import PEOPLE_SQL, RECORDS_SQL, people, records
from civicgrid.operators.registry import Registry

registry = Registry()
R, P = f"WITH {RECORDS_SQL}", f"WITH {PEOPLE_SQL}"

#: The roles that people have; any other is a leader's.
ROLES = ("leader", "instructor", "speaker", "organizer", "founder", "coach", "trainer", "moderator", "admin", "member", "volunteer", "coordinator")
#: Text fields in which a placeholder stands for nothing.
COMMUNITY_TEXTS = ("phone", "contact", "location", "meeting_schedule", "description", "fee", "history", "frequency", "leader", "join_process", "skill_level", "age_range", "language")
VENUE_TEXTS = ("address", "venue_type", "description", "contact", "phone")
SEPARATOR = " | "


def known_text(column: Column) -> Column:
    """Empty counts as unknown."""
    return F.when(F.trim(column) != "", column)


def cleaned(rows: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """Rules that all records share: placeholders, links, e-mail, phone, sources; for the columns that ``rows`` has."""
    have = set(rows.columns)
    rules = {c: T.null_like(F.col(c)) for c in texts if c in have}
    if "phone" in have:
        rules["phone"] = T.valid_phone(rules.get("phone", F.col("phone")))
    if "email" in have:
        rules["email"] = T.valid_email(F.col("email"))
    if "website" in have:
        rules["website"] = T.with_scheme(known_text(F.trim("website")))
    if "social_links" in have:
        rules["social_links"] = T.http_links(F.col("social_links"))
    if {"source_url", "source_urls"} <= have:
        rules["source_urls"] = T.with_source(F.col("source_urls"), F.col("source_url"))
    return rows.withColumns(rules)


def clean_communities(rows: DataFrame) -> DataFrame:
    """Valid communities (name, city and what else ``rows`` has), with their public id where there is none."""
    out = cleaned(rows, COMMUNITY_TEXTS).withColumn("name", T.without_json_tail(F.col("name")))
    if "tags" in out.columns:
        out = out.withColumn("tags", T.normal_tags(F.col("tags")))
    made = T.entity_id(F.col("name"), F.col("city"))
    return out.withColumn("community_id", F.coalesce(known_text(F.col("community_id")), made) if "community_id" in rows.columns else made)


def clean_venues(rows: DataFrame) -> DataFrame:
    return cleaned(rows, VENUE_TEXTS).withColumn("venue_id", T.entity_id(F.col("name"), F.col("city")))


def clean_people(rows: DataFrame) -> DataFrame:
    """People with a name of two words at least and a known role."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("leader")
    out = cleaned(rows, ()).withColumn("role", role).filter(F.size(F.split(F.trim("name"), r"\s+")) >= 2)
    return out.withColumn("person_id", T.entity_id(F.col("name"), F.col("city"), F.col("role"), F.col("community_name")))


def joined(column: str) -> Column:
    return F.array_join(column, SEPARATOR).alias(column)


_NULLS = ", ".join(f"'{x}'" for x in T.NULL_LIKE)
_known = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ({_NULLS}) THEN {c} END"
_site = "CASE WHEN trim(website) = '' THEN NULL WHEN starts_with(trim(website), 'http://') OR starts_with(trim(website), 'https://') THEN trim(website) ELSE 'https://' || trim(website) END"
_links = f"array_to_string(list_filter(social_links, lambda x: starts_with(trim(x), 'http://') OR starts_with(trim(x), 'https://')), '{SEPARATOR}')"
_sources = f"array_to_string(CASE WHEN list_contains(source_urls, source_url) THEN source_urls ELSE list_concat([source_url], source_urls) END, '{SEPARATOR}')"
_digits = "CASE WHEN regexp_matches({0}, '[0-9]') THEN {0} END"
_mail = "CASE WHEN contains(email, '@') THEN email END"


@registry.add(f"""{R}, t AS (SELECT *, CASE WHEN trim(name_cut, ' ",') = '' THEN name ELSE trim(name_cut, ' ",') END AS clean, list_filter(list_transform(tags, lambda x: trim(x)), lambda x: x <> '') AS known FROM (SELECT *, regexp_replace(name, '"\\s*,\\s*(\\d[\\d.]*\\s*[",]|true\\b|false\\b).*$', '') AS name_cut FROM records))
SELECT id, clean AS name, {_site} AS website, {_known('description')} AS description, {_known('location')} AS location, {_known('contact')} AS contact, {_mail} AS email, {_digits.format('phone')} AS phone,
  {_links} AS social_links, {_sources} AS source_urls, array_to_string(list_filter(known, lambda x, i: list_position(known, x) = i)[1:8], '{SEPARATOR}') AS tags, left(sha256(lower(clean) || '|' || lower(city)), 12) AS community_id FROM t""")
def validated_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records under the community rules."""
    out = clean_communities(records(spark, sf_dir))
    return out.select("id", "name", "website", "description", "location", "contact", "email", "phone", joined("social_links"), joined("source_urls"), joined("tags"), "community_id")


@registry.add(f"""{R} SELECT id, name, {_known('location')} AS address, {_known('description')} AS description, {_site} AS website, {_links} AS social_links, {_digits.format(f"({_known('phone')})")} AS phone, left(sha256(lower(name) || '|' || lower(city)), 12) AS venue_id FROM records""")
def validated_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records under the venue rules."""
    out = clean_venues(records(spark, sf_dir).withColumnRenamed("location", "address"))
    return out.select("id", "name", "address", "description", "website", joined("social_links"), "phone", "venue_id")


_roles = ", ".join(f"'{r}'" for r in ROLES)


@registry.add(f"""{P}, r AS (SELECT *, CASE WHEN role IN ({_roles}) THEN role ELSE 'leader' END AS known FROM people WHERE contains(trim(name), ' '))
SELECT id, name, known AS role, {_mail} AS email, {_site} AS website, {_links} AS social_links, {_sources} AS source_urls, left(sha256(lower(name) || '|' || lower(city) || '|' || known || '|' || lower(community_name)), 12) AS person_id FROM r""")
def validated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with two words in their names."""
    out = clean_people(people(spark, sf_dir))
    return out.select("id", "name", "role", "email", "website", joined("social_links"), joined("source_urls"), "person_id")


# model output -----------------------------------------------------------------

#: Text fields of the three kinds of model output.
OUTPUT_TEXTS = {
    "communities": ("description", "meeting_schedule", "location", "contact", "website", "member_count", "fee", "age_range", "skill_level", "join_process", "leader", "email", "phone", "language", "history", "frequency"),
    "venues": ("address", "venue_type", "description", "website", "email", "phone"),
    "persons": ("role", "community_name", "bio", "email", "website"),
}
OUTPUT_LISTS = {"communities": ("social_links", "tags"), "venues": ("welcomed_topics", "social_links"), "persons": ("social_links",)}


def as_text(item: Column, field: str) -> Column:
    """A field as text: lists joined by commas, objects as JSON, empty as null."""
    listed = F.try_variant_get(item, f"$.{field}", "array<string>")
    return known_text(F.coalesce(F.array_join(listed, ", "), F.try_variant_get(item, f"$.{field}", "string")))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, however often ``use`` names it and whatever Spark puts in its place."""
    return F.transform(F.array(value), use)[0]


def output_state(body: Column, kind: str) -> Column:
    """``ok``, ``empty`` (an object without anything), or why the output is unavailable: such pages are tried again and never stored as empty."""

    def state(parsed: Column) -> Column:
        inside = F.try_variant_get(parsed, f"$.{kind}", "variant")
        return (
            F.when(parsed.isNull(), "invalid").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
            .when(F.try_variant_get(parsed, "$", "map<string,variant>").isNull(), "not an object").when(F.size(F.try_variant_get(parsed, "$", "map<string,variant>")) == 0, "empty")
            .when(inside.isNull(), "no key").when(F.try_variant_get(parsed, f"$.{kind}", "array<variant>").isNull(), "not a list").otherwise("ok")
        )

    return once(F.try_parse_json(body), state)


def output_rows(outputs: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """A row for each named item of the usable outputs, with the other columns of ``outputs``; not validated yet."""
    keep = [c for c in outputs.columns if c != body]
    items = outputs.filter(output_state(F.col(body), kind).isin("ok")).select(*keep, F.posexplode(F.try_variant_get(F.try_parse_json(body), f"$.{kind}", "array<variant>")).alias("pos", "item"))
    item = F.col("item")
    rows = items.select(*keep, "pos", as_text(item, "name").alias("name"), *[as_text(item, f).alias(f) for f in OUTPUT_TEXTS[kind]], *[F.coalesce(F.try_variant_get(item, f"$.{f}", "array<string>"), F.array().cast("array<string>")).alias(f) for f in OUTPUT_LISTS[kind]], *_numbers(item, kind))
    named = F.col("name").isNotNull() & (F.col("community_name").isNotNull() if kind == "persons" else F.lit(True))
    return rows.filter(named)


def _numbers(item: Column, kind: str) -> list[Column]:
    if kind != "communities":
        return []
    return [F.try_variant_get(item, "$.confidence", "double").alias("confidence"), F.coalesce(F.try_variant_get(item, "$.joinable", "boolean"), F.lit(True)).alias("joinable"), F.try_variant_get(item, "$.founding_year", "int").alias("founding_year")]


#: What some pages' models answered instead of the expected object.
ODD = {"Brand#10": "oops {", "Brand#11": "[1]", "Brand#12": "{}", "Brand#13": '{"data": []}', "Brand#14": '{"communities": 5}'}


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output for each city and 100 numbers (a shelf): records as JSON, some fields as lists or objects, some outputs malformed."""
    item = F.struct("id", "name", "website", "tags", F.struct(F.col("id").alias("from")).alias("fee"), F.array("topic", "city").alias("history"), F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.col("topic")).alias("language"), (F.col("id") % 10 / 10).alias("confidence"), F.when(F.col("id") % 3 == 0, F.lit(False)).alias("joinable"))
    rows = records(spark, sf_dir).groupBy("city", F.floor(F.col("id") / 100).alias("shelf")).agg(F.sort_array(F.collect_list(item)).alias("communities"))
    body = F.to_json(F.struct("communities"))
    for city, text in ODD.items():
        body = F.when(F.col("city") == city, F.lit(text)).otherwise(body)
    return rows.select("city", "shelf", body.alias("body"))


_odd = ", ".join(f"'{c}'" for c in ODD)


@registry.add(f"""{R} SELECT id // 100 AS shelf, city, row_number() OVER (PARTITION BY city, id // 100 ORDER BY id) - 1 AS pos, name, website, '{{"from":' || id || '}}' AS fee, topic || ', ' || city AS history, CASE WHEN id % 4 <> 0 THEN topic END AS language,
  array_to_string(tags, '{SEPARATOR}') AS tags, (id % 10) / 10 AS confidence, id % 3 <> 0 AS joinable FROM records WHERE city NOT IN ({_odd})""")
def model_output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows from model output."""
    out = output_rows(model_outputs(spark, sf_dir), "communities")
    return out.select("shelf", "city", F.col("pos").cast("long").alias("pos"), "name", "website", "fee", "history", "language", joined("tags"), "confidence", "joinable")


@registry.add(f"""{R} SELECT DISTINCT city, id // 100 AS shelf, CASE city WHEN 'Brand#10' THEN 'invalid' WHEN 'Brand#11' THEN 'not an object' WHEN 'Brand#12' THEN 'empty' WHEN 'Brand#13' THEN 'no key' WHEN 'Brand#14' THEN 'not a list' ELSE 'ok' END AS state FROM records""")
def model_output_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which outputs can be used."""
    return model_outputs(spark, sf_dir).select("city", "shelf", output_state(F.col("body"), "communities").alias("state"))


# linked data ------------------------------------------------------------------


def without_nulls(**fields: Column) -> Column:
    """A JSON object of the fields that are known."""
    return F.to_json(F.struct(*[c.alias(k.replace("at_", "@")) for k, c in fields.items()]))


@registry.add(f"""{R}, o AS (SELECT city, id, '{{"@type":"Organization","name":' || to_json(name) || CASE WHEN website IS NULL THEN '' ELSE ',"url":' || to_json(website) END || '}}' AS thing, row_number() OVER (PARTITION BY city ORDER BY id) AS n FROM records WHERE NOT hidden)
SELECT city, '{{"@context":"https://schema.org","@graph":[' || string_agg(thing, ',' ORDER BY id) || ']}}' AS graph FROM o WHERE n <= 50 GROUP BY city""")
def jsonld_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 visible records of each city as one linked-data graph: the limit is a page's."""
    from pyspark.sql import Window

    rows = records(spark, sf_dir).filter(~F.col("hidden")).withColumn("n", F.row_number().over(Window.partitionBy("city").orderBy("id"))).filter("n <= 50")
    thing = F.struct("id", without_nulls(at_type=F.lit("Organization"), name=F.col("name"), url=F.col("website")).alias("thing"))
    things = F.array_join(F.transform(F.sort_array(F.collect_list(thing)), lambda x: x["thing"]), ",")
    return rows.groupBy("city").agg(F.concat(F.lit('{"@context":"https://schema.org","@graph":['), things, F.lit("]}")).alias("graph"))


@registry.add(f"""{R} SELECT id, '{{"@type":"BreadcrumbList","itemListElement":[{{"position":1,"name":' || to_json(city) || '}},{{"position":2,"name":' || to_json(topic) || '}},{{"position":3,"name":' || to_json(name) || '}}]}}' AS crumbs FROM records""")
def jsonld_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to each record as linked data."""
    steps = F.transform(F.array("city", "topic", "name"), lambda x, i: F.struct((i + 1).alias("position"), x.alias("name")))
    return records(spark, sf_dir).select("id", without_nulls(at_type=F.lit("BreadcrumbList"), itemListElement=steps).alias("crumbs"))


@registry.add(f"""{R} SELECT id, left(sha256(lower(name) || '|' || lower(city)), 12) AS community_id, '/' || trim(regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), '-') || '/' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS public_url FROM records""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids where they are missing, and each record's public address."""
    rows = records(spark, sf_dir)
    return rows.select("id", T.entity_id(F.col("name"), F.col("city")).alias("community_id"), F.concat(F.lit("/"), T.slug(F.col("city")), F.lit("/"), T.slug(F.col("name"))).alias("public_url"))


QUERIES, ORACLE = registry.queries, registry.oracle
