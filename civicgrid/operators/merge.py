"""Keyed merges as whole-table transformations: upserts, replacements, history, merges of records, deletes.

Each takes the old rows and the incoming ones and gives the new table, so that a
single writer can swap it in; none changes rows in place. Old rows here are one
state of a table and incoming ones another, told apart by columns that the tables
carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import MEMBERS_SQL, members, table

registry = Registry()
M = f"WITH {MEMBERS_SQL}"


def blank_to_null(column: Column) -> Column:
    """Empty counts as unknown."""
    return F.when(F.trim(column) != "", column)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], prefer_new: list[str], unions: list[str] = (), keep_old: list[str] = ()) -> DataFrame:
    """Full outer merge by ``keys``: new values win where known, arrays are joined new first, other columns stay."""
    tagged = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o")).join(new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n")), keys, "full_outer")
    out = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in prefer_new]
    empty = F.array().cast("array<bigint>")
    out += [F.array_union(F.coalesce(F.col(f"n.{c}"), empty), F.coalesce(F.col(f"o.{c}"), empty)).alias(c) for c in unions]
    out += [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in keep_old]
    return tagged.select(*keys, *out)


def source_lists(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Suppliers' parts as ordered lists, from line items of one return flag."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    return rows.groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("urls"), F.max("l_linestatus").alias("state"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("updated"))


def _lists_sql(flag: str) -> str:
    return f"SELECT l_suppkey AS id, list_sort(list(DISTINCT l_partkey)) AS urls, max(l_linestatus) AS state, strftime(max(l_shipdate), '%Y-%m-%d') AS updated FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1"


@registry.add(f"""WITH o AS ({_lists_sql('A')}), n AS ({_lists_sql('R')})
SELECT coalesce(o.id, n.id) AS id, coalesce(n.state, o.state) AS state, array_to_string(list_concat(coalesce(n.urls, []), list_filter(coalesce(o.urls, []), lambda u: NOT list_contains(coalesce(n.urls, []), u))), ',') AS urls, coalesce(o.updated, n.updated) AS created FROM o FULL OUTER JOIN n ON o.id = n.id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records: new values, URLs of both with the new ones first, the date of the older."""
    old, new = source_lists(spark, sf_dir, "A"), source_lists(spark, sf_dir, "R")
    merged = upsert(old, new, ["id"], ["state"], ["urls"], ["updated"])
    return merged.select("id", "state", F.array_join(F.transform("urls", lambda u: u.cast("string")), ",").alias("urls"), F.col("updated").alias("created"))


@registry.add("""WITH o AS (SELECT l_orderkey AS id, max(l_quantity) AS a, max(l_discount) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_orderkey AS id, max(l_quantity) AS a, max(l_discount) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT n.id, f.field, CASE f.field WHEN 'quantity' THEN o.a WHEN 'discount' THEN o.b END AS old, CASE f.field WHEN 'quantity' THEN n.a WHEN 'discount' THEN n.b END AS new FROM n LEFT JOIN o ON o.id = n.id, (VALUES ('__created__'), ('quantity'), ('discount')) f(field)
WHERE CASE f.field WHEN '__created__' THEN o.id IS NULL WHEN 'quantity' THEN o.id IS NOT NULL AND o.a IS DISTINCT FROM n.a ELSE o.id IS NOT NULL AND o.b IS DISTINCT FROM n.b END""")
def history_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows: one for each field that differs, one marker for each new record."""
    state = lambda flag: table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    old, new = state("A").withColumn("was", F.lit(True)).alias("o"), state("R").alias("n")
    rows = new.join(old, F.col("n.id") == F.col("o.id"), "left")
    fields = [F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old"), F.col(f"n.{f}").alias("new"), (F.col("o.was") & ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))).alias("keep")) for f in ("quantity", "discount")]
    fields.append(F.struct(F.lit("__created__").alias("field"), F.lit(None).cast("double").alias("old"), F.lit(None).cast("double").alias("new"), F.col("o.was").isNull().alias("keep")))
    return rows.select(F.col("n.id").alias("id"), F.explode(F.array(*fields)).alias("f")).filter("f.keep").select("id", "f.field", "f.old", "f.new")


@registry.add("""WITH i AS (SELECT l_suppkey AS city, l_partkey AS id, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS incoming, bool_or(l_returnflag = 'A' AND l_discount > 0.09) AS was_hidden, bool_or(l_returnflag <> 'R') AS stored FROM lineitem GROUP BY ALL), slice AS (SELECT DISTINCT city FROM i WHERE city <= 50)
SELECT city, id, was_hidden AS hidden FROM i WHERE CASE WHEN city IN (SELECT city FROM slice) THEN incoming ELSE stored END""")
def replace_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the replaced cities only incoming records stand, still hidden if they were; other cities keep what is stored."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("city"), F.col("l_partkey").alias("id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("incoming"), F.bool_or((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.09)).alias("hidden"), F.bool_or(F.col("l_returnflag") != "R").alias("stored"))
    return rows.filter(F.when(F.col("city") <= 50, F.col("incoming")).otherwise(F.col("stored"))).select("city", "id", "hidden")


@registry.add("""WITH p AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_returnflag, l_orderkey, l_quantity FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT a, b, CASE WHEN bool_or(l_returnflag = 'A') THEN 'decided' WHEN bool_or(l_returnflag = 'R') THEN 'manual' ELSE 'found' END AS state, max(l_quantity) AS similarity FROM p GROUP BY a, b""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each unordered pair: decided stays decided, manual beats found."""
    pairs = table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))
    state = F.when(F.bool_or(F.col("l_returnflag") == "A"), "decided").when(F.bool_or(F.col("l_returnflag") == "R"), "manual").otherwise("found")
    return pairs.agg(state.alias("state"), F.max("l_quantity").alias("similarity"))


def merged_counts(lists: DataFrame, merges: DataFrame) -> DataFrame:
    """id and the number of different urls of each id in ``lists`` (id, url), after the lists of ``merges`` (id, winner) joined those of winners that have one.

    Which winners count is found among the merges: the moved urls of a winner never meet in one task.
    """
    known = lists.select(F.col("id").alias("winner")).distinct()
    moved = lists.join(merges.join(known, "winner", "left_semi"), "id").select(F.col("winner").alias("id"), "url")
    return lists.unionByName(moved).distinct().groupBy("id").agg(F.count("url").alias("n_urls"))


@registry.add("""WITH l AS (SELECT l_suppkey AS id, list_sort(list(DISTINCT l_partkey)) AS urls FROM lineitem GROUP BY 1), m AS (SELECT s_suppkey AS loser, s_nationkey AS winner FROM supplier WHERE s_suppkey > 25), w AS (SELECT winner, list_sort(list_distinct(flatten(list(urls)))) AS more FROM m JOIN l ON l.id = m.loser GROUP BY winner)
SELECT l.id, l.id IN (SELECT loser FROM m) AS hidden, len(CASE WHEN more IS NULL THEN urls ELSE list_distinct(list_concat(urls, more)) END) AS n_urls FROM l LEFT JOIN w ON w.winner = l.id""")
def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losers are hidden and their URLs join their winner's."""
    lists = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("url")).distinct()
    merges = table(spark, sf_dir, "supplier").filter("s_suppkey > 25").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("winner"))
    return merged_counts(lists, merges).join(merges.select("id", F.lit(True).alias("lost")), "id", "left").select("id", F.coalesce("lost", F.lit(False)).alias("hidden"), "n_urls")


@registry.add("SELECT s_suppkey AS id, coalesce(nullif(trim(s_name), ''), 'unnamed') AS name, coalesce(CASE WHEN s_acctbal >= 0 THEN s_acctbal END, best) AS balance FROM supplier JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS best FROM supplier GROUP BY 1) ON k = s_nationkey")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown fields are filled, known ones stay."""
    best = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"))
    rows = table(spark, sf_dir, "supplier").join(best, "s_nationkey")
    return rows.select(F.col("s_suppkey").alias("id"), F.coalesce(blank_to_null(F.col("s_name")), F.lit("unnamed")).alias("name"), F.coalesce(F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")), F.col("best")).alias("balance"))


@registry.add("""WITH k AS (SELECT c_custkey AS id, 'k' || (c_custkey // 3) AS old_key, 'k' || (c_custkey // 2) AS new_key FROM customer), c AS (SELECT new_key, min(id) AS keeper, count(*) AS n FROM k GROUP BY 1) SELECT id, k.new_key, keeper, n > 1 AND id <> keeper AS merged FROM k JOIN c ON c.new_key = k.new_key""")
def rekey_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records get a new key; of those that collide the first keeps it and the others merge into it."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("k"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("new_key"))
    keeper = F.min("id").over(Window.partitionBy("new_key"))
    return rows.select("id", "new_key", keeper.alias("keeper"), (F.col("id") != keeper).alias("merged"))


@registry.add("""WITH map AS (SELECT p_partkey AS old_key, 100000 + p_partkey AS new_key FROM part WHERE p_size > 25) SELECT l_orderkey, l_linenumber, coalesce(new_key, l_partkey) AS record_key, count(*) AS n FROM lineitem LEFT JOIN map ON old_key = l_partkey GROUP BY ALL""")
def key_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References follow a map of old to new keys; others stay."""
    mapping = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), (F.lit(100000) + F.col("p_partkey")).alias("new_key"))
    rows = table(spark, sf_dir, "lineitem").join(mapping, "l_partkey", "left")
    return rows.groupBy("l_orderkey", F.col("l_linenumber"), F.coalesce("new_key", "l_partkey").alias("record_key")).agg(F.count("*").alias("n"))


@registry.add(f"{M} SELECT id, city FROM members WHERE NOT (city = 'PERU' AND topic = 'BUILDING')")
def delete_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).filter(~((F.col("city") == "PERU") & (F.col("topic") == "BUILDING"))).select("id", "city")


@registry.add("""SELECT user_id AS token, min(event_id) AS first_id, count(*) AS tries FROM events WHERE event_type = 'signup' GROUP BY user_id""")
def subscription_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert or return what is there: the first sign-up of each address keeps its token."""
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy(F.col("user_id").alias("token")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("tries"))


@registry.add("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey AS id, o_orderkey AS decided_by, o_orderstatus AS resolution FROM e WHERE rn = 1""")
def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest decision on each candidate."""
    latest = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("l")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(latest).select("id", F.col("l.o_orderkey").alias("decided_by"), F.col("l.o_orderstatus").alias("resolution"))


@registry.add("""WITH v AS (SELECT l_partkey AS prompt, l_orderkey AS version, md5(CAST(l_quantity AS VARCHAR)) AS h, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn FROM lineitem), c AS (SELECT *, lag(q) OVER (PARTITION BY prompt ORDER BY rn) AS before FROM v)
SELECT prompt, count(*) AS versions FROM c WHERE before IS NULL OR q <> before GROUP BY prompt""")
def prompt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version is appended only where the content changed."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("before", F.lag("l_quantity").over(order))
    return rows.filter("before IS NULL OR l_quantity <> before").groupBy(F.col("l_partkey").alias("prompt")).agg(F.count("*").alias("versions"))


@registry.add("""SELECT o_custkey AS person, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS roles, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS bio, count(*) AS n FROM orders GROUP BY o_custkey""")
def person_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's roles together, and the first known description."""
    known = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("roles"), F.min_by(F.when(known, F.col("o_orderstatus")), F.when(known, F.col("o_orderkey"))).alias("bio"), F.count("*").alias("n"))


@registry.add("""WITH r AS (SELECT o_custkey AS id, min(o_orderkey) AS first_report FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey AS id, r.id IS NOT NULL AS hidden, first_report FROM customer LEFT JOIN r ON r.id = c_custkey""")
def moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved reports hide their records."""
    reports = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("first_report"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(reports, "id", "left").select("id", F.col("first_report").isNotNull().alias("hidden"), "first_report")


@registry.add("""WITH p AS (SELECT p_brand AS provider, p_name AS model, p_size AS quality, p_retailprice AS measured, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) SELECT provider, model, CASE WHEN rn <= 5 THEN CAST(floor(measured) AS BIGINT) ELSE quality END AS quality FROM p""")
def score_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured qualities replace the configured ones, others stay."""
    part = table(spark, sf_dir, "part")
    measured = part.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).filter("rn <= 5").select("p_partkey", F.floor("p_retailprice").alias("new"))
    return part.join(measured, "p_partkey", "left").select(F.col("p_brand").alias("provider"), F.col("p_name").alias("model"), F.coalesce("new", F.col("p_size").cast("long")).alias("quality"))


QUERIES, ORACLE = registry.queries, registry.oracle
