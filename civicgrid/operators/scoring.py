"""Scores of extractions: what words say about a name, which names are the same, pages and models.

Names that agree in their words are counted by Spark; only what is left of a page
goes to a small matching in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from civicgrid.functions import text as T
from civicgrid.operators.directory import RECORDS_SQL, records
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table
from civicgrid.sources.store import settled

registry = Registry()

#: Points of a page for an answer, for recall and for precision.
ANSWER, RECALL, PRECISION = 20, 50, 30
#: Words that say nothing where there are too few names to tell; abbreviations and endings of clubs.
SEED = ("egyesulet", "klub", "kor", "csoport", "sport", "sportegyesulet", "se", "sc", "verein", "sportverein", "gruppe", "ev", "forening", "klubb", "club", "society", "association", "group")
ABBREVIATIONS = ("sv", "se", "sc", "if", "fc", "tv", "ac", "bc", "vfb", "fsv", "tsv", "mtk", "dvtk", "gik", "ik", "bk", "ff")
ENDINGS = ("verein", "vereinigung", "gemeinschaft", "klubb", "forening", "sallskap", "idrottsforening", "egyesulet", "klub", "club")
FEW_NAMES = 20


def document_frequency(names: DataFrame, column: str) -> DataFrame:
    """In how many names each word occurs: token, df."""
    return names.select(F.explode(T.name_tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def generic_words(names: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """Words that say nothing: the fixed ones and, from 20 names on, those in a tenth of the names, in two at least."""
    n = names.agg(F.count("*").alias("n"))
    seed = names.sparkSession.createDataFrame([(w,) for w in SEED], "token string")
    often = document_frequency(names, column).crossJoin(F.broadcast(n))  # one row
    common = often.filter((F.col("n") >= FEW_NAMES) & (F.col("df") >= F.greatest(F.lit(2), F.floor(F.col("n") * share))))
    return seed.union(common.select("token")).distinct()


def corpus_names(rows: DataFrame, limit: int = 40_000) -> DataFrame:
    """key and name of the first ``limit`` visible records (key, name, hidden) in the order of their keys: the same sample whatever order rows are stored in."""
    return rows.filter(~F.coalesce("hidden", F.lit(False)) & (F.col("name") != "")).orderBy("key").limit(limit).select("key", "name")


#: Names, and pairs of names, of which a worker remembers what it found: directories repeat them.
REMEMBERED = 1 << 16


@lru_cache(REMEMBERED)
def words(name: str) -> tuple[str, ...]:
    return tuple(t for t in re.split("[^a-z0-9]+", T.fold_accents(name)) if t)


class SameName:
    """Whether two names mean one club: equal words, or more words on one side that are all generic, where the other side says something."""

    def __init__(self, generic: frozenset[str] = frozenset(), places: tuple[str, ...] = ()):
        self.generic = generic or frozenset(SEED)
        self.places = tuple(p for p in places if len(p) > 3)

    def says_nothing(self, word: str) -> bool:
        return word in self.generic or word.endswith(ENDINGS) or word.startswith(self.places)

    def says_enough(self, name: str, long_words: frozenset[str]) -> bool:
        every = words(name)
        kinds = sum(w in ABBREVIATIONS or w.endswith(ENDINGS) for w in every)
        return len(long_words) >= 2 or not all(map(self.says_nothing, long_words)) or 0 < kinds < len(every)

    def __call__(self, a: str, b: str) -> bool:
        if "".join(words(a)) == "".join(words(b)):
            return True
        x, y = (frozenset(w for w in words(n) if len(w) > 2) for n in (a, b))
        if not x or not y or not (x <= y or y <= x):
            return False
        small, name, rest = (x, a, y - x) if x <= y else (y, b, x - y)
        return not rest or all(map(self.says_nothing, rest)) and self.says_enough(name, small)


def most_pairs(left: list[str], right: list[str], same: Callable[[str, str], bool]) -> int:
    """Size of a maximum matching of two lists of names."""
    fits = [[j for j, b in enumerate(right) if same(a, b)] for a in left]
    # where no name has a choice, the names that have a partner are the matching
    wanted = [f[0] for f in fits if f]
    if all(len(f) < 2 for f in fits) and len(set(wanted)) == len(wanted):
        return len(wanted)
    partner: dict[int, int] = {}

    def free(i: int, tried: set[int]) -> bool:
        open_to = [j for j in fits[i] if j not in tried]
        tried.update(open_to)
        j = next((j for j in open_to if j not in partner or free(partner[j], tried)), None)
        if j is not None:
            partner[j] = i
        return j is not None

    return sum(free(i, set()) for i in range(len(left)))


def pair_counter(same: SameName):
    @F.pandas_udf(LongType())
    def count(left: pd.Series, right: pd.Series) -> pd.Series:
        known = lru_cache(REMEMBERED)(same)
        return pd.Series([0 if a is None or b is None else most_pairs(a.tolist(), b.tolist(), known) for a, b in zip(left, right, strict=True)], dtype="int64")

    return count


def keyed_names(*lists: DataFrame) -> DataFrame:
    """name and name_key of the different names in some lists: each is folded once, however many rows have it."""
    names = settled(reduce(DataFrame.union, [rows.select("name").filter("name IS NOT NULL").distinct() for rows in lists]).distinct(), "names")
    return settled(T.split_by_letters(names, T.name_key, ["name"], lambda df, way: df.select("name", way(F.col("name")).alias("name_key"))), "name-keys")


def page_scores_of(expected: DataFrame, got: DataFrame, same: SameName) -> DataFrame:
    """page, model and score for each answered page: 20, 50 x recall and 30 x precision.

    ``expected``: page, place, name; ``got``: model, page, place, name, a row of a null
    name for an answer without any. Both lists count each name once, as it is spelled
    first. Where all names of a side have their equal on the other, the matching is
    known; only other pages are matched by ``same``. All lists of a page meet once.
    """
    columns = ["page", "model", "place", "name"]
    both = expected.withColumn("model", F.lit(None).cast(got.schema["model"].dataType)).select(*columns).unionByName(got.select(*columns))
    lists = both.join(keyed_names(expected, got), "name", "left").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("place", "model", "name_key", "name"))).alias("all"))
    each = lists.withColumn("model", F.explode(F.array_distinct(F.filter(F.transform("all", lambda x: x["model"]), lambda m: m.isNotNull()))))

    def first(wanted) -> Column:
        """The first spelling of each name among some of a page's names."""
        some = F.filter("all", lambda x: wanted(x) & x["name_key"].isNotNull())
        return F.filter(some, lambda x, i: F.array_position(F.transform(some, lambda y: y["name_key"]), x["name_key"]) == i + 1)

    named = each.select("model", "page", first(lambda x: x["model"].isNull()).alias("want"), first(lambda x: x["model"] == F.col("model")).alias("have"))
    part = lambda side, field: F.transform(side, lambda x: x[field])
    counts = named.select("model", "page", F.size("want").cast("long").alias("n_want"), F.size("have").cast("long").alias("n_got"), F.size(F.array_intersect(part("want", "name_key"), part("have", "name_key"))).cast("long").alias("equal"), part("want", "name").alias("left"), part("have", "name").alias("right"))
    open_sides = F.col("equal") < F.least("n_want", "n_got")
    counts = counts.withColumns({c: F.when(open_sides, F.sort_array(c)) for c in ("left", "right")})
    pairs = F.when(open_sides, pair_counter(same)("left", "right")).otherwise(F.col("equal"))
    recall = F.try_divide(pairs, F.col("n_want"))
    precision = F.least(F.lit(1.0), F.coalesce(F.try_divide(pairs, F.col("n_got")), F.lit(0.0)))
    score = F.when(F.col("n_want") == 0, 0.0).otherwise(ANSWER + RECALL * recall + PRECISION * precision)
    return counts.select("model", "page", score.alias("score"))


def model_scores_of(pages: DataFrame, models: DataFrame, scores: DataFrame) -> DataFrame:
    """model, score, coverage, answered and failed: the mean over answered pages, null for a model that answered none."""
    n = pages.select("page").distinct().agg(F.count("*").alias("n"))
    by_model = scores.groupBy("model").agg(F.avg("score").alias("mean"), F.count("*").alias("answered"))
    every = models.join(by_model, "model", "left").crossJoin(F.broadcast(n))  # one row
    answered = F.coalesce("answered", F.lit(0).cast("long"))
    return every.select("model", F.bround("mean").cast("long").alias("score"), F.coalesce(F.round(F.try_divide(answered, F.col("n")), 2), F.lit(0.0)).alias("coverage"), answered.alias("answered"), (F.col("n") - answered).alias("failed"))


def clamped(value: int, least: int = 1, most: int = 40) -> int:
    """A number of golden pages as a job may ask for it."""
    return min(max(value, least), most)


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda t: length(t) > 2))"


@registry.add(f"""WITH w AS (SELECT p_partkey, {_TOKENS} AS t FROM part) SELECT token, count(*) AS df FROM (SELECT unnest(t) AS token FROM w) GROUP BY token""")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many names each word occurs."""
    return document_frequency(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")), "name")


@registry.add(f"""WITH w AS (SELECT p_partkey, {_TOKENS} AS t FROM part), d AS (SELECT token, count(*) AS df FROM (SELECT unnest(t) AS token FROM w) GROUP BY token)
SELECT token FROM d WHERE df >= greatest(2, (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM part)) UNION SELECT unnest([{', '.join(f"'{w}'" for w in SEED)}])""")
def generic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that say nothing about a name."""
    return generic_words(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")), "name")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages, their parts as names; each return flag is a model that found what it returned: A in capitals, N some in a longer form, R some in two words."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.lit("Team "), F.replace("p_brand", F.lit("Brand#"), F.lit("no")), F.lit(" "), F.chr(F.col("l_partkey") % 26 + 97), F.lit("ab"))
    rows = items.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("place"), name.alias("name"), F.col("l_returnflag").alias("model"))
    longer = F.when((F.col("model") == "N") & (F.col("place") % 2 == 0), F.concat("name", F.lit(" Sportverein"))).when((F.col("model") == "R") & (F.col("place") % 3 == 0), F.concat(F.lit("The-"), "name")).otherwise(F.col("name"))
    return rows.select("page", "place", "name"), rows.select("model", "page", "place", F.when(F.col("model") == "A", F.upper("name")).otherwise(longer).alias("name"))


_PAIRS = """WITH i AS (SELECT l_orderkey AS page, l_returnflag AS model, 'team ' || replace(p_brand, 'Brand#', 'no') || ' ' || chr(CAST(l_partkey % 26 + 97 AS INTEGER)) || 'ab' AS name, CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'longer' WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'other' ELSE '' END AS form FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT page, count(DISTINCT name) AS n FROM i GROUP BY page), g AS (SELECT model, page, count(DISTINCT name || form) AS n, count(DISTINCT name) FILTER (form <> 'other') AS pairs FROM i GROUP BY ALL),
s AS (SELECT model, g.page, 20 + 50 * pairs / w.n + 30 * least(1.0, pairs / g.n) AS score FROM g JOIN w ON w.page = g.page)"""


@registry.add(f"{_PAIRS} SELECT model, page, CAST(score AS DOUBLE) AS score FROM s")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's names against those that each model found."""
    return page_scores_of(*_answers(spark, sf_dir), SameName())


@registry.add(f"""{_PAIRS}, m AS (SELECT model, avg(score) AS mean, count(*) AS answered FROM s GROUP BY model), n AS (SELECT count(*) AS n FROM w) SELECT model, CAST(round_even(mean, 0) AS BIGINT) AS score, round(answered / n, 2) AS coverage, answered, n - answered AS failed FROM m, n UNION ALL SELECT 'silent', NULL, 0.0, 0, n FROM n""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's mean over the pages that it answered; one that never answered has no score."""
    expected, got = _answers(spark, sf_dir)
    models = spark.createDataFrame([("A",), ("N",), ("R",), ("silent",)], "model string")
    return model_scores_of(expected, models, page_scores_of(expected, got, SameName()))


@registry.add("WITH r AS (SELECT p_brand AS provider, p_type AS locale, p_partkey AS page, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_type = 'ECONOMY') SELECT provider, page FROM r WHERE n <= 40")
def score_job_pages(spark: SparkSession, sf_dir: str, pages: int = 100, locale: str = "ECONOMY") -> DataFrame:
    """The golden pages of a job: those of its locale, 1 to 40 for each provider."""
    rows = table(spark, sf_dir, "part").filter(F.col("p_type") == locale).withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return rows.filter(F.col("n") <= clamped(pages)).select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("page"))


@registry.add(f"WITH {RECORDS_SQL} SELECT 'k' || left(sha256(CAST(id AS VARCHAR)), 8) AS key, name FROM records WHERE NOT hidden AND name <> '' ORDER BY key LIMIT 500")
def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 500 names in the order of their keys: the limit is the feature."""
    rows = records(spark, sf_dir).withColumn("key", F.concat(F.lit("k"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8)))
    return corpus_names(rows, 500)


QUERIES, ORACLE = registry.queries, registry.oracle
