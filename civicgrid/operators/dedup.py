"""Duplicate detection and merging: candidates by address and by name, their state, merged records, edits of identity.

Names are compared inside a city. What may be alike comes from equi-joins that
lose no pair: two names whose ratio reaches a threshold are the same text after a few
deletions in both, which short names meet by; long ones share one of the rarest
pairs of neighbouring characters of both, at about the same place; a name inside
another has its rarest run of three there. Only such pairs are compared one by one,
and after a few records changed only pairs with one of them.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators.components import components
from civicgrid.operators.directory import PEOPLE_SQL, RECORDS_SQL, people, records
from civicgrid.operators.records import SEPARATOR, joined, known_text
from civicgrid.operators.registry import Registry
from civicgrid.sources.store import settled

registry = Registry()
R, P = f"WITH {RECORDS_SQL}", f"WITH {PEOPLE_SQL}"

#: Names that say nothing about a community on their own.
GENERIC = (
    "csoport", "klub", "kör", "egyesület", "közösség", "közösségi", "közössége", "társaság", "társulat", "csapat", "team", "szakkör", "műhely", "szervezet", "alapítvány",
    "group", "club", "community", "circle", "association", "society", "színpad", "táncstúdió", "stúdió", "studio", "idősek klubja", "nyugdíjasklub", "ifjúsági kör",
)
RICH_FIELDS = ("description", "meeting_schedule", "location", "contact", "website")
#: Names of a length meet by deletions if no partner's length takes more of them in either name, and names of ``LONG`` characters never.
DELETIONS, LONG = 500, 64


def richness(columns: list[str]) -> Column:
    """How many of five fields a record has, and how many links."""
    score = F.coalesce(F.size("social_links"), F.lit(0)) if "social_links" in columns else F.lit(0)
    for field in RICH_FIELDS:
        if field in columns:
            score = score + (F.coalesce(F.col(field), F.lit("")) != "").cast("int")
    return score


def without_city(name: Column, city: Column) -> Column:
    """A lower-case name without its city, also as an adjective in -i; the whole name where at most two characters would be left."""
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.lower(city), F.lit(r"\Ei?\b"))
    left = F.trim(F.regexp_replace(F.lower(name), pattern, F.lit("")), F.lit(" –-/"))
    return F.when(F.length(left) > 2, left).otherwise(F.lower(name))


def says_something(a: Column, b: Column) -> Column:
    """The shorter of two names has five characters and is no generic word."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    return (F.length(shorter) >= 5) & ~F.trim(shorter).isin(*GENERIC)


def inside(a: Column, b: Column) -> Column:
    return (F.length(a) > 4) & (F.length(b) > 4) & (a.contains(b) | b.contains(a))


def characters(name: Column) -> Column:
    """A name's characters, each with how often it occurred before; those that repeat first, as they are the rarest."""
    letters = F.split(name, "")
    numbered = F.transform(letters, lambda c, i: F.struct(F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).alias("k"), c.alias("c")))
    return F.sort_array(F.filter(numbered, lambda x: x["c"] != ""), asc=False)


def numbered(runs: Column) -> Column:
    """Each text of an array with how often it occurred before."""
    return F.transform(runs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(runs, 1, i + 1), lambda y: y == x)).cast("string")))


def runs_of(name: Column, q: int) -> Column:
    """All runs of ``q`` characters of a name that has as many."""
    return F.when(F.length(name) >= q, F.transform(F.sequence(F.lit(1), F.length(name) - (q - 1)), lambda i: F.substring(name, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def by_rarity(names: DataFrame, tokens: str, first: Column) -> DataFrame:
    """``names`` with the ``first`` of their ``tokens`` in the order of rarity, which is measured over all names."""
    keys = ["city", "ord"]
    every = names.select(*keys, first.alias("first"), F.explode(tokens).alias("token"))
    often = every.groupBy("token").agg(F.count("*").alias("names"))
    ordered = every.join(often, "token").groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("names", "token"))), F.lit(1), F.max("first")).alias("rare"))
    return names.join(ordered.select(*keys, F.transform("rare", lambda x: x["token"]).alias("rare")), keys)


def signature(tokens: Column) -> Column:
    """64 bits, of which each text of an array sets one."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def met(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """(city, ord_a, ord_b) of names that share a ``key`` under ``condition`` on l and r; where there are ``changed`` ones, pairs with one of those at least."""
    same = (F.col("l.city") == F.col("r.city")) & (F.col("l.key") == F.col("r.key"))
    pair = lambda a, b: a.alias("l").join(b.alias("r"), same).filter(condition & (F.col("l.ord") != F.col("r.ord"))).select(F.col("l.city").alias("city"), F.least("l.ord", "r.ord").alias("ord_a"), F.greatest("l.ord", "r.ord").alias("ord_b"))
    if "changed" not in left.columns:
        return pair(left, right)
    return pair(left.filter("changed"), right).union(pair(left, right.filter("changed")))


def lengths_by_deletions(rows: DataFrame, threshold: float) -> tuple[list[int], dict[int, list[tuple[int, int]]]]:
    """(lengths of names with partners that deletions don't find, ``LONG`` for all from there; by length the lengths of partners to be found by deletions, with those from the name itself)."""
    there = {r[0] for r in rows.select(F.least(F.length("clean"), F.lit(LONG))).distinct().collect()} - {None, 0}  # LONG numbers at most
    common = lambda n, m: math.ceil(threshold * (n + m) / 2 - 1e-9)
    partners = {n: [m for m in there - {LONG} if common(n, m) <= min(n, m)] for n in there - {LONG}}
    few = lambda n, m: max(math.comb(k, k - common(n, m)) for k in (n, m)) <= DELETIONS
    meets_long = lambda n: LONG in there and n * (2 - threshold) / threshold + 1e-9 >= LONG
    short = [n for n in sorted(partners) if not meets_long(n) and all(few(n, m) for m in partners[n])]
    return sorted(there - set(short)), {n: found for n, ms in partners.items() if (found := [(m, n - common(n, m)) for m in ms if n in short or m in short])}


def shortened(name: Column, k: int) -> Column:
    """The different texts that ``k`` deletions leave of a name."""
    found = F.array(F.struct(name.alias("text"), F.lit(1).alias("at")))
    without = lambda text, j: F.struct(F.concat(F.substring(text, F.lit(1), j - 1), F.substring(text, j + 1, F.length(text))).alias("text"), j.alias("at"))
    for _ in range(k):  # from left to right; past the end nothing goes
        found = F.flatten(F.transform(found, lambda v: F.transform(F.sequence(v["at"], F.greatest(v["at"], F.length(v["text"]))), lambda j: without(v["text"], j))))
    return F.array_distinct(F.filter(F.transform(found, lambda v: v["text"]), lambda x: F.length(x) == F.length(name) - k))


def by_deletions(rows: DataFrame, partners: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(city, ord_a, ord_b) of the names with ``partners`` that share as many characters in one order as their ratio needs.

    Names of n and m characters meet by the texts of that many characters that are left
    of both, so that no pair is lost and none that meets shares fewer.
    """
    kinds = F.create_map(*[x for n, found in partners.items() for x in (F.lit(n), F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in found]))])
    extra = ["changed"] if "changed" in rows.columns else []
    dealt = rows.select("city", "ord", "clean", F.length("clean").alias("n"), *extra).filter(F.col("n").isin(*partners)).withColumn("kind", F.explode(F.element_at(kinds, F.col("n"))))
    texts = reduce(lambda other, k: F.when(F.col("kind.k") == k, shortened(F.col("clean"), k)).otherwise(other), sorted({k for found in partners.values() for _, k in found}), F.array().cast("array<string>"))
    m = F.col("kind.m")
    keyed = dealt.withColumn("text", F.explode(texts)).select("city", "ord", "n", m.alias("m"), F.xxhash64(F.least("n", m), F.greatest("n", m), "text").alias("key"), *extra)
    once = (F.col("l.n") < F.col("r.n")) | (F.col("l.ord") < F.col("r.ord"))
    return met(keyed.filter("n <= m"), keyed.filter("n >= m").hint("merge"), once).distinct()  # many texts from small files


def meeting_names(rows: DataFrame, threshold: float, within: int | None) -> DataFrame:
    """(city, ord_a, ord_b) of the names that are worth a comparison: all that ``close_pairs`` gives, and few others."""
    long, partners = lengths_by_deletions(rows, threshold)
    found = ([by_deletions(rows, partners)] if partners else []) + ([by_runs(rows, threshold, within, long)] if long or within else [])
    return reduce(DataFrame.union, found or [met(*[rows.withColumn("key", F.lit(0))] * 2, F.lit(False))]).distinct()


def by_runs(rows: DataFrame, threshold: float, within: int | None, long: list[int]) -> DataFrame:
    """(city, ord_a, ord_b) of the names of ``long`` lengths that are worth a comparison, and of those with a name inside another.

    A ratio of t needs m >= t s / 2 matching characters, s being both lengths together.
    The matches form at most s - 2 m + 1 blocks, so at least o = 3 m - s - 1 pairs of
    neighbours stand in both names. Of n - 1 such pairs, in the order of rarity, the
    first n - o then hold one that both names have: names meet by these. Of what meets
    only that is kept whose signatures differ by no more than s - 2 - 2 o bits for
    pairs of neighbours and s - 2 m for characters. A name inside another has its
    rarest run of three there.
    """
    extra = ["changed"] if "changed" in rows.columns else []
    two, one = numbered(runs_of(F.col("clean"), 2)), numbered(F.filter(F.split("clean", ""), lambda c: c != ""))
    light = rows.filter(F.length("clean") > 0).select("city", "ord", "clean", F.length("clean").alias("n"), two.alias("two"), signature(one).alias("letters"), signature(two).alias("runs"), *extra)
    n, longest = F.col("n"), (2 - threshold) / threshold
    total = F.col("l.n") + F.col("r.n")
    matching = F.ceil(threshold * total / 2 - 1e-9)
    apart = lambda c: F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}")))
    fits = (F.col("l.n") <= longest * F.col("r.n") + 1e-9) & (F.col("r.n") <= longest * F.col("l.n") + 1e-9) & (apart("letters") <= total - 2 * matching) & (apart("runs") <= total - 2 - 2 * (3 * matching - total - 1))
    least = F.ceil((n + F.ceil(n * threshold / (2 - threshold) - 1e-9)) * (1.5 * threshold - 1) - 1 - 1e-9).cast("int")
    carried = ["city", "ord", "n", "letters", "runs", *extra]
    others = light.filter(F.least(n, F.lit(LONG)).isin(*long))
    few = by_rarity(others.filter(least > 0), "two", n - least).withColumn("key", F.explode("rare")).select(*carried, "key")
    found = [met(few, few, fits)]
    # names too short for such a pair, and those that they may be like
    tiny = [k for k in range(1, 60) if (k + math.ceil(k * threshold / (2 - threshold) - 1e-9)) * (1.5 * threshold - 1) <= 1]
    letters = others.filter(n <= longest * max(tiny, default=0)).withColumn("key", F.explode(F.array_distinct(F.filter(F.split("clean", ""), lambda c: c != "")))).select(*carried, "key")
    found.append(met(letters, letters, fits))
    for q in range(min(within, 3), 4) if within else ():
        every = light.filter(n >= within).withColumn("grams", F.array_distinct(runs_of(F.col("clean"), q)))
        rarest = by_rarity(every.filter((n == q) if q < 3 else (n >= q)), "grams", F.lit(1)).select(*carried, F.col("rare")[0].alias("key"))
        found.append(met(rarest, every.withColumn("key", F.explode("grams")).select(*carried, "key"), (F.col("l.n") <= F.col("r.n")) & (F.col("l.letters").bitwiseAND(F.col("r.letters")) == F.col("l.letters"))))
    return reduce(DataFrame.union, found).distinct()


def close_pairs(rows: DataFrame, threshold: float, within: int | None) -> DataFrame:
    """Pairs (a before b by ``ord``) of one city whose ``clean`` names may reach ``threshold``, or of which one holds the other and both have ``within`` characters.

    ``rows``: city, ord, clean and more; with a column ``changed``, only pairs with a changed row.
    What meets by runs is tested by the pairs of neighbours and the characters that both names have.
    """
    long, partners = lengths_by_deletions(rows, threshold)
    more = rows.withColumns({"_two": numbered(runs_of(F.col("clean"), 2)), "_one": characters(F.col("clean"))})
    whole = lambda side, df: df.select("city", F.col("ord").alias(f"ord_{side}"), F.struct(*df.columns).alias(side)).hint("merge")
    joined = lambda pairs, df: pairs.join(whole("a", df), ["city", "ord_a"]).join(whole("b", df), ["city", "ord_b"])
    a, b = F.col("a.clean"), F.col("b.clean")
    held = (F.length(a) >= within) & (F.length(b) >= within) & (a.contains(b) | b.contains(a)) if within else F.lit(False)
    found = [joined(by_deletions(rows, partners), rows).filter(~held).select("city", "a", "b")] if partners else []
    if long or within or not partners:
        lengths = F.length(a) + F.length(b)
        matching = F.ceil(threshold * lengths / 2 - 1e-9)
        alike = (F.size(F.array_intersect("a._two", "b._two")) >= 3 * matching - lengths - 1) & (F.size(F.array_intersect("a._one", "b._one")) >= matching)
        both_long = F.least(F.length(a), F.lit(LONG)).isin(*long) & F.least(F.length(b), F.lit(LONG)).isin(*long)  # others are found above
        plain = lambda side: F.col(side).dropFields("_two", "_one").alias(side)
        found.append(joined(by_runs(rows, threshold, within, long), more).filter((both_long & alike) | held).select("city", plain("a"), plain("b")))
    return reduce(DataFrame.union, found)


def shared_characters(a: Column, b: Column) -> Column:
    """Upper bound of the ratio by the characters that two names share."""
    both = F.size(F.array_intersect(characters(a), characters(b)))
    return 2 * both / (F.length(a) + F.length(b))


def unless(known: Column, value: float, a: Column, b: Column) -> Column:
    """``value`` where ``known`` holds, else the ratio, which is computed there only."""
    return F.when(known, F.lit(value)).otherwise(T.sequence_ratio(F.when(~known, a), F.when(~known, b)))


def each_record(keyed: DataFrame) -> DataFrame:
    """``keyed`` records (city, clean, key, rich, ord, url and more) with themselves as their first and last one."""
    own = F.array(F.struct("ord", "url"))
    return keyed.withColumns({"first": own, "last": own}).drop("ord", "url")


def as_classes(keyed: DataFrame) -> DataFrame:
    """``keyed`` records that differ by ``ord`` and ``url`` alone as one row each, with the first and last of them and the first and last at another address than those.

    A pair of two classes' records in one order at different addresses exists only if one of these makes it.
    """
    same = [c for c in keyed.columns if c not in ("ord", "url")]
    sites = keyed.groupBy(*same, "url").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
    place = lambda *order: F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    ends = [sites.withColumn("n", place(order)).filter("n <= 2").select(*same, F.struct(F.col(c).alias("ord"), "url").alias("end"), F.lit(c == "low").alias("low")) for c, order in (("low", F.col("low")), ("high", F.desc("high")))]
    held = lambda low: F.collect_list(F.when(F.col("low") == low, F.col("end")))
    return ends[0].union(ends[1]).groupBy(*same).agg(held(True).alias("first"), held(False).alias("last"))


def as_units(keyed: DataFrame, more: list[str], copies: bool) -> DataFrame:
    """What is paired: records, or classes of them; written, as both sides of pairs read it."""
    url = T.normal_url(F.col("website")) if "website" in keyed.columns else F.lit("")
    columns = ["city", "clean", "key", "rich", *more, *(["changed"] if "changed" in keyed.columns else [])]
    light = keyed.select(*columns, "ord", F.coalesce(url, F.lit("")).alias("url"))
    return each_record(light) if copies else settled(as_classes(light), "classes")


def name_pairs(units: DataFrame, threshold: float, within: int | None) -> DataFrame:
    """(city, one, other, ratio): different names of one city whose ratio reaches ``threshold`` in that order, if a record of one is before one of the other, and each name with itself; with ``within`` one that holds the other counts 0.9."""
    flags = [F.max("changed").alias("changed")] if "changed" in units.columns else []
    ends = [F.min(F.array_min(F.transform("first", lambda x: x["ord"]))).alias("low"), F.max(F.array_max(F.transform("last", lambda x: x["ord"]))).alias("high")]
    names = units.filter(F.length("clean") > 0).groupBy("city", "clean").agg(F.first("clean").alias("ord"), *ends, *flags)
    names = settled(names.select("city", "ord", "clean", "low", "high", *(["changed"] if flags else [])), "different-names")
    close = settled(close_pairs(names, threshold, within).select("city", "a", "b"), "close-names")
    itself = names.filter("changed") if flags else names
    order = lambda a, b: close.filter(F.col(f"{a}.low") < F.col(f"{b}.high")).select("city", F.col(f"{a}.clean").alias("one"), F.col(f"{b}.clean").alias("other"))
    every = order("a", "b").union(order("b", "a")).union(itself.select("city", "clean", "clean"))
    a, b = F.col("one"), F.col("other")
    ratio = unless(inside(a, b), 0.9, a, b) if within else T.sequence_ratio(a, b)
    return every.withColumn("ratio", ratio).filter(F.col("ratio") >= threshold)


def paired(units: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs a, b of units with names of a pair in ``names`` that have a record of a before one of b, both not at one address; with ``changed``, those with a changed one."""
    side = lambda s, name: units.select("city", F.col("clean").alias(name), F.struct(*[c for c in units.columns if c != "city"]).alias(s))
    both = names.join(side("a", "one"), ["city", "one"]).join(side("b", "other").hint("merge"), ["city", "other"])
    meet = F.exists("a.first", lambda x: F.exists("b.last", lambda y: (x["ord"] < y["ord"]) & ((x["url"] != y["url"]) | (x["url"] == ""))))
    return both.filter(meet & (F.col("a.changed") | F.col("b.changed")) if "changed" in units.columns else meet)


def decided(pairs: DataFrame, copies: bool) -> DataFrame:
    """Candidates: the richer record wins, the first of equals; without ``copies`` each once."""
    wins = F.col("a.rich") >= F.col("b.rich")
    pick = lambda first: F.when(wins, F.col(f"{first[0]}.key")).otherwise(F.col(f"{first[1]}.key"))
    out = pairs.select(pick("ab").alias("winner"), pick("ba").alias("loser"), F.round("ratio", 4).alias("similarity"), F.lit("fuzzy_name").alias("signal"))
    return out if copies else out.distinct()


def url_members(rows: DataFrame, across: str | None) -> DataFrame:
    """(winner, loser) of records with one address in a city: every record goes to the richest of its group, so that groups don't turn into all pairs.

    With ``across`` a group counts only if it has several values of that column.
    """
    url = T.normal_url(F.col("website"))
    addressed = rows.select("city", url.alias("url"), "ord", "key", "rich", *([across] if across else [])).filter("url <> ''")
    group = ["city", "url"]
    several = [(F.min(across) < F.max(across)).alias("several")] if across else []
    sums = addressed.groupBy(*group).agg(F.min_by("key", F.struct((-F.col("rich")).alias("r"), "ord")).alias("winner"), F.count("*").alias("n"), *several)
    sums = sums.filter("several" if across else "n > 1")
    return addressed.join(sums, group).filter("key <> winner").select("winner", F.col("key").alias("loser"))


def at_addresses(keyed: DataFrame, addresses: DataFrame | None) -> DataFrame:
    """Rows with one of ``addresses`` (city, url), if there are such."""
    return keyed if addresses is None else keyed.withColumn("url", T.normal_url(F.col("website"))).join(addresses, ["city", "url"], "left_semi").drop("url")


def flagged(keyed: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Rows told by ``changed`` whether their key is in ``changed``, if there are such."""
    return keyed if changed is None else keyed.join(changed.select("key", F.lit(True).alias("changed")).distinct(), "key", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


def community_candidates(rows: DataFrame, threshold: float = 0.85, changed: DataFrame | None = None, addresses: DataFrame | None = None, copies: bool = True) -> DataFrame:
    """Communities (id, name, city, topic and fields) of one city and different topics: by address as groups, by name as pairs.

    Only pairs with a key of ``changed``, and groups of ``addresses`` (city, url), if these are given. Records of one key
    are copies: without ``copies`` a candidate stands once for all pairs of those of its keys, and work goes with
    different names and keys instead of all such pairs.
    """
    keyed = T.with_record_key(rows, "c", ["name", "city", "topic"]).withColumns({"ord": F.struct("topic", "id"), "rich": richness(rows.columns), "clean": T.strip_articles(without_city(F.col("name"), F.col("city")))})
    keyed = settled(keyed.select("city", "ord", "key", "topic", "rich", "website", "clean"), "names")  # read several times
    by_url = url_members(at_addresses(keyed, addresses), "topic").select("winner", "loser", F.lit(1.0).alias("similarity"), F.lit("url_match").alias("signal"))
    units = as_units(flagged(keyed, changed), ["topic"], copies)
    names = name_pairs(units, threshold, 5).filter(says_something(F.col("one"), F.col("other")))
    by_name = decided(paired(units, names).filter("a.topic <> b.topic"), copies)
    return (by_url if copies else by_url.distinct()).unionByName(by_name)


def venue_candidates(rows: DataFrame, threshold: float = 0.85, changed: DataFrame | None = None, addresses: DataFrame | None = None, copies: bool = True) -> DataFrame:
    """Venues (id, name, city and fields) of one city: by address as groups, by name as pairs; ``changed``, ``addresses`` and ``copies`` as for communities."""
    keyed = T.with_record_key(rows, "v", ["name", "city"]).withColumns({"ord": F.struct("id"), "rich": richness(rows.columns), "clean": T.strip_articles(F.col("name"))})
    keyed = settled(keyed.select("city", "ord", "key", "rich", "website", "clean"), "names")  # read several times
    by_url = url_members(at_addresses(keyed, addresses), None).select("winner", "loser", F.lit(1.0).alias("similarity"), F.lit("url_match").alias("signal"))
    units = as_units(flagged(keyed, changed), [], copies)
    by_name = decided(paired(units, name_pairs(units, threshold, None)), copies)
    return (by_url if copies else by_url.distinct()).unionByName(by_name)


def people_candidates(rows: DataFrame, threshold: float = 0.9, communities: float = 0.7, changed: DataFrame | None = None, copies: bool = True) -> DataFrame:
    """People of one city whose names and whose communities' names are alike; ``changed`` and ``copies`` as for communities."""
    keyed = T.with_record_key(rows, "p", ["name", "city", "role", "community_name"]).withColumns({"ord": F.struct("id"), "rich": richness(rows.columns), "clean": T.strip_articles(F.col("name")), "group": T.strip_articles(F.col("community_name"))})
    keyed = settled(keyed.select("city", "ord", "key", "rich", "clean", "group"), "names")  # read several times
    units = as_units(flagged(keyed, changed), ["group"], copies)
    pairs = paired(units, name_pairs(units, threshold, None))
    return decided(pairs.filter(T.sequence_ratio(F.col("a.group"), F.col("b.group")) >= communities), copies)


# inside a pair of city and topic -------------------------------------------------


def passed_over(group: pd.DataFrame) -> pd.DataFrame:
    """The places that another row stands for, of rows in order that are alike by name or by site.

    A row joins the oldest group whose standing row it is like, and stands for it if it
    is richer. One row of each name has ``near``: the earlier names that the name is like.
    """
    like = {name: near for name, near in zip(group["clean"], group["near"], strict=True) if near is not None}
    standing: list[tuple[int, int, str, str | None]] = []
    names: dict[str, set[int]] = {}
    sites: dict[str, set[int]] = {}
    gone = []
    for place, rich, name, site in group.sort_values("place")[["place", "rich", "clean", "site"]].itertuples(index=False):
        near = set().union(*(names[x] for x in like.get(name, ()) if x in names), sites.get(site, ()) if site else ())
        number = min(near, default=len(standing))
        if near and rich <= standing[number][1]:
            gone.append(place)
            continue
        if near:
            other, _, named, at = standing[number]
            gone.append(other)
            names[named].discard(number)
            if at:
                sites[at].discard(number)
            standing[number] = (place, rich, name, site)
        else:
            standing.append((place, rich, name, site))
        names.setdefault(name, set()).add(number)
        if site:
            sites.setdefault(site, set()).add(number)
    return pd.DataFrame({"pair": group["pair"].iloc[0], "place": pd.Series(gone, dtype="int64")})


def representatives(rows: DataFrame, threshold: float = 0.88) -> DataFrame:
    """``rows`` (city, topic, place, name, website and fields) without those that another of the same city and topic stands for.

    Names are compared without articles, each different one once however many rows have
    it. A task gets the rows that chains of likeness or of one site connect. Tables of
    rows are joined by merges: they are small as files, but not in memory.
    """
    pair = F.concat_ws("\x1f", "city", "topic")
    site = F.regexp_replace(F.coalesce("website", F.lit("")), "/+$", "")
    keyed = rows.withColumns({"pair": pair, "rich": richness(rows.columns), "site": F.when(F.col("website") != "", site), "clean": T.strip_articles(F.col("name"))})
    keyed = settled(keyed, "named-rows")  # read several times
    names = keyed.filter(F.length("clean") > 0).groupBy("pair", "clean").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    light = names.select(F.col("pair").alias("city"), F.col("clean").alias("ord"), "clean")
    close = close_pairs(light, threshold, 1).select(F.col("city").alias("pair"), F.col("a.clean").alias("a"), F.col("b.clean").alias("b"))
    both_ways = close.union(close.select("pair", "b", "a"))  # either may come first
    a, b = F.col("a"), F.col("b")
    alike = settled(both_ways.filter(unless(a.contains(b) | b.contains(a), 1.0, b, a) > threshold), "alike")
    near = names.select("pair", "clean", F.col("clean").alias("earlier")).union(alike.select("pair", F.col("b").alias("clean"), F.col("a").alias("earlier"))).groupBy("pair", "clean").agg(F.collect_list("earlier").alias("near"))
    # names and sites as ends of links; a row without a name is at its site only
    named, at = F.struct("pair", F.lit("n").alias("kind"), F.col("clean").alias("text")), F.struct("pair", F.lit("s").alias("kind"), F.col("site").alias("text"))
    shared = keyed.filter("site <> ''").groupBy("pair", "site").agg(F.count("*").alias("n")).filter("n > 1")
    sited = keyed.filter("site <> ''").groupBy("pair", "site", "clean").agg(F.lit(1).alias("one")).join(shared.hint("merge"), ["pair", "site"])
    by_name = alike.select(F.struct("pair", F.lit("n").alias("kind"), F.col("a").alias("text")).alias("a"), F.struct("pair", F.lit("n").alias("kind"), F.col("b").alias("text")).alias("b"))
    links = by_name.union(sited.select(F.when(F.length("clean") > 0, named).otherwise(at), at)).union(names.filter("n > 1").select(named, named))
    ends = components(links).select("id.pair", "id.kind", "id.text", F.col("root").alias("group"))
    held = lambda kind, column: ends.filter(F.col("kind") == kind).select("pair", F.col("text").alias(column), "group")
    some = keyed.select("pair", "place", F.col("rich").cast("long").alias("rich"), "clean", "site")
    grouped = some.filter(F.length("clean") > 0).join(held("n", "clean").hint("merge"), ["pair", "clean"]).unionByName(some.filter(F.coalesce(F.length("clean"), F.lit(0)) == 0).join(held("s", "site").hint("merge"), ["pair", "site"]))
    told = grouped.join(names.join(near.hint("merge"), ["pair", "clean"]).select("pair", "place", "near").hint("merge"), ["pair", "place"], "left")
    gone = told.groupBy("pair", "group").applyInPandas(passed_over, "pair string, place long")
    return keyed.join(gone.hint("merge"), ["pair", "place"], "left_anti").select(*rows.columns)


def save_pairs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The records of all pairs (key, city, topic, name, hidden and fields) after a run: pairs that came in are replaced by what both have, incoming ones first by key, without duplicates; a record that was hidden stays so."""
    pairs = incoming.select("city", "topic").distinct()
    both = stored.join(pairs, ["city", "topic"], "left_semi").withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = both.groupBy("key").agg(F.max_by(F.struct(*stored.columns), "_new").alias("r")).select("r.*")
    placed = last.withColumn("place", F.row_number().over(Window.partitionBy("city", "topic").orderBy("name", "key")).cast("long"))
    kept = representatives(placed).drop("place")
    was_hidden = stored.filter("hidden").select("key", F.lit(True).alias("_was"))
    shown = kept.join(was_hidden, "key", "left").withColumn("hidden", F.coalesce("_was", F.lit(False))).select(*stored.columns)
    return stored.join(pairs, ["city", "topic"], "left_anti").select(*stored.columns).unionByName(shown)


@registry.add()
def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each city and topic without duplicates, in order of their names."""
    rows = records(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("city", "topic").orderBy("name", "id")).cast("long"))
    return representatives(rows).select("city", "topic", "id", "name")


@registry.add()
def saved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory after a run brought in some pairs anew."""
    rows = T.with_record_key(records(spark, sf_dir), "c", ["name", "city", "topic"]).dropDuplicates(["key"])
    rows = rows.select("key", "id", "name", "city", "topic", "website", "description", "social_links", "hidden")
    incoming = rows.filter("id % 3 = 1 AND topic = 'ECONOMY'").withColumns({"website": F.lit("http://new.example"), "hidden": F.lit(False)})
    return save_pairs(rows.filter("id % 3 <> 2"), incoming).select("key", "id", "hidden", "website")


_sig = "CASE WHEN website IS NULL THEN '' ELSE rtrim(lower(website), '/') END"
RICH_SQL = "CAST(coalesce(description, '') <> '' AS INT) + CAST(coalesce(meeting_schedule, '') <> '' AS INT) + CAST(coalesce(location, '') <> '' AS INT) + CAST(coalesce(contact, '') <> '' AS INT) + CAST(coalesce(website, '') <> '' AS INT) + len(social_links)"


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter(~F.col("hidden"))


@registry.add(f"{R} SELECT id, {RICH_SQL} AS richness FROM records")
def record_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each record tells."""
    rows = records(spark, sf_dir)
    return rows.select("id", richness(rows.columns).cast("long").alias("richness"))


@registry.add(f"""{R}, k AS (SELECT id, city, topic, trim({_sig}) AS url, {RICH_SQL} AS rich FROM records WHERE NOT hidden), g AS (SELECT *, count(DISTINCT topic) OVER (PARTITION BY city, url) AS topics, first_value(id) OVER (PARTITION BY city, url ORDER BY rich DESC, topic, id) AS winner FROM k WHERE url NOT IN ('', 'n/a'))
SELECT city, url, winner, id AS loser FROM g WHERE topics > 1 AND id <> winner""")
def dup_candidates_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one city and address under different topics, each with the richest of them."""
    rows = _visible(spark, sf_dir)
    keyed = rows.withColumns({"key": F.col("id"), "ord": F.struct("topic", "id"), "rich": richness(rows.columns)})
    place = rows.select("id", "city", T.normal_url(F.col("website")).alias("url"))
    return url_members(keyed.select("city", "website", "ord", "key", "rich", "topic"), "topic").join(place, F.col("loser") == F.col("id")).select("city", "url", "winner", "loser")


@registry.add()
def dup_candidates_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates among communities."""
    return community_candidates(_visible(spark, sf_dir).select("id", "name", "city", "topic", "website", *RICH_FIELDS[:4], "social_links"), copies=False)


@registry.add()
def dup_candidates_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates among venues."""
    return venue_candidates(_visible(spark, sf_dir).select("id", "name", "city", "website", *RICH_FIELDS[:4], "social_links"), copies=False)


@registry.add()
def person_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates among people."""
    return people_candidates(people(spark, sf_dir), copies=False)


# the state of candidates ------------------------------------------------------


def with_candidates(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` candidates (entity, winner, loser, similarity, signal, resolution, id) after ``found`` ones (no resolution; ``id`` by age) come in.

    One row stands for an unordered pair: a decided pair stays as it is and is not
    raised again; a manual one keeps or gives its orientation; a found one turns
    an automatic one round; what is new is added.
    """
    pair = ["entity", F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi")]
    row = F.struct("winner", "loser", "similarity", "signal", "resolution", "id")
    manual = F.col("signal") == "manual"
    old = known.withColumn("row", row).groupBy(*pair).agg(F.collect_list(F.when(F.col("resolution").isNotNull(), F.col("row"))).alias("decided"), F.min_by("row", F.struct(~manual, "id")).alias("old"))
    new = found.withColumn("resolution", F.lit(None).cast("string")).withColumn("row", row).groupBy(*pair).agg(F.min_by("row", F.struct(~manual, "id")).alias("new"))
    both = old.join(new, ["entity", "lo", "hi"], "full_outer")
    stays = F.col("new").isNull() | ((F.col("old.signal") == "manual") & (F.col("new.signal") != "manual"))
    turned = F.struct(F.col("new.winner"), F.col("new.loser"), F.col("old.similarity"), F.when(F.col("new.signal") == "manual", "manual").otherwise(F.col("old.signal")).alias("signal"), F.lit(None).cast("string").alias("resolution"), F.col("old.id"))
    pending = F.when(F.col("old").isNull(), F.col("new")).when(stays, F.col("old")).otherwise(turned)
    rows = F.when(F.size("decided") > 0, F.col("decided")).otherwise(F.array(pending))
    return both.select("entity", F.explode(rows).alias("r")).select("entity", "r.*")


def still_valid(candidates: DataFrame, rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``candidates`` with those dismissed whose records are gone or no longer alike; manual ones stay while both records do.

    ``rows``: key, name, city, website.
    """
    side = lambda s: rows.select(F.col("key").alias(s), F.struct(F.lit(True).alias("there"), "name", "city", "website").alias(f"{s}_row"))
    both = candidates.join(side("winner"), "winner", "left").join(side("loser"), "loser", "left")
    clean = lambda s: T.strip_articles(without_city(F.col(f"{s}_row.name"), F.col("winner_row.city")))
    a, b = clean("winner"), clean("loser")
    site = T.normal_url(F.col("winner_row.website"))
    worth = says_something(a, b) & (inside(a, b) | (shared_characters(a, b) >= threshold))
    asked = both.withColumns({"_a": F.when(worth, a), "_b": F.when(worth, b)})
    alike = unless(inside(F.col("_a"), F.col("_b")), 0.9, F.col("_a"), F.col("_b")) >= threshold
    valid = F.col("winner_row").isNotNull() & F.col("loser_row").isNotNull() & ((F.col("signal") == "manual") | F.when(F.col("signal") == "url_match", (site == T.normal_url(F.col("loser_row.website"))) & (site != "")).otherwise(alike))
    return asked.withColumn("resolution", F.when(F.col("resolution").isNull() & ~F.coalesce(valid, F.lit(False)), "auto_dismissed").otherwise(F.col("resolution"))).select(*candidates.columns)


def detect_all(known: DataFrame, communities: DataFrame, venues: DataFrame, persons: DataFrame) -> DataFrame:
    """The candidates table after a scan: stale ones dismissed, then what the three detectors find brought in."""
    keyed = T.with_record_key(communities, "c", ["name", "city", "topic"]).select("key", "name", "city", "website")
    kept = still_valid(known.filter("entity = 'community'"), keyed).unionByName(known.filter("entity <> 'community'"))
    found = [df.withColumn("entity", F.lit(e)) for e, df in (("community", community_candidates(communities, copies=False)), ("venue", venue_candidates(venues, copies=False)), ("person", people_candidates(persons, copies=False)))]
    every = found[0].unionByName(found[1]).unionByName(found[2]).withColumn("id", F.lit(None).cast("long"))
    return with_candidates(kept, every)


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicgrid.operators.roles import table

    rows = table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey AND l_returnflag <> 'R'")
    signal = F.when(F.col("l_discount") > 0.08, "manual").otherwise("fuzzy_name")
    return rows.groupBy(F.col("l_partkey").alias("winner"), F.col("l_suppkey").alias("loser")).agg(F.max("l_tax").alias("similarity"), F.max(signal).alias("signal"), F.when(F.max("l_quantity") > 48, "dismissed").alias("resolution"), F.min("l_orderkey").alias("id")).withColumn("entity", F.lit("venue"))


@registry.add("""WITH known AS (SELECT l_partkey AS winner, l_suppkey AS loser, max(l_tax) AS similarity, max(CASE WHEN l_discount > 0.08 THEN 'manual' ELSE 'fuzzy_name' END) AS signal, CASE WHEN max(l_quantity) > 48 THEN 'dismissed' END AS resolution, min(l_orderkey) AS id FROM lineitem WHERE l_partkey <> l_suppkey AND l_returnflag <> 'R' GROUP BY 1, 2),
found AS (SELECT DISTINCT l_suppkey AS winner, l_partkey AS loser, 0.95 AS similarity, CASE WHEN l_partkey % 9 = 0 THEN 'manual' ELSE 'fuzzy_name' END AS signal, l_partkey * 1000 + l_suppkey AS id FROM lineitem WHERE l_partkey <> l_suppkey AND l_returnflag = 'R'),
k AS (SELECT *, least(winner, loser) AS lo, greatest(winner, loser) AS hi FROM known), kg AS (SELECT *, count(resolution) OVER (PARTITION BY lo, hi) AS n_decided, row_number() OVER (PARTITION BY lo, hi ORDER BY signal <> 'manual', id) AS rn FROM k),
f AS (SELECT *, least(winner, loser) AS lo, greatest(winner, loser) AS hi FROM found), fg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY signal <> 'manual', id) AS rn FROM f) WHERE rn = 1),
decided AS (SELECT winner, loser, similarity, signal, resolution, id FROM kg WHERE n_decided > 0 AND resolution IS NOT NULL), open_old AS (SELECT * FROM kg WHERE n_decided = 0 AND rn = 1)
SELECT 'venue' AS entity, * FROM decided
UNION ALL SELECT 'venue', CASE WHEN fg.winner IS NULL OR (o.signal = 'manual' AND fg.signal <> 'manual') THEN o.winner ELSE fg.winner END, CASE WHEN fg.winner IS NULL OR (o.signal = 'manual' AND fg.signal <> 'manual') THEN o.loser ELSE fg.loser END, o.similarity, CASE WHEN fg.signal = 'manual' THEN 'manual' ELSE o.signal END, NULL, o.id FROM open_old o LEFT JOIN fg ON fg.lo = o.lo AND fg.hi = o.hi
UNION ALL SELECT 'venue', fg.winner, fg.loser, fg.similarity, fg.signal, NULL, fg.id FROM fg WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lo = fg.lo AND k.hi = fg.hi)""")
def candidate_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates table after a scan found pairs again, some the other way round."""
    from civicgrid.operators.roles import table

    rows = table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("winner"), F.col("l_partkey").alias("loser")).distinct()
    found = rows.select("winner", "loser", F.lit(0.95).alias("similarity"), F.when(F.col("loser") % 9 == 0, "manual").otherwise("fuzzy_name").alias("signal"), (F.col("loser") * 1000 + F.col("winner")).alias("id"), F.lit("venue").alias("entity"))
    return with_candidates(_known(spark, sf_dir), found)


# merged records ---------------------------------------------------------------


def all_sources(urls: Column, source: Column) -> Column:
    return T.with_source(F.coalesce(urls, F.array().cast("array<string>")), source)


def merge_communities(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``rows`` (key, source_url, source_urls, hidden and more) after ``merges`` (winner, loser): losers are hidden, their sources join the winner's, in the order of the losers' keys.

    A merge that lacks a record does nothing.
    """
    there = rows.select("key")
    real = merges.select("winner", "loser").distinct().join(there.withColumnRenamed("key", "winner"), "winner", "left_semi").join(there.withColumnRenamed("key", "loser"), "loser", "left_semi")
    sources = rows.select(F.col("key").alias("loser"), all_sources(F.col("source_urls"), F.col("source_url")).alias("more"))
    gained = real.join(sources, "loser").groupBy(F.col("winner").alias("key")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("loser", "more"))), lambda x: x["more"])).alias("gained"))
    lost = real.select(F.col("loser").alias("key"), F.lit(True).alias("lost")).distinct()
    out = rows.join(gained, "key", "left").join(lost, "key", "left")
    own = all_sources(F.col("source_urls"), F.col("source_url"))
    merged = F.when(F.col("gained").isNull(), F.col("source_urls")).otherwise(F.array_distinct(F.concat(own, F.coalesce("gained", F.array().cast("array<string>")))))
    return out.withColumns({"source_urls": merged, "hidden": F.col("hidden") | F.coalesce("lost", F.lit(False))}).select(*rows.columns)


def merge_entities(rows: DataFrame, merges: DataFrame, lists: list[str], texts: list[str]) -> DataFrame:
    """Venues or people after ``merges`` (winner, loser), each loser once: the winner's empty texts are filled from its losers in order of their keys, lists are joined, losers go."""
    real = merges.join(rows.select(F.col("key").alias("winner")), "winner", "left_semi").join(rows.select(F.col("key").alias("loser")), "loser", "left_semi")
    lost = rows.withColumnRenamed("key", "loser").join(real, "loser").withColumn("source_urls", all_sources(F.col("source_urls"), F.col("source_url")))
    first = [F.min_by(known_text(F.col(t)), F.when(known_text(F.col(t)).isNotNull(), F.col("loser"))).alias(f"_{t}") for t in texts]
    every = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("loser", F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda x: x["x"])).alias(f"_{c}") for c in lists]
    gains = lost.groupBy(F.col("winner").alias("key")).agg(*first, *every)
    kept = rows.join(real.select(F.col("loser").alias("key")).distinct(), "key", "left_anti").join(gains, "key", "left")
    filled = {t: F.coalesce(known_text(F.col(t)), F.col(f"_{t}"), F.col(t)) for t in texts}
    empty = F.array().cast("array<string>")
    own = lambda c: all_sources(F.col(c), F.col("source_url")) if c == "source_urls" else F.coalesce(F.col(c), empty)
    unions = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.array_distinct(F.concat(own(c), F.coalesce(f"_{c}", empty)))) for c in lists}
    return kept.withColumns({**filled, **unions}).select(*rows.columns)


def resolve_edits(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """``edits`` (name, city, topic of the record that was shown, and more) with the ``key`` of the record that they mean, of ``rows`` (key, name, city, topic).

    That is the record of this identity, else the only one whose name and city agree by their match keys, else none.
    """
    exact = T.with_record_key(edits.drop("key"), "c", ["name", "city", "topic"], "_exact").join(rows.select(F.col("key").alias("_exact"), F.lit(True).alias("_there")), "_exact", "left")
    loose = lambda df: T.split_by_letters(df, T.match_key, ["name", "city"], lambda part, way: part.withColumns({"_name": way(F.col("name")), "_city": way(F.col("city"))}))
    only = loose(rows.select("key", "name", "city")).groupBy("_name", "_city").agg(F.count("*").alias("_n"), F.min("key").alias("_only")).filter("_n = 1").drop("_n")
    both = loose(exact).join(only, ["_name", "_city"], "left")
    return both.select(*[c for c in edits.columns if c != "key"], F.when(F.col("_there"), F.col("_exact")).otherwise(F.col("_only")).alias("key"))


IDENTITY = {"wrong_city": "city", "wrong_topic": "topic", "name_correction": "name"}


def apply_edits(rows: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, state of each edit) after approved ``edits`` (key, change, value), one for a record at most.

    An edit of identity gives the record a new key; where that key is taken, its sources
    join the record there, which becomes visible, and it is hidden itself.
    """
    known = edits.join(rows.select("key", F.lit(True).alias("there")), "key", "left")
    joined_rows = rows.join(edits.select("key", "change", "value"), "key", "left")
    moves = F.coalesce(F.col("change").isin(*IDENTITY), F.lit(False))
    meant = {c: F.when(F.col("change") == change, F.col("value")).otherwise(F.col(c)) for change, c in IDENTITY.items()}
    rekeyed = joined_rows.withColumn("new_key", F.when(moves, T.record_key("c", meant["name"], meant["city"], meant["topic"])).otherwise(F.col("key")))
    taken = rows.select(F.col("key").alias("new_key"), F.lit(True).alias("taken"))
    placed = rekeyed.join(taken, "new_key", "left").withColumn("collides", moves & (F.col("new_key") != F.col("key")) & F.coalesce("taken", F.lit(False)))
    applied = {c: F.when(F.col("collides"), F.col(c)).otherwise(value) for c, value in meant.items()}
    archived = F.coalesce(F.col("change").isin("archive", "delete"), F.lit(False))
    after = placed.withColumns({**applied, "key": F.when(F.col("collides"), F.col("key")).otherwise(F.col("new_key")), "hidden": F.col("hidden") | archived | F.col("collides")}).select(*rows.columns)
    moved = placed.filter("collides").select(F.col("new_key").alias("winner"), F.col("key").alias("loser"))
    merged = merge_communities(after, moved)
    targets = moved.select(F.col("winner").alias("key"), F.lit(True).alias("target")).distinct()
    shown = merged.join(targets, "key", "left").withColumn("hidden", F.when(F.coalesce("target", F.lit(False)), False).otherwise(F.col("hidden"))).select(*rows.columns)
    merged_keys = moved.select(F.col("loser").alias("key"), F.lit(True).alias("merged"))
    state = F.when(F.col("there").isNull(), "not_found").when(F.col("merged"), "merged").when(F.col("change").isin(*IDENTITY, "archive", "delete"), "ok").otherwise("unsupported")
    return shown, known.join(merged_keys, "key", "left").select("key", "change", state.alias("state"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("id").alias("key"), "source_url", "source_urls", "hidden", "website", "contact", "description", "social_links")


_ALL = "CASE WHEN list_contains(source_urls, source_url) THEN source_urls ELSE list_concat([source_url], source_urls) END"
_distinct = lambda x: f"list_filter({x}, lambda u, i: list_position({x}, u) = i)"


@registry.add(f"""{R}, m AS (SELECT id - id % 20 AS winner, id AS loser FROM records WHERE id % 20 IN (7, 4) AND id - id % 20 < (SELECT max(id) FROM records)), g AS (SELECT winner, flatten(list({_ALL} ORDER BY loser)) AS gained FROM m JOIN records r ON r.id = m.loser GROUP BY winner), w AS (SELECT r.id, r.hidden, r.source_urls, gained, list_concat({_ALL}, gained) AS every FROM records r LEFT JOIN g ON g.winner = r.id)
SELECT id AS key, hidden OR id IN (SELECT loser FROM m) AS hidden, array_to_string(CASE WHEN gained IS NULL THEN source_urls ELSE {_distinct('every')} END, '{SEPARATOR}') AS source_urls FROM w""")
def merged_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of every twenty merge into the first."""
    rows = _keyed(spark, sf_dir)
    merges = rows.filter("key % 20 IN (7, 4)").select((F.col("key") - F.col("key") % 20).alias("winner"), F.col("key").alias("loser"))
    return merge_communities(rows, merges).select("key", "hidden", joined("source_urls"))


@registry.add(f"""{R}, m AS (SELECT id - id % 20 AS winner, id AS loser FROM records WHERE id % 20 IN (7, 4)),
g AS (SELECT winner, flatten(list({_ALL} ORDER BY loser)) AS urls, flatten(list(social_links ORDER BY loser)) AS links, arg_min(website, loser) FILTER (trim(website) <> '') AS site, arg_min(description, loser) FILTER (trim(description) <> '') AS about FROM m JOIN records r ON r.id = m.loser GROUP BY winner),
w AS (SELECT r.*, urls, links, site, about, list_concat({_ALL}, urls) AS every, list_concat(social_links, links) AS every_link FROM records r LEFT JOIN g ON g.winner = r.id WHERE r.id NOT IN (SELECT loser FROM m))
SELECT id AS key, coalesce(website, site) AS website, coalesce(description, about) AS description, array_to_string(CASE WHEN urls IS NULL THEN source_urls ELSE {_distinct('every')} END, '{SEPARATOR}') AS source_urls, array_to_string(CASE WHEN links IS NULL THEN social_links ELSE {_distinct('every_link')} END, '{SEPARATOR}') AS social_links FROM w""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merges under the rules for venues and people."""
    rows = _keyed(spark, sf_dir)
    merges = rows.filter("key % 20 IN (7, 4)").select((F.col("key") - F.col("key") % 20).alias("winner"), F.col("key").alias("loser"))
    return merge_entities(rows, merges, ["source_urls", "social_links"], ["website", "description"]).select("key", "website", "description", joined("source_urls"), joined("social_links"))


key_sql = lambda n, c, t: f"'c2:' || left(sha256(lower(regexp_replace(trim({n}), '\\s+', ' ', 'g')) || chr(31) || lower({c}) || chr(31) || lower({t})), 24)"


def _by_identity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = T.with_record_key(records(spark, sf_dir), "c", ["name", "city", "topic"])
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter("n = 1").drop("n")
    value = F.when(F.col("id") % 5 == 0, "Brand#7").when(F.col("id") % 5 == 1, "ECONOMY").otherwise("small ring")
    change = F.element_at(F.array(*map(F.lit, ("wrong_city", "wrong_topic", "name_correction", "archive", "typo"))), (F.col("id") % 5 + 1).cast("int"))
    edits = one.filter("id % 40 < 5").select("key", change.alias("change"), value.alias("value"))
    return one.select("key", "id", "name", "city", "topic", "source_url", "source_urls", "hidden"), edits


@registry.add(f"""{R}, k AS (SELECT *, {key_sql('name', 'city', 'topic')} AS key FROM records), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1),
e AS (SELECT key, id, ['wrong_city', 'wrong_topic', 'name_correction', 'archive', 'typo'][id % 5 + 1] AS change, CASE id % 5 WHEN 0 THEN 'Brand#7' WHEN 1 THEN 'ECONOMY' ELSE 'small ring' END AS value, name, city, topic FROM o WHERE id % 40 < 5),
n AS (SELECT key, change, CASE change WHEN 'wrong_city' THEN {key_sql('name', 'value', 'topic')} WHEN 'wrong_topic' THEN {key_sql('name', 'city', 'value')} WHEN 'name_correction' THEN {key_sql('value', 'city', 'topic')} ELSE key END AS new_key FROM e)
SELECT key, change, CASE WHEN change = 'typo' THEN 'unsupported' WHEN new_key <> key AND new_key IN (SELECT key FROM o) THEN 'merged' ELSE 'ok' END AS state FROM n""")
def edit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What approved edits come to."""
    return apply_edits(*_by_identity(spark, sf_dir))[1]


@registry.add(f"""{R}, k AS (SELECT *, {key_sql('name', 'city', 'topic')} AS key FROM records), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1),
e AS (SELECT id AS edit, CASE WHEN id % 3 = 0 THEN upper(replace(name, ' ', '-')) ELSE name END AS name, city, CASE WHEN id % 2 = 0 THEN topic ELSE 'moved' END AS topic FROM o WHERE id % 4 < 3), x AS (SELECT *, {key_sql('name', 'city', 'topic')} AS exact FROM e),
m AS (SELECT lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS n, lower(regexp_replace(city, '[^A-Za-z0-9]', '', 'g')) AS c, min(key) AS only FROM o GROUP BY ALL HAVING count(*) = 1)
SELECT edit, CASE WHEN o.key IS NOT NULL THEN o.key ELSE m.only END AS key FROM x LEFT JOIN o ON o.key = exact LEFT JOIN m ON m.n = lower(regexp_replace(x.name, '[^A-Za-z0-9]', '', 'g')) AND m.c = lower(regexp_replace(x.city, '[^A-Za-z0-9]', '', 'g'))""")
def resolved_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that edits mean, some of which were renamed or moved since."""
    one = _by_identity(spark, sf_dir)[0]
    name = F.when(F.col("id") % 3 == 0, F.upper(F.replace("name", F.lit(" "), F.lit("-")))).otherwise(F.col("name"))
    edits = one.filter("id % 4 < 3").select(F.col("id").alias("edit"), name.alias("name"), "city", F.when(F.col("id") % 2 == 0, F.col("topic")).otherwise("moved").alias("topic"))
    return resolve_edits(edits, one).select("edit", "key")


QUERIES, ORACLE = registry.queries, registry.oracle
