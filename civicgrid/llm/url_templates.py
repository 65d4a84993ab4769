"""URL filters: explicit rules first, then a path-template tree for each host.

The tree's first reading of a path writes ``*`` for every run of digits in its
segments. Then, level by level from the root, below each node of a host:

* variable segments become wildcards: where a node has more than
  ``max_children`` different segments, those that carry less than 1 in
  ``max_children`` of its pages become ``*``;
* statistically similar branches merge: a branch whose labelled share of blocked
  pages doesn't differ from its siblings' (two proportions, ``z`` standard errors,
  at least ``min_labelled`` labels on either side) becomes ``*`` too.

Levels below ``depth`` count as one segment. Labels are the verdicts of the rules.
A template is rejected if (blocked + weight / 2) / (labelled + weight) is at
least ``reject``. All of it is DataFrame expressions; pages are summed to their
readings before anything moves, so a hot host is a few rows.

A null url or one without ``://`` has an empty host and path and forms its own
template. Repeated rows count as often as they occur. Without rules all is
allowed. An empty table gives no rows. Only page_id and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: (host and path, verdict) of the rules in force.
RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


@dataclass(frozen=True)
class Tree:
    depth: int = 4
    max_children: int = 20
    min_labelled: int = 5
    z: float = 1.96
    weight: float = 2.0
    reject: float = 0.9


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased, path up to ``?`` or ``#``."""
    tail = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    tail = F.coalesce(tail, F.lit(""))
    return F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def matching(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def reading(path: Column, depth: int) -> Column:
    """The path's segments, digits as ``*``; what lies below ``depth`` is one more."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*"), "/")
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.array_join(F.slice(parts, depth + 1, 1_000_000), "/")))).otherwise(parts)


def templates(readings: DataFrame, tree: Tree) -> DataFrame:
    """host, segments and template of each reading (host, segments, n, labelled, blocked)."""
    rows = readings.withColumn("prefix", F.lit(""))
    for level in range(tree.depth + 1):
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        child = rows.filter(F.col("segment").isNotNull()).groupBy("host", "prefix", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        node = child.groupBy("host", "prefix").agg(F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        rest = F.col("all_labelled") - F.col("labelled")
        pool = F.col("all_blocked") / F.col("all_labelled")
        error = F.sqrt(pool * (1 - pool) * (1 / F.col("labelled") + 1 / rest))
        apart = F.abs(F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / rest)
        similar = F.when((F.col("labelled") >= tree.min_labelled) & (rest >= tree.min_labelled), apart <= tree.z * error).otherwise(F.lit(False))
        variable = (F.col("children") > tree.max_children) & (F.col("n") * tree.max_children < F.col("all_n"))
        named = child.join(node, ["host", "prefix"]).select("host", "prefix", "segment", F.when(variable | similar, "*").otherwise(F.col("segment")).alias("name"))
        rows = rows.join(named, ["host", "prefix", "segment"], "left").withColumn("prefix", F.when(F.col("segment").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), "name"))).drop("segment", "name")
        rows = materialise(rows, f"level-{level}")
    return rows.withColumnRenamed("prefix", "template")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = matching(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": text, "by_rule": verdict, "segments": reading(F.col("path"), tree.depth)})
    labelled = F.col("by_rule").isNotNull()
    readings = split.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(labelled).alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    named = templates(materialise(readings, "readings"), tree)
    purity = named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = purity.select("host", "template", ((F.col("blocked") + tree.weight / 2) / (F.col("labelled") + tree.weight) >= tree.reject).alias("rejected"))
    found = materialise(named.select("host", "segments", "template").join(purity, ["host", "template"]), "templates")
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return split.join(found, ["host", "segments"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "template")


def judge_sql(rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> str:
    """The same as SQL for DuckDB over ``pages``."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    tail = "CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END"
    steps = [
        f"tails AS (SELECT page_id, coalesce({tail}, '') AS tail FROM pages)",
        f"split0 AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM tails)",
        f"split1 AS (SELECT *, {case([r.text for r in ordered])} AS rule, {case([r.verdict for r in ordered])} AS by_rule, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '*', 'g'), '/') AS parts FROM split0)",
        f"split2 AS (SELECT *, CASE WHEN len(parts) > {tree.depth} THEN list_append(parts[1:{tree.depth}], array_to_string(parts[{tree.depth + 1}:], '/')) ELSE parts END AS segments FROM split1)",
        "rows0 AS (SELECT host, segments, '' AS prefix, count(*) AS n, count(by_rule) AS labelled, count(*) FILTER (by_rule = 'block') AS blocked FROM split2 GROUP BY host, segments)",
    ]
    for level in range(tree.depth + 1):
        steps += [
            f"child{level} AS (SELECT host, prefix, segments[{level + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM rows{level} WHERE len(segments) > {level} GROUP BY ALL)",
            f"node{level} AS (SELECT host, prefix, count(*) AS children, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(blocked) AS all_blocked FROM child{level} GROUP BY ALL)",
            f"""named{level} AS (SELECT host, prefix, segment, CASE WHEN children > {tree.max_children} AND n * {tree.max_children} < all_n THEN '*'
              WHEN labelled >= {tree.min_labelled} AND all_labelled - labelled >= {tree.min_labelled}
                AND abs(blocked / labelled - (all_blocked - blocked) / (all_labelled - labelled)) <= {tree.z} * sqrt((all_blocked / all_labelled) * (1 - all_blocked / all_labelled) * (1 / labelled + 1 / (all_labelled - labelled))) THEN '*'
              ELSE segment END AS name FROM child{level} JOIN node{level} USING (host, prefix))""",
            f"""rows{level + 1} AS (SELECT r.host, segments, CASE WHEN name IS NULL THEN r.prefix ELSE r.prefix || '/' || name END AS prefix, n, labelled, blocked
              FROM rows{level} r LEFT JOIN named{level} m ON m.host = r.host AND m.prefix = r.prefix AND m.segment = r.segments[{level + 1}])""",
        ]
    last = f"rows{tree.depth + 1}"
    steps.append(f"purity AS (SELECT host, prefix, (sum(blocked) + {tree.weight / 2}) / (sum(labelled) + {tree.weight}) >= {tree.reject} AS rejected FROM {last} GROUP BY ALL)")
    return f"""WITH {', '.join(steps)}
SELECT page_id, s.host AS host, path, rule, coalesce(by_rule, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, r.prefix AS template
FROM split2 s JOIN {last} r ON r.host = s.host AND r.segments = s.segments JOIN purity p ON p.host = r.host AND p.prefix = r.prefix"""
