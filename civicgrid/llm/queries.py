"""The numbered queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.llm import decontaminate, embedding_dedup, hard_negatives, language_id, ngram_join, packing, sentencepiece_bpe, spelling, suffix_dedup, token_frames, toxicity, url_templates, warc
from civicgrid.llm.common import crc_bucket, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, weights).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build_derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("source_id", "page_id")


def op5_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_classes(table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept", "kept_text")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(vectors, vec_id % 50 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf_dir, "documents"))


_ALL = (
    op1_language_id, op2_decontamination, op3_toxicity, op4_warc_derivatives, op5_token_frames, op6_url_templates, op7_embedding_dedup, op8_best_fit_packing, op9_suffix_dedup, op10_ngram_jaccard_join,
    op11_sentencepiece, op12_hard_negatives, op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}
OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda c: c IS NOT NULL AND isfinite(c))) AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS root FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id WHERE r.root < l.b
), least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, n, k, item FROM dw JOIN iw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b),
least_id AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM d JOIN least_id USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _crc_table() -> str:
    """The 256 steps of the crc32 for one byte, eight hex digits each."""
    steps = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        steps.append(f"{value:08x}")
    return "".join(steps)


OP13_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
t AS (SELECT doc_id, w, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r WHERE length(w) >= 7 GROUP BY doc_id, w),
h AS (SELECT w, c, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)), lambda a, b: xor(a >> 8, CAST('0x' || substr('{_crc_table()}', CAST((xor(a, b) & 255) * 8 + 1 AS INTEGER), 8) AS BIGINT))), 4294967295) AS h FROM t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
del AS (SELECT DISTINCT word, n, word[1:k - 1] || word[k + 1:] AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.d = b.d AND a.word <> b.word AND length(a.word) = length(b.word)
  WHERE len(list_filter(range(1, length(a.word) + 1), lambda k: a.word[k] <> b.word[k])) = 1
  UNION SELECT a.word, b.word, b.n FROM del a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM del a JOIN words b ON a.d = b.word
),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, form := near)) AS best FROM near GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.form END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS here, form AS next, 0 AS step FROM f UNION ALL SELECT walk.word, f.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.next),
ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON f.word = ends.word
"""

ORACLE: dict[str, str] = {
    "op2_decontamination": OP2_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op6_url_templates": url_templates.judge_sql(), "op7_embedding_dedup": OP7_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL,
}
