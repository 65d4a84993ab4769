"""WARC derivatives, URL templates, the pipeline and the registered queries."""

import hashlib
import os

import duckdb
import pytest

import corpus_pipeline
from civicgrid.llm import common, queries, url_templates, warc

SF = "/root/testdata/sf0.001"
PAGE = '<!DOCTYPE html><html lang="hu"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One<br>two &lt;three&gt;</p><script>x("</p>")</script><a href="/x?a=1&amp;b=2">go</a></body></html>'


def test_conversion_and_metadata_records(spark):
    pages = spark.createDataFrame([(1, "http://a.example/é", PAGE), (2, None, None), (3, "http://b.example/", ""), (None, "x", "plain"), (1, "http://a.example/é", PAGE)], "page_id long, url string, html string").selectExpr("*", "'c' AS block", "'d' AS record_id")
    out = warc.build_derivatives(warc.responses_from_pages(pages)).collect()
    assert len(out) == 10
    first = {r["warc_type"]: r for r in out if r["source_id"] == 1}
    assert first["conversion"]["block"] == "One\ntwo <three>\ngo"
    assert first["metadata"]["block"] == "title: A & B\r\nlanguage: hu\r\noutlink: /x?a=1&b=2\r\nsource-header: Content-Type: text/html; charset=utf-8\r\n"
    assert first["conversion"]["refers_to"] == first["metadata"]["refers_to"] != first["conversion"]["record_id"]
    assert first["conversion"]["payload_digest"] == warc.digest(PAGE.encode()) and first["conversion"]["block_digest"] == warc.digest(first["conversion"]["block"].encode())
    assert warc.build_derivatives(warc.responses_from_pages(pages.limit(0))).count() == 0


def test_given_record_ids_are_kept(spark):
    given = spark.createDataFrame([(1, "<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "Server: x\r\nContent-Type: text/html", "<p>hi</p>")], "source_id long, record_id string, target_uri string, warc_date string, headers string, body string")
    out = warc.build_derivatives(given).collect()
    assert {r["refers_to"] for r in out} == {"<urn:uuid:1>"} and "source-header: Server: x" in out[0]["block"]


def test_warc_files_round_trip(spark, tmp_path):
    records = warc.build_derivatives(warc.responses_from_pages(spark.read.parquet(f"{SF}/pages.parquet")))
    files = warc.write_warc(records.repartition(3, "source_id"), f"file://{tmp_path}/warc").collect()
    assert sum(f["n"] for f in files) == records.count()
    back = warc.read_warc(spark, f"file://{tmp_path}/warc")
    plain = ["source_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_headers", "payload_digest", "block_digest", "content_length", "block"]
    assert sorted(map(tuple, back.select(*plain).collect())) == sorted(map(tuple, records.select(*plain).collect()))


def test_pages_that_never_close_their_tags_take_one_pass():
    import time

    for piece in ("<head>", "<title>", "<script>", "<!--", "<a ", "<a href=x>", "<html ", "<style x", "</p", "&lt;", " \n ", "<html lang"):
        for tail in ("", ">"):
            began = time.process_time()
            warc.metadata_fields(piece * 40_000 + tail, "")
            warc.plain_text(piece * 40_000 + tail)
            assert time.process_time() - began < 5, piece
    assert warc.plain_text("a<!-- x <b>y</b>") == "a" and warc.plain_text("a<script>x") == "a" and warc.plain_text("<head>x<p>y</p>") == "x\ny"
    assert warc.plain_text("1 < 2 <b>x</b> 3 < 4") == "1 < 2 x 3 < 4" and warc.plain_text("") == ""


def sql_over(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    result = con.sql(sql)
    columns = sorted(result.columns)
    return columns, sorted(map(repr, result.project(", ".join(columns)).fetchall()))


def url_rows():
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/7a?x#y"), (5, "https://sub.example.com/en/8"), (6, "http://com/en/"), (7, "http://xcom/en/1"), (8, "http://a.net/de/8#f"), (9, "http://a.example.net/de/88"), (10, "http://h.org"), (11, "http://h.org?q=/es/"), (12, "http://h.org/es/é/1/2/3/4/5/6"), (12, "http://h.org/es/é/1/2/3/4/5/6"), (None, "a://b://c/d")]
    rows += [(100 + i, f"http://big.org/es/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'x' * (i % 7)}/p{i}.html") for i in range(400)]
    rows += [(600 + i, f"http://mix.com/{'en' if i % 2 else 'news'}/{'item' if i % 3 else 'post'}/{i}") for i in range(120)]
    rows += [(800 + i, f"http://spam.org/{w}/{i}") for i in range(40) for w in ("es", "shop")]
    return rows


def test_templates_match_sql(spark):
    rows = url_rows()
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' AS host", "'r' AS path", "'s' AS segment", "'t' AS template")
    out = url_templates.judge(frame)
    columns, want = sql_over(rows, url_templates.judge_sql())
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in out.collect()))) == want
    assert len(want) == len(rows)
    assert url_templates.judge(frame.limit(0)).count() == 0


def test_a_blocked_template_rejects_what_no_rule_names(spark):
    rules = (url_templates.Rule("spam.example", "/a/1", "block"), url_templates.Rule("spam.example", "/ok/", "allow"))
    rows = [(i, f"http://spam.example/a/{i}") for i in range(1, 200)] + [(500, "http://spam.example/b/1"), (501, "http://spam.example/ok/1")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    out = {r["page_id"]: r for r in url_templates.judge(frame, rules).collect()}
    assert out[7]["rule"] is None and out[7]["template"] == "/a/*" and out[7]["verdict"] == "block"
    assert out[500]["verdict"] == "allow" and out[501]["verdict"] == "allow"
    assert out[1]["rule"] == "spam.example/a/1"


def test_longest_rule_wins(spark):
    frame = spark.createDataFrame(url_rows(), "page_id long, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judge(frame).collect()}
    assert out[4] == ("example.com", "/en/7a", "example.com/en/7", "allow")
    assert out[5] == ("sub.example.com", "/en/8", "com/en/", "block")
    assert out[7][2] is None and out[9] == ("a.example.net", "/de/88", "example.net/de/8", "block")
    assert out[1][:3] == out[3][:3] == ("", "", None)


def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS and 0.5 * rows <= docs.count() <= rows
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == rows
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_dedup", "decontamination", "best_fit_packing"]


def test_pipeline_over_awkward_documents(spark):
    from tests.llm.cases import documents

    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SF), f"edge-{name}")
    assert docs.count() > 0
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_one_row_of_each_group_stays(spark):
    from tests.llm.cases import documents, prose, rows

    near = prose(21, 120)
    more = [(None, near, "en", "s", 1), (None, near, "en", "s", 1), (None, f"{near} more", "en", "s", 1), (50, near.upper(), "en", "s", 1)]  # ids before none
    more += [(None, prose(22, 40), "en", "s", 1)] * 2  # copies without an id
    more += [(60, prose(23, 80), "en", "s", 1), (60, prose(24, 80), "en", "s", 1), (7, prose(23, 80) + " end", "en", "s", 1)]  # one id, two texts
    out = corpus_pipeline.near_duplicates(spark, documents(spark, rows() + more), SF)
    assert out.columns == corpus_pipeline.COLUMNS
    want = [r for r in rows() if r[0] not in (0, 1, 2, 3)] + [rows()[-2], more[3], more[4], more[7], more[8]]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_a_group_with_a_repeated_row_comes_out_of_the_pipeline(spark):
    from tests.llm.cases import documents

    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SF), f"group-{name}")
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} & {0, 1, 2, 3} == {0}


def test_each_stage_against_brute_force(spark):
    from tests.llm.cases import documents
    from tests.llm.test_duplicates import jaccard_classes, passage_docs, repeats_of
    from tests.llm.test_text_operators import contaminated

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = [(5000 + i, f"word{i} {t}", "en", "s", len(t) + 6) for i, (_, t) in enumerate(items[:2])]
    data, stages = passage_docs() + hit, dict(corpus_pipeline.STAGES)

    def through(name, data):
        return sorted((tuple(r) for r in stages[name](spark, documents(spark, data), SF).select(*corpus_pipeline.COLUMNS).collect()), key=repr)

    want = sorted((d for d in data if any(c.isalpha() for c in d[1] or "")), key=repr)
    assert (data := through("language_id", data)) == want and len(want) < len(passage_docs()) + 2
    # a row without an id is a group of its own here
    ids = [d[0] for d in data if d[0] is not None]
    kept = {d for d, _, _, stays in jaccard_classes([d[:2] for d in data if d[0] is not None]) if stays}
    before, data = data, through("ngram_jaccard_join", data)
    assert sorted(d[0] for d in data if d[0] is not None) == sorted(kept) and len(kept) < len(ids)
    assert all(d in before for d in data) and sum(d[0] is None for d in data) == 1
    whole = {d: n > gone or not gone for d, n, gone, _, _ in repeats_of([d[:2] for d in data], 200)}
    left = {d: sha for d, _, _, _, sha in repeats_of([d[:2] for d in data], 200)}
    before, data = data, through("suffix_dedup", data)
    assert {d[0] for d in data} == {d[0] for d in before if whole[d[0]]} and len(data) == sum(whole.values())
    # all texts that passages are cut from are ASCII
    assert all(hashlib.sha256(d[1].encode()).hexdigest() == left[d[0]] and d[4] == len(d[1]) for d in data)
    clean = {d for d, *_, bad in contaminated([d[:2] for d in data], items) if not bad}
    want = [d for d in data if d[0] in clean]
    assert through("decontamination", data) == want and 0 < len(want) < len(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query_runs_and_matches_its_sql(spark, name):
    out = queries.QUERIES[name](spark, SF)
    rows = out.collect()
    assert rows
    if name not in queries.ORACLE:
        return
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = con.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    assert columns == sorted(out.columns)
    assert sorted(map(repr, want.project(", ".join(columns)).fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)
