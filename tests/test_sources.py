import gzip
import json

import pytest
from pyspark.sql import functions as F

from civicgrid.sources import readers


def test_json_folder_sets_broken_files_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "Chess", "city": "Pécs", "tags": ["x"]}))
    (tmp_path / "b.json").write_text("{not json")
    rows, broken = readers.json_folder(spark, f"{tmp_path}/*.json", readers.COMMUNITY)
    assert [(r["name"], r["stem"]) for r in rows.collect()] == [("Chess", "a")]
    assert [r["stem"] for r in broken.collect()] == ["b"]


def test_search_results_keep_organic_items_in_order(spark):
    items = [{"type": "organic", "url": "u1", "title": "t"}, {"type": "ad", "url": "u2"}, {"type": "organic", "url": ""}, {"type": "organic", "url": "u3"}]
    body = json.dumps({"tasks": [{"result": [{"items": items}]}, {"result": None}]})
    frame = spark.createDataFrame([(1, body), (2, "broken"), (3, None)], "id int, body string")
    assert [(r["id"], r["pos"], r["url"]) for r in readers.search_results(frame, keep=["id"]).collect()] == [(1, 0, "u1"), (1, 3, "u3")]


def test_log_lines_over_rotated_files(spark, tmp_path):
    line = lambda i, level: json.dumps({"seq": i, "ts": f"2024-01-01T00:00:{i:02d}Z", "level": level, "event": f"e{i}", "extra": {"b": "2", "a": "1"}})
    (tmp_path / "app.log").write_text("\n".join([line(5, "ERROR"), "broken", line(6, "info")]))
    with gzip.open(tmp_path / "app.log.1.gz", "wt") as out:
        out.write("\n".join(line(i, "error") for i in range(1, 5)))
    rows = readers.log_lines(spark, f"{tmp_path}/app.log*", "error", "e", 3)
    assert [r["seq"] for r in rows.collect()] == [3, 4, 5]
    assert rows.select(readers.log_text(F.col("event"), F.col("extra")).alias("t")).first()["t"] == "e3  a=1 b=2"
    assert readers.log_lines(spark, f"{tmp_path}/app.log*", None, "E6").count() == 1


def test_catalogue_terms_and_queries(spark):
    models = spark.createDataFrame([("p", [("m", "140"), ("n", "x"), (" ", "5")]), ("q", [("o", "-3")])], "provider string, models array<struct<model:string,quality:string>>")
    assert [tuple(r) for r in readers.model_catalogue(models).collect()] == [("p", "m", 100), ("q", "o", 0)]
    terms = readers.topic_terms(spark, {"run": {"hu": ["futás", "kocogás", "c"], "en": ["run"]}, "chess": {"en": ["chess"]}, "none": {"de": ["x"]}}, "hu")
    built = terms.select("topic", readers.search_queries(F.col("terms"), F.lit("Wien"), F.lit("Bécs")).alias("q"))
    assert {r["topic"]: r["q"] for r in built.collect()} == {"run": ["futás Wien", "kocogás Wien", "futás Bécs"], "chess": ["chess Wien", "chess Bécs"], "none": []}


def test_exports(spark):
    traffic = spark.createDataFrame([("a.hu", 3, 2), ("b.hu", 4, 1), ("x", 9, 9)], "host string, pageviews int, visitors int")
    assert [tuple(r) for r in readers.site_traffic(traffic, {"a.hu": "hu", "b.hu": "hu"}).collect()] == [("hu", 7, 3)]
    cities = spark.createDataFrame([("A", "900", "Point(1.23456 2.0)"), ("A", "5000", "Point(-3.5 4.25)"), ("B", "many", "Point(0 0)"), ("C", "10", None)], "name string, population string, point string")
    assert [tuple(r) for r in readers.largest_cities(cities, 100).collect()] == [("A", 5000, 4.25, -3.5)]


def test_merge_and_snapshot(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string"), spark.createDataFrame([("a", 2, "z"), ("c", 2, "w")], "k string, seq int, v string")
    path = readers.write_snapshot(readers.merge_documents(old, new, "k", "seq"), str(tmp_path))
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", "z"), ("b", "y"), ("c", "w")]


def test_sitemap_lines(spark):
    rows = spark.sql("SELECT * FROM VALUES ('/a', DATE'2024-01-02'), ('/b?x=<1>&y=\"', NULL) AS t(loc, lastmod)")
    lines = [r["value"] for r in readers.sitemap_lines(rows, "https://x").collect()]
    assert lines == ["<url><loc>https://x/a</loc><lastmod>2024-01-02</lastmod></url>", "<url><loc>https://x/b?x=&lt;1&gt;&amp;y=&quot;</loc></url>"]


def test_configuration(spark):
    cities = {"cities": [{"name": "Pécs", "locale": "hu"}, {"name": "Oslo", "locale": False, "country": "NO", "topic_tier": "core"}]}
    topics = {"topics": [{"name": "run", "search_terms": {"hu": ["futás"], "en": ["running"]}}]}
    places, terms, settings = readers.configuration(spark, cities, topics, {"cache": {"search_ttl_days": 3}, "pipeline": {"extract_concurrency": None}})
    assert sorted((r["city"], r["locale"], r["tier"], r["search_variants"]) for r in places.collect()) == [("Oslo", "False", "core", ["Oslo"]), ("Pécs", "hu", "full", ["Pécs"])]
    assert terms.first()["terms"]["hu"] == ["futás"] and settings["search_ttl_days"] == 3 and settings["extract_concurrency"] == 1
    test = readers.configuration(spark, cities, topics, {"pipeline": {"test_mode": True, "test_cities": ["Oslo"]}})[0]
    assert [r["city"] for r in test.collect()] == ["Oslo"]
    for bad in ([], {"cities": {}}):
        with pytest.raises(ValueError):
            readers.configuration(spark, bad, topics, {})


def test_backfill_and_views(spark, tmp_path):
    pages = spark.createDataFrame([('{"model": "m", "n": 3}', None), ('{"n": "x"}', "own"), ("broken", None)], "doc string, model string")
    out = readers.backfilled(pages, "doc", {"model": "string", "n": "int"})
    assert [(r["model"], r["n"]) for r in out.collect()] == [("m", 3), ("own", None), (None, None)]
    views = spark.sql("SELECT TIMESTAMP'2024-01-02 03:00:00' AS ts, 'x' AS path")
    for _ in range(2):
        readers.append_views(f"{tmp_path}/views", views)
    assert spark.read.parquet(f"{tmp_path}/views").filter("day = DATE'2024-01-02'").count() == 2
