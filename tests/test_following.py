"""Change capture, sketches, text index, clustered pages, logs and rounds, each against a plain computation."""

import gzip
import json
import random

from pyspark.sql import functions as F

from civicgrid.operators import postings, sketches
from civicgrid.plans import passes
from civicgrid.sources import pages, readers
from civicgrid.sources.store import BucketedStore
from civicgrid.streaming import capture

STATES = "key long, at timestamp, seq long, name string, note string, tags array<string>"


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_stream_gives_the_table_s_history_in_any_order_of_arrival(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([*range(12), None]), f"2026-01-{1 + n // 40:02d} {n % 24:02d}:00:{r.randrange(60):02d}.{r.randrange(10**6):06d}", n, f"name {n % 5}", r.choice(["a", "b", "", " ", None]), r.choice([["x"], ["x", "y"], [], None])) for n in range(400)]
    frame = spark.createDataFrame(rows, "key long, at string, seq long, name string, note string, tags array<string>").withColumn("at", F.col("at").cast("timestamp"))
    for k in range(4):  # days arrive in order, the rows of a file in none; a day's rows are spread over two files
        part = frame.filter((F.dayofmonth("at") > 3 * k - (k > 0)) & (F.dayofmonth("at") <= 3 * k + 3) & ((F.col("seq") % 2 == 0) | (F.dayofmonth("at") > 3 * k)))
        part.orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    everything = spark.read.schema(frame.schema).parquet(f"{tmp_path}/in").distinct()
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = capture.run_to_table(capture.captured(stream, ["note", "tags"], "name", "5 days"), "history")
    limit = everything.agg(F.max("at")).first()[0]
    want = capture.history_of(everything, ["note", "tags"], "name").filter(F.col("at") <= F.lit(limit) - F.expr("INTERVAL 5 DAYS"))
    assert want.count() > 100 and {x["field"] for x in want.collect()} == {"__created__", "note", "tags"}
    # rows of one batch that follow one another in the stream's files are all there: as many, and the same
    assert sorted_rows(got) == sorted_rows(want.dropDuplicates(["key", "at", "seq", "field"]))


def test_sketches_keep_within_their_error(spark, tmp_path):
    r = random.Random(4)
    views = [(f"s{r.randrange(2)}", f"2026-01-{1 + r.randrange(30):02d}", r.choice([None, *range(30)]) if r.random() < 0.01 else r.randrange(20_000)) for _ in range(60_000)]
    frame = spark.createDataFrame(views, "site string, day string, visitor long").withColumn("day", F.to_date("day")).cache()
    store = BucketedStore.create(spark, str(tmp_path / "s"), spark.createDataFrame([], sketches.SCHEMA).schema, ["site", "day"], 4)
    for part in range(3):  # a day's views come in three parts
        sketches.add_days(store, sketches.daily_sketches(frame.filter(F.pmod(F.xxhash64("visitor", "day"), F.lit(3)) == part)), stream="views", batch_id=part)
    number = store.version().number
    sketches.add_days(store, sketches.daily_sketches(frame.limit(10)), stream="views", batch_id=2)  # written already
    assert store.version().number == number
    last = frame.agg(F.max("day").alias("last"))
    got = {(x["site"], x["days"]): (x["views"], x["visitors"]) for x in sketches.visitors_over(store.read(), last, [1, 7, 30]).collect()}
    newest = max(v[1] for v in views)
    assert len(got) == 6
    for (site, days), (n, visitors) in got.items():
        own = [v for v in views if v[0] == site and int(newest[-2:]) - int(v[1][-2:]) < days]
        exact = len({v[2] for v in own} - {None})
        assert n == len(own) and abs(visitors - exact) <= (0 if exact <= 4000 else 3 * exact / 64)


def test_the_text_index_finds_what_a_scan_finds(spark, tmp_path):
    r, texts = random.Random(5), {}
    index = postings.TextIndex.create(spark, str(tmp_path / "i"), buckets=32)
    word = lambda: "".join(r.choice("abÁáx _%") for _ in range(r.randint(0, 9)))
    for step in range(3):
        new = {r.randrange(60): r.choice([None, "", " ".join(word() for _ in range(6))]) for _ in range(25)}
        gone = r.sample(range(60), 5) if step else []
        texts = {k: v for k, v in (texts | new).items() if k not in gone}
        index.save(spark.createDataFrame(list(new.items()), "id long, text string"), spark.createDataFrame([(g,) for g in gone], "id long") if gone else None)
        for needle in ("abx", "ÁB", "x a", "a", "%_", "b" * 4, word() + "xa", "___"):
            want = sorted((k, v) for k, v in texts.items() if v is not None and needle.lower() in v.lower())
            assert sorted(map(tuple, index.search(needle).collect())) == want
    grams = {(t.lower()[i : i + 3], k) for k, t in texts.items() if t for i in range(len(t) - 2)}
    assert {(x["run"], x["id"]) for x in index.postings.read().collect()} == grams


def test_a_search_reads_the_buckets_of_its_runs(spark, tmp_path):
    index = postings.TextIndex.create(spark, str(tmp_path / "i"), buckets=32)
    index.save(spark.createDataFrame([(i, f"text {i} of many {i * 7919}") for i in range(300)] + [(999, "a needle here")], "id long, text string"))
    runs = index.postings.lookup(spark.createDataFrame([(x,) for x in index.rarest("needle")], "run string"))
    assert len({f.rsplit("/", 2)[1] for f in runs.inputFiles()}) <= 4 < len(index.postings.version().places)
    found = index.search("NEEDLE")
    assert [x["id"] for x in found.collect()] == [999] and len({f.rsplit("/", 2)[1] for f in found.inputFiles() if "/texts/" in f}) == 1


def rows_scanned(df) -> int:
    """Rows that the scan of a plan gives on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return leaves.apply(0).metrics().get("numOutputRows").get().value()


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    rows = spark.range(40_000).select(F.concat(F.lit("http://p.example/"), "id").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("raw_text"))
    rows = rows.withColumn("url_hash", F.substring(F.sha2("url", 256), 1, 16))
    pages.write_pages(rows, str(tmp_path / "p"), 4, 20_000, group_bytes=200_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = pages.page_by_url(spark, str(tmp_path / "p"), "http://p.example/777")
        assert [x["url"] for x in one.collect()] == ["http://p.example/777"]
        assert 0 < rows_scanned(one) <= 4000
        assert rows_scanned(pages.page_by_url(spark, str(tmp_path / "p"), "http://p.example/none")) == 0
        index = spark.read.parquet(str(tmp_path / "p")).select("url_hash", "url")
        assert "raw_text" not in index._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_logs_are_read_from_the_newest_on(spark, tmp_path):
    for age in range(6):
        lines = [json.dumps({"seq": 100 * (5 - age) + n, "ts": f"2026-01-{10 - age:02d}T00:00:{n:02d}", "level": "error" if n % 2 else "info", "event": f"event {n}"}) for n in range(20)]
        text = "\n".join([*lines, "{broken"]) + "\n"
        if age > 2:
            with gzip.open(f"{tmp_path}/app.log.{age}.gz", "wt") as out:
                out.write(text)
        else:
            (tmp_path / ("app.log" if age == 0 else f"app.log.{age}")).write_text(text)
    ages = readers.rotated_files(spark, f"{tmp_path}/app.log*")
    assert [a[0].rsplit("/", 1)[1] for a in ages] == ["app.log", "app.log.1", "app.log.2", "app.log.3.gz", "app.log.4.gz", "app.log.5.gz"]
    (tmp_path / "app.log.5.gz").write_bytes(b"not read: the lines before are enough")
    got = readers.log_lines(spark, f"{tmp_path}/app.log*", "error", "event", 25)
    newest = [100 * (5 - age) + n for age in range(6) for n in range(19, 0, -2)][:25]
    assert [x["seq"] for x in got.collect()] == newest[::-1]
    assert readers.log_lines(spark, f"{tmp_path}/none*").count() == 0


def test_rounds_of_a_pair(spark):
    r = random.Random(6)
    pages_of = [(p, u) for p in range(30) for u in range(r.randint(0, 5))] + [(1, 0)]
    answers = [(p, u, a, r.choice(["x", None])) for p, u in set(pages_of) for a in range(1, 5) if r.random() < 0.35]
    stops = [(p, a, f"reason {a}") for p in range(30) for a in range(1, 5) if r.random() < 0.15]
    want = []
    for pair in range(30):
        pending, end = sorted({u for p, u in pages_of if p == pair}), None
        for attempt in (1, 2, 3):
            now = {u: b for p, u, a, b in answers if p == pair and a == attempt and u in pending}
            want += [(pair, u, "failed" if b is None else "done", attempt, b, None) for u, b in now.items()]
            pending = [u for u in pending if u not in now]
            end = next((reason for p, a, reason in stops if p == pair and a == attempt), None)
            if end:
                break
        want += [(pair, u, "stopped" if end else "deferred", None, None, end) for u in pending]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = passes.after_rounds(frame(pages_of, "pair long, url long"), frame(answers, "pair long, url long, attempt long, body string"), frame(stops, "pair long, attempt long, reason string"))
    assert sorted_rows(got) == sorted(want, key=repr) and len({w[2] for w in want}) == 4
