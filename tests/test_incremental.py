"""What follows a store's changes, against a full computation after every save."""

import random

from pyspark.sql import functions as F

from civicgrid.functions import text as T
from civicgrid.operators import dedup, incremental
from civicgrid.sources.store import BucketedStore, scratch, settled

SCHEMA = "city string, key string, id long, name string, topic string, website string, description string, meeting_schedule string, location string, contact string, social_links array<string>, hidden boolean"
NAMES = ["Futók Köre", "Futok Köre", "Pécsi Futók Köre", "Aurora énekkar", "Auróra énekkar", "Runners Circle", "the Runners Circle", "Sakk", "Sakkozók", "Runner Circles", "Vándor Kórus", "Vándorok Kórusa"]
SITES = [None, "", "n/a", "http://a.example/", "http://A.example", "http://b.example"]


def rows_of(spark, data):
    frame = spark.createDataFrame([(c, "", i, n, t, w, d, None, None, None, [], h) for i, n, c, t, w, d, h in data], SCHEMA)
    return frame.withColumn("key", T.record_key("c", F.col("name"), F.col("city"), F.col("topic"))).dropDuplicates(["key"])


def drawn(r, ids):
    return [(i, r.choice(NAMES), r.choice(["Pécs", "Vác", "Eger"]), r.choice(["run", "sing", "chess"]), r.choice(SITES), r.choice([None, "x"]), r.random() < 0.15) for i in ids]


def pairs(df):
    return sorted((x["winner"], x["loser"], x["similarity"], x["signal"]) for x in df.collect())


def test_candidates_after_any_sequence_of_saves(spark, tmp_path):
    r = random.Random(5)
    store = BucketedStore.create(spark, str(tmp_path / "s"), rows_of(spark, []).schema, ["city", "key"], 8, ["city"])
    store.upsert(rows_of(spark, drawn(r, range(60))))
    full = lambda: dedup.community_candidates(store.read().filter(~F.col("hidden")))
    found, at = settled(full(), "found"), 1
    for step in range(5):
        if step % 2:
            store.delete(store.read().orderBy(F.xxhash64("key", F.lit(step))).limit(6).select("city", "key"))
        else:
            store.upsert(rows_of(spark, drawn(r, range(100 * step, 100 * step + 8))))
        if step == 2:
            continue  # two saves at once
        now = store.version().number
        found, at = settled(incremental.refreshed_candidates_of(found, store, at, now, dedup.community_candidates), "found"), now
        got = pairs(found)
        assert got == pairs(full()) and len({x[3] for x in got}) == 2


def test_venues_are_refreshed_too(spark, tmp_path):
    r = random.Random(6)
    keyed = lambda data: rows_of(spark, data).withColumn("key", T.record_key("v", F.col("name"), F.col("city"))).dropDuplicates(["key"])
    store = BucketedStore.create(spark, str(tmp_path / "s"), rows_of(spark, []).schema, ["city", "key"], 8, ["city"])
    store.upsert(keyed(drawn(r, range(40))))
    full = lambda: dedup.venue_candidates(store.read().filter(~F.col("hidden")))
    found = settled(full(), "found")
    store.upsert(keyed(drawn(r, range(50, 58))))
    assert pairs(incremental.refreshed_candidates_of(found, store, 1, 2, dedup.venue_candidates)) == pairs(full())


def test_only_the_cities_of_the_changes_are_read(spark, tmp_path):
    store = BucketedStore.create(spark, str(tmp_path / "s"), rows_of(spark, []).schema, ["city", "key"], 64, ["city"])
    store.upsert(rows_of(spark, [(i, f"name {i}", f"city {i % 40}", "run", None, None, False) for i in range(400)]))
    store.upsert(rows_of(spark, [(3, "name 3", "city 3", "run", "http://new.example", None, False)]))
    before = len(store.version(1).places)
    read = store.lookup(store.changes(1, 2).select("city").distinct()).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in read}) == 1 < before


def test_few_names_meet_in_a_large_city(spark):
    r = random.Random(1)
    syllables = "ba be bo ka ke ko la le ló má mé mi ná né ni pa pe ra re ro sa sze szo ta te tó va ve vi za ze gyu gyö csa cse".split()
    words = ["".join(r.choice(syllables) for _ in range(r.randint(2, 4))) for _ in range(1500)]
    kinds = "egyesület klub kör csoport alapítvány társaság együttes kórus".split()
    names = [" ".join([r.choice(words) for _ in range(r.randint(1, 3))] + [r.choice(kinds)]) for _ in range(4000)]
    rows = spark.createDataFrame([("x", i, n) for i, n in enumerate(names)], "city string, ord long, clean string")
    for threshold, within in ((0.85, 5), (0.9, None)):
        assert dedup.meeting_names(rows, threshold, within).count() < 0.02 * len(names) * (len(names) - 1) / 2


def test_totals_follow_inserts_hides_deletes_and_moves(spark, tmp_path):
    r = random.Random(7)
    schema = "id long, city string, topic string, v long, hidden boolean"
    store = BucketedStore.create(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema, ["id"], 8)
    totals = incremental.MaintainedAggregate.create(store, str(tmp_path / "t"), ["city", "topic"], ["v"], 8)
    values = incremental.MaintainedAggregate.create(store, str(tmp_path / "v"), ["city", "v"], [], 8)
    for step in range(6):
        ids = r.sample(range(50), 12)
        if step % 3 == 2:
            store.delete(spark.createDataFrame([(i,) for i in ids], "id long"))
        else:
            store.upsert(spark.createDataFrame([(i, r.choice(["a", "b", None]), r.choice("xy"), r.choice([1, 2, 3, None]), r.random() < 0.3) for i in ids], schema))
        if step == 3:
            continue
        number = totals.refresh().number
        assert totals.refresh().number == number  # nothing new: nothing written
        values.refresh()
        rows = store.read().filter(~F.col("hidden"))
        want = rows.groupBy("city", "topic").agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
        assert sorted(map(tuple, totals.read().select("city", "topic", "n", "v").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        distinct = rows.groupBy("city").agg(F.size(F.collect_set(F.coalesce("v", F.lit(-1)))).alias("k"), F.count("*").alias("n"))
        got = incremental.distinct_counts(values.read(), ["city"])
        assert sorted(map(tuple, got.select("city", "values", "n").collect()), key=repr) == sorted(map(tuple, distinct.collect()), key=repr)


def test_scratch_needs_a_shared_folder(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
