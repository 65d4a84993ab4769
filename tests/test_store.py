"""The bucketed store: what a batch writes, what readers and other writers see, and what changed."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from civicgrid.sources.store import BucketedStore, store_sink

SCHEMA = "id long, city string, v double, at long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def made(spark, folder, rows=(), keys=("id",), buckets=16):
    store = BucketedStore.create(spark, str(folder), frame(spark, []).schema, list(keys), buckets)
    if rows:
        store.upsert(frame(spark, list(rows)))
    return store


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    rows = [(i, f"c{i % 7}", float(i), 0) for i in range(1000)]
    store = made(spark, tmp_path / "s", rows)
    first = store.version()
    assert len(first.places) == 16 and content(store.read()) == sorted(rows, key=repr)
    after = store.upsert(frame(spark, [(5, "new", 1.5, 1), (2000, "new", 2.5, 1), (None, "none", 0.0, 1)]))
    assert 0 < len(first.differing(after)) <= 3 and after.number == 2
    want = [r for r in rows if r[0] != 5] + [(5, "new", 1.5, 1), (2000, "new", 2.5, 1), (None, "none", 0.0, 1)]
    assert content(store.read()) == sorted(want, key=repr) and content(store.read(1)) == sorted(rows, key=repr)
    gone = store.delete(spark.createDataFrame([(5,), (None,), (77_777,)], "id long"))
    assert len(after.differing(gone)) <= 3
    assert content(store.read()) == sorted([r for r in want if r[0] not in (5, None)], key=repr)
    files = store.lookup(spark.createDataFrame([(2000,), (5,)], "id long"))
    assert content(files) == [(2000, "new", 2.5, 1)]
    read = {f.rsplit("/", 2)[1] for f in files.inputFiles()}
    assert len(read) <= 2


def test_the_last_of_a_batch_by_order(spark, tmp_path):
    store = made(spark, tmp_path / "s", [(1, "a", 0.0, 0)])
    with pytest.raises(ValueError):
        store.upsert(frame(spark, [(1, "x", 1.0, 1), (1, "y", 1.0, 2)]))
    store.upsert(frame(spark, [(1, "y", 1.0, 9), (1, "x", 1.0, 1)]), order=F.col("at"))
    store.upsert(frame(spark, [(2, "z", 1.0, 1), (2, "z", 1.0, 1)]))
    store.upsert(spark.createDataFrame([(3, "clash")], "id int, _bucket string"))
    assert content(store.read()) == [(1, "y", 1.0, 9), (2, "z", 1.0, 1), (3, None, None, None)]
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("c",)], "city string"))
    assert store.upsert(frame(spark, [])).number == 5 and content(store.read()) == content(store.read(4))


def test_changes_between_versions(spark, tmp_path):
    r, state, store = random.Random(3), {}, made(spark, tmp_path / "s", buckets=8)
    states = [dict(state)]
    for _ in range(6):
        ids = r.sample(range(40), 8)
        if r.random() < 0.4:
            store.delete(spark.createDataFrame([(i,) for i in ids], "id long"))
            state = {k: v for k, v in state.items() if k not in ids}
        else:
            batch = [(i, r.choice("ab"), float(r.randrange(2)), 0) for i in ids]
            store.upsert(frame(spark, batch))
            state = state | {b[0]: b for b in batch}
        states.append(dict(state))
    for a, b in ((0, 6), (2, 3), (3, 6), (4, 4), (5, 1)):
        got = sorted((x["id"], x["old"] and tuple(x["old"]), x["new"] and tuple(x["new"])) for x in store.changes(a, b).collect())
        want = sorted((k, states[a].get(k), states[b].get(k)) for k in states[a].keys() | states[b].keys() if states[a].get(k) != states[b].get(k))
        assert got == want


def test_two_writers_lose_no_rows(spark, tmp_path):
    store, failures = made(spark, tmp_path / "s", buckets=4), []

    def write(k):
        try:
            mine = BucketedStore(spark, str(tmp_path / "s"))
            for n in range(3):
                mine.upsert(frame(spark, [(100 * k + n, f"w{k}", 0.0, n), (9999, f"w{k}", float(n), n)]))
        except Exception as error:
            failures.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and store.version().number == 12
    assert {x["id"] for x in store.read().collect()} == {100 * k + n for k in range(4) for n in range(3)} | {9999}


def test_a_writer_that_comes_late_keeps_what_others_wrote(spark, tmp_path, monkeypatch):
    """Another writer takes the number between merge and publication: in the same bucket, and in another."""
    store, other = made(spark, tmp_path / "s", [(1, "a", 0.0, 0)], buckets=1), BucketedStore(spark, str(tmp_path / "s"))
    merged, between = BucketedStore._merged, []

    def slow(self, last, touched, base):
        out = merged(self, last, touched, base)
        if self is store and not between:
            between.append(other.upsert(frame(spark, [(2, "b", 0.0, 0)])))
        return out

    monkeypatch.setattr(BucketedStore, "_merged", slow)
    store.upsert(frame(spark, [(3, "c", 0.0, 0)]))
    assert [x[0] for x in content(store.read())] == [1, 2, 3] and store.version().number == 3


def test_a_stream_into_the_store(spark, tmp_path):
    r, last = random.Random(4), {}
    for k in range(5):
        batch = [(r.randrange(30), r.choice("ab"), float(k), 10 * k + n) for n in range(9)]
        last |= {b[0]: b for b in batch}
        frame(spark, batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = made(spark, tmp_path / "s")

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(store_sink(store, "events", F.col("at"))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(f"{tmp_path}/c1")
    number = store.version().number
    # the files' order of arrival is theirs: the last batch with a key wins, and in it the last by order
    assert {x[0] for x in content(store.read())} == set(last) and number == 5
    run(f"{tmp_path}/c2")  # a stream that starts from nothing repeats its batches' numbers: none counts again
    assert store.version().number == number
    store.upsert(frame(spark, [(1, "z", 0.0, 0)]))
    before = content(store.read())
    store.vacuum(keep=1)
    assert content(store.read()) == before and store.numbers() == [number + 1]
    assert len(store.files.names("data")) <= 6
