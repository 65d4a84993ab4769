from pyspark.sql import functions as F

from civicgrid.streaming import counters as S

SF = "/root/testdata/sf0.001"


def arriving(spark, tmp_path, files=3):
    spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").repartitionByRange(files, "ts").write.parquet(f"{tmp_path}/events")
    return S.event_stream(spark, f"{tmp_path}/events")


def test_tumbling_counts_agree_with_the_table(spark, tmp_path):
    out = S.run_available(S.tumbling_counts(arriving(spark, tmp_path)), "tumbling")
    want = S.tumbling_counts(spark.read.parquet(f"{SF}/events.parquet"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_ledger_agrees_with_the_table(spark, tmp_path):
    """Whole days in one batch, days over several batches, rows in any order."""
    calls = S.call_events(spark.read.parquet(f"{SF}/events.parquet"))
    for k, part in enumerate(calls.filter("day < '2024-01-07'").randomSplit([1.0, 1.0, 1.0], 3)):
        part.orderBy(F.rand(k)).coalesce(1).write.parquet(f"{tmp_path}/calls/part={k}")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/calls/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    query = S.quota_ledger(stream, "30 days").writeStream.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {row[1:3]: row[1:] for row in sorted(seen, key=lambda r: r[0])}
    want = {(r["provider"], r["day"]): tuple(r) for r in S.ledger_of(calls.filter("day < '2024-01-07'")).select("provider", "day", "calls", "tokens", "blocked_until", "note").collect()}
    assert last == want and len(want) > 20


def test_visitors_are_counted_once(spark, tmp_path):
    out = S.run_available(S.daily_visitors(arriving(spark, tmp_path)), "visitors", "append")
    want = S.daily_visitors(spark.read.parquet(f"{SF}/events.parquet"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_tail_and_batch_sink(spark, tmp_path):
    stream = S.log_tail(arriving(spark, tmp_path), 900)
    sink = S.upsert_into(f"{tmp_path}/out", ["event_id"])
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    rows = S.kept_table(spark, f"{tmp_path}/out")
    assert rows.count() == spark.read.parquet(f"{SF}/events.parquet").filter(F.col("event_id") > 900).count()


def test_a_key_of_two_batches_stands_once(spark, tmp_path):
    sink = S.upsert_into(f"{tmp_path}/out", ["k"])
    for number, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")], [(3, "e")]]):
        batch = spark.createDataFrame(rows, "k int, v string")
        sink(batch, number)
        sink(batch, number)  # runs again
    assert sorted(map(tuple, S.kept_table(spark, f"{tmp_path}/out").collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert S.BucketedStore(spark, f"{tmp_path}/out").version().number == 3
