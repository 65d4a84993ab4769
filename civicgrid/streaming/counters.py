"""Streaming: windowed counters with watermarks, distinct visitors, sessions, a stateful quota ledger, a log tail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table
from civicgrid.sources.store import BucketedStore

registry = Registry()


def event_stream(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Event files that arrive in a folder."""
    return spark.readStream.schema(schema or "event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(folder)


def tumbling_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by window and kind; the same on a table and on a stream, where rows later than ``late`` are dropped."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return source.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def daily_visitors(events: DataFrame, late: str = "1 day") -> DataFrame:
    """First view of each visitor on each day: a row for each, deduplicated within the watermark."""
    views = events.filter("event_type = 'view'").withColumn("day", F.to_date("ts"))
    if events.isStreaming:
        return views.withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "user_id"]).select("day", "user_id")
    return views.select("day", "user_id").distinct()


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: an extension, as windows that end after a gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("s.end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


LEDGER = "provider string, day string, calls long, tokens double, blocked_until double, note string"


def call_events(events: DataFrame) -> DataFrame:
    """Provider calls of the event log: provider, day, ts, event_id, tokens, blocked_until (seconds) and note."""
    until = F.when(F.col("event_type") == "error", F.unix_timestamp("ts").cast("double") + 60)
    return events.select(F.concat(F.lit("p"), F.col("user_id") % 5).alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("tokens"), until.alias("blocked_until"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("note"))


def ledger_of(calls: DataFrame) -> DataFrame:
    """The ledger as a table: calls, tokens, the latest block and the last note of each provider and day."""
    last = F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("ts", "event_id")))
    return calls.groupBy("provider", "day").agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("tokens", F.lit(0.0))), 6).alias("tokens"), F.max("blocked_until").alias("blocked_until"), last.alias("note"))


class Ledger(StatefulProcessor):
    """Counters of one provider and day, in any order of arrival; state goes a day after the day ended, by event time."""

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "calls long, tokens double, blocked_until double, note string, noted string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls, tokens, blocked, note, noted = self.sums.get() if self.sums.exists() else (0, 0.0, None, None, "")
        for batch in rows:
            calls += len(batch)
            tokens += float(batch["tokens"].fillna(0.0).sum())
            latest = batch["blocked_until"].max()
            blocked = blocked if pd.isna(latest) else max(latest, blocked or latest)
            notes = batch[batch["note"].notna()]
            if len(notes):
                when = [f"{t.isoformat()} {e:020d}" for t, e in zip(notes["ts"], notes["event_id"], strict=True)]
                newest = max(range(len(when)), key=when.__getitem__)
                if when[newest] > noted:
                    note, noted = notes["note"].iloc[newest], when[newest]
        self.sums.update((calls, tokens, blocked, note, noted))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(int(pd.Timestamp(key[1], tz="UTC").timestamp() * 1000) + 2 * 86_400_000)
        yield self.row(key, calls, tokens, blocked, note)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        return iter(())

    @staticmethod
    def row(key, calls, tokens, blocked, note) -> pd.DataFrame:
        return pd.DataFrame({"provider": [key[0]], "day": [key[1]], "calls": [calls], "tokens": [round(tokens, 6)], "blocked_until": pd.array([blocked], "Float64"), "note": pd.array([note], "string")})

    def close(self) -> None:
        pass


def quota_ledger(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """The ledger of a stream of calls: a row for each provider and day that a batch touches, with its counters so far.

    Every provider and day is a key of its own, so that a batch that holds several days,
    in whatever order, loses none. Later rows of a key replace earlier ones.
    """
    return calls.withWatermark("ts", late).groupBy("provider", "day").transformWithStateInPandas(Ledger(), LEDGER, "update", "eventTime")


def log_tail(lines: DataFrame, after: int) -> DataFrame:
    """Lines after a sequence number, as they come."""
    return lines.filter(F.col("event_id") > after)


def upsert_into(folder: str, keys: list[str], order: Column | None = None, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps one table: a batch replaces the rows of its keys, and rewrites only their buckets.

    Of several rows of a key in a batch the last by ``order`` counts. A batch that runs again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = BucketedStore(spark, folder)
        if not store.numbers():
            store = BucketedStore.create(spark, folder, batch.schema, keys, buckets)
        store.upsert(batch, order, "batches", number)

    return write


def kept_table(spark: SparkSession, folder: str) -> DataFrame:
    """The table that ``upsert_into`` keeps."""
    return BucketedStore(spark, folder).read()


def run_available(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is into a memory table and return it."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)


@registry.add("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(table(spark, sf_dir, "events"))


@registry.add("SELECT strftime(date_trunc('day', ts) - to_days(CAST(d AS INTEGER)), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, generate_series(0, 6) g(d) GROUP BY ALL")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that start every day."""
    return tumbling_counts(table(spark, sf_dir, "events"), "7 days", "1 day")


@registry.add("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


@registry.add("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS visitors FROM events WHERE event_type = 'view' GROUP BY 1")
def visitors_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_visitors(table(spark, sf_dir, "events")).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("visitors"))


@registry.add("""WITH c AS (SELECT 'p' || (user_id % 5) AS provider, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, value AS tokens, CASE WHEN event_type = 'error' THEN CAST(floor(epoch(ts)) AS DOUBLE) + 60 END AS blocked, CASE WHEN event_type = 'error' THEN event_type END AS note FROM events)
SELECT provider, day, count(*) AS calls, round(sum(tokens), 6) AS tokens, max(blocked) AS blocked_until, arg_max(note, ts) FILTER (note IS NOT NULL) AS note FROM c GROUP BY ALL""")
def provider_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each provider and day."""
    return ledger_of(call_events(table(spark, sf_dir, "events")))


@registry.add("""SELECT event_id, ts, 'view' AS field FROM events WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the last two days, as a feed's reader gets them."""
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts").alias("newest"))
    return rows.filter("event_type = 'view'").crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 2 DAYS")).select("event_id", "ts", F.lit("view").alias("field"))  # one row


QUERIES, ORACLE = registry.queries, registry.oracle
