"""Change capture: the history of records from their states, whatever the order in which these arrive.

A state is what a record was at one time. Its history has a row for each field that
differs from the state before, empty being unknown, and a marker with the record's
label where there is none before. ``history_of`` makes it from a table; ``captured``
makes the same from a stream: states wait until the watermark has passed them, and
are then compared in their order with the last one that the key's state holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from civicgrid.operators.records import known_text
from civicgrid.operators.registry import Registry
from civicgrid.operators.roles import table
from civicgrid.sources.store import scratch

registry = Registry()

CREATED = "__created__"
CHANGES = "key string, at timestamp, seq long, field string, old_value string, new_value string"
#: States that are written by one call.
TOGETHER = 10_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def as_states(rows: DataFrame, fields: list[str], label: str) -> DataFrame:
    """key, at, seq, label and the fields (f0, f1, ...) as known texts or null; rows without key or time aren't states."""
    texts = [F.when(F.size(F.col(f)) > 0, F.to_json(F.col(f))) if rows.schema[f].dataType.typeName() == "array" else F.col(f).cast("string") for f in fields]
    known = [F.when(known_text(t).isNotNull(), t).alias(f"f{k}") for k, t in enumerate(texts)]
    return rows.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), F.col(label).cast("string").alias("label"), *known)


def history_of(rows: DataFrame, fields: list[str], label: str) -> DataFrame:
    """key, at, seq, field, old_value and new_value of the states in ``rows`` (key, at, seq telling a key's states apart, fields)."""
    order = Window.partitionBy("key").orderBy("at", "seq")
    names = [f"f{k}" for k in range(len(fields))]
    states = as_states(rows, fields, label).withColumns({"before": F.lag(F.struct(*names)).over(order), "first": F.row_number().over(order) == 1})
    null = F.lit(None).cast("string")
    told = [F.struct(F.lit(f).alias("field"), F.col(f"before.{n}").alias("old_value"), F.col(n).alias("new_value"), (~F.col("first") & ~F.col(f"before.{n}").eqNullSafe(F.col(n))).alias("keep")) for f, n in zip(fields, names, strict=True)]
    told.append(F.struct(F.lit(CREATED).alias("field"), null.alias("old_value"), F.col("label").alias("new_value"), F.col("first").alias("keep")))
    return states.select("key", "at", "seq", F.explode(F.array(*told)).alias("c")).filter("c.keep").select("key", "at", "seq", "c.field", "c.old_value", "c.new_value")


class Capture(StatefulProcessor):
    """One record: the states that wait, and the last one that was compared.

    What waits is read and written as a whole, at most once for each batch that brings or
    ends something: a state costs no call of its own. A key's timer is that of its earliest
    waiting state.
    """

    def __init__(self, fields: list[str]):
        self.fields = fields

    def init(self, handle) -> None:
        self.handle = handle
        columns = ", ".join(f"f{k} string" for k in range(len(self.fields)))
        self.last = handle.getValueState("last", columns)
        self.waiting = handle.getListState("waiting", f"at long, seq long, label string, {columns}")

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, earliest = ["label", *(f"f{k}" for k in range(len(self.fields)))], None
        for batch in rows:
            micros = batch["at"].astype("datetime64[us]").astype("int64").tolist()
            if micros:
                texts = [batch[n].astype(object).where(batch[n].notna(), None).tolist() for n in names]
                self.waiting.appendList(list(zip(micros, batch["seq"].tolist(), *texts, strict=True)))
                earliest = min(micros) if earliest is None else min(earliest, *micros)
        if earliest is not None:
            self.wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, left = {}, []
        for at, seq, *values in self.waiting.get() if self.waiting.exists() else ():
            if at <= passed:
                due[at, seq] = values
            else:
                left.append((at, seq, *values))
        if not due:
            return
        out, last = [], self.last.get() if self.last.exists() else None
        for (at, seq), (label, *now) in sorted(due.items(), key=lambda d: d[0]):
            if last is None:
                out.append((key[0], at, seq, CREATED, None, label))
            else:
                out += [(key[0], at, seq, f, a, b) for f, a, b in zip(self.fields, last, now, strict=True) if a != b]
            last = tuple(now)
        self.last.update(last)
        self.waiting.clear()
        for k in range(0, len(left), TOGETHER):
            self.waiting.appendList(left[k : k + TOGETHER])
        if left:
            self.wake(min(r[0] for r in left))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])
            yield frame.assign(at=pd.to_datetime(frame["at"], unit="us", utc=True).astype("datetime64[us, UTC]").dt.tz_localize(None), old_value=frame["old_value"].astype("string"), new_value=frame["new_value"].astype("string"))

    def close(self) -> None:
        pass


def captured(rows: DataFrame, fields: list[str], label: str, late: str) -> DataFrame:
    """The same history from a stream, up to its watermark; states that come more than ``late`` after a later one are lost, as with any watermark."""
    states = as_states(rows, fields, label).withWatermark("at", late)
    return states.groupBy("key").transformWithStateInPandas(Capture(fields), CHANGES, "append", "eventTime")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is into files of the shared folder, and read them."""
    spark = stream.sparkSession
    path, held = scratch(spark, name), spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, held) if held else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(path)


def _states(events: DataFrame) -> DataFrame:
    """Events as states of users: what they did last, and how often it was clicked."""
    k = F.get_json_object("props", "$.k")
    return events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit("user "), "user_id").alias("name"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("kind"), F.when(F.col("event_type") == "click", k).alias("k"))


_HISTORY = """s AS (SELECT CAST(user_id AS VARCHAR) AS key, ts AS moment, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END AS k FROM events),
p AS (SELECT *, lag(kind) OVER w AS kind_before, lag(k) OVER w AS k_before, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY key ORDER BY moment, seq)),
h AS (SELECT key, seq, moment, '__created__' AS field, NULL AS old_value, 'user ' || key AS new_value FROM p WHERE n = 1 UNION ALL SELECT key, seq, moment, 'kind', kind_before, kind FROM p WHERE n > 1 AND kind IS DISTINCT FROM kind_before UNION ALL SELECT key, seq, moment, 'k', k_before, k FROM p WHERE n > 1 AND k IS DISTINCT FROM k_before)"""


@registry.add(f"WITH {_HISTORY} SELECT key, seq, field, old_value, new_value FROM h")
def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole history of the users' states."""
    return history_of(_states(table(spark, sf_dir, "events")), ["kind", "k"], "name").select("key", "seq", "field", "old_value", "new_value")


@registry.add(f"WITH {_HISTORY} SELECT key, seq, field, old_value, new_value FROM h WHERE moment <= (SELECT max(moment) FROM s) - INTERVAL 1 DAY")
def change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the events, up to its watermark a day before the last one."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream's path can't be one file
    return run_to_table(captured(_states(stream), ["kind", "k"], "name", "1 day"), "captured").select("key", "seq", "field", "old_value", "new_value")


QUERIES, ORACLE = registry.queries, registry.oracle
