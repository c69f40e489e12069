"""Telemetry as Structured Streaming: ingest, hourly view, rate limits and regimes with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.folds import FIRST_REGIME, Hysteresis, RateLimit
from ..ship import ensure

REPORT = (
    "tick BIGINT, timestamp_ms BIGINT, mean_utility DOUBLE, min_safety DOUBLE, quarantine_fraction DOUBLE, bus_drop_rate DOUBLE, "
    "awareness_coverage DOUBLE, phage_events_this_tick BIGINT, phage_events_total BIGINT, deterministic_alarm BOOLEAN, health_score DOUBLE, needs_healing BOOLEAN"
)
BATCH = f"sent_at_ms BIGINT, reports ARRAY<STRUCT<{REPORT.replace(' BIGINT', ': BIGINT').replace(' DOUBLE', ': DOUBLE').replace(' BOOLEAN', ': BOOLEAN')}>>"


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON batches, one document a file: (batch_id, sent_at_ms, ingested_at, the report's fields)."""
    t = spark.readStream.schema(BATCH).option("multiLine", True).json(folder)
    t = t.select(F.sha2(F.concat_ws("|", F.col("sent_at_ms").cast("string"), F.to_json("reports")), 256).alias("batch_id"), "sent_at_ms", F.timestamp_millis("sent_at_ms").alias("ingested_at"), F.explode("reports").alias("r"))
    return t.select("batch_id", "sent_at_ms", "ingested_at", "r.*")


def scored(events: DataFrame) -> DataFrame:
    """Health and healing again from the parts."""
    c = {k: F.col(k) for k in ("mean_utility", "min_safety", "awareness_coverage", "deterministic_alarm", "quarantine_fraction", "bus_drop_rate")}
    health = S.health_score(c["mean_utility"], c["min_safety"], c["awareness_coverage"], c["deterministic_alarm"], c["quarantine_fraction"])
    return events.withColumn("health_score", health).withColumn("needs_healing", S.needs_healing(c["deterministic_alarm"], c["quarantine_fraction"], c["min_safety"], c["bus_drop_rate"]))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The hourly view on ingest time; rows later than ``late`` are let go, and an hour's state with them.

    Batches are counted exactly: an hour's state holds the ids of its batches.
    """
    return (
        events.withWatermark("ingested_at", late)
        .groupBy(F.window("ingested_at", "1 hour").alias("w"))
        .agg(
            F.size(F.collect_set("batch_id")).cast("long").alias("batch_count"),
            F.count(F.lit(1)).alias("event_count"),
            F.avg("mean_utility").alias("avg_utility"),
            F.min("mean_utility").alias("min_utility"),
            F.max("mean_utility").alias("max_utility"),
            F.avg("health_score").alias("avg_health"),
            F.count_if("needs_healing").alias("healing_events"),
            F.count_if("deterministic_alarm").alias("alarm_events"),
        )
        .withColumn("hour", F.col("w.start"))
        .drop("w")
    )


def ingest(events: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch to Parquet by day, once: a batch that is repeated overwrites its own folder."""

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("day", F.to_date("ingested_at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    ensure(events.sparkSession)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed(events: DataFrame, key: str, columns: list[str], out: str, state: str, resume: Callable, idle_ms: int | None) -> DataFrame:
    """Rows of a key through ``resume(state tuple or None)``, which gives (step, leave): step a frame in order of ticks, leave gives the state.

    A key that has had no rows for ``idle_ms`` is forgotten, and begins anew (for queries that go on: one that ends when it has read all would
    wait for timeouts); without it, states stay for ever.  Ticks are ordered within a micro-batch;
    one that comes after its successors' micro-batch is taken when it comes.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        go, leave = resume(held.get if held.exists else None)
        rows = pd.concat(list(frames)).sort_values("tick", ignore_index=True)  # a micro-batch of one key
        yield go(k[0], rows)
        held.update(leave())
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)

    ensure(events.sparkSession)
    kind = dict(events.dtypes)[key]
    return events.select(key, "tick", *columns).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, tick long, {out}", state, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def rate_limited(events: DataFrame, key: str, window: int = 100, most: int = 5, idle_ms: int | None = None) -> DataFrame:
    """(key, tick, allowed): the last allowed tick and the window's count are the state."""

    def resume(state):
        limit = RateLimit(window, most, *(state or (0, 0)))
        go = lambda k, rows: pd.DataFrame({key: [k] * len(rows), "tick": rows["tick"], "allowed": [limit.ask(t) for t in rows["tick"].tolist()]})
        return go, lambda: (limit.last, limit.used)

    return _keyed(events, key, [], "allowed boolean", "last long, used int", resume, idle_ms)


def held_regimes(events: DataFrame, key: str, seen: str, length: int = 5, first: str = FIRST_REGIME, idle_ms: int | None = None) -> DataFrame:
    """(key, tick, held): the detector's label with hysteresis, its label and countdown as state."""

    def resume(state):
        held = Hysteresis(*(state or (first, 0)), length)
        go = lambda k, rows: pd.DataFrame({key: [k] * len(rows), "tick": rows["tick"], "held": pd.Series([held.see(x) for x in rows[seen].tolist()], dtype=object)})
        return go, lambda: (held.held, held.left)

    return _keyed(events, key, [seen], "held string", "held string, left int", resume, idle_ms)


def latest(events: DataFrame, most: int):
    """A query that keeps the ``most`` latest reports of the stream in a table in memory, ``latest_reports``: by tick, the newest first.

    Each micro-batch is cut to its newest and merged with what is held, so neither grows with the stream.
    """
    held: list[pd.DataFrame] = []

    def merge(df: DataFrame, number: int) -> None:
        top = df.orderBy(F.desc("tick")).limit(most).toPandas()
        held[:] = [pd.concat([*held, top]).sort_values("tick", ascending=False, ignore_index=True).head(most)]
        events.sparkSession.createDataFrame(held[0], df.schema).createOrReplaceTempView("latest_reports")

    return events.writeStream.foreachBatch(merge)


def bounded(events: DataFrame, capacity: int, order: str = "event_id") -> DataFrame:
    """A stream's queue of one tick: the newest beyond ``capacity`` are marked ``dropped``, not lost."""
    from pyspark.sql import Window

    return events.withColumn("dropped", F.row_number().over(Window.partitionBy("stream", "tick").orderBy(order)) > capacity)
