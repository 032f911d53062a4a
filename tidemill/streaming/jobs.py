"""Job logs and event counts as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators import keyed
from tidemill.operators.jobs import STEPS
from tidemill.plans.book import SQL, query
from tidemill.session import ensure_checkpoint_dir
from tidemill.sources.store import VersionedTable

TRANSITION = "job_id string, seq bigint, from_state string, to_state string, legal boolean, illegal bigint"


def transitions(events: DataFrame, steps: Mapping[str, Sequence[str]] = STEPS, start: str = "queued") -> DataFrame:
    """One row per event of a stream (job_id, seq, event): where it led and whether it was allowed.

    State per job is its name and two numbers. Events are ordered by seq within a batch; one that comes
    after a later event of an earlier batch is judged where it arrives.
    """
    allowed = {s: frozenset(to) for s, to in steps.items()}

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, illegal = held.get if held.exists else ("", 0)
        rows = []
        for seq, event in sorted((s, e) for b in batches for s, e in zip(b["seq"], b["event"], strict=True)):
            ok = event == start if not state else event in allowed.get(state, ())
            illegal += not ok
            rows.append((key[0], seq, state or None, event if ok else state or None, bool(ok), illegal))
            state = event if ok else state
        held.update((state, illegal))
        yield pd.DataFrame(rows, columns=["job_id", "seq", "from_state", "to_state", "legal", "illegal"])

    slim = events.select("job_id", "seq", "event")
    return slim.groupBy("job_id").applyInPandasWithState(step, TRANSITION, "state string, illegal bigint", "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per hour and type with bounded state: hours older than the watermark are dropped from it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def upsert_into(stream: DataFrame, target: VersionedTable, checkpoint: str, order: Sequence[str] = (), mode: str = "append"):
    """Drain a stream into a keyed table; within a batch the last row of a key by ``order`` counts."""

    def apply(batch: DataFrame, number: int) -> None:
        new = keyed.latest_per_key(batch, target.keys, *(F.col(c) for c in order)) if order else batch
        target.upsert(new, number)

    return stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("stream_job_states", SQL.get("job_states"))
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final states by the stateful stream, kept in an upserted table."""
    at = _folder(spark, "jobs")
    target = VersionedTable(spark, f"{at}/table", TRANSITION + ", events bigint", ["job_id"])
    steps = transitions(_read(spark, sf_dir, "job_events"))

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("job_id").agg(F.max(F.struct("seq", "from_state", "to_state", "legal", "illegal")).alias("l"), F.count("*").alias("n"))
        old = target.read().select("job_id", F.col("events").alias("before"))
        target.upsert(last.join(old, "job_id", "left").select("job_id", "l.*", (F.col("n") + F.coalesce("before", F.lit(0))).alias("events")), number)

    steps.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return target.read().select("job_id", F.coalesce("to_state", F.lit("")).alias("state"), "events", "illegal")


@query("stream_hourly_events", SQL.get("hourly_events"))
def stream_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by the windowed stream in update mode, upserted by hour and type."""
    at = _folder(spark, "hours")
    target = VersionedTable(spark, f"{at}/table", "hour timestamp, event_type string, n bigint, total double", ["hour", "event_type"])
    upsert_into(hourly(_read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), target, f"{at}/log", mode="update").awaitTermination()
    return target.read().withColumn("total", F.round("total", 4)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
