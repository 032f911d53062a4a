"""Event logs of keyed jobs: folds, durations, stalls, schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a job and where each may lead.
STEPS: dict[str, tuple[str, ...]] = {
    "queued": ("dispatched", "collecting", "failed"),
    "dispatched": ("queued", "collecting", "needs_attention", "failed"),
    "collecting": ("queued", "saved", "needs_attention", "failed"),
    "saved": (),
    "needs_attention": ("queued",),
    "failed": ("queued",),
}


def allowed(state: Column, event: Column, steps: Mapping[str, Sequence[str]] = STEPS, start: str = "queued") -> Column:
    """Whether an event may follow a state; only ``start`` may come first."""
    out = F.when(state.isNull(), event == start)
    for s, to in steps.items():
        out = out.when(state == s, event.isin(*to) if to else F.lit(False))
    return F.coalesce(out, F.lit(False))


def fold(events: DataFrame, steps: Mapping[str, Sequence[str]] = STEPS, start: str = "queued") -> DataFrame:
    """``(job_id, state, events, illegal)``: the events of each job applied in order, illegal ones counted and ignored.

    The events of one job are gathered as (seq, event) pairs, a few bytes each; jobs are many and short.
    """
    steps_of = F.array_sort(F.collect_list(F.struct("seq", "event")))
    zero = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).cast("long").alias("illegal"))
    merge = lambda a, e: F.when(allowed(a["state"], e["event"], steps, start), F.struct(e["event"].alias("state"), a["illegal"].alias("illegal"))).otherwise(
        F.struct(a["state"].alias("state"), (a["illegal"] + 1).alias("illegal"))
    )
    folded = events.groupBy("job_id").agg(F.count("*").alias("events"), F.aggregate(steps_of, zero, merge).alias("f"))
    return folded.select("job_id", F.col("f.state").alias("state"), "events", F.col("f.illegal").alias("illegal"))


def durations(events: DataFrame) -> DataFrame:
    """Time between the first and last event of each job, in seconds."""
    return events.groupBy("job_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("seconds"))


def gaps(events: DataFrame, least_seconds: float) -> DataFrame:
    """Neighbouring events of a job further apart than ``least_seconds``."""
    w = Window.partitionBy("job_id").orderBy("seq")
    g = events.withColumn("next_event", F.lead("event").over(w)).withColumn("gap", (F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1e6)
    return g.where(F.col("gap") >= least_seconds)


def due(state: DataFrame, now: Column, interval_seconds: Column, retry_seconds: int) -> DataFrame:
    """Sources to run: never run, or their interval (the retry after an error) is over. state: (source, last_attempt, last_error)."""
    wait = F.when(F.col("last_error").isNotNull(), F.lit(retry_seconds)).otherwise(interval_seconds)
    at = F.timestamp_micros(F.unix_micros("last_attempt") + wait.cast("long") * 1_000_000)
    return state.withColumn("next_due", at).withColumn("is_due", F.col("last_attempt").isNull() | (F.col("next_due") <= now))


def recovered(states: DataFrame, under_way: Sequence[str] = ("dispatched", "collecting"), start: str = "queued") -> DataFrame:
    """States after a restart: jobs that were under way begin again. states: (job_id, state, ...)."""
    hit = F.coalesce(F.col("state").isin(*under_way), F.lit(False))
    return states.withColumn("recovered", hit).withColumn("state", F.when(hit, start).otherwise(F.col("state")))


def phase(found: Column, collected: Column, failed: Column, skipped: Column, rounds: Column, most_rounds: int, most_items: int) -> Column:
    """How a run of rounds ended, from its counts: nothing seen, only failures, only skips, limits reached, or done."""
    nothing = collected == 0
    return (
        F.when(found == 0, "empty").when(nothing & (failed > 0), "failed").when(nothing & (skipped > 0), "skipped_all")
        .when((rounds >= most_rounds) & (collected >= most_items), "capped").otherwise("done")
    )


def records(runs: DataFrame) -> DataFrame:
    """``(source, last_attempt, last_success, last_error)`` after each source's last run. runs: (source, seq, at, error)."""
    last = runs.groupBy("source").agg(F.max_by(F.struct("at", "error"), "seq").alias("l"))
    return last.select("source", F.col("l.at").alias("last_attempt"), F.when(F.col("l.error").isNull(), F.col("l.at")).alias("last_success"), F.col("l.error").alias("last_error"))
