"""Debounced passes per tenant as keyed state over a stream.

A tenant's pending rows fire a pass when there are ``threshold`` of them, or
when the tenant was quiet for ``idle``.  Both run on event time: a later row of
the tenant, or the watermark, tells that the quiet time is over.  The state of a
tenant is a count, a time and a number of passes, so it never grows with rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from kairograph.operators.graph import _shared_dir

from .ingest import read_events, read_epochs, run_epochs

THRESHOLD, IDLE_SECONDS = 5, 8
_PASS = "user_id long, pass_no long, n long, fired_us long, reason string"
_STATE = "pending long, last long, passes long"
_US = 1_000_000


def fire(threshold: int, idle_seconds: int):
    """The pass function; times are microseconds since 1970."""
    idle = idle_seconds * _US

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, last, passes = state.get if state.exists else (0, 0, 0)
        out = []

        def send(at: int, reason: str) -> None:
            nonlocal pending, passes
            passes += 1
            out.append((key[0], passes, pending, at, reason))
            pending = 0

        if state.hasTimedOut:
            if pending:
                send(last + idle, "idle")
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
            for at in rows["at"].tolist():
                if pending and at - last > idle:
                    send(last + idle, "idle")
                pending, last = pending + 1, max(last, at)
                if pending >= threshold:
                    send(at, "count")
        state.update((pending, last, passes))
        if pending:
            due = (last + idle) // 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "pass_no", "n", "fired_us", "reason"])

    return step


def start(spark: SparkSession, path: str, at: str, threshold: int = THRESHOLD, idle_seconds: int = IDLE_SECONDS) -> None:
    """Runs the stream over what there is; ``at`` holds its checkpoint and its passes, so a second call goes on."""
    events = read_events(spark, path).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    events = events.withWatermark("ts", "0 seconds").select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"))
    passes = events.groupBy("user_id").applyInPandasWithState(fire(threshold, idle_seconds), _PASS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    run_epochs(spark, passes, at)


def stream_passes(spark: SparkSession, path: str, threshold: int = THRESHOLD, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """user_id, pass_no, n, fired_at, reason of every pass."""
    at = f"{_shared_dir(spark)}/passes-{uuid.uuid4().hex}"
    start(spark, path, at, threshold, idle_seconds)
    return read_epochs(spark, at, _PASS).select("user_id", "pass_no", "n", F.timestamp_micros("fired_us").alias("fired_at"), "reason")


def pending_state(spark: SparkSession, path: str, threshold: int = THRESHOLD, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """user_id, pending, passes as the stream's state store holds them after the run."""
    at = f"{_shared_dir(spark)}/pending-{uuid.uuid4().hex}"
    start(spark, path, at, threshold, idle_seconds)
    held = spark.read.format("statestore").load(f"{at}/checkpoint")
    return held.select(F.col("key.user_id").alias("user_id"), F.col("value.groupState.pending").alias("pending"), F.col("value.groupState.passes").alias("passes"))
