"""Streams over several files and over restarts against one run over everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairograph.streaming import ingest, passes

T0 = datetime(2024, 1, 1)


def events(seed, n=300):
    rng, at, out = random.Random(seed), T0, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 5, 30, 400]), microseconds=rng.randrange(10**6))
        out.append((k, at, rng.randrange(6), rng.choice(["a", "b"]), 1.0, '{"k": %d}' % rng.randrange(9)))
    return out


def replay(rows, threshold, idle):
    """Passes of every tenant, row by row, with the watermark at the newest time of all."""
    end, held, out = max(r[1] for r in rows), {}, []

    def send(user, at, reason):
        pending, last, n = held[user]
        out.append((user, n + 1, pending, at, reason))
        held[user] = (0, last, n + 1)

    for _, at, user, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        pending, last, n = held.get(user, (0, at, 0))
        if pending and at - last > idle:
            send(user, last + idle, "idle")
        pending, _, n = held.get(user, (0, at, 0))
        held[user] = (pending + 1, at, n)
        if pending + 1 >= threshold:
            send(user, at, "count")
    for user, (pending, last, _) in list(held.items()):
        if pending and int((last + idle - T0).total_seconds() * 1000) < int((end - T0).total_seconds() * 1000):
            send(user, last + idle, "idle")
    return sorted(out), {u: (p, n) for u, (p, _, n) in held.items()}


def plain(rows):
    return sorted((r.user_id, r.pass_no, r.n, r.at, r.reason) for r in rows.select("*", F.col("fired_at").cast("timestamp_ntz").alias("at")).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_passes_over_files_and_restarts(spark, tmp_path, seed):
    rows, folder, at = events(seed), tmp_path / "in", str(tmp_path / "at")
    idle = 60
    want, held = replay(rows, 5, timedelta(seconds=idle))
    cuts = [0, 90, 91, 200, 300]
    for a, b in zip(cuts, cuts[1:]):  # a file comes, the stream runs, ends and is started again on its checkpoint
        spark.createDataFrame(rows[a:b], ingest._EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        passes.start(spark, str(folder), at, 5, idle)
    got = ingest.read_epochs(spark, at, passes._PASS).select("user_id", "pass_no", "n", F.timestamp_micros("fired_us").alias("fired_at"), "reason")
    assert plain(got) == want
    state = spark.read.format("statestore").load(f"{at}/checkpoint").select("key.user_id", "value.groupState.*").collect()
    assert {r.user_id: (r.pending, r.passes) for r in state} == held
    assert plain(passes.stream_passes(spark, str(folder), 5, idle)) == want


def test_incremental_tables_over_files(spark, tmp_path):
    rows, folder = events(3), tmp_path / "in"
    for a, b in ((0, 100), (100, 250), (250, 300)):
        spark.createDataFrame(rows[a:b], ingest._EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    counts = {(r.user_id, r.event_type): r.n for r in ingest.stream_counts(spark, str(folder)).collect()}
    assert sum(counts.values()) == 300 and counts[rows[0][2], rows[0][3]] == sum(r[2:4] == rows[0][2:4] for r in rows)
    assert ingest.stream_latest(spark, str(folder)).count() == 300
    got = {r.user_id: (r.n, r.error) for r in ingest.isolated_counts(spark, str(folder)).collect()}
    for user in range(6):
        n = sum(r[2] == user for r in rows)
        assert got[user] == ((0, "this tenant's step fails") if user % 3 == 0 else (n, None))
    assert {r.user_id: r.n for r in ingest.recovered_counts(spark, str(folder)).collect()} == {u: sum(r[2] == u for r in rows) for u in range(6)}


def test_late_facts_close_newer_ones(spark, tmp_path):
    rows = [(0, T0 + timedelta(days=3), 8, "lives", 0.0, '{"k": 0}'), (1, T0, 8, "lives", 0.0, '{"k": 1}'), (2, T0, 8, "lives", 0.0, '{"k": 1}')]
    spark.createDataFrame(rows, ingest._EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {r.uuid: (r.target_node_uuid, r.closes) for r in ingest.stream_slots(spark, str(tmp_path / "in")).collect()}
    assert got == {"e0": ("u0:obj:0", None), "e1": ("u0:obj:1", "e0")}
