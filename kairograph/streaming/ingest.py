"""Ingest of raw texts, and Structured Streaming: keyed slot state, micro-batch upserts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.functions.keys import normalize_alias
from kairograph.functions.text import IDENTITY_PREDICATES
from kairograph.operators import temporal, write
from kairograph.operators.graph import _shared_dir, written
from kairograph.sources.hooks import extract

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_CHANGE = "group_id string, source_node_uuid string, name string, target_node_uuid string, uuid string, valid_at timestamp, closes string"


@dataclass(frozen=True)
class Written:
    """What a batch of episodes leaves: entities (uuid, group_id, name, created), mentions (episode_uuid, entity_uuid), edges, episodes."""

    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame


def claims_of(episodes: DataFrame) -> DataFrame:
    """Repaired claims of raw texts with their episode's tenant and time: group_id, episode_uuid, pos, seq, subject, predicate, object, fact, valid_at."""
    texts = episodes.select(F.col("uuid").alias("episode_uuid"), "content", "group_id", F.col("reference_time").alias("valid_at"))
    return temporal.repair(extract(texts, "episode_uuid", carried=("group_id", "valid_at"))).where("keep").drop("keep")


def add_episodes(episodes: DataFrame, entities: DataFrame, aliases: DataFrame, frames: DataFrame) -> Written:
    """Batch ingest: extract, repair, resolve and create entities, write facts through the cascade, link mentions.

    Entities go by alias, then by name, else get a stable id of tenant and
    folded name, so a second run makes the same ones.  Claims arrive in the
    order of (time, episode, sentence, claim); equal open ones merge their
    episodes.  Self-loops stay only for identity predicates.
    """
    told = written(claims_of(episodes))  # texts are read once
    names = told.select("group_id", "episode_uuid", F.explode(F.array("subject", "object")).alias("name")).where("group_id is not null").distinct()
    names = written(names.withColumn("key", normalize_alias(F.col("name"))))
    known = aliases.groupBy("group_id", F.col("normalized_alias").alias("key")).agg(F.min("entity_uuid").alias("by_alias"))
    own = entities.groupBy("group_id", normalize_alias(F.col("name")).alias("key")).agg(F.min("uuid").alias("by_name"))
    keys = names.select("group_id", "key", "name").distinct().groupBy("group_id", "key").agg(F.min("name").alias("name")).join(known, ["group_id", "key"], "left").join(own, ["group_id", "key"], "left")
    fresh = lambda key: F.concat(F.lit("n:"), "group_id", F.lit(":"), key)
    ids = written(keys.select("group_id", "key", "name", F.coalesce("by_alias", "by_name", fresh("key")).alias("uuid"), F.coalesce("by_alias", "by_name").isNull().alias("created")))
    # what a claim makes anew follows from its key; only ids that were there before are joined
    before = written(ids.where("not created").select("group_id", "key", "uuid"))
    rows = told.where("group_id is not null").withColumns({"ks": normalize_alias(F.col("subject")), "ko": normalize_alias(F.col("object"))})
    for key, end in (("ks", "source_node_uuid"), ("ko", "target_node_uuid")):
        rows = rows.join(before.select("group_id", F.col("key").alias(key), F.col("uuid").alias(end)), ["group_id", key], "left").withColumn(end, F.coalesce(end, fresh(key)))
    rows = rows.where((F.col("source_node_uuid") != F.col("target_node_uuid")) | F.col("predicate").isin(*IDENTITY_PREDICATES))
    # only the order within a tenant matters: texts are put in order, each takes as many numbers as its claims can need
    text = ["group_id", "valid_at", "episode_uuid"]
    spans = told.groupBy(*text).agg((F.max("pos") + 1).cast("long").alias("n"), (F.max("seq") + 1).cast("long").alias("width"))
    earlier = Window.partitionBy("group_id").orderBy("valid_at", "episode_uuid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("first", F.coalesce(F.sum(F.col("n") * F.col("width")).over(earlier), F.lit(0))).select(*text, "first", "width")
    rows = rows.join(spans.hint("shuffle_hash"), text)
    place = (F.col("first") + F.col("pos") * F.col("width") + F.col("seq")).cast("long")
    rows = rows.select("group_id", "source_node_uuid", F.col("predicate").alias("relation"), "target_node_uuid", "fact", "valid_at", "episode_uuid", F.concat_ws(":", "episode_uuid", "pos", "seq").alias("uuid"), place.alias("seq"))
    rows = written(rows)
    edges = written(write.write_facts(rows.drop("episode_uuid"), frames))
    told_by = write.claims(rows.drop("episode_uuid"), frames).select("uuid", *write.SLOT, "target_node_uuid", "seq").join(rows.select("uuid", "episode_uuid", "fact"), "uuid")
    # a claim belongs to the edge of its slot and object that was open when it came
    same = [*write.SLOT, "target_node_uuid"]
    spans = edges.select(F.col("uuid").alias("edge"), *same, F.col("seq").alias("from"), F.col("merged_to").alias("to"))
    cited = told_by.join(spans, same).where("seq >= `from` and (`to` is null or seq <= `to`)")
    first = cited.groupBy("edge").agg(F.array_join(F.array_sort(F.collect_set("episode_uuid")), ",").alias("episodes"), F.min_by("fact", "seq").alias("fact"))
    edges = edges.join(first, edges["uuid"] == first["edge"], "left").drop("edge")  # each has its own claim; who doesn't ask for texts reads none
    mentions = names.join(ids.select("group_id", "key", "uuid"), ["group_id", "key"]).select("episode_uuid", F.col("uuid").alias("entity_uuid")).distinct()
    made = ids.groupBy("uuid").agg(F.min("group_id").alias("group_id"), F.min("name").alias("name"), F.first("created").alias("created"))
    return Written(made, mentions, edges)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over one file, or over the files of a folder, one at a time."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 1)
    return stream.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else stream.parquet(path)


def run_epochs(spark: SparkSession, stream: DataFrame, at: str, shape=None, fail=None) -> None:
    """Writes what each micro-batch adds below ``at/epochs``; a replayed batch overwrites itself.

    ``shape`` reduces a batch before it is written; ``fail`` may raise after the write.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        (batch if shape is None else shape(batch)).write.mode("overwrite").parquet(f"{at}/epochs/epoch={epoch}")
        if fail is not None:
            fail(epoch)

    stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def read_epochs(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """What all micro-batches wrote; to be merged by the reader, so no batch rewrites what earlier ones left."""
    if not _exists(spark, f"{at}/epochs"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{at}/epochs/*")


def slot_changes(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Keyed state: the open edge of a slot.  A different object opens an edge and closes the one before, in arrival order."""
    held = state.get if state.exists else (None, None, -1)
    obj, edge, _ = held
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for r in rows.itertuples(index=False):
        if r.target_node_uuid != obj:
            out.append((*key, r.target_node_uuid, r.uuid, r.valid_at, edge))
            obj, edge = r.target_node_uuid, r.uuid
    state.update((obj, edge, int(rows["seq"].iloc[-1])))
    yield pd.DataFrame(out, columns=["group_id", "source_node_uuid", "name", "target_node_uuid", "uuid", "valid_at", "closes"])


def stream_slots(spark: SparkSession, path: str, late: str = "ts") -> DataFrame:
    """Changes of every slot, from a stream with keyed state.

    Rows count in the order of their arrival: one that is late in its valid time
    (``late`` is that time's expression) still closes a newer one.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    events = read_events(spark, path).select(
        F.concat(F.lit("u"), F.col("user_id") % 8).alias("group_id"),
        F.concat(F.lit("user:"), "user_id").alias("source_node_uuid"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("u"), F.col("user_id") % 8, F.lit(":obj:"), F.get_json_object("props", "$.k").cast("long") % 5).alias("target_node_uuid"),
        F.concat(F.lit("e"), "event_id").alias("uuid"),
        F.col("event_id").alias("seq"),
        F.expr(late).cast("timestamp").alias("valid_at"),
    )
    changes = events.groupBy("group_id", "source_node_uuid", "name").applyInPandasWithState(slot_changes, _CHANGE, "obj string, edge string, seq long", "append", GroupStateTimeout.NoTimeout)
    at = f"{_shared_dir(spark)}/slots-{uuid.uuid4().hex}"
    run_epochs(spark, changes, at)
    return read_epochs(spark, at, _CHANGE)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """user_id, event_type, n, last_at: every micro-batch adds its own counts, readers add them up."""
    at = f"{_shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    run_epochs(spark, read_events(spark, path), at, lambda b: b.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at")))
    rows = read_epochs(spark, at, "user_id long, event_type string, n long, last_at timestamp_ntz")
    return rows.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))


def stream_latest(spark: SparkSession, path: str) -> DataFrame:
    """event_id, value: the newest value of every key; each micro-batch adds its newest, readers take the newest of all."""
    at = f"{_shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    best = lambda rows: rows.groupBy("event_id").agg(F.max(F.struct("ts", "value")).alias("b")).select("event_id", "b.ts", "b.value")
    twice = read_events(spark, path).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    run_epochs(spark, twice, at, best)
    return best(read_epochs(spark, at, "event_id long, ts timestamp_ntz, value double")).select("event_id", "value")


def recovered_counts(spark: SparkSession, path: str) -> DataFrame:
    """user_id, n from a query that fails once in its first batch and is started again on the same checkpoint."""
    at, failed = f"{_shared_dir(spark)}/recovered-{uuid.uuid4().hex}", []

    def fail(epoch: int) -> None:
        if not failed:
            failed.append(epoch)
            raise RuntimeError("the first attempt is lost after its write")

    counted = lambda b: b.groupBy("user_id").agg(F.count("*").alias("n"))
    for _ in range(2):
        try:
            run_epochs(spark, read_events(spark, path), at, counted, fail)
        except Exception:
            if len(failed) != 1:
                raise
    return read_epochs(spark, at, "user_id long, n long").groupBy("user_id").agg(F.sum("n").alias("n"))


def isolated_counts(spark: SparkSession, path: str) -> DataFrame:
    """user_id, n, error: each tenant's step of each micro-batch by itself; a third of the tenants raise and are set aside.

    The step sees a tenant's counts, which combine before the shuffle, so no task holds a tenant's rows.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                try:
                    if r.user_id % 3 == 0:
                        raise ValueError("this tenant's step fails")
                    out.append((r.user_id, r.n, None))
                except ValueError as e:
                    out.append((r.user_id, 0, str(e)))
            yield pd.DataFrame(out, columns=["user_id", "n", "error"])

    at, schema = f"{_shared_dir(spark)}/isolated-{uuid.uuid4().hex}", "user_id long, n long, error string"
    run_epochs(spark, read_events(spark, path), at, lambda b: b.groupBy("user_id").agg(F.count("*").alias("n")).mapInPandas(step, schema))
    return read_epochs(spark, at, schema).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("error").alias("error"))


def stopped_counts(spark: SparkSession, path: str) -> DataFrame:
    """event_type, n from a query without an end that is stopped once all input was processed."""
    at = f"{_shared_dir(spark)}/stopped-{uuid.uuid4().hex}"

    def each(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/epochs/epoch={epoch}")

    q = read_events(spark, path).writeStream.option("checkpointLocation", f"{at}/checkpoint").foreachBatch(each).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return read_epochs(spark, at, "event_type string, n long").groupBy("event_type").agg(F.sum("n").alias("n"))
