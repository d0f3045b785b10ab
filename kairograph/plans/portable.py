"""Packs, JSON lines, ingest hooks, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions import frames
from kairograph.sources import pack
from kairograph.sources.hooks import extract
from kairograph.streaming import ingest, passes

from .registry import query
from .scalars import texts
from .windows import slots_sql


def _tables(g, group: str = "u1"):
    rows = g.fact.where(F.col("group_id") == group).select("uuid", "source_node_uuid", "name", "target_node_uuid", "fact", "confidence", "valid_at", F.size("episodes").alias("source_episode_count"))
    return {
        "entities": g.entity.where(F.col("group_id") == group).select("uuid", "name", "summary"),
        "entity_aliases": g.alias.where(F.col("group_id") == group).select("normalized_alias", "entity_uuid"),
        "relation_frames": frames.frame_aliases(g.spark).select("alias", "canonical"),
        "edges": rows,
    }


@query("SELECT uuid, name, summary FROM kg_entity WHERE group_id = 'u1'")
def snk_jsonl_write(g):
    df = _tables(g)["entities"]
    path = pack.scratch(g.spark, "jsonl")
    pack.write_jsonl(df, path)
    return pack.read_jsonl(g.spark, path, df.schema)


@query("SELECT uuid, mention_count, array_to_string(labels, ',') AS labels FROM kg_entity WHERE group_id = 'u2'")
def src_jsonl_read(g):
    df = g.entity.where("group_id = 'u2'").select("uuid", "mention_count", "labels")
    path = pack.scratch(g.spark, "jsonl")
    pack.write_jsonl(df, path)
    return pack.read_jsonl(g.spark, path, df.schema).withColumn("labels", F.array_join("labels", ","))


def _exported(g) -> str:
    path = pack.scratch(g.spark, "pack")
    pack.export_pack(_tables(g), path)
    return path


@query("""SELECT 'entities' AS file, count(*) AS n FROM kg_entity WHERE group_id = 'u1' UNION ALL SELECT 'entity_aliases', count(*) FROM kg_alias WHERE group_id = 'u1' UNION ALL SELECT 'relation_frames', count(*) FROM kg_frame UNION ALL SELECT 'edges', count(*) FROM kg_fact WHERE group_id = 'u1'""")
def snk_pack_export_dir(g):
    out = None
    for name, df in pack.validate_pack(g.spark, _exported(g)).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n")
        out = part if out is None else out.union(part)
    return out


@query("SELECT uuid, source_node_uuid, name, target_node_uuid, valid_at FROM kg_fact WHERE group_id = 'u1'")
def pack_validate(g):
    return pack.validate_pack(g.spark, _exported(g))["edges"].select("uuid", "source_node_uuid", "name", "target_node_uuid", "valid_at")


_ENDS_KNOWN = "source_node_uuid IN (SELECT uuid FROM own) AND target_node_uuid IN (SELECT uuid FROM own)"


@query(rf"""WITH own AS (SELECT uuid, name FROM kg_entity WHERE group_id = 'u1'), e AS (SELECT * FROM kg_fact WHERE group_id = 'u1'), n AS (SELECT count(*) AS n FROM own),
k AS (SELECT count(DISTINCT source_node_uuid || '::' || lower(name) || '::' || target_node_uuid) AS n FROM e WHERE {_ENDS_KNOWN}), d AS (SELECT count(*) + 1 AS n FROM e WHERE NOT ({_ENDS_KNOWN})),
f AS (SELECT count(DISTINCT alias) AS n FROM kg_frame), a AS (SELECT count(*) AS n FROM kg_alias WHERE group_id = 'u1'), h AS (SELECT count(*) AS n FROM kg_fact WHERE group_id = 'u2'), i AS (SELECT count(*) AS n FROM kg_entity WHERE group_id = 'u2'),
known AS (SELECT DISTINCT trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS k FROM kg_entity WHERE group_id = 'u2'), w AS (SELECT count(*) AS n FROM own WHERE trim(regexp_replace(lower(name), '\s+', ' ', 'g')) NOT IN (SELECT k FROM known))
SELECT 'merge' AS mode, 'entities' AS part, n FROM w UNION ALL SELECT 'merge', 'aliases', n FROM a UNION ALL SELECT 'merge', 'dropped', n FROM d UNION ALL SELECT 'merge', 'frames', n - 1 FROM f UNION ALL SELECT 'merge', 'removed', 0
UNION ALL SELECT 'replace', 'entities', n FROM n UNION ALL SELECT 'replace', 'aliases', n FROM a UNION ALL SELECT 'replace', 'edges', n FROM k UNION ALL SELECT 'replace', 'dropped', n FROM d UNION ALL SELECT 'replace', 'frames', n FROM f UNION ALL SELECT 'replace', 'removed', h.n + i.n FROM h, i""")
def src_pack_import(g):
    """The pack of tenant u1 brought into u2, merged and in its place; an edge to nobody is dropped."""
    tables = _tables(g)
    lost = g.spark.createDataFrame([("lost", "nobody", "likes", "user:1")], "uuid string, source_node_uuid string, name string, target_node_uuid string")
    tables["edges"] = tables["edges"].unionByName(lost, allowMissingColumns=True)
    held = g.spark.createDataFrame([("u2", "resides_in", "lives_in")], "group_id string, alias string, canonical string")
    out = None
    for mode in ("merge", "replace"):
        got = pack.import_pack(tables, "u2", g.entity, g.fact, held, mode)
        counts = {"entities": got.entities, "aliases": got.aliases, "dropped": got.dropped, "frames": got.frames, "removed": got.removed} | ({"edges": got.edges} if mode == "replace" else {})
        for name, df in counts.items():
            part = df.agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), F.lit(name).alias("part"), "n")
            out = part if out is None else out.union(part)
    return out


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false)) t(id, safe)")
def pack_zip_safety(g):
    cases = [[("entities.jsonl/part-0.json", 10)], [("../x", 1)], [("/etc/x", 1)], [("a/../../x", 1)], [("big", pack.MOST_BYTES + 1)]]

    def safe(members) -> bool:
        try:
            pack.safe_members(members)
        except pack.PackError:
            return False
        return True

    return g.spark.createDataFrame([(k, safe(m)) for k, m in enumerate(cases, 1)], "id int, safe boolean")


@query()
def udtf_extract(g):
    """Offline extractor over texts: entities in order and the facts of their sentences."""
    return extract(texts(g), "id")


_EDGE_COLUMNS = ("uuid", "group_id", "source_node_uuid", "name", "target_node_uuid", "fact", "valid_at", "invalid_at", "status", "episodes", "n_claims")


@query()
def tf_add_episode(g):
    """Ingest of every conversation turn: entities resolved and created, facts through the whole cascade, mentions linked.  A test replays it text by text."""
    rows = texts(g).select(F.col("id").alias("uuid"), "group_id", "content", "reference_time")
    return ingest.add_episodes(rows, g.entity, g.alias, frames.frame_aliases(g.spark)).edges.select(*_EDGE_COLUMNS)


@query("""WITH l AS (SELECT *, lag(target_node_uuid) OVER w AS prior, row_number() OVER w AS k FROM kg_fact WINDOW w AS (PARTITION BY group_id, source_node_uuid, name ORDER BY seq)), c AS (SELECT * FROM l WHERE k = 1 OR target_node_uuid <> prior)
SELECT group_id, source_node_uuid, name, target_node_uuid, uuid, valid_at, lag(uuid) OVER (PARTITION BY group_id, source_node_uuid, name ORDER BY seq) AS closes FROM c""")
def st_slot_state(g):
    """Slot closure as a stream with keyed state; equals the batch form."""
    return ingest.stream_slots(g.spark, f"{g.sf_dir}/events.parquet")


_IDLE_HOURS = 6
_PASSES = f"""g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {_IDLE_HOURS} HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g), n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1) // 5 AS chunk FROM i),
c AS (SELECT user_id, session, chunk, count(*) AS n, max(ts) AS last FROM n GROUP BY 1, 2, 3), f AS (SELECT *, lead(session) OVER (PARTITION BY user_id ORDER BY session, chunk) IS NOT NULL OR epoch_ms(last + INTERVAL {_IDLE_HOURS} HOUR) < (SELECT epoch_ms(max(ts)) FROM events) AS quiet FROM c)"""


@query(f"""WITH {_PASSES} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY session, chunk) AS pass_no, n, CASE WHEN n = 5 THEN last ELSE last + INTERVAL {_IDLE_HOURS} HOUR END AS fired_at, CASE WHEN n = 5 THEN 'count' ELSE 'idle' END AS reason FROM f WHERE n = 5 OR quiet""")
def st_debounce(g):
    """A stream with keyed state and timers: a tenant's pass fires at five pending rows or after six quiet hours."""
    fired = passes.stream_passes(g.spark, f"{g.sf_dir}/events.parquet", 5, _IDLE_HOURS * 3600)
    return fired.withColumn("fired_at", F.col("fired_at").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2")
def st_ingest(g):
    """Stream to table through foreachBatch upserts; the result equals the batch aggregate."""
    return ingest.stream_counts(g.spark, f"{g.sf_dir}/events.parquet")


@query("SELECT uuid, name, summary FROM kg_entity WHERE group_id = 'u1'")
def snk_pack_export_zip(g):
    """The pack zipped and unpacked again, then validated.  An archive is one local file, so it is made on the driver."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        archive = os.path.join(folder, "pack.zip")
        pack.zip_exported(g.spark, _exported(g), archive)
        back = pack.scratch(g.spark, "unzipped")
        pack.unzip_to(g.spark, archive, back)
    return pack.validate_pack(g.spark, back)["entities"].select("uuid", "name", "summary")


_TRIPLES = """SELECT f.*, 'assert' AS op, coalesce(r.canonical, lower(f.relation)) AS pred, coalesce(r.cardinality = 'one_current', false) AS one,
CASE WHEN r.direction = 'symmetric' THEN least(source_node_uuid, target_node_uuid) ELSE source_node_uuid END AS s, CASE WHEN r.direction = 'symmetric' THEN greatest(source_node_uuid, target_node_uuid) ELSE target_node_uuid END AS o FROM kg_fact f LEFT JOIN kg_frame r ON r.alias = lower(f.relation)"""


@query(f"""WITH t AS ({_TRIPLES}), {slots_sql("SELECT uuid, seq, group_id, valid_at, op, pred AS name, s AS source_node_uuid, o AS target_node_uuid FROM t WHERE one")}
SELECT group_id, source_node_uuid AS subject, name AS predicate, target_node_uuid AS object, status, n_asserts AS n FROM slots UNION ALL SELECT group_id, s, pred, o, 'active', count(*) FROM t WHERE NOT one GROUP BY group_id, s, pred, o""")
def tf_add_triplet(g):
    """Direct triples: aliases resolve, symmetric ends are ordered, a one_current slot keeps the newcomer, equal ones merge."""
    from kairograph.operators import write

    rows = g.fact.select("uuid", "seq", "group_id", "source_node_uuid", "relation", "target_node_uuid", "valid_at")
    out = write.close(write.claims(rows, g.frame))
    status = F.when(F.col("closed_seq").isNull(), "active").otherwise("superseded")
    return out.select("group_id", F.col("source_node_uuid").alias("subject"), F.col("name").alias("predicate"), F.col("target_node_uuid").alias("object"), status.alias("status"), F.col("n_claims").alias("n"))


@query()
def tf_add_bulk(g):
    """The same ingest over all documents: how many entities, mentions and edges each tenant gains."""
    rows = g.raw("documents").selectExpr("'d' || doc_id as uuid", "coalesce(source, '') as group_id", "coalesce(text, '') as content", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int)) as reference_time")
    got = ingest.add_episodes(rows, g.entity, g.alias, frames.frame_aliases(g.spark))
    groups = got.entities.select("uuid", "group_id")
    parts = {"entities": groups, "mentions": got.mentions.join(groups, got.mentions["entity_uuid"] == groups["uuid"]), "edges": got.edges}
    out = None
    for kind, df in parts.items():
        part = df.groupBy("group_id").agg(F.count("*").alias("n")).select("group_id", F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.union(part)
    return out


@query("""SELECT 'assistant:' || group_id AS subject, CASE source WHEN 'self_reflection' THEN 'reflects' ELSE 'observes' END AS predicate, count(*) AS n FROM kg_episode WHERE source LIKE 'self_%' GROUP BY 1, 2""")
def tf_self_episode(g):
    """Self-episodes: the subject is the tenant's assistant, whatever the text names."""
    kinds = {"self_reflection": "reflects", "self_observation": "observes", "self_goal": "aims", "self_belief": "believes"}
    predicate = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("source")], F.lit("observes"))
    return g.episode.where(F.col("source").startswith("self_")).groupBy(F.concat(F.lit("assistant:"), "group_id").alias("subject"), predicate.alias("predicate")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id AS id, user_id, event_type, unnest(CASE WHEN event_id % 2 = 0 THEN ['tea', 'milk'] ELSE ['tea'] END) AS object FROM events)
SELECT id, 0 AS pos, 'user ' || user_id AS subject, CASE WHEN id % 7 = 0 THEN 'related_to' ELSE event_type END AS predicate, object, CASE id % 4 WHEN 0 THEN 'terminate' WHEN 3 THEN 'noop' ELSE 'assert' END AS operation, CASE WHEN id % 3 = 0 THEN 'goal' ELSE 'objective' END AS memory_class, CASE WHEN id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM e""")
def udtf_parse_extraction(g):
    """A model's JSON answer per event as fact rows."""
    from kairograph.sources.hooks import parse_extraction

    return parse_extraction(g.table("kg_answer"), "id").drop("fact")


@query(r"""WITH t AS (SELECT uuid AS id, unnest(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) AS tok FROM kg_text),
h AS (SELECT id, ('0x' || substr(sha256(tok), 1, 8))::BIGINT % 16 AS up, ('0x' || substr(sha256(tok), 9, 8))::BIGINT % 16 AS down FROM t), i AS (SELECT id, i FROM (SELECT uuid AS id FROM kg_text), range(16) r(i)),
s AS (SELECT id, up AS i, 1 AS x FROM h UNION ALL SELECT id, down, -1 FROM h), d AS (SELECT i.id, i.i, coalesce(sum(x), 0) AS x FROM i LEFT JOIN s ON s.id = i.id AND s.i = i.i GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM d GROUP BY id)
SELECT id, string_agg(round(CASE WHEN n > 0 THEN 1000 * x / n ELSE 0 END)::BIGINT::VARCHAR, ',' ORDER BY i) AS vector FROM d JOIN n USING (id) GROUP BY id""")
def udf_embedder(g):
    """Embedder hook: an Arrow-batched model over texts."""
    from kairograph.sources.hooks import embed_column
    from kairograph.sources.offline import HashEmbedder

    v = embed_column(HashEmbedder, F.col("content"))
    return texts(g).select("id", F.array_join(F.transform(v, lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("vector"))


@query(r"""SELECT uuid AS id, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(content), '\s+')), ['i', 'want', 'to', 'learn'])) / 4.0, 6)::DOUBLE AS score FROM kg_text""")
def udf_reranker(g):
    """Reranker hook: a cross encoder over passages."""
    from kairograph.sources.hooks import rerank_column
    from kairograph.sources.offline import OverlapReranker

    return texts(g).select("id", F.round(rerank_column(OverlapReranker, "I want to learn", F.col("content")), 6).alias("score"))


@query("SELECT event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def st_dedupe(g):
    """Equal keys merge in state: the newest value of each key, from a stream with repeats."""
    return ingest.stream_latest(g.spark, f"{g.sf_dir}/events.parquet")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def st_recover(g):
    """The query stops after its first batch and starts again from its checkpoint; nothing is lost or counted twice."""
    return ingest.recovered_counts(g.spark, f"{g.sf_dir}/events.parquet")


_LATE = "CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 10 DAY ELSE ts END"


@query(f"""WITH e AS (SELECT f.*, ({_LATE}) AS told FROM kg_fact f JOIN events ON event_id = seq), l AS (SELECT *, lag(target_node_uuid) OVER w AS prior, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY group_id, source_node_uuid, name ORDER BY seq)),
c AS (SELECT *, lag(uuid) OVER w AS closes, lag(told) OVER w AS closed_at FROM l WHERE k = 1 OR target_node_uuid <> prior WINDOW w AS (PARTITION BY group_id, source_node_uuid, name ORDER BY seq))
SELECT uuid, told AS valid_at, closes, coalesce(told < closed_at, false) AS late FROM c""")
def st_late_data(g):
    """Arrival decides: a fact that is late in its valid time still closes the newer one before it."""
    rows = ingest.stream_slots(g.spark, f"{g.sf_dir}/events.parquet", _LATE).withColumn("valid_at", F.col("valid_at").cast("timestamp_ntz"))
    closed = rows.select(F.col("uuid").alias("closes"), F.col("valid_at").alias("closed_at"))
    return rows.join(closed, "closes", "left").select("uuid", "valid_at", "closes", F.coalesce(F.col("valid_at") < F.col("closed_at"), F.lit(False)).alias("late"))


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN user_id % 3 = 0 THEN 'this tenant''s step fails' END AS error FROM events GROUP BY user_id")
def st_isolation(g):
    """A failing tenant's step is isolated: its error is kept, the others are processed."""
    return ingest.isolated_counts(g.spark, f"{g.sf_dir}/events.parquet")


@query(f"""WITH {_PASSES} SELECT user_id, coalesce(sum(n) FILTER (NOT (n = 5 OR quiet)), 0)::BIGINT AS pending, count(*) FILTER (n = 5 OR quiet) AS passes FROM f GROUP BY user_id""")
def st_state(g):
    """Pending rows and passes of every tenant, read from the stream's state store."""
    return passes.pending_state(g.spark, f"{g.sf_dir}/events.parquet", 5, _IDLE_HOURS * 3600)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st_shutdown(g):
    """A running query is stopped after it took in what there is; its table is whole."""
    return ingest.stopped_counts(g.spark, f"{g.sf_dir}/events.parquet")
