"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.operators import filters as O
from kairograph.operators import graph, resolve, search, temporal

from .registry import query


@query("""SELECT f.uuid, s.name AS subject_name, o.name AS object_name, h.name AS holder_name FROM kg_fact f LEFT JOIN kg_entity s ON s.uuid = f.source_node_uuid LEFT JOIN kg_entity o ON o.uuid = f.target_node_uuid LEFT JOIN kg_entity h ON h.uuid = f.belief_holder""")
def join_endpoint_names(g):
    rows = g.fact.select("uuid", "source_node_uuid", "target_node_uuid", "belief_holder")
    for end, out in (("source_node_uuid", "subject_name"), ("target_node_uuid", "object_name"), ("belief_holder", "holder_name")):
        rows = rows.join(g.entity.select(F.col("uuid").alias(end), F.col("name").alias(out)), end, "left")
    return rows.select("uuid", "subject_name", "object_name", "holder_name")


@query("""WITH n AS (SELECT uuid FROM kg_entity WHERE mention_count >= 4) SELECT uuid FROM kg_fact WHERE source_node_uuid IN (SELECT uuid FROM n) AND target_node_uuid IN (SELECT uuid FROM n)""")
def join_inner_graph(g):
    nodes = g.entity.where("mention_count >= 4").select(F.col("uuid").alias("node"))
    return O.inner_graph(g.fact.select("uuid", "source_node_uuid", "target_node_uuid"), nodes).select("uuid")


@query("SELECT f.uuid, f.e AS episode, s.reference_time FROM (SELECT uuid, unnest(episodes) AS e FROM kg_fact) f JOIN kg_source_episode s ON s.uuid = f.e")
def join_episode_times(g):
    times = g.source_episode.select(F.col("uuid").alias("episode"), "reference_time")
    return g.fact.select("uuid", F.explode("episodes").alias("episode")).join(times, "episode")


@query("SELECT DISTINCT m.episode_uuid, s.reference_time, e.uuid AS entity_uuid, e.name FROM kg_mention m JOIN kg_source_episode s ON s.uuid = m.episode_uuid JOIN kg_entity e ON e.uuid = m.entity_uuid")
def join_mentions(g):
    rows = g.mention.select("episode_uuid", "entity_uuid").distinct()
    rows = rows.join(g.source_episode.select(F.col("uuid").alias("episode_uuid"), "reference_time"), "episode_uuid")
    return rows.join(g.entity.select(F.col("uuid").alias("entity_uuid"), "name"), "entity_uuid").select("episode_uuid", "reference_time", "entity_uuid", "name")


@query("""WITH x AS (SELECT uuid, unnest(traits) AS t, generate_subscripts(traits, 1) AS pos FROM kg_entity) SELECT x.uuid, string_agg(e.name, ',' ORDER BY x.pos) AS trait_names FROM x JOIN kg_entity e ON e.uuid = x.t GROUP BY x.uuid""")
def join_traits_goals(g):
    rows = g.entity.select("uuid", F.posexplode("traits").alias("pos", "t"))
    named = rows.join(g.entity.select(F.col("uuid").alias("t"), "name"), "t")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return named.groupBy("uuid").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ",").alias("trait_names"))


@query("""WITH m(id, group_id, name) AS (VALUES (1, 'u1', 'U-1'), (2, 'u2', 'u-2!'), (3, 'u3', 'U-2'), (4, 'u4', ' U-4 '))
SELECT m.id, a.entity_uuid FROM m JOIN kg_alias a ON a.group_id = m.group_id AND a.normalized_alias = trim(regexp_replace(lower(regexp_replace(m.name, '[^\\p{L}\\p{N}_\\s''\\-]', ' ', 'g')), '\\s+', ' ', 'g'))""".replace("\\\\", "\\"))
def join_alias_lookup(g):
    from kairograph.functions.keys import normalize_alias

    m = g.spark.createDataFrame([(1, "u1", "U-1"), (2, "u2", "u-2!"), (3, "u3", "U-2"), (4, "u4", " U-4 ")], "id int, group_id string, name string")
    m = m.withColumn("normalized_alias", normalize_alias(F.col("name")))
    return g.alias.join(F.broadcast(m.select("id", "group_id", "normalized_alias")), ["group_id", "normalized_alias"]).select("id", "entity_uuid")


_TENANT = [("u1", "resides_in", "dwells_in"), ("u2", "custom_tie", "tied_to")]


@query("""WITH t(group_id, alias, canonical) AS (VALUES ('u1', 'resides_in', 'dwells_in'), ('u2', 'custom_tie', 'tied_to'))
SELECT f.uuid, coalesce(t.canonical, r.canonical, lower(f.relation)) AS canonical, CASE WHEN t.canonical IS NOT NULL THEN 'many_current' ELSE r.cardinality END AS cardinality FROM kg_fact f
LEFT JOIN kg_frame r ON r.alias = lower(f.relation) LEFT JOIN t ON t.group_id = f.group_id AND t.alias = lower(f.relation)""")
def join_frame(g):
    tenant = g.spark.createDataFrame([(a, c, b, 0, "directed", None, "state", "many_current", "coexist", 0.7) for a, b, c in _TENANT], "group_id string, canonical string, alias string, n int, direction string, inverse string, temporal string, cardinality string, policy string, confidence double")
    rows = g.fact.select("uuid", "group_id", "relation")
    return temporal.resolve_frames(rows, g.frame, tenant=tenant).select("uuid", "canonical", "cardinality")


@query("""WITH e AS (SELECT uuid, group_id, fact_embedding AS v FROM kg_vec), m AS (SELECT uuid AS mention, group_id, v FROM e WHERE uuid IN ('vec:4', 'vec:13', 'vec:22')),
s AS (SELECT mention, uuid, round(list_cosine_similarity(m.v, e.v), 6) AS score FROM m JOIN e USING (group_id) WHERE list_cosine_similarity(m.v, e.v) >= 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, uuid) AS rank FROM s) SELECT mention, uuid, score, rank FROM r WHERE rank <= 5""")
def join_semantic_knn(g):
    e = g.vec.select("uuid", "group_id", F.col("fact_embedding").alias("embedding"))
    m = e.where("uuid in ('vec:4', 'vec:13', 'vec:22')").select(F.col("uuid").alias("mention_id"), "group_id", F.col("embedding").alias("mention_embedding"))
    hits = resolve.semantic_matches(F.broadcast(m), e, 0.1).where("rank <= 5")
    return hits.select(F.col("mention_id").alias("mention"), "uuid", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _peers_sql(on: str, other: str) -> str:
    return f"""WITH a AS (SELECT * FROM kg_fact WHERE status = 'active' AND invalid_at IS NULL)
SELECT a.uuid, count(*) AS n_peers, min(b.seq) AS first_peer FROM a JOIN a b ON a.group_id = b.group_id AND a.{on} = b.{on} AND b.seq < a.seq AND a.{other} <> b.{other} GROUP BY a.uuid"""


@query(_peers_sql("target_node_uuid", "source_node_uuid"))
def join_co_object(g):
    return temporal.peer_counts(g.fact.where(O.active()), "target_node_uuid", "source_node_uuid").where("n_peers > 0")


@query(_peers_sql("source_node_uuid", "target_node_uuid"))
def join_co_subject(g):
    return temporal.peer_counts(g.fact.where(O.active()), "source_node_uuid", "target_node_uuid").where("n_peers > 0")


@query("""WITH a AS (SELECT * FROM kg_fact WHERE status = 'active' AND invalid_at IS NULL) SELECT a.uuid, b.uuid AS peer FROM a JOIN a b ON a.group_id = b.group_id AND a.source_node_uuid = b.source_node_uuid AND a.name = b.name AND a.target_node_uuid <> b.target_node_uuid AND b.seq < a.seq""")
def join_slot_peers(g):
    a = g.fact.where(O.active()).select("group_id", "source_node_uuid", "name", "target_node_uuid", "uuid", "seq")
    b = a.select("group_id", "source_node_uuid", "name", F.col("target_node_uuid").alias("t"), F.col("uuid").alias("peer"), F.col("seq").alias("s"))
    return a.join(b, ["group_id", "source_node_uuid", "name"]).where("target_node_uuid <> t and s < seq").select("uuid", "peer")


@query("""WITH k AS (SELECT *, group_id || '::' || source_node_uuid || '::' || lower(name) || '::' || target_node_uuid AS fact_key FROM kg_fact WHERE invalid_at IS NULL)
SELECT a.uuid, min(b.seq) AS equivalent_seq FROM k a JOIN k b ON a.fact_key = b.fact_key AND b.seq < a.seq GROUP BY a.uuid""")
def join_equivalent(g):
    from kairograph.functions.keys import fact_key

    k = g.fact.where("invalid_at is null").select("uuid", "seq", fact_key(F.col("group_id"), F.col("source_node_uuid"), F.col("name"), F.col("target_node_uuid")).alias("fact_key"))
    first = k.groupBy("fact_key").agg(F.min("seq").alias("equivalent_seq"))
    return k.join(first, "fact_key").where("equivalent_seq < seq").select("uuid", "equivalent_seq")


@query("""WITH p AS (SELECT o_orderkey, o_custkey AS c, TIMESTAMP '2024-01-01 00:00:00' + to_hours((o_orderkey % 700)::INT) AS t FROM orders)
SELECT p.o_orderkey, f.uuid FROM p JOIN kg_fact f ON f.source_node_uuid = 'user:' || p.c AND f.valid_at <= p.t AND (f.invalid_at IS NULL OR f.invalid_at > p.t) AND f.invalid_at IS NOT NULL""")
def join_asof(g):
    p = g.raw("orders").selectExpr("o_orderkey", "'user:' || o_custkey as source_node_uuid", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(o_orderkey % 700 as int)) as t")
    f = g.fact.where("invalid_at is not null").select("uuid", "source_node_uuid", "valid_at", "invalid_at")
    return temporal.interval_join(p, f, ["source_node_uuid"]).select("o_orderkey", "uuid")


@query("""WITH n AS (SELECT DISTINCT target_node_uuid AS t FROM kg_vec WHERE source_node_uuid = 'n3') SELECT uuid FROM kg_vec WHERE source_node_uuid IN (SELECT t FROM n) OR target_node_uuid IN (SELECT t FROM n)""")
def join_two_hop(g):
    out = g.vec.where("source_node_uuid = 'n3'").select(F.col("target_node_uuid").alias("node")).distinct()
    return O.ego_edges(g.vec.select("uuid", "source_node_uuid", "target_node_uuid"), out).select("uuid")


@query("""WITH e AS (SELECT source_node_uuid AS a, target_node_uuid AS b FROM kg_vec UNION SELECT target_node_uuid, source_node_uuid FROM kg_vec),
walk(node, depth) AS (SELECT 'n3', 0 UNION SELECT e.b, depth + 1 FROM walk JOIN e ON e.a = walk.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def join_bfs(g):
    return graph.hops(g.vec, "n3", 3)


@query("""WITH map AS (SELECT uuid, 'new:' || uuid AS to_uuid FROM kg_entity WHERE uuid <> 'user:9')
SELECT f.uuid, s.to_uuid AS source_node_uuid, o.to_uuid AS target_node_uuid FROM kg_fact f JOIN map s ON s.uuid = f.source_node_uuid JOIN map o ON o.uuid = f.target_node_uuid""")
def join_id_remap(g):
    to = g.entity.where("uuid <> 'user:9'").select("uuid", F.concat(F.lit("new:"), "uuid").alias("to"))
    rows = g.fact.select("uuid", "source_node_uuid", "target_node_uuid")
    s = to.select(F.col("uuid").alias("source_node_uuid"), F.col("to").alias("s"))
    o = to.select(F.col("uuid").alias("target_node_uuid"), F.col("to").alias("o"))
    return rows.join(s, "source_node_uuid").join(o, "target_node_uuid").select("uuid", F.col("s").alias("source_node_uuid"), F.col("o").alias("target_node_uuid"))


@query("SELECT uuid FROM kg_entity WHERE uuid NOT IN (SELECT source_node_uuid FROM kg_fact) AND uuid NOT IN (SELECT target_node_uuid FROM kg_fact)")
def join_anti(g):
    ends = g.fact.select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("uuid"))
    return g.entity.join(ends, "uuid", "left_anti").select("uuid")


@query("SELECT uuid FROM kg_entity WHERE uuid IN (SELECT entity_uuid FROM kg_mention)")
def join_semi(g):
    return g.entity.join(g.mention.select(F.col("entity_uuid").alias("uuid")), "uuid", "left_semi").select("uuid")
