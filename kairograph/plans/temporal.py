"""Bitemporal fact maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions import frames as frame_functions
from kairograph.functions.keys import fact_key
from kairograph.operators import filters as O
from kairograph.operators import temporal as T
from kairograph.operators.filters import ntz
from kairograph.sources.testgraph import NOW

from .registry import query
from .windows import SLOT_COLUMNS, closed, slots_sql

KEY_SQL = "trim(group_id) || '::' || trim(source_node_uuid) || '::' || lower(name) || '::' || trim(target_node_uuid)"
_ASOF = "TIMESTAMP '2024-01-20 00:00:00'"


@query(f"WITH {slots_sql()} SELECT group_id, source_node_uuid, name, target_node_uuid, uuid, valid_at, invalid_at FROM slots WHERE valid_at <= {_ASOF} AND (invalid_at IS NULL OR invalid_at > {_ASOF})")
def tf_facts_as_of(g):
    return closed(g).where(O.as_of(ntz("2024-01-20"))).select("group_id", "source_node_uuid", "name", "target_node_uuid", "uuid", "valid_at", "invalid_at")


@query(f"WITH {slots_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY source_node_uuid, name ORDER BY valid_at DESC, uuid) AS k FROM slots WHERE valid_at <= {_ASOF} AND (invalid_at IS NULL OR invalid_at > {_ASOF})) SELECT source_node_uuid, name, target_node_uuid, valid_at FROM r WHERE k = 1")
def tf_state_as_of(g):
    return T.latest_per_slot(closed(g), ntz("2024-01-20"), ("source_node_uuid", "name")).select("source_node_uuid", "name", "target_node_uuid", "valid_at")


@query(f"WITH {slots_sql()} SELECT source_node_uuid, name, target_node_uuid, valid_at FROM slots WHERE invalid_at IS NULL")
def tf_current_facts(g):
    return closed(g).where("invalid_at is null").select("source_node_uuid", "name", "target_node_uuid", "valid_at")


@query(f"WITH {slots_sql()} SELECT name, target_node_uuid, valid_at FROM slots WHERE invalid_at IS NULL AND source_node_uuid = 'user:17' AND name = 'click'")
def tf_current_fact(g):
    slot = g.fact.where("source_node_uuid = 'user:17' and name = 'click'").select("group_id", "source_node_uuid", "name", "target_node_uuid", "uuid", "seq", "valid_at")
    return T.close_slots(slot).where("invalid_at is null").select("name", "target_node_uuid", "valid_at")


_OP = "CASE WHEN seq % 9 = 4 THEN 'terminate' WHEN seq % 31 = 0 THEN 'noop' WHEN seq % 10 = 3 THEN 'correct' WHEN seq % 14 = 5 THEN 'qualify' ELSE 'assert' END"
_OPS = f"SELECT * REPLACE (CASE op WHEN 'correct' THEN 'assert' ELSE op END AS op) FROM (SELECT *, {_OP} AS op FROM kg_fact) WHERE op <> 'qualify'"
_L2_COLUMNS = "group_id, source_node_uuid, name, target_node_uuid, uuid, valid_at, invalid_at, superseded_by"


@query(f"""WITH {slots_sql(_OPS)}, q AS (SELECT * FROM kg_fact WHERE ({_OP}) = 'qualify'), t AS (SELECT * FROM kg_fact WHERE ({_OP}) = 'terminate'),
e AS (SELECT q.*, 'q' || (seq % 3) AS qhash, (SELECT count(*) FROM t WHERE t.group_id = q.group_id AND t.source_node_uuid = q.source_node_uuid AND t.name = q.name AND t.target_node_uuid = q.target_node_uuid AND t.seq < q.seq) AS run,
 (SELECT min(struct_pack(seq := t.seq, at := t.valid_at)) FROM t WHERE t.group_id = q.group_id AND t.source_node_uuid = q.source_node_uuid AND t.name = q.name AND t.target_node_uuid = q.target_node_uuid AND t.seq > q.seq) AS ended FROM q)
SELECT {_L2_COLUMNS} FROM slots UNION ALL SELECT group_id, source_node_uuid, name, target_node_uuid, arg_min(uuid, seq), arg_min(valid_at, seq), any_value(ended.at), NULL FROM e GROUP BY group_id, source_node_uuid, name, target_node_uuid, qhash, run""")
def tf_L2_operation(g):
    """Every slot singleton: ``terminate`` closes its object, ``correct`` is an assertion that closes, ``qualify`` coexists in the slot of its qualifiers."""
    from kairograph.operators import write

    rows = g.fact.select("uuid", "seq", "group_id", "source_node_uuid", F.col("name").alias("relation"), "target_node_uuid", "valid_at", F.expr(_OP).alias("operation"))
    rows = rows.withColumns({"singleton": F.lit(True), "qhash": F.when(F.col("operation") == "qualify", F.concat(F.lit("q"), F.col("seq") % 3)).otherwise("")})
    told = write.claims(rows, g.frame.limit(0))
    return write.close(told).select(*_L2_COLUMNS.split(", "))


@query()
def tf_write_facts(g):
    """The whole cascade over every fact: frames, operations, qualifiers, memory classes, closure, judge, conflicts.  A test replays it claim by claim."""
    from kairograph.operators import write

    return write.write_facts(claim_rows(g), g.frame).select("uuid", "group_id", "source_node_uuid", "name", "target_node_uuid", "valid_at", "invalid_at", "superseded_by", "status", "conflict_group_id", "n_claims")


def claim_rows(g):
    from kairograph.functions.decay import memory_class

    text = F.concat("fact", F.when(F.expr("seq % 10 = 0"), " no longer").otherwise(""))
    qhash = F.when(F.expr(_OP) == "qualify", F.concat(F.lit("q"), F.col("seq") % 3)).otherwise("")
    return g.fact.select("uuid", "seq", "group_id", "source_node_uuid", "relation", "target_node_uuid", "valid_at", F.expr(_OP).alias("operation"), "singleton", "source_type", qhash.alias("qhash"), memory_class(F.col("memory_class")).alias("memory_class"), "is_belief", text.alias("fact"))


_FRAMED = """SELECT f.uuid, f.seq, f.group_id, f.valid_at, 'assert' AS op, coalesce(r.canonical, lower(f.relation)) AS name, r.cardinality, r.policy, f.singleton, f.source_type,
CASE WHEN r.direction = 'symmetric' THEN least(source_node_uuid, target_node_uuid) ELSE source_node_uuid END AS source_node_uuid, CASE WHEN r.direction = 'symmetric' THEN greatest(source_node_uuid, target_node_uuid) ELSE target_node_uuid END AS target_node_uuid
FROM kg_fact f LEFT JOIN kg_frame r ON r.alias = lower(f.relation)"""
_SINGLE = "(cardinality = 'one_current' OR (cardinality IS NULL AND singleton AND source_type = 'user'))"


@query(f"WITH framed AS ({_FRAMED}), {slots_sql(f'SELECT * FROM framed WHERE {_SINGLE}')} SELECT {', '.join(SLOT_COLUMNS)} FROM slots")
def tf_L1_singleton(g):
    return T.close_slots(_framed(g).where(_single())).select(*SLOT_COLUMNS)


def _framed(g):
    rows = g.fact.select("uuid", "seq", "group_id", "valid_at", "relation", "singleton", "source_type", "source_node_uuid", "target_node_uuid")
    rows = T.resolve_frames(rows, g.frame)
    s, o = T.symmetric()
    return rows.withColumns({"source_node_uuid": s, "target_node_uuid": o, "name": F.col("canonical")})


def _single():
    frame = F.col("cardinality") == "one_current"
    return F.coalesce(frame, F.lit(False)) | (F.col("cardinality").isNull() & F.col("singleton") & (F.col("source_type") == "user"))


@query(f"""WITH framed AS ({_FRAMED}), {slots_sql(f'SELECT * FROM framed WHERE {_SINGLE}')}
SELECT uuid, name, source_node_uuid, target_node_uuid, valid_at, invalid_at, status FROM slots
UNION ALL SELECT arg_min(uuid, seq), name, source_node_uuid, target_node_uuid, arg_min(valid_at, seq), NULL, 'active' FROM framed WHERE NOT coalesce({_SINGLE}, false) GROUP BY group_id, name, source_node_uuid, target_node_uuid""")
def tf_add_fact_edge(g):
    """Frame path: resolve, normalise symmetric ends, close singleton slots, merge equal facts elsewhere."""
    rows = _framed(g)
    columns = ("uuid", "name", "source_node_uuid", "target_node_uuid", "valid_at", "invalid_at", "status")
    closed_ = T.close_slots(rows.where(_single())).select(*columns)
    merged = rows.where(~F.coalesce(_single(), F.lit(False))).groupBy("group_id", "name", "source_node_uuid", "target_node_uuid").agg(F.min_by("uuid", "seq").alias("uuid"), F.min_by("valid_at", "seq").alias("valid_at"))
    return closed_.unionByName(merged.select("uuid", "name", "source_node_uuid", "target_node_uuid", "valid_at", F.lit(None).cast("timestamp_ntz").alias("invalid_at"), F.lit("active").alias("status")))


@query(f"""WITH k AS (SELECT *, {KEY_SQL} AS fact_key FROM kg_fact WHERE invalid_at IS NULL), e AS (SELECT fact_key, string_agg(DISTINCT e, ',' ORDER BY e) AS episodes FROM (SELECT fact_key, unnest(episodes) AS e FROM k) GROUP BY 1)
SELECT fact_key, arg_min(uuid, seq) AS uuid, min(valid_at) AS valid_at, count(*) AS n_rows, any_value(e.episodes) AS episodes FROM k JOIN e USING (fact_key) GROUP BY fact_key""")
def tf_dedupe(g):
    key = fact_key(F.col("group_id"), F.col("source_node_uuid"), F.col("name"), F.col("target_node_uuid"))
    return T.dedupe(g.fact.where("invalid_at is null"), key).withColumn("episodes", F.array_join("episodes", ","))


@query("""WITH x AS (SELECT *, first_value(target_node_uuid) OVER (PARTITION BY group_id, source_node_uuid, name ORDER BY seq) AS f FROM kg_fact), y AS (SELECT *, max((target_node_uuid <> f)::INT) OVER (PARTITION BY group_id, source_node_uuid, name) AS seen FROM x)
SELECT uuid, CASE WHEN seen = 1 THEN group_id || '::' || source_node_uuid || '::' || name END AS conflict_group, CASE WHEN target_node_uuid <> f THEN 'needs_resolution' ELSE 'active' END AS resolution FROM y""")
def tf_L4_conflict(g):
    return T.mark_conflicts(g.fact).select("uuid", "conflict_group", "resolution")


@query(f"""WITH c AS (SELECT 'e' || (seq - 1) AS uuid, min(valid_at) AS closed_at, 'e' || min(seq) AS closed_by FROM kg_fact WHERE seq % 4 = 1 GROUP BY 1)
SELECT f.uuid, CASE WHEN h THEN c.closed_at ELSE invalid_at END AS invalid_at, CASE WHEN h THEN TIMESTAMP '{NOW}' ELSE expired_at END AS expired_at, CASE WHEN h THEN 'superseded' ELSE status END AS status, CASE WHEN h THEN closed_by END AS superseded_by
FROM (SELECT f.*, c.closed_at IS NOT NULL AND (f.invalid_at IS NULL OR f.invalid_at > c.closed_at) AS h FROM kg_fact f LEFT JOIN c USING (uuid)) f LEFT JOIN c USING (uuid)""")
def tf_invalidate(g):
    closers = g.fact.where("seq % 4 = 1").select(F.concat(F.lit("e"), F.col("seq") - 1).alias("uuid"), F.col("valid_at").alias("closed_at"), F.col("uuid").alias("closed_by"))
    return T.invalidate(g.fact.select("uuid", "invalid_at", "expired_at", "status"), closers, ntz(NOW)).select("uuid", "invalid_at", "expired_at", "status", "superseded_by")


@query("SELECT uuid, conflict_group_id, status FROM kg_fact WHERE status = 'needs_resolution'")
def tf_get_conflicts(g):
    return g.fact.where("status = 'needs_resolution'").select("uuid", "conflict_group_id", "status")


@query("""WITH e AS (SELECT uuid, source_node_uuid, target_node_uuid FROM kg_fact WHERE list_contains(episodes, 'ep:12')) SELECT 'edge' AS kind, uuid FROM e UNION ALL SELECT DISTINCT 'node', n FROM (SELECT source_node_uuid AS n FROM e UNION SELECT target_node_uuid FROM e UNION SELECT entity_uuid FROM kg_mention WHERE episode_uuid = 'ep:12')""")
def tf_nodes_edges_by_episode(g):
    e = g.fact.where(F.array_contains("episodes", "ep:12")).select("uuid", "source_node_uuid", "target_node_uuid")
    ends = e.select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("uuid"))
    named = g.mention.where("episode_uuid = 'ep:12'").select(F.col("entity_uuid").alias("uuid"))
    return e.select(F.lit("edge").alias("kind"), "uuid").union(ends.union(named).distinct().select(F.lit("node"), "uuid"))


@query("""WITH more(canonical, alias, n) AS (VALUES ('dwells_in', 'resides_in', 100), ('dwells_in', 'dwells_in', 100), ('rents', 'rents', 101)), a AS (SELECT canonical, alias, n FROM kg_frame UNION ALL SELECT * FROM more)
SELECT alias, arg_max(canonical, n) AS canonical FROM a GROUP BY alias""")
def tf_frame_register(g):
    new = (frame_functions.Frame("dwells_in", ("resides_in",), "directed", "state", "many_current", "coexist", 0.7), frame_functions.Frame("rents", (), "directed", "state", "many_current", "coexist", 0.7))
    rows = frame_functions.frame_rows(g.spark).unionByName(frame_functions.frame_rows(g.spark, new, 100))
    return frame_functions.latest_aliases(rows).select("alias", "canonical")


@query("SELECT DISTINCT relation, coalesce(r.canonical, lower(relation)) AS canonical, r.policy FROM kg_fact f LEFT JOIN kg_frame r ON r.alias = lower(f.relation)")
def tf_frame_resolve(g):
    return T.resolve_frames(g.fact.select("relation").distinct(), g.frame).select("relation", "canonical", "policy")


@query("SELECT alias, CASE WHEN canonical = 'friend_of' THEN 'member_of' ELSE canonical END AS canonical FROM kg_frame")
def tf_frame_merge(g):
    return frame_functions.merge_frames(g.frame, "friend_of", "member_of").select("alias", "canonical")


@query("""SELECT DISTINCT e AS episode_uuid, n AS entity_uuid FROM (SELECT unnest(episodes) AS e, source_node_uuid AS n FROM kg_fact UNION ALL SELECT unnest(episodes), target_node_uuid FROM kg_fact)""")
def tf_link_mentions(g):
    return g.fact.select(F.explode("episodes").alias("episode_uuid"), "source_node_uuid", "target_node_uuid").select("episode_uuid", F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("entity_uuid")).distinct()


_LIVE = "status = 'active' AND invalid_at IS NULL"
_CUE = "seq % 100 = 0"  # every hundredth fact says " no longer"


@query(f"""WITH o AS (SELECT * FROM kg_fact WHERE {_LIVE}),
p AS (SELECT n.uuid, o.seq FROM kg_fact n JOIN o ON n.group_id = o.group_id AND o.seq < n.seq AND n.is_belief = o.is_belief AND n.source_node_uuid = o.source_node_uuid
UNION SELECT n.uuid, o.seq FROM kg_fact n JOIN o ON n.group_id = o.group_id AND o.seq < n.seq AND n.is_belief = o.is_belief AND n.target_node_uuid = o.target_node_uuid)
SELECT uuid, count(*) AS n_candidates, min(seq) AS first_candidate FROM p GROUP BY uuid""")
def tf_candidates(g):
    """Every fact as newcomer against all earlier active facts at one of its ends, on its side of the belief gate."""
    return T.endpoint_candidates(g.fact, O.active()).where("n_candidates > 0")


@query(f"""WITH n AS (SELECT * FROM kg_fact WHERE {_CUE}), o AS (SELECT * FROM kg_fact WHERE {_LIVE})
SELECT o.uuid, min(n.seq) AS closed_by_seq FROM n JOIN o ON n.group_id = o.group_id AND o.seq < n.seq AND n.is_belief = o.is_belief AND (n.source_node_uuid = o.source_node_uuid OR n.target_node_uuid = o.target_node_uuid) GROUP BY o.uuid""")
def tf_L3_contradiction(g):
    """The offline judge over all candidate pairs: each active fact is closed by the first later one with a cue at one of its ends."""
    said = g.fact.withColumn("fact", F.concat("fact", F.when(F.expr(_CUE), " no longer").otherwise("")))
    return T.contradicted(said, O.active()).where("closed_by_seq is not null")


@query(r"""WITH p AS (SELECT uuid AS id, content AS new_fact, lag(content) OVER w AS fact, source AS new_subject, lag(source) OVER w AS subject, '' AS new_object, '' AS object FROM kg_text WINDOW w AS (PARTITION BY group_id ORDER BY seq)),
w AS (SELECT *, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(new_fact), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 2)), list_distinct(list_filter(regexp_split_to_array(lower(fact), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 2)))) AS shared, regexp_matches(lower(new_fact), 'not |no longer|moved|changed|stopped|former') AS has_cue FROM p WHERE fact IS NOT NULL)
SELECT id, has_cue AND (lower(new_subject) = lower(subject) OR shared >= 1) AS contradicts FROM w""")
def tf_judge_stub(g):
    """Each text against the one before it in its tenant."""
    from pyspark.sql import Window

    w = Window.partitionBy("group_id").orderBy("seq")
    p = g.text.select(F.col("uuid").alias("id"), F.col("content").alias("new_fact"), F.lag("content").over(w).alias("fact"), F.col("source").alias("new_subject"), F.lag("source").over(w).alias("subject"), F.lit("").alias("new_object"), F.lit("").alias("object"))
    return p.where("fact is not null").select("id", T.judge(p).alias("contradicts"))


@query("SELECT a.uuid, count(*) AS n_peers, min(b.seq) AS first_peer FROM kg_fact a JOIN kg_fact b ON a.group_id = b.group_id AND a.target_node_uuid = b.target_node_uuid AND a.source_node_uuid <> b.source_node_uuid AND b.seq < a.seq AND a.is_belief = b.is_belief GROUP BY a.uuid")
def tf_belief_gate(g):
    """Peers on the same side of the gate: beliefs meet beliefs only."""
    return T.peer_counts(g.fact, "target_node_uuid", "source_node_uuid", ("group_id", "is_belief")).where("n_peers > 0")


@query(f"""WITH v AS (SELECT *, cast(substr(uuid, 5) AS bigint) AS seq FROM kg_vec),
s AS (SELECT n.uuid AS new_uuid, o.uuid, round(list_cosine_similarity(n.fact_embedding, o.fact_embedding), 9) AS score FROM v n JOIN v o ON n.group_id = o.group_id AND n.source_node_uuid = o.source_node_uuid AND o.seq < n.seq WHERE o.status = 'active' AND o.invalid_at IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY new_uuid ORDER BY score DESC, uuid) AS k FROM s WHERE score >= 0.1) SELECT new_uuid, uuid, round(score, 6) AS score FROM r WHERE k <= 5""")
def tf_L0_replaces(g):
    """Each fact's descriptor against the earlier active facts of its subject: the five nearest are replaced."""
    from kairograph.operators.resolve import replaced

    rows = g.vec.withColumn("seq", F.substring("uuid", 5, 20).cast("long"))
    hits = replaced(rows.select("uuid", "seq", "group_id", "source_node_uuid", "fact_embedding"), rows.where(O.active()), 0.1)
    return hits.select("new_uuid", "uuid", F.round("score", 6).alias("score"))


@query("""SELECT 'user:' || c_custkey AS uuid, 'User' AS label, c_name AS display_name FROM customer""")
def tf_upsert_user(g):
    from kairograph.operators.mutate import upsert

    users = g.raw("customer").selectExpr("'user:' || c_custkey as uuid", "'User' as label", "c_name as display_name")
    old = users.withColumn("display_name", F.lit("old name")).where("uuid < 'user:15'")
    return upsert(old, users)


@query("""WITH n(source_node_uuid, name, target) AS (VALUES ('user:1', 'is_named', 'Ann'), ('user:2', 'likes', 'Tea'), ('user:3', 'is_named', 'Cy')) SELECT e.uuid, coalesce(n.target, e.name) AS display_name FROM kg_entity e LEFT JOIN n ON n.source_node_uuid = e.uuid AND n.name = 'is_named'""")
def tf_bootstrap_name(g):
    named = g.spark.createDataFrame([("user:1", "is_named", "Ann"), ("user:2", "likes", "Tea"), ("user:3", "is_named", "Cy")], "uuid string, predicate string, target string").where("predicate = 'is_named'")
    return g.entity.select("uuid", "name").join(F.broadcast(named), "uuid", "left").select("uuid", F.coalesce("target", "name").alias("display_name"))
