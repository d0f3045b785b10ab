"""Cognition passes and the read API's summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kairograph.functions.keys import fact_key
from kairograph.functions.text import GOALS
from kairograph.operators import cognition as C
from kairograph.operators.filters import active, ntz
from kairograph.sources.testgraph import NOW

from .registry import PLANS, SQL, query
from .scalars import EFFECTIVE_SQL, GOAL_CLEAN, VITALITY_SQL, affect_sql, texts

LIVE = "status = 'active' AND invalid_at IS NULL"
KEY_SQL = "group_id || '::' || source_node_uuid || '::' || lower(name) || '::' || target_node_uuid"
_KLASS = "CASE WHEN lower(trim(coalesce(memory_class, ''))) = '' THEN 'objective' ELSE lower(trim(memory_class)) END"


_SAID = "SELECT uuid, content FROM kg_source_episode"
_BELIEF = r"(?i)\b(?:I think|I believe|I feel(?: like)?|feels like|seems(?: like)?|might be|I suspect|in my opinion|I guess|probably)\b"


def _moods(g):
    rows = C.affect(g.source_episode.select("uuid", "content"))
    return rows.select(F.col("uuid").alias("episode"), "polarity", "intensity").join(g.source_episode.select(F.col("uuid").alias("episode"), "reference_time"), "episode")


@query(f"""WITH {affect_sql(_SAID)}, m AS (SELECT id AS episode, round(pw / w, 3) AS polarity, round(least(1.0, w / 2), 3) AS intensity FROM best WHERE k = 1),
r AS (SELECT f.uuid, m.*, s.reference_time FROM (SELECT uuid, unnest(episodes) AS episode FROM kg_fact) f JOIN m USING (episode) JOIN kg_source_episode s ON s.uuid = m.episode)
SELECT uuid, arg_max(polarity, (reference_time, episode)) AS valence, max(intensity) AS intensity FROM r GROUP BY uuid""")
def cg_affect(g):
    return C.tag_affect(g.fact.select("uuid", "episodes"), _moods(g))


@query(rf"""WITH b AS (SELECT uuid AS e FROM kg_source_episode WHERE regexp_matches(content, '{_BELIEF}')),
c AS (SELECT uuid, source_node_uuid, unnest(episodes) AS e FROM kg_fact WHERE {LIVE} AND NOT is_belief) SELECT DISTINCT c.uuid, c.source_node_uuid AS belief_holder, 'belief' AS memory_class FROM c JOIN b USING (e) JOIN kg_mention m ON m.episode_uuid = c.e AND m.entity_uuid = c.source_node_uuid""")
def cg_beliefs(g):
    return C.beliefs(g.fact, g.source_episode.select("uuid", "content"), g.mention)


@query("""WITH s AS (SELECT f.uuid, stability, count(DISTINCT s.uuid) AS n, (epoch_us(max(s.reference_time)) - epoch_us(min(s.reference_time))) / 86400000000.0 AS span FROM (SELECT uuid, stability, unnest(episodes) AS e FROM kg_fact) f JOIN kg_source_episode s ON s.uuid = f.e GROUP BY 1, 2)
SELECT uuid, n AS n_episodes, round(span, 6) AS span_days, CASE WHEN stability = 'consolidated' THEN 'consolidated' WHEN n >= 7 AND span >= 7 THEN 'persistent' WHEN n >= 3 AND stability = 'episodic' THEN 'reinforced' ELSE stability END AS new_stability FROM s""")
def cg_reinforce(g):
    return C.reinforcement(g.fact, g.source_episode).select("uuid", "n_episodes", "span_days", "new_stability")


@query(f"""SELECT uuid, recall_count + (seq % 4 = 0)::INT AS recall_count, round(CASE WHEN seq % 4 = 0 THEN least(1.0, ({EFFECTIVE_SQL}) + 0.04) ELSE decay_score END, 6)::DOUBLE AS decay_score FROM kg_fact""")
def cg_recall_reinforce(g):
    hits = g.fact.where("seq % 4 = 0").select("uuid")
    out = C.recall_reinforce(g.fact.drop("episodes", "attributes"), hits, ntz(NOW))
    return out.select("uuid", "recall_count", F.round(F.col("decay_score").cast("double"), 6).alias("decay_score"))


@query(f"""WITH a AS (SELECT * FROM kg_fact WHERE {LIVE}), d AS (SELECT n, count(*) AS d FROM (SELECT source_node_uuid AS n FROM a UNION ALL SELECT target_node_uuid FROM a) GROUP BY n), e AS (SELECT e, count(*) AS f FROM (SELECT unnest(episodes) AS e FROM a) GROUP BY e),
x AS (SELECT uuid, sum(f - 1) AS shared FROM (SELECT uuid, unnest(episodes) AS e FROM a) JOIN e USING (e) GROUP BY uuid), t AS (SELECT a.*, (ds.d - 1) + (dt.d - 1) + coalesce(shared, 0) AS touched FROM a JOIN d ds ON ds.n = a.source_node_uuid JOIN d dt ON dt.n = a.target_node_uuid LEFT JOIN x USING (uuid))
SELECT uuid, touched::BIGINT AS touched, round(least(4.0, greatest(0.0, ({EFFECTIVE_SQL}) * (1 + least(1.0, touched / 12.0)))), 6)::DOUBLE AS weight FROM t""")
def cg_weights(g):
    return C.weights(g.fact, ntz(NOW))


_TRAITS = f"""rows_ AS (SELECT * FROM kg_fact WHERE {LIVE} AND NOT singleton AND NOT is_belief AND name NOT IN ('error')),
both_ AS (SELECT source_node_uuid, name, target_node_uuid, sum(reinforcement_count) AS strength, count(*) AS n_edges FROM rows_ GROUP BY 1, 2, 3 HAVING sum(reinforcement_count) >= 2 UNION ALL SELECT source_node_uuid, name, NULL, sum(reinforcement_count), count(*) FROM rows_ GROUP BY 1, 2 HAVING count(*) >= 3),
ranked_ AS (SELECT *, row_number() OVER (PARTITION BY source_node_uuid ORDER BY strength DESC, name, target_node_uuid NULLS FIRST)::INTEGER AS rank FROM both_)"""


@query(f"""WITH {_TRAITS} SELECT source_node_uuid, rank, lower(trim(regexp_replace(name || coalesce('_' || target_node_uuid, ''), '[^0-9A-Za-z]+', '_', 'g'), '_')) AS trait, round(least(0.95, 0.4 + 0.05 * strength), 6)::DOUBLE AS confidence FROM ranked_ WHERE rank <= 3""")
def cg_traits(g):
    return C.traits(C.trait_candidates(g.fact, ("error",)))


_PHRASES = " || ".join("regexp_extract_all(content, '{}', 1)".format(p.replace("'", "''")) for p in GOALS)


_GOAL_CTES = rf"""f AS (SELECT uuid AS id, group_id, {_PHRASES} AS p FROM kg_text),
c AS (SELECT id, group_id, list_filter(list_transform(p, lambda x: trim(regexp_replace(trim(x), '\s+', ' ', 'g'), ' ,.;:')), lambda x: length(x) BETWEEN 8 AND 200) AS p FROM f),
n AS (SELECT id, group_id, list_transform(p, lambda x: coalesce(nullif(lower(trim(regexp_replace(x, '[^0-9A-Za-z]+', '_', 'g'), '_')), ''), 'unknown')) AS n FROM c), goals_ AS (SELECT id, group_id, n[1] AS goal FROM (SELECT id, group_id, list_filter(n, lambda x: {GOAL_CLEAN}) AS n FROM n) WHERE len(n) > 0)"""


@query(f"WITH {_GOAL_CTES} SELECT id, goal, 0.55::DOUBLE AS confidence FROM goals_")
def cg_goals(g):
    return C.goals(texts(g), "id")


_LABEL = r"""CASE WHEN content = '' THEN 'one_off_query' WHEN regexp_matches(content, '(?i)\b(?:best|optimal|optimi[sz]e|improve|better|tune|refine|tweak|sharper|tighter)\b') THEN 'optimization_request' WHEN qs = 0 AND n >= 60 THEN 'narrative_share'
 WHEN coalesce(prior, '') <> '' AND overlap >= 3 AND qs >= 1 THEN 'iterative_refinement' WHEN coalesce(prior, '') <> '' AND overlap >= 2 AND n < 40 THEN 'clarification' ELSE 'one_off_query' END"""


def _modes(source: str) -> str:
    """CTEs up to ``modes``: the label that holds most of the last eight texts of every tenant, at least five."""
    return rf"""mw AS (SELECT uuid, group_id, content, reference_time, lag(content) OVER (PARTITION BY group_id ORDER BY reference_time, uuid) AS prior, row_number() OVER (PARTITION BY group_id ORDER BY reference_time DESC, uuid DESC) AS r FROM {source}),
mc AS (SELECT *, len(regexp_extract_all(content, '\?')) AS qs, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS n,
 len(list_intersect(list_distinct(list_filter(list_transform(regexp_extract_all(content, '[a-zA-Z'']+'), lambda x: lower(x)), lambda x: length(x) > 3)), list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(prior, ''), '[a-zA-Z'']+'), lambda x: lower(x)), lambda x: length(x) > 3)))) AS overlap FROM mw WHERE r <= 8),
ml AS (SELECT group_id, {_LABEL} AS label FROM mc), mk AS (SELECT group_id, label, count(*) AS n FROM ml GROUP BY 1, 2), mb AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS p FROM mk),
modes AS (SELECT group_id, label, n FROM mb WHERE p = 1 AND n >= 5)"""


@query(f"WITH {_modes('kg_episode')} SELECT group_id, label, n, round(least(1.0, 0.5 + 0.06 * n), 6)::DOUBLE AS confidence FROM modes WHERE label <> 'one_off_query'")
def cg_procedural(g):
    out = C.interaction_mode(C.interaction_labels(g.episode)).where("label <> 'one_off_query'")
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.5 + 0.06 * F.col("n")), 6))


@query(f"""WITH k AS (SELECT *, {KEY_SQL} AS fact_key FROM kg_fact WHERE {LIVE}), s AS (SELECT fact_key, count(DISTINCT s.uuid) AS n_episodes, (epoch_us(max(reference_time)) - epoch_us(min(reference_time))) / 86400000000.0 AS span FROM (SELECT fact_key, unnest(episodes) AS e FROM k) x JOIN kg_source_episode s ON s.uuid = x.e GROUP BY 1)
SELECT fact_key, arg_max(uuid, (confidence, uuid)) AS best, any_value(n_episodes) AS n_episodes, round(any_value(span), 6) AS span_days, count(DISTINCT uuid) AS n_members, round(least(1.0, avg(confidence) + 0.1), 6) AS confidence FROM k JOIN s USING (fact_key) WHERE n_episodes >= 8 AND span >= 0.1 GROUP BY fact_key""")
def cg_consolidate(g):
    key = fact_key(F.col("group_id"), F.col("source_node_uuid"), F.col("name"), F.col("target_node_uuid"))
    return C.consolidation(g.fact, g.source_episode, key, 8, 0.1)


@query(f"""WITH z AS (SELECT source_node_uuid AS subject, {_KLASS} AS klass, coalesce(nullif(domain, ''), nullif(canonical_name, ''), name) AS topic, uuid, fact FROM kg_fact WHERE {LIVE} AND ({VITALITY_SQL}) <= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, klass, topic ORDER BY uuid) AS k, count(*) OVER (PARTITION BY subject, klass, topic) AS n FROM z)
SELECT subject, klass, topic, n, string_agg(fact, '; ' ORDER BY k) FILTER (k <= 5) || CASE WHEN n > 5 THEN '; and ' || (n - 5) || ' related' ELSE '' END AS summary, 0.5::DOUBLE AS confidence FROM r WHERE n >= 5 GROUP BY subject, klass, topic, n""")
def cg_stagnant(g):
    return C.stagnant(g.fact, ntz(NOW))


@query("""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents), c AS (SELECT source, term, count(*) AS n FROM w WHERE term NOT IN ('have','with','this','that','from','user','also','into','their','there','about','they','your','more','much','some','what','when','would','could','should','really','actually') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS k FROM c) SELECT source, max(CASE WHEN k = 1 THEN term END) AS domain, string_agg(term, ',' ORDER BY k) AS terms FROM r WHERE k <= 8 GROUP BY source""")
def cg_domains(g):
    top = C.top_terms(g.raw("documents"), ["source"], "text", 8)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy("source").agg(F.transform(ordered, lambda x: x["term"]).alias("t")).select("source", F.col("t")[0].alias("domain"), F.array_join("t", ",").alias("terms"))


@query(f"""WITH {_GOAL_CTES}, {_modes('kg_text')}, dc AS (SELECT group_id, domain, count(*) AS n FROM kg_entity WHERE domain IS NOT NULL GROUP BY 1, 2), dr AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, domain) AS k FROM dc),
gs AS (SELECT group_id, array_to_string(list_sort(list_distinct(list(goal)))[1:10], ',') AS goals FROM goals_ GROUP BY 1), d AS (SELECT group_id, string_agg(domain, ',' ORDER BY k) AS domains FROM dr WHERE k <= 5 GROUP BY 1)
SELECT group_id, concat_ws(' | ', 'goals: ' || goals, 'domains: ' || domains, 'mode: ' || label) AS prediction FROM d FULL JOIN gs USING (group_id) FULL JOIN modes USING (group_id)""")
def cg_prediction(g):
    """Goals and interaction modes of the texts, domains of the entities."""
    said = texts(g)
    goals = C.goals(said, "id").join(said.select("id", "group_id"), "id").select("group_id", "goal")
    return C.prediction(goals, g.entity.where("domain is not null").select("group_id", "domain"), C.interaction_labels(said.withColumnRenamed("id", "uuid")))


_SLUG = "left(CASE WHEN {0} = '' THEN 'self_model' ELSE {0} END, 80)"


@query(f"""WITH j AS (SELECT group_id, json_extract_string(content, '$.type') AS type, json_extract_string(content, '$.name') AS name, json_extract_string(content, '$.confidence')::DOUBLE AS confidence FROM kg_self WHERE starts_with(content, '{{')),
s AS (SELECT *, trim(regexp_replace(replace(lower(name), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_') AS v FROM j WHERE type <> 'belief' OR confidence >= 0.5), k AS (SELECT group_id, type, {_SLUG.format('v')} AS slug, max(confidence) AS confidence, count(*) AS n_sources FROM s GROUP BY 1, 2, 3),
u AS (SELECT *, trim(regexp_replace(replace(lower(slug), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_') AS w FROM k)
SELECT group_id, type, 'self_' || {_SLUG.format('w')} || '_' || substr(sha1(group_id || chr(0) || slug), 1, 12) AS uuid, confidence, n_sources FROM u""")
def cg_self_awareness(g):
    """Structured self-episodes become traits, beliefs (confidence of 0.5 at least) and patterns with stable ids."""
    return C.self_model(g.table("kg_self"))


@query("""SELECT uuid, CASE WHEN starts_with(content, '{') THEN json_extract_string(content, '$.type') || ': ' || json_extract_string(content, '$.name') || ' (' || json_extract_string(content, '$.confidence') || ')' ELSE content END AS text FROM kg_self""")
def cg_render_self(g):
    rows = g.table("kg_self").select("uuid", "content", F.from_json("content", "type string, name string, confidence string").alias("j"))
    shown = F.concat("j.type", F.lit(": "), "j.name", F.lit(" ("), "j.confidence", F.lit(")"))
    return rows.select("uuid", F.coalesce(shown, "content").alias("text"))


@query(f"""WITH n AS (SELECT group_id, source_node_uuid, 'has_trait' AS name, max(confidence) AS confidence FROM kg_fact WHERE {LIVE} AND reinforcement_count >= 9 GROUP BY 1, 2)
SELECT group_id || '::' || source_node_uuid || '::has_trait::' || source_node_uuid || ':trait' AS fact_key, confidence FROM n""")
def cg_synth_upsert(g):
    rows = g.fact.where(active() & (F.col("reinforcement_count") >= 9)).groupBy("group_id", "source_node_uuid").agg(F.max("confidence").alias("confidence"))
    key = fact_key(F.col("group_id"), F.col("source_node_uuid"), F.lit("has_trait"), F.concat("source_node_uuid", F.lit(":trait")))
    return rows.select(key.alias("fact_key"), "confidence")


_STEPS = ("affect", "beliefs", "reinforce", "weights", "traits", "goals", "procedural", "consolidate", "stagnant", "domains", "prediction", "self_awareness")
_PENDING = "SELECT uuid FROM kg_episode WHERE cognition_processed_at IS NULL"


@query(" UNION ALL ".join(f"SELECT {k} AS step, '{n}' AS name, (SELECT count(*) FROM ({SQL['cg_' + n]})) AS n, NULL::VARCHAR AS error" for k, n in enumerate(_STEPS)) + f" UNION ALL SELECT {len(_STEPS)}, 'processed', (SELECT count(*) FROM ({_PENDING})), NULL")
def cg_run_pass(g):
    """One pass over all tenants: every step's rows written, each failure isolated, the episodes it read marked."""
    from kairograph.operators.graph import _shared_dir

    steps = {n: (lambda n=n: PLANS[f"cg_{n}"](g)) for n in _STEPS}
    steps["processed"] = lambda: g.episode.where("cognition_processed_at is null").select("uuid", ntz(NOW).alias("cognition_processed_at"))
    return C.run_pass(g.spark, steps, f"{_shared_dir(g.spark)}/pass-{uuid.uuid4().hex}")


# -- read API ---------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT source_node_uuid AS s, target_node_uuid AS t FROM kg_fact WHERE group_id = 'u6' AND invalid_at IS NULL AND expired_at IS NULL), d AS (SELECT n, count(*) AS degree FROM (SELECT s AS n FROM e UNION ALL SELECT t FROM e) GROUP BY n)
SELECT k.uuid, k.name, degree FROM d JOIN kg_entity k ON k.uuid = d.n""")
def api_graph(g):
    from kairograph.operators.filters import GraphView
    from kairograph.operators.graph import degree

    edges = g.fact.where(GraphView(group_id="u6").column())
    return degree(edges).join(g.entity.select(F.col("uuid").alias("node"), "uuid", "name"), "node").select("uuid", "name", "degree")


@query("""SELECT f.uuid, f.name AS predicate, s.name AS subject, o.name AS object, f.valid_at, f.invalid_at FROM kg_fact f LEFT JOIN kg_entity s ON s.uuid = f.source_node_uuid LEFT JOIN kg_entity o ON o.uuid = f.target_node_uuid WHERE f.source_node_uuid = 'user:8'""")
def api_entity_timeline(g):
    s = g.entity.select(F.col("uuid").alias("source_node_uuid"), F.col("name").alias("subject"))
    o = g.entity.select(F.col("uuid").alias("target_node_uuid"), F.col("name").alias("object"))
    rows = g.fact.where("source_node_uuid = 'user:8'").select("uuid", F.col("name").alias("predicate"), "source_node_uuid", "target_node_uuid", "valid_at", "invalid_at")
    return rows.join(s, "source_node_uuid", "left").join(o, "target_node_uuid", "left").select("uuid", "predicate", "subject", "object", "valid_at", "invalid_at")


@query("""SELECT s.uuid, s.content, s.reference_time, count(DISTINCT f.uuid) AS n_edges FROM kg_source_episode s LEFT JOIN (SELECT uuid, unnest(episodes) AS e FROM kg_fact) f ON f.e = s.uuid WHERE s.uuid = 'ep:7' GROUP BY ALL""")
def api_episode(g):
    cited = g.fact.where(F.array_contains("episodes", "ep:7")).select(F.lit("ep:7").alias("uuid"), F.col("uuid").alias("edge"))
    return g.source_episode.where("uuid = 'ep:7'").join(cited, "uuid", "left").groupBy("uuid", "content", "reference_time").agg(F.countDistinct("edge").alias("n_edges"))


@query(f"""SELECT e.uuid, e.name, count(f.uuid) AS n_facts, string_agg(f.fact, ' / ' ORDER BY f.valid_at DESC, f.uuid) AS facts FROM kg_entity e JOIN (SELECT * FROM kg_fact WHERE {LIVE} AND confidence >= 0.9) f ON f.source_node_uuid = e.uuid GROUP BY 1, 2""")
def api_memory(g):
    rows = g.fact.where(active() & (F.col("confidence") >= 0.9)).select("source_node_uuid", "uuid", "fact", "valid_at")
    order = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("valid_at").cast("timestamp"))).alias("t"), "uuid", "fact")))
    facts = rows.groupBy(F.col("source_node_uuid").alias("uuid")).agg(F.count("*").alias("n_facts"), F.array_join(F.transform(order, lambda x: x["fact"]), " / ").alias("facts"))
    return g.entity.select("uuid", "name").join(facts, "uuid")


@query("""SELECT view, count(*) AS n FROM (SELECT unnest(CASE WHEN invalid_at IS NULL AND expired_at IS NULL AND coalesce(status, '') IN ('', 'active') THEN ['truth'] ELSE [] END || CASE WHEN coalesce(conflict_group_id, '') <> '' AND status = 'needs_resolution' THEN ['conflicts'] ELSE [] END || ['raw', 'provenance'] || CASE WHEN invalid_at IS NULL AND expired_at IS NULL THEN ['timeline'] ELSE [] END) AS view FROM kg_fact) GROUP BY view""")
def api_view_lenses(g):
    from kairograph.operators.filters import GraphView

    lens = {
        "truth": GraphView(visibility="active"),
        "conflicts": GraphView(include_invalid=True, visibility="conflicts", status=["needs_resolution"]),
        "raw": GraphView(include_invalid=True),
        "provenance": GraphView(include_invalid=True),
        "timeline": GraphView(),
    }
    tags = F.array_compact(F.array(*[F.when(v.column(), F.lit(k)) for k, v in lens.items()]))
    return g.fact.select(F.explode(tags).alias("view")).groupBy("view").agg(F.count("*").alias("n"))
