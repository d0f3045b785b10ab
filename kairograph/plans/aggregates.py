"""Aggregations, set operations, sorted lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kairograph.functions.decay import memory_class
from kairograph.functions.keys import fact_key
from kairograph.operators import cognition, graph
from kairograph.operators.filters import active

from .registry import query

KEY = lambda: fact_key(F.col("group_id"), F.col("source_node_uuid"), F.col("name"), F.col("target_node_uuid"))
KEY_SQL = "group_id || '::' || source_node_uuid || '::' || lower(name) || '::' || target_node_uuid"
LIVE_SQL = "status = 'active' AND invalid_at IS NULL"


@query("SELECT group_id, count(*) AS n FROM kg_entity GROUP BY group_id")
def agg_group_counts(g):
    return g.entity.groupBy("group_id").agg(F.count("*").alias("n"))


@query("SELECT group_id, min(valid_at) AS first_at, greatest(max(valid_at), max(invalid_at), max(created_at)) AS last_at FROM kg_fact GROUP BY group_id")
def agg_timeline_bounds(g):
    return g.fact.groupBy("group_id").agg(F.min("valid_at").alias("first_at"), F.greatest(F.max("valid_at"), F.max("invalid_at"), F.max("created_at")).alias("last_at"))


@query("""SELECT f.group_id, n_beliefs, n_consolidated, n_reinforced, n_conflicts, n_affect, n_derived, n_traits, n_goals FROM
(SELECT group_id, count_if(is_belief) AS n_beliefs, count_if(stability = 'consolidated') AS n_consolidated, count_if(reinforcement_count >= 3) AS n_reinforced, count_if(status = 'needs_resolution') AS n_conflicts, count_if(intensity > 0.5) AS n_affect, count_if(derived) AS n_derived FROM kg_fact GROUP BY 1) f
JOIN (SELECT group_id, count_if(list_contains(labels, 'trait')) AS n_traits, count_if(list_contains(labels, 'goal')) AS n_goals FROM kg_entity GROUP BY 1) e USING (group_id)""")
def agg_cognition_summary(g):
    counts = {"n_beliefs": F.col("is_belief"), "n_consolidated": F.col("stability") == "consolidated", "n_reinforced": F.col("reinforcement_count") >= 3, "n_conflicts": F.col("status") == "needs_resolution", "n_affect": F.col("intensity") > 0.5, "n_derived": F.col("derived")}
    facts = g.fact.groupBy("group_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    nodes = g.entity.groupBy("group_id").agg(F.count_if(F.array_contains("labels", "trait")).alias("n_traits"), F.count_if(F.array_contains("labels", "goal")).alias("n_goals"))
    return facts.join(nodes, "group_id")


@query("SELECT episode_uuid, entity_uuid, count(*) AS n, string_agg(uuid, ',' ORDER BY uuid) AS uuids FROM kg_mention GROUP BY 1, 2")
def agg_mentions_bucket(g):
    return g.mention.groupBy("episode_uuid", "entity_uuid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("uuid")), ",").alias("uuids"))


@query("SELECT node, count(*) AS degree FROM (SELECT source_node_uuid AS node FROM kg_fact UNION ALL SELECT target_node_uuid FROM kg_fact) GROUP BY node")
def agg_degree(g):
    return graph.degree(g.fact)


@query("""SELECT conflict_group_id, count(*) AS n, min(valid_at) AS first_at, string_agg(DISTINCT target_node_uuid, ',' ORDER BY target_node_uuid) AS objects FROM kg_fact WHERE coalesce(conflict_group_id, '') <> '' GROUP BY 1 HAVING bool_or(status = 'needs_resolution')""")
def agg_conflict_groups(g):
    rows = g.fact.where(F.coalesce("conflict_group_id", F.lit("")) != "")
    out = rows.groupBy("conflict_group_id").agg(F.count("*").alias("n"), F.min("valid_at").alias("first_at"), F.array_join(F.array_sort(F.collect_set("target_node_uuid")), ",").alias("objects"), F.bool_or(F.col("status") == "needs_resolution").alias("open"))
    return out.where("open").drop("open")


@query("""WITH used AS (SELECT DISTINCT lower(coalesce(canonical_name, name)) AS canonical FROM kg_fact), seed AS (SELECT DISTINCT canonical FROM kg_frame WHERE alias = canonical)
SELECT canonical, true AS seeded FROM seed UNION ALL SELECT canonical, false FROM used WHERE canonical NOT IN (SELECT canonical FROM seed)""")
def agg_frame_catalog(g):
    seed = g.frame.where("alias = canonical").select("canonical").distinct()
    used = g.fact.select(F.lower(F.coalesce("canonical_name", "name")).alias("canonical")).distinct().join(seed, "canonical", "left_anti")
    return seed.withColumn("seeded", F.lit(True)).union(used.withColumn("seeded", F.lit(False)))


@query("""SELECT name, count(*) AS n, count_if(status = 'active') AS n_active, count_if(status = 'superseded') AS n_superseded, count_if(coalesce(conflict_group_id, '') <> '') AS n_conflicts, count_if(canonical_name IS NULL) AS n_unknown FROM kg_fact GROUP BY name""")
def agg_frame_health(g):
    return g.fact.groupBy("name").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "active").alias("n_active"),
        F.count_if(F.col("status") == "superseded").alias("n_superseded"),
        F.count_if(F.coalesce("conflict_group_id", F.lit("")) != "").alias("n_conflicts"),
        F.count_if(F.col("canonical_name").isNull()).alias("n_unknown"),
    )


@query("""WITH ends AS (SELECT source_node_uuid AS node, status, conflict_group_id FROM kg_fact UNION ALL SELECT target_node_uuid, status, conflict_group_id FROM kg_fact),
q AS (SELECT node, count_if(coalesce(conflict_group_id, '') <> '') AS n_conflicts, bool_and(status <> 'active') AS historical FROM ends GROUP BY node), m AS (SELECT entity_uuid AS node, count(*) AS n_mentions FROM kg_mention GROUP BY 1)
SELECT q.node, n_conflicts, coalesce(n_mentions, 0) AS n_mentions, historical, CASE WHEN n_conflicts > 0 THEN '!' WHEN historical THEN 'H' WHEN coalesce(n_mentions, 0) >= 5 THEN cast(n_mentions AS VARCHAR) ELSE '?' END AS badge FROM q LEFT JOIN m USING (node)""")
def agg_node_quality(g):
    ends = g.fact.select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("node"), "status", "conflict_group_id")
    q = ends.groupBy("node").agg(F.count_if(F.coalesce("conflict_group_id", F.lit("")) != "").alias("n_conflicts"), F.bool_and(F.col("status") != "active").alias("historical"))
    m = g.mention.groupBy(F.col("entity_uuid").alias("node")).agg(F.count("*").alias("n_mentions"))
    out = q.join(m, "node", "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))
    badge = F.when(F.col("n_conflicts") > 0, "!").when(F.col("historical"), "H").when(F.col("n_mentions") >= 5, F.col("n_mentions").cast("string")).otherwise("?")
    return out.select("node", "n_conflicts", "n_mentions", "historical", badge.alias("badge"))


@query("SELECT least(source_node_uuid, target_node_uuid) AS a, greatest(source_node_uuid, target_node_uuid) AS b, count(*) AS n FROM kg_fact GROUP BY 1, 2")
def agg_pair_multiplicity(g):
    a, b = graph.unordered(F.col("source_node_uuid"), F.col("target_node_uuid"))
    return g.fact.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT group_id, entity_uuid, count(*) AS n FROM kg_mention GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, entity_uuid) AS k FROM c) SELECT group_id, entity_uuid, n FROM r WHERE k = 1""")
def agg_top_mentioned(g):
    counts = g.mention.groupBy("group_id", "entity_uuid").agg(F.count("*").alias("n"))
    best = counts.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "entity_uuid", "n")).alias("b"))
    return best.select("group_id", "b.entity_uuid", "b.n")


@query(f"""WITH a AS (SELECT * FROM kg_fact WHERE {LIVE_SQL}) SELECT 'node' AS kind, node AS key, count(*) AS n FROM (SELECT source_node_uuid AS node FROM a UNION ALL SELECT target_node_uuid FROM a) GROUP BY 2 UNION ALL SELECT 'episode', e, count(*) FROM (SELECT unnest(episodes) AS e FROM a) GROUP BY 2""")
def agg_entity_episode_freq(g):
    live = g.fact.where(active())
    keys = F.concat(F.transform(F.array("source_node_uuid", "target_node_uuid"), lambda x: F.struct(F.lit("node").alias("kind"), x.alias("key"))), F.transform("episodes", lambda x: F.struct(F.lit("episode").alias("kind"), x.alias("key"))))
    return live.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"))


@query("""SELECT f.uuid, count(DISTINCT s.uuid) AS n_episodes, min(s.reference_time) AS first_at, max(s.reference_time) AS last_at, round((epoch_us(max(s.reference_time)) - epoch_us(min(s.reference_time))) / 86400000000.0, 6) AS span_days
FROM (SELECT uuid, unnest(episodes) AS e FROM kg_fact) f JOIN kg_source_episode s ON s.uuid = f.e GROUP BY f.uuid""")
def agg_reinforcement(g):
    return cognition.reinforcement(g.fact, g.source_episode).drop("new_stability")


@query(f"""WITH k AS (SELECT *, {KEY_SQL} AS fact_key FROM kg_fact WHERE {LIVE_SQL}), e AS (SELECT fact_key, unnest(episodes) AS e FROM k),
s AS (SELECT fact_key, count(DISTINCT s.uuid) AS n_episodes, (epoch_us(max(reference_time)) - epoch_us(min(reference_time))) / 86400000000.0 AS span FROM e JOIN kg_source_episode s ON s.uuid = e.e GROUP BY 1),
r AS (SELECT fact_key, avg(confidence) AS mean, arg_max(uuid, (confidence, uuid)) AS best, count(DISTINCT uuid) AS n_members FROM k GROUP BY 1)
SELECT fact_key, best, n_episodes, round(span, 6) AS span_days, n_members, round(least(1.0, mean + 0.1), 6) AS confidence FROM r JOIN s USING (fact_key) WHERE n_episodes >= 2 AND span >= 1""")
def agg_fact_key_rollup(g):
    return cognition.consolidation(g.fact, g.source_episode, KEY(), 2, 1)


@query(f"""SELECT source_node_uuid AS subject, CASE WHEN lower(trim(coalesce(memory_class, ''))) = '' THEN 'objective' ELSE lower(trim(memory_class)) END AS klass, coalesce(nullif(domain, ''), nullif(canonical_name, ''), name) AS topic, count(*) AS n, round(sum(value), 4) AS total FROM kg_fact WHERE {LIVE_SQL} GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def agg_stagnant_rollup(g):
    topic = F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.nullif(F.col("canonical_name"), F.lit("")), F.col("name"))
    rows = g.fact.where(active()).groupBy(F.col("source_node_uuid").alias("subject"), memory_class(F.col("memory_class")).alias("klass"), topic.alias("topic"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).where("n >= 5")


_TRAIT_ROWS = f"SELECT * FROM kg_fact WHERE {LIVE_SQL} AND NOT singleton AND NOT is_belief AND name <> 'error'"


@query(f"SELECT source_node_uuid, name, target_node_uuid, sum(reinforcement_count)::BIGINT AS strength, count(*) AS n_edges FROM ({_TRAIT_ROWS}) GROUP BY 1, 2, 3 HAVING sum(reinforcement_count) >= 2")
def agg_trait_pair(g):
    rows = g.fact.where(active() & ~F.col("singleton") & ~F.col("is_belief") & (F.col("name") != "error"))
    return rows.groupBy("source_node_uuid", "name", "target_node_uuid").agg(F.sum("reinforcement_count").alias("strength"), F.count("*").alias("n_edges")).where("strength >= 2")


@query(f"SELECT source_node_uuid, name, sum(reinforcement_count)::BIGINT AS strength, count(*) AS n_edges FROM ({_TRAIT_ROWS}) GROUP BY 1, 2 HAVING count(*) >= 3")
def agg_trait_pred(g):
    rows = g.fact.where(active() & ~F.col("singleton") & ~F.col("is_belief") & (F.col("name") != "error"))
    return rows.groupBy("source_node_uuid", "name").agg(F.sum("reinforcement_count").alias("strength"), F.count("*").alias("n_edges")).where("n_edges >= 3")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_node_uuid ORDER BY seq DESC) AS k FROM kg_fact), c AS (SELECT source_node_uuid, name, count(*) AS n FROM r WHERE k <= 8 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY source_node_uuid ORDER BY n DESC, name) AS p FROM c) SELECT source_node_uuid AS group_id, name AS label, n FROM b WHERE p = 1 AND n >= 3""")
def agg_interaction_mode(g):
    newest = F.row_number().over(Window.partitionBy("source_node_uuid").orderBy(F.desc("seq")))
    labels = g.fact.withColumn("k", newest).where("k <= 8").select(F.col("source_node_uuid").alias("group_id"), F.col("name").alias("label"))
    counts = labels.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "label", "n")).alias("b"))
    return best.select("group_id", "b.label", "b.n").where("n >= 3")


@query("SELECT domain, count(*) AS n FROM kg_entity WHERE domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 5")
def agg_domain_top5(g):
    return g.entity.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(5)


_STOP = "('have','with','this','that','from','user','also','into','their','there','about','they','your','more','much','some','what','when','would','could','should','really','actually')"


@query(f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w WHERE term NOT IN {_STOP} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c) SELECT lang, term, n, rank::INTEGER AS rank FROM r WHERE rank <= 8""")
def agg_top_terms(g):
    return cognition.top_terms(g.raw("documents"), ["lang"], "text", 8).select("lang", "term", "n", "rank")


@query("""SELECT source_node_uuid, string_agg(DISTINCT coalesce(canonical_name, lower(name)), ',' ORDER BY coalesce(canonical_name, lower(name))) AS predicates, count(*) AS n FROM kg_fact WHERE status = 'active' AND invalid_at IS NULL GROUP BY 1""")
def agg_current_profile(g):
    return g.fact.where(active()).groupBy("source_node_uuid").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("canonical_name", F.lower("name")))), ",").alias("predicates"), F.count("*").alias("n"))


@query("""SELECT group_id, count(*) AS n_self, count_if(is_belief) AS n_beliefs, count_if(stability = 'persistent') AS n_patterns, max_by(uuid, (confidence, uuid)) AS surest FROM kg_fact WHERE source_type = 'assistant' GROUP BY group_id""")
def agg_self_model(g):
    rows = g.fact.where("source_type = 'assistant'")
    return rows.groupBy("group_id").agg(F.count("*").alias("n_self"), F.count_if("is_belief").alias("n_beliefs"), F.count_if(F.col("stability") == "persistent").alias("n_patterns"), F.max_by("uuid", F.struct("confidence", "uuid")).alias("surest"))


_COUNTED = ("kg_fact", "kg_entity", "kg_episode", "kg_mention", "kg_alias")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n FROM {t}" for t in _COUNTED))
def agg_table_counts(g):
    out = None
    for t in _COUNTED:
        part = g.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n")
        out = part if out is None else out.union(part)
    return out


@query("SELECT source_node_uuid, array_to_string(list_sort(list_distinct(flatten(list(episodes)))), ',') AS episodes FROM kg_fact GROUP BY 1")
def agg_distinct_arrays(g):
    return g.fact.select("source_node_uuid", F.explode("episodes").alias("e")).groupBy("source_node_uuid").agg(F.array_join(F.array_sort(F.collect_set("e")), ",").alias("episodes"))


# -- lists ------------------------------------------------------------------------------------------------------------


def _top(sql_where: str, order: str, limit: int, columns: str = "uuid, confidence, valid_at") -> str:
    return f"SELECT {columns} FROM kg_fact WHERE {sql_where} ORDER BY {order}, uuid LIMIT {limit}"


@query(_top("status = 'active' AND invalid_at IS NULL", "valid_at DESC", 30))
def topk_recent_facts(g):
    return g.fact.where(active()).select("uuid", "confidence", "valid_at").orderBy(F.desc("valid_at"), "uuid").limit(30)


@query(_top("reinforcement_count >= 3", "reinforcement_count DESC", 25, "uuid, reinforcement_count"))
def topk_reinforced(g):
    return g.fact.where("reinforcement_count >= 3").select("uuid", "reinforcement_count").orderBy(F.desc("reinforcement_count"), "uuid").limit(25)


@query(_top("intensity > 0", "valid_at DESC", 25, "uuid, valence, intensity, valid_at"))
def topk_affect(g):
    return g.fact.where("intensity > 0").select("uuid", "valence", "intensity", "valid_at").orderBy(F.desc("valid_at"), "uuid").limit(25)


@query(_top("stability = 'consolidated'", "confidence DESC", 20))
def topk_consolidated(g):
    return g.fact.where("stability = 'consolidated'").select("uuid", "confidence", "valid_at").orderBy(F.desc("confidence"), "uuid").limit(20)


@query(_top("is_belief AND status = 'active'", "confidence DESC", 20, "uuid, belief_holder, confidence"))
def topk_beliefs(g):
    return g.fact.where("is_belief and status = 'active'").select("uuid", "belief_holder", "confidence").orderBy(F.desc("confidence"), "uuid").limit(20)


def _labelled(label: str, n: int):
    def plan(g):
        return g.entity.where(F.array_contains("labels", label)).select("uuid", "name", "mention_count").orderBy(F.desc("mention_count"), "uuid").limit(n)

    return plan


for _name, _label in (("topk_traits", "trait"), ("topk_goals", "goal")):
    query(f"SELECT uuid, name, mention_count FROM kg_entity WHERE list_contains(labels, '{_label}') ORDER BY mention_count DESC, uuid LIMIT 15", _name)(_labelled(_label, 15))


@query("SELECT group_id, max(domain) AS domain, count(*) AS n FROM kg_entity WHERE domain IS NOT NULL GROUP BY group_id ORDER BY n DESC, group_id LIMIT 5")
def topk_predictions(g):
    return g.entity.where("domain is not null").groupBy("group_id").agg(F.max("domain").alias("domain"), F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").limit(5)


@query("SELECT uuid, fact, created_at FROM kg_fact WHERE group_id = 'u4' ORDER BY created_at, uuid")
def topk_created(g):
    return g.fact.where("group_id = 'u4'").select("uuid", "fact", "created_at").orderBy("created_at", "uuid")


# -- sets -------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT uuid, 0 AS channel FROM kg_fact WHERE name = 'click'), b AS (SELECT uuid, 1 AS channel FROM kg_fact WHERE status = 'superseded'), c AS (SELECT uuid, 2 AS channel FROM kg_fact WHERE target_node_uuid = 'u1:obj:1')
SELECT uuid, min(channel)::INTEGER AS channel FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY uuid""")
def set_union_dedupe(g):
    conditions = ("name = 'click'", "status = 'superseded'", "target_node_uuid = 'u1:obj:1'")
    out = None
    for k, c in enumerate(conditions):
        part = g.fact.where(c).select("uuid", F.lit(k).alias("channel"))
        out = part if out is None else out.union(part)
    return out.groupBy("uuid").agg(F.min("channel").alias("channel"))


@query("SELECT uuid, array_to_string(list_sort(list_distinct(list_concat(traits, labels))), ',') AS members FROM kg_entity")
def set_union_sidecar(g):
    return g.entity.select("uuid", F.array_join(F.array_sort(F.array_union("traits", "labels")), ",").alias("members"))


@query("""WITH w AS (SELECT uuid, group_id, reference_time, list_distinct(list_filter(list_transform(regexp_extract_all(content, '[a-zA-Z'']+'), lambda x: lower(x)), lambda x: length(x) >= 4)) AS ws FROM kg_episode),
p AS (SELECT uuid, ws, lag(ws) OVER (PARTITION BY group_id ORDER BY reference_time, uuid) AS before FROM w) SELECT uuid, len(list_intersect(ws, before))::INTEGER AS overlap FROM p WHERE before IS NOT NULL""")
def set_token_intersect(g):
    from kairograph.functions.text import words

    w = g.episode.select("uuid", "group_id", "reference_time", words(F.col("content"), 4).alias("ws"))
    p = w.select("uuid", "ws", F.lag("ws").over(Window.partitionBy("group_id").orderBy("reference_time", "uuid")).alias("before"))
    return p.where("before is not null").select("uuid", F.size(F.array_intersect("ws", "before")).alias("overlap"))


@query("""SELECT f.uuid, CASE WHEN r.direction = 'symmetric' THEN least(source_node_uuid, target_node_uuid) ELSE source_node_uuid END AS s, CASE WHEN r.direction = 'symmetric' THEN greatest(source_node_uuid, target_node_uuid) ELSE target_node_uuid END AS o FROM kg_fact f LEFT JOIN kg_frame r ON r.alias = lower(f.relation)""")
def set_symmetric_norm(g):
    from kairograph.operators import temporal

    rows = temporal.resolve_frames(g.fact.select("uuid", "relation", "source_node_uuid", "target_node_uuid"), g.frame)
    s, o = temporal.symmetric()
    return rows.select("uuid", s.alias("s"), o.alias("o"))
