"""Scans and changes of tables (sources and sinks that SQL can express)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions.keys import fact_key
from kairograph.operators import mutate
from kairograph.operators.filters import ntz

from .registry import query

FACT_COLUMNS = ("uuid", "group_id", "source_node_uuid", "name", "target_node_uuid", "valid_at", "status")


@query("SELECT uuid, group_id, source_node_uuid, name, target_node_uuid, valid_at, status FROM kg_fact WHERE group_id = 'u3'")
def src_table_scan(g):
    return g.fact.where("group_id = 'u3'").select(*FACT_COLUMNS)


@query("SELECT uuid, name, target_node_uuid, confidence FROM kg_fact WHERE uuid = 'e42'")
def src_point_lookup(g):
    return g.fact.where("uuid = 'e42'").select("uuid", "name", "target_node_uuid", "confidence").limit(1)


@query("SELECT uuid, name, group_id FROM kg_entity WHERE uuid IN ('user:1', 'user:7', 'u2:obj:3', 'nobody')")
def src_multi_get(g):
    wanted = g.spark.createDataFrame([(u,) for u in ("user:1", "user:7", "u2:obj:3", "nobody")], "uuid string")
    return g.entity.join(F.broadcast(wanted), "uuid", "left_semi").select("uuid", "name", "group_id")


@query("SELECT uuid, name FROM kg_entity WHERE group_id = 'u5' AND name = 'User 5' ORDER BY uuid LIMIT 1")
def src_name_lookup(g):
    return g.entity.where("group_id = 'u5' and name = 'User 5'").select("uuid", "name").orderBy("uuid").limit(1)


@query("SELECT uuid, created_at FROM kg_fact WHERE group_id = 'u1' ORDER BY created_at, uuid LIMIT 50 OFFSET 100")
def src_keyset_page(g):
    return g.fact.where("group_id = 'u1'").select("uuid", "created_at").orderBy("created_at", "uuid").offset(100).limit(50)


@query("""SELECT uuid, group_id, source, reference_time FROM kg_episode WHERE reference_time <= TIMESTAMP '2024-01-01 12:00:00' AND group_id IN ('c1', 'c2') AND source = 'message'
ORDER BY reference_time DESC, uuid LIMIT 20""")
def src_recent_episodes(g):
    rows = g.episode.where((F.col("reference_time") <= ntz("2024-01-01 12:00:00")) & F.col("group_id").isin("c1", "c2") & (F.col("source") == "message"))
    return rows.select("uuid", "group_id", "source", "reference_time").orderBy(F.desc("reference_time"), "uuid").limit(20)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reference_time DESC, uuid) AS n FROM kg_episode WHERE cognition_processed_at IS NULL)
SELECT group_id, uuid, reference_time FROM r WHERE n <= 32""")
def src_pending_episodes(g):
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("reference_time"), "uuid"))
    return g.episode.where("cognition_processed_at is null").withColumn("n", newest).where("n <= 32").select("group_id", "uuid", "reference_time")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reference_time DESC, uuid DESC) AS n FROM kg_episode)
SELECT group_id, string_agg(content, chr(10) || '---' || chr(10) ORDER BY reference_time, uuid) AS contents FROM r WHERE n <= 10 GROUP BY group_id""")
def src_episode_contents(g):
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("reference_time"), F.desc("uuid")))
    rows = g.episode.withColumn("n", newest).where("n <= 10")
    ordered = F.array_sort(F.collect_list(F.struct("reference_time", "uuid", "content")))
    return rows.groupBy("group_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n---\n").alias("contents"))


@query("""SELECT uuid, name, summary, mention_count FROM kg_entity WHERE uuid NOT IN ('user:1', 'user:2')
UNION ALL SELECT uuid, 'Renamed ' || uuid, summary, mention_count + 1 FROM kg_entity WHERE uuid IN ('user:1', 'user:2')
UNION ALL VALUES ('user:new', 'New one', NULL, 1)""")
def snk_upsert(g):
    old = g.entity.select("uuid", "name", "summary", "mention_count")
    changed = old.where("uuid in ('user:1', 'user:2')").select("uuid", F.concat(F.lit("Renamed "), "uuid").alias("name"), (F.col("mention_count") + 1).alias("mention_count"))
    new = changed.unionByName(g.spark.createDataFrame([("user:new", "New one", 1)], "uuid string, name string, mention_count bigint"))
    return mutate.upsert(old, new)


@query("""SELECT uuid, CASE WHEN uuid = 'e1' THEN 'superseded' ELSE status END AS status FROM kg_fact""")
def snk_save_edge(g):
    new = g.spark.createDataFrame([("e1", "superseded"), ("unknown", "active")], "uuid string, status string")
    return mutate.update(g.fact.select("uuid", "status"), new)


@query("""SELECT 'entity' AS tab, uuid FROM kg_entity WHERE uuid <> 'user:3'
UNION ALL SELECT 'relates_to', uuid FROM kg_fact WHERE source_node_uuid <> 'user:3' AND target_node_uuid <> 'user:3'
UNION ALL SELECT 'mentions', uuid FROM kg_mention WHERE entity_uuid <> 'user:3'""")
def snk_delete_node(g):
    gone = g.spark.createDataFrame([("user:3",)], "uuid string")
    edges = {"relates_to": (g.fact.select("uuid", "source_node_uuid", "target_node_uuid"), ("source_node_uuid", "target_node_uuid")), "mentions": (g.mention.select("uuid", "entity_uuid"), ("entity_uuid",))}
    nodes, left = mutate.delete_nodes(g.entity.select("uuid"), edges, gone)
    out = nodes.select(F.lit("entity").alias("tab"), "uuid")
    for name, table in left.items():
        out = out.union(table.select(F.lit(name).alias("tab"), "uuid"))
    return out


@query("SELECT uuid, name FROM kg_fact WHERE uuid <> 'e10'")
def snk_delete_edge(g):
    return g.fact.join(F.broadcast(g.spark.createDataFrame([("e10",)], "uuid string")), "uuid", "left_anti").select("uuid", "name")


@query("""SELECT 'entity' AS tab, group_id, count(*) AS n FROM kg_entity WHERE group_id <> 'u2' GROUP BY ALL UNION ALL SELECT 'relates_to', group_id, count(*) FROM kg_fact WHERE group_id <> 'u2' GROUP BY ALL
UNION ALL SELECT 'mentions', group_id, count(*) FROM kg_mention WHERE group_id <> 'u2' GROUP BY ALL UNION ALL SELECT 'alias', group_id, count(*) FROM kg_alias GROUP BY ALL""")
def snk_delete_group(g):
    out = None
    for name, table, scoped in (("entity", g.entity, True), ("relates_to", g.fact, True), ("mentions", g.mention, True), ("alias", g.alias, False)):
        rows = table.where("group_id <> 'u2'") if scoped else table
        part = rows.groupBy("group_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "group_id", "n")
        out = part if out is None else out.union(part)
    return out


@query("SELECT uuid, name FROM kg_entity WHERE false")
def snk_clear(g):
    return g.entity.select("uuid", "name").limit(0)


@query("""SELECT uuid, array_to_string(list_filter(episodes, lambda e: e <> 'ep:5'), ',') AS episodes FROM kg_fact WHERE len(list_filter(episodes, lambda e: e <> 'ep:5')) > 0""")
def snk_remove_episode(g):
    return mutate.remove_episode(g.fact.select("uuid", "episodes"), "ep:5").select("uuid", F.array_join("episodes", ",").alias("episodes"))


@query("""SELECT uuid, coalesce(domain, 'none') AS domain, 1.0::DOUBLE AS salience, coalesce(canonical_name, 'unknown') AS canonical_name FROM kg_fact""")
def snk_init_schema(g):
    rows = g.fact.select("uuid", "domain", "canonical_name")
    return mutate.with_defaults(rows, {"domain": F.lit("none"), "salience": F.lit(1.0), "canonical_name": F.lit("unknown")})


@query("""SELECT uuid, trim(group_id) || '::' || trim(source_node_uuid) || '::' || lower(trim(relation)) || '::' || trim(target_node_uuid) AS fact_key FROM kg_fact WHERE seq % 2 = 0 UNION ALL SELECT uuid, 'kept' FROM kg_fact WHERE seq % 2 <> 0""")
def snk_backfill_fact_key(g):
    held = F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.lit("kept"))
    key = fact_key(F.col("group_id"), F.col("source_node_uuid"), F.col("relation"), F.col("target_node_uuid"))
    return g.fact.select("uuid", F.when(held == "", key).otherwise(held).alias("fact_key"))


@query("""WITH new AS (SELECT uuid, group_id, name FROM kg_entity WHERE uuid LIKE 'user:1%' UNION ALL SELECT 'x:' || uuid, group_id, name || ' twin' FROM kg_entity WHERE uuid LIKE 'user:1%')
SELECT uuid, group_id, name FROM kg_entity UNION ALL SELECT uuid, group_id, name FROM new WHERE uuid LIKE 'x:%'""")
def snk_insert_node(g):
    old = g.entity.select("uuid", "group_id", "name")
    some = old.where("uuid like 'user:1%'")
    new = some.union(some.select(F.concat(F.lit("x:"), "uuid"), "group_id", F.concat("name", F.lit(" twin"))))
    return mutate.insert(old, new.toDF("uuid", "group_id", "name"), "uuid")


@query("""SELECT episode_uuid AS source, entity_uuid AS target, min(created_at) AS created_at, 'mentions' AS kind FROM kg_mention GROUP BY 1, 2 UNION ALL
SELECT DISTINCT source_node_uuid, target_node_uuid, min(created_at) OVER (PARTITION BY source_node_uuid, target_node_uuid), 'relates_to' FROM kg_fact""")
def snk_relate(g):
    m = g.mention.groupBy(F.col("episode_uuid").alias("source"), F.col("entity_uuid").alias("target")).agg(F.min("created_at").alias("created_at")).withColumn("kind", F.lit("mentions"))
    f = g.fact.groupBy(F.col("source_node_uuid").alias("source"), F.col("target_node_uuid").alias("target")).agg(F.min("created_at").alias("created_at")).withColumn("kind", F.lit("relates_to"))
    return m.unionByName(f)
