"""Projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.operators import filters as O
from kairograph.operators import temporal
from kairograph.sources.testgraph import NOW

from .registry import query

_PROT = "('constraint','style','preference','goal','trait','self_model','consolidated','archived_summary')"


@query("SELECT uuid, valid_at FROM kg_fact WHERE status = 'active' AND invalid_at IS NULL")
def flt_active(g):
    return g.fact.where(O.active()).select("uuid", "valid_at")


@query(f"""SELECT uuid, status FROM kg_fact WHERE (invalid_at IS NULL OR invalid_at > TIMESTAMP '{NOW}') AND (expired_at IS NULL OR expired_at > TIMESTAMP '{NOW}') AND coalesce(status, '') IN ('', 'active')""")
def flt_valid_now(g):
    return g.fact.where(O.valid_now(O.ntz(NOW))).select("uuid", "status")


@query("""SELECT uuid FROM kg_fact WHERE ((valid_at >= TIMESTAMP '2024-01-05' AND valid_at < TIMESTAMP '2024-01-10') OR valid_at > TIMESTAMP '2024-01-25') AND (invalid_at IS NULL OR invalid_at <= TIMESTAMP '2024-01-20')
AND coalesce(created_at <> TIMESTAMP '2024-01-06', false) AND expired_at IS NOT NULL""")
def flt_date_dnf(g):
    dates = {
        "valid_at": [[(">=", "2024-01-05"), ("<", "2024-01-10")], [(">", "2024-01-25")]],
        "invalid_at": [[("IS NULL", None)], [("<=", "2024-01-20")]],
        "created_at": [[("<>", "2024-01-06")]],
        "expired_at": [[("IS NOT NULL", None)]],
    }
    return g.fact.where(O.SearchFilters(dates=dates).edges(g.fact.columns)).select("uuid")


@query("SELECT uuid, name FROM kg_fact WHERE name IN ('click', 'purchase')")
def flt_edge_types(g):
    return g.fact.where(O.SearchFilters(edge_types=["click", "purchase"]).edges(g.fact.columns)).select("uuid", "name")


@query("SELECT uuid FROM kg_fact WHERE uuid IN ('e1', 'e5', 'e999')")
def flt_edge_uuids(g):
    return g.fact.where(O.SearchFilters(edge_uuids=["e1", "e5", "e999"]).edges(g.fact.columns)).select("uuid")


@query("""SELECT uuid FROM kg_fact WHERE confidence >= 0.7 AND json_extract_string(attributes, '$.color') = 'red' AND json_extract_string(attributes, '$.score')::DOUBLE < 50""")
def flt_property(g):
    cols = g.fact.columns
    wanted = O.SearchFilters(properties=[("confidence", ">=", 0.7), ("color", "=", "red"), ("score", "<", 50), ("missing", "IS NULL", None)])
    return g.fact.where(wanted.edges(cols)).select("uuid")


@query("SELECT uuid FROM kg_fact WHERE CASE WHEN lower(trim(coalesce(memory_class, ''))) = '' THEN 'objective' ELSE lower(trim(memory_class)) END IN ('goal', 'objective')")
def flt_memory_class(g):
    return g.fact.where(O.SearchFilters(memory_classes=["goal", "objective"]).edges(g.fact.columns)).select("uuid")


@query("SELECT uuid FROM kg_entity WHERE list_has_any(labels, ['BUILDING', 'trait'])")
def flt_node_labels(g):
    return g.entity.where(O.SearchFilters(node_labels=["BUILDING", "trait"]).nodes()).select("uuid")


_VIEWS = {
    "default": (O.GraphView(group_id="u1"), "group_id = 'u1' AND invalid_at IS NULL AND expired_at IS NULL"),
    "as_of": (O.GraphView(include_invalid=True, as_of="2024-01-15", status=["active", "superseded"]), "valid_at <= TIMESTAMP '2024-01-15' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-15') AND status IN ('active', 'superseded')"),
    "conflicts": (O.GraphView(include_invalid=True, visibility="conflicts"), "coalesce(conflict_group_id, '') <> ''"),
    "derived": (O.GraphView(derived_only=True, min_confidence=0.6), "invalid_at IS NULL AND expired_at IS NULL AND derived AND confidence >= 0.6"),
    "non_derived": (O.GraphView(visibility="non_derived", source_type=["user"]), "invalid_at IS NULL AND expired_at IS NULL AND NOT derived AND source_type = 'user'"),
    "invalidated": (O.GraphView(include_invalid=True, visibility="invalidated"), "invalid_at IS NOT NULL OR expired_at IS NOT NULL OR status = 'superseded'"),
    "active": (O.GraphView(visibility="active", canonical=["CLICK", "purchase"]), "invalid_at IS NULL AND expired_at IS NULL AND coalesce(status, '') IN ('', 'active') AND (coalesce(canonical_name, '') IN ('click', 'purchase') OR name IN ('click', 'purchase'))"),
    "window": (O.GraphView(include_invalid=True, valid_after="2024-01-10", valid_before="2024-01-12"), "valid_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS view, uuid FROM kg_fact WHERE {w}" for k, (_, w) in _VIEWS.items()))
def flt_graph(g):
    f = g.fact
    tags = F.array_compact(F.array(*[F.when(v.column(), F.lit(k)) for k, (v, _) in _VIEWS.items()]))
    return f.select("uuid", F.explode(tags).alias("view"))


@query("SELECT uuid, list_contains(labels, 'goal') AS is_goal FROM kg_entity WHERE list_contains(labels, 'trait')")
def flt_label_contains(g):
    return g.entity.where(F.array_contains("labels", "trait")).select("uuid", F.array_contains("labels", "goal").alias("is_goal"))


@query("SELECT uuid FROM kg_episode WHERE contains(source, 'self_')")
def flt_source_contains(g):
    return g.episode.where(F.col("source").contains("self_")).select("uuid")


@query("SELECT uuid FROM kg_fact WHERE list_has_any(episodes, ['ep:1', 'ep:33'])")
def flt_any_inside(g):
    return g.fact.where(F.arrays_overlap("episodes", F.array(F.lit("ep:1"), F.lit("ep:33")))).select("uuid")


@query("SELECT uuid FROM kg_fact WHERE source_node_uuid IN ('user:3', 'u2:obj:1') OR target_node_uuid IN ('user:3', 'u2:obj:1')")
def flt_ego(g):
    nodes = g.spark.createDataFrame([("user:3",), ("u2:obj:1",)], "node string")
    return O.ego_edges(g.fact, F.broadcast(nodes)).select("uuid")


@query("""WITH via AS (SELECT * FROM kg_fact WHERE contains(lower(name || ' ' || fact), 'tag 12')), ends AS (SELECT source_node_uuid AS u FROM via UNION SELECT target_node_uuid FROM via)
SELECT uuid, name FROM kg_entity WHERE contains(lower(name || ' ' || summary), 'tag 12') OR uuid IN (SELECT u FROM ends)""")
def flt_text_contains(g):
    return O.text_contains(g.entity, g.fact, "Tag 12").select("uuid", "name")


_RULES = [("Person", "Brand#1", ["click", "view"]), ("BUILDING", "Product", []), ("MACHINERY", "Product", ["purchase"])]


@query("""WITH rules(s, o, allowed) AS (VALUES ('Person', 'Brand#1', ['click', 'view']), ('BUILDING', 'Product', []::VARCHAR[]), ('MACHINERY', 'Product', ['purchase'])),
lab AS (SELECT uuid AS node, unnest(labels) AS label FROM kg_entity)
SELECT DISTINCT f.uuid FROM kg_fact f JOIN lab a ON a.node = f.source_node_uuid JOIN lab b ON b.node = f.target_node_uuid JOIN rules r ON r.s = a.label AND r.o = b.label WHERE len(allowed) = 0 OR list_contains(allowed, f.name)""")
def flt_edge_type_map(g):
    rules = g.spark.createDataFrame(_RULES, "subject_label string, object_label string, allowed array<string>")
    labels = g.entity.select(F.col("uuid").alias("node"), F.explode("labels").alias("label"))
    return O.by_type_map(g.fact, labels, F.broadcast(rules)).select("uuid")


@query("""WITH kept AS (SELECT uuid FROM kg_entity WHERE NOT list_has_any(labels, ['BUILDING', 'Brand#2']))
SELECT 'entity' AS kind, uuid FROM kept UNION ALL SELECT 'fact', uuid FROM kg_fact WHERE source_node_uuid IN (SELECT uuid FROM kept) AND target_node_uuid IN (SELECT uuid FROM kept)""")
def flt_excluded_types(g):
    entities, facts = O.without_types(g.entity, g.fact, ["BUILDING", "Brand#2"])
    return entities.select(F.lit("entity").alias("kind"), "uuid").union(facts.select(F.lit("fact"), "uuid"))


@query("SELECT uuid, group_id, name, label, confidence FROM kg_vec")
def prj_strip_embeddings(g):
    rows = g.vec.select("uuid", "group_id", "name", "label", "fact_embedding", "confidence")
    return rows.drop(*[c for c in rows.columns if c.endswith("_embedding")])


@query("""SELECT f.uuid, coalesce(s.name, f.source_node_uuid) AS subject, f.name AS predicate, coalesce(o.name, f.target_node_uuid) AS object, f.fact FROM kg_fact f LEFT JOIN kg_entity s ON s.uuid = f.source_node_uuid LEFT JOIN kg_entity o ON o.uuid = f.target_node_uuid""")
def prj_edge_view(g):
    names = g.entity.select("uuid", "name")
    s = names.select(F.col("uuid").alias("source_node_uuid"), F.col("name").alias("s"))
    o = names.select(F.col("uuid").alias("target_node_uuid"), F.col("name").alias("o"))
    rows = g.fact.join(s, "source_node_uuid", "left").join(o, "target_node_uuid", "left")
    return rows.select("uuid", F.coalesce("s", "source_node_uuid").alias("subject"), F.col("name").alias("predicate"), F.coalesce("o", "target_node_uuid").alias("object"), "fact")


@query("SELECT uuid, name, array_to_string(labels, ',') AS labels, left(summary, 20) AS short, coalesce(domain, '') AS domain FROM kg_entity")
def prj_node_view(g):
    return g.entity.select("uuid", "name", F.array_join("labels", ",").alias("labels"), F.substring("summary", 1, 20).alias("short"), F.coalesce("domain", F.lit("")).alias("domain"))


_RAW = [(1, " Ann ", "Lives_In", "Paris"), (2, "Ann", "lives_in", " World "), (3, "", "likes", "tea"), (4, "Bob", "is_named", "Bob"), (5, "Bob", "likes", "Bob"), (6, "spk", "is_aka", "spk"), (7, "Cy", " ", "x"), (8, "Di", "from", "Earthly"), (9, None, "likes", "y"), (10, "Eve", "MENTIONS_WITH", "Eve")]
_RAW_SQL = ", ".join("({}, {}, '{}', '{}')".format(i, "NULL" if s is None else f"'{s}'", p, o) for i, s, p, o in _RAW)


@query(f"""WITH raw(id, s, p, o) AS (VALUES {_RAW_SQL}), t AS (SELECT id, trim(coalesce(s, '')) AS s, lower(trim(p)) AS p, trim(o) AS o FROM raw),
k AS (SELECT *, s <> '' AND o <> '' AND p <> '' AND NOT (p IN ('lives_in','located_in','from','resides_in','based_in') AND lower(o) IN ('world','earth','universe','everywhere','anywhere','somewhere'))
 AND (s <> o OR p IN ('is_named','is_called','is_self','is_aka','mentions_with')) AS keep FROM t)
SELECT id, keep, CASE WHEN keep AND s = o AND s <> 'spk' THEN 'spk' ELSE s END AS subject, p AS predicate, o AS object FROM k""")
def prj_repair_fact(g):
    raw = g.spark.createDataFrame(_RAW, "id int, subject string, predicate string, object string")
    return temporal.repair(raw, "spk").select("id", "keep", "subject", "predicate", "object")


@query("""SELECT uuid, array_to_string(list_sort(list_distinct(list_concat(labels, list_filter(['User', 'Object', 'Robot'], lambda t: contains(lower(name), lower(t)))))), ',') AS labels FROM kg_entity""")
def prj_label_hint(g):
    types = F.array(*map(F.lit, ("User", "Object", "Robot")))
    hints = F.filter(types, lambda t: F.lower("name").contains(F.lower(t)))
    return g.entity.select("uuid", F.array_join(F.array_sort(F.array_union("labels", hints)), ",").alias("labels"))
