"""Hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions.decay import effective_confidence
from kairograph.functions.text import terms
from kairograph.operators import graph
from kairograph.operators import search as S
from kairograph.operators.filters import SearchFilters, active, ntz
from kairograph.sources.testgraph import NOW

from .registry import query
from .scalars import EFFECTIVE_SQL, profiles_sql

QUERY_TEXT = "the and thing of Ist der"
QUERY_VEC = 7
_ACC, _PLAIN = "àâäáãçéèêëíîïìñóôöòõúûüùÿ", "aaaaaceeeeiiiinooooouuuuy"
TOKENS_SQL = "regexp_extract_all(translate(lower({0}), '%s', '%s'), '[a-z0-9]+')" % (_ACC, _PLAIN)


def vector(g, vec_id: int = QUERY_VEC) -> list[float]:
    """The query's embedding: one row by id."""
    return [float(x) for x in g.raw("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def knn_sql(k: int, where: str = "true", source: str = "kg_vec") -> str:
    return f"knn0 AS (SELECT e.uuid, list_cosine_similarity(e.fact_embedding, q.v) AS score FROM {source} e, (SELECT fact_embedding AS v FROM kg_vec WHERE uuid = 'vec:{QUERY_VEC}') q WHERE {where}), knn AS (SELECT * FROM knn0 ORDER BY round(score, 9) DESC, uuid LIMIT {k})"


def bm25_sql(source: str, key: str, text: str, query_text: str, k: int | None) -> str:
    words = ", ".join(f"('{w}')" for w in sorted(set(query_text.lower().split())))
    top = f" ORDER BY score DESC, {key} LIMIT {k}" if k else ""
    return f"""docs_ AS (SELECT {key}, {TOKENS_SQL.format(f"coalesce({text}, '')")} AS t FROM {source}), q_(term) AS (VALUES {words}),
stats_ AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs_), tf_ AS (SELECT {key}, term, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS length FROM docs_, q_), df_ AS (SELECT term, count(*) AS df FROM tf_ WHERE tf > 0 GROUP BY 1),
bm25 AS (SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 9) AS score FROM tf_ JOIN df_ USING (term), stats_ WHERE tf > 0 GROUP BY {key}{top})"""


def _rounded(rows, *more):
    return rows.select("uuid", F.round("score", 6).alias("score"), *more)


@query(f"WITH {knn_sql(10)} SELECT uuid, round(score, 6) AS score FROM knn")
def hs_knn_edges(g):
    return _rounded(S.knn(g.vec, vector(g), 10))


def _own(name: str, source: str, k: int) -> str:
    """A KNN ranking over ``name_embedding`` of a source."""
    return f"{name} AS (SELECT e.uuid, list_cosine_similarity(e.name_embedding, q.v) AS score FROM {source} e, (SELECT fact_embedding AS v FROM kg_vec WHERE uuid = 'vec:{QUERY_VEC}') q ORDER BY round(score, 9) DESC, e.uuid LIMIT {k})"


_CENTRES = """x_ AS (SELECT label, unnest(fact_embedding) AS v, generate_subscripts(fact_embedding, 1) AS i FROM kg_vec),
centres AS (SELECT 'community:' || label AS uuid, list(m ORDER BY i) AS name_embedding FROM (SELECT label, i, avg(v) AS m FROM x_ GROUP BY 1, 2) GROUP BY label)"""


def _communities(g):
    return S.centroids(g.vec, "label", "fact_embedding").withColumn("uuid", F.concat(F.lit("community:"), "label"))


@query(f"WITH {_own('near', 'kg_node', 10)} SELECT uuid, round(score, 6) AS score FROM near")
def hs_knn_nodes(g):
    return _rounded(S.knn(g.node, vector(g), 10, "name_embedding"))


@query(f"WITH {_CENTRES}, {_own('near', 'centres', 5)} SELECT uuid, round(score, 6) AS score FROM near")
def hs_knn_communities(g):
    return _rounded(S.search_communities(_communities(g), vector(g), 5))


@query(f"WITH {bm25_sql('kg_vec', 'uuid', 'fact', QUERY_TEXT, 20)} SELECT uuid, round(score, 6) AS score FROM bm25")
def hs_fts_edges(g):
    return _rounded(S.bm25(g.vec, QUERY_TEXT, k=20))


@query(f"WITH {bm25_sql('kg_entity', 'uuid', 'summary', 'building customer 12', 10)} SELECT uuid, round(score, 6) AS score FROM bm25")
def hs_fts_nodes(g):
    return _rounded(S.bm25(g.entity, "building customer 12", "summary", 10))


@query(f"WITH {bm25_sql('kg_episode', 'uuid', 'content', 'the ist que', 10)} SELECT uuid, round(score, 6) AS score FROM bm25")
def hs_fts_episodes(g):
    return _rounded(S.bm25(g.episode, "the ist que", "content", 10))


@query(f"WITH {bm25_sql('documents', 'doc_id', 'text', 'the and thing', 10)} SELECT doc_id, round(score, 6) AS score FROM bm25")
def hs_fts_documents(g):
    return S.bm25(g.raw("documents"), "the and thing", "text", 10, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT uuid, unnest({TOKENS_SQL.format('fact')}) AS term FROM kg_fact) SELECT uuid, term, count(*) AS tf FROM t GROUP BY 1, 2""")
def hs_postings(g):
    return S.postings(g.fact, "fact").select("uuid", "term", "tf")


@query(f"WITH d AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents) SELECT doc_id, len(t)::INTEGER AS n_terms, len(list_distinct(t))::INTEGER AS n_distinct FROM d")
def hs_analyzer(g):
    t = terms(F.coalesce("text", F.lit("")))
    return g.raw("documents").select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


def fused_sql(where: str = "true", text: str = QUERY_TEXT, k: int = 50) -> str:
    source = "kg_vec" if where == "true" else f"(SELECT * FROM kg_vec WHERE {where})"
    return f"""{knn_sql(k, where)}, {bm25_sql(source, 'uuid', 'fact', text.replace(',', ''), k)},
lists AS (SELECT 0 AS l, uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS rank FROM knn UNION ALL SELECT 1, uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 FROM bm25),
rrf AS (SELECT uuid, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score FROM lists GROUP BY uuid)"""


VALID_SQL = f"(invalid_at IS NULL OR invalid_at > TIMESTAMP '{NOW}') AND (expired_at IS NULL OR expired_at > TIMESTAMP '{NOW}') AND coalesce(status, '') IN ('', 'active')"


@query(f"WITH {fused_sql()} SELECT uuid, round(score, 9) AS score FROM rrf")
def hs_rrf(g):
    a = S.ranked(S.knn(g.vec, vector(g)).select("uuid", "score"), 0)
    b = S.ranked(S.bm25(g.vec, QUERY_TEXT), 1)
    return S.rrf(a.union(b)).select("uuid", F.round("score", 9).alias("score"))


def _hits(out):
    return out.select("uuid", F.round("score", 9).alias("score"))


@query(f"WITH {fused_sql()} SELECT uuid, round(r.score, 9) AS score FROM rrf r JOIN kg_vec USING (uuid) WHERE {VALID_SQL} ORDER BY r.score DESC, uuid LIMIT 10")
def hs_hybrid(g):
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW)))


@query(f"""WITH {fused_sql()} SELECT uuid, round(r.score, 9) AS score FROM rrf r JOIN kg_vec v USING (uuid) WHERE {VALID_SQL} AND v.confidence >= 0.6 AND v.name <> 'rel3' AND v.valid_at < TIMESTAMP '2024-01-18' AND (source_node_uuid IN ('n1','n2','n3','n7','n20') OR target_node_uuid IN ('n1','n2','n3','n7','n20')) ORDER BY r.score DESC, uuid LIMIT 10""")
def hs_hybrid_filtered(g):
    filters = SearchFilters(dates={"valid_at": [[("<", "2024-01-18")]]}, properties=[("confidence", ">=", 0.6), ("name", "<>", "rel3")])
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW), S.SearchConfig(filters=filters, ego=("n1", "n2", "n3", "n7", "n20"))))


@query(f"""WITH {fused_sql()} SELECT uuid, round(r.score, 9) AS score FROM rrf r JOIN kg_vec v USING (uuid) WHERE {VALID_SQL} ORDER BY len(list_intersect(list_distinct(regexp_split_to_array(lower(v.fact), '\\s+')), ['and','der','ist','of','the','thing'])) / 6.0 DESC, r.score DESC, uuid LIMIT 10""")
def hs_rr_cross_encoder(g):
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW), S.SearchConfig(reranker="cross_encoder")))


@query(f"""WITH {fused_sql()} SELECT uuid, round(r.score, 9) AS score FROM rrf r JOIN kg_vec v USING (uuid) WHERE {VALID_SQL} ORDER BY len(episodes) DESC, r.score DESC, uuid LIMIT 10""")
def hs_rr_episode_mentions(g):
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW), S.SearchConfig(reranker="episode_mentions")))


@query(f"""WITH {fused_sql()}, nb AS (SELECT DISTINCT target_node_uuid AS n FROM kg_vec WHERE source_node_uuid = 'n4'),
d AS (SELECT uuid, CASE WHEN 'n4' IN (source_node_uuid, target_node_uuid) THEN 1 WHEN source_node_uuid IN (SELECT n FROM nb) OR target_node_uuid IN (SELECT n FROM nb) THEN 2 ELSE 99 END AS depth FROM kg_vec)
SELECT uuid, round(r.score, 9) AS score FROM rrf r JOIN kg_vec v USING (uuid) JOIN d USING (uuid) WHERE {VALID_SQL} ORDER BY depth, r.score DESC, uuid LIMIT 10""")
def hs_rr_node_distance(g):
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW), S.SearchConfig(focal="n4")))


@query(f"""WITH {fused_sql()}, nb AS (SELECT DISTINCT target_node_uuid AS n FROM kg_vec WHERE source_node_uuid = 'n11'),
d AS (SELECT uuid, CASE WHEN 'n11' IN (source_node_uuid, target_node_uuid) THEN 1 WHEN source_node_uuid IN (SELECT n FROM nb) OR target_node_uuid IN (SELECT n FROM nb) THEN 2 ELSE 99 END AS depth FROM kg_vec)
SELECT uuid, round(r.score, 9) AS score FROM rrf r JOIN kg_vec v USING (uuid) JOIN d USING (uuid) WHERE {VALID_SQL} ORDER BY depth, r.score DESC, uuid LIMIT 10""")
def hs_rr_dispatch(g):
    """A focal node wins over the reranker that was asked for."""
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW), S.SearchConfig(focal="n11", reranker="episode_mentions")))


@query()
def hs_rr_mmr(g):
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW), S.SearchConfig(reranker="mmr")))


@query(f"WITH {fused_sql()} SELECT uuid, round(r.score * ({EFFECTIVE_SQL}), 9) AS score FROM rrf r JOIN kg_vec v USING (uuid) WHERE {VALID_SQL} AND round(r.score * ({EFFECTIVE_SQL}), 9) > 0 ORDER BY 2 DESC, uuid LIMIT 10")
def hs_decay(g):
    return _hits(S.hybrid(g.vec, QUERY_TEXT, vector(g), ntz(NOW), S.SearchConfig(decay=True)))


@query(f"WITH {fused_sql("group_id IN ('v1', 'v3')")} SELECT uuid, round(r.score, 9) AS score FROM rrf r JOIN kg_vec USING (uuid) WHERE {VALID_SQL} ORDER BY r.score DESC, uuid LIMIT 25")
def hs_search(g):
    return _hits(S.search(g.vec, QUERY_TEXT, vector(g), ntz(NOW), "normal", ["v1", "v3"]))


NODE_TEXT = "User 7"


def _nodes_sql(query_text: str, k: int) -> str:
    """CTEs of a node search; its ranking is ``nodes_``."""
    return f"""{_own('name_near', 'kg_node', k)}, {bm25_sql('kg_node', 'uuid', 'name', query_text, k).replace('docs_', 'ndocs_').replace('q_', 'nq_').replace('stats_', 'nstats_').replace('tf_', 'ntf_').replace('df_', 'ndf_').replace('nntf_', 'ntf_').replace('bm25 AS', 'nbm25 AS')},
nlists AS (SELECT uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS rank FROM name_near UNION ALL SELECT uuid, row_number() OVER (ORDER BY score DESC, uuid) - 1 FROM nbm25),
nodes_ AS (SELECT uuid, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score FROM nlists GROUP BY uuid ORDER BY score DESC, uuid LIMIT {k})"""


def _episodes_sql(query_text: str, k: int) -> str:
    return bm25_sql("kg_episode", "uuid", "content", query_text, k).replace("docs_", "edocs_").replace("q_", "eq_").replace("stats_", "estats_").replace("tf_", "etf_").replace("df_", "edf_").replace("bm25 AS", "ebm25 AS")


@query(f"""WITH {fused_sql()}, hits AS (SELECT uuid, r.score FROM rrf r JOIN kg_vec USING (uuid) WHERE {VALID_SQL} ORDER BY r.score DESC, uuid LIMIT 10), {_nodes_sql(QUERY_TEXT, 10)}, {_episodes_sql(QUERY_TEXT, 10)}, {_CENTRES}, {_own('near', 'centres', 10)}
SELECT 'edge' AS kind, uuid, round(score, 6) AS score FROM hits UNION ALL SELECT 'node', uuid, round(score, 6) FROM nodes_ UNION ALL SELECT 'episode', uuid, round(score, 6) FROM ebm25 UNION ALL SELECT 'community', uuid, round(score, 6) FROM near""", "hs_search_")
def hs_search_bundle(g):
    """Edges, nodes, episodes and communities, each searched on its own vectors and texts."""
    found = S.combined(g.vec, g.node, g.episode, _communities(g), QUERY_TEXT, vector(g), ntz(NOW))
    return found.select("kind", "uuid", F.round("score", 6).alias("score"))


@query(f"WITH {_nodes_sql(NODE_TEXT, 10)} SELECT uuid, round(score, 9) AS score FROM nodes_")
def hs_nodes(g):
    return _hits(S.search_nodes(g.node, NODE_TEXT, vector(g)))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c.reranker}', {c.limit}, {c.candidates})" for k, c in S.RECIPES.items()) + ') t(recipe, reranker, "limit", candidates)')
def hs_recipes(g):
    return g.spark.createDataFrame([(k, c.reranker, c.limit, c.candidates) for k, c in S.RECIPES.items()], "recipe string, reranker string, `limit` int, candidates int")


@query("""SELECT uuid, memory_class, valid_at FROM kg_vec WHERE status = 'active' AND invalid_at IS NULL AND memory_class = 'goal' ORDER BY valid_at DESC, uuid LIMIT 10""")
def hs_class_fallback(g):
    from kairograph.functions.decay import memory_class

    rows = g.vec.where(active() & memory_class(F.col("memory_class")).isin("goal"))
    return rows.select("uuid", "memory_class", "valid_at").orderBy(F.desc("valid_at"), "uuid").limit(10)


QUESTION = "what did Node N7 tell Node N8, and the thing of it"
_ENDS = "SELECT DISTINCT n AS uuid, 'Node ' || upper(n) AS name FROM (SELECT source_node_uuid AS n FROM kg_vec UNION ALL SELECT target_node_uuid FROM kg_vec)"
_ASKED = QUESTION.replace(",", " ")


@query(f"""WITH w AS (SELECT list_filter(regexp_split_to_array('{_ASKED}', '\\s+'), lambda x: length(x) > 1) AS w), ph AS (SELECT DISTINCT lower(array_to_string(w[i : i + n - 1], ' ')) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS n), (SELECT unnest(range(1, 20)) AS i) WHERE i + n - 1 <= len(w)),
ego AS (SELECT * FROM ({_ENDS}) WHERE lower(name) IN (SELECT phrase FROM ph)), {fused_sql(text=QUESTION, k=80)},
hits AS (SELECT v.uuid, round(r.score * ({EFFECTIVE_SQL}), 9) AS s FROM rrf r JOIN kg_vec v USING (uuid) WHERE {VALID_SQL} AND (source_node_uuid IN (SELECT uuid FROM ego) OR target_node_uuid IN (SELECT uuid FROM ego)) AND round(r.score * ({EFFECTIVE_SQL}), 9) > 0 ORDER BY s DESC, uuid LIMIT 20),
{_episodes_sql(QUESTION.replace(',', ''), 20)}, {_CENTRES}, {_own('near', 'centres', 20)}
SELECT 'fact' AS kind, uuid, round(s, 6) AS score, recall_count + 1 AS recall_count FROM hits JOIN kg_vec USING (uuid) UNION ALL SELECT 'profile', uuid, NULL, NULL FROM ego UNION ALL SELECT 'episode', uuid, round(score, 6), NULL FROM ebm25 UNION ALL SELECT 'community', uuid, round(score, 6), NULL FROM near""".replace("\\\\", "\\"))
def hs_recall(g):
    """Deep recall: the question's phrases name entities, an ego search with decay finds facts and reinforces them, episodes and communities join."""
    from kairograph.operators import resolve
    from kairograph.operators.cognition import recall_reinforce

    ends = g.vec.select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("uuid")).distinct().select("uuid", F.concat(F.lit("Node "), F.upper("uuid")).alias("name"))
    phrases = g.spark.createDataFrame([(p,) for p in S.question_phrases(QUESTION)], "name string")
    ego = resolve.named(phrases, ends, g.alias)
    focus = sorted(r.uuid for r in ego.select("uuid").collect())  # at most one entity per phrase of the question
    config = S.SearchConfig(limit=20, candidates=80, decay=True, ego=tuple(focus))
    hits = S.hybrid(g.vec, QUESTION, vector(g), ntz(NOW), config).select("uuid", "score")
    facts = recall_reinforce(g.vec.join(F.broadcast(hits), "uuid"), hits.select("uuid"), ntz(NOW))
    none = F.lit(None)
    rows = facts.select(F.lit("fact").alias("kind"), "uuid", F.round("score", 6).alias("score"), F.col("recall_count").cast("long").alias("recall_count"))
    rows = rows.union(ego.select(F.lit("profile"), "uuid", none.cast("double"), none.cast("long")))
    rows = rows.union(S.search_episodes(g.episode, QUESTION, 20).select(F.lit("episode"), "uuid", F.round("score", 6), none.cast("long")))
    return rows.union(S.search_communities(_communities(g), vector(g), 20).select(F.lit("community"), "uuid", F.round("score", 6), none.cast("long")))


# -- resolution -------------------------------------------------------------------------------------------------------


#: every supplier is a mention: by alias, by name, by the vector of a known user, by another tenant's vector, by an object's name
_MENTION = {
    "mention_id": "s_suppkey",
    "group_id": "'u' || (s_suppkey % 8)",
    "name": "CASE s_suppkey % 5 WHEN 0 THEN 'U-' || s_suppkey WHEN 1 THEN '  user ' || s_suppkey WHEN 2 THEN 'Stranger ' || s_suppkey WHEN 3 THEN 'Nobody ' || s_suppkey ELSE 'object ' || cast(floor(s_suppkey / 8) as int) END",
    "vec": "CASE WHEN s_suppkey % 5 = 3 THEN s_suppkey + 1 ELSE s_suppkey END",
}
_MENTIONS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _MENTION.items()) + " FROM supplier"
_FOLD = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_RESOLVE_SQL = f"""WITH m AS ({_MENTIONS_SQL}), ents AS (SELECT group_id, uuid, name FROM kg_entity),
vecs AS (SELECT group_id, uuid, name_embedding AS v FROM kg_node), q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
k AS (SELECT *, {_FOLD.format('name')} AS key FROM m),
a AS (SELECT group_id, normalized_alias AS key, min(entity_uuid) AS by_alias FROM kg_alias GROUP BY 1, 2), b AS (SELECT group_id, {_FOLD.format('name')} AS key, min(uuid) AS by_name FROM ents GROUP BY 1, 2),
s AS (SELECT k.*, by_alias, by_name FROM k LEFT JOIN a USING (group_id, key) LEFT JOIN b USING (group_id, key)),
c AS (SELECT mention_id, v.uuid, round(list_cosine_similarity(q.e, v.v), 9) AS score FROM s JOIN q ON q.vec_id = s.vec JOIN vecs v ON v.group_id = s.group_id WHERE by_alias IS NULL AND by_name IS NULL AND list_cosine_similarity(q.e, v.v) >= 0.86),
r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, uuid)), d AS (SELECT mention_id, uuid, score FROM r WHERE k = 1 AND (second IS NULL OR score - second >= 0.05)),
resolved AS (SELECT s.*, coalesce(by_alias, by_name, d.uuid) AS canonical_uuid, CASE WHEN by_alias IS NOT NULL THEN 'alias_hit' WHEN by_name IS NOT NULL THEN 'exact_name' WHEN d.uuid IS NOT NULL THEN 'semantic_match' ELSE 'new' END AS resolution, d.score FROM s LEFT JOIN d USING (mention_id))"""


@query(f"{_RESOLVE_SQL} SELECT mention_id, canonical_uuid, resolution FROM resolved")
def er_resolve(g):
    return _resolved(g).select("mention_id", "canonical_uuid", "resolution")


def _resolved(g):
    from kairograph.operators import resolve

    m = g.raw("supplier").selectExpr(*[f"{e} AS {c}" for c, e in _MENTION.items()])
    vecs = g.raw("embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").cast("array<double>").alias("mention_embedding"))
    vectors = g.node.select("uuid", F.col("name_embedding").alias("embedding"))
    return resolve.resolve(m.join(vecs, "vec", "left").drop("vec"), g.entity.select("uuid", "group_id", "name"), g.alias, vectors=vectors)


@query(f"{_RESOLVE_SQL} SELECT group_id, name AS alias, key AS normalized_alias, canonical_uuid AS entity_uuid, score AS confidence FROM resolved WHERE resolution = 'semantic_match' AND (group_id, key) NOT IN (SELECT (group_id, normalized_alias) FROM kg_alias)")
def er_record_alias(g):
    from kairograph.operators import resolve

    return resolve.new_aliases(_resolved(g), g.alias).select("group_id", "alias", "normalized_alias", "entity_uuid", "confidence")


@query("""WITH batch(name) AS (VALUES ('User 1'), ('user  1'), ('Newcomer'), ('NEWCOMER'), ('Other')), k AS (SELECT min(name) AS name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key FROM batch GROUP BY 2),
e AS (SELECT trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key, min(uuid) AS uuid FROM kg_entity WHERE group_id = 'u1' GROUP BY 1) SELECT key, e.uuid IS NULL AS created, coalesce(e.uuid, 'new:' || key) AS uuid FROM k LEFT JOIN e USING (key)""".replace("\\\\", "\\"))
def er_upsert(g):
    from kairograph.functions.keys import name_key

    batch = g.spark.createDataFrame([("User 1",), ("user  1",), ("Newcomer",), ("NEWCOMER",), ("Other",)], "name string")
    names = batch.groupBy(name_key(F.col("name")).alias("key")).agg(F.min("name").alias("name"))
    known = g.entity.where("group_id = 'u1'").groupBy(name_key(F.col("name")).alias("key")).agg(F.min("uuid").alias("uuid"))
    return names.join(known, "key", "left").select("key", F.col("uuid").isNull().alias("created"), F.coalesce("uuid", F.concat(F.lit("new:"), "key")).alias("uuid"))


@query(r"""WITH m AS (SELECT uuid, first_value(uuid) OVER (PARTITION BY group_id, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) ORDER BY created_at, uuid) AS c FROM kg_entity)
SELECT f.uuid, coalesce(s.c, f.source_node_uuid) AS source_node_uuid, coalesce(o.c, f.target_node_uuid) AS target_node_uuid FROM kg_fact f LEFT JOIN m s ON s.uuid = f.source_node_uuid LEFT JOIN m o ON o.uuid = f.target_node_uuid""")
def er_merge_case_dups(g):
    from kairograph.operators import resolve

    to = resolve.duplicate_map(g.entity.select("uuid", "group_id", "name", "created_at"))
    return resolve.repoint(g.fact.select("uuid", "source_node_uuid", "target_node_uuid"), to, "source_node_uuid", "target_node_uuid").select("uuid", "source_node_uuid", "target_node_uuid")


@query(profiles_sql("(SELECT * FROM kg_fact WHERE status = 'active' AND invalid_at IS NULL)"))
def pf_refresh(g):
    from kairograph.operators import resolve

    return resolve.profiles(g.entity.select("uuid", "name"), g.fact.where(active()))


@query("""WITH s AS (SELECT source_node_uuid AS node, uuid, valid_at FROM kg_fact UNION SELECT target_node_uuid, uuid, valid_at FROM kg_fact), c AS (SELECT node, least(count(*), 30) AS n_facts, max(valid_at) AS last_seen FROM s GROUP BY node)
SELECT e.uuid, n_facts, e.mention_count + 1 AS mention_count, last_seen FROM kg_entity e JOIN c ON c.node = e.uuid""")
def pf_backfill(g):
    sides = g.fact.select(F.explode(F.array_distinct(F.array("source_node_uuid", "target_node_uuid"))).alias("uuid"), "valid_at")
    counts = sides.groupBy("uuid").agg(F.least(F.count("*"), F.lit(30)).alias("n_facts"), F.max("valid_at").alias("last_seen"))
    return g.entity.join(counts, "uuid").select("uuid", "n_facts", (F.col("mention_count") + 1).alias("mention_count"), "last_seen")


@query("""SELECT 'entity' AS kind, uuid AS key, name AS detail FROM kg_entity WHERE uuid = 'user:6' UNION ALL SELECT 'alias', normalized_alias, alias FROM kg_alias WHERE entity_uuid = 'user:6'
UNION ALL SELECT 'fact', uuid, fact FROM (SELECT * FROM kg_fact WHERE source_node_uuid = 'user:6' OR target_node_uuid = 'user:6' ORDER BY valid_at DESC, uuid LIMIT 20)""")
def pf_dossier(g):
    e = g.entity.where("uuid = 'user:6'").select(F.lit("entity").alias("kind"), F.col("uuid").alias("key"), F.col("name").alias("detail"))
    a = g.alias.where("entity_uuid = 'user:6'").select(F.lit("alias"), "normalized_alias", "alias")
    f = g.fact.where("source_node_uuid = 'user:6' or target_node_uuid = 'user:6'").orderBy(F.desc("valid_at"), "uuid").limit(20).select(F.lit("fact"), "uuid", "fact")
    return e.union(a).union(f)


# -- graph ------------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'x' || (n_nationkey), 'x' || (n_nationkey + 5) FROM nation WHERE n_nationkey < 20),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.node) SELECT node, min(root) AS component FROM reach GROUP BY node""")
def gr_components(g):
    c = g.raw("customer").selectExpr("'c' || c_custkey as a", "'n' || c_nationkey as b")
    s = g.raw("supplier").selectExpr("'s' || s_suppkey", "'n' || s_nationkey")
    x = g.raw("nation").where("n_nationkey < 20").selectExpr("'x' || n_nationkey", "'x' || (n_nationkey + 5)")
    return graph.components(c.union(s).union(x), "a", "b")


@query("""WITH e AS (SELECT source_node_uuid AS a, target_node_uuid AS b FROM kg_fact WHERE invalid_at IS NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.node), c AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node), r AS (SELECT c.*, degree, name FROM c JOIN d USING (node) LEFT JOIN kg_entity k ON k.uuid = c.node)
SELECT component, arg_min(node, (-degree, node)) AS head, count(*) AS n_members, string_agg(name, ', ' ORDER BY name) AS summary, arg_min(name, (-degree, node)) || ' community' AS community_name FROM r GROUP BY component HAVING count(*) >= 2""")
def gr_communities(g):
    return graph.communities(g.fact, g.entity.select("uuid", "name"))


@query("""WITH n AS (SELECT 'user:11' AS x UNION SELECT target_node_uuid FROM kg_fact WHERE source_node_uuid = 'user:11' UNION SELECT source_node_uuid FROM kg_fact WHERE target_node_uuid = 'user:11') SELECT f.uuid FROM kg_fact f WHERE source_node_uuid IN (SELECT x FROM n) AND target_node_uuid IN (SELECT x FROM n)""")
def gr_ego(g):
    from kairograph.operators.filters import inner_graph

    return inner_graph(g.fact.select("uuid", "source_node_uuid", "target_node_uuid"), graph.hops(g.fact, "user:11", 1).select("node")).select("uuid")


@query("""WITH nb AS (SELECT DISTINCT target_node_uuid AS n FROM kg_vec WHERE source_node_uuid = 'n9') SELECT uuid, CASE WHEN 'n9' IN (source_node_uuid, target_node_uuid) THEN 1 ELSE 2 END AS depth FROM kg_vec WHERE 'n9' IN (source_node_uuid, target_node_uuid) OR source_node_uuid IN (SELECT n FROM nb) OR target_node_uuid IN (SELECT n FROM nb)""")
def gr_distance(g):
    return S.hop_depth(g.vec, "n9")
