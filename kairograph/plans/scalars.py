"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions import decay, keys, text, vectors
from kairograph.operators import graph
from kairograph.operators.filters import ntz
from kairograph.sources.testgraph import NOW

from .registry import query

NAMES_SQL = "SELECT id, name FROM kg_name"


def _names(g):
    return g.table("kg_name")


@query("""WITH a AS (SELECT uuid, fact_embedding AS v FROM kg_vec), q AS (SELECT v AS qv FROM a WHERE uuid = 'vec:7') SELECT uuid, round(list_cosine_similarity(v, qv), 6) AS similarity FROM a, q""")
def sc_cosine(g):
    a = g.vec.select("uuid", F.col("fact_embedding").alias("v"))
    q = a.where("uuid = 'vec:7'").select(F.col("v").alias("qv"))  # one row
    return a.crossJoin(F.broadcast(q)).select("uuid", F.round(vectors.cosine(F.col("v"), F.col("qv")), 6).alias("similarity"))


@query("""WITH t AS (SELECT uuid, unnest(list_filter(regexp_split_to_array(lower(fact), '\\s+'), lambda x: x <> '')) AS tok FROM kg_fact),
h AS (SELECT uuid, ('0x' || substr(sha256(tok), 1, 8))::BIGINT % 16 AS up, ('0x' || substr(sha256(tok), 9, 8))::BIGINT % 16 AS down FROM t),
d AS (SELECT uuid, i, count_if(up = i) - count_if(down = i) AS x FROM h, range(16) r(i) GROUP BY uuid, i), n AS (SELECT uuid, sqrt(sum(x * x)) AS n FROM d GROUP BY uuid)
SELECT uuid, string_agg(round(CASE WHEN n > 0 THEN 1000 * x / n ELSE 0 END)::BIGINT::VARCHAR, ',' ORDER BY i) AS vector FROM d JOIN n USING (uuid) GROUP BY uuid""".replace("\\\\", "\\"))
def sc_hash_embed(g):
    v = vectors.hash_embedding(F.col("fact"), 16)
    return g.fact.select("uuid", F.array_join(F.transform(v, lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("vector"))


@query(rf"""WITH n AS ({NAMES_SQL}) SELECT id, trim(regexp_replace(replace(lower(regexp_replace(name, '[^\p{{L}}\p{{N}}_\s''\-]', ' ', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm FROM n""")
def sc_normalize_alias(g):
    return _names(g).select("id", keys.normalize_alias(F.col("name")).alias("norm"))


@query(rf"""WITH n AS ({NAMES_SQL}) SELECT id, trim(regexp_replace(replace(lower(name), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm FROM n""")
def sc_name_key(g):
    return _names(g).select("id", keys.name_key(F.col("name")).alias("norm"))


@query(f"""WITH n AS ({NAMES_SQL}) SELECT id, trim(regexp_replace(regexp_replace(lower(trim(name)), '^the ', ''), '[^a-z0-9]+', ' ', 'g')) AS norm FROM n""")
def sc_normalize_name_js(g):
    return _names(g).select("id", keys.normalize_label(F.col("name")).alias("norm"))


@query("SELECT p_partkey, levenshtein(lower(p_name), lower(p_type))::INTEGER AS distance FROM part")
def sc_levenshtein(g):
    return g.raw("part").select("p_partkey", F.levenshtein(F.lower("p_name"), F.lower("p_type")).alias("distance"))


@query()
def sc_alias_groups(g):
    names = g.entity.where("uuid like 'user:%'").select("group_id", "uuid", keys.normalize_label(F.col("name")).alias("norm"))
    return graph.alias_groups(names)


_QSQL = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{"by":"' || event_type || '","season":"' || (user_id % 4) || '"}' WHEN 1 THEN '{}' WHEN 2 THEN NULL ELSE '{"season":"' || (user_id % 4) || '"}' END AS j FROM events"""


def _qualified(g):
    """Qualifiers of every event: two in either order, none, null, one."""
    season, by = F.struct(F.lit("season").alias("k"), (F.col("user_id") % 4).cast("string").alias("v")), F.struct(F.lit("by").alias("k"), F.col("event_type").alias("v"))
    two = F.map_from_entries(F.when(F.col("event_id") % 8 == 0, F.array(season, by)).otherwise(F.array(by, season)))
    m = F.col("event_id") % 4
    q = F.when(m == 0, two).when(m == 1, F.create_map().cast("map<string,string>")).when(m == 3, F.map_from_entries(F.array(season)))
    return g.raw("events").select(F.col("event_id").alias("id"), q.alias("q")).withColumn("qhash", keys.qualifier_hash(keys.canonical_qualifiers(F.col("q"))))


@query(f"WITH q AS ({_QSQL}) SELECT id, CASE WHEN coalesce(j, '') IN ('', '{{}}') THEN '' ELSE substr(sha256(j), 1, 16) END AS qhash FROM q")
def sc_qhash(g):
    return _qualified(g).select("id", "qhash")


@query(f"WITH q AS ({_QSQL}), h AS (SELECT id, CASE WHEN coalesce(j, '') IN ('', '{{}}') THEN '' ELSE substr(sha256(j), 1, 16) END AS h FROM q) SELECT id, 'g::Ann::lives_in::Paris' || CASE WHEN h = '' THEN '' ELSE '::' || h END AS fact_key FROM h")
def sc_fact_key(g):
    return _qualified(g).select("id", keys.fact_key(F.lit(" g"), F.lit("Ann "), F.lit("Lives_In"), F.lit("Paris"), F.col("qhash")).alias("fact_key"))


@query(f"WITH q AS ({_QSQL}), h AS (SELECT id, CASE WHEN coalesce(j, '') IN ('', '{{}}') THEN '' ELSE substr(sha256(j), 1, 16) END AS h FROM q) SELECT id, 'g::Ann::lives_in::' || h AS slot_key FROM h")
def sc_slot_key(g):
    return _qualified(g).select("id", keys.slot_key(F.lit("g"), F.lit("Ann"), F.lit("LIVES_IN"), F.col("qhash")).alias("slot_key"))


@query(f"""WITH n AS ({NAMES_SQL}), s AS (SELECT id, lower(trim(regexp_replace(name, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS v FROM n) SELECT id, CASE WHEN v = '' THEN 'unknown' ELSE v END AS snake FROM s""")
def sc_snake_case(g):
    return _names(g).select("id", keys.snake_case(F.col("name")).alias("snake"))


@query(f"""WITH n AS ({NAMES_SQL}), s AS (SELECT id, trim(regexp_replace(replace(lower(name), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_') AS v FROM n) SELECT id, left(CASE WHEN v = '' THEN 'self_model' ELSE v END, 80) AS slug FROM s""")
def sc_slug(g):
    return _names(g).select("id", keys.slug(F.col("name")).alias("slug"))


@query(f"""WITH n AS ({NAMES_SQL}), s AS (SELECT id, name, trim(regexp_replace(replace(lower(name), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_') AS v FROM n)
SELECT id, 'trait_' || left(CASE WHEN v = '' THEN 'self_model' ELSE v END, 80) || '_' || substr(sha1('grp' || chr(0) || name), 1, 12) AS uuid FROM s""")
def sc_stable_uuid(g):
    return _names(g).select("id", keys.stable_uuid("trait", F.lit("grp"), F.col("name")).alias("uuid"))


@query("""WITH h AS (SELECT id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('pack:g:entity:' || name)) AS h FROM kg_name)
SELECT id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', ('0x' || substr(h, 17, 1))::INTEGER % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS uuid FROM h""")
def sc_uuid5(g):
    return _names(g).select("id", keys.uuid5_url(F.concat(F.lit("pack:g:entity:"), "name")).alias("uuid"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS parsed FROM events""")
def sc_parse_iso(g):
    """Every event's time as one of six spellings: zoned, naive, impossible, words, with an offset, empty."""
    plain = lambda sep: F.date_format("ts", f"yyyy-MM-dd{sep}HH:mm:ss")
    m = F.col("event_id") % 6
    s = F.when(m == 0, F.concat(plain("'T'"), F.lit("Z"))).when(m == 1, plain(" ")).when(m == 2, "2024-02-30").when(m == 3, "soon").when(m == 4, F.concat(plain("'T'"), F.lit("+02:00"))).otherwise("")
    rows = g.raw("events").select(F.col("event_id").alias("id"), s.alias("s"))
    zoned = F.when(F.col("s").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.col("s")).otherwise(F.concat("s", F.lit("Z")))  # naive means UTC
    return rows.select("id", F.convert_timezone(F.expr("current_timezone()"), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz")).alias("parsed"))


@query("SELECT uuid, floor(epoch(valid_at))::BIGINT AS seconds FROM kg_fact")
def sc_as_aware(g):
    utc = F.convert_timezone(F.lit("UTC"), F.expr("current_timezone()"), F.col("valid_at")).cast("timestamp")
    return g.fact.select("uuid", F.unix_seconds(utc).alias("seconds"))


_KLASS = "CASE WHEN lower(trim(coalesce(memory_class, ''))) = '' THEN 'objective' ELSE lower(trim(memory_class)) END"
PROTECTED_SQL = f"({_KLASS} IN ('constraint','style','preference','goal','trait','self_model','consolidated','archived_summary') OR stability = 'consolidated')"
DAYS_SQL = f"greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(coalesce(last_recalled_at, last_reinforced_at, valid_at, created_at))) / 86400))"
VITALITY_SQL = f"CASE WHEN {PROTECTED_SQL} THEN least(1.0, greatest(0.0, decay_score)) ELSE least(1.0, greatest(0.0, decay_score - {DAYS_SQL} * 0.01)) END"
EFFECTIVE_SQL = f"""CASE WHEN {PROTECTED_SQL} THEN least(1.0, greatest(0.0, confidence)) ELSE least(1.0, greatest(0.0, least(1.0, greatest(0.0, confidence)) * ({VITALITY_SQL})
 + least(0.25, ln(greatest(1, reinforcement_count)) * 0.03) + least(0.2, greatest(0, recall_count) * 0.04))) END"""


@query(f"SELECT uuid, round({VITALITY_SQL}, 6)::DOUBLE AS vitality FROM kg_fact")
def sc_linear_vitality(g):
    v = decay.linear_vitality(F.col("decay_score"), F.col("memory_class"), F.col("stability"), decay.last_touched(), ntz(NOW))
    return g.fact.select("uuid", F.round(v.cast("double"), 6).alias("vitality"))


@query(f"SELECT uuid, round({EFFECTIVE_SQL}, 6)::DOUBLE AS effective FROM kg_fact")
def sc_effective_confidence(g):
    return g.fact.select("uuid", F.round(decay.effective_confidence(ntz(NOW)), 6).alias("effective"))


@query(f"SELECT uuid, {PROTECTED_SQL} AS protected FROM kg_fact")
def sc_is_protected(g):
    return g.fact.select("uuid", decay.is_protected(F.col("memory_class"), F.col("stability")).alias("protected"))


@query("SELECT uuid, CASE stability WHEN 'reinforced' THEN 90.0 WHEN 'persistent' THEN 400.0 WHEN 'consolidated' THEN 1e9 ELSE 30.0 END::DOUBLE AS days FROM kg_fact")
def sc_half_life(g):
    return g.fact.select("uuid", decay.half_life(F.col("stability"), {"persistent": 400.0, "consolidated": 1e9}).alias("days"))


TEXTS_SQL = "SELECT uuid, content FROM kg_text"


def texts(g):
    """Every turn of ``conversations``, led by a saying."""
    return g.text.select(F.col("uuid").alias("id"), "group_id", "seq", "reference_time", "content")


_LEX_SQL = ", ".join(f"('{w}', '{e}', {p}::DOUBLE, {x}::DOUBLE)" for w, e, p, x in text.AFFECT)


def affect_sql(source: str = TEXTS_SQL) -> str:
    return f"""lex(word, emotion, polarity, weight) AS (VALUES {_LEX_SQL}), texts(id, content) AS ({source}),
tok AS (SELECT id, lower(unnest(regexp_extract_all(content, '[a-zA-Z'']+'))) AS word FROM texts), bag AS (SELECT id, emotion, round(sum(weight), 9) AS w, round(sum(polarity * weight), 9) AS pw FROM tok JOIN lex USING (word) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, emotion) AS k FROM bag)"""


AFFECT_SQL = affect_sql()


@query(f"WITH {AFFECT_SQL} SELECT id, emotion, round(pw / w, 3) AS polarity, round(least(1.0, w / 2), 3) AS intensity FROM best WHERE k = 1")
def sc_score_affect(g):
    from kairograph.operators.cognition import affect

    return affect(texts(g), "id")


@query(f"WITH {AFFECT_SQL} SELECT id, emotion, w, pw FROM bag")
def agg_affect_bag(g):
    words = texts(g).select("id", F.explode(F.regexp_extract_all("content", F.lit("[a-zA-Z']+"), 0)).alias("x")).select("id", F.lower("x").alias("word"))
    return words.join(F.broadcast(text.affect_lexicon(g.spark)), "word").groupBy("id", "emotion").agg(F.round(F.sum("weight"), 9).alias("w"), F.round(F.sum(F.col("polarity") * F.col("weight")), 9).alias("pw"))


@query(f"WITH t(id, content) AS ({TEXTS_SQL}) SELECT id, regexp_matches(content, '(?i)\\b(?:I think|I believe|I feel(?: like)?|feels like|seems(?: like)?|might be|I suspect|in my opinion|I guess|probably)\\b') AS belief FROM t")
def sc_looks_like_belief(g):
    return texts(g).select("id", text.looks_like_belief(F.col("content")).alias("belief"))


@query(rf"""WITH p AS (SELECT uuid AS id, content, lag(content) OVER (PARTITION BY group_id ORDER BY seq) AS prior FROM kg_text),
c AS (SELECT *, len(regexp_extract_all(content, '\?')) AS qs, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS n,
 len(list_intersect(list_distinct(list_filter(list_transform(regexp_extract_all(content, '[a-zA-Z'']+'), lambda x: lower(x)), lambda x: length(x) > 3)), list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(prior, ''), '[a-zA-Z'']+'), lambda x: lower(x)), lambda x: length(x) > 3)))) AS overlap FROM p)
SELECT id, CASE WHEN content = '' THEN 'one_off_query' WHEN regexp_matches(content, '(?i)\b(?:best|optimal|optimi[sz]e|improve|better|tune|refine|tweak|sharper|tighter)\b') THEN 'optimization_request' WHEN qs = 0 AND n >= 60 THEN 'narrative_share'
 WHEN coalesce(prior, '') <> '' AND overlap >= 3 AND qs >= 1 THEN 'iterative_refinement' WHEN coalesce(prior, '') <> '' AND overlap >= 2 AND n < 40 THEN 'clarification' ELSE 'one_off_query' END AS label FROM c""")
def sc_classify_episode(g):
    from pyspark.sql import Window

    rows = texts(g).withColumn("prior", F.lag("content").over(Window.partitionBy("group_id").orderBy("seq")))
    return rows.select("id", text.classify_episode(F.col("content"), F.col("prior")).alias("label"))


_GOAL_SQL = ", ".join("'{}'".format(p.replace("'", "''")) for p in text.GOALS)


@query(rf"""WITH t(id, content) AS ({TEXTS_SQL}), f AS (SELECT id, k, unnest(regexp_extract_all(content, p, 1)) AS x FROM t, (SELECT unnest([{_GOAL_SQL}]) AS p, unnest(range({len(text.GOALS)})) AS k)),
c AS (SELECT id, trim(regexp_replace(trim(x), '\s+', ' ', 'g'), ' ,.;:') AS phrase FROM f) SELECT id, phrase FROM c WHERE length(phrase) BETWEEN 8 AND 200""")
def sc_goal_phrases(g):
    return texts(g).select("id", F.explode(text.goal_phrases(F.col("content"))).alias("phrase"))


GOAL_CLEAN = " AND ".join(["length(x) >= 4", "x NOT IN ({})".format(", ".join(f"'{n}'" for n in text.NO_GOALS)), *[f"x <> '{p.rstrip('_')}' AND NOT starts_with(x, '{p}')" for p in text.BAD_GOAL_PREFIXES]])


@query(f"SELECT id, {GOAL_CLEAN} AS clean FROM (SELECT id, lower(trim(name)) AS x FROM kg_goal_name)")
def sc_clean_goal_name(g):
    return g.table("kg_goal_name").select("id", text.clean_goal_name(F.col("name")).alias("clean"))


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 2 THEN '[' || event_id || ', 2]' WHEN 4 THEN '[{"a": ' || event_id || '}]' ELSE '{"a": ' || event_id || '}' END AS json FROM events""")
def sc_parse_json_loose(g):
    """JSON in a fence, within noise, as a list, missing, and as a list within noise."""
    m, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    s = F.when(m == 0, F.concat(F.lit('```json\n{"a": '), n, F.lit("}\n```"))).when(m == 1, F.concat(F.lit('noise {"a": '), n, F.lit("} tail"))).when(m == 2, F.concat(F.lit("["), n, F.lit(", 2]"))).when(m == 3, "none").otherwise(F.concat(F.lit('x [{"a": '), n, F.lit("}] y")))
    rows = g.raw("events").select(F.col("event_id").alias("id"), s.alias("s"))
    bare = F.regexp_replace("s", r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    cut = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    # a list that holds records is found by its own bracket
    listed = F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit(""))
    cut = F.when(F.get_json_object(cut, "$").isNotNull(), cut).otherwise(listed)
    ok = F.get_json_object(cut, "$").isNotNull()
    return rows.select("id", F.when(ok, cut).alias("json"))


@query("""WITH r AS (SELECT source_node_uuid AS node, fact, row_number() OVER (PARTITION BY source_node_uuid ORDER BY valid_at DESC, uuid) AS k, count(*) OVER (PARTITION BY source_node_uuid) AS n FROM kg_fact)
SELECT node, string_agg(fact, '; ' ORDER BY k) FILTER (k <= 5) || CASE WHEN any_value(n) > 5 THEN '; and ' || (any_value(n) - 5) || ' related' ELSE '' END AS summary FROM r GROUP BY node""")
def sc_cluster_summary(g):
    from kairograph.operators.cognition import first_facts

    rows = g.fact.select(F.col("source_node_uuid").alias("node"), "fact", "valid_at", "uuid")
    return first_facts(rows, ["node"], [F.desc("valid_at"), F.col("uuid")]).select("node", "summary")


@query()
def sc_entity_regex(g):
    """Names of all documents.  Word boundaries see every letter, which the SQL engine's do not, so a test recomputes the rows."""
    return g.raw("documents").select("doc_id", F.array_join(F.array_sort(text.entity_names(F.col("text"))), "|").alias("names"))


SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), ';\s*', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH s AS (SELECT uuid AS id, {SENTENCES_SQL.format('content')} AS ss FROM kg_text), p AS (SELECT id, unnest(range(len(ss))) AS pos, ss FROM s) SELECT id, pos::INTEGER AS pos, ss[pos + 1] AS sentence FROM p")
def sc_sentence_split(g):
    return texts(g).select("id", F.posexplode(text.sentences(F.col("content"))).alias("pos", "sentence"))


@query("SELECT uuid, regexp_replace(uuid, '^[^:]+:', '') AS key, regexp_replace('entity:⟨' || uuid || '⟩', '^[a-z_]+:⟨?([^⟩]*)⟩?$', '\\1') AS stripped FROM kg_entity")
def sc_recordid_strip(g):
    record = F.concat(F.lit("entity:⟨"), "uuid", F.lit("⟩"))
    return g.entity.select("uuid", F.regexp_replace("uuid", "^[^:]+:", "").alias("key"), F.regexp_replace(record, "^[a-z_]+:⟨?([^⟩]*)⟩?$", "$1").alias("stripped"))


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"


@query(f"""SELECT uuid, '{{"valid_at":"' || {_ISO.format('valid_at')} || '"' || coalesce(',"invalid_at":"' || {_ISO.format('invalid_at')} || '"', '') || ',"episodes":["' || array_to_string(episodes, '","') || '"],"score":' || (seq % 100) || '}}' AS json FROM kg_fact""")
def sc_json_safe(g):
    return g.fact.withColumn("score", F.col("seq") % 100).select("uuid", F.to_json(F.struct("valid_at", "invalid_at", "episodes", "score"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))


def profiles_sql(source: str, top: int = 30) -> str:
    return f"""WITH s AS (SELECT unnest(list_distinct([source_node_uuid, target_node_uuid])) AS node, fact, valid_at, uuid AS fact_uuid FROM {source}), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY valid_at DESC, fact_uuid) AS r FROM s),
f AS (SELECT e.uuid, e.name, r.r, r.fact, length(e.name) + 1 + sum(length(r.fact) + 2) OVER (PARTITION BY e.uuid ORDER BY r.r) AS size FROM r JOIN kg_entity e ON e.uuid = r.node WHERE r.r <= {top})
SELECT uuid, count(*) AS n_facts, any_value(name) || coalesce(': ' || string_agg(fact, '; ' ORDER BY r) FILTER (size <= 800) || '.', '') AS profile FROM f GROUP BY uuid"""


@query(profiles_sql("kg_fact"))
def sc_summary_compose(g):
    from kairograph.operators.resolve import profiles

    return profiles(g.entity.select("uuid", "name"), g.fact)


@query("""SELECT uuid, array_to_string(list_filter(episodes, lambda x: x <> 'ep:3'), ',') AS removed, array_to_string(list_sort(list_distinct(list_concat(episodes, ['ep:3']))), ',') AS added, list_has_any(episodes, ['ep:3']) AS inside FROM kg_fact""")
def sc_array_functions(g):
    three = F.array(F.lit("ep:3"))
    return g.fact.select("uuid", F.array_join(F.array_remove("episodes", "ep:3"), ",").alias("removed"), F.array_join(F.array_sort(F.array_distinct(F.concat("episodes", three))), ",").alias("added"), F.arrays_overlap("episodes", three).alias("inside"))


@query("SELECT uuid, greatest(valence, intensity) AS top, round(ln(1 + reinforcement_count), 6) AS logged, floor(value)::BIGINT AS whole, least(1.0, greatest(0.0, valence)) AS clipped FROM kg_fact")
def sc_math_functions(g):
    return g.fact.select("uuid", F.greatest("valence", "intensity").alias("top"), F.round(F.log1p("reinforcement_count"), 6).alias("logged"), F.floor("value").alias("whole"), decay.clip01(F.col("valence")).alias("clipped"))


@query("""SELECT uuid, json_extract_string(attributes, '$.color') AS color, json_extract_string(attributes, '$.score')::BIGINT + 1 AS score, 'extra' AS added FROM kg_fact""")
def sc_object_functions(g):
    bag = F.map_concat(F.map_filter(F.from_json("attributes", "map<string,string>"), lambda k, v: k != "score"), F.create_map(F.lit("added"), F.lit("extra"), F.lit("score"), (F.get_json_object("attributes", "$.score").cast("long") + 1).cast("string")))
    return g.fact.select("uuid", bag.alias("b")).select("uuid", F.col("b")["color"].alias("color"), F.col("b")["score"].cast("long").alias("score"), F.col("b")["added"].alias("added"))


@query("SELECT uuid, floor(epoch(coalesce(invalid_at, valid_at)))::BIGINT AS at_seconds FROM kg_fact")
def sc_time_functions(g):
    utc = F.convert_timezone(F.lit("UTC"), F.expr("current_timezone()"), F.coalesce("invalid_at", "valid_at")).cast("timestamp")
    return g.fact.select("uuid", F.unix_seconds(utc).alias("at_seconds"))
