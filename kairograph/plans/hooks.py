"""Model hooks over whole tables, with their offline forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kairograph.functions.text import TRANSITION_CUES
from kairograph.sources import hooks, offline

from .registry import query
from .scalars import texts

_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: length(x) > 2))"
_CUES = " OR ".join(f"contains(lower(content), '{c}')" for c in TRANSITION_CUES)


@query(f"""WITH w AS (SELECT uuid, content, list(content) OVER (PARTITION BY group_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM kg_text), u AS (SELECT uuid, content, c, unnest(range(len(c))) AS k FROM w)
SELECT uuid, string_agg(k::VARCHAR, ',' ORDER BY k) AS contradicted FROM u WHERE ({_CUES}) AND len(list_intersect({_WORDS.format('content')}, {_WORDS.format('c[k + 1]')})) > 0 GROUP BY uuid""")
def udf_judge(g):
    """Each text against the three before it in its tenant."""
    w = Window.partitionBy("group_id").orderBy("seq").rowsBetween(-3, -1)
    rows = texts(g).withColumn("before", F.collect_list("content").over(w))
    found = rows.select(F.col("id").alias("uuid"), hooks.judge_column(offline.CueJudge, F.col("content"), F.col("before")).alias("k"))
    return found.where(F.size("k") > 0).select("uuid", F.array_join("k", ",").alias("contradicted"))


@query("""WITH p AS (SELECT DISTINCT lower(relation) AS predicate FROM kg_fact), k AS (SELECT DISTINCT canonical FROM kg_frame)
SELECT predicate, (SELECT min(canonical) FROM k WHERE split_part(canonical, '_', 1) = split_part(predicate, '_', 1)) AS canonical FROM p""")
def udf_frame_classifier(g):
    """Every predicate of the facts against the known frames."""
    known = sorted(r.canonical for r in g.frame.select("canonical").distinct().collect())  # the frames of the catalogue
    rows = g.fact.select(F.lower("relation").alias("predicate")).distinct()
    return rows.select("predicate", hooks.classify_column(offline.StemClassifier, F.col("predicate"), F.col("predicate"), known).alias("canonical"))


_HEADS = "WITH r AS (SELECT source_node_uuid AS node, fact, row_number() OVER (PARTITION BY source_node_uuid ORDER BY valid_at DESC, uuid) AS k FROM kg_fact), h AS (SELECT node, list(fact ORDER BY k) AS facts FROM r WHERE k <= 8 GROUP BY node)"


def _heads(g):
    """node, facts: the eight newest facts of every subject."""
    rank = F.row_number().over(Window.partitionBy("source_node_uuid").orderBy(F.desc("valid_at"), "uuid"))
    rows = g.fact.select(F.col("source_node_uuid").alias("node"), "fact", rank.alias("k")).where("k <= 8")
    return rows.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "fact"))), lambda x: x["fact"]).alias("facts"))


@query(f"{_HEADS} SELECT node, array_to_string(facts[1:5], '; ') || CASE WHEN len(facts) > 5 THEN '; and ' || (len(facts) - 5) || ' related' ELSE '' END AS text FROM h")
def udf_synthesizer(g):
    return _heads(g).select("node", hooks.synthesize_column(offline.ListSynthesizer, F.col("facts")).alias("text"))


@query(f"{_HEADS} SELECT e.uuid, e.name || ': ' || array_to_string(facts[1:3], '; ') AS summary FROM h JOIN kg_entity e ON e.uuid = h.node")
def udf_summarizer(g):
    rows = g.entity.select("uuid", "name").join(_heads(g), F.col("uuid") == F.col("node"))
    return rows.select("uuid", hooks.summarize_column(offline.HeadSummarizer, F.col("name"), F.col("facts")).alias("summary"))


@query("""WITH s AS (SELECT c_mktsegment AS seg, c_nationkey AS nation, list('User ' || c_custkey ORDER BY c_custkey) AS names FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 4 GROUP BY 1, 2)
SELECT c_custkey, list_position(names, 'User ' || c_custkey) - 1 AS picked FROM customer JOIN s ON s.seg = c_mktsegment AND s.nation = c_nationkey WHERE len(names) > 1""")
def udf_tie_breaker(g):
    """Each customer's mention against the first four customers of its segment and nation: the one with its own number, if it is among them."""
    k = F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey"))
    rows = g.raw("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    names = rows.withColumn("k", k).where("k <= 4").groupBy("c_mktsegment", "c_nationkey").agg(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda c: F.concat(F.lit("User "), c)).alias("names"))
    asked = rows.join(names.where(F.size("names") > 1), ["c_mktsegment", "c_nationkey"])
    picked = hooks.pick_column(offline.OverlapTieBreaker, F.col("c_custkey").cast("string"), F.lit(""), F.col("names"))
    return asked.select("c_custkey", picked.cast("long").alias("picked"))
