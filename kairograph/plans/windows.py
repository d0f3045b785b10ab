"""Window operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kairograph.operators import temporal
from kairograph.operators.filters import ntz

from .registry import query

SLOT_SQL = "group_id, source_node_uuid, name"


def slots_sql(source: str = "SELECT *, 'assert' AS op FROM kg_fact", SLOT_SQL: str = SLOT_SQL) -> str:
    """Slot closure by its definition: the run that each surviving row belongs to, then its edge."""
    return f"""r0 AS ({source}),
r1 AS (SELECT *, last_value(CASE WHEN op = 'assert' THEN target_node_uuid END IGNORE NULLS) OVER (PARTITION BY {SLOT_SQL} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r0 WHERE op IN ('assert', 'terminate')),
r2 AS (SELECT *, lag(op) OVER (PARTITION BY {SLOT_SQL} ORDER BY seq) AS before FROM r1 WHERE op = 'assert' OR prev IS NOT DISTINCT FROM target_node_uuid),
r3 AS (SELECT *, sum(CASE WHEN op = 'assert' AND (prev IS NULL OR prev <> target_node_uuid OR before = 'terminate') THEN 1 ELSE 0 END) OVER (PARTITION BY {SLOT_SQL} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM r2),
i0 AS (SELECT {SLOT_SQL}, island, target_node_uuid, arg_min(uuid, seq) FILTER (op = 'assert') AS uuid, arg_min(valid_at, seq) FILTER (op = 'assert') AS valid_at, arg_min(valid_at, seq) FILTER (op = 'terminate') AS ended, count(*) FILTER (op = 'assert') AS n_asserts FROM r3 WHERE island > 0 GROUP BY ALL),
i1 AS (SELECT *, lead(valid_at) OVER w AS next_at, lead(uuid) OVER w AS next, lag(uuid) OVER w AS prior, lag(ended) OVER w AS prior_ended FROM i0 WINDOW w AS (PARTITION BY {SLOT_SQL} ORDER BY island)),
slots AS (SELECT {SLOT_SQL}, target_node_uuid, uuid, valid_at, n_asserts, coalesce(ended, next_at) AS invalid_at, CASE WHEN ended IS NULL AND next IS NULL THEN 'active' ELSE 'superseded' END AS status, CASE WHEN ended IS NULL THEN next END AS superseded_by, CASE WHEN prior_ended IS NULL THEN prior END AS supersedes FROM i1)"""


SLOT_COLUMNS = ("group_id", "source_node_uuid", "name", "target_node_uuid", "uuid", "valid_at", "n_asserts", "invalid_at", "status", "superseded_by", "supersedes")


def closed(g):
    rows = g.fact.select("group_id", "source_node_uuid", "name", "target_node_uuid", "uuid", "seq", "valid_at")
    return temporal.close_slots(rows)


@query(f"WITH {slots_sql()} SELECT {', '.join(SLOT_COLUMNS)} FROM slots")
def win_slot_close(g):
    return closed(g).select(*SLOT_COLUMNS)


@query("""WITH l(list_id, uuid, score) AS (SELECT 0, uuid, confidence FROM kg_vec UNION ALL SELECT 1, uuid, 1 - confidence FROM kg_vec), r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, uuid) - 1 AS rank FROM l)
SELECT list_id::INTEGER AS list_id, uuid, rank::INTEGER AS rank FROM r WHERE rank < 50""")
def win_rrf_rank(g):
    from kairograph.operators.search import ranked

    a = g.vec.select("uuid", F.col("confidence").alias("score"))
    b = g.vec.select("uuid", (1 - F.col("confidence")).alias("score"))
    best = lambda rows: rows.orderBy(F.desc("score"), "uuid").limit(50)  # noqa: E731  a top-k per partition comes before the rank
    return ranked(best(a), 0).union(ranked(best(b), 1))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_node_uuid, name, target_node_uuid ORDER BY valid_at DESC, uuid) AS k FROM kg_fact WHERE valid_at <= TIMESTAMP '2024-01-15' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-15'))
SELECT source_node_uuid, name, target_node_uuid, uuid, valid_at FROM r WHERE k = 1""")
def win_latest_per_slot(g):
    return temporal.latest_per_slot(g.fact, ntz("2024-01-15")).select("source_node_uuid", "name", "target_node_uuid", "uuid", "valid_at")


@query("SELECT uuid, lag(uuid) OVER w AS prior_uuid, length(lag(content) OVER w) AS prior_length FROM kg_episode WINDOW w AS (PARTITION BY group_id ORDER BY reference_time, uuid)")
def win_prior_text(g):
    w = Window.partitionBy("group_id").orderBy("reference_time", "uuid")
    return g.episode.select("uuid", F.lag("uuid").over(w).alias("prior_uuid"), F.length(F.lag("content").over(w)).cast("long").alias("prior_length"))


@query("SELECT group_id, uuid, n FROM (SELECT group_id, uuid, row_number() OVER (PARTITION BY group_id ORDER BY reference_time DESC, uuid DESC)::INTEGER AS n FROM kg_episode) WHERE n <= 8")
def win_recent_n(g):
    n = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("reference_time"), F.desc("uuid")))
    return g.episode.select("group_id", "uuid", n.alias("n")).where("n <= 8")


@query("""WITH r AS (SELECT group_id, name, uuid, confidence, lead(confidence) OVER w AS second, row_number() OVER w AS k FROM kg_fact WINDOW w AS (PARTITION BY group_id, name ORDER BY confidence DESC, uuid))
SELECT group_id, name, uuid, round(confidence - second, 6) AS margin, coalesce(confidence - second >= 0.05, true) AS clear FROM r WHERE k = 1""")
def win_margin(g):
    w = Window.partitionBy("group_id", "name").orderBy(F.desc("confidence"), "uuid")
    r = g.fact.select("group_id", "name", "uuid", "confidence", F.lead("confidence").over(w).alias("second"), F.row_number().over(w).alias("k"))
    margin = F.col("confidence") - F.col("second")
    return r.where("k = 1").select("group_id", "name", "uuid", F.round(margin, 6).alias("margin"), F.coalesce(margin >= 0.05, F.lit(True)).alias("clear"))


@query("""WITH q(id, text) AS (VALUES (1, 'the user bought object three'), (2, 'hello'), (3, 'a b')), t AS (SELECT id, string_split(text, ' ') AS w FROM q),
n AS (SELECT id, unnest([3, 2, 1]) AS size, w FROM t), p AS (SELECT id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM n)
SELECT id, size::INTEGER AS size, pos::INTEGER AS pos, array_to_string(w[pos : pos + size - 1], ' ') AS phrase FROM p""")
def win_ngram(g):
    q = g.spark.createDataFrame([(1, "the user bought object three"), (2, "hello"), (3, "a b")], "id int, text string").withColumn("w", F.split("text", " "))
    n = q.select("id", "w", F.explode(F.array(F.lit(3), F.lit(2), F.lit(1))).alias("size"))
    p = n.where("size(w) >= size").select("id", "w", "size", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("pos"))
    return p.select("id", "size", "pos", F.array_join(F.slice("w", F.col("pos"), F.col("size")), " ").alias("phrase"))


@query("""SELECT uuid, row_number() OVER w AS step, lead(uuid) OVER w AS next_uuid, lag(uuid) OVER w AS prior_uuid FROM kg_fact WHERE source_node_uuid = 'user:5' WINDOW w AS (ORDER BY coalesce(valid_at, created_at), uuid)""")
def win_timeline(g):
    w = Window.partitionBy("source_node_uuid").orderBy(F.coalesce("valid_at", "created_at"), "uuid")
    rows = g.fact.where("source_node_uuid = 'user:5'")
    return rows.select("uuid", F.row_number().over(w).cast("long").alias("step"), F.lead("uuid").over(w).alias("next_uuid"), F.lag("uuid").over(w).alias("prior_uuid"))
