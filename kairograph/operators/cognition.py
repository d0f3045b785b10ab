"""Cognition passes: set-based rewrites of the fact, entity and episode tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.functions.decay import clip01, effective_confidence, memory_class
from kairograph.functions.keys import slug, snake_case, stable_uuid
from kairograph.functions.text import TERM_STOPWORDS, affect_lexicon, classify_episode, clean_goal_name, goal_phrases, looks_like_belief

from .filters import active

#: Fixed values.
REINFORCED_AT, PERSISTENT_AT, PERSISTENT_DAYS = 3, 7, 7
CONSOLIDATE_EPISODES, CONSOLIDATE_DAYS = 8, 14
STAGNANT_LEAST, STAGNANT_SCAN = 5, 120
ASSOCIATION_DIVISOR, WEIGHT_CAP = 12, 4
TRAIT_LEAST, TRAIT_EDGES, TRAIT_CANDIDATES = 2, 3, 12
PATTERN_WINDOW, PATTERN_LEAST = 8, 5


def affect(texts: DataFrame, key: str = "uuid", text: str = "content") -> DataFrame:
    """key, emotion, polarity, intensity of texts with a signal; ties go to the first emotion by name."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit("[a-zA-Z']+"), 0)).alias("w")).select(key, F.lower("w").alias("word"))
    hits = words.join(F.broadcast(affect_lexicon(texts.sparkSession)), "word")
    bags = hits.groupBy(key, "emotion").agg(F.round(F.sum("weight"), 9).alias("w"), F.round(F.sum(F.col("polarity") * F.col("weight")), 9).alias("pw"))
    best = bags.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("o"), "emotion", "w", "pw")).alias("b"))
    return best.select(key, F.col("b.emotion").alias("emotion"), F.round(F.col("b.pw") / F.col("b.w"), 3).alias("polarity"), F.round(F.least(F.lit(1.0), F.col("b.w") / 2), 3).alias("intensity"))


def tag_affect(edges: DataFrame, moods: DataFrame, order: str = "reference_time") -> DataFrame:
    """uuid, valence of the latest supporting episode, intensity as the maximum.  ``moods``: episode, time, polarity, intensity."""
    rows = edges.select("uuid", F.explode("episodes").alias("episode")).join(moods, "episode")
    return rows.groupBy("uuid").agg(F.max_by("polarity", F.struct(order, "episode")).alias("valence"), F.max("intensity").alias("intensity"))


def beliefs(edges: DataFrame, episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges that become beliefs: cited by a belief-bearing episode that mentions their subject, active, not yet a belief."""
    bearing = episodes.where(looks_like_belief(F.col("content"))).select(F.col("uuid").alias("episode"))
    cited = edges.where(active() & ~F.coalesce("is_belief", F.lit(False))).select("uuid", "source_node_uuid", F.explode("episodes").alias("episode"))
    named = mentions.select(F.col("episode_uuid").alias("episode"), F.col("entity_uuid").alias("source_node_uuid"))
    hit = cited.join(bearing, "episode", "left_semi").join(named, ["episode", "source_node_uuid"], "left_semi")
    return hit.groupBy("uuid").agg(F.min("source_node_uuid").alias("belief_holder")).withColumn("memory_class", F.lit("belief"))


def reinforcement(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """uuid, count of distinct episodes, first and last time, span in days, stability."""
    times = episodes.select(F.col("uuid").alias("episode"), "reference_time")
    rows = edges.select("uuid", "stability", F.explode(F.array_distinct("episodes")).alias("episode")).join(times, "episode")
    out = rows.groupBy("uuid", "stability").agg(F.countDistinct("episode").alias("n_episodes"), F.min("reference_time").alias("first_at"), F.max("reference_time").alias("last_at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = (micros("last_at") - micros("first_at")) / F.lit(86_400_000_000.0)
    n = F.col("n_episodes")
    level = (
        F.when(F.col("stability") == "consolidated", "consolidated")
        .when((n >= PERSISTENT_AT) & (span >= PERSISTENT_DAYS), "persistent")
        .when((n >= REINFORCED_AT) & (F.coalesce("stability", F.lit("episodic")) == "episodic"), "reinforced")
        .otherwise(F.coalesce("stability", F.lit("episodic")))
    )
    return out.select("uuid", "n_episodes", "first_at", "last_at", F.round(span, 6).alias("span_days"), level.alias("new_stability"))


def recall_reinforce(edges: DataFrame, recalled: DataFrame, now: Column) -> DataFrame:
    """Recalled edges count one more recall and gain vitality."""
    out = edges.join(recalled.select("uuid", F.lit(True).alias("__hit")).distinct(), "uuid", "left")
    hit = F.coalesce("__hit", F.lit(False))
    gained = clip01(effective_confidence(now) + 0.04)
    return out.withColumns({"decay_score": F.when(hit, gained).otherwise(F.col("decay_score")), "last_recalled_at": F.when(hit, now).otherwise(F.col("last_recalled_at")), "recall_count": F.col("recall_count") + hit.cast("int")}).drop("__hit")


def weights(edges: DataFrame, now: Column) -> DataFrame:
    """uuid, touched, weight of active edges from how connected their ends and episodes are."""
    live = edges.where(active())
    ends = live.select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    freq = live.select(F.explode("episodes").alias("episode")).groupBy("episode").agg(F.count("*").alias("f"))
    by_episode = live.select("uuid", F.explode("episodes").alias("episode")).join(freq, "episode").groupBy("uuid").agg(F.sum(F.col("f") - 1).alias("shared"))
    out = live.join(ends.select(F.col("node").alias("source_node_uuid"), F.col("d").alias("ds")), "source_node_uuid")
    out = out.join(ends.select(F.col("node").alias("target_node_uuid"), F.col("d").alias("dt")), "target_node_uuid").join(by_episode, "uuid", "left")
    touched = (F.col("ds") - 1) + (F.col("dt") - 1) + F.coalesce("shared", F.lit(0))
    weight = effective_confidence(now) * (1 + F.least(F.lit(1.0), touched / ASSOCIATION_DIVISOR))
    return out.select("uuid", touched.alias("touched"), F.round(F.least(F.greatest(weight, F.lit(0.0)), F.lit(float(WEIGHT_CAP))), 6).alias("weight"))


def trait_candidates(edges: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """subject, predicate, object (null for predicate candidates), strength, n_edges; at most 12 per subject."""
    rows = edges.where(active() & ~F.coalesce("singleton", F.lit(False)) & ~F.coalesce("is_belief", F.lit(False)) & ~F.col("name").isin(*excluded))
    strength = F.sum(F.coalesce("reinforcement_count", F.lit(1)))
    pair = rows.groupBy("source_node_uuid", "name", "target_node_uuid").agg(strength.alias("strength"), F.count("*").alias("n_edges")).where(F.col("strength") >= TRAIT_LEAST)
    pred = rows.groupBy("source_node_uuid", "name").agg(strength.alias("strength"), F.count("*").alias("n_edges")).where(F.col("n_edges") >= TRAIT_EDGES)
    both = pair.unionByName(pred.withColumn("target_node_uuid", F.lit(None).cast("string")))
    rank = F.row_number().over(Window.partitionBy("source_node_uuid").orderBy(F.desc("strength"), "name", F.col("target_node_uuid").asc_nulls_first()))
    return both.withColumn("rank", rank).where(F.col("rank") <= TRAIT_CANDIDATES)


def traits(candidates: DataFrame, top: int = 3) -> DataFrame:
    """Fallback ratification: the strongest candidates, confidence from strength."""
    return candidates.where(F.col("rank") <= top).select(
        "source_node_uuid",
        "rank",
        snake_case(F.concat_ws("_", "name", "target_node_uuid")).alias("trait"),
        F.round(F.least(F.lit(0.95), 0.4 + 0.05 * F.col("strength")), 6).alias("confidence"),
    )


def goals(texts: DataFrame, key: str = "uuid") -> DataFrame:
    """key, goal, confidence: the first clean phrase of each text."""
    named = texts.select(key, F.filter(F.transform(goal_phrases(F.col("content")), snake_case), clean_goal_name).alias("names"))
    return named.where(F.size("names") > 0).select(key, F.col("names")[0].alias("goal"), F.lit(0.55).alias("confidence"))


def interaction_labels(episodes: DataFrame) -> DataFrame:
    """group_id, uuid, label of the last eight episodes of every group, each against the text before it."""
    w = Window.partitionBy("group_id").orderBy("reference_time", "uuid")
    newest = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("reference_time"), F.desc("uuid")))
    rows = episodes.select("group_id", "uuid", "content", F.lag("content").over(w).alias("prior"), newest.alias("r"))
    return rows.where(F.col("r") <= PATTERN_WINDOW).select("group_id", "uuid", classify_episode(F.col("content"), F.col("prior")).alias("label"))


def interaction_mode(labels: DataFrame) -> DataFrame:
    """group_id, label, n of groups where one label holds at least five of the last eight."""
    counts = labels.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "label", "n")).alias("b"))
    return best.select("group_id", F.col("b.label").alias("label"), F.col("b.n").alias("n")).where(F.col("n") >= PATTERN_LEAST)


def consolidation(edges: DataFrame, episodes: DataFrame, key: Column, least: int = CONSOLIDATE_EPISODES, days: int = CONSOLIDATE_DAYS) -> DataFrame:
    """Per fact key with enough episodes over enough time: the consolidated edge."""
    rows = edges.where(active()).withColumn("fact_key", key)
    times = episodes.select(F.col("uuid").alias("episode"), "reference_time")
    seen = rows.select("fact_key", F.explode("episodes").alias("episode")).join(times, "episode").groupBy("fact_key").agg(F.countDistinct("episode").alias("n_episodes"), F.min("reference_time").alias("a"), F.max("reference_time").alias("z"))
    rolled = rows.groupBy("fact_key").agg(F.avg("confidence").alias("mean"), F.max_by("uuid", F.struct("confidence", "uuid")).alias("best"), F.array_sort(F.collect_set("uuid")).alias("members"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = (micros("z") - micros("a")) / F.lit(86_400_000_000.0)
    out = rolled.join(seen, "fact_key").where((F.col("n_episodes") >= least) & (span >= days))
    return out.select("fact_key", "best", "n_episodes", F.round(span, 6).alias("span_days"), F.size("members").cast("long").alias("n_members"), F.round(F.least(F.lit(1.0), F.col("mean") + 0.1), 6).alias("confidence"))


def stagnant(edges: DataFrame, now: Column, least: int = STAGNANT_LEAST, facts: int = 5) -> DataFrame:
    """Buckets of edges without vitality: one archived summary each."""
    from kairograph.functions.decay import last_touched, linear_vitality

    vitality = linear_vitality(F.col("decay_score"), F.col("memory_class"), F.col("stability"), last_touched(), now)
    rows = edges.where(active() & (vitality <= 0)).select(
        F.col("source_node_uuid").alias("subject"),
        memory_class(F.col("memory_class")).alias("klass"),
        F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.nullif(F.col("canonical_name"), F.lit("")), F.col("name")).alias("topic"),
        "uuid",
        "fact",
    )
    return first_facts(rows, ["subject", "klass", "topic"], [F.col("uuid")], facts).where(F.col("n") >= least).withColumn("confidence", F.lit(0.5))


def first_facts(rows: DataFrame, keys: list[str], order: list[Column], first: int = 5) -> DataFrame:
    """keys, n, summary: the first facts of each group and how many more there are.

    The rank is limited before anything is gathered, so a group of any size hands on ``first`` texts; its
    size is a count that combines before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    heads = rows.withColumn("r", rank).where(F.col("r") <= first).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "fact"))), lambda x: x["fact"]), "; ").alias("head"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > first, F.concat(F.lit("; and "), (F.col("n") - first).cast("string"), F.lit(" related"))).otherwise("")
    return heads.join(counts, keys).select(*keys, "n", F.concat("head", more).alias("summary"))


def top_terms(texts: DataFrame, key: list[str], text: str, k: int) -> DataFrame:
    """key..., term, n: the k most frequent words of four letters and more; ties by word."""
    words = texts.select(*key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{4,}"), 0)).alias("term"))
    counts = words.where(~F.col("term").isin(*TERM_STOPWORDS)).groupBy(*key, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*(key or [F.lit(0)])).orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def prediction(goals_: DataFrame, domains: DataFrame, labels: DataFrame) -> DataFrame:
    """group_id, prediction: the heuristic bundle out of goals, domains and the interaction mode."""
    g = goals_.groupBy("group_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("goal")), 1, 10), ",").alias("goals"))
    counted = domains.groupBy("group_id", "domain").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "domain"))
    d = counted.withColumn("r", rank).where("r <= 5").groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "domain"))), lambda x: x["domain"]), ",").alias("domains"))
    m = interaction_mode(labels).select("group_id", "label")
    out = d.join(g, "group_id", "full").join(m, "group_id", "full")
    return out.select("group_id", F.concat_ws(" | ", F.concat(F.lit("goals: "), "goals"), F.concat(F.lit("domains: "), "domains"), F.concat(F.lit("mode: "), "label")).alias("prediction"))


def self_model(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """group_id, type, uuid, confidence, n_sources: structured self-episodes become traits, patterns and beliefs held with ``least`` confidence."""
    got = rows.select("group_id", *[F.get_json_object("content", f"$.{k}").alias(k) for k in ("type", "name")], F.get_json_object("content", "$.confidence").cast("double").alias("confidence"))
    kept = got.where((F.col("type").isNotNull()) & ((F.col("type") != "belief") | (F.col("confidence") >= least)))
    best = kept.groupBy("group_id", "type", slug(F.col("name")).alias("slug")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_sources"))
    return best.select("group_id", "type", stable_uuid("self", F.col("group_id"), F.col("slug")).alias("uuid"), "confidence", "n_sources")


def run_pass(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]], folder: str) -> DataFrame:
    """step, name, n, error: every step's rows written below the folder, in order; one that fails leaves its error and ends nothing."""
    done = []
    for k, (name, step) in enumerate(steps.items()):
        try:
            rows = step()
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
            done.append((k, name, spark.read.schema(rows.schema).parquet(f"{folder}/{name}").count(), None))
        except Exception as e:  # the pass goes on
            done.append((k, name, 0, str(e)[:200]))
    return spark.createDataFrame(done, "step int, name string, n long, error string")
