"""Hybrid search: exact KNN, BM25, reciprocal rank fusion, rerankers, decay."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.decay import effective_confidence
from kairograph.functions.text import ACCENTED, PLAIN, terms
from kairograph.functions.vectors import cosine

from .filters import SearchFilters, ego_edges, valid_now
from .graph import written

#: Fixed values.
RRF_K, LIMIT, CANDIDATES, MMR_LAMBDA = 60, 10, 50, 0.5
BM25_K1, BM25_B = 1.2, 0.75


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def knn(rows: DataFrame, vector: Sequence[float], k: int = CANDIDATES, column: str = "fact_embedding") -> DataFrame:
    """The k most similar rows with ``score``; each partition keeps k, the driver's plan merges them."""
    scored = rows.where(F.col(column).isNotNull()).withColumn("score", cosine(F.col(column), vector_literal(vector)))
    return scored.orderBy(F.desc("score"), "uuid").limit(k)


def postings(rows: DataFrame, text: str, key: str = "uuid") -> DataFrame:
    """Inverted index: key, term, tf, length.  Terms are counted within the row, so no row is shuffled."""
    t = rows.select(key, terms(F.col(text)).alias("terms"))
    t = t.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _equals(word: str):
    return lambda x: x == word


def bm25(rows: DataFrame, query: str, text: str = "fact", k: int | None = CANDIDATES, key: str = "uuid") -> DataFrame:
    """key, score by BM25 over the rows' own statistics.

    Only the query's terms are kept from the texts: term counts are expressions
    over each row.  These narrow counts are written once, so texts are read and
    split once; one aggregate over them gives N, the average length and every
    document frequency, and scores need only the rows with a hit.
    """
    plain = query.lower().translate(str.maketrans(ACCENTED, PLAIN))
    wanted = sorted(set(re.findall("[a-z0-9]+", plain)))
    if not wanted:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    t = rows.select(key, terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    t = t.select(key, F.size("t").alias("length"), *[F.size(F.filter("t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(wanted)])
    t = written(t)
    stats = t.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    both = t.where(" or ".join(f"tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
    out = both.select(key, F.round(score, 9).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def ranked(rows: DataFrame, list_id: int, score: str = "score") -> DataFrame:
    """list_id, uuid, rank (from 0) of a bounded ranking."""
    rank = F.row_number().over(Window.partitionBy(F.lit(list_id)).orderBy(F.desc(score), "uuid")) - 1
    return rows.select(F.lit(list_id).alias("list_id"), "uuid", rank.alias("rank"))


def rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """uuid, score: the sum of 1 / (k + rank + 1) over the rankings."""
    return rankings.groupBy("uuid").agg(F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 12).alias("score"))


def mmr(candidates: DataFrame, vector: Sequence[float], limit: int = LIMIT, weight: float = MMR_LAMBDA, column: str = "fact_embedding") -> DataFrame:
    """Greedy maximal marginal relevance over a bounded candidate list (``score`` gives the arrival order)."""
    import numpy as np
    import pandas as pd

    query = np.asarray(vector, float)

    def cos(a, b) -> float:
        n = min(len(a), len(b))
        size = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(np.dot(a[:n], b[:n]) / size) if size else 0.0

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "uuid"], ascending=[False, True])
        pool = [(u, None if v is None else np.asarray(v, float)) for u, v in zip(frame["uuid"], frame["v"])]
        chosen: list[tuple[str, np.ndarray | None, float]] = []
        while pool and len(chosen) < limit:
            scores = []
            for _, v in pool:
                if v is None:
                    scores.append(-1e9)
                    continue
                again = max([0.0, *(cos(v, s) for _, s, _ in chosen if s is not None)])
                scores.append(weight * cos(query, v) - (1 - weight) * again)
            best = int(np.argmax(scores))
            chosen.append((*pool.pop(best), scores[best]))
        return pd.DataFrame({"uuid": [u for u, *_ in chosen], "rank": range(1, len(chosen) + 1), "mmr": [s for *_, s in chosen]})

    rows = candidates.select("uuid", "score", F.col(column).alias("v"))
    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(pick, "uuid string, rank int, mmr double")


def token_overlap(query: str, text: Column) -> Column:
    """Offline cross encoder: the share of the query's tokens that the text holds."""
    tokens = sorted({t for t in query.lower().split() if t})
    found = F.size(F.array_intersect(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, tokens)))) if tokens else F.lit(0)
    return found / F.lit(float(max(len(tokens), 1)))


def hop_depth(edges: DataFrame, focal: str) -> DataFrame:
    """uuid, depth: 1 for edges at the focal node, 2 for edges at its out-neighbours."""
    touches = (F.col("source_node_uuid") == focal) | (F.col("target_node_uuid") == focal)
    first = edges.where(touches).select("uuid", F.lit(1).alias("depth"))
    out = edges.where(F.col("source_node_uuid") == focal).select(F.col("target_node_uuid").alias("node")).distinct()
    ends = edges.select("uuid", F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("node"))
    second = ends.join(out, "node", "left_semi").select("uuid", F.lit(2).alias("depth"))
    return first.union(second).groupBy("uuid").agg(F.min("depth").alias("depth"))


@dataclass(frozen=True)
class SearchConfig:
    limit: int = LIMIT
    candidates: int = CANDIDATES
    reranker: str = "rrf"  # rrf, mmr, cross_encoder, node_distance, episode_mentions
    filters: SearchFilters | None = None
    focal: str | None = None
    ego: tuple[str, ...] | None = None
    decay: bool = False
    include_zero_vitality: bool = False


#: Presets by name: kind and reranker.
RECIPES = {f"{kind}_{r}": SearchConfig(reranker=r) for kind, rerankers in {
    "edge": ("rrf", "mmr", "cross_encoder", "node_distance", "episode_mentions"),
    "node": ("rrf", "mmr", "cross_encoder"),
    "community": ("rrf", "mmr", "cross_encoder"),
    "combined": ("rrf", "mmr", "cross_encoder"),
}.items() for r in rerankers} | {"edge_ego": SearchConfig(decay=True)}


def rerank(hits: DataFrame, edges: DataFrame, query: str, vector: Sequence[float], config: SearchConfig) -> DataFrame:
    """``hits`` has the edge columns and score; returns them with ``order`` to sort by, descending."""
    kind = "node_distance" if config.focal else config.reranker
    if kind == "rrf":
        return hits.withColumn("order", F.col("score"))
    if kind == "mmr":
        chosen = mmr(hits, vector, config.candidates)
        return hits.join(F.broadcast(chosen), "uuid").withColumn("order", -F.col("rank").cast("double")).drop("rank", "mmr")
    if kind == "cross_encoder":
        return hits.withColumn("order", token_overlap(query, F.col("fact")))
    if kind == "episode_mentions":
        return hits.withColumn("order", F.size("episodes").cast("double"))
    if kind == "node_distance":
        if not config.focal:
            raise ValueError("node_distance needs a focal node")
        depth = hop_depth(edges, config.focal)
        return hits.join(depth, "uuid", "left").withColumn("order", -F.coalesce("depth", F.lit(99)).cast("double")).drop("depth")
    raise ValueError(f"unknown reranker {kind}")


def hybrid(edges: DataFrame, query: str, vector: Sequence[float], now: Column, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Vector and text rankings fused before any filter, then filters, reranker, decay, limit."""
    near = ranked(knn(edges, vector, config.candidates).select("uuid", "score"), 0)
    text = ranked(bm25(edges, query, k=config.candidates), 1)
    hits = edges.join(F.broadcast(rrf(near.union(text))), "uuid").where(valid_now(now))
    if config.filters:
        hits = hits.where(config.filters.edges(edges.columns))
    if config.ego is not None:
        nodes = edges.sparkSession.createDataFrame([(n,) for n in config.ego], "node string")
        hits = ego_edges(hits, F.broadcast(nodes))
    out = rerank(hits, edges, query, vector, config)
    if config.decay:
        out = out.withColumn("score", F.round(F.col("score") * effective_confidence(now), 9))
        out = out if config.include_zero_vitality else out.where("score > 0")
        return out.orderBy(F.desc("score"), "uuid").limit(config.limit)
    return out.orderBy(F.desc("order"), F.desc("score"), "uuid").limit(config.limit)


def best(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "uuid").limit(k)


def search_nodes(nodes: DataFrame, query: str, vector: Sequence[float] | None, limit: int = LIMIT, filters: Column | None = None) -> DataFrame:
    """uuid, score: name vectors and name texts, each cut at the limit, fused before the filter."""
    lists = []
    if vector is not None:
        lists.append(ranked(knn(nodes, vector, limit, "name_embedding").select("uuid", "score"), 0))
    if query.strip():
        lists.append(ranked(bm25(nodes, query, "name", limit), 1))
    fused = rrf(reduce(DataFrame.union, lists))
    hits = nodes.join(F.broadcast(fused), "uuid")  # at most two lists of ``limit``
    return best((hits if filters is None else hits.where(filters)).select("uuid", "score"), limit)


def search_episodes(episodes: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    return bm25(episodes, query, "content", limit)


def search_communities(communities: DataFrame, vector: Sequence[float], limit: int = LIMIT) -> DataFrame:
    return knn(communities, vector, limit, "name_embedding").select("uuid", "score")


def centroids(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, name_embedding: the mean vector of each group."""
    means = rows.select(key, F.posexplode(column).alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("name_embedding"))


def question_phrases(question: str) -> list[str]:
    """Runs of three, two and one words of a question, each once whatever its case: what may name an entity."""
    words = [w for w in question.replace(",", " ").split() if len(w) > 1]
    runs = [" ".join(words[i : i + n]) for n in (3, 2, 1) for i in range(len(words) - n + 1)]
    return list({r.casefold(): r for r in reversed(runs)}.values())[::-1]


def combined(edges: DataFrame, nodes: DataFrame, episodes: DataFrame, communities: DataFrame, query: str, vector: Sequence[float], now: Column, limit: int = LIMIT) -> DataFrame:
    """kind, uuid, score: every kind searched on its own index."""
    parts = {
        "edge": hybrid(edges, query, vector, now, SearchConfig(limit=limit)),
        "node": search_nodes(nodes, query, vector, limit),
        "episode": search_episodes(episodes, query, limit),
        "community": search_communities(communities, vector, limit),
    }
    return reduce(DataFrame.union, [d.select(F.lit(k).alias("kind"), "uuid", "score") for k, d in parts.items()])


def search(edges: DataFrame, query: str, vector: Sequence[float], now: Column, depth: str = "normal", group_ids: Sequence[str] | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Facade: depth sets the limit; several groups are allowed."""
    limit = {"fast": 10, "normal": 25, "deep": 50}[depth]
    rows = edges.where(F.col("group_id").isin(*group_ids)) if group_ids else edges
    return hybrid(rows, query, vector, now, replace(config, limit=limit))
