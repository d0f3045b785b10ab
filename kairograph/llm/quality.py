"""Operator 10: quality classifier with hierarchical empirical Bayes.

A logistic model on text features, fitted on a bounded sample of labelled rows
(``TRAIN_ROWS`` ids, chosen by a hash of the id), gives each document's
evidence.  Good documents are counted by host and by path level over all
documents: a document of the sample counts with its label, every other one,
which the classifier has not seen, with its probability.  The Beta strength of
each level comes from the moments between its groups; sparse groups shrink
towards the level above, hosts towards the global rate.  A document's score is
its own log odds moved by its path's posterior against the global rate, and the
posteriors leave the document itself out, so it never confirms itself.

The counts by (host, level) are aggregated before the shuffle and joined back
to the documents, by broadcast up to ``BROADCAST_GROUPS`` groups.

Defined results: a null text is empty; null hosts and levels are groups of
their own; repeated rows count as often as they occur, of a repeated id in the
sample the mean label counts; without labels of both classes the evidence is
the share of good labels (or 1), so nothing is rejected; a text of any length is
read whole; an empty table gives an empty result; extra columns are kept by
``keep_good`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back

TRAIN_ROWS = 20_000
BROADCAST_GROUPS = 50_000
FEATURES = ("log_words", "distinct", "adjacent", "upper", "bang", "symbol", "pipe", "digit", "word_length", "short_lines", "stops", "distinct_x_log")


def features(text: str) -> list[float]:
    """Shares that do not depend on the language."""
    words = text.split()
    n = max(len(words), 1)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(int(raw.sum()), 1)
    letters = max(int(raw[65:91].sum() + raw[97:123].sum()), 1)
    distinct = len(set(words)) / n
    adjacent = sum(a == b for a, b in zip(words, words[1:])) / n
    symbols = int(sum(raw[ord(c)] for c in "#$%&*@^~<>{}[]=+\\_"))
    lines = text.count("\n") + 1
    log_words = float(np.log1p(len(words)))
    return [
        log_words,
        distinct,
        adjacent,
        float(raw[65:91].sum()) / letters,
        float(raw[33]) / size * 10,
        symbols / size * 10,
        float(raw[124]) / size * 10,
        float(raw[48:58].sum()) / size * 10,
        min(size / n / 10, 5.0),
        float(lines / n),
        float(raw[46] + raw[44]) / n,
        distinct * log_words / 10,
    ]


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    labels: DataFrame | None = None  # id, y of the sample, at most ``TRAIN_ROWS`` rows

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return np.clip(z @ np.array(self.weights) + self.bias, -20, 20)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> Model:
    """Logistic regression by Newton steps."""
    width = len(FEATURES)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return Model((0.0,) * width, (1.0,) * width, (0.0,) * width, float(np.log(share / (1 - share))) if len(y) else 20.0)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
    w = np.zeros(width + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(width + 1)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled ids; only their features, one row per id, reach the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = Scratch(docs.sparkSession, "quality").keep(sample.coalesce(1))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "x": [features(t) for t in f["text"]], "y": f["y"]})
        give_back()

    ddl = docs.schema[id_col].dataType.simpleString()
    measured = texts.select("id", "text", "y").mapInPandas(measure, f"id {ddl}, x array<double>, y double")
    got = measured.groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return replace(fit(x, (got["y"].to_numpy(dtype=float) >= 0.5).astype(float)), labels=sample)


def evidence(model: Model, text: Column) -> Column:
    """The classifier's log odds of a document being good."""
    model = replace(model, labels=None)  # a table stays on the driver

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            x = np.array([features(v) for v in t], dtype=float).reshape(-1, len(FEATURES))
            yield pd.Series(model.log_odds(x))
        give_back()

    return score(F.coalesce(text, F.lit("")))


def _strength(groups: DataFrame, centre: str) -> float:
    """Beta strength from the moments of group rates around ``centre``, at least 1."""
    rate = F.col("good") / F.col("n")
    r = groups.agg(
        F.count("*").alias("g"),
        F.sum((rate - F.col(centre)) ** 2).alias("between"),
        F.sum(F.col(centre) * (1 - F.col(centre)) / F.col("n")).alias("within"),
        F.avg(F.col(centre) * (1 - F.col(centre))).alias("spread"),
    ).first()
    if not r.g or r.between is None:
        return 1.0
    excess = (r.between - r.within) / r.g
    return float(np.clip(r.spread / excess - 1 if excess > 1e-12 else 1e6, 1.0, 1e6))


def counts(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """``scored`` has host, level, p: per (host, level) good, n, host_good, host_n; the global rate; the strengths of hosts and levels."""
    paths = Scratch(scored.sparkSession, "quality").keep(scored.groupBy("host", "level").agg(F.sum("p").alias("good"), F.count("*").alias("n")))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = float(whole.good / whole.n) if whole.n else 1.0
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    m = _strength(hosts.withColumn("above", F.lit(rate)), "above")
    hosts = hosts.select(F.col("host").alias("h"), F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    m2 = _strength(joined.withColumn("above", posterior(F.col("host_good"), F.col("host_n"), m, F.lit(rate))), "above")
    return joined, rate, m, m2


def posterior(good: Column, n: Column, strength: float, above: Column) -> Column:
    return (good + strength * above) / (n + strength)


def scores(scored: DataFrame, rate: float, host_strength: float, path_strength: float) -> DataFrame:
    """``scored`` with e, p and the counts of its groups: gains __evidence, __host_rate, __path_rate, __score, each without the row itself."""
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    host = posterior(F.col("__host_good") - F.col("__p"), F.col("__host_n") - 1, host_strength, F.lit(rate))
    out = scored.withColumn("__host_rate", host)
    out = out.withColumn("__path_rate", posterior(F.col("__good") - F.col("__p"), F.col("__n") - 1, path_strength, F.col("__host_rate")))
    total = lambda r: 1 / (1 + F.exp(-(F.col("__evidence") + odds(r) - odds(F.lit(rate)))))
    out = out.withColumn("__score", total(F.col("__path_rate"))).withColumn("__host_score", total(F.col("__host_rate")))
    return out.drop("__host", "__level", "__p", "__good", "__n", "__host_good", "__host_n")


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", level_col: str = "lang", threshold: float = 0.5, narrow: bool = False) -> DataFrame:
    """``docs`` with __evidence, __host_rate, __path_rate, __host_score, __score and __keep.

    With ``narrow`` only the id stays beside them, and the evidence is written
    once and read twice; without, whole rows would have to be written for that,
    which costs more than a second look at the texts.
    """
    spark = docs.sparkSession
    given = docs.withColumns({"__evidence": evidence(model, F.col(text_col)), "__host": F.col(host_col), "__level": F.col(level_col)})
    if model.labels is None:
        given = given.withColumn("__y", F.lit(None).cast("double"))
    else:
        given = given.join(F.broadcast(model.labels.select(F.col("id").alias("__id"), F.col("y").alias("__y"))), F.col(id_col) == F.col("__id"), "left").drop("__id")
    given = given.withColumn("__p", F.coalesce("__y", 1 / (1 + F.exp(-F.col("__evidence"))))).drop("__y")
    if narrow:
        given = Scratch(spark, "quality").keep(given.select(id_col, "__evidence", "__host", "__level", "__p"))
    stats, rate, m, m2 = counts(given.select(F.col("__host").alias("host"), F.col("__level").alias("level"), F.col("__p").alias("p")))
    stats = stats.select(F.col("host").alias("__h"), F.col("level").alias("__l"), *[F.col(c).alias(f"__{c}") for c in ("good", "n", "host_good", "host_n")])
    if stats.count() <= BROADCAST_GROUPS:
        stats = F.broadcast(stats)
    out = given.join(stats, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__level").eqNullSafe(F.col("__l")), "left").drop("__h", "__l")
    return scores(out, rate, m, m2).withColumn("__keep", F.col("__score") >= threshold)


def moved(classified: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: documents, and the decisions that the host level moved against the evidence, and the path level against the host level."""
    own, host, path = (1 / (1 + F.exp(-F.col("__evidence"))) >= threshold), F.col("__host_score") >= threshold, F.col("__score") >= threshold
    return classified.agg(F.count("*").alias("documents"), F.count_if(own != host).alias("by_host"), F.count_if(host != path).alias("by_path"))


def keep_good(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    return classify(docs, train(docs, labels), **more).where("__keep").select(*[F.col(f"`{c}`") for c in docs.columns])
