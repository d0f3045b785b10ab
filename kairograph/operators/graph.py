"""Graph analytics: components, neighbourhoods, degrees, quality marks."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; an own one only in local mode where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    import os
    import tempfile

    own = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    if own not in _OWN:
        import atexit
        import shutil

        _OWN.add(own)
        spark.sparkContext.setCheckpointDir(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_OWN: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage is cut and nothing is computed twice."""
    path = f"{_shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def _dropped(df: DataFrame) -> None:
    """Deletes a table of an earlier round that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, source: str = "source_node_uuid", target: str = "target_node_uuid") -> DataFrame:
    """node, component (the smallest node reachable) by label propagation with pointer jumping.

    Each round takes the smallest label around every node and then that label's
    own label, so the rounds grow with the logarithm of the diameter; minima
    combine before the shuffle and lineage is cut by writing each round.
    """
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct())
    labels = written(edges.select(F.explode(F.array(source, target)).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while True:
        around = both.join(labels.select("node", "component"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        hop = labels.select("node", "component").join(around, F.col("node") == F.col("a"), "left").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        hop = written(hop)
        jump = hop.select(F.col("node").alias("j"), F.col("component").alias("further"))
        new = written(hop.join(jump, hop["component"] == jump["j"]).select("node", F.least("component", "further").alias("component"), "old"))
        done = not new.where("component <> old").take(1)
        for old in (labels, hop, *([both] if done else [])):
            _dropped(old)
        if done:
            return new.select("node", "component")
        labels = new


def communities(edges: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """component, head (most connected, smallest id on ties), members, name, summary (sorted member names)."""
    open_edges = edges.where("invalid_at is null")
    member = components(open_edges)
    deg = degree(open_edges)
    rows = member.join(deg, "node").join(names.select(F.col("uuid").alias("node"), "name"), "node", "left")
    out = rows.groupBy("component").agg(
        F.count("*").alias("n_members"),
        F.min(F.struct((-F.col("degree")).alias("d"), F.col("node").alias("node"))).alias("h"),
        F.max_by("name", F.struct("degree", F.expr("reverse(node)"))).alias("__any"),
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("summary"),
    )
    out = out.where(F.col("n_members") >= least).select("component", F.col("h.node").alias("head"), "n_members", "summary")
    return out.join(names.select(F.col("uuid").alias("head"), F.concat("name", F.lit(" community")).alias("community_name")), "head", "left")


def degree(edges: DataFrame, source: str = "source_node_uuid", target: str = "target_node_uuid") -> DataFrame:
    """node, degree over both ends."""
    return edges.select(F.explode(F.array(source, target)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def hops(edges: DataFrame, start: str, radius: int, source: str = "source_node_uuid", target: str = "target_node_uuid") -> DataFrame:
    """node, depth within ``radius`` undirected hops of ``start``."""
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    both = pairs.union(pairs.select("b", "a")).distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node string, depth int")
    front = seen
    for depth in range(1, radius + 1):
        front = both.join(front.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        front = front.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"))
        seen = seen.union(front)
    return seen


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def _within(names: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """Which rows of equally long ``names`` (a row per position, a column per name) lie within ``most`` edits of ``name``: the band of the edit table, all names at once."""
    m, n = len(name), len(names)
    far = np.int16(most + 1)
    row = [np.full(names.shape[1], min(j, most + 1), np.int16) for j in range(n + 1)]
    for i in range(1, m + 1):
        low, high = max(1, i - most), min(n, i + most)
        new = [np.full(names.shape[1], far, np.int16)] * (n + 1)
        if i <= most:
            new[0] = np.full(names.shape[1], i, np.int16)
        for j in range(low, high + 1):
            cell = np.minimum(row[j], new[j - 1]) + np.int16(1)
            new[j] = np.minimum(np.minimum(cell, row[j - 1] + (names[j - 1] != name[i - 1])), far)
        row = new
    return row[n] <= most


def _anchors(norms: list[str]) -> list[int]:
    """For distinct names in order, the place of the first anchor near each; a name near none is an anchor itself.

    Each anchor sweeps over the names that are still free, so a name goes to the
    earliest anchor near it, as it would if names came one by one.
    """
    anchor = [-1] * len(norms)
    at = {n: k for k, n in enumerate(norms)}
    free = np.ones(len(norms), bool)
    by_length: dict[int, list[int]] = {}
    for k, n in enumerate(norms):
        by_length.setdefault(len(n), []).append(k)
    lists = {size: np.array(ks) for size, ks in by_length.items()}
    codes = {size: np.array([[ord(c) for c in norms[k]] for k in ks], np.int32).reshape(len(ks), size).T.copy() for size, ks in by_length.items()}
    rest, texts = np.arange(len(norms)), pa.array(norms, pa.large_string())
    for k, name in enumerate(norms):
        if not free[k]:
            continue
        near = [np.array([k])]
        if name:
            near.append(rest[pc.match_substring(texts, name).to_numpy(zero_copy_only=False)])
            inside = {name[i:j] for i in range(len(name)) for j in range(i + 1, len(name) + 1)}
            near.append(np.array([at[x] for x in inside if x in at], int))
        code = np.array([ord(c) for c in name], np.int32)
        for size, ks in lists.items():
            most = max(1, int(0.22 * min(len(name), size)))
            if abs(len(name) - size) <= most and len(ks):
                near.append(ks[_within(codes[size], code, most)])
        hit = np.unique(np.concatenate(near))
        hit = hit[free[hit]]
        free[hit] = False
        for h in hit.tolist():
            anchor[h] = k
        # names that found their anchor go once they are a tenth of what is swept over
        if free[rest].sum() < 0.9 * len(rest):
            live = free[rest]
            rest, texts = rest[live], texts.filter(pa.array(live))
            for size, ks in lists.items():
                live = free[ks]
                lists[size], codes[size] = ks[live], codes[size][:, live].copy()
    return anchor


def alias_groups(names: DataFrame, key: str = "uuid") -> DataFrame:
    """Greedy grouping of near-equal normalised names per group: equal, contained, or within an edit distance.

    A group of names is one tenant's display list; greedy order needs its rows together.
    """

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        ids, norms = frame[key].tolist(), frame["norm"].tolist()
        first: dict = {}  # equal names, null included, share their first one's anchor
        for k, n in enumerate(norms):
            first.setdefault(n, k)
        known = [n for n in first if n is not None]
        found = dict(zip(known, (first[known[a]] for a in _anchors(known))))
        return pd.DataFrame({key: ids, "norm": norms, "anchor": [ids[found.get(n, first[n])] for n in norms]})

    return names.select("group_id", key, "norm").groupBy("group_id").applyInPandas(group, f"{key} string, norm string, anchor string")
