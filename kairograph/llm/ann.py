"""Operator 4: nearest neighbours by a block matrix join on int8 tiles.

Vectors are dealt into data blocks; chunks of queries travel to every data
block as one binary row each.  A task reads its blocks sorted, the vectors
first: it holds one block as int8 codes and doubles, and lets the query chunks
pass one by one, so its memory follows block and chunk, not the queries.

Within a tile both sides are int8 with one scale per vector; the integer
product (exact in single precision, cast slice by slice) gives the distance of
the quantised vectors, and by the triangle inequality the true distance differs
by at most the two quantisation errors.  Pairs whose lower bound exceeds the
query's k-th smallest upper bound in the tile cannot be among its k nearest; the
others are computed again in double precision, dimension by dimension, and kept
in a heap per query.  The k best of every tile are merged per query at the end,
so a query's rows never exceed k x blocks, and the result is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, as rows without an id; only vectors of equal length
are compared; a repeated id counts once, with its nearest row, whichever block
its rows lie in, and a query never finds its own id; a query id with several
vectors asks with each and keeps the nearest; ties go to the smaller id; fewer
candidates than k give all of them; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back
from .textblocks import runs

BLOCK = 8192
QUERY_BLOCK = 256
SLICE = 2048  # vectors whose codes are cast at once


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale per row, and an upper bound of the distance to the row."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9) + 1e-300


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of row pairs, summed dimension by dimension in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        total += d * d
    return np.sqrt(total)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes, exact: sums below 2**24 in single precision, longer vectors in double."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left = a.astype(kind)
    out = np.empty((len(a), len(b)), kind)
    for at in range(0, len(b), SLICE):
        np.matmul(left, b[at : at + SLICE].astype(kind).T, out=out[:, at : at + SLICE])
    return out


class Tile:
    """One side of a tile: vectors, ids, int8 codes with scale, error and squared length."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.codes, self.scale, self.error = quantise(x)
        whole = self.codes.astype(np.int64)
        self.squares = (whole * whole).sum(1) * self.scale**2
        self.surplus = len(ids) - len(np.unique(ids))  # rows beside the first of their id


def tile_nearest(q: Tile, x: Tile, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest of the tile as (distance, id), each id once."""
    d = code_products(q.codes, x.codes).astype(np.float64)
    d *= -2 * q.scale[:, None] * x.scale[None, :]
    d += q.squares[:, None] + x.squares[None, :]
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    slack = (q.error[:, None] + x.error[None, :]) * (1 + 1e-9) + 1e-6 * (np.sqrt(q.squares)[:, None] + np.sqrt(x.squares)[None, :])
    own = q.ids[:, None] == x.ids[None, :]
    # among this many smallest upper bounds are k of different ids
    at = min(k + x.surplus, len(x.ids)) - 1
    limit = np.partition(np.where(own, np.inf, d + slack), at, axis=1)[:, at]
    d -= slack
    out = []
    for i in range(len(q.ids)):
        near = np.flatnonzero(~(d[i] > limit[i]) & ~own[i])
        exact = exact_distance(np.broadcast_to(q.x[i], (len(near), q.x.shape[1])), x.x[near])
        best: dict[int, float] = {}
        for dist, ident in zip(exact.tolist(), x.ids[near].tolist()):
            if dist < best.get(ident, np.inf):
                best[ident] = dist
        out.append(heapq.nsmallest(k, ((dist, ident) for ident, dist in best.items())))
    return out


def _distinct(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeats of one id and vector."""
    if len(np.unique(ids)) == len(ids):
        return x, ids
    key = np.concatenate([ids[:, None].view(np.uint8).reshape(len(ids), -1), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)], axis=1)
    _, first = np.unique(key, axis=0, return_index=True)
    return x[first], ids[first]


def _sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return out.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


_SCHEMA = "query_id long, vec_id long, score double"
_MOVED = "block int, dim int, kind int, ids binary, m binary"
DATA, ASKED = 0, 1


def _packed(kind: int, most: int):
    """id, v, dim, block to rows of ``_MOVED`` with up to ``most`` vectors of one length and block each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, blocks = (batch.column(c).to_numpy() for c in ("id", "dim", "block"))
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])
            order = np.lexsort((blocks, dims))
            cuts = np.flatnonzero((np.diff(dims[order]) != 0) | (np.diff(blocks[order]) != 0)) + 1
            out = []
            for group in np.split(order, cuts) if len(order) else []:
                for at in range(0, len(group), most):
                    part = group[at : at + most]
                    m = np.concatenate([flat[starts[r] : starts[r + 1]] for r in part])
                    out.append((int(blocks[part[0]]), int(dims[part[0]]), kind, ids[part].astype("<i8").tobytes(), m.astype("<f8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "dim", "kind", "ids", "m"])

    return run


def _tile(ids: bytes, m: bytes, dim: int, distinct: bool) -> Tile:
    x, ids = np.frombuffer(m, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8")
    return Tile(*_distinct(x, ids)) if distinct else Tile(x, ids)


def _tiles(k: int):
    """Rows sorted by (block, dim, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim), parts in runs(batches, ["block", "dim"]):
            held, data = [], None
            for part in parts(16):
                for row in part.to_pylist():
                    if row["kind"] == DATA:
                        held.append((row["ids"], row["m"]))
                        continue
                    if data is None:  # the block's vectors came before its queries
                        ids, m = b"".join(h[0] for h in held), b"".join(h[1] for h in held)
                        # a block that came out large is worked through in tiles
                        data = [_tile(ids[8 * at : 8 * (at + BLOCK)], m[8 * dim * at : 8 * dim * (at + BLOCK)], dim, True) for at in range(0, len(ids) // 8, BLOCK)]
                        held = []
                    q = _tile(row["ids"], row["m"], dim, False)
                    best: dict[int, list] = {}
                    for x in data:
                        for i, near in enumerate(tile_nearest(q, x, k)):
                            best[i] = _merged(best.get(i, []), near, k)
                    found = [(int(q.ids[i]), ident, dist) for i, near in best.items() for dist, ident in near]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])
        give_back()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", n_blocks: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of ``vectors`` to each row of ``queries``."""
    data = _sound(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    if n_blocks is None:
        n_blocks = max(1, -(-data.count() // BLOCK))
    # any even deal will do; the row's number keeps the rows of one id or vector apart
    data = data.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    asked = _sound(queries, id_col, vector_col).withColumn("dim", F.size("v")).dropDuplicates(["id", "v"]).withColumn("block", F.lit(-1))
    columns = ("id", "v", "dim", "block")
    chunks = asked.select(*columns).mapInArrow(_packed(ASKED, QUERY_BLOCK), _MOVED)
    sent = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("block", "dim", "kind", "ids", "m")
    moved = data.select(*columns).mapInArrow(_packed(DATA, BLOCK), _MOVED).union(sent)
    tiles = moved.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "dim", "kind")
    near = tiles.mapInArrow(_tiles(k), _SCHEMA)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merged(a: list, b: list, k: int) -> list:
    best: dict[int, float] = {}
    for dist, ident in heapq.merge(a, b):
        if ident not in best:
            best[ident] = dist
    return [(d, i) for i, d in list(best.items())[:k]]
