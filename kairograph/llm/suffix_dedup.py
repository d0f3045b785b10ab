"""Operator 1: suffix-array dedup with a distributed difference cover.

A byte goes if a string of ``length`` bytes over it also starts elsewhere.  The
order of whole suffixes is not needed for that, only which of them share a
prefix of ``length`` bytes, so the difference-cover algorithm runs to that
depth and no further:

* *Sample.* Positions whose residue modulo v lies in a perfect difference set D
  (v = 133, |D| = 12 for 400 bytes).  For any two positions some shift below v
  brings both into the sample.
* *Name triples and recurse on names.* Bytes are named, then triples of names,
  then triples of those, up to windows of 3**j bytes (243).  Names are 64-bit
  fingerprints, so equal strings get equal names on every machine without a
  global rank; the sample's names are sorted per name range.
* *Merge.* Two equal strings have a sampled pair of equal names at a common
  shift below v.  Sorted classes of equal names are split by the name of the
  whole context that such shifts can reach (v - 1 bytes before, ``length``
  after).  Samples that share the context settle every string that reaches
  them.  Of a class with several contexts, one sample of each context goes on.
* *Compare adjacent prefixes.* The strings that reach those samples are sorted
  by the name of their full ``length`` bytes; neighbours that are equal repeat.

Equality is decided by names throughout, never by the bytes themselves, and
names stand in no lexical order: no suffix array of whole suffixes is built.
The symbols are bytes, or words for ``passages``; the steps are the same.

Two independent families of names take part in every decision (about 100 bits
for contexts, 96 and more for strings).  Names travel as packed arrays, one row
per task and name range, sorted with numpy where they meet; copies that meet in
one task are settled there and leave one entry, so a string repeated by a third
of the corpus arrives once per task.  Ranges of names go one to one to tasks.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; a text of any length is one block and never cut; rows repeated with one id and text are rows of their own and repeat
each other; ids are integers, a null id stays null; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, release_shuffles
from .textblocks import mix64, runs, text_buffers, word_hashes

#: Perfect difference sets by modulus.
DIFFERENCE_SETS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
BLOCK = 2 << 20  # symbols whose names are held at once; a longer text is one block
FLUSH = 1 << 20  # entries that are packed together
RANGE = 24 << 20  # bytes of text for each range of names
PASSAGE_WORDS = 50  # a passage of over 50 words holds a string of as many
STRIDE = 1 << 16
GAP = 255  # no byte of UTF-8; where symbols are hashes of words, no hash but by chance

_rng = np.random.default_rng(400)
_FAMILIES = [(_rng.integers(1, 1 << 63, 256, dtype=np.uint64), _rng.integers(1, 1 << 62, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) for _ in range(2)]


@dataclass(frozen=True)
class Plan:
    length: int
    depth: int
    modulus: int

    @property
    def window(self) -> int:
        return 3**self.depth

    @property
    def cover(self) -> np.ndarray:
        return np.array(DIFFERENCE_SETS[self.modulus])

    def tiles(self, size: int) -> list[int]:
        """Starts of windows that together cover ``size`` bytes."""
        return [*range(0, size - self.window, self.window), size - self.window]


def plan(length: int) -> Plan:
    """Windows of about 0.6 of the length, and the largest modulus the rest allows."""
    if length < 5:
        raise ValueError("strings of at least 5 bytes")
    depth = max(j for j in range(1, 40) if 3**j <= max(0.62 * length, 3))
    return Plan(length, depth, max(v for v in DIFFERENCE_SETS if v <= length - 3**depth + 1))


def names(data: np.ndarray, p: Plan, family: int) -> np.ndarray:
    """Name of the window that starts at every byte; the array is ``window - 1`` shorter than the data."""
    value, (a, b, c) = _FAMILIES[family]
    n = len(data) - p.window + 1
    out = np.empty(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, STRIDE):
            x = data[at : min(at + STRIDE, n) + p.window - 1]
            x = value[x] if data.dtype == np.uint8 else mix64(x ^ value[0])
            step = 1
            for _ in range(p.depth):
                t = x[: -2 * step] * a
                t += x[step:-step] * b
                t += x[2 * step :] * c
                t ^= t >> np.uint64(29)
                x, step = t, step * 3
            out[at : at + len(x)] = x
    return out


def _combined(x: np.ndarray, at: np.ndarray, tiles: list[int]) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for t in tiles:
            total = mix64(total * np.uint64(0x9FB21C651E98DF25) + x[at + t])
    return total


def _planes(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


_PACKED = "bucket int, kind int, n long, name binary, wide binary, id binary, hash binary, pos binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
SETTLED, OPEN = 0, 1  # kinds of marks; ENTRY and its repeated form are what is compared
ENTRY, ENTRIES = 2, 3


def _pack(bucket: np.ndarray, kind: int, name: np.ndarray, wide: np.ndarray, ids: np.ndarray, hashes: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    marks = not len(name)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        o = order[a:b]
        row = (int(bucket[a]), kind, b - a, b"" if marks else _planes(name[o]), b"" if marks else wide[o].tobytes(), _planes(_steps(ids[o])), _planes(_steps(hashes[o])), _planes(_steps(pos[o])))
        types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], _NAMES)


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    with np.errstate(over="ignore"):
        loc = [np.cumsum(_unplanes(row[c], k), dtype=k) for c, k in (("id", np.uint64), ("hash", np.uint64), ("pos", np.int64))]
    return _unplanes(row["name"], np.uint32), np.frombuffer(row["wide"], np.uint64), *loc


class _Entries:
    """Gathers (name, wide, place) of one task and packs them by range of names."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.parts = buckets, 0, []

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held += len(columns[0])
        self.parts.append(columns)
        if self.held >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        name, wide, ids, hashes, pos = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((wide, name))
        first = np.ones(len(order), bool)
        first[1:] = (name[order][1:] != name[order][:-1]) | (wide[order][1:] != wide[order][:-1])
        starts = np.flatnonzero(first)
        several = np.diff(np.append(starts, len(order))) > 1
        bucket = ((name >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        for kind, chosen in ((ENTRY, order[starts[~several]]), (ENTRIES, order[starts[several]])):
            o = np.sort(chosen)
            yield from _pack(bucket[o], kind, name[o].astype(np.uint32), wide[o], ids[o], hashes[o], pos[o])
        rest = np.sort(order[~first])  # the copies of what was sent are settled
        none = np.empty(0, np.uint64)
        yield from _pack(bucket[rest], SETTLED, none, none, ids[rest], hashes[rest], pos[rest])


def _symbols(batch: pa.RecordBatch, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, symbols of the texts from there, offsets per text): bytes, or hashes of words."""
    data, offsets = text_buffers(batch.column("text"))
    if not words:
        yield 0, data, offsets
        return
    at = 0
    while at < len(offsets) - 1:  # hashing takes many times the text, so a block of texts at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, *word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _blocks(batch: pa.RecordBatch, p: Plan, words: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their sizes, symbols with gaps around every text, starts of the texts in it) for texts long enough."""
    gap = p.length + p.modulus
    for first, data, offsets in _symbols(batch, words):
        sizes = np.diff(offsets)
        rows = np.flatnonzero(sizes >= p.length)
        at = 0
        while at < len(rows):
            total = np.cumsum(sizes[rows[at:]] + gap)
            to = at + max(1, int(np.searchsorted(total, BLOCK)))
            part = rows[at:to]
            starts = gap + np.concatenate([[0], np.cumsum(sizes[part] + gap)[:-1]])
            out = np.full(int((sizes[part] + gap).sum()) + gap, GAP, data.dtype)
            for r, s in zip(part.tolist(), starts.tolist()):
                out[s : s + sizes[r]] = data[offsets[r] : offsets[r + 1]]
            yield first + part, sizes[part], out, starts
            at = to


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _sampled(p: Plan, buckets: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, cover, v = _Entries(buckets), p.cover, p.modulus
        before = np.searchsorted(cover, np.arange(v + 1))  # sampled residues below each residue
        context = [t - (v - 1) for t in p.tiles(p.length + v - 1)]
        for batch in batches:
            ids, hashes = _column(batch, "id"), _column(batch, "hash")
            for rows, sizes, data, starts in _blocks(batch, p, words):
                most = sizes - p.length + v  # places below this can be reached by a string of the text
                count = most // v * len(cover) + before[most % v]
                row = np.repeat(np.arange(len(rows)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                pos = nth // len(cover) * v + cover[nth % len(cover)]
                at = starts[row] + pos
                own = mix64(names(data, p, 0)[at])
                wide = _combined(names(data, p, 1), at, context)
                yield from entries.add(own, wide, ids[rows][row], hashes[rows][row], pos)
        yield from entries.flush()
        give_back()

    return run


def _strings(p: Plan, buckets: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, tiles = _Entries(buckets), p.tiles(p.length)
        for batch in batches:
            ids, hashes = _column(batch, "id"), _column(batch, "hash")
            first, last = batch.column("open_from"), batch.column("open_to")
            for rows, sizes, data, starts in _blocks(batch, p, words):
                place, row = [], []
                for k, r in enumerate(rows.tolist()):
                    for a, b in zip(first[r].as_py(), last[r].as_py()):
                        place.append(np.arange(a, min(b, int(sizes[k]) - p.length + 1)))
                        row.append(np.full(len(place[-1]), k))
                pos, row = np.concatenate(place), np.concatenate(row)
                at = starts[row] + pos
                own, wide = (_combined(names(data, p, f), at, tiles) for f in (0, 1))
                yield from entries.add(own, wide, ids[rows][row], hashes[rows][row], pos)
        yield from entries.flush()
        give_back()

    return run


def _compare(parts_n: int, contexts: bool):
    """Rows sorted by range of names: what repeats is settled; with ``contexts`` classes of several contexts stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)

        def marks(kind: int, ids: np.ndarray, hashes: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((pos, hashes, ids))
            ids, hashes, pos = ids[order], hashes[order], pos[order]
            yield from _pack((mix64(ids ^ mix64(hashes)) % np.uint64(parts_n)).astype(np.int64), kind, none, none, ids, hashes, pos)

        for _, parts in runs(batches, ["bucket"]):
            held, done = [], []
            for part in parts(64):
                for row in part.to_pylist():
                    got = _unpack(row)
                    if row["kind"] == SETTLED:
                        done.append(got[2:])
                    else:
                        held.append((*got, np.full(len(got[2]), row["kind"] == ENTRIES)))
            if done:
                yield from marks(SETTLED, *(np.concatenate(c) for c in zip(*done)))
            if not held:
                continue
            name, wide, ids, hashes, pos, several = (np.concatenate(c) for c in zip(*held))
            del held
            order = np.lexsort((wide, name))
            name, wide, several = name[order], wide[order], several[order]
            new_name = np.ones(len(order), bool)
            new_name[1:] = name[1:] != name[:-1]
            new = new_name.copy()
            new[1:] |= wide[1:] != wide[:-1]
            starts = np.flatnonzero(new)
            again = (np.diff(np.append(starts, len(order))) > 1) | np.logical_or.reduceat(several, starts)
            group = np.cumsum(new) - 1
            settled = order[again[group]]
            yield from marks(SETTLED, ids[settled], hashes[settled], pos[settled])
            if contexts:
                of_name = (np.cumsum(new_name) - 1)[starts]
                mixed = np.bincount(of_name)[of_name] > 1
                left = order[starts[mixed]]
                yield from marks(OPEN, ids[left], hashes[left], pos[left])
            del name, wide, ids, hashes, pos, several, order
        give_back()

    return run


def _merge(p: Plan, before: int):
    """Rows sorted by part of the places: per text the spans that go, and the strings that stay open."""

    def spans(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = np.ones(len(start), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
        at = np.flatnonzero(new)
        return start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else end, row[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs(batches, ["bucket"]):
            held = [(*_unpack(r)[2:], np.full(r["n"], r["kind"])) for part in parts(64) for r in part.to_pylist()]
            ids, hashes, pos, kind = (np.concatenate(c) for c in zip(*held))
            del held
            order = np.lexsort((pos, hashes, ids))
            ids, hashes, pos, kind = ids[order], hashes[order], pos[order], kind[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
            row, at = np.cumsum(new) - 1, np.flatnonzero(new)
            columns = [pa.array(ids[at].view(np.int64)), pa.array(hashes[at].view(np.int64))]
            for wanted, after in ((SETTLED, p.length), (OPEN, 1)):
                o = np.flatnonzero(kind == wanted)
                start, end, r = spans(np.maximum(pos[o] - before, 0), pos[o] + after, row[o])
                offsets = pa.array(np.searchsorted(r, np.arange(len(at) + 1)).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (start, end)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "gone_from", "gone_to", "open_from", "open_to"])
        give_back()

    return run


_MARKS = "id long, hash long, gone_from array<long>, gone_to array<long>, open_from array<long>, open_to array<long>"


def removed_spans(size: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover within the text."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def _cut(with_text: bool, passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            starts, ends = batch.column("gone_from"), batch.column("gone_to")
            rows, spans = [], []
            for k in range(batch.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                found = removed_spans(len(raw), starts[k].as_py() or [], ends[k].as_py() or [])
                at, kept = 0, []
                for a, b in found:
                    kept.append(raw[at:a].tobytes())
                    at = b
                left = b"".join([*kept, raw[at:].tobytes()])
                row = (len(raw), sum(b - a for a, b in found), len(found), hashlib.sha256(left).hexdigest())
                rows.append((*row, left) if with_text else row)
                spans.append([{"start": a, "end": b} for a, b in found])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*rows)) or [()] * (4 + with_text)
            arrays = [batch.column("doc"), *[pa.array(c, t) for c, t in zip(columns, types)]]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            if passages:
                from_, to = batch.column("word_from").to_pylist(), batch.column("word_to").to_pylist()
                arrays.append(pa.array([len(removed_spans(len(data), a or [], b or [])) for a, b in zip(from_, to)], pa.int64()))
                names.append("n_passages")
            if with_text:
                arrays.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _repeats(long: DataFrame, p: Plan, buckets: int, words: bool, scratch: Scratch) -> DataFrame:
    """id, hash, gone_from, gone_to: what strings of the plan's length cover that also start elsewhere."""
    spark = long.sparkSession

    def compared(entries: DataFrame, contexts: bool, before: int) -> DataFrame:
        found = entries.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_compare(buckets, contexts), _PACKED)
        return scratch.keep(found.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_merge(p, before), _MARKS))

    settled = compared(long.mapInArrow(_sampled(p, buckets, words), _PACKED), True, p.modulus - 1)
    release_shuffles(spark)
    still = settled.where(F.size("open_from") > 0).select("id", "hash", "open_from", "open_to")
    strings = compared(long.join(still, ["id", "hash"]).mapInArrow(_strings(p, buckets, words), _PACKED), False, 0)
    release_shuffles(spark)
    gone = settled.select("id", "hash", "gone_from", "gone_to").union(strings.select("id", "hash", "gone_from", "gone_to"))
    return gone.where(F.size("gone_from") > 0)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False, passages: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``with_text`` also kept (bytes) and spans.  With ``passages`` also
    n_passages: maximal runs of words covered by that many words in a row (A-Z
    lower-cased, split at ASCII white space) that start anywhere else too.
    """
    spark, p = docs.sparkSession, plan(length)
    scratch = Scratch(spark, "suffix_dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a place is (id, hash of the text, offset): rows repeated with one id are told apart by their text
    read = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(-(-size // RANGE), 2 * spark.sparkContext.defaultParallelism)
    long = lambda least: read.where(F.octet_length("text") >= least).select("id", "hash", "text")
    gone = _repeats(long(length), p, buckets, False, scratch)
    if passages:
        none = F.lit(None).cast("array<long>")
        runs_ = _repeats(long(2 * passages - 1), plan(passages), buckets, True, scratch)  # a word and a space each
        gone = gone.select("*", none.alias("word_from"), none.alias("word_to")).union(runs_.select("id", "hash", none, none, "gone_from", "gone_to"))
    columns = ["gone_from", "gone_to"] + ["word_from", "word_to"] * bool(passages)
    gone = gone.groupBy("id", "hash").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in columns])
    ddl = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {ddl}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text + ", n_passages long" * bool(passages) + ", spans array<struct<start:long,end:long>>" * with_text
    return read.join(gone, ["id", "hash"], "left").select("doc", "text", *columns).mapInArrow(_cut(with_text, bool(passages)), schema).withColumnRenamed("doc", id_col)
