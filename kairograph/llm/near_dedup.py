"""Operator 8: MinHash near-dedup by a multi-index Hamming join.

Every document's set of word shingles gets a signature of 32 symbols of 16
bits.  The signature is split into 8 chunks of 4 symbols.  If two signatures
differ in at most 15 symbols, the pigeonhole gives a chunk with at most one
difference, so keys made of a chunk with each one of its symbols left out (32
keys a document) bring together all pairs within that signature distance.  At a
similarity of 0.85 a pair exceeds the distance with a probability of 4e-6, at
0.8 of 1e-4.

1. Equal sets are collapsed to one class by a digest of the whole set.
2. Classes meet in buckets by key, in the order of their sets' sizes; each bucket
   emits stars over its components of pairs within the distance whose sizes allow
   the similarity, never all pairs.  Rows are let go when no later set is small
   enough for them.  Connected components of the stars are the candidate groups.
3. Every link is confirmed on full sets, without a pair of a group left out.  A
   group of up to a block of classes meets in one task.  A larger one is dealt
   into blocks, which first connect what they hold; then one class of each
   component so found meets the others; and only classes outside the group's
   largest component meet all its blocks.  What confirmed links already connect
   is not confirmed again.
4. Components of the confirmed links, and of classes that share a document, are
   the result.

Defined results: texts that are null, empty or without words have an empty set
and are linked with nothing; rows repeated with one id are one document (their
sets are linked); a row without an id takes no part, has a null component and
stays; a text of any length has its whole set; an empty table gives an empty
result; extra columns are not read.  Sets are of 64-bit hashes of shingles and
classes of 128-bit digests of sets, so "full sets" means sets of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, release_shuffles
from .components import components
from .textblocks import doc_bytes, mix64, runs, shingles

SYMBOLS, CHUNK = 32, 4
CHUNKS = SYMBOLS // CHUNK
DISTANCE = 2 * CHUNKS - 1
BLOCK = 2048  # classes of a group that meet in one task, rows of a bucket that are read at once

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def digest(distinct: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    with np.errstate(over="ignore"):
        a = mix64(distinct ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        b = mix64(distinct * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16[documents, SYMBOLS]; rows of empty sets are 0."""
    n = len(offsets) - 1
    out = np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        starts = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for k in range(SYMBOLS):
                least = np.minimum.reduceat(hashes * _A[k] + _B[k], starts)
                out[full, k] = (mix64(least) >> np.uint64(48)).astype(np.uint16)
    return out


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """int64[rows, CHUNKS * CHUNK]: each chunk with each one of its symbols left out."""
    s = sigs.astype(np.uint64).reshape(len(sigs), CHUNKS, CHUNK)
    out = np.empty((len(sigs), CHUNKS, CHUNK), np.uint64)
    for c in range(CHUNKS):
        for left in range(CHUNK):
            rest = [x for x in range(CHUNK) if x != left]
            packed = (s[:, c, rest[0]] << np.uint64(32)) | (s[:, c, rest[1]] << np.uint64(16)) | s[:, c, rest[2]]
            out[:, c, left] = mix64(packed | np.uint64((c * CHUNK + left) << 48))
    return out.reshape(len(sigs), -1).view(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.StructArray.from_arrays([batch.column("id"), batch.column("hash")], ["id", "hash"])
            for ids, data, starts in doc_bytes(pa.RecordBatch.from_arrays([rows, batch.column("text")], ["id", "text"])):
                hashes, offsets = shingles(data, starts, width)
                sigs = signatures(hashes, offsets)
                sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.field(0),
                        ids.field(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sigs], pa.binary()),
                    ],
                    ["id", "hash", "n_shingles", "sid", "sig"],
                )
        give_back()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        keys = bucket_keys(sigs)
        offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["sid", "sig", "n", "keys"])


def connected(linked, label: np.ndarray, new: int = 0) -> np.ndarray:
    """Components over rows that ``label`` unites in part: the first row visited of each row's component.

    ``linked(i, rows)`` says which of the rows are linked with i.  Rows before
    ``new`` have been compared with each other already.  A row that is reached
    is not compared again, so copies cost one pass.
    """
    n = len(label)
    out = np.full(n, -1)
    order = np.argsort(label, kind="stable")
    cuts = np.searchsorted(label[order], label, "left"), np.searchsorted(label[order], label, "right")
    rest = np.arange(n)
    for seed in range(n):
        if out[seed] >= 0:
            continue
        stack = order[cuts[0][seed] : cuts[1][seed]].tolist()
        out[stack] = seed
        rest = rest[out[rest] < 0]
        while stack and len(rest):
            i = stack.pop()
            asked = rest if i >= new else rest[rest >= new]
            if not len(asked):
                continue
            hits = asked[linked(i, asked)]
            if not len(hits):
                continue
            for j in hits.tolist():
                if out[j] < 0:
                    reached = order[cuts[0][j] : cuts[1][j]]
                    out[reached] = seed
                    stack += reached.tolist()
            rest = rest[out[rest] < 0]
    return out


def _smallest(names: list, root: np.ndarray) -> list:
    """Of each row's component the smallest name."""
    least: dict = {}
    for name, r in zip(names, root.tolist()):
        if r not in least or name < least[r]:
            least[r] = name
    return [least[r] for r in root.tolist()]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key without those whose key no neighbour has; the ends of a batch may lie next to more."""
    for batch in batches:
        if batch.num_rows > 2:
            key = batch.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.ones(batch.num_rows, bool)
            keep[1:-1] = same[1:] | same[:-1]
            batch = batch.take(pa.array(np.flatnonzero(keep)))
        yield batch


def _bucket_edges(percent: int, block: int):
    """Rows sorted by (key, n); emits stars over the components of each bucket's pairs within DISTANCE and with sizes near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for _, parts in runs(_shared(batches), ["key"]):
            sids: list[bytes] = []
            sigs, sizes, label = np.empty((0, SYMBOLS), np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)
            seen = 0
            for part in parts(block):
                n = part.column("n").to_numpy()
                old = np.flatnonzero(100 * sizes >= percent * n[0])  # sizes rise, so the others meet nobody any more
                held = len(old)
                sids = [sids[k] for k in old.tolist()] + part.column("sid").to_pylist()
                more = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                sigs, sizes = np.concatenate([sigs[old], more]), np.concatenate([sizes[old], n])
                label = np.concatenate([label[old], seen + np.arange(len(n))])
                seen += len(n)
                if len(sids) == 1:
                    continue

                def linked(i: int, rows: np.ndarray) -> np.ndarray:
                    ok = 100 * np.minimum(sizes[rows], sizes[i]) >= percent * np.maximum(sizes[rows], sizes[i])
                    near = rows[ok]
                    ok[ok] = (sigs[near] != sigs[i]).sum(axis=1) <= DISTANCE
                    return ok

                root = connected(linked, label, held)
                out += {(a, s) for a, s in zip(_smallest(sids, root), sids) if a != s}
                label = label[root]
                if len(out) > 10_000:
                    yield _pairs(out)
                    out = []
        if out:
            yield _pairs(out)
        give_back()

    return run


def _pairs(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*set(out))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a class per task and place; rows repeated with one id and text bring several."""
    seen = set()
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "j", "sid"))))
        new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
        if new:
            yield batch.take(pa.array(new))
    give_back()


def _confirm(width: int, percent: int, kind: pa.DataType):
    """Rows sorted by (grp, i, j); sid, id and label: the smallest label among all that confirmed links or equal labels connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs(batches, ["grp", "i", "j"]):
            sids, sets, labels, ids = [], [], [], []
            seen = set()
            for part in parts(512):
                rows = pa.StructArray.from_arrays([part.column(c).combine_chunks() for c in ("sid", "label", "id")], ["sid", "label", "id"])
                for got, data, starts in doc_bytes(pa.table({"id": rows, "text": part.column("text")}).combine_chunks().to_batches()[0]):
                    hashes, offsets = shingles(data, starts, width)
                    for sid, label, ident, a, b in zip(*(got.field(k).to_pylist() for k in range(3)), offsets[:-1].tolist(), offsets[1:].tolist()):
                        distinct = np.unique(hashes[a:b])
                        if sid not in seen and len(distinct) and digest(distinct) == sid:  # two texts may have one id and hash
                            seen.add(sid)
                            sids.append(sid)
                            sets.append(distinct)
                            labels.append(label)
                            ids.append(ident)
            if not sids:
                continue
            of = {x: k for k, x in enumerate(dict.fromkeys(labels))}
            root = confirmed(sets, percent, np.array([of[x] for x in labels]))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(ids, kind), pa.array(_smallest(labels, root), kind)], ["sid", "id", "label"])
        give_back()

    return run


def confirmed(sets: list[np.ndarray], percent: int, label: np.ndarray) -> np.ndarray:
    """``connected`` over the pairs with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    words, dense = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(len(words), bool)

    def linked(i: int, rows: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[rows], sizes[i]), np.maximum(sizes[rows], sizes[i])
        near = np.flatnonzero(100 * low >= percent * high)
        ok = np.zeros(len(rows), bool)
        if len(near):
            mine = dense[offsets[i] : offsets[i + 1]]
            flag[mine] = True
            which = rows[near]
            if len(which) * 4 > len(sets):
                sums = np.concatenate([[0], np.cumsum(flag[dense])])
                inter = sums[offsets[which + 1]] - sums[offsets[which]]
            else:
                inter = np.array([np.count_nonzero(flag[dense[offsets[r] : offsets[r + 1]]]) for r in which])
            flag[mine] = False
            ok[near] = 100 * inter >= percent * (sizes[which] + sizes[i] - inter)
        return ok

    return connected(linked, label)


def _links(read: DataFrame, classes: DataFrame, groups: DataFrame, width: int, percent: int, block: int, scratch: Scratch) -> DataFrame:
    """a, b: stars over what confirmed links connect in every candidate group (sid, grp).

    Labels and the stars' ends are the classes' smallest ids; classes of one
    document may share theirs, and are linked by that document anyway.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, ddl = to_arrow_type(read.schema["id"].dataType), read.schema["id"].dataType.simpleString()
    half = max(1, block // 2)
    tasks = max(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * read.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    blocks = lambda rows, n: rows.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(half)).cast("int").alias(n))

    def met(members: DataFrame, most: bool = False) -> DataFrame:
        """``members`` has sid, label, grp, i, j; gains the label of what is connected where they meet.

        The narrow rows meet first and are written, so the planner knows their
        size when it joins the texts, which travel to their id and to their
        place.  ``most`` of the classes grow with the input, so they are joined
        the same way at every size; later rounds ask for few.
        """
        asked = scratch.keep(classes.select("sid", "id", "hash").join(members, "sid"))
        asked = asked.hint("merge") if most else asked
        texts = read.join(asked, ["id", "hash"]).select("grp", "i", "j", "sid", "id", "label", "text").mapInArrow(_once, _PLACED.format(id=ddl))
        rows = texts.repartition(tasks, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return scratch.keep(rows.mapInArrow(_confirm(width, percent, kind), f"sid binary, id {ddl}, label {ddl}"))

    def stars(labels: DataFrame) -> DataFrame:
        return labels.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))

    own = groups.join(blocks(groups, "n"), "grp").withColumn("own", dealt("n")).join(classes.select("sid", F.col("id").alias("cid")), "sid")
    first = met(own.select("sid", F.col("cid").alias("label"), "grp", F.col("own").alias("i"), F.col("own").alias("j")), most=True)
    links = stars(first)
    large = scratch.keep(own.where("n > 1"))
    if large.isEmpty():
        return links
    known = large.join(first.select("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "cid"))
    # one class of each component that a block has connected
    heads = known.where("label = cid").drop("n")
    heads = heads.join(blocks(heads, "n"), "grp").withColumn("own", dealt("n"))
    second = met(heads.select("sid", "label", "grp", F.col("own").alias("i"), F.col("own").alias("j")))
    links = links.union(stars(second))
    known = known.join(second.groupBy(F.col("id").alias("label")).agg(F.min("label").alias("further")), "label", "left")
    known = scratch.keep(known.withColumn("label", F.coalesce("further", "label")).drop("further"))
    # classes outside the largest component of a group meet every block of it
    largest = known.groupBy("grp", "label").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("parts"))
    loose = scratch.keep(known.join(largest.where("parts > 1"), "grp"))
    if loose.isEmpty():
        return links
    loose = loose.join(blocks(loose.where("label <> most"), "m"), "grp")
    a = loose.where("label <> most").withColumn("i", dealt("m")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    b = loose.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    columns = ("sid", "label", "grp", "i", "j")
    return links.union(stars(met(a.select(*columns).union(b.select(*columns)).distinct())))


_PLACED = "grp binary, i int, j int, sid binary, id {id}, label {id}, text string"


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near_dedup")
    ddl = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    sketch = scratch.keep(read.mapInArrow(_sketch(width), f"id {ddl}, hash long, n_shingles long, sid binary, sig binary"))
    known = sketch.where(F.col("sid").isNotNull() & F.col("id").isNotNull())
    classes = known.groupBy("sid").agg(F.min(F.struct("id", "hash", "sig")).alias("one"), F.min("n_shingles").alias("n")).select("sid", "one.id", "one.hash", "one.sig", "n")
    keyed = classes.select("sid", "sig", F.col("n").cast("int").alias("n")).mapInArrow(_keys, "sid binary, sig binary, n int, keys array<long>").select("sid", "sig", "n", F.explode("keys").alias("key"))
    near = keyed.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_bucket_edges(percent, block), "a binary, b binary")
    groups = scratch.keep(components(near, scratch).select(F.col("vertex").alias("sid"), F.col("label").alias("grp")))
    del keyed, near
    release_shuffles(spark)

    linked = _links(read, classes, groups, width, percent, block, scratch)
    # a class goes by its smallest id, so the smallest id reachable is a component's own label
    of = classes.select("sid", F.col("id").alias("cid"))
    spans = known.groupBy("id").agg(F.min("sid").alias("s"), F.max("sid").alias("z")).where("s <> z").select("id")
    shared = known.join(spans, "id").select("id", "sid").distinct().join(of, "sid").select(F.col("cid").alias("a"), F.col("id").alias("b"))
    label = components(linked.union(shared), scratch)
    found = of.join(label.withColumnRenamed("vertex", "cid"), "cid", "left").select("sid", F.coalesce("label", "cid").alias("found"))
    out = sketch.join(found, "sid", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays: one document of each group, with every row it has."""
    gone = near_groups(docs, id_col, text_col, width, percent).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    gone = Scratch(docs.sparkSession, "near_dedup").keep(gone)  # written, so the planner knows its size when it joins whole rows
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
