"""Operator 5: exact dedup with Patricia-trie owners.

Texts are equal when identical after every ``[\\x20\\x09-\\x0D]+`` became one
space.  Two levels of owners keep hot groups apart:

1. Each input partition inserts its texts into one compressed radix trie.  A
   terminal holds the smallest identifier and the count of the rows that ended
   there, never the rows: these are sent on one by one with the number of their
   terminal.  A task so passes on one owner per distinct text it holds, however
   many copies there were.
2. Owners are dealt by (length, content hash) and sorted, and each partition
   inserts its full byte strings into one trie, so equality is always decided on
   whole strings, never on hashes.  Terminals keep the smallest identifier and
   add up the counts.

A trie over its budget spills its largest subtree: the subtree's terminals are
sent on and forgotten.  On level 1 a later copy becomes an owner of its own,
which level 2 unites; on level 2 rows come sorted and spills fall between two
keys, when no string in the trie has another copy to come.  No file outside
Spark's shuffles and the shared folder is written.

The result goes back to the rows by a join on the level-1 owner, which has at
most one input partition's rows; nobody gathers a whole group.

Defined results: a null text equals the empty text; a null id sorts after all
others; of rows repeated with one id and text exactly one is kept; a text of any
length is one key and never split; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back

SPACES = r"[\x20\x09-\x0D]+"
HELD_BYTES = 64 << 20
NODE_BYTES = 256  # what a node costs besides its label
BATCH = 2000


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equal, a[:high] not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("label", "children", "end", "held")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.end = None  # of a terminal: what its string owns
        self.held = len(label) + NODE_BYTES  # bytes of the whole subtree


class PatriciaTrie:
    """Compressed radix trie over byte strings; ``end`` of a terminal is made once and changed by the caller."""

    def __init__(self, budget: int = HELD_BYTES):
        self.root, self.budget = _Node(b""), budget

    def insert(self, key: bytes, make: Callable[[], list]) -> list:
        """The end of the string's terminal, made by ``make`` where the string is new."""
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                node.children[key[at]] = leaf
                self._grow(path, leaf.held)
                node, at = leaf, len(key)
                break
            rest = key[at : at + len(child.label)]
            n = len(rest) if rest == child.label else common_prefix(rest, child.label)
            if n < len(child.label):
                top = _Node(child.label[:n])
                child.label = child.label[n:]
                child.held -= n
                top.children[child.label[0]] = child
                top.held += child.held
                node.children[key[at]] = top
                self._grow(path, NODE_BYTES)
                child = top
            node, at = child, at + n
            path.append(node)
        if node.end is None:
            node.end = make()
        return node.end

    @staticmethod
    def _grow(path: list[_Node], n: int) -> None:
        for node in path:
            node.held += n

    @property
    def full(self) -> bool:
        return self.root.held > self.budget and (bool(self.root.children) or self.root.end is not None)

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Takes the largest subtree below the root, or the root's own end, out of the trie: its (string, end)."""
        if not self.root.children:
            yield from self._terminals(self.root, b"")
            self.root = _Node(b"")
            return
        first, largest = max(self.root.children.items(), key=lambda c: c[1].held)
        del self.root.children[first]
        self.root.held -= largest.held
        yield from self._terminals(largest, b"")

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """(string, end) of every terminal."""
        yield from self._terminals(self.root, b"")

    @staticmethod
    def _terminals(node: _Node, before: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.end is not None:
                yield key, node.end
            stack += [(c, key) for c in node.children.values()]


def _smaller(a: tuple, b: tuple) -> bool:
    """Of (id, uid): null ids last."""
    return (a[0] is None, 0 if a[0] is None else a[0], a[1]) < (b[0] is None, 0 if b[0] is None else b[0], b[1])


class _Rows:
    """Tuples gathered into record batches; every yielded batch has at most ``BATCH`` rows."""

    def __init__(self, fields: list[tuple[str, pa.DataType]]):
        self.names, self.types = [f[0] for f in fields], [f[1] for f in fields]
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), self.types)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, self.names)


#: rows of documents have owner, id, uid; rows of owners the others too, with the smallest id and uid
_LOCAL = "owner long, id {id}, uid long, n long, n_bytes int, hash long, text binary, text_sha256 string"


def _local_owners(kind: pa.DataType, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, owners = TaskContext.get().partitionId() << 33, 0, 0
        trie = PatriciaTrie(budget)
        fields = [("owner", pa.int64()), ("id", kind), ("uid", pa.int64()), ("n", pa.int64()), ("n_bytes", pa.int32()), ("hash", pa.int64()), ("text", pa.binary()), ("text_sha256", pa.string())]
        members, out = _Rows(fields), _Rows(fields)

        def send(ends: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            for key, (owner, ident, uid, n, h, sha) in ends:
                yield from out.add((owner, ident, uid, n, len(key), h, key, sha))

        for batch in batches:
            texts = batch.column(1)
            for k, (ident, h, sha) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                uid = base | seq
                seq += 1
                end = trie.insert(texts[k].as_py().encode(), lambda: [base | owners, ident, uid, 0, h, sha])
                owners += not end[3]
                end[3] += 1
                if _smaller((ident, uid), (end[1], end[2])):
                    end[1], end[2] = ident, uid
                yield from members.add((end[0], ident, uid, None, None, None, None, None))
                while trie.full:
                    yield from send(trie.spill())
        yield from send(trie.terminals())
        yield from out.flush()
        yield from members.flush()
        trie.root = None
        give_back()

    return run


#: rows of owners have owner, terminal; rows of terminals the others, with the smallest id and uid
_GLOBAL = "owner long, terminal long, keep_id {id}, keep_uid long, group_size long"


def _global_owners(kind: pa.DataType, budget: int):
    """Rows sorted by (n_bytes, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, terminals = TaskContext.get().partitionId() << 33, 0
        trie, at = PatriciaTrie(budget), None
        fields = [("owner", pa.int64()), ("terminal", pa.int64()), ("keep_id", kind), ("keep_uid", pa.int64()), ("group_size", pa.int64())]
        owners, out = _Rows(fields), _Rows(fields)

        def send(ends: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            for _, end in ends:
                yield from out.add((None, *end))

        for batch in batches:
            texts = batch.column("text")
            columns = [batch.column(c).to_pylist() for c in ("n_bytes", "hash", "id", "uid", "owner", "n")]
            for k, (n_bytes, h, ident, uid, owner, n) in enumerate(zip(*columns)):
                if (n_bytes, h) != at:
                    while trie.full:  # no string so far has another copy to come
                        yield from send(trie.spill())
                    at = (n_bytes, h)
                end = trie.insert(texts[k].as_py(), lambda: [base | terminals, ident, uid, 0])
                terminals += not end[3]
                end[3] += n
                if _smaller((ident, uid), (end[1], end[2])):
                    end[1], end[2] = ident, uid
                yield from owners.add((owner, end[0], None, None, None))
        yield from send(trie.terminals())
        yield from out.flush()
        yield from owners.flush()
        trie.root = None
        give_back()

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = HELD_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    id_type = docs.schema[id_col].dataType
    kind, ddl = to_arrow_type(id_type), id_type.simpleString()
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    read = docs.select(F.col(id_col).alias("id"), norm.alias("text"))
    read = read.select("id", "text", F.xxhash64("text").alias("hash"), F.sha2("text", 256).alias("sha"))
    local = scratch.keep(read.mapInArrow(_local_owners(kind, budget), _LOCAL.format(id=ddl)))
    owners = local.where(F.col("n").isNotNull())
    dealt = owners.select("n_bytes", "hash", "text", "id", "uid", "owner", "n").repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    settled = scratch.keep(dealt.mapInArrow(_global_owners(kind, budget), _GLOBAL.format(id=ddl)))
    ends = settled.where(F.col("owner").isNull()).select("terminal", "keep_id", "keep_uid", "group_size")
    groups = settled.where(F.col("owner").isNotNull()).select("owner", "terminal").join(ends, "terminal")
    groups = groups.join(owners.select("owner", "text_sha256"), "owner")
    members = local.where(F.col("n").isNull()).select("owner", "id", "uid")
    return members.join(groups, "owner").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows repeated with one id are told apart by their rank among themselves.
    """
    groups = exact_groups(docs, id_col, text_col).where("kept")
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    known = F.concat(F.when(F.col(id_col).isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    owners = groups.select(known.alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    keyed = docs.withColumn("__id", known).withColumn("__sha", F.sha2(norm, 256))
    # equal keys on both sides: the duplicates go without another exchange
    return keyed.join(owners, ["__id", "__sha"]).dropDuplicates(["__id", "__sha"]).select(*[F.col(f"`{c}`") for c in docs.columns])
