"""The write path of facts as set operations: what a stream of claims leaves behind.

Claims arrive in the order of ``seq``; stored edges take part as claims that
came before.  The layers, in the order in which they decide:

* dedupe: a claim equal to an open edge (fact key with qualifiers) adds its
  episodes to it and does nothing else;
* L0: edges that a claim declares replaced are closed by it;
* L1: a claim of a singleton slot closes the slot's other open edges.  A slot
  is (tenant, subject, predicate, qualifiers, memory class); it is singleton by
  its frame, or for a predicate without a frame by the user's own mark;
* L2: ``terminate`` closes and adds nothing, ``correct`` counts as singleton,
  ``qualify`` closes nobody, ``noop`` is dropped;
* L3: a claim that L1 left alone, under no ``coexist`` frame, closes what the
  judge finds contradicted at its ends;
* L4: under an ``uncertain`` frame, what is left open with several objects in a
  slot needs resolution and shares a conflict group.

Slots of singleton claims only are closed by windows, slots without any by
windows per object; slots that mix both are worked through in order, slot after
slot in a task, so work grows with the largest such slot.  L3 sees the state that
L0 to L2 leave: an edge that both would close goes to the earlier closer, and an
equal claim that comes after a closure by L3 still counts for the closed edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal
from .graph import written

SLOT = ("group_id", "source_node_uuid", "name", "qhash", "memory_class")
CLAIM = {
    "operation": "assert",
    "singleton": False,
    "source_type": "user",
    "qhash": "",
    "memory_class": "objective",
    "is_belief": False,
    "fact": "",
}
_EDGE = "uuid string, seq long, {0}, target_node_uuid string, valid_at long, closed_seq long, invalid_at long, superseded_by string, n_claims long, closed_any boolean".format(", ".join(f"{c} string" for c in SLOT))
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def claims(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows with defaults for what they lack, their frame, ordered symmetric ends and ``single``.

    ``rows``: uuid, seq, group_id, source_node_uuid, relation, target_node_uuid, valid_at and any of ``CLAIM``.
    """
    for name, default in CLAIM.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default))
    rows = temporal.resolve_frames(rows, frames)
    s, o = temporal.symmetric()
    framed = F.col("cardinality").isNotNull()
    op = F.lower(F.trim("operation"))
    single = (op != "qualify") & (F.coalesce("policy", F.lit("")) != "uncertain") & F.when(framed, F.col("cardinality") == "one_current").otherwise((F.col("singleton") | (op == "correct")) & (F.col("source_type") == "user"))
    return rows.withColumns({"source_node_uuid": s, "target_node_uuid": o, "name": F.col("canonical"), "operation": op, "single": single}).where("operation <> 'noop'")


def _spread(rows: DataFrame) -> DataFrame:
    """A terminate reaches every slot of its subject and predicate that has its object, whatever the qualifiers."""
    ends = rows.where("operation = 'terminate'")
    places = rows.where("operation <> 'terminate'").select("group_id", "source_node_uuid", "name", "target_node_uuid", "qhash", "memory_class").distinct()
    ends = ends.drop("qhash", "memory_class").join(places, ["group_id", "source_node_uuid", "name", "target_node_uuid"])
    return rows.where("operation <> 'terminate'").unionByName(ends.select(*rows.columns))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mixed slots, one after the other, claim by claim: rows come sorted by slot and ``seq``, only a slot's open edges are held."""
    names = [f.split()[0] for f in _EDGE.split(", ")]
    kinds = [_ARROW[f.split()[1]] for f in _EDGE.split(", ")]
    done: list[tuple] = []
    slot, held = None, {}

    def shut(edge: list, *closer) -> None:
        uuid, seq, obj, at, n, any_ = edge
        done.append((uuid, seq, *slot, obj, at, *closer, n, any_))

    def packed() -> pa.RecordBatch:
        columns = zip(*done) if done else [()] * len(names)
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        done.clear()
        return out

    for batch in batches:
        for *key, uuid, seq, obj, at, operation, single in zip(*[c.to_pylist() for c in batch.columns]):
            if key != slot:
                for edge in held.values():
                    shut(edge, None, None, None)
                slot, held = key, {}
            if operation == "terminate":
                if obj in held:
                    shut(held.pop(obj), seq, at, None)
                continue
            if obj in held:
                held[obj][4] += 1
                continue
            edge = [uuid, seq, obj, at, 1, False]
            if single:
                for old in held.values():
                    shut(old, seq, at, uuid)
                edge[5] = bool(held)
                held = {}
            held[obj] = edge
        yield packed()
    for edge in held.values():
        shut(edge, None, None, None)
    yield packed()


def _by_windows(rows: DataFrame, slot: tuple[str, ...]) -> DataFrame:
    """Edges of slots in which every claim closes its peers."""
    op = F.when(F.col("operation") == "terminate", "terminate").otherwise("assert")
    out = temporal.close_slots(rows.withColumn("op", op), slot=slot, order="seq", op="op")
    return out.select("uuid", "seq", *SLOT, "target_node_uuid", "valid_at", "closed_seq", "invalid_at", "superseded_by", F.col("n_asserts").alias("n_claims"), F.col("supersedes").isNotNull().alias("closed_any"))


def close(rows: DataFrame) -> DataFrame:
    """Edges after dedupe, L1 and L2: their claim, slot, object, validity, closer, number of claims, and whether they closed a peer."""
    rows = _spread(rows).select("uuid", "seq", *SLOT, "target_node_uuid", "valid_at", "operation", "single")
    made = F.col("operation") != "terminate"
    whole = Window.partitionBy(*SLOT)
    known = rows.withColumns({"every": F.bool_and(F.when(made, F.col("single"))).over(whole), "some": F.bool_or(F.when(made, F.col("single"))).over(whole)})
    known = written(known)  # read by each of the three
    single = _by_windows(known.where("every").drop("every", "some"), SLOT)
    plain = _by_windows(known.where("not some").drop("every", "some"), (*SLOT, "target_node_uuid")).withColumns({"superseded_by": F.lit(None).cast("string"), "closed_any": F.lit(False)})
    mixed = known.where("some and not every").select(*SLOT, "uuid", "seq", "target_node_uuid", F.unix_micros(F.col("valid_at").cast("timestamp")).alias("valid_at"), "operation", "single")
    mixed = mixed.repartition(*SLOT).sortWithinPartitions(*SLOT, "seq").mapInArrow(_in_order, _EDGE)
    back = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    mixed = mixed.select("uuid", "seq", *SLOT, "target_node_uuid", back("valid_at"), "closed_seq", back("invalid_at"), "superseded_by", "n_claims", "closed_any")
    return single.unionByName(plain).unionByName(mixed)


def judged(edges: DataFrame, rows: DataFrame, cue: Column | None = None) -> DataFrame:
    """Edges after L3: each is closed by the first later claim with a cue at one of its ends that L1 left alone.

    ``rows`` are claims with fact, policy and is_belief; ``edges`` those of ``close``.
    """
    told = rows.where("operation <> 'terminate'").select("uuid", "fact", "policy", "is_belief")
    out = edges.join(told, "uuid").withColumn("__cue", (temporal.has_cue(F.col("fact")) if cue is None else cue) & ~F.col("closed_any") & (F.coalesce("policy", F.lit("")) != "coexist"))
    closer = F.when(F.col("__cue"), F.struct("seq", "valid_at", "uuid"))
    for k, column in enumerate(("source_node_uuid", "target_node_uuid")):
        # from the last row backwards: a frame that grows is summed up once, one that shrinks anew for every row
        w = Window.partitionBy("group_id", "is_belief", column).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"__c{k}", F.min(closer).over(w))
    out = out.withColumn("__c", F.least("__c0", "__c1"))
    hit = F.col("__c").isNotNull() & (F.col("closed_seq").isNull() | (F.col("__c.seq") < F.col("closed_seq")))
    out = out.withColumns({"invalid_at": F.when(hit, F.col("__c.valid_at")).otherwise(F.col("invalid_at")), "superseded_by": F.when(hit, F.col("__c.uuid")).otherwise(F.col("superseded_by")), "closed_seq": F.when(hit, F.col("__c.seq")).otherwise(F.col("closed_seq"))})
    return out.drop("__cue", "__c0", "__c1", "__c", "fact")


def write_facts(rows: DataFrame, frames: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Edges with status, closure and conflict group; ``merged_to`` is the last ``seq`` whose equal claims went into the edge.

    ``replaced`` (uuid, closed_seq, closed_at, closed_by) names edges that claims declare replaced (L0).
    """
    told = written(claims(rows, frames))  # every layer reads it again
    out = written(close(told)).withColumn("merged_to", F.col("closed_seq"))
    if replaced is not None:
        first = replaced.groupBy("uuid").agg(F.min(F.struct("closed_seq", "closed_at", "closed_by")).alias("__r"))
        out = out.join(first, "uuid", "left")
        hit = F.col("__r").isNotNull() & (F.col("closed_seq").isNull() | (F.col("__r.closed_seq") < F.col("closed_seq")))
        out = out.withColumns({"invalid_at": F.when(hit, F.col("__r.closed_at")).otherwise(F.col("invalid_at")), "superseded_by": F.when(hit, F.col("__r.closed_by")).otherwise(F.col("superseded_by")), "closed_seq": F.when(hit, F.col("__r.closed_seq")).otherwise(F.col("closed_seq"))}).drop("__r")
    out = judged(out, told)
    open_ = F.col("closed_seq").isNull() & (F.coalesce("policy", F.lit("")) == "uncertain")
    peers = out.where(open_).groupBy(*SLOT).agg(F.count_distinct("target_node_uuid").alias("__o")).where("__o > 1")
    out = out.join(peers, list(SLOT), "left")
    conflict = open_ & F.col("__o").isNotNull()
    status = F.when(F.col("closed_seq").isNotNull(), "superseded").when(conflict, "needs_resolution").otherwise("active")
    return out.withColumns({"status": status, "conflict_group_id": F.when(conflict, F.concat_ws("::", *SLOT))}).drop("__o")
