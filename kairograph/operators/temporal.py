"""Bitemporal facts: slots, closure, deduplication, conflicts, snapshots.

Facts arrive in the order of ``seq``.  A slot is (group, subject, canonical
predicate, qualifier hash, memory class).  Closure is a set operation over
windows partitioned by slot, so it scales with the largest slot, not with the
table; equal slots are the only rows that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.text import IDENTITY_PREDICATES, LOCATION_FILLERS, LOCATION_PREDICATES, TRANSITION_CUES

SLOT = ("group_id", "source_node_uuid", "name")


def resolve_frames(facts: DataFrame, frames: DataFrame, predicate: str = "relation", tenant: DataFrame | None = None) -> DataFrame:
    """Adds the frame's columns; a tenant's frame beats the global one; unknown predicates keep their name."""
    key = F.lower(F.trim(F.col(predicate)))
    out = facts.withColumn("__p", key).join(F.broadcast(frames.withColumnRenamed("alias", "__p").drop("n")), "__p", "left")
    if tenant is not None:
        own = tenant.select(F.col("group_id"), F.col("alias").alias("__p"), *[F.col(c).alias(f"__{c}") for c in frames.columns if c not in ("alias", "n")])
        out = out.join(F.broadcast(own), ["group_id", "__p"], "left")
        hit = F.col("__canonical").isNotNull()  # taken before any of the columns is replaced
        merged = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in frames.columns if c not in ("alias", "n")}
        out = out.withColumns(merged).drop(*[f"__{c}" for c in merged])
    return out.withColumn("canonical", F.coalesce("canonical", "__p")).drop("__p")


def symmetric(source: str = "source_node_uuid", target: str = "target_node_uuid") -> tuple[Column, Column]:
    """Endpoints in order for symmetric frames, as they are otherwise."""
    sym = F.coalesce(F.col("direction") == "symmetric", F.lit(False))
    s, o = F.col(source), F.col(target)
    return F.when(sym, F.least(s, o)).otherwise(s), F.when(sym, F.greatest(s, o)).otherwise(o)


def repair(facts: DataFrame, speaker: str | None = None) -> DataFrame:
    """subject, predicate, object cleaned; ``keep`` tells whether the fact can be stored."""
    s, o = F.trim(F.coalesce("subject", F.lit(""))), F.trim(F.coalesce("object", F.lit("")))
    p = F.lower(F.trim(F.coalesce("predicate", F.lit(""))))
    loop = s == o
    identity = p.isin(*IDENTITY_PREDICATES)
    filler = p.isin(*LOCATION_PREDICATES) & F.lower(o).isin(*LOCATION_FILLERS)
    keep = (s != "") & (o != "") & (p != "") & ~filler & (~loop | identity)
    subject = F.when(loop & identity & (s != speaker), F.lit(speaker)).otherwise(s) if speaker else s
    return facts.withColumns({"keep": keep, "subject": F.when(keep, subject).otherwise(s), "object": o, "predicate": p})


def close_slots(facts: DataFrame, slot: tuple[str, ...] = SLOT, obj: str = "target_node_uuid", order: str = "seq", op: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Singleton closure: one edge per run of equal objects in a slot.

    A run starts at an assert whose object differs from the last asserted one
    or that follows a terminate; a terminate counts if it names the current
    object.  A run is closed by its terminate or by the next run.
    """
    w = Window.partitionBy(*slot).orderBy(order)
    kind = F.coalesce(F.col(op), F.lit("assert")) if op else F.lit("assert")
    rows = facts.withColumn("__op", kind).where(F.col("__op").isin("assert", "terminate"))
    asserted = F.when(F.col("__op") == "assert", F.col(obj))
    rows = rows.withColumn("__prev", F.last(asserted, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where((F.col("__op") == "assert") | F.col("__prev").eqNullSafe(F.col(obj)))
    starts = (F.col("__op") == "assert") & (F.col("__prev").isNull() | (F.col("__prev") != F.col(obj)) | F.coalesce(F.lag("__op").over(w) == "terminate", F.lit(False)))
    rows = rows.withColumn("__island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__island > 0")
    made = F.col("__op") == "assert"
    islands = rows.groupBy(*dict.fromkeys((*slot, "__island", obj))).agg(
        F.min_by("uuid", F.when(made, F.col(order))).alias("uuid"),
        F.min(order).alias(order),
        F.min_by("valid_at", F.when(made, F.col(order))).alias("valid_at"),
        F.min_by("valid_at", F.when(~made, F.col(order))).alias("__ended"),
        F.min(F.when(~made, F.col(order))).alias("__ended_seq"),
        F.count_if(made).alias("n_asserts"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    nxt = Window.partitionBy(*slot).orderBy("__island")
    islands = islands.withColumns({"__next_seq": F.lead(order).over(nxt), "__next_at": F.lead("valid_at").over(nxt), "__next": F.lead("uuid").over(nxt), "__before": F.lag("uuid").over(nxt), "__before_ended": F.lag("__ended").over(nxt)})
    return islands.withColumns(
        {
            "invalid_at": F.coalesce("__ended", "__next_at"),
            "closed_seq": F.when(F.col("__ended_seq").isNotNull(), F.col("__ended_seq")).otherwise(F.col("__next_seq")),
            "status": F.when(F.col("__ended").isNull() & F.col("__next").isNull(), "active").otherwise("superseded"),
            "superseded_by": F.when(F.col("__ended").isNull(), F.col("__next")),
            "supersedes": F.when(F.col("__before_ended").isNull(), F.col("__before")),
        }
    ).drop("__island", "__ended", "__next_at", "__next", "__before", "__before_ended", "__ended_seq", "__next_seq")


def dedupe(facts: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """One edge per fact key among rows that are still open: first row, all episodes."""
    rows = facts.withColumn("fact_key", key)
    episodes = rows.select("fact_key", F.explode("episodes").alias("e")).groupBy("fact_key").agg(F.array_sort(F.collect_set("e")).alias("episodes"))
    first = rows.groupBy("fact_key").agg(F.min_by("uuid", order).alias("uuid"), F.min("valid_at").alias("valid_at"), F.count("*").alias("n_rows"))
    return first.join(episodes, "fact_key", "left")


def mark_conflicts(facts: DataFrame, slot: tuple[str, ...] = SLOT, obj: str = "target_node_uuid", order: str = "seq") -> DataFrame:
    """Policy ``uncertain``: rows after the first object of a slot need resolution and share a conflict group."""
    w = Window.partitionBy(*slot).orderBy(order)
    first = F.first(obj).over(w)
    out = facts.withColumn("__first", first)
    seen = F.max(F.when(F.col(obj) != F.col("__first"), F.lit(1)).otherwise(0)).over(Window.partitionBy(*slot))
    return out.withColumns(
        {
            "conflict_group": F.when(seen == 1, F.concat_ws("::", *slot)),
            "resolution": F.when(F.col(obj) != F.col("__first"), F.lit("needs_resolution")).otherwise(F.lit("active")),
        }
    ).drop("__first")


def latest_per_slot(facts: DataFrame, t: Column, keys: tuple[str, ...] = ("source_node_uuid", "name", "target_node_uuid")) -> DataFrame:
    """State at a time: the newest fact valid then per key."""
    from .filters import as_of

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("valid_at"), "uuid"))
    return facts.where(as_of(t)).withColumn("__r", rank).where("__r = 1").drop("__r")


def interval_join(probes: DataFrame, facts: DataFrame, keys: list[str], at: str = "t", day: int = 1) -> DataFrame:
    """Each probe with the facts valid at its time.

    Times are cut into bins of ``day`` days.  A validity interval is covered by
    nested bins of 1, 2, 4, ... such bins, at most two of each size, and a probe
    lies in one bin of each size, so both sides grow with the logarithm of the
    span only and meet in an equi-join on (keys, size, bin); an open interval
    ends at the last probe.
    """
    span = day * 86_400
    bin_of = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / span)
    first, last = probes.agg(F.min(bin_of(F.col(at))), F.max(bin_of(F.col(at)))).first()
    if first is None:
        first, last = 0, -1  # no probe, no bin
    levels = max(last - first + 1, 1).bit_length()
    # bins are counted from the first probe's; nothing before it is asked for
    start = F.greatest(bin_of(F.col("valid_at")) - first, F.lit(0))
    stop = F.least(F.coalesce(bin_of(F.col("invalid_at")), F.lit(last)), F.lit(last)) - first + 1
    cut = facts.withColumn("__from", start.cast("long")).withColumn("__stop", stop.cast("long")).where("__from < __stop")
    parts = []
    for k in range(levels):
        low, high = F.shiftright(F.col("__from") + ((1 << k) - 1), k), F.shiftright(F.col("__stop"), k)
        parts.append(F.when((low < high) & (low % 2 == 1), F.struct(F.lit(k).alias("level"), low.alias("bin"))))
        parts.append(F.when((low < high) & (high % 2 == 1), F.struct(F.lit(k).alias("level"), (high - 1).alias("bin"))))
    cut = cut.withColumn("__b", F.explode(F.array_compact(F.array(*parts)))).withColumns({"__level": F.col("__b.level"), "__bin": F.col("__b.bin")}).drop("__from", "__stop", "__b")
    own = (bin_of(F.col(at)) - first).cast("long")
    p = probes.withColumn("__own", own).withColumn("__b", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("__own"), k).alias("bin")) for k in range(levels)])))
    p = p.withColumns({"__level": F.col("__b.level"), "__bin": F.col("__b.bin")}).drop("__own", "__b")
    hit = p.join(cut, [*keys, "__level", "__bin"])
    return hit.where((F.col("valid_at") <= F.col(at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col(at)))).drop("__level", "__bin")


def invalidate(facts: DataFrame, closers: DataFrame, now: Column) -> DataFrame:
    """Applies closers (uuid, closed_at, closed_by): only open rows, or those that would close later."""
    first = closers.groupBy("uuid").agg(F.min(F.struct("closed_at", "closed_by")).alias("c"))
    out = facts.join(first, "uuid", "left")
    hit = F.col("c").isNotNull() & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col("c.closed_at")))
    return out.withColumns(
        {
            "superseded_by": F.when(hit, F.col("c.closed_by")),
            "expired_at": F.when(hit, now).otherwise(F.col("expired_at")),
            "status": F.when(hit, F.lit("superseded")).otherwise(F.col("status")),
            "invalid_at": F.when(hit, F.col("c.closed_at")).otherwise(F.col("invalid_at")),
        }
    ).drop("c")


def shared_tokens(a: Column, b: Column) -> Column:
    """Distinct words of over two characters that both texts hold."""
    words = lambda t: F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2)
    return F.size(F.array_intersect(words(a), words(b)))


def has_cue(text: Column) -> Column:
    out = F.lit(False)
    for cue in TRANSITION_CUES:
        out = out | F.lower(text).contains(cue)
    return out


def judge(pairs: DataFrame) -> Column:
    """The offline judge: a transition cue and the same subject, object or a shared word."""
    same = lambda a, b: (F.lower(a) == F.lower(b)) & (F.lower(a) != "")
    near = same(F.col("new_subject"), F.col("subject")) | same(F.col("new_object"), F.col("object")) | (shared_tokens(F.col("new_fact"), F.col("fact")) >= 1)
    return has_cue(F.col("new_fact")) & near


def peers(facts: DataFrame, on: str, other: str) -> DataFrame:
    """Pairs of active facts of a group that share ``on`` and differ in ``other``; the newcomer is the later row."""
    cols = ["group_id", on, "uuid", "seq", other, "is_belief"]
    a = facts.select(*cols)
    b = facts.select("group_id", on, *[F.col(c).alias(f"peer_{c}") for c in ("uuid", "seq", other, "is_belief")])
    return a.join(b, ["group_id", on]).where((F.col("peer_seq") < F.col("seq")) & (F.col(f"peer_{other}") != F.col(other)))


def peer_counts(facts: DataFrame, on: str, other: str, within: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """uuid, n_peers, first_peer: what ``peers`` pairs a row with, counted without the pairs.

    Earlier rows that share ``on``, less those that share ``other`` too; the
    first peer is the partition's first row, or the first that differs from it
    in ``other``.
    """
    w = Window.partitionBy(*within, on).orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*within, on, other).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = facts.withColumns({"__all": F.count("*").over(before), "__same": F.count("*").over(same), "__first": F.first(other).over(w), "__at": F.first("seq").over(w)})
    second = F.min(F.when(F.col(other) != F.col("__first"), F.col("seq"))).over(before)
    first = F.when(F.col(other) != F.col("__first"), F.col("__at")).otherwise(F.col("__second"))
    return rows.withColumn("__second", second).select("uuid", (F.col("__all") - F.col("__same")).alias("n_peers"), first.alias("first_peer"))


def endpoint_candidates(facts: DataFrame, live: Column) -> DataFrame:
    """uuid, n_candidates, first_candidate: earlier live facts with the same subject or the same object, counted without the pairs."""
    rows = facts.withColumn("__live", live.cast("int"))
    ends = {"s": ("source_node_uuid",), "o": ("target_node_uuid",), "b": ("source_node_uuid", "target_node_uuid")}
    for k, columns in ends.items():
        w = Window.partitionBy("group_id", "is_belief", *columns).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"__n{k}": F.coalesce(F.sum("__live").over(w), F.lit(0)), f"__f{k}": F.min(F.when(F.col("__live") == 1, F.col("seq"))).over(w)})
    return rows.select("uuid", (F.col("__ns") + F.col("__no") - F.col("__nb")).alias("n_candidates"), F.least("__fs", "__fo").alias("first_candidate"))


def contradicted(facts: DataFrame, live: Column) -> DataFrame:
    """uuid, closed_by_seq of live facts: the first later fact at one of their ends whose text has a cue.

    For facts that share an end the offline judge asks for nothing but the cue,
    so the earliest closer is a window minimum and no pair is made.
    """
    rows = facts.withColumns({"__live": live, "__cue": F.when(has_cue(F.col("fact")), F.col("seq"))})
    later = []
    for k, column in enumerate(("source_node_uuid", "target_node_uuid")):
        # from the last row backwards: a frame that grows is summed up once, one that shrinks anew for every row
        w = Window.partitionBy("group_id", "is_belief", column).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"__c{k}", F.min("__cue").over(w))
        later.append(f"__c{k}")
    return rows.where("__live").select("uuid", F.least(*later).alias("closed_by_seq"))
