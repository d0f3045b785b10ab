"""Structured filters: declarative descriptions compiled to one Boolean column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.decay import memory_class

_OPS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}
NULLARY = {"IS NULL": lambda a: a.isNull(), "IS NOT NULL": lambda a: a.isNotNull()}


def ntz(text: str) -> Column:
    """A literal time."""
    return F.lit(text).cast("timestamp_ntz")


def compare(value: Column, op: str, operand: Column | None) -> Column:
    """A null on either side is false, but for the two null tests."""
    if op in NULLARY:
        return NULLARY[op](value)
    if operand is None:
        return F.lit(False)
    return F.coalesce(_OPS[op](value, operand), F.lit(False))


def _all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def active() -> Column:
    return (F.col("status") == "active") & F.col("invalid_at").isNull()


def valid_now(now: Column) -> Column:
    """Neither closed nor expired by ``now``; a status other than active drops."""
    open_ = F.coalesce(F.col("invalid_at") > now, F.lit(True)) & F.coalesce(F.col("expired_at") > now, F.lit(True))
    return open_ & F.coalesce(F.col("status").isin("", "active"), F.lit(True))


def as_of(t: Column) -> Column:
    """Half-open validity at a time."""
    return (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def date_dnf(column: str, windows: Sequence[Sequence[tuple[str, str | None]]]) -> Column:
    """OR over windows of AND over (operator, time); no windows accept everything."""
    if not windows:
        return F.lit(True)
    return _any([_all([compare(F.col(column), op, None if t is None else ntz(t)) for op, t in w]) for w in windows])


def property_is(columns: Sequence[str], name: str, op: str, value: object = None, bag: str = "attributes") -> Column:
    """A column of that name, else the key of the JSON bag; values of another type do not match."""
    kind = "double" if isinstance(value, (int, float)) and not isinstance(value, bool) else "boolean" if isinstance(value, bool) else "string"
    held = F.get_json_object(F.col(bag), f"$.{name}") if bag in columns else F.lit(None).cast("string")
    if op in NULLARY:
        return NULLARY[op](F.coalesce(F.col(name).cast("string"), held) if name in columns else held)
    cast = held.try_cast(kind)
    actual = F.coalesce(F.col(name).try_cast(kind), cast) if name in columns else cast
    return compare(actual, op, F.lit(value))


@dataclass(frozen=True)
class SearchFilters:
    node_labels: Sequence[str] | None = None
    edge_types: Sequence[str] | None = None
    edge_uuids: Sequence[str] | None = None
    dates: dict[str, Sequence[Sequence[tuple[str, str | None]]]] = field(default_factory=dict)
    properties: Sequence[tuple[str, str, object]] = ()
    memory_classes: Sequence[str] | None = None

    def edges(self, columns: Sequence[str]) -> Column:
        out = [date_dnf(c, w) for c, w in self.dates.items()]
        if self.edge_types is not None:
            out.append(F.col("name").isin(*self.edge_types) if self.edge_types else F.lit(False))
        if self.edge_uuids is not None:
            out.append(F.col("uuid").isin(*self.edge_uuids) if self.edge_uuids else F.lit(False))
        out += [property_is(columns, *p) for p in self.properties]
        if self.memory_classes is not None:
            out.append(memory_class(F.col("memory_class")).isin(*self.memory_classes))
        return F.coalesce(_all(out), F.lit(False))

    def nodes(self) -> Column:
        if self.node_labels is None:
            return F.lit(True)
        return F.coalesce(F.arrays_overlap("labels", F.array(*map(F.lit, self.node_labels))), F.lit(False))


@dataclass(frozen=True)
class GraphView:
    """Filter of the graph view; null-tolerant where a missing value means "no limit"."""

    group_id: str | None = None
    include_invalid: bool = False
    as_of: str | None = None
    status: Sequence[str] | None = None
    source_type: Sequence[str] | None = None
    canonical: Sequence[str] | None = None
    conflict_only: bool = False
    derived_only: bool = False
    visibility: str = "all"
    min_confidence: float | None = None
    valid_after: str | None = None
    valid_before: str | None = None

    def column(self) -> Column:
        c = F.col
        lax = lambda cond, *names: reduce(lambda a, b: a | b, [c(n).isNull() for n in names]) | cond
        untouched = c("invalid_at").isNull() & c("expired_at").isNull()
        out: list[Column] = []
        if self.group_id:
            out.append(c("group_id") == self.group_id)
        if not self.include_invalid:
            out.append(untouched)
        if self.as_of:
            out += [lax(c("valid_at") <= ntz(self.as_of), "valid_at"), lax(c("invalid_at") > ntz(self.as_of), "invalid_at")]
        if self.status:
            out.append(c("status").isin(*self.status))
        if self.source_type:
            out.append(c("source_type").isin(*self.source_type))
        if self.canonical:
            wanted = [x.lower() for x in self.canonical]
            out.append(F.coalesce(c("canonical_name").isin(*wanted), F.lit(False)) | c("name").isin(*wanted))
        if self.conflict_only or self.visibility == "conflicts":
            out.append(F.coalesce(c("conflict_group_id"), F.lit("")) != "")
        if self.derived_only or self.visibility == "derived":
            out.append(c("derived"))
        if self.visibility == "non_derived":
            out.append(~F.coalesce(c("derived"), F.lit(False)))
        if self.visibility == "invalidated":
            out.append(~untouched | F.coalesce(c("status") == "superseded", F.lit(False)))
        if self.visibility == "active":
            out += [untouched, F.coalesce(c("status"), F.lit("")).isin("", "active")]
        if self.min_confidence is not None:
            out.append(lax(c("confidence") >= self.min_confidence, "confidence"))
        if self.valid_after:
            out.append(lax(c("valid_at") >= ntz(self.valid_after), "valid_at"))
        if self.valid_before:
            out.append(lax(c("valid_at") <= ntz(self.valid_before), "valid_at"))
        return F.coalesce(_all(out), F.lit(False))


def ego_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either endpoint among ``nodes`` (a DataFrame with ``node``)."""
    hit = F.col("source_node_uuid") == F.col("node"), F.col("target_node_uuid") == F.col("node")
    out = edges.join(nodes, hit[0], "left_semi").select("uuid").union(edges.join(nodes, hit[1], "left_semi").select("uuid"))
    return edges.join(out.distinct(), "uuid", "left_semi")


def inner_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among ``nodes``."""
    ids = nodes.select("node")
    first = edges.join(ids, F.col("source_node_uuid") == F.col("node"), "left_semi")
    return first.join(ids, F.col("target_node_uuid") == F.col("node"), "left_semi")


def by_type_map(facts: DataFrame, labels: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts whose (subject label, object label) pair allows their predicate.

    ``labels`` has node, label; ``rules`` has subject_label, object_label,
    allowed (array; empty: unrestricted).  A fact without any matching pair drops.
    """
    s = labels.select(F.col("node").alias("source_node_uuid"), F.col("label").alias("subject_label"))
    o = labels.select(F.col("node").alias("target_node_uuid"), F.col("label").alias("object_label"))
    pairs = facts.select("uuid", "name", "source_node_uuid", "target_node_uuid").join(s, "source_node_uuid").join(o, "target_node_uuid")
    ok = pairs.join(rules, ["subject_label", "object_label"]).where((F.size("allowed") == 0) | F.expr("array_contains(allowed, name)"))
    return facts.join(ok.select("uuid").distinct(), "uuid", "left_semi")


def without_types(entities: DataFrame, facts: DataFrame, banned: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entities without banned labels, and the facts between them."""
    kept = entities.where(~F.arrays_overlap("labels", F.array(*map(F.lit, banned))))
    return kept, inner_graph(facts, kept.select(F.col("uuid").alias("node")))


def text_contains(nodes: DataFrame, links: DataFrame, needle: str) -> DataFrame:
    """Nodes whose text holds the needle, and endpoints of links whose text does."""
    wanted = needle.lower()
    hit = nodes.where(F.lower(F.concat_ws(" ", "name", "summary")).contains(wanted)).select("uuid")
    via = links.where(F.lower(F.concat_ws(" ", "name", "fact")).contains(wanted))
    ends = via.select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("uuid"))
    return nodes.join(hit.union(ends).distinct(), "uuid", "left_semi")
