"""Extension points: extractor, embedder, judge and reranker, with their offline forms.

A hook is a function from columns to columns, or from a batch to a batch for
Arrow code; the offline extractor is plain columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.text import entity_names, sentences


_CAPITAL = re.compile("[A-Z]")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rank(self, query: str, passages: list[str]) -> list[float]: ...


def embed_column(make: Callable[[], Embedder], text: Column) -> Column:
    """Vectors of texts, batch by batch; the embedder is made once per task."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(model.embed([t or "" for t in texts]))

    return run(text)


def rerank_column(make: Callable[[], Reranker], query: str, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(model.rank(query, [t or "" for t in texts]), dtype=float)

    return run(text)


class Judge(Protocol):
    """Which of the candidate facts a new fact contradicts."""

    def contradictions(self, new_fact: str, candidates: list[str]) -> list[int]: ...


class FrameClassifier(Protocol):
    """The canonical name of an unknown predicate, or None for a frame of its own."""

    def classify(self, predicate: str, span: str, known: list[str]) -> str | None: ...


class Synthesizer(Protocol):
    """One text out of several facts."""

    def synthesize(self, facts: list[str]) -> str: ...


class TieBreaker(Protocol):
    """Which of near-equal entities a mention means, or None for a new one."""

    def pick(self, mention: str, context: str, names: list[str]) -> int | None: ...


class Summarizer(Protocol):
    """A profile out of a name and its facts."""

    def summarize(self, name: str, facts: list[str]) -> str: ...


def _hooked(make: Callable[[], object], kind: str, call: Callable, *columns: Column) -> Column:
    """A hook called row by row within Arrow batches; the model is made once per task."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            rows = zip(*batch) if isinstance(batch, tuple) else ((x,) for x in batch)
            yield pd.Series([call(model, *row) for row in rows], dtype=object)

    return run(*columns)


def _texts(x) -> list[str]:
    return [] if x is None else [t or "" for t in x]


def judge_column(make: Callable[[], Judge], new_fact: Column, candidates: Column) -> Column:
    """Indexes (from 0) of the contradicted candidates; what a judge returns beyond them is ignored."""

    def call(model: Judge, fact: str, facts) -> list[int]:
        facts = _texts(facts)
        return sorted({k for k in model.contradictions(fact or "", facts) if 0 <= k < len(facts)}) if facts else []

    return _hooked(make, "array<int>", call, new_fact, candidates)


def classify_column(make: Callable[[], FrameClassifier], predicate: Column, span: Column, known: list[str]) -> Column:
    """A known canonical name or null."""

    def call(model: FrameClassifier, predicate: str, span: str) -> str | None:
        name = model.classify(predicate or "", span or "", known)
        return name if name in known else None

    return _hooked(make, "string", call, predicate, span)


def synthesize_column(make: Callable[[], Synthesizer], facts: Column) -> Column:
    return _hooked(make, "string", lambda model, x: model.synthesize(_texts(x)) if len(_texts(x)) else "", facts)


def pick_column(make: Callable[[], TieBreaker], mention: Column, context: Column, names: Column) -> Column:
    """Index (from 0) of the chosen name, or null."""

    def call(model: TieBreaker, mention: str, context: str, names) -> int | None:
        names = _texts(names)
        k = model.pick(mention or "", context or "", names) if names else None
        return k if k is not None and 0 <= k < len(names) else None

    return _hooked(make, "int", call, mention, context, names)


def summarize_column(make: Callable[[], Summarizer], name: Column, facts: Column) -> Column:
    return _hooked(make, "string", lambda model, n, x: model.summarize(n or "", _texts(x)), name, facts)


def extract(rows: DataFrame, key: str, text: str = "content", carried: tuple[str, ...] = ()) -> DataFrame:
    """key, pos, seq, subject, predicate, object, fact: the offline extractor; ``carried`` columns go along behind the key.

    Names are capitalised runs; the names that a sentence holds give
    ``related_to`` facts between neighbours, a lone name a self-fact.
    """
    own = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *carried))
    found = rows.select(key, *carried, entity_names(F.col(text)).alias("names"), sentences(F.col(text)).alias("sentences"))
    return found.mapInArrow(_told, f"{own}, pos int, seq int, subject string, predicate string, object string, fact string")


def _held(names: list[str]) -> Callable[[str], list[str]]:
    """The names that a sentence holds, in their order.

    A name begins with a capital and has two characters at least: at each capital
    of the sentence the names of the same beginning are looked up by length.
    """
    places = {n: k for k, n in enumerate(names)}
    lengths: dict[str, list[int]] = {}
    for lead, n in sorted({(n[:2], len(n)) for n in names}):
        lengths.setdefault(lead, []).append(n)

    def held(sentence: str) -> list[str]:
        hits = set()
        for m in _CAPITAL.finditer(sentence):
            at = m.start()
            for n in lengths.get(sentence[at : at + 2], ()):
                if at + n > len(sentence):
                    break
                if (k := places.get(sentence[at : at + n])) is not None:
                    hits.add(k)
        return [names[k] for k in sorted(hits)]

    return held


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of whole texts: own columns, names, sentences.  Each name is looked for where it can begin, not in every sentence."""
    for batch in batches:
        *own, names, texts = batch.columns
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            at, *facts = zip(*rows)
            out = [c.take(pa.array(at)) for c in own] + [pa.array(c, k) for c, k in zip(facts, (pa.int32(), pa.int32(), *[pa.string()] * 4))]  # noqa: B023
            rows.clear()  # noqa: B023
            return pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[: len(own)], "pos", "seq", "subject", "predicate", "object", "fact"])  # noqa: B023

        for k in range(batch.num_rows):  # one text at a time as Python objects
            held = _held(names[k].as_py())
            for pos, sentence in enumerate(texts[k].as_py() or ()):
                if here := held(sentence):
                    fact = sentence if sentence.endswith(".") else sentence + "."
                    if len(here) == 1:
                        rows.append((k, pos, 0, here[0], "MENTIONS_WITH", here[0], fact))
                    rows += [(k, pos, seq, a, "related_to", b, fact) for seq, (a, b) in enumerate(zip(here, here[1:]))]
                    if len(rows) >= 20_000:
                        yield packed()
        if rows:
            yield packed()


def parse_extraction(rows: DataFrame, key: str, json_col: str = "json") -> DataFrame:
    """A model's JSON answer as fact rows: lists of subjects and objects give every combination, unknown values their default."""
    schema = "facts array<struct<subject:string,subjects:array<string>,predicate:string,object:string,objects:array<string>,operation:string,memory_class:string,confidence:string,fact:string>>"
    f = rows.select(key, F.posexplode(F.from_json(F.col(json_col), schema)["facts"]).alias("pos", "f"))
    many = lambda one, all_: F.coalesce(all_, F.array(one))
    out = f.select(key, "pos", "f", F.explode(many(F.col("f.subject"), F.col("f.subjects"))).alias("subject")).select(key, "pos", "f", "subject", F.explode(many(F.col("f.object"), F.col("f.objects"))).alias("object"))
    operation = F.lower(F.coalesce("f.operation", F.lit("")))
    return out.select(
        key,
        "pos",
        "subject",
        F.coalesce(F.nullif(F.trim("f.predicate"), F.lit("")), F.lit("related_to")).alias("predicate"),
        "object",
        F.when(operation.isin("assert", "terminate", "correct", "qualify", "noop"), operation).otherwise("assert").alias("operation"),
        F.when(F.lower("f.memory_class").isin("objective", "preference", "goal", "belief", "trait", "constraint", "style", "self_model"), F.lower("f.memory_class")).otherwise("objective").alias("memory_class"),
        F.coalesce(F.col("f.confidence").try_cast("double"), F.lit(1.0)).alias("confidence"),
        F.col("f.fact").alias("fact"),
    )
