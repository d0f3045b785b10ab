"""Operator 9: secret scans with a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over mandatory
trigrams (AND over what must occur, OR over alternatives).  Per block of rows
an inverted index of the query trigrams is built with numpy over the folded
bytes; postings are intersected and united as the query says, and only the
candidates are verified with the expression.  A rule without mandatory
trigrams (``hex``) scans every row.  Blocks are Arrow batches, so nothing is
shuffled and memory is bounded by a batch.

Defined results: a null text is empty and has no spans; every input row gives
one output row; a text of any length is scanned whole; an empty table gives an empty result; other columns are not
read.  Offsets are code points, ends exclusive; expressions are ASCII-only in
their case folding.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False


#: The base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Kinds the method adds.
MORE = (
    # to its END line, or over the lines of base64 that follow where none comes before the next mark
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*-----END [A-Z ]*PRIVATE KEY-----|(?:\s*\n[A-Za-z0-9+/=]{16,}(?!\S))*)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
#: A query is True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple[str, tuple]
_MOST = 64  # alternatives kept while literals are multiplied out; beyond it the condition is dropped, never a match


def _join(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "or" and (True in parts or not parts):
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _trigrams(word: bytes) -> Query:
    return _join("and", [word[i : i + 3] for i in range(len(word) - 2)])


def _class(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if op is C.LITERAL and arg < 128:
            out.add(bytes([arg]))
        elif op is C.RANGE and arg[1] < 128 and arg[1] - arg[0] < 8:
            out |= {bytes([x]) for x in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > 8:
            return None
    return out


def _walk(tokens) -> tuple[set[bytes] | None, Query]:
    """(every string the tokens can match, or None if not listable; the trigram query)."""
    exact: set[bytes] | None = {b""}
    held: set[bytes] = {b""}  # strings of the run of listable tokens being read
    query: list[Query] = []

    def flush() -> None:
        nonlocal held
        query.append(_join("or", [_trigrams(w) for w in held]))
        held = {b""}

    for op, arg in tokens:
        can: set[bytes] | None = None
        inner: Query = True
        if op is C.LITERAL:
            can = {chr(arg).encode()}
        elif op is C.IN:
            can = _class(arg)
        elif op is C.AT:
            can = {b""}
        elif op is C.SUBPATTERN:
            can, inner = _walk(arg[3])
        elif op is C.BRANCH:
            found = [_walk(b) for b in arg[1]]
            can = set().union(*(c for c, _ in found)) if all(c is not None for c, _ in found) else None
            inner = _join("or", [q for _, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            sub_can, sub_query = _walk(sub)
            if (low, high) == (0, 1) and sub_can is not None:
                can = sub_can | {b""}
            elif low:
                inner = sub_query
        if can is not None and len(held) * len(can) <= _MOST:
            held = {a + b for a in held for b in can}
            exact = {a + b for a in exact for b in can} if exact is not None and len(exact) * len(can) <= _MOST else None
        else:
            flush()
            exact = None
            query.append(inner)
    if exact is None:
        flush()
    return exact, _join("and", query if exact is None else [_join("or", [_trigrams(w) for w in exact])])


def trigram_query(pattern: str) -> Query:
    """Boolean trigram condition, over case-folded bytes, that every match of ``pattern`` implies."""

    def fold(q: Query) -> Query:
        if isinstance(q, bytes):
            return q.lower()
        return q if q is True else _join(q[0], [fold(x) for x in q[1]])

    return fold(_walk(parser.parse(pattern))[1])


def _leaves(q: Query) -> set[bytes]:
    return {q} if isinstance(q, bytes) else set() if q is True else set().union(*map(_leaves, q[1]))


class TrigramIndex:
    """Postings of the wanted trigrams (a table by code) over one block of texts (UTF-8, folded)."""

    @staticmethod
    def table(wanted: set[bytes]) -> np.ndarray:
        out = np.zeros(1 << 24, dtype=bool)
        out[[int.from_bytes(t, "big") for t in wanted]] = True
        return out

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.n = len(offsets) - 1
        hits, rows = [], []
        step = 1 << 20
        for at in range(0, max(len(data) - 2, 0), step):
            b = data[at : at + step + 2].astype(np.uint32)
            b = np.where((b >= 65) & (b <= 90), b + 32, b)
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            where = np.flatnonzero(table[code])
            row = np.searchsorted(offsets, where + at, side="right") - 1
            inside = where + at + 3 <= offsets[row + 1]
            hits.append(code[where][inside])
            rows.append(row[inside])
        pairs = np.unique((np.concatenate(hits).astype(np.uint64) << 40) | np.concatenate(rows).astype(np.uint64)) if hits else np.empty(0, np.uint64)
        self.codes, self.rows = pairs >> 40, (pairs & ((1 << 40) - 1)).astype(np.int64)

    def postings(self, trigram: bytes) -> np.ndarray:
        code = np.uint64(int.from_bytes(trigram, "big"))
        return self.rows[np.searchsorted(self.codes, code, "left") : np.searchsorted(self.codes, code, "right")]

    def rows_of(self, q: Query) -> np.ndarray:
        if q is True:
            return np.arange(self.n)
        if isinstance(q, bytes):
            return self.postings(q)
        found = [self.rows_of(x) for x in q[1]]
        if q[0] == "or":
            return np.unique(np.concatenate(found))
        out = found[0]
        for x in sorted(found[1:], key=len):
            out = np.intersect1d(out, x, assume_unique=True)
        return out


def _compiled(rule: Rule) -> re.Pattern:
    # a run of one class that fills the whole expression is the same with its least length written out
    pattern = re.sub(r"^(\[[^]]+\])\+$", rf"\1{{{rule.least},}}", rule.pattern) if not rule.group else rule.pattern
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """id, spans array<struct<kind,start,end>> ordered by start, then the rules' order."""
    asked = [(k, r, trigram_query(r.pattern), _compiled(r)) for k, r in enumerate(rules)]
    wanted = set().union(*(_leaves(q) for _, _, q, _ in asked))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TrigramIndex.table(wanted)
        for batch in batches:
            text = batch.column(1)
            buffers = text.buffers()
            width = np.int64 if pa.types.is_large_string(text.type) else np.int32
            offsets = np.frombuffer(buffers[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
            index = TrigramIndex(data[offsets[0] : offsets[-1]], offsets - offsets[0], table)
            found: list[list] = [[] for _ in range(len(text))]
            texts: dict[int, str] = {}
            for k, rule, query, regex in asked:
                for i in index.rows_of(query).tolist():
                    value = texts[i] if i in texts else text[i].as_py()
                    if query is not True:
                        texts[i] = value
                    for m in regex.finditer(value or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), k, m.end()))
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def rendered(spans, kinds: tuple[str, ...] | None = None):
    """Column: ``kind:start:end`` joined by commas, optionally of some kinds only."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
