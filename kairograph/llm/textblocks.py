"""Numpy helpers over Arrow batches of texts: word shingles and sorted runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def text_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array without nulls."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    buffers = text.buffers()
    if not len(text):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_bytes(batch, id_col: str = "id", text_col: str = "text") -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive rows with about BLOCK_BYTES of text each; one row is never split."""
    data, offsets = text_buffers(batch.column(text_col))
    ids = batch.column(id_col)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield ids.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lowered, split at ASCII white space), and word offsets per row."""
    n = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= inside[inner]
    end[inner - 1] |= inside[inner - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[_FOLD[data]] * power[: len(data)], out=total[1:], dtype=np.uint64)
        h = mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return h, np.searchsorted(first, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's word shingles (repeats included), and their offsets per row.

    A row with fewer words than ``width`` has its whole sequence as one shingle.
    """
    h, at = word_hashes(data, offsets)
    words = at[1:] - at[:-1]
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(words)), count)
    start = at[:-1][row] + (np.arange(out_at[-1]) - out_at[:-1][row])
    length = np.minimum(words[row], width)
    with np.errstate(over="ignore"):
        total = length.astype(np.uint64)
        padded = np.concatenate([h, np.zeros(width, np.uint64)])
        for k in range(width):
            part = mix64(padded[start + k] + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
            total = total * np.uint64(0xD1342543DE82EF95) + np.where(k < length, part, np.uint64(0))
    return mix64(total), out_at


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Callable[[int], Iterator[pa.Table]]]]:
    """Runs of equal keys in sorted batches, as (key, parts); ``parts(n)`` yields tables of at most n rows.

    Only one part is held at a time.  A run must be read before the next is asked for;
    what is left of it is skipped.
    """

    def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                if pa.types.is_integer(c.type):
                    v = c.to_numpy(zero_copy_only=False)
                    change |= v[1:] != v[:-1]
                else:
                    v = c.to_pylist()
                    change |= np.fromiter((x != y for x, y in zip(v, v[1:])), bool, len(v) - 1)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield tuple(c[a].as_py() for c in columns), batch.slice(a, b - a)

    source = pieces()
    ahead = next(source, None)
    while ahead is not None:
        key = ahead[0]

        def parts(n: int, key=key) -> Iterator[pa.Table]:
            nonlocal ahead
            held, rows = [], 0
            while ahead is not None and ahead[0] == key:
                piece = ahead[1]
                while piece.num_rows:
                    took = piece.slice(0, n - rows)
                    held.append(took)
                    rows += took.num_rows
                    piece = piece.slice(took.num_rows)
                    if rows == n:
                        yield pa.Table.from_batches(held)
                        held, rows = [], 0
                ahead = next(source, None)
            if rows:
                yield pa.Table.from_batches(held)

        yield key, parts
        while ahead is not None and ahead[0] == key:
            ahead = next(source, None)
