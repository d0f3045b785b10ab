"""Operator 6: byte-level BPE encoding and decoding through a sentencepiece model.

The rank file is serialised into a sentencepiece BPE model: every token's bytes
are mapped to printable characters, its score is its negative rank, the
normaliser is the identity.  Merging the best-scored neighbours is then the
same as merging the lowest-ranked pair.  Texts are split by the vocabulary's
pattern; each match is encoded by itself, a match that is a token as a whole is
that token; ids are decoded by the inverse byte mapping.

Defined results: a null text is empty and has no tokens; every row gives one
row, whatever repeats; an empty table gives an empty result; other columns are
not read.  Whole texts are encoded; the cache of words is emptied when full,
which bounds memory and changes nothing else.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .textblocks import text_buffers

CACHE_WORDS = 100_000
BLOCK_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where printable in Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """ModelProto bytes; piece ids equal ranks, the unknown piece comes last."""
    import struct

    chars = byte_characters()
    by_rank = {r: t for t, r in ranks.items()}
    out = bytearray()
    for rank in range(len(by_rank)):
        piece = "".join(chars[b] for b in by_rank[rank]).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        out += _field(1, _field(1, piece) + score + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        import regex
        import sentencepiece

        self.ranks, self.cache_words = ranks, cache_words
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        chars = byte_characters()
        self.latin = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.token = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.cache: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > self.cache_words:
            self.cache.clear()
        hard = []
        for w in words:
            rank = self.ranks.get(w.encode())
            if rank is None:
                hard.append(w)
            else:
                self.cache[w] = (rank,)
        mapped = [w.encode().decode("latin-1").translate(self.latin) for w in hard]
        for w, ids in zip(hard, self.model.encode(mapped, num_threads=1)):
            self.cache[w] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        words, out = self.split(text), []
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            if new := set(part).difference(self.cache):
                self._learn(set(part) if len(self.cache) + len(new) > self.cache_words else new)
            out.extend(chain.from_iterable(map(self.cache.__getitem__, part)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of consecutive rows with about BLOCK_BYTES of text each; one row is never split."""
    offsets = text_buffers(batch.column(1))[1]
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at)
        at = to


def load_ranks(spark, path: str) -> dict[bytes, int]:
    """The rank file, read by the driver; a vocabulary is bounded (tens of thousands of entries)."""
    return read_ranks(path)


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _worker_bpe(vocabulary: str, pattern: str, ranks) -> ByteBpe:
    """One encoder per Python worker; it outlives the tasks."""
    if (vocabulary, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[vocabulary, pattern] = ByteBpe(ranks.value, pattern)
    return _LOADED[vocabulary, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids array<int> (if asked for), ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(spark, vocabulary))
    ddl = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(vocabulary, pattern, ranks)
        for batch in batches:
            for ids_, texts in _blocks(batch):
                rows, tokens, ends = [], [], [0]
                for text in texts:
                    ids = bpe.encode(text.as_py())
                    joined = " ".join(map(str, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                    if with_ids:
                        tokens.append(np.array(ids, np.int32))
                        ends.append(ends[-1] + len(ids))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens))))
                yield pa.RecordBatch.from_arrays([ids_, *arrays], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays) + 1])
        bpe.cache.clear()
        give_back()

    schema = f"id {ddl}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return out.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text bytes: the inverse of ``encode_documents``; null ids give null."""
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(tokens.sparkSession, vocabulary))
    ddl = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in ranks.value.items()}
        for batch in batches:
            raw = [None if ids.as_py() is None else b"".join(token[i] for i in ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "decoded"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {ddl}, decoded binary").withColumnRenamed("id", id_col)
