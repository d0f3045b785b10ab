"""Operators 1, 5 and 8 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairograph.llm import exact_dedup, near_dedup, suffix_dedup
from kairograph.llm.common import Scratch
from kairograph.llm.components import components

DOCS = "doc_id long, text string, n long, id long, hash long"


def documents(spark, texts, extra=True):
    """Rows with columns whose names clash with the operators' own."""
    rows = [(*t, 1, 2, 3) if isinstance(t, tuple) else (k, t, 1, 2, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# -- 5 ---------------------------------------------------------------------------------------------------------------


def test_trie_spills_and_keeps_every_terminal():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(12)).encode() for _ in range(400)] + [b""]
    for budget in (1, 4000, 1 << 20):
        trie, got, spills = exact_dedup.PatriciaTrie(budget), defaultdict(list), 0
        for k, w in enumerate(words):
            trie.insert(w, list).append(k)
            while trie.full:
                spills += 1
                for key, end in trie.spill():
                    got[key] += end
            assert trie.root.held == sum(len(n.label) + exact_dedup.NODE_BYTES for n in nodes(trie.root))
        for key, end in trie.terminals():
            got[key] += end
        expected = defaultdict(list)
        for k, w in enumerate(words):
            expected[w].append(k)
        assert got == expected
        assert (spills > 0) == (budget < 1 << 20)


def nodes(node):
    yield node
    for child in node.children.values():
        yield from nodes(child)


def test_exact_spills_by_subtree_at_the_default_budget(spark):
    """Distinct long texts exceed the budget in the workers; copies before and after the spill are one group."""
    n, size = 30, 4 << 20
    texts = F.concat(F.chr(F.lit(65) + F.col("id") % n), F.repeat(F.chr(F.lit(97) + F.col("id") % n % 7), size))
    docs = spark.range(2 * n, numPartitions=1).select(F.col("id").alias("doc_id"), texts.alias("text"))
    assert n * size > exact_dedup.HELD_BYTES
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {k: (k % n, 2, k < n) for k in range(2 * n)}


def test_exact_is_linear_in_copies():
    """A terminal holds no rows, so a copy costs the same whether it is the second or the millionth."""
    import time

    trie, took = exact_dedup.PatriciaTrie(), []
    for _ in range(2):
        start = time.perf_counter()
        for _ in range(500_000):
            trie.insert(b"one text", lambda: [0])[0] += 1
        took.append(time.perf_counter() - start)
    (key, end), held = next(trie.terminals()), trie.root.held
    assert (key, end) == (b"one text", [1_000_000]) and held < 1000
    assert took[1] < 5 * took[0]


def test_common_prefix():
    assert exact_dedup.common_prefix(b"abcx", b"abcyz") == 3
    assert exact_dedup.common_prefix(b"", b"a") == 0
    assert exact_dedup.common_prefix(b"q", b"a") == 0


def brute_exact(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(ident)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, sha))
            kept |= i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("budget", [1, exact_dedup.HELD_BYTES])
def test_exact_groups(spark, budget):
    rows = [(5, "a  b"), (3, "a\tb"), (9, " a b"), (7, None), (8, ""), (2, "x" * 100_000), (1, "x" * 100_000), (4, "a b"), (4, "a b"), (None, "a b"), (None, "only")]
    rows += [(100 + k, "hot text") for k in range(300)] + [(1000, "a\u00a0b"), (1001, "a b")]
    got = exact_dedup.exact_groups(documents(spark, rows).repartition(3), budget=budget).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


def test_exact_empty_and_drop(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    kept = exact_dedup.drop_exact_copies(documents(spark, [(1, "a"), (1, "a"), (2, "a "), (3, None), (4, ""), (None, "z")]))
    assert kept.columns == ["doc_id", "text", "n", "id", "hash"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a"), (2, "a "), (3, None), (None, "z")], key=repr)


def test_exact_query_on_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs).collect()), key=repr)
    assert got == brute_exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


# -- 8 ---------------------------------------------------------------------------------------------------------------


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_near(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    by_id = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            label[find(a)] = find(by_id.setdefault(i, a))
    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and None not in (rows[a][0], rows[b][0]) and 100 * inter >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    out = []
    for a, (i, _) in enumerate(rows):
        c = None if i is None else least[find(a)]
        out.append((i, len(sets[a]), c, i is None or c == i))
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("qrstuvwxyz") * 3
    return " ".join(words)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_groups(spark, width, percent):
    rng = random.Random(3)
    rows = [(90, None), (91, ""), (92, " \t\n"), (93, "one"), (94, "ONE"), (95, "one two"), (96, "One\x0btwo"), (None, "one"), (97, "Ébc d e"), (98, "ébc d e")]
    for g in range(6):
        base = [f"w{g}{rng.randrange(400)}" for _ in range(rng.choice([60, 120, 300]))]
        rows += [(rng.randrange(10**6), edited(rng, base, rng.choice([0, 1, 2, 3, 5, 8]))) for _ in range(25)]
    rows += [(500, "long " * 30_000), (501, "long " * 30_001), (502, "repeat me now please"), (502, "another text for one id"), (503, "Another text for one id")]
    got = near_dedup.near_groups(documents(spark, rows).repartition(4), width=width, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_near(rows, width, percent)


@pytest.mark.parametrize("block", [2, 8, 16])
def test_near_groups_beyond_a_block(spark, block):
    """Buckets and groups far beyond a block, in the workers: one tight group, and one that holds together by its edges only."""
    rng = random.Random(5)
    base, other = ([f"{c}{rng.randrange(999)}" for _ in range(150)] for c in "vu")
    rows = [(k, edited(rng, base, rng.choice([1, 2, 4, 9]))) for k in range(90)]
    drift = list(other)
    for k in range(60):  # each is near the one before, the ends are not near
        drift[2 * k % 150] = f"t{k}"
        rows.append((1000 + k, " ".join(drift)))
    rows += [(k, t) for k, t in rows[:5] for _ in range(20)]  # rows repeated with one id and text
    rows += [(7, edited(rng, base, 3)) for _ in range(20)]  # one id with many texts
    got = near_dedup.near_groups(documents(spark, rows), width=3, percent=85, block=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_near(rows, 3, 85)


def test_near_empty_and_drop(spark):
    assert near_dedup.near_groups(documents(spark, [])).count() == 0
    rows = [(4, "a b c d e f g"), (2, "A b c d e f g"), (9, "other words in this one"), (None, "a b c d e f g"), (7, "")]
    kept = near_dedup.drop_near_copies(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "id", "hash"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 9, None, 7], key=repr)


def test_near_query_on_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = sorted((tuple(r) for r in near_dedup.near_groups(docs, width=3, percent=85).collect()), key=repr)
    assert got == brute_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3, 85)


def test_signature_keys_meet_the_pigeonhole():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        where = rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        b[where] = ~b[where]
        assert (near_dedup.bucket_keys(a[None]) == near_dedup.bucket_keys(b[None])).any()


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 300), (300, 200)]
    got = components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.vertex: r.label for r in got} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_with_hubs(spark):
    """A hub low, one in the middle and one high among the vertices, and a chain between them."""
    edges = [(h, 10_000 + 10 * k + h % 7) for h in (0, 12_000, 90_000) for k in range(3000)] + [(90_000, 200_000), (200_000, 200_001)]
    got = {r.vertex: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    label = list(range(200_002))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    assert got == {v: find(v) for e in edges for v in e}


# -- 1 ---------------------------------------------------------------------------------------------------------------


def brute_suffix(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    out = []
    for (ident, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(gone.astype(int), prepend=0)
        left = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        out.append((ident, len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [5, 9, 40, 400])
def test_repeated_spans(spark, length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(length + rng.randrange(-2, 2 * length)) for _ in range(8)]
    rows = [(50, None), (51, ""), (52, "z" * (3 * length)), (53, "y" * length), (54, "y" * length), (55, "x" * (length - 1)), (56, "x" * (length - 1)), (None, word(2 * length))]
    for k in range(40):
        rows.append((k, word(rng.randrange(length)) + rng.choice(passages) + word(rng.randrange(3 * length)) + rng.choice(passages)[: rng.randrange(1, 2 * length)]))
    whole = word(5 * length)
    rows += [(60, whole), (61, whole), (62, whole[3:]), (63, whole + "q"), (64, whole[: 3 * length]), (64, whole[: 3 * length]), (64, "p" + whole[length:])]
    got = suffix_dedup.repeated_spans(documents(spark, rows).repartition(3), length=length).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_suffix(rows, length)


def brute_passages(rows, words):
    sets = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for _, t in rows]
    seen = defaultdict(int)
    for w in sets:
        for i in range(len(w) - words + 1):
            seen[tuple(w[i : i + words])] += 1
    out = []
    for (ident, _), w in zip(rows, sets):
        gone = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                gone[i : i + words] = True
        out.append((ident, int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [6, 50])
def test_passages(spark, words):
    rng = random.Random(words)
    some = lambda n: [rng.choice(["an", "of", "É", "it,", "so."]) + str(rng.randrange(40)) for _ in range(n)]
    passages = [some(words + rng.randrange(-2, 30)) for _ in range(8)]
    rows = [(50, None), (51, ""), (52, "z " * (3 * words)), (53, "y " * words), (54, " y" * words), (55, "x " * (words - 1)), (56, "x " * (words - 1)), (None, " ".join(some(90)))]
    for k in range(40):
        parts = some(rng.randrange(90)) + rng.choice(passages) + some(rng.randrange(60)) + rng.choice(passages)[: rng.randrange(1, 60)]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(60, rows[-1][1]), (60, rows[-1][1]), (61, rows[-1][1].upper())]
    got = suffix_dedup.repeated_spans(documents(spark, rows).repartition(3), passages=words).collect()
    assert sorted(((r.doc_id, r.n_passages) for r in got), key=repr) == brute_passages(rows, words)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_suffix(rows, 400)


def test_repeated_spans_texts_and_empty(spark):
    assert suffix_dedup.repeated_spans(documents(spark, [])).count() == 0
    a, b = "k" + "ab" * 5, "m" + "ab" * 5
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.repeated_spans(documents(spark, [a, b]), length=10, with_text=True).collect()}
    assert got == {0: (b"k", [(1, 11)]), 1: (b"m", [(1, 11)])}


def test_repeated_spans_query_on_table(spark, tiny):
    from kairograph.llm import queries

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = queries.op1_suffix_array_dedup(spark, tiny).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_suffix(rows, 400)
    assert sorted(((r.doc_id, r.n_passages) for r in got), key=repr) == brute_passages(rows, 50)


def test_names_go_in_many_blocks_and_flushes(monkeypatch):
    """The task functions in this process, with blocks, strides and flushes far below the texts' size."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(30, 900))) for _ in range(30)]
    texts += [t[5:] for t in texts[:9]]
    batch = lambda part: pa.record_batch({"id": pa.array([k for k, _ in part], pa.int64()), "hash": pa.array([7] * len(part), pa.int64()), "text": pa.array([t for _, t in part])})
    rows, found = list(enumerate(texts)), []
    for small in (False, True):
        if small:
            for name, value in (("BLOCK", 500), ("FLUSH", 40), ("STRIDE", 64)):
                monkeypatch.setattr(suffix_dedup, name, value)
        p = suffix_dedup.plan(40)
        packed = [r for b in suffix_dedup._sampled(p, 3, False)(iter([batch(rows[:20]), batch(rows[20:])])) for r in b.to_pylist()]
        assert not small or len(packed) > 50
        packed.sort(key=lambda r: r["bucket"])
        marks = list(suffix_dedup._compare(1, True)(iter(pa.RecordBatch.from_pylist([r], schema=PACKED) for r in packed)))
        merged = [r for b in suffix_dedup._merge(p, p.modulus - 1)(iter(marks)) for r in b.to_pylist()]
        found.append({r["id"]: suffix_dedup.removed_spans(len(texts[r["id"]]), r["gone_from"], r["gone_to"]) for r in merged})
    assert found[0] == found[1] and found[0]


PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("name", "wide", "id", "hash", "pos")]])


def test_difference_sets_cover():
    for v, d in suffix_dedup.DIFFERENCE_SETS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
