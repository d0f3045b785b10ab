"""Odd texts and large groups."""

from __future__ import annotations

import random

import duckdb
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from kairograph.functions import frames, text
from kairograph.functions.vectors import cosine
from kairograph.operators import graph, resolve, temporal, write


def test_word_edges_are_ascii_as_in_sql(spark):
    odd = ["bestü", "übest", "best_", "a best.", "beſt", "tweaK", "ſharper", "xſharper", "besser", "é tune é", "optimiſe", "w\u000bw " * 40, "w w " * 40]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, t string")
    said = {r.id: r.label for r in rows.select("id", text.classify_episode(F.col("t"), F.lit(None)).alias("label")).collect()}
    con = duckdb.connect()
    want = {}
    for k, t in enumerate(odd):
        best, n = con.execute(r"SELECT regexp_matches($1, $2), len(list_filter(regexp_split_to_array($1, '\s+'), lambda x: x <> ''))", [t, text.OPTIMISE]).fetchone()
        want[k] = "optimization_request" if best else "narrative_share" if n >= 60 else "one_off_query"
    assert said == want and set(want.values()) == {"optimization_request", "narrative_share", "one_off_query"}
    beliefs = ["éI think", "I thinké", "I think_", "it ſeems"]
    rows = spark.createDataFrame(list(enumerate(beliefs)), "id int, t string")
    said = {r.id: r.b for r in rows.select("id", text.looks_like_belief(F.col("t")).alias("b")).collect()}
    assert said == {k: con.execute("SELECT regexp_matches($1, $2)", [t, text.BELIEF]).fetchone()[0] for k, t in enumerate(beliefs)}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_contradictions_take_no_frame_that_is_summed_up_anew_for_every_row(spark):
    rng = random.Random(6)
    rows = [(f"e{k}", k, rng.choice("gh"), rng.choice("ab"), rng.choice("xyz"), rng.random() < 0.3, "no longer" if rng.random() < 0.1 else "plain", rng.random() < 0.6) for k in range(200)]
    facts = spark.createDataFrame(rows, "uuid string, seq long, group_id string, source_node_uuid string, target_node_uuid string, is_belief boolean, fact string, live boolean")
    got = temporal.contradicted(facts, F.col("live"))
    assert "unboundedfollowing" not in plan_of(got)  # quadratic in a group
    want = {r[0]: min((o[1] for o in rows if o[1] > r[1] and o[2] == r[2] and o[5] == r[5] and (o[3] == r[3] or o[4] == r[4]) and o[6] != "plain"), default=None) for r in rows if r[7]}
    assert {r.uuid: r.closed_by_seq for r in got.collect()} == want


def test_mixed_slots_are_walked_in_one_pass(spark):
    """Slots that mix singleton and other claims, one after the other in a task and over the ends of batches."""
    def run(rows):
        columns = [[r[i] for r in rows] for i in range(11)]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [str(i) for i in range(11)])
        got = [r for size in (1, 2, 99) for r in [[x for b in write._in_order(batch.slice(i, size) for i in range(0, len(rows), size)) for x in b.to_pylist()]]]
        assert got[0] == got[1] == got[2]
        return {r["uuid"]: (r["closed_seq"], r["invalid_at"], r["superseded_by"], r["n_claims"], r["closed_any"]) for r in got[0]}

    a, b = ("g", "s", "p", "", "m"), ("g", "t", "p", "", "m")
    rows = [(*a, "1", 1, "x", 10, "assert", False), (*a, "2", 2, "y", 20, "assert", False), (*a, "3", 3, "x", 30, "assert", True), (*a, "4", 4, "z", 40, "correct", True), (*a, "5", 5, "z", 50, "terminate", False), (*b, "6", 6, "x", 60, "assert", True), (*b, "7", 7, "y", 70, "assert", False)]
    assert run(rows) == {"1": (4, 40, "4", 2, False), "2": (4, 40, "4", 1, False), "4": (5, 50, None, 1, True), "6": (None, None, None, 1, False), "7": (None, None, None, 1, False)}


def test_the_cascade_takes_no_group_of_pandas_and_no_shrinking_frame(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(write, "written", lambda df: plans.append(plan_of(df)) or df)
    rows = spark.createDataFrame([("a", 1, "g", "s", "likes", "x")], "uuid string, seq long, group_id string, source_node_uuid string, relation string, target_node_uuid string").withColumn("valid_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    plans.append(plan_of(write.write_facts(rows, frames.frame_aliases(spark))))
    assert not [p for p in plans if "flatmapgroupsinpandas" in p or "unboundedfollowing" in p.replace("unboundedpreceding$(), unboundedfollowing$()", "")]


@pytest.mark.parametrize("block, threshold", [(8192, 0.86), (7, 0.86), (7, -2.0)])
def test_matches_by_blocks_equal_all_pairs(spark, monkeypatch, block, threshold):
    """Copies, zero, missing, short and broken vectors; every pair by ``cosine`` is the measure."""
    monkeypatch.setattr(resolve, "_BLOCK", block)
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, base[0][:3]]

    def some(n, lead):
        rows = [(rng.choice("gh"), rng.choice([base[0], [x + rng.gauss(0, 0.1) for x in rng.choice(base)], [x + rng.gauss(0, 0.3) for x in rng.choice(base)]])) for _ in range(n)] + [("g", v) for v in odd]
        return [(f"{lead}{k}", *r) for k, r in enumerate(rows)]

    m = spark.createDataFrame(some(25, "m"), "mention_id string, group_id string, mention_embedding array<double>")
    e = spark.createDataFrame(some(60, "e"), "uuid string, group_id string, embedding array<double>")
    pairs = m.join(e, "group_id").select("mention_id", "uuid", F.round(cosine(F.col("mention_embedding"), F.col("embedding")), 9).alias("score")).where(F.col("score") >= threshold).orderBy("mention_id", F.desc("score"), "uuid").collect()
    want = {}
    for r in pairs:
        want.setdefault(r.mention_id, []).append((r.uuid, str(r.score)))
    got = {}
    df = resolve.semantic_matches(m, e, threshold)
    assert "join" not in plan_of(df)  # no row per pair
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.mention_id, []).append((r.uuid, str(r.score)))
    assert got == {k: v[:5] for k, v in want.items()} and got


def test_sweeps_of_anchors_equal_names_one_by_one():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    def near(a, b):
        most = max(1, int(0.22 * min(len(a), len(b))))
        return a == b or bool(a and b and (a in b or b in a)) or abs(len(a) - len(b)) <= most and edits(a, b) <= most

    rng = random.Random(3)
    for letters, longest in (("ab", 9), ("abcdé日", 16), ("0123456789", 6), ("abc ", 30)):
        names = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(longest + 1))) for _ in range(300)))
        anchors, want = [], []
        for k, n in enumerate(names):
            a = next((a for a in anchors if near(n, names[a])), k)
            anchors += [k] if a == k else []
            want.append(a)
        assert graph._anchors(names) == want and len(anchors) > 1
    # many names, each once
    many = [f"{rng.randrange(10**9):09d}" for _ in range(200)] + [f"user {k}" for k in range(40_000)]
    assert len(graph._anchors(list(dict.fromkeys(many)))) == len(set(many))


def test_new_aliases_come_from_blocks(spark):
    from kairograph import catalog

    plan = catalog.queries()["er_record_alias"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "flatmapcogroupsinpandas" in plan and "mention_embedding" not in plan.split("flatmapcogroupsinpandas")[0]


@pytest.mark.parametrize("threshold", [0.86, -2.0])
def test_names_are_folded_once_and_only_mentioned_ones_grouped(spark, monkeypatch, threshold):
    """Null and repeated names, null ids, vectors kept apart; the later stages read what the first wrote."""
    plans = []
    monkeypatch.setattr(resolve, "written", lambda df: plans.append(plan_of(df)) or graph.written(df))
    m = spark.createDataFrame([(1, "g", "  User  1", [1.0, 0.0]), (2, "g", "A.K.A", None), (3, "g", "stranger", [0.0, 1.0]), (4, "g", None, [0.0, 1.0]), (5, None, "user 1", None), (6, "h", "user 1", [1.0, 0.0]), (7, "g", "user 1", None), (8, "g", "lost", None)], "mention_id long, group_id string, name string, mention_embedding array<double>")
    e = spark.createDataFrame([("b", "g", "USER 1"), ("a", "g", "user 1"), ("c", "g", "other"), ("d", "h", "else"), ("n", "g", None)], "uuid string, group_id string, name string")
    v = spark.createDataFrame([("c", [0.0, 2.0]), ("a", [1.0, 0.0])], "uuid string, embedding array<double>")
    a = spark.createDataFrame([("g", "a k a", "z"), ("g", "a k a", "y"), ("g", "lost", None), ("h", "a k a", "x")], "group_id string, normalized_alias string, entity_uuid string")
    whole = resolve.resolve(m, e.join(v, "uuid", "left"), a, threshold, 0.05)
    apart = resolve.resolve(m, e, a, threshold, 0.05, vectors=v)
    assert "leftsemi" in plans[0] and "regexp_replace" not in plan_of(whole) + plan_of(apart)
    got = {r.mention_id: (r.canonical_uuid, r.resolution, r.confidence) for r in whole.collect()}
    assert got == {r.mention_id: (r.canonical_uuid, r.resolution, r.confidence) for r in apart.collect()}
    assert [got[k][:2] for k in (1, 2, 3, 4, 5, 7)] == [("a", "exact_name"), ("y", "alias_hit"), ("c", "semantic_match"), ("c", "semantic_match"), (None, "new"), ("a", "exact_name")]
    assert got[6][:2] == ((None, "new") if threshold > 0 else ("d", "semantic_match"))


def test_a_text_is_read_once_whatever_its_sentences(spark):
    """Names within words, repeated, at edges; null and empty texts; the plan holds no row per sentence."""
    from kairograph.sources.hooks import extract

    rng = random.Random(4)
    parts = ["Al", "Alice", "MacDonald", "Donald", "Rome", "New York", "York", "A-B", "x_Al", "éAl", "Alé", "Al_", "Foo-", "B", "no", "longer", ".", "!", "? ", ";", "; ", "\n", " ", " ", " ", " ", "\u000b", "日本", "It's", "N0"]
    texts = [None, "", " ", "Al", "Al.", ".;!"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = extract(rows, "id")
    assert "explode" not in plan_of(got)
    plain = rows.select("id", F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(text.ENTITY), 1)).alias("n"), F.split("content", r"(?<=[.!?])\s+|;\s*").alias("s"))
    want = set()
    for r in plain.collect():
        for pos, s in enumerate(s for s in ((p.strip(" ") for p in r.s or ())) if s):
            here, fact = [n for n in r.n if n in s], s if s.endswith(".") else s + "."
            want |= {(r.id, pos, 0, here[0], "MENTIONS_WITH", here[0], fact)} if len(here) == 1 else {(r.id, pos, k, a, "related_to", b, fact) for k, (a, b) in enumerate(zip(here, here[1:]))}
    out = [tuple(r) for r in got.collect()]
    assert not set(out) ^ want, sorted(set(out) ^ want)[:4]
    assert len(out) == len(want) > 500
