"""Truth tables and invariants on small inline rows."""

from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairograph.functions import decay, frames, keys, text, vectors
from kairograph.operators import cognition, filters, graph, mutate, resolve, search, temporal
from kairograph.sources import hooks, pack
from kairograph.streaming import ingest

T0 = datetime(2024, 1, 1)
FACT = "uuid string, seq long, group_id string, source_node_uuid string, name string, target_node_uuid string, valid_at timestamp_ntz, op string"


def facts(spark, rows):
    return spark.createDataFrame([(f"f{k}", k, g, s, p, o, T0 + timedelta(hours=t), op) for k, (g, s, p, o, t, op) in enumerate(rows)], FACT)


def simulate(rows):
    """Facts one after the other, as they arrive."""
    open_, edges = {}, {}
    for k, (g, s, p, o, t, op) in enumerate(rows):
        slot, at = (g, s, p), T0 + timedelta(hours=t)
        held = open_.get(slot)
        if op == "assert":
            if held and edges[held]["object"] == o:
                continue
            edges[f"f{k}"] = {"object": o, "valid_at": at, "invalid_at": None, "by": None}
            if held:
                edges[held] |= {"invalid_at": at, "by": f"f{k}"}
            open_[slot] = f"f{k}"
        elif op == "terminate" and held and edges[held]["object"] == o:
            edges[held]["invalid_at"] = at
            del open_[slot]
    return {u: (e["object"], e["valid_at"], e["invalid_at"], e["by"]) for u, e in edges.items()}


@pytest.mark.parametrize("seed", range(6))
def test_closure_equals_arrival_order(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("gh"), rng.choice("ab"), "p", rng.choice("xyz"), rng.randrange(200), rng.choices(["assert", "terminate", "noop"], [7, 2, 1])[0]) for _ in range(80)]
    got = temporal.close_slots(facts(spark, rows), op="op").collect()
    assert {r.uuid: (r.target_node_uuid, r.valid_at, r.invalid_at, r.superseded_by) for r in got} == simulate(rows)
    open_slots = [(r.group_id, r.source_node_uuid, r.name) for r in got if r.status == "active"]
    assert len(open_slots) == len(set(open_slots))
    back = {r.uuid: r.supersedes for r in got}
    assert all(back[r.superseded_by] == r.uuid for r in got if r.superseded_by)


def test_tenants_are_apart(spark):
    rows = [("g1", "ann", "lives_in", "paris", 0, "assert"), ("g2", "ann", "lives_in", "rome", 1, "assert")]
    assert {r.status for r in temporal.close_slots(facts(spark, rows), op="op").collect()} == {"active"}


def test_as_of_is_half_open(spark):
    rows = [("g", "a", "p", "x", 0, "assert"), ("g", "a", "p", "y", 10, "assert")]
    closed = temporal.close_slots(facts(spark, rows), op="op")
    for hour, expected in ((-1, set()), (0, {"x"}), (9, {"x"}), (10, {"y"}), (99, {"y"})):
        at = filters.ntz(str(T0 + timedelta(hours=hour)))
        assert {r.target_node_uuid for r in closed.where(filters.as_of(at)).collect()} == expected


def test_interval_join_equals_range_join(spark):
    rng = random.Random(4)
    f = spark.createDataFrame([(f"f{k}", rng.choice("ab"), T0 + timedelta(hours=a), None if rng.random() < 0.3 else T0 + timedelta(hours=a + rng.randrange(90))) for k in range(60) for a in [rng.randrange(200)]], "uuid string, k string, valid_at timestamp_ntz, invalid_at timestamp_ntz")
    p = spark.createDataFrame([(k, rng.choice("ab"), T0 + timedelta(hours=rng.randrange(-10, 320))) for k in range(60)], "id int, k string, t timestamp_ntz")
    got = {(r.id, r.uuid) for r in temporal.interval_join(p, f, ["k"]).collect()}
    want = {(a.id, b.uuid) for a in p.collect() for b in f.collect() if a.k == b.k and b.valid_at <= a.t and (b.invalid_at is None or b.invalid_at > a.t)}
    assert got == want


def test_dedupe_merges_episodes(spark):
    rows = spark.createDataFrame([("a", 1, "k", T0, ["e1"]), ("b", 2, "k", T0, ["e2", "e1"]), ("c", 3, "z", T0, [])], "uuid string, seq long, key string, valid_at timestamp_ntz, episodes array<string>")
    got = {r.fact_key: (r.uuid, r.episodes, r.n_rows) for r in temporal.dedupe(rows, F.col("key")).collect()}
    assert got == {"k": ("a", ["e1", "e2"], 2), "z": ("c", None, 1)}


def test_conflicts(spark):
    rows = [("g", "a", "p", "x", 0, "assert"), ("g", "a", "p", "x", 1, "assert"), ("g", "a", "p", "y", 2, "assert"), ("g", "b", "p", "x", 3, "assert")]
    got = {r.uuid: (r.resolution, r.conflict_group) for r in temporal.mark_conflicts(facts(spark, rows)).collect()}
    assert got == {"f0": ("active", "g::a::p"), "f1": ("active", "g::a::p"), "f2": ("needs_resolution", "g::a::p"), "f3": ("active", None)}


def test_frames(spark):
    got = {r.alias: r.canonical for r in frames.frame_aliases(spark).collect()}
    assert got["located_in"] == "located_in" and got["resides_in"] == "lives_in" and got["wife_of"] == "spouse_of"
    rows = spark.createDataFrame([("Wife_Of", "b", "a"), ("unheard_of", "b", "a")], "relation string, source_node_uuid string, target_node_uuid string")
    s, o = temporal.symmetric()
    out = temporal.resolve_frames(rows, frames.frame_aliases(spark)).select("canonical", s.alias("s"), o.alias("o")).collect()
    assert sorted(map(tuple, out)) == [("spouse_of", "a", "b"), ("unheard_of", "b", "a")]


@pytest.mark.parametrize(
    ("value", "windows", "expected"),
    [
        (T0, [], True),
        (None, [[("IS NULL", None)]], True),
        (None, [[("<", "2024-02-01")]], False),
        (T0, [[(">=", "2024-01-01"), ("<", "2024-01-02")]], True),
        (T0, [[(">", "2024-01-01")], [("=", "2024-01-01")]], True),
        (T0, [[("<>", "2024-01-01")]], False),
        (T0, [[("IS NOT NULL", None), ("<=", None)]], False),
    ],
)
def test_date_filters(spark, value, windows, expected):
    row = spark.createDataFrame([(value,)], "at timestamp_ntz")
    assert row.select(filters.date_dnf("at", windows)).first()[0] is expected


def test_property_filters(spark):
    row = spark.createDataFrame([(0.7, '{"n": 3, "s": "x"}')], "confidence double, attributes string")
    is_ = lambda *a: row.select(filters.property_is(row.columns, *a)).first()[0]
    assert is_("confidence", ">=", 0.7) and is_("n", "=", 3) and is_("s", "=", "x")
    assert not is_("s", ">", 3) and not is_("gone", "=", "x")
    assert is_("gone", "IS NULL") and is_("n", "IS NOT NULL")


def test_decay_bounds(spark):
    now = filters.ntz("2024-06-01")
    rows = [(1.5, 0, 0, "episodic", "objective", 1.0), (0.9, 1, 0, "episodic", None, 1.0), (0.9, 20, 9, "episodic", "", 0.0), (0.4, 0, 0, "consolidated", "x", 0.0), (0.4, 0, 0, "episodic", " GOAL ", 0.0)]
    df = spark.createDataFrame([(*r, T0, T0, None, None) for r in rows], "confidence double, reinforcement_count int, recall_count int, stability string, memory_class string, decay_score double, valid_at timestamp_ntz, created_at timestamp_ntz, last_reinforced_at timestamp_ntz, last_recalled_at timestamp_ntz")
    got = [r[0] for r in df.select(decay.effective_confidence(now)).collect()]
    assert all(0 <= x <= 1 for x in got)
    assert got[1] == 0.0 and abs(got[2] - (min(0.25, 0.03 * 2.995732273553991) + 0.2)) < 1e-9 and got[3] == got[4] == 0.4


def test_keys(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    a = val(keys.qualifier_hash(keys.canonical_qualifiers(F.create_map(F.lit("x"), F.lit("1"), F.lit("a"), F.lit("2")))))
    b = val(keys.qualifier_hash(keys.canonical_qualifiers(F.create_map(F.lit("a"), F.lit("2"), F.lit("x"), F.lit("1")))))
    assert a == b and len(a) == 16
    for s in ("http://example.org", "é😀", ""):
        assert val(keys.uuid5_url(F.lit(s))) == str(uuid.uuid5(uuid.NAMESPACE_URL, s))
    assert val(keys.normalize_alias(F.lit("  Straße, O'Neil-X! "))) == "strasse o'neil-x"
    assert val(keys.snake_case(F.lit("  A b--C "))) == "a_b_c" and val(keys.snake_case(F.lit("!!"))) == "unknown"


def test_vectors(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert abs(val(vectors.cosine(arr(1, 2), arr(2, 4))) - 1) < 1e-12
    assert val(vectors.cosine(arr(0, 0), arr(1, 2))) == 0.0
    assert val(vectors.cosine(F.array().cast("array<double>"), arr(1))) == 0.0
    assert abs(val(vectors.cosine(arr(1, 0, 5), arr(1, 0))) - 1 / 26**0.5) < 1e-12


def test_hash_embedding_equals_offline(spark):
    from kairograph.sources.offline import HashEmbedder

    texts = ["a b a", "", "The the Cat", "x " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.hash_embedding(F.col("t"), 16)).collect()
    for r, e in zip(rows, HashEmbedder().embed(texts)):
        assert all(abs(x - y) < 1e-12 for x, y in zip(r[0], e))


def test_rrf_and_mmr(spark):
    rows = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (1, "b", 0)], "list_id int, uuid string, rank int")
    got = {r.uuid: r.score for r in search.rrf(rows).collect()}
    assert abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-9 and abs(got["a"] - 1 / 61) < 1e-9
    c = spark.createDataFrame([("near", 3.0, [1.0, 0.0]), ("twin", 2.0, [0.99, 0.01]), ("far", 1.0, [0.3, 0.9]), ("none", 0.5, None)], "uuid string, score double, fact_embedding array<double>")
    order = [r.uuid for r in search.mmr(c, [1.0, 0.1], 4).orderBy("rank").collect()]
    assert order == ["twin", "far", "near", "none"]  # the near twin is redundant once the other is chosen


def test_bm25_prefers_rare_terms_and_short_texts(spark):
    rows = spark.createDataFrame([("1", "apple pie"), ("2", "apple apple tree with many other words"), ("3", "pear"), ("4", None)], "uuid string, fact string")
    got = {r.uuid: r.score for r in search.bm25(rows, "Apple pie").collect()}
    assert set(got) == {"1", "2"} and got["1"] > got["2"]
    assert search.bm25(rows, "!!").count() == 0


def test_rerankers_reject(spark):
    with pytest.raises(ValueError, match="focal"):
        search.rerank(spark.range(1), spark.range(1), "q", [1.0], search.SearchConfig(reranker="node_distance"))
    with pytest.raises(ValueError, match="unknown"):
        search.rerank(spark.range(1), spark.range(1), "q", [1.0], search.SearchConfig(reranker="odd"))


def test_resolution_stages(spark):
    m = spark.createDataFrame([(1, "g", "Known As", None), (2, "g", " ANN ", None), (3, "g", "close", [1.0, 0.0]), (4, "g", "between", [0.0, 1.0]), (5, "h", "Ann", None)], "mention_id int, group_id string, name string, mention_embedding array<double>")
    e = spark.createDataFrame([("u1", "g", "Ann", [1.0, 0.01]), ("u2", "g", "Bea", [0.01, 1.0]), ("u3", "g", "Bee", [0.0, 1.0])], "uuid string, group_id string, name string, embedding array<double>")
    a = spark.createDataFrame([("g", "known as", "u2")], "group_id string, normalized_alias string, entity_uuid string")
    got = {r.mention_id: (r.canonical_uuid, r.resolution) for r in resolve.resolve(m, e, a).collect()}
    assert got == {1: ("u2", "alias_hit"), 2: ("u1", "exact_name"), 3: ("u1", "semantic_match"), 4: (None, "new"), 5: (None, "new")}
    assert [r.alias for r in resolve.new_aliases(resolve.resolve(m, e, a), a).collect()] == ["close"]


def test_duplicates_merge(spark):
    e = spark.createDataFrame([("a", "g", "Ann  Lee", T0), ("b", "g", "ANN lee", T0 + timedelta(1)), ("c", "h", "ann lee", T0)], "uuid string, group_id string, name string, created_at timestamp_ntz")
    to = resolve.duplicate_map(e)
    assert [tuple(r) for r in to.collect()] == [("b", "a")]
    edges = spark.createDataFrame([("1", "b", "c")], "uuid string, s string, t string")
    assert [(r.s, r.t) for r in resolve.repoint(edges, to, "s", "t").collect()] == [("a", "c")]


def test_profile_stops_at_first_overflow(spark):
    row = spark.createDataFrame([("N", ["a" * 10, "b" * 30, "c"])], "n string, f array<string>")
    assert row.select(resolve.compose_summary(F.col("n"), F.col("f"), 20)).first()[0] == "N: " + "a" * 10 + "."


def test_components_and_hops(spark):
    e = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(30)] + [("x", "y"), ("z", "z")], "a string, b string")
    got = {r.node: r.component for r in graph.components(e, "a", "b").collect()}
    assert {got[f"n{k:02}"] for k in range(31)} == {"n00"} and got["y"] == "x" and got["z"] == "z"
    assert {r.node: r.depth for r in graph.hops(e, "n05", 2, "a", "b").collect()} == {"n05": 0, "n04": 1, "n06": 1, "n03": 2, "n07": 2}


def test_texts(spark):
    rows = spark.createDataFrame([("I think so",), ("thinking",), ("It PROBABLY is",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.looks_like_belief(F.col("t"))).collect()] == [True, False, True, False]
    moods = cognition.affect(spark.createDataFrame([("1", "happy happy sad"), ("2", "plain"), ("3", "")], "uuid string, content string"))
    assert [(r.uuid, r.emotion, r.polarity, r.intensity) for r in moods.collect()] == [("1", "joy", 0.7, 0.9)]


def test_mutations(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "uuid string, n int, s string")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "uuid string, n int")
    assert sorted(map(tuple, mutate.upsert(old, new).collect()), key=repr) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)]
    assert sorted(map(tuple, mutate.update(old, new).collect())) == [("a", 1, "x"), ("b", 5, "y")]
    edges = spark.createDataFrame([("1", ["p"]), ("2", ["p", "q"]), ("3", ["q"])], "uuid string, episodes array<string>")
    assert sorted((r.uuid, r.episodes) for r in mutate.remove_episode(edges, "p").collect()) == [("2", ["q"]), ("3", ["q"])]


def test_extractor(spark):
    rows = spark.createDataFrame([(1, "Ann Lee met Bob. Bob sings; it rains! Only lower here.")], "id int, content string")
    got = [tuple(r) for r in hooks.extract(rows, "id").orderBy("pos", "seq").select("subject", "predicate", "object", "fact").collect()]
    assert got == [("Ann Lee", "related_to", "Bob", "Ann Lee met Bob."), ("Bob", "MENTIONS_WITH", "Bob", "Bob sings."), ("Only", "MENTIONS_WITH", "Only", "Only lower here.")]


def test_pack_round_trip_and_refusals(spark, tmp_path):
    tables = {
        "entities": spark.createDataFrame([("u1", "Ann", [1.0]), ("u2", None, None)], "uuid string, name string, name_embedding array<double>"),
        "entity_aliases": spark.createDataFrame([("ann", "u1")], "normalized_alias string, entity_uuid string"),
        "relation_frames": frames.frame_aliases(spark).select("alias", "canonical"),
        "edges": spark.createDataFrame([("f1", "u1", "likes", "u2", T0 + timedelta(microseconds=7)), ("f2", "u1", "likes", "gone", T0)], "uuid string, source_node_uuid string, name string, target_node_uuid string, valid_at timestamp_ntz"),
    }
    path = str(tmp_path / "pack")
    pack.export_pack(tables, path)
    got = pack.validate_pack(spark, path)
    assert got["entities"].columns == ["uuid", "name"]
    assert sorted(map(tuple, got["edges"].collect())) == sorted(map(tuple, tables["edges"].collect()))
    none = spark.createDataFrame([], "uuid string, group_id string, name string, source_node_uuid string, target_node_uuid string")
    first = pack.import_pack(got, "new", none, none)
    assert first.entities.count() == 2 and first.edges.count() == 1 and [r.uuid for r in first.dropped.collect()] == ["f2"]
    again = pack.import_pack(got, "new", first.entities.where("name is not null"), first.edges)
    assert again.edges.count() == 0
    for part in (tmp_path / "pack" / "entities.jsonl").glob("part-*.json"):
        part.write_text(part.read_text().replace("Ann", "Eve"))
    for crc in (tmp_path / "pack" / "entities.jsonl").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(pack.PackError, match="entities"):
        pack.validate_pack(spark, path)
    with pytest.raises(pack.PackError, match="missing"):
        pack.validate_pack(spark, str(tmp_path / "nothing"))


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    changes = ingest.stream_slots(spark, path).collect()
    from kairograph import catalog

    batch = catalog.queries()["win_slot_close"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.uuid, r.target_node_uuid) for r in changes} == {(r.uuid, r.target_node_uuid) for r in batch}
    assert {r.closes: r.uuid for r in changes if r.closes} == {r.uuid: r.superseded_by for r in batch if r.superseded_by}


def test_library_stands_without_the_training_subpackage():
    import pathlib

    top = pathlib.Path(__file__).parent.parent / "kairograph"
    for f in top.rglob("*.py"):
        if "llm" not in f.relative_to(top).parts:
            assert "kairograph.llm" not in f.read_text() and "import llm" not in f.read_text(), f
