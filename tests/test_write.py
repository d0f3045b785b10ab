"""The write path against claims replayed one by one."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairograph import catalog
from kairograph.functions import frames, text
from kairograph.operators import write
from kairograph.plans.temporal import claim_rows
from kairograph.sources.testgraph import Graph

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
CLAIM = "uuid string, seq long, group_id string, source_node_uuid string, relation string, target_node_uuid string, valid_at timestamp_ntz, operation string, singleton boolean, source_type string, qhash string, memory_class string, is_belief boolean, fact string"


def replay(claims):
    """Edges by uuid after L1 and L2, claim by claim; then L3 and L4 over what they leave."""
    edges = []
    for c in sorted(claims, key=lambda c: (c.group_id, c.seq)):
        slot = tuple(c[k] for k in write.SLOT)
        if c.operation == "terminate":
            for e in edges:
                if e["closed"] is None and e["slot"][:3] == slot[:3] and e["object"] == c.target_node_uuid:
                    e |= {"closed": c.seq, "invalid_at": c.valid_at}
            continue
        open_ = [e for e in edges if e["closed"] is None and e["slot"] == slot]
        if same := [e for e in open_ if e["object"] == c.target_node_uuid]:
            same[0]["n"] += 1
            continue
        if c.single:
            for e in open_:
                e |= {"closed": c.seq, "invalid_at": c.valid_at, "by": c.uuid}
        edges.append({"claim": c, "slot": slot, "object": c.target_node_uuid, "closed": None, "invalid_at": None, "by": None, "n": 1, "closer": c.single and bool(open_)})
    for e in edges:
        c = e["claim"]
        for o in sorted(edges, key=lambda o: o["claim"].seq):
            d = o["claim"]
            if d.seq > c.seq and d.group_id == c.group_id and d.is_belief == c.is_belief and (d.source_node_uuid == c.source_node_uuid or d.target_node_uuid == c.target_node_uuid):
                if any(q in d.fact.lower() for q in text.TRANSITION_CUES) and not o["closer"] and d.policy != "coexist":
                    if e["closed"] is None or d.seq < e["closed"]:
                        e["late"] = {"closed": d.seq, "invalid_at": d.valid_at, "by": d.uuid}
                    break
    for e in edges:
        e |= e.pop("late", {})
    objects = defaultdict(set)
    for e in edges:
        if e["closed"] is None and e["claim"].policy == "uncertain":
            objects[e["slot"]].add(e["object"])
    out = {}
    for e in edges:
        conflict = e["closed"] is None and len(objects[e["slot"]]) > 1
        status = "superseded" if e["closed"] is not None else "needs_resolution" if conflict else "active"
        out[e["claim"].uuid] = (e["invalid_at"], e["by"], status, "::".join(e["slot"]) if conflict else None, e["n"])
    return out


def rows_of(edges):
    return {r.uuid: (r.invalid_at, r.superseded_by, r.status, r.conflict_group_id, r.n_claims) for r in edges.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_cascade_equals_replay(spark, seed):
    rng = random.Random(seed)
    more = (frames.Frame("rated", ("rates",), "directed", "state", "many_current", "uncertain", 0.5),)
    table = frames.latest_aliases(frames.frame_rows(spark).unionByName(frames.frame_rows(spark, more, 100)))
    rows = []
    for k in range(160):
        op = rng.choices(["assert", "terminate", "correct", "qualify", "noop", " Assert "], [8, 2, 2, 2, 1, 1])[0]
        fact = rng.choice(["a fact", "it changed", "not so"]) if rng.random() < 0.2 else "plain"
        rows.append((f"f{k}", k, rng.choice("gh"), rng.choice("ab"), rng.choice(["lives_in", "likes", "owns", "married_to", "rates"]), rng.choice("abxyz"), T0 + timedelta(hours=rng.randrange(99)), op, rng.random() < 0.3, rng.choice(["user", "system"]), rng.choice(["", "", "q1"]), rng.choice(["objective", "preference"]), rng.random() < 0.2, fact))
    claims = spark.createDataFrame(rows, CLAIM)
    assert rows_of(write.write_facts(claims, table)) == replay(write.claims(claims, table).collect())


def test_registered_cascade_equals_replay(spark):
    g = Graph(spark, SF)
    got = rows_of(catalog.queries()["tf_write_facts"](spark, SF))
    assert got == replay(write.claims(claim_rows(g), g.frame).collect())
    assert {s for _, _, s, *_ in got.values()} == {"active", "superseded"}


def test_defaults_and_replaced_edges(spark):
    rows = spark.createDataFrame([("a", 1, "g", "s", "likes", "x", T0), ("b", 2, "g", "s", "likes", "y", T0), ("c", 3, "g", "s", "likes", "z", T0)], "uuid string, seq long, group_id string, source_node_uuid string, relation string, target_node_uuid string, valid_at timestamp_ntz")
    replaced = spark.createDataFrame([("a", 3, T0, "c"), ("a", 2, T0 + timedelta(1), "b")], "uuid string, closed_seq long, closed_at timestamp_ntz, closed_by string")
    got = rows_of(write.write_facts(rows, frames.frame_aliases(spark), replaced))
    assert got["a"] == (T0 + timedelta(1), "b", "superseded", None, 1) and got["b"][2] == got["c"][2] == "active"
    assert write.write_facts(rows.limit(0), frames.frame_aliases(spark)).count() == 0


def fold(name):
    kept = re.sub(r"[^\w\s'\-]", " ", name).lower().replace("ß", "ss")
    return re.sub(r"\s+", " ", kept).strip()


def extracted(content):
    """(pos, seq, subject, predicate, object, fact) of a text by the offline rules."""
    names = list(dict.fromkeys(re.findall(text.ENTITY, content)))
    sentences = [s for s in (p.strip(" ") for p in re.split(r"(?<=[.!?])\s+|;\s*", content)) if s]
    for pos, sentence in enumerate(sentences):
        here = [n for n in names if n in sentence]
        fact = sentence if sentence.endswith(".") else sentence + "."
        if len(here) == 1:
            yield pos, 0, here[0], "mentions_with", here[0], fact
        for k, (a, b) in enumerate(zip(here, here[1:])):
            yield pos, k, a, "related_to", b, fact


def test_extractor_on_table(spark):
    rows = Graph(spark, SF).text.select("uuid", "content").collect()
    want = sorted((r.uuid, p, k, s, q, o, f) for r in rows for p, k, s, q, o, f in extracted(r.content))
    got = sorted((r.id, r.pos, r.seq, r.subject, r.predicate.lower(), r.object, r.fact) for r in catalog.queries()["udtf_extract"](spark, SF).collect())
    assert got == want and len(got) > 100


def test_ingest_equals_replay(spark):
    g = Graph(spark, SF)
    episodes = sorted(g.text.select("uuid", "group_id", "content", "reference_time").collect(), key=lambda r: (r.reference_time, r.uuid))
    known = {}
    for r in sorted(g.entity.select("uuid", "group_id", "name").collect(), key=lambda r: r.uuid, reverse=True):
        known[r.group_id, fold(r.name)] = r.uuid
    for r in sorted(g.alias.collect(), key=lambda r: r.entity_uuid, reverse=True):
        known[r.group_id, r.normalized_alias] = r.entity_uuid
    edges = {}
    for e in episodes:
        for pos, k, s, p, o, fact in extracted(e.content):
            s_id, o_id = (known.get((e.group_id, fold(n)), f"n:{e.group_id}:{fold(n)}") for n in (s, o))
            if s_id == o_id and p != "mentions_with":
                continue
            edge = edges.setdefault((e.group_id, s_id, p, o_id), {"uuid": f"{e.uuid}:{pos}:{k}", "fact": fact, "at": e.reference_time, "episodes": set(), "n": 0})
            edge["episodes"].add(e.uuid)
            edge["n"] += 1
    got = catalog.queries()["tf_add_episode"](spark, SF).collect()
    assert {(r.group_id, r.source_node_uuid, r.name, r.target_node_uuid): (r.uuid, r.fact, r.valid_at, r.episodes, r.n_claims) for r in got} == {k: (e["uuid"], e["fact"], e["at"], ",".join(sorted(e["episodes"])), e["n"]) for k, e in edges.items()}
    # a transition cue in a text closes what shares an end with it
    assert any(r.status == "superseded" for r in got) and any(r.status == "active" for r in got)


def test_bulk_counts(spark):
    got = {(r.group_id, r.kind): r.n for r in catalog.queries()["tf_add_bulk"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).collect()
    named, cited, edges = defaultdict(set), set(), defaultdict(set)
    for d in docs:
        for _, _, s, p, o, _ in extracted(d.text):
            for n in (s, o):
                named[d.source].add(fold(n))
                cited.add((d.doc_id, d.source, fold(n)))
            if p == "mentions_with" or fold(s) != fold(o):
                edges[d.source].add((fold(s), p, fold(o)))
    want = {(g, "entities"): len(v) for g, v in named.items()} | {(g, "edges"): len(v) for g, v in edges.items()}
    for _, g, _ in cited:
        want[g, "mentions"] = want.get((g, "mentions"), 0) + 1
    assert got == want
