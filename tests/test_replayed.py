"""Registered queries that SQL cannot express, recomputed row by row."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import duckdb

from kairograph import catalog
from kairograph.functions import text
from kairograph.plans.search import QUERY_VEC, VALID_SQL, fused_sql
from kairograph.sources.testgraph import Graph, with_tables

SF = "/root/testdata/sf0.001"
#: queries without SQL, and where their rows are recomputed
COVERED = {
    "hs_rr_mmr": "here",
    "sc_alias_groups": "here",
    "sc_entity_regex": "here",
    "tf_add_bulk": "test_write",
    "tf_add_episode": "test_write",
    "tf_write_facts": "test_write",
    "udtf_extract": "test_write",
}


def test_every_query_has_sql_or_a_recomputation():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(COVERED)


def test_names_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: "|".join(sorted(set(re.findall(text.ENTITY, r.text or "")))) for r in docs}
    got = {r.doc_id: r.names for r in catalog.queries()["sc_entity_regex"](spark, SF).collect()}
    assert got == want and len(got) == len(docs)


def edits(a, b):
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


def test_alias_groups(spark):
    names = sorted((r.uuid, r.group_id, re.sub("[^a-z0-9]+", " ", re.sub("^the ", "", r.name.strip().lower())).strip()) for r in Graph(spark, SF).entity.where("uuid like 'user:%'").select("uuid", "group_id", "name").collect())
    anchors, want = defaultdict(list), {}
    for u, group, name in names:
        for anchor, other in anchors[group]:
            most = max(1, int(0.22 * min(len(name), len(other))))
            if name == other or (name and other and (name in other or other in name)) or (abs(len(name) - len(other)) <= most and edits(name, other) <= most):
                want[u] = anchor
                break
        else:
            anchors[group].append((u, name))
            want[u] = u
    assert {r.uuid: r.anchor for r in catalog.queries()["sc_alias_groups"](spark, SF).collect()} == want


def test_mmr(spark):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    hits = con.execute(with_tables(f"WITH {fused_sql()} SELECT uuid, r.score, fact_embedding FROM rrf r JOIN kg_vec USING (uuid) WHERE {VALID_SQL}")).fetchall()
    query = con.execute(f"select embedding from embeddings where vec_id = {QUERY_VEC}").fetchone()[0]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    pool, chosen = sorted(hits, key=lambda h: (-h[1], h[0])), []
    while pool and len(chosen) < 10:
        best = max(pool, key=lambda h: 0.5 * cosine(query, h[2]) - 0.5 * max([0.0, *(cosine(h[2], c[2]) for c in chosen)]))
        pool.remove(best)
        chosen.append(best)
    got = {r.uuid: r.score for r in catalog.queries()["hs_rr_mmr"](spark, SF).collect()}
    assert got == {u: round(s, 9) for u, s, _ in chosen}


def test_tie_breaker_settles_what_the_margin_leaves(spark):
    from kairograph.operators import resolve
    from kairograph.sources.offline import OverlapTieBreaker

    entities = spark.createDataFrame([("e1", "g", "Ann Lee", [1.0, 0.0]), ("e2", "g", "Ann Ray", [1.0, 0.01]), ("e3", "h", "Ann Ray", [1.0, 0.0])], "uuid string, group_id string, name string, embedding array<double>")
    aliases = spark.createDataFrame([("g", "annie", "e1")], "group_id string, normalized_alias string, entity_uuid string")
    mentions = spark.createDataFrame([(1, "g", "Ray", [1.0, 0.005]), (2, "g", "Annie", [0.0, 1.0]), (3, "g", "someone", [1.0, 0.0]), (4, "g", "Zed", [0.0, 1.0]), (5, "h", "Ray", [1.0, 0.0])], "mention_id int, group_id string, name string, mention_embedding array<double>")
    plain = {r.mention_id: (r.canonical_uuid, r.resolution) for r in resolve.resolve(mentions, entities, aliases).collect()}
    assert plain == {1: (None, "new"), 2: ("e1", "alias_hit"), 3: (None, "new"), 4: (None, "new"), 5: ("e3", "semantic_match")}
    asked = {r.mention_id: (r.canonical_uuid, r.resolution) for r in resolve.resolve(mentions, entities, aliases, tie_breaker=OverlapTieBreaker).collect()}
    assert asked == plain | {1: ("e2", "tie_break")}
