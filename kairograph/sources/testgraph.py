"""The driver's tables read as graph tables, and the same mapping as DuckDB CTEs.

One list of column expressions serves both engines; the few functions that are
spelled differently are written as macros.  The mapping is lazy: a query reads
only the columns that it uses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: macro -> (Spark, DuckDB)
_MACROS = {
    r"DAYS\(([^()]*(?:\([^()]*\)[^()]*)*)\)": (r"make_dt_interval(cast(\1 as int))", r"to_days(cast(\1 as int))"),
    r"MINS\(([^()]*(?:\([^()]*\)[^()]*)*)\)": (r"make_dt_interval(0, 0, cast(\1 as int))", r"to_minutes(cast(\1 as bigint))"),
    r"JSON\(": ("get_json_object(", "json_extract_string("),
    r"TS'": ("TIMESTAMP_NTZ'", "TIMESTAMP'"),
    r"DOUBLES\((\w+)\)": (r"transform(\1, x -> cast(x as double))", r"cast(\1 as double[])"),
}


def _spelled(text: str, engine: int) -> str:
    for pattern, forms in _MACROS.items():
        text = re.sub(pattern, forms[engine], text)
    return text


#: what people say; the tables' own texts are invented words, so each row's text is led by one of these
SAYINGS = [
    "I am so frustrated and angry, I hate this deadline.",
    "What a great, awesome day! I love it and I'm happy.",
    "Maybe I am unsure. I think the plan might be late.",
    "I want to learn Rust this year. My goal is to run a marathon!",
    "I'm trying to improve my sleep; could you make it better?",
    "How do I tune the parser and sharpen the lexer output?",
    "Nothing here.",
    "Nobody no longer works at Acme.",
    "I'd like to visit the northern islands. I aim to go soon.",
    "Could the parser output also cover lexer errors and parser output?",
    "Alice Smith met Bob in New York. Alice Smith moved; Bob stayed. Carol sings.",
    "Dana stopped singing. She changed her mind about Rome.",
]


def _one_of(values: list[str], n: str) -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in enumerate(values))
    return f"(CASE ({n}) % {len(values)} {cases} END)"


def saying(n: str) -> str:
    """One of the sayings by a number, in both engines."""
    return _one_of(SAYINGS, n)


_K = "cast(JSON(props, '$.k') as bigint)"
FACT = {
    "uuid": "'e' || event_id",
    "seq": "event_id",
    "group_id": "'u' || (user_id % 8)",
    "source_node_uuid": "'user:' || user_id",
    "name": "event_type",
    "target_node_uuid": f"'u' || (user_id % 8) || ':obj:' || ({_K} % 5)",
    "fact": f"'user ' || user_id || ' ' || event_type || ' object ' || ({_K} % 5) || ' tag ' || (event_id % 37)",
    "relation": "CASE event_id % 8 WHEN 0 THEN 'Lives_In' WHEN 1 THEN 'resides_in' WHEN 2 THEN 'works_for' WHEN 3 THEN 'has_pet' WHEN 4 THEN 'married_to' WHEN 5 THEN 'located_in' ELSE event_type END",
    "source_type": "CASE event_id % 5 WHEN 0 THEN 'assistant' WHEN 1 THEN 'system' ELSE 'user' END",
    "confidence": "cast(event_id % 51 as double) / 100 + 0.45",
    "valid_at": "ts",
    "invalid_at": "CASE WHEN event_id % 3 = 0 THEN ts + DAYS(event_id % 20 + 1) END",
    "created_at": "ts + MINS(event_id % 600)",
    "expired_at": "CASE WHEN event_id % 6 = 0 THEN ts + DAYS(event_id % 40 + 5) END",
    "status": "CASE WHEN event_id % 17 = 0 THEN 'needs_resolution' WHEN event_id % 3 = 0 THEN 'superseded' WHEN event_id % 37 = 1 THEN '' ELSE 'active' END",
    "singleton": "event_id % 4 = 0",
    "domain": "CASE WHEN event_id % 4 = 1 THEN 'work' WHEN event_id % 4 = 2 THEN 'home' END",
    "derived": "event_id % 13 = 0",
    "canonical_name": "CASE WHEN event_id % 10 <> 0 THEN lower(event_type) END",
    "conflict_group_id": "CASE WHEN event_id % 17 = 0 THEN 'u' || (user_id % 8) || ':' || user_id || ':' || event_type WHEN event_id % 18 = 0 THEN '' END",
    "memory_class": "CASE WHEN event_id % 23 = 0 THEN 'preference' WHEN event_id % 29 = 0 THEN ' Goal ' WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'objective' END",
    "attributes": """'{"score":' || (event_id % 100) || ',"color":"' || (CASE WHEN event_id % 2 = 0 THEN 'red' ELSE 'blue' END) || '"}'""",
    "episodes": "split('ep:' || (event_id % 97) || (CASE WHEN event_id % 2 = 0 THEN ',ep:' || (event_id % 89) ELSE '' END), ',')",
    "reinforcement_count": "event_id % 12",
    "recall_count": "event_id % 7",
    "last_reinforced_at": "CASE WHEN event_id % 5 = 0 THEN ts + DAYS(2) END",
    "last_recalled_at": "CASE WHEN event_id % 9 = 0 THEN ts + DAYS(3) END",
    "decay_score": "CASE WHEN event_id % 3 = 1 THEN 0.05 ELSE 1 - cast(event_id % 90 as double) / 100 END",
    "stability": "CASE WHEN event_id % 41 = 0 THEN 'consolidated' WHEN event_id % 12 >= 7 THEN 'persistent' WHEN event_id % 12 >= 3 THEN 'reinforced' ELSE 'episodic' END",
    "is_belief": "event_id % 19 = 0",
    "belief_holder": "CASE WHEN event_id % 19 = 0 THEN 'user:' || user_id END",
    "valence": "cast(event_id % 21 as double) / 10 - 1",
    "intensity": "cast(event_id % 11 as double) / 10",
    "value": "value",
}
EPISODE = {
    "uuid": "conv_id || ':' || turn",
    "group_id": "'c' || (conv_id % 8)",
    "content": "text",
    "source": "CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'self_reflection' ELSE 'text' END",
    "source_description": "role",
    "reference_time": "TS'2024-01-01 00:00:00' + MINS(conv_id * 10 + turn)",
    "created_at": "TS'2024-01-01 00:01:00' + MINS(conv_id * 10 + turn)",
    "cognition_processed_at": "CASE WHEN conv_id % 3 <> 0 THEN TS'2024-03-01 00:00:00' END",
}
SOURCE_EPISODE = {"uuid": "'ep:' || event_id", "group_id": "'u' || (user_id % 8)", "reference_time": "ts", "content": f"{saying('event_id')} || ' ' || event_type || ' of user ' || user_id"}
MENTION = {"uuid": "'m' || event_id", "group_id": "'u' || (user_id % 8)", "episode_uuid": "'ep:' || (event_id % 97)", "entity_uuid": "'user:' || user_id", "created_at": "ts"}
USER = {
    "uuid": "'user:' || c_custkey",
    "group_id": "'u' || (c_custkey % 8)",
    "name": "CASE WHEN c_custkey % 10 = 0 THEN upper('user  ' || (c_custkey - 8)) ELSE 'User ' || c_custkey END",
    "labels": "split('Person,' || c_mktsegment || (CASE WHEN c_custkey % 6 = 0 THEN ',trait' ELSE '' END) || (CASE WHEN c_custkey % 14 = 0 THEN ',goal' ELSE '' END), ',')",
    "summary": "lower(c_mktsegment) || ' customer number ' || c_custkey",
    "domain": "CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) END",
    "created_at": "TS'2023-06-01 00:00:00' + MINS(c_custkey * 7)",
    "mention_count": "c_custkey % 9",
    "traits": "split(CASE WHEN c_custkey % 4 = 0 THEN 'user:' || (c_custkey + 8) || ',user:' || c_custkey ELSE '' END, ',')",
    "balance": "c_acctbal",
}
OBJECT = {
    "uuid": "'u' || (p_partkey % 8) || ':obj:' || cast(floor(p_partkey / 8) as int)",
    "group_id": "'u' || (p_partkey % 8)",
    "name": "'Object ' || cast(floor(p_partkey / 8) as int)",
    "labels": "split('Product,' || p_brand, ',')",
    "summary": "lower(p_type)",
    "domain": "lower(p_brand)",
    "created_at": "TS'2023-05-01 00:00:00' + MINS(p_partkey)",
    "mention_count": "p_partkey % 9",
    "traits": "split('', ',')",
    "balance": "p_retailprice",
}
ALIAS = {"alias": "'U-' || c_custkey", "normalized_alias": "'u-' || c_custkey", "group_id": "'u' || (c_custkey % 8)", "entity_uuid": "'user:' || c_custkey", "confidence": "cast(0.9 as double)"}
VEC = {
    "uuid": "'vec:' || vec_id",
    "group_id": "'v' || (vec_id % 4)",
    "source_node_uuid": "'n' || (vec_id % 50)",
    "target_node_uuid": "'n' || ((vec_id * 7 + 3) % 50)",
    "name": "'rel' || label",
    "label": "label",
    "fact": "coalesce(text, '')",
    "fact_embedding": "DOUBLES(embedding)",
    "episodes": "split('ep:' || (vec_id % 97) || (CASE WHEN vec_id % 3 = 0 THEN ',ep:' || (vec_id % 11) ELSE '' END), ',')",
    "confidence": "cast(vec_id % 50 as double) / 100 + 0.5",
    "valid_at": "TS'2024-01-01 00:00:00' + MINS(vec_id * 60)",
    "invalid_at": "CASE WHEN vec_id % 9 = 0 THEN TS'2024-01-20 00:00:00' + MINS(vec_id * 60) END",
    "created_at": "TS'2024-01-01 00:00:00' + MINS(vec_id * 61)",
    "expired_at": "CASE WHEN vec_id % 10000 = 9999 THEN TS'2024-01-20 00:00:00' END",
    "status": "CASE WHEN vec_id % 25 = 1 THEN 'superseded' ELSE 'active' END",
    "memory_class": "CASE WHEN vec_id % 12 = 0 THEN 'goal' ELSE 'objective' END",
    "reinforcement_count": "vec_id % 10",
    "recall_count": "vec_id % 6",
    "last_reinforced_at": "CASE WHEN vec_id % 5 = 0 THEN TS'2024-02-01 00:00:00' END",
    "last_recalled_at": "CASE WHEN vec_id % 8 = 0 THEN TS'2024-02-03 00:00:00' END",
    "decay_score": "cast(1 as double)",
    "stability": "CASE WHEN vec_id % 33 = 0 THEN 'consolidated' ELSE 'episodic' END",
}
NODE = {
    "uuid": "'user:' || c_custkey",
    "group_id": "'u' || (c_custkey % 8)",
    "name": "'User ' || c_custkey",
    "summary": "lower(c_mktsegment) || ' customer number ' || c_custkey",
    "labels": "split('Person,' || c_mktsegment, ',')",
    "created_at": "TS'2023-06-01 00:00:00' + MINS(c_custkey * 7)",
    "name_embedding": "DOUBLES(embedding)",
}
TEXT = {
    "uuid": "'t' || conv_id || ':' || turn",
    "group_id": "'c' || (conv_id % 8)",
    "seq": "conv_id * 1000 + turn",
    "source": "CASE role WHEN 'user' THEN 'message' WHEN 'assistant' THEN 'self_reflection' ELSE 'text' END",
    "content": f"{saying('conv_id * 7 + turn')} || ' ' || coalesce(text, '')",
    "reference_time": "TS'2024-01-01 00:00:00' + MINS(conv_id * 10 + turn)",
}
#: spellings that lead the names of parts
SPELLINGS = ["  Müller & Söhne ", "O'Brien-Smith", "STRASSE  Straße", "the Big  Cat!", "", "A.B.C.", "snake_case name", "i want to win", "日本 Tokyo"]
#: names of goals, followed by a number in every other round
GOAL_NAMES = ["i_m_working", "learn_rust", "my_goal", "na", "null", "the_user_x", "user", "run", "run_far", "we_are_one", "western", "", "  Ice_Cream "]


NAME = {"id": "p_partkey", "name": f"{_one_of(SPELLINGS, 'p_partkey')} || (CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END)"}
GOAL_NAME = {"id": "event_id", "name": f"{_one_of(GOAL_NAMES, 'event_id')} || (CASE WHEN event_id % 4 < 2 THEN '' ELSE '_' || user_id END)"}
#: what the assistant says about itself: a record, or free text
SELF = {
    "uuid": "'s' || conv_id || ':' || turn",
    "group_id": "'c' || (conv_id % 8)",
    "content": """CASE WHEN conv_id % 9 = 4 THEN 'free text without structure' ELSE '{"type":"' || (CASE conv_id % 3 WHEN 0 THEN 'trait' WHEN 1 THEN 'belief' ELSE 'pattern' END) || '","name":"' || (CASE turn % 4 WHEN 0 THEN 'Patient listener' WHEN 1 THEN 'Small steps, win' WHEN 2 THEN 'patient  LISTENER' ELSE 'Asks first' END) || '","confidence":0.' || (conv_id % 9 + 1) || '}' END""",
}
#: a model's answer per event
ANSWER = {
    "id": "event_id",
    "json": """'{"facts":[{"subject":"user ' || user_id || '","predicate":"' || (CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END) || '",' || (CASE WHEN event_id % 2 = 0 THEN '"objects":["tea","milk"]' ELSE '"object":"tea"' END) || ',"operation":"' || (CASE event_id % 4 WHEN 0 THEN 'Terminate' WHEN 1 THEN 'frobnicate' WHEN 2 THEN 'assert' ELSE 'noop' END) || '","memory_class":"' || (CASE event_id % 3 WHEN 0 THEN 'Goal' WHEN 1 THEN 'odd' ELSE '' END) || '","confidence":"' || (CASE WHEN event_id % 5 = 0 THEN 'high' ELSE '0.5' END) || '"}]}'""",
}
#: graph table -> parts of (driver table, condition, columns)
TABLES = {
    "kg_fact": [("events", "true", FACT)],
    "kg_episode": [("conversations", "true", EPISODE)],
    "kg_source_episode": [("events", "true", SOURCE_EPISODE)],
    "kg_mention": [("events", "true", MENTION)],
    "kg_entity": [("customer", "true", USER), ("part", "true", OBJECT)],
    "kg_alias": [("customer", "true", ALIAS)],
    "kg_vec": [("embeddings LEFT JOIN documents ON vec_id = doc_id", "true", VEC)],
    "kg_node": [("embeddings JOIN customer ON vec_id = c_custkey", "true", NODE)],
    "kg_text": [("conversations", "true", TEXT)],
    "kg_name": [("part", "true", NAME)],
    "kg_goal_name": [("events", "true", GOAL_NAME)],
    "kg_self": [("conversations", "role = 'assistant'", SELF)],
    "kg_answer": [("events", "true", ANSWER)],
}
_FRAMES_SQL = "kg_frame"
NOW = "2024-02-10 00:00:00"


def table_sql(name: str) -> str:
    """The graph table as DuckDB SQL over the driver's tables."""
    if name == _FRAMES_SQL:
        from kairograph.functions.frames import SEED_FRAMES

        rows = [f"('{f.canonical}', '{a}', {n}, '{f.direction}', {'NULL' if f.inverse is None else repr(f.inverse)}, '{f.temporal}', '{f.cardinality}', '{f.policy}', {f.confidence}::DOUBLE)" for n, f in enumerate(SEED_FRAMES) for a in (f.canonical, *f.aliases)]
        return f"SELECT * FROM (VALUES {', '.join(rows)}) t(canonical, alias, n, direction, inverse, temporal, cardinality, policy, confidence) QUALIFY row_number() OVER (PARTITION BY alias ORDER BY n DESC) = 1"
    parts = []
    for source, where, columns in TABLES[name]:
        chosen = ", ".join(f"{_spelled(e, 1)} AS {c}" for c, e in columns.items())
        parts.append(f"SELECT {chosen} FROM {source} WHERE {where}")
    return " UNION ALL ".join(parts)


def with_tables(sql: str) -> str:
    """Puts the CTEs of the graph tables that ``sql`` names in front of it."""
    names = [n for n in (*TABLES, _FRAMES_SQL) if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({table_sql(n)})" for n in names)
    if not ctes:
        return sql
    sql = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH RECURSIVE {ctes}, {sql[m.end():]}"
    return f"WITH RECURSIVE {ctes} {sql}"


@dataclass(frozen=True)
class Graph:
    """Graph tables of one data directory."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        out = None
        for source, where, columns in TABLES[name]:
            if " JOIN " in source:
                left, right, on = source.replace(" LEFT JOIN ", " JOIN ").replace(" ON ", " JOIN ").split(" JOIN ")
                a, b = on.split(" = ")
                left_df, right_df = self.raw(left), self.raw(right)
                base = left_df.join(right_df.drop("label"), left_df[a] == right_df[b], "left" if " LEFT JOIN " in source else "inner")
            else:
                base = self.raw(source)
            part = base.where(where).selectExpr(*[f"{_spelled(e, 0)} AS {c}" for c, e in columns.items()])
            out = part if out is None else out.unionByName(part)
        return out

    fact = property(lambda self: self.table("kg_fact"))
    episode = property(lambda self: self.table("kg_episode"))
    source_episode = property(lambda self: self.table("kg_source_episode"))
    mention = property(lambda self: self.table("kg_mention"))
    entity = property(lambda self: self.table("kg_entity"))
    alias = property(lambda self: self.table("kg_alias"))
    vec = property(lambda self: self.table("kg_vec"))
    node = property(lambda self: self.table("kg_node"))
    text = property(lambda self: self.table("kg_text"))

    @property
    def frame(self) -> DataFrame:
        from kairograph.functions.frames import frame_aliases

        return frame_aliases(self.spark)
