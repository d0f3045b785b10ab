"""Operator 3 [native]: chat formatting by schema fingerprints.

A layout is recognised by the hash of its nested field paths; a declarative
mapping then turns its rows into canonical turns ``array<struct<role,text>>``.
Two entry points exist: ``canonical_turns`` fingerprints a DataFrame's schema,
``canonical_json`` fingerprints each JSON record, so one column may mix layouts.
``format_chat`` renders turns into segments with a loss flag; ``read_back``
parses the rendered string again.  All of it is DataFrame functions.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn.  Every control string
starts with ``<`` or ``[``; inside roles and texts ``~ < [`` become
``~0 ~1 ~2``, so no control string survives in a text and the change is
reversible.  The loss mask covers exactly the texts of assistant turns.

Defined results: null role or text is empty; rows of one turn number are
ordered by role, then text; repeated rows are turns of their own; a null
conversation id is a group of its own; an empty table gives an empty result;
columns the layout does not name are ignored.  One conversation is one string,
hence one row: its size is bounded by Spark's 2 GB string limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; ``[]`` marks an array step."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(
        F.coalesce(role.cast("string"), F.lit("")).alias("role"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
    )


def _listed(column: str, role: str, text: str, roles: dict[str, str] | None = None) -> Column:
    def one(x: Column) -> Column:
        name = x[role]
        for a, b in (roles or {}).items():
            name = F.when(x[role] == a, F.lit(b)).otherwise(name)
        return _turn(name, x[text])

    return F.coalesce(F.transform(F.col(column), one), F.array().cast(TURNS))


def _pair(prompt: Column, reply: str) -> Column:
    return F.array(_turn("user", prompt), _turn("assistant", F.col(reply)))


def _instruction(with_input: bool) -> Column:
    asked = F.coalesce(F.col("instruction"), F.lit(""))
    if with_input:
        more = F.coalesce(F.col("input"), F.lit(""))
        asked = F.when(more == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), more))
    return _pair(asked, "output")


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column] | None  # None: one row is one turn

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))


#: From the most to the least specific; the first whose fingerprint fits is taken.
LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), None),
    Layout("messages", ("messages[].role", "messages[].content"), lambda: _listed("messages", "role", "content")),
    Layout("dialogue", ("conversations[].from", "conversations[].value"), lambda: _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("instruction_input", ("instruction", "input", "output"), lambda: _instruction(True)),
    Layout("instruction", ("instruction", "output"), lambda: _instruction(False)),
    Layout("prompt_completion", ("prompt", "completion"), lambda: _pair(F.col("prompt"), "completion")),
    Layout("prompt_response", ("prompt", "response"), lambda: _pair(F.col("prompt"), "response")),
)


def layout_of(schema: T.StructType) -> Layout:
    """The layout whose fingerprint equals that of the schema's paths it names."""
    paths = set(field_paths(schema))
    for layout in LAYOUTS:
        if fingerprint([p for p in layout.paths if p in paths]) == layout.key:
            return layout
    raise ValueError(f"no layout for fields {sorted(paths)}")


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, turns; the mapping is chosen by the schema's fingerprint."""
    layout = layout_of(df.schema)
    if layout.turns is not None:
        return df.select(F.col(id_col), layout.turns().alias("turns"))
    row = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    gathered = df.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.select(id_col, F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


_RECORD = (
    "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,`value`:string>>,"
    "instruction:string,input:string,output:string,prompt:string,completion:string,response:string>"
)


def canonical_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, layout, fingerprint, turns for records of mixed layouts; unknown layouts have null turns."""
    at = df.select(F.col(id_col), F.from_json(F.col(json_col), _RECORD).alias("r")).select(id_col, "r.*")
    listed = [layout for layout in LAYOUTS if layout.turns is not None]
    found = []
    for top, paths in {p.split("[]")[0]: [q for q in layout.paths if q.split("[]")[0] == p.split("[]")[0]] for layout in listed for p in layout.paths}.items():
        found += [F.when(F.col(top).isNotNull(), F.lit(p)) for p in paths]
    paths = F.array_sort(F.array_compact(F.array(*found)))
    at = at.withColumn("fingerprint", F.sha2(F.array_join(paths, "\n"), 256))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in listed:
        same = F.col("fingerprint") == layout.key
        name, turns = F.when(same, F.lit(layout.name)).otherwise(name), F.when(same, layout.turns()).otherwise(turns)
    return at.select(id_col, name.alias("layout"), "fingerprint", turns.alias("turns"))


def escape(text: Column) -> Column:
    for a, b in (("~", "~0"), ("<", "~1"), ("[", "~2")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def format_chat(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, segments array<struct<piece,loss>>, formatted (the pieces joined)."""
    pieces = F.transform(
        "turns",
        lambda t: F.array(
            F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("piece"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("piece"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")),
        ),
    )
    out = df.select(id_col, F.flatten(pieces).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["piece"]), ""))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, turns and loss_text parsed from what ``format_chat`` wrote."""
    blocks = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.greatest(F.size(F.split("formatted", r"<\|turn\|>")) - 1, F.lit(0)))

    def parse(block: Column) -> Column:
        cut = F.split(F.regexp_replace(block, r"<\|end\|>\z", ""), r"<\|text\|>")
        return F.struct(unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"]))
    return formatted.select(
        id_col,
        F.transform(blocks, parse).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
