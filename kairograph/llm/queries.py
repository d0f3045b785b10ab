"""Thin digest queries over the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, exact_dedup, mixing, near_dedup, quality, secrets, suffix_dedup, url_filter
from .common import read_table

#: The rules of op7.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Target weights of the named sources: each fourth one counts double.  A source without a weight, null included, keeps the rate 1.
SOURCE_WEIGHTS = {f"src{k}": 2.0 if k % 4 == 0 else 1.0 for k in range(20)}
MIX_SEED = 17
VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passages: repeated passages of over 50 words, of which many are shorter than 400 bytes."""
    return suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"), passages=suffix_dedup.PASSAGE_WORDS)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs, SOURCE_WEIGHTS, "source", F.col("n_chars"), MIX_SEED).select("doc_id", "copy", "lang", "source", "n_chars", "text", F.round("rate", 9).alias("rate"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes as rows by turn, the added conversation as a record of another layout."""
    said = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    record = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    more = chat_format.canonical_json(spark.createDataFrame([(-1, record)], "conv_id long, record string"), "conv_id", "record")
    turns = chat_format.canonical_turns(rows).select("conv_id", "turns").union(more.select("conv_id", "turns"))
    back = chat_format.read_back(chat_format.format_chat(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_pattern(), with_ids=False)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), rules)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    kinds = tuple(r.kind for r in secrets.BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(secrets.rendered(F.col("spans"), kinds), 256).alias("base_sha256"),
        secrets.rendered(F.col("spans")).alias("spans"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = quality.classify(docs, quality.train(docs, labels), narrow=True)
    return out.select(
        "doc_id",
        F.col("__evidence").alias("evidence"),
        F.col("__host_rate").alias("host_rate"),
        F.col("__path_rate").alias("path_rate"),
        F.col("__score").alias("score"),
        F.col("__keep").alias("kept"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_suffix_array_dedup, op2_mix_sources, op3_chat_format, op4_nearest, op5_exact_dedup, op6_byte_bpe, op7_url_filter, op8_minhash_near_dedup, op9_secret_scan, op10_quality)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


_MIX = f"""
WITH weights(source, w) AS (VALUES {", ".join(f"('{g}', {w}::DOUBLE)" for g, w in SOURCE_WEIGHTS.items())}),
sizes AS (SELECT source, sum(n_chars)::DOUBLE AS size FROM documents WHERE source IN (SELECT source FROM weights) GROUP BY source),
rates AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM sizes) * w / (SELECT sum(w) FROM weights) / size ELSE 0.0 END AS rate FROM weights JOIN sizes USING (source)),
spread AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS j FROM (SELECT source, rate FROM rates UNION ALL SELECT NULL, 1.0) WHERE rate > 0),
steps AS (SELECT source, rate, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) OVER (PARTITION BY source, rate ORDER BY j) AS cdf FROM spread),
tables AS (SELECT source, any_value(rate) AS rate, list(cdf ORDER BY j) AS cdfs FROM steps GROUP BY source),
marked AS (SELECT *, md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce('=' || source, '') || ':' || md5(coalesce(text, ''))) AS mark, CASE WHEN source IN (SELECT source FROM weights) THEN source END AS grp FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(mark || ':' || (row_number() OVER (PARTITION BY mark) - 1)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM marked),
counted AS (SELECT h.*, t.rate, len(list_filter(t.cdfs, lambda c: h.u >= c)) AS k FROM hashed h JOIN tables t ON h.grp IS NOT DISTINCT FROM t.source)
SELECT doc_id, unnest(range(0, k))::INTEGER AS copy, lang, source, n_chars, text, round(rate, 9) AS rate FROM counted WHERE k > 0
"""

_CHAT = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT *, replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2') AS erole, replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2') AS etext FROM rows),
whole AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  sum(length('<|turn|><|text|><|end|>') + length(erole) + length(etext))::BIGINT AS formatted_chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""

_NEAREST = """
WITH sound AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT DISTINCT q.vec_id AS query_id, x.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM sound q JOIN sound x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_EXACT = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
ranked AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS r, sha256(t) AS text_sha256
  FROM norm WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, r = 1 AS kept, text_sha256 FROM ranked
"""

_URLS = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
split AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1)) AS host,
  regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
numbered AS (SELECT *, row_number() OVER () AS n FROM split),
best AS (SELECT n, arg_min(r.host || r.path, (-length(r.host || r.path), r.host || r.path)) AS rule, arg_min(r.verdict, (-length(r.host || r.path), r.host || r.path, r.verdict)) AS verdict
  FROM numbered s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (n)
"""


def oracle_sql() -> dict[str, str]:
    """Operators 1, 6, 8, 9, 10 and the pipeline have brute-force tests instead."""
    return {"op2_mix_sources": _MIX, "op3_chat_format": _CHAT, "op4_nearest": _NEAREST, "op5_exact_dedup": _EXACT, "op7_url_filter": _URLS}
