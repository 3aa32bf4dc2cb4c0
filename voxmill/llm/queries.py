"""The queries of this subpackage and, where SQL can say it, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, linededup, matroska, mixing, neardup, packing, tokens, toxicity, urls
from .common import table


def op1_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chat(own.unionByName(extra)), in_order=True)


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') AS te,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS re
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(re) + 2 + length(te) + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def _op7_sql() -> str:
    found = lambda term: rf"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"
    hits = lambda terms: "[x FOR x IN [" + ", ".join(f"CASE WHEN {found(t)} THEN '{t}' END" for t in sorted(terms)) + "] IF x IS NOT NULL]"
    weight = " + ".join(f"CASE WHEN {found(t)} THEN {w}::DOUBLE ELSE 0 END" for t, w in urls.SOFT.items())
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(urls.RULES, key=lambda r: -len(r.name))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{of(r)}'" for r in ordered) + " END"
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, lower(coalesce(url, '')) AS low FROM pages), p AS (
  SELECT page_id,
         translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         {hits(urls.STRICT)} AS strict_hits, {hits(urls.SOFT)} AS soft_hits, {weight} AS soft_weight
  FROM u
), r AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM p)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN len(strict_hits) > 0 OR (len(soft_hits) >= {urls.SOFT_HITS} AND soft_weight >= {urls.SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, soft_weight
FROM r
"""


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored(table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines", "removed_chunks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_stable_projections": op1_stable_projections,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_power_of_two_packing": op4_power_of_two_packing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_url_vocabulary": op7_url_vocabulary,
    "op8_pivotal_mixing": op8_pivotal_mixing,
    "op9_matroska_packets": op9_matroska_packets,
    "op10_line_chunks": op10_line_chunks,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op7_url_vocabulary": _op7_sql()}
