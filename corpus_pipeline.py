"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns
a DataFrame that is written and read again as the next stage's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import linededup, mixing, neardup, packing, toxicity
from voxmill.llm.common import only, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, as they are."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go from the texts; a document that consists of nothing else goes with them. n_chars follows the text."""
    left = linededup.dedup_lines(docs)
    kept = left.filter((F.col("removed_lines") == 0) | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates, linked by sets of five-word shingles, the document with the smallest id stays; of rows that share an id, one."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        ranked = F.struct(F.coalesce(-F.length("text"), F.lit(1)).alias("n"), "text", *(c for c in docs.columns if c not in ("doc_id", "text")))
        several = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(ranked).alias("row"))  # the longest; combined before the shuffle
        left = left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several.select("doc_id", *(F.col("row")[c].alias(c) for c in docs.columns if c != "doc_id")))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A tokenizer and a fitted model are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with only(f"stage-{name.replace(' ', '-')}") as kept:  # a stage's own tables go when its result is there
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
