"""A corpus pipeline of five operators: each stage works on all documents that the one before kept.

Every stage's result is written as Parquet and read again, so a lost executor costs the running stage alone.
Null, empty and very long texts, ties, repeated rows and further columns go through as the operators' docstrings
say; an empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import decontamination, near_duplicates, packing, substring_dedup, toxicity
from turnstone.llm.common import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores below one half."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, lexicon, threshold=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least, of each component of near duplicates."""
    return near_duplicates.keep_one(docs, percent=75)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those with passages of 35 words or more that occur elsewhere too, without them.

    Such a document's other words are joined by one blank, and ``n_chars`` counts them; one that is nothing but
    such passages stays as an empty text.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = substring_dedup.remove_passages(docs, window=35, carry=others)
    changed = F.col("n_removed") > 0
    rows = found.select(F.col("key").alias("doc_id"), F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text")).alias("text"), changed.alias("changed"), "rest")
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    if "n_chars" in others:
        at = docs.columns.index("n_chars")
        kind = docs.schema["n_chars"].dataType
        columns[at] = F.when(F.col("changed"), F.char_length("text").cast(kind)).otherwise(F.col("rest.n_chars")).alias("n_chars")
    return rows.select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, up to word edits."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of what is left."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No stage's rows can be told by SQL (learned lexicon, components, spans, edit distances, packing); the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
