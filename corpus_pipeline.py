"""A cleaning pipeline over documents: each stage's result is written as Parquet and read again as the next one's docs.

All stages but the last return the columns of documents, those of any further name as they came; very long texts are worked on whole. run() writes each stage in the folder that driver and executors
share; a run that is broken off is begun anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import carried, materialise, row_key, small, sparse_join, table
from postsieve.llm.decontaminate import decontaminate
from postsieve.llm.near_dup import Shingling, group
from postsieve.llm.quality_rules import assess
from postsieve.llm.secrets import redact
from postsieve.llm.sentencepieces import encode_decode


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged on its own.

    Null and empty texts go; rows that repeat each other stay or go together. An empty table stays empty.
    """
    rows, back = carried(docs, ["doc_id", "text", "lang"])
    keyed = rows.withColumn("_key", row_key("doc_id", "text", "lang"))
    rejected = materialise(assess(keyed.select("doc_id", "text", "lang", "_key")).filter("NOT kept").select("_key").distinct(), "rejected")
    return back(sparse_join(keyed, rejected, "_key", "left_anti"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 80 %): that of the smallest doc_id.

    Of rows that repeat this doc_id one stays. Rows without a doc_id go only where their group has a document with one.
    """
    found = materialise(group(docs, Shingling(), keyed=True).select("key", "component_id", "kept"), "groups")
    again = found.filter("kept AND component_id IS NOT NULL").groupBy("component_id").agg(F.min("key").alias("key"), F.count("*").alias("n")).filter("n > 1")
    again = materialise(again, "repeated")
    others = found.join(small(again.select("component_id", F.col("key").alias("stays"))), "component_id").filter("kept AND key <> stays").select("key")
    dropped = materialise(found.filter("NOT kept").select("key").union(others).distinct(), "dropped")
    rows, back = carried(docs, ["doc_id", "text"])
    d = sparse_join(rows.withColumn("key", row_key("doc_id", "text")), dropped, "key", "left_anti")
    if not again.isEmpty():
        twice = again.select("key")
        d = sparse_join(d, twice, "key", "left_anti").unionByName(sparse_join(d, twice, "key", "left_semi").dropDuplicates(["key"]))
    return back(d)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates; null and empty texts are clean, repeated rows are judged alike."""
    rows, back = carried(docs, ["doc_id", "text"])
    return back(decontaminate(rows, table(spark, sf_dir, "benchmark")).filter("NOT contaminated"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds; n_chars follows the new text. Null texts stay null."""
    rows, back = carried(docs, ["doc_id", "text", *[c for c in docs.columns if c == "n_chars"]])
    d = redact(rows.withColumn("_was", F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("_was") != F.col("text"), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return back(d)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of the decoded text, and the ids; a null or empty text has begin and end id."""
    return encode_decode(docs, decoded=False)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("sentencepiece", token_stage),
]
#: SentencePiece ids can't be had in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
