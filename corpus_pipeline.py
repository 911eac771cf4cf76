"""Corpus cleaning pipeline: quality classifier, quality rules, near copies, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of `documents`. The
driver of the stages writes each result as Parquet and reads it again as the next one's docs; run() does the same in
the folder that the cluster shares. An empty documents table goes through as no rows; documents with null texts go at
the quality rules; further columns of documents are carried on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, packing, quality_model, quality_rules
from corpusloom.llm.common import free_names, materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limit."""
    names = free_names(docs, "perplexity", "threshold", "kept")
    return quality_model.classify(docs, table(spark, sf_dir, "labels"), names=tuple(names)).where(F.col(names[2])).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    (kept,) = free_names(docs, "kept")
    return quality_rules.judge(docs, name=kept).where(F.col(kept)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: the one of the smallest doc_id, nulls last.

    Rows are told apart by doc_id and text, so that rows of one id stay unless they are copies; of rows alike in both one
    stays. Documents without words are copies of nothing and stay.
    """
    (row,) = free_names(docs, "row")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("text"))
    marked = docs.withColumn(row, own)
    groups = materialise(jaccard_join.near_copies(marked, key=row), "groups")
    groups = groups.groupBy(row).agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"), F.min("component_id").alias("first")).where(F.col(row) == F.col("first"))
    once = (F.col("rows") == 1) | (F.col("n") == 0)
    single, several = (marked.join(groups.where(x).select(row), row, "left_semi") for x in (once, ~once))
    return single.unionByName(several.dropDuplicates([row])).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", best_fit_packing),
]
#: SQL can't express the model, the near copies or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
