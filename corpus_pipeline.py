"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

Every stage takes all rows its predecessor kept and, but for the last, returns
the columns of ``documents`` for the rows that it keeps itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestlens.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from ingestlens.llm.common import marked, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.5."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).filter("predicted = 1").select(*docs.columns)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original with the smallest id; of its rows of one id and length, one."""
    return exact_dedup.keep_one(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; documents without shingles or without id stay.

    Rows are dropped by id and text, so a row that is like no other stays even if its id has another text that goes.
    """
    groups = near_dedup.near_groups(docs)
    dropped = stored(groups.filter("not first").select(F.col("id").alias("doc_id"), F.col("text_hash").alias("__hash")).distinct(), "near-copies")
    rows = marked(docs.withColumn("__hash", F.xxhash64("text")), dropped, "doc_id", "__hash")  # only texts that may be dropped meet the list
    maybe = rows.filter("maybe").join(dropped, ["doc_id", "__hash"], "left_anti")
    return rows.filter("not maybe").select(*docs.columns).unionByName(maybe.select(*docs.columns))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("decontamination", keep_clean),
    ("packing", pack),
]

#: Model training, tokenisation and the iterative near-dedup are outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each one's rows are written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
