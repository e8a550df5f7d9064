"""The documents table from raw texts to piece ids, stage by stage.

Every stage reads what its predecessor kept and returns the columns of documents, whatever other columns there are; the
last returns per document the number and digest of its piece ids, and the digest of the text they decode to.
`run` writes each stage's result below the shared folder and reads it again, so a
lost executor costs one stage's tasks and no more.

In all stages: rows are told apart by doc_id, null included, and text, so rows that repeat both share a decision; null texts
are empty documents; texts are read whole, of any length; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontaminate, line_dedup, sentencepiece, simhash, toxicity
from feedloom.llm.common import ship_package, stage
from feedloom.llm.queries import PIECES, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. Null and empty texts are scored as any other."""
    ship_package(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; n_chars follows the text. Null and empty texts
    stay; of rows that repeat id and text each keeps what the first keeps."""
    return line_dedup.without_lines(docs, line_dedup.repeated_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id, of ties that of the smallest hash of
    the text, and one row of equal ones. Null and empty texts are one component."""
    ship_package(spark)
    return simhash.keep_one(docs, simhash.near_duplicates(docs, keyed=True))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark. Null and empty texts share none."""
    ship_package(spark)
    return decontaminate.clean(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keyed=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of ids of each text and the digests of an encoding and decoding. Null texts count as empty."""
    ship_package(spark)
    return sentencepiece.digests(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# Neither the classifier's scores nor SimHash or the encoding can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
