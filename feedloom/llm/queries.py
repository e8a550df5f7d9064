"""One query per operator of this subpackage, over whole tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import (
    conversations,
    decontaminate,
    exact_dedup,
    lexical_search,
    line_dedup,
    ngram_join,
    secrets,
    sentencepiece,
    sharding,
    simhash,
    suffix_tree,
    toxicity,
    url_filter,
)
from feedloom.llm.common import ship_package

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT * FROM VALUES
            ('net/', 'block', true), ('example.net/en/', 'allow', true),
            ('example.com/de/', 'block', true), ('org/fr/', 'allow', true)
        AS rules(entry, verdict, is_rule)
        """
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = url_rules(spark).unionByName(url_filter.noncommercial_pages(pages), allowMissingColumns=True)
    return url_filter.judge(pages, listed)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sentencepiece.digests(table(spark, sf_dir, "documents"), PIECES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.dedup(*exact_dedup.halves(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return sharding.shard_records(documents, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return line_dedup.report(documents, line_dedup.repeated_lines(documents))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.repair(conversations.damaged(rows)))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_ngram_join": op13_ngram_join,
    "pipeline": pipeline,
}
