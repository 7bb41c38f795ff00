"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm import knn_quality, language_id, sql
from bizlens.llm.adaptive_rules import adaptive_quality
from bizlens.llm.byte_bpe import encoded
from bizlens.llm.common import documents, id_remainder
from bizlens.llm.decontaminate import contaminated
from bizlens.llm.jaccard_join import jaccard_components
from bizlens.llm.kd_shards import kd_shards
from bizlens.llm.line_dedup import dedup_lines
from bizlens.llm.maxent_lm import scored_texts
from bizlens.llm.phrase_mining import collocations
from bizlens.llm.prefix_trie import conversation_trie
from bizlens.llm.token_store import stored_documents
from bizlens.llm.weighted_mix import mix_plan
from bizlens.sources.tables import read_table


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose executors lack that folder, ship the package with ``--py-files``.
    """
    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        env = spark.sparkContext.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
        return query(spark, *args)
    return run


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_documents(documents(spark, sf_dir, "doc_id", "text"),
                            public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocab_size=50_257)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op3_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_quality(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held_out))
    p = docs.select("doc_id", held_out.alias("held_out"), language_id.predicted(docs, model).alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text")).drop("text_hash", "is_first")


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_texts(documents(spark, sf_dir, "doc_id", "text"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), shards=16)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir, "doc_id", "text", "source")).drop("source")


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    voters = knn_quality.fit(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    p = docs.select("doc_id", held_out.alias("held_out"), knn_quality.scored(docs, voters).alias("score"))
    return p.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded(documents(spark, sf_dir, "doc_id", "text"), ranks, keep_ids=False)


def op11_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir, "doc_id", "text", "source"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "text", "lang"))


QUERIES = {f.__name__: importable(f) for f in (
    op1_token_store, op2_decontaminate, op3_adaptive_rules, op4_language_id, op5_jaccard_join, op6_maxent_lm,
    op7_kd_shards, op8_line_dedup, op9_knn_quality, op10_byte_bpe, op11_weighted_mix, op12_prefix_trie,
    op13_collocations)}
QUERIES["pipeline"] = importable(corpus_pipeline.run)
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": sql.decontaminate_sql(),
                              "op3_adaptive_rules": sql.adaptive_rules_sql(),
                              "op8_line_dedup": sql.line_dedup_sql(),
                              "op11_weighted_mix": sql.weighted_mix_sql(),
                              "op12_prefix_trie": sql.prefix_trie_sql(),
                              "op13_collocations": sql.collocations_sql()}
