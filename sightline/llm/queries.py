"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe, chat, fim, fingerprints, language, lines, mixing, packing, quality, simhash, urls, warc, whitening
from sightline.llm.common import table

#: The vocabulary that op2 uses; its folder is the tokenizer package's.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = f.read()
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, spaced=True)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat.format_all(turns.unionByName(probe))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(simhash.with_fingerprint(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.pages(table(spark, sf_dir, "pages"), language.train(table(spark, sf_dir, "documents")))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.round_trip(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_fingerprints, op2_bpe, op3_chat, op4_packing, op5_warc, op6_simhash, op7_lines, op8_language, op9_urls, op10_quality, op11_whitening, op12_fim, op13_mixing, pipeline)
    return {f.__name__: f for f in found}


@functools.cache
def oracle_sql() -> dict[str, str]:
    return {"op9_urls": urls.oracle_sql(), "op13_mixing": mixing.oracle_sql()}
