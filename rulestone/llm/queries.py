"""Queries of this subpackage, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, fingerprint, linededup, packing, quality, sharding, simhash, toxicity
from .common import held_out, table

WORD_PARTS = "byte_bpe_50k.json"
MANY_LANGUAGES = "byte_bpe_multi_50k.tiktoken"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_PARTS))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.assign(table(spark, sf_dir, "documents"), 8)
    return assigned.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MANY_LANGUAGES), public_tokenizers.PATTERN)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_projection_ann": op4_projection_ann,
        "op5_bpe": op5_bpe,
        "op6_fingerprints": op6_fingerprints,
        "op7_simhash": op7_simhash,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality": op9_quality,
        "op10_chat": op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": linededup.SQL, "op10_chat": chat.SQL}
