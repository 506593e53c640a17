"""Queries of this subpackage, with production parameters and over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, exact, lines, mixing, repeats, sharding, simhash, tokens, toxicity, urls
from strata.llm.storage import ship

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encode_and_read_back(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return decontam.find_benchmark(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(_table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_ids,
        op2_simhash,
        op3_shards,
        op4_toxicity,
        op5_exact,
        op6_decontaminate,
        op7_lines,
        op8_suffixes,
        op9_mix,
        op10_urls,
    )
}

#: The other operators can't be said in SQL, or not on whole tables (tokenizer, XXH64, CRC-32, trained models, edit
#: distance of all lines, every string of 400 bytes); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_exact": exact.ORACLE_SQL,
    "op6_decontaminate": decontam.ORACLE_SQL,
    "op9_mix": mixing.ORACLE_SQL,
    "op10_urls": urls.ORACLE_SQL,
}
