"""The thin queries over whole tables: each derives its digest columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, html_template, langid, mixing, near_dedup, pii, pivot_search, preference, secret_scan, sharding
from lodestone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.with_repeated_answer(preference.gather(table(spark, sf_dir, "conversations"))))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("found")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits", "__h")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("copies")


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_preference": op2_preference,
    "op3_langid": op3_langid,
    "op4_topk": op4_topk,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_html": op9_html,
    "op10_mixing": op10_mixing,
}
