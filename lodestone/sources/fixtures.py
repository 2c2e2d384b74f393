"""Sparse vectors derived from the relational tables: (vec_id, dim, val), values positive whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TF = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_vectors(texts: DataFrame, id_col: str, text_col: str = "text", max_tf: int = MAX_TF) -> DataFrame:
    """Term counts, held to max_tf, of the tokens [a-z0-9]+ of lower-cased ASCII."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = texts.select(F.col(id_col).alias("vec_id"), F.explode(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)).alias("dim"))
    return tokens.groupBy("vec_id", "dim").agg(F.least(F.count(F.lit(1)), F.lit(max_tf)).cast("long").alias("val"))


def doc_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_vectors(table(spark, sf_dir, "documents"), "doc_id")


def bench_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_vectors(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("vec_id", "qid")


def cust_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.groupBy(F.col("o_custkey").alias("vec_id"), F.col("l_partkey").alias("dim")).agg(F.sum("l_quantity").cast("long").alias("val"))


def emb_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    val = F.round(F.col("x").cast("double") * 1e6).cast("long")
    return flat.where("x > 0").select("vec_id", F.col("dim").cast("long").alias("dim"), val.alias("val")).where("val > 0")


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    return vectors.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "qid")
