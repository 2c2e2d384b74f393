"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, mixing, near_dedup, sharding
from lodestone.llm.common import Scratch, join_unique, mark, release, remove, shared_dir, table, with_row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What names a row of a stage's table.
ROW = ("__file", "__row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: those without letters, and those of which no language is likely."""
    return langid.identify(docs, keep=COLUMNS[1:]).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id, and of its rows the first in the files.

    Decisions are told by row, so repeated ids and rows without id are rows like any other; texts without words stay.
    """
    scratch = Scratch(spark)
    rows = with_row_key(docs.select(*COLUMNS), scratch)
    out = scratch.put(near_dedup.dedup(rows, keep=ROW).where("group_id is not null"))
    first = F.struct(*ROW)
    best = out.where("kept").groupBy("group_id").agg(F.min(first).alias("__best"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    gone = scratch.put(join_unique(out, best, ["group_id"]).where(~F.col("kept") | (F.col("__best") != first)).select(*ROW))
    scratch.drop(out)
    return near_dedup.only_ids(rows, gone, list(ROW), "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark."""
    scratch = Scratch(spark)
    rows = with_row_key(docs.select(*COLUMNS), scratch)
    gone = scratch.put(decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=ROW).where("contaminated").select(*ROW))
    return near_dedup.only_ids(rows, gone, list(ROW), "left_anti").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix takes them: a row for each copy.

    Copies are decided in a narrow table; texts meet them once, by row, so that neither a source nor an id gathers texts.
    """
    scratch = Scratch(spark)
    rows = with_row_key(docs.select(*COLUMNS), scratch)
    copies = scratch.put(mixing.mix(rows, table(spark, sf_dir, "labels"), keep=ROW).where("copies > 0").select(*ROW, "copies"))
    mixed = rows.join(copies.hint("shuffle_hash"), list(ROW))
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row into one of 24 shards; copies of a document share its shard and get slots of their own."""
    return sharding.shard(docs, 24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
    ("sharding", shard_stage),
]

#: Language ID is a trained model, which SQL can't express; tests hold the stages against brute-force versions, given its answers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; every stage's rows are written to the shared folder and read again, and go, with the stage's own tables, once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        before = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        release(before)
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
