"""Intermediate tables that survive executors, and index tables kept as Parquet under a manifest."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it; a session of one process has one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def durable(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and cuts its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def placed(df: DataFrame, *by: str) -> DataFrame:
    """durable(), dealt by columns to as many partitions as a shuffle has: joins and sums by them need no shuffle any more.

    Planned without adaptive execution, which doesn't tell a stored table how it was dealt.
    """
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return durable(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by))
    finally:
        spark.conf.set(key, was)


def fingerprint(vectors: DataFrame) -> dict[str, int]:
    """What a cache must agree in with its data: rows, vectors, and an order-free hash of all coordinates."""
    row = vectors.agg(F.count(F.lit(1)), F.countDistinct("vec_id"), F.coalesce(F.sum(F.pmod(F.xxhash64("vec_id", "dim", "val"), F.lit(1 << 31))), F.lit(0))).first()
    return {"nnz": int(row[0]), "n": int(row[1]), "hash": int(row[2])}


def save_tables(tables: dict[str, DataFrame], path: str, manifest: dict) -> None:
    """Writes every table, then the manifest: a cache without one is never read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:  # noqa: BLE001  Spark has one exception for all missing paths
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {x: spark.read.parquet(f"{path}/{x}") for x in names}


def get_or_build(spark: SparkSession, path: str, manifest: dict, build, force: bool = False) -> dict[str, DataFrame]:  # noqa: ANN001
    """The tables under path if their manifest agrees, else those that build() gives, saved there first."""
    known = load_manifest(spark, path)
    want = json.loads(json.dumps(manifest))
    if force or known is None or {k: v for k, v in known.items() if k != "tables"} != want:
        tables = build()
        save_tables(tables, path, want | {"tables": sorted(tables)})
        known = want | {"tables": sorted(tables)}
    return load_tables(spark, path, known["tables"])
