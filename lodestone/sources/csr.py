"""Binary CSR matrices and ground-truth files on file systems that the driver and all tasks mount.

CSR: three uint64 (rows, columns, non-zeros), uint64 offsets[rows + 1], int32 indices, float32 values, little-endian.
Truth: int32 queries, int32 depth, int32 ids[queries][depth], float32 scores[queries][depth].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.operators.storage import durable

PACKED = "vec_id bigint, ind array<int>, val array<float>"
ROWS_PER_TASK = 50_000
ROWS_PER_BATCH = 4096


def _offsets(path: str) -> tuple[int, int, int, np.ndarray]:
    head = np.fromfile(path, np.uint64, 3)
    if len(head) < 3:
        raise ValueError(f"{path}: no CSR header")
    rows, cols, nnz = (int(x) for x in head)
    offsets = np.memmap(path, np.uint64, "r", 24, (rows + 1,))
    size = 24 + 8 * (rows + 1) + 8 * nnz
    import os

    if os.path.getsize(path) != size or int(offsets[-1]) != nnz:
        raise ValueError(f"{path}: {os.path.getsize(path)} bytes do not agree with its header, which asks for {size}")
    return rows, cols, nnz, offsets


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, step: int) -> None:
        self.path, self.step = path, step

    def partitions(self) -> list[InputPartition]:
        rows = _offsets(self.path)[0]
        return [_Range(a, min(rows, a + self.step)) for a in range(0, rows, self.step)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        rows, _, nnz, offsets = _offsets(self.path)
        at = 24 + 8 * (rows + 1)
        ind = np.memmap(self.path, np.int32, "r", at, (nnz,)) if nnz else np.zeros(0, np.int32)
        val = np.memmap(self.path, np.float32, "r", at + 4 * nnz, (nnz,)) if nnz else np.zeros(0, np.float32)
        for first in range(part.first, part.last, ROWS_PER_BATCH):
            last = min(part.last, first + ROWS_PER_BATCH)
            ends = np.array(offsets[first : last + 1]).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(np.array(x[ends[0] : ends[-1]]))) for x in (ind, val)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), *lists], ["vec_id", "ind", "val"])


class CsrDataSource(DataSource):
    """spark.read.format("csr").load(path): a task per range of rows, for files on a file system that all tasks mount."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return PACKED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rowspertask", ROWS_PER_TASK)))


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, ind, val) of a mounted file."""
    spark.dataSource.register(CsrDataSource)
    return spark.read.format("csr").load(path)


def long_form(packed: DataFrame) -> DataFrame:
    both = packed.select("vec_id", F.explode(F.arrays_zip("ind", "val")).alias("c"))
    return both.select("vec_id", F.col("c.ind").cast("long").alias("dim"), F.col("c.val").alias("val"))


def write_csr(vectors: DataFrame, path: str, n: int | None = None, dims: int | None = None) -> None:
    """Writes (vec_id, dim, val), ids from 0, to a mounted file: ranges of ids go to tasks, each of which writes its part of the file.

    A task's places follow from how many coordinates the ranges before it hold, and writing them again changes nothing.
    The driver holds two numbers for each range.
    """
    spread = durable(vectors.select("vec_id", "dim", "val").repartitionByRange("vec_id").sortWithinPartitions("vec_id", "dim"))
    sizes = spread.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)), F.coalesce(F.max("dim") + 1, F.lit(0)), F.count(F.lit(1))).first()
    rows, cols, nnz = n or int(sizes[0]), dims or int(sizes[1]), int(sizes[2])
    held = spread.groupBy(F.spark_partition_id().alias("part")).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per task
    starts = [0, *[r["first"] for r in held[1:]], rows]  # ids without coordinates belong to the range before them
    before = np.concatenate([[0], np.cumsum([r["n"] for r in held])]).astype(np.int64)
    place = {r["part"]: (int(starts[i]), int(starts[i + 1]), int(before[i])) for i, r in enumerate(held)}
    with open(path, "wb") as f:
        np.array([rows, cols, nnz], np.uint64).tofile(f)
        f.truncate(24 + 8 * (rows + 1) + 8 * nnz)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 24 + 8 * (rows + 1)
        mine = place.get(TaskContext.get().partitionId())
        if mine is None:
            yield from (b.slice(0, 0).select([0]) for b in batches)
            return
        first, last, done = mine
        counts, start = np.zeros(last - first, np.uint64), done
        with open(path, "r+b") as f:
            for batch in batches:
                ids, ind, val = (batch.column(i).to_numpy() for i in range(3))
                np.add.at(counts, ids - first, np.uint64(1))
                for offset, x in ((at, ind.astype(np.int32)), (at + 4 * nnz, val.astype(np.float32))):
                    f.seek(offset + 4 * done)
                    f.write(x.tobytes())
                done += len(ids)
            f.seek(24 + 8 * (first + 1))
            f.write((start + np.cumsum(counts)).astype(np.uint64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([done - start], pa.int64())], ["vec_id"])

    spread.mapInArrow(write, "vec_id long").agg(F.sum("vec_id")).collect()


def write_truth(truth: DataFrame, path: str, depth: int) -> None:
    """(qid, rank, vec_id, ip), queries from 0; missing ranks are id -1 and score 0."""
    n = int(truth.agg(F.coalesce(F.max("qid") + 1, F.lit(0))).first()[0])
    ids, scores = np.full((n, depth), -1, np.int32), np.zeros((n, depth), np.float32)
    for r in truth.where(F.col("rank") <= depth).toLocalIterator():
        ids[r["qid"], r["rank"] - 1], scores[r["qid"], r["rank"] - 1] = r["vec_id"], r["ip"]
    with open(path, "wb") as f:
        np.array([n, depth], np.int32).tofile(f)
        ids.tofile(f)
        scores.tofile(f)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, vec_id, ip) of a truth file, a bounded table of queries * depth rows."""
    n, depth = (int(x) for x in np.fromfile(path, np.int32, 2))
    ids = np.fromfile(path, np.int32, n * depth, offset=8).reshape(n, depth)
    scores = np.fromfile(path, np.float32, n * depth, offset=8 + 4 * n * depth).reshape(n, depth)
    rows = [(q, r + 1, int(ids[q, r]), float(scores[q, r])) for q in range(n) for r in range(depth) if ids[q, r] >= 0]
    return spark.createDataFrame(rows, "qid long, rank int, vec_id long, ip float")


def truth_csv(truth: DataFrame, k: int, queries: int) -> DataFrame:
    """(query_id, rank, doc_id, score) of the first queries, to be written as CSV with a header."""
    return truth.where((F.col("rank") <= k) & (F.col("qid") < queries)).select(F.col("qid").alias("query_id"), "rank", F.col("vec_id").alias("doc_id"), F.col("ip").alias("score"))
