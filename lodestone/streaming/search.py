"""An extension: a stream of query vectors answered from a static index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lodestone.operators import search, vectors


def answer_stream(queries: DataFrame, index: search.Index, k: int, nprobe: int, sink: str) -> DataStreamWriter:
    """Writes (qid, rank, vec_id, ip) of every micro-batch of (qid, dim, val) rows to Parquet under sink.

    All of a query's coordinates must arrive in one batch, as rows of one file do; a batch is one search job.
    """

    def answer(batch: DataFrame, number: int) -> None:
        search.clustered_search(index, batch, k, nprobe).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(answer)


def exact_stream(queries: DataFrame, base: DataFrame, k: int, sink: str) -> DataStreamWriter:
    """The same by exact products."""

    def answer(batch: DataFrame, number: int) -> None:
        vectors.exact_topk(batch, base, k).select("qid", "rank", "vec_id", "ip").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(answer)
