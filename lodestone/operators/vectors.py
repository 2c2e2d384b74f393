"""Operators on sparse vectors in long form (vec_id, dim, val): filters, norms, inner products, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import blocks
from lodestone.operators.storage import durable

PPM = 1_000_000
#: Queries of so many coordinates in all are broadcast, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Queries that fill fewer blocks are dealt to so many.
MANY_BLOCKS = 32
#: Spark limits rows per window group before the shuffle only up to this rank.
GROUP_LIMIT = 1000


def merged(vectors: DataFrame) -> DataFrame:
    """Enforces one row per (vec_id, dim): repeated coordinates are added up."""
    return vectors.groupBy("vec_id", "dim").agg(F.sum("val").alias("val"))


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, ind, val): coordinates as two arrays, sorted by dim."""
    rows = vectors.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("dim", "val"))).alias("c"))
    return rows.select("vec_id", F.col("c.dim").alias("ind"), F.col("c.val").alias("val"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.explode(F.arrays_zip(F.col("ind").alias("dim"), F.col("val").alias("val"))).alias("c")).select("vec_id", F.col("c.dim").alias("dim"), F.col("c.val").alias("val"))


def row_slice(vectors: DataFrame, vec_id: int) -> DataFrame:
    return vectors.where(F.col("vec_id") == vec_id)


def positive(vectors: DataFrame) -> DataFrame:
    return vectors.where("val > 0")


def dim_limit(vectors: DataFrame, limit: int) -> DataFrame:
    """Keeps dims below the limit; meant for sketch input only, exact products read the whole vector."""
    return vectors.where(F.col("dim") < limit)


def row_limit(vectors: DataFrame, n: int) -> DataFrame:
    """The first n vectors; ids must be contiguous from 0."""
    return vectors.where(F.col("vec_id") < n)


def max_normalised(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Adds norm_ppm, val over the vector's largest value in parts per million, held to [0, 10^6]; 10^6 if that isn't positive."""
    top = F.max("val").over(Window.partitionBy(id_col))
    norm = F.when(top <= 0, F.lit(PPM)).otherwise(F.greatest(F.lit(0), F.least(F.lit(PPM), F.floor(F.col("val") * PPM / top))))
    return vectors.withColumn("norm_ppm", norm.cast("long"))


def global_max_normalised(vectors: DataFrame) -> DataFrame:
    """The same over the largest value of all vectors."""
    top = vectors.agg(F.max("val").alias("top"))
    out = vectors.crossJoin(F.broadcast(top))  # one row
    norm = F.when(F.col("top") <= 0, F.lit(PPM)).otherwise(F.greatest(F.lit(0), F.least(F.lit(PPM), F.floor(F.col("val") * PPM / F.col("top")))))
    return out.withColumn("norm_ppm", norm.cast("long")).drop("top")


def norm_squares(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("vec_id").agg(F.sum(F.col("val") * F.col("val")).alias("norm_sq"), F.max("val").alias("max_val"), F.count(F.lit(1)).alias("nnz"))


def l2_normalised(vectors: DataFrame) -> DataFrame:
    """Adds unit = val / |vector|, rounded to nine digits; a zero vector is left alone."""
    total = F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("vec_id"))
    return vectors.withColumn("unit", F.round(F.when(total > 0, F.col("val") / F.sqrt(total)).otherwise(F.col("val").cast("double")), 9))


def sparse_dot(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, vec_id, ip) of all pairs that share a dim: an equi-join on dim, summed with partial sums before the shuffle."""
    both = queries.select("qid", "dim", F.col("val").alias("qv")).join(vectors.select("vec_id", "dim", F.col("val").alias("dv")), "dim")
    return both.groupBy("qid", "vec_id").agg(F.sum(F.col("qv") * F.col("dv")).alias("ip"))


def weighted_dot(queries: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, vec_id, wip): the sum of q * d * w^3, w being a dim's weight in parts per million (1 where it has none), rounded to six digits per dim."""
    w = F.coalesce(F.col("idf_ppm") / PPM, F.lit(1.0))
    cube = F.round(w * w * w * PPM).cast("long")
    side = queries.select("qid", "dim", F.col("val").alias("qv")).join(weights.select("dim", "idf_ppm"), "dim", "left").select("qid", "dim", (F.col("qv") * cube).alias("qw"))
    return block_products(side, vectors, "qw", "wip")


def query_blocks(queries: DataFrame, val: str = "val", most: int = 0, per: int = 0) -> DataFrame:
    """(qid, dim, val) in blocks (of `per` queries, if given), computed once, each query to keep `most` candidates."""
    asked = durable(blocks.packed(blocks.narrow(queries, "dim", val), "qid", val).select("*", F.lit(0).cast("long").alias("cluster_id"), F.lit(most).cast("long").alias("most")))
    n = asked.count()
    per = per or blocks.per_block(most) if per or n > MANY_BLOCKS * blocks.QUERY_BLOCK else max(16, min(blocks.per_block(most), n // MANY_BLOCKS + 1))
    return durable(blocks.blocks(asked, "qid", n, per, "dims", "vals", "most"))


def base_blocks(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, dim, val) in blocks, computed once, and their bytes."""
    base = durable(blocks.packed(blocks.narrow(vectors, "dim", "val"), "vec_id").select("*", F.lit(0).cast("long").alias("cluster_id")))
    return blocks.settled(blocks.blocks(base, "vec_id", base.count(), blocks.BASE_BLOCK, "dims", "vals"))


def block_products(queries: DataFrame, vectors: DataFrame, val: str, name: str) -> DataFrame:
    """(qid, vec_id, name) of all pairs that share a dim, multiplied by blocks: no row per shared dim, and no shuffle of pairs.

    The product is a long, or decimal(38,0) if any leaves 64 bits.
    """
    return blocks.pairs(query_blocks(queries, val), *base_blocks(vectors), name)


def block_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """exact_topk() by blocks, for vectors of which most pairs share dims: a task multiplies its queries with all vectors and keeps a running k best."""
    found = blocks.search(query_blocks(queries, most=k), *base_blocks(vectors), "ip", "ranked")
    return found.select("qid", "vec_id", F.col("score").alias("ip"), F.col("place").alias("rank"))


def top_k(scored: DataFrame, k: int, by: str = "ip", group: tuple[str, ...] = ("qid",), tie: str = "vec_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ties to the smaller id. The literal bound lets Spark cut each group before the shuffle."""
    order = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), tie))
    return scored.withColumn(rank, order).where(F.col(rank) <= k)


def gathered_dot(queries: DataFrame, vectors: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """sparse_dot() that gathers vectors by id once and sends the queries to them.

    All products of a vector are made and added up in one task, so that pairs are ranked there and never shuffled.
    Queries of more than `bound` coordinates meet the vectors by dim instead.
    """
    few = durable(queries.select("qid", "dim", F.col("val").alias("qv")))
    if few.count() > bound:
        return sparse_dot(queries, vectors)
    both = vectors.select("vec_id", "dim", F.col("val").alias("dv")).repartition("vec_id").join(F.broadcast(few), "dim")
    return both.groupBy("qid", "vec_id").agg(F.sum(F.col("qv") * F.col("dv")).alias("ip"))


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, ip, rank): the exact best k vectors of every query among those that share a dim with it."""
    return top_k(gathered_dot(queries, vectors), k)


def padded_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """exact_topk that fills short lists with vectors of product 0, smallest ids first.

    A list short of k has fewer than k overlapping vectors, so its fill is among the 2k smallest ids.
    """
    scored = sparse_dot(queries, vectors)
    fill = vectors.select("vec_id").distinct().orderBy("vec_id").limit(2 * k)
    short = queries.select("qid").distinct().join(scored.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < k).select("qid")
    zero = short.crossJoin(F.broadcast(fill)).join(scored.select("qid", "vec_id"), ["qid", "vec_id"], "left_anti").select("qid", "vec_id", F.lit(0).cast("long").alias("ip"))
    return top_k(scored.unionByName(zero), k)


def norm_range_partition(vectors: DataFrame, ratio: float = 0.5, size: int = 40960) -> DataFrame:
    """(vec_id, norm_sq, chunk, local_id): vectors by squared norm in ranges [r^-i, r^-(i+1)), each cut every `size` ranks.

    Ranges are fixed powers of 1 / ratio, so that no pass over sorted norms is needed.
    """
    norms = norm_squares(vectors).select("vec_id", "norm_sq")
    level = norms.withColumn("level", F.floor(F.round(F.ln(F.col("norm_sq").cast("double")) / F.ln(F.lit(1 / ratio)), 9)).cast("long"))
    at = F.row_number().over(Window.partitionBy("level").orderBy("norm_sq", "vec_id")) - 1
    out = level.withColumn("at", at)
    return out.select("vec_id", "norm_sq", "level", F.floor(F.col("at") / size).cast("long").alias("chunk"), (F.col("at") % size).cast("long").alias("local_id"))
