"""Seeded spherical k-means over sparse vectors, boundary spill and memberships.

Centroids are unit vectors in parts per million, rounded after every round: sums of whole numbers do not depend on order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.operators import blocks
from lodestone.operators.storage import durable
from lodestone.operators.vectors import base_blocks, query_blocks

PPM = 1_000_000


@dataclass
class Clustering:
    """assign(vec_id, cluster_id) was made against the centroids before the last update, as in the surveyed method, unless reassigned."""

    assign: DataFrame
    centroids: DataFrame
    k: int
    rounds: int
    held: DataFrame | None = None


def _unit(sums: DataFrame) -> DataFrame:
    """(cluster_id, dim, s) to (cluster_id, dim, w): each cluster's sum at unit length."""
    square = F.col("s").cast("decimal(19,0)") * F.col("s").cast("decimal(19,0)")
    total = sums.groupBy("cluster_id").agg(F.sum(square).cast("double").alias("t"))
    w = F.round(F.col("s").cast("double") * PPM / F.sqrt("t")).cast("long")
    return sums.join(total, "cluster_id").where("t > 0").select("cluster_id", "dim", w.alias("w")).where("w <> 0")


def seeds(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """(vec_id, cluster_id): k distinct vectors by a seeded hash of their ids."""
    ids = vectors.select("vec_id").distinct().withColumn("r", F.expr(hashing.draw("vec_id", "0", seed)))
    few = ids.orderBy("r", "vec_id").limit(k)
    out = few.withColumn("cluster_id", (F.row_number().over(Window.orderBy("r", "vec_id")) - 1).cast("long"))  # k rows
    return out.select("vec_id", "cluster_id")


def _asking(vectors: DataFrame) -> DataFrame:
    return query_blocks(vectors.withColumnRenamed("vec_id", "qid"), per=blocks.BASE_BLOCK // 2)


def _sent(centroids: DataFrame) -> tuple[DataFrame, int]:
    return base_blocks(centroids.select(F.col("cluster_id").alias("vec_id"), "dim", F.col("w").alias("val")))


def scores(vectors: DataFrame, centroids: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(vec_id, cluster_id, score) of the pairs that share a dim, multiplied by blocks: those of the vectors (query_blocks(), if at hand) meet the centroids."""
    held = _asking(vectors) if held is None else held
    found = blocks.pairs(held, *_sent(centroids), "score")
    return found.select(F.col("qid").alias("vec_id"), F.col("vec_id").alias("cluster_id"), "score")


def assign(vectors: DataFrame, centroids: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(vec_id, cluster_id, score): the best cluster, ties and vectors without any shared dim to the lowest number."""
    held = _asking(vectors) if held is None else held
    return blocks.nearest(held, *_sent(centroids)).select(F.col("qid").alias("vec_id"), F.col("vec_id").alias("cluster_id"), "score")


def update(vectors: DataFrame, assigned: DataFrame, old: DataFrame) -> DataFrame:
    """New centroids; a cluster without members keeps its old one."""
    return _renewed(vectors.join(assigned.select("vec_id", "cluster_id"), "vec_id").groupBy("cluster_id", "dim").agg(F.sum("val").alias("s")), old)


def _renewed(sums: DataFrame, old: DataFrame) -> DataFrame:
    new = _unit(sums)
    return new.unionByName(old.join(new.select("cluster_id").distinct(), "cluster_id", "left_anti"))


def shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cluster_id, shift): how far each centroid moved, in units of its length."""
    both = old.withColumnRenamed("w", "a").join(new.withColumnRenamed("w", "b"), ["cluster_id", "dim"], "full_outer")
    d = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return both.groupBy("cluster_id").agg(F.round(F.sqrt(F.sum(d * d).cast("double")) / PPM, 6).alias("shift"))


def kmeans(vectors: DataFrame, k: int, max_iter: int = 25, tol: float = 1e-4, seed: int = 2026, final_reassign: bool = False) -> Clustering:
    """Rounds of assignment and update until no centroid moves by tol. tol 0 runs exactly max_iter rounds.

    Vectors aren't normalised, so centroid sums are weighted by length. k must be positive and at most the number of vectors.
    """
    n = vectors.select("vec_id").distinct().count()
    if not 0 < k <= n:
        raise ValueError(f"{k} clusters of {n} vectors")
    first = vectors.join(F.broadcast(seeds(vectors, k, seed)), "vec_id").groupBy("cluster_id", "dim").agg(F.sum("val").alias("s"))  # k vectors
    now, old, rounds = durable(_unit(first)), None, 0
    held, kind = _asking(vectors), "string" if dict(vectors.dtypes)["dim"] == "string" else "long"
    while rounds < max_iter:
        # The assignment of a round and its sums are made in one pass.
        sums = blocks.nearest(held, *_sent(now), kind).groupBy(F.col("vec_id").alias("cluster_id"), "dim").agg(F.sum("s").alias("s"))
        new = durable(_renewed(durable(sums), now))
        rounds += 1
        moved = shift(now, new).agg(F.max("shift")).first()[0] if tol > 0 else None
        old, now = now, new
        if moved is not None and moved < tol:
            break
    assigned = assign(vectors, now if final_reassign or old is None else old, held)
    return Clustering(assigned.select("vec_id", "cluster_id"), now, k, rounds, held)


def spill(vectors: DataFrame, clustering: Clustering, tau_percent: int = 80) -> DataFrame:
    """(vec_id, cluster_id): other clusters whose score is at least tau of the own cluster's, if that is positive."""
    if tau_percent <= 0 or clustering.k <= 1:
        return clustering.assign.limit(0)
    s = durable(scores(vectors, clustering.centroids, clustering.held))
    own = s.join(clustering.assign, ["vec_id", "cluster_id"]).select("vec_id", F.col("cluster_id").alias("own"), F.col("score").alias("best")).where("best > 0")
    return s.join(own, "vec_id").where((F.col("cluster_id") != F.col("own")) & (F.col("score") * 100 >= F.col("best") * tau_percent)).select("vec_id", "cluster_id")


def memberships(clustering: Clustering, spilled: DataFrame | None = None) -> DataFrame:
    out = clustering.assign if spilled is None else clustering.assign.unionByName(spilled)
    return out.distinct()


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_i"))


def size_stats(members: DataFrame) -> DataFrame:
    return sizes(members).agg(F.min("n_i").alias("min_n"), F.max("n_i").alias("max_n"), F.round(F.avg("n_i"), 9).alias("avg_n"), F.count(F.lit(1)).alias("n_clusters"))


def active_dims(vectors: DataFrame, members: DataFrame, weights: DataFrame) -> DataFrame:
    """(cluster_id, n_dims, avg_l): the dims that a cluster's members use and their mean length."""
    used = vectors.where("val > 0").join(members, "vec_id").select("cluster_id", "dim").distinct()
    return used.join(weights.select("dim", "l"), "dim").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_dims"), F.round(F.avg("l"), 9).alias("avg_l"))
