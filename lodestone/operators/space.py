"""Index size accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.selection import delta_vs_first

SIGNATURE, BUCKET, POSTING, CENTROID, META = 4, 16, 4, 4, 20


def index_bytes(signatures: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """(n_points, signature_entries, signature_bytes, n_buckets, bucket_bytes, posting_bytes, centroid_bytes, total_bytes).

    A signature entry takes 4 bytes, a bucket 16, a posting 4, a centroid coordinate 4 and a cluster's parameters 20.
    """
    cells = signatures.groupBy("cluster_id", "h", "mh").agg(F.count(F.lit(1)).alias("n"))
    one = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("signature_entries"), F.count(F.lit(1)).alias("n_buckets"))
    points = signatures.where("h = 0").agg(F.count(F.lit(1)).alias("n_points"))
    extra = signatures.sparkSession.range(1).select(F.lit(0).cast("long").alias("centroid_bytes")) if centroids is None else centroids.agg((F.count(F.lit(1)) * CENTROID + F.countDistinct("cluster_id") * META).alias("centroid_bytes"))
    out = one.crossJoin(points).crossJoin(extra)  # one row each
    e, b = F.col("signature_entries"), F.col("n_buckets")
    return out.select("n_points", "signature_entries", (e * SIGNATURE).alias("signature_bytes"), "n_buckets", (b * BUCKET).alias("bucket_bytes"), (e * POSTING).alias("posting_bytes"), "centroid_bytes", (e * (SIGNATURE + POSTING) + b * BUCKET + F.col("centroid_bytes")).alias("total_bytes"))


def space_decomposition(named: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """One row per configuration (signatures, centroids), in the given order, with the difference to the first."""
    out = None
    for i, (name, (signatures, centroids)) in enumerate(named.items()):
        row = index_bytes(signatures, centroids).select(F.lit(i).alias("config_no"), F.lit(name).alias("config"), "*", F.lit("all").alias("__all"))
        out = row if out is None else out.unionByName(row)
    return delta_vs_first(out, "total_bytes", "__all", "config_no").drop("__all")
