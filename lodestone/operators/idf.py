"""IDF weights and the slot layout that they give: every dim owns l consecutive slots, more if it is rare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PPM = 1_000_000


def document_frequency(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("df"))


def idf_raw(vectors: DataFrame, n: int | None = None, universe: DataFrame | None = None) -> DataFrame:
    """(dim, df, raw_ppm): ln(n / (df + 1)) + 1 in parts per million, of observed dims or of a whole universe (df 0 included)."""
    df = document_frequency(vectors)
    if universe is not None:
        df = universe.select("dim").join(df, "dim", "left").select("dim", F.coalesce("df", F.lit(0)).alias("df"))
    if n is not None:
        total = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"))
    else:
        total = vectors.agg(F.countDistinct("vec_id").alias("n"))
    out = df.crossJoin(F.broadcast(total))  # one row
    return out.select("dim", "df", F.round((F.ln(F.col("n") / (F.col("df") + 1)) + 1) * PPM).cast("long").alias("raw_ppm"))


def clip_scaled(raw: DataFrame, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Adds idf_ppm, raw_ppm moved linearly to [lo, hi] (in either order); equal values all become lo."""
    lo_ppm, hi_ppm = round(min(lo, hi) * PPM), round(max(lo, hi) * PPM)
    ends = raw.agg(F.min("raw_ppm").alias("lo"), F.max("raw_ppm").alias("hi"))
    out = raw.crossJoin(F.broadcast(ends))  # one row
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(lo_ppm)).otherwise(F.lit(lo_ppm) + F.expr(f"(raw_ppm - lo) * {hi_ppm - lo_ppm} div (hi - lo)"))
    return out.withColumn("idf_ppm", scaled.cast("long")).drop("lo", "hi")


def with_length(weights: DataFrame, l_base: int = 20, adaptive: bool = True) -> DataFrame:
    """Adds l: clamp(round(l_base * idf), 3, 40), or max(3, l_base) for all dims."""
    if not adaptive:
        return weights.withColumn("l", F.lit(max(3, l_base)).cast("long"))
    return weights.withColumn("l", F.greatest(F.lit(3), F.least(F.lit(40), F.expr(f"({l_base} * idf_ppm + {PPM // 2}) div {PPM}"))).cast("long"))


def prefix_sum(rows: DataFrame, value: str, order: str, bucket: Column, name: str) -> DataFrame:
    """The running sum of the values before each row, by `order`, in two levels.

    bucket must grow with order. Sums run within buckets; only one row per bucket meets in one task.
    """
    rows = rows.withColumn("__b", bucket)
    sums = rows.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = sums.selectExpr("__b", "coalesce(sum(__s) over (order by __b rows between unbounded preceding and 1 preceding), 0) as __before")
    inner = rows.selectExpr("*", f"coalesce(sum({value}) over (partition by __b order by {order} rows between unbounded preceding and 1 preceding), 0) as __in")
    return inner.join(before, "__b").withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__b", "__before", "__in")


def _dim_bucket(weights: DataFrame) -> Column:
    return F.substring("dim", 1, 2) if dict(weights.dtypes)["dim"] == "string" else F.floor(F.col("dim") / 4096)


def with_prefix(weights: DataFrame) -> DataFrame:
    return prefix_sum(weights, "l", "dim", _dim_bucket(weights), "prefix_l")


def idf_weights(vectors: DataFrame, l_base: int = 20, lo: float = 0.5, hi: float = 2.0, adaptive: bool = True, universe: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(dim, df, raw_ppm, idf_ppm, l, prefix_l)."""
    return with_prefix(with_length(clip_scaled(idf_raw(vectors, n, universe), lo, hi), l_base, adaptive))


def fixed_layout(vectors: DataFrame, l: int = 10) -> DataFrame:  # noqa: E741
    """(dim, l, prefix_l) with the same length for every observed dim."""
    return with_prefix(vectors.select("dim").distinct().withColumn("l", F.lit(l).cast("long")))


def length_stats(weights: DataFrame) -> DataFrame:
    return weights.agg(F.min("l").alias("min_l"), F.max("l").alias("max_l"), F.round(F.avg("l"), 9).alias("avg_l"), F.sum("l").alias("total_l"), F.count(F.lit(1)).alias("n_dims"))


def domain_of(weights: DataFrame) -> int:
    """The hash domain: all slots and one more for the empty set."""
    return int(weights.agg(F.coalesce(F.sum("l"), F.lit(0))).first()[0]) + 1
