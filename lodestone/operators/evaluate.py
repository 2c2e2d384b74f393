"""Evaluation against exact answers: recall, ratios, coverage, rank correlation, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    return results.join(truth.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi")


def recall_at_k(results: DataFrame, truth: DataFrame, k: int, distinct: bool = True) -> DataFrame:
    """(qid, n_hits, recall) of every query with a truth: hits over k, by distinct ids or, as duplicates allow, by rows."""
    n = F.countDistinct("vec_id") if distinct else F.count(F.lit(1))
    found = hits(results, truth).groupBy("qid").agg(n.alias("n_hits"))
    out = truth.select("qid").distinct().join(found, "qid", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return out.select("qid", "n_hits", F.round(F.col("n_hits") / k, 9).alias("recall"))


def score_ratio(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, ratio): min(1, sum of returned products over sum of true ones)."""
    got = results.groupBy("qid").agg(F.sum("ip").alias("got"))
    out = truth.groupBy("qid").agg(F.sum("ip").alias("best")).join(got, "qid", "left")
    return out.select("qid", F.round(F.least(F.lit(1.0), F.coalesce("got", F.lit(0)) / F.col("best")), 9).alias("ratio"))


def rank_aligned(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, rank, ratio): the r-th returned product over the r-th true one."""
    both = results.select("qid", "rank", F.col("ip").alias("got")).join(truth.select("qid", "rank", F.col("ip").alias("best")), ["qid", "rank"])
    return both.select("qid", "rank", F.round(F.col("got") / F.col("best"), 9).alias("ratio"))


def rank_ratios(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, mean_ratio, kth_ratio): the mean over ranks, and the ratio at the last rank."""
    r = rank_aligned(results, truth)
    return r.groupBy("qid").agg(F.round(F.sum(F.round(F.col("ratio") * 1e9).cast("long")) / F.count(F.lit(1)) / 1e9, 6).alias("mean_ratio"), F.max_by("ratio", "rank").alias("kth_ratio"))


def satisfied_at_c(results: DataFrame, truth: DataFrame, k: int, levels: tuple[float, ...] = (0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """(c, satisfied): the share of the queries' k ranks whose ratio is at least c."""
    n = truth.agg(F.countDistinct("qid").alias("n_queries"))
    each = rank_aligned(results, truth).withColumn("c", F.explode(F.array(*[F.lit(x) for x in levels])))
    counts = each.groupBy("c").agg(F.sum((F.col("ratio") >= F.col("c")).cast("long")).alias("n"))
    return counts.crossJoin(F.broadcast(n)).select("c", F.round(F.col("n") / (F.col("n_queries") * k), 9).alias("satisfied"))  # one row


def coverage_precision(ranked: DataFrame, truth: DataFrame, k: int, cuts: tuple[int, ...] = (100, 200, 500, 1000)) -> DataFrame:
    """(qid, cut, covered, coverage, precision): true answers among the first `cut` candidates (qid, vec_id, place)."""
    true = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    found = ranked.select("qid", "vec_id", "place").join(true, ["qid", "vec_id"], "left_semi")
    wide = truth.select("qid").distinct().withColumn("cut", F.explode(F.array(*[F.lit(x) for x in cuts])))
    out = wide.join(found, "qid", "left").groupBy("qid", "cut").agg(F.count(F.when(F.col("place") <= F.col("cut"), 1)).alias("covered"))
    return out.select("qid", "cut", "covered", F.round(F.col("covered") / k, 9).alias("coverage"), F.round(F.col("covered") / F.col("cut"), 9).alias("precision"))


def average_ranks(rows: DataFrame, value: str, name: str, group: str = "qid") -> DataFrame:
    """Adds twice the average rank with ties (a whole number), the smallest value first."""
    w = Window.partitionBy(group)
    twice = 2 * F.rank().over(w.orderBy(value)) + F.count(F.lit(1)).over(Window.partitionBy(group, value)) - 1
    return rows.withColumn(name, twice.cast("long"))


def spearman(rows: DataFrame, a: str, b: str, group: str = "qid") -> DataFrame:
    """(group, n, spearman): Pearson correlation of tie-averaged ranks; 0 for fewer than two rows or a constant side."""
    r = average_ranks(average_ranks(rows, a, "x", group), b, "y", group)
    s = r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(e).cast("decimal(19,0)")).cast("decimal(38,0)").alias(k) for k, e in (("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("syy", "y * y"), ("sxy", "x * y"))])
    vx, vy, cov = (F.expr(e).cast("double") for e in ("n * sxx - sx * sx", "n * syy - sy * sy", "n * sxy - sx * sy"))
    return s.select(group, "n", F.round(F.when((F.col("n") < 2) | (vx <= 0) | (vy <= 0), 0.0).otherwise(cov / F.sqrt(vx) / F.sqrt(vy)), 6).alias("spearman"))


def proxy_summary(per_query: DataFrame) -> DataFrame:
    """Means over queries of spearman, coverage and precision per config (config, qid, spearman, cut, coverage, precision)."""
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6, 6)
    return per_query.groupBy("config", "cut").agg(mean("spearman").alias("spearman"), mean("coverage").alias("coverage"), mean("precision").alias("precision"), F.count(F.lit(1)).alias("n"))


def audit_status(recalls: DataFrame, target: float, slack: tuple[float, float, float] = (0.03, 0.10, 0.08)) -> DataFrame:
    """(avg, min, max recall, status): verified if the mean misses the target by at most slack[0] and the minimum by at
    most slack[1]; provisional if the mean misses it by at most slack[2]; else reject."""
    s = recalls.agg(F.round(F.sum(F.round(F.col("recall") * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6, 6).alias("avg_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"))
    ok = (F.col("avg_recall") >= round(target - slack[0], 9)) & (F.col("min_recall") >= round(target - slack[1], 9))
    return s.withColumn("status", F.when(ok, "verified").when(F.col("avg_recall") >= round(target - slack[2], 9), "provisional").otherwise("reject"))


def consistency(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_a, n_b, n_truth, n_common, depth): distinct queries of two results and the truth, those in all three, deepest rank."""
    ids = lambda x: x.select("qid").distinct()
    common = ids(a).intersect(ids(b)).intersect(ids(truth))
    counts = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((ids(a), "n_a"), (ids(b), "n_b"), (ids(truth), "n_truth"), (common, "n_common"))]
    depth = a.select("rank").unionByName(b.select("rank")).agg(F.max("rank").cast("long").alias("depth"))
    out = counts[0]
    for x in (*counts[1:], depth):
        out = out.crossJoin(x)  # one row each
    return out


def top_ids(results: DataFrame, n: int = 10) -> DataFrame:
    """(qid, ids): the first n ids as one string."""
    return results.where(F.col("rank") <= n).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ";").alias("ids"))


def spot_audit(results: DataFrame, truth: DataFrame, counts: DataFrame, k: int, n: int = 10) -> DataFrame:
    """(qid, truth_top, result_top, recall, n_verified): what an auditor looks at."""
    out = top_ids(truth, n).withColumnRenamed("ids", "truth_top").join(top_ids(results, n).withColumnRenamed("ids", "result_top"), "qid", "left")
    out = out.join(recall_at_k(results, truth, k).select("qid", "recall"), "qid").join(counts.select("qid", "n_verified"), "qid", "left")
    return out.select("qid", "truth_top", F.coalesce("result_top", F.lit("")).alias("result_top"), "recall", F.coalesce("n_verified", F.lit(0)).alias("n_verified"))


def benchmark_averages(per_query: DataFrame, clusters: bool = False) -> DataFrame:
    """Means over queries of recall, ratio and cost (qid, recall, ratio, n_verified), and of clusters asked for, found and giving candidates (n_requested, n_selected, n_active)."""
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6, 6)
    more = [mean(f"n_{x}").alias(f"avg_{x}") for x in ("requested", "selected", "active")] if clusters else []
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), mean("recall").alias("recall"), mean("ratio").alias("ratio"), mean("n_verified").alias("avg_verified"), *more)


def baseline_averages(results: DataFrame, truth: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(n_queries, recall, ratio, kth_ratio, avg_verified) of an un-clustered method: ratios by rank, over queries with results."""
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count(c) / 1e6, 6)
    per = recall_at_k(results, truth, k).join(rank_ratios(results, truth), "qid", "left").join(counts, "qid", "left")
    per = per.withColumn("n_verified", F.coalesce("n_verified", F.lit(0)))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), mean("recall").alias("recall"), mean("mean_ratio").alias("ratio"), mean("kth_ratio").alias("kth_ratio"), mean("n_verified").alias("avg_verified"))
