"""Choosing configurations from curves (dataset, method, config, knob, recall, qps, cost)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _targets(curve: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    return curve.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))


def _first(rows: DataFrame, group: tuple[str, ...], *order: Column) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__r = 1").drop("__r")


def dedup_best_qps(curve: DataFrame) -> DataFrame:
    """The fastest row of each (dataset, method, config)."""
    return _first(curve, ("dataset", "method", "config"), F.desc("qps"), F.asc("knob"))


def select_max_qps(curve: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """Per dataset, method and target, the fastest row that reaches it; a row with status N/A where none does."""
    wide = _targets(curve, targets)
    best = _first(wide.where("recall >= target"), ("dataset", "method", "target"), F.desc("qps"), F.asc("config"), F.asc("knob"))
    every = wide.select("dataset", "method", "target").distinct()
    out = every.join(best.select("dataset", "method", "target", "config", "knob", "recall", "qps", "cost"), ["dataset", "method", "target"], "left")
    return out.withColumn("status", F.when(F.col("qps").isNull(), "N/A").otherwise("ok"))


def select_nearest(curve: DataFrame, targets: tuple[float, ...], tolerance: float | None = None) -> DataFrame:
    """The row of nearest recall, ties to the faster; beyond the tolerance N/A."""
    gap = F.round(F.abs(F.col("recall") - F.col("target")), 9)
    best = _first(_targets(curve, targets).withColumn("gap", gap), ("dataset", "method", "target"), F.asc("gap"), F.desc("qps"), F.asc("config"), F.asc("knob"))
    ok = F.lit(True) if tolerance is None else F.col("gap") <= tolerance
    return best.select("dataset", "method", "target", "config", "knob", "recall", "qps", "cost", F.when(ok, "ok").otherwise("N/A").alias("status"))


def select_reaching(curve: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """The row of nearest recall among those that reach the target."""
    best = _first(_targets(curve, targets).where("recall >= target"), ("dataset", "method", "target"), F.asc("recall"), F.desc("qps"), F.asc("config"), F.asc("knob"))
    return best.select("dataset", "method", "target", "config", "knob", "recall", "qps", "cost")


def select_min_nprobe(grid: DataFrame, target: float) -> DataFrame:
    """Per config, the smallest knob that reaches the target, ties to the faster."""
    return _first(grid.where(F.col("recall") >= target), ("dataset", "method", "config"), F.asc("knob"), F.desc("qps"))


def pick_working_points(grid: DataFrame) -> DataFrame:
    """(role, ...): default is the fastest, then cheapest, with recall in [0.94, 0.96], or else the one nearest 0.95, then likewise; high_recall
    is the best recall, then fastest, of those from 0.97 on, or else the one nearest 0.97."""
    near = lambda x: F.round(F.abs(F.col("recall") - x), 9)
    group = ("dataset", "method")
    band = F.when(F.col("recall").between(0.94, 0.96), 0).otherwise(1)
    default = _first(grid.withColumn("__b", band), group, F.asc("__b"), F.when(F.col("__b") == 0, -F.col("qps")).otherwise(near(0.95)).asc(), F.desc("qps"), F.asc("cost"), F.asc("config"), F.asc("knob")).drop("__b")
    top = F.when(F.col("recall") >= 0.97, 0).otherwise(1)
    high = _first(grid.withColumn("__b", top), group, F.asc("__b"), F.when(F.col("__b") == 0, -F.col("recall")).otherwise(near(0.97)).asc(), F.desc("qps"), F.asc("config"), F.asc("knob")).drop("__b")
    return default.withColumn("role", F.lit("default")).unionByName(high.withColumn("role", F.lit("high_recall")))


def parameter_roles(grid: DataFrame) -> DataFrame:
    """Every row with its role: default, high_recall, both (joined by +), or rejected."""
    picked = pick_working_points(grid).groupBy("dataset", "method", "config", "knob").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("role"))
    return grid.join(picked, ["dataset", "method", "config", "knob"], "left").withColumn("role", F.coalesce("role", F.lit("rejected")))


def equal_recall_pivot(selected: DataFrame, targets: tuple[float, ...], value: str = "qps") -> DataFrame:
    """One row per dataset and method, one column t<target percent> per target."""
    names = {f"t{round(t * 100)}": float(t) for t in targets}
    aggs = [F.max(F.when(F.col("target") == t, F.col(value))).alias(n) for n, t in names.items()]
    return selected.groupBy("dataset", "method").agg(*aggs)


def paper_table(selected: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """The same with cells `qps (cost)`, rounded to whole numbers, N/A where there is none."""
    cell = F.concat(F.round("qps").cast("long").cast("string"), F.lit(" ("), F.round("cost").cast("long").cast("string"), F.lit(")"))
    names = {f"t{round(t * 100)}": float(t) for t in targets}
    aggs = [F.coalesce(F.max(F.when(F.col("target") == t, cell)), F.lit("N/A")).alias(n) for n, t in names.items()]
    return selected.groupBy("dataset", "method").agg(*aggs)


def speedups(selected: DataFrame, reference: str) -> DataFrame:
    """Adds speedup: qps over that of the reference method at the same dataset and target."""
    base = selected.where(F.col("method") == reference).select("dataset", "target", F.col("qps").alias("__ref"))
    return selected.join(base, ["dataset", "target"], "left").withColumn("speedup", F.round(F.col("qps") / F.col("__ref"), 6)).drop("__ref")


def monotonic(selected: DataFrame) -> DataFrame:
    """(dataset, method, qps_ok, cost_ok): along growing targets, qps must not grow and cost must not fall."""
    w = Window.partitionBy("dataset", "method").orderBy("target")
    have = selected.where("qps is not null")
    step = have.withColumn("q", F.coalesce(F.col("qps") <= F.lag("qps").over(w), F.lit(True))).withColumn("c", F.coalesce(F.col("cost") >= F.lag("cost").over(w), F.lit(True)))
    return step.groupBy("dataset", "method").agg(F.bool_and("q").alias("qps_ok"), F.bool_and("c").alias("cost_ok"))


def delta_vs_first(rows: DataFrame, value: str, group: str, order: str) -> DataFrame:
    """Adds delta: the difference to the group's first row."""
    return rows.withColumn("delta", F.col(value) - F.first(value).over(Window.partitionBy(group).orderBy(order)))
