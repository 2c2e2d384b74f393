"""Experiments: benchmarks of a configuration, sweeps, ablation, comparisons, audits and reports.

A sweep builds an index once for what sketches and signatures depend on (clusters, spill, m0, IDF range); eta, k and nprobe
only enter at query time.
"""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parameters
from lodestone.operators import cluster, evaluate, search, selection, space, vectors
from lodestone.operators.storage import durable, fingerprint, get_or_build
from lodestone.sources import config as cfg
from lodestone.sources import csr

CURVE = "dataset string, method string, config string, knob double, recall double, qps double, cost double"


@dataclass
class Dataset:
    """Vectors, queries and their exact answers, each computed once."""

    name: str
    vectors: DataFrame
    queries: DataFrame
    truth: DataFrame
    k: int


def prepare(name: str, base: DataFrame, queries: DataFrame, k: int, truth_dir: str | None = None, query_limit: int | None = None, truth: DataFrame | None = None) -> Dataset:
    """Exact answers are those given, or come from truth_dir if they were made from these very vectors, queries and k, else are made and kept there."""
    base, queries = durable(base), durable(queries if query_limit is None or query_limit < 0 else queries.join(F.broadcast(search.query_sample(queries, query_limit)), "qid"))
    if truth is not None:
        known = truth.where(F.col("rank") <= k).join(queries.select("qid").distinct(), "qid", "left_semi")
        return Dataset(name, base, queries, durable(known.select("qid", "rank", "vec_id", "ip")), k)
    exact = vectors.exact_topk(queries, base, k).select("qid", "rank", "vec_id", "ip")
    if truth_dir is None:
        return Dataset(name, base, queries, durable(exact), k)
    manifest = {"base": fingerprint(base), "queries": fingerprint(queries.withColumnRenamed("qid", "vec_id")), "k": k}
    spark = base.sparkSession
    return Dataset(name, base, queries, get_or_build(spark, truth_dir, manifest, lambda: {"truth": exact})["truth"], k)


def timed(results: DataFrame) -> tuple[DataFrame, float]:
    """A result and the seconds that computing it took."""
    began = time.perf_counter()
    out = durable(results)
    return out, time.perf_counter() - began


def clustered_benchmark(data: Dataset, index: search.Index, nprobe: int, k: int | None = None) -> dict:
    """Recall, ratio, cost and queries a second of one configuration."""
    k = k or data.k
    results, seconds = timed(search.clustered_search(index, data.queries, k, nprobe))
    costs = search.verified_counts(index, data.queries, nprobe)
    per = evaluate.recall_at_k(results, data.truth.where(F.col("rank") <= k), k).join(evaluate.score_ratio(results, data.truth.where(F.col("rank") <= k)), "qid").join(costs, "qid", "left")
    row = evaluate.benchmark_averages(per.withColumn("n_verified", F.coalesce("n_verified", F.lit(0)))).first()
    return {"recall": row["recall"], "ratio": row["ratio"], "cost": row["avg_verified"], "qps": row["n_queries"] / seconds, "seconds": seconds}


def _sketch_benchmark(data: Dataset, results: DataFrame, candidates: DataFrame) -> dict:
    results, seconds = timed(results)
    counts = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("n_verified"))
    row = evaluate.baseline_averages(results, data.truth, counts, data.k).first()
    return {"recall": row["recall"], "ratio": row["ratio"], "kth_ratio": row["kth_ratio"], "cost": row["avg_verified"], "qps": row["n_queries"] / seconds, "seconds": seconds}


def baseline_benchmark(data: Dataset, index: search.Baseline, ub: int) -> dict:
    """Recall, ratios by rank, cost and queries a second of the global sketch."""
    return _sketch_benchmark(data, search.baseline_search(index, data.queries, data.k, ub), search.baseline_candidates(index, data.queries, data.k, ub))


def inverted_benchmark(data: Dataset, index: search.Baseline, ub: int) -> dict:
    """The same by exact set overlaps."""
    return _sketch_benchmark(data, search.inverted_overlap_search(index, data.queries, data.k, ub), search.inverted_candidates(index, data.queries, data.k, ub))


def linear_benchmark(data: Dataset) -> dict:
    """The exact scan, whose recall is measured like any other's."""
    results, seconds = timed(vectors.exact_topk(data.queries, data.vectors, data.k).select("qid", "rank", "vec_id", "ip"))
    row = evaluate.recall_at_k(results, data.truth, data.k).agg(F.avg("recall"), F.count(F.lit(1))).first()
    n = data.vectors.select("vec_id").distinct().count()
    return {"recall": row[0], "cost": float(n), "qps": row[1] / seconds, "seconds": seconds}


def with_eta(index: search.Index, eta: float, k: int) -> search.Index:
    """The same index under other budgets, which only queries read."""
    t = F.greatest(F.lit(5 * k), F.ceil(F.round(F.lit(eta) * F.col("n_i") + k, 9))).cast("int")
    return dataclasses.replace(index, params=index.params.withColumn("t_budget", t))


def _curve(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CURVE)


def sweep_nprobe(data: Dataset, index: search.Index, nprobes: Iterable[int], config: str = "default") -> DataFrame:
    got = [(p, clustered_benchmark(data, index, p)) for p in nprobes]
    return _curve(data.vectors.sparkSession, [(data.name, "clustered", config, float(p), r["recall"], r["qps"], r["cost"]) for p, r in got])


def sweep_eta(data: Dataset, index: search.Index, etas: Iterable[float], nprobe: int) -> DataFrame:
    got = [(e, clustered_benchmark(data, with_eta(index, e, data.k), nprobe)) for e in etas]
    return _curve(data.vectors.sparkSession, [(data.name, "clustered", "eta", float(e), r["recall"], r["qps"], r["cost"]) for e, r in got])


def sweep_k(data: Dataset, index: search.Index, ks: Iterable[int], nprobe: int, eta: float) -> DataFrame:
    """Depths up to that of the truth."""
    got = [(k, clustered_benchmark(data, with_eta(index, eta, k), nprobe, k)) for k in ks if k <= data.k]
    return _curve(data.vectors.sparkSession, [(data.name, "clustered", "k", float(k), r["recall"], r["qps"], r["cost"]) for k, r in got])


def sweep_build(data: Dataset, name: str, values: Iterable, nprobe: int, **fixed) -> DataFrame:  # noqa: ANN003
    """A build parameter (k_clusters, tau_percent, m0, idf_range, dim_limit): an index for each value.

    Clusters are made once unless their number is what is swept.
    """
    shared = None if name == "k_clusters" else cluster.kmeans(data.vectors, fixed.get("k_clusters", 15), seed=fixed.get("seed", 2026))
    rows = []
    for v in values:
        index = search.build(data.vectors, **(fixed | {name: v}), k=data.k, clustering=shared)
        r = clustered_benchmark(data, index, nprobe)
        rows.append((data.name, "clustered", f"{name}={v}", float(v if isinstance(v, (int, float)) else len(rows)), r["recall"], r["qps"], r["cost"]))
    return _curve(data.vectors.sparkSession, rows)


def sweep_baseline(data: Dataset, index: search.Baseline, ubs: Iterable[int], method: str = "baseline") -> DataFrame:
    benchmark = {"baseline": baseline_benchmark, "inverted": inverted_benchmark}[method]
    got = [(u, benchmark(data, index, u)) for u in ubs]
    return _curve(data.vectors.sparkSession, [(data.name, method, "default", float(u), r["recall"], r["qps"], r["cost"]) for u, r in got])


def sweep_c(data: Dataset, index: search.Index, levels: Iterable[float], nprobe: int) -> DataFrame:
    """(c, satisfied): the share of ranks that reach a ratio of c."""
    return evaluate.satisfied_at_c(search.clustered_search(index, data.queries, data.k, nprobe), data.truth, data.k, tuple(levels))


GRID = "dataset string, seed long, k_clusters int, tau_percent int, nprobe int, recall double, qps double, avg_verified double, build_seconds double, index_bytes long"


def timed_call(make):  # noqa: ANN001, ANN201
    began = time.perf_counter()
    out = make()
    return out, time.perf_counter() - began


def grid(data: Dataset, nprobes: Iterable[int], ks: Iterable[int] | None = None, taus: Iterable[int] | None = None, **fixed) -> DataFrame:  # noqa: ANN003
    """Every number of clusters and spill threshold with every nprobe; an index for each of the former, clusters once a number."""
    rows, nprobes, seed = [], list(nprobes), fixed.get("seed", 2026)
    rest = {x: v for x, v in fixed.items() if x not in ("k_clusters", "tau_percent")}
    for k_clusters in ks or [fixed.get("k_clusters", 15)]:
        clusters, first = timed_call(lambda k=k_clusters: cluster.kmeans(data.vectors, k, fixed.get("max_iter", 25), seed=seed))
        for tau in taus or [fixed.get("tau_percent", 80)]:
            index, seconds = timed_call(lambda k=k_clusters, t=tau, c=clusters: search.build(data.vectors, k, t, k=data.k, clustering=c, **rest).settled())
            size = space.index_bytes(index.signatures, index.centroids).first()["total_bytes"]
            for p in nprobes:
                r = clustered_benchmark(data, index, min(p, k_clusters))
                rows.append((data.name, seed, k_clusters, tau, p, r["recall"], r["qps"], float(r["cost"]), first + seconds, int(size)))
    return data.vectors.sparkSession.createDataFrame(rows, GRID)


def reselect(points: DataFrame, target: float = 0.95) -> dict[str, DataFrame]:
    """The result tables of a grid: working points, every row's role, and the smallest nprobe of each configuration that reaches the target."""
    config = F.concat(F.lit("K="), "k_clusters", F.lit(" tau="), "tau_percent")
    curve = points.select("dataset", F.lit("clustered").alias("method"), config.alias("config"), F.col("nprobe").cast("double").alias("knob"), "recall", "qps", F.col("avg_verified").alias("cost"))
    return {"working_points": selection.pick_working_points(curve), "selection": selection.parameter_roles(curve), "smallest_nprobe": selection.select_min_nprobe(curve, target)}


def summary(table: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns that a table has of those asked for, in that order."""
    return table.select(*[c for c in columns if c in table.columns])


def ablation(data: Dataset, nprobe: int, ub: int, **fixed) -> DataFrame:  # noqa: ANN003
    """The baseline, then IDF, adaptive lengths, clusters and spill added one at a time."""
    spark, rows = data.vectors.sparkSession, []
    r = baseline_benchmark(data, search.build_baseline(data.vectors), ub)
    rows.append((data.name, "baseline", "0 baseline", 0.0, r["recall"], r["qps"], r["cost"]))
    many = fixed.pop("k_clusters", 15)
    steps = [("1 +IDF", 1, False, 0), ("2 +adaptive length", 1, True, 0), ("3 +clusters", many, True, 0), ("4 +spill", many, True, fixed.pop("tau_percent", 80))]
    for i, (label, clusters, adaptive, tau) in enumerate(steps):
        index = search.build(data.vectors, clusters, tau, adaptive_length=adaptive, k=data.k, **fixed)
        r = clustered_benchmark(data, index, min(nprobe, clusters))
        rows.append((data.name, "clustered", label, float(i + 1), r["recall"], r["qps"], r["cost"]))
    return _curve(spark, rows)


def scalability(name: str, base: DataFrame, queries: DataFrame, sizes: Iterable[int], k: int, nprobe: int, **fixed) -> DataFrame:  # noqa: ANN003
    """Recall against the truth of each subset of the first n vectors."""
    rows = []
    for n in sizes:
        data = prepare(name, vectors.row_limit(base, n), queries, k)
        r = clustered_benchmark(data, search.build(data.vectors, **fixed, k=k), nprobe)
        rows.append((name, "clustered", f"n={n}", float(n), r["recall"], r["qps"], r["cost"]))
    return _curve(base.sparkSession, rows)


def build_breakdown(base: DataFrame, **fixed) -> DataFrame:  # noqa: ANN003
    """(phase, seconds, share) of building an index: weights, clusters, spill, sketch, signatures, buckets."""
    from lodestone.operators import idf, sketch

    spans: list[tuple[str, float]] = []

    def phase(name: str, make):  # noqa: ANN001, ANN202
        began = time.perf_counter()
        out = make()
        spans.append((name, time.perf_counter() - began))
        return out

    k, tau, m0, eta, seed = fixed.get("k_clusters", 15), fixed.get("tau_percent", 80), fixed.get("m0", 170), fixed.get("eta", 0.03), fixed.get("seed", 2026)
    weights = phase("weights", lambda: durable(idf.idf_weights(base, 20, *fixed.get("idf_range", (0.5, 3.0)))))
    clusters = phase("clusters", lambda: cluster.kmeans(base, k, fixed.get("max_iter", 25), seed=seed))
    members = phase("spill", lambda: durable(cluster.memberships(clusters, cluster.spill(base, clusters, tau))))
    slots = phase("sketch", lambda: durable(sketch.sketch(base, weights)))
    params = parameters.adaptive_params(cluster.sizes(members), base.select("vec_id").distinct().count(), 50, m0, eta)
    signatures = phase("signatures", lambda: durable(sketch.minhash_arrow(slots, members.join(params.select("cluster_id", "m_i"), "cluster_id"), idf.domain_of(weights), seed)))
    phase("buckets", lambda: sketch.buckets(signatures).count())
    total = sum(s for _, s in spans)
    return base.sparkSession.createDataFrame([(n, s, s / total) for n, s in spans], "phase string, seconds double, share double")


def proxy_validity(data: Dataset, index: search.Index, nprobe: int, config: str = "clustered", cuts: tuple[int, ...] = (100, 200, 500, 1000)) -> DataFrame:
    """(config, qid, n, spearman, spearman_weighted, cut, covered, coverage, precision): how well collisions stand in for products."""
    found = durable(search.proxy_candidates(index, data.queries, nprobe))
    both = found.select("qid", "vec_id", "cc").join(vectors.sparse_dot(data.queries, data.vectors), ["qid", "vec_id"]).join(vectors.weighted_dot(data.queries, data.vectors, index.weights), ["qid", "vec_id"])
    rho = evaluate.spearman(both, "cc", "ip").join(evaluate.spearman(both, "cc", "wip").select("qid", F.col("spearman").alias("spearman_weighted")), "qid")
    return rho.join(evaluate.coverage_precision(found, data.truth, data.k, cuts), "qid").withColumn("config", F.lit(config))


def space_gain(base: DataFrame, ks: Iterable[int], **fixed) -> DataFrame:  # noqa: ANN003
    """Bytes of the global, the unspilled and the spilled index for each number of clusters."""
    out = None
    for k in ks:
        full = search.build(base, k, **fixed)
        primary = full.signatures.join(cluster.kmeans(base, k, fixed.get("max_iter", 25), seed=fixed.get("seed", 2026)).assign, ["vec_id", "cluster_id"], "left_semi")
        rows = space.space_decomposition({"global": (search.build(base, 1, 0, **{x: v for x, v in fixed.items() if x != "tau_percent"}).signatures, None), "no spill": (primary, full.centroids), "spill": (full.signatures, full.centroids)}).withColumn("k_clusters", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def compare(data: Dataset, methods: Iterable[str], nprobes: Iterable[int], ubs: Iterable[int], index_dir: str | None = None, **fixed) -> DataFrame:  # noqa: ANN003
    """The curves of the methods over one dataset."""
    spark = data.vectors.sparkSession
    curves = [_curve(spark, [])]
    for method in methods:
        if method == "linear":
            r = linear_benchmark(data)
            curves.append(_curve(spark, [(data.name, "linear", "default", 0.0, r["recall"], r["qps"], r["cost"])]))
        elif method == "baseline":
            curves.append(sweep_baseline(data, search.build_baseline(data.vectors), ubs))
        elif method == "inverted":
            curves.append(sweep_baseline(data, search.build_baseline(data.vectors), ubs, method))
        elif method == "clustered":
            index = search.Index.load(data.vectors, index_dir) if index_dir else None
            if index is None:
                index = search.build(data.vectors, k=data.k, **fixed)
                if index_dir:
                    index.save(index_dir)
            curves.append(sweep_nprobe(data, index, nprobes))
        else:
            raise ValueError(f"no method {method}")
    out = curves[0]
    for c in curves[1:]:
        out = out.unionByName(c)
    return out


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Parquet in long form (vec_id, dim, val), or a binary CSR file."""
    return csr.long_form(csr.read_csr(spark, path)) if path.endswith((".csr", ".bin")) else spark.read.parquet(path)


def dataset(spark: SparkSession, conf: cfg.Config, d: cfg.Dataset) -> Dataset:
    """A configuration's dataset, with the ground truth that it names or else one that is made and kept in output_dir."""
    truth = csr.read_truth(spark, d.groundtruth_path) if d.groundtruth_path else None
    return prepare(d.name, read_vectors(spark, d.base_path), read_vectors(spark, d.query_path).withColumnRenamed("vec_id", "qid"), conf.topk, f"{conf.output_dir}/truth_{d.name}", conf.query_subset_size, truth)


def settings(conf: cfg.Config, data: Dataset) -> dict:
    eta = conf.eta if conf.eta > 0 else parameters.size_dependent_eta(data.vectors.select("vec_id").distinct().count())
    return {"k_clusters": conf.k_clusters if conf.k_clusters > 0 else 15, "tau_percent": round(100 * conf.tau) if conf.tau >= 0 else 80, "eta": eta, "seed": conf.random_seed}


def run_config(spark: SparkSession, conf: cfg.Config, targets: tuple[float, ...] = (0.8, 0.9, 0.95, 0.98)) -> DataFrame:
    """The comparison over every dataset of a configuration; curves, equal-recall tables and a report go to output_dir."""
    every = None
    for d in conf.datasets:
        data = dataset(spark, conf, d)
        rows = compare(data, conf.methods, conf.nprobes, conf.budgets, f"{conf.output_dir}/index_{d.name}", **settings(conf, data))
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        raise ValueError("the configuration names no dataset")
    every = durable(every)
    cfg.write_csv(every, f"{conf.output_dir}/curves")
    best = selection.select_max_qps(every, targets)
    cfg.write_csv(selection.speedups(best, "baseline"), f"{conf.output_dir}/equal_recall")
    cfg.write_csv(selection.paper_table(best, targets), f"{conf.output_dir}/paper_table")
    cfg.write_text(spark, report(every, targets), f"{conf.output_dir}/report")
    return every


def full_run(spark: SparkSession, conf: cfg.Config, ks: tuple[int, ...] = (5, 15, 32), taus: tuple[int, ...] = (70, 80, 90), target: float = 0.95) -> dict[str, DataFrame]:
    """Every experiment over every dataset, each table kept under output_dir; a run that broke off goes on at the first table that is missing."""
    out: dict[str, DataFrame] = {}
    for d in conf.datasets:
        data = dataset(spark, conf, d)
        out |= {f"{d.name}/{name}": table for name, table in _experiments(spark, conf, data, ks, taus, target).items()}
    return out


def _experiments(spark: SparkSession, conf: cfg.Config, data: Dataset, ks: tuple[int, ...], taus: tuple[int, ...], target: float) -> dict[str, DataFrame]:
    fixed, most, made = settings(conf, data), max(conf.nprobes), []

    def index() -> search.Index:
        if not made:
            made.append(search.build(data.vectors, k=data.k, **fixed).settled())
        return made[0]

    steps = {
        "grid": lambda: grid(data, conf.nprobes, ks, **fixed),
        "tau_grid": lambda: grid(data, conf.nprobes, None, taus, **fixed),
        "curves": lambda: compare(data, conf.methods, conf.nprobes, conf.budgets, **fixed),
        "satisfied": lambda: sweep_c(data, index(), (0.8, 0.85, 0.9, 0.95), most),
        "proxy": lambda: proxy_validity(data, index(), most),
        "breakdown": lambda: build_breakdown(data.vectors, **fixed),
        "space": lambda: space_gain(data.vectors, ks, **{x: v for x, v in fixed.items() if x not in ("k_clusters", "eta")}),
    }
    manifest = {"data": fingerprint(data.vectors), "k": data.k, "fixed": fixed, "nprobes": conf.nprobes, "budgets": conf.budgets, "methods": conf.methods, "ks": ks, "taus": taus}
    base = f"{conf.output_dir}/{data.name}"
    out = {name: get_or_build(spark, f"{base}/{name}", manifest, lambda n=name, m=make: {n: m()})[name] for name, make in steps.items()}
    chosen = reselect(out["grid"], target)
    for name, table in chosen.items():
        cfg.write_csv(table, f"{base}/{name}")
    return out | chosen


def report(curves: DataFrame, targets: tuple[float, ...]) -> str:
    best = selection.select_max_qps(curves, targets)
    parts = ["# Equal recall", cfg.markdown(selection.paper_table(best, targets).orderBy("dataset", "method")), "# Order along targets", cfg.markdown(selection.monotonic(best).orderBy("dataset", "method")), "# Curves", cfg.markdown(curves.orderBy("dataset", "method", "knob"))]
    return "\n\n".join(parts) + "\n"


def spot_audit(data: Dataset, index: search.Index, nprobe: int, target: float, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """What n sampled queries return next to the truth, and the verdict on their recalls."""
    few = data.queries.join(F.broadcast(search.query_sample(data.queries, n)), "qid")
    truth = data.truth.join(few.select("qid").distinct(), "qid", "left_semi")
    results = durable(search.clustered_search(index, few, data.k, nprobe))
    rows = evaluate.spot_audit(results, truth, search.verified_counts(index, few, nprobe), data.k)
    return rows, evaluate.audit_status(evaluate.recall_at_k(results, truth, data.k), target)

