"""python -m lodestone.plans.cli COMMAND: truth, build, search, compare, full, sweep, grid, ablation, proxy, space, audit, breakdown, summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestone.operators import search
from lodestone.operators.storage import durable
from lodestone.plans import experiments as ex
from lodestone.sources import config as cfg
from lodestone.sources import csr


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, data: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        if data:
            c.add_argument("base")
            c.add_argument("queries")
            c.add_argument("--k", type=int, default=50)
            c.add_argument("--limit", type=int, default=-1, help="sample this many queries")
            c.add_argument("--clusters", type=int, default=15)
            c.add_argument("--tau", type=int, default=80, help="spill threshold in percent")
            c.add_argument("--m0", type=int, default=170)
            c.add_argument("--eta", type=float, default=0.03)
            c.add_argument("--nprobe", type=int, nargs="+", default=[5])
            c.add_argument("--seed", type=int, default=2026)
        return c

    command("truth", "exact answers to a binary truth file").add_argument("out")
    command("build", "build and save an index").add_argument("out")
    c = command("search", "answer queries from an index")
    c.add_argument("--index", default=None)
    c.add_argument("--out", default=None, help="Parquet folder, or a CSV one if it ends in .csv; without it every row is printed")
    c = command("compare", "all methods over the datasets of a configuration", data=False)
    c.add_argument("config")
    c = command("full", "every experiment of a configuration, going on where a former run broke off", data=False)
    c.add_argument("config")
    c = command("summary", "some columns of a CSV table", data=False)
    c.add_argument("table")
    c.add_argument("columns", nargs="+")
    c = command("sweep", "recall and speed along a parameter")
    c.add_argument("parameter", choices=["nprobe", "eta", "k", "k_clusters", "tau_percent", "m0", "dim_limit", "idf_range", "c"])
    c.add_argument("values", nargs="+", help="numbers, or low:high for idf_range")
    c = command("grid", "numbers of clusters or spill thresholds, each with every nprobe")
    c.add_argument("out")
    c.add_argument("--ks", type=int, nargs="+", default=None)
    c.add_argument("--taus", type=int, nargs="+", default=None)
    command("ablation", "add the method's parts one at a time").add_argument("--ub", type=int, default=2000)
    command("proxy", "how well collisions stand in for products")
    command("space", "index bytes by number of clusters").add_argument("--ks", type=int, nargs="+", default=[5, 15, 32])
    command("audit", "look at sampled queries").add_argument("--target", type=float, default=0.9)
    command("breakdown", "seconds of each build phase")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if a.command == "compare":
        with open(a.config) as f:
            print(cfg.markdown(ex.run_config(spark, cfg.parse(f.read()))))
        return
    if a.command == "full":
        with open(a.config) as f:
            for name, table in ex.full_run(spark, cfg.parse(f.read())).items():
                print(f"# {name}", cfg.markdown(table), sep="\n")
        return
    if a.command == "summary":
        print(cfg.markdown(ex.summary(cfg.read_csv(spark, a.table), a.columns)))
        return
    base, queries = ex.read_vectors(spark, a.base), ex.read_vectors(spark, a.queries).withColumnRenamed("vec_id", "qid")
    fixed = {"k_clusters": a.clusters, "tau_percent": a.tau, "m0": a.m0, "eta": a.eta, "seed": a.seed}
    if a.command == "build":
        search.build(base, k=a.k, **fixed).save(a.out)
        return
    if a.command == "breakdown":
        print(cfg.markdown(ex.build_breakdown(base, **fixed)))
        return
    if a.command == "space":
        print(cfg.markdown(ex.space_gain(base, a.ks, **{x: v for x, v in fixed.items() if x != "k_clusters"})))
        return
    data = ex.prepare("data", base, queries, a.k, query_limit=a.limit)
    if a.command == "truth":
        csr.write_truth(data.truth, a.out, a.k)
    elif a.command == "search":
        index = search.Index.load(data.vectors, a.index) if a.index else None
        found = search.clustered_search(index or search.build(data.vectors, k=a.k, **fixed), data.queries, a.k, a.nprobe[0])
        if a.out:
            cfg.write_results(found, a.out)
        else:
            for r in found.orderBy("qid", "rank").toLocalIterator():
                print(*r, sep="\t")
    elif a.command == "grid":
        points = durable(ex.grid(data, a.nprobe, a.ks, a.taus, **fixed))
        for name, table in {"grid": points, **ex.reselect(points)}.items():
            cfg.write_csv(table, f"{a.out}/{name}")
    elif a.command == "sweep":
        numbers = [] if a.parameter == "idf_range" else [float(v) for v in a.values]
        if a.parameter in ("nprobe", "eta", "k", "c"):
            index = search.build(data.vectors, k=a.k, **fixed)
            out = {
                "nprobe": lambda: ex.sweep_nprobe(data, index, [int(v) for v in numbers]), "eta": lambda: ex.sweep_eta(data, index, numbers, a.nprobe[0]),
                "k": lambda: ex.sweep_k(data, index, [int(v) for v in numbers], a.nprobe[0], a.eta), "c": lambda: ex.sweep_c(data, index, numbers, a.nprobe[0]),
            }[a.parameter]()
        elif a.parameter == "idf_range":
            out = ex.sweep_build(data, a.parameter, [tuple(map(float, v.split(":"))) for v in a.values], a.nprobe[0], **fixed)
        else:
            out = ex.sweep_build(data, a.parameter, [int(v) for v in numbers], a.nprobe[0], **fixed)
        print(cfg.markdown(out))
    elif a.command == "ablation":
        print(cfg.markdown(ex.ablation(data, a.nprobe[0], a.ub, **fixed)))
    else:
        index = search.build(data.vectors, k=a.k, **fixed)
        if a.command == "proxy":
            print(cfg.markdown(ex.proxy_validity(data, index, a.nprobe[0])))
        else:
            for x in ex.spot_audit(data, index, a.nprobe[0], a.target):
                print(cfg.markdown(x))


if __name__ == "__main__":
    main()
