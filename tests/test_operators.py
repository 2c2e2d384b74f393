"""Operators on small frames with edge cases."""

import math

import pytest

from lodestone.functions import hashing, parameters
from lodestone.operators import cluster, evaluate, idf, search, selection, sketch, storage, vectors

VEC = "vec_id long, dim long, val long"


def vecs(spark, rows):
    return spark.createDataFrame([(v, d, x) for v, coords in rows.items() for d, x in coords.items()], VEC)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_disjoint_vectors_have_no_product_unless_padded(spark):
    base = vecs(spark, {0: {1: 2}, 1: {2: 3}, 2: {1: 1}})
    queries = vecs(spark, {7: {1: 5}}).withColumnRenamed("vec_id", "qid")
    assert rows(vectors.sparse_dot(queries, base)) == [(7, 0, 10), (7, 2, 5)]
    assert rows(vectors.padded_topk(queries, base, 3), "rank", "vec_id", "ip") == [(1, 0, 10), (2, 2, 5), (3, 1, 0)]


def test_ties_go_to_the_smaller_id_and_k_may_exceed_n(spark):
    base = vecs(spark, {5: {1: 1}, 3: {1: 1}, 4: {1: 1}})
    queries = vecs(spark, {0: {1: 1}}).withColumnRenamed("vec_id", "qid")
    assert rows(vectors.exact_topk(queries, base, 2), "rank", "vec_id") == [(1, 3), (2, 4)]
    assert vectors.exact_topk(queries, base, 10).count() == 3


def test_values_that_are_not_positive_stay_in_products_and_out_of_sketches(spark):
    base = vecs(spark, {0: {1: -2, 2: 4}})
    queries = vecs(spark, {0: {1: 3, 2: 1}}).withColumnRenamed("vec_id", "qid")
    assert rows(vectors.sparse_dot(queries, base)) == [(0, 0, -2)]
    weights = idf.idf_weights(base, n=1)
    dims = {r["dim"]: (r["prefix_l"], r["l"]) for r in weights.collect()}
    got = {r["slot"] for r in sketch.sketch(base, weights).collect()}
    assert got and all(dims[2][0] <= s < dims[2][0] + dims[2][1] for s in got)


def test_empty_sketch_hashes_to_the_end_of_the_domain(spark):
    members = spark.createDataFrame([(1, 0, 4)], "vec_id long, cluster_id long, m_i int")
    none = spark.createDataFrame([], "vec_id long, slot long")
    for f in (sketch.minhash, sketch.minhash_arrow):
        assert {r["mh"] for r in f(none, members, 100).collect()} == {99}


def test_arrow_and_sql_signatures_agree_with_the_family(spark):
    slots = spark.createDataFrame([(v, s) for v in (1, 2) for s in range(v, 40 * v, 3)], "vec_id long, slot long")
    members = spark.createDataFrame([(v, c, 8) for v in (1, 2) for c in (0, 3)], "vec_id long, cluster_id long, m_i int")
    a, b = sketch.minhash(slots, members, 1000), sketch.minhash_arrow(slots, members, 1000)
    assert rows(a, "cluster_id", "vec_id", "h", "mh") == rows(b, "cluster_id", "vec_id", "h", "mh")
    x, y = hashing.family(8, 3)[5]
    want = min((x * s + y) % hashing.PRIME % 1000 for s in range(2, 80, 3))
    assert [r["mh"] for r in a.where("cluster_id = 3 and vec_id = 2 and h = 5").collect()] == [want]


def test_draws_follow_the_probability(spark):
    n = spark.range(20000).selectExpr(f"avg(cast({hashing.draw('id', 'id * 7 + 3', 17)} < 300000 as int)) as p").first()["p"]
    assert abs(n - 0.3) < 4 * math.sqrt(0.3 * 0.7 / 20000)


def test_collision_rate_estimates_jaccard(spark):
    slots = spark.createDataFrame([(1, s) for s in range(0, 300)] + [(2, s) for s in range(100, 400)], "vec_id long, slot long")
    members = spark.createDataFrame([(v, 0, 300) for v in (1, 2)], "vec_id long, cluster_id long, m_i int")
    sig = sketch.minhash_arrow(slots, members, 1_000_003)
    same = sig.alias("a").join(sig.alias("b"), ["h", "mh"]).where("a.vec_id = 1 and b.vec_id = 2").count()
    assert abs(same / 300 - 0.5) < 4 * math.sqrt(0.25 / 300)


def test_prefix_is_the_same_with_one_level(spark):
    base = vecs(spark, {v: {d: 1 for d in range(0, 10000, 37 + v)} for v in range(3)})
    got = rows(idf.idf_weights(base), "dim", "l", "prefix_l")
    total = 0
    for _, length, prefix in got:
        assert prefix == total
        total += length
    assert idf.domain_of(idf.idf_weights(base)) == total + 1


def test_clusters_cover_all_vectors_and_spill_elsewhere(spark):
    base = vecs(spark, {v: {v % 3: 10, 5 + v % 2: 3} for v in range(30)} | {99: {77: 1}})
    got = cluster.kmeans(base, 3, 5, seed=1)
    assert got.assign.count() == 31
    spilled = cluster.spill(base, got, 10)
    assert spilled.join(got.assign, ["vec_id", "cluster_id"]).count() == 0
    assert cluster.spill(base, cluster.kmeans(base, 1, 2), 80).count() == 0
    with pytest.raises(ValueError):
        cluster.kmeans(base, 32)


def test_a_cluster_without_members_keeps_its_centroid(spark):
    base = vecs(spark, {0: {1: 5}, 1: {1: 5}})
    old = spark.createDataFrame([(0, 1, 1000000), (1, 2, 1000000)], "cluster_id long, dim long, w long")
    new = cluster.update(base, cluster.assign(base, old), old)
    assert rows(new, "cluster_id", "dim", "w") == [(0, 1, 1000000), (1, 2, 1000000)]


@pytest.fixture(scope="module")
def small(spark):
    base = vecs(spark, {v: {(v * 7 + j * j) % 40: 1 + (v * j) % 9 for j in range(8)} for v in range(60)})
    index = search.build(base, 4, 60, m0=30, eta=2.0, k=5, idf_range=(0.5, 3.0), max_iter=3)
    return base, base.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "qid"), index


def test_clustered_results_are_exact_products_without_duplicates(small):
    base, queries, index = small
    exact = {(r["qid"], r["vec_id"]): r["ip"] for r in vectors.sparse_dot(queries, base).collect()}
    got = search.clustered_search(index, queries, 5, 4).collect()
    assert got and all(exact[r["qid"], r["vec_id"]] == r["ip"] for r in got)
    assert len({(r["qid"], r["vec_id"]) for r in got}) == len(got)


def test_recall_does_not_fall_with_nprobe_when_budgets_do_not_bind(small):
    base, queries, index = small
    truth = vectors.exact_topk(queries, base, 5)
    recalls = [evaluate.recall_at_k(search.clustered_search(index, queries, 5, p), truth, 5).agg({"recall": "avg"}).first()[0] for p in (1, 2, 4)]
    assert recalls == sorted(recalls) and recalls[-1] > 0.5


def test_index_is_loaded_only_for_its_own_vectors(spark, small, tmp_path):
    base, queries, index = small
    index.save(str(tmp_path / "index"))
    again = search.Index.load(base, str(tmp_path / "index"))
    assert rows(search.clustered_search(again, queries, 5, 2)) == rows(search.clustered_search(index, queries, 5, 2))
    assert search.Index.load(base.where("vec_id < 50"), str(tmp_path / "index")) is None
    assert storage.load_manifest(spark, str(tmp_path / "nothing")) is None


def test_evaluation_counts_distinct_ids_unless_told_otherwise(spark):
    truth = spark.createDataFrame([(0, 1, 10, 9), (0, 2, 11, 8), (1, 1, 12, 5)], "qid long, rank int, vec_id long, ip long")
    found = spark.createDataFrame([(0, 1, 10, 9), (0, 2, 10, 9)], "qid long, rank int, vec_id long, ip long")
    assert rows(evaluate.recall_at_k(found, truth, 2)) == [(0, 1, 0.5), (1, 0, 0.0)]
    assert rows(evaluate.recall_at_k(found, truth, 2, distinct=False)) == [(0, 2, 1.0), (1, 0, 0.0)]
    assert rows(evaluate.score_ratio(found, truth)) == [(0, 1.0), (1, 0.0)]


def test_spearman_of_constant_or_single_rows_is_zero(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (1, 5, 5), (2, 1, 3), (2, 2, 2), (2, 3, 1)], "qid long, a long, b long")
    assert rows(evaluate.spearman(df, "a", "b"), "qid", "spearman") == [(0, 0.0), (1, 0.0), (2, -1.0)]


def test_selectors_on_a_method_that_never_reaches_a_target(spark):
    curve = spark.createDataFrame([("d", "a", "c", 1.0, 0.8, 10.0, 5.0), ("d", "a", "c", 2.0, 0.95, 5.0, 9.0), ("d", "b", "c", 1.0, 0.5, 90.0, 1.0)], "dataset string, method string, config string, knob double, recall double, qps double, cost double")
    best = selection.select_max_qps(curve, (0.9,))
    assert rows(best, "method", "status") == [("a", "ok"), ("b", "N/A")]
    assert rows(selection.paper_table(best, (0.9,)), "method", "t90") == [("a", "5 (9)"), ("b", "N/A")]
    assert rows(selection.select_nearest(curve, (0.9,)), "method", "recall") == [("a", 0.95), ("b", 0.5)]
    assert rows(selection.select_reaching(curve, (0.9,)), "method") == [("a",)]


def test_spearman_of_many_rows_does_not_overflow(spark):
    from pyspark.sql import functions as F

    rows_ = spark.range(120_000).select(F.lit(0).alias("qid"), F.col("id").alias("a"), (F.col("id") * 7 % 120_011).alias("b"))
    assert -1 < evaluate.spearman(rows_, "a", "b").first()["spearman"] < 1


def test_default_working_point_near_the_band_is_the_faster_of_equals(spark):
    grid = spark.createDataFrame([("d", "m", "x", 1.0, 0.9, 10.0, 1.0), ("d", "m", "y", 1.0, 0.9, 20.0, 9.0)], "dataset string, method string, config string, knob double, recall double, qps double, cost double")
    assert [r["config"] for r in selection.pick_working_points(grid).where("role = 'default'").collect()] == ["y"]


def test_exact_search_beyond_the_broadcast_bound_agrees(small):
    base, queries, _ = small
    assert rows(vectors.gathered_dot(queries, base, 0)) == rows(vectors.gathered_dot(queries, base))


def test_exact_search_ranks_pairs_where_they_are_made(small):
    base, queries, _ = small
    plan = vectors.exact_topk(queries, base, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # vectors by id, and the best rows by query


def test_a_settled_index_answers_alike_and_stays_in_place(small):
    base, queries, index = small
    settled = index.settled()
    assert rows(search.clustered_search(settled, queries, 5, 3)) == rows(search.clustered_search(index, queries, 5, 3))


def test_parameters():
    assert [parameters.default_m0(c) for c in (0.9, 0.8, 0.6, 0.2)] == [200, 170, 150, 120]
    assert parameters.smooth_m0(0.75) == 200 and parameters.smooth_m0(0.1) == 150
    assert abs(parameters.gaussian_cdf(0) - 0.5) < 1e-6 and abs(parameters.gaussian_cdf(1.96) - 0.975) < 1e-4
    assert parameters.size_dependent_eta(10) == 0.15
    k, tables = parameters.lsh_tables(10000, 0.5, 4.0)
    assert k >= 1 and tables >= 1
