"""Pairs by blocks against plain loops, and that pairs are never shuffled."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import vecs

from lodestone.operators import blocks, idf, search, sketch, vectors


def some(n, most, seed, low=1):
    r = random.Random(seed)
    return {v: {d: r.choice([r.randint(low, most), r.randint(1, 9)]) for d in r.sample(range(9), r.randint(1, 6))} for v in range(n)}


def dots(a, b):
    return sorted((q, v, sum(x[d] * y[d] for d in x if d in y)) for q, x in a.items() for v, y in b.items() if set(x) & set(y))


def top_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")[:1]


@pytest.mark.parametrize(("most", "low", "kind", "dense"), [(900, 1, "bigint", 1 / 64), (900, -900, "bigint", 2), (4 * 10**9, -(4 * 10**9), "decimal(38,0)", 1 / 64), (4 * 10**9, -(4 * 10**9), "decimal(38,0)", 2)])
def test_f4_products_are_exact_in_and_beyond_64_bits(spark, monkeypatch, most, low, kind, dense):
    """The sum over shared dims left 64 bits on 51,282 embeddings, which failed the query."""
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(blocks, "BASE_BLOCK", 7)
    base, queries = some(40, most, 1, low), some(9, most, 2, low)
    got = vectors.block_products(vecs(spark, queries).withColumnRenamed("vec_id", "qid"), vecs(spark, base), "val", "p")
    assert dict(got.dtypes)["p"] == kind
    assert sorted((r["qid"], r["vec_id"], int(r["p"])) for r in got.collect()) == dots(queries, base)
    assert "MapInArrow" in "".join(top_of(got))


@pytest.mark.parametrize("sent", [1 << 30, -1])
def test_f1_f2_f6_candidates_are_cut_in_place_as_plain_loops_cut_them(spark, monkeypatch, sent):
    monkeypatch.setattr(blocks, "BASE_BLOCK", 11)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", sent)
    base, queries = some(700, 50, 3), some(5, 50, 4)
    q = vecs(spark, queries).withColumnRenamed("vec_id", "qid")
    index = search.build_baseline(vecs(spark, base), 4, 6)
    scores = search.inverted_scores(index, q)
    assert "MapInArrow" in "".join(top_of(scores))
    ip = {(a, b): p for a, b, p in dots(queries, base)}
    common = {}
    for r in scores.collect():
        common.setdefault(r["qid"], []).append((-r["n_common"], r["vec_id"]))
    cc = {}
    for r in search._baseline_counts(index, q)[0].collect():
        cc.setdefault(r["qid"], []).append((-r["cc"], r["vec_id"]))
    for scored, got in ((common, search.inverted_overlap_search(index, q, 3, 20)), (cc, search.baseline_search(index, q, 3, 20, by="cc"))):
        want = {(i, k + 1, v, -p) for i, s in scored.items() for k, (p, v) in enumerate(sorted((-ip[i, v], v) for _, v in sorted(s)[:23] if (i, v) in ip)[:3])}
        assert {(r["qid"], r["rank"], r["vec_id"], r["ip"]) for r in got.collect()} == want


def test_f10_clusters_tell_their_best_where_candidates_are(spark):
    base = some(300, 50, 5)
    v = vecs(spark, base)
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    index = search.build(v, k_clusters=3, tau_percent=80, m0=24, eta=0.05, k=3, max_iter=2, tol=0.0)
    ip = {(a, b): p for a, b, p in dots({i: base[i] for i in range(0, 300, 20)}, base)}
    ranked = search.candidates(index, q, 2).collect()
    by_query = {}
    for r in ranked:
        by_query.setdefault(r["qid"], set()).add(r["vec_id"])
    want = {(i, k + 1, x, -p) for i, s in by_query.items() for k, (p, x) in enumerate(sorted((-ip[i, x], x) for x in s if (i, x) in ip)[:3])}
    assert {(r["qid"], r["rank"], r["vec_id"], r["ip"]) for r in search.clustered_search(index, q, 3, 2).collect()} == want
    counts = {r["qid"]: r["n_verified"] for r in search.verified_counts(index, q, 2).collect()}
    assert counts == {i: sum(r["qid"] == i for r in ranked) for i in by_query}
    found = search.matches(index, q, 2, "best", 3)
    assert "MapInArrow" in "".join(top_of(found))


def test_truth_is_multiplied_by_blocks_and_never_shuffled(spark, monkeypatch):
    """F5 and all that read emb_truth: a hash table of all pairs did not end on 102,564 embeddings."""
    monkeypatch.setattr(blocks, "BASE_BLOCK", 11)
    base, queries = some(300, 50, 6, -50), some(7, 50, 7, -50)
    got = vectors.block_topk(vecs(spark, queries).withColumnRenamed("vec_id", "qid"), vecs(spark, base), 4)
    assert "MapInArrow" in "".join(str(x) for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n")[:2])
    want, ip = set(), dots(queries, base)
    for i in queries:
        want |= {(i, k + 1, v, -p) for k, (p, v) in enumerate(sorted((-p, v) for q, v, p in ip if q == i)[:4])}
    assert {(r["qid"], r["rank"], r["vec_id"], r["ip"]) for r in got.collect()} == want


def test_sets_drawn_and_hashed_by_numpy_are_those_of_the_sql(spark, monkeypatch):
    """F11 and all that read emb_index: a row per slot, and a hash of every slot of every cluster, took the index's time."""
    v = vecs(spark, some(60, 50, 8))
    weights = idf.idf_weights(v, 20, 0.5, 3.0).localCheckpoint()
    members = v.select("vec_id").distinct().selectExpr("vec_id", "explode(array(0L, 1L, 2L)) cluster_id").selectExpr("*", "cast(5 + cluster_id as int) m_i").where("vec_id % 3 <> cluster_id")
    rows = sketch.sketch(v, weights)
    sets = sketch.sketch_sets(v, weights)
    assert sorted(sets.select("vec_id", F.explode("slots")).collect()) == sorted(rows.collect())
    layout = idf.fixed_layout(v, 4)
    assert sorted(sketch.global_sets(v, layout).select("vec_id", F.explode("slots")).collect()) == sorted(sketch.global_sketch(v, layout).collect())
    want = sorted(map(tuple, sketch.minhash(rows, members, idf.domain_of(weights)).collect()))
    for few in (1 << 22, 0):
        monkeypatch.setattr(sketch, "TABLE", few)
        assert sorted(map(tuple, sketch.unpacked(sketch.minhash_sets(sets, members, idf.domain_of(weights))).collect())) == want


@pytest.mark.parametrize(("kept", "sent"), [(1 << 15, 1 << 30), (0, -1)])
def test_proxies_and_counts_come_from_one_task_a_query(spark, monkeypatch, kept, sent):
    """a row per candidate and cluster was shuffled, and vectors were sent once for each of their clusters."""
    monkeypatch.setattr(blocks, "BASE_BLOCK", 11)
    monkeypatch.setattr(blocks, "SCORES", kept)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", sent)
    v = vecs(spark, some(200, 50, 9))
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    index = search.build(v, k_clusters=3, tau_percent=60, m0=24, eta=0.2, k=3, max_iter=2, tol=0.0)
    assert index.blocks()[0].selectExpr("sum(size(rows))").first()[0] == 200
    of = {}
    ranked = search.candidates(index, q, 2).collect()
    for r in ranked:
        key = -r["cc"], -r["score"], r["cluster_id"]
        of.setdefault(r["qid"], {})[r["vec_id"]] = min(of.get(r["qid"], {}).get(r["vec_id"], key), key)
    want = {(i, x, -a, -b, c, n + 1) for i, s in of.items() for n, (a, b, x, c) in enumerate(sorted((a, b, x, c) for x, (a, b, c) in s.items())[:9])}
    assert {tuple(r) for r in search.proxy_candidates(index, q, 2, 9).collect()} == want
    found = search.matches(index, q, 2, "best", 3).localCheckpoint()
    counts = {r["qid"]: r["n_verified"] for r in search.counts_of(found).collect()}
    assert counts == {i: sum(r["qid"] == i for r in ranked) for i in of}
    assert sorted(map(tuple, search.best_of(found, 3).collect())) == sorted(map(tuple, search.clustered_search(index, q, 3, 2).collect()))
