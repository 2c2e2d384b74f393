import numpy as np
import pytest

from lodestone.operators import vectors
from lodestone.plans import cli
from lodestone.plans import experiments as ex
from lodestone.sources import config, csr


def small(spark):
    return spark.createDataFrame([(v, (v * 3 + j * 5) % 20, 1 + (v + j) % 4) for v in range(25) for j in range(4)], "vec_id long, dim long, val long")


def test_csr_round_trip_with_empty_rows(spark, tmp_path):
    base = small(spark).where("vec_id <> 3")
    csr.write_csr(base, str(tmp_path / "x.csr"))
    packed = csr.read_csr(spark, str(tmp_path / "x.csr"))
    assert packed.count() == 25 and packed.where("vec_id = 3 and size(ind) = 0").count() == 1
    got = csr.long_form(packed).selectExpr("vec_id", "dim", "cast(val as long) as val")
    assert got.exceptAll(base).count() == 0 and base.exceptAll(got).count() == 0


def test_csr_with_a_header_that_lies_is_refused(tmp_path):
    np.array([5, 5, 99], np.uint64).tofile(tmp_path / "bad.csr")
    with pytest.raises(Exception):
        csr._offsets(str(tmp_path / "bad.csr"))


def test_truth_round_trip(spark, tmp_path):
    base = small(spark)
    truth = vectors.exact_topk(base.withColumnRenamed("vec_id", "qid"), base, 3).select("qid", "rank", "vec_id", "ip")
    csr.write_truth(truth, str(tmp_path / "t.ben"), 3)
    back = csr.read_truth(spark, str(tmp_path / "t.ben")).selectExpr("qid", "rank", "vec_id", "cast(ip as long) as ip")
    assert back.exceptAll(truth.selectExpr("qid", "rank", "vec_id", "ip")).count() == 0 and back.count() == truth.count()


def test_configuration_from_json_and_from_lines():
    a = config.parse('{"seed": 7, "topk": 3, "datasets": [{"name": "x", "base_path": "b"}], "methods": {"linear": true, "baseline": false}}')
    assert (a.random_seed, a.topk, a.datasets[0].name, a.methods) == (7, 3, "x", ["linear"])
    b = config.parse("# a comment\nseed = 9\nnprobes = 1,2\ntau = 0.7\n")
    assert (b.random_seed, b.nprobes, b.tau) == (9, [1, 2], 0.7)
    assert config.parse(config.dump(a)) == a
    with pytest.raises(ValueError):
        config.parse("speed = 3")


def test_comparison_over_a_configuration(spark, tmp_path):
    base = small(spark)
    base.write.parquet(str(tmp_path / "base"))
    base.where("vec_id < 5").write.parquet(str(tmp_path / "q"))
    conf = config.Config(output_dir=str(tmp_path / "out"), topk=3, k_clusters=2, nprobes=[1, 2], budgets=[5], datasets=[config.Dataset("d", str(tmp_path / "base"), str(tmp_path / "q"))])
    got = ex.run_config(spark, conf)
    assert {r["method"] for r in got.collect()} == {"linear", "baseline", "clustered"}
    assert got.where("method = 'linear' and recall = 1.0").count() == 1
    assert next((tmp_path / "out" / "report").glob("part-*")).read_text().startswith("# Equal recall")
    assert config.read_csv(spark, str(tmp_path / "out" / "curves")).count() == got.count()


def test_a_named_ground_truth_is_the_one_used(spark, tmp_path):
    base = small(spark)
    base.write.parquet(str(tmp_path / "base"))
    base.where("vec_id < 5").write.parquet(str(tmp_path / "q"))
    wrong = spark.createDataFrame([(q, 1, 24, 1.0) for q in range(5)], "qid long, rank int, vec_id long, ip double")
    csr.write_truth(wrong, str(tmp_path / "t.ben"), 1)
    conf = config.Config(output_dir=str(tmp_path / "out"), topk=1)
    data = ex.dataset(spark, conf, config.Dataset("d", str(tmp_path / "base"), str(tmp_path / "q"), str(tmp_path / "t.ben")))
    assert {r["vec_id"] for r in data.truth.collect()} == {24}


def test_full_run_goes_on_where_it_broke_off_and_grids_are_selected_from(spark, tmp_path, monkeypatch):
    base = small(spark)
    base.write.parquet(str(tmp_path / "base"))
    base.where("vec_id < 5").write.parquet(str(tmp_path / "q"))
    conf = config.Config(output_dir=str(tmp_path / "out"), topk=3, nprobes=[2], k_clusters=2, methods=["linear", "inverted"], budgets=[5], datasets=[config.Dataset("d", str(tmp_path / "base"), str(tmp_path / "q"))])
    calls = []
    for name in ("proxy_validity", "build_breakdown", "space_gain", "compare"):
        monkeypatch.setattr(ex, name, lambda *a, n=name, **k: calls.append(n) or spark.createDataFrame([(n,)], "what string"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(ex, "space_gain", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        ex.full_run(spark, conf, (2,), (80,))
    before = len(calls)
    got = ex.full_run(spark, conf, (2,), (80,))
    assert calls[before:] == ["space_gain"]
    assert got["d/grid"].count() == 1 and got["d/working_points"].count() == 2 and got["d/satisfied"].count() > 0
    assert ex.summary(got["d/grid"], ["recall", "nothing", "nprobe"]).columns == ["recall", "nprobe"]


def test_inverted_method_has_a_benchmark(spark):
    base = small(spark)
    data = ex.prepare("d", base, base.where("vec_id < 5").withColumnRenamed("vec_id", "qid"), 3)
    row = ex.compare(data, ["inverted"], [1], [50]).first()
    assert row["method"] == "inverted" and row["recall"] > 0.5 and row["cost"] > 0


def test_command_line_writes_all_results(spark, tmp_path, capsys):
    small(spark).write.parquet(str(tmp_path / "base"))
    args = ["search", str(tmp_path / "base"), str(tmp_path / "base"), "--k", "2", "--clusters", "2", "--nprobe", "2"]
    cli.main([*args, "--out", str(tmp_path / "found")], spark)
    cli.main(args, spark)
    assert len(capsys.readouterr().out.splitlines()) == spark.read.parquet(str(tmp_path / "found")).count() > 25


def test_command_line_writes_a_truth_file(spark, tmp_path):
    small(spark).write.parquet(str(tmp_path / "base"))
    cli.main(["truth", str(tmp_path / "base"), str(tmp_path / "base"), str(tmp_path / "t.ben"), "--k", "2"], spark)
    assert csr.read_truth(spark, str(tmp_path / "t.ben")).count() == 50


def test_stream_of_queries(spark, tmp_path):
    from lodestone.streaming.search import exact_stream

    base = small(spark)
    base.where("vec_id < 4").withColumnRenamed("vec_id", "qid").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, dim long, val long").parquet(str(tmp_path / "in"))
    exact_stream(stream, base, 2, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    want = vectors.exact_topk(base.where("vec_id < 4").withColumnRenamed("vec_id", "qid"), base, 2).select("qid", "rank", "vec_id", "ip")
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "rank", "vec_id", "ip")
    assert got.exceptAll(want).count() == 0 and got.count() == 8
