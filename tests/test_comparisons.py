"""Comparisons, benchmark jobs, scenarios, suites and report writers on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.functions import kernels
from quorate.operators import benchmark as bm
from quorate.operators import clustering as cl
from quorate.operators import comparisons as cp
from quorate.operators import contingency as ct
from quorate.operators import ensemble as en
from quorate.operators import generators as gn
from quorate.sources import sinks


def blobs(spark, n=60, k=3):
    return gn.gaussian(spark, n, k, 3, std=0.3, separation=8.0)


def test_normalised_keeps_whole_rows_only(spark):
    rows = spark.createDataFrame([("a", "", "m1", "", "1", "2", "3", "5"), ("b", "x", None, "ward", "", "2", "3", "5"), ("c", "x", None, "ward", "1", "2", "z", "5"), ("d", "x", None, None, "1", "2", "3", "2")], "dataset string, algorithm string, mode string, method string, nmi string, ari string, f string, runs string")
    assert [tuple(r) for r in cp.normalised(rows, "s", {"a": "g"}).collect()] == [("a", "g", "m1", "average", 1.0, 2.0, 3.0, "s")]
    assert cp.normalised(rows.limit(0), "s", {"a": "g"}).count() == 0


def test_wins_take_the_first_of_ties(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 0), ("a", "y", 1.0, 1), ("b", "y", 2.0, 2), ("b", "x", 1.0, 3), ("c", "x", 0.0, 4)], "dataset string, algorithm string, value double, row_no long")
    assert {tuple(r) for r in cp.win_counts(rows, ["dataset"], "algorithm").collect()} == {("x", 2), ("y", 1)}


def test_best_profile_breaks_ties_by_value_then_time(spark):
    rows = spark.createDataFrame([("a", "p", 0.5, 2.0, "validation"), ("a", "q", 0.5, 1.0, "validation"), ("a", "r", 0.9, 9.0, "test")], "dataset string, algorithm string, value double, runtime double, split string")
    assert cp.best_profile(rows, ["algorithm"]).first()["profile_id"] == "q"
    assert cp.best_profile(rows.drop("split"), ["algorithm"], "value").first()["profile_id"] == "r"


def test_labels_and_cautions(spark):
    row = spark.createDataFrame([("g", "default", "", 0), ("g", "qd", "ward", 8)], "algorithm string, variant string, linkage string, m int")
    assert [r[0] for r in row.select(cp.run_label()).collect()] == ["g", "g / qd / ward / m=8"]
    diag = spark.createDataFrame([("a", 0.6, None, 0.2, 0.0, 0.4), ("b", None, None, None, None, None)], "dataset string, dim double, constant double, missing double, outlier double, explained double")
    assert [r[1] for r in cp.cautions(diag).orderBy("dataset").collect()] == ["many features,missing values,flat projection", ""]


def test_projection_is_that_of_numpy(spark):
    x = np.random.default_rng(3).normal(size=(40, 4)) @ np.diag([5, 3, 1, 0.1])
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(4)], "obj_id long, feat int, value double")
    got = np.array([r[1:] for r in cp.projection(values).orderBy("obj_id").collect()])
    v = np.linalg.svd(x - x.mean(0))[2][:2].T
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ v))


def test_nearest_labels_and_its_bound(spark):
    objs = blobs(spark)
    points = objs.where("obj_id % 7 = 0")
    got = cp.nearest_labels(points, objs.where("obj_id % 7 <> 0"))
    assert got.join(points.select("obj_id", F.col("gt").alias("own")), "obj_id").where("gt <> own").count() == 0 and got.count() == points.count()
    with pytest.raises(ValueError):
        cp.nearest_labels(points, objs, max_points=2)


def test_json_rows_have_no_nan(spark):
    rows = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (float("inf"), "b")], "x double, y string")
    assert [json.loads(r[0]) for r in cp.json_rows(rows).collect()] == [{"x": 1.0, "y": "a"}, {"x": None, "y": None}, {"x": None, "y": "b"}]


def test_members_of_one_cluster_are_skipped(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "obj_id long, gt long")
    members = labels.selectExpr("obj_id", "0 AS part_id", "gt AS cluster_id").unionByName(labels.selectExpr("obj_id", "1 AS part_id", "1L AS cluster_id"))
    assert tuple(cp.member_scores(members, labels).first()) == (1, 1.0, 1.0)


def test_jobs_are_scored_and_failures_are_rows(spark):
    objs = blobs(spark)
    members = en.base_partitions(objs, 6)
    plan = bm.plan_jobs(60, [19], [4], ["average"], ["random", "qd"], [0.5], algorithms=["kmeans", "agglomerative_ward", "hierarchical", "weighted"])
    assert [j["variant"] for j in plan] == ["default", "default", "random", "qd", "random", "qd"] and {j["algorithm"] for j in bm.plan_jobs(900, [1], [4], ["ward"], ["random"], [])}.isdisjoint({"guided", "guided_diffusion"})
    plan.append(plan[2] | {"job_id": len(plan), "linkage": "nothing"})
    done = {r["job_id"]: r for r in bm.run_jobs(objs, members, plan).collect()}
    assert len(done) == len(plan) and done[6]["status"] == "failed" and done[6]["nmi_mean"] is None and done[6]["error"]
    assert all(done[i]["nmi_mean"] > 0.9 and done[i]["status"] == "ok" for i in range(6)) and [done[i]["runs"] for i in (0, 2)] == [1, 2]
    with pytest.raises(ValueError):
        bm.plan_jobs(10, [1], [2], ["ward"], ["random"], [], algorithms=["unknown"])


def test_winner_of_ties_is_the_single_one(spark):
    rows = spark.createDataFrame([(0, "single", "kmeans", 0.5, "ok"), (1, "consensus", "guided", 0.5, "ok"), (2, "consensus", "weighted", 0.9, "failed")], "job_id int, family string, algorithm string, nmi_mean double, status string")
    assert bm.winners(rows).first().asDict() == {"single": "kmeans", "single_nmi": 0.5, "consensus": "guided", "consensus_nmi": 0.5, "gain": 0.0, "winner": "single"}


def test_partition_features_are_those_used(spark):
    rows = en.partition_features(spark, 9, 4).collect()
    assert [r["part_id"] for r in rows] == [0, 1, 2, 3] and all(5 <= len(r["features"]) <= 9 and r["features"] == sorted(set(r["features"])) for r in rows)
    with pytest.raises(ValueError):
        en.base_partitions(blobs(spark), preprocessing="other")


@pytest.mark.parametrize("name", gn.SCENARIOS)
def test_scenarios(spark, name):
    rows = gn.scenario(spark, name, 120, 3, 2, "easy").collect()
    assert len(rows) == 120 and {r["gt"] for r in rows} - {0} == {1, 2, 3} and len(rows[0]["features"]) == (20 if name == "highdim" else 2)


def test_suite(spark):
    plan = gn.suite_plan(spark, 7, n=(200, 220), k=(3, 3))
    assert plan.count() == 7 and {r["split"] for r in plan.collect()} <= {"train", "validation", "test"}
    some = plan.where("type IN ('compact', 'imbalanced')")
    sizes = {r["dataset"]: r["n"] for r in some.collect()}
    assert {r["dataset"]: r["count"] for r in gn.suite(spark, some).groupBy("dataset").count().collect()} == sizes


def test_report_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 0.12345, None), ("c", float("nan"), 2)], "name string, x double, n int")
    assert sinks.markdown(rows.limit(1), "T") == "## T\n\n| name | x | n |\n|---|---|---|\n| a\\|b | 0.123 |  |\n"
    with pytest.raises(ValueError):
        sinks.markdown(rows, "T", max_rows=1)
    sinks.write_profile(rows, rows.limit(1), str(tmp_path / "p"), "rank")
    assert json.loads(spark.read.text(str(tmp_path / "p/profile")).first()[0])["selection_metric"] == "rank"
    sinks.write_markdown({"A": rows, "B": rows}, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).where("value LIKE '## %'").count() == 2
    sinks.upsert_table(spark, str(tmp_path / "t"), rows, ["name"])
    sinks.snapshot(spark, str(tmp_path / "t"), "latest_rows")
    sinks.upsert_table(spark, str(tmp_path / "t"), rows.withColumn("n", F.lit(7)), ["name"])
    assert spark.table("latest_rows").where("n = 7").count() == 0


def test_kmeans_without_a_bound(spark):
    objs = blobs(spark, 90)
    found = cl.kmeans(objs, 3)
    assert ct.agreement(found.join(objs, "obj_id"), [], "label", "gt").first()["nmi"] > 0.99
    members = cl.distributed_partitions(objs, 3)
    assert {(r["part_id"], r["n"]) for r in members.groupBy("part_id").agg(F.count("*").alias("n")).collect()} == {(0, 90), (1, 90), (2, 90)}
    assert cl.scales(objs, "none") == ([0.0] * 3, [1.0] * 3)
    with pytest.raises(ValueError):
        cl.distributed_partitions(objs, preprocessing="other")


def test_spectral_follows_rings(spark):
    rng = np.random.default_rng(5)
    angle = rng.uniform(0, 2 * np.pi, 120)
    x = np.c_[np.cos(angle), np.sin(angle)] * np.repeat([1.0, 6.0], [40, 80])[:, None]
    labels = kernels.spectral(kernels.pairwise(x), 2, rng)
    assert len(set(labels[:40])) == 1 and len(set(labels[40:])) == 1 and labels[0] != labels[-1]
    assert not any(j["algorithm"] == "spectral" for j in bm.plan_jobs(901, [1], [4], ["ward"], ["random"], []))


def test_names_and_ignored_parameters(spark):
    objs = blobs(spark)
    members = en.base_partitions(objs, 4)
    row = en.run_consensus(members, objs.select("obj_id", "gt"), "hierarchical_weighted", m=3, runs=2, per_run=True, sharpen=1.5, eta=0.5).first()
    assert row["ignored_params"] == "eta" and len(row["nmi_runs"]) == 2 and abs(sum(row["nmi_runs"]) / 2 - row["nmi_mean"]) < 1e-9
    assert en.ignored_params("own", {"x": 1}) == [] and en.canonical("sdgca_modified") == "guided_diffusion"
