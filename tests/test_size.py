"""Whole jobs on inputs beyond what one task or the driver can hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.functions import kernels
from quorate.operators import benchmark as bm
from quorate.operators import coassociation as co
from quorate.operators import ensemble as en
from quorate.operators import linkage as ln
from quorate.operators import neighbours as nb
from quorate.operators import reports as rp


def test_remaining_is_not_broadcast(spark):
    keys = ["dataset", "algorithm", "alpha"]
    man = spark.range(50).select(F.col("id").alias("dataset"), F.lit(100).alias("n"))
    jobs = rp.job_grid(man, ["hierarchical", "guided"], [10], ["average"], ["random", "qd"], [0.3]).drop("n")
    done = jobs.where("dataset % 3 = 0 AND strategy = 'random'")
    left = rp.remaining(jobs, done.unionByName(done), keys)
    rows = sorted((r.dataset, r.algorithm, r.strategy) for r in left.collect())
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
    assert rows == sorted((d, a, s) for d in range(50) for a in ("hierarchical", "guided") for s in ("random", "qd") if s == "qd" or d % 3)


def pairs_by_hand(labels, weight):
    """(i, j) -> (partitions, weight) that i < j share."""
    n, m = labels.shape
    every = {(i, j): [p for p in range(m) if labels[i, p] == labels[j, p]] for i in range(n) for j in range(i + 1, n)}
    return {ij: (len(ps), sum(weight[p, labels[ij[0], p]] for p in ps)) for ij, ps in every.items() if ps}


@pytest.mark.parametrize("radix", [True, False])
def test_partners_and_links_without_other_pairs(spark, monkeypatch, radix):
    """Copies, objects that agree with none, keys as numbers and as texts; no join of objects for sums over partners."""
    rng = np.random.default_rng(5)
    labels = np.concatenate([rng.integers(1, 4, (30, 5)), np.ones((6, 5), dtype=int), [[9] * 5]])
    weight = {(p, c): float(rng.random()) for p in range(5) for c in np.unique(labels[:, p])}
    if not radix:
        monkeypatch.setattr(co.math, "prod", lambda _: 1 << 63)
    members = spark.createDataFrame([(i, p, int(c)) for i, row in enumerate(labels) for p, c in enumerate(row)], "obj_id long, part_id int, cluster_id int")
    weights = spark.createDataFrame([(p, int(c), w) for (p, c), w in weight.items()], "part_id int, cluster_id int, weight double")
    shared = pairs_by_hand(labels, weight)
    plan = co.later_partners(members, weights)
    got = {r.i: (r.partners, r.total, r.top) for r in plan.collect()}
    for i in range(len(labels)):
        w = [v for (a, _), (_, v) in shared.items() if a == i]
        assert (i in got) == bool(w)
        assert not w or np.allclose(got[i], (len(w), sum(w), max(w)))
    for share in (0.55, 0.8):
        kept = {ij: w for ij, (n, w) in shared.items() if n / 5 >= share}
        low, high = min(kept.values()), max(kept.values())
        found = co.must_link_pairs(members, weights, share).collect()
        assert sorted((r.i, r.j) for r in found) == sorted(kept)
        assert all(abs(r.w - ((kept[r.i, r.j] - low) / (high - low) / 5 + 0.8)) < 1e-9 for r in found)


@pytest.mark.parametrize(("algorithm", "method"), [("hierarchical", "complete"), ("hierarchical", "ward"), ("weighted", "average")])
def test_consensus_by_points(spark, algorithm, method):
    """More objects than a run may have points; the labels are those of the whole matrix."""
    rng = np.random.default_rng(11)
    labels = rng.integers(1, 4, (90, 3))
    members = spark.createDataFrame([(i, p, int(c)) for i, row in enumerate(labels) for p, c in enumerate(row)], "obj_id long, part_id int, cluster_id int")
    found = en.consensus(members, en.random_plan(members, 3, 1), 4, algorithm, method, sharpen=1.5, **({"max_n": 27} if algorithm == "hierarchical" else {})).orderBy("obj_id").collect()
    whole = en.ALGORITHMS[algorithm](labels, {"sharpen": 1.5})
    assert [r.label for r in found] == kernels.consensus_labels(whole, 4, method, None, 12).tolist()


def test_weighted_has_no_bound_on_objects(spark):
    rows = spark.range(3100).select(F.col("id").alias("obj_id"), F.explode(F.array(*[F.struct(F.lit(p).alias("part_id"), (F.col("id") % (p + 2)).cast("int").alias("cluster_id")) for p in range(2)])).alias("m"))
    members = rows.select("obj_id", "m.*")
    found = en.consensus(members, en.random_plan(members, 2, 1), 6, "weighted").groupBy("label").count().collect()
    assert sorted(r["count"] for r in found) == [516, 516, 517, 517, 517, 517]


def test_base_partitions_have_no_bound(spark):
    """Beyond max_n the pool is k-means over all tasks."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(9, 0.1, (40, 2))])
    objs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obj_id long, features array<double>")
    got = en.base_partitions(objs, 2, k_max=2, max_hierarchical=10, max_n=50).toPandas()
    assert len(got) == 160 and set(got["algorithm"]) == {"kmeans"} and got["linkage"].isna().all()
    for _, part in got.groupby("part_id"):
        labels = part.sort_values("obj_id")["cluster_id"].to_numpy()
        assert len(set(labels[:40])) == len(set(labels[40:])) == 1 and labels[0] != labels[40]


def test_pivots_that_exclude_nothing_are_left_out(monkeypatch):
    """Points about equally far apart have one cell; separate groups keep their pivots; blocks grow so that few are enough."""
    monkeypatch.setattr(nb, "PER_PIVOT", 50)
    rng = np.random.default_rng(4)
    sphere = rng.normal(0, 1, (400, 64))
    sphere /= np.sqrt((sphere**2).sum(1))[:, None]
    assert len(nb._pivots(sphere, 400, 1.1)) == 1
    groups = rng.permutation(np.repeat(np.arange(8), 50))[:, None] * [100.0, 0.0] + rng.normal(0, 0.1, (400, 2))
    assert len(nb._pivots(groups, 400, 0.5)) > 1


@pytest.mark.parametrize("keep", [10, 10**6])
def test_components_in_steps(spark, monkeypatch, keep):
    """Tiles that are compared in many steps, with pairs reduced on the way, against all pairs."""
    for name, value in {"STEP": 7, "KEEP": keep, "BLOCKS": 3}.items():
        monkeypatch.setattr(nb, name, value)
    monkeypatch.setattr(nb.linkage, "BLOCK", 20)
    x = np.random.default_rng(6).normal(0, 1, (150, 2))
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.25
    low = np.arange(150)
    for _ in range(150):
        low = np.array([low[n].min() for n in near])
    objs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obj_id long, features array<double>")
    assert [r.component for r in nb.eps_components(objs, 0.25).orderBy("obj_id").collect()] == low.tolist()


def test_large_jobs_fail_without_their_objects(spark, monkeypatch):
    """Linkages and runs beyond the bound are failed rows with the same errors, and no task gets their objects; k-means goes on."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))])
    objs = spark.createDataFrame([(i, v.tolist(), i // 20) for i, v in enumerate(x)], "obj_id long, features array<double>, gt int")
    members = spark.createDataFrame([(i, p, i // 20) for i in range(40) for p in range(2)], "obj_id long, part_id int, cluster_id int")
    jobs = bm.plan_jobs(40, [1], [2], ["average"], ["random"], [], algorithms=["kmeans", "agglomerative_ward", "weighted"])
    ids = {j["job_id"]: j["algorithm"] for j in jobs}
    single = bm.single_labels(objs, jobs, 2, max_n=30).toPandas()
    runs = bm.consensus_labels(members, jobs, 2, max_n=30).toPandas()
    for frame, failed, count in ((single, "agglomerative_ward", 40), (runs, "weighted", 80)):
        part = frame[frame["job_id"].map(ids) == failed]
        assert len(part) == count and set(part["error"]) == {"ValueError: 40 objects; max_n is 30"} and set(part["label"]) == {0} and not part["memory_mb"].any()
    good = single[single["job_id"].map(ids) == "kmeans"].sort_values("obj_id")
    assert good["error"].isna().all() and len(set(good["label"][:20])) == len(set(good["label"][20:])) == 1


@pytest.mark.parametrize(("algorithm", "params"), [("guided", {}), ("guided_diffusion", {"time": "adaptive"})])
def test_guided_has_no_bound_on_objects(spark, algorithm, params):
    """More than 3000 objects of few classes: the labels are those of the whole matrix, with weights of clusters and for any linkage by classes."""
    rng = np.random.default_rng(12)
    hidden = rng.integers(0, 3, 3100)
    labels = np.stack([np.where(rng.random(3100) < 0.3, rng.integers(1, 4, 3100), 1 + hidden) for _ in range(4)], 1)
    members = spark.createDataFrame([(i, p, int(c)) for i, row in enumerate(labels) for p, c in enumerate(row)], "obj_id long, part_id int, cluster_id int")
    fuzzy, more = None, {}
    if algorithm == "guided_diffusion":
        more["fuzzy"] = rng.random(12)
        fuzzy = spark.createDataFrame([(p, c, float(more["fuzzy"][3 * p + c - 1])) for p in range(4) for c in (1, 2, 3)], "part_id int, cluster_id int, weight double")
    found = en.consensus(members, en.random_plan(members, 4, 1), 5, algorithm, "average", fuzzy=fuzzy, **params).orderBy("obj_id").collect()
    assert [r.label for r in found] == kernels.consensus_labels(en.ALGORITHMS[algorithm](labels, params | more), 5, "average", None, 12).tolist()


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_class_labels_equal_object_labels(method):
    """Classes that merge first, classes that are apart, and cuts that leave objects of a class alone."""
    rng = np.random.default_rng(13)
    for k in (1, 3, 7, 12, 25):
        n = rng.integers(1, 6, 8)
        similarity = rng.random((8, 8))
        similarity = (similarity + similarity.T) / 2
        similarity[np.arange(8), np.arange(8)] = rng.choice([0.2, 0.9, 0.97, 1.0], 8)
        back = np.repeat(np.arange(8), n)
        whole = similarity[np.ix_(back, back)]
        np.fill_diagonal(whole, 1)
        want = kernels.consensus_labels(whole, k, method, None, 12)
        at, rank, labels = kernels.class_labels(similarity, n, k, method, 12)
        got = np.zeros(len(back), dtype=int)
        for c, r, label in zip(at, rank, labels, strict=True):
            place = np.flatnonzero(back == c)
            got[place if r < 0 else place[r]] = label
        first = {label: i for i, label in reversed(list(enumerate(got)))}
        assert [sorted(first.values()).index(first[label]) + 1 for label in got] == want.tolist()


def test_objects_of_a_class_get_labels_of_their_own(spark):
    """Rows of ranks go to the objects of a class in their order, and labels go by the least objects."""
    own = spark.createDataFrame([(0, 5, "a"), (0, 2, "b"), (0, 9, "a"), (0, 7, "b")], "run_id int, obj_id long, sig string")
    points = own.groupBy("run_id", "sig").agg(F.min("obj_id").alias("s"))
    found = spark.createDataFrame([(0, 5, 1, 3), (0, 5, 0, 1), (0, 2, -1, 2)], "run_id int, obj_id long, rank int, label int")
    with en.Tables(spark, "test") as tables:
        assert sorted((r.obj_id, r.label) for r in en._of_classes(own, points, found, tables).collect()) == [(2, 1), (5, 2), (7, 1), (9, 3)]


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_euclidean_equals_kernel(spark, monkeypatch, method):
    """Copies and equal distances, rounds over several tiles in small steps, then one task; against the whole matrix."""
    for name, value in {"BLOCK": 30, "DEALT": 3, "ROWS": 7, "COLUMNS": 11, "HELD": 20}.items():
        monkeypatch.setattr(ln, name, value)
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.integers(0, 1000, (40, 3))])
    x = np.concatenate([x, x[5:12], x[5:9]])
    objs = spark.createDataFrame([(3 * i + 1, v.tolist()) for i, v in enumerate(x)], "obj_id long, features array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), ln.DIGITS)
    want = kernels.cut(kernels.linkage(d, method, None, ln.DIGITS), len(x), 9).tolist()
    assert [r.label for r in ln.euclidean(objs, 9, method, 50).orderBy("obj_id").collect()] == want


def test_single_clusterers_have_no_bound(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(9, 0.1, (40, 2))])
    objs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obj_id long, features array<double>")
    got = en.single_clusterers(objs, 2, max_n=30).toPandas().sort_values("obj_id")
    assert {a: g["label"].tolist() for a, g in got.groupby("algorithm") if a != "kmeans"} == dict.fromkeys(en.METHODS, [1] * 40 + [2] * 40) and len(got) == 400


def test_bootstrap_gives_sums_once_a_task(spark):
    """Rows of one split are spread, and each task gives ``resamples`` rows a key, whatever the number of its batches; counts are those of the hash."""
    rows = spark.createDataFrame([("a" if i % 3 else None, i, float(i % 7)) for i in range(400)], "k string, row_no long, v double").coalesce(1)
    got = {r.k: r for r in en.bootstrap_mean(rows, ["k"], "v", resamples=50).collect()}
    plan = en.bootstrap_mean(rows, ["k"], "v", resamples=50)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in plan
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    high, spare = kernels.folded(x) ^ kernels.folded(np.uint64(77)), np.empty_like(x)
    kernels.scramble_high(high, spare)
    assert (high == kernels.scrambled(x ^ np.uint64(77)) >> np.uint64(48)).all()
    assert set(got) == {"a"} and got["a"].low <= got["a"].mean <= got["a"].high


def test_single_clusterers_are_the_same_over_all_tasks(spark):
    """k-means and linkages of one task each and over all tasks give equal labels."""
    x = np.random.default_rng(16).normal(0, 1, (150, 3))
    objs = spark.createDataFrame([(7 * i + 1, v.tolist()) for i, v in enumerate(x)], "obj_id long, features array<double>").repartition(3)
    one, all_ = (sorted(map(tuple, en.single_clusterers(objs, 5, max_n=n).collect())) for n in (3000, 100))
    assert one == all_ and len(one) == 750


@pytest.mark.parametrize("method", ["complete", "average", "ward"])
def test_groups_keep_their_nearest_one(spark, monkeypatch, method):
    """Only groups whose nearest one merged, and new ones, look for another: far fewer questions than groups times rounds."""
    monkeypatch.setattr(ln, "BLOCK", 100)
    seen = []
    written = ln.Tables.write
    groups = lambda df: (df.where("open").select("s").distinct().count(), df.select("s").distinct().count()) if {"open", "s"} <= set(df.columns) else None
    monkeypatch.setattr(ln.Tables, "write", lambda self, df: (seen.append(groups(df)), written(self, df))[1])
    x = np.random.default_rng(17).normal(0, 1, (200, 8))
    objs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obj_id long, features array<double>")
    ln.euclidean(objs, 4, method, 60)
    seen = [x for x in seen if x]
    assert seen[0] == (200, 200) and len(seen) > 3 and all(o < n for o, n in seen[1:])


def test_pool_does_not_depend_on_the_number_of_objects(spark):
    """Hierarchical partitions stay hierarchical at any size, and partitions over all tasks are those of one task each."""
    x = np.random.default_rng(18).normal(0, 1, (90, 4))
    objs = spark.createDataFrame([(5 * i + 2, v.tolist()) for i, v in enumerate(x)], "obj_id long, features array<double>").repartition(3)
    one, all_ = (sorted(map(tuple, en.base_partitions(objs, 4, max_hierarchical=n).collect()), key=str) for n in (2500, 50))
    assert one == all_ and {(r[1], r[4]) for r in all_} == {(0, None), (1, "complete"), (2, None), (3, "ward")}


def test_benchmark_plans_all_jobs_at_any_size(spark, monkeypatch):
    """Guided and spectral jobs are planned beyond 900 objects too."""
    from quorate.plans import registry

    seen = {}
    monkeypatch.setattr(bm, "run_jobs", lambda objs, members, jobs: seen.update({j["algorithm"]: objs for j in jobs}) or spark.range(1).select(F.lit(0.0).alias("seconds"), "id"))
    registry.QUERIES["benchmark_jobs"](spark, "/root/testdata/sf0.1")
    assert seen["guided"].count() > 900 and set(seen) == {*bm.SINGLE, *en.ALGORITHMS}


def test_benchmark_jobs_are_the_same_over_all_tasks(spark, monkeypatch):
    """Single jobs of one task each and over all tasks, and runs by points and by objects, give equal partitions; no job fails for its size."""
    rng = np.random.default_rng(19)
    x = np.concatenate([rng.normal(c, 0.5, (50, 3)) for c in (0, 5, 10)])
    objs = spark.createDataFrame([(3 * i + 1, v.tolist(), i // 50) for i, v in enumerate(x)], "obj_id long, features array<double>, gt int").repartition(3)
    members = spark.createDataFrame([(3 * i + 1, p, int(i // 50 if rng.random() < 0.8 else rng.integers(0, 3))) for i in range(150) for p in range(4)], "obj_id long, part_id int, cluster_id int")
    jobs = bm.plan_jobs(150, [1], [3], ["average"], ["random"], [], runs=1)

    def partitions(df):
        pdf = df.toPandas().sort_values("obj_id")
        assert pdf["error"].isna().all() and len(pdf) == 150 * pdf["job_id"].nunique()
        return {j: [g["label"].tolist().index(v) for v in g["label"]] for j, g in pdf.groupby("job_id")}

    one, runs = partitions(bm.single_labels(objs, jobs, 3)), partitions(bm.consensus_labels(members, jobs, 3))
    assert runs == partitions(bm.consensus_labels(members, jobs, 3, max_n=3000))
    monkeypatch.setattr(bm, "ONE_TASK", 100)
    assert one == partitions(bm.single_labels(objs, jobs, 3))
