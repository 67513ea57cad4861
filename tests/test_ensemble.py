from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.operators import coassociation as co
from quorate.operators import contingency as ct
from quorate.operators import ensemble as en
from quorate.operators import features as ft
from quorate.operators import generators as g
from quorate.operators import recommend as rc
from quorate.operators import reports as rp


@pytest.fixture(scope="module")
def blobs(spark):
    return g.gaussian(spark, n=120, k=3, d=2, std=0.4, separation=6, seed=4).cache()


@pytest.fixture(scope="module")
def pool(blobs):
    return en.base_partitions(blobs, 25, 2, 5).cache()


@pytest.mark.parametrize("algorithm", list(en.ALGORITHMS))
def test_quality_floor(blobs, pool, algorithm):
    row = en.run_consensus(pool, blobs.select("obj_id", "gt"), algorithm, m=15, runs=3).first()
    assert row["nmi_mean"] > 0.7 and row["runs"] == 3


def test_qd_repeats_its_subset(blobs, pool):
    row = en.run_consensus(pool, blobs.select("obj_id", "gt"), m=10, runs=2, selection="qd").first()
    assert row["nmi_std"] == 0
    assert en.random_plan(pool, 99, 2).count() == 50


def test_schedule(pool):
    kinds = {r.part_id: (r.algorithm, r.linkage) for r in pool.select("part_id", "algorithm", "linkage").distinct().collect()}
    assert all(kinds[j] == (("hierarchical", "complete" if j % 4 == 1 else "ward") if j % 2 else ("kmeans", None)) for j in range(25))


def test_errors(blobs, pool):
    with pytest.raises(ValueError):
        en.base_partitions(blobs, 3, strategy="other")
    with pytest.raises(KeyError):
        en.consensus(pool, en.random_plan(pool, 3, 1), 3, "other")
    with pytest.raises(ValueError):
        en.consensus(pool, en.random_plan(pool, 3, 1), 3, method="other")
    with pytest.raises(Exception, match="max_n"):
        en.consensus(pool, en.random_plan(pool, 3, 1), 3, "weighted", max_n=10).count()


def test_signatures_change_nothing(pool, blobs):
    plan = en.random_plan(pool, 8, 1)
    got = en.consensus(pool, plan, 3).toPandas().set_index("obj_id").label.sort_index()
    wide = pool.join(plan, "part_id").toPandas().pivot(index="obj_id", columns="part_id", values="cluster_id").sort_index()
    from quorate.functions import kernels

    want = kernels.consensus_labels(en.plain(wide.to_numpy(), {}), 3)
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize(
    "pred,truth,nmi,ari,f",
    [([1, 1, 2, 2, 3, 3], [1, 1, 2, 2, 3, 3], 1, 1, 1), ([1, 1, 2, 2], [7, 7, 9, 9], 1, 1, 1), ([1, 2, 3, 4], [1, 2, 3, 4], 1, 1, 1), ([1, 1, 1], [1, 1, 1], 1, 1, 1), ([1, 2, 1, 2], [1, 1, 2, 2], 0, -0.5, 0)],
)
def test_agreement(spark, pred, truth, nmi, ari, f):
    df = spark.createDataFrame(list(zip(range(len(pred)), pred, truth)), "obj_id long, p int, t int")
    row = ct.agreement(df, [], "p", "t").first()
    assert (row.nmi, row.ari, row.f) == pytest.approx((nmi, ari, f), abs=1e-9)


def test_impute_and_profile_with_bad_values(spark):
    rows = [(i, 1, j, v) for i, r in enumerate([[1.0, float("nan")], [3.0, float("inf")], [None, 5.0]]) for j, v in enumerate(r)]
    v = spark.createDataFrame(rows, "obj_id long, gt int, feat int, value double")
    assert [r.value for r in ft.impute_mean(v).orderBy("obj_id", "feat").collect()] == [1, 5, 3, 5, 2, 5]
    p = ft.basic_profile(v).first()
    assert p.missing_ratio == pytest.approx(2 / 6) and p.inf_ratio == pytest.approx(1 / 6)


def test_shapes_and_pca(spark):
    rng = np.random.default_rng(0)
    long, round_ = rng.normal(size=(60, 2)) * [5, 0.3], rng.normal(size=(60, 2))
    pdf = pd.DataFrame({"obj_id": range(120), "features": np.vstack([long, round_ + 20]).tolist(), "gt": [1] * 60 + [2] * 60})
    objs = spark.createDataFrame(pdf)
    e = {r.gt: r.elongation for r in en.class_shapes(objs).collect()}
    assert e[1] > 50 > 5 > e[2]
    value = np.sort(np.linalg.eigvalsh(np.cov(np.array(pdf.features.tolist()).T)))[::-1]
    got = en.pca_profile(objs.select("obj_id", F.posexplode("features").alias("feat", "value"))).first()
    assert got.participation == pytest.approx(value.sum() ** 2 / (value**2).sum())


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(200).selectExpr("id as row_no", "cast(id % 10 as double) as value", "1 as k")
    r = en.bootstrap_mean(rows, ["k"], "value", 300).first()
    assert r.low < r.mean == 4.5 < r.high and r.high - r.low == pytest.approx(2 * 1.96 * 2.87 / 200**0.5, rel=0.3)


def test_generators(spark):
    for df, n, k in ((g.archetype(spark, 200, 4, 3, laws=("normal", "student", "uniform")), 200, 4), (g.density(spark, 200, 3, 2, noise=0.05), 200, 4), (g.separated(spark, 60, 3, 2, outliers=0.05, noise_features=2), 60, 4)):
        rows = df.collect()
        assert len(rows) == n and len({r.obj_id for r in rows}) == n and len({r.gt for r in rows}) == k
    assert len(rows[0].features) == 4 and sum(r.gt == 4 for r in rows) == 3
    sizes = g.cluster_sizes(500, 4, 6, np.random.default_rng(1))
    assert sizes.sum() == 500 and 4 < sizes.max() / sizes.min() < 8
    values = g.geometric_values(6, 2.0, 9.0, np.random.default_rng(1))
    assert np.exp(np.log(values).mean()) == pytest.approx(2) and values.max() / values.min() == pytest.approx(9)
    for bad in ({"k": 1}, {"separation": 1.0}, {"outliers": 1.0}, {"noise_features": -1}, {"n": 3}, {"eigen_ratio": 0.5}, {"d": 0}):
        with pytest.raises(ValueError):
            g.separated(spark, **{"n": 60, "k": 3, "d": 2} | bad)


def test_parameter_grid(blobs, pool):
    grid = [{"lam": 0.09, "eta": 0.75}, {"eta": "wrong"}]
    t = en.parameter_grid(pool, blobs.select("obj_id", "gt"), grid, m=8, runs=2)
    rows = t.collect()
    assert {(r.trial, r.status) for r in rows} == {(0, "ok"), (1, "failed")} and len(rows) == 4
    assert all(r.nmi is None and r.error for r in rows if r.trial == 1)
    assert en.best_setting(t).first().trial == 0


def test_queries_do_the_whole_job(spark, sf, monkeypatch):
    import inspect

    from quorate.operators import ensemble
    from quorate.plans import registry

    assert registry.QUERIES["consensus_scores"](spark, sf).first()["runs"] == 20
    pool = {r.part_id: r.algorithm for r in registry.QUERIES["base_ensemble"](spark, sf).select("part_id", "algorithm").distinct().collect()}
    assert pool == {j: "hierarchical" if j % 2 else "kmeans" for j in range(30)}
    assert len(registry.QUERIES["bootstrap_ci"](spark, sf).collect()) > 0
    seen = {}
    for name in ("base_partitions", "bootstrap_mean"):
        whole = getattr(ensemble, name)

        def watched(*args, whole=whole, **options):
            bound = inspect.signature(whole).bind(*args, **options)
            bound.apply_defaults()
            seen.update(bound.arguments)
            return whole(*args, **options)

        monkeypatch.setattr(ensemble, name, watched)
    registry.QUERIES["base_ensemble"](spark, sf), registry.QUERIES["bootstrap_ci"](spark, sf)
    assert seen["max_hierarchical"] == 2500 and seen["resamples"] == 10_000


def test_diffusion_weights_by_hand(monkeypatch):
    """Agreement of the partitions times the fuzzy weights, the largest 1."""
    members = np.array([[1, 1, 1], [1, 1, 2], [2, 2, 1], [2, 2, 2], [2, 1, 1], [1, 2, 2]])
    seen = {}
    monkeypatch.setattr(en.kernels, "guided", lambda m, **kw: seen.update(kw))

    def nmi(a, b):
        joint, h = 0.0, lambda x: -sum((x == v).mean() * np.log((x == v).mean()) for v in set(x))
        for u in set(a):
            for v in set(b):
                if p := ((a == u) & (b == v)).mean():
                    joint += p * np.log(p / ((a == u).mean() * (b == v).mean()))
        return joint / ((h(a) + h(b)) / 2)

    agree = np.array([np.mean([nmi(members[:, p], members[:, q]) for q in range(3) if q != p]) for p in range(3)])
    agree = np.clip(agree / agree.max(), 1e-6, 1)
    en.guided_diffusion(members, {})
    assert np.allclose(seen["weight"], np.repeat(agree, 2))
    fuzzy = np.array([0.9, 0.5, 0.4, 0.8, 1.0, 0.2])
    en.guided_diffusion(members, {"fuzzy": fuzzy})
    want = np.repeat(agree, 2) * fuzzy
    assert np.allclose(seen["weight"], np.clip(want / want.max(), 1e-6, 1))


def test_fuzzy_weights_by_hand(spark):
    x, labels = np.array([[0.0, 0], [1, 0], [4, 1], [5, 5], [0, 2]]), np.array([[1, 2], [1, 2], [2, 1], [2, 2], [1, 2]])
    values = spark.createDataFrame([(i, f, float(x[i, f])) for i in range(5) for f in range(2)], "obj_id long, feat int, value double")
    members = spark.createDataFrame([(i, p, int(labels[i, p])) for i in range(5) for p in range(2)], "obj_id long, part_id int, cluster_id int")
    want = {}
    for p in range(2):
        names = np.unique(labels[:, p])
        centres = np.array([x[labels[:, p] == c].mean(0) for c in names])
        u = 1 / np.maximum(np.sqrt(((x[:, None] - centres) ** 2).sum(2)), 1e-12)
        u /= u.sum(1, keepdims=True)
        u[np.arange(5), np.searchsorted(names, labels[:, p])] += 1e-6
        u /= u.sum(1, keepdims=True)
        h = -(u * np.log2(u)).sum(1)
        want |= {(p, int(c)): np.exp(-h[labels[:, p] == c].mean() / 0.3) for c in names}
    got = {(r.part_id, r.cluster_id): r.weight for r in ft.fuzzy_partition_weights(values, members, 0.3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tests_by_enumeration(spark):
    import itertools

    rng = np.random.default_rng(6)
    table = {(d, a): round(float(rng.random()) + (a == "x"), 3) for d in range(8) for a in "bxyz"} | {(d, "same"): None for d in range(0)}
    rows = [(str(d), a, v) for (d, a), v in table.items()] + [(str(d), "same", table[d, "b"]) for d in range(8)]
    scores = spark.createDataFrame(rows, "dataset string, algorithm string, value double")
    got = {r.algorithm: r for r in rp.signed_rank_tests(scores, "b").collect()}
    want = {}
    for a in ("x", "y", "z"):
        d = [table[k, a] - table[k, "b"] for k in range(8)]
        rank = np.argsort(np.argsort(np.abs(d))) + 1
        low = min(sum(r for r, v in zip(rank, d) if v > 0), sum(r for r, v in zip(rank, d) if v < 0))
        sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=8)]
        want[a] = min(1.0, 2 * sum(s <= low for s in sums) / 256)
    assert got["same"].p == 1.0 and all(abs(got[a].p - p) < 1e-12 for a, p in want.items())
    ordered = sorted([*want.items(), ("same", 1.0)], key=lambda x: (x[1], x[0]))
    assert all(abs(got[a].adjusted - min(1.0, p * (4 - i))) < 1e-12 for i, (a, p) in enumerate(ordered))
    f = rp.friedman_test(scores.where("algorithm <> 'same'")).first()
    grid = np.linspace(f.f, f.f + 4000, 4_000_001)  # P(F > f) by the trapezium rule
    from math import lgamma

    a, b = f.df1 / 2, f.df2 / 2
    density = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(a / b) + (a - 1) * np.log(grid) - (a + b) * np.log1p(a / b * grid))
    assert abs(f.p - ((density[1:] + density[:-1]) / 2).sum() * (grid[1] - grid[0])) < 1e-4


def test_top_pairs_and_histogram_with_copies(spark):
    rng = np.random.default_rng(3)
    labels = np.concatenate([rng.integers(1, 3, (12, 4)), np.ones((9, 4), dtype=int)])
    members = spark.createDataFrame([(i, p, int(labels[i, p])) for i in range(21) for p in range(4)], "obj_id long, part_id int, cluster_id int")
    together = {(i, j): int((labels[i] == labels[j]).sum()) for i in range(21) for j in range(i + 1, 21)}
    want = Counter(t for t in together.values() if t)
    assert {r.together: r.pairs for r in co.histogram(members).collect()} == want
    for limit in (1, 5, 37, 60, 500):
        best = sorted(((-t / 4, i, j) for (i, j), t in together.items() if t))[:limit]
        assert [(-r.w, r.i, r.j) for r in co.top_pairs(members, limit).collect()] == best


def test_diagnostics(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (30, 3)), rng.normal(6, 1, (30, 3))])
    objs = spark.createDataFrame([(i, v.tolist(), i // 30 + 1) for i, v in enumerate(x)], "obj_id long, features array<double>, gt long")
    r = ft.diagnostics(objs).first()
    assert (r.n, r.d, r.k) == (60, 3, 2) and r.silhouette > 0.6 and r.hopkins > 0.6 and r.imbalance == 1
    assert ft.hopkins(objs.limit(12)).count() == 0 or ft.hopkins(objs.limit(12)).first().hopkins is None
    flat = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(40)], "obj_id long, features array<double>, gt long")
    h = ft.hopkins(flat).first().hopkins
    assert h is None or h == 1.0  # the probes' box is one wide, the objects are alike
    advice = rc.rules(ft.diagnostics(objs).withColumn("dataset", F.lit("x"))).first()
    assert advice.k_min == 2 and advice.m >= 20


def test_diffusion_with_fuzzy_weights(spark, sf):
    from quorate.plans import registry

    rows = registry.QUERIES["guided_diffusion_fuzzy_labels"](spark, sf).collect()
    objects = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r.run_id for r in rows} == {0, 1} and all({r.obj_id for r in rows if r.run_id == k} == objects for k in (0, 1))
