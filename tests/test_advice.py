import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.operators import contingency as ct
from quorate.operators import ensemble as en
from quorate.operators import recommend as rc
from quorate.operators import reports as rp
from quorate.plans import registry

DIAG = "dataset string, n long, d long, k long, dim90 long, hopkins double, overlap double, imbalance double, elongation double, silhouette double, density double"


def test_reasons_go_with_the_rules(spark):
    rows = [("clear", 200, 2, 3, 2, 0.9, 0.1, 1.0, 2.0, 0.7, 0.1), ("hard", 3000, 2000, None, 30, 0.4, 0.5, 9.0, 12.0, 0.1, 0.9), ("unknown", 400, 2, *[None] * 8)]
    diag = spark.createDataFrame(rows, DIAG)
    got = {r.dataset: r.reasons for r in rc.reasons(diag).collect()}
    assert "sharpen: little contrast: classes are clear" in got["clear"] and "theta: higher: classes are clear" in got["clear"]
    assert {"m: 10 more: weak cluster tendency", "m: 10 more: classes overlap", "m: 10 more: strong imbalance of classes", "method: single linkage keeps long clusters"} <= set(got["hard"])
    assert got["unknown"][0] == "k range: no labels and no dimensions: the default" and len(got["unknown"]) == 8
    advice = {r.dataset: r for r in rc.rules(diag).collect()}
    for r in rows:  # every 10 more is a reason
        base = {200: 20, 400: 30, 3000: 40}[r[1]]
        assert advice[r[0]].m == base + 10 * sum("10 more" in x for x in got[r[0]])
    notes = {r.dataset: r for r in rc.interpretation(diag.withColumn("outliers", F.lit(0.2))).collect()}
    assert notes["clear"].warnings == ["many outliers: a chosen subset and a larger m may help"] and notes["clear"].algorithm == "guided_diffusion"
    assert len(notes["hard"].warnings) == 5 and notes["hard"].algorithm == "weighted"
    assert notes["unknown"].findings == [] and len(notes["unknown"].warnings) == 2


def test_reasons_from_data_are_not_empty(spark, sf):
    from quorate.operators import features as ft
    from quorate.plans import views as vw

    row = rc.reasons(ft.diagnostics(vw.objects(spark, sf)).withColumn("dataset", F.lit("e"))).first()
    assert len(row.reasons) >= 8


def test_prefix_intervals(spark):
    """Against resampling written out for each prefix, and the deviations of prefix_stability."""
    r = np.random.default_rng(1)
    values = r.normal(0.6, 0.1, 40)
    rows = spark.createDataFrame([("a", float(v), i) for i, v in enumerate(values)] + [("b", 0.5, i) for i in range(7)], "algorithm string, value double, row_no long")
    got = {(x.algorithm, x.k): x for x in rp.prefix_intervals(rows, [5, 10, 30, 50], seed=3).collect()}
    assert set(got) == {("a", 5), ("a", 10), ("a", 30), ("b", 5)}
    u = np.random.default_rng(3).random((2000, 40))
    for k in (5, 10, 30):
        means = [np.mean([values[int(x * k)] for x in row[:k]]) for row in u]
        low, high = np.percentile(means, [2.5, 97.5])
        x = got["a", k]
        assert (x.low, x.high, x.width) == pytest.approx((low, high, high - low)) and x.low < x.mean < x.high
        assert x.width == pytest.approx(2 * 1.96 * values[:k].std() / np.sqrt(k), rel=0.25)
    plain = {(x.algorithm, x.k): x for x in rp.prefix_stability(rows, [5, 10, 30, 50]).collect()}
    assert all((got[k].mean, got[k].std) == pytest.approx((plain[k].mean, plain[k].std)) for k in got) and got["b", 5].width == 0


def members_of(spark, n=40, m=6, seed=0):
    r = np.random.default_rng(seed)
    hidden = r.integers(0, 3, n)
    x = np.stack([np.where(r.random(n) < 0.3, r.integers(0, 3, n), hidden) for _ in range(m)], 1)
    rows = [(i, p, int(c)) for i in range(n) for p, c in enumerate(x[i])]
    return x, spark.createDataFrame(rows, "obj_id long, part_id int, cluster_id int"), spark.createDataFrame([(i, int(h)) for i, h in enumerate(hidden)], "obj_id long, gt int")


def test_learned_weights_by_position(spark):
    x, members, _ = members_of(spark)
    plan = spark.createDataFrame([(0, 1), (0, 4), (0, 5), (1, 0), (1, 2), (1, 3)], "run_id int, part_id int")
    want = []
    for parts in ((1, 4, 5), (0, 2, 3)):
        same = [x[:, None, p] == x[None, :, p] for p in parts]
        w = np.array([[(a == b).mean() for b in same] for a in same]).mean(1)
        w = (w / w.sum()) ** 1.5
        want.append(w / w.sum())
    got = {r.position: (r.runs, r.weight) for r in ct.position_weights(members, plan, 1.5).collect()}
    assert got == {p + 1: (2, pytest.approx(np.mean([w[p] for w in want]))) for p in range(3)}


def test_what_each_run_took(spark):
    x, members, labels = members_of(spark)
    row = en.run_consensus(members, labels, "weighted", m=4, runs=3, seed=5, per_run=True, sharpen=1.5).first()
    plan = en.random_plan(members, 4, 3, 5)
    taken = {}
    for r in plan.collect():
        taken.setdefault(r.run_id, []).append(r.part_id)
    assert row.selected_runs == [sorted(taken[r]) for r in range(3)] and row.pool == 6 and len(row.nmi_runs) == 3
    want = [r.weight for r in sorted(ct.position_weights(members, plan, 1.5).collect(), key=lambda r: r.position)]
    assert row.mean_weights == pytest.approx(want) and sum(want) == pytest.approx(1)


def test_tuning_finds_the_best_of_the_full_grid(spark, monkeypatch):
    """An algorithm whose result is best at one setting: rounds end next to it, and errors count 0."""
    _, members, labels = members_of(spark)

    def build(x, params):
        if params["a"] > 0.9:
            raise ValueError("too large")
        near = (x[:, None, :] == x[None, :, :]).mean(2)
        blur = abs(params["a"] - 0.4) + abs(params["b"] - 3) / 10
        noise = np.random.default_rng(0).random(near.shape)
        return (1 - min(1, 2 * blur)) * near + min(1, 2 * blur) * (noise + noise.T) / 2

    monkeypatch.setitem(en.ALGORITHMS, "own", build)
    trials = en.tune(members, labels, {"a": (0.0, 1.0), "b": (1.0, 5.0)}, steps=3, rounds=2, seeds=(1, 2), algorithm="own", m=6, runs=1)
    rows = trials.toPandas()
    assert rows.groupby("round").size().tolist() == [9, 9] and (rows[rows.failed > 0].value == 0).all() and (rows.failed > 0).any()
    full = [en.parameter_grid(members, labels, [{"a": a, "b": b} for a in np.linspace(0, 1, 5) for b in np.linspace(1, 5, 5)], "own", m=6, runs=1, seed=s).toPandas() for s in (1, 2)]
    best = pd.concat(full).assign(nmi=lambda d: d.nmi.fillna(0)).groupby("params").nmi.mean().max()
    assert en.best_trial(trials).first().value >= best - 1e-9


def test_queries(spark, sf):
    assert registry.QUERIES["prefix_intervals"](spark, sf).where("low > mean OR high < mean").count() == 0
    done = registry.QUERIES["experiment_suite"](spark, sf).collect()
    assert len(done) == 8 and {r.status for r in done} == {"ok"}


def test_tuning_without_labels(spark):
    """The objective over features: what the grid reports is the kernel's value of the labels it found."""
    from quorate.functions import kernels

    x, members, labels = members_of(spark, 30, 4)
    points = np.random.default_rng(0).normal(size=(30, 2)) + 5 * np.stack([x[:, 0] == 0, x[:, 0] == 1], 1)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "obj_id long, features array<double>")
    rows = en.parameter_grid(members, labels, [{"sharpen": 1.0}, {"sharpen": -1.0}], "weighted", m=4, runs=1, features=features).collect()
    want = kernels.objective(kernels.consensus_labels(en.weighted(x, {"sharpen": 1.0}), 3), x, points)
    assert {r.trial: r.objective for r in rows}[0] == pytest.approx(want) and all(r.status == "ok" for r in rows)
    tried = en.tune(members, labels, {"sharpen": (0.5, 2.5)}, 3, 1, "objective", (1,), algorithm="weighted", m=3, runs=1, features=features)
    assert tried.count() == 3 and tried.where("value <= 0.2 OR value > 1").count() == 0


def test_filters_and_checks(spark):
    sets = spark.createDataFrame([("a", "test", 0, "round", 10), ("b", "test", 1, "long", 900), ("c", "train", 0, "round", 50), ("d", "test", 0, "long", 20)], "dataset string, split string, fold int, type string, n int")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(rp.chosen_sets(sets)) == ["a", "b", "c", "d"] and names(rp.chosen_sets(sets, limit=2)) == ["a", "b"]
    assert names(rp.chosen_sets(sets, "test", 0)) == ["a", "d"] and names(rp.chosen_sets(sets, "test", types=["long"], max_n=100)) == ["d"]
    found = spark.createDataFrame([("x", "single"), ("y", "average"), ("z", "single")], "algorithm string, linkage string")
    assert names(rp.known_results(found, ["x", "y"])) == ["x", "y"] and names(rp.known_results(found, ["x", "y"], "single")) == ["x"]
    registry_ = spark.createDataFrame([("/a", ".npz", 3), ("/b", ".csv", 3), ("/c", ".MAT", 1), ("/d", ".npz", 0), ("/e", ".npz", None), ("/f", ".mat", 2)], "path string, suffix string, n_partitions int")
    assert names(rp.runnable(registry_, spark.createDataFrame([("/a",), ("/c",), ("/d",)], "path string"))) == ["/a", "/c"]
    for m, runs, params in ((0, 1, {}), (1, 0, {}), (1, 1, {"sharpen": 0}), (1, 1, {"time": -1}), (1, 1, {"tau": 2})):
        with pytest.raises(ValueError, match="out of range"):
            en.checked(m, runs, params)
    en.checked(1, 1, {"time": "adaptive", "tau": 0.5})


def test_fixed_tau(spark):
    """A tau of 1 leaves no cannot links but full ones; a tau of 0 makes every difference one."""
    x, _, _ = members_of(spark, 25, 4)
    default, none, every = (en.guided(x, {"tau": t} if t is not None else {}) for t in (None, 1.0, 0.0))
    assert np.allclose(default, en.guided(x, {"tau": 0.8})) and every.sum() < none.sum()
    assert en.ignored_params("guided", {"tau": 1}) == []
