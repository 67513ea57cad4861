import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.functions import kernels
from quorate.functions.shared import Tables
from quorate.operators import ensemble as en
from quorate.operators import linkage as ln


def random_members(spark, n, m, seed, clusters=4, noise=0.5):
    """Partitions that follow a hidden grouping, with noise: many ties, some equal objects."""
    r = np.random.default_rng(seed)
    hidden = r.integers(0, 6, n)
    x = np.stack([np.where(r.random(n) < noise, r.integers(0, clusters, n), hidden % clusters) for _ in range(m)], 1)
    rows = [(int(i) * 3 + 1, p, int(c) + 10 * (p % 2)) for i in range(n) for p, c in enumerate(x[i])]
    return x, spark.createDataFrame(rows, "obj_id long, part_id int, cluster_id int")


def labels(df, run=0):
    return [r.label for r in sorted(df.where(f"run_id = {run}").collect(), key=lambda r: r.obj_id)]


def dense(x, k, method):
    """The kernel on all objects, in the order of their ids; equal ones stay together for any k."""
    k = min(k, len(x) - 1)
    same = (x[:, None, :] == x[None, :, :]).mean(2)
    return kernels.cut(kernels.linkage(np.round(1 - same, ln.DIGITS), method, None, ln.DIGITS), len(x), k).tolist()


def test_single_equals_kernel(spark, monkeypatch):
    monkeypatch.setattr(ln, "BLOCK", 32)
    x, members = random_members(spark, 110, 6, 1)
    plan = spark.createDataFrame([(0, p) for p in range(6)] + [(1, p) for p in (0, 2, 5)], "run_id int, part_id int")
    with Tables(spark, "test") as tables:
        pts = tables.write(ln.points(members, plan))
        forest = tables.write(ln.spanning_forest(pts, tables).select("run_id", "a", "b", (-F.col("agree")).cast("double").alias("height")))
        for k in (9,):
            got = ln.cut(pts, forest, k, tables)
            assert labels(got) == dense(x, k, "single")
            assert labels(got, 1) == dense(x[:, [0, 2, 5]], k, "single")


@pytest.mark.parametrize("small", [0, 100_000])
def test_forest_is_minimal(spark, monkeypatch, small):
    """Its agreements are those of a minimum spanning tree by Prim's rule."""
    monkeypatch.setattr(ln, "BLOCK", 16)
    monkeypatch.setattr(ln, "SMALL", small)
    x, members = random_members(spark, 90, 9, 2, clusters=3)
    plan = spark.createDataFrame([(0, p) for p in range(9)], "run_id int, part_id int")
    with Tables(spark, "test") as tables:
        forest = ln.spanning_forest(ln.points(members, plan), tables).collect()
    u = np.unique(x, axis=0)
    agree = (u[:, None, :] == u[None, :, :]).sum(2)
    inside, best, want = {0}, agree[0].copy(), []
    while len(inside) < len(u):
        j = max((j for j in range(len(u)) if j not in inside), key=lambda j: best[j])
        want.append(int(best[j]))
        inside.add(j)
        best = np.maximum(best, agree[j])
    assert sorted(r.agree for r in forest) == sorted(w for w in want if w)
    assert len({(r.a, r.b) for r in forest}) == len(forest)


@pytest.mark.parametrize(("k", "few"), [(4, 12), (9, 10_000)])
def test_average_equals_kernel(spark, monkeypatch, k, few):
    monkeypatch.setattr(ln, "BLOCK", 32)
    x, members = random_members(spark, 100, 7, 3, clusters=5)
    plan = spark.createDataFrame([(0, p) for p in range(7)] + [(1, p) for p in (1, 2, 4, 6)], "run_id int, part_id int")
    got = ln.average(members, plan, k, few)
    assert labels(got) == dense(x, k, "average")
    assert labels(got, 1) == dense(x[:, [1, 2, 4, 6]], k, "average")


def test_few_objects(spark):
    plan = spark.createDataFrame([(0, 0), (0, 1)], "run_id int, part_id int")
    rows = [(5, 0, 1), (5, 1, 1), (6, 0, 2), (6, 1, 2), (7, 0, 2), (7, 1, 2), (8, 0, 3), (8, 1, 3)]
    members = spark.createDataFrame(rows, "obj_id long, part_id int, cluster_id int")
    # nothing in common: all pairs are equally far, so two clusters are only left where there are no more
    assert labels(ln.average(members, plan, 2)) == [1, 1, 1, 1]
    assert labels(ln.single(members, plan, 3)) == [1, 2, 2, 3]
    assert ln.single(members.where("obj_id = 0"), plan, 2).count() == 0


@pytest.mark.parametrize("small", [0, 40, 100_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(ln, "SMALL", small)
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(9, 9)] + [(700, i) for i in range(701, 760)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        return v if root[v] == v else find(root[v])

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    with Tables(spark, "test") as tables:
        got = {(x.g, x.id): x.component for x in ln.components(spark.createDataFrame([(g, *e) for g in (0, 1) for e in edges], "g int, a long, b long"), tables, ["g"]).collect()}
        assert got == {(g, v): find(v) for g in (0, 1) for v in root}
        assert ln.components(spark.createDataFrame([], "a long, b long"), tables).count() == 0


def test_consensus_goes_through_it(spark, monkeypatch):
    x, members = random_members(spark, 60, 6, 5)
    plan = spark.createDataFrame([(0, p) for p in range(6)], "run_id int, part_id int")
    assert labels(en.consensus(members, plan, 3)) == dense(x, 3, "average")
    calls = []
    for name in ("single", "average"):
        monkeypatch.setattr(ln, name, lambda *a, name=name: calls.append((name, *a[2:])))
    en.consensus(members, plan, 3, method="single")
    en.consensus(members, plan, 3, max_n=5)
    assert calls == [("single", 3), ("average", 3, 5)]
    with pytest.raises(Exception, match="max_n"):
        en.consensus(members, plan, 3, method="complete", max_n=5).collect()
