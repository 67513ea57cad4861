import numpy as np
import pytest

from quorate.operators import linkage as ln
from quorate.operators import neighbours as nb


def plain(x, g, eps):
    near = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps) & (g[:, None] == g)
    low = np.arange(len(x))
    while True:
        new = np.array([low[near[i]].min() for i in range(len(x))])
        if (new == low).all():
            return low.tolist()
        low = new


@pytest.mark.parametrize(("pivots", "block"), [(1, 4096), (7, 24)])
def test_equals_all_pairs(spark, monkeypatch, pivots, block):
    """Few and many pivots and blocks; copies; pairs at exactly the radius."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (120, 3)), r.normal(6, 0.3, (40, 3)), np.repeat(r.normal(3, 2, (1, 3)), 20, 0), [[50, 0, 0], [50.5, 0, 0], [51, 0, 0], [51.5001, 0, 0]]])
    g = r.integers(0, 2, len(x))
    g[-4:] = 0
    monkeypatch.setattr(nb, "PER_PIVOT", len(x) // pivots)
    monkeypatch.setattr(ln, "BLOCK", block)
    objs = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, g, strict=True))], "obj_id long, features array<double>, gt int")
    got = [r.component for r in sorted(nb.eps_components(objs, 0.5).collect(), key=lambda r: r.obj_id)]
    assert got == plain(x, np.zeros(len(x)), 0.5) and got[-4:] == [180, 180, 180, 183]
    want = plain(x, g, 0.5)
    rows = {r.gt: r for r in nb.eps_connectivity(objs, 0.5).collect()}
    for k in (0, 1):
        sizes = np.bincount([c for c, own in zip(want, g, strict=True) if own == k])
        assert (rows[k].objects, rows[k].components, rows[k].largest, rows[k].connected) == ((g == k).sum(), (sizes > 0).sum(), sizes.max(), False)


def test_one_and_none(spark):
    objs = spark.createDataFrame([(3, [1.0, 2.0], 1)], "obj_id long, features array<double>, gt int")
    assert [tuple(r) for r in nb.eps_components(objs, 0.1).collect()] == [(3, 3)]
    assert nb.eps_components(objs.limit(0), 0.1).count() == 0
