import hashlib
import math
import random

import numpy as np
import pytest

from quorate.llm import centroids, queries


def plain(rows, k=8, rounds=10):
    """The contract in plain loops: rows are (vec_id, components)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        where = [min(range(len(now)), key=lambda c: (far(v, now[c]), c)) for _, v in kept]
        if r < rounds:
            groups = [[v for (_, v), w in zip(kept, where, strict=True) if w == c] for c in range(len(now))]
            now = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else now[c] for c, g in enumerate(groups)]
    dist = [far(v, now[w]) for (_, v), w in zip(kept, where, strict=True)]
    own = [sum(d for d, w in zip(dist, where, strict=True) if w == c) for c in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, w, d, own[w], sum(own), sha[w]) for (i, _), w, d in zip(kept, where, dist, strict=True)), key=str)


def vectors(n, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [x + r.gauss(0, 0.4) for x in r.choice(centres)]) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, v string, cluster int"


def test_equals_plain_loops(spark):
    rows = vectors(300, 1)
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (400, rows[5][1])]  # repeats, a null id
    rows += [(500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [float("nan")] * 64), (504, [float("inf")] + [0.0] * 63), (505, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert rows_of(centroids.cluster(df)) == plain(rows)


def test_ties_and_empty_clusters(spark):
    """All on a grid of two values: many equal distances, and centroids that are equal from the start."""
    r = random.Random(2)
    rows = [(i, [float(r.random() < 0.5)] + [0.0] * 63) for i in range(60)]
    assert rows_of(centroids.cluster(spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA))) == plain(rows)


def test_few_or_no_rows(spark):
    for n in (0, 1, 5):
        rows = vectors(n, 3)
        assert rows_of(centroids.cluster(spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA))) == plain(rows)
    big = spark.createDataFrame([(1, [2e5] + [0.0] * 63, "x", 1)], SCHEMA)
    with pytest.raises(Exception, match="scaled component"):
        centroids.cluster(big).collect()


def test_bounds_skip_work_and_stay_true():
    """Bounds by total displacement never pass the true distance, and save most distances once centroids settle."""
    r = np.random.default_rng(0)
    v = (r.normal(0, 300, (4, 16)).repeat(200, 0) + r.normal(0, 60, (800, 16))).astype(np.int64)
    history = v[r.choice(800, 6, replace=False)][None]
    bounds, took = centroids.Bounds.fresh(v, 6), []
    for _ in range(12):
        took.append(bounds.assign(history))
        now = ((v[:, None] - history[-1]) ** 2).sum(2)
        assert (bounds.cluster == now.argmin(1)).all()
        moved = np.sqrt(((history[-1] - history) ** 2).sum(2).astype(float))
        assert (bounds.lower - moved[bounds.lower_at, np.arange(6)] <= np.sqrt(now) + 1e-6).all()
        assert (bounds.upper + moved[bounds.upper_at, bounds.cluster] >= np.sqrt(now[np.arange(800), bounds.cluster]) - 1e-6).all()
        history = np.concatenate([history, [[v[bounds.cluster == c].sum(0) // max(1, (bounds.cluster == c).sum()) for c in range(6)]]])
    assert took[0] == 800 * 6 and sum(took[6:]) < 0.4 * sum(took[:1]) * 6


def test_query(spark, sf):
    got = queries.op11_clustering(spark, sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(got) == plain(rows)
