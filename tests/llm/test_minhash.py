import random

import numpy as np

from quorate.llm import minhash

WORDS = [f"w{i}" for i in range(3000)]


def brute(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[find(i)] = min(best.get(find(i), k), k)
    return sorted(((k, len(sets[i]), best.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def near(rng, words, rate):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in words)


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, rows = random.Random(5), [(900, None), (901, ""), (902, " \t\n"), (903, "A b"), (904, "a B"), (None, "one two three four five six"), (905, "One two three four five six"), (905, "One two three four five six")]
    for g, (size, length, rate) in enumerate([(60, 120, 0.03), (25, 400, 0.02), (5, 30, 0.02), (3, 9, 0.0)]):
        base = [rng.choice(WORDS) for _ in range(length)]
        rows += [(1000 * (g + 1) + k, near(rng, base, rate * rng.random() * 2)) for k in range(size)]
    rows += [(9000 + k, " ".join(rng.choice(WORDS) for _ in range(40))) for k in range(20)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component_id int")
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 1000, 60000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.concatenate([a[: int(len(a) * 0.8)], rng.integers(0, 2**63, max(0, int(n * 0.2))).astype(np.uint64)])
        same, other = minhash.sketch(a), minhash.sketch(np.unique(b)) if len(b) else None
        assert np.array_equal(same, minhash.sketch(a[::-1].copy())) and len(same) == minhash.COORDINATES
        if n >= 1000:
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs((same == other).mean() - j) < 0.12
