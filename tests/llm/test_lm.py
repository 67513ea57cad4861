import math
import zlib
from collections import Counter

import numpy as np

from quorate.llm import lm


def brute(rows):
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(k, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (k, _), t, h in zip(rows, tokens, held)]


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, score string")
    got = lm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    return got


def test_counts_and_base(spark):
    check(spark, [(1, None), (2, ""), (None, "The the cat"), (3, "THE cat É sat"), (3, "THE cat É sat"), (4, "word " * 5000)])
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    assert all(r.score == 0 for r in check(spark, [(k, "a b") for k in only_held]))


def test_the_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [r for r in check(spark, rows) if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.9


def test_context_is_learned_and_normalised():
    classes, k = np.tile([0, 1, 2, 3, 4], 3000), 6
    share = np.array([0.18, 0.18, 0.18, 0.18, 0.18, 0.1])
    one, two = lm.contexts(classes, np.array([len(classes)]), k)
    flat = lm.Model.start(share, 8, 3)
    for turn in range(20):
        flat = lm.train(flat, 8, share, one, two, classes, np.ones(len(classes)), turn)
    m = lm.Model(k, 8, flat.astype(float))
    u1, u2 = np.array([0, 1, 6]), np.array([4, 0, 6])
    p = np.exp(np.stack([m.log_probability(u1, u2, np.full(3, w)) for w in range(k)], 1))
    assert np.allclose(p.sum(1), 1) and p[0, 1] > 0.8 and p[1, 2] > 0.8
    assert lm.contexts(np.array([5, 6, 7, 8]), np.array([1, 3]), 9)[1].tolist() == [9, 9, 9, 6]
    # by hand: groups first, then the classes of a group
    h = m.context[u1] * m.scale[0] + m.context[u2] * m.scale[1]
    g = np.exp(h @ m.group[:, :-1].T + m.group[:, -1])
    w = np.exp(h @ m.word[:, :-1].T + m.word[:, -1])
    for word in range(k):
        alike = [c for c in range(k) if c % m.groups == word % m.groups]
        assert np.allclose(p[:, word], g[:, word % m.groups] / g.sum(1) * w[:, word] / w[:, alike].sum(1))


def test_all_words_have_one_class_and_shares_add_up():
    rng = np.random.default_rng(2)
    counts = np.minimum(rng.zipf(1.3, 5000), 10**6)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64)
    bands = {int(b): int(counts[lm.band(counts) == b].sum()) for b in np.unique(lm.band(counts))}
    v = lm.Vocabulary(bands, len(counts), 2.0)
    v.name(hashes[lm.band(counts) >= v.own])
    classes = v.of(hashes, counts)
    assert classes.min() >= 0 and classes.max() < v.unseen and len(v.words) > 5
    assert (v.of(hashes[:3], np.zeros(3, np.int64)) == v.unseen).all()
    own = lm.band(counts) >= v.own
    assert len(set(classes[own])) == own.sum() and not set(classes[own]) & set(classes[~own])
    tokens = np.bincount(classes, weights=counts, minlength=v.classes)
    assert np.isclose(sum((counts[classes == c] / tokens[c]).sum() for c in range(v.classes)), (tokens > 0).sum())
    assert tokens[: v.dealt].max() < 3 * counts.sum() / max(lm.LEAST, 2 * 5000**0.5) and set(classes[counts == 1]) <= set(range(*v.once))


def test_a_dependent_corpus_teaches_the_network(spark):
    """Each word decides the next one: with the context the held-out texts are far more likely than by counts alone."""
    rng, words = np.random.default_rng(4), [f"w{i}" for i in range(40)]
    rows = []
    for k in range(400):
        at, text = int(rng.integers(40)), []
        for _ in range(60):
            text.append(words[at])
            at = (at * 7 + 3 + int(rng.random() < 0.2)) % 40
        rows.append((k, " ".join(text)))
    held = [r for r in check(spark, rows) if r.held_out]
    per_token = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.15
