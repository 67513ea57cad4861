import numpy as np
import pytest

from quorate.functions import kernels as k


def naive_linkage(d, method):
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, out, alive = np.ones(len(d)), [], list(range(len(d)))
    for _ in range(len(d) - 1):
        i, j = min(((a, b) for x, a in enumerate(alive) for b in alive[x + 1 :]), key=lambda p: (d[p], p))
        h = d[i, j]
        out.append((i, j, h))
        alive.remove(j)
        for c in alive:
            if c != i:
                d[i, c] = d[c, i] = k.UPDATES[method](d[i, c], d[j, c], h, size[i], size[j], size[c])
        size[i] += size[j]
    return np.array(out)


@pytest.mark.parametrize("method", list(k.UPDATES))
def test_linkage(method):
    rng = np.random.default_rng(4)
    for n in (2, 3, 17, 30):
        for d in (k.pairwise(rng.normal(size=(n, 3))), np.round(k.pairwise(rng.integers(0, 3, (n, 2)).astype(float)), 6)):
            assert np.allclose(k.linkage(d, method), naive_linkage(d, method))


def test_cut_can_leave_fewer_clusters_on_ties():
    d = np.array([[0, 1, 1, 9], [1, 0, 1, 9], [1, 1, 0, 9], [9, 9, 9, 0.0]])
    assert k.cut(k.linkage(d, "single"), 4, 3).tolist() == [1, 1, 1, 2]
    assert k.cut(k.linkage(d, "single"), 4, 9).tolist() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        k.linkage(d, "median")


def test_heat_kernel_and_time():
    s = np.array([[1, 0.5, 0.1], [0.5, 1, 0.2], [0.1, 0.2, 1]])
    assert np.allclose(k.heat_kernel(s, 0), np.eye(3))
    lap, series, term = k.laplacian(s), np.eye(3), np.eye(3)
    for n in range(1, 40):
        term = term @ (-0.7 * lap) / n
        series += term
    assert np.allclose(k.heat_kernel(s, 0.7), np.clip(k.scaled_to_diagonal(series), 0, 1))
    assert k.adaptive_time(np.eye(3)) == 1.0 and 0.1 <= k.adaptive_time(s) <= 5


def test_refinement_keeps_links():
    rng = np.random.default_rng(1)
    w = rng.random((12, 12))
    w = (w + w.T) / 2
    must, cannot = np.where(w > 0.85, 0.9, 0), np.where(w < 0.15, 0.9, 0)
    s, d = k.refine(np.diag(w.sum(1)) - w, must, cannot)
    assert np.allclose(s[must > 0], 0.9, atol=0.02) and np.allclose(d[cannot > 0], 0.9, atol=0.02)
    assert np.array_equal(k.fuse(np.zeros((2, 2)), np.zeros((2, 2)), np.eye(2)), np.eye(2))


def test_eta_above_one_is_reliable_coassociation():
    members = np.array([[1, 1], [1, 2], [2, 2], [2, 1]])
    seg, part = k.one_hot(members)
    w = k.reliable_coassociation(seg, np.exp(-k.cluster_entropy(seg, part) / (0.09 * 2)), 2)
    assert np.allclose(k.guided(members, eta=1.01), w) and np.allclose(np.diag(w), 1)


def test_greedy_subset():
    a = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert k.greedy_subset(a, 3) == [0, 1, 2] and k.greedy_subset(a, 2, 1.0) == [1, 0] and k.greedy_subset(a, 2, 0.0) == [1, 2]


def test_p_values():
    from itertools import product

    n = 6
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product([0, 1], repeat=n)]
    for w in range(11):
        assert k.exact_wilcoxon(w, n) == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 2**n))
    assert k.exact_wilcoxon(0, 0) == 1.0
    assert k.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-3)  # t = 2 with 10 degrees of freedom
    assert k.f_tail(1.0, 7, 7) == pytest.approx(0.5) and k.f_tail(float("inf"), 2, 3) == 0


def plain_guided(members, lam=0.09, eta=0.75, theta=0.65, time=None, diffusion=False):
    """The whole matrices, object by object."""
    seg, part = k.one_hot(members)
    m = members.shape[1]
    w = k.reliable_coassociation(seg, np.exp(-k.cluster_entropy(seg, part) / (lam * m)), m)
    ca = seg.T @ seg / m
    high, similarity = np.where(ca >= eta, ca, 0), k.jaccard(seg)
    near = (k.heat_kernel(similarity, k.adaptive_time(similarity) if time is None else time)) if diffusion else k.random_walk(similarity)
    np.fill_diagonal(near, 1)
    cannot = k.cannot_links(seg, part, 1 - near, None if diffusion else 0.8)
    must = np.where(cannot > 0, 0, k.must_links(w, ca >= theta))
    return k.fuse(*k.refine(np.diag(high.sum(1)) - high, must, cannot), w)


@pytest.mark.parametrize(("seed", "clusters", "options"), [(0, 2, {}), (1, 3, {}), (2, 2, {"diffusion": True}), (3, 3, {"diffusion": True, "time": 0.5}), (4, 2, {"theta": 1.0, "eta": 0.5}), (5, 9, {})])
def test_guided_by_classes_equals_whole_matrices(seed, clusters, options):
    """Classes of several equal objects and of one, in one matrix."""
    r = np.random.default_rng(seed)
    hidden = r.integers(0, 3, 70)
    members = np.stack([np.where(r.random(70) < 0.35, r.integers(0, clusters, 70), hidden % clusters) for _ in range(5)], 1)
    if clusters < 9:
        assert len(np.unique(members, axis=0)) < 70
    assert np.abs(k.guided(members, **options) - plain_guided(members, **options)).max() < 1e-3


def test_weighted_percentile():
    r = np.random.default_rng(0)
    v, n = np.round(r.random(40), 1), r.integers(1, 9, 40)
    for q in (0, 13, 60, 99, 100):
        assert k.weighted_percentile(v, n, q) == pytest.approx(np.percentile(np.repeat(v, n), q))


def test_random_walk_by_hand():
    """Three clusters in a chain: walks of one and two steps written out, and one cluster apart."""
    s = np.array([[1, 0.5, 0, 0], [0.5, 1, 0.25, 0], [0, 0.25, 1, 0], [0, 0, 0, 1.0]])
    p = np.array([[0, 1, 0, 0], [2 / 3, 0, 1 / 3, 0], [0, 1, 0, 0], [0, 0, 0, 0]])
    p2 = np.array([[2 / 3, 0, 1 / 3, 0], [0, 1, 0, 0], [2 / 3, 0, 1 / 3, 0], [0, 0, 0, 0]])
    want = p @ p.T + p2 @ p2.T
    root = np.sqrt(np.outer(np.diag(want), np.diag(want)))
    want = np.divide(want, root, out=np.zeros((4, 4)), where=root > 0)
    assert np.allclose(k.random_walk(s, steps=2), want) and not k.random_walk(s)[3].any()
    assert want[0, 2] == pytest.approx(1) and want[0, 1] == pytest.approx(0)


def test_links_and_fusion_by_hand():
    segments, part = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 0], [0, 1, 1.0]]), np.array([0, 0, 1, 1])
    apart = np.array([[0, 0.9, 0, 0], [0.9, 0, 0, 0], [0, 0, 0, 0.4], [0, 0, 0.4, 0]])
    # objects 0 and 1 differ in the second partition only, 0 and 2 in both, 1 and 2 in the first only
    assert np.allclose(k.cannot_links(segments, part, apart, 0.3), [[0, 0, 0.65], [0, 0, 0.45], [0.65, 0.45, 0]])
    assert np.allclose(k.cannot_links(segments, part, apart, 0.5), [[0, 0, 0.65], [0, 0, 0], [0.65, 0, 0]])
    w = np.array([[1, 0.5], [0.5, 1]])
    assert np.allclose(k.must_links(w, np.ones((2, 2), bool)), [[1, 0.8], [0.8, 1]])
    s, d = np.array([[1, 0.7], [0.7, 1]]), np.array([[0, 0.2], [0.2, 0]])
    assert np.allclose(k.fuse(s, d, w), [[1, 1 - 0.5 * 0.5], [0.75, 1]])
    assert np.allclose(k.fuse(d, s, w)[0, 1], 0.5 * 0.5)


def test_objective_by_hand():
    """Silhouette, index and agreement written out for five points in two clusters."""
    x, labels = np.array([[0.0], [1.0], [5.0], [6.0], [8.0]]), np.array([1, 1, 2, 2, 2])
    d = np.abs(x - x.T)
    s = []
    for i in range(5):
        own = [d[i, j] for j in range(5) if j != i and labels[j] == labels[i]]
        other = [d[i, j] for j in range(5) if labels[j] != labels[i]]
        a, b = np.mean(own), np.mean(other)
        s.append((b - a) / max(a, b))
    assert k.silhouette(d, labels) == pytest.approx(np.mean(s))
    c = [0.5, 19 / 3]
    spread = [0.5, np.mean([abs(v - c[1]) for v in (5, 6, 8)])]
    assert k.davies_bouldin(x, labels) == pytest.approx(sum(spread) / (c[1] - c[0]))
    assert k.silhouette(d, np.array([1, 1, 2, 2, 3])) == pytest.approx(np.mean(list(_silhouettes(d, [1, 1, 2, 2, 3]))))
    members = np.stack([labels, [1, 2, 1, 2, 1], [7] * 5], 1)
    assert k.nmi(labels, labels) == pytest.approx(1) and k.nmi(np.ones(5), np.ones(5)) == 1 and k.nmi(labels, np.ones(5)) == 0
    p = np.array([[1, 1], [2, 1]]) / 5
    mutual = sum(p[i, j] * np.log(p[i, j] / (p[i].sum() * p[:, j].sum())) for i in range(2) for j in range(2))
    h = lambda q: -sum(v * np.log(v) for v in q)
    want = 2 * mutual / (h(p.sum(1)) + h(p.sum(0)))
    assert k.nmi(labels, members[:, 1]) == pytest.approx(want)
    value = 0.4 * (np.mean(s) + 1) / 2 + 0.4 * (1 + want) / 2 + 0.2 / (1 + k.davies_bouldin(x, labels))
    assert k.objective(labels, members, x) == pytest.approx(value)
    assert k.objective(labels, members) == pytest.approx(0.2 + 0.4 * (1 + want) / 2 + 0.2 / 6) and k.objective(np.ones(5), members[:, 2:]) == pytest.approx(0.2 + 0.2 / 6)


def _silhouettes(d, labels):
    for i, own in enumerate(labels):
        mates = [d[i, j] for j in range(len(labels)) if j != i and labels[j] == own]
        other = min(np.mean([d[i, j] for j in range(len(labels)) if labels[j] == c]) for c in set(labels) - {own})
        yield (other - np.mean(mates)) / max(other, np.mean(mates)) if mates else 0.0
