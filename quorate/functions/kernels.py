"""Bounded dense kernels on NumPy arrays, for one group of a grouped map at a time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np

#: How Lance and Williams update the distance of k to the union of i and j, from (d_ki, d_kj, d_ij, n_i, n_j, n_k).
UPDATES = {
    "single": lambda a, b, c, i, j, k: np.minimum(a, b),
    "complete": lambda a, b, c, i, j, k: np.maximum(a, b),
    "average": lambda a, b, c, i, j, k: (i * a + j * b) / (i + j),
    "ward": lambda a, b, c, i, j, k: np.sqrt(np.maximum(0, ((i + k) * a**2 + (j + k) * b**2 - k * c**2) / (i + j + k))),
}


def scrambled(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers, scrambled one to one (the usual finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(x: np.ndarray) -> np.ndarray:
    """The first step of scrambled: that of x ^ y is folded(x) ^ folded(y)."""
    return x ^ (x >> np.uint64(30))


def scramble_high(x: np.ndarray, spare: np.ndarray) -> None:
    """The highest 16 bits of scrambled(y), from x = folded(y) and in its place; the last step does not change them."""
    np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
    np.right_shift(x, np.uint64(27), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint64(0x94D049BB133111EB), out=x)
    np.right_shift(x, np.uint64(48), out=x)


def linkage(dist: np.ndarray, method: str = "average", sizes: np.ndarray | None = None, digits: int | None = None) -> np.ndarray:
    """Merges (i, j, height) of agglomerative clustering; of equal distances the smallest (i, j) merges first.

    ``sizes`` are the weights of the points. Each row remembers its nearest later neighbour, so a merge costs O(n).
    ``digits`` are those that distances and heights count to, so that equal ones are equal however they were summed.
    """
    if method not in UPDATES:
        raise ValueError(f"unknown linkage {method!r}")
    exact, n = dist.astype(np.float64).copy(), len(dist)
    size, alive = np.ones(n) if sizes is None else sizes.astype(np.float64).copy(), np.ones(n, dtype=bool)
    if method == "ward" and sizes is not None:  # as if the equal objects of each point had been merged
        exact *= np.sqrt(2 * np.outer(size, size) / (size[:, None] + size))
    np.fill_diagonal(exact, np.inf)
    d = exact if digits is None else np.round(exact, digits)
    upper = np.where(np.triu(np.ones((n, n), dtype=bool), 1), d, np.inf)
    near = upper.argmin(1) if n else np.zeros(0, int)
    best = upper[np.arange(n), near] if n else np.zeros(0)
    out = np.zeros((max(0, n - 1), 3))
    for step in range(n - 1):
        i = int(best.argmin())
        j = int(near[i])
        out[step] = i, j, best[i]
        k = np.flatnonzero(alive)
        k = k[(k != i) & (k != j)]
        new = UPDATES[method](exact[i, k], exact[j, k], exact[i, j], size[i], size[j], size[k])
        exact[i, k] = exact[k, i] = new
        if digits is not None:
            d[i, k] = d[k, i] = np.round(new, digits)
        size[i] += size[j]
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
        best[j] = np.inf
        for r in {i, *k[(near[k] == i) | (near[k] == j)].tolist()}:
            row = d[r, r + 1 :]
            best[r], near[r] = (row.min(), r + 1 + int(row.argmin())) if len(row) else (np.inf, r)
        lower = k[(k < i) & (d[k, i] < best[k])]
        best[lower], near[lower] = d[lower, i], i
        equal = k[(k < i) & (d[k, i] == best[k]) & (near[k] > i)]
        near[equal] = i
    return out


def spectral(dist: np.ndarray, k: int, rng: np.random.Generator, neighbours: int = 10) -> np.ndarray:
    """Labels from 1: k-means of spectral_vectors."""
    vectors = spectral_vectors(dist, k, neighbours)
    return min((kmeans(vectors, k, rng) for _ in range(10)), key=lambda r: r[1])[0] + 1


def spectral_vectors(dist: np.ndarray, k: int, neighbours: int = 10) -> np.ndarray:
    """The k lowest eigenvectors of the normalised Laplacian of the symmetric neighbour graph.

    A point is one of its own neighbours; rows of the eigenvectors are divided by the root of their degree.
    """
    n = len(dist)
    near = np.argsort(dist, axis=1, kind="stable")[:, : min(neighbours, max(2, n - 1))]
    graph = np.zeros((n, n))
    graph[np.arange(n)[:, None], near] = 1
    graph = (graph + graph.T) / 2
    np.fill_diagonal(graph, 0)
    root = np.sqrt(np.maximum(graph.sum(1), 1e-12))
    return np.linalg.eigh(np.eye(n) - graph / np.outer(root, root))[1][:, :k] / root[:, None]


def joined(merges: np.ndarray, n: int, height: float) -> np.ndarray:
    """Labels from 1, in order of first members, of what the merges up to a height connect."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, j, h in merges:
        if h <= height:
            a, b = find(int(i)), find(int(j))
            root[max(a, b)] = min(a, b)
    return np.unique([find(x) for x in range(n)], return_inverse=True)[1] + 1


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels from 1, in order of first members, at the smallest height that leaves k clusters or fewer."""
    return joined(merges, n, np.sort(merges[:, 2])[n - k - 1] if n > k else -np.inf)


def consensus_labels(similarity: np.ndarray, k: int, method: str = "average", sizes: np.ndarray | None = None, digits: int | None = None) -> np.ndarray:
    """Cut of the hierarchy on 1 - similarity."""
    far = 1 - np.clip(np.maximum(similarity, similarity.T), 0, 1)
    return cut(linkage(far if digits is None else np.round(far, digits), method, sizes, digits), len(far), k)


def class_labels(similarity: np.ndarray, n: np.ndarray, k: int, method: str = "average", digits: int | None = None, most: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, rank, label): consensus_labels of objects in classes of equal ones, n in each; the diagonal is the similarity within a class.

    A class whose objects are no farther from each other than from any others merges first, at one height, so it is a point of
    n objects (single, complete and average linkage). The objects of other classes are points of their own, in the order of class
    and rank, and more than ``most`` points raise. Rank -1 stands for all objects of a class.
    """
    if method == "ward":
        raise ValueError("equal objects that are apart are no point of ward linkage")
    far = 1 - np.clip(np.maximum(similarity, similarity.T), 0, 1)
    far = far if digits is None else np.round(far, digits)
    own, n = far.diagonal().copy(), n.astype(np.int64)
    np.fill_diagonal(far, np.inf)
    apart = (n > 1) & (own > far.min(1))
    np.fill_diagonal(far, own)
    size = np.where(apart, 1, n)
    at = np.repeat(np.arange(len(n)), np.where(apart, n, 1))
    if len(at) > most:
        raise ValueError(f"{len(at)} points in a run; max_n is {most}")
    merges = linkage(far[np.ix_(at, at)] if apart.any() else far, method, size[at], digits)
    heights = np.sort(np.concatenate([merges[:, 2], np.repeat(own, size - 1)]))
    height = heights[n.sum() - k - 1] if n.sum() > k else -np.inf
    labels, rank = joined(merges, len(at), height), np.where(apart[at], np.arange(len(at)) - np.searchsorted(at, at), -1)
    loose = np.flatnonzero((size > 1) & (own > height))  # of few objects, each a cluster
    rank[np.isin(at, loose)] = 0
    more = np.repeat(loose, size[loose] - 1)
    later = np.arange(len(more)) - np.searchsorted(more, more) + 1
    return np.concatenate([at, more]), np.concatenate([rank, later]), np.concatenate([labels, labels.max(initial=0) + 1 + np.arange(len(more))])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, iterations: int = 50) -> tuple[np.ndarray, float]:
    """Lloyd's algorithm from random points: labels from 0 and the cost."""
    return lloyd(x, x[rng.choice(len(x), min(k, len(x)), replace=False)], iterations)


def starting(ids: np.ndarray, seed: int, job: int) -> np.ndarray:
    """Hashes of ids: a k-means starts from some of the objects of the smallest ones."""
    salt = scrambled(np.array([seed, job], dtype=np.int64).view(np.uint64))
    return scrambled(ids.astype(np.int64).view(np.uint64) ^ salt[0] ^ scrambled(salt[1:])[0])


#: Objects of the smallest hashes for each centre that a k-means starts from.
CANDIDATES = 4


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """The first of some rows, and then k - 1 times the one that is farthest from those chosen."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return x[chosen]


def hashed_kmeans(x: np.ndarray, ids: np.ndarray, k: int, seed: int, job: int, iterations: int = 50) -> tuple[np.ndarray, float]:
    """Lloyd's algorithm from k of the objects of the smallest hashes, as clustering.lloyd does it over all tasks: labels from 0 and the cost."""
    return lloyd(x, spread_out(x[np.lexsort((ids, starting(ids, seed, job)))[: CANDIDATES * k]], k), iterations)


def lloyd(x: np.ndarray, centres: np.ndarray, iterations: int = 50) -> tuple[np.ndarray, float]:
    """Lloyd's algorithm: labels from 0 and the cost; a centre without points stays where it is."""
    labels = np.full(len(x), -1)
    square = np.concatenate([(x[at : at + 8192] ** 2).sum(1) for at in range(0, len(x), 8192)])[:, None]  # no second x at a time
    for _ in range(iterations):
        d = square - x @ (2 * centres.T) + (centres**2).sum(1)
        new = d.argmin(1)
        if (new == labels).all():
            break
        labels = new
        n = np.bincount(labels, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, labels, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return labels, float(np.maximum(d.min(1), 0).sum())


def pairwise(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)))


def one_hot(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster indicators (clusters by objects) of a matrix objects by partitions, and the partition of each cluster."""
    rows, part = [], []
    for p in range(members.shape[1]):
        for c in np.unique(members[:, p]):
            rows.append(members[:, p] == c)
            part.append(p)
    return np.array(rows, dtype=np.float64), np.array(part)


def jaccard(segments: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Overlap of clusters; n are the weights of the objects."""
    weighted = segments if n is None else segments * n
    both, size = weighted @ segments.T, weighted.sum(1)
    union = size[:, None] + size - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def cluster_entropy(segments: np.ndarray, part: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """log2 entropy of each cluster summed over all partitions, over log2 of its own partition's number of clusters."""
    weighted = segments if n is None else segments * n
    p = weighted @ segments.T / weighted.sum(1)[:, None]
    h = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1)
    k = np.bincount(part)[part]
    return np.divide(h, np.log2(np.maximum(k, 2)), out=np.zeros_like(h), where=k > 1)


def reliable_coassociation(segments: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    w = (segments * weight[:, None]).T @ segments / m
    w = (w + w.T) / 2
    w /= max(w.max(), 1e-300)
    np.fill_diagonal(w, 1)
    return w


def scaled_to_diagonal(o: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.outer(np.diag(o), np.diag(o)))
    return np.divide(o, root, out=np.zeros_like(o), where=root > 0)


def random_walk(similarity: np.ndarray, steps: int = 20, beta: float = 1.0) -> np.ndarray:
    """Similarity of the walks that start at two clusters, over all lengths up to ``steps``."""
    w = similarity.copy()
    np.fill_diagonal(w, 0)
    total = w.sum(1, keepdims=True)
    walk = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    at, out = walk.copy(), walk @ walk.T
    for _ in range(steps - 1):
        at = at @ walk
        out += beta * at @ at.T
    out = scaled_to_diagonal(out)
    alone = total[:, 0] <= 0
    out[alone, :] = out[:, alone] = 0
    return out


def laplacian(similarity: np.ndarray) -> np.ndarray:
    w = similarity.copy()
    np.fill_diagonal(w, 0)
    d = w.sum(1)
    r = np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    return np.eye(len(w)) - r[:, None] * w * r


def heat_kernel(similarity: np.ndarray, t: float) -> np.ndarray:
    """exp(-t L) of the normalised Laplacian, scaled to a unit diagonal; at t = 0 the identity."""
    value, vector = np.linalg.eigh(laplacian(similarity))
    out = np.clip(scaled_to_diagonal((vector * np.exp(-t * value)) @ vector.T), 0, 1)
    np.fill_diagonal(out, 1)
    return out


def adaptive_time(similarity: np.ndarray) -> float:
    """1 over the second smallest eigenvalue of the Laplacian, within [0.1, 5]; 1 where that says nothing."""
    if len(similarity) < 2 or not (similarity - np.diag(np.diag(similarity))).any():
        return 1.0
    second = np.linalg.eigvalsh(laplacian(similarity))[1]
    return 1.0 if not np.isfinite(second) or second < 1e-6 else float(np.clip(1 / second, 0.1, 5))


def weighted_percentile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """np.percentile of each value repeated by its count."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    place = (upto[-1] - 1) * q / 100
    low, high = (values[order][np.searchsorted(upto, x, side="right")] for x in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def cannot_links(segments: np.ndarray, part: np.ndarray, apart: np.ndarray, tau: float | None, percentile: float = 60, n: np.ndarray | None = None) -> np.ndarray:
    """Mean over partitions of the dissimilarity of two objects' clusters; values below tau (or the percentile of positive ones) are 0."""
    m, size = part.max() + 1, segments.shape[1]
    d = np.zeros((size, size))
    for p in range(m):
        own = np.flatnonzero(part == p)
        s = segments[own]
        d += s.T @ apart[np.ix_(own, own)] @ s
    d /= m
    if tau is None:
        positive = d > 1e-9
        counts = np.ones(d.shape) if n is None else np.outer(n, n)
        tau = weighted_percentile(d[positive], counts[positive], percentile) if positive.any() else 0.0
    d[d < tau] = 0
    return d


def must_links(w: np.ndarray, mask: np.ndarray) -> np.ndarray:
    if not mask.any():
        return np.zeros_like(w)
    low, high = w[mask].min(), w[mask].max()
    scaled = (w - low) / (high - low) / 5 + 0.8 if high > low else np.full_like(w, 0.8)
    return np.where(mask, scaled, 0)


def refine(lap: np.ndarray, must: np.ndarray, cannot: np.ndarray, iterations: int = 120, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and dissimilarity that are smooth on the graph and keep the links: alternating directions.

    All systems share the eigenvectors of the Laplacian, so it is decomposed once.
    """
    value, vector = np.linalg.eigh((lap + lap.T) / 2)
    sym = lambda a: (a + a.T) / 2

    def solve(mu: float, right: np.ndarray) -> np.ndarray:
        return sym((vector / (2 * value + 2 * mu)) @ (vector.T @ right))

    n, mu = len(lap), 1.0
    s, d, f1, f2, y1, y2 = (np.zeros((n, n)) for _ in range(6))
    for _ in range(iterations):
        s0, d0 = s, d
        s = solve(mu, 2 * mu * f1 - d - y1)
        f1 = sym(np.clip((y1 / (2 * mu) + s) * (must == 0), 0, 1) + must)
        d = solve(mu, 2 * mu * f2 - s - y2)
        f2 = sym(np.clip((y2 / (2 * mu) + d) * (cannot == 0), 0, 1) + cannot)
        y1, y2 = y1 + mu * (s - f1), y2 + mu * (d - f2)
        mu = min(mu * 1.1, 1e6)
        if max(np.linalg.norm(x) for x in (s - s0, d - d0, s - f1, d - f2)) < tol:
            break
    return s, d


def fuse(s: np.ndarray, d: np.ndarray, w: np.ndarray) -> np.ndarray:
    s, d = (np.clip((x + x.T) / 2, 0, 1) for x in (s, d))
    return np.where(s >= d, 1 - (1 - s + d) * (1 - w), (1 + s - d) * w)


def refine_classes(high: np.ndarray, n: np.ndarray, must: tuple, cannot: tuple, iterations: int = 120, tol: float = 1e-3, threads: int = 1) -> tuple[tuple, tuple]:
    """``refine`` for objects in classes of equal ones: n objects in each, high between classes.

    Matrices that are constant between and within classes but for the diagonal are closed under what refine does, so each
    is a pair: its entries by class, and its diagonal. A product with the inverse of the Laplacian plus a constant is one
    with an inverse by class, once the diagonal's own part is taken off. Single precision suffices for ``tol``. Rows are
    taken in slices, by ``threads`` threads.
    """
    root = np.sqrt(n)
    degree = high @ n
    value, vector = np.linalg.eigh(np.diag(degree) - root[:, None] * high * root)
    left, right = (vector / root[:, None]).astype(np.float32), (vector.T * root).astype(np.float32)
    del vector
    twice, own, weight = (2 * high).astype(np.float32), np.arange(len(n)), n.astype(np.float32)
    must, cannot = ((a.astype(np.float32), b) for a, b in (must, cannot))
    mu, count = 1.0, len(n)
    zero = lambda: [np.zeros(high.shape, np.float32), np.zeros(count)]
    s, d, f1, f2, y1, y2 = (zero() for _ in range(6))
    x, out, inverse = (np.empty(high.shape, np.float32) for _ in range(3))

    with ThreadPoolExecutor(threads) as pool:

        def by_rows(work: Callable[[slice], object], step: int) -> list:
            return list(pool.map(work, [slice(at, min(at + step, count)) for at in range(0, count, step)]))

        def product(a: np.ndarray, b: np.ndarray, to: np.ndarray) -> None:
            by_rows(lambda r: np.matmul(a[r], b, out=to[r]), -(-count // threads))

        def step(this: list, f: list, other: list, y: list, link: tuple) -> float:
            """One matrix, its bounded copy and its multipliers in place; the largest of its two changes."""
            inner = 2 * mu * f[0][own, own] - other[0][own, own] - y[0][own, own]
            diagonal = 2 * mu * f[1] - other[1] - y[1]
            alone = (diagonal - inner) / (2 * degree + 2 * mu)
            single = alone.astype(np.float32)

            def right_side(r: slice) -> None:
                x[r] = 2 * mu * f[0][r] - other[0][r] - y[0][r] + twice[r] * single

            by_rows(right_side, 64)
            product(inverse, x, out)

            def bounded(r: slice) -> float:
                new = (out[r] + out[:, r].T) / 2
                moved = ((new - this[0][r]) ** 2 @ weight).astype(float)
                this[0][r] = new
                x[r] = np.where(link[0][r] == 0, np.clip(y[0][r] / (2 * mu) + new, 0, 1), link[0][r])
                return n[r] @ moved

            def even(r: slice) -> float:
                f[0][r] = (x[r] + x[:, r].T) / 2  # links at the edge of a threshold may count in one direction only
                off = this[0][r] - f[0][r]
                y[0][r] += mu * off
                return n[r] @ (off**2 @ weight).astype(float)

            was = this[0][own, own].astype(float), this[1]
            total = np.array([sum(by_rows(bounded, 64)), sum(by_rows(even, 64))])
            now = this[0][own, own].astype(float)
            this[1] = now + alone
            f[1] = np.where(link[1] == 0, np.clip(y[1] / (2 * mu) + this[1], 0, 1), link[1])
            inside = np.array([n @ (now - was[0]) ** 2, n @ (now - f[0][own, own]) ** 2])
            diagonals = np.array([n @ (this[1] - was[1]) ** 2, n @ (this[1] - f[1]) ** 2])
            y[1] = y[1] + mu * (this[1] - f[1])
            return float(np.sqrt(np.maximum(0, total - inside + diagonals)).max())

        for _ in range(iterations):
            product(left / (2 * value + 2 * mu).astype(np.float32), right, inverse)
            change = max(step(s, f1, d, y1, must), step(d, f2, s, y2, cannot))
            mu = min(mu * 1.1, 1e6)
            if change < tol:
                break
    return tuple(s), tuple(d)


def guided(members: np.ndarray, lam: float = 0.09, eta: float = 0.75, theta: float = 0.65, weight: np.ndarray | None = None, time: float | None = None, diffusion: bool = False, tau: float | None = None, counts: np.ndarray | None = None, threads: int = 1) -> np.ndarray:
    """Consensus matrix guided by must and cannot links; with ``diffusion`` cluster similarity is a heat kernel (time None: adaptive).

    ``tau`` is the least dissimilarity that is a cannot link: 0.8, or by a percentile with ``diffusion``, if it is None.

    Objects with equal rows are one class. ``weight`` goes by the clusters of one_hot(members). With ``counts`` the rows are
    classes already, with so many objects, and so are those of the result, whose diagonal is the similarity within a class.
    """
    if counts is None:
        classes, back, n = np.unique(members, axis=0, return_inverse=True, return_counts=True)
    else:
        order = np.lexsort(members.T[::-1])
        classes, back, n = members[order], np.argsort(order), counts[order]
    back, n = back.ravel(), n.astype(float)
    segments, part = one_hot(classes)
    m, alone = members.shape[1], n == 1
    neci = np.exp(-cluster_entropy(segments, part, n) / (lam * m)) if weight is None else weight
    w = (segments * neci[:, None]).T @ segments / m
    w /= max(w.max(), 1e-300)
    ones = np.ones(len(n))

    def spread(x: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        out = x[np.ix_(back, back)]
        if counts is None:
            np.fill_diagonal(out, diagonal[back])
        return out

    if eta > 1:
        return spread(w, ones)
    ca = segments.T @ segments / m
    similarity = jaccard(segments, n)
    if diffusion:
        near = heat_kernel(similarity, adaptive_time(similarity) if time is None else time)
    else:
        near = random_walk(similarity)
    np.fill_diagonal(near, 1)
    cannot = cannot_links(segments, part, 1 - near, tau if tau is not None else None if diffusion else 0.8, n=n)
    # the weights of linked pairs: an object alone in its class has no pair there, and every object is linked with itself
    mask = ca >= theta
    real = mask & ~np.diag(alone)
    low, high = (float(f(w[real], initial=1.0)) for f in (np.min, np.max)) if theta <= 1 else (0.0, 0.0)
    scale = lambda x: (x - low) / (high - low) / 5 + 0.8 if high > low else np.full_like(x, 0.8)
    must = np.where(mask & (cannot <= 0), scale(w), 0).astype(np.float32), np.where(np.diag(cannot) > 0, 0, scale(ones)) * (theta <= 1)
    cannot = cannot.astype(np.float32), np.diag(cannot).copy()
    high = np.where(ca >= eta, ca, 0)
    del ca, mask, real
    s, d = refine_classes(high, n, must, cannot, threads=threads)
    return spread(fuse(s[0].astype(float), d[0].astype(float), w), fuse(s[1], d[1], ones))


def nmi(a: np.ndarray, b: np.ndarray) -> float:
    """Mutual information of two labelings over the mean of their entropies; 1 if both have one cluster."""
    x, y = (np.unique(v, return_inverse=True)[1].ravel() for v in (a, b))
    p = np.bincount(x * (y.max() + 1) + y, minlength=(x.max() + 1) * (y.max() + 1)).reshape(x.max() + 1, -1) / len(x)
    px, py = p.sum(1), p.sum(0)
    if len(px) == len(py) == 1:
        return 1.0
    mutual = (p[p > 0] * np.log(p[p > 0] / np.outer(px, py)[p > 0])).sum()
    return 0.0 if abs(mutual) < 1e-12 else float(max(0.0, 2 * mutual / -((px * np.log(px)).sum() + (py * np.log(py)).sum())))


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; a point alone in its cluster has 0."""
    k = np.unique(labels, return_inverse=True)[1].ravel()
    onto = np.eye(k.max() + 1)[k]
    n = onto.sum(0)
    mean = dist @ onto / np.maximum(n - onto, 1)  # the own cluster without the point itself
    own = (mean * onto).sum(1)
    other = np.where(onto > 0, np.inf, mean).min(1)
    return float(np.where(n[k] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0).mean())


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean over clusters of the largest (spread + spread) / distance of centres; equal centres count 0."""
    k = np.unique(labels, return_inverse=True)[1].ravel()
    n = np.bincount(k)
    centre = np.zeros((len(n), x.shape[1]))
    np.add.at(centre, k, x)
    centre /= n[:, None]
    spread = np.bincount(k, weights=np.sqrt(((x - centre[k]) ** 2).sum(1))) / n
    apart = pairwise(centre)
    np.fill_diagonal(apart, np.inf)
    ratio = np.divide(spread[:, None] + spread, apart, out=np.zeros_like(apart), where=apart > 1e-12)
    return float(ratio.max(1).mean())


def objective(labels: np.ndarray, members: np.ndarray, x: np.ndarray | None = None) -> float:
    """How good a labeling is without any ground truth: 0.4 for its silhouette, 0.4 for its mean NMI with the base partitions, 0.2 for its Davies-Bouldin index, each in [0, 1].

    Without features, or with one cluster or as many as points, the silhouette counts as 0 and the index as 5.
    """
    clusters = len(np.unique(labels))
    clear, mixed = (silhouette(pairwise(x), labels), davies_bouldin(x, labels)) if x is not None and 1 < clusters < len(labels) else (0.0, 5.0)
    agree = [nmi(labels, p) for p in members.T if len(np.unique(p)) > 1]
    return 0.4 * (clear + 1) / 2 + 0.4 * (float(np.mean(agree)) if agree else 0.0) + 0.2 / (1 + mixed)


def greedy_subset(agreement: np.ndarray, m: int, alpha: float = 0.5) -> list[int]:
    """Quality and diversity: start with the best partition, then add what has most quality and least agreement with those chosen."""
    n = len(agreement)
    if m >= n:
        return list(range(n))
    quality = (agreement.sum(1) - np.diag(agreement)) / (n - 1) if n > 1 else np.ones(1)
    chosen = [int(quality.argmax())]
    while len(chosen) < m:
        rest = [p for p in range(n) if p not in chosen]
        gain = [alpha * quality[p] + (1 - alpha) * (1 - agreement[p, chosen]).mean() for p in rest]
        chosen.append(rest[int(np.argmax(gain))])
    return chosen


def exact_wilcoxon(statistic: float, n: int) -> float:
    """Two-sided p of the signed-rank sum: counted exactly up to 50 values without ties, else the normal approximation."""
    if n == 0:
        return 1.0
    if n <= 50 and float(statistic).is_integer():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(statistic) + 1].sum() / 2.0**n))
    from math import erfc, sqrt

    z = (statistic - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return float(min(1.0, erfc(-z / sqrt(2)) if z < 0 else 1.0))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f), by the continued fraction of the incomplete beta function."""
    from math import exp, inf, lgamma, log

    if f == inf:
        return 0.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x in (0.0, 1.0):
        return x

    def fraction(a: float, b: float, x: float) -> float:
        c, d, h = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + top * d), 1 + top / c
                h *= d * c
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
