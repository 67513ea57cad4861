"""Synthetic data sets. The driver plans the clusters (a few rows); tasks draw the points, each cluster from its own generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points that one task draws of a cluster.
CHUNK = 100_000


def cluster_sizes(n: int, k: int, ratio: float, rng: np.random.Generator) -> np.ndarray:
    """k sizes of at least 1 that add up to n; the largest is about ``ratio`` times the smallest."""
    if k < 1 or n < k or ratio < 1:
        raise ValueError("1 <= k <= n and ratio >= 1 are needed")
    share = np.exp(np.linspace(0, np.log(ratio), k) if k > 1 else np.zeros(1)) * np.exp(rng.normal(0, 0.02, k))
    exact = share / share.sum() * n
    sizes = np.maximum(1, np.floor(exact)).astype(int)
    while sizes.sum() != n:
        gap = exact - sizes
        sizes[gap.argmax() if sizes.sum() < n else sizes.argmax()] += 1 if sizes.sum() < n else -1
    return rng.permutation(sizes)


def rotation(d: int, rng: np.random.Generator) -> np.ndarray:
    q, r = np.linalg.qr(rng.normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def draw(spark: SparkSession, clusters: list[dict], seed: int) -> DataFrame:
    """(obj_id, features, gt) of planned clusters: label, size, center, axes (rows scaled by their lengths) and radial law."""
    plan, first = [], 0
    for c in clusters:
        for at in range(0, c["size"], CHUNK):
            plan.append((len(plan), first + at, min(CHUNK, c["size"] - at), int(c["label"]), [float(v) for v in c["center"]], [[float(v) for v in row] for row in c["axes"]], c.get("law", "normal")))
        first += c["size"]
    tasks = spark.createDataFrame(plan, "task int, first long, size long, gt long, center array<double>, axes array<array<double>>, law string")

    def points(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        rng, n, axes = np.random.default_rng([seed, int(r["task"])]), int(r["size"]), np.stack(r["axes"])
        z = rng.normal(size=(n, len(axes)))
        if r["law"] != "normal":
            radius = {"lognormal": lambda: rng.lognormal(0, 0.55, n), "exponential": lambda: rng.exponential(1, n), "student": lambda: np.abs(rng.standard_t(3, n)), "uniform": lambda: rng.uniform(0, 1.5, n), "ball": lambda: rng.uniform(0, 1, n) ** (1 / len(axes))}[r["law"]]()
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) * radius[:, None]
        x = z @ axes + np.asarray(r["center"])
        return pd.DataFrame({"obj_id": int(r["first"]) + np.arange(n), "features": list(x), "gt": int(r["gt"])})

    return tasks.groupBy("task").applyInPandas(points, "obj_id long, features array<double>, gt long")


def gaussian(spark: SparkSession, n: int = 300, k: int = 3, d: int = 2, std: float = 0.5, separation: float = 5.0, ratio: float = 1.0, seed: int = 19) -> DataFrame:
    """Round clusters around random centres at least ``separation`` standard deviations of 1 apart, where that can be had."""
    rng = np.random.default_rng(seed)
    centers: list[np.ndarray] = []
    while len(centers) < k:
        tries = rng.uniform(-separation * k, separation * k, (200, d))
        gap = [min((np.linalg.norm(t - c) for c in centers), default=np.inf) for t in tries]
        centers.append(next((t for t, g in zip(tries, gap, strict=True) if g >= separation), tries[int(np.argmax(gap))]))
    sizes = cluster_sizes(n, k, ratio, rng)
    return draw(spark, [{"label": i + 1, "size": int(s), "center": c, "axes": np.eye(d) * std} for i, (s, c) in enumerate(zip(sizes, centers, strict=True))], seed)


def geometric_values(k: int, mean: float, ratio: float, rng: np.random.Generator) -> np.ndarray:
    """k values with the given geometric mean whose largest is ``ratio`` times the smallest."""
    logs = np.sort(rng.uniform(0, 1, k))
    logs = (logs - logs[0]) / (logs[-1] - logs[0]) if k > 1 and logs[-1] > logs[0] else np.zeros(k)
    logs = logs * np.log(ratio)
    return rng.permutation(mean * np.exp(logs - logs.mean()))


def archetype(spark: SparkSession, n: int = 300, k: int = 4, d: int = 2, aspect: float = 1.5, aspect_ratio: float = 2.0, radius_ratio: float = 2.0, imbalance: float = 2.0, min_overlap: float = 0.0, max_overlap: float = 0.05, laws: tuple[str, ...] = ("normal",), seed: int = 19) -> DataFrame:
    """Ellipsoids of given aspect, size and imbalance ratios, placed so that no two overlap more than max_overlap and some two at least min_overlap.

    Overlap is 2 / (1 + exp(2.3 (s - 1.6))) of the distance s in radii; after 5000 tries the last placement is widened.
    """
    rng = np.random.default_rng(seed)
    radii, aspects, sizes = geometric_values(k, 1.0, radius_ratio, rng), geometric_values(k, aspect, aspect_ratio, rng), cluster_sizes(n, k, imbalance, rng)
    overlap = lambda s: 2 / (1 + np.exp(np.minimum(2.3 * (s - 1.6), 700)))
    spread = 2.0 * k ** (1 / d)
    for attempt in range(5000):
        centers = rng.uniform(-spread, spread, (k, d))
        gaps = np.array([overlap(np.linalg.norm(centers[i] - centers[j]) / ((radii[i] + radii[j]) / 2)) for i in range(k) for j in range(i)])
        if not len(gaps) or (gaps.max() <= max_overlap and gaps.max() >= min_overlap):
            break
        spread *= 1.002 if gaps.max() > max_overlap else 0.998
    plan = []
    for i in range(k):
        lengths = geometric_values(d, radii[i] / 3, aspects[i], rng)
        plan.append({"label": i + 1, "size": int(sizes[i]), "center": centers[i], "axes": lengths[:, None] * rotation(d, rng), "law": laws[int(rng.integers(len(laws)))]})
    return draw(spark, plan, seed)


def density(spark: SparkSession, n: int = 300, k: int = 3, d: int = 2, cores: int = 8, eps: float = 1.0, momentum: float = 0.5, branch: float = 0.1, noise: float = 0.0, min_points: int = 3, seed: int = 19) -> DataFrame:
    """Clusters along skeletons of cores less than eps apart, different skeletons more than 2.5 eps apart; noise has label 0.

    A skeleton grows by momentum from its last core, or from a random one with probability ``branch``.
    """
    if n < k * cores * min_points:
        raise ValueError("n is too small for min_points in every core")
    rng, skeletons = np.random.default_rng(seed), []
    unit = lambda: (v := rng.normal(size=d)) / np.linalg.norm(v)
    for _ in range(k):
        for restart in range(200):
            at = [rng.uniform(-3, 3, d) * eps * k * (1 + restart / 20)]
            heading, tries = unit(), 0
            while len(at) < cores and tries < 300 * cores:
                tries += 1
                anchor = at[int(rng.integers(len(at)))] if rng.random() < branch else at[-1]
                step = momentum * heading + (1 - momentum) * unit()
                new = anchor + step / np.linalg.norm(step) * eps * rng.uniform(0.55, 0.95)
                if all(np.linalg.norm(new - c) > 0.3 * eps for c in at):
                    heading = (new - anchor) / np.linalg.norm(new - anchor)
                    at.append(new)
            far = all(np.linalg.norm(a - b) > 2.5 * eps for a in at for s in skeletons for b in s)
            if len(at) == cores and far:
                break
        else:
            raise ValueError("no room for another cluster")
        skeletons.append(at)
    n_noise = int(n * noise)
    spare = rng.multinomial(n - n_noise - k * cores * min_points, np.full(k * cores, 1 / (k * cores)))
    plan = [{"label": i + 1, "size": int(min_points + spare[i * cores + j]), "center": c, "axes": np.eye(d) * 0.25 * eps, "law": "ball"} for i, s in enumerate(skeletons) for j, c in enumerate(s)]
    out = draw(spark, plan, seed)
    if not n_noise:
        return out
    every = np.concatenate([np.stack(s) for s in skeletons])
    low, high = every.min(0) - 0.25 * np.ptp(every, axis=0), every.max(0) + 0.25 * np.ptp(every, axis=0)
    found: list[np.ndarray] = []
    while len(found) < n_noise:
        p = rng.uniform(low, high)
        if np.linalg.norm(every - p, axis=1).min() > 1.25 * eps:
            found.append(p)
        else:
            low, high = low - 0.001 * eps, high + 0.001 * eps
    extra = draw(spark, [{"label": 0, "size": 1, "center": p, "axes": np.zeros((d, d))} for p in found], seed)
    return out.unionByName(extra.withColumn("obj_id", F.col("obj_id") + (n - n_noise)))


def separation_index(gap: np.ndarray, a: np.ndarray, b: np.ndarray, z: float = 1.645) -> float:
    """Largest (aD - z(s1 + s2)) / (aD + z(s1 + s2)) over directions a of the gap D between two clusters, by projected gradient steps."""
    direction = np.linalg.solve(a + b + 1e-9 * np.eye(len(a)), gap)
    best = -1.0
    for _ in range(60):
        s1, s2 = np.sqrt(direction @ a @ direction), np.sqrt(direction @ b @ direction)
        along = abs(direction @ gap)
        best = max(best, (along - z * (s1 + s2)) / (along + z * (s1 + s2)))
        direction = np.linalg.solve(a / max(s1, 1e-12) + b / max(s2, 1e-12) + 1e-12 * np.eye(len(a)), gap)
    return float(best)


def separated(spark: SparkSession, n: int = 300, k: int = 3, d: int = 2, separation: float = 0.2, outliers: float = 0.05, noise_features: int = 0, eigen_ratio: float = 5.0, rotate: bool = True, seed: int = 19) -> DataFrame:
    """Gaussian clusters on a simplex whose smallest pairwise separation index is ``separation``; outliers have label k + 1."""
    if k < 2 or d < 1 or not -0.99 < separation < 0.99 or not 0 <= outliers < 1 or noise_features < 0 or n < 2 * k or eigen_ratio < 1:
        raise ValueError("k >= 2, d >= 1, |separation| < 0.99, 0 <= outliers < 1, noise_features >= 0, n >= 2 k and eigen_ratio >= 1 are needed")
    rng = np.random.default_rng(seed)
    covariances = []
    for _ in range(k):
        q = rotation(d, rng)
        covariances.append(q * rng.uniform(1, eigen_ratio, d) @ q.T)
    centers = np.zeros((k, d))
    for i in range(1, k):
        centers[i, (i - 1) % d] = 1 + (i - 1) // d
    pairs = [(i, j) for i in range(k) for j in range(i)]
    smallest = lambda s: min(separation_index(s * (centers[i] - centers[j]), covariances[i], covariances[j]) for i, j in pairs)
    low, high = 1e-3, 1.0
    while smallest(high) < separation:
        high *= 2
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if smallest(mid) < separation else (low, mid)
    centers = centers * high
    turn = rotation(d, rng) if rotate else np.eye(d)
    n_out = int(n * outliers)
    sizes = cluster_sizes(n - n_out, k, 1.5, rng)
    pad = lambda m: np.block([[m, np.zeros((d, noise_features))], [np.zeros((noise_features, d)), np.eye(noise_features)]])
    wide = lambda v: np.concatenate([v, np.zeros(noise_features)])
    plan = [{"label": i + 1, "size": int(sizes[i]), "center": wide(centers[i] @ turn), "axes": pad(np.linalg.cholesky(covariances[i]).T @ turn)} for i in range(k)]
    spread = np.sqrt(np.mean([np.trace(c) / d for c in covariances])) * 4 + centers.std()
    plan += [{"label": k + 1, "size": 1, "center": wide(centers.mean(0) @ turn + rng.uniform(-spread, spread, d)), "axes": np.zeros((d + noise_features, d + noise_features))} for _ in range(n_out)]
    return draw(spark, plan, seed)


#: Spread of clusters and distance of their centres by difficulty, for all scenarios and for 'overlap'. Fixed values.
SPREAD = {"easy": (0.4, 5.0), "medium": (0.7, 3.5), "hard": (1.1, 2.0)}
SPREAD_OVERLAP = {"easy": (1.0, 2.5), "medium": (1.5, 1.8), "hard": (2.2, 1.2)}

#: What else a scenario sets by difficulty. Fixed values.
ASPECT = {"easy": 3.0, "medium": 7.0, "hard": 14.0}
IMBALANCE = {"easy": 3.0, "medium": 6.0, "hard": 12.0}
NOISE = {"easy": 0.05, "medium": 0.1, "hard": 0.2}
BRANCH = {"easy": 0.02, "medium": 0.06, "hard": 0.12}

SCENARIOS = ("compact", "overlap", "elongated", "density", "highdim", "imbalance")


def scenario(spark: SparkSession, name: str, n: int = 300, k: int = 3, d: int = 2, difficulty: str = "medium", seed: int = 19) -> DataFrame:
    """(obj_id, features, gt) of one of SCENARIOS at one of three difficulties."""
    if name not in SCENARIOS or difficulty not in SPREAD:
        raise ValueError(f"unknown scenario {name!r} or difficulty {difficulty!r}")
    std, gap = (SPREAD_OVERLAP if name == "overlap" else SPREAD)[difficulty]
    if name == "elongated":
        return archetype(spark, n, k, d, aspect=ASPECT[difficulty], aspect_ratio=2.0, imbalance=1.0, seed=seed)
    if name == "density":
        return density(spark, n, k, d, noise=NOISE[difficulty], branch=BRANCH[difficulty], seed=seed)
    return gaussian(spark, n, k, max(d, 20) if name == "highdim" else d, std, gap, IMBALANCE[difficulty] if name == "imbalance" else 1.0, seed)


#: Types of a suite's data sets: generator, choices of dimensions, ranges of its parameters. Fixed values.
SUITE = {
    "compact": ("gaussian", (2, 3, 5), {"std": (0.18, 0.35), "separation": (5.5, 8.0), "ratio": (1.0, 1.4)}),
    "overlapping": ("gaussian", (2, 3, 5, 10), {"std": (0.65, 1.15), "separation": (1.8, 3.0), "ratio": (1.0, 1.8)}),
    "imbalanced": ("gaussian", (2, 5, 10), {"std": (0.35, 0.75), "separation": (3.2, 5.5), "ratio": (3.0, 8.0)}),
    "high_dimensional": ("gaussian", (10, 20, 50, 100), {"std": (0.45, 0.95), "separation": (2.4, 4.8), "ratio": (1.0, 2.5)}),
    "elongated": ("archetype", (2, 3, 5, 10), {"aspect": (4.5, 7.0), "aspect_ratio": (4.0, 8.0), "radius_ratio": (1.5, 3.0), "min_overlap": (0.02, 0.08), "max_overlap": (0.12, 0.28), "imbalance": (1.5, 3.5)}),
    "density_varied": ("density", (2, 3, 5), {"noise": (0.04, 0.14), "momentum": (0.0, 0.45), "branch": (0.0, 0.08)}),
    "mixed_complex": ("archetype", (10, 20, 50), {"aspect": (4.5, 7.0), "aspect_ratio": (4.0, 8.0), "radius_ratio": (2.0, 4.0), "min_overlap": (0.04, 0.12), "max_overlap": (0.18, 0.35), "imbalance": (3.0, 7.0)}),
}


def suite_plan(spark: SparkSession, count: int, seed: int = 19, folds: int = 5, n: tuple[int, int] = (300, 600), k: tuple[int, int] = (3, 7), max_guided: int = 650) -> DataFrame:
    """The manifest of ``count`` data sets, the types in turn: one row each, with its parameters as JSON, its split and its fold."""
    import json

    from quorate.operators.reports import stratified_split

    rng, rows = np.random.default_rng(seed), []
    for i in range(count):
        kind = list(SUITE)[i % len(SUITE)]
        generator, dims, ranges = SUITE[kind]
        params = {p: round(float(rng.uniform(low, high)), 6) for p, (low, high) in ranges.items()}
        size = int(rng.integers(n[0], n[1] + 1))
        rows.append((f"{kind}_{i // len(SUITE):03d}", kind, generator, size, int(rng.integers(k[0], k[1] + 1)), int(rng.choice(dims)), seed + 1009 * i + 17, size <= max_guided, json.dumps(params, sort_keys=True)))
    plan = spark.createDataFrame(rows, "dataset string, type string, generator string, n int, k int, d int, seed int, allow_guided boolean, params string")
    return plan.join(stratified_split(plan, "dataset", "type", folds).drop("type"), "dataset")


def suite(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """(dataset, obj_id, features, gt) of every row of a manifest; a data set is planned on the driver and drawn in tasks."""
    import json

    make, out = {"gaussian": gaussian, "archetype": archetype, "density": density}, None
    for r in plan.orderBy("dataset").collect():  # a manifest's rows, not data
        one = make[r["generator"]](spark, n=r["n"], k=r["k"], d=r["d"], seed=r["seed"], **json.loads(r["params"]))
        one = one.select(F.lit(r["dataset"]).alias("dataset"), "obj_id", "features", "gt")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the manifest has no rows")
    return out
