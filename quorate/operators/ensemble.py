"""Building ensembles of base partitions and running consensus algorithms over many runs at once.

A run is a column: all runs of all data sets are one grouped map, each group one (data set, run) with its members in a
dense matrix. Its size is bounded by ``max_n`` distinct objects, which is checked and raises; nothing is sampled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.functions import kernels
from quorate.functions.shared import Tables
from quorate.operators import contingency as ct
from quorate.operators import features as ft
from quorate.operators import linkage

METHODS = ("average", "complete", "single", "ward")

#: Ways of preparing features: what is taken off each one, and what it is then divided by.
PREPARED: dict[str, Callable[[np.ndarray], tuple]] = {"zscore": lambda x: (x.mean(0), x.std(0)), "minmax": lambda x: (x.min(0), np.ptp(x, axis=0)), "none": lambda x: (0.0, np.ones(x.shape[1]))}


def feature_subset(d: int, rng: np.random.Generator) -> np.ndarray:
    """A random half or more of d features; all of them if there are two at most."""
    return np.sort(rng.choice(d, rng.integers(max(2, -(-d // 2)), d + 1), replace=False)) if d > 2 else np.arange(d)


def partition_features(spark: SparkSession, d: int, n_partitions: int = 30, seed: int = 19) -> DataFrame:
    """(part_id, features): which of the d features, from 0, each partition of base_partitions with that seed uses."""
    drawn = [(j, feature_subset(d, np.random.default_rng([seed, j])).tolist()) for j in range(n_partitions)]
    return spark.createDataFrame(drawn, "part_id int, features array<int>")


def jitter(ids: np.ndarray, seed: int, part: int, used: np.ndarray, width: float) -> np.ndarray:
    """Normal numbers of a deviation for each object and feature, from a hash of both, the seed and the partition."""
    salt = kernels.scrambled(np.array([seed, part], dtype=np.int64).view(np.uint64))
    row = kernels.scrambled(ids.astype(np.int64).view(np.uint64) ^ salt[0] ^ kernels.scrambled(salt[1:])[0])
    h = row[:, None] + kernels.scrambled(used.astype(np.uint64) + np.uint64(1))
    u, v = ((kernels.scrambled(h + np.uint64(c)) >> np.uint64(11)).astype(float) * 2.0**-53 for c in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A))
    return width * np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)


def base_partitions(objs: DataFrame, n_partitions: int = 30, k_min: int = 2, k_max: int = 8, strategy: str = "mixed", seed: int = 19, noise: float = 0.01, subsets: bool = True, max_hierarchical: int = 2500, max_n: int | None = None, preprocessing: str = "zscore") -> DataFrame:
    """(obj_id, part_id, cluster_id, algorithm, linkage, k): a pool of base partitions of objs(obj_id, features).

    Features are prepared by one of PREPARED first; ``partition_features`` tells which of them a partition uses.

    Partition j uses a random half or more of the features (if there are more than two), jitter of noise * (1 + j % 3)
    and k in [k_min, k_max]; odd j of 'mixed' and all j of 'hierarchical' are hierarchical, with linkage METHODS[j % 4]; the others
    are k-means. Up to max_hierarchical objects a partition is one task. Beyond, the linkages go through ``linkage.euclidean`` and
    all k-means at once through ``clustering.lloyd``, which do the same over all tasks, so that no partition depends on the way it is built.
    A caller may give max_n: beyond it, and beyond max_hierarchical, all partitions are k-means.
    """
    if strategy not in ("mixed", "kmeans", "hierarchical"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if preprocessing not in PREPARED:
        raise ValueError(f"unknown preprocessing {preprocessing!r}")
    if n_partitions < 1 or k_min < 1 or k_max < k_min:
        raise ValueError("n_partitions >= 1 and 1 <= k_min <= k_max are needed")
    from quorate.operators import clustering  # it builds on this module

    n = objs.count()
    shift, scale = map(np.array, clustering.scales(objs, preprocessing))
    plain_only = strategy == "kmeans" or (max_n is not None and n > max(max_n, max_hierarchical))
    linkages = [METHODS[j % 4] if not plain_only and (strategy == "hierarchical" or j % 2 == 1) else None for j in range(n_partitions)]
    low = max(2, k_min)

    def drawn(j: int) -> tuple[np.ndarray, int]:
        rng = np.random.default_rng([seed, j])
        used = feature_subset(len(shift), rng) if subsets else np.arange(len(shift))
        return used, int(rng.integers(low, min(max(low, k_max), n) + 1)) if n > low else low

    draws = [drawn(j) for j in range(n_partitions)]

    def prepared(j: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        used, _ = draws[j]
        return lambda ids, x: (x[:, used] - shift[used]) / scale[used] + jitter(ids, seed, j, used, noise * (1 + j % 3))

    schema = "obj_id long, part_id int, cluster_id int, algorithm string, linkage string, k int"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obj_id")
        j, x = int(pdf["part_id"].iloc[0]), np.stack(pdf["features"].to_numpy()).astype(float)
        if not np.isfinite(x).all():
            raise ValueError("features must be finite")
        ids, (_, k), method = pdf["obj_id"].to_numpy(), draws[j], linkages[j]
        x = prepared(j)(ids, x)
        labels = kernels.cut(kernels.linkage(np.round(kernels.pairwise(x), linkage.DIGITS), method, None, linkage.DIGITS), n, k) if method else kernels.hashed_kmeans(x, ids, k, seed, j)[0]
        labels = np.unique(labels, return_inverse=True)[1] + 1
        return pd.DataFrame({"obj_id": ids, "part_id": j, "cluster_id": labels, "algorithm": "hierarchical" if method else "kmeans", "linkage": method, "k": k})

    if n <= max_hierarchical:
        tasks = objs.select("obj_id", "features", F.explode(F.sequence(F.lit(0), F.lit(n_partitions - 1))).alias("part_id"))
        return tasks.groupBy("part_id").applyInPandas(build, schema)

    def merged(j: int) -> DataFrame:
        make = prepared(j)

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = pdf["obj_id"].to_numpy()
                yield pd.DataFrame({"obj_id": ids, "features": list(make(ids, clustering.matrix(pdf["features"])))})

        found = linkage.euclidean(objs.select("obj_id", "features").mapInPandas(rows, "obj_id long, features array<double>"), draws[j][1], linkages[j])
        return found.select("obj_id", F.lit(j).alias("part_id"), F.col("label").cast("int").alias("cluster_id"), F.lit("hierarchical").alias("algorithm"), F.lit(linkages[j]).alias("linkage"), F.lit(draws[j][1]).alias("k"))

    parts = []
    if jobs := {j: (draws[j][1], prepared(j)) for j in range(n_partitions) if not linkages[j]}:
        centres = {j: c for j, (c, _) in clustering.lloyd(objs, jobs, seed).items()}
        found = clustering.labelled(objs, jobs, centres)
        rank = found.select("job", "label").distinct().select("job", "label", F.row_number().over(W.partitionBy("job").orderBy("label")).alias("cluster_id"))  # a row a cluster
        sizes = F.element_at(F.array(*[F.lit(draws[j][1]) for j in range(n_partitions)]), F.col("job") + 1)
        parts.append(found.join(F.broadcast(rank), ["job", "label"]).select("obj_id", F.col("job").alias("part_id"), "cluster_id", F.lit("kmeans").alias("algorithm"), F.lit(None).cast("string").alias("linkage"), sizes.alias("k")))
    with ThreadPool(4) as pool:  # each thread waits for Spark jobs
        parts += pool.map(inheritable_thread_target(objs.sparkSession)(merged), [j for j in range(n_partitions) if linkages[j]])
    return reduce(DataFrame.unionByName, parts)


def random_plan(members: DataFrame, m: int, runs: int, seed: int = 19) -> DataFrame:
    """(run_id, part_id): m partitions of each run by hash order; all of them if there are fewer."""
    parts = members.select("part_id").distinct().withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    order = W.partitionBy("run_id").orderBy(F.xxhash64(F.lit(seed), "run_id", "part_id"), "part_id")
    return parts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= m).select("run_id", "part_id")


def diverse_plan(members: DataFrame, m: int, runs: int, alpha: float = 0.5) -> DataFrame:
    """(run_id, part_id): the greedy subset of good and diverse partitions, the same in every run. The agreements of partitions, not of objects, go to one task."""
    pairs = ct.both_ways(ct.rand_agreement(members), "agreement")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = np.sort(pdf["p"].unique())
        a = np.eye(len(parts))
        a[np.searchsorted(parts, pdf["p"]), np.searchsorted(parts, pdf["q"])] = pdf["agreement"]
        return pd.DataFrame({"part_id": parts[kernels.greedy_subset(a, m, alpha)]})

    chosen = pairs.groupBy(F.lit(0).alias("_")).applyInPandas(lambda pdf: choose(pdf), "part_id int")
    return chosen.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_id"), "part_id")


def plain(members: np.ndarray, params: dict) -> np.ndarray:
    return (members[:, None, :] == members[None, :, :]).mean(2)


def weighted(members: np.ndarray, params: dict) -> np.ndarray:
    """Partitions count by their mean agreement; params['counts'] says how many objects each row stands for."""
    m = members.shape[1]
    same = [members[:, None, p] == members[None, :, p] for p in range(m)]
    n = np.asarray(params.get("counts", np.ones(len(members))), dtype=float)
    agree = np.array([[n @ (a == b) @ n for b in same] for a in same]) / n.sum() ** 2
    w = agree.mean(1)
    w = (w / w.sum()) ** params.get("sharpen", 1.0) if w.sum() > 0 else np.full(m, 1 / m)
    return sum(x * s for x, s in zip(w / w.sum(), same, strict=True))


def guided(members: np.ndarray, params: dict) -> np.ndarray:
    return kernels.guided(members, params.get("lam", 0.09), params.get("eta", 0.75), params.get("theta", 0.65), tau=params.get("tau"), counts=params.get("counts"), threads=params.get("threads", 1))


def guided_diffusion(members: np.ndarray, params: dict) -> np.ndarray:
    """As guided, with other weights of clusters and a heat kernel; time 'adaptive' fits it to the graph.

    A cluster's weight is its partition's agreement with the others times its fuzzy entropy weight (params['fuzzy'], in
    the order of partitions and cluster ids), which is 1 without features; the largest becomes 1. params['counts'] says how many
    objects each row stands for.
    """
    segments, part = kernels.one_hot(members)
    m, n = members.shape[1], np.asarray(params.get("counts", np.ones(len(members))), dtype=float)
    p = (segments * n) @ segments.T / n.sum()
    share = segments @ n / n.sum()
    outer = np.outer(share, share)
    info = np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / np.where(outer > 0, outer, 1)), 0)
    onto = (part[:, None] == np.arange(m)).astype(float)
    mutual, h = onto.T @ info @ onto, -(onto.T @ (share * np.log(share)))
    mean_h = (h[:, None] + h) / 2
    nmi = np.clip(np.divide(mutual, mean_h, out=np.zeros_like(mutual), where=mean_h > 0), 0, 1)
    agree = (nmi.sum(1) - np.diag(nmi)) / (m - 1) if m > 1 else np.ones(1)
    agree = np.clip(agree / max(agree.max(), 1e-12), 1e-6, 1)
    weight = agree[part] * np.asarray(params.get("fuzzy", 1.0))
    weight = np.clip(weight / max(weight.max(), 1e-12), 1e-6, 1)
    time = params.get("time", 1.0)
    return kernels.guided(members, eta=params.get("eta", 0.75), theta=params.get("theta", 0.65), weight=weight, time=None if time == "adaptive" else time, diffusion=True, tau=params.get("tau"), counts=params.get("counts"), threads=params.get("threads", 1))


#: name -> function of (objects by partitions, parameters) to a similarity matrix. Add to it to extend the library.
ALGORITHMS: dict[str, Callable[[np.ndarray, dict], np.ndarray]] = {"hierarchical": plain, "weighted": weighted, "guided": guided, "guided_diffusion": guided_diffusion}

#: Names of the algorithms in result tables of others. Fixed values.
ALIASES = {"hierarchical_baseline": "hierarchical", "hierarchical_weighted": "weighted", "sdgca": "guided", "sdgca_modified": "guided_diffusion"}

#: The parameters that each algorithm looks at.
PARAMETERS = {"hierarchical": (), "weighted": ("sharpen",), "guided": ("lam", "eta", "theta", "tau"), "guided_diffusion": ("eta", "theta", "time", "tau")}


def canonical(name: str) -> str:
    """The name in ALGORITHMS of a name or alias; other names stay as they are."""
    return ALIASES.get(name, name)


def checked(m: int, runs: int, params: dict) -> None:
    """Raise where a run cannot be meant: no partitions, no runs, no sharpening, no time, a tau outside [0, 1]."""
    time = params.get("time", 1.0)
    for name, right in (("m", m >= 1), ("runs", runs >= 1), ("sharpen", params.get("sharpen", 1.0) > 0), ("time", time == "adaptive" or time > 0), ("tau", params.get("tau") is None or 0 <= params["tau"] <= 1)):
        if not right:
            raise ValueError(f"{name} is out of range")


def ignored_params(algorithm: str, params: dict) -> list[str]:
    """The names of the given parameters that the algorithm does not look at; none for algorithms that PARAMETERS does not list."""
    known = PARAMETERS.get(canonical(algorithm))
    return [] if known is None else sorted(set(params) - set(known))


#: Algorithms whose matrix is 1 between objects with equal cluster ids, so that such objects are one point.
BY_POINTS = ("hierarchical", "weighted")

#: Algorithms that take classes of equal objects and params['counts']; the diagonal of their matrix is the similarity within a class.
BY_CLASSES = ("guided", "guided_diffusion")

#: Most classes of a run of BY_CLASSES: some 20 matrices of single precision are in memory.
CLASSES = 4096


def consensus(members: DataFrame, plan: DataFrame, k: int, algorithm: str = "hierarchical", method: str = "average", max_n: int | None = None, fuzzy: DataFrame | None = None, **params) -> DataFrame:
    """(run_id, obj_id, label): the consensus partition of every run of the plan.

    Objects with equal cluster ids throughout the run's partitions are one point with a weight for BY_POINTS; only points
    and how many objects they stand for go to a run's task. 'hierarchical' with 'single', or with 'average' and more than
    linkage.FEW points in a run, goes through ``linkage`` and has no bound; else a run has at most 8192 points. For BY_CLASSES
    such objects are a class, of which a run has at most CLASSES, but with 'ward', which goes over the objects. Other algorithms have 3000
    objects at most; a given max_n bounds the points of 'hierarchical' and the objects of others. Unknown names raise KeyError. ``fuzzy`` are the weights (part_id, cluster_id,
    weight) of features.fuzzy_partition_weights for 'guided_diffusion'. A run of BY_CLASSES uses the cores that the runs leave idle.
    """
    algorithm = canonical(algorithm)
    by_classes = algorithm in BY_CLASSES and method != "ward"
    build, with_fuzzy, by_points = ALGORITHMS[algorithm], fuzzy is not None, algorithm in BY_POINTS or by_classes
    if method not in METHODS:
        raise ValueError(f"unknown linkage {method!r}")
    if algorithm == "hierarchical" and method == "single":
        return linkage.single(members, plan, k)
    if algorithm == "hierarchical" and method == "average":
        few = linkage.FEW if max_n is None else max_n
        counts = linkage.points(members, plan).select("run_id", "s").distinct().groupBy("run_id").count()
        if (counts.agg(F.max("count")).first()[0] or 0) > few:
            return linkage.average(members, plan, k, few)
    most = max_n if max_n is not None else CLASSES if by_classes else 8192 if by_points else 3000
    threads = _idle_cores(plan) if by_classes else 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="obj_id", columns="part_id", values="cluster_id").sort_index()
        more, n = {}, None
        if by_points:
            n = pdf.drop_duplicates("obj_id").set_index("obj_id")["n"].loc[wide.index].to_numpy()
            more["counts"] = n
        many = n.sum() if max_n is not None and by_points and algorithm != "hierarchical" else len(wide)
        if many > most:
            raise ValueError(f"{many} points in a run; max_n is {most}")
        if with_fuzzy:
            known = dict(zip(zip(pdf["part_id"], pdf["cluster_id"], strict=True), pdf["weight"], strict=True))
            more["fuzzy"] = [known[p, c] for p in wide.columns for c in np.unique(wide[p])]
        if by_classes:
            at, rank, labels = kernels.class_labels(build(wide.to_numpy(), params | more | {"threads": threads}), n, k, method, linkage.DIGITS)
            return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "obj_id": wide.index[at], "rank": rank, "label": labels})
        labels = kernels.consensus_labels(build(wide.to_numpy(), params | more), k, method, n, linkage.DIGITS)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "obj_id": wide.index, "label": labels})

    rows = members.select("obj_id", "part_id", "cluster_id").join(plan, "part_id")
    solved = "run_id int, obj_id long, label int"
    if not by_points:
        rows = rows if fuzzy is None else rows.join(fuzzy, ["part_id", "cluster_id"])
        return rows.groupBy("run_id").applyInPandas(solve, solved)
    own = rows.groupBy("run_id", "obj_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "cluster_id"))).alias("sig"))
    points = own.groupBy("run_id", "sig").agg(F.min("obj_id").alias("s"), F.count("*").alias("n"))  # a point goes by its first object
    rows = points.select("run_id", F.col("s").alias("obj_id"), "n", F.explode("sig").alias("m")).select("run_id", "obj_id", "n", "m.*")
    rows = rows if fuzzy is None else rows.join(fuzzy, ["part_id", "cluster_id"])
    if by_classes:
        with Tables(members.sparkSession, "classes") as tables:
            found = tables.write(rows.groupBy("run_id").applyInPandas(solve, "run_id int, obj_id long, rank int, label int"))
            return tables.keep(_of_classes(own, points, found, tables))
    found = rows.groupBy("run_id").applyInPandas(solve, solved)
    named = points.select("run_id", "sig", "s").join(found.select("run_id", F.col("obj_id").alias("s"), "label"), ["run_id", "s"])
    return own.join(named, ["run_id", "sig"]).select("run_id", "obj_id", "label")


def _idle_cores(plan: DataFrame) -> int:
    """How many cores each run of a plan may use: an even share of all, and those of one executor at most."""
    spark = plan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    here = cores if spark.sparkContext.master.startswith("local") else int(spark.conf.get("spark.executor.cores", "1"))
    return max(1, min(here, cores // max(1, plan.select("run_id").distinct().count())))


def _of_classes(own: DataFrame, points: DataFrame, found: DataFrame, tables: Tables) -> DataFrame:
    """(run_id, obj_id, label) from found(run_id, obj_id, rank, label): rank -1 stands for a class, others for one object of it; labels go by the least objects."""
    named = points.select("run_id", "sig", F.col("s").alias("obj_id")).join(found, ["run_id", "obj_id"]).drop("obj_id")
    rank = F.row_number().over(W.partitionBy("run_id", "sig").orderBy("obj_id")) - 1
    whole, each = named.where("rank < 0").drop("rank"), named.where("rank >= 0").withColumnRenamed("label", "other")
    both = own.withColumn("rank", rank).join(whole, ["run_id", "sig"], "left").join(each, ["run_id", "sig", "rank"], "left")
    out = tables.write(both.select("run_id", "obj_id", F.coalesce("label", "other").alias("c")))
    first = out.groupBy("run_id", "c").agg(F.min("obj_id").alias("o"))  # k rows a run at most
    number = first.select("run_id", "c", F.row_number().over(W.partitionBy("run_id").orderBy("o")).alias("label"))
    return out.join(F.broadcast(number), ["run_id", "c"]).select("run_id", "obj_id", "label")


def run_consensus(members: DataFrame, labels: DataFrame, algorithm: str = "hierarchical", method: str = "average", m: int = 40, runs: int = 20, seed: int = 19, selection: str = "random", alpha: float = 0.5, per_run: bool = False, **params) -> DataFrame:
    """One row: means and population deviations of NMI, ARI and F over the runs, how many there were, and ignored parameters.

    With ``per_run`` also the values of the runs in their order, as arrays nmi_runs, ari_runs and f_runs, the partitions that
    each run took (selected_runs), how many there are (pool) and, for 'weighted', the mean weight of each place in a run.

    k is the number of classes in labels(obj_id, gt), which are used for nothing else but the scores.
    """
    checked(m, runs, params)
    k = labels.select("gt").distinct().count()
    if k < 2:
        raise ValueError("at least two classes are needed")
    plan = diverse_plan(members, m, runs, alpha) if selection == "qd" else random_plan(members, m, runs, seed)
    scored = ct.agreement(consensus(members, plan, k, algorithm, method, **params).join(labels, "obj_id"), ["run_id"], "label", "gt")
    stats = [f(c).alias(f"{c}_{n}") for c in ("nmi", "ari", "f") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    if per_run:
        stats += [F.expr(f"transform(array_sort(collect_list(struct(run_id, {c}))), r -> r.{c})").alias(f"{c}_runs") for c in ("nmi", "ari", "f")]
    ignored = F.lit(",".join(ignored_params(algorithm, params))).alias("ignored_params")
    out = scored.agg(*stats, F.count("*").alias("runs")).select(F.lit(algorithm).alias("algorithm"), F.lit(method).alias("method"), "*", ignored)
    if per_run:  # rows of runs times partitions
        chosen = plan.groupBy("run_id").agg(F.sort_array(F.collect_list("part_id")).alias("s")).agg(F.expr("transform(array_sort(collect_list(struct(run_id, s))), r -> r.s)").alias("selected_runs"))
        more = [chosen, members.agg(F.count_distinct("part_id").alias("pool"))]
        if canonical(algorithm) == "weighted":
            weights = ct.position_weights(members, plan, params.get("sharpen", 1.0))
            more.append(weights.agg(F.expr("transform(array_sort(collect_list(struct(position, weight))), r -> r.weight)").alias("mean_weights")))
        for part in more:
            out = out.join(F.broadcast(part), F.lit(True))  # one row
    return out


def single_clusterers(objs: DataFrame, k: int, seed: int = 19, starts: int = 10, max_n: int = 3000) -> DataFrame:
    """(algorithm, obj_id, label): k-means (best of ``starts``), average, complete, single and ward linkage of the objects.

    Up to max_n objects an algorithm is one task. Beyond, the linkages go through ``linkage.euclidean`` and k-means through
    ``clustering.best_kmeans``, which do the same over all tasks and have no bound.
    """
    if objs.count() > max_n:
        from quorate.operators import clustering  # it builds on this module

        def over_all(name: str) -> DataFrame:
            found = clustering.best_kmeans(objs, k, seed, starts) if name == "kmeans" else linkage.euclidean(objs, k, name)
            return found.select(F.lit(name).alias("algorithm"), "obj_id", F.col("label").cast("int").alias("label"))

        with ThreadPool(1 + len(METHODS)) as pool:  # each thread waits for Spark jobs, which are short for the most part
            return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(objs.sparkSession)(over_all), ("kmeans", *METHODS)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obj_id")
        name, ids, x = pdf["algorithm"].iloc[0], pdf["obj_id"].to_numpy(), np.stack(pdf["features"].to_numpy()).astype(float)
        if name == "kmeans":
            labels = min((kernels.hashed_kmeans(x, ids, k, seed, s) for s in range(starts)), key=lambda r: r[1])[0] + 1
        else:
            labels = kernels.cut(kernels.linkage(np.round(kernels.pairwise(x), linkage.DIGITS), name, None, linkage.DIGITS), len(x), k)
        return pd.DataFrame({"algorithm": name, "obj_id": ids, "label": labels})

    tasks = objs.select("obj_id", "features", F.explode(F.array(*map(F.lit, ("kmeans", *METHODS)))).alias("algorithm"))
    return tasks.groupBy("algorithm").applyInPandas(solve, "algorithm string, obj_id long, label int")


def class_shapes(objs: DataFrame) -> DataFrame:
    """(gt, elongation, condition): ratios of the largest to the second and the smallest eigenvalue of each class's sample covariance.

    The covariance is summed in tasks; only a d by d matrix of each class goes to one.
    """

    def ratios(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.maximum(np.linalg.eigvalsh(ft.covariance(pdf)[0])[::-1], 1e-12)
        return pd.DataFrame({"gt": [pdf["gt"].iloc[0]], "elongation": [e[0] / e[min(1, len(e) - 1)]], "condition": [e[0] / e[-1]]})

    moments = ft.comoments(objs.select(F.col("gt").cast("long").alias("gt"), F.col("features").alias("x")), ["gt"])
    return moments.groupBy("gt").applyInPandas(ratios, "gt long, elongation double, condition double")


def pca_profile(values: DataFrame) -> DataFrame:
    """explained_2, explained_10, dims_90, dims_95 and participation of the feature covariance, which tasks sum up."""

    def profile(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = ft.covariance(pdf)
        e = np.maximum(np.linalg.eigvalsh(m)[::-1], 0)[: min(len(m), n - 1)]
        share = np.cumsum(e) / np.trace(m)
        dims = [int(min(np.searchsorted(share, q) + 1, len(e))) for q in (0.9, 0.95)]
        return pd.DataFrame({"explained_2": [share[min(1, len(e) - 1)]], "explained_10": [share[min(9, len(e) - 1)]], "dims_90": [dims[0]], "dims_95": [dims[1]], "participation": [e.sum() ** 2 / (e**2).sum()]})

    moments = ft.comoments(ft.objects_of(values), [])
    return moments.groupBy(F.lit(0).alias("_")).applyInPandas(lambda pdf: profile(pdf), "explained_2 double, explained_10 double, dims_90 int, dims_95 int, participation double")


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """(keys..., mean, low, high): percentile interval of the mean, by Poisson resampling with counts from a hash of (row_no, resample).

    A task adds up its resamples over its batches, so what is shuffled is ``resamples`` sums for each task and key; it holds the sums of
    1000 keys at most.
    """
    chances = np.cumsum(np.exp(-1) / np.array([float(math.factorial(k)) for k in range(9)]))
    count_of = np.searchsorted(chances, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)  # by 16 bits of a hash
    salts = kernels.folded(kernels.scrambled(np.arange(1, resamples + 1, dtype=np.uint64)))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        many, wide = 32, 1024  # small enough for a core's cache
        hashes, spare = np.empty((2, many * wide), dtype=np.uint64)
        drawn, counts = np.empty(many * wide, dtype=np.uint8), np.empty(many * wide)

        def give() -> Iterator[pd.DataFrame]:
            for key, (total, n) in sums.items():
                yield pd.DataFrame({k: [x] * resamples for k, x in zip(keys, key, strict=True)} | {"b": np.arange(resamples), "s": total, "n": n.astype(np.int64)})
            sums.clear()

        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False):
                key = tuple(None if pd.isna(x) else x for x in key)
                if key not in sums and len(sums) >= 1000:
                    yield from give()
                both = sums.setdefault(key, np.zeros((2, resamples)))
                v, row = part["v"].to_numpy(dtype=float), kernels.scrambled(part["row_no"].to_numpy(dtype=np.int64).view(np.uint64))
                v, row = np.stack([v, np.ones(len(v))]), kernels.folded(row)
                for at in range(0, len(row), many):
                    some = row[at : at + many, None]
                    for b in range(0, resamples, wide):
                        salt = salts[b : b + wide]
                        h, x, d, c = (m[: len(some) * len(salt)].reshape(len(some), len(salt)) for m in (hashes, spare, drawn, counts))
                        np.bitwise_xor(some, salt, out=h)
                        kernels.scramble_high(h, x)
                        np.take(count_of, h.view(np.int64), out=d, mode="clip")
                        np.copyto(c, d)
                        both[:, b : b + wide] += v[:, at : at + many] @ c
        yield from give()

    slim = rows.select(*keys, "row_no", F.col(value).alias("v")).where("v IS NOT NULL")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keys)
    slim = slim.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)  # a row costs much more than its way, and files may have few splits
    drawn = slim.mapInPandas(resample, f"{schema}, b int, s double, n long")
    means = drawn.groupBy(*keys, "b").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    edge = (1 - confidence) / 2
    ends = means.groupBy(*keys).agg(F.percentile("m", F.lit(edge)).alias("low"), F.percentile("m", F.lit(1 - edge)).alias("high"))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ends, keys)


def parameter_grid(members: DataFrame, labels: DataFrame, grid: list[dict], algorithm: str = "guided", method: str = "average", m: int = 20, runs: int = 2, seed: int = 19, max_n: int = 3000, features: DataFrame | None = None) -> DataFrame:
    """(trial, params, run_id, nmi, ari, f, objective, status, error): every setting of the grid on the same runs, one task each.

    A run of more than max_n objects is a failed row. ``objective`` needs no labels (see kernels.objective); it looks at
    features(obj_id, features) if they are given.

    A setting that fails gives rows of status 'failed' with its error instead of stopping the others. The best one is
    the row of largest mean metric over its runs; see ``best_setting``.
    """
    k = labels.select("gt").distinct().count()
    build, with_features = ALGORITHMS[algorithm], features is not None
    plan = random_plan(members, m, runs, seed)
    trials = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(json.dumps(p, sort_keys=True)).alias("params")) for i, p in enumerate(grid)])

    def attempt(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {"trial": int(pdf["trial"].iloc[0]), "params": pdf["params"].iloc[0], "run_id": int(pdf["run_id"].iloc[0])}
        wide = pdf.pivot(index="obj_id", columns="part_id", values="cluster_id").sort_index()
        try:
            if len(wide) > max_n:
                raise ValueError(f"{len(wide)} objects; max_n is {max_n}")
            found, error = kernels.consensus_labels(build(wide.to_numpy(), json.loads(head["params"])), k, method), None
            first = pdf[pdf["part_id"] == wide.columns[0]].set_index("obj_id") if with_features else None
            value = kernels.objective(found, wide.to_numpy(), None if first is None else np.stack(first["features"].loc[wide.index].to_numpy()).astype(float))
        except Exception as e:  # a failed setting is a result
            found, value, error = np.zeros(len(wide), dtype=int), None, f"{type(e).__name__}: {e}"[:120]
        return pd.DataFrame(head | {"obj_id": wide.index, "label": found, "objective": pd.array([value] * len(wide), dtype="Float64"), "error": error})

    rows = members.select("obj_id", "part_id", "cluster_id").join(plan, "part_id").withColumn("t", F.explode(trials)).select("obj_id", "part_id", "cluster_id", "run_id", "t.*")
    if with_features:
        rows = rows.join(features.select("obj_id", "features"), "obj_id")
    tried = rows.groupBy("trial", "run_id").applyInPandas(attempt, "trial int, params string, run_id int, obj_id long, label int, objective double, error string")
    keys = ["trial", "params", "run_id", "objective", "status", "error"]
    tried = tried.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed")).withColumn("error", F.coalesce("error", F.lit("")))
    tried = tried.withColumn("objective", F.coalesce("objective", F.lit(float("nan"))))  # keys are joined, which nulls are not
    scored = ct.agreement(tried.join(labels, "obj_id"), keys, "label", "gt").drop("n")
    ok = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    return scored.select(*keys[:3], ok("nmi"), ok("ari"), ok("f"), ok("objective"), "status", "error")


def best_setting(trials: DataFrame, metric: str = "nmi") -> DataFrame:
    """One row: the setting of the largest mean metric, the first of ties."""
    means = trials.where("status = 'ok'").groupBy("trial", "params").agg(F.avg(metric).alias(metric))
    return means.orderBy(F.desc(metric), "trial").limit(1)


def tune(members: DataFrame, labels: DataFrame, ranges: dict[str, tuple[float, float]], steps: int = 3, rounds: int = 3, metric: str = "nmi", seeds: tuple[int, ...] = (19, 116), **options) -> DataFrame:
    """(round, trial, params, value, failed): a coarse grid over the ranges, then finer ones around the best setting, in rounds.

    A round tries ``steps`` values in each range, ends included, and the next one reaches a step to each side of the
    best setting, within the first ranges. A setting's value is its mean over all seeds and runs; failed runs count 0. The
    metric is nmi, ari or f, or 'objective', which needs no labels but for the number of clusters.
    The best setting of all is the row of the largest value; see ``best_trial``. A round is one job of bounded tasks.
    """
    spark, now, rows = members.sparkSession, dict(ranges), []
    for r in range(rounds):
        axes = {k: np.linspace(a, b, steps) for k, (a, b) in now.items()}
        grid = [dict(zip(axes, map(float, x), strict=True)) for x in np.stack(np.meshgrid(*axes.values(), indexing="ij"), -1).reshape(-1, len(axes))]
        tried = [parameter_grid(members, labels, grid, seed=s, **options) for s in seeds]
        every = tried[0]
        for t in tried[1:]:
            every = every.unionByName(t)
        found = every.groupBy("trial").agg(F.avg(F.coalesce(metric, F.lit(0.0))).alias("value"), F.count_if(F.col("status") != "ok").alias("failed")).collect()  # a row a setting
        rows += [(r, t.trial, json.dumps(grid[t.trial], sort_keys=True), t.value, t.failed) for t in sorted(found, key=lambda t: t.trial)]
        best = json.loads(max(rows, key=lambda x: (x[3], -x[0], -x[1]))[2])
        reach = {k: (b - a) / max(1, steps - 1) for k, (a, b) in now.items()}
        now = {k: (max(a, best[k] - reach[k]), min(b, best[k] + reach[k])) for k, (a, b) in ranges.items()}
    return spark.createDataFrame(rows, "round int, trial int, params string, value double, failed long")


def best_trial(trials: DataFrame) -> DataFrame:
    """One row of tune(): the largest value, the first of ties."""
    return trials.orderBy(F.desc("value"), "round", "trial").limit(1)
