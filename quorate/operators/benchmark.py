"""Benchmarks of single and consensus clusterers: planned jobs in, one scored row a job out."""

from __future__ import annotations

import resource
import threading
import time
from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.functions import kernels
from quorate.functions.shared import Tables
from quorate.operators import clustering as cl
from quorate.operators import comparisons as cp
from quorate.operators import contingency as ct
from quorate.operators import ensemble as en
from quorate.operators import linkage

#: Algorithms of one clustering of the features, and the linkage that the hierarchical ones use.
SINGLE = {"kmeans": None, "spectral": None, **{f"agglomerative_{m}": m for m in ("average", "complete", "single", "ward")}}

#: Variants of an ablation: name -> algorithm and parameters.
VARIANTS = {
    "plain": ("hierarchical", {}),
    "weighted": ("weighted", {"sharpen": 1.5}),
    "guided": ("guided", {}),
    "diffusion": ("guided_diffusion", {"time": 1.0}),
    "diffusion, adaptive time": ("guided_diffusion", {"time": "adaptive"}),
}

LABELS = "job_id int, run_id int, obj_id long, label int, seconds double, memory_mb double, error string"


class PeakMemory:
    """How much the resident memory of this process rises above its start within the with block, in MB, looked at every 10 ms."""

    def __enter__(self) -> PeakMemory:
        self.start = self.most = self._now()
        self.end = threading.Event()
        self.watch = threading.Thread(target=self._look, daemon=True)
        self.watch.start()
        return self

    def _now(self) -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()

    def _look(self) -> None:
        while not self.end.wait(0.01):
            self.most = max(self.most, self._now())

    def __exit__(self, *_) -> None:
        self.end.set()
        self.watch.join()
        self.mb = (max(self.most, self._now()) - self.start) / 2**20


def plan_jobs(n: int, seeds: list[int], sizes: list[int], linkages: list[str], strategies: list[str], alphas: list[float], runs: int = 2, algorithms: list[str] | None = None, max_guided: int | None = 650, max_spectral: int | None = 900) -> list[dict]:
    """The jobs of one data set of n objects; guided algorithms are left out beyond ``max_guided`` objects, 'spectral' beyond
    ``max_spectral``, and none is if they are None; alpha is for 'qd' alone. Algorithms go by their names in ensemble.ALGORITHMS or ensemble.ALIASES.
    """
    jobs: list[dict] = []
    for seed in seeds:
        for name in map(en.canonical, algorithms or [*SINGLE, *en.ALGORITHMS]):
            if name == "spectral" and max_spectral is not None and n > max_spectral:
                continue
            if name not in SINGLE and name not in en.ALGORITHMS:
                raise ValueError(f"unknown algorithm {name!r}")
            if name in SINGLE:
                jobs.append({"family": "single", "algorithm": name, "variant": "default", "linkage": SINGLE[name] or "", "m": 0, "alpha": None, "seed": seed, "runs": 1})
            elif max_guided is None or n <= max_guided or not name.startswith("guided"):
                for m, linkage, strategy in [(m, x, s) for m in sizes for x in linkages for s in strategies]:
                    jobs += [{"family": "consensus", "algorithm": name, "variant": strategy, "linkage": linkage, "m": m, "alpha": a, "seed": seed, "runs": runs} for a in (alphas if strategy == "qd" else [None])]
    return [j | {"job_id": i} for i, j in enumerate(jobs)]


def attempt(head: dict, ids: np.ndarray, solve) -> pd.DataFrame:
    """The labels that solve() gives, with its time and the memory it took; one cluster and the error if it raises."""
    began = time.perf_counter()
    with PeakMemory() as memory:
        try:
            found, error = solve(), None
        except Exception as e:  # a failed job is a result
            found, error = np.zeros(len(ids), dtype=int), f"{type(e).__name__}: {e}"[:200]
    return pd.DataFrame(head | {"obj_id": ids, "label": found, "seconds": time.perf_counter() - began, "memory_mb": memory.mb, "error": error})


def too_large(rows: DataFrame, max_n: int) -> DataFrame:
    """LABELS of runs that fail for their size, from rows (job_id, run_id, obj_id, n): as ``attempt`` gives them, without sending the objects to a task."""
    error = F.concat(F.lit("ValueError: "), F.col("n").cast("string"), F.lit(f" objects; max_n is {max_n}"))
    zero = F.lit(0.0)
    return rows.select(F.col("job_id").cast("int"), F.col("run_id").cast("int"), "obj_id", F.lit(0).alias("label"), zero.alias("seconds"), zero.alias("memory_mb"), error.alias("error"))


#: Objects of a single job, and points of a run, that one task takes.
ONE_TASK, POINTS = 3000, 8192


def over_all_tasks(objs: DataFrame, jobs: dict[int, dict], k: int, starts: int = 10) -> DataFrame:
    """LABELS of single jobs as one task each gives them, with a job over all tasks; seconds are the driver's, memory is not measured."""
    shift, scale = map(np.array, cl.scales(objs, "zscore"))

    def standard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"obj_id": pdf["obj_id"], "features": list((cl.matrix(pdf["features"]) - shift) / scale)})

    with Tables(objs.sparkSession, "standard") as tables:
        rows = tables.write(objs.select("obj_id", "features").mapInPandas(standard, "obj_id long, features array<double>"))

        def run(i: int) -> DataFrame:
            job, began, error = jobs[i], time.perf_counter(), None
            try:
                if job["algorithm"] == "spectral":
                    found = cl.spectral(rows, k, job["seed"])
                else:
                    method = SINGLE[job["algorithm"]]
                    found = cl.best_kmeans(rows, k, job["seed"], starts) if method is None else linkage.euclidean(rows, k, method)
                found = tables.keep(found.select("obj_id", F.col("label").cast("int").alias("label")))
            except Exception as e:  # a failed job is a result
                found, error = objs.select("obj_id", F.lit(0).alias("label")), f"{type(e).__name__}: {e}"[:200]
            seconds = F.lit(time.perf_counter() - began)
            return found.select(F.lit(i).alias("job_id"), F.lit(0).alias("run_id"), "obj_id", "label", seconds.alias("seconds"), F.lit(None).cast("double").alias("memory_mb"), F.lit(error).cast("string").alias("error"))

        with ThreadPool(max(1, len(jobs))) as pool:  # each thread waits for Spark jobs
            return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(objs.sparkSession)(run), list(jobs)))


def single_labels(objs: DataFrame, jobs: list[dict], k: int, starts: int = 10, max_n: int | None = None) -> DataFrame:
    """LABELS of the single jobs over standardised features. Up to ONE_TASK objects a job is one task, beyond it goes over all tasks with the same result.

    If a caller gives ``max_n``, a job is one task, and all but k-means are failed jobs beyond so many objects.
    """
    settings = {j["job_id"]: j for j in jobs if j["family"] == "single"}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obj_id")
        job, x = settings[int(pdf["job_id"].iloc[0])], np.stack(pdf["features"].to_numpy()).astype(float, copy=False)
        pdf = pdf.drop(columns="features")  # the matrix alone stays
        shift, scale = x.mean(0), x.std(0)
        x -= shift
        x /= np.where(scale > 0, scale, 1)
        method = SINGLE[job["algorithm"]]

        def labels() -> np.ndarray:
            if method is None:
                rows = kernels.spectral_vectors(kernels.pairwise(x), k) if job["algorithm"] == "spectral" else x
                return min((kernels.hashed_kmeans(rows, ids, k, job["seed"], s) for s in range(starts)), key=lambda r: r[1])[0] + 1
            return kernels.cut(kernels.linkage(np.round(kernels.pairwise(x), linkage.DIGITS), method, None, linkage.DIGITS), len(x), k)

        ids = pdf["obj_id"].to_numpy()
        return attempt({"job_id": job["job_id"], "run_id": 0}, ids, labels)

    n = objs.count()
    if max_n is None and n > ONE_TASK:
        return over_all_tasks(objs, settings, k, starts)
    max_n = n if max_n is None else max_n
    large = [i for i, j in settings.items() if n > max_n and j["algorithm"] != "kmeans"]
    ids = lambda x: F.explode(F.array(*map(F.lit, x)).cast("array<int>")).alias("job_id")
    found = objs.select("obj_id", "features", ids([i for i in settings if i not in large])).groupBy("job_id").applyInPandas(solve, LABELS)
    return found.unionByName(too_large(objs.select("obj_id", F.lit(0).alias("run_id"), F.lit(n).alias("n"), ids(large)), max_n)) if large else found


def by_points(members: DataFrame, plans: list[DataFrame], jobs: dict[int, dict], k: int) -> DataFrame:
    """LABELS of the consensus jobs of plans(job_id, run_id, part_id), one task a run of a job, which gets points: objects with equal clusters in the
    run's partitions, and how many there are. Only runs of more than POINTS points (CLASSES for guided ones) are failed, whatever the number of objects.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        job, s, n = jobs[int(pdf["job_id"].iloc[0])], pdf["s"].to_numpy(), pdf["n"].to_numpy()
        guided = job["algorithm"] in en.BY_CLASSES
        most = en.CLASSES if guided else POINTS
        at, rank = np.arange(len(s)), np.full(len(s), -1)

        def labels() -> np.ndarray:
            nonlocal at, rank
            if len(s) > most:
                raise ValueError(f"{len(s)} points in a run; max_n is {most}")
            similarity = en.ALGORITHMS[job["algorithm"]](np.stack(pdf["sig"].to_numpy()), job.get("params", {}) | {"counts": n})
            if not guided:
                return kernels.consensus_labels(similarity, k, job["linkage"], n, linkage.DIGITS)
            at, rank, found = kernels.class_labels(similarity, n, k, job["linkage"], linkage.DIGITS)
            return found

        began = time.perf_counter()
        with PeakMemory() as memory:
            try:
                found, error = labels(), None
            except Exception as e:  # a failed job is a result
                found, error = np.zeros(len(s), dtype=int), f"{type(e).__name__}: {e}"[:200]
        head = {"job_id": job["job_id"], "run_id": int(pdf["run_id"].iloc[0])}
        return pd.DataFrame(head | {"s": s[at], "rank": rank, "label": found, "seconds": time.perf_counter() - began, "memory_mb": memory.mb, "error": error})

    out = []
    for plan in plans:
        ids = plan.select("job_id").distinct()
        runs = plan.select("run_id", "part_id").distinct()
        own = linkage.points(members, runs)
        points = own.groupBy("run_id", "s").agg(F.first("sig").alias("sig"), F.count("*").alias("n")).crossJoin(F.broadcast(ids))  # a row a job
        found = points.groupBy("job_id", "run_id").applyInPandas(solve, "job_id int, run_id int, s long, rank int, label int, seconds double, memory_mb double, error string")
        rank = F.row_number().over(W.partitionBy("run_id", "s").orderBy("obj_id")) - 1
        named = own.select("run_id", "obj_id", "s", rank.alias("own")).join(found, ["run_id", "s"]).where("rank < 0 OR rank = own")
        out.append(named.select("job_id", "run_id", "obj_id", "label", "seconds", "memory_mb", "error"))
    return reduce(DataFrame.unionByName, out)


def _plans(members: DataFrame, settings: dict[int, dict]) -> list[DataFrame]:
    """(run_id, part_id, job_id): one for all jobs with the same runs."""
    plans = []
    for variant, m, alpha, seed, runs in dict.fromkeys((j["variant"], j["m"], j["alpha"], j["seed"], j["runs"]) for j in settings.values()):
        plan = en.diverse_plan(members, m, runs, 0.5 if alpha is None else alpha) if variant == "qd" else en.random_plan(members, m, runs, seed)
        same = [i for i, j in settings.items() if (j["variant"], j["m"], j["alpha"], j["seed"], j["runs"]) == (variant, m, alpha, seed, runs)]
        plans.append(plan.select("run_id", "part_id", F.explode(F.array(*map(F.lit, same)).cast("array<int>")).alias("job_id")))
    return plans


def consensus_labels(members: DataFrame, jobs: list[dict], k: int, max_n: int | None = None) -> DataFrame:
    """LABELS of the consensus jobs, one task a run of a job, by points.

    Runs beyond ``max_n`` objects are failed if a caller gives it, and beyond 3000 for algorithms that do not go by points.
    """
    settings = {j["job_id"]: j for j in jobs if j["family"] == "consensus"}
    if max_n is None:
        pointed = [i for i, j in settings.items() if j["algorithm"] in en.BY_POINTS or j["algorithm"] in en.BY_CLASSES and j["linkage"] != "ward"]
        others = [j for i, j in settings.items() if i not in pointed]
        plans = _plans(members, {i: settings[i] for i in pointed})
        parts = [by_points(members, plans, settings, k)] if pointed else []
        return reduce(DataFrame.unionByName, parts + ([consensus_labels(members, others, k, 3000)] if others else []))
    plans = _plans(members, settings)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        job = settings[int(pdf["job_id"].iloc[0])]
        wide = pdf.pivot(index="obj_id", columns="part_id", values="cluster_id").sort_index()

        def labels() -> np.ndarray:
            if len(wide) > max_n:
                raise ValueError(f"{len(wide)} objects; max_n is {max_n}")
            return kernels.consensus_labels(en.ALGORITHMS[job["algorithm"]](wide.to_numpy(), job.get("params", {})), k, job["linkage"], None, linkage.DIGITS)

        return attempt({"job_id": job["job_id"], "run_id": int(pdf["run_id"].iloc[0])}, wide.index.to_numpy(), labels)

    rows = members.select("obj_id", "part_id", "cluster_id").join(reduce(DataFrame.unionByName, plans), "part_id")
    if members.select("obj_id").distinct().count() <= max_n:
        return rows.groupBy("job_id", "run_id").applyInPandas(solve, LABELS)
    sizes = rows.groupBy("job_id", "run_id").agg(F.count_distinct("obj_id").alias("n"))
    rows = rows.join(F.broadcast(sizes), ["job_id", "run_id"])  # a row a run
    found = rows.where(F.col("n") <= max_n).drop("n").groupBy("job_id", "run_id").applyInPandas(solve, LABELS)
    return found.unionByName(too_large(rows.where(F.col("n") > max_n).select("job_id", "run_id", "obj_id", "n").distinct(), max_n))


def run_jobs(objs: DataFrame, members: DataFrame, jobs: list[dict]) -> DataFrame:
    """One row a job: its settings, mean and deviation of nmi, ari and f over its runs, seconds, memory_mb (peak of a run), runs, status and error.

    Labels are used for the number of clusters and the scores alone. A job fails if one of its runs does; its scores are null.
    The labels are written, as times differ from run to run: what is reported is what was measured once.
    """
    k = objs.select("gt").distinct().count()
    if k < 2:
        raise ValueError("at least two classes are needed")
    kinds = {j["family"] for j in jobs}
    parts = [f for f, need in ((lambda: single_labels(objs, jobs, k), "single"), (lambda: consensus_labels(members, jobs, k), "consensus")) if need in kinds]
    keys = ["job_id", "run_id"]
    head = "job_id int, family string, algorithm string, variant string, linkage string, m int, alpha double, seed int"
    settings = objs.sparkSession.createDataFrame([tuple(j[x.split()[0]] for x in head.split(", ")) for j in jobs], head)
    with Tables(objs.sparkSession, "jobs") as tables:
        labels = tables.write(reduce(DataFrame.unionByName, [f() for f in parts]))
        ran = labels.groupBy(*keys).agg(F.max("seconds").alias("seconds"), F.max("memory_mb").alias("memory_mb"), F.coalesce(F.max("error"), F.lit("")).alias("error"))
        scored = ct.agreement(labels.join(objs.select("obj_id", "gt"), "obj_id"), keys, "label", "gt").join(ran, keys)
        metrics = [f(F.when(F.col("error") == "", F.col(c))).alias(f"{c}_{s}") for c in ("nmi", "ari", "f") for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
        per = scored.groupBy("job_id").agg(*metrics, F.sum("seconds").alias("seconds"), F.max("memory_mb").alias("memory_mb"), F.count("*").alias("runs"), F.max("error").alias("error"))
        per = per.withColumn("status", F.when(F.col("error") == "", "ok").otherwise("failed"))
        per = per.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in per.columns if c.endswith(("_mean", "_std"))})
        return tables.keep(settings.join(per, "job_id"))


def ablation(members: DataFrame, objs: DataFrame, m: int = 6, runs: int = 2, seed: int = 19, linkage: str = "average") -> DataFrame:
    """run_jobs of VARIANTS on the same runs, with ``name`` and ``gain`` of mean nmi over the plain one."""
    jobs = [{"job_id": i, "family": "consensus", "algorithm": a, "variant": "random", "linkage": linkage, "m": m, "alpha": None, "seed": seed, "runs": runs, "params": p} for i, (a, p) in enumerate(VARIANTS.values())]
    done = run_jobs(objs, members, jobs)
    base = done.where("job_id = 0").select(F.col("nmi_mean").alias("base"))
    names = F.element_at(F.array(*map(F.lit, VARIANTS)), F.col("job_id") + 1)
    return done.join(F.broadcast(base), F.lit(True)).select(names.alias("name"), "nmi_mean", "ari_mean", "f_mean", (F.col("nmi_mean") - F.col("base")).alias("gain"), "runs", "status")  # one row


def winners(results: DataFrame) -> DataFrame:
    """One row: the best single and consensus jobs by mean nmi, the gain of consensus, and who wins; ties go to the single one."""
    best = lambda f: F.max_by(F.when(F.col("family") == f, F.struct("algorithm", "nmi_mean")), F.when(F.col("family") == f, F.struct("nmi_mean", -F.col("job_id"))))
    b = results.where("status = 'ok'").agg(best("single").alias("s"), best("consensus").alias("c"))
    gain = F.col("c.nmi_mean") - F.col("s.nmi_mean")
    return b.select(F.col("s.algorithm").alias("single"), F.col("s.nmi_mean").alias("single_nmi"), F.col("c.algorithm").alias("consensus"), F.col("c.nmi_mean").alias("consensus_nmi"), gain.alias("gain"), F.when(gain > 0, "consensus").otherwise("single").alias("winner"))


def preprocessing_scores(objs: DataFrame, n_partitions: int = 8, strategy: str = "kmeans", **options) -> DataFrame:
    """(preprocessing, partitions, nmi, ari): mean scores of the base partitions that each way of preparing the features gives."""
    rows = []
    for mode in en.PREPARED:
        members = en.base_partitions(objs, n_partitions, strategy=strategy, preprocessing=mode, **options)
        rows.append(cp.member_scores(members, objs.select("obj_id", "gt")).select(F.lit(mode).alias("preprocessing"), "*"))
    return reduce(DataFrame.unionByName, rows)
