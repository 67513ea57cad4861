"""Experiments that append and resume: a ledger of jobs in a versioned table, one keyed row a job.

A start runs only the jobs that have no row of status 'ok'; each row is put in when its job ends, so a start that is
killed loses the jobs it was in, and the next one goes on. A repeated row changes nothing but its own key. A job that
fails is a row with its error; it is tried again by the next start, whose row takes its place.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators import benchmark as bm
from quorate.operators import ensemble as en
from quorate.operators import reports as rp
from quorate.sources.versioned import VersionedTable

#: What names a job.
KEYS = ["experiment", "dataset", "algorithm", "linkage", "strategy", "alpha", "m", "runs", "seed"]
_HEAD = "experiment string, dataset string, algorithm string, linkage string, strategy string, alpha double, m int, runs int, seed int"
SCHEMA = f"{_HEAD}, n_objects long, n_members int, nmi_mean double, nmi_std double, ari_mean double, ari_std double, f_mean double, f_std double, seconds double, memory_mb double, status string, error string"
_VALUES = [x.split()[0] for x in SCHEMA.split(", ")][len(KEYS) :]

#: A data set: objects (obj_id, gt, ...) and members (obj_id, part_id, cluster_id).
Dataset = tuple[DataFrame, DataFrame]

#: Experiments of a report: name -> lists of algorithms, linkages, ensemble sizes and ways of selection with their alphas.
REPORT = {
    "main": {"algorithms": list(en.ALGORITHMS), "linkages": ["average"], "sizes": [20]},
    "linkage": {"algorithms": ["hierarchical", "weighted"], "linkages": ["average", "complete", "single"], "sizes": [20]},
    "ensemble_size": {"algorithms": ["hierarchical", "weighted"], "linkages": ["average"], "sizes": [5, 10, 20, 30, 50]},
    "selection": {"algorithms": ["hierarchical", "weighted"], "linkages": ["average"], "sizes": [20], "strategies": ["random", "qd"], "alphas": [0.3, 0.5, 0.7]},
}


def plan(spark: SparkSession, experiment: str, datasets: dict[str, Dataset], algorithms: list[str], linkages: list[str], sizes: list[int], strategies: list[str] | None = None, alphas: list[float] | None = None, runs: int = 3, seed: int = 19) -> DataFrame:
    """The jobs (KEYS) of an experiment; m is at most the number of a data set's partitions, alpha is for 'qd' alone, equal jobs are one."""
    rows = set()
    for name, (_, members) in datasets.items():
        parts = members.select("part_id").distinct().count()
        for algorithm in map(en.canonical, algorithms):
            for linkage in linkages:
                for m in sizes:
                    for strategy in strategies or ["random"]:
                        for alpha in (alphas or [0.5]) if strategy == "qd" else [None]:
                            rows.add((experiment, name, algorithm, linkage, strategy, alpha, min(m, parts), runs, seed))
    return spark.createDataFrame(sorted(rows, key=str), _HEAD)


def report_plan(spark: SparkSession, datasets: dict[str, Dataset], runs: int = 3, seed: int = 19, only: list[str] | None = None) -> DataFrame:
    """The jobs of all experiments of REPORT."""
    jobs = None
    for name, settings in REPORT.items():
        if only is None or name in only:
            new = plan(spark, name, datasets, runs=runs, seed=seed, **settings)
            jobs = new if jobs is None else jobs.unionByName(new)
    return jobs


def attempt(job: dict, data: Dataset) -> tuple:
    """The values of one job's row (SCHEMA after KEYS)."""
    objs, members = data
    shape = members.agg(F.countDistinct("obj_id").alias("n"), F.countDistinct("part_id").alias("m")).first()
    try:
        one = {"job_id": 0, "family": "consensus", "algorithm": job["algorithm"], "variant": job["strategy"], "linkage": job["linkage"], "m": job["m"], "alpha": job["alpha"], "seed": job["seed"], "runs": job["runs"], "params": job.get("params", {})}
        if one["algorithm"] not in en.ALGORITHMS:
            raise ValueError(f"unknown algorithm {one['algorithm']!r}")
        r = bm.run_jobs(objs, members, [one]).first()
        return (shape.n, shape.m, r.nmi_mean, r.nmi_std, r.ari_mean, r.ari_std, r.f_mean, r.f_std, r.seconds, r.memory_mb, r.status, r.error)
    except Exception as e:  # a failed job is a row
        return (shape.n, shape.m, *[None] * 8, "failed", f"{type(e).__name__}: {e}"[:200])


def ledger(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, KEYS)


def remaining(table: VersionedTable, jobs: DataFrame) -> DataFrame:
    """The jobs without a row of status 'ok'."""
    done = table.read()
    return jobs if done is None else rp.remaining(jobs, done.where("status = 'ok'"), KEYS)


def run(table: VersionedTable, jobs: DataFrame, datasets: dict[str, Dataset], parallelism: int = 4, solve: Callable[[dict, Dataset], tuple] = attempt) -> DataFrame:
    """Run what remains of the jobs, ``parallelism`` at a time, and put each row into the ledger as its job ends; the ledger's rows."""
    spark = table.spark
    todo = [r.asDict() for r in remaining(table, jobs).select(*KEYS).orderBy(*KEYS).collect()]  # a row a job

    def one(job: dict) -> None:
        if job["dataset"] not in datasets:
            values = (None, None, *[None] * 8, "failed", f"no data set {job['dataset']!r}")
        else:
            values = solve(job, datasets[job["dataset"]])
        table.upsert(spark.createDataFrame([(*(job[k] for k in KEYS), *values)], SCHEMA))

    with ThreadPool(parallelism) as pool:  # each thread waits for Spark jobs
        pool.map(inheritable_thread_target(spark)(one), todo, chunksize=1)
    if len(table.versions()) > 100:
        table.compact()
    done = table.read()
    return spark.createDataFrame([], SCHEMA) if done is None else done.select(*KEYS, *_VALUES)


def by_setting(rows: DataFrame, column: str, metric: str = "nmi_mean") -> DataFrame:
    """(experiment, algorithm, column, jobs, failed, mean, best): how a setting - linkage, m or strategy - changes the results."""
    ok = F.when(F.col("status") == "ok", F.col(metric))
    return rows.groupBy("experiment", "algorithm", column).agg(F.count("*").alias("jobs"), F.count_if(F.col("status") != "ok").alias("failed"), F.avg(ok).alias("mean"), F.max(ok).alias("best"))
