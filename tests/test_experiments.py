import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.functions.shared import shared_folder
from quorate.operators import experiments as ex
from quorate.sources.versioned import VersionedTable


@pytest.fixture
def path(spark, tmp_path):
    return f"file://{tmp_path}/table"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_upsert_unique_ignore_delete(spark, path):
    t = VersionedTable(spark, path, ["path"], unique="name")
    assert t.read() is None and t.versions() == []
    put = lambda *rows: spark.createDataFrame(rows, "path string, name string, size int")
    t.upsert(put(("/a", "one", 1), ("/b", "two", 2)))
    t.upsert(put(("/c", "two", 3)))  # the name moves to another path
    assert rows_of(t.read(), "path", "name", "size") == [("/a", "one", 1), ("/c", "two", 3)]
    t.upsert(put(("/c", "two", 4)))
    t.insert_missing(put(("/a", "other", 9), ("/d", None, 5), (None, "none", 6)))
    assert rows_of(t.read(), "path", "size") == [("/a", 1), ("/c", 4), ("/d", 5), (None, 6)]
    t.insert_missing(put((None, "again", 7)))
    assert len(t.read().collect()) == 4
    t.delete("size > 4")
    assert rows_of(t.read(), "path", "size") == [("/a", 1), ("/c", 4)]
    assert rows_of(t.read(2), "path", "size") == [("/a", 1), ("/c", 3)]
    t.upsert(spark.createDataFrame([("/a", "one", 1, "x")], "path string, name string, size int, more string"))  # a new column
    assert rows_of(t.read(), "path", "more") == [("/a", "x"), ("/c", None)]


def test_compact_and_vacuum(spark, path):
    t = VersionedTable(spark, path, ["k"])
    for v in range(4):
        t.upsert(spark.createDataFrame([(v % 2, v)], "k int, v int"))
    t.compact()
    assert t.versions() == [1, 2, 3, 4, 5] and rows_of(t.read(), "k", "v") == [(0, 2), (1, 3)]
    assert t.vacuum(keep=1) == [] and t.versions() == [5]  # the folders are too young
    assert len(t.vacuum(keep=1, grace=-10)) == 4
    assert rows_of(t.read(), "k", "v") == [(0, 2), (1, 3)]
    t.upsert(spark.createDataFrame([(0, 9)], "k int, v int"))
    assert t.versions() == [5, 6] and rows_of(t.read(), "k", "v") == [(0, 9), (1, 3)]


def test_writers_at_once_lose_nothing(spark, path):
    failed = []

    def write(w):
        try:
            t = VersionedTable(spark, path, ["k"], unique="name")
            for i in range(3):
                t.upsert(spark.createDataFrame([(f"{w}-{i}", f"n{w}-{i}", w), ("shared", "s", w)], "k string, name string, v int"))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = VersionedTable(spark, path, ["k"])
    assert not failed and t.versions() == list(range(1, 10))
    assert [r[0] for r in rows_of(t.read(), "k")] == sorted([f"{w}-{i}" for w in range(3) for i in range(3)] + ["shared"])


def data(spark, n=24):
    r = np.random.default_rng(0)
    objs = spark.createDataFrame([(i, i % 3) for i in range(n)], "obj_id long, gt int")
    rows = [(i, p, int(i % 3 if r.random() < 0.8 else r.integers(0, 3))) for i in range(n) for p in range(4)]
    return objs, spark.createDataFrame(rows, "obj_id long, part_id int, cluster_id int")


def test_a_killed_start_goes_on(spark, path):
    """Half of the jobs, then a crash, then another start: what is done is not run again, failed jobs are."""
    sets = {"a": data(spark), "b": data(spark, 18)}
    jobs = ex.plan(spark, "x", sets, ["hierarchical", "weighted", "nonsense"], ["average", "ward"], [2, 9], ["random", "qd"], [0.5], runs=1)
    assert jobs.count() == 2 * 3 * 2 * 2 * 2 and jobs.where("m = 4").count() == 24  # m is cut to the partitions there are
    tried = []

    def solve(job, sets, crash):
        if len(tried) == crash:
            raise RuntimeError("killed")
        tried.append(tuple(job[k] for k in ex.KEYS))
        bad = job["algorithm"] == "nonsense"
        return (1, 4, *[None if bad else 0.5] * 6, 0.1, 1.0, "failed" if bad else "ok", "unknown" if bad else "")

    t = ex.ledger(spark, path)
    few = jobs.where("dataset = 'a' AND linkage = 'ward' AND m = 2")
    with pytest.raises(RuntimeError, match="killed"):
        ex.run(t, few, sets, 1, lambda j, d: solve(j, d, 3))
    assert t.read().count() == 3
    done = ex.run(t, few, sets, 2, lambda j, d: solve(j, d, -1))
    assert done.count() == few.count() == 6 and done.where("status = 'ok'").count() == 4
    assert len(tried) == 7  # the third one had failed
    again = ex.run(t, few, sets, 2, lambda j, d: solve(j, d, -1))
    assert again.count() == 6 and len(tried) == 9 and {k[2] for k in tried[7:]} == {"nonsense"}


def test_report_and_settings(spark, path):
    sets = {"a": data(spark)}
    t = ex.ledger(spark, path)
    jobs = ex.report_plan(spark, sets, runs=1, only=["linkage"]).where("linkage <> 'single'").unionByName(ex.plan(spark, "other", {"gone": sets["a"]}, ["weighted"], ["average"], [2], runs=1)).unionByName(ex.plan(spark, "linkage", sets, ["nonsense"], ["average"], [2], runs=1))
    done = ex.run(t, jobs, sets)
    ok = done.where("status = 'ok'").collect()
    assert len(ok) == 4 and all(r.m == 4 and 0 < r.nmi_mean <= 1 and r.seconds > 0 and r.memory_mb >= 0 and r.n_objects == 24 and r.error == "" for r in ok)
    bad = {r.dataset: r.error for r in done.where("status = 'failed'").collect()}
    assert "unknown algorithm" in bad["a"] and "no data set" in bad["gone"]
    by = {(r.algorithm, r.linkage): (r.jobs, r.failed) for r in ex.by_setting(done, "linkage").where("experiment = 'linkage'").collect()}
    assert by == {("hierarchical", "average"): (1, 0), ("hierarchical", "complete"): (1, 0), ("weighted", "average"): (1, 0), ("weighted", "complete"): (1, 0), ("nonsense", "average"): (1, 1)}
    assert ex.remaining(t, jobs).count() == 2
    assert shared_folder(spark)


def test_peak_memory_of_a_job(spark):
    import numpy as np

    from quorate.operators import benchmark as bm

    def allocates():
        x = np.ones(25_000_000)  # 200 MB
        return (x[:3] > 2).astype(int)

    row = bm.attempt({"job_id": 0, "run_id": 0}, np.arange(3), allocates).iloc[0]
    assert 150 < row["memory_mb"] < 400 and row["error"] is None
    assert bm.attempt({"job_id": 0, "run_id": 0}, np.arange(3), lambda: np.zeros(3, int)).iloc[0]["memory_mb"] < 50


def test_import_skips_invalid_files(spark, path, tmp_path):
    from quorate.sources.versioned import import_results

    folder = tmp_path / "results"
    folder.mkdir()
    good = '{"created_at": "2024-01-01", "dataset": "a", "algorithm": "x", "nmi_mean": 0.5}'
    for name, text in (("a.json", good), ("b.json", "no json"), ("c.json", '{"dataset": "a", "algorithm": "x"}'), ("d.json", good.replace('"a"', '""')), ("e.json", "[1, 2]"), ("f.txt", good)):
        (folder / name).write_text(text)
    t = VersionedTable(spark, path, ["result_file"])
    schema, required = "created_at string, dataset string, algorithm string, nmi_mean double", ["created_at", "dataset", "algorithm"]
    import_results(t, f"file://{folder}", schema, required)
    assert [(r.result_file.rsplit("/", 1)[1], r.nmi_mean) for r in t.read().collect()] == [("a.json", 0.5)]
    (folder / "a.json").write_text(good.replace("0.5", "0.9"))
    (folder / "g.json").write_text(good.replace("0.5", "0.7"))
    import_results(t, f"file://{folder}", schema, required)
    assert sorted((r.result_file.rsplit("/", 1)[1], r.nmi_mean) for r in t.read().collect()) == [("a.json", 0.5), ("g.json", 0.7)]
