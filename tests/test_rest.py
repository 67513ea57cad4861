"""What queries reach but no other test names: sources, plans, ablations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import benchmark as bm
from quorate.operators import ensemble as en
from quorate.operators import features as ft
from quorate.sources import readers, sinks

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_database(spark, tmp_path):
    """Bound parameters, ranges of a key in several tasks, and filters that reach the database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"it's {i % 3}", i * 0.5) for i in range(20)], "id int, name string, v double")
    query = 'SELECT "ID", "NAME", "V" FROM t WHERE "NAME" = %s AND "V" > %s'
    rows.toDF("ID", "NAME", "V").write.option("createTableColumnTypes", "NAME VARCHAR(40)").jdbc(url, "t", properties=DERBY)
    got = readers.database(spark, url, query, ("it's 1", 2), **DERBY)
    assert sorted(r[0] for r in got.collect()) == [7, 10, 13, 16, 19]
    parts = readers.database(spark, url, 'SELECT "ID", "V" FROM t', by=("ID", 0, 20, 4), **DERBY)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 20
    few = parts.where("ID < 5").select("ID")
    assert "PushedFilters: [*IsNotNull(ID), *LessThan(ID,5)" in few._jdf.queryExecution().toString() and few.count() == 5
    assert readers.bound("a = %s AND b = %s AND c LIKE 'x%%' OR d = %s", (None, True, 1.5)) == "a = NULL AND b = TRUE AND c LIKE 'x%' OR d = 1.5"
    assert readers.bound("n = %s", ("x'; DROP TABLE t; --",)) == "n = 'x''; DROP TABLE t; --'"
    for query, params in (("%s", ()), ("a", (1,)), ("%s", (float("nan"),))):
        with pytest.raises(ValueError):
            readers.bound(query, params)


def test_ids_of_lines_do_not_depend_on_splits(spark, tmp_path):
    for name, first in (("b.csv", 300), ("a.csv", 0)):
        (tmp_path / name).write_text("x,y,gt\n" + "\n".join(f"{i},{i * 2},{i % 3}\n" if i % 50 == 7 else f"{i},{i * 2},{i % 3}" for i in range(first, first + 300)))
    ids = []
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            ids.append({r.obj_id: r.features[0] for r in readers.delimited(spark, str(tmp_path), ",").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len(ids[0]) == 600
    assert ids[0][1] == 0.0 and ids[0][300] == 299.0 and ids[0][302] == 300.0  # each file's header is a line


def test_truthy_and_constant(spark):
    rows = spark.createDataFrame([(" Yes ",), ("0",), ("TRUE",), (None,), ("",)], "x string")
    assert [r[0] for r in rows.select(readers.truthy("x")).collect()] == [True, False, True, None, False]
    values = spark.createDataFrame([(i, f, float(f * i)) for i in range(4) for f in range(3)], "obj_id long, feat int, value double")
    assert {r.feat for r in ft.drop_constant(values).collect()} == {1, 2}


def data(spark, n=36, seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(c, 0.4, (n // 3, 2)) for c in ((0, 0), (6, 0), (3, 6))])
    objs = spark.createDataFrame([(i, v.tolist(), i // (n // 3) + 1) for i, v in enumerate(x)], "obj_id long, features array<double>, gt int")
    rows = [(i, p, int((i // (n // 3)) if r.random() < 0.85 else r.integers(0, 3))) for i in range(n) for p in range(6)]
    return objs, spark.createDataFrame(rows, "obj_id long, part_id int, cluster_id int")


def test_ablation_and_single_clusterers(spark):
    objs, members = data(spark)
    rows = {r.name: r for r in bm.ablation(members, objs, m=5, runs=1).collect()}
    assert set(rows) == set(bm.VARIANTS) and rows["plain"].gain == 0 and all(r.status == "ok" and r.nmi_mean > 0.6 for r in rows.values())
    found = en.single_clusterers(objs, 3).join(objs, "obj_id").groupBy("algorithm").agg(F.countDistinct("label").alias("k"), F.countDistinct("label", "gt").alias("pairs"))
    assert {r.algorithm: (r.k, r.pairs) for r in found.collect()} == {a: (3, 3) for a in ("kmeans", "average", "complete", "single", "ward")}
    scores = {r.preprocessing: r for r in bm.preprocessing_scores(objs, 3, k_min=3, k_max=3, subsets=False).collect()}
    assert set(scores) == set(en.PREPARED) and all(r.nmi > 0.5 for r in scores.values())


def test_diverse_plan_is_greedy(spark):
    _, members = data(spark)
    x = np.array([[r.cluster_id for r in sorted(g, key=lambda r: r.part_id)] for g in _by_object(members)])
    same = [x[:, None, p] == x[None, :, p] for p in range(6)]
    agree = np.array([[(a == b).mean() for b in same] for a in same])
    quality = (agree.sum(1) - 1) / 5
    chosen = [int(quality.argmax())]
    while len(chosen) < 3:
        rest = [p for p in range(6) if p not in chosen]
        chosen.append(max(rest, key=lambda p: 0.5 * quality[p] + 0.5 * (1 - agree[p, chosen].mean())))
    plan = en.diverse_plan(members, 3, 2)
    assert {(r.run_id, r.part_id) for r in plan.collect()} == {(run, p) for run in (0, 1) for p in chosen}


def _by_object(members):
    rows = {}
    for r in members.collect():
        rows.setdefault(r.obj_id, []).append(r)
    return [rows[k] for k in sorted(rows)]


def test_write_with_ensemble(spark, tmp_path):
    objs, _ = data(spark)
    stored = sinks.write_with_ensemble(objs, str(tmp_path / "set"), n_partitions=3, strategy="kmeans")
    assert stored.count() == 36 * 3 and spark.read.parquet(str(tmp_path / "set" / "objects")).count() == 36


def test_covariances_against_numpy(spark):
    """Summed in tasks over many partitions, far from the origin, with classes of one object."""
    r = np.random.default_rng(2)
    x = r.normal(1e6, 1, (50, 4)) @ r.normal(size=(4, 4))
    g = [0] * 30 + [1] * 19 + [2]
    rows = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, g, strict=True))], "obj_id long, x array<double>, gt int").repartition(6)
    got = {k: ft.covariance(p.drop(columns="gt")) for k, p in ft.comoments(rows, ["gt"]).toPandas().groupby("gt")}
    for k in (0, 1):
        own = x[np.array(g) == k]
        assert np.allclose(got[k][0], np.cov(own.T), rtol=1e-6) and got[k][1] == len(own)
    assert np.allclose(got[2][0], 0) and got[2][1] == 1
