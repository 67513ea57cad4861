import json

import numpy as np
import pytest

from quorate.sources import readers, sinks
from quorate.streaming import results


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited(spark, tmp_path):
    a = readers.delimited(spark, put(tmp_path / "a.csv", "﻿f1,gt,f2\n1,0,2\n3,1,4\n5,1,6\n7,0,8\n")).orderBy("obj_id").collect()
    assert [r.features for r in a] == [[1, 2], [3, 4], [5, 6], [7, 8]] and [r.gt for r in a] == [0, 1, 1, 0]
    b = readers.delimited(spark, put(tmp_path / "b.tsv", "1\t2\tcat\n3\t4\tdog\n5\t6\tcat\n")).orderBy("obj_id").collect()
    assert [r.gt for r in b] == [0, 1, 0] and b[0].features == [1, 2]
    c = readers.delimited(spark, put(tmp_path / "c.txt", "1  2 0.5\n3 4   10.5\n")).orderBy("obj_id").collect()
    assert [r.gt for r in c] == [0, 1]
    with pytest.raises(ValueError):
        readers.delimited(spark, put(tmp_path / "d.csv", "1\n2\n"))
    with pytest.raises(Exception, match="width"):
        readers.delimited(spark, put(tmp_path / "e.csv", "a,b,gt\n1,2,0\n1,2\n")).select("features").collect()


def test_bundles(spark, tmp_path):
    full = {"X": [[1.0, 2.0], [3.0, 4.0]], "gt": [0, 1], "members": [[1, 1, 2], [2, 1, 2]]}
    objs, members = readers.json_bundle(spark, put(tmp_path / "a.json", json.dumps(full)))
    assert objs.count() == 2 and members.count() == 6
    assert [r.gt for r in readers.rebased(objs).orderBy("obj_id").collect()] == [1, 2]
    for bad, what in (([1, 2, 3], "object"), ({"gt": [1]}, "X"), ({"X": [[1.0]]}, "gt")):
        with pytest.raises(ValueError, match=what):
            readers.json_bundle(spark, put(tmp_path / "b.json", json.dumps(bad)))
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "one.npz", data=np.ones((2, 5)), label=np.array([0, 1, 1, 0, 1]), members=np.ones((5, 3), dtype=int))
    objs, members = readers.arrays(spark, str(tmp_path / "npz"))
    assert [len(r.features) for r in objs.collect()] == [2] * 5 and {r.gt for r in objs.collect()} == {1, 2} and members.count() == 15


def test_results_and_sinks(spark, tmp_path):
    assert readers.results(spark, str(tmp_path / "none"), ["nmi"], ["dataset", "nmi"]).count() == 0
    rows = spark.createDataFrame([("a", "0.5", "ok", "5"), ("b", "", "failed", "5"), ("c", "x", "ok", "2")], "dataset string, nmi string, status string, runs string")
    sinks.append_tsv(rows, str(tmp_path / "r"))
    sinks.append_tsv(rows.limit(1), str(tmp_path / "r"))
    back = readers.results(spark, str(tmp_path / "r"), ["nmi"])
    assert back.count() == 4 and back.where("nmi IS NULL").count() == 2
    assert [r.source for r in readers.combined({"x": back, "y": rows.drop("runs", "nmi").limit(1)}).orderBy("source").collect()] == ["x", "x", "y"]
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):  # the second time changes nothing
        sinks.upsert_table(spark, path, one, ["k"])
    got = sinks.upsert_table(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.without_ghosts(got, one.select("k"), "k").count() == 2


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = {"dataset": "a", "algorithm": "h", "method": "average", "seed": 1, "nmi": 0.5, "created_at": "2024-01-01"}
    put(source / "1.json", json.dumps(row) + "\n" + json.dumps(row | {"nmi": 0.6, "created_at": "2024-01-02"}))
    run = lambda: results.ingest(spark, f"file://{source}", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    run()
    assert [r.nmi for r in sinks.read_table(spark, str(tmp_path / "t")).collect()] == [0.6]
    put(source / "2.json", json.dumps(row | {"seed": 2}) + "\n" + json.dumps(row | {"nmi": 0.7, "created_at": "2024-01-03"}) + "\n" + json.dumps(row | {"seed": 2, "nmi": 0.1, "created_at": "2023-01-01"}))
    run()
    assert sorted((r.seed, r.nmi) for r in sinks.read_table(spark, str(tmp_path / "t")).collect()) == [(1, 0.7), (2, 0.5)]
    put(source / "3.json", json.dumps(row | {"nmi": 0.9, "created_at": "2023-05-05"}))
    run()
    assert sorted((r.seed, r.nmi) for r in sinks.read_table(spark, str(tmp_path / "t")).collect()) == [(1, 0.7), (2, 0.5)]


def mat(variables):
    """A MAT file of version 5: every second variable compressed."""
    import struct
    import zlib

    pad = lambda b: b + bytes(-len(b) % 8)
    element = lambda kind, b: struct.pack("<II", kind, len(b)) + pad(b)
    out = bytes(124) + b"\x00\x01IM"
    for k, (name, a) in enumerate(variables.items()):
        kind = {"f8": 9, "i4": 5, "u1": 2}[a.dtype.str[1:]]
        label = struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *a.shape)) + label + element(kind, a.tobytes(order="F"))
        whole = element(14, body)
        packed = zlib.compress(whole)
        out += struct.pack("<II", 15, len(packed)) + packed if k % 2 else whole
    return out


def test_any_file(spark, tmp_path):
    x, gt, m = np.arange(12.0).reshape(6, 2), np.array([[0, 1, 1, 0, 2, 2]], dtype=np.int32), np.ones((6, 4), dtype=np.uint8)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.mat").write_bytes(mat({"fea": x, "gt": gt, "members": m}))
    objs, members = readers.load(spark, str(tmp_path / "deep" / "one.mat"))
    assert sorted((r.obj_id, *r.features, r.gt) for r in objs.collect()) == [(k, 2.0 * k, 2.0 * k + 1, int(gt[0, k]) + 1) for k in range(6)]
    assert members.count() == 24
    np.savez(tmp_path / "one.npz", X=x, gt=gt)
    put(tmp_path / "two.csv", "a,b,gt\n1,2,0\n3,4,1\n")
    put(tmp_path / "two.json", json.dumps({"X": [[1.0]], "gt": [0]}))
    put(tmp_path / "smoke_x.csv", "1,2,0\n")
    put(tmp_path / "notes.md", "x")
    found = {(r.dataset, r.suffix) for r in readers.discover(spark, str(tmp_path)).collect()}
    assert found == {("one", "npz"), ("one", "mat"), ("two", "csv"), ("two", "json")}
    registry = spark.createDataFrame([("three", "/x/three.csv")], "dataset string, path string")
    where = lambda n: readers.resolve(spark, n, registry, str(tmp_path))
    assert where("three") == "/x/three.csv" and where("one").endswith("one.npz") and where("two").endswith("two.csv") and where("no") is None
    s = readers.summary(spark, str(tmp_path / "deep" / "one.mat")).first()
    assert (s.n_objects, s.n_features, s.n_classes, s.n_partitions, s.error) == (6, 2, 3, 4, None)
    assert "suffix" in readers.summary(spark, str(tmp_path / "notes.md")).first().error
    assert readers.manifest(spark, put(tmp_path / "m.tsv", "dataset\tn\na\t5\n")).first().n == "5"
    (tmp_path / "parts").mkdir()
    for k in range(2):
        put(tmp_path / "parts" / f"{k}.csv", f"a,b,gt\n{k},2,0\n3,4,1\n")
    assert readers.delimited(spark, str(tmp_path / "parts"), ",").count() == 4
