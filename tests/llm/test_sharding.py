from collections import Counter
import zlib

from pyspark.sql import functions as F

from quorate.llm import sharding


def test_hypergeometric_law(spark):
    q = sharding.hypergeometric("3L", "10L", "4L", sharding.uniform("id"))
    got = Counter(r.x for r in spark.range(40000).selectExpr(f"{q} AS x").collect())
    want = {0: 35 / 210, 1: 105 / 210, 2: 63 / 210, 3: 7 / 210}
    assert all(abs(got[k] / 40000 - p) < 0.012 for k, p in want.items())
    edge = spark.sql(f"SELECT {sharding.hypergeometric('0L', '5L', '2L', '0.5D')} a, {sharding.hypergeometric('5L', '5L', '2L', '0.5D')} b, {sharding.hypergeometric('3L', '5L', '5L', '0.5D')} c").first()
    assert tuple(edge) == (0, 2, 3)


def test_matrix_sums(spark):
    sizes = spark.createDataFrame([(b, 50 + b) for b in range(13)], "block long, n long")
    total = sum(50 + b for b in range(13))
    shards = [total // 5 + (j < total % 5) for j in range(5)]
    rows = sharding.communication_matrix(sizes, 13, shards, 3).collect()
    assert {r.block: sum(r.dealt) for r in rows} == {b: 50 + b for b in range(13)}
    assert [sum(r.dealt[j] for r in rows) for j in range(5)] == shards
    assert min(min(r.dealt) for r in rows) >= 0


def test_empty_blocks_and_many_levels(spark):
    sizes = spark.createDataFrame([(b, 3) for b in range(0, 300, 7)], "block long, n long")
    total = 3 * len(range(0, 300, 7))
    rows = sharding.communication_matrix(sizes, 300, [total - 10, 10], 5).collect()
    assert {r.block: sum(r.dealt) for r in rows} == {b: 3 for b in range(0, 300, 7)}
    assert [sum(r.dealt[j] for r in rows) for j in (0, 1)] == [total - 10, 10]


def test_every_row_goes_everywhere(spark):
    """Where 64 rows end up over many shuffles, against the even law: chi-square of (row, shard) and of (row, half of the slots)."""
    docs = spark.range(64).selectExpr("id as doc_id", "'' as text").coalesce(1)
    seen, times = Counter(), 10
    for seed in range(times):
        for r in sharding.shuffle_into_shards(docs, shards=4, seed=seed, block_rows=9).collect():
            seen["shard", r.doc_id % 8, r.shard] += 1
            seen["half", r.doc_id % 8, r.slot // 8] += 1
    for what, cells in (("shard", 4), ("half", 2)):
        even = times * 8 / cells
        chi = sum((seen[what, k, c] - even) ** 2 / even for k in range(8) for c in range(cells))
        assert chi < 8 * (cells - 1) + 5 * (2 * 8 * (cells - 1)) ** 0.5, (what, chi)


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "1 as shard", "2 as rid")
    docs = docs.unionByName(spark.createDataFrame([(None, None, 0, 0), (7, "é", 0, 0), (7, "é", 0, 0)], docs.schema))
    for block_rows in (1 << 14, 10):
        rows = sharding.shuffle_into_shards(docs, block_rows=block_rows).collect()
        n = Counter(r.shard for r in rows)
        assert len(rows) == docs.count() and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(16))
        for s in n:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
        assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 7 and r.size == 3} == {(3, zlib.crc32("é".encode()))}
        assert [(r.size, r.text_crc32) for r in rows if r.doc_id is None] == [(1, 0)]
    again = sharding.shuffle_into_shards(docs).select("shard", "slot", F.col("doc_id")).collect()
    assert sorted(map(str, again)) == sorted(map(str, sharding.shuffle_into_shards(docs).select("shard", "slot", "doc_id").collect()))
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0
    assert sharding.shuffle_into_shards(docs.limit(3)).count() == 3
