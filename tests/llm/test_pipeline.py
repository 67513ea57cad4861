import corpus_pipeline
from pyspark.sql import functions as F

from quorate.llm import decontaminate, pii
from quorate.llm.common import Scratch, components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34 !!", "en", "s", 8), (-3, None, None, None, None)], docs.schema)
    docs = docs.unionByName(junk)
    for clash in ("score", "rid", "_rid", "k1", "_k1", "guess"):
        docs = docs.withColumn(clash, F.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        seen[name] = (docs, docs := after)
    language = {r.doc_id for r in seen["language"][1].collect()}
    assert language == {r.doc_id for r in seen["language"][0].where("doc_id >= 0").collect()}
    before, after = (x.count() for x in seen["near_duplicates"])
    assert after < before and after == seen["near_duplicates"][1].select("doc_id").distinct().count()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.contaminated(seen["near_duplicates"][1], bench).count() > 0
    assert decontaminate.contaminated(seen["decontamination"][1], bench).count() == 0
    assert pii.find(seen["personal_data"][1]).where("spans <> ''").count() == 0
    assert seen["personal_data"][1].where("n_chars <> length(text)").count() == 0


def test_near_duplicates_with_other_splits_in_each_scan(spark, sf, monkeypatch, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    find, before = corpus_pipeline.minhash.near_duplicates, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def resplit(*args, **options):
        found = find(*args, **options)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        return found

    monkeypatch.setattr(corpus_pipeline.minhash, "near_duplicates", resplit)
    try:
        got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), sf).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_empty_and_repeated(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(3)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        twice = stage(spark, some.unionByName(some), sf)
        if name in ("language", "decontamination", "personal_data"):
            assert twice.count() == 2 * stage(spark, some, sf).count()
        if name == "near_duplicates":
            assert twice.count() == stage(spark, some, sf).count()


def test_run(spark, sf):
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert pieces and {r.doc_id for r in pieces} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (20, 30), (30, 25), (4, 0)] + [(100 + k, 101 + k) for k in range(40)]
    with Scratch(spark, "test") as scratch:
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r.id: r.component for r in components(df, scratch).collect()}
        none = components(df.limit(0), scratch).count()
    want = {k: 0 for k in range(5)} | {10: 10, 11: 10, 20: 20, 30: 20, 25: 20} | {100 + k: 100 for k in range(41)}
    assert got == want and none == 0
