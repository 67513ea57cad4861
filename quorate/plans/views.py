"""Views of the driver tables as the clustering data model, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj_id, features array<double>, gt): the embeddings with their labels from 1."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obj_id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") + 1).alias("gt"))


def values(objs: DataFrame) -> DataFrame:
    """The long form (obj_id, gt, feat, value)."""
    return objs.select("obj_id", "gt", F.posexplode("features").alias("feat", "value"))


def members8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj_id, part_id, cluster_id): eight partitions by the signs of two features each."""
    sign = lambda i: F.when(F.col("embedding")[i] > 0, 1).otherwise(0)
    parts = F.array(*[F.struct(F.lit(j).alias("part_id"), (1 + sign(2 * j) + 2 * sign(2 * j + 1)).alias("cluster_id")) for j in range(8)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obj_id"), F.explode(parts).alias("m")).select("obj_id", "m.*")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, algorithm, seed, linkage, value, row_no): events as results of runs."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("dataset"), F.col("event_type").alias("algorithm"), (F.col("user_id") % 5).alias("seed"),
        F.element_at(F.array(*map(F.lit, ("average", "complete", "single"))), (F.col("user_id") % 3 + 1).cast("int")).alias("linkage"), "value", F.col("event_id").alias("row_no"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, algorithm, value): the mean result, to 6 digits."""
    return runs(spark, sf_dir).groupBy("dataset", "algorithm").agg(F.round(F.avg("value"), 6).alias("value"))


SQL = {
    "objects": "objects AS (SELECT vec_id AS obj_id, label + 1 AS gt, embedding AS e FROM embeddings)",
    "vals": "vals AS (SELECT vec_id AS obj_id, label + 1 AS gt, j AS feat, CAST(embedding[j + 1] AS DOUBLE) AS value FROM embeddings, range(0, 64) t(j))",
    "members": "members AS (SELECT vec_id AS obj_id, CAST(j AS INTEGER) AS part_id, 1 + (CASE WHEN embedding[2*j+1] > 0 THEN 1 ELSE 0 END) + 2 * (CASE WHEN embedding[2*j+2] > 0 THEN 1 ELSE 0 END) AS cluster_id FROM embeddings, range(0, 8) t(j))",
    "runs": "runs AS (SELECT strftime(ts, '%Y-%m-%d') AS dataset, event_type AS algorithm, user_id % 5 AS seed, CASE user_id % 3 WHEN 0 THEN 'average' WHEN 1 THEN 'complete' ELSE 'single' END AS linkage, value, event_id AS row_no FROM events)",
}
SQL["scores"] = SQL["runs"] + ", scores AS (SELECT dataset, algorithm, round(avg(value), 6) AS value FROM runs GROUP BY dataset, algorithm)"


def with_views(names: str, body: str) -> str:
    """A DuckDB query over the named views."""
    return f"WITH {', '.join(SQL[n] for n in names.split())} {body}" if "WITH+" not in body else f"WITH {', '.join(SQL[n] for n in names.split())}, {body.replace('WITH+', '').strip()}"
