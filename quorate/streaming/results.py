"""A stream of result files into a keyed table: late or repeated files change nothing but their own key, and older rows nothing at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorate.sources.sinks import upsert_table

SCHEMA = "dataset string, algorithm string, method string, seed long, nmi double, ari double, f double, created_at string"
KEYS = ["dataset", "algorithm", "method", "seed"]


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each key by created_at."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("created_at"), F.desc("nmi")))).where("_r = 1").drop("_r")


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Read new JSON files under source and put their results into the table, all that is there now."""
    stream = spark.readStream.schema(SCHEMA).json(source)
    put = lambda batch, _: upsert_table(batch.sparkSession, table, latest(batch), KEYS, "created_at")
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
