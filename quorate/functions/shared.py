"""Tables of one call in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a fresh folder in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return root.rstrip("/")


def filesystem(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop for a path of any scheme."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Tables:
    """Written tables cut lineage and outlive lost executors. ``drop`` gives one up; what ``keep`` wrote stays when the with block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[str, str] = {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths.values():
            self._delete(path)

    def _delete(self, path: str) -> None:
        fs, at = filesystem(self.spark, path)
        fs.delete(at, True)

    def write(self, df: DataFrame) -> DataFrame:
        """df written once, as a table to read."""
        out, path = self._written(df)
        self.paths[path] = path
        out.shared_path = path
        return out

    def counted(self, df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
        """df written, and how many of its rows (those of a condition) there are, counted as they are written."""
        seen = Observation()
        out = self.write(df.observe(seen, (F.count(F.lit(1)) if which is None else F.count_if(which)).alias("n")))
        return out, seen.get["n"]

    def _written(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, df: DataFrame) -> None:
        self._delete(self.paths.pop(df.shared_path))

    def release(self) -> None:
        """Let Spark drop the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, df: DataFrame) -> DataFrame:
        """df written for the caller, in the shared folder like a checkpoint."""
        return self._written(df)[0]
