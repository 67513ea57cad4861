"""Writers: data sets, appended and replaced result tables, keyed upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.operators import ensemble
from quorate.operators.comparisons import json_rows
from quorate.operators.reports import upsert


def write_bundle(objs: DataFrame, members: DataFrame | None, path: str) -> None:
    """objects and members under one folder, partitioned by data set where they have that column."""
    for name, df in (("objects", objs), ("members", members)):
        if df is not None:
            w = df.write.mode("overwrite")
            (w.partitionBy("dataset") if "dataset" in df.columns else w).parquet(f"{path}/{name}")


def write_with_ensemble(objs: DataFrame, path: str, **options) -> DataFrame:
    """A bundle whose members are built from the objects' features; returns the members as stored."""
    write_bundle(objs, ensemble.base_partitions(objs, **options), path)
    return objs.sparkSession.read.parquet(f"{path}/members")


def append_tsv(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Rows as TSV with a header; nulls are empty."""
    rows.write.mode("overwrite" if replace else "append").option("sep", "\t").option("header", True).option("nullValue", "").csv(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Put new rows into the Parquet table under path by key: a new version is written, then the pointer to it moves.

    With ``order`` the row of the largest value of that column stays for a key, so late old rows change nothing. The
    pointer is replaced by a rename, so readers see the old version or the new one. One writer at a time.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    fs = pointer.getFileSystem(conf)
    current = f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}" if fs.exists(pointer) else None
    if current and order:
        both = spark.read.parquet(current).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        first = W.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
        merged = both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_new")
    else:
        merged = upsert(spark.read.parquet(current), new, keys) if current else new
    version = f"v-{uuid.uuid4().hex}"
    merged.write.parquet(f"{path}/{version}")
    written = jvm.org.apache.hadoop.fs.Path(f"{path}/_{version}.pointer")
    out = fs.create(written, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(written), fs.makeQualified(pointer), how)
    return read_table(spark, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}")


def without_ghosts(registry: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Registry rows whose file is still among ``existing``."""
    return registry.join(existing.select(F.col(key)).distinct(), key, "left_semi")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row, in place of what the folder held; NaN and infinite numbers become null."""
    json_rows(rows).write.mode("overwrite").text(path)


def write_profile(candidates: DataFrame, best: DataFrame, path: str, metric: str) -> None:
    """The chosen profile as JSON under path/profile and all candidates as TSV under path/candidates."""
    write_json(best.select("*", F.lit(metric).alias("selection_metric"), F.lit("validation").alias("selected_on")), f"{path}/profile")
    append_tsv(candidates, f"{path}/candidates", replace=True)


def markdown(rows: DataFrame, title: str, digits: int = 3, max_rows: int = 1000) -> str:
    """A titled Markdown table of at most ``max_rows`` rows, which is checked: reports are short."""
    found = rows.limit(max_rows + 1).collect()
    if len(found) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in found)]) + "\n"


def write_markdown(tables: dict[str, DataFrame], path: str) -> None:
    """A report of titled tables as one text under path, in place of what it held."""
    spark = next(iter(tables.values())).sparkSession
    text = "\n".join(markdown(rows, title) for title, rows in tables.items())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def snapshot(spark: SparkSession, path: str, name: str) -> str:
    """The version of the table under path that is current, registered as the view ``name``; later versions do not change it."""
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    spark.read.parquet(f"{path}/{version}").createOrReplaceTempView(name)
    return version
