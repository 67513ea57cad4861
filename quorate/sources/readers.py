"""Readers of data sets as (obj_id, features, gt) and (obj_id, part_id, cluster_id), whatever the file format."""

from __future__ import annotations

import io
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of a label column, of features and of labels in array files. Fixed values.
LABEL_NAMES = ("gt", "label", "labels", "target", "class", "y")
FEATURE_KEYS = ("X", "x", "data", "fea", "features")
LABEL_KEYS = ("gt", "label", "y")
TRUE_WORDS = ("1", "true", "yes", "on")


def truthy(column: str):
    return F.lower(F.trim(F.col(column))).isin(*TRUE_WORDS)


def numbered(lines: DataFrame) -> DataFrame:
    """lines(value) read from files, with obj_id: their places through all files by name, from 0, the same for any splits."""
    split = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    placed = lines.withColumns(split)  # a split's ids are consecutive
    splits = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))  # a row a split
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0)))
    return placed.join(splits, ["_file", "_block"]).select("value", (F.col("_before") + F.col("_id") - F.col("_first")).alias("obj_id"))


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(obj_id, features, gt, label): a CSV, TSV or white-space table.

    The first line is a header unless all of its fields, or all but the last, are numbers. The label is the first
    column whose name is in LABEL_NAMES, else the last. Whole-number labels stay; others are numbered from 0 in the
    order of their text. obj_id is the number of the line through all files in the order of their names, blank lines
    left out, however the input is split. Rows of another width and tables without a feature raise.
    """
    lower = path.lower()
    sep = sep or ("," if lower.endswith(".csv") else "\t" if lower.endswith(".tsv") else r"\s+")
    pattern = sep if sep == r"\s+" else f"\\Q{sep}\\E"
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.length(F.trim("value")) > 0)
    rows = numbered(lines).select("obj_id", F.transform(F.split(F.trim("value") if sep == r"\s+" else F.col("value"), pattern, -1), lambda x: F.trim(x)).alias("f"))
    head = rows.orderBy("obj_id").first()
    if head is None:
        raise ValueError("the table is empty")
    fields, width = head["f"], len(head["f"])
    if width < 2:
        raise ValueError("at least one feature and a label are needed")

    def number(s: str) -> bool:
        try:
            float(s)
        except ValueError:
            return False
        return True

    has_header = not (all(map(number, fields)) or all(map(number, fields[:-1])))
    if has_header:
        rows = rows.where(~(F.col("f") == F.array(*map(F.lit, fields))))  # each file of a folder has one
    names = [n.strip().lower() for n in fields] if has_header else []
    at = next((i for i, n in enumerate(names) if n in LABEL_NAMES), width - 1)
    wrong = F.raise_error(F.concat(F.lit("a row has another width: "), F.array_join("f", ",")))
    checked = rows.withColumn("f", F.when(F.size("f") == width, F.col("f")).otherwise(wrong.cast("array<string>")))
    values = F.transform(F.filter("f", lambda x, i: i != at), lambda x: x.try_cast("double"))
    return encode_labels(checked.select("obj_id", values.alias("features"), F.col("f")[at].alias("label")))


def encode_labels(rows: DataFrame) -> DataFrame:
    """rows with ``gt``: label as a whole number if all are, else its place among the distinct labels' texts, from 0."""
    whole = F.expr("try_cast(label AS DOUBLE)")
    names = rows.select("label").distinct()
    all_whole = names.select(F.min(F.coalesce((whole == F.floor(whole)).cast("int"), F.lit(0))).alias("w")).first()["w"]
    if all_whole:
        return rows.withColumn("gt", whole.cast("long"))
    ranked = names.withColumn("gt", (F.row_number().over(W.orderBy("label")) - 1).cast("long"))  # one row a class
    return rows.join(ranked, "label").select("obj_id", "features", "label", "gt")


def rebased(labels: DataFrame, base: int = 1) -> DataFrame:
    """labels with gt moved so that its smallest value is base."""
    return labels.crossJoin(F.broadcast(labels.agg(F.min("gt").alias("_low")))).withColumn("gt", F.col("gt") - F.col("_low") + base).drop("_low")


def json_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects and members of a JSON object {X, gt, members}; members may be missing; anything but an object raises."""
    schema = T.StructType([T.StructField("X", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("gt", T.ArrayType(T.LongType())), T.StructField("members", T.ArrayType(T.ArrayType(T.IntegerType())))])
    bundle = spark.read.schema(schema).option("multiLine", True).json(path)
    have = bundle.agg(F.count("X"), F.count("gt"), F.count("*")).first()
    if have[2] != 1 or not (have[0] or have[1]):
        raise ValueError("a JSON object with X and gt is needed")
    for key, n in (("X", have[0]), ("gt", have[1])):
        if not n:
            raise ValueError(f"{key} is missing")
    objs = bundle.select("gt", F.posexplode("X").alias("obj_id", "features")).select(F.col("obj_id").cast("long"), "features", F.col("gt")[F.col("obj_id")].alias("gt"))
    members = bundle.select(F.posexplode("members").alias("obj_id", "m")).select(F.col("obj_id").cast("long").alias("obj_id"), F.posexplode("m").alias("part_id", "cluster_id"))
    return objs, members


#: Numeric element types of MAT files of version 5. Fixed values.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED = 14, 15


def mat_arrays(content: bytes) -> dict[str, np.ndarray]:
    """The numeric matrices of a MAT file of version 5 by name; other variables are left out."""
    order = "<" if content[126:128] == b"IM" else ">"
    found: dict[str, np.ndarray] = {}

    def elements(data: bytes) -> Iterator[tuple[int, bytes]]:
        at = 0
        while at + 8 <= len(data):
            kind, size = np.frombuffer(data, dtype=order + "u4", count=2, offset=at).tolist()
            if kind >> 16:  # a small element: its size and type share a word, its data the next
                yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
                at += 8
            else:
                yield kind, data[at + 8 : at + 8 + size]
                at += 8 + (size if kind == MAT_COMPRESSED else -(-size // 8) * 8)

    def visit(data: bytes) -> None:
        for kind, body in elements(data):
            if kind == MAT_COMPRESSED:
                visit(zlib.decompress(body))
            elif kind == MAT_MATRIX:
                parts = list(elements(body))
                if len(parts) >= 4 and parts[3][0] in MAT_TYPES:
                    shape = np.frombuffer(parts[1][1], dtype=order + "i4").tolist()
                    values = np.frombuffer(parts[3][1], dtype=order + MAT_TYPES[parts[3][0]])
                    if len(values) == int(np.prod(shape)):
                        found[parts[2][1].decode("ascii")] = values.reshape(shape, order="F")

    visit(content[128:])
    return found


def array_file(name: str, content: bytes) -> dict[str, np.ndarray]:
    if name.lower().endswith(".mat"):
        return mat_arrays(content)
    with np.load(io.BytesIO(content)) as z:
        return {k: z[k] for k in z.files}


def arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects and members of .npz and .mat files, one file a data set: (dataset, obj_id, features, gt), (dataset, obj_id, part_id, cluster_id).

    Features stand under any of FEATURE_KEYS and are turned if only their other side has the labels' length; labels
    that begin at 0 are moved to 1.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{npz,mat}").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                z = array_file(name, content)
                x = next((z[k] for k in FEATURE_KEYS if k in z), None)
                gt = next((z[k].reshape(-1).astype(np.int64) for k in LABEL_KEYS if k in z), None)
                m = z.get("members")
                if x is None and gt is None and m is None:
                    raise ValueError(f"{name}: no features, labels or members")
                n = len(gt) if gt is not None else len(x if x is not None else m)
                if x is not None and len(x) != n and x.shape[1] == n:
                    x = x.T
                if any(a is not None and len(a) != n for a in (x, m)):
                    raise ValueError(f"{name}: arrays differ in length")
                gt = gt + (gt.min() == 0) if gt is not None else None
                yield pd.DataFrame({"dataset": name.rsplit("/", 1)[-1][:-4], "obj_id": np.arange(n), "features": list(x.astype(float)) if x is not None else None, "gt": gt, "clusters": list(m.astype(np.int32)) if m is not None else None})

    rows = files.mapInPandas(read, "dataset string, obj_id long, features array<double>, gt long, clusters array<int>")
    return rows.select("dataset", "obj_id", "features", "gt"), rows.where("clusters IS NOT NULL").select("dataset", "obj_id", F.posexplode("clusters").alias("part_id", "cluster_id"))


#: Suffixes of data sets, the preferred one first. Fixed values.
SUFFIXES = ("npz", "mat", "csv", "tsv", "txt", "json")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Objects and members (None where the format has none) of a file of any of SUFFIXES; another suffix raises."""
    suffix = path.lower().rpartition(".")[2]
    if suffix in ("npz", "mat"):
        return arrays(spark, path)
    if suffix in ("csv", "tsv", "txt"):
        return delimited(spark, path), None
    if suffix == "json":
        return json_bundle(spark, path)
    raise ValueError(f"unsupported suffix {suffix!r}")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row of a file: objects, features, classes, partitions, and the error (null if there is none) that loading it gave."""
    shape = "n_objects long, n_features int, n_classes long, n_partitions long, error string"
    try:
        objs, members = load(spark, path)
        x = objs.agg(F.count("*").alias("n_objects"), F.max(F.size("features")).alias("n_features"), F.count_distinct("gt").alias("n_classes")).first()
        parts = members.agg(F.count_distinct("part_id")).first()[0] if members is not None else 0
        row = (x.n_objects, x.n_features, x.n_classes, parts, None)
    except Exception as e:  # a file that cannot be read is a result here
        row = (None, None, None, None, f"{type(e).__name__}: {e}"[:200])
    return spark.createDataFrame([(path, *row)], f"path string, {shape}")


def discover(spark: SparkSession, folder: str, skip: str = "smoke") -> DataFrame:
    """(dataset, path, suffix, place): files of SUFFIXES under a folder, at any depth, without those named like ``skip``; place ranks suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    place = F.array_position(F.array(*map(F.lit, SUFFIXES)), suffix)
    found = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("dataset"), "path", suffix.alias("suffix"), place.cast("int").alias("place"))
    return found.where(F.col("place") > 0).where(~F.lower("dataset").contains(skip))


def resolve(spark: SparkSession, name: str, registry: DataFrame | None, *folders: str) -> str | None:
    """The path of a data set: the registry's (dataset, path) if it has the name, else the file of the best suffix in the first folder that has one."""
    if registry is not None and (row := registry.where(F.col("dataset") == name).orderBy("path").first()):
        return row.path
    for folder in folders:
        if row := discover(spark, folder).where(F.col("dataset") == name).orderBy("place", "path").first():
            return row.path
    return None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV with a header, all columns as text."""
    return spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",").csv(path)


def bound(query: str, params: tuple) -> str:
    """The query with its %s in turn replaced by literals: numbers, quoted texts, NULL, TRUE and FALSE. %% is a percent sign."""

    def literal(v) -> str:
        if v is None or isinstance(v, bool):
            return {None: "NULL", True: "TRUE", False: "FALSE"}[v]
        if isinstance(v, (int, float)):
            if isinstance(v, float) and not math.isfinite(v):
                raise ValueError("a bound number must be finite")
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    left = list(params)
    pieces = re.split(r"(%s|%%)", query)
    if pieces.count("%s") != len(left):
        raise ValueError(f"{pieces.count('%s')} places for {len(left)} parameters")
    return "".join(literal(left.pop(0)) if p == "%s" else "%" if p == "%%" else p for p in pieces)


def database(spark: SparkSession, url: str, query: str, params: tuple | None = None, by: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query over a relational database by JDBC; filters and columns of its rows are pushed down. postgres:// URLs are accepted.

    ``params`` stand for the query's %s. ``by`` (column, low, high, parts) reads ranges of a whole-number column in so many
    tasks; rows below low or above high go to the first and the last.
    """
    url = re.sub(r"^postgres(ql)?://", "jdbc:postgresql://", url)
    query = query if params is None else bound(query, params)
    reader = spark.read.format("jdbc").options(url=url if url.startswith("jdbc:") else f"jdbc:{url}", **options)
    if by is None:
        return reader.option("query", query).load()
    column, low, high, parts = by
    return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def results(spark: SparkSession, path: str, numeric: list[str], columns: list[str] | None = None) -> DataFrame:
    """A TSV of results with numbers where they can be read and null elsewhere; a missing path gives no rows of ``columns``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ", ".join(f"`{c}` {'double' if c in numeric else 'string'}" for c in columns or numeric))
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select(*[F.expr(f"try_cast(nullif(`{c}`, '') AS DOUBLE)").alias(c) if c in numeric else F.col(c) for c in raw.columns])


def combined(tables: dict[str, DataFrame], least_runs: int = 5) -> DataFrame:
    """Result tables by name, with their source, of status ok (or none) and least_runs runs (or none)."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("source", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    for c, ok in (("status", "coalesce(status, 'ok') IN ('', 'ok')"), ("runs", f"coalesce(try_cast(runs AS DOUBLE), {least_runs}) >= {least_runs}")):
        if c in out.columns:
            out = out.where(ok)
    return out
