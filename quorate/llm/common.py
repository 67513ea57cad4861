"""What the operators of this subpackage share: scratch tables, hashing, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the usual 64-bit finaliser.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


#: Hashes of runs of bytes: runs longer than LONG are hashed by xxh3 instead, and so much text is handled at once.
LONG, CHUNK = 256, 1 << 20
BLANK = re.compile(rb"[ \t\n\r\v\f]")
BLANKS = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
LOWER = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], dtype=np.uint8)
#: Random odd values of the bytes (a blank has none) and powers of an odd base, modulo 2**64.
VALUE = np.where(BLANKS, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1))
POWER = np.multiply.accumulate(np.full(LONG + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))


def run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of data[first[k] : last[k]] for each k; runs in order and apart, with nothing but blanks between them."""
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(first[0], len(data)) - np.repeat(first, np.diff(first, append=len(data)))
    out = mix64(np.add.reduceat(VALUE[data[first[0] :]] * POWER[np.minimum(place, LONG)], first - first[0]))
    for k in np.flatnonzero(last - first > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[first[k] : last[k]].tobytes())
    return out


def chunks(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces of about CHUNK bytes that end in a blank, as data does."""
    at = 0
    while at < len(data):
        end = BLANK.search(data, min(at + CHUNK, len(data) - 1)).end()
        yield at, np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs without ASCII white space, A-Z lower-cased) of all texts, and how many each text has."""
    begins, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, raw in chunks(b"\n".join([*texts, b""])):
        edges = np.diff(BLANKS[raw].astype(np.int8), prepend=1)
        first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        begins.append(first + at)
        hashes.append(run_hashes(LOWER[raw], first, last))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(begins), starts))


_STATE: dict = {}


def worker_state(key: tuple, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task under a key; asking for another key gives the former up.

    So a worker that serves one operator after the other never holds the memory of two.
    """
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a fresh one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return root.rstrip("/")


class Scratch:
    """Tables of one operator call in the shared folder; they cut lineage and outlive lost executors.

    Leave the ``with`` block only when nothing lazy reads them any more: it deletes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.delete(self.path)
        self.release()

    def delete(self, path: str) -> None:
        """Delete a folder through the file system that its scheme names."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def table(self, df: DataFrame) -> DataFrame:
        """Write df once and read it back."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """Write df bucketed by a column, so that later groupings on it need no exchange."""
        self.n += 1
        name = f"scratch_{uuid.uuid4().hex}"
        self.tables.append(name)
        (df.repartition(buckets, column).write.option("compression", "zstd").option("path", f"{self.path}/{self.n}").bucketBy(buckets, column).saveAsTable(name))
        return self.spark.table(name)

    def release(self) -> None:
        """Let Spark drop the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    scratch_root(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) per id, component the smallest id.

    Alternates large-star and small-star steps (Kiveris et al. 2014). The minima are groupings with map-side partial
    results; the edges of a vertex with very many neighbours then meet their minimum in a join (two longs a row), which
    adaptive execution splits where its partition is far larger than others. Empty edges give no rows.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.table(edges)
    before = None
    while before != (before := state(edges)) and before[0]:
        # large star: each larger neighbour of a vertex points to the smallest vertex near it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.table(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: each smaller neighbour of a vertex, and the vertex itself, point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.table(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    star = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return star.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
