"""Exact Lloyd clustering of integer vectors, sped up by ns-bounds (Newling and Fleuret 2016).

Each vector keeps, for each centroid, the distance at the round in which it was last computed, and that round. The
history of all centroids stays, so a bound is loosened by the norm of the centroid's *total* displacement since that
round, which is at most the sum of the drifts of the rounds between. The upper bound on the own distance is loosened
in the same way. A centroid is measured again only where its loosened lower bound does not clear the upper bound.
What is measured is measured exactly, in whole numbers, so the result is that of the plain algorithm.

A round is one pass without a shuffle: each task reads its vectors with their bounds, assigns them and writes them
with the new bounds, and beside them a row of whole sums per cluster and batch. Only those sums are grouped. The
history has rounds x k x components numbers and travels with the tasks; nothing on the driver grows with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import Scratch, checkpointed, free_name

#: Components of this size or more would let a squared distance of 64 components leave 64 bits.
LARGEST = 1 << 27
STATE = "vec_id long, v array<long>, cluster int, upper double, upper_at int, lower array<double>, lower_at array<int>, n long, sums array<long>"


def slack(x: np.ndarray) -> np.ndarray:
    """More than the rounding error of the roots and sums that make a bound."""
    return 1e-6 + 1e-12 * x


class Bounds:
    """The bounds of one batch: v (n, d) whole numbers, the state of its rows, the history of centroids (t, k, d)."""

    def __init__(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray):
        self.v, self.cluster, self.upper, self.upper_at, self.lower, self.lower_at = v, cluster, upper, upper_at, lower, lower_at

    @classmethod
    def fresh(cls, v: np.ndarray, k: int) -> Bounds:
        """Nothing is known: no lower bound, no upper bound."""
        n = len(v)
        return cls(v, np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n, np.int32), np.zeros((n, k)), np.zeros((n, k), np.int32))

    def assign(self, history: np.ndarray) -> int:
        """Move every vector to its nearest centroid of the last round (ties: the smaller number); how many distances it took."""
        now, k = len(history) - 1, history.shape[1]
        rows = np.arange(len(self.v))
        moved = np.sqrt(((history[now] - history) ** 2).sum(2).astype(np.float64))  # (t, k)
        low = self.lower - moved[self.lower_at, np.arange(k)]
        high = self.upper + moved[self.upper_at, self.cluster]
        clear = lambda: low - slack(self.lower) > (high + slack(high))[:, None]
        others = np.arange(k) != self.cluster[:, None]
        # first the own distance, where some other centroid may be as near
        open_ = np.flatnonzero((others & ~clear()).any(1))
        exact = np.full((len(rows), k), -1, dtype=np.int64)
        self._measure(exact, open_, self.cluster[open_], history[now], now)
        high[open_] = self.lower[open_, self.cluster[open_]]
        self.upper[open_], self.upper_at[open_] = high[open_], now
        # then every centroid whose bound still fails
        fails = np.zeros((len(rows), k), dtype=bool)
        fails[open_] = (others & ~clear())[open_]
        row, col = np.nonzero(fails)
        self._measure(exact, row, col, history[now], now)
        best = np.where(exact[open_] < 0, np.iinfo(np.int64).max, exact[open_]).argmin(1)
        self.cluster[open_] = best
        self.upper[open_] = self.lower[open_, best]
        return len(open_) + len(row)

    def _measure(self, exact: np.ndarray, row: np.ndarray, col: np.ndarray, centroids: np.ndarray, now: int) -> None:
        for at in range(0, len(row), 65_536):
            r, c = row[at : at + 65_536], col[at : at + 65_536]
            exact[r, c] = ((self.v[r] - centroids[c]) ** 2).sum(1)
            self.lower[r, c], self.lower_at[r, c] = np.sqrt(exact[r, c].astype(np.float64)), now

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        return ((self.v - centroids[self.cluster]) ** 2).sum(1)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(flat) else flat.reshape(len(column), 0)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel(), kind))


_SCHEMA = pa.schema([
    ("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("upper_at", pa.int32()),
    ("lower", pa.list_(pa.float64())), ("lower_at", pa.list_(pa.int32())), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
])


def _round(state: DataFrame, history: np.ndarray) -> DataFrame:
    """Assign every vector; rows of vectors (n is null) and of sums per cluster and batch (v is null)."""
    k, d = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), np.int64)
            if b.column("upper").null_count:  # the first round
                bounds = Bounds.fresh(v, k)
            else:
                whole = lambda c: b.column(c).to_numpy(zero_copy_only=False).copy()
                bounds = Bounds(v, whole("cluster"), whole("upper"), whole("upper_at"), _matrix(b.column("lower"), np.float64), _matrix(b.column("lower_at"), np.int32))
            bounds.assign(history)
            none = lambda n: [pa.nulls(n, f.type) for f in _SCHEMA]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _lists(v, pa.int64()), pa.array(bounds.cluster), pa.array(bounds.upper), pa.array(bounds.upper_at), _lists(bounds.lower, pa.float64()), _lists(bounds.lower_at, pa.int32()), *none(len(v))[7:]], schema=_SCHEMA)
            used = np.unique(bounds.cluster)
            sums = np.array([v[bounds.cluster == c].sum(0) for c in used]).reshape(-1, d)
            out = none(len(used))
            out[2], out[7], out[8] = pa.array(used, pa.int32()), pa.array(np.bincount(bounds.cluster, minlength=k)[used]), _lists(sums, pa.int64())
            yield pa.RecordBatch.from_arrays(out, schema=_SCHEMA)

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of the means; a cluster without vectors keeps its centroid."""
    sums = state.where("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in sums.collect():  # k x components rows
        out[r.cluster, r.i] = int(r.x) // int(r.n)
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly ``components`` components, none null or non-finite; a component x becomes
    floor(scale * x). The first centroids are the ``k`` kept rows whose ids hash lowest with the seed (sha256 of
    ``seed:id``; a null id hashes as an empty one; equal ids go on by their components); fewer than k rows give as many
    centroids. Repeated rows are rows like any other, equal distances go to the smaller number, an empty table or one
    without a kept row gives no rows, other columns are ignored. A component of 2**27 or more after scaling raises, as
    its squared distance may not fit a long.
    """
    x, v = F.col(vector_col).cast("array<double>"), free_name(vectors, "v")
    finite = F.coalesce(F.size(x) == components, F.lit(False)) & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    kept = vectors.where(finite).withColumn(v, F.transform(x, lambda c: F.floor(c * scale)))
    fits = F.forall(v, lambda c: F.abs(c.cast("double")) < LARGEST)
    kept = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, F.col(v).cast("array<long>")).otherwise(F.raise_error(F.lit(f"a scaled component reaches {LARGEST}"))).alias("v"))
    with Scratch(vectors.sparkSession, "centroids") as scratch:
        none = {c: F.lit(None).cast(t) for c, t in (x.split(" ") for x in STATE.split(", ")[2:])}
        state = scratch.table(kept.withColumns(none))
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = [r.v for r in state.orderBy(order, "v").limit(k).select("v").collect()]
        history = np.array([first], dtype=np.int64).reshape(1, len(first), components)
        for r in range(rounds + 1):
            if not len(first):
                break
            assigned = scratch.table(_round(state.where("n IS NULL"), history))
            scratch.delete(f"{scratch.path}/{scratch.n - 1}")
            state = assigned
            if r < rounds:
                history = np.concatenate([history, _moved(state, history[-1])[None]])
        return checkpointed(_measured(state.where("n IS NULL"), history[-1]))


def _measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The exact distances to the own centroids, their sums, and the digests of the centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bounds = Bounds(_matrix(b.column("v"), np.int64), b.column("cluster").to_numpy(zero_copy_only=False), *[np.zeros(0)] * 4)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(bounds.distances(centroids))], ["vec_id", "cluster", "distance"])

    rows = state.mapInArrow(run, "vec_id long, cluster int, distance long")
    own = {r.cluster: int(r.x) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # k rows
    whole = sum(own.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, x, whole, digests[c]) for c, x in own.items()]
    per_cluster = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
