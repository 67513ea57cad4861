"""Neighbourhoods within a radius and what they connect, exactly and without a grid, in any number of dimensions.

Points go to the cell of their nearest pivot, and as visitors to every other cell that may hold a neighbour: by the
triangle inequality a neighbour of x in the cell of pivot q has d(x, q) <= d(x, own pivot) + 2 radii. Cells are compared in
tiles of blocks; a tile returns a spanning forest of its links instead of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.shared import Tables
from quorate.operators import linkage

#: Points for each pivot, and most pivots: their vectors travel with the tasks.
PER_PIVOT, PIVOTS = 20_000, 256
#: Points that show how many cells a point visits; it decides how many pivots there are, not what is found.
PROBES = 500
#: Blocks of a cell that are enough for its tiles to keep the tasks busy, and points that a task compares at a time.
BLOCKS, STEP = 16, 1024
#: Pairs of a tile that wait until they are reduced to what they connect.
KEEP = 2_000_000


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs are at most eps apart: by products, and by differences where rounding could decide."""
    a, b = (x**2).sum(1), (y**2).sum(1)
    square = a[:, None] + b - 2 * x @ y.T
    out = square <= eps**2
    for i, j in np.argwhere(np.abs(square - eps**2) <= 1e-9 * (1 + a.max() + b.max())):
        out[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum()) <= eps
    return out


def _cells(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each point, and which cells it goes to: its own and those that may hold a neighbour."""
    far = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)
    return far.argmin(1), far <= far.min(1)[:, None] + 2 * eps * (1 + 1e-9)


def _pivots(drawn: np.ndarray, n: int, eps: float) -> np.ndarray:
    """As many of the drawn points as make the comparisons fewest: where all points are about equally far apart a point visits all cells, and one pivot does."""
    most = max(1, min(PIVOTS, n // PER_PIVOT, len(drawn)))
    choices = [p for p in {most, *(1 << e for e in range(most.bit_length()))} if p <= most]
    cost = {p: _cells(drawn, drawn[:p], eps)[1].sum(1).mean() ** 2 / p if len(drawn) else 1.0 for p in sorted(choices)}
    return drawn[: min(cost, key=cost.get)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect just what the edges a - b connect: each vertex with the smallest one that it reaches."""
    if not len(a):
        return a, b
    found, root = linkage._smallest(a, b)
    return found[found != root], root[found != root]


def _links(eps: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = linkage._sides(pdf)
        ids, x, visits = ([linkage._numbers(r[c], kind) for r in (left, right)] for c, kind in (("ids", np.int64), ("points", np.float64), ("visits", np.bool_)))
        x = [v.reshape(len(i), -1) for v, i in zip(x, ids, strict=True)]
        # pairs step by step, and of those of earlier steps only what connects them
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in range(0, len(ids[0]), STEP):
            for q in range(0, len(ids[1]), STEP):
                u, v = slice(p, p + STEP), slice(q, q + STEP)
                i, j = np.nonzero(_near(x[0][u], x[1][v], eps) & ~(visits[0][u, None] & visits[1][v]))
                a, b = np.concatenate([a, ids[0][u][i]]), np.concatenate([b, ids[1][v][j]])
                if len(a) > KEEP:
                    a, b = _forest(a, b)
        found, root = _forest(a, b)
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "a": found, "b": root})

    return run


def links(points: DataFrame, eps: float, tables: Tables) -> DataFrame:
    """points(g int, s long, features array<double>) -> (g, a, b): pairs of each g that connect just what lies within eps of each other."""
    points = tables.write(points)
    n = points.count()
    pivots = _pivots(np.array([r.features for r in points.orderBy(F.xxhash64("s"), "s").limit(max(1, min(PIVOTS, n // PER_PIVOT)) + PROBES).collect()], dtype=float), n, eps)
    n_pivots = max(1, len(pivots))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["features"].to_numpy()).astype(float)
            home, near = _cells(x, pivots, eps)
            for cell in range(n_pivots):
                row = np.flatnonzero(near[:, cell])
                out = pdf.iloc[row]
                yield pd.DataFrame({"run_id": out["g"].to_numpy() * n_pivots + cell, "s": out["s"].to_numpy(), "features": out["features"].to_numpy(), "visits": home[row] != cell})

    dealt = points.mapInPandas(deal, "run_id int, s long, features array<double>, visits boolean")
    pack = lambda p: {"ids": p["s"].to_numpy(np.int64).tobytes(), "points": np.stack(p["features"].to_numpy()).astype(np.float64).tobytes(), "visits": p["visits"].to_numpy(np.bool_).tobytes()}
    blocks = linkage.blocked(tables.write(dealt), "ids binary, points binary, visits binary", pack, BLOCKS)
    found = linkage.tiles(blocks).groupBy("run_id", "tile_a", "tile_b").applyInPandas(_links(eps), "run_id int, a long, b long")
    return found.select(F.expr(f"run_id div {n_pivots}").cast("int").alias("g"), "a", "b").distinct()


def eps_components(objs: DataFrame, eps: float, by: str | None = None) -> DataFrame:
    """objs(obj_id, features) -> (obj_id, component): the smallest object that a chain of steps of at most eps reaches.

    With ``by``, an integer column that is then returned too, only objects of equal values are neighbours. Equal vectors
    are one point. Features must be finite and equally many; ids are unique.
    """
    with Tables(objs.sparkSession, "eps") as tables:
        rows = objs.select((F.col(by) if by else F.lit(0)).cast("int").alias("g"), "obj_id", F.col("features").cast("array<double>").alias("features"))
        points = tables.write(rows.groupBy("g", "features").agg(F.min("obj_id").alias("s")))
        joined = linkage.components(links(points.select("g", "s", "features"), eps, tables), tables, ["g"])
        named = points.join(joined.select("g", F.col("id").alias("s"), "component"), ["g", "s"], "left")
        out = rows.join(named.select("g", "features", F.coalesce("component", "s").alias("component")), ["g", "features"])
        return tables.keep(out.select("obj_id", "component", *([F.col("g").alias(by)] if by else [])))


def eps_connectivity(objs: DataFrame, eps: float, by: str = "gt") -> DataFrame:
    """(by, objects, components, largest, connected): whether steps of at most eps connect each class."""
    sizes = eps_components(objs, eps, by).groupBy(by, "component").agg(F.count("*").alias("n"))
    return sizes.groupBy(by).agg(F.sum("n").alias("objects"), F.count("*").alias("components"), F.max("n").alias("largest")).withColumn("connected", F.col("components") == 1)
