"""Hierarchies of consensus runs without a bound on the number of objects, and components of graphs.

Objects with equal cluster ids throughout a run's partitions are one point, as their co-association is 1. Points are
packed into blocks; pairs of blocks are tiles, and the task of a tile compares all its pairs in NumPy but returns only the
best one of each of its groups. So the comparisons are quadratic in the points and nothing else is: what moves between
stages is points times blocks, and groups.

* single: a minimum spanning forest by Boruvka's rounds. Each group of points finds its closest pair with another group,
  a table of edges; groups are contracted along them by pointer doubling.
* average: rounds that merge all reciprocal nearest pairs. Average co-association is linear in the counts of a group's
  points over all clusters, so a group is a vector of counts. When few groups are left, one task finishes the run.
* euclidean: the same two ways on distances of vectors. Ward groups are centroids; for average and complete linkage the distances
  of points are taken again, as nothing smaller tells those of groups. No union is closer to a group than the closer one of its parts, so
  a group keeps its nearest one until that merges: a round takes the distances of new groups and of those that lost theirs.

Ties go by the smallest ids, so the merges are those of the sequential algorithm, which takes the closest pair of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.functions import kernels
from quorate.functions.shared import Tables

#: Points of a block, groups of a run that one task finishes, and pointers or edges that one task follows to their ends.
BLOCK, FEW, SMALL = 2048, 3000, 100_000
#: Most points of a block where fewer blocks are enough.
LARGE = 65_536
#: Digits to which distances count: beyond them sums taken in another order differ.
DIGITS = 12


def _ends(c: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Where the pointers c -> up end; each id of up is one of c."""
    order = np.argsort(c)
    at = order[np.searchsorted(c[order], up)]
    while (c[at] != c[at[at]]).any():
        at = at[at]
    return c[at]


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges a - b and the smallest that each one reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at.ravel(), 2)
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        low = _ends(np.arange(len(ids)), low[root])
        if (low == root).all():
            return ids, ids[root]
        root = low


def _in_one_task(rows: DataFrame, keys: list[str], names: tuple[str, str], solve) -> DataFrame:
    """rows(keys..., two columns) -> (keys..., names): solve gets the two columns of each value of the keys."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), *(f"{n} long" for n in names)])
    one, two = (c for c in rows.columns if c not in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(dict(zip(names, solve(pdf[one].to_numpy(), pdf[two].to_numpy()), strict=True)))
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, *names]]

    return rows.groupBy(*(keys or [F.lit(0).alias("_")])).applyInPandas(lambda pdf: run(pdf), schema)


def follow(pointers: DataFrame, tables: Tables, keys: list[str]) -> DataFrame:
    """pointers(keys..., c, up), where roots point to themselves -> (keys..., c, root): by doubling, or in one task if there are few.

    The pointers must not run in circles. A root that very many point to is a skewed join key.
    """
    now, n = tables.counted(pointers.select(*keys, "c", F.col("up").alias("root")))
    if n <= SMALL:
        return _in_one_task(now, keys, ("c", "root"), lambda c, up: (c, _ends(c, up)))
    moved = 1
    while moved:
        far = now.select(*keys, F.col("c").alias("root"), F.col("root").alias("far"))
        new, moved = tables.counted(now.join(far, [*keys, "root"]).select(*keys, "c", "root", "far"), F.col("root") != F.col("far"))
        now = new.select(*keys, "c", F.col("far").alias("root"))
    return now


def components(edges: DataFrame, tables: Tables, keys: list[str] | None = None) -> DataFrame:
    """edges(keys..., a, b) -> (keys..., id, component): the smallest id that each vertex reaches, for each value of the keys.

    Every vertex points to its smallest neighbour if that is smaller; vertices are contracted to the roots, and what is
    left of the edges goes on. A round at least halves the vertices that have edges, and the smallest vertex stays a root.
    When few edges are left, one task for each value of the keys ends it.
    """
    keys = keys or []
    edges, n = tables.counted(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    whole = None
    while n:
        if n <= SMALL:
            roots = tables.write(_in_one_task(edges, keys, ("c", "root"), _smallest))
        else:
            both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
            up = both.groupBy(*keys, F.col("a").alias("c")).agg(F.min("b").alias("m")).select(*keys, "c", F.least("c", "m").alias("up"))
            roots = follow(up, tables, keys)
        if whole is None:
            whole = roots.select(*keys, F.col("c").alias("id"), F.col("root").alias("component"))
        else:
            next_ = roots.select(*keys, F.col("c").alias("component"), "root")
            whole = tables.write(whole.join(next_, [*keys, "component"], "left").select(*keys, "id", F.coalesce("root", "component").alias("component")))
        if n <= SMALL:
            break
        a, b = (roots.select(*keys, F.col("c").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        left = edges.join(a, [*keys, "a"]).join(b, [*keys, "b"]).where("ra <> rb")
        left, n = tables.counted(left.select(*keys, F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        tables.drop(edges)
        edges = left
    if whole is None:
        return edges.select(*keys, F.col("a").alias("id"), F.col("b").alias("component"))
    return whole


def points(members: DataFrame, plan: DataFrame) -> DataFrame:
    """(run_id, obj_id, s, sig): each object with its clusters in the run's partitions, in their order, and s, the least object with the same ones."""
    rows = members.select("obj_id", "part_id", "cluster_id").join(plan, "part_id").groupBy("run_id", "obj_id")
    sig = rows.agg(F.expr("transform(array_sort(collect_list(struct(part_id, cluster_id))), x -> cast(x.cluster_id as int))").alias("sig"))
    least = sig.groupBy("run_id", "sig").agg(F.min("obj_id").alias("s"))
    return sig.join(least, ["run_id", "sig"]).select("run_id", "obj_id", "s", "sig")


def blocked(rows: DataFrame, schema: str, pack, enough: int | None = None, point: str = "s") -> DataFrame:
    """Rows (run_id, s, ...) packed into one row a block (run_id, block, blocks, ...); pack gets a block in order of s and gives its other columns.

    A block has BLOCK points, or more if ``enough`` blocks of a run will do, up to LARGE: a block goes once to each of the others, so what is shuffled
    then grows with the points and not with their square. Rows are dealt by s; the column that tells their points may be another.
    """
    n = F.count("*")
    blocks = F.ceil(n / BLOCK) if enough is None else F.greatest(F.ceil(n / LARGE), F.least(F.ceil(n / BLOCK), F.lit(enough)))
    sizes = rows.select("run_id", point).distinct().groupBy("run_id").agg(blocks.cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "run_id").withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))  # a row a run

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[["run_id", "block", "blocks"]].iloc[:1].reset_index(drop=True)
        return head.assign(**{k: [v] for k, v in pack(pdf.sort_values("s")).items()})

    return rows.groupBy("run_id", "block").applyInPandas(run, f"run_id int, block int, blocks int, {schema}")


def tiles(blocks: DataFrame) -> DataFrame:
    """Each block once for each tile that it is in: those of all pairs of blocks of its run, tile_a <= tile_b."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return blocks.withColumn("other", other).withColumns({"tile_a": F.least("block", "other"), "tile_b": F.greatest("block", "other")}).drop("other", "blocks")


def _sides(pdf: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
    pdf = pdf.sort_values("block")
    return pdf.iloc[0], pdf.iloc[-1]


def _numbers(x: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(x, dtype=kind)


def _closest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one tile: for each group the pair of points with another group that agree in most partitions."""
    left, right = _sides(pdf)
    found = []
    ids = [_numbers(x["ids"]) for x in (left, right)]
    groups = [_numbers(x["groups"]) for x in (left, right)]
    codes = [_numbers(x["codes"], np.int32).reshape(len(i), -1) for x, i in zip((left, right), ids, strict=True)]
    agree = np.zeros((len(ids[0]), len(ids[1])), dtype=np.int16)
    for p in range(codes[0].shape[1]):
        agree += codes[0][:, p, None] == codes[1][None, :, p]
    agree[groups[0][:, None] == groups[1][None, :]] = 0
    for side, a in ((0, agree), (1, agree.T)):
        at = a.argmax(1)  # the first of the most: the smallest id, as ids ascend
        n, other = a[np.arange(len(a)), at], ids[1 - side][at]
        found.append(pd.DataFrame({"c": groups[side], "n": n, "a": np.minimum(ids[side], other), "b": np.maximum(ids[side], other), "d": groups[1 - side][at]}))
    best = pd.concat(found)
    best = best[best["n"] > 0].sort_values(["n", "a", "b"], ascending=[False, True, True]).drop_duplicates("c")
    return best.assign(run_id=pdf["run_id"].iloc[0])[["run_id", "c", "n", "a", "b", "d"]]


def spanning_forest(pts: DataFrame, tables: Tables, kind: type = np.int32, closest=_closest, enough: int | None = None) -> DataFrame:
    """pts(run_id, s, sig) -> (run_id, a, b, agree): a forest of each run's points with the most agreement; pairs that agree in nothing are no edges.

    ``closest`` finds the best pairs of a tile; the numbers in sig are of a kind.
    """
    pts = tables.write(pts.select("run_id", "s", "sig").distinct())
    block = tables.write(blocked(pts, "ids binary, codes binary", lambda p: {"ids": p["s"].to_numpy(np.int64).tobytes(), "codes": np.stack(p["sig"].to_numpy()).astype(kind).tobytes()}, enough))
    groups = tables.write(pts.select("run_id", "s", F.col("s").alias("c")))
    forest, agree = None, "int" if kind == np.int32 else "double"
    while True:
        named = blocked(groups, "groups binary", lambda p: {"groups": p["c"].to_numpy(np.int64).tobytes()}, enough).drop("blocks")
        best = tiles(block.join(named, ["run_id", "block"])).groupBy("run_id", "tile_a", "tile_b").applyInPandas(closest, f"run_id int, c long, n {agree}, a long, b long, d long")
        edge = best.groupBy("run_id", "c").agg(F.min(F.struct((-F.col("n")).alias("n"), "a", "b", "d")).alias("e"))
        edge, n = tables.counted(edge.select("run_id", "c", (-F.col("e.n")).alias("agree"), "e.a", "e.b", F.col("e.d").alias("up")))
        new = edge.select("run_id", "a", "b", "agree").distinct()
        forest = new if forest is None else forest.unionByName(new)
        if not n:
            return forest
        # two groups that chose each other chose the same edge: the smaller one is a root; so are groups without an edge
        back = edge.select("run_id", F.col("c").alias("up"), F.col("up").alias("c"), F.lit(True).alias("mutual"))
        up = groups.select("run_id", "c").distinct().join(edge.select("run_id", "c", "up"), ["run_id", "c"], "left").join(back, ["run_id", "c", "up"], "left")
        root = F.col("up").isNull() | (F.col("mutual").isNotNull() & (F.col("c") < F.col("up")))
        roots = follow(up.select("run_id", "c", F.when(root, F.col("c")).otherwise(F.col("up")).alias("up")), tables, ["run_id"])
        groups = tables.write(groups.join(roots, ["run_id", "c"]).select("run_id", "s", F.col("root").alias("c")))


def cut(pts: DataFrame, merges: DataFrame, k: int, tables: Tables) -> DataFrame:
    """(run_id, obj_id, label): what is connected by merges(run_id, a, b, height) up to the smallest height that leaves k clusters or fewer.

    pts(run_id, obj_id, s). Labels from 1, in the order of the smallest objects. Where the merges leave more than k, all
    points are one cluster, as the pairs that are no merges are all equally far.
    """
    merges = tables.write(merges)
    sizes = pts.select("run_id", "s").distinct().groupBy("run_id").agg(F.count("*").alias("n"))
    last = merges.withColumn("r", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("height")))).where(F.col("r") <= k + 1)
    last = last.groupBy("run_id").agg(F.sort_array(F.collect_list("height"), asc=False).alias("top"))
    facts = sizes.join(merges.groupBy("run_id").agg(F.count("*").alias("m")), "run_id", "left").join(last, "run_id", "left")
    # of n - 1 merges the k-th from the top is the last one that counts; missing ones are the highest
    place = F.col("k") - (F.col("n") - 1 - F.coalesce("m", F.lit(0)))
    limit = F.when(F.col("n") <= k, F.lit(float("-inf"))).when(place < 1, F.lit(float("inf"))).otherwise(F.get("top", place.cast("int") - 1))
    limits = facts.withColumn("k", F.lit(k)).select("run_id", limit.alias("limit"))
    used = merges.join(F.broadcast(limits), "run_id").where("height <= limit").select("run_id", "a", "b")  # a row a run
    joined = components(used, tables, ["run_id"])
    named = pts.select("run_id", "obj_id", "s").join(joined.select("run_id", F.col("id").alias("s"), "component"), ["run_id", "s"], "left").join(F.broadcast(limits), "run_id")
    named = named.select("run_id", "obj_id", F.when(F.col("limit") == float("inf"), F.lit(None)).otherwise(F.coalesce("component", "s")).alias("c"))
    named = tables.write(named)
    # at most k groups a run
    first = named.groupBy("run_id", "c").agg(F.min("obj_id").alias("o"))
    number = first.withColumn("label", F.row_number().over(W.partitionBy("run_id").orderBy("o"))).select(F.col("run_id").alias("r"), F.col("c").alias("d"), "label")
    return named.join(number, (F.col("run_id") == F.col("r")) & F.col("c").eqNullSafe(F.col("d"))).select("run_id", "obj_id", "label")


def single(members: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """(run_id, obj_id, label): single linkage of 1 - co-association, for any number of objects."""
    with Tables(members.sparkSession, "single") as tables:
        pts = tables.write(points(members, plan))
        forest = spanning_forest(pts, tables)
        return tables.keep(cut(pts, forest.select("run_id", "a", "b", (-F.col("agree")).cast("double").alias("height")), k, tables))


def _profiles(pdf: pd.DataFrame) -> dict:
    """A block of groups: rows of one group are added up."""
    ids, first = np.unique(pdf["s"].to_numpy(np.int64), return_index=True)
    counts = np.add.reduceat(np.stack(pdf["counts"].to_numpy()).astype(np.int64), first, axis=0)
    sizes = np.add.reduceat(pdf["size"].to_numpy(np.int64), first)
    return {"ids": ids.tobytes(), "counts": counts.tobytes(), "sizes": sizes.tobytes()}


def _far(a: tuple, b: tuple, parts: int) -> np.ndarray:
    """1 - mean co-association of two lists of groups."""
    (_, x, n), (_, y, m) = a, b
    return np.round(1 - (x.astype(float) @ y.T.astype(float)) / (parts * np.outer(n, m)), DIGITS)


def _unpacked(row: pd.Series) -> tuple:
    ids, sizes = _numbers(row["ids"]), _numbers(row["sizes"])
    return ids, _numbers(row["counts"]).reshape(len(ids), -1), sizes


def average(members: DataFrame, plan: DataFrame, k: int, few: int = FEW) -> DataFrame:
    """(run_id, obj_id, label): average linkage of 1 - co-association, for any number of objects; one task finishes a run of ``few`` groups."""
    spark = members.sparkSession
    with Tables(spark, "average") as tables:
        pts = tables.write(points(members, plan))
        parts = dict(plan.groupBy("run_id").agg(F.count("*")).collect())  # a row a run
        size = F.broadcast(members.select("part_id", "cluster_id").distinct())
        place = size.withColumn("i", F.dense_rank().over(W.orderBy("part_id", "cluster_id")) - 1)  # a row a cluster
        width = place.count()
        order = {r.part_id: {} for r in place.collect()}
        for r in place.collect():
            order[r.part_id][r.cluster_id] = r.i
        used = {r: sorted(x.part_id for x in rows) for r, rows in _by_run(plan)}

        def start(batches):
            for pdf in batches:
                counts = np.zeros((len(pdf), width), dtype=np.int64)
                for row, (run, sig) in enumerate(zip(pdf["run_id"], pdf["sig"], strict=True)):
                    counts[row, [order[p][c] for p, c in zip(used[run], sig, strict=True)]] = pdf["size"].iloc[row]
                yield pd.DataFrame({"run_id": pdf["run_id"], "s": pdf["s"], "counts": list(counts), "size": pdf["size"]})

        kind = "run_id int, s long, counts array<long>, size long"
        groups = tables.write(pts.groupBy("run_id", "s").agg(F.first("sig").alias("sig"), F.count("*").alias("size")).mapInPandas(start, kind))

        def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
            left, right = (_unpacked(x) for x in _sides(pdf))
            run, found = int(pdf["run_id"].iloc[0]), []
            d = _far(left, right, parts[run])
            if len(pdf) == 1:
                np.fill_diagonal(d, np.inf)
            for x, ids, other in ((d, left[0], right[0]), (d.T, right[0], left[0])):
                at = x.argmin(1)  # the first of the least: the smallest id
                found.append(pd.DataFrame({"run_id": run, "s": ids, "d": x[np.arange(len(x)), at], "t": other[at]}))
            return pd.concat(found[: len(pdf)]).query("d < inf")

        def unpack(batches):
            for pdf in batches:
                for _, row in pdf.iterrows():
                    ids, counts, sizes = _unpacked(row)
                    yield pd.DataFrame({"run_id": row["run_id"], "s": ids, "counts": list(counts), "size": sizes})

        merges = None
        while True:
            block = tables.write(blocked(groups, "ids binary, counts binary, sizes binary", _profiles))
            tables.drop(groups)
            groups = tables.write(block.mapInPandas(unpack, kind))
            many = groups.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > few)
            open_ = block.join(F.broadcast(many.select("run_id")), "run_id", "left_semi")  # a row a run
            if not many.limit(1).count():
                break
            near = tiles(open_).groupBy("run_id", "tile_a", "tile_b").applyInPandas(nearest, "run_id int, s long, d double, t long")
            # ties: the pair whose smaller and then larger id is least, which is the neighbour of least id
            near = tables.write(near.groupBy("run_id", "s").agg(F.min(F.struct("d", "t")).alias("e")).select("run_id", "s", "e.d", "e.t"))
            back = near.select("run_id", F.col("s").alias("t"), F.col("t").alias("s"))
            pairs = tables.write(near.join(back, ["run_id", "s", "t"]).where("s < t").select("run_id", F.col("s").alias("a"), F.col("t").alias("b"), F.col("d").alias("height")))
            merges = pairs if merges is None else merges.unionByName(pairs)
            into = pairs.select("run_id", F.col("b").alias("s"), "a")
            groups = tables.write(groups.join(into, ["run_id", "s"], "left").select("run_id", F.coalesce("a", "s").alias("s"), "counts", "size"))

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("s")
            rows = (pdf["s"].to_numpy(np.int64), np.stack(pdf["counts"].to_numpy()).astype(np.int64), pdf["size"].to_numpy(np.int64))
            run = int(pdf["run_id"].iloc[0])
            found = kernels.linkage(_far(rows, rows, parts[run]), "average", rows[2], DIGITS)
            return pd.DataFrame({"run_id": run, "a": rows[0][found[:, 0].astype(int)], "b": rows[0][found[:, 1].astype(int)], "height": found[:, 2]})

        done = groups.groupBy("run_id").applyInPandas(finish, "run_id int, a long, b long, height double")
        merges = done if merges is None else merges.unionByName(done)
        return tables.keep(cut(pts, merges, k, tables))


def _by_run(plan: DataFrame) -> list:
    rows: dict = {}
    for r in plan.collect():  # runs x partitions rows
        rows.setdefault(r.run_id, []).append(r)
    return list(rows.items())


#: Blocks of points for distances of vectors, parts of what is asked of each, and rows, columns and distances of groups that a task holds at a time.
DEALT, ASKED, ROWS, COLUMNS, HELD = 12, 2, 512, 1024, 8_000_000


def _square(x: np.ndarray, y: np.ndarray, xx: np.ndarray | None = None, yy: np.ndarray | None = None) -> np.ndarray:
    """Squared distances; xx and yy are the squares of the rows."""
    d = (2 * x) @ y.T
    np.subtract(((x**2).sum(1) if xx is None else xx)[:, None], d, out=d)
    d += (y**2).sum(1) if yy is None else yy
    return np.maximum(d, 0, out=d)


def apart(x: np.ndarray, y: np.ndarray, xx: np.ndarray | None = None, yy: np.ndarray | None = None) -> np.ndarray:
    d = _square(x, y, xx, yy)
    return np.sqrt(d, out=d)


def _vectors(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(float)
    if not np.isfinite(x).all():
        raise ValueError("features must be finite")
    return x


def _closest_vectors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one tile: for each group the closest pair of points with another group; n is minus their distance."""
    left, right = _sides(pdf)
    ids, groups = ([_numbers(s[c]) for s in (left, right)] for c in ("ids", "groups"))
    x, y = (_numbers(s["codes"], np.float64).reshape(len(i), -1) for s, i in zip((left, right), ids, strict=True))
    best = [[np.full(len(i), np.inf), np.zeros(len(i), dtype=np.int64)] for i in ids]
    for p in range(0, len(x), ROWS):
        for q in range(0, len(y), COLUMNS):
            u, v = slice(p, p + ROWS), slice(q, q + COLUMNS)
            d = np.round(apart(x[u], y[v]), DIGITS)
            d[groups[0][u, None] == groups[1][None, v]] = np.inf
            for side, here, there, m in ((0, u, v, d), (1, v, u, d.T)):
                at = m.argmin(1)  # the first of the least: the smallest id, as ids ascend
                low, (least, other) = m[np.arange(len(m)), at], best[side]
                better = low < least[here]
                other[here] = np.where(better, at + there.start, other[here])
                least[here] = np.minimum(low, least[here])
    found = []
    for side in (0, 1):
        least, at = best[side]
        other = ids[1 - side][at]
        found.append(pd.DataFrame({"c": groups[side], "n": -least, "a": np.minimum(ids[side], other), "b": np.maximum(ids[side], other), "d": groups[1 - side][at]}))
    out = pd.concat(found)
    out = out[out["n"] > -np.inf].sort_values(["n", "a", "b"], ascending=[False, True, True]).drop_duplicates("c")
    return out.assign(run_id=pdf["run_id"].iloc[0])[["run_id", "c", "n", "a", "b", "d"]]


def _groups_of(rows: pd.DataFrame) -> dict:
    """A block of groups s with their points x, which stand for n objects each, group by group; ``open`` ones look for their nearest."""
    ids, first = np.unique(rows["s"].to_numpy(np.int64), return_index=True)
    return {"ids": ids.tobytes(), "first": first.astype(np.int64).tobytes(), "x": _vectors(rows["x"]).tobytes(), "n": rows["n"].to_numpy(np.float64).tobytes(), "open": rows["open"].to_numpy(bool)[first].tobytes()}


def _centroids_of(rows: pd.DataFrame) -> dict:
    """A block of groups s by their centroids, each one row that stands for n objects."""
    ids, first = np.unique(rows["s"].to_numpy(np.int64), return_index=True)
    n = rows["n"].to_numpy(np.float64)
    size = np.add.reduceat(n, first)
    x = np.add.reduceat(_vectors(rows["x"]) * n[:, None], first) / size[:, None]
    return {"ids": ids.tobytes(), "first": np.arange(len(ids)).tobytes(), "x": x.tobytes(), "n": size.tobytes(), "open": rows["open"].to_numpy(bool)[first].tobytes()}


def _dealt(row: pd.Series) -> tuple:
    n = _numbers(row["n"], np.float64)
    return _numbers(row["ids"]), _numbers(row["first"]), _numbers(row["x"], np.float64).reshape(len(n), -1), n


def _asking(batches):
    """Blocks with their open groups alone; those without any are left out."""
    for pdf in batches:
        rows = []
        for _, row in pdf.iterrows():
            open_, (ids, first, x, n) = _numbers(row["open"], bool), _dealt(row)
            if open_.any():
                many = np.diff(np.append(first, len(x)))
                at, many = np.repeat(open_, many), many[open_]
                rows.append(row.to_dict() | {"ids": ids[open_].tobytes(), "first": (np.cumsum(many) - many).tobytes(), "x": x[at].tobytes(), "n": n[at].tobytes(), "open": open_[open_].tobytes()})
        if rows:
            yield pd.DataFrame(rows)[list(pdf.columns)]


def _between(a: tuple, b: tuple, method: str):
    """(place, distances): those of some groups of a at a time, from that place on, to all of b."""
    (ids, first, x, n), (others, second, y, m) = a, b
    size, far = np.add.reduceat(n, first), np.add.reduceat(m, second)
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    ends = np.append(first, len(x))
    owner = np.repeat(np.arange(len(others)), np.diff(np.append(second, len(y))))
    mine = np.repeat(np.arange(len(ids)), np.diff(ends))
    complete, weighted = method == "complete", method == "average" and bool((n != 1).any() or (m != 1).any())
    join = np.maximum if complete else np.add
    step = max(1, HELD // len(others))
    for g in range(0, len(ids), step):
        to = min(g + step, len(ids))
        out = np.zeros((to - g, len(others)))
        for p in range(ends[g], ends[to], ROWS):
            u = slice(p, min(p + ROWS, ends[to]))
            for q in range(0, len(y), COLUMNS):
                v = slice(q, min(q + COLUMNS, len(y)))
                d = (_square if complete else apart)(x[u], y[v], xx[u], yy[v])
                if weighted:
                    d *= n[u, None]
                    d *= m[v]
                i, j = mine[u], owner[v]
                rows, columns = (np.flatnonzero(np.append(True, k[1:] != k[:-1])) for k in (i, j))
                d = d if len(rows) == len(i) else join.reduceat(d, rows, axis=0)
                d = d if len(columns) == len(j) else join.reduceat(d, columns, axis=1)
                place = slice(i[0] - g, i[-1] + 1 - g), slice(j[0], j[-1] + 1)
                join(out[place], d, out=out[place])
        if complete:
            np.sqrt(out, out=out)  # the root of the largest is the largest root
        elif method == "average":
            out /= size[g:to, None]
            out /= far
        elif method == "ward":
            out *= np.sqrt(2 * np.outer(size[g:to], far) / (size[g:to, None] + far))
        yield g, np.round(out, DIGITS, out=out)


def euclidean(objs: DataFrame, k: int, method: str, few: int = FEW) -> DataFrame:
    """(obj_id, label): a linkage of the Euclidean distances of objs(obj_id, features), for any number of objects.

    Objects with equal features are a point. Arithmetic is quadratic in the points, times the rounds' shares of open groups for average
    and complete linkage; what is held at a time is bounded, but a group lies in one block. One task finishes ``few`` groups.
    """
    with Tables(objs.sparkSession, "euclidean") as tables:
        same = objs.groupBy("features").agg(F.min("obj_id").alias("s"), F.count("*").alias("n"))
        points = tables.write(same.select(F.lit(0).alias("run_id"), "s", "n", F.col("features").alias("x")))
        pts = tables.write(objs.join(same.select("features", "s"), "features").select(F.lit(0).alias("run_id"), "obj_id", "s"))
        if method == "single":
            forest = spanning_forest(points.select("run_id", "s", F.col("x").alias("sig")), tables, np.float64, _closest_vectors, DEALT)
            merges = forest.select("run_id", "a", "b", (-F.col("agree")).alias("height"))
        else:
            merges = _merges(points, method, few, tables)
        return tables.keep(cut(pts, merges, k, tables).select("obj_id", "label"))


def _merges(points: DataFrame, method: str, few: int, tables: Tables) -> DataFrame:
    """(run_id, a, b, height) of points(run_id, s, n, x), by reciprocal nearest groups; groups are open while their nearest one is not known."""
    ward = method == "ward"
    groups, left = tables.counted(points.select("run_id", F.col("s").alias("p"), "s", "n", "x", F.lit(True).alias("open")))
    pack, merges, near, kept, turn = _centroids_of if ward else _groups_of, None, None, None, 0

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one block and some of the open groups: the nearest one of the block to each."""
        whole = pdf[pdf["whole"]].iloc[0]
        b, found = _dealt(whole), []
        for _, row in pdf[~pdf["whole"]].iterrows():
            a = _dealt(row)
            own = np.searchsorted(b[0], a[0]) if row["block"] == whole["block"] else None
            for g, d in _between(a, b, method):
                one = np.arange(len(d))
                if own is not None:
                    d[one, own[g : g + len(d)]] = np.inf
                at = d.argmin(1)  # the first of the least: the smallest id
                found.append(pd.DataFrame({"s": a[0][g : g + len(d)], "d": d[one, at], "t": b[0][at]}))
        out = pd.concat(found) if found else pd.DataFrame({"s": [], "d": [], "t": []})
        return out.query("d < inf").assign(run_id=int(whole["run_id"]))[["run_id", "s", "d", "t"]]

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (_dealt(x) for x in _sides(pdf))
        sizes = np.add.reduceat(a[3], a[1])
        raw = [d for _, d in _between(a, b, "centroids" if ward else method)]
        head = {"run_id": int(pdf["run_id"].iloc[0]), "rows": a[0].tobytes(), "columns": b[0].tobytes(), "sizes": sizes.tobytes()}
        return pd.DataFrame({c: [v] for c, v in head.items()} | {"d": [np.concatenate(raw).tobytes()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = ([_numbers(x) for x in pdf[c]] for c in ("rows", "columns"))
        ids = np.unique(np.concatenate(rows + columns))
        d, size = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        for r, c, n, x in zip(rows, columns, pdf["sizes"], pdf["d"], strict=True):
            i, j, part = np.searchsorted(ids, r), np.searchsorted(ids, c), _numbers(x, np.float64).reshape(len(r), len(c))
            d[np.ix_(i, j)], d[np.ix_(j, i)] = part, part.T
            size[i] = _numbers(n, np.float64)
        found = kernels.linkage(d, method, size, DIGITS)
        return pd.DataFrame({"run_id": int(pdf["run_id"].iloc[0]), "a": ids[found[:, 0].astype(int)], "b": ids[found[:, 1].astype(int)], "height": found[:, 2]})

    while True:
        block = tables.write(blocked(groups, "ids binary, first binary, x binary, n binary, open binary", pack, DEALT, "s" if ward else "p"))
        if left <= few:
            rows = tiles(block).groupBy("run_id", "tile_a", "tile_b").applyInPandas(matrix, "run_id int, rows binary, columns binary, sizes binary, d binary")
            done = rows.groupBy("run_id").applyInPandas(finish, "run_id int, a long, b long, height double")
            return done if merges is None else merges.unionByName(done)
        asked = block.mapInPandas(_asking, block.schema).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), (F.col("block") % ASKED).alias("part"), F.lit(False).alias("whole"))
        dealt = asked.unionByName(block.select("*", F.col("block").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(ASKED - 1))).alias("part"), F.lit(True).alias("whole")))
        found = dealt.groupBy("run_id", "at", "part").applyInPandas(nearest, "run_id int, s long, d double, t long")
        found = found.groupBy("run_id", "s").agg(F.min(F.struct("d", "t")).alias("e")).select("run_id", "s", "e.d", "e.t")
        old, near = near, tables.write(found if kept is None else found.unionByName(kept))
        back = near.select("run_id", F.col("s").alias("t"), F.col("t").alias("s"))
        ends = ["run_id", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), F.col("d").alias("height")]
        pairs, n = tables.counted(near.join(back, ["run_id", "s", "t"]).where("s < t").select(*ends))
        if not n:  # distances that differ in their last digit, summed in another order: the closest pair of all
            pairs, n = tables.counted(near.select(*ends).orderBy("height", "a", "b").limit(1))
        merges = pairs if merges is None else merges.unionByName(pairs)
        merged = pairs.select("run_id", F.explode(F.array("a", "b")).alias("s"))
        kept = near.join(merged, ["run_id", "s"], "left_anti").join(merged.withColumnRenamed("s", "t"), ["run_id", "t"], "left_anti").select("run_id", "s", "d", "t")
        fate = pairs.select("run_id", F.col("b").alias("s"), "a", F.lit(True).alias("now")).unionByName(kept.select("run_id", "s", F.col("s").alias("a"), F.lit(False).alias("now")))
        moved = tables.write(groups.join(fate, ["run_id", "s"], "left").select("run_id", "p", F.coalesce("a", "s").alias("s"), "n", "x", F.coalesce("now", F.lit(True)).alias("open")))
        for gone in (groups, block, old):
            if gone is not None:
                tables.drop(gone)
        groups, left, turn = moved, left - n, turn + 1
        if turn % 5 == 0:
            tables.release()
