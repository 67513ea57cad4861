"""Feature preparation and dataset diagnostics on the long form (obj_id, gt, feat, value).

Distances between all objects are a block product of two tables of arrays and grow with the square of the number of
objects by definition; the diagnostics that need them take ``max_n`` objects at most, chosen by the hash of their ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_feature(values: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """values with statistics of each feature: partial aggregates sent back, a row a feature, together as wide as one object."""
    return values.join(F.broadcast(values.groupBy("feat").agg(*[c.alias(n) for n, c in stats.items()])), "feat")


def zscore(values: DataFrame) -> DataFrame:
    """value less the mean over the population deviation, where a constant feature divides by 1."""
    s = per_feature(values, {"mean": F.avg("value"), "sd": F.stddev_pop("value")})
    return s.select("obj_id", "feat", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)).alias("value"))


def minmax(values: DataFrame) -> DataFrame:
    s = per_feature(values, {"low": F.min("value"), "high": F.max("value")})
    span = F.col("high") - F.col("low")
    return s.select("obj_id", "feat", ((F.col("value") - F.col("low")) / F.when(span > 0, span).otherwise(1.0)).alias("value"))


def preprocess(values: DataFrame, mode: str = "zscore") -> DataFrame:
    """Dispatch over zscore, minmax and none."""
    modes = {"zscore": zscore, "minmax": minmax, "none": lambda v: v.select("obj_id", "feat", "value")}
    if mode not in modes:
        raise ValueError(f"unknown preprocessing {mode!r}")
    return modes[mode](values)


def finite(value: str = "value") -> Column:
    c = F.col(value)
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def impute_mean(values: DataFrame) -> DataFrame:
    """Missing, NaN and infinite values become their feature's mean, or 0 if it has no finite value."""
    s = per_feature(values.withColumn("value", finite()), {"mean": F.avg("value")})
    return s.select("obj_id", "feat", F.coalesce("value", "mean", F.lit(0.0)).alias("value"))


def impute_median(values: DataFrame) -> DataFrame:
    s = per_feature(values.withColumn("value", finite()), {"mid": F.median("value")})
    return s.select("obj_id", "feat", F.coalesce("value", "mid").alias("value"))


def drop_constant(values: DataFrame) -> DataFrame:
    return per_feature(values, {"sd": F.stddev_pop("value")}).where("sd > 0").select("obj_id", "feat", "value")


def top_variance(values: DataFrame, n: int) -> DataFrame:
    """(feat, variance): the n features of largest population variance, ties by number."""
    return values.groupBy("feat").agg(F.var_pop("value").alias("variance")).orderBy(F.desc("variance"), "feat").limit(n)


def label_ids(labels: DataFrame, keys: list[str], label: str, order: Column | None = None, base: int = 1) -> DataFrame:
    """labels with ``id``: consecutive numbers of the distinct labels of each group, in their order."""
    names = labels.select(*keys, label).distinct()
    ranked = names.withColumn("id", F.row_number().over(W.partitionBy(*keys).orderBy(order if order is not None else F.col(label))) + (base - 1))
    return labels.join(ranked, [*keys, label])


def global_cluster_ids(members: DataFrame) -> DataFrame:
    """(part_id, cluster_id, gcid): clusters numbered through all partitions, from 0."""
    c = members.select("part_id", "cluster_id").distinct()
    k = c.groupBy("part_id").agg(F.count("*").alias("k"))
    before = k.select("part_id", (F.sum("k").over(W.orderBy("part_id")) - F.col("k")).alias("before"))  # one row a partition
    local = F.row_number().over(W.partitionBy("part_id").orderBy("cluster_id")) - 1
    return c.withColumn("local", local).join(before, "part_id").select("part_id", "cluster_id", (F.col("before") + F.col("local")).alias("gcid"))


def basic_profile(values: DataFrame) -> DataFrame:
    """n, d, d/n, shares of missing and infinite values and of constant features, and statistics of the feature variances."""
    v = F.col("value")
    bad = F.isnan(v) | v.isNull()
    infinite = ~bad & (F.abs(v) == float("inf"))
    known = F.when(~bad & ~infinite, v)
    per = values.groupBy("feat").agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("missing"), F.sum(infinite.cast("long")).alias("infinite"), F.var_pop(known).alias("var"))
    n, d = F.max("n"), F.count("*")
    return per.agg(
        n.alias("n"), d.alias("d"), (d / n).alias("d_over_n"), (F.sum("missing") / F.sum("n")).alias("missing_ratio"), (F.sum("infinite") / F.sum("n")).alias("inf_ratio"),
        F.avg((F.coalesce("var", F.lit(0.0)) < 1e-12).cast("double")).alias("constant_ratio"), F.avg("var").alias("var_mean"), F.stddev_pop("var").alias("var_std"), F.min("var").alias("var_min"), F.max("var").alias("var_max"),
    )


def class_stats(labels: DataFrame) -> DataFrame:
    """k, sizes, imbalance, share of small classes (below max(5, a tenth of the mean size)) and log2 entropy of gt."""
    sizes = labels.groupBy("gt").agg(F.count("*").alias("m"))
    total = sizes.agg(F.sum("m").alias("n"), F.avg("m").alias("mean"))
    s = sizes.crossJoin(F.broadcast(total))  # one row
    p = F.col("m") / F.col("n")
    small = (F.col("m") < F.greatest(F.lit(5), F.floor(F.col("mean") * 0.1))).cast("double")
    return s.agg(F.count("*").alias("k"), F.min("m").alias("min_size"), F.max("m").alias("max_size"), (F.max("m") / F.min("m")).alias("imbalance"), F.avg(small).alias("small_ratio"), F.sum(-p * F.log2(p)).alias("entropy"))


def centroids(values: DataFrame) -> DataFrame:
    """(gt, size, center array)."""
    c = values.groupBy("gt", "feat").agg(F.avg("value").alias("c"), F.count("*").alias("n"))
    return c.groupBy("gt").agg(F.max("n").alias("size"), F.expr("transform(array_sort(collect_list(struct(feat, c))), x -> x.c)").alias("center"))


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroid_distances(values: DataFrame) -> DataFrame:
    """min_nearest, mean distance, and the mean of nearest over second nearest (three classes or more) of class centres."""
    c = centroids(values)
    pairs = c.select(F.col("gt").alias("p"), F.col("center").alias("a")).join(c.select(F.col("gt").alias("q"), F.col("center").alias("b")), F.col("p") != F.col("q"))
    near = pairs.select("p", distance("a", "b").alias("d")).groupBy("p").agg(F.min("d").alias("d1"), F.avg("d").alias("mean"), F.expr("get(sort_array(collect_list(d)), 1)").alias("d2"))
    return near.agg(F.min("d1").alias("min_nearest"), F.avg("mean").alias("mean_distance"), F.avg(F.col("d1") / F.col("d2")).alias("margin"))


def separation(values: DataFrame) -> DataFrame:
    """calinski_harabasz and davies_bouldin from class sums, without any pair of objects."""
    c = centroids(values)
    mean = values.groupBy("feat").agg(F.avg("value").alias("m")).agg(F.expr("transform(array_sort(collect_list(struct(feat, m))), x -> x.m)").alias("mean"))
    objs = values.groupBy("obj_id", "gt").agg(F.expr("transform(array_sort(collect_list(struct(feat, value))), x -> x.value)").alias("x")).join(c, "gt")
    spread = objs.select("gt", distance("x", "center").alias("r")).groupBy("gt").agg(F.avg("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("w"))
    per = c.join(spread, "gt").crossJoin(F.broadcast(mean)).withColumn("b", F.col("size") * F.pow(distance("center", "mean"), 2))
    ch = per.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("size").alias("n"), F.count("*").alias("k"))
    ch = ch.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    left = per.select(F.col("gt").alias("p"), F.col("s").alias("sp"), F.col("center").alias("a"))
    right = per.select(F.col("gt").alias("q"), F.col("s").alias("sq"), F.col("center").alias("b2"))
    ratio = left.join(right, F.col("p") != F.col("q")).select("p", ((F.col("sp") + F.col("sq")) / distance("a", "b2")).alias("r"))
    return ch.crossJoin(F.broadcast(ratio.groupBy("p").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))))


def sampled(objs: DataFrame, max_n: int) -> DataFrame:
    """Exactly max_n objects, or all: those of the smallest md5 of their id."""
    return objs.orderBy(F.md5(F.col("obj_id").cast("string")), "obj_id").limit(max_n)


def compared(objs: DataFrame, max_n: int, reduce: Callable, schema: str) -> DataFrame:
    """One row (schema) for each of at most max_n objects: what reduce(own place, distances to all of them, ids, classes) gives.

    The sample goes to the driver and to all tasks, where each part of it is compared with the whole in arrays; distances
    do not leave the task.
    """
    some = sampled(objs.select("obj_id", "gt", "features"), max_n)
    pool = some.toPandas()
    x = np.stack(pool["features"].to_numpy()).astype(float) if len(pool) else np.zeros((0, 0))
    ids, classes = pool["obj_id"].to_numpy(), pd.factorize(pool["gt"], use_na_sentinel=False)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [reduce(at, np.sqrt(((x - x[at]) ** 2).sum(1)), ids, classes) for at in pdf["id"]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return objs.sparkSession.range(0, len(pool), 1, objs.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, schema)


def silhouette(objs: DataFrame, max_n: int = 2000) -> DataFrame:
    """Mean Euclidean silhouette; an object alone in its class has 0."""

    def reduce(at: int, d: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> tuple:
        n, total = np.bincount(classes), np.bincount(classes, weights=d)
        own = classes[at]
        n[own] -= 1  # not itself, which is 0 away
        mean = np.divide(total, n, out=np.full(len(n), np.inf), where=n > 0)
        others = np.delete(mean, own)
        if n[own] == 0 or not len(others):
            return (0.0 if n[own] == 0 else None,)
        b = others.min()
        return ((b - mean[own]) / max(mean[own], b),)

    return compared(objs, max_n, reduce, "s double").agg(F.avg("s").alias("silhouette"), F.count("*").alias("n"))


def knn_density(objs: DataFrame, k: int = 5, max_n: int = 3000, exclude_self: bool = False) -> DataFrame:
    """Mean, deviation and variation of the k-th neighbour's distance, and the share beyond its 95th percentile."""

    def reduce(at: int, d: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> tuple:
        d = np.delete(d, at) if exclude_self else d
        return (np.partition(d, k - 1)[k - 1] if len(d) >= k else None,)

    kth = compared(objs, max_n, reduce, "d double").where("d IS NOT NULL")
    cut = kth.agg(F.percentile("d", F.lit(0.95)).alias("p95"))
    return kth.crossJoin(F.broadcast(cut)).agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), (F.stddev_pop("d") / F.avg("d")).alias("cv"), F.avg((F.col("d") > F.col("p95")).cast("double")).alias("outlier_ratio"))


def overlap(objs: DataFrame, k: int = 60, max_n: int = 3000, exclude_self: bool = False) -> DataFrame:
    """Nearest friend and enemy among the k nearest: means, share of objects nearer to an enemy, mean ratio."""

    def reduce(at: int, d: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> tuple:
        near = np.lexsort((ids, d))
        near = (near[near != at] if exclude_self else near)[:k]
        friend = classes[near] == classes[at]
        first = lambda x: d[x[0]] if len(x) else None
        return first(near[friend]), first(near[~friend])

    both = compared(objs, max_n, reduce, "f double, e double").where("f IS NOT NULL AND e IS NOT NULL")
    return both.agg(F.avg("f").alias("friend"), F.avg("e").alias("enemy"), F.avg((F.col("e") < F.col("f")).cast("double")).alias("overlap_ratio"), F.avg(F.col("e") / F.greatest("f", F.lit(1e-12))).alias("margin_ratio"))


def comoments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys..., x array<double>) -> (keys..., a, b, v): sums over the rows of products of the features a <= b, less a common shift.

    b = -1 has the sums of feature a, and a = -1 the number of rows, so covariances need nothing else. A task adds up
    matrices for each key and returns d * (d + 1) / 2 numbers at its end; the shift is the mean of each feature, a row's width.
    """
    means = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()  # a row a feature
    shift = np.array([np.nan if r.m is None else r.m for r in means], dtype=float)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                if len(part):
                    x = np.stack(part["x"].to_numpy()).astype(float) - shift
                    n, s, c = held.get(key, (0, 0.0, 0.0))
                    held[key] = n + len(x), s + x.sum(0), c + x.T @ x
        i, j = np.triu_indices(len(shift))
        for key, (n, s, c) in held.items():
            a = np.concatenate([i, np.arange(len(s)), [-1]])
            b = np.concatenate([j, np.full(len(s), -1), [-1]])
            yield pd.DataFrame({**{k: [v] * len(a) for k, v in zip(keys, key, strict=True)}, "a": a, "b": b, "v": np.concatenate([c[i, j], s, [float(n)]])})

    return rows.select(*keys, "x").mapInPandas(run, ", ".join([*kinds, "a int, b int, v double"])).groupBy(*keys, "a", "b").agg(F.sum("v").alias("v"))


def covariance(pdf: pd.DataFrame) -> tuple[np.ndarray, int]:
    """The sample covariance and the number of rows from the comoments of one key."""
    a, b, v = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["v"].to_numpy()
    n = int(v[a == -1][0])
    sums = (b == -1) & (a >= 0)
    s = np.zeros(int(sums.sum()))
    s[a[sums]] = v[sums]
    c = np.zeros((len(s), len(s)))
    both = b >= 0
    c[a[both], b[both]] = c[b[both], a[both]] = v[both]
    return (c - np.outer(s, s) / n) / max(1, n - 1), n


#: What an object's membership in its own cluster gains before memberships are made to sum to 1 again. Fixed value.
OWN = 1e-6


def objects_of(values: DataFrame, *keys: str) -> DataFrame:
    """(obj_id, keys..., x array): the values of each object in the order of the features."""
    return values.groupBy("obj_id", *keys).agg(F.expr("transform(array_sort(collect_list(struct(feat, value))), x -> x.value)").alias("x"))


def memberships(objs: DataFrame, centres: DataFrame, on: list[str], own: str) -> DataFrame:
    """objs(obj_id, on..., own, x), centres(on..., cluster, center) -> u: inverse distances that sum to 1, with OWN added to the own cluster's."""
    near = objs.join(centres, on) if on else objs.join(centres, F.lit(True))
    near = near.withColumn("u", F.lit(1.0) / F.greatest(distance("x", "center"), F.lit(1e-12))).drop("x", "center")
    u = F.col("u") / F.sum("u").over(W.partitionBy("obj_id", *on))
    return near.withColumn("u", (u + F.when(F.col("cluster") == F.col(own), OWN).otherwise(0.0)) / (1 + OWN))


def fuzzy_membership(values: DataFrame) -> DataFrame:
    """(obj_id, gt, cluster, u): membership in each class centre by inverse distance, summing to 1."""
    c = centroids(values).select(F.col("gt").alias("cluster"), "center")
    return memberships(objects_of(values, "gt"), c, [], "gt").select("obj_id", "gt", "cluster", "u")


def mean_entropy_weight(u: DataFrame, on: list[str], own: str, lam: float) -> DataFrame:
    h = u.groupBy("obj_id", *on, own).agg(F.sum(-F.col("u") * F.log2(F.greatest("u", F.lit(1e-12)))).alias("h"), F.count("*").alias("k"))
    weight = F.exp(-(F.avg("h") / F.log2(F.greatest(F.max("k"), F.lit(2)).cast("double"))) / F.lit(max(lam, 1e-12)))
    return h.groupBy(*on, F.col(own).alias("cluster_id")).agg(weight.alias("weight"))


def fuzzy_weights(values: DataFrame, lam: float = 0.09) -> DataFrame:
    """(cluster, weight): exp(-H / lam), H the mean membership entropy of the cluster's objects over log2 of the number of clusters."""
    return mean_entropy_weight(fuzzy_membership(values), [], "gt", lam).withColumnRenamed("cluster_id", "cluster")


def fuzzy_partition_weights(values: DataFrame, members: DataFrame, lam: float = 0.09) -> DataFrame:
    """(part_id, cluster_id, weight): the fuzzy entropy weight of each cluster of each base partition, from the features."""
    x = objects_of(values)
    sums = members.join(values.select("obj_id", "feat", "value"), "obj_id").groupBy("part_id", "cluster_id", "feat").agg(F.avg("value").alias("c"))
    centres = sums.groupBy("part_id", F.col("cluster_id").alias("cluster")).agg(F.expr("transform(array_sort(collect_list(struct(feat, c))), x -> x.c)").alias("center"))
    return mean_entropy_weight(memberships(members.select("obj_id", "part_id", "cluster_id").join(x, "obj_id"), centres, ["part_id"], "cluster_id"), ["part_id"], "cluster_id", lam)


def chance(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def hopkins(objs: DataFrame, m: int = 150, max_n: int = 3000) -> DataFrame:
    """One row hopkins: w / (w + u), w the sum of m even probes' distances to their nearest object, u of m objects' to their nearest other.

    At most a third of the objects are taken; with fewer than 15 objects, or only equal ones, it is null. The objects
    are the first max_n, and the taken ones the first m, by the md5 of their id; probes are even in the objects' box.
    """
    some = sampled(objs, max_n).select("obj_id", F.col("features").alias("x"))
    n = some.agg(F.count("*").alias("n")).select(F.least(F.lit(m), F.floor(F.col("n") / 3)).cast("int").alias("m")).where("m >= 5")
    box = some.select(F.posexplode("x").alias("feat", "v")).groupBy("feat").agg(F.min("v").alias("low"), (F.max("v") - F.min("v")).alias("span"))
    spots = n.select(F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("p")).join(F.broadcast(box), F.lit(True))  # a row a feature
    value = F.col("low") + chance(F.col("p").cast("string"), F.col("feat").cast("string")) * F.when(F.col("span") == 0, 1.0).otherwise(F.col("span"))
    probes = spots.withColumn("v", value).groupBy("p").agg(F.expr("transform(array_sort(collect_list(struct(feat, v))), x -> x.v)").alias("y"))
    w = probes.join(some, F.lit(True)).groupBy("p").agg(F.min(distance("x", "y")).alias("d")).agg(F.sum("d").alias("w"))
    ranked = some.withColumn("r", F.row_number().over(W.orderBy(F.md5(F.col("obj_id").cast("string")), "obj_id")))  # max_n rows
    taken = ranked.join(F.broadcast(n), F.col("r") <= F.col("m")).select(F.col("obj_id").alias("i"), F.col("x").alias("y"))
    u = taken.join(some, F.col("i") != F.col("obj_id")).groupBy("i").agg(F.min(distance("x", "y")).alias("d")).agg(F.sum("d").alias("u"))
    total = F.col("w") + F.col("u")
    return w.crossJoin(F.broadcast(u)).select(F.when(total >= 1e-12, F.col("w") / total).alias("hopkins"))


def diagnostics(objs: DataFrame, max_n: int = 3000) -> DataFrame:
    """One row: the composite record of objs(obj_id, features, gt), named as the rules of advice take it.

    Every part is one row; parts that a data set is too small for are null.
    """
    from quorate.operators import ensemble

    values = objs.select("obj_id", "gt", F.posexplode("features").alias("feat", "value"))
    shapes = ensemble.class_shapes(objs).agg(F.avg("elongation").alias("elongation_mean"), F.max("elongation").alias("elongation"), F.avg("condition").alias("condition_mean"), F.max("condition").alias("condition_max"))
    parts = [
        basic_profile(values),
        class_stats(objs.select("obj_id", "gt")),
        ensemble.pca_profile(values).withColumnsRenamed({"dims_90": "dim90", "dims_95": "dim95"}),
        hopkins(objs, max_n=max_n),
        knn_density(objs, max_n=max_n).select(F.col("mean").alias("knn_mean"), F.col("std").alias("knn_std"), F.col("cv").alias("density"), "outlier_ratio"),
        silhouette(objs).select("silhouette"),
        separation(values),
        overlap(objs, max_n=max_n).withColumnRenamed("overlap_ratio", "overlap"),
        centroid_distances(values),
        shapes,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), F.lit(True), "left")  # one row each
    return out
