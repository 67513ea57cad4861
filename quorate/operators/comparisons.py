"""Comparisons of runs: normalised results, wins, choices of profiles, failures, verdicts, labels and parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.operators import contingency as ct
from quorate.operators import features as ft
from quorate.operators import recommend as rc
from quorate.operators import reports as rp

#: Published parameters of data sets: lambda, eta, theta, diffusion time. Fixed values.
SET_PARAMS = {
    "Ecoli": (0.09, 0.65, 0.75, 1.0),
    "GLIOMA": (0.02, 0.8, 0.6, 1.0),
    "Aggregation": (0.08, 0.65, 0.7, 0.8),
    "Lung": (0.75, 0.75, 0.6, 1.2),
    "BBC": (0.06, 1.01, 1.01, 1.1),
    "orlraws10P": (0.95, 1.01, 1.01, 1.0),
    "densired_compact_hard": (0.08, 0.72, 0.78, 0.9),
    "densired_stretched_hard": (0.06, 0.82, 0.88, 1.3),
    "densired_mix_hard": (0.07, 0.75, 0.82, 1.1),
}

#: The same for every other data set. Fixed values.
ANY_PARAMS = (0.09, 0.75, 0.65, 1.0)

#: Bounds of the cautions about a data set: column, bound, whether more than it is bad, code. Fixed values.
CAUTIONS = [("dim", 0.5, True, "many features"), ("constant", 0.2, True, "constant features"), ("missing", 0.1, True, "missing values"), ("outlier", 0.1, True, "outliers"), ("explained", 0.5, False, "flat projection")]


def filled(column: str) -> Column:
    """The column as text, null where it is empty."""
    return F.nullif(F.col(column).cast("string"), F.lit(""))


def first_filled(rows: DataFrame, columns: list[str], default: str | None = None) -> Column:
    """The first of the columns, as far as rows have them, that is neither null nor empty; else the default."""
    return F.coalesce(*[filled(c) for c in columns if c in rows.columns], F.lit(default))


def normalised(rows: DataFrame, source: str, groups: dict[str, str], metrics: tuple[str, ...] = ("nmi", "ari", "f"), runs: tuple[str, ...] = ("", "5")) -> DataFrame:
    """(dataset, group, algorithm, method, metrics..., source) of finished rows with every metric and one of the wanted numbers of runs.

    A missing status counts as 'ok', a null number of runs as empty. The algorithm is the first of algorithm, version
    and mode that is filled; method is 'average' where it is empty; data sets outside ``groups`` are 'other'.
    """
    kept = rows.where(first_filled(rows, ["status"], "ok") == "ok").where(F.coalesce(F.col("runs").cast("string"), F.lit("")).isin(*runs))
    numbers = [F.expr(f"try_cast(`{m}` AS double)").alias(m) for m in metrics]
    group = F.coalesce(*[F.when(F.col("dataset") == k, v) for k, v in groups.items()], F.lit("other"))
    named = kept.select("dataset", group.alias("group"), first_filled(rows, ["algorithm", "version", "mode"]).alias("algorithm"), first_filled(rows, ["method"], "average").alias("method"), *numbers, F.lit(source).alias("source"))
    return named.dropna(subset=list(metrics))


def win_counts(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """(what, wins): how often each value of ``what`` has the largest result of a key, the first of ties."""
    return rp.best_row(rows, keys, *([] if what in keys else [what])).groupBy(what).agg(F.count("*").alias("wins"))


def profiles(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(profile_id, mean_rank, mean_value, mean_runtime, datasets): rows are ranked in their data set, ties at their mean."""
    named = rows.withColumn("profile_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return named.withColumn("r", rp.average_rank()).groupBy("profile_id").agg(F.avg("r").alias("mean_rank"), F.avg("value").alias("mean_value"), F.avg("runtime").alias("mean_runtime"), F.countDistinct("dataset").alias("datasets"))


def best_profile(rows: DataFrame, cols: list[str], by: str = "rank") -> DataFrame:
    """One row: the profile of smallest mean rank, then largest mean value and smallest run time (by='value': without the rank).

    Only finished consensus rows of the validation part are looked at, as far as rows have those columns.
    """
    for column, wanted in (("split", "validation"), ("family", "consensus"), ("status", "ok")):
        rows = rows.where(F.col(column) == wanted) if column in rows.columns else rows
    order = [F.desc("mean_value"), F.col("mean_runtime"), F.col("profile_id")]
    return profiles(rows, cols).orderBy(*([F.col("mean_rank")] if by == "rank" else []), *order).limit(1)


def failures(deltas: DataFrame, keys: list[str], n: int = 30) -> DataFrame:
    """The n rows of smallest delta, a null one counted as 0, ties by key."""
    return deltas.withColumn("delta", F.coalesce("delta", F.lit(0.0))).orderBy("delta", *keys).limit(n)


def significant_pairs(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The pairs of algorithms that differ significantly, the largest difference first."""
    return rp.nemenyi(scores, alpha).where("significant").drop("significant").orderBy(F.desc("difference"), "a", "b")


def run_label(algorithm: str = "algorithm", variant: str = "variant", linkage: str = "linkage", m: str = "m") -> Column:
    """algorithm / variant / linkage / m=...; empty parts and the variant 'default' are left out, and m where it is 0."""
    size = F.nullif(F.nullif(F.col(m).cast("string"), F.lit("")), F.lit("0"))
    return F.concat_ws(" / ", F.col(algorithm), F.nullif(filled(variant), F.lit("default")), filled(linkage), F.concat(F.lit("m="), size))


def resolved(rows: DataFrame) -> DataFrame:
    """rows(dataset, lam, eta, theta, time) with nulls replaced by the data set's published value, else by the general one."""
    out = {}
    for i, c in enumerate(("lam", "eta", "theta", "time")):
        known = [F.when(F.col("dataset") == name, values[i]) for name, values in SET_PARAMS.items()]
        out[c] = F.coalesce(F.col(c), *known, F.lit(ANY_PARAMS[i]))
    return rows.withColumns(out)


def choices(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the distinct values of each column that are not null, in order; one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).select("p.*").dropna().distinct().orderBy("column", "value")


def number(column: str) -> Column:
    """The column with NaN as null."""
    return F.when(~F.isnan(column), F.col(column))


def averages(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., columns...): means that skip nulls and NaN."""
    return rows.groupBy(*keys).agg(*[F.avg(number(c)).alias(c) for c in columns])


def gain_share(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys..., n, share, mean_gain): share of rows where b is above a, and b's mean gain, over rows that have both."""
    gain = number(b) - number(a)
    return rows.withColumn("_gain", gain).groupBy(*keys).agg(F.count("_gain").alias("n"), F.avg((F.col("_gain") > 0).cast("double")).alias("share"), F.avg("_gain").alias("mean_gain"))


def member_scores(members: DataFrame, labels: DataFrame, label: str = "gt") -> DataFrame:
    """One row: partitions, mean nmi and mean ari of the base partitions against labels(obj_id, label); single clusters are skipped."""
    keep = members.groupBy("part_id").agg(F.min("cluster_id").alias("lo"), F.max("cluster_id").alias("hi")).where("lo < hi").select("part_id")
    scored = ct.agreement(members.join(keep, "part_id", "left_semi").join(labels, "obj_id"), ["part_id"], "cluster_id", label)
    return scored.agg(F.count("*").alias("partitions"), F.avg("nmi").alias("nmi"), F.avg("ari").alias("ari"))


def objective(silhouette: str = "silhouette", agreement: str = "agreement", davies_bouldin: str = "davies_bouldin") -> Column:
    """The value that tuning maximises: silhouette, agreement with the ensemble and compactness."""
    return F.lit(0.4) * (F.col(silhouette) + 1) / F.lit(2.0) + F.lit(0.4) * F.col(agreement) + F.lit(0.2) / (F.lit(1.0) + F.col(davies_bouldin))


def verdicts(both: DataFrame, default: str = "default", tuned: str = "tuned", band: float = 0.005) -> DataFrame:
    """both with ``delta`` and the verdict improved, same or worse."""
    d = F.col("delta")
    return both.withColumn("delta", F.col(tuned) - F.col(default)).withColumn("verdict", F.when(d > band, "improved").when(F.abs(d) <= band, "same").otherwise("worse"))


def result_matrix(rows: DataFrame, method: str | None = None) -> DataFrame:
    """(dataset, algorithm, value): means of one linkage, or of every algorithm/linkage as an algorithm of its own."""
    kept = rows.where(F.col("linkage") == method) if method else rows.withColumn("algorithm", F.concat_ws("/", "algorithm", "linkage"))
    return kept.groupBy("dataset", "algorithm").agg(F.round(F.avg("value"), 6).alias("value"))


def with_default(rows: DataFrame, lookup: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """rows with ``column`` of the lookup's row of that key, or the default. The lookup has one row a key."""
    return rows.join(lookup.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def tuned_blend(sets: DataFrame) -> DataFrame:
    """sets(dataset, n, k, d, overlap, silhouette, imbalance) -> (dataset, lam, eta, theta): the blend of near configurations with its four exceptions."""
    s = sets.join(rc.blend(sets.select("dataset", "n", "k", "d")), "dataset")
    wide = F.col("d") / F.greatest("n", F.lit(1)) > 2
    s = s.withColumn("lam", F.when(wide & (F.col("lam") < 0.15), 0.3).otherwise(F.col("lam")))
    s = s.withColumn("eta", F.when((F.col("overlap") > 0.4) & (F.col("eta") > 0.9), 0.8).otherwise(F.col("eta")))
    s = s.withColumn("theta", F.when((F.col("silhouette") > 0.55) & (F.col("theta") < 0.75), 0.75).otherwise(F.col("theta")))
    s = s.withColumn("theta", F.when((F.col("imbalance") > 5) & (F.col("theta") > 0.65), F.least("theta", F.lit(0.6))).otherwise(F.col("theta")))
    return s.select("dataset", *[F.round(c, 4).alias(c) for c in ("lam", "eta", "theta")])


def cautions(diag: DataFrame) -> DataFrame:
    """(dataset, cautions): the codes of CAUTIONS that hold, comma-joined; null diagnostics give none."""
    return diag.select("dataset", F.concat_ws(",", *[F.when(F.col(c) > bound if above else F.col(c) < bound, code) for c, bound, above, code in CAUTIONS]).alias("cautions"))


def nearest_labels(points: DataFrame, labelled: DataFrame, max_points: int = 10_000) -> DataFrame:
    """(obj_id, nearest, gt, d): each point's nearest labelled object and its label, ties by id.

    The points (at most ``max_points``, which is checked) go to all tasks; each task keeps its best object for a point.
    """
    pool = points.select("obj_id", "features").limit(max_points + 1).toPandas()
    if len(pool) > max_points:
        raise ValueError(f"more than {max_points} points")
    ids, x = pool["obj_id"].to_numpy(), np.stack(pool["features"].to_numpy()).astype(float) if len(pool) else np.zeros((0, 0))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("obj_id")
            y = np.stack(pdf["features"].to_numpy()).astype(float)
            for i, v in zip(ids, x, strict=True):
                d = np.sqrt(((y - v) ** 2).sum(1))
                at = int(d.argmin())
                yield pd.DataFrame({"obj_id": [i], "nearest": pdf["obj_id"].iloc[[at]].to_numpy(), "gt": pdf["gt"].iloc[[at]].to_numpy(), "d": [d[at]]})

    found = labelled.select("obj_id", "gt", "features").mapInPandas(nearest, "obj_id long, nearest long, gt long, d double")
    return found.groupBy("obj_id").agg(F.min(F.struct("d", "nearest", "gt")).alias("b")).select("obj_id", "b.nearest", "b.gt", "b.d")


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """rows ordered by name without regard to case, then by name; ``place`` counts from 1. For registries, not for data."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.lower(name), name)))


def projection(values: DataFrame) -> DataFrame:
    """(obj_id, x, y): the two first principal components, with signs that make the largest loading positive.

    Tasks sum the covariance; one task sees its d by d matrix; loadings (2 d numbers) are joined on the feature.
    """
    mean = values.groupBy("feat").agg(F.avg("value").alias("m"))

    def loadings(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.linalg.eigh(ft.covariance(pdf)[0])[1][:, ::-1]
        v = np.hstack([v, np.zeros((len(v), 1))])[:, :2]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(2)] < 0, -1, 1)
        return pd.DataFrame({"feat": np.arange(len(v)), "p": v[:, 0], "q": v[:, 1]})

    moments = ft.comoments(ft.objects_of(values), [])
    axes = moments.groupBy(F.lit(0).alias("_")).applyInPandas(lambda pdf: loadings(pdf), "feat int, p double, q double").join(mean, "feat")
    centred = F.col("value") - F.col("m")
    return values.join(axes, "feat").groupBy("obj_id").agg(F.sum(centred * F.col("p")).alias("x"), F.sum(centred * F.col("q")).alias("y"))


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): each row as JSON, with NaN and infinite numbers as null; nulls are written."""
    safe = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))
