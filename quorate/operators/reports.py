"""Reports over result tables: paired deltas, ranks, rank tests, selections, splits, job grids, upserts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorate.functions import kernels

#: Critical values of the studentised range over the square root of 2, for 2 to 10 algorithms. Fixed values.
NEMENYI_Q = {
    0.05: {2: 1.96, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.85, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164},
    0.1: {2: 1.645, 3: 2.052, 4: 2.291, 5: 2.459, 6: 2.589, 7: 2.693, 8: 2.78, 9: 2.855, 10: 2.92},
}


def paired_delta(results: DataFrame, keys: list[str], variant: str, value: str, a: str, b: str) -> DataFrame:
    """(keys..., a, b, delta): the last value of variant b less that of a, where both exist."""
    last = lambda v: F.max_by(F.when(F.col(variant) == v, F.col(value)), F.when(F.col(variant) == v, F.col("row_no")))
    both = results.where(F.col(variant).isin(a, b)).groupBy(*keys).agg(last(a).alias("a"), last(b).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").withColumn("delta", F.col("b") - F.col("a"))


def win_loss_tie(deltas: DataFrame, keys: list[str], band: float = 0.002) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy(*keys).agg(F.count_if(d > band).alias("wins"), F.count_if(d < -band).alias("losses"), F.count_if(F.abs(d) <= band).alias("ties"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"))


def best_of_families(scores: DataFrame, family: Column) -> DataFrame:
    """(dataset, single, consensus, delta): the best value of each family, where both exist."""
    best = scores.groupBy("dataset").agg(F.max(F.when(family == "single", F.col("value"))).alias("single"), F.max(F.when(family == "consensus", F.col("value"))).alias("consensus"))
    return best.where("single IS NOT NULL AND consensus IS NOT NULL").withColumn("delta", F.col("consensus") - F.col("single"))


def average_rank() -> Column:
    """Descending rank in the dataset, ties at their mean."""
    ties = F.count("*").over(W.partitionBy("dataset", "value"))
    return F.rank().over(W.partitionBy("dataset").orderBy(F.desc("value"))) + (ties - 1) / F.lit(2.0)


def complete(scores: DataFrame) -> DataFrame:
    """The datasets that every algorithm has a value for."""
    k = scores.agg(F.countDistinct("algorithm").alias("k"))
    full = scores.groupBy("dataset").agg(F.countDistinct("algorithm").alias("have")).join(F.broadcast(k), F.col("have") == F.col("k")).select("dataset")
    return scores.join(full, "dataset", "left_semi")


def ordinal_rank(scores: DataFrame) -> DataFrame:
    """(algorithm, mean_rank, n): ranks without ties (by name), nulls skipped, best mean first."""
    r = F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("value"), "algorithm"))
    return scores.where("value IS NOT NULL").withColumn("r", r).groupBy("algorithm").agg(F.avg("r").alias("mean_rank"), F.count("*").alias("n"))


def friedman(scores: DataFrame) -> DataFrame:
    """n, k, chi2, f (Iman and Davenport; infinite where the denominator is not positive) and its degrees of freedom."""
    mean = complete(scores).withColumn("r", average_rank()).groupBy("algorithm").agg(F.avg("r").alias("r"), F.count("*").alias("n"))
    s = mean.agg(F.max("n").cast("double").alias("n"), F.count("*").cast("double").alias("k"), F.sum(F.col("r") * F.col("r")).alias("r2"))
    k, n = F.col("k"), F.col("n")
    s = s.withColumn("chi2", F.lit(12.0) * n / (k * (k + 1)) * (F.col("r2") - k * (k + 1) * (k + 1) / F.lit(4.0)))
    low = n * (k - 1) - F.col("chi2")
    return s.select("n", "k", "chi2", F.when(low <= 0, F.lit(float("inf"))).otherwise((n - 1) * F.col("chi2") / low).alias("f"), (k - 1).alias("df1"), ((k - 1) * (n - 1)).alias("df2"))


def nemenyi(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(a, b, difference, critical, significant) of every two algorithms a < b."""
    mean = complete(scores).withColumn("r", average_rank()).groupBy("algorithm").agg(F.avg("r").alias("r"), F.count("*").alias("n"))
    size = mean.agg(F.count("*").alias("k"), F.max("n").alias("n"))
    q = F.element_at(F.create_map(*[x for k, v in NEMENYI_Q[alpha].items() for x in (F.lit(k), F.lit(v))]), F.col("k").cast("int"))
    size = size.select((q * F.sqrt(F.col("k") * (F.col("k") + 1) / (F.lit(6.0) * F.col("n")))).alias("critical"))
    left, right = mean.select(F.col("algorithm").alias("a"), F.col("r").alias("ra")), mean.select(F.col("algorithm").alias("b"), F.col("r").alias("rb"))
    pairs = left.join(right, F.col("a") < F.col("b")).join(F.broadcast(size), F.lit(True))
    return pairs.select("a", "b", F.abs(F.col("ra") - F.col("rb")).alias("difference"), "critical", (F.abs(F.col("ra") - F.col("rb")) > F.col("critical")).alias("significant"))


def signed_ranks(scores: DataFrame, baseline: str) -> DataFrame:
    """(algorithm, n, w_plus, w_minus, statistic): Wilcoxon's sums against the baseline; zero differences are left out."""
    base = scores.where(F.col("algorithm") == baseline).select("dataset", F.col("value").alias("base"))
    d = scores.where(F.col("algorithm") != baseline).join(base, "dataset").select("algorithm", (F.col("value") - F.col("base")).alias("d")).where("d <> 0")
    size = F.round(F.abs("d"), 9)
    ties = F.count("*").over(W.partitionBy("algorithm", size))
    d = d.withColumn("r", F.rank().over(W.partitionBy("algorithm").orderBy(size)) + (ties - 1) / F.lit(2.0))
    s = d.groupBy("algorithm").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    return s.withColumn("statistic", F.least("w_plus", "w_minus"))


def friedman_test(scores: DataFrame) -> DataFrame:
    """friedman with p, the upper tail of its F."""

    @F.pandas_udf("double")
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([kernels.f_tail(*x) for x in zip(f, d1, d2, strict=True)], dtype=float)

    return friedman(scores).withColumn("p", tail("f", "df1", "df2"))


def signed_rank_tests(scores: DataFrame, baseline: str, alpha: float = 0.05) -> DataFrame:
    """signed_ranks with the two-sided p of each algorithm, and Holm's adjusted p and decision over all of them.

    Algorithms without a difference have p = 1 and stay. Up to 50 differences without ties p is exact.
    """

    @F.pandas_udf("double")
    def exact(statistic: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([kernels.exact_wilcoxon(s, int(k)) for s, k in zip(statistic, n, strict=True)], dtype=float)

    all_of = scores.where(F.col("algorithm") != baseline).select("algorithm").distinct()
    ranked = all_of.join(signed_ranks(scores, baseline), "algorithm", "left").fillna(0)
    tested = ranked.withColumn("p", exact("statistic", "n"))
    return tested.join(holm(tested.select("algorithm", "p"), alpha).drop("p"), "algorithm")


def holm(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(algorithm, p, adjusted, reject): min(1, p * (m - i)) without a running maximum; rejections stop at the first failure."""
    w = W.orderBy("p", "algorithm")  # one row an algorithm
    m = p_values.agg(F.count("*").alias("m"))
    r = p_values.crossJoin(F.broadcast(m)).withColumn("adjusted", F.least(F.lit(1.0), F.col("p") * (F.col("m") - F.row_number().over(w) + 1)))
    reject = F.min((F.col("adjusted") < alpha).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1
    return r.select("algorithm", "p", "adjusted", reject.alias("reject"))


def sign_counts(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, k, p): two-sided sign test over nonzero differences; k the smaller count, p = min(1, 2 P(X <= k))."""
    c = deltas.where("delta <> 0").groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("delta") > 0).cast("int").alias("pos"))
    c = c.select(*keys, "n", F.least("pos", F.col("n") - F.col("pos")).alias("k"))
    tail = F.expr("aggregate(sequence(0, k), named_struct('c', exp(-n * ln(2D)), 's', 0D), (a, i) -> named_struct('c', a.c * (n - i) / (i + 1), 's', a.s + a.c)).s")
    return c.select(*keys, "n", "k", F.least(F.lit(1.0), F.lit(2.0) * tail).alias("p"))


def profile_selection(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(profile_id, mean_rank, mean_value, datasets): profiles ordered by rank, value and name; the first is the choice."""
    named = rows.withColumn("profile_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    per = named.groupBy("dataset", "profile_id").agg(F.avg("value").alias("value")).withColumn("value", F.round("value", 6))
    return per.withColumn("r", average_rank()).groupBy("profile_id").agg(F.avg("r").alias("mean_rank"), F.avg("value").alias("mean_value"), F.countDistinct("dataset").alias("datasets"))


def mean_of_means(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, mean_all): the mean over groups of their means, not over rows."""
    return rows.groupBy(outer, inner).agg(F.avg("value").alias("m")).groupBy(outer).agg(F.avg("m").alias("mean_all"))


def best_row(rows: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """For each key the columns of the row with the largest value, the first of ties."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols, "value"), F.struct("value", -F.col("row_no"))).alias("b")).select(*keys, "b.*")


def power_fit(points: DataFrame, keys: list[str], n: str, t: str) -> DataFrame:
    """(keys..., points, exponent, factor, r2) of t = factor * n**exponent over means per n; three points at least."""
    mean = points.groupBy(*keys, n).agg(F.avg(t).alias("t")).where((F.col(n) > 0) & (F.col("t") > 0))
    x, y = F.log(F.col(n).cast("double")), F.log("t")
    fit = mean.groupBy(*keys).agg(F.count("*").alias("points"), F.regr_slope(y, x).alias("exponent"), F.exp(F.regr_intercept(y, x)).alias("factor"), F.regr_r2(y, x).alias("r2"))
    return fit.where("points >= 3")


def first_results(rows: DataFrame, most: int) -> DataFrame:
    """(algorithm, k, value): the first results of each algorithm in row order, numbered from 1."""
    k = F.row_number().over(W.partitionBy("algorithm").orderBy("row_no"))
    return rows.select("algorithm", "value", "row_no", k.alias("k")).where(F.col("k") <= most).select("algorithm", "k", "value")


def prefix_stability(rows: DataFrame, at: list[int]) -> DataFrame:
    """(algorithm, k, mean, std): mean and sample deviation of the first k results in row order."""
    w = W.partitionBy("algorithm").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    p = first_results(rows, max(at)).select("algorithm", F.col("k").cast("long").alias("k"), F.avg("value").over(w).alias("mean"), F.stddev_samp("value").over(w).alias("std"))
    return p.where(F.col("k").isin(at))


def prefix_intervals(rows: DataFrame, at: list[int], resamples: int = 2000, confidence: float = 0.95, seed: int = 19) -> DataFrame:
    """(algorithm, k, mean, std, low, high, width): prefix_stability with a percentile interval of the mean.

    An algorithm's task holds its first max(at) results. One matrix of draws serves all prefixes: a resample of the first
    k takes the first k of its uniform numbers times k as places, so prefixes share their draws and differ by what they add.
    """
    places = sorted(at)
    edge = 50 * (1 - confidence)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("k")["value"].to_numpy(dtype=float)
        u, out = np.random.default_rng(seed).random((resamples, len(v))), []
        for k in places:
            if k <= len(v):
                means = v[(u[:, :k] * k).astype(int)].mean(1)
                low, high = np.percentile(means, [edge, 100 - edge])
                out.append((pdf["algorithm"].iloc[0], k, v[:k].mean(), v[:k].std(ddof=1) if k > 1 else 0.0, low, high, high - low))
        return pd.DataFrame(out, columns=["algorithm", "k", "mean", "std", "low", "high", "width"])

    return first_results(rows, max(at)).groupBy("algorithm").applyInPandas(run, "algorithm string, k long, mean double, std double, low double, high double, width double")


def stratified_split(items: DataFrame, key: str, stratum: str, folds: int = 5) -> DataFrame:
    """(key, stratum, split, fold): 60/20/20 in each stratum by the order of md5(key), one each in the first two parts."""
    order = F.row_number().over(W.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)) - 1
    n = F.count("*").over(W.partitionBy(stratum))
    s = items.select(key, stratum, order.alias("o"), n.alias("n"))
    train, valid = F.greatest(F.lit(1), F.floor(F.col("n") * 6 / 10)), F.greatest(F.lit(1), F.floor(F.col("n") * 2 / 10))
    split = F.when(F.col("o") < train, "train").when(F.col("o") < train + valid, "validation").otherwise("test")
    return s.select(key, stratum, split.alias("split"), (F.col("o") % folds).alias("fold"))


def job_grid(manifest: DataFrame, algorithms: list[str], sizes: list[int], linkages: list[str], strategies: list[str], alphas: list[float], max_spectral: int = 900, max_guided: int = 650) -> DataFrame:
    """Every job of a benchmark: one row per dataset, algorithm, m, linkage, strategy and, for qd alone, alpha.

    'spectral' needs n <= max_spectral and algorithms that begin with 'guided' n <= max_guided.
    """
    lits = lambda xs: F.array(*map(F.lit, xs))
    j = manifest.withColumn("algorithm", F.explode(lits(algorithms)))
    j = j.where(~((F.col("algorithm") == "spectral") & (F.col("n") > max_spectral)) & ~(F.col("algorithm").startswith("guided") & (F.col("n") > max_guided)))
    j = j.withColumn("m", F.explode(lits(sizes))).withColumn("linkage", F.explode(lits(linkages))).withColumn("strategy", F.explode(lits(strategies)))
    return j.withColumn("alpha", F.explode(F.when(F.col("strategy") == "qd", lits(alphas)).otherwise(F.array(F.lit(None).cast("double")))))


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished row of the same key; nulls are equal to each other.

    Both sides are shuffled: grids are made by explode, so a plan takes them for far smaller than they are and would send one to the driver.
    """
    d = done.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return jobs.join(d.hint("merge"), on, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of new put in or in place of those with their key."""
    return existing.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def union_distinct(tables: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The union by name, one row per key: the first by ``order``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def text_search(rows: DataFrame, query: str) -> DataFrame:
    """Rows that have the query anywhere in their columns, whatever its case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])), F.lit(query.lower())))


def runtime_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def highlighted(scores: DataFrame, keys: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    """scores with ``best``: within tol of the largest value of its group."""
    top = scores.groupBy(*keys).agg(F.max(value).alias("_top"))
    return scores.join(top, keys).withColumn("best", F.abs(F.col(value) - F.col("_top")) < tol).drop("_top")


def dashboard_filter(rows: DataFrame, max_n: int | None = None, **wanted: str) -> DataFrame:
    """Rows whose columns have the wanted values, where 'all' wants any, with n up to max_n."""
    for column, value in wanted.items():
        if value != "all":
            rows = rows.where(F.col(column) == value)
    return rows if max_n is None else rows.where(F.col("n") <= max_n)


def categorised(rows: DataFrame, name: str, known: dict[str, str]) -> DataFrame:
    """rows with ``type``: that of the equal name, else of the first known name that contains it or is in it, else 'unknown'."""
    stem = F.regexp_replace(F.col(name), r"\.(npz|mat|csv|tsv|txt|json)$", "")
    exact = F.coalesce(*[F.when(stem == k, v) for k, v in known.items()])
    partly = F.coalesce(*[F.when(F.contains(stem, F.lit(k)) | F.contains(F.lit(k), stem), v) for k, v in known.items()])
    return rows.withColumn("type", F.coalesce(exact, partly, F.lit("unknown")))


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly n rows, or all: those of the smallest md5 of their key."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def chosen_sets(manifest: DataFrame, split: str | None = None, fold: int | None = None, types: list[str] | None = None, max_n: int | None = None, limit: int | None = None) -> DataFrame:
    """manifest(dataset, split, fold, type, n, ...) cut down to a split, a fold, types and sizes, then to the first ``limit`` by name; None takes all."""
    kept = manifest
    for condition, given in ((F.col("split") == split, split), (F.col("fold") == fold, fold), (F.col("type").isin(types or []), types), (F.col("n") <= max_n, max_n)):
        kept = kept if given is None else kept.where(condition)
    return kept if limit is None else kept.orderBy("dataset").limit(limit)


def known_results(results: DataFrame, algorithms: list[str], linkage: str | None = None) -> DataFrame:
    """Results of known algorithms, of one linkage if it is given."""
    kept = results.where(F.col("algorithm").isin(algorithms))
    return kept if linkage is None else kept.where(F.col("linkage") == linkage)


def runnable(registry: DataFrame, existing: DataFrame, suffixes: tuple[str, ...] = (".npz", ".mat")) -> DataFrame:
    """registry(path, suffix, n_partitions, ...) rows that consensus can run on: with members, of a suffix that is read, and still there."""
    return registry.where((F.col("n_partitions") > 0) & F.lower("suffix").isin(*suffixes)).join(existing.select("path").distinct(), "path", "left_semi")
