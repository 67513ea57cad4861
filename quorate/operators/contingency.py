"""Agreement of labelings from their contingency tables: one grouping over the long form, never a dense matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contingency(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys..., a, b, n): how many rows have each pair of labels."""
    return pairs.groupBy(*keys, a, b).agg(F.count("*").alias("n"))


def marginals(table: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys..., n, n2, a2, b2, k_a, k_b, mutual, h_a, h_b): sums that all measures are made of; natural logarithms."""
    rows = table.groupBy(*keys, a).agg(F.sum("n").alias("m"))
    cols = table.groupBy(*keys, b).agg(F.sum("n").alias("m"))
    entropy = F.sum(F.col("m") * F.log(F.col("m").cast("double")))
    x = rows.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("a2"), F.count("*").alias("k_a"), entropy.alias("ea"))
    y = cols.groupBy(*keys).agg(F.sum(F.col("m") * F.col("m")).alias("b2"), F.count("*").alias("k_b"), entropy.alias("eb"))
    z = table.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("eab"))
    x, y, z = (d.withColumn("_all", F.lit(1)) for d in (x, y, z))
    on, n = [*keys, "_all"], F.col("n")
    out = x.join(y, on).join(z, on).drop("_all")
    h = lambda e: F.log(n.cast("double")) - F.col(e) / n
    return out.select(*keys, "n", "n2", "a2", "b2", "k_a", "k_b", h("ea").alias("h_a"), h("eb").alias("h_b"), (h("ea") + h("eb") - h("eab")).alias("mutual"))


def nmi() -> Column:
    """Normalised mutual information by the arithmetic mean; 1 for two single clusters."""
    both = (F.col("k_a") == 1) & (F.col("k_b") == 1)
    return F.when(both, 1.0).when(F.abs("mutual") < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("mutual") / ((F.col("h_a") + F.col("h_b")) / F.lit(2.0))))


def ari() -> Column:
    """Adjusted Rand index from ordered pairs."""
    tp, fp, fn = (F.col(x).cast("double") for x in ("_tp", "_fp", "_fn"))
    n = F.col("n").cast("double")
    tn = n * n - tp - fp - fn - n
    plain = F.lit(2.0) * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return F.when((F.col("_fn") == 0) & (F.col("_fp") == 0), 1.0).otherwise(plain)


def f_score() -> Column:
    """Pairwise F: a labeling without pairs counts as precise (or complete)."""
    tp = (F.col("n2") - F.col("n")) / F.lit(2.0)
    precision = F.when(F.col("a2") == F.col("n"), 1.0).otherwise(tp / ((F.col("a2") - F.col("n")) / F.lit(2.0)))
    recall = F.when(F.col("b2") == F.col("n"), 1.0).otherwise(tp / ((F.col("b2") - F.col("n")) / F.lit(2.0)))
    return F.when(precision + recall == 0, 0.0).otherwise(F.lit(2.0) * precision * recall / (precision + recall))


def agreement(pairs: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """(keys..., n, nmi, ari, f) of predicted against true labels."""
    m = marginals(contingency(pairs, keys, pred, truth), keys, pred, truth)
    m = m.withColumns({"_tp": F.col("n2") - F.col("n"), "_fp": F.col("b2") - F.col("n2"), "_fn": F.col("a2") - F.col("n2")})
    return m.select(*keys, "n", nmi().alias("nmi"), ari().alias("ari"), f_score().alias("f"))


def partition_pairs(members: DataFrame) -> DataFrame:
    """(p, q, c, d, n): cluster overlaps of every two partitions p < q."""
    left = members.select("obj_id", F.col("part_id").alias("p"), F.col("cluster_id").alias("c"))
    right = members.select("obj_id", F.col("part_id").alias("q"), F.col("cluster_id").alias("d"))
    return left.join(right, "obj_id").where("p < q").groupBy("p", "q", "c", "d").agg(F.count("*").alias("n"))


def rand_agreement(members: DataFrame) -> DataFrame:
    """(p, q, agreement): share of object pairs, ordered and with repetition, on which two partitions agree."""
    m = marginals(partition_pairs(members), ["p", "q"], "c", "d")
    n = F.col("n").cast("double")
    return m.select("p", "q", ((n * n - F.col("a2") - F.col("b2") + 2 * F.col("n2")) / (n * n)).alias("agreement"))


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    return pairs.select("p", "q", value).unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"), value))


def quality(members: DataFrame) -> DataFrame:
    """(part_id, quality): mean agreement with the other partitions; 1 if there is no other."""
    mean = both_ways(rand_agreement(members), "agreement").groupBy(F.col("p").alias("part_id")).agg(F.avg("agreement").alias("quality"))
    return members.select("part_id").distinct().join(mean, "part_id", "left").select("part_id", F.coalesce("quality", F.lit(1.0)).alias("quality"))


def weights(members: DataFrame, sharpen: float = 1.0) -> DataFrame:
    """(part_id, weight): mean agreement, its own included, as a share of the total; then weight**sharpen as a share."""
    every = both_ways(rand_agreement(members), "agreement").select("p", "agreement")
    every = every.unionByName(members.select(F.col("part_id").alias("p"), F.lit(1.0).alias("agreement")).distinct())
    mean = every.groupBy(F.col("p").alias("part_id")).agg(F.avg("agreement").alias("m"))
    total = mean.agg(F.sum("m").alias("t"), F.count("*").alias("k"))
    share = F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(F.lit(1.0) / F.col("k"))
    sharp = mean.crossJoin(F.broadcast(total)).select("part_id", F.pow(share, F.lit(float(sharpen))).alias("w"))  # one row
    return sharp.crossJoin(F.broadcast(sharp.agg(F.sum("w").alias("t")))).select("part_id", (F.col("w") / F.col("t")).alias("weight"))


def run_weights(members: DataFrame, plan: DataFrame, sharpen: float = 1.0) -> DataFrame:
    """(run_id, position, part_id, weight): the weights that 'weighted' learns in each run of plan(run_id, part_id).

    position is the partition's place in its run, from 1. Agreements come from contingencies, once for all runs.
    """
    pairs = both_ways(rand_agreement(members), "agreement")
    other = plan.select(F.col("run_id"), F.col("part_id").alias("q"))
    met = plan.join(pairs, F.col("part_id") == F.col("p")).join(other, ["run_id", "q"]).groupBy("run_id", "part_id").agg(F.sum("agreement").alias("s"))
    run = W.partitionBy("run_id")  # the partitions of a run
    m = plan.join(met, ["run_id", "part_id"], "left").withColumn("m", (F.lit(1.0) + F.coalesce("s", F.lit(0.0))) / F.count("*").over(run))
    w = m.withColumn("w", F.pow(F.col("m") / F.sum("m").over(run), F.lit(float(sharpen))))
    return w.select("run_id", F.row_number().over(run.orderBy("part_id")).alias("position"), "part_id", (F.col("w") / F.sum("w").over(run)).alias("weight"))


def position_weights(members: DataFrame, plan: DataFrame, sharpen: float = 1.0) -> DataFrame:
    """(position, runs, weight): the mean learned weight of each place in a run."""
    return run_weights(members, plan, sharpen).groupBy("position").agg(F.count("*").alias("runs"), F.avg("weight").alias("weight"))


def nmi_agreement(members: DataFrame) -> DataFrame:
    """(part_id, weight): mean NMI with the other partitions over the largest such mean, within [1e-6, 1]; 1 if alone."""
    m = marginals(partition_pairs(members), ["p", "q"], "c", "d")
    mean_h = (F.col("h_a") + F.col("h_b")) / F.lit(2.0)
    value = F.when(mean_h <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mutual") / mean_h)))
    mean = both_ways(m.select("p", "q", value.alias("v")), "v").groupBy(F.col("p").alias("part_id")).agg(F.avg("v").alias("v"))
    top = mean.agg(F.max("v").alias("top"))
    scaled = mean.crossJoin(F.broadcast(top)).select("part_id", F.least(F.lit(1.0), F.greatest(F.lit(1e-6), F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(1.0))).alias("weight"))
    return members.select("part_id").distinct().join(scaled, "part_id", "left").select("part_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
