"""Parameter advice as rules over a row of diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Published configurations: name, objects, classes, features, lambda, eta, theta. Fixed values.
CONFIGS = [
    ("Ecoli", 336, 8, 7, 0.09, 0.65, 0.75),
    ("GLIOMA", 50, 4, 4434, 0.02, 0.8, 0.6),
    ("Aggregation", 788, 7, 2, 0.08, 0.65, 0.7),
    ("MF", 2000, 10, 649, 0.05, 0.75, 0.95),
    ("IS", 6435, 7, 36, 0.03, 0.9, 0.95),
    ("MNIST", 2000, 10, 784, 0.07, 0.95, 0.95),
    ("Texture", 5500, 11, 40, 0.04, 1.01, 1.01),
    ("SPF", 4435, 12, 30, 0.06, 0.7, 0.9),
    ("ODR", 4000, 10, 27, 0.06, 0.95, 0.95),
    ("LS", 6435, 6, 36, 0.18, 0.7, 0.6),
    ("ISOLET", 7797, 26, 617, 0.06, 0.95, 0.95),
    ("USPS", 9298, 10, 256, 0.06, 0.95, 0.95),
    ("orlraws10P", 100, 10, 10304, 0.95, 1.01, 1.01),
    ("BBC", 2225, 5, 9635, 0.06, 1.01, 1.01),
    ("lung", 203, 5, 3312, 0.75, 0.75, 0.6),
]


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIGS, "name string, cn int, ck int, cd int, lam double, eta double, theta double")


def nearest_configs(sets: DataFrame, top: int = 3) -> DataFrame:
    """sets(dataset, n, k, d) -> the ``top`` nearest published configurations of each, with distance and place."""
    log1p = lambda c: F.log1p(F.col(c).cast("double"))
    d = F.abs(log1p("cn") - log1p("n")) + F.lit(2.0) * F.abs(F.col("ck") - F.col("k")) / F.greatest("k", F.lit(1)) + F.lit(0.5) * F.abs(log1p("cd") - log1p("d"))
    near = sets.join(F.broadcast(configs(sets.sparkSession)), F.lit(True)).withColumn("distance", d)  # 15 rows
    return near.withColumn("place", F.row_number().over(W.partitionBy("dataset").orderBy("distance", "name"))).where(F.col("place") <= top)


def blend(sets: DataFrame, top: int = 3) -> DataFrame:
    """(dataset, lam, eta, theta): the nearest configurations' values weighted by 1 / (distance + 1e-6)."""
    w = F.lit(1.0) / (F.col("distance") + F.lit(1e-6))
    return nearest_configs(sets, top).groupBy("dataset").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in ("lam", "eta", "theta")])


def rules(diag: DataFrame) -> DataFrame:
    """diag(dataset, n, k, dim90, hopkins, overlap, imbalance, elongation, silhouette, density) -> recommended parameters."""
    c = F.col
    k_min = F.when(c("k").isNotNull(), F.greatest(F.lit(2), c("k") - 2)).otherwise(2)
    k_max = F.when(c("k").isNotNull(), F.least(c("k") + 4, F.lit(30))).when(c("dim90").isNotNull(), F.least(F.greatest(F.lit(5), F.floor(c("dim90") / 2) + 2), F.lit(20))).otherwise(10)
    base = F.when(c("n") < 300, 20).when(c("n") < 1000, 30).when(c("n") < 5000, 40).otherwise(50)
    more = sum((F.when(x, 10).otherwise(0) for x in (c("hopkins") < 0.6, c("overlap") > 0.3, c("imbalance") > 5)), F.lit(0))
    return diag.select(
        "dataset", k_min.cast("long").alias("k_min"), k_max.cast("long").alias("k_max"), F.least(base + more, F.lit(100)).cast("long").alias("m"),
        F.when(c("n") > 2500, "kmeans").otherwise("mixed").alias("strategy"), F.lit("zscore").alias("preprocessing"),
        F.when(c("elongation") > 8, "single").otherwise("average").alias("method"),
        F.when(c("overlap") > 0.35, 2.5).when(c("silhouette") > 0.5, 1.2).when(c("k") > 6, 2.0).otherwise(1.5).alias("sharpen"),
        F.when(c("n") > 2500, 5.0).when((c("overlap") > 0.3) | (c("density") > 0.6), 4.0).otherwise(3.0).alias("diffusion_time"),
        F.when(c("overlap") > 0.4, 0.05).when(c("silhouette") > 0.5, 0.12).otherwise(0.09).alias("lam"),
        F.when(c("overlap") > 0.4, 0.8).when(c("silhouette") > 0.5, 0.7).otherwise(0.75).alias("eta"),
        F.when(c("imbalance") > 5, 0.55).when(c("silhouette") > 0.5, 0.7).otherwise(0.65).alias("theta"),
    )


def algorithm_ranking(diag: DataFrame) -> DataFrame:
    """(dataset, algorithm, score, place): sums of points per algorithm; ties in the order hierarchical, weighted, guided, guided_diffusion."""
    c = F.col
    total = lambda *xs: sum((F.when(x, p).otherwise(0.0) for x, p in xs), F.lit(0.0))
    high_d, over, clear, many, long, uneven, flat = c("d") / c("n") > 0.5, c("overlap") > 0.4, c("silhouette") > 0.55, c("k") > 7, c("elongation") > 8, c("imbalance") > 5, c("hopkins") < 0.55
    points = [
        ("hierarchical", total((clear, 1.5), (long, 2.0))),
        ("weighted", total((over, 2.5), (clear, 1.0), (long, 1.0), (flat, 1.5))),
        ("guided", total((high_d, 2.0), (many, 1.5))),
        ("guided_diffusion", F.lit(1.0) + total((high_d, 2.0), (over, 1.5), (many, 1.5), (uneven, 1.0))),
    ]
    rows = diag.select("dataset", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(a).alias("algorithm"), s.alias("score")) for i, (a, s) in enumerate(points)])).alias("p")).select("dataset", "p.*")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("score"), "o"))).drop("o")


def simple_rules(sets: DataFrame) -> DataFrame:
    """sets(dataset, n, d, k, pool) -> parameters from sizes alone: k range, m (the pool's size if there is one), strategy, sharpening, time."""
    c = F.col
    k_min = F.when(c("k").isNotNull(), F.greatest(F.lit(2), c("k") - 2)).otherwise(2)
    k_max = F.when(c("k").isNotNull(), F.least(c("k") + 4, F.lit(20))).otherwise(10)
    m = F.when(c("n") < 300, 20).when(c("n") < 1000, 30).when(c("n") < 5000, 40).otherwise(50)
    large = c("n") > 2500
    return sets.select(
        "dataset", k_min.cast("long").alias("k_min"), k_max.cast("long").alias("k_max"), F.coalesce(c("pool"), m).cast("long").alias("m"), F.when(large, "kmeans").otherwise("mixed").alias("strategy"),
        F.when(c("k") > 6, 2.0).otherwise(1.5).alias("sharpen"), F.when(large, 5.0).otherwise(3.0).alias("diffusion_time"),
        F.concat_ws(",", F.when(c("d") > 50, "many features"), F.when(large, "many objects"), F.when(c("k").isNull(), "no labels")).alias("warnings"),
    )


#: Diagnostics and the bounds of their low, medium and high bands. Fixed values.
BANDS = {"dim": (0.1, 0.5), "density": (0.3, 0.6), "overlap": (0.15, 0.3), "imbalance": (2, 5), "elongation": (3, 8)}


def bands(diag: DataFrame) -> DataFrame:
    """Low, medium or high for each diagnostic in BANDS; null stays null."""
    level = lambda c, low, high: F.when(F.col(c) < low, "low").when(F.col(c) < high, "medium").when(F.col(c) >= high, "high").alias(c)
    return diag.select("dataset", *[level(c, low, high) for c, (low, high) in BANDS.items()])


def route(diag: DataFrame) -> DataFrame:
    """The algorithm that a question about a data set is sent to: diffusion where it is dense, long or mixed, else weighted."""
    hard = (F.col("density") > 1) | (F.col("elongation") > 8) | (F.col("overlap") > 0.25)
    return diag.select("dataset", F.when(hard, "guided_diffusion").otherwise("weighted").alias("algorithm"))


#: Why rules() says what it says: what it is about, when, and the reason. Of one group the first that holds counts.
REASONS = [
    [("k range", "k IS NOT NULL", "around the number of classes"), ("k range", "dim90 IS NOT NULL", "no labels: from the dimensions that hold 90 % of the variance"), ("k range", "true", "no labels and no dimensions: the default")],
    [("m", "n < 300", "20 for fewer than 300 objects"), ("m", "n < 1000", "30 for fewer than 1000 objects"), ("m", "n < 5000", "40 for fewer than 5000 objects"), ("m", "true", "50 for 5000 objects or more")],
    [("m", "hopkins < 0.6", "10 more: weak cluster tendency")],
    [("m", "overlap > 0.3", "10 more: classes overlap")],
    [("m", "imbalance > 5", "10 more: strong imbalance of classes")],
    [("strategy", "n > 2500", "k-means alone: linkages are too slow for more than 2500 objects"), ("strategy", "true", "k-means and linkages in turn")],
    [("method", "elongation > 8", "single linkage keeps long clusters"), ("method", "density > 0.6", "average linkage bears uneven density"), ("method", "true", "average linkage is the steadiest")],
    [("sharpen", "overlap > 0.35", "strong contrast: classes overlap"), ("sharpen", "silhouette > 0.5", "little contrast: classes are clear"), ("sharpen", "k > 6", "more contrast: many classes"), ("sharpen", "true", "the default")],
    [("diffusion_time", "n > 2500", "longer for a large graph"), ("diffusion_time", "overlap > 0.3 OR density > 0.6", "longer: overlap or uneven density"), ("diffusion_time", "true", "the default")],
    [("lam, eta", "overlap > 0.4", "careful: classes overlap much"), ("lam, eta", "silhouette > 0.5", "bold: classes are clear"), ("lam, eta", "true", "the default")],
    [("theta", "imbalance > 5", "lower, so that small classes stay"), ("theta", "silhouette > 0.5", "higher: classes are clear"), ("theta", "true", "the default")],
]


def _first(group: list[tuple[str, str, str]]):
    out = None
    for about, when, why in group:
        out = (F.when if out is None else out.when)(F.expr(when), f"{about}: {why}")
    return out


def reasons(diag: DataFrame) -> DataFrame:
    """(dataset, reasons array<string>): a reason for each piece of advice of rules(), in the order of REASONS; unknown diagnostics give none."""
    return diag.select("dataset", F.array_compact(F.array(*[_first(g) for g in REASONS])).alias("reasons"))


#: What stands out in a row of diagnostics: whether it is a finding or a warning, when, and the text.
NOTES = [
    ("finding", "k IS NOT NULL", "labels are there: for scores and diagnostics only"),
    ("warning", "k IS NULL", "no labels: advice comes from the inner structure alone"),
    ("warning", "d / n >= 0.5", "many features for so few objects: distances become unreliable"),
    ("finding", "density >= 0.6", "density is uneven: look at average linkage and guided algorithms"),
    ("warning", "overlap >= 0.3", "classes overlap: scores can be low for all algorithms"),
    ("warning", "imbalance >= 5", "strong imbalance: small clusters can be lost without weights"),
    ("finding", "elongation >= 8", "clusters are long: look at single and average linkage"),
    ("warning", "outliers > 0.1", "many outliers: a chosen subset and a larger m may help"),
    ("warning", "constant > 0.2", "many constant features: they say nothing"),
    ("warning", "missing > 0.1", "many missing values were filled in"),
]


def interpretation(diag: DataFrame) -> DataFrame:
    """(dataset, findings, warnings, algorithm): what stands out, as arrays of texts, and the algorithm to start with.

    Notes on diagnostics that diag does not have are left out. Long clusters start with 'weighted', others with
    'guided_diffusion'.
    """
    known = {c.lower() for c in diag.columns}
    words = lambda when: {w for w in when.replace("/", " ").split() if w.isalpha() and w.islower()}
    texts = lambda kind: F.array_compact(F.array(*[F.when(F.expr(when), text) for k, when, text in NOTES if k == kind and words(when) <= known]))
    return diag.select("dataset", texts("finding").alias("findings"), texts("warning").alias("warnings"), F.when(F.col("elongation") > 8, "weighted").otherwise("guided_diffusion").alias("algorithm"))
