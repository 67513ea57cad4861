"""Queries of comparisons and benchmarks, with their SQL. The registry imports this module at its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quorate.functions.shared import shared_folder
from quorate.operators import benchmark as bm
from quorate.operators import clustering as cl
from quorate.operators import comparisons as cp
from quorate.operators import experiments as ex
from quorate.operators import features as ft
from quorate.operators import reports as rp
from quorate.plans import registry as rg
from quorate.plans import views as vw
from quorate.plans.registry import query, rounded

MONTHS = {"01": "winter", "02": "winter", "12": "winter", "06": "summer", "07": "summer", "08": "summer"}
RAW = "raw AS (SELECT strftime(ts, '%m') AS dataset, CASE WHEN user_id % 4 <> 0 THEN event_type ELSE '' END AS algorithm, 'v' || (user_id % 3) AS version, CASE WHEN user_id % 6 <> 0 THEN 'ward' ELSE '' END AS method, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN user_id % 11 = 0 THEN '2' WHEN user_id % 5 = 0 THEN '' ELSE '5' END AS runs, CASE WHEN user_id % 13 <> 0 THEN CAST(round(value, 3) AS VARCHAR) ELSE '' END AS nmi, CAST(round(value, 3) AS VARCHAR) AS ari FROM events)"


def raw(spark, sf):
    u = F.col("user_id")
    metric = F.round("value", 3).cast("string")
    return vw.table(spark, sf, "events").select(
        F.date_format("ts", "MM").alias("dataset"), F.when(u % 4 != 0, F.col("event_type")).otherwise("").alias("algorithm"), F.concat(F.lit("v"), (u % 3).cast("string")).alias("version"), F.when(u % 6 != 0, "ward").otherwise("").alias("method"),
        F.when(u % 7 == 0, "failed").otherwise("ok").alias("status"), F.when(u % 11 == 0, "2").when(u % 5 == 0, "").otherwise("5").alias("runs"), F.when(u % 13 != 0, metric).otherwise("").alias("nmi"), metric.alias("ari"),
    )


@query("normalised_results", "", f"WITH {RAW} SELECT dataset, CASE WHEN dataset IN ('01', '02', '12') THEN 'winter' WHEN dataset IN ('06', '07', '08') THEN 'summer' ELSE 'other' END AS \"group\", coalesce(nullif(algorithm, ''), version) AS algorithm, coalesce(nullif(method, ''), 'average') AS method, CAST(nmi AS DOUBLE) AS nmi, CAST(ari AS DOUBLE) AS ari, 'events' AS source FROM raw WHERE status = 'ok' AND runs IN ('', '5') AND nmi <> ''")
def normalised_results(spark, sf):
    return cp.normalised(raw(spark, sf), "events", MONTHS, ("nmi", "ari"))


@query("linkage_wins", "runs", "SELECT linkage, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY dataset, algorithm ORDER BY value DESC, row_no) AS r FROM runs) x WHERE r = 1 GROUP BY 1")
def linkage_wins(spark, sf):
    return cp.win_counts(vw.runs(spark, sf), ["dataset", "algorithm"], "linkage")


@query("algorithm_wins", "runs", "SELECT algorithm, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, row_no) AS r FROM runs) x WHERE r = 1 GROUP BY 1")
def algorithm_wins(spark, sf):
    return cp.win_counts(vw.runs(spark, sf), ["dataset"], "algorithm")


JOBS = "jobs AS (SELECT dataset, algorithm, linkage, value, CAST(row_no % 97 AS DOUBLE) AS runtime, CASE row_no % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, CASE WHEN row_no % 10 = 0 THEN 'failed' ELSE 'ok' END AS status FROM runs)"
PROFILES = f"{JOBS}, ok AS (SELECT * FROM jobs WHERE split = 'validation' AND status = 'ok'), rj AS (SELECT *, algorithm || '|' || linkage AS profile_id, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0 AS r FROM ok), pf AS (SELECT profile_id, avg(r) AS mean_rank, avg(value) AS mean_value, avg(runtime) AS mean_runtime, count(DISTINCT dataset) AS datasets FROM rj GROUP BY 1)"
PROFILE_COLUMNS = "profile_id, round(mean_rank, 5) AS mean_rank, round(mean_value, 5) AS mean_value, round(mean_runtime, 5) AS mean_runtime, datasets"


def jobs(spark, sf):
    r = F.col("row_no")
    return vw.runs(spark, sf).select("dataset", "algorithm", "linkage", "value", (r % 97).cast("double").alias("runtime"), F.when(r % 3 == 0, "train").when(r % 3 == 1, "validation").otherwise("test").alias("split"), F.when(r % 10 == 0, "failed").otherwise("ok").alias("status"))


@query("best_profile", "runs", f"WITH+ {PROFILES} SELECT {PROFILE_COLUMNS} FROM pf ORDER BY pf.mean_rank, pf.mean_value DESC, pf.mean_runtime, profile_id LIMIT 1")
def best_profile(spark, sf):
    return rounded(cp.best_profile(jobs(spark, sf), ["algorithm", "linkage"]), 5)


@query("best_profile_by_value", "runs", f"WITH+ {PROFILES} SELECT {PROFILE_COLUMNS} FROM pf ORDER BY pf.mean_value DESC, pf.mean_runtime, profile_id LIMIT 1")
def best_profile_by_value(spark, sf):
    return rounded(cp.best_profile(jobs(spark, sf), ["algorithm", "linkage"], "value"), 5)


@query("failure_table", "runs", f"WITH+ {rg.DELTA}, fd AS (SELECT dataset, algorithm, CASE WHEN dataset LIKE '%3' THEN 0.0 ELSE delta END AS delta FROM delta) SELECT dataset, algorithm, round(delta, 6) AS delta FROM fd ORDER BY fd.delta, dataset, algorithm LIMIT 30")
def failure_table(spark, sf):
    d = rg.deltas(spark, sf).withColumn("delta", F.when(~F.col("dataset").endswith("3"), F.col("delta")))
    return rounded(cp.failures(d.select("dataset", "algorithm", "delta"), ["dataset", "algorithm"]))


MATRIX = vw.with_views("runs", "WITH+ scores AS (SELECT dataset, algorithm || '/' || linkage AS algorithm, round(avg(value), 6) AS value FROM runs GROUP BY 1, 2)")


@query("labelled_friedman", "", MATRIX + ", " + rg.ORACLE["friedman"].split(vw.SQL["scores"])[1].lstrip(", "))
def labelled_friedman(spark, sf):
    return rounded(rp.friedman(cp.result_matrix(vw.runs(spark, sf))))


APART = rg.ORACLE["nemenyi_pairs"].replace("round(avg(value), 6) AS value", "round(avg(value) + 30 * length(algorithm), 6) AS value")


@query("significant_pairs", "", f"SELECT a, b, difference, critical FROM ({APART}) x WHERE difference > critical")
def significant_pairs(spark, sf):
    apart = vw.runs(spark, sf).groupBy("dataset", "algorithm").agg(F.avg("value").alias("v")).select("dataset", "algorithm", F.round(F.col("v") + 30 * F.length("algorithm"), 6).alias("value"))
    return rounded(cp.significant_pairs(apart))


@query("run_labels", "", "SELECT c_custkey, concat_ws(' / ', c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'qd' ELSE NULL END, CASE WHEN c_custkey % 4 > 1 THEN 'ward' END, CASE WHEN c_nationkey > 0 THEN 'm=' || c_nationkey END) AS label FROM customer")
def run_labels(spark, sf):
    k = F.col("c_custkey")
    c = vw.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("algorithm"), F.when(k % 3 == 0, "default").when(k % 3 == 1, "qd").otherwise("").alias("variant"), F.when(k % 4 > 1, "ward").when(k % 4 == 1, "").alias("linkage"), F.col("c_nationkey").alias("m"))
    return c.select("c_custkey", cp.run_label().alias("label"))


NAMES = [*cp.SET_PARAMS, "none of these", None]
KNOWN = "known(name, lam, eta, theta, t) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in cp.SET_PARAMS.items()) + ")"


@query("resolved_params", "", f"WITH {KNOWN}, o AS (SELECT c_custkey, CASE c_custkey % 11 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(NAMES[:-1]))} END AS dataset, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey / 100.0 END AS l, CASE WHEN c_custkey % 7 = 0 THEN c_nationkey / 50.0 END AS e FROM customer) SELECT c_custkey, dataset, CAST(coalesce(l, lam, 0.09) AS DOUBLE) AS lam, CAST(coalesce(e, eta, 0.75) AS DOUBLE) AS eta, CAST(coalesce(theta, 0.65) AS DOUBLE) AS theta, CAST(coalesce(t, 1.0) AS DOUBLE) AS time FROM o LEFT JOIN known ON name = dataset")
def resolved_params(spark, sf):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (k % 11 + 1).cast("int"))
    none = F.lit(None).cast("double")
    c = vw.table(spark, sf, "customer").select("c_custkey", name.alias("dataset"), F.when(k % 5 == 0, F.col("c_nationkey") / F.lit(100.0)).alias("lam"), F.when(k % 7 == 0, F.col("c_nationkey") / F.lit(50.0)).alias("eta"), none.alias("theta"), none.alias("time"))
    return cp.resolved(c)


@query("filter_choices", "runs", "SELECT DISTINCT 'dataset' AS \"column\", dataset AS value FROM runs UNION ALL SELECT DISTINCT 'algorithm', algorithm FROM runs UNION ALL SELECT DISTINCT 'linkage', linkage FROM runs UNION ALL SELECT DISTINCT 'seed', CAST(seed AS VARCHAR) FROM runs")
def filter_choices(spark, sf):
    return cp.choices(vw.runs(spark, sf), ["dataset", "algorithm", "linkage", "seed"])


def holes(spark, sf):
    a = F.when(F.col("row_no") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    b = F.when(F.col("row_no") % 19 != 0, F.col("value") * (F.col("seed") + 1) / F.lit(2.0))
    return vw.runs(spark, sf).select("algorithm", a.alias("a"), b.alias("b"))


HOLES = "h AS (SELECT algorithm, CASE WHEN row_no % 17 <> 0 THEN value END AS a, CASE WHEN row_no % 19 <> 0 THEN value * (seed + 1) / 2.0 END AS b FROM runs)"


@query("nan_averages", "runs", f"WITH+ {HOLES} SELECT algorithm, round(avg(a), 5) AS a, round(avg(b), 5) AS b FROM h GROUP BY 1")
def nan_averages(spark, sf):
    return rounded(cp.averages(holes(spark, sf), ["algorithm"], ["a", "b"]), 5)


@query("gain_share", "runs", f"WITH+ {HOLES} SELECT algorithm, count(b - a) AS n, round(avg(CASE WHEN b - a > 0 THEN 1.0 WHEN b - a <= 0 THEN 0.0 END), 5) AS share, round(avg(b - a), 5) AS mean_gain FROM h GROUP BY 1")
def gain_share(spark, sf):
    return rounded(cp.gain_share(holes(spark, sf), ["algorithm"], "a", "b"), 5)


MEMBER = "q AS (SELECT *, n2 - n AS tp, b2 - n2 AS fp, a2 - n2 AS fn FROM s WHERE ka > 1), sc AS (SELECT part_id, CASE WHEN abs(mi) < 1e-12 THEN 0.0 ELSE greatest(0.0, mi / ((ha + hb) / 2)) END AS nmi, CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp * (n*n - tp - fp - fn - n) - fn * fp) / ((tp + fn) * (fn + (n*n - tp - fp - fn - n)) + (tp + fp) * (fp + (n*n - tp - fp - fn - n))) END AS ari FROM q)"
PREDICTED = "objects AS (SELECT vec_id AS obj_id, 1 + (CASE WHEN embedding[21] > 0 THEN 1 ELSE 0 END) + 2 * (CASE WHEN embedding[22] > 0 THEN 1 ELSE 0 END) AS gt FROM embeddings)"
AGREEMENT = f"WITH {PREDICTED}, {vw.SQL['members']}, {rg.MARGINS}, {MEMBER} SELECT count(*) AS partitions, round(avg(nmi), 6) AS nmi, round(avg(ari), 6) AS ari FROM sc"


@query("base_member_scores", "objects members", f"WITH+ {rg.MARGINS}, {MEMBER} SELECT count(*) AS partitions, round(avg(nmi), 6) AS nmi, round(avg(ari), 6) AS ari FROM sc")
def base_member_scores(spark, sf):
    return rounded(cp.member_scores(vw.members8(spark, sf), vw.objects(spark, sf).select("obj_id", "gt")))


def predicted(spark, sf):
    e = lambda i: F.when(F.col("embedding")[i] > 0, 1).otherwise(0)
    return vw.table(spark, sf, "embeddings").select(F.col("vec_id").alias("obj_id"), (1 + e(20) + 2 * e(21)).alias("label"))


@query("ensemble_agreement", "", AGREEMENT)
def ensemble_agreement(spark, sf):
    return rounded(cp.member_scores(vw.members8(spark, sf), predicted(spark, sf), "label"))


@query("tuning_objective", "", f"SELECT round(0.4 * (a.silhouette + 1) / 2.0 + 0.4 * c.nmi + 0.2 / (1.0 + b.davies_bouldin), 5) AS objective FROM ({rg.ORACLE['silhouette']}) a, ({rg.ORACLE['calinski_davies']}) b, ({rg.ORACLE['base_member_scores']}) c")
def tuning_objective(spark, sf):
    a, b, c = ft.silhouette(vw.objects(spark, sf)), ft.separation(rg.vals(spark, sf)), cp.member_scores(vw.members8(spark, sf), vw.objects(spark, sf).select("obj_id", "gt"))
    one = a.crossJoin(b).crossJoin(c.withColumnRenamed("nmi", "agreement"))  # one row each
    return one.select(F.round(cp.objective(), 5).alias("objective"))


@query("tuned_verdicts", "runs", "SELECT dataset, algorithm, round(a, 6) AS \"default\", round(b, 6) AS tuned, round(b - a, 6) AS delta, CASE WHEN b - a > 0.005 THEN 'improved' WHEN abs(b - a) <= 0.005 THEN 'same' ELSE 'worse' END AS verdict FROM (SELECT dataset, algorithm, avg(CASE WHEN linkage = 'average' THEN value END) / 1000 AS a, avg(CASE WHEN linkage = 'single' THEN value END) / 1000 AS b FROM runs GROUP BY 1, 2) x WHERE a IS NOT NULL AND b IS NOT NULL")
def tuned_verdicts(spark, sf):
    mean = lambda v: F.avg(F.when(F.col("linkage") == v, F.col("value"))) / F.lit(1000)
    both = vw.runs(spark, sf).groupBy("dataset", "algorithm").agg(mean("average").alias("default"), mean("single").alias("tuned")).dropna()
    return rounded(cp.verdicts(both))


@query("lookup_default", "", "SELECT c_custkey, coalesce(n_name, 'other') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON n_nationkey = c_nationkey")
def lookup_default(spark, sf):
    nation = vw.table(spark, sf, "nation").where("n_regionkey <> 1").withColumnRenamed("n_nationkey", "c_nationkey")
    return cp.with_default(vw.table(spark, sf, "customer"), nation, "c_nationkey", "n_name", "other").select("c_custkey", "n_name")


SMART_SETS = "sets AS (SELECT p_brand AS dataset, count(*) AS n, CAST(max(p_size) % 12 + 2 AS INTEGER) AS k, count(DISTINCT p_size) * 10 AS d, (count(*) % 10) / 10.0 AS overlap, (min(p_size) % 10) / 10.0 AS silhouette, CAST(count(*) % 9 AS DOUBLE) AS imbalance FROM part GROUP BY 1)"
SMART = rg.NEAR.replace(rg.SETS, SMART_SETS)


@query("smart_params", "", f"WITH {SMART}, bl AS (SELECT dataset, sum(lam / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) AS lam, sum(eta / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) AS eta, sum(theta / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) AS theta FROM nr WHERE place <= 3 GROUP BY 1), ov AS (SELECT dataset, n, d, imbalance, CASE WHEN d * 1.0 / greatest(n, 1) > 2 AND lam < 0.15 THEN 0.3 ELSE lam END AS lam, CASE WHEN overlap > 0.4 AND eta > 0.9 THEN 0.8 ELSE eta END AS eta, CASE WHEN silhouette > 0.55 AND theta < 0.75 THEN 0.75 ELSE theta END AS theta FROM bl JOIN sets USING (dataset)) SELECT dataset, round(lam, 4) AS lam, round(eta, 4) AS eta, round(CASE WHEN imbalance > 5 AND theta > 0.65 THEN least(theta, 0.6) ELSE theta END, 4) AS theta FROM ov")
def smart_params(spark, sf):
    n = F.count("*")
    s = vw.table(spark, sf, "part").groupBy(F.col("p_brand").alias("dataset")).agg(n.alias("n"), (F.max("p_size") % 12 + 2).alias("k"), (F.countDistinct("p_size") * 10).alias("d"), ((n % 10) / F.lit(10.0)).alias("overlap"), ((F.min("p_size") % 10) / F.lit(10.0)).alias("silhouette"), (n % 9).cast("double").alias("imbalance"))
    return cp.tuned_blend(s)


@query("cautions", "", "SELECT l_suppkey AS dataset, concat_ws(',', CASE WHEN d > 0.5 THEN 'many features' END, CASE WHEN c > 0.2 THEN 'constant features' END, CASE WHEN m > 0.1 THEN 'missing values' END, CASE WHEN o > 0.1 THEN 'outliers' END, CASE WHEN e < 0.5 THEN 'flat projection' END) AS cautions FROM (SELECT l_suppkey, count(DISTINCT l_quantity) * 1.0 / count(*) AS d, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN l_tax >= 0.08 THEN 1.0 ELSE 0.0 END) AS m, avg(CASE WHEN l_discount >= 0.1 THEN 1.0 ELSE 0.0 END) AS o, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS e FROM lineitem GROUP BY 1) x")
def cautions(spark, sf):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    d = vw.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("dataset")).agg((F.countDistinct("l_quantity") / F.count("*")).alias("dim"), share(F.col("l_returnflag") == "R").alias("constant"), share(F.col("l_tax") >= 0.08).alias("missing"), share(F.col("l_discount") >= 0.1).alias("outlier"), share(F.col("l_linestatus") == "F").alias("explained"))
    return cp.cautions(d)


@query("nearest_labels", "vals", "WITH+ dd AS (SELECT a.obj_id, b.obj_id AS nearest, b.gt, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d FROM vals a JOIN vals b ON a.feat = b.feat AND a.obj_id % 50 = 0 AND b.obj_id % 50 <> 0 GROUP BY 1, 2, 3) SELECT obj_id, nearest, gt, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY d, nearest) AS r FROM dd) x WHERE r = 1")
def nearest_labels(spark, sf):
    objs = vw.objects(spark, sf)
    return rounded(cp.nearest_labels(objs.where("obj_id % 50 = 0"), objs.where("obj_id % 50 <> 0")))


@query("names_in_order", "", "SELECT s_name, row_number() OVER (ORDER BY lower(s_name), s_name) AS place FROM supplier")
def names_in_order(spark, sf):
    return cp.by_name(vw.table(spark, sf, "supplier"), "s_name").select("s_name", "place")


@query("pca_projection")
def pca_projection(spark, sf):
    return rounded(cp.projection(rg.vals(spark, sf)))


def benchmark(spark, sf):
    objs = vw.objects(spark, sf)
    plan = bm.plan_jobs(objs.count(), [19], [6], ["average"], ["random", "qd"], [0.5], max_guided=None, max_spectral=None)
    return bm.run_jobs(objs, vw.members8(spark, sf), plan).drop("seconds")


@query("benchmark_jobs")
def benchmark_jobs(spark, sf):
    return rounded(benchmark(spark, sf))


@query("benchmark_winner")
def benchmark_winner(spark, sf):
    return rounded(bm.winners(benchmark(spark, sf)))


@query("experiment_suite")
def experiment_suite(spark, sf):
    """Two linkages and sizes of two algorithms over the embeddings, through a ledger of its own that a second start finds complete."""
    sets = {"embeddings": (vw.objects(spark, sf), vw.members8(spark, sf))}
    jobs = ex.plan(spark, "suite", sets, ["hierarchical", "weighted"], ["average", "complete"], [4, 8], runs=1)
    table = ex.ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    ex.run(table, jobs, sets)
    done = ex.run(table, jobs, sets)
    return rounded(done.select("experiment", "dataset", "algorithm", "linkage", "m", "n_objects", "n_members", "nmi_mean", "ari_mean", "f_mean", "status", "error"))


@query("ablation")
def ablation(spark, sf):
    return rounded(bm.ablation(vw.members8(spark, sf), vw.objects(spark, sf)))


@query("ensemble_preprocessing")
def ensemble_preprocessing(spark, sf):
    return rounded(bm.preprocessing_scores(vw.objects(spark, sf)))


@query("distributed_kmeans")
def distributed_kmeans(spark, sf):
    return cl.kmeans(vw.objects(spark, sf), 10)


@query("distributed_ensemble")
def distributed_ensemble(spark, sf):
    return cl.distributed_partitions(vw.objects(spark, sf), 8)
