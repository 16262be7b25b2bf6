"""Exposure estimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.oracle_views import view
from varloom.catalog.q_aggregates import encoded  # noqa: F401
from varloom.catalog.q_windows import win_retrieval_rank
from varloom.catalog.registry import ORACLES, query
from varloom.operators import exposures as ex, features as ft

SQL_NEAREST = ORACLES["win_retrieval_rank"]


def profiles(t):
    return ft.shares(t.sample_counts()).select("patient", "channel", "p")


@query("exp_reference", "sigref maf", """
SELECT signature, channel, round(p/sum(p) OVER (PARTITION BY signature),6) AS p FROM sigref WHERE channel IN (SELECT DISTINCT variant_class||'_'||variant_type FROM maf WHERE variant_type<>'DEL')""")
def exp_reference(t):
    return ex.matched_reference(t.signature_reference(), t.sample_counts().filter("channel NOT LIKE '%DEL'"))


@query("exp_fit_nnls")
def exp_fit_nnls(t):
    return ex.fit(profiles(t), t.signature_reference())


@query("exp_split_norm")
def exp_split_norm(t):
    groups = {f"SIG{i}": "SBS" if i < 3 else "DBS" for i in range(5)}
    return ex.fit(profiles(t), t.signature_reference(), groups=groups)


@query("exp_lasso_pos")
def exp_lasso_pos(t):
    return ex.fit(profiles(t), t.signature_reference(), penalty=1e-5)


def exposure_pairs(t):
    """Shares of signatures per patient over all events (truth) and over half of them (prediction)."""
    n = t.profile_records().groupBy("patient", "signature").agg(
        F.count(F.lit(1)).alias("a"), F.count_if(F.col("event_id") % 3 == 0).alias("b"))
    total = n.groupBy("patient").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = lambda x, s: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(s)), F.lit(0.0))
    return n.join(total, "patient").select("patient", "signature", share("a", "ta").alias("truth"), share("b", "tb").alias("pred"))


view("exp_pairs", "profile_rec", """
SELECT patient, signature, a/CAST(sum(a) OVER w AS DOUBLE) AS truth, coalesce(b/CAST(nullif(sum(b) OVER w,0) AS DOUBLE),0) AS pred
FROM (SELECT patient, signature, count(*) AS a, count(*) FILTER (event_id%3=0) AS b FROM profile_rec GROUP BY ALL) WINDOW w AS (PARTITION BY patient)""")
view("exp_metrics", "exp_pairs", """
SELECT patient, CASE WHEN nt*np>1e-15 THEN dot/(nt*np) ELSE 0 END AS cosine, mae, l1, CASE WHEN st>1e-12 AND sp>1e-12 THEN c ELSE 0 END AS pearson, top1,
 CASE WHEN tp+fp>0 THEN tp/CAST(tp+fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp+fn>0 THEN tp/CAST(tp+fn AS DOUBLE) ELSE 0 END AS recall, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/CAST(2*tp+fp+fn AS DOUBLE) ELSE 0 END AS f1
FROM (SELECT patient, sum(truth*pred) AS dot, sqrt(sum(truth*truth)) AS nt, sqrt(sum(pred*pred)) AS np, avg(abs(truth-pred)) AS mae, sum(abs(truth-pred)) AS l1, stddev_pop(truth) AS st, stddev_pop(pred) AS sp,
 CASE WHEN stddev_pop(truth)>1e-12 AND stddev_pop(pred)>1e-12 THEN corr(truth,pred) END AS c, count(*) FILTER (pred>0.2 AND truth>0.2) AS tp, count(*) FILTER (pred>0.2 AND truth<=0.2) AS fp, count(*) FILTER (pred<=0.2 AND truth>0.2) AS fn,
 first(signature ORDER BY truth DESC, signature)=first(signature ORDER BY pred DESC, signature) AS top1 FROM exp_pairs GROUP BY patient)""")


@query("exp_eval", "exp_metrics", "SELECT patient, round(cosine,6) AS cosine, round(mae,6) AS mae, round(l1,6) AS l1, round(pearson,6) AS pearson, top1, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM exp_metrics")
def exp_eval(t):
    return ex.evaluate(exposure_pairs(t), 0.2)


@query("exp_diagnostics", "exp_pairs sigref sample_counts", """
WITH p AS (SELECT patient, channel, n/CAST(sum(n) OVER (PARTITION BY patient) AS DOUBLE) AS p FROM sample_counts), r AS (SELECT patient, channel, sum(pred*p) AS r FROM exp_pairs JOIN sigref USING (signature) GROUP BY ALL),
j AS (SELECT patient, coalesce(p,0) AS p, coalesce(r,0) AS r FROM p FULL JOIN r USING (patient, channel))
SELECT patient, round(CASE WHEN sqrt(sum(p*p))*sqrt(sum(r*r))>1e-15 THEN sum(p*r)/(sqrt(sum(p*p))*sqrt(sum(r*r))) ELSE 0 END,6) AS cosine, round(sqrt(sum((r-p)*(r-p)))/(sqrt(sum(p*p))+1e-15),6) AS error FROM j GROUP BY patient""")
def exp_diagnostics(t):
    weights = exposure_pairs(t).select("patient", "signature", F.col("pred").alias("weight"))
    return ex.diagnostics(weights, t.signature_reference(), profiles(t))


@query("exp_summaries", "exp_metrics", "SELECT top1, round(avg(mae),6) AS mean, count(*) AS n, round(quantile_cont(mae,0.5),6) AS median FROM exp_metrics GROUP BY top1")
def exp_summaries(t):
    return ex.summaries(ex.evaluate(exposure_pairs(t), 0.2), ["top1"], "mae")


view("bridge_w", "", "SELECT sample, process, n/CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS w FROM (SELECT o_custkey AS sample, label AS process, count(*) AS n FROM orders JOIN embeddings ON vec_id=o_orderkey % (SELECT count(*) FROM embeddings) GROUP BY ALL)")


@query("exp_impute_bridge", "bridge_w basis", """
WITH nearest AS (""" + SQL_NEAREST[SQL_NEAREST.index("c AS (SELECT label, vec_id%2"):].replace("c AS (SELECT label, vec_id%2", "WITH c AS (SELECT label, vec_id%2", 1) + """),
m AS (SELECT sample, nearest AS process, sum(w) AS w FROM bridge_w JOIN nearest USING (process) GROUP BY ALL), n AS (SELECT sample, process, w/sum(w) OVER (PARTITION BY sample) AS w FROM m),
avgw AS (SELECT process, sum(w)/(SELECT count(DISTINCT sample) FROM bridge_w) AS w FROM bridge_w GROUP BY process)
SELECT sample, round(avg(abs(coalesce(b.w,0)-coalesce(n.w,0))),6) AS bridge_mae, round(avg(abs(coalesce(b.w,0)-a.w)),6) AS mean_mae FROM (SELECT DISTINCT sample FROM bridge_w) s CROSS JOIN avgw a LEFT JOIN bridge_w b USING (sample, process) LEFT JOIN n USING (sample, process) GROUP BY sample""")
def exp_impute_bridge(t):
    labels = t.embeddings.select("vec_id", F.col("label").alias("process"))
    w = t.vector_orders().select(F.col("o_custkey").alias("sample"), "vec_id").join(labels, "vec_id")
    weights = ft.shares(ft.n_by(w, "sample", "process"), "sample").select("sample", "process", F.col("p").alias("w"))
    mapping = win_retrieval_rank(t).select("process", F.col("nearest").alias("target"))
    moved = ex.bridge(weights, mapping).withColumnRenamed("w", "m")
    size = F.broadcast(weights.agg(F.countDistinct("sample").alias("N")))
    mean = weights.groupBy("process").agg(F.sum("w").alias("s")).join(size).select("process", (F.col("s") / F.col("N")).alias("a"), F.lit(1).alias("j"))
    grid = weights.select("sample").distinct().withColumn("j", F.lit(1)).join(F.broadcast(mean), "j")
    full = grid.join(weights, ["sample", "process"], "left").join(moved, ["sample", "process"], "left").fillna(0.0, ["w", "m"])
    return full.groupBy("sample").agg(F.avg(F.abs(F.col("w") - F.col("m"))).alias("bridge_mae"), F.avg(F.abs(F.col("w") - F.col("a"))).alias("mean_mae"))


#: Starts of the factorisation (fixed values).
SEEDS = [11, 23, 37, 53, 71]


@query("exp_factorise")
def exp_factorise(t):
    return ex.factorise(t.sample_counts(), t.signature_reference(), 5, SEEDS)
