"""Consolidation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.oracle_views import view
from varloom.catalog.q_stats import _p2, deltas
from varloom.catalog.q_vectors import trf_candidate_stack
from varloom.catalog.registry import ORACLES, query
from varloom.evaluation import results as res, stats
from varloom.plans import panel
from varloom.sources.readers import union_results

FAMILIES = {"standard": "signatures_only", "kernel": "one_hot_event_KME", "stack": "MAF_stack_only"}


@query("cns_normalise", "", """
SELECT source, endpoint, representation, CASE representation WHEN 'standard' THEN 'signatures_only' WHEN 'kernel' THEN 'one_hot_event_KME' END AS representation_family, round(primary_score,6) AS primary_score FROM (
 SELECT 'a' AS source, c_mktsegment AS endpoint, CASE c_nationkey%3 WHEN 0 THEN 'standard' WHEN 1 THEN 'kernel' ELSE 'unknown' END AS representation, avg(c_acctbal) AS primary_score FROM customer GROUP BY ALL UNION ALL SELECT 'b', o_orderpriority, 'standard', avg(o_totalprice) FILTER (o_orderpriority>='3') FROM orders GROUP BY o_orderpriority)""")
def cns_normalise(t):
    rep = F.when(F.col("c_nationkey") % 3 == 0, "standard").when(F.col("c_nationkey") % 3 == 1, "kernel").otherwise("unknown")
    a = t.customer.groupBy(F.col("c_mktsegment").alias("endpoint"), rep.alias("representation")).agg(F.avg("c_acctbal").cast("string").alias("auroc"))
    b = t.orders.groupBy(F.col("o_orderpriority").alias("task_name")).agg(F.avg("o_totalprice").alias("s")).select(
        "task_name", F.when(F.col("task_name") < "3", "n/a").otherwise(F.col("s").cast("string")).alias("score"), F.lit("standard").alias("model"))
    raw = union_results({"a": a, "b": b})
    wanted = {"source": ["source"], "endpoint": ["endpoint", "task_name"], "representation": ["representation", "model"], "primary_score": ["score", "auroc", "spearman"]}
    return panel.normalise(raw, wanted, {k: v for k, v in FAMILIES.items() if k != "stack"})


def runs(t):
    r = res.sample_results(t)
    return r.select(
        "*", F.when(F.col("representation") == "kernel", "event_kernel").when(F.col("n") % 5 == 0, "locked").otherwise("complete_panel").alias("experiment"),
        F.when(F.col("n") % 7 == 0, 3).otherwise(5).alias("folds"), F.lit(1).alias("repeats"), F.when(F.col("n") % 11 == 0, " ").otherwise("oof.csv").alias("oof_file"),
        F.when(F.col("representation") == "kernel", 55).otherwise(60).alias("priority"),
    )


EXPECTED = {"standard": "complete_panel", "kernel": "event_kernel", "stack": "complete_panel"}
view("canonical", "results", """
SELECT endpoint, representation, learner, resample, score, n FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, representation, learner ORDER BY score DESC, resample) AS k FROM results
WHERE (representation='kernel' OR n%5<>0) AND n%7<>0 AND n%11<>0) WHERE k=1""")


def canon(t):
    return panel.canonical(runs(t), EXPECTED).select("endpoint", "representation", "learner", "resample", "score", "n")


@query("cns_canonical", "canonical", "SELECT endpoint, representation, learner, resample, round(score,6) AS score, n, endpoint||'|'||representation||'|'||learner AS slot FROM canonical")
def cns_canonical(t):
    return canon(t).withColumn("slot", F.concat_ws("|", "endpoint", "representation", "learner"))


@query("cns_oof_extract", "canonical", """
SELECT o_orderpriority AS endpoint, CASE o_custkey%3 WHEN 0 THEN 'standard' WHEN 1 THEN 'kernel' ELSE 'stack' END AS representation, CASE WHEN o_orderkey%2=0 THEN 'linear' ELSE 'trees' END AS learner, CAST(month(o_orderdate) AS BIGINT) AS resample, o_orderkey, round(o_totalprice,6) AS pred
FROM orders JOIN canonical c ON c.endpoint=o_orderpriority AND c.representation=CASE o_custkey%3 WHEN 0 THEN 'standard' WHEN 1 THEN 'kernel' ELSE 'stack' END AND c.learner=CASE WHEN o_orderkey%2=0 THEN 'linear' ELSE 'trees' END AND c.resample=month(o_orderdate)""")
def cns_oof_extract(t):
    rep = F.when(F.col("o_custkey") % 3 == 0, "standard").when(F.col("o_custkey") % 3 == 1, "kernel").otherwise("stack")
    p = t.orders.select(F.col("o_orderpriority").alias("endpoint"), rep.alias("representation"), F.when(F.col("o_orderkey") % 2 == 0, "linear").otherwise("trees").alias("learner"),
                        F.month("o_orderdate").cast("long").alias("resample"), "o_orderkey", F.col("o_totalprice").alias("pred"))
    return panel.extract_predictions(canon(t), p, ["endpoint", "representation", "learner", "resample"], "o_orderkey")


@query("cns_plot_tables", "canonical results", f"""
WITH s AS (SELECT endpoint, representation, learner, avg(delta) AS mean, stddev_samp(delta)/sqrt(count(*)) AS se FROM (SELECT c.endpoint, c.representation, c.learner, c.score-s.score AS delta FROM results s JOIN results c USING (endpoint, learner, resample) WHERE s.representation='standard' AND c.representation<>'standard') GROUP BY ALL),
p AS (SELECT endpoint, representation, learner, mean AS delta, {_p2('mean/se')} AS p FROM s), q AS (SELECT *, least(1.0,min(p*m/rk) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM p))
SELECT c.endpoint, c.representation, c.learner, round(score,6) AS score, round(delta,6) AS delta, round(q,6) AS q_value, CASE WHEN q<0.001 THEN '***' WHEN q<0.01 THEN '**' WHEN q<0.05 THEN '*' WHEN q<0.1 THEN '.' ELSE '' END AS significance FROM canonical c LEFT JOIN q USING (endpoint, representation, learner)""")
def cns_plot_tables(t):
    tests = stats.normal_interval(deltas(t), ["endpoint", "representation", "learner"], "delta").select(
        "endpoint", "learner", F.col("representation").alias("candidate"), F.col("mean").alias("delta"), "p_value")
    return panel.plot_table(canon(t), tests).select("endpoint", "representation", "learner", "score", "delta", "q_value", "significance")


@query("cns_validate", "canonical", "SELECT endpoint, representation, learner FROM canonical WHERE false")
def cns_validate(t):
    keys = ["endpoint", "representation", "learner"]
    return panel.violations(canon(t), canon(t), keys, "score").select(*keys)


@query("aud_folds", "", "SELECT c_custkey, CAST(c_nationkey%5 AS BIGINT) AS lo, CAST(CASE WHEN c_custkey%10=0 THEN 9 ELSE c_nationkey%5 END AS BIGINT) AS hi, 1+CAST(c_custkey%15=0 AS BIGINT) AS copies FROM customer WHERE c_custkey%10=0 OR c_custkey%15=0")
def aud_folds(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey") % 5)
    base = t.customer.select("c_custkey", F.lit("standard").alias("representation"), (F.col("c_nationkey") % 5).alias("fold"))
    other = t.customer.select("c_custkey", F.lit("kernel").alias("representation"), F.when(F.col("c_custkey") % 10 == 0, 9).otherwise(F.col("c_nationkey") % 5).alias("fold"))
    return panel.fold_audit(base.unionByName(other).unionByName(base.filter("c_custkey % 15 = 0")), "c_custkey", "fold", "representation")


@query("aud_reproduce", "results", """
WITH c AS (SELECT endpoint, representation, avg(score) AS score FROM results WHERE learner='trees' GROUP BY ALL), p AS (SELECT endpoint, representation, avg(score) AS prior_score FROM results WHERE learner='linear' AND representation<>'stack' GROUP BY ALL)
SELECT endpoint, representation, round(score,6) AS score, round(prior_score,6) AS prior_score, round(score-prior_score,6) AS current_minus_prior FROM c LEFT JOIN p USING (endpoint, representation)""")
def aud_reproduce(t):
    mean = lambda cond: res.sample_results(t).filter(cond).groupBy("endpoint", "representation").agg(F.avg("score").alias("score"))
    return panel.reproduction(mean("learner = 'trees'"), mean("learner = 'linear' AND representation <> 'stack'"), ["endpoint", "representation"], "score")


_STACK = ORACLES["trf_candidate_stack"]
_CUT = _STACK.rindex("SELECT model_id, patient")
_WITH_STACK = "WITH " + _STACK[_STACK.index("b AS (SELECT 'gene'"):_CUT] + ", st AS (" + _STACK[_CUT:] + "), dm AS (SELECT model_id, count(DISTINCT feature) AS n_features, (SELECT count(*) FROM cohort) AS n_samples, count(*) AS nz FROM st GROUP BY model_id)"


def dims(t):
    return panel.feature_dims(trf_candidate_stack(t), t.cohort())


@query("aud_feature_dims", "maf cohort", _WITH_STACK + " SELECT model_id, n_features, n_samples, round(nz/CAST(n_features*n_samples AS DOUBLE),6) AS nonzero_fraction FROM dm")
def aud_feature_dims(t):
    return dims(t)


@query("aud_reconstruction", "maf cohort", _WITH_STACK + " SELECT model_id, n_features, CASE WHEN model_id LIKE 'id_plus%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reconstruction_r2, CASE WHEN model_id LIKE 'id_plus%' THEN 0 ELSE greatest(257-(n_features-3),0) END AS estimated_collisions, model_id LIKE 'id_plus%' AS preserves_identity FROM dm")
def aud_reconstruction(t):
    return panel.reconstruction(dims(t), ["id_plus_gene", "id_plus_all"], 257)
