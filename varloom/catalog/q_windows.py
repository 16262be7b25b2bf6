"""Best rows, ranks, caps and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog import q_joins  # noqa: F401  (the results view)
from varloom.catalog.registry import query
from varloom.evaluation import results as res
from varloom.functions import labels as lab
from varloom.operators import features as ft, kernels, windows as win
from varloom.sources.readers import first_per_key, last_per_key


@query("win_best_sample", "maf", """
SELECT patient, barcode, n, is_primary FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY is_primary DESC, n DESC, barcode) AS k FROM (SELECT patient, barcode, count(*) AS n, substr(barcode,14,2)='01' AS is_primary FROM maf GROUP BY ALL)) WHERE k=1""")
def win_best_sample(t):
    s = ft.n_by(t.maf_records(), "patient", "barcode").withColumn("is_primary", F.substring("barcode", 14, 2) == "01")
    return first_per_key(s, ["patient"], F.struct((~F.col("is_primary")).alias("x"), (-F.col("n")).alias("y"), "barcode"))


@query("win_best_row", "results", """
SELECT endpoint, representation, learner, resample, round(score,6) AS score, n FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, representation ORDER BY CASE learner WHEN 'trees' THEN 60 ELSE 55 END DESC, score DESC, resample) AS k FROM results) WHERE k=1""")
def win_best_row(t):
    r = res.sample_results(t).withColumn("priority", F.when(F.col("learner") == "trees", 60).otherwise(55))
    return res.best_rows(r, ["endpoint", "representation"], [("priority", "desc"), ("score", "desc"), ("resample", "asc")]).drop("priority")


@query("win_select_params", "results", """
SELECT learner, endpoint, CAST(landmarks AS BIGINT) AS landmarks, multiplier, score FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY score DESC, landmarks, abs(multiplier-1), multiplier, endpoint) AS k
FROM (SELECT learner, endpoint, resample*4 AS landmarks, CASE representation WHEN 'standard' THEN 0.5 WHEN 'kernel' THEN 1.0 ELSE 2.0 END::DOUBLE AS multiplier, round(score,1) AS score FROM results)) WHERE k=1""")
def win_select_params(t):
    m = F.when(F.col("representation") == "standard", 0.5).when(F.col("representation") == "kernel", 1.0).otherwise(2.0)
    r = res.sample_results(t).select("learner", "endpoint", (F.col("resample") * 4).alias("landmarks"), m.alias("multiplier"), F.round("score", 1).alias("score"))
    r = r.withColumn("off", F.abs(F.col("multiplier") - 1))
    order = [("score", "desc"), ("landmarks", "asc"), ("off", "asc"), ("multiplier", "asc"), ("endpoint", "asc")]
    return res.best_rows(r, ["learner"], order).drop("off")


@query("win_keep_last", "", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY ALL")
def win_keep_last(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("priority"))
    return last_per_key(o, ["o_custkey"], F.col("o_orderkey"))


@query("win_delta_vs_baseline", "results", """
SELECT endpoint, learner, resample, representation, round(score-max(score) FILTER (representation='standard') OVER (PARTITION BY endpoint, learner, resample),6) AS delta FROM results""")
def win_delta_vs_baseline(t):
    d = res.with_baseline(res.sample_results(t), ["endpoint", "learner", "resample"], "representation", "standard", "score")
    return d.select("endpoint", "learner", "resample", "representation", F.col("delta_vs_baseline").alias("delta"))


@query("win_rank_pct", "sample_counts", """
SELECT patient, channel, n, round((rank() OVER (PARTITION BY patient ORDER BY n) + (count(*) OVER (PARTITION BY patient, n)-1)/2.0)/count(*) OVER (PARTITION BY patient),6) AS rank_pct FROM sample_counts""")
def win_rank_pct(t):
    return win.rank_pct(t.sample_counts())


@query("win_retrieval_rank", "basis", """
WITH c AS (SELECT label, vec_id%2 AS side, list_transform(range(1, k+1), lambda i: s[i]/n) AS v FROM (SELECT label, side AS vs, max(n) AS n, max(k) AS k, list(s ORDER BY d) AS s, side AS vec_id FROM (
  SELECT label, vec_id%2 AS side, d, sum(x) AS s, count(*) AS n, max(k) AS k FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding,1) AS d, len(embedding) AS k FROM basis) GROUP BY ALL) GROUP BY label, side)),
d AS (SELECT a.label, b.label AS other, list_distance(a.v,b.v) AS dist FROM c a, c b WHERE a.side=0 AND b.side=1),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, other) AS rk FROM d)
SELECT CAST(label AS BIGINT) AS process, CAST(max(rk) FILTER (label=other) AS BIGINT) AS true_rank, CAST(max(other) FILTER (rk=1) AS BIGINT) AS nearest, round(1.0/max(rk) FILTER (label=other),6) AS reciprocal, round(max(dist) FILTER (label=other),6) AS true_distance FROM r GROUP BY label HAVING max(rk) FILTER (label=other) IS NOT NULL""")
def win_retrieval_rank(t):
    b = t.basis().select(F.col("label").alias("process"), (F.col("vec_id") % 2).alias("side"), "embedding", F.lit(1.0).alias("one"))
    mean = ft.weighted_mean(b, ["process", "side"], "embedding", "one")
    cents = mean.groupBy("process", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("v"))
    return kernels.retrieval_ranks(cents.filter("side = 0").drop("side"), cents.filter("side = 1").drop("side"), "process", "v")


@query("win_event_cap", "maf", """
SELECT event_id, patient, pos, gene, variant_type FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY sha256('cap|'||event_id||'|'||patient||'|'||pos||'|'||gene||'|'||variant_type)) AS k FROM maf) WHERE k<=40""")
def win_event_cap(t):
    cols = ["event_id", "patient", "pos", "gene", "variant_type"]
    return win.event_cap(t.maf_records().select(cols), "patient", cols, 40, "cap")


@query("top_variance", "maf cohort", """
SELECT gene AS feature, round(variance,6) AS variance FROM (SELECT gene, (sum(n*n)-sum(n)*sum(n)/CAST(k AS DOUBLE))/(k-1) AS variance FROM (SELECT patient, gene, count(*) AS n FROM maf GROUP BY ALL), (SELECT count(*) AS k FROM cohort) GROUP BY gene, k) ORDER BY round(variance,9) DESC, gene LIMIT 64""")
def top_variance(t):
    n = ft.n_by(t.maf_records(), "patient", F.col("gene").alias("feature"))
    return ft.top_variance(n, t.cohort().agg(F.count(F.lit(1)).alias("N")), 64)


@query("top_channels", "maf", """
SELECT gene AS channel, round(imp*(1-least(greatest(r2,0),1)),6) AS score FROM (SELECT gene, avg(t_alt_count)/10 AS imp, avg(t_depth)/40-0.3 AS r2 FROM maf GROUP BY ALL) ORDER BY round(imp*(1-least(greatest(r2,0),1)),9) DESC, gene LIMIT 20""")
def top_channels(t):
    d = t.maf_records().groupBy(F.col("gene").alias("channel")).agg((F.avg("t_alt_count") / 10).alias("imp"), (F.avg("t_depth") / 40 - 0.3).alias("r2"))
    score = res.missing_signal(F.col("imp"), F.col("r2"))
    return d.select("channel", score.alias("score")).orderBy(F.round("score", 9).desc(), "channel").limit(20)


@query("top_candidates", "results", """
SELECT representation, resample, round(mean_delta,6) AS mean_delta FROM (SELECT c.representation, c.resample, avg(c.score-b.score) AS mean_delta, min(c.score-b.score) AS lo FROM results c JOIN results b USING (endpoint, learner, resample) WHERE b.representation='standard' AND c.representation<>'standard' GROUP BY 1,2)
WHERE lo>=-0.05 ORDER BY round(mean_delta,9) DESC, representation, resample LIMIT 3""")
def top_candidates(t):
    d = res.with_baseline(res.sample_results(t), ["endpoint", "learner", "resample"], "representation", "standard", "score")
    s = d.filter("representation <> 'standard' AND delta_vs_baseline IS NOT NULL").groupBy("representation", "resample").agg(
        F.avg("delta_vs_baseline").alias("mean_delta"), F.min("delta_vs_baseline").alias("lo"))
    return s.filter("lo >= -0.05").orderBy(F.round("mean_delta", 9).desc(), "representation", "resample").limit(3).drop("lo")
