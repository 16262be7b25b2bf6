"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.registry import query
from varloom.evaluation import results as res
from varloom.operators import encode, joins
from varloom.operators.density import attach_density
from varloom.sources.readers import first_per_key, union_results
from varloom.sources.tables import ALLELE


@query("join_cohort_left", "maf", """
WITH b AS (SELECT CAST(substr(patient,6) AS BIGINT) AS k, count(*) AS total FROM maf GROUP BY ALL)
SELECT c_custkey, c_acctbal, total, CASE WHEN c_acctbal>=4200 THEN 'high' ELSE 'low' END AS label, n_name AS region_name
FROM customer LEFT JOIN b ON c_custkey=k  LEFT JOIN nation ON c_nationkey=n_nationkey""")
def join_cohort_left(t):
    people = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    burden = t.maf_records().groupBy(F.substring("patient", 6, 7).cast("long").alias("c_custkey")).agg(F.count(F.lit(1)).alias("total"))
    label = people.select("c_custkey", F.when(F.col("c_acctbal") >= 4200, "high").otherwise("low").alias("label"))
    clinical = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region_name"))
    joined = people.join(burden, "c_custkey", "left").join(label, "c_custkey", "left").join(clinical, "c_nationkey", "left")
    return first_per_key(joined.drop("c_nationkey"), ["c_custkey"], F.col("c_acctbal"))


@query("join_oof_inner", "preds", "SELECT doc_id, CAST(y AS BIGINT) AS y, round(a,6) AS candidate, round(b,6) AS baseline FROM preds WHERE lang<>'fr' AND source<>'src3'")
def join_oof_inner(t):
    p = t.preds()
    a = p.filter("lang <> 'fr'").select("doc_id", "y", F.col("a").alias("score"))
    b = p.filter("source <> 'src3'").select("doc_id", "y", F.col("b").alias("score"))
    return joins.paired_predictions(a, b, ["doc_id"])


@query("join_index_align", "maf cohort", "SELECT m.patient, n, y_cont FROM (SELECT patient, count(*) AS n FROM maf GROUP BY ALL) m JOIN cohort USING (patient)")
def join_index_align(t):
    n = t.maf_records().groupBy("patient").agg(F.count(F.lit(1)).alias("n"))
    return n.join(t.cohort().select("patient", "y_cont"), "patient")


@query("join_patient_semi", "maf cohort", "SELECT event_id, patient FROM maf WHERE patient IN (SELECT patient FROM cohort WHERE y_bin=1)")
def join_patient_semi(t):
    return joins.members_only(t.maf_records().select("event_id", "patient"), joins.hinted(t.cohort().filter("y_bin = 1")), "patient")


@query("join_spine_left", "maf cohort", """
SELECT c.patient, count(m.patient) FILTER (impact='HIGH') AS high, count(m.patient) FILTER (impact='LOW') AS low FROM cohort c LEFT JOIN maf m ON m.patient=c.patient GROUP BY ALL""")
def join_spine_left(t):
    f = t.maf_records().groupBy("patient").pivot("impact", ["HIGH", "LOW"]).count().withColumnsRenamed({"HIGH": "high", "LOW": "low"})
    return joins.on_spine(t.cohort(), f, "patient")


@query("join_pathway", "maf sets", "SELECT patient, gene_set, impact, count(*) AS n FROM maf JOIN sets USING (gene) GROUP BY ALL")
def join_pathway(t):
    return joins.expand_sets(t.maf_records(), joins.hinted(t.sets())).groupBy("patient", "gene_set", "impact").agg(F.count(F.lit(1)).alias("n"))


@query("join_context", "flanked", "SELECT event_id, lf AS left_flank, rf AS right_flank, ref_ok FROM flanked")
def join_context(t):
    ev = encode.attach_flanks(encode.classify(t.events_maf()), t.reference(), 12, longest=ALLELE)
    return ev.select("event_id", F.col("left").alias("left_flank"), F.col("right").alias("right_flank"), "ref_ok")


@query("join_density", "maf", "SELECT event_id, patient, chromosome, pos, count(*) OVER (PARTITION BY patient, chromosome, pos//8) AS density FROM maf")
def join_density(t):
    ev = t.maf_records().withColumn("bin", F.floor(F.col("pos") / 8))
    return attach_density(ev, ["patient", "chromosome", "bin"], "density").select("event_id", "patient", "chromosome", "pos", "density")


RESULTS_SQL = """
SELECT o_orderpriority AS endpoint, CASE o_custkey%3 WHEN 0 THEN 'standard' WHEN 1 THEN 'kernel' ELSE 'stack' END AS representation,
 CASE WHEN o_orderkey%2=0 THEN 'linear' ELSE 'trees' END AS learner, CAST(month(o_orderdate) AS BIGINT) AS resample, avg(o_totalprice)/1000000 AS score, count(*) AS n
FROM orders GROUP BY ALL"""
from varloom.catalog.oracle_views import view  # noqa: E402

view("results", "", RESULTS_SQL)


@query("join_resample_pair", "results", """
SELECT s.endpoint, s.learner, s.resample, c.representation, round(s.score,6) AS score_standard, round(c.score,6) AS score_candidate, round(c.score-s.score,6) AS delta
FROM results s JOIN results c USING (endpoint, learner, resample) WHERE s.representation='standard' AND c.representation<>'standard'""")
def join_resample_pair(t):
    r = res.sample_results(t)
    return res.paired_resamples(r, ["endpoint", "learner", "resample"], "representation", "standard", "score")


@query("join_wide_learners", "results", """
WITH m AS (SELECT endpoint, representation, avg(score) FILTER (learner='linear') AS l, avg(score) FILTER (learner='trees') AS x FROM results GROUP BY ALL),
d AS (SELECT a.endpoint, a.representation, a.l-b.l AS dl, a.x-b.x AS dx FROM m a JOIN m b USING (endpoint) WHERE b.representation='standard' AND a.representation<>'standard')
SELECT endpoint, representation, round(dl,6) AS delta_linear, round(dx,6) AS delta_trees,
 (CASE WHEN dl>0.0001 THEN 1 WHEN dl<-0.0001 THEN -1 ELSE 0 END)=(CASE WHEN dx>0.0001 THEN 1 WHEN dx<-0.0001 THEN -1 ELSE 0 END) AS agree FROM d""")
def join_wide_learners(t):
    return res.learner_agreement(res.sample_results(t), tolerance=1e-4)


@query("join_metadata_left", "results", """
SELECT r.representation, round(avg(score),6) AS mean_score, dim FROM results r LEFT JOIN (SELECT 'standard' AS representation, count(*) AS dim FROM nation UNION ALL SELECT 'kernel', count(*) FROM region) m ON m.representation=r.representation GROUP BY ALL""")
def join_metadata_left(t):
    meta = t.nation.agg(F.count(F.lit(1)).alias("dim")).withColumn("representation", F.lit("standard")).unionByName(
        t.region.agg(F.count(F.lit(1)).alias("dim")).withColumn("representation", F.lit("kernel"))
    )
    return res.sample_results(t).groupBy("representation").agg(F.avg("score").alias("mean_score")).join(meta, "representation", "left")


@query("join_anti_missing", "results", """
SELECT * FROM (SELECT DISTINCT endpoint FROM results), (SELECT DISTINCT representation FROM results), (SELECT unnest(range(1,15)) AS resample)
EXCEPT SELECT endpoint, representation, resample FROM results WHERE learner='linear' AND n>40""")
def join_anti_missing(t):
    r = res.sample_results(t)
    months = t.region.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(14).cast("long"))).alias("resample"))
    expected = joins.grid(r.select("endpoint"), r.select("representation"), months)
    return joins.missing_slots(expected, r.filter("learner = 'linear' AND n > 40"), ["endpoint", "representation", "resample"])


@query("join_overlap_audit", "", """
SELECT a AS in_customers, b AS in_orders, c AS in_labels, count(*) AS keys FROM (SELECT k, max(CAST(s='a' AS BIGINT)) AS a, max(CAST(s='b' AS BIGINT)) AS b, max(CAST(s='c' AS BIGINT)) AS c FROM (
 SELECT DISTINCT c_custkey AS k, 'a' AS s FROM customer UNION ALL SELECT DISTINCT o_custkey, 'b' FROM orders UNION ALL SELECT DISTINCT doc_id, 'c' FROM labels) GROUP BY k) GROUP BY ALL""")
def join_overlap_audit(t):
    return joins.overlap_sizes(
        {
            "in_customers": t.customer.select(F.col("c_custkey").alias("k")),
            "in_orders": t.orders.select(F.col("o_custkey").alias("k")),
            "in_labels": t.labels.select(F.col("doc_id").alias("k")),
        },
        "k",
    )


@query("join_label_truth_check", "results", """
SELECT learner, round(max(score),6) AS selected_score, round(max(score),6) AS best_score, true AS matches FROM results WHERE representation='kernel' GROUP BY ALL""")
def join_label_truth_check(t):
    kernel = res.sample_results(t).filter("representation = 'kernel'")
    chosen = res.best_rows(kernel, ["learner"], [("score", "desc"), ("endpoint", "asc"), ("resample", "asc")]).select("learner", F.col("score").alias("selected_score"))
    best = kernel.groupBy("learner").agg(F.max("score").alias("best_score"))
    return chosen.join(best, "learner").withColumn("matches", F.abs(F.col("selected_score") - F.col("best_score")) <= 1e-12)


@query("set_union_tagged", "", "SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance, NULL AS priority FROM customer UNION ALL SELECT 'orders', o_orderkey, NULL, o_orderpriority FROM orders")
def set_union_tagged(t):
    return union_results(
        {
            "customer": t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")),
            "orders": t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority")),
        }
    )


@query("set_intersect_keys", "", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT doc_id FROM labels")
def set_intersect_keys(t):
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey")).intersect(t.labels.select("doc_id"))


@query("set_except_slots", "maf sets", "SELECT patient, gene_set FROM (SELECT DISTINCT patient FROM maf), (SELECT DISTINCT gene_set FROM sets) EXCEPT SELECT patient, gene_set FROM maf JOIN sets USING (gene) WHERE impact='HIGH' AND pos<60")
def set_except_slots(t):
    ev = t.maf_records()
    slots = ev.select("patient").distinct().select("patient", F.explode(F.array(*[F.lit(f"S{i}") for i in range(6)])).alias("gene_set"))
    seen = joins.expand_sets(ev.filter("impact = 'HIGH' AND pos < 60"), joins.hinted(t.sets())).select("patient", "gene_set")
    return slots.subtract(seen)


@query("set_distinct", "maf", "SELECT chromosome, variant_type, count(*) AS n FROM maf GROUP BY ALL")
def set_distinct(t):
    return t.maf_records().groupBy("chromosome", "variant_type").agg(F.count(F.lit(1)).alias("n"))


@query("set_completion_grid", "results", """
WITH b AS (SELECT endpoint, representation, learner, max(score) AS primary_score FROM results GROUP BY ALL)
SELECT e.endpoint, l.learner, r.representation, round(primary_score,6) AS primary_score, CASE WHEN primary_score IS NULL THEN 'not_applicable' ELSE 'measured' END AS status
FROM (SELECT DISTINCT endpoint FROM results) e CROSS JOIN (SELECT DISTINCT learner FROM results) l CROSS JOIN (SELECT DISTINCT representation FROM results UNION ALL SELECT 'burden_only') r
LEFT JOIN b ON b.endpoint=e.endpoint AND b.learner=l.learner AND b.representation=r.representation""")
def set_completion_grid(t):
    r = res.sample_results(t)
    best = r.groupBy("endpoint", "representation", "learner").agg(F.max("score").alias("primary_score"))
    reps = r.select("representation").unionByName(t.region.select(F.lit("burden_only").alias("representation")))
    full = joins.grid(r.select("endpoint"), r.select("learner"), reps)
    return full.join(best, ["endpoint", "learner", "representation"], "left").withColumn(
        "status", F.when(F.col("primary_score").isNull(), "not_applicable").otherwise("measured")
    )
