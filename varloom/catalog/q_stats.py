"""Metrics and statistical comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varloom.catalog import q_joins  # noqa: F401  (the results view)
from varloom.catalog.oracle_views import view
from varloom.catalog.registry import query
from varloom.evaluation import metrics as met, models, results as res, stats
from varloom.operators import features as ft


def _rank_sql(value: str, part: str) -> str:
    part = f"PARTITION BY {part}" if part else ""
    both = f"PARTITION BY {part[13:]}, {value}" if part else f"PARTITION BY {value}"
    return f"(rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({both})-1)/2.0)"


def _auc(y: str, s: str) -> str:
    return f"(sum(rk) FILTER ({y}=1)-count(*) FILTER ({y}=1)*(count(*) FILTER ({y}=1)+1)/2.0)/(count(*) FILTER ({y}=1)*count(*) FILTER ({y}=0))"


@query("met_auroc", "preds", f"""
SELECT lang, 'binary' AS kind, round({_auc('y', 'a')},6) AS auroc FROM (SELECT lang, y, {_rank_sql('a', 'lang')} AS rk FROM preds) GROUP BY lang HAVING count(DISTINCT y)=2
UNION ALL SELECT 'all', 'macro', round(avg(s),6) FROM (SELECT cls, {_auc('isc', 'p')} AS s FROM (SELECT cls, CAST(source=cls AS INT) AS isc, {_rank_sql('p', 'cls')} AS rk FROM (SELECT p.source, c.cls, ((doc_id*k)%97)/96.0::DOUBLE AS p FROM preds p, (SELECT source AS cls, row_number() OVER (ORDER BY source)+10 AS k FROM (SELECT DISTINCT source FROM preds)) c)) GROUP BY cls)""")
def met_auroc(t):
    p = t.preds()
    one = met.auroc(p, ["lang"], "y", "a").filter("auroc IS NOT NULL").select("lang", F.lit("binary").alias("kind"), "auroc")
    classes = p.select(F.col("source").alias("class")).distinct()
    k = classes.select("class", (F.row_number().over(Window.orderBy("class")) + 10).alias("k"))  # one row a class
    proba = p.select("doc_id", F.col("source").alias("y")).crossJoin(k)
    proba = proba.select("y", "class", (((F.col("doc_id") * F.col("k")) % 97) / 96.0).alias("p"), F.lit("all").alias("lang"))
    macro = met.macro_auroc(proba, ["lang"]).select("lang", F.lit("macro").alias("kind"), F.col("macro_auroc").alias("auroc"))
    return one.unionByName(macro)


@query("met_auprc", "preds", """
SELECT lang, round(sum(np*tp/CAST(nn AS DOUBLE))/max(pall),6) AS auprc FROM (SELECT lang, np, sum(np) OVER (PARTITION BY lang ORDER BY a DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY a DESC) AS nn, sum(np) OVER (PARTITION BY lang) AS pall
 FROM (SELECT lang, a, sum(y) AS np, count(*) AS n FROM preds GROUP BY ALL)) GROUP BY lang""")
def met_auprc(t):
    return met.auprc(t.preds(), ["lang"], "y", "a")


@query("met_spearman", "preds", f"SELECT lang, round(corr(ra,rb),6) AS spearman FROM (SELECT lang, {_rank_sql('a', 'lang')} AS ra, {_rank_sql('b', 'lang')} AS rb FROM preds) GROUP BY lang")
def met_spearman(t):
    return met.spearman(t.preds(), ["lang"], "a", "b")


@query("met_regression", "preds", "SELECT source, round(corr(a,b),6) AS pearson, round(1-sum((a-b)*(a-b))/(var_pop(a)*count(*)),6) AS r2, round(avg(abs(a-b)),6) AS mae, count(*) AS n_test FROM preds GROUP BY source")
def met_regression(t):
    return met.regression(t.preds(), ["source"], "a", "b")


_CLS = """SELECT {g}, round(max(acc),6) AS accuracy, round(max(brier),6) AS brier, round(avg(CASE WHEN tt>0 THEN h/CAST(tt AS DOUBLE) END),6) AS balanced_accuracy, round(avg(2.0*h/(tt+q)),6) AS macro_f1 FROM (
 SELECT {g}, cls, sum(tt) AS tt, sum(q) AS q, sum(h) AS h FROM (SELECT {g}, y AS cls, 1 AS tt, 0 AS q, CAST(y=pred AS INT) AS h FROM pr UNION ALL SELECT {g}, pred, 0, 1, 0 FROM pr) GROUP BY ALL) JOIN (SELECT {g}, avg(CAST(y=pred AS INT)) AS acc, avg((a-y)*(a-y)) AS brier FROM pr GROUP BY {g}) USING ({g}) GROUP BY {g}"""


@query("met_classification", "preds", "WITH pr AS (SELECT *, CAST(a>=0.5 AS INT) AS pred FROM preds) " + _CLS.format(g="lang"))
def met_classification(t):
    return met.classification(t.preds().withColumn("pred", (F.col("a") >= 0.5).cast("int")), ["lang"], "y", "pred", "a")


@query("met_fold", "preds", "WITH pr AS (SELECT *, CAST(a>=0.5 AS INT) AS pred, CAST(doc_id%5+1 AS BIGINT) AS fold FROM preds) " + f"SELECT fold, n_test, round(auc,6) AS auroc, accuracy FROM (SELECT fold, count(*) AS n_test, {_auc('y', 'a')} AS auc, round(avg(CAST(y=pred AS INT)),6) AS accuracy FROM (SELECT *, {_rank_sql('a', 'fold')} AS rk FROM pr) GROUP BY fold)")
def met_fold(t):
    p = t.preds().withColumns({"fold": F.col("doc_id") % 5 + 1, "pred": (F.col("a") >= 0.5).cast("int")})
    n = p.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    c = met.classification(p, ["fold"], "y", "pred").select("fold", "accuracy")
    return n.join(met.auroc(p, ["fold"], "y", "a"), "fold").join(c, "fold")


@query("met_calibration", "preds", """
SELECT 'binary' AS mode, CAST(least(floor(a*10),9) AS BIGINT)+1 AS bin, round(avg(a),6) AS mean_predicted, round(avg(y),6) AS observed_frequency, count(*) AS n_samples FROM preds GROUP BY 2
UNION ALL SELECT 'confidence', CAST(least(floor(greatest(a,1-a)*10),9) AS BIGINT)+1, round(avg(greatest(a,1-a)),6), round(avg(CAST((a>=0.5)=(y=1) AS INT)),6), count(*) FROM preds GROUP BY 2""")
def met_calibration(t):
    p = t.preds()
    one = met.calibration(p, [], "a", "y").withColumn("mode", F.lit("binary"))
    conf = p.select(F.greatest("a", 1 - F.col("a")).alias("c"), ((F.col("a") >= 0.5) == (F.col("y") == 1)).cast("int").alias("ok"))
    return one.unionByName(met.calibration(conf, [], "c", "ok").withColumn("mode", F.lit("confidence")))


@query("met_recoverability")
def met_recoverability(t):
    n = ft.n_by(t.maf_records(), "patient", F.col("impact").alias("feature"))
    channels = ft.shares(ft.n_by(t.maf_records(), "patient", F.col("variant_type").alias("feature"))).select("patient", "feature", "p")
    return models.recoverability(models.dense(n, "patient"), models.dense(channels.withColumnRenamed("p", "n"), "patient"), "patient", folds=3, alpha=10.0)


_IMP = """WITH f AS (SELECT o_custkey AS sample, o_orderpriority AS feature, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL), l AS (SELECT 'segment' AS endpoint, c_custkey AS sample, c_mktsegment AS y FROM customer UNION ALL SELECT 'nation', c_custkey, CAST(c_nationkey%3 AS VARCHAR) FROM customer),
b AS (SELECT sample, feature, CASE WHEN hi>lo THEN least(floor((value-lo)/(hi-lo)*10),9) ELSE 0 END AS b FROM f JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM f GROUP BY feature) USING (feature)),
j AS (SELECT endpoint, feature, b, y, count(*) AS n FROM b JOIN l USING (sample) GROUP BY ALL),
m AS (SELECT endpoint, feature, sum(n/tt*ln(n*tt/(nb*ny))) AS mi FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY endpoint, feature) AS DOUBLE) AS tt, CAST(sum(n) OVER (PARTITION BY endpoint, feature, b) AS DOUBLE) AS nb, CAST(sum(n) OVER (PARTITION BY endpoint, feature, y) AS DOUBLE) AS ny FROM j) GROUP BY ALL),
i AS (SELECT feature, avg(CASE WHEN mx>1e-12 THEN greatest(mi,0)/mx ELSE 0 END) AS importance FROM (SELECT *, max(mi) OVER (PARTITION BY endpoint) AS mx FROM m) GROUP BY feature)"""


def importance(t):
    f = ft.n_by(t.orders, F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("feature")).withColumn("value", F.col("n").cast("double"))
    c = t.customer
    l = c.select(F.lit("segment").alias("endpoint"), F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("y")).unionByName(
        c.select(F.lit("nation").alias("endpoint"), F.col("c_custkey").alias("sample"), (F.col("c_nationkey") % 3).cast("string").alias("y")))
    return met.mutual_information(f.select("sample", "feature", "value"), l)


@query("met_importance", "", _IMP + " SELECT feature, round(importance,6) AS importance FROM i")
def met_importance(t):
    return importance(t)


@query("met_missing_signal", "", _IMP + " SELECT CASE WHEN feature<'3' THEN 'urgent' ELSE 'normal' END AS signal_class, count(*) AS n_channels, round(avg(importance),6) AS mean_importance, round(avg(importance*(1-length(feature)/20.0)),6) AS mean_missing, round(max(importance*(1-length(feature)/20.0)),6) AS max_missing FROM i GROUP BY 1")
def met_missing_signal(t):
    d = importance(t).withColumn("missing", res.missing_signal(F.col("importance"), F.length("feature") / F.lit(20.0)))
    return d.groupBy(F.when(F.col("feature") < "3", "urgent").otherwise("normal").alias("signal_class")).agg(
        F.count(F.lit(1)).alias("n_channels"), F.avg("importance").alias("mean_importance"), F.avg("missing").alias("mean_missing"), F.max("missing").alias("max_missing"))


def _erfc(x: str) -> str:
    poly = repr(stats.ERFC[-1])
    for c in reversed(stats.ERFC[:-1]):
        poly = f"({c!r}::DOUBLE+(1/(1+0.5::DOUBLE*{x}))*{poly}::DOUBLE)"
    return f"((1/(1+0.5::DOUBLE*{x}))*exp(-{x}*{x}+{poly}))"


def _p2(z: str) -> str:
    return f"(SELECT {_erfc('x')} FROM (SELECT abs({z})/sqrt(2.0::DOUBLE) AS x))"


@query("st_delong", "preds", f"""
WITH v AS (SELECT lang, y, (SELECT count(*) FILTER (q.a<p.a)+0.5*count(*) FILTER (q.a=p.a) FROM preds q WHERE q.lang=p.lang AND q.y<>p.y) AS ca, (SELECT count(*) FILTER (q.b<p.b)+0.5*count(*) FILTER (q.b=p.b) FROM preds q WHERE q.lang=p.lang AND q.y<>p.y) AS cb, (SELECT count(*) FROM preds q WHERE q.lang=p.lang AND q.y<>p.y) AS m FROM preds p),
s AS (SELECT lang, avg(ca/m) FILTER (y=1) AS auc_a, avg(cb/m) FILTER (y=1) AS auc_b, var_samp((ca-cb)/m) FILTER (y=1)/count(*) FILTER (y=1)+var_samp((ca-cb)/m) FILTER (y=0)/count(*) FILTER (y=0) AS var FROM v WHERE m>0 GROUP BY lang)
SELECT lang, round(auc_a,6) AS auc_a, round(auc_b,6) AS auc_b, round(auc_a-auc_b,6) AS delta, round(CASE WHEN coalesce(var,0)<=1e-18 THEN 1.0 ELSE {_p2('(auc_a-auc_b)/sqrt(var)')} END,6) AS p_value FROM s""")
def st_delong(t):
    return stats.delong(t.preds(), ["lang"], "y", "a", "b").filter("auc_a IS NOT NULL")


#: Bootstrap replicates (fixed value).
REPLICATES = 500


def _boot_sql(seed: str) -> str:
    word = lambda i: f"CAST('0x'||substr(h,{7 * i + 1},7) AS BIGINT)"
    v = f"(({word(0)}+r*{word(1)}+r*r*{word(2)}+r*r*r*{word(3)})%{stats.MODULUS})"
    times = f"len(list_filter([{','.join(map(str, stats.POISSON))}], lambda c: c<=v))"
    auc = lambda c: f"""(SELECT r, sum(wp*(bn+wn/2.0))/nullif(sum(wp)*sum(wn),0) AS auc FROM (SELECT r, wp, wn, coalesce(sum(wn) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bn
 FROM (SELECT r, {c} AS s, coalesce(sum(mult) FILTER (y=1),0) AS wp, coalesce(sum(mult) FILTER (y=0),0) AS wn FROM m GROUP BY r, {c})) GROUP BY r)"""
    return f"""v AS (SELECT y, a, b, r, {v} AS v FROM (SELECT *, sha256('{seed}|'||doc_id) AS h FROM preds), (SELECT unnest(range(1,{REPLICATES + 1})) AS r)),
m AS (SELECT y, a, b, r, {times} AS mult FROM v), dl AS (SELECT x.auc-z.auc AS delta FROM {auc('a')} x JOIN {auc('b')} z USING (r))"""


@query("st_bootstrap", "preds", f"WITH {_boot_sql('boot')} SELECT round(least(1.0,2.0*least((count(*) FILTER (delta<=0)+1.0)/(count(*)+1.0),(count(*) FILTER (delta>=0)+1.0)/(count(*)+1.0))),6) AS p_value, count(*) AS n_resamples, round(quantile_cont(delta,0.025),6) AS ci_low, round(quantile_cont(delta,0.975),6) AS ci_high FROM dl WHERE delta IS NOT NULL")
def st_bootstrap(t):
    d = stats.replicate_deltas(t.preds(), "y", "a", "b", "doc_id", replicates=REPLICATES, seed="boot")
    return stats.delta_summary(d, [], "delta", smoothed=True)


@query("st_bootstrap_unsmoothed", "preds", f"WITH {_boot_sql('plain')} SELECT round(least(1.0,2.0*least(count(*) FILTER (delta<=0)/CAST(count(*) AS DOUBLE),count(*) FILTER (delta>=0)/CAST(count(*) AS DOUBLE))),6) AS p_value, count(*) AS n_resamples, round(quantile_cont(delta,0.025),6) AS ci_low, round(quantile_cont(delta,0.975),6) AS ci_high FROM dl WHERE delta IS NOT NULL")
def st_bootstrap_unsmoothed(t):
    d = stats.replicate_deltas(t.preds(), "y", "a", "b", "doc_id", replicates=REPLICATES, seed="plain")
    return stats.delta_summary(d, [], "delta", smoothed=False)


view("deltas", "results", "SELECT c.endpoint, c.representation, c.learner, c.resample, c.score-s.score AS delta FROM results s JOIN results c USING (endpoint, learner, resample) WHERE s.representation='standard' AND c.representation<>'standard'")


def deltas(t):
    return res.paired_resamples(res.sample_results(t), ["endpoint", "learner", "resample"], "representation", "standard", "score").select("endpoint", "representation", "learner", "resample", "delta")


@query("st_delta_ci_p", "deltas", "SELECT endpoint, representation, round(least(1.0,2.0*least((count(*) FILTER (delta<=0)+1.0)/(count(*)+1.0),(count(*) FILTER (delta>=0)+1.0)/(count(*)+1.0))),6) AS p_value, count(*) AS n_resamples, round(quantile_cont(delta,0.025),6) AS ci_low, round(quantile_cont(delta,0.975),6) AS ci_high FROM deltas GROUP BY ALL")
def st_delta_ci_p(t):
    return stats.delta_summary(deltas(t), ["endpoint", "representation"], "delta", smoothed=True)


@query("st_wilcoxon", "preds", f"""
WITH r AS (SELECT lang, d, {_rank_sql('abs(d)', 'lang')} AS rk, count(*) OVER (PARTITION BY lang, abs(d)) AS tt FROM (SELECT lang, round(a,2)-round(b,2) AS d0, CAST(round((a-b)*20) AS BIGINT) AS d FROM preds) WHERE d<>0),
s AS (SELECT lang, least(sum(rk) FILTER (d>0),sum(rk) FILTER (d<0)) AS st, count(*) AS m, sum(tt*tt-1) AS ties FROM r GROUP BY lang), z AS (SELECT *, (st-m*(m+1)/4.0)/sqrt(m*(m+1)*(2*m+1)/24.0-ties/48.0) AS z FROM s)
SELECT lang, round(CAST(st AS DOUBLE),6) AS statistic, m AS n, round(z,6) AS z, round({_p2('z')},6) AS p_value FROM z""")
def st_wilcoxon(t):
    return stats.wilcoxon(t.preds().withColumn("d", F.round((F.col("a") - F.col("b")) * 20).cast("long")), ["lang"], "d")


@query("st_friedman", "", """
WITH s AS (SELECT o_custkey AS block, CAST(month(o_orderdate)%3 AS BIGINT) AS model, count(*) AS v FROM orders GROUP BY ALL), f AS (SELECT *, count(*) OVER (PARTITION BY block) AS k FROM s),
r AS (SELECT model, rank() OVER (PARTITION BY block ORDER BY v)+(count(*) OVER (PARTITION BY block, v)-1)/2.0 AS rk, count(*) OVER (PARTITION BY block, v) AS tt FROM f WHERE k=3),
b AS (SELECT sum(rk) AS r, sum(tt*tt-1) AS ties, count(*) AS n FROM r GROUP BY model), c AS (SELECT max(n) AS n, (12.0*sum(r*r)/(max(n)*12)-3.0*max(n)*4)/(1.0-sum(ties)/(max(n)*3*8.0)) AS chi FROM b)
SELECT n AS n_blocks, round(chi,6) AS statistic, round(exp(-chi/2),6) AS p_value FROM c""")
def st_friedman(t):
    s = ft.n_by(t.orders, F.col("o_custkey").alias("block"), (F.month("o_orderdate") % 3).alias("model"))
    return stats.friedman(s, "block", "model", "n", 3)


@query("st_steiger", "preds", f"""
WITH r AS (SELECT lang, {_rank_sql('y', 'lang')} AS ry, {_rank_sql('a', 'lang')} AS ra, {_rank_sql('b', 'lang')} AS rb FROM preds), c AS (SELECT lang, corr(ry,ra) AS r12, corr(ry,rb) AS r13, corr(ra,rb) AS r23, count(*) AS n FROM r GROUP BY lang),
q AS (SELECT *, (r23*(1-r12*r12-r13*r13)+0.5*r12*r13*(r12*r12+r13*r13+r23*r23-1))/((1-r12*r12)*(1-r13*r13)) AS rho FROM c), z AS (SELECT *, (0.5*ln((1+r13)/(1-r13))-0.5*ln((1+r12)/(1-r12)))/sqrt(greatest((2-2*rho)/greatest(n-3,1),1e-12)) AS z FROM q)
SELECT lang, round(r12,6) AS r12, round(r13,6) AS r13, round(z,6) AS z, round({_p2('z')},6) AS p_value FROM z""")
def st_steiger(t):
    return stats.steiger(t.preds(), ["lang"], "y", "a", "b")


@query("st_normal_ci", "deltas", f"""
WITH s AS (SELECT endpoint, representation, learner, avg(delta) AS mean, stddev_samp(delta)/sqrt(count(*)) AS se, count(*) AS n FROM deltas GROUP BY ALL)
SELECT endpoint, representation, learner, round(mean,6) AS mean, round(mean-1.96*se,6) AS ci_low, round(mean+1.96*se,6) AS ci_high, round(CASE WHEN n<=1 THEN NULL WHEN se<=1e-15 THEN CASE WHEN abs(mean)>1e-15 THEN 0.0 ELSE 1.0 END ELSE {_p2('mean/se')} END,6) AS p_value, n FROM s""")
def st_normal_ci(t):
    return stats.normal_interval(deltas(t), ["endpoint", "representation", "learner"], "delta")


def ptests(t):
    o = t.orders
    p = F.when(F.col("o_orderkey") % 17 != 0, F.pmod(F.col("o_orderkey") * 7919, F.lit(997)) / 997.0 * F.pmod(F.col("o_custkey"), F.lit(13)) / 13.0)
    return o.select("o_orderkey", F.col("o_orderpriority").alias("family"), p.alias("p_value"))


view("ptests", "", "SELECT o_orderkey, o_orderpriority AS family, CASE WHEN o_orderkey%17<>0 THEN ((o_orderkey*7919)%997)/997.0::DOUBLE*(o_custkey%13)/13.0::DOUBLE END AS p_value FROM orders")


def _bh_sql(part: str) -> str:
    w = f"PARTITION BY {part}" if part else ""
    return f"least(1.0, min(p_value*m/rk) OVER ({w} ORDER BY p_value DESC))"


view("bh_family", "ptests", """SELECT o_orderkey, family, p_value, least(1.0, min(p_value*m/rk) OVER (PARTITION BY family ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (
 SELECT *, count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM ptests WHERE p_value IS NOT NULL)""")


@query("st_bh", "ptests bh_family", """
WITH g AS (SELECT o_orderkey, least(1.0, min(p_value*m/rk) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM ptests WHERE p_value IS NOT NULL))
SELECT t.o_orderkey, round(g.q,6) AS q_value, round(f.q,6) AS q_value_family FROM ptests t LEFT JOIN g USING (o_orderkey) LEFT JOIN bh_family f USING (o_orderkey)""")
def st_bh(t):
    q = stats.bh(ptests(t), [], "p_value")
    return stats.bh(q, ["family"], "p_value", "q_value_family").select("o_orderkey", "q_value", "q_value_family")


@query("st_stars", "bh_family", "SELECT CASE WHEN q<0.001 THEN '***' WHEN q<0.01 THEN '**' WHEN q<0.05 THEN '*' WHEN q<0.1 THEN '.' ELSE '' END AS label, count(*) AS n FROM bh_family GROUP BY 1")
def st_stars(t):
    q = stats.bh(ptests(t).filter("p_value IS NOT NULL"), ["family"], "p_value")
    return q.groupBy(stats.stars(F.col("q_value")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("st_comparison_registry", "results", f"""
WITH sp AS (SELECT * FROM (VALUES ('figure_2','kernel_vs_standard','kernel','standard'),('figure_3','stack_vs_standard','stack','standard'),('figure_3','burden_vs_standard','burden','standard')) x(figure_id, comparison, candidate, baseline)),
m AS (SELECT endpoint, learner, representation, avg(score) AS score FROM results GROUP BY ALL), s AS (SELECT endpoint, representation, learner, avg(delta) AS mean, stddev_samp(delta)/sqrt(count(*)) AS se, count(*) AS n FROM (SELECT c.endpoint, c.representation, c.learner, c.score-s.score AS delta FROM results s JOIN results c USING (endpoint, learner, resample) WHERE s.representation='standard' AND c.representation<>'standard') GROUP BY ALL),
g AS (SELECT sp.*, e.endpoint, l.learner FROM sp, (SELECT DISTINCT endpoint FROM results) e, (SELECT DISTINCT learner FROM results) l)
SELECT figure_id, comparison, g.endpoint, g.learner, CASE WHEN a.score IS NULL OR b.score IS NULL THEN 'not_tested' ELSE 'tested' END AS status, CASE WHEN a.score IS NULL OR b.score IS NULL THEN 'missing candidate or baseline' ELSE '' END AS reason, round(a.score-b.score,6) AS delta, round(CASE WHEN n<=1 THEN NULL WHEN se<=1e-15 THEN CASE WHEN abs(mean)>1e-15 THEN 0.0 ELSE 1.0 END ELSE {_p2('mean/se')} END,6) AS p_value
FROM g LEFT JOIN m a ON a.endpoint=g.endpoint AND a.learner=g.learner AND a.representation=candidate LEFT JOIN m b ON b.endpoint=g.endpoint AND b.learner=g.learner AND b.representation=baseline LEFT JOIN s ON s.endpoint=g.endpoint AND s.learner=g.learner AND s.representation=candidate""")
def st_comparison_registry(t):
    specs = [("figure_2", "kernel_vs_standard", "kernel", "standard"), ("figure_3", "stack_vs_standard", "stack", "standard"), ("figure_3", "burden_vs_standard", "burden", "standard")]
    tests = stats.normal_interval(deltas(t), ["endpoint", "representation", "learner"], "delta")
    return res.comparison_registry(res.sample_results(t), specs, tests)


@query("st_win_rate", "deltas", "SELECT endpoint, representation, round(avg(CAST(delta>0 AS INT)),6) AS win_rate, count(*) AS n FROM deltas GROUP BY ALL")
def st_win_rate(t):
    return deltas(t).groupBy("endpoint", "representation").agg(F.avg((F.col("delta") > 0).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("n"))
