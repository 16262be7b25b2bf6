"""Ranked, regression and classification metrics as aggregates over long prediction tables.

Every function takes ``keys`` (endpoint, model, fold, replicate, ...) and returns one row per key. Ranks
come from runs of equal scores and running totals, so no key is ever ordered inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.evaluation.quantiles import join_keys, midranks, running_totals, value_runs


def pearson(x: str, y: str) -> Column:
    """Correlation, null when one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _runs(preds: DataFrame, keys: list[str], y: str, score: str, weight: str | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    positive = F.col(y) == 1
    runs = value_runs(
        preds, keys, score, {"pos": F.sum(F.when(positive, w).otherwise(0)), "neg": F.sum(F.when(positive, 0).otherwise(w))}
    )
    return running_totals(runs, keys, score, ["pos", "neg"])


def auroc(preds: DataFrame, keys: list[str], y: str, score: str, *, weight: str | None = None, out: str = "auroc") -> DataFrame:
    """Exact AUROC with ties counted half; null when a class is missing."""
    r = _runs(preds, keys, y, score, weight)
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return r.groupBy(*keys).agg(F.try_divide(won, F.max("all_pos").cast("double") * F.max("all_neg")).alias(out))


def macro_auroc(proba: DataFrame, keys: list[str]) -> DataFrame:
    """Mean one-vs-rest AUROC of ``(keys, y, class, p)``; classes with one outcome are skipped."""
    one = proba.withColumn("is", (F.col("y") == F.col("class")).cast("int"))
    return auroc(one, [*keys, "class"], "is", "p").groupBy(*keys).agg(F.avg("auroc").alias("macro_auroc"))


def auprc(preds: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Average precision: precision at each distinct score weighted by the recall it adds."""
    r = _runs(preds, keys, y, score)
    tp = F.col("all_pos") - F.col("before_pos")
    n = tp + F.col("all_neg") - F.col("before_neg")
    return r.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * tp / n), F.max("all_pos")).alias("auprc"))


def attach_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    r = midranks(df, keys, value, out).select(*keys, value, out)
    return df.join(r, [*keys, value])


def spearman(preds: DataFrame, keys: list[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    ranked = attach_rank(attach_rank(preds, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(pearson("_rx", "_ry").alias(out))


def regression(preds: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Pearson, R² and MAE; the total sum of squares is var_pop · n."""
    d = F.col(y) - F.col(p)
    return preds.groupBy(*keys).agg(
        pearson(y, p).alias("pearson"), (1 - F.try_divide(F.sum(d * d), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        F.avg(F.abs(d)).alias("mae"), F.count(F.lit(1)).alias("n_test"),
    )


def classification(preds: DataFrame, keys: list[str], y: str, pred: str, p: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 (0 for an empty class) and, for binary scores, Brier."""
    hit = (F.col(y) == F.col(pred)).cast("int")
    brier = F.avg((F.col(p) - F.col(y)) ** 2) if p else F.lit(None).cast("double")
    base = preds.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("accuracy"), brier.alias("brier"))
    entry = lambda cls, t, q, h: F.struct(cls.alias("cls"), t.alias("t"), q.alias("q"), h.alias("h"))
    zero, one = F.lit(0), F.lit(1)
    sides = F.array(entry(F.col(y), one, zero, hit), entry(F.col(pred), zero, one, zero))
    per = preds.select(*keys, F.inline(sides)).groupBy(*keys, "cls").agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("h").alias("h"))
    cls = per.groupBy(*keys).agg(
        F.avg(F.try_divide("h", "t")).alias("balanced_accuracy"),
        F.avg(2.0 * F.col("h") / (F.col("t") + F.col("q"))).alias("macro_f1"),
    )
    return join_keys(base, cls, keys)


def calibration(preds: DataFrame, keys: list[str], confidence: str, observed: str) -> DataFrame:
    """Ten equal bins, the last one closed."""
    b = F.least(F.floor(F.col(confidence) * 10), F.lit(9)) + 1
    return preds.filter(F.col(confidence).isNotNull()).groupBy(*keys, b.alias("bin")).agg(
        F.avg(confidence).alias("mean_predicted"), F.avg(F.col(observed).cast("double")).alias("observed_frequency"), F.count(F.lit(1)).alias("n_samples"),
    )


def mutual_information(features: DataFrame, labels: DataFrame, bins: int = 10) -> DataFrame:
    """Binned mutual information per endpoint and feature (equal-width bins by exact range), over the
    endpoint's maximum, averaged over endpoints.

    ``features``: sample, feature, value; ``labels``: endpoint, sample, y.
    """
    span = features.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    binned = features.join(span, "feature").select("sample", "feature", b.alias("b"))
    joint = binned.join(labels, "sample").groupBy("endpoint", "feature", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    g = ["endpoint", "feature"]
    px = joint.groupBy(*g, "b").agg(F.sum("n").alias("nb"))
    py = joint.groupBy(*g, "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy(*g).agg(F.sum("n").alias("t"))
    mi = (
        joint.join(px, [*g, "b"]).join(py, [*g, "y"]).join(total, g).groupBy(*g)
        .agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")).cast("double"))).alias("mi"))
    )
    top = mi.groupBy("endpoint").agg(F.max("mi").alias("m"))
    share = F.when(F.col("m") > 1e-12, F.greatest("mi", F.lit(0.0)) / F.col("m")).otherwise(0.0)
    return mi.join(top, "endpoint").groupBy("feature").agg(F.avg(share).alias("importance"))
