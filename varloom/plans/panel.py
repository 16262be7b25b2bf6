"""Consolidation of result tables into one canonical panel, with its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.evaluation import stats
from varloom.evaluation.results import best_rows

# Result source -> priority.
SOURCE_PRIORITY = {"complete_panel": 60, "event_kernel": 55, "locus_stack": 35, "locked": 25, "kernel_mean": 20}


def normalise(raw: DataFrame, candidates: dict[str, list[str]], families: dict[str, str]) -> DataFrame:
    """Heterogeneous result columns to one schema: the first present and non-null candidate column wins."""
    out = []
    for name, options in candidates.items():
        present = [F.col(o) for o in options if o in raw.columns]
        out.append((F.coalesce(*present) if present else F.lit(None).cast("string")).alias(name))
    mapped = raw.select(*out)
    rows = list(families.items())
    dim = raw.sparkSession.createDataFrame(rows, "representation string, representation_family string")
    return mapped.join(F.broadcast(dim), "representation", "left").withColumn("primary_score", F.col("primary_score").try_cast("double"))


def canonical(rows: DataFrame, expected_source: dict[str, str]) -> DataFrame:
    """One row per slot from the expected source: finite score, 5 folds, 1 repeat, predictions on file."""
    dim = rows.sparkSession.createDataFrame(list(expected_source.items()), "representation string, expected string")
    ok = rows.join(F.broadcast(dim), "representation").filter(
        (F.col("experiment") == F.col("expected")) & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("folds") == 5)
        & (F.col("repeats") == 1) & (F.coalesce(F.trim("oof_file"), F.lit("")) != "")
    ).drop("expected")
    return best_rows(ok, ["endpoint", "representation", "learner"], [("priority", "desc"), ("score", "desc"), ("resample", "asc")])


def extract_predictions(canon: DataFrame, predictions: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """Predictions of the canonical slots; a repeated (slot, sample) fails the query."""
    kept = predictions.join(canon.select(*keys).distinct(), keys, "left_semi")
    one = kept.groupBy(*keys, sample).agg(F.count(F.lit(1)).alias("_n"), F.min("pred").alias("pred"))
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated prediction in a slot")).cast("double")).otherwise(F.col("pred"))
    return one.select(*keys, sample, guard.alias("pred"))


def plot_table(canon: DataFrame, tests: DataFrame) -> DataFrame:
    """Measured slots with the delta and q-value of their comparison, if there is one."""
    q = stats.bh(tests, [], "p_value").select("endpoint", "learner", F.col("candidate").alias("representation"), "delta", "q_value")
    return canon.join(q, ["endpoint", "learner", "representation"], "left").withColumn("significance", stats.stars(F.col("q_value")))


def violations(table: DataFrame, canon: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows that differ from the canonical score by more than 1e-12 or miss a slot (empty when valid)."""
    both = table.select(*keys, F.col(score).alias("a")).join(canon.select(*keys, F.col(score).alias("b")), keys, "full")
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > 1e-12))


def fold_audit(preds: DataFrame, sample: str, fold: str, representation: str) -> DataFrame:
    """Per sample: number of distinct folds over representations and repeated keys, only offenders."""
    one = preds.groupBy(sample, representation).agg(F.count(F.lit(1)).alias("n"), F.min(fold).alias("f"), F.max(fold).alias("g"))
    per = one.groupBy(sample).agg(F.min("f").alias("lo"), F.max("g").alias("hi"), F.max("n").alias("copies"))
    return per.filter((F.col("lo") != F.col("hi")) | (F.col("copies") > 1))


def reproduction(current: DataFrame, prior: DataFrame, keys: list[str], score: str) -> DataFrame:
    p = prior.select(*keys, F.col(score).alias("prior_score"))
    return current.join(p, keys, "left").withColumn("current_minus_prior", F.col(score) - F.col("prior_score"))


def feature_dims(stack: DataFrame, spine: DataFrame) -> DataFrame:
    """Features, samples and non-zero share per model; distinct counts are aggregates of pre-aggregated keys."""
    per_feature = stack.groupBy("model_id", "feature").agg(F.count_if(F.col("value") != 0).alias("nz"))
    size = F.broadcast(spine.agg(F.count(F.lit(1)).alias("n_samples")))
    dims = per_feature.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum("nz").alias("nz"))
    return dims.join(size).select("model_id", "n_features", "n_samples", (F.col("nz") / (F.col("n_features") * F.col("n_samples"))).alias("nonzero_fraction"))


def reconstruction(dims: DataFrame, identity_models: list[str], n_channels: int) -> DataFrame:
    keeps = F.col("model_id").isin(identity_models)
    return dims.select(
        "model_id", "n_features", F.when(keeps, 1.0).otherwise(0.0).alias("reconstruction_r2"),
        F.when(keeps, 0).otherwise(F.greatest(F.lit(n_channels) - (F.col("n_features") - 3), F.lit(0))).alias("estimated_collisions"),
        keeps.alias("preserves_identity"),
    )
