"""Result tables of model comparisons: pairing, selection, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_results(t) -> DataFrame:
    """A result table (endpoint, representation, learner, resample, score, n) aggregated from orders."""
    o = t.orders
    rep = F.when(F.col("o_custkey") % 3 == 0, "standard").when(F.col("o_custkey") % 3 == 1, "kernel").otherwise("stack")
    return o.groupBy(
        F.col("o_orderpriority").alias("endpoint"), rep.alias("representation"),
        F.when(F.col("o_orderkey") % 2 == 0, "linear").otherwise("trees").alias("learner"),
        F.month("o_orderdate").cast("long").alias("resample"),
    ).agg((F.avg("o_totalprice") / 1000000).alias("score"), F.count(F.lit(1)).alias("n"))


def paired_resamples(results: DataFrame, keys: list[str], name: str, baseline: str, score: str) -> DataFrame:
    """Each candidate row next to the baseline row of the same resample."""
    base = results.filter(F.col(name) == baseline).select(*keys, F.col(score).alias(f"{score}_standard"))
    cand = results.filter(F.col(name) != baseline).select(*keys, name, F.col(score).alias(f"{score}_candidate"))
    return cand.join(base, keys).withColumn("delta", F.col(f"{score}_candidate") - F.col(f"{score}_standard"))


def sign_within(x: Column, tolerance: float) -> Column:
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)


def learner_agreement(results: DataFrame, *, tolerance: float) -> DataFrame:
    """Deltas against the standard representation for both learners and whether their signs agree."""
    mean = results.groupBy("endpoint", "representation").pivot("learner", ["linear", "trees"]).agg(F.avg("score"))
    base = mean.filter("representation = 'standard'").select("endpoint", F.col("linear").alias("bl"), F.col("trees").alias("bx"))
    d = mean.filter("representation <> 'standard'").join(base, "endpoint").select(
        "endpoint", "representation", (F.col("linear") - F.col("bl")).alias("delta_linear"),
        (F.col("trees") - F.col("bx")).alias("delta_trees"),
    )
    return d.withColumn("agree", sign_within(F.col("delta_linear"), tolerance) == sign_within(F.col("delta_trees"), tolerance))


def best_rows(df: DataFrame, keys: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """The first row per key in a mixed order; descending columns are numeric (their sign is turned).

    An aggregate with a struct as sort key: partial results combine before the shuffle.
    """
    rank = F.struct(*[(-F.col(c) if d == "desc" else F.col(c)).alias(f"k{i}") for i, (c, d) in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_baseline(results: DataFrame, keys: list[str], name: str, baseline: str, score: str) -> DataFrame:
    """``delta_vs_baseline`` against the baseline row of the same keys (aggregate and join)."""
    base = results.filter(F.col(name) == baseline).groupBy(*keys).agg(F.max(score).alias("_base"))
    return results.join(base, keys, "left").withColumn("delta_vs_baseline", F.col(score) - F.col("_base")).drop("_base")


def leaderboard(deltas: DataFrame, keys: list[str], delta: str, endpoint: str, score: str) -> DataFrame:
    """Summary of deltas per candidate with counts of gains and losses and the promotion rule.

    A candidate has one row per endpoint, so the group behind the median is as small as the panel.
    """
    d = F.col(delta)
    out = deltas.groupBy(*keys).agg(
        F.countDistinct(endpoint).alias("n_endpoints"), F.avg(d).alias("mean_delta"),
        F.percentile(d, 0.5).alias("median_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"),
        F.count_if(d >= 0.03).alias("gains"), F.count_if(d < -0.02).alias("losses"), F.avg(score).alias("mean_score"),
    )
    return out.withColumn("promoted", promoted())


def promoted() -> Column:
    return (
        (F.col("mean_delta") >= 0.02) & (F.col("min_delta") >= -0.02) & (F.col("gains") >= 3) & (F.col("losses") == 0)
    )


def missing_signal(importance: Column, r2: Column) -> Column:
    """Importance that a representation does not recover."""
    return importance * (1 - F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0)))


def comparison_registry(results: DataFrame, specs: list[tuple[str, str, str, str]], tests: DataFrame) -> DataFrame:
    """Every comparison x endpoint x learner with its delta and p-value, or why it was not tested."""
    spark = results.sparkSession
    spec = spark.createDataFrame(specs, "figure_id string, comparison string, candidate string, baseline string")
    slots = results.select("endpoint", "learner").distinct().withColumn("j", F.lit(1))
    grid = slots.join(F.broadcast(spec.withColumn("j", F.lit(1))), "j").drop("j")
    mean = results.groupBy("endpoint", "learner", "representation").agg(F.avg("score").alias("score"))
    side = lambda role, s: mean.select("endpoint", "learner", F.col("representation").alias(role), F.col("score").alias(s))
    p = tests.select("endpoint", "learner", F.col("representation").alias("candidate"), "p_value")
    full = (
        grid.join(side("candidate", "a"), ["endpoint", "learner", "candidate"], "left")
        .join(side("baseline", "b"), ["endpoint", "learner", "baseline"], "left")
        .join(p, ["endpoint", "learner", "candidate"], "left")
    )
    missing = F.col("a").isNull() | F.col("b").isNull()
    return full.select(
        "figure_id", "comparison", "endpoint", "learner", F.when(missing, "not_tested").otherwise("tested").alias("status"),
        F.when(missing, "missing candidate or baseline").otherwise("").alias("reason"), (F.col("a") - F.col("b")).alias("delta"), "p_value",
    )


def frozen_choice(results: DataFrame, endpoint: str, tuned_on: str, keys: list[str], params: list[str], score: str) -> DataFrame:
    """Pick the best parameters per key on one endpoint and keep only those rows everywhere."""
    tuned = results.filter(F.col(endpoint) == tuned_on)
    chosen = best_rows(tuned, keys, [(score, "desc")] + [(p, "asc") for p in params]).select(*keys, *params)
    return results.join(F.broadcast(chosen), [*keys, *params], "left_semi")


def early_stop(deltas: DataFrame, candidate: list[str], endpoint: str, limiting: list[str], delta: str, gate: float) -> DataFrame:
    """Two stages: all candidates on the limiting endpoints, the rest only for those above the gate."""
    first = deltas.filter(F.col(endpoint).isin(limiting))
    alive = first.groupBy(*candidate).agg(F.avg(delta).alias("m")).filter(F.col("m") >= gate).select(*candidate)
    rest = deltas.filter(~F.col(endpoint).isin(limiting)).join(alive, candidate, "left_semi")
    return first.unionByName(rest.select(first.columns))
