"""Joins between events, cohorts, predictions and dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sides up to this many rows are broadcast; larger ones are left to the optimizer.
BROADCAST_ROWS = 2_000_000


def hinted(dim: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``dim`` only after counting that it stays within ``limit`` rows (the count stops there)."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def members_only(events: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    """Events of cohort members."""
    return events.join(cohort.select(key).distinct(), key, "left_semi")


def on_spine(spine: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Features for every spine entity; missing numbers read as zero."""
    return spine.select(key).join(features, key, "left").fillna(0)


def expand_sets(events: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per event and gene set it falls in; sets overlap."""
    return events.join(sets, "gene")


def paired_predictions(candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two prediction tables; differing labels or repeated keys fail the query.

    Both have ``keys, y, score``.
    """
    one = lambda df, s: df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"n_{s}"), F.min("y").alias(f"y_{s}"), F.min("score").alias(s)
    )
    both = one(candidate, "candidate").join(one(baseline, "baseline"), keys)
    fault = (
        F.when((F.col("n_candidate") > 1) | (F.col("n_baseline") > 1), "repeated prediction key")
        .when(~F.col("y_candidate").eqNullSafe(F.col("y_baseline")), "labels differ between predictions")
    )
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("candidate"))
    return both.select(*keys, F.col("y_candidate").alias("y"), checked.alias("candidate"), "baseline")


def missing_slots(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(observed.select(*keys), keys, "left_anti")


def grid(*dims: DataFrame) -> DataFrame:
    """All combinations of small dimension tables (configuration, never events); the product is made where the parts are."""
    return reduce(lambda a, b: a.crossJoin(b), [d.distinct() for d in dims])


def overlap_sizes(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows per combination of tables a key occurs in: one union and two aggregations, no pairwise joins."""
    tagged = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(key).distinct().withColumn("src", F.lit(n)) for n, df in tables.items()],
    )
    flags = [F.max((F.col("src") == n).cast("int")).alias(n) for n in tables]
    return tagged.groupBy(key).agg(*flags).groupBy(*tables).agg(F.count(F.lit(1)).alias("keys"))
