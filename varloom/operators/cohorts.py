"""Sequential eligibility rules and tagged cohort subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.evaluation.quantiles import attach_quantiles


def exclude_gene(events: DataFrame, gene: str) -> DataFrame:
    return events.filter(F.upper(F.coalesce("gene", F.lit(""))) != gene.upper())


def eligible(
    meta: DataFrame, burden: str, min_burden: int, cls: str, group: str, *, drop: list[str], min_groups: int, min_rows: int
) -> DataFrame:
    """Enough burden and a kept class; then classes seen in enough groups; then classes with enough rows."""
    use = meta.filter((F.col(burden) >= min_burden) & ~F.col(cls).isin(drop))
    wide = use.groupBy(cls).agg(F.countDistinct(group).alias("k")).filter(F.col("k") >= min_groups).select(cls)
    use = use.join(wide, cls, "left_semi")
    full = use.groupBy(cls).count().filter(F.col("count") >= min_rows).select(cls)
    return use.join(full, cls, "left_semi")


def usable_endpoints(labels: DataFrame, *, min_binary: int, min_class: int, min_classes: int) -> DataFrame:
    """Binary endpoints need two classes of a minimum size; multiclass ones lose small classes first.

    ``labels`` has ``endpoint, task, <sample>, y``.
    """
    n = labels.groupBy("endpoint", "task", "y").agg(F.count(F.lit(1)).alias("n"))
    kept = n.filter((F.col("task") == "binary") | (F.col("n") >= min_class))
    ok = (
        kept.groupBy("endpoint", "task")
        .agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"))
        .filter(
            F.when(F.col("task") == "binary", (F.col("k") == 2) & (F.col("smallest") >= min_binary)).otherwise(
                F.col("k") >= min_classes
            )
        )
    )
    classes = kept.join(ok.select("endpoint", "task"), ["endpoint", "task"], "left_semi")
    return labels.join(classes.select("endpoint", "task", "y"), ["endpoint", "task", "y"], "left_semi")


def burden_quartile(people: DataFrame, burden: str) -> DataFrame:
    q = attach_quantiles(people, [], burden, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    b = F.col(burden)
    return q.withColumn(
        "quartile",
        F.when(b <= F.col("q1"), "Q1").when(b <= F.col("q2"), "Q2").when(b <= F.col("q3"), "Q3").otherwise("Q4"),
    )


def named_subsets(people: DataFrame, burden: str, kind: str, *, min_rows: int) -> DataFrame:
    """One row per (subset, patient): a patient belongs to every subset whose rule holds.

    The rules are an array per row, exploded once, instead of a scan per subset.
    """
    b = F.col(burden)
    tag = lambda rule, name: F.when(rule, name)
    tags = F.array(
        F.lit("full"),
        tag(b <= F.col("q2"), F.lit("low_burden_q50")),
        F.concat(F.lit("within_type_"), F.col(kind).cast("string")),
        tag(b >= F.col("q1"), F.lit("exclude_low_burden_q25")),
        tag(F.col("quartile").isin("Q1", "Q4"), F.lit("burden_extremes")),
        tag(F.col("quartile") == "Q1", F.lit("burden_Q1")),
        tag(F.col("quartile").isin("Q2", "Q3"), F.lit("burden_mid")),
        tag(F.col("quartile") == "Q4", F.lit("burden_Q4")),
    )
    rows = burden_quartile(people, burden).select(F.explode(F.array_compact(tags)).alias("subset"), "patient", burden)
    big = rows.groupBy("subset").count().filter(F.col("count") >= min_rows).select("subset")
    return rows.join(big, "subset", "left_semi")
