"""Order statistics that never gather a group: runs of equal values, running totals, exact quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.session import parallel_width, settle


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys]) if keys else F.lit(True)


#: Distinct values of a key that one task takes together; a key with more is cut into bins.
GATHERED = 20_000


def join_keys(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one row per key set onto ``df``; without keys ``dim`` is a single row."""
    return df.join(dim, keys, how) if keys else df.join(F.broadcast(dim))


def value_runs(df: DataFrame, keys: list[str], value: str, aggs: dict[str, Column]) -> DataFrame:
    """One row per distinct value and key: ties collapse map-side, so a hot value is one row."""
    return df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in aggs.items()])


def running_totals(runs: DataFrame, keys: list[str], value: str, cols: list[str], bins: int | None = None) -> DataFrame:
    """Adds ``before_<c>`` (sum of ``c`` over smaller values of the key) and ``all_<c>``.

    A single ordered window per key would put a whole key into one task. Here the runs are stored once, so that none of the
    steps computes them again, and each key is cut into ``bins`` bins of about equally many runs at approximate quantiles;
    bin totals are summed first, and the window only runs within a bin.
    """
    runs = settle(runs, "runs")
    totals = [F.sum(c).alias(f"all_{c}") for c in cols]
    binned = _binned(runs, keys, value, bins, totals)
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*keys, "_bin")
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
        .select(*keys, "_bin", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in cols])
    )
    inner = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(offsets, [*keys, "_bin"])
    for c in cols:
        out = out.withColumn(f"before_{c}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)))
    return out.drop("_bin", *[f"_o_{c}" for c in cols])


def _binned(df: DataFrame, keys: list[str], value: str, bins: int | None, aggs: list[Column]) -> DataFrame:
    """``df`` with ``aggs`` of its key and ``_bin``, the number of the key's cut points below the value.

    ``df`` must be stored: the cut points come from a reading of their own. Cut points are stored with it, so a retried task
    cuts in the same way.
    """
    v, bins = F.col(value).cast("double"), bins or parallel_width(df.sparkSession)
    cuts = F.array_distinct(F.percentile_approx(v, [i / bins for i in range(1, bins)], 4 * bins)).alias("_cuts")
    span = settle(df.groupBy(*keys).agg(cuts, *aggs), "cuts")
    below = F.size(F.filter("_cuts", lambda c: c < v))
    return join_keys(df, span, keys).withColumn("_bin", F.when(v.isNull(), 0).otherwise(below).cast("int")).drop("_cuts")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key (nulls ignored), one row per key; none of a null key.

    Runs are stored once. A key of few distinct values meets in one task, only those of more than ``GATHERED`` are ranked bin by bin.
    """
    given = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [value, *keys]])
    runs = settle(value_runs(df.filter(given), keys, value, {"n": F.count(F.lit(1))}), "runs")
    v = F.col(value).cast("double")
    sizes = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_runs"))
    hot = settle(sizes.where(F.col("_runs") > GATHERED).select(*keys, "_runs"), "hot-keys")
    some = hot.count()
    if some and not keys:
        return _ranked_quantiles(runs, keys, value, probs)
    at = F.percentile(v, F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("n")).alias("_at")
    few = runs.join(hot, keys, "left_anti") if some else runs
    out = few.groupBy(*keys).agg(at).select(*keys, *[F.col("_at")[i].alias(name) for i, name in enumerate(probs)])
    return out.unionByName(_ranked_quantiles(runs.join(hot.drop("_runs"), keys), keys, value, probs)) if some else out


def _ranked_quantiles(runs: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles`` of runs (keys, value, n) by running totals, which gather no key."""
    ranked = running_totals(runs, keys, value, ["n"])
    v = F.col(value).cast("double")
    aggs = []
    for name, p in probs.items():
        h = (F.col("all_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        at = lambda k: F.max(F.when((F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n")), v))
        a, b = at(lo), at(hi)
        aggs.append((a + (b - a) * F.max(h - lo)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def attach_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    return join_keys(df, quantiles(df, keys, value, probs), keys, "left" if keys else "inner")


def midranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank of each distinct (key, value): ``before + (n + 1) / 2``, with ``n`` and ``all_n``."""
    runs = value_runs(df, keys, value, {"n": F.count(F.lit(1))})
    return running_totals(runs, keys, value, ["n"]).withColumn(
        out, F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)
    )


def suffix_minimum(df: DataFrame, keys: list[str], value: str, col: str, out: str, bins: int | None = None) -> DataFrame:
    """Minimum of ``col`` over rows with a value at least as large, per key, stored and cut into bins like
    ``running_totals``."""
    df = settle(df, "values")
    binned = _binned(df, keys, value, bins, [])
    w = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    later = binned.groupBy(*keys, "_bin").agg(F.min(col).alias("_m")).select(*keys, "_bin", F.min("_m").over(w).alias("_later"))
    inner = Window.partitionBy(*keys, "_bin").orderBy(F.desc(value))
    return binned.join(later, [*keys, "_bin"]).withColumn(out, F.least(F.min(col).over(inner), F.col("_later"))).drop("_bin", "_later")
