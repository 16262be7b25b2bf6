"""Selection, ranking and capping that stay parallel when one key holds most rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.session import parallel_width


def smallest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, salt: Column) -> DataFrame:
    """The ``n`` first rows per key in two rounds.

    First within (key, salt), which spreads a hot key over many tasks, then among the survivors. A row
    that is among the first ``n`` of its key is among the first ``n`` of its salt, so this is exact.
    """
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(salt, F.lit(parallel_width(df.sparkSession))))
        .withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= n)
        .withColumn("_k", F.row_number().over(second)).filter(F.col("_k") <= n)
        .drop("_k", "_salt")
    )


def event_cap(events: DataFrame, key: str, identity: list[str], n: int, seed: str) -> DataFrame:
    """At most ``n`` events per key: a seeded sample without replacement, by hash order."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in identity])
    hashed = events.withColumn("_h", F.sha2(text, 256))
    return smallest_per_key(hashed, [key], [F.col("_h")], n, F.xxhash64("_h")).drop("_h")


def hypergeometric(u: float, total: int, marked: int, draws: int) -> int:
    """How many of ``draws`` units, taken without replacement from ``total``, are among the ``marked``: inverse distribution at ``u``.

    The weights are built from the most likely value outwards by their ratios; further than 14 standard deviations and 30 units
    from it they are below any double, so a draw costs about the square root of ``draws``.
    """
    least, most = max(0, draws - (total - marked)), min(marked, draws)
    if least == most:
        return least
    mean = draws * marked / total
    spread = 14 * math.sqrt(mean * (1 - marked / total) * (total - draws) / max(1, total - 1)) + 30
    mode = min(max((draws + 1) * (marked + 1) // (total + 2), least), most)
    least, most = max(least, int(mean - spread)), min(most, int(mean + spread) + 1)
    up = np.arange(mode, most, dtype=float)  # from k to k + 1
    down = np.arange(mode, least, -1, dtype=float)  # from k to k - 1
    rise = np.cumprod((marked - up) * (draws - up) / ((up + 1) * (total - marked - draws + up + 1)))
    fall = np.cumprod(down * (total - marked - draws + down) / ((marked - down + 1) * (draws - down + 1)))
    weight = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    return least + int(np.searchsorted(weight, u * weight[-1]))


def downsample(counts: DataFrame, budget: int, replicates: int, seed: str) -> DataFrame:
    """Draw ``budget`` units without replacement from each sample's counts, per replicate; smaller samples are dropped.

    Channel after channel, in the order of their names, takes a hypergeometric share of what is left of the budget, by the inverse
    distribution at a number that a hash of seed, replicate, sample and channel gives: multivariate hypergeometric, repeatable,
    and never more than one row a distinct (sample, channel, replicate). A group is one sample's channels.
    ``counts``: patient, channel, n.
    """
    totals = counts.groupBy("patient").agg(F.sum("n").alias("t")).filter(F.col("t") >= budget)
    rows = counts.filter("n > 0").join(totals, "patient").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.concat_ws("|", F.lit(seed), "replicate", "patient", "channel")
    rows = rows.withColumn("u", F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(16**13))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf["channel"].str.encode("utf-8").to_numpy())]
        left, total, taken = budget, int(pdf["t"].iloc[0]), []
        for n, u in zip(pdf["n"].tolist(), pdf["u"].tolist(), strict=True):
            x = hypergeometric(u, total, n, left) if left else 0
            taken.append(x)
            left, total = left - x, total - n
        return pdf.assign(n=taken)[["patient", "replicate", "channel", "n"]]

    drawn = rows.groupBy("patient", "replicate").applyInPandas(draw, "patient string, replicate int, channel string, n long")
    return drawn.filter("n > 0")


def rank_pct(features: DataFrame, key: str = "patient", value: str = "n") -> DataFrame:
    """Average rank within the sample over its number of features.

    A sample has at most as many rows as there are features, so the window is bounded by the feature
    universe, not by the events.
    """
    tie = Window.partitionBy(key, value)
    w = Window.partitionBy(key)
    rank = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(tie) - 1) / F.lit(2.0)
    return features.withColumn("rank_pct", rank / F.count(F.lit(1)).over(w))
