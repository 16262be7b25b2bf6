"""Sample-by-channel counts and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import catalogues


def channel_counts(encoded: DataFrame) -> DataFrame:
    """Long ``(patient, channel, n)`` of accepted events inside the catalogue; map-side combined."""
    return (
        encoded.filter(F.col("reject_reason").isNull() & F.col("channel").isNotNull())
        .groupBy("patient", "channel")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def complete_counts(observed: DataFrame, spine: DataFrame) -> DataFrame:
    """Every spine patient with every channel of the universe, zero where nothing was observed.

    The 257 channels are an array literal exploded per patient, so the fill is a projection and one
    outer join on (patient, channel).
    """
    names = F.array(*[F.lit(c) for _, _, c in catalogues.universe()])
    grid = spine.select("patient", F.explode(names).alias("channel"))
    return grid.join(observed, ["patient", "channel"], "left").select(
        "patient", "channel", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
