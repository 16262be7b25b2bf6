"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.catalog.oracle_views import with_views
from varloom.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: integers as bigint, fractions as doubles rounded to 6 places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            # + 0.0 turns a negative zero into zero
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, needs: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` runs over the views in ``needs``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(Tables(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(needs, sql)
        return fn

    return wrap
