"""Durable outputs: result tables, keyed upserts, resumable work lists and a content-addressed cache."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources.readers import last_per_key


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write (the committer publishes a job's output as a whole) and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Union of both versions, the row of the latest batch per key; of several in one batch the greatest row."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != batch]
    return last_per_key(both, keys, F.struct(batch, *rest))


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work still to do; a done-table that lacks a key column counts as empty."""
    if not set(keys) <= set(done.columns):
        return plan
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modificationTime) of the files below ``paths``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", "length", "modificationTime")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes whenever a file is added, removed, resized or rewritten. One aggregation, whatever the number of files."""
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
    r = listing(spark, paths).agg(F.count("*").alias("n"), F.sum(one).alias("a"), F.sum(one * F.lit(31) % F.lit(1_000_003)).alias("b")).first()
    return f"{r['n']}-{r['a']}-{r['b']}"


def cached(spark: SparkSession, root: str, name: str, settings: dict[str, str], inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table built from ``inputs`` with ``settings``: stored by the first call, read by later ones.

    What it was built from is stored beside it and compared in full, so neither changed inputs nor two settings that share a
    folder can return another table's rows; whatever does not compare is built anew under a folder of its own.
    """
    facts = sorted({**{f"setting {k}": str(v) for k, v in settings.items()}, "inputs": " ".join(sorted(inputs)), "files": fingerprint(spark, inputs)}.items())
    wanted = spark.createDataFrame(facts, "fact string, value string")
    place = f"{root}/{name}/" + hashlib.blake2b(repr(facts).encode(), digest_size=12).hexdigest()
    try:
        known = spark.read.parquet(f"{place}/facts")
        if known.exceptAll(wanted).isEmpty() and wanted.exceptAll(known).isEmpty():
            return spark.read.parquet(f"{place}/rows")
        place += "-" + uuid.uuid4().hex
    except AnalysisException:  # nothing stored yet
        pass
    build().write.mode("overwrite").parquet(f"{place}/rows")
    wanted.coalesce(1).write.mode("overwrite").parquet(f"{place}/facts")  # last: rows without facts are unfinished
    return spark.read.parquet(f"{place}/rows")


def nonzero(long: DataFrame, value: str) -> DataFrame:
    """Sparse matrix as its non-zero entries."""
    return long.filter(F.col(value) != 0)
