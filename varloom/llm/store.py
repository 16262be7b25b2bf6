"""Intermediate tables in the folder that all executors share, fixed-size membership bitmaps and per-process caches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, the session's warehouse folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and return the table that reads it.

    This cuts the lineage: what follows survives lost executors without running ``df`` again.
    Every call has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/varloom-text/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cached(name: str, build: Callable):
    """``build()`` once per Python process, on the driver or in a worker that runs many tasks."""
    store = sys.modules.setdefault("_varloom_process_cache", types.ModuleType("_varloom_process_cache")).__dict__
    if name not in store:
        store[name] = build()
    return store[name]


def bitmap(df: DataFrame, hashes: Column, log2_bits: int = 24) -> np.ndarray:
    """Bits set at the top ``log2_bits`` bits of each hash: at most ``2 ** log2_bits / 8`` bytes whatever the table's size.

    A table too large for it fills the map and lets more rows through to the exact join that follows.
    """
    bit = F.shiftrightunsigned(hashes, 64 - log2_bits)
    words = (
        df.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), bit.bitwiseAND(F.lit(63)).cast("int").alias("at"))
        .select("word", F.call_function("shiftleft", "one", "at").alias("mask"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    out = np.zeros(max(1, 2**log2_bits // 64), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes may be in the set of ``bitmap``."""
    top = hashes >> np.uint64(64 - int(len(bits) * 64).bit_length() + 1)
    return (bits[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bits_for(rows: int) -> int:
    """Size of a bitmap for so many hashes: about 64 bits each, between 2**20 and 2**27 bits."""
    return min(27, max(20, int(np.ceil(np.log2(max(rows, 1)))) + 6))
