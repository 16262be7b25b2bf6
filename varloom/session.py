"""Session settings and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "varloom") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # longer generated methods are never compiled by the JVM; such a stage is generated operator by operator instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def parallel_width(spark: SparkSession) -> int:
    """Into how many parts a hot key is cut: as many as the session's shuffles have, 64 at least."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``varloom.scratch`` or ``spark.checkpoint.dir`` of the session.

    A local session that names none uses its warehouse folder; any other must name one.
    """
    named = spark.conf.get("varloom.scratch", None) or spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set varloom.scratch or spark.checkpoint.dir to a folder that all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; every call has its own, so no table is overwritten under a lazy reader."""
    return f"{shared_dir(spark)}/varloom/{uuid.uuid4().hex}-{name}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written once below the shared folder and read back: what follows reads it again without computing it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
