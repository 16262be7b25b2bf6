"""Typed readers for the file shapes mutation studies come in, and the writers of their test copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAF_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("patient", T.StringType()),
        T.StructField("chromosome", T.StringType()), T.StructField("pos", T.LongType()),
        T.StructField("variant_type", T.StringType()), T.StructField("gene", T.StringType()),
        T.StructField("variant_class", T.StringType()), T.StructField("impact", T.StringType()),
        T.StructField("t_depth", T.LongType()), T.StructField("t_alt_count", T.LongType()),
        T.StructField("barcode", T.StringType()),
    ]
)


def all_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def read_maf(spark: SparkSession, path: str, schema: T.StructType = MAF_SCHEMA, *, columns: list[str]) -> DataFrame:
    """Tab-separated events read as strings, a column subset, numbers cast by hand (bad ones null).

    A compressed text file is one task however large: land it once as parquet and scan that.
    """
    raw = spark.read.csv(path, sep="\t", header=True, schema=all_strings(schema))
    kinds = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[F.col(c).try_cast(kinds[c]).alias(c) if kinds[c] != T.StringType() else F.col(c) for c in columns])


def read_maf_strict(spark: SparkSession, path: str, schema: T.StructType = MAF_SCHEMA) -> DataFrame:
    """Whole-file read that skips malformed lines."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="DROPMALFORMED", enforceSchema=True)


def read_commented(spark: SparkSession, path: str, schema: T.StructType, *, preamble: str | None = None) -> DataFrame:
    """Tab-separated text with ``#`` comment lines, Latin-1; rows that repeat a preamble mark are dropped."""
    df = spark.read.csv(path, sep="\t", schema=schema, comment="#", encoding="ISO-8859-1")
    return df.filter(~F.col(schema.fields[0].name).rlike(preamble)) if preamble else df


def read_matrix(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A wide per-sample matrix: key as string, missing numbers as zero."""
    return spark.read.parquet(path).withColumn(key, F.col(key).cast("string")).fillna(0)


def unpivot_wide(wide: DataFrame, *, prefix: str, name: str, value: str) -> DataFrame:
    """Row-key by column-entity matrix to long; the key column is ``NAME`` or ``Type``."""
    key = "NAME" if "NAME" in wide.columns else "Type"
    cols = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot([key], cols, name, value).withColumnRenamed(key, "key")


def nonzero_signatures(long: DataFrame) -> DataFrame:
    """Catalogue rows of signatures whose probabilities sum to more than zero."""
    keep = long.groupBy("signature").agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("s")).filter("s > 0")
    return long.join(keep.select("signature"), "signature", "left_semi")


def normalised(long: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` divided by its total per key, zero when the total is zero.

    The totals are aggregated and joined: a window would put a whole key in one task.
    """
    total = long.groupBy(key).agg(F.sum(value).alias("_total"))
    share = F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(0.0)
    return long.join(total, key).withColumn(value, share).drop("_total")


def truth_shares(wide: DataFrame, signatures: DataFrame, *, prefix: str) -> DataFrame:
    """Contribution table to shares over a signature list: the first word of the row name is the signature."""
    long = unpivot_wide(wide, prefix=prefix, name="sample", value="n").select(
        F.split_part("key", F.lit(" "), F.lit(1)).alias("signature"), "sample", "n"
    )
    grid = signatures.select("signature").distinct().crossJoin(long.select("sample").distinct())
    full = grid.join(long, ["signature", "sample"], "left").fillna(0, ["n"])
    return normalised(full.withColumn("n", F.col("n").cast("double")), "sample", "n")


def treatment_map(spark: SparkSession, path: str) -> DataFrame:
    """``sample<TAB>treatment`` lines out of free text."""
    line = F.col("value")
    return (
        spark.read.text(path)
        .filter(line.rlike(r"^MSM0\.\d+\t"))
        .select(
            F.trim(F.split_part(line, F.lit("\t"), F.lit(1))).alias("sample_name"),
            F.trim(F.regexp_replace(line, r"^[^\t]*\t", "")).alias("treatment"),
        )
    )


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key, as an aggregate: one hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def scenario_rows(spark: SparkSession, glob: str) -> DataFrame:
    """Parquet below ``scenario_<n>`` folders with the scenario number taken from the file name."""
    n = F.regexp_extract(F.input_file_name(), r"scenario_(\d+)", 1).cast("long")
    return spark.read.parquet(glob).withColumn("scenario", n)


def truncate_blocks(vec: Column, depth: int) -> Column:
    """The first ``depth`` entries of each of four equal blocks."""
    block = (F.size(vec) / 4).cast("int")
    parts = [F.slice(vec, block * i + 1, F.lit(depth)) for i in range(4)]
    return F.concat(*parts)


def atlas(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """JSON maps ``key -> vector`` to rows, blocks truncated; a vector that is not four blocks of at
    least ``depth`` entries fails the query."""
    rows = spark.read.text(path).select(
        F.explode(F.from_json("value", "map<string,array<double>>")).alias("key", "vec")
    )
    bad = (F.size("vec") % 4 != 0) | (F.size("vec") < 4 * depth)
    return rows.select(
        "key", F.when(bad, F.raise_error(F.lit("context vector does not hold four blocks of that depth")).cast("array<double>")).otherwise(truncate_blocks(F.col("vec"), depth)).alias("vec")
    )


def union_results(frames: dict[str, DataFrame]) -> DataFrame:
    """Result tables with differing columns, tagged with their source."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
