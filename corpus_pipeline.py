"""A training corpus from the table of documents: five stages, each written as Parquet and read again by the next.

Stages number the rows of their stored input, so repeated ids stay apart and each decision hits one row. Rows to drop or to
change are written first; where they are few, Spark broadcasts them by their known size, else it joins by shuffling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import op1_decontamination, op2_jaccard, op3_secrets, op7_packing, op9_language
from varloom.llm.registry import table
from varloom.llm.sampling import remainder
from varloom.llm.store import materialise

MASK = "[secret]"
#: Near duplicates: words of an n-gram, and least Jaccard similarity in percent.
NEAR = {"k": 4, "percent": 85}


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number; ``docs`` must read a stored table, whose rows then get the same numbers each time."""
    return docs.withColumn("__row", F.monotonically_increasing_id())


def as_documents(rows: DataFrame) -> DataFrame:
    """The row numbers as ids, and the texts."""
    return rows.select(F.col("__row").alias("doc_id"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language (null, or no letter) and those between two languages."""
    model = op9_language.fit(docs.where(remainder(5) != 0))
    plain = docs.toDF(*[c if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)])
    found = op9_language.identify(plain, model)
    rejected = F.col("ambiguous") | (F.col("lang_pred") == "und") if model.languages else F.lit(False)
    return found.where(~rejected).select(*[F.col(f"`{c}`") for c in plain.columns]).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of similar documents."""
    rows = numbered(docs)
    groups = op2_jaccard.jaccard_components(as_documents(rows), **NEAR).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component"))
    groups = groups.join(rows.select("__row", F.col("doc_id").alias("id")), "__row")
    groups = materialise(groups, "groups")
    first = groups.groupBy("component").agg(F.min_by("__row", F.struct(F.col("id").isNull(), "id", "__row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = materialise(groups.join(first, "component").where("__row <> first").select("__row"), "copies")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    rows = numbered(docs)
    found = op1_decontamination.decontaminate(as_documents(rows), table(spark, sf_dir, "benchmark"))
    gone = materialise(found.where("n_hit > 0").select(F.col("doc_id").alias("__row")), "contaminated")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted ``spans`` replaced; overlapping spans are one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)).cast("int"))
        new = F.when(x["s"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), new.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; ``n_chars`` follows the text."""
    rows = numbered(docs)
    found = op3_secrets.secrets(as_documents(rows)).where(F.size("spans") > 0)
    found = materialise(found.select(F.col("doc_id").alias("__row"), F.col("spans").alias("__spans")), "secrets")
    out = rows.join(found, "__row", "left")
    out = out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return op7_packing.pack_documents(docs, op7_packing.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("packing", packing),
]

#: Trained models, component search and a tokenizer are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
