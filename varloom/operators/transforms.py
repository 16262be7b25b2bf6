"""Count transforms, interactions, stacks and pooling on long features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import features as ft
from varloom.operators.windows import rank_pct


def count_transforms(counts: DataFrame, spine: DataFrame) -> DataFrame:
    """raw, binary, log1p, sqrt, fraction, log_fraction, tfidf and rank of ``patient, feature, n``."""
    idf = ft.document_frequency(counts, spine).select("feature", "idf")
    ranked = rank_pct(ft.shares(counts)).withColumnRenamed("rank_pct", "rank")
    n = F.col("n")
    return ranked.join(F.broadcast(idf), "feature").select(
        "patient", "feature", n.alias("raw"), (n > 0).cast("int").alias("binary"), F.log1p(n).alias("log1p"), F.sqrt(n).alias("sqrt"),
        F.col("p").alias("fraction"), F.log1p("p").alias("log_fraction"), (n * F.col("idf")).alias("tfidf"), "rank",
    )


def presence_product(a: DataFrame, b: DataFrame, left: str, right: str, prefix: str) -> DataFrame:
    """Pairs of features present in the same patient; both sides are distinct feature sets."""
    name = F.concat_ws("__", F.lit(prefix), left, right)
    return a.join(b, "patient").select("patient", name.alias("feature"), F.lit(1.0).alias("value"))


def presence_times(a: DataFrame, b: DataFrame, left: str, value: str, prefix: str) -> DataFrame:
    return a.join(b, "patient").select("patient", F.concat_ws("__", F.lit(prefix), left).alias("feature"), F.col(value).alias("value"))


def candidate_stack(blocks: DataFrame, specs: dict[str, list[str]], identity: str = "identity") -> DataFrame:
    """Named combinations of blocks in long form; models called ``maf_only_*`` leave the identity block out."""
    rows = [(m, b) for m, bs in specs.items() for b in ([] if m.startswith("maf_only_") else [identity]) + bs]
    spec = blocks.sparkSession.createDataFrame(rows, "model_id string, block string")
    return blocks.join(F.broadcast(spec), "block").select("model_id", "patient", F.concat_ws("__", "block", "feature").alias("feature"), F.col("n").alias("value"))


def _with_fractions(counts: DataFrame) -> DataFrame:
    by = counts.groupBy("patient", "modality").agg(F.sum("n").alias("tm"))
    total = by.groupBy("patient").agg(F.sum("tm").alias("t"))
    return counts.join(by.join(total, "patient"), ["patient", "modality"]).withColumns(
        {"p": F.col("n") / F.col("tm"), "f": F.col("tm") / F.col("t")}
    )


def block_stack(counts: DataFrame) -> DataFrame:
    """Modality profiles next to each other, each weighted by its share of the burden."""
    return _with_fractions(counts).select("patient", "modality", "channel", (F.col("p") * F.col("f")).alias("value"))


def feature_modes(counts: DataFrame) -> DataFrame:
    """weighted, weighted_frac and unweighted_frac pooling of modality profiles, one scan of the shares."""
    q = _with_fractions(counts)
    name = F.concat_ws("__", "modality", "feature")
    e = lambda mode, v: F.struct(F.lit(mode).alias("mode"), name.alias("feature"), v.alias("value"))
    w, u = F.col("p") * F.col("f"), F.col("p")
    body = q.select("patient", F.inline(F.array(e("weighted", w), e("weighted_frac", w), e("unweighted_frac", u))))
    frac = q.select("patient", "modality", "f").distinct().select(
        F.explode(F.array(F.lit("weighted_frac"), F.lit("unweighted_frac"))).alias("mode"), "patient",
        F.concat(F.lit("fraction_"), "modality").alias("feature"), F.col("f").alias("value"),
    )
    return body.unionByName(frac)


def standardise(counts: DataFrame, spine: DataFrame) -> DataFrame:
    """z-scores per feature over the whole spine (absent = 0), population standard deviation."""
    s = counts.groupBy("feature").agg(F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    s = s.join(F.broadcast(spine.agg(F.count(F.lit(1)).alias("N")))).select(
        "feature", (F.col("s1") / F.col("N")).alias("m"), F.sqrt(F.greatest(F.col("s2") / F.col("N") - (F.col("s1") / F.col("N")) ** 2, F.lit(0.0))).alias("sd")
    )
    full = spine.select("patient", F.lit(1).alias("j")).join(F.broadcast(s.withColumn("j", F.lit(1))), "j").drop("j")
    z = (F.coalesce("n", F.lit(0)) - F.col("m")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return full.join(counts, ["patient", "feature"], "left").select("patient", "feature", z.alias("z"))
