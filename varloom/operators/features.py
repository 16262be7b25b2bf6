"""Per-sample features from long counts. Everything stays long; wide tables only at the model boundary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.evaluation.quantiles import quantiles
from varloom.functions import catalogues as cat
from varloom.functions import labels as lab
from varloom.functions import sequence as seq
from varloom.session import settle
from varloom.sources.reference import Reference, window_counts


def rows() -> Column:
    return F.count(F.lit(1))


def n_by(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias("n"))


def shares(counts: DataFrame, key: str = "patient", n: str = "n") -> DataFrame:
    """``n`` over the key's total (aggregate and join)."""
    total = counts.groupBy(key).agg(F.sum(n).alias("_t"))
    return counts.join(total, key).withColumn("p", F.try_divide(F.col(n).cast("double"), F.col("_t"))).fillna(0, ["p"]).drop("_t")


def modality_covariates(events: DataFrame) -> DataFrame:
    """log1p burdens and SBS/DBS/ID fractions per patient, zero-safe. Needs ``modality``."""
    c = lambda m: F.count_if(F.col("modality") == m)
    s = events.filter(F.col("modality") != "OTHER").groupBy("patient").agg(
        c("SBS").alias("sbs"), c("DBS").alias("dbs"), c("ID").alias("ids"), rows().alias("total")
    )
    frac = lambda k: F.coalesce(F.try_divide(F.col(k).cast("double"), F.col("total")), F.lit(0.0))
    return s.select(
        "patient", F.log1p("total").alias("log_total_burden"), frac("sbs").alias("fraction_sbs"),
        frac("dbs").alias("fraction_dbs"), frac("ids").alias("fraction_id"), F.log1p("sbs").alias("log_sbs"),
        F.log1p("dbs").alias("log_dbs"), F.log1p("ids").alias("log_id"),
    )


def composite_pivot(counts: DataFrame, columns: list[str], prefix: str, values: list[str]) -> DataFrame:
    """Long counts to columns ``prefix__a__b``; the value list is given, so no extra scan finds it."""
    name = F.concat_ws("__", F.lit(prefix), *columns)
    return counts.withColumn("_f", name).groupBy("patient").pivot("_f", values).sum("n").fillna(0)


def summary_of_counts(counts: DataFrame, *, n_features: Column | int, variant: str = "log1p") -> DataFrame:
    """Distribution summary per patient of a long count table (zeros absent).

    ``log1p`` uses log1p of the total and log(max(1, n)); ``log10`` uses log10(total+1) and log(max(n, 2)).
    """
    p = shares(counts.filter("n > 0"))
    order = Window.partitionBy("patient").orderBy(F.desc("p"), "feature")
    k = F.lit(n_features) if isinstance(n_features, int) else n_features
    ranked = p.withColumn("_k", F.row_number().over(order))
    s = ranked.groupBy("patient").agg(
        F.sum("n").alias("total"), rows().alias("nonzero_count"), F.sum(-F.col("p") * F.log("p")).alias("entropy"),
        F.sum(F.col("p") * F.col("p")).alias("simpson"), F.max("p").alias("max_fraction"),
        F.sum(F.when(F.col("_k") <= 5, F.col("p"))).alias("top5_fraction"),
        F.sum(F.when(F.col("_k") <= 10, F.col("p"))).alias("top10_fraction"),
    )
    top = F.log(F.greatest(F.lit(1 if variant == "log1p" else 2), k))
    return s.select(
        "patient",
        (F.log1p("total") if variant == "log1p" else F.log10(F.col("total") + 1)).alias("log_total"),
        "nonzero_count", (F.col("nonzero_count") / k).alias("nonzero_fraction"), "entropy",
        F.when(top > 0, F.col("entropy") / top).otherwise(0.0).alias("normalized_entropy"), "simpson",
        "max_fraction", "top5_fraction", "top10_fraction", (1 - F.col("top10_fraction")).alias("tail90_fraction"),
    )


def top_variance(counts: DataFrame, spine_size: DataFrame, n: int) -> DataFrame:
    """Names of the ``n`` features with the largest variance over the whole spine, zeros included.

    From sums only: var = (Σx² − (Σx)²/N) / (N−1). Equal variances are ordered by name.
    ``spine_size`` is one row with ``N``.
    """
    s = counts.groupBy("feature").agg(F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    big = F.col("N").cast("double")
    var = (F.col("s2") - F.col("s1") * F.col("s1") / big) / (big - 1)
    return (
        s.join(F.broadcast(spine_size)).select("feature", var.alias("variance"))
        .orderBy(F.round("variance", 9).desc(), "feature").limit(n)
    )


def keep_top(counts: DataFrame, top: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(top.select("feature")), "feature", "left_semi")


def locus_blocks(events: DataFrame, spine: DataFrame, *, bin_width: int, top: int) -> DataFrame:
    """Chromosome, chromosome x modality, variant class and top bins as ``(block, patient, feature, value)``,
    plus the density summary: one scan grouped by sets of keys."""
    chrom = seq.chrom_plain(F.col("chromosome"))
    base = events.select(
        "patient", chrom.alias("chrom"), seq.modality_of_type(F.col("variant_type")).alias("modality"),
        F.lower("variant_class").alias("variant_class"), lab.megabase_bin(chrom, F.col("pos"), width=bin_width).alias("mb_bin"),
    )
    entry = lambda block, feature: F.struct(F.lit(block).alias("block"), feature.alias("feature"))
    named = F.array(
        entry("locus_chrom", F.col("chrom")), entry("locus_chrom_modality", F.concat_ws("__", "chrom", "modality")),
        entry("locus_variant_class", F.col("variant_class")), entry("locus_mb", F.col("mb_bin")),
    )
    counts = base.select("patient", F.inline(named)).groupBy("patient", "block", "feature").agg(rows().alias("n"))
    mb = counts.filter("block = 'locus_mb'")
    size = spine.agg(rows().alias("N"))
    best = keep_top(mb, top_variance(mb, size, top)).withColumn("block", F.lit("locus_mb_top"))
    density = summary_of_counts(mb, n_features=1).drop("nonzero_fraction", "normalized_entropy")
    cols = [c for c in density.columns if c != "patient"]
    dens = density.select("patient", *[F.col(c).cast("double") for c in cols]).unpivot(["patient"], cols, "feature", "value")
    dens = dens.select("patient", F.lit("locus_mb_density").alias("block"), "feature", "value")
    whole = counts.filter("block <> 'locus_mb'").unionByName(best).withColumn("value", F.col("n").cast("double")).drop("n")
    return whole.unionByName(dens).join(spine.select("patient"), "patient", "left_semi")


def gene_blocks(events: DataFrame, sets: DataFrame) -> DataFrame:
    """All event annotation counts as ``(block, patient, feature, n)``.

    Events become one row per block they count in (an array of structs, exploded), so the table is
    scanned once; the gene-set blocks need the 1:N set join and are added from it.
    """
    base = events.select(
        "patient", seq.gene_name(F.col("gene")).alias("gene"), seq.token(F.col("variant_class")).alias("variant_class"),
        seq.token(F.col("variant_type")).alias("variant_type"), seq.token(F.col("impact")).alias("impact"),
    ).withColumn("damaging", F.col("variant_class").isin(cat.DAMAGING_CLASSES) | F.col("impact").isin("high", "moderate"))
    entry = lambda block, feature: F.struct(F.lit(block).alias("block"), feature.alias("feature"))
    if_damaging = lambda block, feature: F.when(F.col("damaging"), entry(block, feature))
    plain = F.array_compact(F.array(
        entry("gene", F.col("gene")), if_damaging("gene_damaging", F.col("gene")), entry("impact", F.col("impact")),
        entry("variant_class", F.col("variant_class")), entry("variant_type", F.col("variant_type")),
    ))
    in_sets = F.array_compact(F.array(
        entry("pathway", F.col("gene_set")), if_damaging("pathway_damaging", F.col("gene_set")),
        entry("pathway_impact", F.concat_ws("__", "gene_set", "impact")),
        entry("pathway_gene", F.concat_ws("__", "gene_set", "gene")),
    ))
    entries = base.select("patient", F.inline(plain)).unionByName(base.join(sets, "gene").select("patient", F.inline(in_sets)))
    return entries.groupBy("block", "patient", "feature").agg(rows().alias("n"))


def vaf_summary(events: DataFrame) -> DataFrame:
    """Mean, standard deviation (0 for one value), median, 90% quantile and tail fractions per patient."""
    v = events.select("patient", lab.vaf(F.col("t_alt_count"), F.col("t_depth")).alias("vaf")).filter("vaf IS NOT NULL")
    s = v.groupBy("patient").agg(
        F.avg("vaf").alias("vaf_mean"), F.coalesce(F.stddev_samp("vaf"), F.lit(0.0)).alias("vaf_std"),
        F.avg((F.col("vaf") >= 0.35).cast("double")).alias("vaf_high_fraction"),
        F.avg((F.col("vaf") <= 0.10).cast("double")).alias("vaf_low_fraction"),
    )
    return s.join(quantiles(v, ["patient"], "vaf", {"vaf_median": 0.5, "vaf_q90": 0.9}), "patient")


def numeric_summary(events: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, std, median, q90 per patient and numeric column, nulls dropped per column."""
    long = events.select("patient", *[F.col(c).cast("double") for c in columns]).unpivot(["patient"], columns, "name", "value").filter("value IS NOT NULL")
    s = long.groupBy("patient", "name").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return s.join(quantiles(long, ["patient", "name"], "value", {"median": 0.5, "q90": 0.9}), ["patient", "name"])


SUBSTITUTIONS = [f"{r}>{a}" for r, alts in (("C", "AGT"), ("T", "ACG")) for a in alts]


def biology_table(spark) -> DataFrame:
    """(channel, feature): which biology sums each of the 257 channels belongs to. A small dimension."""
    pairs = []
    for _, name, full in cat.universe():
        if full.startswith("SBS96:"):
            left, ref, alt, right = name[0], name[2], name[4], name[6]
            sub = f"{ref}>{alt}"
            gc = (left in "GC") + (right in "GC")
            feats = [f"sbs_substitution_{sub}", f"sbs_left_{left}", f"sbs_right_{right}", f"sbs_flank_gc_count_{gc}",
                     f"sbs_{sub}_left_{left}", f"sbs_{sub}_right_{right}"]
            feats += ["sbs_cpg_ct"] * (sub == "C>T" and right == "G")
            feats += ["sbs_apobec_like"] * (sub in ("C>T", "C>G") and left == "T" and right in "AT")
            feats += ["sbs_ca_total"] * (sub == "C>A")
        elif full.startswith("ID83:"):
            size, event, motif, aux = name.split(":")
            e, m, aux_n = event.lower(), motif.lower(), int(aux)
            long = size if size != "5" else "5plus"
            aux_l = aux if aux_n < 5 else "5plus"
            kind = {"C": "homopolymer", "T": "homopolymer", "M": "microhomology", "R": "repeat"}[motif]
            feats = [f"id_event_{e}", f"id_motif_{m}", f"id_length_{long}", f"id_{e}_length_{long}", f"id_{kind}_aux_{aux_l}", f"id_{e}_{m}"]
            feats += [f"id_{kind}_5plus"] * (aux_n >= 5 and kind != "repeat")
        else:
            feats = []
        pairs += [(full, f) for f in feats]
    return spark.createDataFrame(pairs, "channel string, feature string")


def biology_sums(channel_counts: DataFrame, totals: bool = False) -> DataFrame:
    """Sums of channels by biology class; the dimension has under 2,000 rows. ``totals``: also those of each kind, as ``total_`` and its name."""
    dim = biology_table(channel_counts.sparkSession)
    if totals:
        dim = dim.unionByName(dim.select("channel").distinct().withColumn("feature", F.concat(F.lit("total_"), F.split_part("channel", F.lit(":"), F.lit(1)))))
    dim = F.broadcast(dim)
    return channel_counts.join(dim, "channel").groupBy("patient", "feature").agg(F.sum("n").alias("value"))


def motif_ratios(channel_counts: DataFrame) -> DataFrame:
    """Parent sums over the modality's total, and two cross ratios smoothed by one.

    Counts are stored once and dealt by patient, who has at most one row a channel; sums and totals are made there.
    """
    sums = biology_sums(settle(channel_counts, "channel-counts").repartition("patient"), totals=True)
    kind = F.when(F.col("feature").startswith("sbs_"), "SBS96").when(F.col("feature").startswith("id_"), "ID83").otherwise(F.substring("feature", 7, 20))
    total = F.max(F.when(F.col("feature").startswith("total_"), F.col("value"))).over(Window.partitionBy("patient", "kind"))
    ratio = sums.filter(F.col("patient").isNotNull()).withColumn("kind", kind).withColumn("t", total).filter(~F.col("feature").startswith("total_")).select(
        "patient", F.concat(F.lit("ratio_"), "feature").alias("feature"), (F.col("value") / F.col("t")).alias("value")
    )
    of = lambda f: F.coalesce(F.sum(F.when(F.col("feature") == f, F.col("value"))), F.lit(0)) + 1
    cross = sums.groupBy("patient").agg(
        (of("sbs_cpg_ct") / of("sbs_apobec_like")).alias("ratio_cpg_to_apobec_plus1"),
        (of("id_microhomology_5plus") / of("id_homopolymer_5plus")).alias("ratio_id_mh_to_hp_plus1"),
    ).unpivot(["patient"], ["ratio_cpg_to_apobec_plus1", "ratio_id_mh_to_hp_plus1"], "feature", "value")
    return ratio.unionByName(cross)


def census(reference: Reference, d: int) -> DataFrame:
    """Mean flanking-base bits around every canonical trinucleotide, both strands.

    Words of ``2d+1`` bases are counted where the tiles are; strands are folded on the distinct words only.
    """
    windows = window_counts(reference, 2 * d + 1)
    centre = F.substring("w", d + 1, 1)
    canon = F.when(centre.isin("C", "T"), F.col("w")).otherwise(seq.revcomp(F.col("w")))
    counted = windows.groupBy(canon.alias("w")).agg(F.sum("n").alias("n"))
    key = F.substring("w", d, 3).alias("key")
    offsets = F.explode(F.sequence(F.lit(1), F.lit(d))).alias("offset")
    spread = counted.select(key, "n", "w", offsets).select(
        "key", "offset", "n", F.substring(F.col("w"), F.lit(d + 1) - F.col("offset"), F.lit(1)).alias("l"),
        F.substring(F.col("w"), F.lit(d + 1) + F.col("offset"), F.lit(1)).alias("r"),
    )
    mean = lambda c, bases: F.sum(F.when(F.col(c).isin(*bases), F.col("n")).otherwise(0)) / F.sum("n")
    return spread.groupBy("key", "offset").agg(
        mean("l", "CT").alias("lx"), mean("l", "AC").alias("ly"), mean("r", "CT").alias("rx"), mean("r", "AC").alias("ry"),
        F.sum("n").alias("n"),
    )


#: Vectors up to this many are broadcast.
BROADCAST_VECTORS = 200_000


def with_vectors(rows: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """``rows`` with the vectors of their ``vec_id``, dealt by ``key``: sums per key and dimension are made without moving the
    rows of single dimensions. ``rows`` has a key's vectors once each."""
    if vectors.limit(BROADCAST_VECTORS + 1).count() <= BROADCAST_VECTORS:
        return rows.repartition(key).join(F.broadcast(vectors), "vec_id")
    return rows.join(vectors, "vec_id").repartition(key)


def vector_sums(data: DataFrame, keys: list[str], vec: str, weight: str) -> DataFrame:
    """Σ weight·vec and Σ weight per key in long form ``(keys, dim, s, w)``; summed map-side per dimension."""
    return (
        data.select(*keys, F.col(weight).alias("_w"), F.posexplode(vec).alias("dim", "_v"))
        .groupBy(*keys, "dim").agg(F.sum(F.col("_w") * F.col("_v")).alias("s"), F.sum("_w").alias("w"))
    )


def weighted_mean(data: DataFrame, keys: list[str], vec: str, weight: str) -> DataFrame:
    return vector_sums(data, keys, vec, weight).select(
        *keys, "dim", F.when(F.col("w") > 1e-15, F.col("s") / F.col("w")).otherwise(0.0).alias("value")
    )


def standardised_basis(basis: DataFrame) -> DataFrame:
    """Basis ``(vec_id, z)``, one array a vector, population standard deviation, constant columns left at zero."""
    long = basis.select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    s = long.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    s = s.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "sd"))).alias("_s"))  # one row, as wide as a vector
    at = lambda i: F.get("_s", i)
    z = F.transform("embedding", lambda v, i: (v - at(i)["m"]) / F.when(at(i)["sd"] > 1e-12, at(i)["sd"]).otherwise(1.0))
    return basis.crossJoin(F.broadcast(s)).select("vec_id", z.alias("z"))


def moments(counts: DataFrame, basis: DataFrame) -> DataFrame:
    """Weighted mean, variance and third central moment per (sample, dim). ``counts``: sample, vec_id, n."""
    placed = with_vectors(shares(counts, "sample").select("sample", "vec_id", "p"), "sample", standardised_basis(basis))
    m = placed.select("sample", "p", F.posexplode("z").alias("dim", "z")).groupBy("sample", "dim").agg(
        F.sum(F.col("p") * F.col("z")).alias("mean"), F.sum(F.col("p") * F.col("z") ** 2).alias("s2"),
        F.sum(F.col("p") * F.col("z") ** 3).alias("s3"),
    )
    mu = F.col("mean")
    return m.select(
        "sample", "dim", "mean", F.greatest(F.col("s2") - mu * mu, F.lit(0.0)).alias("variance"),
        (F.col("s3") - 3 * mu * F.col("s2") + 2 * mu * mu * mu).alias("third"),
    )


def majority_purity(events: DataFrame, bin_col: str, target: str) -> DataFrame:
    """Share of events that carry their bin's most frequent value, and the number of bins."""
    n = n_by(events.filter(F.col(target).isNotNull()), bin_col, target)
    per = n.groupBy(bin_col).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return per.agg((F.sum("top") / F.sum("all")).alias("purity"), rows().alias("n_bins"), F.sum("all").alias("n_events"))


def collisions(vectors: DataFrame, key: str, vec: str, places: int = 10) -> DataFrame:
    """Members of groups with identical rounded vectors: one row per member with its group's smallest
    member and size (nothing is collected per group)."""
    rounded = vectors.select(key, F.array_join(F.transform(vec, lambda v: F.format_string("%." + str(places) + "f", F.round(v, places) + F.lit(0.0))), ",").alias("_v"))
    hashed = rounded.select(key, F.sha2("_v", 256).alias("_h"))
    groups = hashed.groupBy("_h").agg(F.min(key).alias("bucket"), rows().alias("size")).filter("size > 1")
    return hashed.join(groups, "_h").select("bucket", "size", key)


def driver_labels(events: DataFrame, spine: DataFrame, functional: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """0/1 per patient and gene group from functional events; one pass, one conditional maximum per group."""
    hit = F.col("variant_class").isin(functional)
    flags = [F.max((hit & F.upper("gene").isin(genes)).cast("int")).alias(name) for name, genes in groups.items()]
    return spine.select("patient").join(events.groupBy("patient").agg(*flags), "patient", "left").fillna(0)


def document_frequency(counts: DataFrame, spine: DataFrame) -> DataFrame:
    """Samples with the feature and the smoothed inverse frequency ``ln((1+N)/(1+df)) + 1``."""
    df = counts.filter("n > 0").groupBy("feature").agg(rows().alias("df"))
    size = F.broadcast(spine.agg(rows().alias("N")))
    return df.join(size).select("feature", "df", (F.log((1.0 + F.col("N")) / (1.0 + F.col("df"))) + 1).alias("idf"))
