"""Scan to encoded events: clean, classify, look up flanks, reject with a reason, label the channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import catalogues, sequence
from varloom.sources.reference import Reference, fetch_windows

REJECT_REASONS = [
    "invalid_or_other",
    "invalid_position",
    "fasta_ref_mismatch",
    "unresolved_context",
    "invalid_allele_after_canonicalization",
]


def classify(events: DataFrame) -> DataFrame:
    """Clean alleles, event class (declared SNP/DNP types win over lengths) and canonical alleles.

    ``body`` is the part of the channel label that needs no flanks: ``[C>T]`` for single
    substitutions, the whole label for pairs and indels, null outside the catalogue. It is computed
    here, before the reference lookup: a filter on the channel is pushed down to the lookup join by
    substitution, and what is already a column below the join is not repeated in it.
    """
    col = F.col
    ref, alt = sequence.clean_allele(col("ref")), sequence.clean_allele(col("alt"))
    kind = sequence.event_modality(col("ref_c"), col("alt_c"), col("variant_type"), snp_first=True)
    # a purine, or a pair that begins with one
    flip = F.concat("modality", "ref_c").rlike(r"^SBS[AG]\z|^DBS[AG]")
    # cleaned alleles are upper case
    strand = lambda c: F.when(col("flip"), F.reverse(F.translate(col(c), "ACGT", "TGCA"))).otherwise(col(c))
    pair = col("_change")
    body = (
        F.when(
            col("modality") == "SBS",
            F.when((F.length("cref") == 1) & (F.length("calt") == 1) & (col("cref") != col("calt")), F.concat(F.lit("["), pair, F.lit("]"))),
        )
        .when(col("modality") == "DBS", F.when(pair.isin(catalogues.DBS78), F.concat(F.lit("DBS78:"), pair)))
        .when(col("modality") == "ID", F.concat(F.lit("ID83:"), sequence.id83_plain(col("_pair"))))
    )
    return (
        events.withColumns({"ref_c": ref, "alt_c": alt})
        .withColumn("modality", kind)
        .withColumn("flip", flip)
        .withColumns({"cref": strand("ref_c"), "calt": strand("alt_c")})
        .withColumns({"_pair": sequence.trimmed_pair(col("cref"), col("calt")), "_change": F.concat("cref", F.lit(">"), "calt")})
        .withColumn("body", body)
        .drop("_pair", "_change")
    )


def attach_flanks(events: DataFrame, reference: Reference, d_context: int, longest: int | None = None) -> DataFrame:
    """``left``/``right`` flanks of ``d_context`` bases, the observed reference and whether it matches.

    A pure insertion has no reference base: its window is ``pos-d+1 .. pos+d`` and it always matches. ``longest`` says that no
    reference allele is longer.
    """
    d = d_context
    pure = F.col("_pure")
    span = F.greatest(F.lit(1), F.length("ref_c"))
    located = events.withColumn("_pure", (F.col("modality") == "ID") & (F.col("ref_c") == "")).withColumns(
        {
            "_contig": F.regexp_replace("chromosome", "^chr", "").cast("long"),
            "_start": F.when(pure, F.col("pos") - d + 1).otherwise(F.col("pos") - d),
            "_length": F.when(pure, F.lit(2 * d)).otherwise(span + 2 * d).cast("long"),
        }
    )
    # cleaning an allele only shortens it
    bound = F.greatest(F.lit(1), F.length("ref")) + 2 * d
    found = fetch_windows(located, reference, contig="_contig", start="_start", length="_length", bound=bound, longest=None if longest is None else max(1, longest) + 2 * d)
    observed = F.when(pure, F.lit("")).otherwise(F.substring("window", F.lit(d + 1), span))
    return (
        found.withColumns(
            {
                "left": F.substring("window", 1, d),
                "right": F.substring("window", -d, d),
                "observed": observed,
            }
        )
        .withColumn(
            "ref_ok", pure | ((F.col("ref_c") != "") & (F.col("observed") == F.col("ref_c")))
        )
        .drop("_contig", "_start", "_length", "_pure", "window")
    )


def reject_reason() -> Column:
    """The first failing check, in order; null for accepted events."""
    return (
        F.when((F.col("modality") == "OTHER") | (F.col("alt_c") == ""), REJECT_REASONS[0])
        .when(F.col("pos").isNull(), REJECT_REASONS[1])
        .when(~F.col("ref_ok"), REJECT_REASONS[2])
        .when(F.concat("left", "right").contains("N"), REJECT_REASONS[3])
        .when(F.concat("ref_c", "alt_c").rlike("[^ACGT]"), REJECT_REASONS[4])
    )


def channel_label() -> Column:
    """Prefixed channel: the body, with the flanking bases of the canonical strand around it for SBS."""
    before, after = F.substring("left", -1, 1), F.substring("right", 1, 1)
    comp = lambda c: F.translate(c, "ACGT", "TGCA")
    return F.when(
        F.col("modality") == "SBS",
        F.concat(
            F.lit("SBS96:"), F.when(F.col("flip"), comp(after)).otherwise(before), F.col("body"),
            F.when(F.col("flip"), comp(before)).otherwise(after),
        ),
    ).otherwise(F.col("body"))


def encode_events(events: DataFrame, reference: Reference, *, d_context: int = 12, longest: int | None = None) -> DataFrame:
    """All events with ``reject_reason`` and, for accepted ones, canonical flanks, alleles and channel.

    The verdict is a generated row: a filter on it stays above and does not repeat the lookup and all checks by substitution.
    """
    # generated rows, too, end a stage's generated method: each part stays below what the JVM compiles
    made = classify(events)
    new = [c for c in made.columns if c not in events.columns]
    classified = made.select(*events.columns, F.inline(F.array(F.struct(*new))))
    flanked = attach_flanks(classified, reference, d_context, longest)
    strand = lambda a, b: F.when(F.col("flip"), sequence.revcomp(F.col(a))).otherwise(F.col(b))
    judged = flanked.withColumn("_reject", reject_reason()).withColumn("_channel", F.when(F.col("_reject").isNull(), channel_label()))
    verdict = F.array(F.struct(F.col("_reject").alias("reject_reason"), F.col("_channel").alias("channel")))
    judged = judged.select(*flanked.columns, strand("right", "left").alias("cleft"), strand("left", "right").alias("cright"), F.inline(verdict))
    return judged.select(*flanked.columns, "reject_reason", "cleft", "cright", "channel")


def accepted(encoded: DataFrame) -> DataFrame:
    return encoded.filter(F.col("reject_reason").isNull())
