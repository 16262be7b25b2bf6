"""Expressions that parse channel labels and derive biology classes, attributes and clinical labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import catalogues as cat
from varloom.functions import sequence as seq


def channel_kind(c: Column) -> Column:
    """SBS96 / SBS1536 / DBS78 / ID83 / other from the shape of a channel label."""
    dbs_long = c.rlike("^[ACGT]{2}>[ACGT]{2}$") & (F.substring(c, 1, 2) != F.substring(c, 4, 2))
    dbs_short = c.rlike("^[ACGT]{4}$") & (F.substring(c, 1, 2) != F.substring(c, 3, 2))
    return (
        F.when(c.rlike(r"^[ACGT]\[[ACGT]>[ACGT]\][ACGT]$"), "SBS96")
        .when(c.rlike("^[ACGT]{2}[CT][ACGT]{3}$") & (F.substring(c, 3, 1) != F.substring(c, 6, 1)), "SBS1536")
        .when(dbs_long | dbs_short, "DBS78")
        .when(c.rlike("^(?i)(del|ins):[^:]*:[^:]*:") | c.rlike("^[^:]*:(?i)(del|ins):[^:]*:"), "ID83")
        .otherwise("other")
    )


def capped(tok: Column, cap: int) -> Column:
    """``5+`` and the like mean the cap; numbers are limited to 0..cap; anything else is the cap."""
    num = tok.try_cast("int")
    return (
        F.when(tok.endswith("+"), F.lit(cap))
        .when(num.isNull(), F.lit(cap))
        .otherwise(F.greatest(F.lit(0), F.least(num, F.lit(cap))))
    )


def sbs96_parts(c: Column) -> dict[str, Column]:
    return {
        "left": F.substring(c, 1, 1), "ref": F.substring(c, 3, 1),
        "alt": F.substring(c, 5, 1), "right": F.substring(c, 7, 1),
    }


def id83_parts(c: Column) -> dict[str, Column]:
    """(event, motif, length, aux) of both label orders: ``DEL:C:1:0`` and ``1:Del:C:0``."""
    bit = lambda i: F.split_part(c, F.lit(":"), F.lit(i))
    front = F.upper(bit(1)).isin("DEL", "INS")
    motif = F.upper(F.when(front, bit(2)).otherwise(bit(3)))
    motif = F.replace(F.replace(motif, F.lit("REPEATS"), F.lit("R")), F.lit("MH"), F.lit("M"))
    size = F.when(front, bit(3)).otherwise(bit(1))
    number = lambda t: F.when(t.endswith("+"), 5).when(t.rlike("^[0-9]+$"), t.try_cast("int")).otherwise(0)
    event = F.when(front, F.upper(bit(1))).when(F.lower(bit(2)) == "del", "DEL").otherwise("INS")
    return {"event": event, "motif": motif, "length": number(size), "aux": number(bit(4))}


def signal_class(channel: Column) -> Column:
    """Biology class of a prefixed channel (``SBS96:`` or ``ID83:``); other kinds are ``burden``."""
    body = F.split_part(channel, F.lit(":"), F.lit(2))
    s = sbs96_parts(body)
    i = id83_parts(F.regexp_replace(channel, "^ID83:", ""))
    sub = F.concat(s["ref"], F.lit(">"), s["alt"])
    sbs = (
        F.when((sub == "C>T") & (s["right"] == "G"), "SBS CpG C>T")
        .when(sub.isin("C>T", "C>G") & (s["left"] == "T") & s["right"].isin("A", "T"), "SBS APOBEC-like C>T/C>G")
        .when(sub == "C>A", "SBS C>A substitution")
        .otherwise(F.concat(F.lit("SBS "), sub, F.lit(" substitution")))
    )
    indel = (
        F.when(i["motif"].isin("M", "MH"), "ID microhomology")
        .when(i["motif"].isin("C", "T") & (i["aux"] >= 5), "ID homopolymer 5+")
        .when(i["motif"].isin("C", "T"), "ID homopolymer")
        .when(i["motif"] == "R", "ID repeat")
        .when(i["length"] >= 5, "ID length 5+")
        .otherwise(F.concat(F.lit("ID "), i["event"]))
    )
    return F.when(channel.startswith("SBS96:"), sbs).when(channel.startswith("ID83:"), indel).otherwise("burden")


CODING_TERMS = ["missense", "nonsense", "splice", "frame", "in_frame"]


def event_attributes(events: DataFrame) -> DataFrame:
    """Derived attributes of events that carry clean alleles, 20-base flanks and a density count.

    Needs ``ref_c, alt_c, modality, left, right, variant_class, density``.
    """
    pair = seq.trimmed_pair(F.col("ref_c"), F.col("alt_c"))
    events = events.withColumn("_pair", pair).withColumns(
        {"ref_payload": seq.pair_ref(F.col("_pair")), "alt_payload": seq.pair_alt(F.col("_pair"))}
    ).drop("_pair")
    centre = F.when(F.col("ref_c") != "", F.substring("ref_c", 1, 1)).otherwise("N")
    context = lambda k: F.concat(F.right("left", F.lit(k)), centre, F.substring("right", 1, k))
    near = F.concat(F.right("left", F.lit(10)), F.substring("right", 1, 10))
    coding = F.lower("variant_class").rlike("|".join(CODING_TERMS))
    is_id = F.col("modality") == "ID"
    out = events.withColumns(
        {
            "payload": F.when(F.length("ref_payload") >= F.length("alt_payload"), F.col("ref_payload")).otherwise(
                F.col("alt_payload")
            ),
            "event_class": F.when(~is_id, "other")
            .when(F.length("ref_payload") >= F.length("alt_payload"), "del")
            .otherwise("ins"),
            "context_3": context(1), "context_5": context(2), "context_7": context(3), "context_11": context(5),
            "local_gc": F.length(F.translate(near, "ATN", "")) / F.greatest(F.length(near), F.lit(1)),
            "gene_region": F.when(coding, "coding").otherwise("noncoding_or_silent"),
            "clustered": (F.col("density") >= 3).cast("int"),
        }
    )
    out = out.withColumns(
        {
            "payload_len": F.length("payload"),
            "homopolymer_len": seq.homopolymer_span(F.col("payload"), F.col("left"), F.col("right")),
            "microhomology_len": F.when(
                F.col("event_class") == "del", seq.boundary_microhomology(F.col("left"), F.col("right"))
            ).otherwise(0),
            "sbs96": F.when(
                F.col("modality") == "SBS",
                seq.sbs96(F.col("ref_c"), F.col("alt_c"), F.substring("context_5", 2, 1), F.substring("context_5", 4, 1)),
            ),
        }
    )
    indel = F.concat(
        F.col("event_class"),
        F.lit("_len"), seq.bin_index(F.col("payload_len"), [1, 2, 3, 4, 5, 10]).cast("string"),
        F.lit("_hp"), seq.bin_index(F.col("homopolymer_len"), [0, 1, 2, 3, 4, 5]).cast("string"),
        F.lit("_mh"), seq.bin_index(F.col("microhomology_len"), [0, 1, 2, 3, 4, 5]).cast("string"),
    )
    # a generated row: the long label is worked out once, and in a method of its own
    out = out.select("*", F.inline(F.array(F.struct(F.when(is_id, indel).otherwise("").alias("indel_class")))))
    return out.withColumn("motif_class", motif_class())


def motif_class() -> Column:
    """CpG / APOBEC-like / substitution / pair / indel-bin class; here APOBEC only asks for a T on the left."""
    c, alt = F.col("context_3"), F.col("alt_c")
    mid, l, r = F.substring(c, 2, 1), F.substring(c, 1, 1), F.substring(c, 3, 1)
    full = F.length(c) == 3
    return (
        F.when(F.col("modality") == "ID", F.col("indel_class"))
        .when(F.col("modality") == "DBS", F.concat(F.lit("DBS_"), F.col("ref_c"), F.lit(">"), alt))
        .when(full & (mid == "C") & (alt == "T") & (r == "G"), "CpG_CtoT")
        .when(full & (mid == "C") & alt.isin("G", "T") & (l == "T"), "APOBEC_like")
        .when((F.col("ref_c") != "") & (alt != ""), F.concat(F.lit("SBS_"), F.col("ref_c"), F.lit(">"), alt))
        .otherwise("OTHER")
    )


def agent_condition(c: Column) -> Column:
    label = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", "")), r"\s+", " "))
    return F.when(label == "", "Unknown").otherwise(label)


def agent_core(c: Column) -> Column:
    bare = F.trim(F.regexp_replace(agent_condition(c), r"(?i)\s*\+\s*H?S9\b", ""))
    return F.when(F.lower(c).contains("control"), "Control").otherwise(F.when(bare == "", "Unknown").otherwise(bare))


def damage_class_table(spark) -> DataFrame:
    rows = [(agent, name) for name, agents in cat.DAMAGE_CLASSES.items() for agent in agents]
    return spark.createDataFrame(rows, "agent_core string, damage_class string")


def attach_damage_class(treatments: DataFrame, agent: str = "agent_core") -> DataFrame:
    """Lookup by agent; controls and unknown agents have their own classes. The table has 78 rows."""
    known = damage_class_table(treatments.sparkSession).withColumnRenamed("agent_core", agent)
    return treatments.join(F.broadcast(known), agent, "left").withColumn(
        "damage_class",
        F.when(F.col(agent) == "Control", cat.CONTROL_CLASS).otherwise(F.coalesce("damage_class", F.lit(cat.OTHER_CLASS))),
    )


def burden_tier(n: Column) -> Column:
    return F.when(n < 100, "Low (<100)").when(n <= 1000, "Medium (100-1000)").otherwise("High (>1000)")


def subtype(er: Column, pr: Column, her2: Column) -> Column:
    neg = lambda c: F.coalesce(c == "Negative", F.lit(False))
    return (
        F.when(neg(er) & neg(pr) & neg(her2), "TNBC")
        .when(F.coalesce(er == "Positive", F.lit(False)), "ER+")
        .otherwise("Other")
    )


def vaf(alt_count: Column, depth: Column) -> Column:
    """Alternate fraction; zero depth gives null."""
    return F.try_divide(alt_count.cast("double"), depth.cast("double"))


def megabase_bin(chrom: Column, pos: Column, *, unknown: bool = False, width: int = 1_000_000) -> Column:
    """``<chrom>_mb<k>``; a missing position counts as 0, or as ``unknown_mb`` in the other variant."""
    k = F.floor(F.coalesce(pos, F.lit(0)) / width)
    label = F.concat(chrom, F.lit("_mb"), k.cast("string"))
    return F.when(pos.isNull(), F.lit("unknown_mb")).otherwise(label) if unknown else label
