"""Column expressions for alleles, chromosomes and channel labels.

Everything here is a ``Column -> Column`` function of built-in expressions, so a scan
that uses them stays inside one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "no allele". All but one lose every letter when other letters than bases are removed.
NULL_ALLELES = ["", "-", ".", "NAN", "NONE"]
NULL_TOKENS = ["", "nan", "none"]
NULL_GENES = ["", "NAN", "NONE", "UNKNOWN"]
CLINICAL_MISSING = ["[Not Available]", "[Not Evaluated]", "[Performed but Not Available]", "[Discrepancy]"]


def clean_allele(c: Column) -> Column:
    """Bases of an allele; nothing for the tokens that mean none. The input is mentioned once, which keeps generated methods short."""
    up = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.regexp_replace(up, r"^NAN\z|[^ACGT]", "")


def chrom_plain(c: Column) -> Column:
    """``chr`` and leading zeros removed; nothing left means ``0``."""
    bare = F.upper(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("nan")), "chr|CHR", "")))
    bare = F.when(bare.isin("", "NAN"), F.lit("0")).otherwise(F.ltrim(bare, F.lit("0")))
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def chrom_alias(c: Column) -> Column:
    """``chr`` removed and numeric sex/mitochondrial codes named."""
    bare = F.replace(F.upper(c.cast("string")), F.lit("CHR"), F.lit(""))
    return (
        F.when(bare == "23", "X").when(bare == "24", "Y").when(bare.isin("25", "M"), "MT").otherwise(bare)
    )


def chrom_density(c: Column) -> Column:
    """Leading ``chr`` in any case and leading zeros removed (may end up empty)."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, "^(?i)chr", ""), "^0+", ""))


def revcomp(c: Column) -> Column:
    return F.reverse(F.translate(F.upper(c), "ACGTN", "TGCAN"))


def choose_alt(ref: Column, allele1: Column, allele2: Column, *, require_bases: bool) -> Column:
    """The tumour allele: allele 2 if it differs from the reference, else allele 1, else allele 2.

    ``require_bases`` is the stricter variant that also skips empty alleles.
    Inputs are already cleaned.
    """
    differs2, differs1 = allele2 != ref, allele1 != ref
    if require_bases:
        differs2, differs1 = differs2 & (allele2 != ""), differs1 & (allele1 != "")
    return F.when(differs2, allele2).when(differs1, allele1).otherwise(allele2)


def event_modality(ref: Column, alt: Column, declared: Column, *, snp_first: bool) -> Column:
    """SBS / DBS / ID / OTHER from the declared type and allele lengths.

    The two precedences in use differ for declared indels with equal allele lengths.
    """
    kind = F.upper(F.coalesce(declared, F.lit("")))
    n, m = F.length(ref), F.length(alt)
    single, double = (n == 1) & (m == 1), (n == 2) & (m == 2)
    indel = kind.isin("INS", "DEL") | (n != m)
    if snp_first:
        return (
            F.when(kind.isin("SNP", "SNV") | single, "SBS")
            .when((kind == "DNP") | double, "DBS")
            .when(indel, "ID")
            .otherwise("OTHER")
        )
    return F.when(indel, "ID").when(single, "SBS").when(double, "DBS").otherwise("OTHER")


def modality_of_type(declared: Column) -> Column:
    kind = F.upper(F.trim(declared))
    return (
        F.when(kind.isin("SNP", "SNV"), "SBS")
        .when(kind.isin("DNP", "TNP", "ONP"), "DBS")
        .when(kind.isin("INS", "DEL"), "ID")
        .otherwise("OTHER")
    )


def token(c: Column, fallback: str = "unknown") -> Column:
    low = F.trim(F.lower(F.coalesce(c.cast("string"), F.lit(""))))
    low = F.when(low.isin(NULL_TOKENS), F.lit(fallback)).otherwise(low)
    out = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def gene_name(c: Column) -> Column:
    up = F.trim(F.upper(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(up.isin(NULL_GENES), "UNKNOWN").otherwise(F.replace(up, F.lit(" "), F.lit("_")))


def trimmed_pair(ref: Column, alt: Column) -> Column:
    """``ref|alt`` after removing the shared prefix and then the shared suffix.

    Two back-reference replacements (greedy prefix, then shortest head so the suffix is longest), each
    mentioning its input once: a filter on anything derived from it is pushed through projections
    by substitution, and repeated mentions would multiply.
    """
    pair = F.concat(ref, F.lit("|"), alt)
    pair = F.regexp_replace(pair, r"^([^|]*)([^|]*)\|\1", "$2|")
    return F.regexp_replace(pair, r"^([^|]*?)([^|]*)\|([^|]*)\2$", "$1|$3")


def pair_ref(pair: Column) -> Column:
    return F.split_part(pair, F.lit("|"), F.lit(1))


def pair_alt(pair: Column) -> Column:
    return F.split_part(pair, F.lit("|"), F.lit(2))


def purine_start(ref: Column) -> Column:
    return F.substring(ref, 1, 1).isin("A", "G")


def sbs96(ref: Column, alt: Column, left: Column, right: Column) -> Column:
    """``L[R>A]R`` on the pyrimidine strand; null unless all four are single bases and ref <> alt."""
    ok = ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & left.rlike("^[ACGT]$") & right.rlike("^[ACGT]$")
    flip = ref.isin("A", "G")
    plus = F.concat(left, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), right)
    minus = F.concat(
        revcomp(right), F.lit("["), revcomp(ref), F.lit(">"), revcomp(alt), F.lit("]"), revcomp(left)
    )
    return F.when(ok & (ref != alt), F.when(flip, minus).otherwise(plus))


def sbs96_from_11mer(ref: Column, alt: Column, context: Column) -> Column:
    """Same label from an 11-base context column (centre at 6); ref = alt is allowed here."""
    left, right = F.upper(F.substring(context, 5, 1)), F.upper(F.substring(context, 7, 1))
    ref, alt = F.upper(ref), F.upper(alt)
    ok = (
        (F.length(context) == 11)
        & ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & left.rlike("^[ACGT]$") & right.rlike("^[ACGT]$")
    )
    plus = F.concat(left, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), right)
    minus = F.concat(
        revcomp(right), F.lit("["), revcomp(ref), F.lit(">"), revcomp(alt), F.lit("]"), revcomp(left)
    )
    return F.when(ok, F.when(ref.isin("C", "T"), plus).otherwise(minus))


def id83_plain(pair: Column) -> Column:
    """Indel channel from a trimmed ``ref|alt`` pair; this variant always reports repeat 0.

    Every label it can produce is in the catalogue.
    """
    gap = F.locate("|", pair) * 2 - 1 - F.length(pair)  # reference minus alternate length
    payload = F.split_part(pair, F.lit("|"), F.when(gap > 0, 1).otherwise(2))
    event = F.when(gap > 0, ":Del:").otherwise(":Ins:")
    size = F.least(F.greatest(F.lit(1), F.length(payload)), F.lit(5)).cast("string")
    # single bases are reported by their pyrimidine; G pairs with C and A with T; no base counts as C
    base = F.translate(F.substring(F.concat(payload, F.lit("C")), 1, 1), "AG", "TC")
    kind = F.when(F.length(payload) <= 1, base).otherwise("R")
    return F.when(gap != 0, F.concat(size, event, kind, F.lit(":0")))


def id83_annotated(kind: Column, length: Column, repeats: Column, label: Column, change: Column) -> Column:
    """Indel channel from annotated columns (type, length, repeat count, classification, base change)."""
    low = F.lower(F.trim(kind))
    event = F.when(low.startswith("del"), "Del").when(low.startswith("ins"), "Ins")
    size = F.least(F.greatest(F.lit(1), F.coalesce(length, F.lit(1))), F.lit(5))
    rep = F.least(F.greatest(F.lit(0), F.coalesce(repeats, F.lit(0))), F.lit(5))
    cleaned = clean_allele(change)
    base = F.when(F.substring(cleaned, 1, 1).isin("C", "T"), F.substring(cleaned, 1, 1)).otherwise("C")
    micro = (event == "Del") & F.lower(F.coalesce(label, F.lit(""))).contains("microhomology") & (size >= 2)
    s, r = size.cast("string"), rep.cast("string")
    return (
        F.when(event.isNull(), F.lit(None).cast("string"))
        .when(micro, F.concat(s, F.lit(":Del:M:"), F.greatest(F.lit(1), rep).cast("string")))
        .when(size == 1, F.concat(F.lit("1:"), event, F.lit(":"), base, F.lit(":"), r))
        .otherwise(F.concat(s, F.lit(":"), event, F.lit(":R:"), r))
    )


def leading_run(seq: Column, base: Column) -> Column:
    return F.length(seq) - F.length(F.ltrim(seq, base))


def trailing_run(seq: Column, base: Column) -> Column:
    return F.length(seq) - F.length(F.rtrim(seq, base))


def homopolymer_span(payload: Column, left: Column, right: Column) -> Column:
    """Payload of one repeated base plus the runs of that base that touch it; 0 otherwise."""
    base = F.substring(payload, 1, 1)
    uniform = (payload != "") & (F.ltrim(payload, base) == "")
    return F.when(uniform, F.length(payload) + trailing_run(left, base) + leading_run(right, base)).otherwise(0)


def boundary_microhomology(left: Column, right: Column, longest: int = 20) -> Column:
    """Longest suffix of ``left`` that is a prefix of ``right`` (at most ``longest`` bases)."""
    joined = F.concat(F.right(left, F.lit(longest)), F.lit("|"), right)
    return F.length(F.regexp_extract(joined, r"([^|]*)\|\1", 1))


def bin_index(value: Column, edges: list[float]) -> Column:
    """Index of the first edge that is not exceeded; ``len(edges)`` beyond the last."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(value <= edges[i], F.lit(i)).otherwise(out)
    return out
