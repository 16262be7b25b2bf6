"""Bit-string encoders of bases, contexts, payloads and whole events.

A binary vector is a string of ``0``/``1``: built by ``translate``/``replace``/``rpad`` inside
generated code, compact to shuffle and usable as a grouping key. ``to_array`` turns it into an array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base -> (x, y): A=(0,1) C=(1,1) G=(0,0) T=(1,0) N=(0,0)
X_BITS, Y_BITS = "01010", "11000"
PAYLOAD_ALIASES = {
    "bits": "legacy", "zero": "legacy", "legacy_zero": "legacy", "legacy": "legacy",
    "presence": "masked", "presence_mask": "masked", "mask": "masked", "masked": "masked",
    "block_length": "length", "length_code": "length", "length_coded": "length", "length": "length",
}


def x_bits(seq: Column, d: int) -> Column:
    return F.rpad(F.translate(F.substring(seq, 1, d), "ACGTN", X_BITS), d, "0")


def y_bits(seq: Column, d: int) -> Column:
    return F.rpad(F.translate(F.substring(seq, 1, d), "ACGTN", Y_BITS), d, "0")


def context_blocks(left: Column, right: Column, d: int) -> tuple[Column, Column]:
    """(left block, right block); the left flank is walked outward from the variant."""
    out = F.reverse(left)
    return F.concat(x_bits(out, d), y_bits(out, d)), F.concat(x_bits(right, d), y_bits(right, d))


def length_bits(d: int) -> int:
    return math.ceil(math.log2(d + 2))


def payload_dim(d: int, schema: str) -> int:
    kind = PAYLOAD_ALIASES[schema.lower().replace("-", "_")]
    return {"legacy": 2 * d, "masked": 3 * d, "length": 2 * d + length_bits(d)}[kind]


def payload_block(seq: Column, d: int, schema: str = "masked") -> Column:
    """[X, Y], [X, Y, mask] or [X, Y, length code]; code d+1 marks a longer payload.

    ``legacy`` has no absence mark: missing bases look like G.
    """
    kind = PAYLOAD_ALIASES[schema.lower().replace("-", "_")]
    bits = F.concat(x_bits(seq, d), y_bits(seq, d))
    if kind == "legacy":
        return bits
    if kind == "masked":
        return F.concat(bits, F.rpad(F.repeat(F.lit("1"), F.least(F.length(seq), F.lit(d))), d, "0"))
    return F.concat(bits, F.lpad(F.bin(F.least(F.length(seq), F.lit(d + 1))), length_bits(d), "0"))


def event_vector(left: Column, right: Column, ref_payload: Column, alt_payload: Column, d: int, dp: int, schema: str = "masked") -> Column:
    """[left context, reference payload, right context, alternate payload]."""
    lb, rb = context_blocks(left, right, d)
    return F.concat(lb, payload_block(ref_payload, dp, schema), rb, payload_block(alt_payload, dp, schema))


def context_slice(vec: Column, d: int, dp: int, schema: str = "masked") -> Column:
    return F.concat(F.substring(vec, 1, 2 * d), F.substring(vec, 2 * d + payload_dim(dp, schema) + 1, 2 * d))


def _pairs_to_bases(x: Column, y: Column, d: int) -> Column:
    """Bases of two bit strings: x=0,y=1 is A; 1,1 C; 0,0 G; 1,0 T."""
    pick = lambda i: F.translate(
        (F.substring(x, i, 1).cast("int") * 2 + F.substring(y, i, 1).cast("int")).cast("string"), "0123", "GATC"
    )
    return F.concat(*[pick(i) for i in range(1, d + 1)])


def decode_masked(block: Column, d: int) -> Column:
    bases = _pairs_to_bases(F.substring(block, 1, d), F.substring(block, d + 1, d), d)
    present = F.length(F.replace(F.substring(block, 2 * d + 1, d), F.lit("0"), F.lit("")))
    return F.substring(bases, F.lit(1), present)


def decode_length(block: Column, d: int) -> tuple[Column, Column]:
    """(bases, overflow flag)"""
    bases = _pairs_to_bases(F.substring(block, 1, d), F.substring(block, d + 1, d), d)
    code = F.conv(F.substring(block, 2 * d + 1, length_bits(d)), 2, 10).cast("int")
    return F.substring(bases, F.lit(1), F.least(code, F.lit(d))), code == d + 1


def _spread(seq: Column, codes: dict[str, str]) -> Column:
    out = seq
    for base, code in codes.items():
        out = F.replace(out, F.lit(base), F.lit(code))
    return out


ONE_HOT4 = {"A": "1000", "C": "0100", "G": "0010", "T": "0001", "N": "0000"}
ONE_HOT5 = {"A": "10001", "C": "01001", "G": "00101", "T": "00011"}


def one_hot_event(left: Column, right: Column, ref: Column, alt: Column, d: int = 12, dp: int = 8) -> Column:
    """4·2d context bits, 5·2dp payload bits with presence, and 2 overflow bits: 8d + 10dp + 2."""
    flank = lambda s: F.rpad(_spread(s, ONE_HOT4), 4 * d, "0")
    load = lambda s: F.rpad(_spread(F.substring(s, 1, dp), ONE_HOT5), 5 * dp, "0")
    over = lambda s: F.when(F.length(s) > dp, "1").otherwise("0")
    return F.concat(
        flank(F.right(left, F.lit(d))), flank(F.substring(right, 1, d)), load(ref), load(alt), over(ref), over(alt)
    )


def event_code(left: Column, right: Column, ref: Column, alt: Column, d: int = 12, dp: int = 8) -> Column:
    """What ``one_hot_event`` shows of an event, spelled: both flanks and alleles, ``+`` behind a longer allele. Events of plain
    bases and full flanks have equal codes where they have equal bits; a code is a sixth as long."""
    cut = lambda s: F.when(F.length(s) > dp, F.concat(F.substring(s, 1, dp), F.lit("+"))).otherwise(s)
    return F.concat(F.right(left, F.lit(d)), F.lit("|"), F.substring(right, 1, d), F.lit("|"), cut(ref), F.lit("|"), cut(alt))


def one_hot_code(code: Column, d: int = 12, dp: int = 8) -> Column:
    """The bits of an event from its code."""
    return one_hot_event(*[F.split_part(code, F.lit("|"), F.lit(i)) for i in (1, 2, 3, 4)], d, dp)


def one_hot_weights(d: int = 12, dp: int = 8) -> list[float]:
    """Position weights: flanks 0.35..1 growing towards the variant, payload 1.35, overflow 0.75."""
    left = [0.35 + 0.65 * ((i + 1) / max(d, 1)) for i in range(d) for _ in range(4)]
    right = [0.35 + 0.65 * ((d - i) / max(d, 1)) for i in range(d) for _ in range(4)]
    return left + right + [1.35] * (10 * dp) + [0.75, 0.75]


def to_array(bits: Column) -> Column:
    return F.transform(F.split(bits, ""), lambda b: b.cast("tinyint"))


def unit_fraction(bits: Column) -> Column:
    """Σ bᵢ2⁻ⁱ over Σ 2⁻ⁱ of a bit string = its value as an integer over 2ⁿ − 1; 0 when empty."""
    n = F.length(bits)
    return F.when(n == 0, 0.0).otherwise(F.conv(bits, 2, 10).cast("double") / (F.pow(F.lit(2.0), n) - 1))


def cgr_xy(seq: Column) -> tuple[Column, Column]:
    """Left-to-right dyadic coordinates of a sequence (other letters skipped)."""
    s = F.translate(F.upper(seq), "N", "")
    return unit_fraction(F.translate(s, "ACGT", X_BITS[:4])), unit_fraction(F.translate(s, "ACGT", Y_BITS[:4]))


def hash_unit(text: Column, part: int) -> Column:
    """Unsigned 8-byte part (0 or 1) of the SHA-256 over 2⁶⁴ − 1."""
    word = F.conv(F.substring(F.sha2(text, 256), 1 + 16 * part, 16), 16, 10)
    return word.cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


def grid_index(v: Column, level: int) -> Column:
    size = 2**level
    return F.least(F.greatest(F.floor(v * size), F.lit(0)), F.lit(size - 1)).cast("int")


def morton(ix: Column, iy: Column, level: int) -> Column:
    """Interleaved bits of two grid indices, x first."""
    out = F.lit(0)
    for b in range(level):
        bit = lambda c, to: F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), to)
        out = out.bitwiseOR(bit(ix, 2 * b + 1)).bitwiseOR(bit(iy, 2 * b))
    return out


def cosine(a: Column, b: Column, *, zero: str = "null") -> Column:
    """Cosine similarity; ``zero`` says what a zero norm gives: null, 0, or 1 if both are zero (else 0)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    none = (na * nb) <= 1e-15
    value = dot(a, b) / F.when(none, 1.0).otherwise(na * nb)
    if zero == "null":
        return F.when(~none, value)
    if zero == "zero":
        return F.when(none, 0.0).otherwise(value)
    return F.when((na <= 1e-15) & (nb <= 1e-15), 1.0).when(none, 0.0).otherwise(value)


def base4(value: Column, width: int) -> Column:
    """Base-4 digits of a non-negative integer text as bases, left-padded with A."""
    return F.translate(F.lpad(F.conv(value, 10, 4), width, "0"), "0123", "ACGT")


def hash_bases(text: Column, width: int) -> Column:
    """The last ``width`` base-4 digits of the SHA-1 as bases (``width`` even, at most 30)."""
    tail = F.right(F.sha1(text), F.lit(width // 2))
    return F.translate(F.lpad(F.conv(tail, 16, 4), width, "0"), "0123", "ACGT")


MOTIF = "ACGTAACGTA"


def id_proxy(parts: dict[str, Column], d: int, dp: int, source: str) -> dict[str, Column]:
    """Proxy flanks and payload of an indel channel (event, motif, length, aux as from ``id83_parts``).

    ``source``: id83_proxy, id83_token_pair, id83_repeat_context or id83_payload_only.
    """
    event, motif = parts["event"], parts["motif"]
    size = F.greatest(F.lit(1), F.least(parts["length"], F.lit(dp)))
    aux = F.least(parts["aux"], F.lit(d))
    unit = F.when(motif == "T", F.repeat(F.lit("T"), size)).when(
        motif.isin("R", "M"), F.substring(F.lit(MOTIF), F.lit(1), size)
    ).otherwise(F.repeat(F.lit("C"), size))
    needed = F.greatest(F.lit(d), F.length(unit) * (F.greatest(F.lit(1), aux) + 2))
    run = F.substring(F.repeat(unit, (needed / F.length(unit)).cast("int") + 2), F.lit(1), needed)
    left, right = F.right(run, F.lit(d)), F.substring(run, 1, d)
    text = lambda side: F.concat_ws(":", F.lit(side), event, motif, size.cast("string"), aux.cast("string"))
    if source == "id83_token_pair":
        left, right = hash_bases(text("left"), d), hash_bases(text("right"), d)
    elif source == "id83_payload_only":
        left, right = F.lit(""), F.lit("")
    elif source == "id83_proxy":
        e = F.when(event == "INS", 1).otherwise(0)
        k = F.when(motif == "T", 1).when(motif == "R", 2).when(motif == "M", 3).otherwise(0)
        code = ((e * 4 + k) * 6 + F.least(size, F.lit(5))) * 6 + F.least(aux, F.lit(5))
        right = base4(code.cast("string"), d)
    is_del = event == "DEL"
    return {
        "left": left, "right": right,
        "ref": F.when(is_del, unit).otherwise(""), "alt": F.when(is_del, F.lit("")).otherwise(unit),
    }
