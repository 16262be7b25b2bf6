"""Bounded samples of labelled rows for fits, and the split of rows by a checksum of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many bytes are not learnt from.
LONGEST = 1 << 16


def remainder(divisor: int) -> Column:
    """crc32 of the id's digits, modulo ``divisor``; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, sample: int, longest: int = LONGEST) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of about ``sample`` rows of either label that fulfil ``wanted``, chosen by a hash of the id, and the share
    of label 1 among all of them.

    The ids are chosen from ``labels`` alone, so a list of bounded length meets the documents and their texts are not shuffled.
    An id with several labels counts as the greatest of them; null labels, ids and texts are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & wanted).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, int(1_000_000 * min(1, sample / n)) + 1).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id").toArrow()  # ``chosen``: about 2 x sample rows
    found = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), rows.column("label").to_pylist(), strict=True))
    return [(t, y) for _, t, y in found], sizes.get(1, 0) / max(1, sum(sizes.values()))
