"""Lookups in the stored reference: sent to all tasks where it is small, shuffled where it is large."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from varloom.functions import sequence
from varloom.operators import encode
from varloom.operators.density import attach_density
from varloom.sources import reference as ref


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stored(spark):
    """Contig 1 has 300 bases, 2 has 5, 3 none, 4 is there twice with unequal lengths; one contig is null."""
    pieces = [(1, 0, ("ACGTT" * 60)[:64]), *[(1, i, ("ACGTT" * 60)[i : i + 64]) for i in range(64, 300, 64)], (2, 0, "GATTA"), (3, 0, ""), (4, 0, "C" * 64), (4, 64, "G" * 9), (4, 0, "T" * 7), (None, 0, "A")]
    return ref.land(spark.createDataFrame(pieces, "contig long, at long, seq string"), 64, aligned=True)


SPANS = [(1, -70, 30), (1, -3, 10), (1, 0, 1), (1, 60, 64), (1, 290, 30), (1, 400, 5), (1, 1, 299), (2, 3, 9), (3, 1, 4), (4, 60, 12), (4, 2, 9), (9, 1, 3), (None, 1, 3), (1, None, 3), (1, 5, None), (1, 5, 0)]


def test_small_reference_moves_no_event(spark, stored, monkeypatch):
    """Both ways give the same rows; where the reference is sent to the tasks, a short lookup has no exchange."""
    found = {}
    for limit in (1 << 27, 0):
        monkeypatch.setattr(ref, "BROADCAST", limit, raising=False)
        events = spark.createDataFrame(SPANS, "c long, start long, size long").repartition(3)
        found[limit] = rows_of(ref.fetch_windows(events, stored, contig="c", start="start", length="size"))
        short = ref.fetch_windows(spark.range(100).selectExpr("id", "id % 5 AS c", "id AS start", "10L AS size").repartition(2), stored, contig="c", start="start", length="size", bound=F.lit(10))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = short._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert ("Exchange hashpartitioning" in plan) == (limit == 0)
    assert found[0] == found[1 << 27]
    text = "ACGTT" * 60
    for c, start, size, window in found[0]:
        if c == 1 and start is not None and size is not None:
            assert window == "".join(text[i - 1] if 1 <= i <= 300 else "N" for i in range(start, start + size))
    assert [w for c, s, _, w in found[0] if (c, s) == (2, 3)] == ["TTANNNNNN"]
    assert not stored.unique()  # contig 4 comes twice, so lookups there give more rows
    assert len([1 for c, s, *_ in found[0] if (c, s) == (4, 2)]) > 1


def test_contigs_without_repeats_are_unique(spark):
    pieces = [(1, 0, "A" * 64), (1, 64, "C"), (2, 0, "G"), (None, 0, "A"), (None, 0, "A")]
    assert ref.land(spark.createDataFrame(pieces, "contig long, at long, seq string"), 64, aligned=True).unique()


def test_density_is_never_broadcast_and_counts_the_rows_named(spark):
    events = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, None, 1)], "id long, p string, bin long")
    assert rows_of(attach_density(events, ["p", "bin"], "n").select("id", "n")) == [(1, 2), (2, 2), (3, 1)]
    twice = attach_density(events, ["p", "bin"], "n", of=events.unionAll(events))
    assert rows_of(twice.select("id", "n")) == [(1, 4), (2, 4), (3, 2)]
    assert "BroadcastHashJoin" not in twice._jdf.queryExecution().sparkPlan().toString()


def test_filters_on_the_verdict_do_not_repeat_the_lookup(spark, stored):
    rows = [(1, "chr1", 40, "SNP", "T", "G"), (2, "chr1", 40, "SNP", "A", "G"), (3, "chr1", 1, "SNP", "A", "G"), (4, "chr1", 41, "INS", "-", "CC"), (5, None, 41, "SNP", "A", "G")]
    events = spark.createDataFrame(rows, "event_id long, chromosome string, pos long, variant_type string, ref string, alt string")
    encoded = encode.encode_events(events, stored)
    assert encoded.columns[-4:] == ["reject_reason", "cleft", "cright", "channel"]
    found = {r["event_id"]: (r["reject_reason"], r["channel"]) for r in encoded.collect()}
    assert found[1] == (None, "SBS96:T[T>G]A") and found[4][0] is None and found[4][1].startswith("ID83:")
    assert [found[i] for i in (2, 3, 5)] == [("fasta_ref_mismatch", None), ("unresolved_context", None), ("fasta_ref_mismatch", None)]
    plan = encode.accepted(encoded).filter("channel IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("wide#" in line or "window#" in line)]


def test_encoding_fits_a_compiled_method(spark, stored):
    """The JVM only interprets methods of more than 8000 bytes; all stages that encode events stay below."""
    columns = "patient string, chromosome string, pos long, ref string, alt string, variant_type string"
    events = spark.createDataFrame([("p", "chr1", 20, "A", "C", "SNP"), ("q", "chr1", 21, "C", "NAN", None)], columns).repartition(2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = encode.accepted(encode.encode_events(events, stored)).groupBy("patient", "channel").count()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        text = counted._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000


def test_short_forms_of_alleles_and_labels(spark):
    """Tokens for no allele, letters that are no bases, and indel labels without bases."""
    alleles = {"NAN": "", " nan ": "", "NANA": "AA", "NAN\n": "A", "none": "", "-": "", ".": "", "acgtn": "ACGT", None: ""}
    df = spark.createDataFrame([(a,) for a in alleles], "a string")
    assert {r[0]: r[1] for r in df.select("a", sequence.clean_allele(F.col("a"))).collect()} == alleles
    labels = {"G|": "1:Del:C:0", "|A": "1:Ins:T:0", "ACGTAC|": "5:Del:R:0", "A|CG": "2:Ins:R:0", "A|C": None, "|": None, None: None}
    df = spark.createDataFrame([(p,) for p in labels], "p string")
    assert {r[0]: r[1] for r in df.select("p", sequence.id83_plain(F.col("p"))).collect()} == labels
