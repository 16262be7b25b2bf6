"""Hand-made cases for the rules that differ between variants, and invariants of what SQL cannot state."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from varloom.evaluation import metrics, models, quantiles, stats
from varloom.functions import catalogues, sequence, vectors
from varloom.operators import durable, exposures, windows
from varloom.sources.reference import fetch_windows, land, pieces_of_fasta, pieces_of_text, window_counts


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first().r


def test_catalogue_sizes():
    assert (len(catalogues.SBS96), len(catalogues.DBS78), len(catalogues.ID83)) == (96, 78, 83)
    assert len(set(c for _, _, c in catalogues.universe())) == 257


@pytest.mark.parametrize(
    "ref,alt,want", [("ACG", "ATG", "C|T"), ("A", "AAA", "|AA"), ("AAAA", "AA", "AA|"), ("CAT", "CGGT", "A|GG"), ("", "AC", "|AC"), ("AC", "AC", "|")]
)
def test_trimming(spark, ref, alt, want):
    assert one(spark, sequence.trimmed_pair(F.col("a"), F.col("b")), a=ref, b=alt) == want


@pytest.mark.parametrize("left,right,want", [("TTACG", "ACGTT", 3), ("AAAA", "AAAA", 4), ("ACGT", "CCCC", 0), ("", "ACG", 0)])
def test_microhomology(spark, left, right, want):
    assert one(spark, sequence.boundary_microhomology(F.col("a"), F.col("b")), a=left, b=right) == want


def test_homopolymer_counts_payload_and_both_runs(spark):
    span = sequence.homopolymer_span(F.col("p"), F.col("l"), F.col("r"))
    assert one(spark, span, p="AA", l="CGAA", r="ACG") == 5
    assert one(spark, span, p="AC", l="AA", r="AA") == 0


def test_modality_precedence_differs(spark):
    args = [F.col("r"), F.col("a"), F.col("v")]
    values = dict(r="A", a="C", v="DEL")
    assert one(spark, sequence.event_modality(*args, snp_first=True), **values) == "SBS"
    assert one(spark, sequence.event_modality(*args, snp_first=False), **values) == "ID"


def test_choose_alt_variants(spark):
    args = [F.col("r"), F.col("a1"), F.col("a2")]
    assert one(spark, sequence.choose_alt(*args, require_bases=False), r="A", a1="C", a2="") == ""
    assert one(spark, sequence.choose_alt(*args, require_bases=True), r="A", a1="C", a2="") == "C"


def test_legacy_payload_collides_and_masked_does_not(spark):
    block = lambda s, kind: one(spark, vectors.payload_block(F.col("s"), 3, kind), s=s)
    assert block("G", "legacy") == block("GG", "legacy")
    assert block("G", "masked") != block("GG", "masked")
    assert block("ACGT", "length")[6:] == "100"


def test_plain_indel_labels_are_in_the_catalogue(spark):
    pairs = spark.createDataFrame([(r, a) for r in ["", "A", "C", "ACGTAC", "GG"] for a in ["", "T", "G", "CC", "ACGTACG"]], "r string, a string")
    label = sequence.id83_plain(sequence.trimmed_pair(F.col("r"), F.col("a")))
    got = {x.l for x in pairs.select(label.alias("l")).collect()} - {None}
    assert got and got <= set(catalogues.ID83)


def test_windows_beyond_the_contig_and_beyond_a_tile(spark):
    text = "ACGT" * 50
    contigs = land(spark.createDataFrame([(1, 0, text[:70]), (1, 70, text[70:73]), (1, 73, text[73:])], "contig long, at long, seq string"), 64)
    spans = [(1, -3, 10), (1, 1, 64), (1, 60, 10), (1, 195, 20), (1, 300, 5), (1, 1, 150), (2, 5, 4)]
    ev = spark.createDataFrame(spans, "c long, start long, size long")
    got = {(r.c, r.start, r.size): r.window for r in fetch_windows(ev, contigs, contig="c", start="start", length="size").collect()}
    for c, start, size in spans:
        want = "".join(text[i - 1] if c == 1 and 1 <= i <= 200 else "N" for i in range(start, start + size))
        assert got[(c, start, size)] == want


def test_long_contig_is_cut_in_slices(spark):
    """10^8 bases in one text: lengths, borders and words."""
    n = 100_000_000
    unit = "ACGTTGCA" * 125_000 + "\n"
    text = spark.range(1).select(F.lit(7).cast("long").alias("id"), F.repeat(F.lit(unit), n // 1_000_000).alias("text"))
    ref = land(pieces_of_text(text, "id", "text", dict(zip("ACGT", "ACGT"))), aligned=True)
    assert ref.sizes().first().size == n
    assert ref.tiles.agg(F.max(F.length("seq"))).first()[0] == ref.size
    spans = [(7, 1, 12), (7, n - 5, 12), (7, (1 << 20) - 3, 8), (7, 50_000_000, 700)]
    ev = spark.createDataFrame(spans, "c long, start long, size long")
    for r in fetch_windows(ev, ref, contig="c", start="start", length="size").collect():
        assert r.window == "".join("ACGTTGCA"[(i - 1) % 8] if i <= n else "N" for i in range(r.start, r.start + r.size))
    counts = {r.w: r.n for r in window_counts(ref, 5).collect()}
    assert sum(counts.values()) == n - 4 and counts["ACGTT"] == n // 8 and len(counts) == 8


def test_fasta_over_several_blocks(spark, tmp_path):
    """Contigs that begin and end inside blocks, empty contigs, empty lines, lower case, no final line end."""
    rng = np.random.default_rng(3)
    contigs = {f"c{i}": "".join(rng.choice(list("ACGTn"), int(n))) for i, n in enumerate([0, 5, 700, 64, 3000, 1, 0, 129])}
    lines = [""]
    for name, s in contigs.items():
        lines += [f">{name} some words", *[s[i : i + 50].lower() for i in range(0, len(s), 50)], ""]
    (tmp_path / "a.fa").write_text("\n".join(lines).strip())
    (tmp_path / "b.fa").write_text(">other\nACGT\nAC")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        ref = land(pieces_of_fasta(spark, str(tmp_path)), 64)
        got = {}
        for r in sorted(ref.tiles.filter("tile >= 0").collect(), key=lambda r: (r.contig, r.tile)):
            got[r.contig] = got.get(r.contig, "") + r.seq
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {**{k: v.upper() for k, v in contigs.items()}, "other": "ACGTAC"}


def test_quantiles_and_running_totals_on_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(size=2000)] + [("hot", 0.5)] * 1000 + [("b", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q1, r.q2) for r in quantiles.quantiles(df, ["k"], "v", {"q1": 0.1, "q2": 0.5}).collect()}
    hot = [v for k, v in rows if k == "hot"]
    assert np.allclose(got["hot"], np.quantile(hot, [0.1, 0.5])) and np.allclose(got["b"], [1.1, 1.5])


def test_auroc_and_average_precision_against_brute_force(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean()
    assert math.isclose(metrics.auroc(df, [], "y", "s").first().auroc, want, rel_tol=1e-12)
    cut = np.unique(s)[::-1]
    prec = [(y[s >= c] == 1).mean() for c in cut]
    rec = [(y[s >= c] == 1).sum() / (y == 1).sum() for c in cut]
    ap = sum((r - q) * v for r, q, v in zip(rec, [0, *rec[:-1]], prec))
    assert math.isclose(metrics.auprc(df, [], "y", "s").first().auprc, ap, rel_tol=1e-12)


def test_erfc_and_chi_square(spark):
    row = spark.range(1).select(*[stats.erfc(F.lit(x)).alias(f"e{i}") for i, x in enumerate([0.0, 0.5, 2.0, 4.0])]).first()
    assert np.allclose(list(row), [math.erfc(x) for x in [0.0, 0.5, 2.0, 4.0]], rtol=3e-7)
    odd = spark.range(1).select(stats.chi_square_tail(F.lit(3.0), 1).alias("p"), stats.chi_square_tail(F.lit(3.0), 3).alias("q")).first()
    assert math.isclose(odd.p, 0.0832645, rel_tol=1e-5) and math.isclose(odd.q, 0.3916252, rel_tol=1e-5)


def test_bh_keeps_nulls_and_is_monotone(spark):
    p = [0.01, 0.04, 0.03, None, 0.20]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    q = {r.i: r.q_value for r in stats.bh(df, [], "p").collect()}
    assert q[3] is None
    assert np.allclose([q[0], q[2], q[1], q[4]], [0.04, 0.16 / 3, 0.16 / 3, 0.20])


def test_event_cap_is_exact_under_salting(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id"))
    kept = windows.event_cap(df, "k", ["id"], 1500, "s")
    plain = df.orderBy(F.sha2(F.concat_ws("|", F.lit("s"), F.col("id").cast("string")), 256)).limit(1500)
    assert {r.id for r in kept.collect()} == {r.id for r in plain.collect()}


def test_downsample_draws_the_budget(spark):
    counts = spark.createDataFrame([("p", "a", 70), ("p", "b", 30), ("q", "a", 5)], "patient string, channel string, n long")
    got = windows.downsample(counts, 40, 3, "s").groupBy("patient", "replicate").agg(F.sum("n").alias("n"), F.max("n").alias("m")).collect()
    assert len(got) == 3 and all(r.patient == "p" and r.n == 40 and r.m <= 40 for r in got)


def test_nnls_recovers_mixtures_and_stays_non_negative(spark):
    ref = [("S1", "a", 0.7), ("S1", "b", 0.2), ("S1", "c", 0.1), ("S2", "a", 0.1), ("S2", "b", 0.1), ("S2", "c", 0.8)]
    reference = spark.createDataFrame(ref, "signature string, channel string, p double")
    mix = [("x", ch, 0.25 * a + 0.75 * b) for ch, a, b in [("a", 0.7, 0.1), ("b", 0.2, 0.1), ("c", 0.1, 0.8)]] + [("zero", "a", 0.0), ("odd", "b", 1.0)]
    got = exposures.fit(spark.createDataFrame(mix, "patient string, channel string, p double"), reference).collect()
    w = {(r.patient, r.signature): r.weight for r in got}
    assert abs(w[("x", "S1")] - 0.25) < 1e-6 and abs(w[("x", "S2")] - 0.75) < 1e-6
    assert w[("zero", "S1")] == 0 and min(w.values()) >= 0 and abs(w[("odd", "S1")] + w[("odd", "S2")] - 1) < 1e-9


def test_grouped_folds_never_split_a_group_and_oof_covers_every_row_once(spark):
    rows = spark.range(240).select("id", (F.col("id") % 24).alias("g"), (F.col("id") % 24 % 3).alias("y"))
    folds = models.grouped(rows, "y", "g", 4, "s")
    assert folds.count() == 240 and folds.groupBy("g").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    data = models.stratified(rows.select("id", (F.col("id") % 2).cast("double").alias("y")), "y", "id", 3, "s")
    from pyspark.ml.functions import array_to_vector

    data = data.withColumn("features", array_to_vector(F.array(F.col("id").cast("double"), F.col("y") + F.rand(1))))
    oof = models.out_of_fold(data.withColumn("fold", F.array("fold")), models.linear_classifier, "id", "binary", 3).filter("class = 1").withColumnRenamed("p", "pred")
    assert oof.count() == 240 and oof.select("id").distinct().count() == 240


def test_upsert_keeps_the_last_batch_and_pending_ignores_foreign_tables(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, batch int")
    new = spark.createDataFrame([("b", 2, 2), ("c", 2, 2)], "k string, v int, batch int")
    assert {(r.k, r.v) for r in durable.upsert(old, new, ["k"], "batch").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert durable.pending(old, new.select("v"), ["k"]).count() == 2


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient", "channel", "n"] and df.count() == 2570


def test_long_alleles_and_far_positions(spark):
    """A 120-base deletion and an event past position 10,000 whose window spans tiles are looked up, not rejected."""
    import random

    from varloom.operators import encode

    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(12_000))
    contigs = land(spark.createDataFrame([(7, 0, seq)], "contig long, at long, seq string"))
    at = lambda pos, n: seq[pos - 1 : pos - 1 + n]
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}
    rows = [(1, "chr7", 500, "DEL", at(500, 121), at(500, 1)), (2, "chr7", 10_943, "SNP", at(10_943, 1), other[at(10_943, 1)]), (3, "chr7", 128, "SNP", at(128, 1), other[at(128, 1)]), (4, "chr7", 500, "DEL", at(500, 120) + other[at(620, 1)], at(500, 1))]
    events = spark.createDataFrame(rows, "event_id long, chromosome string, pos long, variant_type string, ref string, alt string")
    found = {r["event_id"]: r for r in encode.encode_events(events, contigs).collect()}
    assert [found[i]["reject_reason"] for i in (1, 2, 3, 4)] == [None, None, None, "fasta_ref_mismatch"]
    assert found[2]["left"] == at(10_931, 12) and found[2]["right"] == at(10_944, 12) and found[1]["channel"].startswith("ID83:5:Del")


def test_python_functions_need_no_package_in_workers(tmp_path):
    """A query with Python workers runs from another working directory."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nimport __spark_entry__ as e\nfrom varloom.session import local_session\nprint('rows', e.queries()['vec_distance'](local_session(2), '/root/testdata/sf0.001').count())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_second_call_leaves_the_first_result_alone(spark, folder):
    from varloom.catalog.registry import QUERIES

    first = QUERIES["snk_result_table"](spark, folder)
    n = first.count()
    QUERIES["snk_result_table"](spark, folder.replace("0.001", "0.01"))
    assert first.count() == n


def test_cache_notices_changed_inputs(spark, tmp_path):
    from varloom.operators import durable

    source, root = str(tmp_path / "in"), str(tmp_path / "cache")
    read = lambda: durable.cached(spark, root, "doubles", {"factor": "2"}, [source], lambda: spark.read.parquet(source).selectExpr("id * 2 AS v")).count()
    spark.range(5).write.parquet(source)
    assert (read(), read()) == (5, 5)
    spark.range(3).write.mode("append").parquet(source)
    assert read() == 8
