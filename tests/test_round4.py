"""Round 4: what queries over events and kernel embeddings write to disk."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from varloom.sources import reference as ref


def stored_by(spark, tmp_path, build):
    """Names of the tables that ``build`` and its action write below the scratch folder."""
    spark.conf.set("varloom.scratch", str(tmp_path))
    try:
        build().collect()
    finally:
        spark.conf.unset("varloom.scratch")
    below = os.path.join(tmp_path, "varloom")
    return sorted(name.split("-", 1)[1] for name in os.listdir(below))


@pytest.mark.parametrize("name", ["agg_modality_covariates", "lmk_random", "vec_payload"])
def test_events_are_not_stored(spark, folder, tmp_path, name):
    """the one table that is written is the reference."""
    assert stored_by(spark, tmp_path, lambda: entry.queries()[name](spark, folder)) == ["reference-tiles"]


@pytest.mark.parametrize("letter", ["N", "-"])
def test_packed_windows_are_those_of_the_text(spark, letter):
    """four bases in three bytes where all letters allow it; windows of any length and start, also behind the contig."""
    text = ("ACGTTGCAAC" * 40 + letter)[:399] + letter + "GT"
    pieces = [(1, i, text[i : i + 128]) for i in range(0, len(text), 128)]
    stored = ref.land(spark.createDataFrame(pieces, "contig long, at long, seq string"), 128, aligned=True)
    assert stored.packed() == (letter == "N")
    spans = [(1, s, n) for s in (-5, 0, 1, 2, 3, 4, 127, 128, 129, 250, 390, 402, 500) for n in (0, 1, 5, 64, 77, 128)]
    events = spark.createDataFrame(spans, "c long, start long, size long")
    want = {(s, n): "".join(text[i - 1] if 1 <= i <= len(text) else "N" for i in range(s, s + n)) for _, s, n in spans}
    for longest in (None, 128):
        rows = ref.fetch_windows(events, stored, contig="c", start="start", length="size", longest=longest)
        assert {(r.start, r.size): r.window for r in rows.collect()} == want
    assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_more_bases_fit_a_broadcast(spark, monkeypatch):
    """short contigs count with their own bases and not with a tile's, neighbours with the bases that a window may need."""
    pieces = [(i, at, "ACGT" * 16) for i in range(50) for at in (0, 64, 128, 192)]
    stored = ref.land(spark.createDataFrame(pieces, "contig long, at long, seq string"), 64, aligned=True)
    monkeypatch.setattr(ref, "BROADCAST", 50 * 5 * 128 + 50 * 256)
    assert stored.small(16) and not stored.small()


def test_f3_reference_windows_are_not_cut_into_rows(spark, folder, monkeypatch):
    """no window of the query spans more than two tiles, so none becomes a row a tile."""
    def no(*args, **options):
        raise AssertionError("windows are exploded")

    monkeypatch.setattr(ref, "fetch_long_windows", no)
    assert entry.queries()["src_reference_tiles"](spark, folder).count() > 0


def test_f9_motif_ratios_count_channels_once(spark, tmp_path):
    """what the counts come from is read once; ratios and totals are made where a patient's counts are."""
    from varloom.operators import features as ft

    rows = [("p", "SBS96:A[C>T]G", 6), ("p", "SBS96:T[C>G]A", 2), ("p", "ID83:1:Del:C:0", 4), ("p", "DBS78:AC>CA", 9), ("q", "DBS78:AC>CA", 1), (None, "SBS96:A[C>A]A", 3)]
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame(rows, "patient string, channel string, n long").mapInArrow(seen, "patient string, channel string, n long")
    spark.conf.set("varloom.scratch", str(tmp_path))
    try:
        got = {(r.patient, r.feature): round(r.value, 6) for r in ft.motif_ratios(source).collect()}
    finally:
        spark.conf.unset("varloom.scratch")
    assert reads.value == len(rows)
    assert got[("p", "ratio_sbs_cpg_ct")] == 0.75 and got[("p", "ratio_sbs_apobec_like")] == 0.25 and got[("p", "ratio_id_event_del")] == 1.0
    assert got[("p", "ratio_cpg_to_apobec_plus1")] == round(7 / 3, 6) and got[("p", "ratio_id_mh_to_hp_plus1")] == 1.0
    assert {k[1] for k in got if k[0] is None} == {"ratio_cpg_to_apobec_plus1", "ratio_id_mh_to_hp_plus1"}
    assert not [k for k in got if k[0] == "q" or "total" in k[1]]


def vectors_of(spark, n, copies):
    rows = spark.range(n).select(F.lpad(F.bin("id"), 16, "0").alias("v"))
    return rows.unionAll(spark.range(copies).select(F.lit("1" * 16).alias("v"))).unionAll(spark.range(2).select(F.lit(None).cast("string").alias("v")))


def by_hash(vectors, seed):
    return sorted(vectors, key=lambda v: (hashlib.sha256(f"{seed}|{v}".encode()).hexdigest(), v))


def test_f11_only_vectors_below_a_bound_meet(spark):
    """the same landmarks as by sorting all distinct vectors, from a small share of them."""
    from varloom.operators.landmarks import random_landmarks

    rows = vectors_of(spark, 30_000, 5_000).repartition(7)
    want = by_hash({f"{i:016b}" for i in range(30_000)} | {"1" * 16}, "s")
    chosen = random_landmarks(rows, "v", 5, "s")
    assert [r.v for r in chosen.collect()] == [None, *want[:4]]
    assert [r.v for r in random_landmarks(rows.filter("v IS NOT NULL"), "v", 5, "s").collect()] == want[:5]
    assert "<=" in chosen._jdf.queryExecution().optimizedPlan().toString()
    assert random_landmarks(rows.limit(0), "v", 5, "s").count() == 0 and random_landmarks(rows, "v", 0, "s").count() == 0
    assert len(random_landmarks(vectors_of(spark, 3, 1), "v", 12, "s").collect()) == 5


def test_f8_frequent_vectors_are_counted_in_short_form(spark):
    """F8: codes are equal where bits are, and counts of codes give the landmarks that counts of bits give."""
    from varloom.functions import vectors as vec
    from varloom.operators.landmarks import frequency_landmarks

    bases = ["ACGTACGTACGT", "ACGTACGTACGA", "CCCCCCCCCCCC"]
    rows = [(a, b, r, t) for a in bases for b in bases[:2] for r in ("", "A", "ACGTACGT", "ACGTACGTA", "ACGTACGTCC") for t in ("G", "GT")]
    events = spark.createDataFrame(rows + rows[3:9] + rows[5:7], "l string, r string, x string, y string")
    parts = [F.col(c) for c in "lrxy"]
    events = events.select(vec.one_hot_event(*parts).alias("v"), vec.event_code(*parts).alias("code"))
    pairs = events.select("v", "code", vec.one_hot_code(F.col("code")).alias("again")).distinct().collect()
    assert all(p.v == p.again and len(p.v) == 178 for p in pairs)
    assert len({p.v for p in pairs}) == len({p.code for p in pairs}) == len(pairs)
    counted = events.groupBy("code").agg(F.count("*").alias("n")).select(vec.one_hot_code(F.col("code")).alias("v"), "n")
    both = [[(r.v, r.part) for r in frequency_landmarks(events, "v", 8, "s", n).collect()] for n in (None, counted)]
    assert both[0] == both[1] and [p for _, p in both[0]] == ["frequent"] * 4 + ["tail"] * 4
    head = [v for v, p in both[0] if p == "frequent"]
    assert [v for v, p in both[0] if p == "tail"] == by_hash({p.v for p in pairs} - set(head), "s")[:4]


def test_f7_kernel_sums_need_no_sort(spark, monkeypatch):
    """a task adds up its keys in any order and in parts; rows without a key are no other key's."""
    from varloom.operators import kernels

    rng = np.random.default_rng(1)
    rows = [(f"k{i % 700}" if i % 11 else None, "".join(map(str, rng.integers(0, 2, 6))), int(rng.integers(1, 4))) for i in range(4_000)]
    y = rng.integers(0, 2, (3, 6)).astype(float)
    want: dict[tuple[str, int], float] = {}
    for key, bits, n in rows:
        for j in range(3) if key else ():
            d = ((np.array(list(bits), dtype=float) - y[j]) ** 2).sum()
            want[(key, j + 1)] = want.get((key, j + 1), 0.0) + n * np.exp(-0.5 * d / 4)
    monkeypatch.setattr(kernels, "HELD", 3_000)
    data = spark.createDataFrame(rows, "k string, v string, n int").repartition(2)
    sums = kernels.weighted_kernel_sums(data, "k", "v", "n", [1, 2, 3], y, 2.0, bits=True)
    got = {(r.k, r.landmark): r.value for r in sums.collect()}
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()))
    assert "Sort" not in sums._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kme_event", "kme_stratified"])
def test_inventory_holds_short_codes(spark, folder, tmp_path, name):
    """the stored vectors are spelled in bases, not in 178 bits."""
    assert [n.split("-")[0] for n in stored_by(spark, tmp_path, lambda: entry.queries()[name](spark, folder))] == ["inventory", "reference"]
    below = os.path.join(tmp_path, "varloom")
    inventory = spark.read.parquet(os.path.join(below, next(n for n in os.listdir(below) if "inventory" in n)))
    assert "v" not in inventory.columns and inventory.agg(F.max(F.length("code"))).first()[0] < 60


@pytest.mark.parametrize("depth", [1, 2])
def test_f1_trees_meet_in_tables_of_two_features(spark, depth):
    """all trees of a model cost at most one lookup a pair of features, and give what walking each tree gives."""
    from varloom.evaluation import boosting

    rng = np.random.default_rng(3)
    n, width, bins, count = 500, 4, 8, 30
    b = rng.integers(0, bins, (width, n)).astype(np.uint8)
    inner, ends = 2**depth - 1, 2**depth
    trees = [(rng.integers(0, width, (3, inner)), rng.integers(0, bins + 60, (3, inner)), rng.normal(size=(3, ends))) for _ in range(count)]
    models = boosting.Models(*[np.zeros(3)] * 6, trees)
    summed = boosting.tables(models, depth, bins)
    start = rng.normal(size=(3, n))
    walked = boosting.margins(b, start, models, depth)
    assert np.allclose(boosting.margins(b, start, models, depth, summed, boosting.Places(b, bins)), walked)
    assert max(map(len, summed)) <= width * (width + 1) // 2 < count
    assert boosting.tables(models, 3, bins) is None


def test_f1_rows_are_numbered_without_cut_points(spark, tmp_path):
    """hash order within groups, repeated rows share a number, and only the hashes are stored."""
    from varloom.evaluation import stats

    rows = [(i, "a" if i % 3 else "b") for i in range(300)] + [(7, "a"), (7, "a"), (9, "b"), (None, "a"), (5, None)]
    preds = spark.createDataFrame(rows, "id long, g string")
    spark.conf.set("varloom.scratch", str(tmp_path))
    try:
        got = sorted((r.id if r.id is not None else -1, r.g, r.idx, r.n) for r in stats.numbered(preds, ["g"], "id", "s").collect())
    finally:
        spark.conf.unset("varloom.scratch")
    place = lambda i: int(hashlib.sha256(("s" if i is None else f"s|{i}").encode()).hexdigest()[:13], 16)
    want = []
    for i, g in rows:
        mine = [place(k) for k, other in rows if other == g]
        if g is not None:
            want.append((i if i is not None else -1, g, sum(m < place(i) for m in mine), len(mine)))
    assert got == sorted(want)
    assert [name.split("-", 1)[1] for name in os.listdir(tmp_path / "varloom")] == ["hashes"]


def test_tiles_are_put_together_only_where_each_is_there_once(spark):
    """longer tiles give the windows of the text; what repeated tiles give does not change."""
    text = "ACGTTGCAAC" * 30
    once = [(1, i, text[i : i + 64]) for i in range(0, 300, 64)] + [(2, 0, "GATTA"), (3, 0, "")]
    spans = [(c, s, n) for c in (1, 2, 3, 4) for s in (-70, -3, 1, 60, 64, 129, 290) for n in (1, 64, 65, 200)]
    spans += [(c, s, n) for c, s in ((None, 5), (1, None), (None, None)) for n in (1, 64, 65, 200, None)]
    events = spark.createDataFrame(spans, "c long, start long, size long")
    for pieces, whole in ((once, True), (once + once, False), (once[:2] + once[3:], False)):
        stored = ref.land(spark.createDataFrame(pieces, "contig long, at long, seq string"), 64, aligned=True)
        assert (stored.for_windows(200) is not stored) == whole
        rows = lambda longest: sorted(map(tuple, ref.fetch_windows(events, stored, contig="c", start="start", length="size", longest=longest).collect()), key=str)  # noqa: E731, B023
        assert rows(200) == rows(None)
