"""Findings of round 3, fourth pass: each test fails on the code before."""

import collections

import numpy as np


def test_counts_of_the_language_model_are_taken_by_sorting(monkeypatch):
    """``np.unique`` hashes 64-bit values into single nodes: counting and asking for n-grams go without it."""
    from varloom.llm import op13_lm as lm

    rng = np.random.default_rng(3)
    rows = [[rng.integers(0, 40, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64)] for _ in range(3)]
    want = collections.Counter(pair for a, b in rows for pair in zip(a.tolist(), b.tolist(), strict=True))
    monkeypatch.setattr(np, "unique", None)
    tally = lm.Tally()
    tally.add([np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)])
    for columns in rows:
        tally.add(columns)
    tally.combine()
    ((_, (a, b), n),) = tally.parts
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want
    assert lm.distinct(np.array([7, 2**63, 7, 0], dtype=np.uint64)).tolist() == [0, 7, 2**63] and not len(lm.distinct(rows[0][0][:0]))


def attributed(spark):
    from pyspark.sql import functions as F

    kinds = F.element_at(F.array(*[F.lit(x) for x in ("SBS", "DBS", "ID", "OTHER")]), (F.col("id") % 4 + 1).cast("int"))
    base = lambda k, n: F.substring(F.repeat(F.element_at(F.array(*[F.lit(x) for x in ("ACGTN", "TTGAC", "CNGTA")]), (F.col("id") % 3 + 1).cast("int")), n), k, n)
    return spark.range(300).select(
        "id", (F.col("id") % 5).alias("patient"), kinds.alias("modality"), F.concat(F.lit("m"), F.col("id") % 7).alias("motif_class"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("i"), F.col("id") % 2)).alias("indel_class"), F.when(F.col("id") % 4 == 0, "A[C>T]G").alias("sbs96"),
        *[base(k, n).alias(f"context_{n}") for k, n in ((1, 3), (2, 5), (1, 7))], F.when(F.col("id") % 13 > 0, base(3, 11)).alias("context_11"),
        F.when(F.col("id") % 2 == 0, "del").otherwise("ins").alias("event_class"), *[(F.col("id") % m).cast("int").alias(c) for c, m in (("payload_len", 14), ("homopolymer_len", 3), ("microhomology_len", 4))],
        (F.col("id") % 21 / 20).alias("local_gc"), F.when(F.col("id") % 3 == 0, "coding").otherwise("other").alias("gene_region"),
        (F.col("id") % 2).cast("int").alias("clustered"), F.when(F.col("id") % 6 < 3, "+").otherwise("-").alias("strand"),
    )


def test_f5_geometries_place_equal_inputs_once(spark):
    """Counted inputs give the rows of single events, and an event that occurs again is not placed again."""
    from varloom.functions import geometry as geo

    events, names = attributed(spark), list(geo.GEOMETRIES)
    for keys in ([], ["patient"]):
        want = collections.Counter((*[r[k] for k in keys], r["geometry"], r["token"], r["x"], r["y"]) for r in geo.place(events, names).collect())
        got, rows = collections.Counter(), geo.place(events.unionAll(events), names, keys=keys).collect()
        for r in rows:
            got[*[r[k] for k in keys], r["geometry"], r["token"], r["x"], r["y"]] += r["n"]
        assert got == {k: 2 * n for k, n in want.items()} and len(rows) < 300 * len(names)
    assert geo.place(events.limit(0), names, keys=[]).count() == 0


def test_f11_quantiles_cut_only_keys_of_many_values_into_bins(spark, monkeypatch):
    from varloom.evaluation import quantiles as q

    rows = [(k, float((i * 37) % m)) for k, m, n in (("a", 1000, 900), ("b", 7, 50), ("c", 1, 3), (None, 5, 5)) for i in range(n)] + [("d", None), ("e", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: [float(np.quantile([v for j, v in rows if j == k and v is not None], p)) for p in (0.5, 0.9)] for k in "abce"}
    cut, true = [], q.running_totals
    monkeypatch.setattr(q, "running_totals", lambda runs, *rest: cut.append(runs.select(*rest[0]).distinct().count()) or true(runs, *rest))
    for limit, keys_cut in ((20_000, []), (100, [1]), (0, [4])):
        monkeypatch.setattr(q, "GATHERED", limit, raising=False)
        cut.clear()
        got = {r["k"]: [r["median"], r["q90"]] for r in q.quantiles(df, ["k"], "v", {"median": 0.5, "q90": 0.9}).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want) and cut == keys_cut
    everything = q.quantiles(df.drop("k"), [], "v", {"median": 0.5}).first()["median"]
    assert everything == np.median([v for _, v in rows if v is not None])
    assert q.quantiles(df.limit(0), [], "v", {"median": 0.5}).first()["median"] is None and q.quantiles(df.limit(0), ["k"], "v", {"median": 0.5}).count() == 0
