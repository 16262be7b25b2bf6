"""Draws, factorisations, decompositions and models against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from varloom.evaluation import boosting, models, reduction, stats
from varloom.operators import exposures, windows


def test_hypergeometric_is_the_inverse_distribution():
    total, marked, draws = 60, 25, 20
    weight = [math.comb(marked, k) * math.comb(total - marked, draws - k) for k in range(draws + 1)]
    cdf = np.cumsum(weight) / math.comb(total, draws)
    for u in np.linspace(0.001, 0.999, 97):
        assert windows.hypergeometric(u, total, marked, draws) == int(np.searchsorted(cdf, u))
    assert windows.hypergeometric(0.5, 10, 10, 4) == 4 and windows.hypergeometric(0.5, 10, 0, 4) == 0


def test_downsample_marginals(spark):
    """Chi-square of one channel's counts over 4,000 replicates; a channel of 10^9 units costs no more than a small one."""
    counts = spark.createDataFrame([("p", "a", 25), ("p", "b", 15), ("p", "c", 20)], "patient string, channel string, n long")
    got = windows.downsample(counts, 20, 4000, "s")
    assert {r.t for r in got.groupBy("replicate").agg(F.sum("n").alias("t")).collect()} == {20}
    for channel, marked in (("a", 25), ("b", 15), ("c", 20)):
        seen = {r.n: r["count"] for r in got.filter(F.col("channel") == channel).groupBy("n").count().collect()}
        p = np.array([math.comb(marked, k) * math.comb(60 - marked, 20 - k) for k in range(21)]) / math.comb(60, 20)
        use = p * 4000 >= 5
        observed = np.array([seen.get(k, 0) for k in range(21)])
        assert ((observed[use] - 4000 * p[use]) ** 2 / (4000 * p[use])).sum() < 3 * use.sum()
    big = spark.createDataFrame([("p", "a", 10**9), ("p", "b", 10**9), ("p", "c", 5)], "patient string, channel string, n long")
    rows = windows.downsample(big, 1_000_000, 3, "s").collect()
    assert all(abs(r.n - 500_000) < 5_000 for r in rows if r.channel != "c") and sum(r.n for r in rows) == 3_000_000


def test_factorisation_recovers_planted_factors(spark):
    """Patients with one pure factor each and mixtures of them: the factors come back and the error is that of a NumPy version."""
    rng = np.random.default_rng(5)
    h = np.zeros((3, 12))
    for j in range(3):
        h[j, 4 * j : 4 * j + 4] = rng.integers(20, 80, 4)
    w = np.vstack([np.eye(3), rng.integers(0, 4, (27, 3))])
    w[w.sum(axis=1) == 0, 0] = 1
    x = (w @ h).astype(int)
    counts = spark.createDataFrame([(f"p{i}", f"c{j:02d}", int(x[i, j])) for i in range(30) for j in range(12) if x[i, j]], "patient string, channel string, n long")
    reference = spark.createDataFrame([(f"S{j}", f"c{i:02d}", float(h[j, i])) for j in range(3) for i in range(12)], "signature string, channel string, p double")
    got = exposures.factorise(counts, reference, 3, [1, 2, 3]).collect()
    assert {r.signature for r in got} == {"S0", "S1", "S2"} and all(r.mutual and r.cosine > 0.999 for r in got)
    assert all(r.converged and r.error < 1e-3 for r in got)


def test_factor_pass_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x, h = rng.random((40, 6)), rng.random((2, 6))
    rows = spark.createDataFrame([(f"p{i}", list(range(6)), [float(v) for v in r]) for i, r in enumerate(x)], "patient string, i array<int>, p array<double>")
    wx, ww, error = exposures.factor_pass(rows.repartition(3), {9: h})[9]
    w = exposures.coordinate_descent(h @ h.T, x @ h.T)
    assert np.allclose(wx, w.T @ x, atol=1e-7) and np.allclose(ww, w.T @ w, atol=1e-7)
    assert math.isclose(error, ((x - w @ h) ** 2).sum(), rel_tol=1e-7)


@pytest.mark.parametrize("exact", [1024, 4])
def test_svd_equals_numpy(spark, monkeypatch, exact):
    """From the Gram matrix and by subspace iteration."""
    monkeypatch.setattr(reduction, "EXACT", exact)
    rng = np.random.default_rng(7)
    n = rng.poisson(np.outer(rng.gamma(1, 1, 50), rng.gamma(0.5, 2, 30)))
    counts = spark.createDataFrame([(f"p{i}", f"f{j:02d}", int(n[i, j])) for i in range(50) for j in range(30) if n[i, j]], "patient string, feature string, n long")
    entries, width = reduction.numbered_entries(counts, "patient", 100)
    x = np.log1p(n[:, n.sum(axis=0) > 0])
    assert width == x.shape[1]
    v, values = reduction.right_vectors(entries, "patient", width, 4)
    want = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, want[1][:4], rtol=1e-6) and np.allclose(np.abs(want[2][:4] @ v), np.eye(4), atol=1e-4)
    scores = {(r.patient, r.k, r.component): r.score for r in reduction.truncated_svd(counts, "patient", [2, 4]).collect()}
    assert math.isclose(scores["p0", 2, 1], scores["p0", 4, 1], abs_tol=1e-9)
    with pytest.raises(ValueError):
        reduction.numbered_entries(counts, "patient", 10)


def test_bootstrap_replicates_against_brute_force(spark, monkeypatch):
    """Ties, a hot score, several bins, small slices."""
    monkeypatch.setattr(stats, "SLICE", 7)
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    a, b = rng.integers(0, 30, 300) / 30, np.where(rng.random(300) < 0.4, 0.5, rng.random(300))
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(300)], "id long, y int, a double, b double")
    words = np.array([r.h for r in df.select("id", stats.hash_words(F.concat_ws("|", F.lit("s"), F.col("id").cast("string"))).alias("h")).orderBy("id").collect()])
    m = stats.multiplicities(words, 12)
    assert abs(m.mean() - 1) < 0.1 and abs(m.var() - 1) < 0.15

    def area(score, times):
        p, q = (np.repeat(score[y == k], times[y == k]) for k in (1, 0))
        return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))

    got = {r.replicate: r.delta for r in stats.replicate_deltas(df, "y", "a", "b", "id", replicates=12, seed="s").collect()}
    assert sorted(got) == list(range(1, 13))
    assert all(math.isclose(got[r + 1], area(a, m[:, r]) - area(b, m[:, r]), abs_tol=1e-12) for r in range(12))


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 3))
    x[::17, 1] = np.nan
    z = x[:, 0] + np.nan_to_num(x[:, 1])
    rows = [(i, [float(v) for v in x[i]], [float(z[i]), float(z[i] > 0), float(np.digitize(z[i], [-0.7, 0.7]))], [int(i % 3 + 1), int(i // 3 % 3 + 1)] * 3) for i in range(240)]
    return spark.createDataFrame(rows, "id long, x array<double>, y array<double>, fold array<int>")


TARGETS = [boosting.Target("size", "regression"), boosting.Target("sign", "binary", 2), boosting.Target("group", "multiclass", 3)]


def test_boosted_models_learn_and_never_see_their_fold(spark, cohort):
    s = boosting.Settings(trees=25, rate=0.3, child_weight=1.0, bins=16)
    run = lambda rows: {(r.id, r.target, r.repeat, r["class"]): r for r in boosting.cross_boosted(rows, "id", TARGETS, repeats=2, folds=3, settings=s).collect()}
    got = run(cohort)
    assert len(got) == 240 * 2 * (1 + 2 + 3)
    total = {}
    for (i, target, repeat, c), r in got.items():
        if c is not None:
            total[i, target, repeat] = total.get((i, target, repeat), 0) + r.p
    assert np.allclose(list(total.values()), 1)
    size = [(r.y, r.p) for r in got.values() if r.target == "size"]
    assert np.corrcoef(*zip(*size))[0, 1] > 0.85
    right = [(r.p > 0.5) == (r.y == 1) for r in got.values() if r.target == "sign" and r["class"] == 1]
    assert np.mean(right) > 0.85
    best = {k: max((got[*k, c].p, c) for c in range(3))[1] == got[*k, 0].y for k in {k[:3] for k in got} if k[1] == "group"}
    assert np.mean(list(best.values())) > 0.75
    # labels of fold 1 of the first repeat changed: its predictions there stay as they are
    changed = cohort.withColumn("y", F.when(F.col("fold")[0] == 1, F.transform("y", lambda v: F.lit(0.0))).otherwise(F.col("y")))
    other = run(changed)
    mine = [k for k, r in got.items() if k[2] == 1 and r.fold == 1]
    assert mine and all(math.isclose(got[k].p, other[k].p, abs_tol=1e-9) for k in mine)


def test_one_tree_is_the_best_split(spark):
    """Leaf weights and gain of a stump against all splits tried by hand."""
    x, y = np.arange(40.0), np.where(np.arange(40) < 22, 1.0, 5.0)
    rows = spark.createDataFrame([(i, [float(x[i])], [float(y[i])], [1 if i == 0 else 2]) for i in range(40)], "id long, x array<double>, y array<double>, fold array<int>")
    s = boosting.Settings(trees=1, depth=1, rate=1.0, rows=1.0, columns=1.0, child_weight=1.0, l2=2.0, l1=0.0, bins=64)
    got = {r.id: r.p for r in boosting.cross_boosted(rows, "id", [boosting.Target("t", "regression")], repeats=1, folds=2, settings=s).collect()}
    base = y[1:].mean()
    low = base - ((base - y[1:22]).sum()) / (21 + 2)
    assert math.isclose(got[0], low, rel_tol=1e-9)


def test_out_of_fold_classes(spark, cohort):
    rows = cohort.select("id", F.col("y")[2].alias("y"), array_to_vector(F.transform("x", lambda v: F.nanvl(v, F.lit(0.0)))).alias("features"), F.slice("fold", 1, 2).alias("fold"))
    got = models.out_of_fold(rows, models.linear_classifier, "id", "multiclass", 3, 2)
    sums = got.groupBy("id", "repeat").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sums) == 480 and all(r.n == 3 and math.isclose(r.p, 1, abs_tol=1e-9) for r in sums)
    mean = models.class_averages(got, ["id"])
    assert mean.count() == 720 and mean.filter("repeats = 2").count() == 720


def test_nested_refit_has_coefficients(spark, cohort):
    rows = cohort.select("id", F.col("y")[1].alias("y"), array_to_vector(F.transform("x", lambda v: F.nanvl(v, F.lit(0.0)))).alias("features"), F.col("fold")[0].alias("fold"))
    preds, table = models.nested(rows, "id", ["a", "b", "c"], outer=3, inner=2, grid=[{"strength": 0.01, "mix": 0.0}, {"strength": 1.0, "mix": 1.0}])
    assert preds.count() == 240
    found = {(r.fold, r.feature): r for r in table.collect()}
    assert {f for f, _ in found} == {"1", "2", "3", "full"} and found["full", "a"].coefficient > 3 * abs(found["full", "c"].coefficient)
