"""Paired tests, resampling and false-discovery control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.evaluation import metrics as met
from varloom.evaluation.quantiles import join_keys, midranks, quantiles, running_totals, suffix_minimum, value_runs
from varloom.session import parallel_width, settle

#: Rows whose replicates are added up at once.
SLICE = 4096

# Coefficients of the rational Chebyshev fit of erfc (relative error below 1.2e-7).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative column."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi_square_tail(x: Column, df: int) -> Column:
    """Survival function for a whole number of degrees of freedom."""
    half = x / 2.0
    if df % 2 == 0:
        terms = [F.pow(half, F.lit(float(i))) / math.factorial(i) for i in range(df // 2)]
        return F.exp(-half) * sum(terms[1:], terms[0])
    out = erfc(F.sqrt(half))
    for i in range(1, (df + 1) // 2):
        out = out + F.exp(-half) * F.pow(half, F.lit(i - 0.5)) / math.gamma(i + 0.5)
    return out


def delong(preds: DataFrame, keys: list[str], y: str, a: str, b: str, *, floor: float | None = None) -> DataFrame:
    """Paired DeLong test of AUROC(a) − AUROC(b).

    ``floor`` None: a variance of zero or less gives p = 1; otherwise the variance is raised to it.
    Placement values are computed per distinct score and joined back to the rows.
    """
    out = preds
    for name in (a, b):
        runs = met._runs(preds, keys, y, name)
        v = F.try_divide(F.col("before_neg") + F.col("neg") / 2.0, "all_neg").alias(f"_p_{name}")
        w = F.try_divide(F.col("all_pos") - F.col("before_pos") - F.col("pos") / 2.0, "all_pos").alias(f"_n_{name}")
        out = out.join(runs.select(*keys, name, v, w), [*keys, name])
    pos, neg = F.col(y) == 1, F.col(y) == 0
    pick = lambda cond, c: F.when(cond, F.col(c))
    diff = lambda cond, s: pick(cond, f"_{s}_{a}") - pick(cond, f"_{s}_{b}")
    s = out.groupBy(*keys).agg(
        F.avg(pick(pos, f"_p_{a}")).alias("auc_a"), F.avg(pick(pos, f"_p_{b}")).alias("auc_b"),
        # var(a) + var(b) - 2 cov(a, b) is the variance of the paired difference
        F.var_samp(diff(pos, "p")).alias("vp"), F.var_samp(diff(neg, "n")).alias("vn"),
        F.count_if(pos).alias("np"), F.count_if(neg).alias("nn"),
    )
    var = F.try_divide("vp", "np") + F.try_divide("vn", "nn")
    delta = F.col("auc_a") - F.col("auc_b")
    if floor is None:
        p = F.when(F.coalesce(var, F.lit(0.0)) <= 1e-18, 1.0).otherwise(two_sided(delta / F.sqrt(var)))
    else:
        p = two_sided(delta / F.sqrt(F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(floor))))
    return s.select(*keys, "auc_a", "auc_b", delta.alias("delta"), p.alias("p_value"))


def hash_number(text: Column) -> Column:
    """52 bits of a SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def numbered(preds: DataFrame, groups: list[str], identity: str, seed: str) -> DataFrame:
    """Adds ``idx`` 0..n-1 within the groups in hash order, and ``n``.

    Hashes are evenly spread, so bins of equal width hold about equally many and no cut points are looked for. Hashes are stored
    once; bins are added up first and a window runs only inside one.
    """
    bins = parallel_width(preds.sparkSession)
    h = preds.withColumn("_h", hash_number(F.concat_ws("|", F.lit(seed), F.col(identity).cast("string"))))
    runs = settle(value_runs(h, groups, "_h", {"c": F.count(F.lit(1))}), "hashes")
    runs = runs.withColumn("_bin", F.floor(F.col("_h") / float(1 << 52) * bins).cast("int"))
    key = Window.partitionBy(*groups)
    sizes = runs.groupBy(*groups, "_bin").agg(F.sum("c").alias("_t"))
    sizes = sizes.select(*groups, "_bin", F.coalesce(F.sum("_t").over(key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(key).alias("n"))
    inner = Window.partitionBy(*groups, "_bin").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = runs.join(sizes, [*groups, "_bin"]).select(*groups, "_h", (F.col("_o") + F.coalesce(F.sum("c").over(inner), F.lit(0))).alias("idx"), "n")
    return h.join(ranked, [*groups, "_h"]).drop("_h")


#: Modulus of the replicate numbers; how often a row is drawn is looked up among these parts of it: the distribution of a Poisson count of mean 1.
MODULUS = 2**31 - 1
POISSON = [math.floor(MODULUS * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(13)]


def hash_words(text: Column) -> Column:
    """Four whole numbers below 2**28 from one SHA-256."""
    h = F.sha2(text, 256)
    return F.array(*[F.conv(F.substring(h, 7 * i + 1, 7), 16, 10).cast("long") for i in range(4)])


def multiplicities(words: np.ndarray, replicates: int) -> np.ndarray:
    """Rows x replicates: how often each row is drawn; replicate r reads its number from a cubic polynomial in r."""
    r = np.arange(1, replicates + 1, dtype=np.int64)
    v = (words[:, 0:1] + r * words[:, 1:2] + r**2 * words[:, 2:3] + r**3 * words[:, 3:4]) % MODULUS
    return np.searchsorted(np.array(POISSON), v.ravel(), side="right").reshape(v.shape)


def replicate_areas(preds: DataFrame, y: str, score: str, words: str, replicates: int) -> DataFrame:
    """(replicate, auroc) of a weighted bootstrap, without a row for each replicate.

    Rows are cut into bins of the score. A cut point's own value is a bin of one run of ties, whose rows may be dealt to any
    number of tasks; between two cut points lie about equally many rows, which are put in order and added up in slices. Every
    group keeps arrays with one number a replicate: positives, negatives and pairs won inside it. Bins then meet by replicate.
    """
    wide = parallel_width(preds.sparkSession)
    rows = preds.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).select(F.col(score).cast("double").alias("s"), (F.col(y) == 1).alias("pos"), F.col(words).alias("h"))
    cuts = settle(rows.agg(F.array_distinct(F.percentile_approx("s", [i / wide for i in range(1, wide)], 4 * wide)).alias("cuts")), "score-cuts")
    below, at = F.size(F.filter("cuts", lambda c: c < F.col("s"))), F.array_contains("cuts", F.col("s"))
    rows = rows.join(F.broadcast(cuts)).select("s", "pos", "h", (2 * below + at.cast("int")).alias("bin"), F.when(at, F.pmod(F.xxhash64("h"), F.lit(wide))).otherwise(0).alias("salt"))

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s", kind="stable")
        score, pos, words = pdf["s"].to_numpy(), pdf["pos"].to_numpy(), np.array(pdf["h"].tolist(), dtype=np.int64)
        before, won, positives = (np.zeros(replicates, dtype=np.int64) for _ in range(3))
        open_pos, open_neg = (np.zeros(replicates, dtype=np.int64) for _ in range(2))
        for i in range(0, len(score), SLICE):
            m = multiplicities(words[i : i + SLICE], replicates)
            part, p = score[i : i + SLICE], pos[i : i + SLICE, None]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            up, down = np.add.reduceat(m * p, first), np.add.reduceat(m * ~p, first)
            if i and score[i] != score[i - 1]:  # the run left open ends here
                won, before = won + open_pos * (2 * before + open_neg), before + open_neg
                open_pos, open_neg = 0 * open_pos, 0 * open_neg
            up[0] += open_pos
            down[0] += open_neg
            start = before + np.concatenate([np.zeros((1, replicates), dtype=np.int64), np.cumsum(down, axis=0)[:-1]])
            won = won + (up[:-1] * (2 * start[:-1] + down[:-1])).sum(axis=0)
            before, open_pos, open_neg = start[-1], up[-1], down[-1]
            positives = positives + (m * p).sum(axis=0)
        won, before = won + open_pos * (2 * before + open_neg), before + open_neg
        return pd.DataFrame({"bin": [pdf["bin"].iloc[0]], "pos": [positives], "neg": [before], "won": [won]})

    parts = rows.groupBy("bin", "salt").applyInPandas(area, "bin int, pos array<long>, neg array<long>, won array<long>")
    each = parts.select("bin", F.posexplode(F.arrays_zip("pos", "neg", "won")).alias("replicate", "x"))
    each = each.groupBy("replicate", "bin").agg(*[F.sum(f"x.{c}").alias(c) for c in ("pos", "neg", "won")])
    lower = Window.partitionBy("replicate").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # pairs are counted twice, ties once; salted parts of a run of ties are put together first
    inside = F.when(F.col("bin") % 2 == 1, F.col("pos") * F.col("neg")).otherwise(F.col("won"))
    pairs = (inside + 2 * F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0))).alias("pairs")
    return each.select("replicate", "pos", "neg", pairs).groupBy("replicate").agg(
        F.try_divide(F.sum("pairs") / 2.0, F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def replicate_deltas(preds: DataFrame, y: str, a: str, b: str, identity: str, *, replicates: int, seed: str) -> DataFrame:
    """AUROC(a) - AUROC(b) of every bootstrap replicate; both scores of a row are drawn alike.

    A row is drawn a Poisson number of times, which a hash of seed and identity gives, so rows need no numbers and nothing
    is dealt out by replicate. AUROC divides by the drawn positives and negatives, so the classes need no strata.
    """
    rows = settle(preds.select(y, a, b, hash_words(F.concat_ws("|", F.lit(seed), F.col(identity).cast("string"))).alias("_h")), "scores")
    sides = [replicate_areas(rows, y, s, "_h", replicates).withColumnRenamed("auroc", n) for s, n in ((a, "_a"), (b, "_b"))]
    return sides[0].join(sides[1], "replicate").select((F.col("replicate") + 1).alias("replicate"), (F.col("_a") - F.col("_b")).alias("delta"))


def delta_summary(deltas: DataFrame, keys: list[str], delta: str, *, smoothed: bool) -> DataFrame:
    """Two-sided p and percentile interval from replicate deltas; the +1 rule is the ``smoothed`` one."""
    valid = deltas.filter(F.col(delta).isNotNull() & ~F.isnan(delta))
    lo, hi, n = F.count_if(F.col(delta) <= 0), F.count_if(F.col(delta) >= 0), F.count(F.lit(1))
    k = 1.0 if smoothed else 0.0
    p = F.least(F.lit(1.0), 2.0 * F.least((lo + k) / (n + k), (hi + k) / (n + k)))
    s = valid.groupBy(*keys).agg(p.alias("p_value"), n.alias("n_resamples"))
    return join_keys(s, quantiles(valid, keys, delta, {"ci_low": 0.025, "ci_high": 0.975}), keys)


def wilcoxon(pairs: DataFrame, keys: list[str], d: str, *, min_n: int = 2) -> DataFrame:
    """Paired signed-rank test: zero differences dropped, normal approximation with tie correction."""
    nz = pairs.filter(F.col(d) != 0).withColumn("_abs", F.abs(d))
    runs = value_runs(nz, keys, "_abs", {"n": F.count(F.lit(1)), "up": F.count_if(F.col(d) > 0)})
    r = running_totals(runs, keys, "_abs", ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2.0)
    s = r.groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("up")).alias("wp"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("wm"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"), F.max("all_n").alias("m"),
    ).filter(F.col("m") >= min_n)
    m = F.col("m")
    stat = F.least("wp", "wm")
    var = m * (m + 1) * (2 * m + 1) / 24.0 - F.col("ties") / 48.0
    z = (stat - m * (m + 1) / 4.0) / F.sqrt(var)
    return s.select(*keys, stat.alias("statistic"), m.alias("n"), z.alias("z"), F.when(var > 0, two_sided(z)).otherwise(1.0).alias("p_value"))


def friedman(scores: DataFrame, block: str, model: str, value: str, k: int) -> DataFrame:
    """Tie-corrected Friedman test over ``k`` models; only blocks with all models count.

    A block has ``k`` rows, so ranking inside it is a bounded window.
    """
    w = Window.partitionBy(block)
    tie = Window.partitionBy(block, value)
    full = scores.withColumn("_k", F.count(F.lit(1)).over(w)).filter(F.col("_k") == k)
    t = F.count(F.lit(1)).over(tie)
    ranked = full.withColumns({"rank": F.rank().over(w.orderBy(value)) + (t - 1) / 2.0, "t": t})
    by = ranked.groupBy(model).agg(F.sum("rank").alias("R"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"), F.count(F.lit(1)).alias("n"))
    # each tie group of size t contributes t members of (t² - 1), that is t³ - t
    s = by.agg(F.sum(F.col("R") * F.col("R")).alias("r2"), F.sum("ties").alias("ties"), F.max("n").alias("n"))
    n = F.col("n")
    chi = (12.0 * F.col("r2") / (n * k * (k + 1)) - 3.0 * n * (k + 1)) / (1.0 - F.col("ties") / (n * k * (k * k - 1.0)))
    return s.select(n.alias("n_blocks"), chi.alias("statistic"), chi_square_tail(chi, k - 1).alias("p_value"))


def steiger(preds: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """Compare two dependent rank correlations with the same outcome."""
    r = met.spearman(preds, keys, y, a, "r12")
    r = join_keys(r, met.spearman(preds, keys, y, b, "r13"), keys)
    r = join_keys(r, met.spearman(preds, keys, a, b, "r23"), keys)
    r = join_keys(r, preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    r12, r13, r23 = F.col("r12"), F.col("r13"), F.col("r23")
    fz = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    rho = (r23 * (1 - r12**2 - r13**2) + 0.5 * r12 * r13 * (r12**2 + r13**2 + r23**2 - 1)) / ((1 - r12**2) * (1 - r13**2))
    var = F.greatest((2 - 2 * rho) / F.greatest(F.col("n") - 3, F.lit(1)), F.lit(1e-12))
    z = (fz(r13) - fz(r12)) / F.sqrt(var)
    return r.select(*keys, "r12", "r13", z.alias("z"), two_sided(z).alias("p_value"))


def normal_interval(deltas: DataFrame, keys: list[str], d: str) -> DataFrame:
    """Mean ± 1.96 SE and z-test; one value has no interval, no spread gives p 0 or 1."""
    s = deltas.filter(F.col(d).isNotNull()).groupBy(*keys).agg(F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), F.count(d).alias("n"))
    m, se = F.col("mean"), F.col("se")
    p = (
        F.when(F.col("n") <= 1, F.lit(None).cast("double")).when(se <= 1e-15, F.when(F.abs(m) > 1e-15, 0.0).otherwise(1.0))
        .otherwise(two_sided(m / se))
    )
    return s.select(*keys, "mean", (m - 1.96 * se).alias("ci_low"), (m + 1.96 * se).alias("ci_high"), p.alias("p_value"), "n")


def bh(tests: DataFrame, groups: list[str], p: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg per group, nulls kept null. Tied p-values share the largest rank.

    The tests are stored first: p-values computed again, from sums in another order, may differ in the last digit and find no rank.
    """
    tests = settle(tests, "tests")
    runs = value_runs(tests.filter(F.col(p).isNotNull()), groups, p, {"n": F.count(F.lit(1))})
    ranked = running_totals(runs, groups, p, ["n"])
    adj = ranked.withColumn("_adj", F.col(p) * F.col("all_n") / (F.col("before_n") + F.col("n")))
    q = suffix_minimum(adj, groups, p, "_adj", "_q").select(*groups, p, F.least("_q", F.lit(1.0)).alias(out))
    return tests.join(q, [*groups, p], "left")


def stars(q: Column) -> Column:
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").when(q < 0.10, ".").otherwise("")
