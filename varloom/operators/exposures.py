"""Non-negative exposure fits over a cohort, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.evaluation.metrics import pearson
from varloom.evaluation.quantiles import quantiles
from varloom.operators import features as ft
from varloom.session import settle

MAX_REFERENCE_VALUES = 4_000_000


def matched_reference(reference: DataFrame, channels: DataFrame) -> DataFrame:
    """Reference rows whose channel occurs in the input, columns rescaled to one."""
    kept = reference.join(channels.select("channel").distinct(), "channel", "left_semi")
    total = kept.groupBy("signature").agg(F.sum("p").alias("t"))
    return kept.join(total, "signature").select(
        "signature", "channel", F.when(F.col("t") > 1e-15, F.col("p") / F.col("t")).otherwise(0.0).alias("p")
    )


def reference_matrix(reference: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """(channels, signatures, matrix); the catalogue is a dimension and its size is checked."""
    size = reference.agg(F.countDistinct("channel").alias("c"), F.countDistinct("signature").alias("s")).first()
    if size.c * size.s > MAX_REFERENCE_VALUES:
        raise ValueError(f"reference of {size.c} x {size.s} is too large to ship to every task")
    pdf = reference.toPandas().pivot(index="channel", columns="signature", values="p").fillna(0.0).sort_index()
    return list(pdf.index), list(pdf.columns), pdf.to_numpy()


def coordinate_descent(gram: np.ndarray, atb: np.ndarray, penalty: float = 0.0, tol: float = 1e-12, rounds: int = 20_000) -> np.ndarray:
    """Non-negative minimisers of ½wᵀGw − w·(Aᵀb − penalty) for all rows of ``atb`` at once."""
    w = np.zeros_like(atb)
    diag = np.maximum(np.diag(gram), 1e-15)
    target = atb - penalty
    for _ in range(rounds):
        change = 0.0
        for j in range(gram.shape[0]):
            new = np.maximum(0.0, w[:, j] + (target[:, j] - w @ gram[:, j]) / diag[j])
            change = max(change, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if change < tol:
            break
    return w


def fit(profiles: DataFrame, reference: DataFrame, *, groups: dict[str, str] | None = None, penalty: float = 0.0) -> DataFrame:
    """Exposures ``(patient, signature, weight)`` of sample profiles ``(patient, channel, p)``.

    Profiles become one short array per sample by a partial aggregation; batches of samples are solved
    together against the shared Gram matrix. With ``groups`` (signature -> group) the weights are
    normalised within each group, else over all signatures. ``penalty`` is the L1 strength.
    Empty and non-finite profiles give zero weights.
    """
    channels, signatures, a = reference_matrix(reference)
    numbers = profiles.sparkSession.createDataFrame(list(zip(channels, range(len(channels)), strict=True)), "channel string, i int")
    packed = packed_profiles(profiles, numbers)
    gram = a.T @ a
    group_of = np.array([0 if groups is None else sorted(set(groups.values())).index(groups[s]) for s in signatures])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = dense_rows(pdf, a.shape[0])
            usable = np.isfinite(b).all(1) & (b.sum(1) > 1e-15)
            w = np.zeros((len(pdf), a.shape[1]))
            if usable.any():
                w[usable] = coordinate_descent(gram, b[usable] @ a, penalty * a.shape[0])
            for g in np.unique(group_of):
                part = w[:, group_of == g]
                s = part.sum(1, keepdims=True)
                w[:, group_of == g] = np.divide(part, s, out=np.zeros_like(part), where=s > 1e-15)
            yield pd.DataFrame({"patient": pdf["patient"], "w": list(w)})

    names = F.array(*[F.lit(s) for s in signatures])
    solved = packed.mapInPandas(run, "patient string, w array<double>")
    return solved.select("patient", F.posexplode("w").alias("i", "weight")).select(
        "patient", F.element_at(names, F.col("i") + 1).alias("signature"), "weight"
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 1e-15, a / b).otherwise(0.0)


def evaluate(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per patient from ``(patient, signature, truth, pred)``: similarity, errors, detection and top-1."""
    t, p = F.col("truth"), F.col("pred")
    tp, fp, fn = (F.count_if(c) for c in ((p > threshold) & (t > threshold), (p > threshold) & (t <= threshold), (p <= threshold) & (t > threshold)))
    s = pairs.groupBy("patient").agg(
        _ratio(F.sum(t * p), F.sqrt(F.sum(t * t)) * F.sqrt(F.sum(p * p))).alias("cosine"), F.avg(F.abs(t - p)).alias("mae"),
        F.sum(F.abs(t - p)).alias("l1"), F.coalesce(F.when((F.stddev_pop(t) > 1e-12) & (F.stddev_pop(p) > 1e-12), pearson("truth", "pred")), F.lit(0.0)).alias("pearson"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        (F.min_by("signature", F.struct(-t, "signature")) == F.min_by("signature", F.struct(-p, "signature"))).alias("top1"),
    )
    pr, rc = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return s.select("patient", "cosine", "mae", "l1", "pearson", "top1", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"))


def diagnostics(exposures: DataFrame, reference: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cosine and relative error between each profile and its reconstruction."""
    rec = exposures.join(F.broadcast(reference), "signature").groupBy("patient", "channel").agg(F.sum(F.col("weight") * F.col("p")).alias("r"))
    both = profiles.join(rec, ["patient", "channel"], "full").fillna(0.0, ["p", "r"])
    p, r = F.col("p"), F.col("r")
    return both.groupBy("patient").agg(
        _ratio(F.sum(p * r), F.sqrt(F.sum(p * p)) * F.sqrt(F.sum(r * r))).alias("cosine"),
        (F.sqrt(F.sum((r - p) * (r - p))) / (F.sqrt(F.sum(p * p)) + 1e-15)).alias("error"),
    )


def summaries(metrics: DataFrame, keys: list[str], value: str) -> DataFrame:
    mean = metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return mean.join(quantiles(metrics, keys, value, {"median": 0.5}), keys)


def bridge(weights: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move weights ``(sample, process, w)`` to mapped processes and renormalise."""
    moved = weights.join(F.broadcast(mapping), "process").groupBy("sample", F.col("target").alias("process")).agg(F.sum("w").alias("w"))
    return ft.shares(moved, "sample", "w").select("sample", "process", F.col("p").alias("w"))


def packed_profiles(profiles: DataFrame, channels: DataFrame) -> DataFrame:
    """(patient, i, p): the numbers of a sample's channels and their shares; channels must be a bounded set (channel, i)."""
    entries = profiles.join(channels, "channel").select("patient", F.struct("i", "p").alias("e"))
    return entries.groupBy("patient").agg(F.collect_list("e").alias("e")).select("patient", F.col("e.i").alias("i"), F.col("e.p").alias("p"))


def dense_rows(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """The packed rows of a batch as a matrix; repeated channels add up."""
    size = pdf["i"].map(len).to_numpy()
    out = np.zeros((len(pdf), width))
    if size.sum():
        np.add.at(out, (np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["i"].to_numpy()).astype(int)), np.concatenate(pdf["p"].to_numpy()))
    return out


def factor_pass(rows: DataFrame, h: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per start: W'X, W'W and the squared error, W being the best non-negative weights of every row for that start's factors.

    W is solved where the rows are and not kept. Each task sends one row of (channels + rank) x rank + 1 numbers a start.
    """
    rank, width = next(iter(h.values())).shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {s: np.zeros(rank * width + rank * rank + 1) for s in h}
        for pdf in batches:
            x = dense_rows(pdf, width)
            for s, factors in h.items():
                gram, xh = factors @ factors.T, x @ factors.T
                w = coordinate_descent(gram, xh, tol=1e-10, rounds=2000)
                error = (x * x).sum() - 2 * (w * xh).sum() + (w.T @ w * gram).sum()
                sums[s] += np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [error]])
        yield pd.DataFrame({"start": list(sums), "v": list(sums.values())})

    each = rows.select("i", "p").mapInPandas(run, "start int, v array<double>").select("start", F.posexplode("v").alias("at", "v"))
    got = each.groupBy("start", "at").agg(F.sum("v").alias("v")).toPandas()  # starts x ((channels + rank) x rank + 1) numbers
    out = {}
    for s, part in got.groupby("start"):
        v = part.sort_values("at")["v"].to_numpy()
        out[int(s)] = v[: rank * width].reshape(rank, width), v[rank * width : -1].reshape(rank, rank), float(v[-1])
    return out


def factors(rows: DataFrame, width: int, rank: int, seeds: list[int], *, rounds: int = 1000, tol: float = 1e-5) -> tuple[np.ndarray, dict]:
    """Channel factors (rank x channels) with the least squared error over several starts, by alternating non-negative least squares.

    All starts share the passes over ``rows``; each goes on until its error falls by less than ``tol`` of its first error. Only
    factors, whose size is checked, are on the driver.
    """
    if len(seeds) * rank * (rank + width) > MAX_REFERENCE_VALUES:
        raise ValueError(f"{len(seeds)} starts of {rank} factors over {width} channels are too large to ship to every task")
    going = {s: np.random.default_rng(s).random((rank, width)) + 1e-3 for s in seeds}
    first, last, done = {}, {s: np.inf for s in seeds}, {}
    for turn in range(1, rounds + 1):
        for s, (wx, ww, error) in factor_pass(rows, going).items():
            first.setdefault(s, error)
            converged = last[s] - error <= tol * first[s]
            if converged or turn == rounds:
                done[s] = {"seed": s, "error": error, "rounds": turn, "converged": converged, "factors": going.pop(s)}
                continue
            last[s] = error
            h = coordinate_descent(ww, wx.T, tol=1e-10, rounds=2000).T
            scale = np.linalg.norm(h, axis=1, keepdims=True)
            # an empty factor starts anew instead of staying empty
            going[s] = np.where(scale > 1e-12, h / np.maximum(scale, 1e-12), np.random.default_rng(s + turn).random((rank, width)))
        if not going:
            break
    best = min(done.values(), key=lambda d: (d["error"], d["seed"]))
    return best["factors"], best


def factorise(counts: DataFrame, reference: DataFrame, rank: int, seeds: list[int], **stop) -> DataFrame:
    """Non-negative factorisation of the samples' channel shares, components matched to reference signatures by mutually best cosine.

    One row a component, with the seed, the squared error and the rounds of the best start.
    """
    spark = counts.sparkSession
    seen = counts.select("channel").distinct()
    width = seen.count()
    if width * rank > MAX_REFERENCE_VALUES:
        raise ValueError(f"{rank} factors over {width} channels are too large to ship to every task")
    names = [r[0] for r in seen.orderBy("channel").collect()]  # its number was checked
    channels = spark.createDataFrame(list(zip(names, range(width), strict=True)), "channel string, i int")
    rows = settle(packed_profiles(ft.shares(counts).select("patient", "channel", "p"), channels), "packed-profiles")
    h, best = factors(rows, width, rank, seeds, **stop)
    parts = spark.createDataFrame([(names[i], j, float(h[j, i])) for j in range(rank) for i in range(width)], "channel string, component int, v double")
    dot = parts.join(reference, "channel").groupBy("component", "signature").agg(F.sum(F.col("v") * F.col("p")).alias("dot"))
    na = parts.groupBy("component").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("na"))
    nb = reference.groupBy("signature").agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("nb"))
    cos = settle(dot.join(na, "component").join(nb, "signature").select("component", "signature", _ratio(F.col("dot"), F.col("na") * F.col("nb")).alias("cosine")), "factor-cosines")
    mine = cos.groupBy("component").agg(F.max_by("signature", F.struct("cosine", "signature")).alias("signature"), F.max("cosine").alias("cosine"))
    theirs = cos.groupBy("signature").agg(F.max_by("component", F.struct("cosine", "component")).alias("back"))
    return mine.join(theirs, "signature").select(
        "component", "signature", "cosine", (F.col("component") == F.col("back")).alias("mutual"),
        F.lit(best["seed"]).alias("seed"), F.lit(best["error"]).alias("error"), F.lit(best["rounds"]).alias("rounds"), F.lit(best["converged"]).alias("converged"),
    )
