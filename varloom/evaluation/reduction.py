"""Random directions, truncated SVD and a two-dimensional map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators import features as ft
from varloom.operators.kernels import with_rows
from varloom.session import settle

#: Features up to which the Gram matrix is formed (8 MB a task).
EXACT = 1024


def random_direction_features(counts: DataFrame, basis: DataFrame, *, n_dirs: int, seed: int) -> DataFrame:
    """Weighted means of the first three powers of projections on seeded unit directions."""
    d = basis.select(F.max(F.size("embedding"))).first()[0]
    w = np.random.default_rng(seed).normal(size=(d, n_dirs))
    w /= np.maximum(np.linalg.norm(w, axis=0, keepdims=True), 1e-12)

    def powers(x):
        p = x @ w
        return np.concatenate([p, p**2, p**3], axis=1)

    projected = with_rows(basis.select("vec_id", "embedding"), "embedding", "q", powers).select("vec_id", "q")
    return ft.weighted_mean(counts.join(projected, "vec_id"), ["sample"], "q", "n")


def block_products(entries: DataFrame, key: str, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Q'X'XQ, X'XQ) of the sparse rows X: one small dense product a task.

    ``entries``: one row a sample with feature numbers ``i`` and values ``x``; ``q`` has a row a feature and few columns.
    """
    width, k = q.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner, back = np.zeros((k, k)), np.zeros((width, k))
        for pdf in batches:
            size = pdf["i"].map(len).to_numpy()
            row, i = np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["i"].to_numpy()).astype(int)
            x = np.concatenate(pdf["x"].to_numpy())
            y = np.zeros((len(pdf), k))
            np.add.at(y, row, x[:, None] * q[i])
            inner += y.T @ y
            np.add.at(back, i, x[:, None] * y[row])
        yield pd.DataFrame({"row": range(k + width), "v": [*inner, *back]})

    each = entries.select("i", "x").mapInPandas(run, "row int, v array<double>").select("row", F.posexplode("v").alias("at", "v"))
    got = each.groupBy("row", "at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((k + width, k))
    out[got["row"], got["at"]] = got["v"]
    return out[:k], out[k:]


def gram(entries: DataFrame, width: int) -> np.ndarray:
    """X'X of the sparse rows; each task sends the products of its rows once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((width, width))
        for pdf in batches:
            size = pdf["i"].map(len).to_numpy()
            x = np.zeros((len(pdf), width))
            np.add.at(x, (np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["i"].to_numpy()).astype(int)), np.concatenate(pdf["x"].to_numpy()))
            out += x.T @ x
        yield pd.DataFrame({"row": range(width), "v": list(out)})

    each = entries.select("i", "x").mapInPandas(run, "row int, v array<double>").select("row", F.posexplode("v").alias("at", "v"))
    got = each.filter("v <> 0").groupBy("row", "at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[got["row"], got["at"]] = got["v"]
    return out


def numbered_entries(counts: DataFrame, key: str, limit: int) -> tuple[DataFrame, int]:
    """One row a sample with the numbers and log1p values of its features, and the number of features, in name order.

    Features are numbered by a table of their own and never collected; beyond ``limit`` of them the caller must select first.
    """
    names = counts.select("feature").distinct()
    width = names.limit(limit + 1).count()
    if width > limit:
        raise ValueError(f"more than {limit} features: select some first")
    numbers = names.withColumn("i", F.row_number().over(Window.orderBy("feature")) - 1)  # at most ``limit`` rows
    rows = counts.join(numbers, "feature").groupBy(key).agg(F.collect_list(F.struct("i", F.log1p("n").alias("x"))).alias("e"))
    return settle(rows.select(key, F.col("e.i").alias("i"), F.col("e.x").alias("x")), "entries"), width


def right_vectors(entries: DataFrame, key: str, width: int, k: int, *, extra: int = 10, rounds: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of the sparse rows.

    Up to ``EXACT`` features from the Gram matrix, in one pass. Beyond by subspace iteration from seeded directions: a round is
    one pass that sends (features + k) x k numbers a task; it ends when the values change by less than ``tol``.
    """
    if width <= EXACT:
        values, vectors = np.linalg.eigh(gram(entries, width))
        values, vectors = values[::-1], vectors[:, ::-1]
        return _signed(vectors[:, :k]), np.sqrt(np.maximum(values[:k], 0.0))
    size = min(width, k + extra)
    q, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(width, size)))
    last = None
    for _ in range(rounds):
        inner, back = block_products(entries, key, q)
        values, turn = np.linalg.eigh(inner)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        if last is not None and np.abs(values[:k] - last).max(initial=0.0) <= tol * max(values[0], 1e-300):
            break
        last = values[:k]
        q, _ = np.linalg.qr(back)
    return _signed(vectors[:, :k]), np.sqrt(np.maximum(values[:k], 0.0))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def truncated_svd(counts: DataFrame, key: str, ks: list[int], limit: int = 100_000) -> DataFrame:
    """Uncentred truncated SVD scores of log1p counts (PCA would centre): ``(key, k, component, score)`` for every ``k``.

    The components of a smaller ``k`` are the first of a larger one, so all come from one decomposition.
    """
    entries, width = numbered_entries(counts, key, limit)
    v, values = right_vectors(entries, key, width, min(max(ks), width))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["i"].map(len).to_numpy()
            out = np.zeros((len(pdf), v.shape[1]))
            np.add.at(out, np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["x"].to_numpy())[:, None] * v[np.concatenate(pdf["i"].to_numpy()).astype(int)])
            yield pd.DataFrame({key: pdf[key], "scores": list(out)})

    kind = entries.schema[key].dataType.simpleString()
    scores = entries.mapInPandas(project, f"{key} {kind}, scores array<double>").select(key, F.posexplode("scores").alias("component", "score"))
    return scores.select(key, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "component", "score").filter("component < k")


def two_dimensional_map(vectors: DataFrame, name: str, vec: str) -> DataFrame:
    data = vectors.select(name, array_to_vector(vec).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(data)
    return model.transform(data).select(name, vector_to_array("xy").alias("xy")).select(name, F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
