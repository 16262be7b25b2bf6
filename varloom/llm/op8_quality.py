"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from statistics of its characters and words; gated attention
(tanh times sigmoid) learns from the documents' labels how much each passage counts, and the weighted mean of the codes is
scored. A fit reads a bounded sample of labelled rows; scoring runs over whole texts where they lie.

A text without words is one empty passage. Without labels of both kinds every score is 0.5. Repeated rows are judged each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.sampling import labelled_sample, remainder
from varloom.llm.scan import buffers, chunks, words
from varloom.llm.store import cached

#: Labelled rows of each label, about, that a fit reads; chosen by a hash of the id.
SAMPLE = 1500
PASSAGE = 48  # words
CODE, GATE, EPOCHS = 24, 12, 60
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "|", "!?", "#*$%&<>", ".,;:", "\n", "()[]{}\"'", "/\\@=_+-~^`"]


def byte_class() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for i, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = i + 1
    out[128:] = len(CLASSES) + 1
    return out


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, ends of each document's passages)."""
    w = words(data, offsets, "space_folded")
    count = np.diff(w.first)
    number = np.maximum(1, -(-count // PASSAGE))
    ends = np.concatenate([[0], np.cumsum(number)])
    doc = np.repeat(np.arange(len(count)), number)
    a = w.first[doc] + (np.arange(ends[-1]) - ends[doc]) * PASSAGE
    b = np.minimum(a + PASSAGE, w.first[doc + 1])
    n = (b - a).astype(np.float64)
    full = b > a
    last = max(len(w.starts) - 1, 0)
    first_byte = np.where(full, w.starts[np.minimum(a, last)], 0) if len(w.starts) else np.zeros(len(a), np.int64)
    last_byte = np.where(full, w.ends[np.maximum(b - 1, 0)], 0) if len(w.starts) else np.zeros(len(a), np.int64)
    size = np.maximum(1, last_byte - first_byte)
    kind = cached("byte-class", byte_class)[data]
    x = [np.log1p(n), size / np.maximum(1, n) / 8]
    for k in range(1, len(CLASSES) + 2):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        x.append((total[last_byte] - total[first_byte]) / size * 4)
    of = np.repeat(np.arange(len(a)), b - a)
    key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (w.hashes >> np.uint64(24)))
    new = np.concatenate([[0], np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))]) if len(key) else np.zeros(1, np.int64)
    edge = np.concatenate([[0], np.cumsum(b - a)])
    x.append((new[edge[1:]] - new[edge[:-1]]) / np.maximum(1, n))
    same = np.zeros(len(w.hashes) + 1)
    same[2:] = np.cumsum(w.hashes[1:] == w.hashes[:-1]) if len(w.hashes) > 1 else 0
    x.append(np.where(n > 1, same[np.maximum(b, 1)] - same[np.minimum(a + 1, len(w.hashes))], 0) / np.maximum(1, n))
    long = np.concatenate([[0], np.cumsum((w.ends - w.starts) > 12)])
    x.append((long[b] - long[a]) / np.maximum(1, n))
    return np.stack(x, axis=1), ends


@dataclass
class Model:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None


def bag_sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, ends[:-1], axis=0)


def forward(p: dict[str, np.ndarray], x: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Codes, gates, attention and scores of bags of standardised passages."""
    size = np.diff(ends)
    h = np.tanh(x @ p["encode"] + p["encode0"])
    t, g = np.tanh(h @ p["tanh"]), 1 / (1 + np.exp(-(h @ p["gate"])))
    e = (t * g) @ p["attend"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, ends[:-1]), size))
    a = e / np.repeat(np.add.reduceat(e, ends[:-1]), size)
    z = bag_sums(a[:, None] * h, ends)
    s = 1 / (1 + np.exp(-np.clip(z @ p["score"] + p["score0"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": s}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the weighted logistic loss in all weights."""
    f, size = forward(p, x, ends), np.diff(ends)
    d = (f["s"] - y) * weight
    out = {"score": f["z"].T @ d, "score0": d.sum(keepdims=True)}
    dz = np.repeat(d[:, None] * p["score"], size, axis=0)
    along = (dz * f["h"]).sum(1)
    de = f["a"] * (along - np.repeat(np.add.reduceat(f["a"] * along, ends[:-1]), size))
    out["attend"] = (f["t"] * f["g"]).T @ de
    dt = de[:, None] * p["attend"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["attend"] * f["t"] * f["g"] * (1 - f["g"])
    out["tanh"], out["gate"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (f["a"][:, None] * dz + dt @ p["tanh"].T + dg @ p["gate"].T) * (1 - f["h"] ** 2)
    out["encode"], out["encode0"] = x.T @ dh, dh.sum(0)
    return out


def fit(rows: list[tuple[str, int]], share: float = 0.5, seed: int = 5) -> Model:
    """Learn from (text, label) rows by Adam steps on groups of documents; ``share`` is label 1's share of all labelled rows."""
    y = np.array([v for _, v in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Model()
    x, ends = passages(*buffers(pa.array([t for t, _ in rows], pa.string())))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
    p = {"encode": make(x.shape[1], CODE), "encode0": np.zeros(CODE), "tanh": make(CODE, GATE), "gate": make(CODE, GATE), "attend": make(GATE), "score": make(CODE), "score0": np.zeros(1)}
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    rate = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            size = np.diff(ends)[some]
            until = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(ends[some] - until[:-1], size) + np.arange(until[-1])
            slope = gradients(p, x[take], until, y[some], rate[some] / len(some))
            step += 1
            for k in p:
                g = slope[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(p, mean, scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                if model.weights:
                    x, ends = passages(data, offsets)
                    s = forward(model.weights, (x - model.mean) / model.scale, ends)["s"]
                else:
                    s = np.full(j - i, 0.5)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s)], names=["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit(*labelled_sample(docs, table(spark, folder, "labels"), "quality", remainder(4) != 2, SAMPLE))
    found = score(docs.withColumn("held_out", remainder(4) == 2), model)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
