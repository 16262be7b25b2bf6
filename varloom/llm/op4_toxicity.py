"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts and one on ordinary text. A window that compresses
better with the toxic dictionary resembles toxic text; its gain is the difference of the two lengths. A text is described by
how its windows' gains are distributed: the largest ones and the shares of windows beyond thresholds calibrated on ordinary
training windows. A logistic function of these, fitted on training texts, gives the score.

Toxic texts are ordinary for the most part. So the toxic dictionary is built from what the ordinary dictionary explains
worst: of the words in toxic texts those whose presence is most typical of them, each with the words around it.

Null and empty texts have no windows and get the score of a text without gains. Without labels of both kinds every score is
0. Repeated rows are judged each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.op9_language import logistic
from varloom.llm.registry import query, table
from varloom.llm.sampling import labelled_sample, remainder
from varloom.llm.store import cached

#: Labelled rows of each label, about, that a fit reads; chosen by a hash of the row.
SAMPLE = 1500
WINDOW = 160  # bytes of a window, extended to the end of its last word
DICTIONARY = 1 << 13  # bytes of each dictionary
COMMON = 300  # frequent words in both dictionaries
CARRIER = 128
LEVEL = 3
THRESHOLDS = [0.9, 0.99, 0.999, 0.9999]  # quantiles of ordinary windows' gains


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    cuts: tuple[float, ...] = ()
    weights: np.ndarray | None = None
    bias: float = 0.0
    name: str = "none"


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Successive runs of whole words of at least ``size`` bytes, each with a blank in front, that cover the text."""
    data = b" " + " ".join(text.lower().split()).encode("utf-8", "replace")
    out, at = [], 0
    while at < len(data) and len(data) > 1:
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        out.append(data[at:end])
        at = end
    return out


def typical(own: Counter, other: Counter, n_own: int, n_other: int) -> list[bytes]:
    """Words that more texts of one side hold than chance explains among so many words, the most typical last."""
    vocabulary = len(own.keys() | other.keys())
    share, out = n_own / (n_own + n_other), []
    for w, c in own.items():
        o = other[w]
        if c > share * (c + o):
            surprise = 2 * (c * math.log(c / (share * (c + o))) + (o * math.log(o / ((1 - share) * (c + o))) if o else 0))
            if surprise > 2 * math.log(vocabulary):  # likelihood ratio statistic
                out.append((surprise, w))
    return [(" " + w + " ").encode() for _, w in sorted(out)]


def dictionary(words: list[bytes], size: int) -> bytes:
    """A dictionary trained on ``words`` and the words themselves behind it, where they are cheapest to refer to."""
    words = words[-size // 4 :]
    try:
        own = zstandard.train_dictionary(size, words * max(1, 20000 // len(words)), k=16, d=6, level=LEVEL).as_bytes()[-size:] if words else b""
    except zstandard.ZstdError:  # too few words to train on
        own = b""
    return own + b"".join(words)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, strategy=zstandard.STRATEGY_BTOPT, window_log=17, hash_log=14, chain_log=14, search_log=4, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def gains(parts: list[bytes], toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor, carrier: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window over the ordinary one.

    The carrier, a piece of both dictionaries behind each window, makes short windows worth compressing at all.
    """
    a, b = toxic.compress, ordinary.compress
    return np.fromiter((len(b(p)) - len(a(p)) for p in (p + carrier for p in parts)), dtype=np.float64, count=len(parts))


def features(g: np.ndarray, cuts: tuple[float, ...]) -> np.ndarray:
    """Distribution of a text's gains: largest ones, and for each threshold the share and the number of windows beyond it."""
    top = np.sort(np.concatenate([g, np.zeros(3)]))[::-1][:3] if len(g) else np.zeros(3)
    beyond = [(g > c).sum() for c in cuts]
    return np.array([*top, *[b / max(1, len(g)) for b in beyond], *np.log1p(beyond)], dtype=np.float64)


def fit(rows: list[tuple[str, int]], share: float = 0.5) -> Model:
    """Dictionaries, thresholds and weights from (text, label) rows; one half trains the dictionaries, all fit the weights.

    ``share`` is the share of label 1 among all labelled rows, from which the sample may differ.
    """
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return Model()
    half = [r for i, r in enumerate(rows) if i % 2 == 0]
    if len({y for _, y in half}) < 2 or len(rows) < 200:
        half = rows
    seen = {0: Counter(), 1: Counter()}
    for text, y in half:
        seen[y].update(set(text.lower().split()))
    n = [max(1, sum(y == v for _, y in half)) for v in (0, 1)]
    frequent = sorted(seen[0].items(), key=lambda x: (x[1], x[0]))[-COMMON:]
    common = b"".join((" " + w).encode() for w, _ in frequent)
    toxic = dictionary(typical(seen[1], seen[0], n[1], n[0]), DICTIONARY)
    ordinary = dictionary(typical(seen[0], seen[1], n[0], n[1]), DICTIONARY)
    # both hold the same frequent words at the same distance, so what is common to the sides costs the same
    wide = max(len(toxic), len(ordinary))
    toxic, ordinary = (common + bytes(wide - len(d)) + d for d in (toxic, ordinary))
    a, b = compressor(toxic), compressor(ordinary)
    found = [gains(windows(t), a, b, toxic[:CARRIER]) for t, _ in rows]
    pool = np.concatenate([g for g, y in zip(found, labels, strict=True) if y == 0] or [np.zeros(1)])
    cuts = tuple(np.quantile(pool if len(pool) else np.zeros(1), THRESHOLDS).tolist())
    x = np.stack([features(g, cuts) for g in found])
    weight = np.array([1 - share, share])[labels] / np.bincount(labels, minlength=2)[labels]
    w, bias = logistic(x, np.where(labels == 1, 1.0, -1.0)[:, None], weight, rounds=600, ridge=1e-4)
    return Model(toxic, ordinary, cuts, w[:, 0], float(bias[0]), f"toxicity-{zlib.crc32(toxic + ordinary)}")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = cached(model.name, lambda: (compressor(model.toxic), compressor(model.ordinary))) if model.weights is not None else (None, None)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out = np.zeros(part.num_rows)
                if a is not None:
                    x = np.stack([features(gains(windows(t or ""), a, b, model.toxic[:CARRIER]), model.cuts) for t in part.column("text").to_pylist()])
                    out = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(out)], names=["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit(*labelled_sample(docs, table(spark, folder, "labels"), "toxic", remainder(3) != 1, SAMPLE))
    found = score(docs.withColumn("held_out", remainder(3) == 1), model)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
