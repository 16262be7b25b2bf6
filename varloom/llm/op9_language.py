"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one linear classifier over hashed byte trigrams predicts each bit, and the language
whose codeword has the least weighted logistic loss wins. Where the two best languages are close the row is ambiguous.

Texts that are null or have no letter get ``und`` with score 0. With nothing to learn from, every text gets ``und``.
Repeated rows are judged each for itself, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.sampling import remainder
from varloom.llm.scan import chunks, mix
from varloom.llm.store import cached

BUCKETS = 4096
#: Labelled rows of each language, about, that a fit reads; chosen by a hash of the whole row.
SAMPLE = 500
#: Least lead of the best language's probability over the second's; below it a text is ambiguous.
LEAD = 0.2


@dataclass
class Codes:
    languages: list[str]
    codes: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Rows of -1 and 1: all distinct two-way splits for up to 6 languages, else the best of some random codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        splits = [[1] + [1 if m >> i & 1 else -1 for i in range(k - 1)] for m in range(2 ** (k - 1) - 1)]
        return np.array(splits, dtype=float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, least = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(k, bits))
        gap = min(np.sum(code[i] != code[j]) for i in range(k) for j in range(i))
        if gap > least and (np.abs(code.sum(0)) < k).all():
            best, least = code, gap
    return best


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that ends at each byte from the third on; ASCII is folded, its non-letters are one space."""

    def build():
        byte = np.arange(256)
        fold = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        return np.where((byte < 128) & ~((fold >= 97) & (fold <= 122)), 32, fold).astype(np.uint32)

    b = cached("trigram-fold", build)[data]
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    x *= np.uint32(0x9E3779B1)
    return (x ^ (x >> np.uint32(15))) >> np.uint32(20)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    plain = np.concatenate([[0], np.cumsum(cached("ascii-letter", lambda: np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)]))[data])])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out):
        if offsets[i + 1] > offsets[i]:
            out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def spans(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end trigram of each text; trigrams over a border belong to none."""
    a = np.minimum(offsets[:-1], n)
    return a, np.maximum(a, np.minimum(offsets[1:] - 2, n))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, share of each trigram bucket) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for i, j, data, offsets in chunks(batch.column("text")):
                rows = np.zeros((j - i, BUCKETS), dtype=np.float32)
                if len(data) > 2:
                    t = trigrams(data)
                    for r, (a, b) in enumerate(zip(*spans(offsets, len(t)), strict=True)):
                        rows[r] = np.bincount(t[a:b], minlength=BUCKETS) / max(1, b - a)
                yield pa.RecordBatch.from_arrays([langs.slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "x"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, x binary")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Linear classifiers for all columns of ``y`` (-1 or 1) at once by accelerated gradient steps on standardised inputs."""
    mean, scale = x.mean(0), x.std(0) + 1e-4
    z = (x - mean) / scale / np.sqrt(x.shape[1])
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for t in range(rounds):
        aw, ab = w + t / (t + 3) * vw, b + t / (t + 3) * vb
        slope = -y / (1 + np.exp(np.clip(y * (z @ aw + ab), -30, 30))) * weight[:, None] / weight.sum()
        nw, nb = aw - 4 * (z.T @ slope + ridge * aw), ab - 4 * slope.sum(0)
        vw, vb, w, b = nw - w, nb - b, nw, nb
    w = w / scale[:, None] / np.sqrt(x.shape[1])
    return w, b - mean @ w


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Codes:
    """Learn from rows (text, lang); about ``sample`` rows of each language are read."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    names = sorted(sizes)
    if not names:
        return Codes([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    share = F.lit(0)
    for name in names:
        share = F.when(F.col("lang") == name, int(1_000_000 * min(1, sample / sizes[name])) + 1).otherwise(share)
    rows = counts(labelled.where(F.pmod(F.xxhash64("lang", "text"), F.lit(1_000_000)) < share)).toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(-1, BUCKETS).astype(np.float64)
    index = np.array([names.index(v) for v in rows.column("lang").to_pylist()], dtype=int)
    code = codewords(len(names))
    if len(index) == 0 or len(names) == 1:
        return Codes(names, code, np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1]), np.ones(code.shape[1]))
    y = code[index]
    weight = 1 / np.maximum(1, np.bincount(index, minlength=len(names)))[index]
    w, b = logistic(x, y, weight)
    right = ((x @ w + b) * y > 0).T @ weight / weight.sum()
    trust = np.maximum(0.05, 2 * right - 1)
    return Codes(names, code, w, b, trust / trust.sum() * len(trust))


def identify(docs: DataFrame, model: Codes, lead: float = LEAD) -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous; other columns of ``docs`` named in ``keep`` travel along."""
    padded = np.ascontiguousarray(model.weights, dtype=np.float32)  # bounded: buckets x bits
    names, code, bias, trust = model.languages, model.codes, model.bias, model.trust

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j, data, offsets in chunks(texts, 1 << 19):
                margin = np.tile(bias, (j - i, 1))
                if len(data) > 2:
                    t = trigrams(data)
                    a, b = spans(offsets, len(t))
                    total = np.zeros((len(t) + 1, padded.shape[1]))
                    np.cumsum(padded[t], axis=0, dtype=np.float64, out=total[1:])
                    margin = margin + (total[b] - total[a]) / np.maximum(1, b - a)[:, None]
                known = has_letter(data, offsets) & bool(names)
                if names:
                    loss = np.stack([np.logaddexp(0, -margin * c) @ trust for c in code], axis=1)
                    odds = np.exp(loss.min(1, keepdims=True) - loss)
                    odds /= odds.sum(1, keepdims=True)
                    best = odds.argmax(1)
                    ranked = np.sort(odds, axis=1)
                    score = np.where(known, ranked[:, -1], 0.0)
                    gap = ranked[:, -1] - (ranked[:, -2] if len(names) > 1 else 0)
                    pred = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                else:
                    score, gap, pred = np.zeros(j - i), np.zeros(j - i), ["und"] * (j - i)
                others = [batch.column(n).slice(i, j - i) for n in batch.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(~known | (gap < lead))],
                    names=[*batch.schema.names, "lang_pred", "score", "ambiguous"],
                )

    clean = docs.drop("lang_pred", "score", "ambiguous")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields)
    return clean.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


@query("op9_language")
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit(docs.where(remainder(5) != 0))
    found = identify(docs.select("doc_id", "text").withColumn("held_out", remainder(5) == 0), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
