"""Substring deduplication over a compacted de Bruijn graph of words.

Windows of ``window`` consecutive words are the edges of the graph. Every window belongs to the least of its ``k``-word
hashes, its anchor; successive windows of one anchor form a path, so the graph is compacted while a document is read.

1. Documents with equal words: only those with the smallest id go on, all words of the longer others are repeated.
2. Anchors that occur under two ids are counted; a bitmap of them selects the paths worth looking at.
3. Equal paths collapse by one aggregation, which keeps the source coordinates (doc_id, position) with the smallest id.
4. Different paths of one anchor meet in some windows at most. Only there are paths opened again: windows are joined by hash
   and get the smallest source coordinates among the paths.
5. Back on each document, neighbouring windows are joined into spans while their source coordinates advance word by word
   together with them; a span whose source has a smaller id is removed.

A window counts as repeated by its 64-bit hash. Null and empty texts have no words. Rows without an id keep their words and
take them from nobody. Rows that repeat an id repeat nothing of each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.scan import Words, chunks, mix, rolling, words
from varloom.llm.store import bitmap, bits_for, in_bitmap, materialise

WINDOW = 50
K = 20


def sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) of each ``width`` neighbouring values."""
    done, out = 1, x
    while done * 2 <= width:
        out, done = take(out[: len(out) - done], out[done:]), done * 2
    return take(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def paths(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first windows, ends, anchors) of the maximal runs of windows with one anchor."""
    n = len(w.hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - k + 1)
    anchor = sliding(rolling(w.hashes, at, at + k), window - k + 1, np.minimum)
    doc = w.doc
    valid = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(valid):
        return valid, valid, np.zeros(0, np.uint64)
    anchor = anchor[valid]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(valid) != 1)])
    first = np.flatnonzero(new)
    return valid[first], valid[np.concatenate([first[1:], [len(valid)]]) - 1] + 1, anchor[first]


def fingerprints(w: Words) -> np.ndarray:
    return rolling(w.hashes, w.first[:-1], w.first[1:]).view(np.int64)


def joined(w: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """Kept words of document ``i`` joined by one blank."""
    a, b = w.first[i], w.first[i + 1]
    rows = np.arange(a, b) if keep is None else a + np.flatnonzero(keep)
    if not len(rows):
        return b""
    start, end = w.starts[rows], w.ends[rows]
    size = end - start + 1
    until = np.cumsum(size)
    at = np.repeat(start - (until - size), size) + np.arange(until[-1])
    out = w.data[np.minimum(at, len(w.data) - 1)]
    out[until - 1] = 32
    return out[:-1].tobytes()


def profiles(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Per row: doc_id, words (fingerprint), n_words, sha256 of all words, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                w = words(data, offsets, "space")
                first, _, anchor = paths(w, window, k)
                ends = np.searchsorted(first, w.first)
                sha = [hashlib.sha256(joined(w, r)).hexdigest() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(fingerprints(w)), pa.array(np.diff(w.first), pa.int64()), pa.array(sha),
                     pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(anchor.view(np.int64))).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "words", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id long, words long, n_words long, sha string, anchors array<long>")


def repeated_paths(docs: DataFrame, bits: np.ndarray, window: int, k: int) -> DataFrame:
    """Paths whose anchor may be repeated: doc_id, words, pos, anchor, path (hash) and the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                w = words(data, offsets, "space")
                first, end, anchor = paths(w, window, k)
                some = in_bitmap(bits, anchor)
                first, end, anchor = first[some], end[some], anchor[some]
                size = end - first
                until = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(first - until[:-1], size) + np.arange(until[-1])
                each = rolling(w.hashes, at, at + window)
                path = mix(rolling(w.hashes, first, end + window - 1) + size.astype(np.uint64))
                doc = w.doc[first]
                ids = batch.column("doc_id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), pa.array(fingerprints(w)[doc]), pa.array(first - w.first[doc], pa.int64()), pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64)),
                     pa.LargeListArray.from_arrays(pa.array(until, pa.int64()), pa.array(each.view(np.int64))).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "words", "pos", "anchor", "path", "windows"])

    return docs.mapInArrow(run, "doc_id long, words long, pos long, anchor long, path long, windows array<long>")


def fingerprinted(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, words, text) of the rows whose id and words may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                mark = fingerprints(words(data, offsets, "space"))
                part = batch.slice(i, j - i)
                ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = pa.array(np.flatnonzero(in_bitmap(bits, (mark ^ (ids << np.int64(40))).view(np.uint64))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), pa.array(mark).take(rows), part.column("text").take(rows)], names=["doc_id", "words", "text"])

    return docs.mapInArrow(run, "doc_id long, words long, text string")


def cut(rows: DataFrame) -> DataFrame:
    """(doc_id, words, n_removed, kept_sha256) of rows with their ``spans`` of words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                w = words(data, offsets, "space")
                removed, sha = [], []
                for r, spans in enumerate(batch.column("spans").slice(i, j - i).to_pylist()):
                    edge = np.zeros(w.first[r + 1] - w.first[r] + 1, dtype=np.int64)
                    for s in spans:
                        edge[s["a"]] += 1
                        edge[s["b"]] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    removed.append(int((~keep).sum()))
                    sha.append(hashlib.sha256(joined(w, r, keep)).hexdigest())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "words", "text", "spans").mapInArrow(run, "doc_id long, words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialise(profiles(docs, window, k), "profiles")
    least = seen.groupBy("words", "n_words").agg(F.min("doc_id").alias("least"))
    first = seen.join(least, ["words", "n_words"]).where(F.col("doc_id") == F.col("least"))
    anchors = first.select("doc_id", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    anchors = materialise(anchors.where("a < b").select("anchor"), "anchors")
    bits = bitmap(anchors, F.col("anchor"), bits_for(anchors.count()))

    walk = materialise(repeated_paths(docs.where(F.col("doc_id").isNotNull()), bits, window, k).join(anchors, "anchor"), "paths")
    whole = walk.groupBy("path").agg(F.min(F.struct("doc_id", "pos")).alias("source"), F.first("anchor").alias("anchor"), F.first("windows").alias("windows"))
    whole = materialise(whole, "distinct-paths")
    branching = whole.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    opened = whole.join(branching, "anchor").select("path", "source", F.posexplode("windows").alias("i", "window"))
    opened = opened.select("path", "i", "window", F.struct(F.col("source.doc_id").alias("doc_id"), (F.col("source.pos") + F.col("i")).alias("pos")).alias("source"))
    best = opened.groupBy("window").agg(F.min("source").alias("best"))
    met = opened.join(best, "window").where(F.col("best.doc_id") < F.col("source.doc_id")).groupBy("path").agg(F.collect_list(F.struct("i", F.col("best.doc_id").alias("doc_id"), F.col("best.pos").alias("pos"))).alias("better"))
    sources = whole.join(met, "path", "left").select("path", "source", "better")
    sources = materialise(sources.join(walk.select("path").groupBy("path").agg(F.count("*").alias("n")), "path").where((F.col("n") > 1) | F.col("better").isNotNull()).drop("n"), "sources")

    # source of each window: the better one of the opened path, else the first occurrence of the whole path
    placed = walk.select("doc_id", "words", "pos", "path", F.size("windows").alias("size")).join(sources, "path")
    own = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(i.alias("i"), F.col("source.doc_id").alias("doc_id"), (F.col("source.pos") + i).alias("pos")))
    taken = F.transform("better", lambda b: b["i"])
    every = F.when(F.col("better").isNull(), own).otherwise(F.concat("better", F.filter(own, lambda o: ~F.array_contains(F.col("taken"), o["i"]))))
    repeated = placed.withColumn("taken", taken).select("doc_id", "words", "pos", F.array_sort(F.filter(every, lambda x: x["doc_id"] < F.col("doc_id"))).alias("w")).where(F.size("w") > 0)
    # windows whose sources advance with them are one span
    none = F.expr("cast(array() AS array<struct<a: bigint, b: bigint, doc_id: bigint, shift: bigint>>)")
    shift = lambda x: x["pos"] - x["i"]
    fresh = lambda x: F.struct((F.col("pos") + x["i"]).alias("a"), (F.col("pos") + x["i"] + window).alias("b"), x["doc_id"].alias("doc_id"), shift(x).alias("shift"))
    follows = lambda z, x: (z["doc_id"] == x["doc_id"]) & (z["shift"] == shift(x)) & (z["b"] == F.col("pos") + x["i"] + window - 1)
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    grow = lambda acc, x: F.when(F.coalesce(follows(last(acc), x), F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["a"].alias("a"), (last(acc)["b"] + 1).alias("b"), last(acc)["doc_id"].alias("doc_id"), last(acc)["shift"].alias("shift"))))).otherwise(F.concat(acc, F.array(fresh(x))))
    spans = repeated.select("doc_id", "words", F.aggregate("w", none, grow).alias("s"))
    spans = spans.groupBy("doc_id", "words").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("spans"))
    spans = materialise(spans.select("doc_id", "words", F.transform("spans", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("spans")), "spans")

    bits = bitmap(spans, F.col("words").bitwiseXOR(F.shiftleft("doc_id", 40)), bits_for(spans.count()))
    changed = cut(fingerprinted(docs, bits).join(spans, ["doc_id", "words"])).dropDuplicates(["doc_id", "words"])
    empty = hashlib.sha256(b"").hexdigest()
    rows = seen.select("doc_id", "words", "n_words", "sha").join(least, ["words", "n_words"]).join(changed, ["doc_id", "words"], "left")
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window)
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS t FROM d, unnest(range(1, len(w) - 48)) AS u(i) WHERE len(w) >= 50),
least AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
gone AS (SELECT DISTINCT r, p FROM win JOIN least USING (t), unnest(range(i, i + 50)) AS u(p) WHERE m < doc_id),
kept AS (SELECT d.r, count(gone.p) AS n_removed, string_agg(w[u.p], ' ' ORDER BY u.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM d, unnest(range(1, len(w) + 1)) AS u(p) LEFT JOIN gone ON gone.r = d.r AND gone.p = u.p GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


@query("op10_substrings", SQL)
def op10_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 50 words or more that a document with a smaller id has."""
    return deduplicate(table(spark, folder, "documents"))
