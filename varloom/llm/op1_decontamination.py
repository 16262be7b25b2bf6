"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window is a set of shingles that must
all occur, in order, in a document: at containment 1 the necessary prefix of the set is one shingle, so each window is
joined by its rarest one, rarity being the number of document stretches that hold the shingle. The place of the shingle in
the window gives the only possible start; starts before the stretch or ends behind it are dropped (positional and length
bounds), and the words are then compared one by one.

The documents are scanned once. A fixed-size bitmap of the benchmark's shingles lets a worker keep only the stretches of
a document that consist of benchmark shingles. Equal stretches of many documents are joined once.

Null or empty texts have no words. Items without words, and rows without an item id, have no windows. Repeated item ids
count once; repeated documents are judged each for itself. Empty tables give documents without hits, or no rows. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.scan import chunks, ngrams, words
from varloom.llm.store import bitmap, in_bitmap, materialise

WINDOW = 10
SHINGLE = 5
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """(size, hash) of the shingles of all items; an item shorter than a shingle is one shingle of its own size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                w = words(data, offsets, "alnum_folded")
                count = np.diff(w.first)
                for size in range(1, shingle + 1):
                    at, h = ngrams(w, size)
                    keep = np.ones(len(at), dtype=bool) if size == shingle else count[w.doc[at]] == size
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), size), pa.int32()), pa.array(h[keep].view(np.int64))], names=["size", "hash"])

    return items.select("text").mapInArrow(run, "size int, hash long")


def stretches(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Per document: doc_id, n_words and the stretches of words that consist of shingles in the bitmap, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, offsets in chunks(batch.column("text")):
                w = words(data, offsets, "alnum_folded")
                edge = np.zeros(len(w.hashes) + 1, dtype=np.int32)
                for size in sizes:
                    at, h = ngrams(w, size)
                    at = at[in_bitmap(bits, h)]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                inside = np.cumsum(edge[:-1]) > 0
                # a stretch ends where the next word is not covered or belongs to another document
                border = np.zeros(len(inside) + 1, dtype=bool)
                border[w.first] = True
                start = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
                end = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
                texts = []
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    flat = w.text(a, b).decode("utf-8", "replace")
                    texts.append(flat)
                ends = np.searchsorted(start, w.first)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(w.first), pa.int64()), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(texts, pa.string())).cast(pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "stretches"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, stretches array<string>")


def split_words(column: str):
    return F.regexp_extract_all(F.translate(F.col(column), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def shingled(df: DataFrame, at: str, sizes: list[int]) -> DataFrame:
    """A row for each shingle of the array ``w``: its size, its place ``at`` and its words joined by a blank."""
    parts = [F.expr(f"transform(sequence(0, size(w) - {s}), i -> struct({s} AS size, i AS {at}, array_join(slice(w, i + 1, {s}), ' ') AS shingle))") for s in sizes]
    empty = F.expr(f"cast(array() AS array<struct<size: int, {at}: int, shingle: string>>)")
    every = F.concat(*[F.when(F.size("w") >= s, p).otherwise(empty) for s, p in zip(sizes, parts, strict=True)])
    return df.withColumn("s", F.explode(every)).select("*", "s.*").drop("s")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit and the sorted ids of the items with a window in it (``items``)."""
    items = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    hashes = materialise(item_shingles(items, shingle), "item-shingles")
    sizes = sorted(r["size"] for r in hashes.select("size").distinct().collect())  # at most ``shingle`` values
    bits = bitmap(hashes, F.col("hash"))
    scanned = materialise(stretches(docs, bits, sizes), "stretches").withColumn("row", F.monotonically_increasing_id())

    held = scanned.select("row", F.explode("stretches").alias("stretch"))
    each = materialise(held.groupBy("stretch").agg(F.count("*").alias("n")).select("stretch", "n", split_words("stretch").alias("w")), "distinct-stretches")
    at_doc = shingled(each, "p", sizes) if sizes else None

    w = items.select("item", split_words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    windows = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("w"))
    windows = windows.groupBy("w").agg(F.collect_set("item").alias("owners"))
    if not sizes:
        hits = spark_empty(docs.sparkSession)
    else:
        lengths = F.least(F.size("w"), F.lit(shingle))
        rarity = at_doc.groupBy("size", "shingle").agg(F.sum("n").alias("n"))
        tokens = shingled(windows, "o", sizes).where(F.col("size") == lengths)
        # inner join: a window with a shingle that no document holds may drop out by another of its shingles, or is never found
        ranked = tokens.join(rarity, ["size", "shingle"])
        prefix = ranked.groupBy("w").agg(F.min(F.struct("n", "shingle", "o", "size")).alias("m"), F.first("owners").alias("owners"))
        prefix = prefix.select(F.col("w").alias("words"), "owners", "m.shingle", "m.size", "m.o")
        found = at_doc.select("stretch", "w", "size", "p", "shingle").join(prefix, ["size", "shingle"])
        a = F.col("p") - F.col("o")
        found = found.where((a >= 0) & (a + F.size("words") <= F.size("w"))).where(F.slice("w", F.when(a >= 0, a).otherwise(0) + 1, F.size("words")) == F.col("words"))
        hits = found.select("stretch", "owners", F.sequence(a, a + F.size("words") - 1).alias("covered")).groupBy("stretch").agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("owners"))).alias("owners"))
    per_row = held.join(hits, "stretch").groupBy("row").agg(F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("items"))
    return scanned.join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))


def spark_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "stretch string, n_hit long, owners array<string>")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
docwins AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM wins) AS s, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT r, i, n, item_id FROM docwins JOIN wins USING (n, t)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit) AS h, unnest(range(i, i + n)) AS u(p) GROUP BY r),
owners AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN owners USING (r)
"""


@query("op1_decontamination", SQL)
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
