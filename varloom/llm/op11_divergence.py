"""Source divergence audit: how far the word use of each source lies from that of its language and of its other sources.

A worker translates the bytes of a text once by a table that lowers A-Z and blanks all separators, splits at the blanks and
counts the terms of the document. Counts of documents of one (language, source) are added up in the worker and sent on as
sparse cells (language, source, term, occurrences, documents), which Spark sums. A language keeps the terms of at least
``KEEP`` of its documents.

Pairs of sources differ in every kept term, also in those that neither holds. The terms of a language are dealt into blocks of
about ``BLOCK`` terms and its sources into blocks of about ``SOURCES``; each pair of source blocks meets in each block of terms,
where a small matrix gives exact partial sums; terms that no source of the two blocks holds differ by the same amount and
enter as one product. So a task holds a bounded matrix, whatever the number of terms or sources, and a pair of sources costs
one row a block of terms. All arithmetic is on integers.

Null text, language or source count as ''. A group without kept terms has the frequencies of zero occurrences; a language
without kept terms gives pairs of value 0. Repeated rows count each for itself; ties rank by the bytes of the item. Long texts
are split in slices. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.scan import buffers
from varloom.llm.store import materialise, partitions

#: A term stays where so many documents of the language hold it; frequencies are out of so many parts.
KEEP = 10
SCALE = 1_000_000_000
#: Terms and sources of a block, first ranks of the terms.
BLOCK, SOURCES, TOP = 1024, 64, 10
#: Bytes of a text that are split at once, and cells that a worker gathers before it sends them on.
SLICE, CELLS = 1 << 20, 300_000

LETTERS = b"abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b if b in LETTERS or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a list for each slice of about ``SLICE`` bytes."""
    flat, at = raw.translate(TABLE), 0
    while at < len(flat):
        end = flat.find(b" ", at + SLICE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) summed over parts of a partition; a group's row without a term says that it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            lang, source, term, n, in_docs = [], [], [], [], []
            for (a, b), (count, held) in sums.items():
                lang += [a] * (len(held) + 1)
                source += [b] * (len(held) + 1)
                term += [None, *held]
                n += [0, *(count[t] for t in held)]
                in_docs += [0, *held.values()]
            sums.clear()
            columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            for i, key in enumerate(groups):
                frequencies = Counter()
                for part in tokens(data[offsets[i] : offsets[i + 1]].tobytes()):
                    frequencies.update(part)
                count, held = sums.setdefault(key, (Counter(), Counter()))
                count.update(frequencies)
                held.update(frequencies.keys())
                if i % 64 == 63 and sum(len(h) for _, h in sums.values()) > CELLS:
                    yield flush()
        if sums:
            yield flush()

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact; without terms 1."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(terms > 0, 1 + F.call_function("div", wide(F.lit(SCALE)) * wide(n + 2), wide(total + 2 * terms))).otherwise(F.lit(1)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def block_pairs(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one block of terms for the pairs (a, b), a < b, of two blocks of sources."""
    groups = groups.sort_values("source", ignore_index=True)
    if len(groups) < 2:
        return pd.DataFrame({"lang": [""], "a": [""], "b": [""], "value": [0]}).astype(object).head(0).astype({"value": "int64"})
    zero = groups["zero"].to_numpy(np.int64)
    at = pd.Index(groups["source"]).get_indexer(cells["source"])
    term, names = pd.factorize(cells["term"])
    p = np.repeat(zero[:, None], len(names), axis=1)
    p[at, term] = cells["p"].to_numpy(np.int64)
    unseen = int(groups["n_terms"].iloc[0]) - len(names)
    block = groups["block"].to_numpy()
    i, j = int(groups["i"].iloc[0]), int(groups["j"].iloc[0])
    out = []
    for a in range(len(groups) - 1):
        other = np.arange(a + 1, len(groups))
        if i != j:
            other = other[block[other] != block[a]]
        d, s = p[a] - p[other], p[a] + p[other]
        d0, s0 = zero[a] - zero[other], zero[a] + zero[other]
        out.append((np.full(len(other), a), other, (d * d // s).sum(axis=1) + unseen * (d0 * d0 // s0)))
    a, b, value = (np.concatenate(x) for x in zip(*out, strict=True))
    names = groups["source"].to_numpy()
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "a": names[a], "b": names[b], "value": value})


def source_pairs(cells: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language; ``groups`` has blocks, ``cells`` p."""
    in_block = kept.groupBy("lang", "bin").agg(F.count("*").alias("n_terms"))
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = [F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j")]
    left = cells.withColumn("x", meet).select("lang", "source", "term", "p", "bin", *sides)
    right = groups.withColumn("x", meet).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    right = right.join(in_block, ["lang", "bin"], "left").select("lang", "source", "zero", "block", "bin", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), *sides)
    keys = ["lang", "bin", "i", "j"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_pairs, "lang string, a string, b string, value long")
    sums = materialise(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "source-pairs")
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def first_ranks(rows: DataFrame, top: int, salts: int) -> DataFrame:
    """The ``top`` first rows of each (lang, source), ranked among salted parts first."""
    order = [F.col("value").desc(), "item"]
    for keys in (["lang", "source", F.pmod(F.xxhash64("item"), F.lit(salts))], ["lang", "source"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows


def divergence(docs: DataFrame, keep: int = KEEP, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources of the language) and ``term`` (first ranks)."""
    cells = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = materialise(cells, "cells")
    kept = cells.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= keep).drop("docs")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    kept = materialise(kept.join(langs, "lang").withColumn("bin", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / BLOCK))), "kept-terms")
    langs = kept.groupBy("lang").agg(F.first("terms").alias("terms"), F.first("total_lang").alias("total_lang"))

    held = cells.join(kept, ["lang", "term"])
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cells.where(F.col("term").isNull()).select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left").na.fill(0, ["total", "terms"])
    groups = groups.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks")), "lang")
    groups = groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms"))).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    groups = materialise(groups.withColumn("bins", F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1))), "source-groups")
    held = held.join(groups.select("lang", "source", "total", "block", "blocks"), ["lang", "source"])
    held = held.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("terms")))
    held = materialise(held.select("lang", "source", "term", "p", "q", "bin", "block", "blocks"), "kept-cells")

    pairs = source_pairs(held, groups, kept)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))).withColumn("part", F.lit("pair"))
    above = held.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = first_ranks(above, top, partitions(docs.sparkSession)).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // CAST(coalesce(total.n, 0) + 2 * v.v AS HUGEINT) AS HUGEINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // CAST(v.n + 2 * v.v AS HUGEINT) AS HUGEINT) AS q
  FROM g JOIN kept AS k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM f AS x JOIN f AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q), row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // (p + q) DESC, term) FROM f WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op11_divergence", SQL)
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence between the sources of each language, and the terms that set each source apart."""
    return divergence(table(spark, folder, "documents"))
