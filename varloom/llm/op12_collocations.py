"""Phrase collocation mining by stripes.

A stripe is a prefix of 0 to 4 words with a counter of the words that follow it; an entry without a word counts the
occurrences of the prefix that nothing countable follows. Workers count stripes in parts of a partition; Spark deals them
out by prefix and merges the counters of equal prefixes element by element. From a merged stripe follow the counts of its
extensions, the total of its prefix (the sum of the counter) and the largest count of an extension, which tells whether a
longer phrase subsumes the prefix.

Lengths are done one after the other. All pairs of words are counted; a longer phrase can be as frequent as asked only if both
phrases it has with one word less are, so only those are counted. A bitmap of bounded size (``store.bitmap``) tells workers
which these may be; what it lets through besides is counted and then found too rare. A prefix with a ``HEAVY``-th of all
words has a stripe that may be too large for one task; there are at most ``HEAVY`` of them, and their stripes are cut by
the next word.

The counts of all first and last parts of a phrase are carried along as the lengths grow, so a candidate meets them in one
join on its prefix and one on its last words. Words of a language are known by 64-bit hashes, phrases by hashes of these; equal
hashes count as equal. Null texts have no words, a null language is ``und``. Repeated rows count each for itself, ties rank by
the bytes of the phrase. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.scan import ODD, chunks, mix, rolling
from varloom.llm.store import bitmap, bits_for, in_bitmap, materialise, partitions

#: Least count of a phrase, most words of a phrase, ranks of a language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: A prefix with this part of all words is split.
HEAVY = 1000
#: Tasks that merge stripes for each shuffle partition: an entry takes about six times as much memory there as on its way.
SPREAD = 4
#: Bytes of text counted at once, and entries that a worker gathers before it sends them on.
CHUNK, ENTRIES = 1 << 19, 300_000

_byte = np.arange(256)
_fold = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Words end at blank and tab, pieces at punctuation marks and line ends.
_break = np.isin(_byte, list(b".,;:!?\n\x0b\x0c\r"))
_word = ~(_break | np.isin(_byte, list(b" \t")))
_value = mix(_fold.astype(np.uint64) * np.uint64(ODD) + np.uint64(ODD))


@dataclass
class Pieces:
    """Words of several texts: hashes, the document and the piece of each, and their folded bytes."""

    hashes: np.ndarray
    doc: np.ndarray
    piece: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words ``at``."""
        a, n = self.starts[at], self.ends[at] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - a, n)
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(_fold[self.data[place]])).cast(pa.string())


def pieces(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> Pieces:
    """Words and pieces of the texts ``data[offsets[i]:offsets[i + 1]]`` of the languages with hashes ``langs``."""
    w = _word[data]
    before, after = np.zeros(len(w), dtype=bool), np.zeros(len(w), dtype=bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    edges = offsets[(offsets > 0) & (offsets < len(w))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    piece = np.cumsum(_break[data], dtype=np.int64)[starts] + doc if len(starts) else doc
    return Pieces(mix(rolling(_value[data], starts, ends) ^ langs[doc]), doc, piece, data, starts, ends)


def lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all but its last word and of its last word."""
    return mix(prefix + word * np.uint64(ODD))


def phrases(p: Pieces, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words from each word on, those over the end of a piece included."""
    out = p.hashes
    for i in range(1, size):
        out = extended(out[:-1], p.hashes[i:]) if len(out) else out
    return out


def entries(p: Pieces, size: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(prefix hashes, next words) of all occurrences of countable prefixes of ``size - 1`` words; next word 0: nothing follows."""
    prefix = phrases(p, size - 1)
    n = len(prefix)
    known = p.piece[:n] == p.piece[size - 2 :] if n else np.zeros(0, dtype=bool)
    if bits is not None:
        known &= in_bitmap(bits, prefix)
    at = np.flatnonzero(known)
    follows = at[at + 1 < n]
    follows = follows[known[follows + 1] & (p.piece[follows] == p.piece[follows + size - 1])]
    word = np.zeros(n, dtype=np.uint64)
    word[follows] = p.hashes[follows + size - 1]
    return prefix[at], word[at]


class Stripes:
    """Distinct (prefix, next word) with counts, of many chunks."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, prefix: np.ndarray, word: np.ndarray, counts: np.ndarray | None = None) -> None:
        if not len(prefix):
            return
        key, first, inverse, n = np.unique(extended(prefix, word), return_index=True, return_inverse=True, return_counts=True)
        if counts is not None:
            n = np.zeros(len(key), dtype=np.int64)
            np.add.at(n, inverse, counts)
        self.parts.append((prefix[first], word[first], n))
        self.size += len(key)

    def combine(self) -> None:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            self.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def blocks(self, heavy: np.ndarray, cuts: int) -> Iterator[pa.RecordBatch]:
        """All that was counted, one row a part, its stripes one after the other; then start anew."""
        self.combine()
        for prefix, word, counts in self.parts:
            spread = np.where(np.isin(prefix, heavy), extended(prefix, word), prefix)
            part = ((spread >> np.uint64(16)) % np.uint64(cuts)).astype(np.int32)
            order = np.lexsort((prefix, part))
            first = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
            ends = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (prefix[order].view(np.int64), word[order].view(np.int64), counts[order].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(part[order][first]), *lists], names=["part", "prefix", "word", "n"])
        self.parts, self.size = [], 0


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, pa.Array]]:
    """Words of successive runs of texts, and their languages."""
    for batch in batches:
        langs = batch.column("lang").cast(pa.string())
        codes = {x: lang_hash(x) for x in pc.unique(langs).to_pylist()}
        codes = np.array([codes[x] for x in langs.to_pylist()], dtype=np.uint64)
        for i, j, data, offsets in chunks(batch.column("text"), CHUNK):
            yield pieces(data, offsets, codes[i:j]), langs.slice(i, j - i)
        pa.default_memory_pool().release_unused()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, hash, n): the stripe of the empty prefix of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def combined() -> pa.Table:
            return pa.concat_tables(held).group_by(["hash", "lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["hash", "lang", "phrase", "n"])

        for p, langs in each_chunk(batches):
            key, first, n = np.unique(p.hashes, return_index=True, return_counts=True)
            held.append(pa.table({"hash": key.view(np.int64), "lang": langs.take(pa.array(p.doc[first])), "phrase": p.strings(first), "n": n}))
            if sum(map(len, held)) > ENTRIES:
                held = [combined()]
                if len(held[0]) > ENTRIES // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from combined().to_batches()

    rows = docs.mapInArrow(run, "hash long, lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))


def merged_stripes(docs: DataFrame, size: int, bits: np.ndarray | None, heavy: np.ndarray, cuts: int, least: int) -> DataFrame:
    """(prefix, part, total, extensions) of the prefixes of ``size - 1`` words: extensions are the next words with counts of
    ``least`` and more; a heavy prefix has several parts, each with its share of the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for p, _ in each_chunk(batches):
            stripes.add(*entries(p, size, bits))
            if stripes.size > ENTRIES:
                stripes.combine()
                if stripes.size > ENTRIES // 2:
                    yield from stripes.blocks(heavy, cuts)
        yield from stripes.blocks(heavy, cuts)

    blocks = docs.mapInArrow(run, "part int, prefix array<long>, word array<long>, n array<int>").repartition(cuts, "part")
    each = blocks.select("part", F.explode(F.arrays_zip("prefix", "word", "n")).alias("x")).select("part", "x.prefix", "x.word", "x.n")
    each = each.groupBy("part", "prefix", "word").agg(F.sum("n").alias("n"))
    extension = F.when((F.col("n") >= least) & (F.col("word") != 0), F.struct("word", "n"))
    return each.groupBy("part", "prefix").agg(F.sum("n").alias("total"), F.collect_list(extension).alias("extensions"))


def with_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` (prefix, word, n) with the hash of the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("prefix", "word"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(extended(prefix, word).view(np.int64))], names=["prefix", "word", "a", "hash"])

    return rows.mapInArrow(run, "prefix long, word long, a long, hash long")


def frequent(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Words a language; per length (from 1) the frequent phrases (hash, lang, phrase, a, lefts, rights, last: the hash of the phrase
    without its first word); per length (from 2) the prefixes (prefix, total, widest extension).

    ``lefts`` and ``rights``: the counts of the first k words and of the rest, k from 1.
    """
    cuts = SPREAD * partitions(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = materialise(word_counts(docs), "words")
    sizes = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    none = F.expr("cast(array() AS array<long>)")
    words = words.where(F.col("n") >= least).select("hash", "lang", "phrase", F.col("n").alias("a"), none.alias("lefts"), none.alias("rights"), F.expr("0L").alias("last"))
    levels, heads, bits = [materialise(words, "phrases-1")], [], None
    for size in range(2, longest + 1):
        shorter = levels[-1]
        known = shorter.count()
        if not known:
            break
        if size > 2:
            bits = bitmap(shorter, F.col("hash"), bits_for(known))
        heavy = shorter.where(F.col("a") * HEAVY >= total).select("hash").toArrow().column("hash").to_numpy().view(np.uint64)  # at most HEAVY
        # all parts of a heavy prefix count towards its total
        kept = (F.size("extensions") > 0) | F.col("prefix").isin(heavy.view(np.int64).tolist())
        stripes = materialise(merged_stripes(docs, size, bits, heavy, cuts, least).where(kept), f"stripes-{size}")
        head = stripes.groupBy("prefix").agg(F.sum("total").alias("total"), F.max(F.array_max(F.transform("extensions", lambda x: x["n"]))).alias("widest"))
        head = head.where(F.col("widest").isNotNull()).join(shorter.select(F.col("hash").alias("prefix"), "lang", "phrase", "lefts"), "prefix")
        head = materialise(head, f"prefixes-{size}")
        found = materialise(with_hashes(stripes.select("prefix", F.explode("extensions").alias("x")).select("prefix", "x.word", "x.n")), f"found-{size}")
        left = head.select("prefix", "lang", F.col("phrase").alias("before"), F.concat("lefts", F.array("total")).alias("lefts"))
        rows = found.join(left, "prefix").join(levels[0].select(F.col("hash").alias("word"), F.col("phrase").alias("next")), "word")
        rows = materialise(rows.select("hash", "lang", F.concat_ws(" ", "before", "next").alias("phrase"), "a", "lefts"), f"named-{size}")
        # the last words, as a phrase of one word less
        right = shorter.select("lang", F.col("phrase").alias("end"), F.col("hash").alias("last"), F.concat(F.array("a"), "rights").alias("rights"))
        rows = rows.withColumn("end", F.expr("substring(phrase, instr(phrase, ' ') + 1)")).join(right, ["lang", "end"])
        levels.append(materialise(rows.select("hash", "lang", "phrase", "a", "lefts", "rights", "last"), f"phrases-{size}"))
        heads.append(head)
    return sizes, levels, heads


def unsubsumed(levels: list[DataFrame], heads: list[DataFrame]) -> DataFrame:
    """Phrases of two and more words that no longer frequent phrase holds at every occurrence."""
    out = None
    for at in range(1, len(levels)):
        rows = levels[at]
        if at + 1 < len(levels):
            right = heads[at].select(F.col("prefix").alias("hash"), F.col("widest").alias("longer"))
            left = levels[at + 1].groupBy(F.col("last").alias("hash")).agg(F.max("a").alias("longer"))
            longer = right.unionByName(left).groupBy("hash").agg(F.max("longer").alias("longer"))
            rows = rows.join(longer, "hash", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
        rows = rows.select("lang", "phrase", "a", "lefts", "rights")
        out = rows if out is None else out.unionByName(rows)
    return out


def first_ranks(rows: DataFrame, top: int, salts: int) -> DataFrame:
    """The ``top`` best rows of each language, ranked among salted parts first."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    widths = [salts, int(np.ceil(salts**0.5))] if salts > 16 else [salts]
    for width in [*widths, 1]:
        keys = ["lang"] if width == 1 else ["lang", F.pmod(F.xxhash64("phrase"), F.lit(width))]
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language."""
    sizes, levels, heads = frequent(docs, longest, least)
    if len(levels) < 2:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rows = unsubsumed(levels, heads).join(sizes, "lang")
    wide = lambda c: f"cast({c} AS decimal(19,0))"
    cut = f"struct(cast((cast(1000 AS decimal(4,0)) * {wide('a')} * {wide('n')}) div ({wide('x.lefts')} * {wide('x.rights')}) AS bigint) AS score, i AS k, x.lefts AS l, x.rights AS r)"
    rows = rows.withColumn("cut", F.expr(f"array_min(transform(arrays_zip(lefts, rights), (x, i) -> {cut}))"))
    rows = rows.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rows = first_ranks(rows, top, partitions(docs.sparkSession))
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM s),
size AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, w[i : i + m - 1] AS p FROM w, (SELECT unnest(range(1, 6)) AS m) AS ms, unnest(range(1, len(w) - m + 2)) AS u(i)),
f AS (SELECT lang, m, p, count(*) AS a FROM grams GROUP BY lang, m, p HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE m >= 2),
cuts AS (
  SELECT c.lang, c.m, c.p, c.a, x.a AS l, y.a AS r, n, k, (1000 * CAST(c.a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM c, unnest(range(1, c.m)) AS u(k) JOIN size ON size.lang = c.lang JOIN f AS x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f AS y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.m]
),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nr FROM cuts),
held AS (SELECT DISTINCT c.lang, c.p[i : i + k - 1] AS p, c.a FROM c, (SELECT unnest(range(2, 5)) AS k) AS ks, unnest(range(1, c.m - k + 2)) AS u(i) WHERE k < c.m),
kept AS (SELECT * FROM best WHERE nr = 1 AND NOT EXISTS (FROM held WHERE held.lang = best.lang AND held.p = best.p AND 100 * held.a >= 100 * best.a)),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of each language whose words go together more often than their parts would."""
    return collocations(table(spark, folder, "documents"))
