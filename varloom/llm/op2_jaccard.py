"""N-gram Jaccard join with vertical partitioning.

1. Documents with equal n-gram sets form a class; only classes are compared.
2. Two sets as similar as asked share ``l`` of the first ``n - ceil(t n) + l`` n-grams of each in any common order. In hash
   order this needs no ranking: n-grams that several classes have there are marked in a bitmap, and classes with too few
   marked ones have no partner and go no further.
3. The n-grams of the others are counted. An n-gram of one class only cannot be shared, so classes of which too few are left
   go as well. The global order is then rarest first, and its first n-grams are the postings.
4. The global order is cut into fragments of about equal weight. Each fragment counts a pair's partial overlap from the two
   segments alone, and the partial overlaps are summed per pair.
5. Postings are not expanded into all pairs. In each round every posting list compares one pivot with its other members;
   verified links draw labels together, and members with one label are not compared again. When few pairs with different
   labels are left, all of them are compared, so no link between components is lost.

Null and empty texts have no n-grams and are linked with nothing; a text of fewer words than ``k`` is one n-gram. Rows with
equal texts are in one component, also with equal ids. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.components import components
from varloom.llm.registry import query, table
from varloom.llm.scan import chunks, mix, ngrams, rolling, words
from varloom.llm.store import bitmap, bits_for, in_bitmap, materialise

K = 4
PERCENT = 85
FRAGMENTS = 4
#: Rounds of pivots go on while posting lists hold more than this many pairs an entry with different labels, and labels change.
PAIRS_LEFT = 2
ROUNDS = 4  # at most; then all pairs that the bounds on sizes allow are compared


def ngram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes, their ends) of each document."""
    w = words(data, offsets, "space_folded")
    at, h = ngrams(w, k)
    first = np.searchsorted(at, w.first)
    out, count = [], np.diff(w.first)
    for i in range(len(offsets) - 1):
        if count[i] >= k:
            s = np.sort(h[first[i] : first[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif count[i]:
            out.append(rolling(w.hashes, w.first[i : i + 1], w.first[i + 1 : i + 2]))
        else:
            out.append(h[:0])
    ends = np.cumsum([0, *map(len, out)])
    return (np.concatenate(out) if out else h), ends


def fingerprints(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    return rolling(values, ends[:-1], ends[1:]).view(np.int64), rolling(mix(values ^ np.uint64(0xA5A5A5A5)), ends[:-1], ends[1:]).view(np.int64)


def needed(n: Column, percent: int) -> Column:
    """Least overlap of a set of ``n`` with any partner."""
    return F.ceil(n * percent / 100)


def owner_key(fingerprint: Column, doc_id: Column) -> Column:
    """Hash of a class and the document that stands for it."""
    return fingerprint.bitwiseXOR(F.shiftleft(F.coalesce(doc_id, F.lit(0)), 40))


def slices(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A list column of ``values[start:start + size]``."""
    until = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - until[:-1], size) + np.arange(until[-1])
    return pa.LargeListArray.from_arrays(pa.array(until, pa.int64()), pa.array(values[take].view(np.int64))).cast(pa.list_(pa.int64()))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, n and the fingerprints a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                values, ends = ngram_sets(data, offsets, k)
                a, b = fingerprints(values, ends)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(ends), pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long")


def owned(docs: DataFrame, owners: np.ndarray, k: int, percent: int, shared: np.ndarray | None) -> DataFrame:
    """(a, b, grams) of the rows that may stand for a class.

    Without ``shared``, the first n-grams in hash order: any partner shares ``1 + m // 10`` of those it has itself, ``m``
    being the smaller size. With the bitmap ``shared`` of the n-grams that several classes have there, whole sets, and only of
    rows with enough of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                values, ends = ngram_sets(data, offsets, k)
                a, b = fingerprints(values, ends)
                ids = batch.column("doc_id").slice(i, j - i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.diff(ends)
                least = (n * percent + 99) // 100
                size = np.minimum(n, n - least + 1 + n // 10)
                good = (n > 0) & in_bitmap(owners, (a ^ (ids << np.int64(40))).view(np.uint64))
                if shared is not None:
                    hit = np.concatenate([[0], np.cumsum(in_bitmap(shared, values))])
                    good &= hit[ends[:-1] + size] - hit[ends[:-1]] >= 1 + least // 10
                    size = n
                rows = np.flatnonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(b[rows]), slices(values, ends[:-1][rows], size[rows])], names=["a", "b", "grams"])

    return docs.mapInArrow(run, "a long, b long, grams array<long>")


def marked(grams: DataFrame, shared: np.ndarray, percent: int) -> DataFrame:
    """(set, n, grams) with only the n-grams in the bitmap, of the sets that have enough of them for any partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("grams").cast(pa.large_list(pa.int64()))
            ends = column.offsets.to_numpy().astype(np.int64)
            hit = in_bitmap(shared, column.values.to_numpy().view(np.uint64)) if len(column.values) else np.zeros(0, dtype=bool)
            n, total = np.diff(ends), np.concatenate([[0], np.cumsum(hit)])
            size = total[ends[1:]] - total[ends[:-1]]
            rows = np.flatnonzero(size >= (n * percent + 99) // 100)
            values = column.values.to_numpy().view(np.uint64)[hit]
            yield pa.RecordBatch.from_arrays([batch.column("set").take(pa.array(rows)), pa.array(n[rows]), slices(values, total[ends[:-1]][rows], size[rows])], names=["set", "n", "grams"])

    return grams.select("set", "grams").mapInArrow(run, "set long, n long, grams array<long>")


def overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, nx, ny) that are similar enough: partial overlaps per fragment, summed.

    ``segments`` has a row a set and fragment, and what the set has in later fragments (``later``). The fragment of the rarest
    n-grams is counted first; pairs that all later fragments cannot save are given up there.
    """

    def sides(at: Column) -> tuple[DataFrame, DataFrame]:
        some = segments.where(at)
        return tuple(some.select(F.col("set").alias(c), "fragment", F.col("segment").alias("s" + c), F.col("later").alias("later" + c)) for c in "xy")

    enough = lambda common: common * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    common = F.size(F.array_intersect("sx", "sy"))
    x, y = sides(F.col("fragment") == 0)
    first = pairs.join(x.drop("fragment"), "x").join(y.drop("fragment"), "y")
    first = first.select("x", "y", "nx", "ny", common.alias("common"), F.least("laterx", "latery").alias("rest"))
    first = materialise(first.where(enough(F.col("common") + F.col("rest"))).drop("rest"), "promising")
    x, y = sides((F.col("fragment") > 0) & (F.size("segment") > 0))
    more = first.join(x, "x").join(y, ["y", "fragment"]).select("x", "y", "nx", "ny", common.alias("common"))
    total = first.unionByName(more).groupBy("x", "y", "nx", "ny").agg(F.sum("common").alias("common"))
    return total.where(enough(F.col("common"))).select("x", "y")


def may_link(percent: int) -> Column:
    """Bounds on a pair from sizes alone: of the sets (nx, ny), and of what they share with any other set (sx, sy).

    What a set shares with none lies in the symmetric difference, which a linked pair keeps small; what it shares with some bounds
    the overlap.
    """
    nx, ny, sx, sy = (F.col(c) for c in ("nx", "ny", "sx", "sy"))
    sizes = (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent)
    alone = (nx - sx + ny - sy) * (100 + percent) <= (nx + ny) * (100 - percent)
    return sizes & alone & (F.least(sx, sy) * (100 + percent) >= (nx + ny) * percent)


def drawn_together(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (set, component) after the components that ``links`` (x, y) tie together have become one."""
    u = labels.select(F.col("set").alias("x"), F.col("component").alias("u"))
    v = labels.select(F.col("set").alias("y"), F.col("component").alias("v"))
    roots = components(links.join(u, "x").join(v, "y").select("u", "v")).withColumnRenamed("node", "component")
    return materialise(labels.join(roots, "component", "left").select("set", F.coalesce("root", "component").alias("component")), "labels")


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(signatures(docs, k), "signatures")
    classes = materialise(signed.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")), "classes")
    owners = bitmap(classes, owner_key(F.col("a"), F.col("doc_id")), bits_for(classes.count()))
    first = owned(docs, owners, k, percent, None).select(F.explode("grams").alias("gram"))
    shared = materialise(first.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1").select("gram"), "shared")
    found = owned(docs, owners, k, percent, bitmap(shared, F.col("gram"), bits_for(shared.count())))
    grams = materialise(found, "grams").withColumn("set", F.monotonically_increasing_id())  # of a stored table: the same in every reading

    df = grams.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    df = materialise(df, "frequencies")
    each = marked(grams, bitmap(df, F.col("gram"), bits_for(df.count())), percent).select("set", "n", F.explode("grams").alias("gram"))
    kept = each.join(df, "gram").groupBy("set").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    kept = kept.where(F.size("grams") >= needed(F.col("n"), percent))
    kept = materialise(kept, "kept")

    place = lambda x: x["df"] + F.shiftrightunsigned(x["gram"].bitwiseXOR(F.lit(-(2**63))), 11) / F.lit(2.0**53)  # noqa: E731  place in the global order: rarity, then hash
    before_cut = lambda c: lambda x: place(x) < c
    weight = kept.select(F.explode("grams").alias("g")).select(place(F.col("g")).alias("place"))
    cuts = weight.agg(F.percentile_approx("place", [i / fragments for i in range(1, fragments)])).first()[0] or []
    ends = [F.lit(0), *[F.size(F.filter("grams", before_cut(c))) for c in cuts], F.size("grams")]
    bounds = kept.select("set", "grams", F.array(*ends).alias("e"))
    at = lambda i: F.element_at("e", i + 1)
    each = F.transform(F.sequence(F.lit(0), F.lit(len(cuts))), lambda i: F.struct(i.alias("fragment"), F.slice(F.col("grams.gram"), at(i) + 1, at(i + 1) - at(i)).alias("segment"), (F.size("grams") - at(i + 1)).alias("later")))
    segments = bounds.select("set", F.explode(each).alias("s")).select("set", "s.*")
    segments = materialise(segments.where((F.size("segment") > 0) | (F.col("fragment") == 0)), "segments")

    n, here = F.col("n"), F.size("grams")
    length = n - needed(n, percent) + 1 - (n - here)  # n-grams of one class only come first in the order
    postings = materialise(kept.select("set", "n", here.alias("s"), F.explode(F.slice("grams.gram", 1, length.cast("int"))).alias("gram")), "postings")
    labels = materialise(kept.select("set", F.col("set").alias("component")), "labels")
    enough = PAIRS_LEFT * postings.count()
    tested, before, turn = None, None, 0
    while True:
        placed = postings.join(labels, "set")
        per = placed.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        left = per.agg(F.sum((F.col("s") * F.col("s") - F.col("q")).cast("double")) / 2).first()[0] or 0.0
        if left == 0:
            break
        last = left <= enough or before == left or turn == ROUNDS
        before = left
        x = placed.select("gram", F.col("set").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("component").alias("cx"))
        if last:
            y = placed.select("gram", F.col("set").alias("y"), F.col("n").alias("ny"), F.col("s").alias("sy"), F.col("component").alias("cy"))
        else:
            pivot = placed.groupBy("gram").agg(F.min(F.struct(F.xxhash64("set", F.lit(turn)), F.col("set"), F.col("n"), F.col("s"), F.col("component"))).alias("p"))
            y = pivot.select("gram", F.col("p.set").alias("y"), F.col("p.n").alias("ny"), F.col("p.s").alias("sy"), F.col("p.component").alias("cy"))
        pairs = x.join(y, "gram").where((F.col("cx") != F.col("cy")) & may_link(percent))
        if last:
            pairs = pairs.where("x < y")
        swap = F.col("x") > F.col("y")
        one, other = (F.struct(F.col(s).alias("set"), F.col("n" + s).alias("n")) for s in "xy")
        pairs = pairs.select(F.when(swap, other).otherwise(one).alias("p"), F.when(swap, one).otherwise(other).alias("q"))
        pairs = pairs.select(F.col("p.set").alias("x"), F.col("q.set").alias("y"), F.col("p.n").alias("nx"), F.col("q.n").alias("ny")).distinct()
        pairs = materialise(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"), "pairs")
        labels = drawn_together(labels, overlaps(pairs, segments, percent))
        if last:
            break
        tested = pairs.select("x", "y") if tested is None else tested.unionByName(pairs.select("x", "y"))
        turn += 1

    named = grams.select("set", "a", "b").join(labels, "set").select("a", "b", "component").distinct()
    named = classes.join(named, ["a", "b"], "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component", "left").select("a", "b", F.coalesce("least", "doc_id").alias("component_id"))
    rows = signed.select("doc_id", "n", "a", "b")
    linked = rows.where("n > 0").join(named, ["a", "b"]).select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS t FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g AS a JOIN g AS b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM common JOIN n AS nx ON nx.r = x JOIN n AS ny ON ny.r = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edge AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
least AS (SELECT x, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN least ON least.x = d.r
"""


@query("op2_jaccard", SQL)
def op2_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents at 4 words and a Jaccard similarity of 0.85."""
    return jaccard_components(table(spark, folder, "documents"))
