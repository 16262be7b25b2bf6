"""Language-model scores by a weighted backoff automaton.

The model has n-grams of up to three tokens, smoothed by interpolated absolute discounting. Single tokens have (c + 1) / (N + V + 1),
unseen ones included. Longer n-grams have (c - D) / c(context) + lambda * p(word | shorter context); all other words of a context
share its rest lambda by the shorter context, so every context's probabilities add up to 1. A pair or triple is in the model where
it occurs ``LEAST`` times and more and lifts the training texts' log10 probability by ``GAIN`` against the shorter context, a triple
only if its two pairs are; both limits are on the evidence for one n-gram, whatever the corpus. Counts are taken over all
training texts and whole texts.

As an automaton: the root, each token and each pair of tokens with continuations are states; an n-gram is an arc from the state
of its context with its log-probability to the state of its longest known ending; a failure arc leads from a state to the one of
the shorter context with log10(lambda). A text is one walk from left to right: from the state that the tokens before lead to, take the arc
of the next token or else fail and look again; the weights passed add up to the text's log-probability. A worker takes the arcs of many
tokens side by side.

Counting goes by length: a pair is counted only where both tokens are frequent enough, a triple only where both pairs are in the
model, by a bitmap of bounded size (``store.bitmap``) that only saves work. The model is as large as the corpus makes it and never held
in one place: texts are dealt into blocks of about ``BLOCK`` bytes, each block asks for the n-grams it holds, a join answers, and
the block's part of the automaton is compiled where its texts are. A token of a training text that no bitmap of repeated tokens
holds occurs once in training and is not asked for. Tokens and n-grams are known by 64-bit hashes.

Null texts are empty: one end token. Without training rows every token has probability 1. Repeated rows count and are scored
each for itself; a null id counts as an empty one. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.sampling import remainder
from varloom.llm.scan import ODD, chunks, mix, words
from varloom.llm.store import bitmap, bits_for, in_bitmap, materialise, partitions

#: Least count of a pair or triple of tokens, what is taken off it, and what it must add to the log10 probability.
LEAST, DISCOUNT, GAIN = 16, 0.75, 10.0
#: Bytes of text of a block; bytes counted at once; entries that a worker gathers before it sends them on.
BLOCK, CHUNK, ENTRIES = 1 << 24, 1 << 19, 400_000
#: A context with this part of all tokens is split.
HEAVY = 1000
#: Tasks that add up counts for each shuffle partition: an entry takes about six times as much memory there as on its way.
SPREAD = 4
#: Largest bitmap: two of 4 MB are with each worker.
BITS = 25
#: Tokens whose arcs are taken side by side.
TOGETHER = 1 << 17
END = np.uint64(0x5BD1E9955BD1E995)
_NONE = np.zeros(0, dtype=np.uint64)


def fold(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of all but its last token and the last token."""
    return mix(context + token * np.uint64(ODD))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end after each text, offsets of the texts in them)."""
    w = words(data, offsets, "space_folded")
    return np.insert(w.hashes, w.first[1:], END), w.first + np.arange(len(w.first))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by a sort: ``np.unique`` puts them through a table of single nodes, which takes many times as long."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def grams(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs and triples that begin at each token, and how many tokens its text has from there on."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(t))
    pair = fold(t[:-1], t[1:]) if len(t) > 1 else _NONE
    return pair, left


class Tally:
    """Distinct rows of 64-bit values with counts, of many chunks."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        if not len(columns[0]):
            return
        key = columns[-1]
        for c in columns[:-1]:
            key = fold(key, c)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key))) if counts is None else np.add.reduceat(counts[order], first)
        key, at = key[first], order[first]
        self.parts.append((key, [c[at] for c in columns], n))
        self.size += len(key)

    def combine(self) -> None:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            self.add([np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)], np.concatenate([p[2] for p in parts]))

    def full(self) -> bool:
        if self.size > ENTRIES:
            self.combine()
        return self.size > ENTRIES // 2


def counted(docs: DataFrame, size: int, bits: np.ndarray, heavy: np.ndarray, cuts: int, names: list[str], least: int) -> DataFrame:
    """Occurrences of the n-grams of ``size`` tokens of all texts; for longer ones than 1 those of ``least`` and more, and only
    n-grams whose shorter parts are in the bitmap."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def send() -> Iterator[pa.RecordBatch]:
            tally.combine()
            for _, columns, n in tally.parts:
                spread = columns[0] if size > 1 else columns[-1]
                spread = np.where(np.isin(spread, heavy), fold(spread, columns[-1]), spread)
                part = ((spread >> np.uint64(16)) % np.uint64(cuts)).astype(np.int32)
                order = np.lexsort((columns[0], part))
                first = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
                ends = pa.array(np.append(first, len(order)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(c[order].view(np.int64))) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(part[order][first]), *lists, pa.ListArray.from_arrays(ends, pa.array(n[order].astype(np.int32)))], names=["part", *names, "n"])
            tally.parts, tally.size = [], 0

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text"), CHUNK):
                t, first = tokens(data, offsets)
                pair, left = grams(t, first)
                if size == 1:
                    tally.add([t])
                elif size == 2:
                    known = in_bitmap(bits, t)
                    at = np.flatnonzero((left[: len(pair)] > 1) & known[:-1] & known[1:]) if len(pair) else np.zeros(0, np.int64)
                    tally.add([t[at], t[at + 1]])
                else:
                    known = in_bitmap(bits, pair)
                    at = np.flatnonzero((left[: len(pair) - 1] > 2) & known[:-1] & known[1:]) if len(pair) > 1 else np.zeros(0, np.int64)
                    tally.add([pair[at], t[at + 1], t[at + 2]])
                if tally.full():
                    yield from send()
            pa.default_memory_pool().release_unused()
        yield from send()

    rows = docs.select("text").mapInArrow(gather, "part int, " + "".join(f"{x} array<long>, " for x in names) + "n array<int>")
    each = rows.repartition(cuts, "part").select("part", F.explode(F.arrays_zip(*names, "n")).alias("x")).select("part", *[f"x.{x}" for x in [*names, "n"]])
    sums = each.groupBy("part", *names).agg(F.sum("n").alias("n")).drop("part")
    return sums if size == 1 else sums.where(F.col("n") >= least)


def with_keys(rows: DataFrame, suffix: bool) -> DataFrame:
    """``rows`` (context, [suffix,] word, n) with the key of the n-gram and, for triples, that of its last two tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {x: batch.column(x).to_numpy().view(np.uint64) for x in batch.schema.names if x != "n"}
            shorter = fold(c["suffix"], c["word"]) if suffix else c["word"]
            columns = [fold(c["context"], c["word"]), c["context"], shorter]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in columns], batch.column("n")], names=["key", "context", "shorter", "n"])

    return rows.mapInArrow(run, "key long, context long, shorter long, n long")


def arcs(longer: DataFrame, shorter: DataFrame, discount: float, gain: float, name: str) -> tuple[DataFrame, DataFrame]:
    """(n-grams with their probabilities, rest of each context) from ``longer`` (key, context, shorter, n) and ``shorter`` (key, n, p)."""
    rows = longer.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("of")), "context")
    rows = rows.join(shorter.select(F.col("key").alias("shorter"), F.col("p").alias("below")), "shorter")
    rows = rows.where(F.col("n") * F.log10(F.col("n") / F.col("of") / F.col("below")) >= gain).select("key", "context", "n", "of", "below")
    rows = materialise(rows, f"kept-{name}")
    rest = rows.groupBy("context", "of").agg(F.sum(F.col("n") - discount).alias("mass")).select("context", (1 - F.col("mass") / F.col("of")).alias("rest"))
    rest = materialise(rest, f"rests-{name}")
    out = rows.join(rest, "context").select("key", "n", ((F.col("n") - discount) / F.col("of") + F.col("rest") * F.col("below")).alias("p"))
    return materialise(out, f"arcs-{name}"), rest.select(F.col("context").alias("key"), "rest")


def automaton(training: DataFrame, least: int, discount: float, gain: float) -> tuple[DataFrame, int, int]:
    """((key, n, arc, back) of all n-grams, tokens, distinct tokens). n: of single tokens; arc: log-probability of longer ones; back:
    weight of the failure arc where the n-gram is a state."""
    cuts = SPREAD * partitions(training.sparkSession)
    single = materialise(counted(training, 1, _NONE, _NONE, cuts, ["key"], 1), "tokens")
    total, distinct, often = single.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") >= least, 1))).first()

    def filters(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        heavy = rows.where(F.col("n") * HEAVY >= total).select("key").toArrow().column("key").to_numpy().view(np.uint64)  # at most HEAVY
        return bitmap(rows, F.col("key"), min(BITS, bits_for(n))), heavy

    bits, heavy = filters(single.where(F.col("n") >= least), often)
    single = single.withColumn("p", (F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    pairs = with_keys(counted(training, 2, bits, heavy, cuts, ["context", "word"], least), False)
    pair_arcs, token_rest = arcs(pairs, single, discount, gain, "pairs")
    bits, heavy = filters(pair_arcs, pair_arcs.count())
    triples = with_keys(counted(training, 3, bits, heavy, cuts, ["context", "suffix", "word"], least), True)
    triple_arcs, pair_rest = arcs(triples, pair_arcs, discount, gain, "triples")
    no = F.lit(None).cast("double")
    model = single.join(token_rest, "key", "left").select("key", "n", no.alias("arc"), F.log10("rest").alias("back"))
    model = model.unionByName(pair_arcs.join(pair_rest, "key", "left").select("key", "n", F.log10("p").alias("arc"), F.log10("rest").alias("back")))
    model = model.unionByName(triple_arcs.select("key", "n", F.log10("p").alias("arc"), no.alias("back")))
    return materialise(model, "automaton"), int(total), int(distinct)


def asked(docs: DataFrame, bits: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """(block, key) of the n-grams of each block that the model may have; ``docs`` is dealt by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}  # keys of a block, at most about one for each of its tokens

        def add(block: np.ndarray, key: np.ndarray) -> None:
            for b in distinct(block).tolist():
                mine = held.setdefault(b, [])
                mine.append(distinct(key[block == b]))
                if len(mine) > 32:
                    held[b] = [distinct(np.concatenate(mine))]

        for batch in batches:
            block = batch.column("block").to_numpy()
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in chunks(batch.column("text"), CHUNK):
                t, first = tokens(data, offsets)
                pair, left = grams(t, first)
                of = np.repeat(block[i:j], np.diff(first))
                single = in_bitmap(repeated, t) | np.repeat(held_out[i:j], np.diff(first))
                known = in_bitmap(bits, pair)
                two = np.flatnonzero(known & (left[: len(pair)] > 1))
                three = np.flatnonzero(known[:-1] & known[1:] & (left[: max(0, len(pair) - 1)] > 2)) if len(pair) > 1 else two[:0]
                triple = fold(pair[three], t[three + 2])
                inside = in_bitmap(bits, triple)
                add(np.concatenate([of[single], of[two], of[three][inside]]), np.concatenate([t[single], pair[two], triple[inside]]))
            pa.default_memory_pool().release_unused()
        for b, parts in held.items():
            key = distinct(np.concatenate(parts))
            for i in range(0, len(key), ENTRIES):
                part = key[i : i + ENTRIES]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b, dtype=np.int32)), pa.array(part.view(np.int64))], names=["block", "key"])

    return docs.mapInArrow(run, "block int, key long")


class Walk:
    """The part of the automaton that some texts need, and the walk over it.

    The state after a token follows from the last two tokens: their pair if that is a state, else the token if that is one, else the root.
    So the arcs of many tokens are taken side by side, each from the state that the tokens before it lead to.
    """

    def __init__(self, t: np.ndarray, first: np.ndarray, single: tuple[np.ndarray, ...], longer: tuple[np.ndarray, ...], learnt: np.ndarray, total: int, distinct: int):
        """``single`` (key, n, back) and ``longer`` (key, arc, back) are sorted by key."""
        self.token, self.first, self.longer = t, first, longer
        key, n, back = single
        vocabulary, self.t = np.unique(t, return_inverse=True)
        at, found = self.find(key, vocabulary)
        once = np.zeros(len(vocabulary), dtype=np.int64)  # tokens of training texts that were not asked for
        once[self.t[np.repeat(learnt, np.diff(first))]] = 1
        self.count = np.where(found, n[at], once) if len(key) else once
        self.unigram = np.log10((self.count + 1) / (total + distinct + 1))
        self.back = np.where(found, back[at], np.nan) if len(key) else np.full(len(vocabulary), np.nan)  # of the tokens that are states

    @staticmethod
    def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the sorted keys, whether the key there is the wanted one)."""
        if not len(sorted_keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return at, sorted_keys[at] == wanted

    def scores(self) -> np.ndarray:
        """log10 probability of each text."""
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        score = np.zeros(len(self.first) - 1)
        for i in range(0, len(text), TOGETHER):
            np.add.at(score, np.repeat(text[i : i + TOGETHER], 3), self.weights(i, min(i + TOGETHER, len(text)), text).ravel())
        return score

    def weights(self, i: int, j: int, text: np.ndarray) -> np.ndarray:
        """What the walk adds at each token from ``i`` to before ``j``: failing from a pair, failing from a token, and the arc taken."""
        start = max(0, i - 2)
        t, word, inside = self.token[start:j], self.t[start:j], text[start : j - 1] == text[start + 1 : j]
        key, arc, back = self.longer
        pair = fold(t[:-1], t[1:])
        two = np.flatnonzero(inside & ~np.isnan(self.back[word[:-1]]))
        at, found = self.find(key, pair[two])
        two, at = two[found], at[found]
        from_token, from_pair, pair_back, token_back = (np.full(len(t), np.nan) for _ in range(4))  # each at the token that is read
        from_token[two + 1] = arc[at]
        states = ~np.isnan(back[at]) & (two + 2 < len(t))
        two, at = two[states], at[states]
        going_on = inside[two + 1]
        two, at = two[going_on], at[going_on]
        pair_back[two + 2] = back[at]
        at, found = self.find(key, fold(pair[two], t[two + 2]))
        from_pair[two[found] + 2] = arc[at[found]]
        token_back[1:][inside] = self.back[word[:-1]][inside]
        triple, known = ~np.isnan(from_pair), ~np.isnan(from_token)
        out = np.zeros((len(t), 3))
        out[:, 0] = np.where(triple, 0.0, np.nan_to_num(pair_back))
        out[:, 1] = np.where(triple | known, 0.0, np.nan_to_num(token_back))
        out[:, 2] = np.where(triple, from_pair, np.where(known, from_token, self.unigram[word]))
        return out[i - start :]


def score_texts(docs: DataFrame, model: DataFrame, total: int, distinct: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of ``docs`` (doc_id, held_out, text)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, int(np.ceil(size / BLOCK)))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.withColumn("block", block).repartition(max(blocks, 2), "block")
    longer = model.where(F.col("arc").isNotNull())
    repeated = model.where(F.col("arc").isNull() & (F.col("n") > 1))
    bits, repeated = (bitmap(x, F.col("key"), min(BITS, bits_for(x.count()))) for x in (longer, repeated))
    answers = asked(dealt, bits, repeated).join(model, "key").select("block", "key", "n", "arc", "back")

    def run(texts: pa.Table, part: pa.Table) -> pa.Table:
        numbers = lambda c, kind: part.column(c).combine_chunks().fill_null(np.nan if kind is float else 0).to_numpy(zero_copy_only=False) if len(part) else np.zeros(0, kind)
        key = numbers("key", np.int64).astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        key, n, arc, back = key[order], numbers("n", np.int64)[order], numbers("arc", float)[order], numbers("back", float)[order]
        alone = np.isnan(arc)
        single, longer = (key[alone], n[alone], back[alone]), (key[~alone], arc[~alone], back[~alone])
        known, base, score, size = [], [], [], []
        column, learnt = texts.column("text").combine_chunks(), ~texts.column("held_out").to_numpy()
        for i, j, data, offsets in chunks(column, 2 * CHUNK):
            t, first = tokens(data, offsets)
            walk = Walk(t, first, single, longer, learnt[i:j], total, distinct)
            size.append(np.diff(first))
            known.append(np.add.reduceat((walk.count > 0)[walk.t].astype(np.int64), first[:-1]))
            base.append(np.add.reduceat(walk.unigram[walk.t], first[:-1]))
            score.append(walk.scores())
        out = [texts.column("doc_id"), texts.column("held_out"), *(pa.array(np.concatenate(x) if x else np.zeros(0, k)).cast(kind) for x, k, kind in ((size, np.int64, pa.int64()), (known, np.int64, pa.int64()), (base, float, pa.float64()), (score, float, pa.float64())))]
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def score_documents(docs: DataFrame, held_out: Column, least: int = LEAST, discount: float = DISCOUNT, gain: float = GAIN) -> DataFrame:
    """Scores of all texts by a model of those for which ``held_out`` is false."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model, total, distinct = automaton(plain.where(~F.col("held_out")), least, discount, gain)
    return score_texts(plain, model, total, distinct).withColumn("train_tokens", F.lit(total).cast("long"))


@query("op13_lm")
def op13_lm(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document by a trigram model of six sevenths of them, and by single tokens."""
    scored = score_documents(table(spark, folder, "documents"), remainder(7) == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
