"""Packing of token sequences by reciprocal-capacity (harmonic) classes.

Tokenised documents are cut into pieces whose lengths are exactly ``capacity / k`` for ``k`` a power of two. Such a length
is its own harmonic class: a sequence of class ``k`` takes a fixed number, ``k``, of its pieces and is then full. Workers
fill sequences of each class independently of one another; they only need the number of pieces that other workers hold in
the class, a table of (workers x classes) rows. What is left in a class, fewer than ``k`` pieces, forms sequences whose
lengths are powers of two, so no sequence needs padding.

Null and empty texts have the end id alone. Repeated rows are packed each for itself. An empty table gives no pieces.
Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.scan import chunks, words
from varloom.llm.store import cached, materialise, partitions

CAPACITY = 4096
END_ID = 2
#: Entries after which a worker forgets the words it has tokenised; bounds its memory, not the result.
REMEMBERED = 800_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return cached(f"tokenizer-{path}", lambda: Tokenizer.from_file(path))


def word_tokenizer(path: str):
    """(the vocabulary's merges on words that are already split and written as byte symbols, which ids end a word)."""

    def build():
        from tokenizers import Tokenizer

        with open(path) as f:
            whole = json.load(f)
        vocabulary = whole["model"]["vocab"]
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        bare = whole | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        return Tokenizer.from_str(json.dumps(bare)), ends

    return cached(f"word-tokenizer-{path}", build)


def byte_symbols() -> dict[int, str]:
    """Code points beyond ASCII as the symbols of their UTF-8 bytes: printable Latin-1 stands for itself, the rest follows from U+0100 on."""

    def build():
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        return {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(0x80, 0x2100)}

    return cached("byte-symbols", build)


#: Texts of these characters only are lower-cased and split here in the same way as by the vocabulary's own rules.
USUAL = [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0xB2), *range(0xB4, 0xB9), 0xBA, 0xBB]
USUAL += [*range(0xBF, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028), 0x20AC]
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+|\n"


class WordIds:
    """Token ids of the words met so far by a worker, found by the words' hashes; whole arrays of words at once.

    The table doubles before it is half full, so a text may bring any number of words.
    """

    BITS = 21

    def __init__(self) -> None:
        self.bits = self.BITS
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.index = np.zeros(1 << self.bits, dtype=np.int64)
        self.start, self.count, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, 0 if it is not known."""
        out, rest = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        slot = self.place(hashes)
        while len(rest):
            key = self.keys[slot]
            hit = key == hashes[rest]
            out[rest[hit]] = self.index[slot[hit]]
            on = ~hit & (key != 0)
            rest, slot = rest[on], (slot[on] + 1) % len(self.keys)
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """New distinct words with the ends of their ids in ``ids``."""
        first = len(self.start)
        begin = np.concatenate([[0], ends[:-1]])
        self.start = np.concatenate([self.start, begin + len(self.ids)])
        self.count = np.concatenate([self.count, ends - begin])
        self.ids = np.concatenate([self.ids, ids])
        if 2 * len(self.start) > len(self.keys):
            self.grow(len(self.start))
        self.put(hashes, first + np.arange(len(hashes)))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The first slot to look in."""
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        rest, slot = np.arange(len(hashes)), self.place(hashes)
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[rest[free]]
            mine = self.keys[slot] == hashes[rest]
            self.index[slot[mine]] = numbers[rest[mine]]
            rest, slot = rest[~mine], (slot[~mine] + 1) % len(self.keys)

    def grow(self, words: int) -> None:
        """A table of at least twice as many slots as ``words``, with all that is in the old one."""
        held = np.flatnonzero(self.keys)
        keys, numbers = self.keys[held], self.index[held]
        while 2 * words > 1 << self.bits:
            self.bits += 1
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.index = np.zeros(1 << self.bits, dtype=np.int64)
        self.put(keys, numbers)


def token_bytes(column: pa.Array, path: str) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text, without special tokens.

    This vocabulary drops white space and never joins over it, so a text's ids are those of its white-space-separated
    parts. Each part of a usual text is tokenised once, many new ones in one call, and remembered; a text with unusual
    characters is tokenised whole.
    """
    model, (bare, word_end) = tokenizer(path), word_tokenizer(path)
    unusual, parts, symbols = re.compile(f"[^{re.escape(''.join(map(chr, USUAL)))}]|<\\|"), re.compile(PARTS), byte_symbols()
    beyond = re.compile("[^\x00-\x7f]")
    memory = cached(f"word-ids-{path}", lambda: [WordIds()])
    for i, j, data, offsets in chunks(column):
        texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
        whole = {r: model.encode(t, add_special_tokens=False).ids for r, t in enumerate(texts) if unusual.search(t)}
        w = words(data, offsets, "space_folded")
        usual = np.ones(j - i, dtype=bool)
        usual[list(whole)] = False
        usual = usual[w.doc]
        if len(memory[0].start) > REMEMBERED:
            memory[0] = WordIds()
        known = memory[0]
        number = np.where(usual, known.find(w.hashes), 0)
        at = np.flatnonzero(usual & (number == 0))
        if len(at):
            _, one = np.unique(w.hashes[at], return_index=True)
            new = at[one]
            raw = data.tobytes()
            listed = b"".join([raw[x:y] + b"\n" for x, y in zip(w.starts[new].tolist(), w.ends[new].tolist(), strict=True)])
            pieces = parts.findall(listed.decode().lower())
            joined = beyond.sub(lambda m: symbols[ord(m[0])], " ".join(pieces))
            ids = np.asarray(bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            line = np.flatnonzero(np.fromiter(("\n" == x for x in pieces), bool, len(pieces)))  # a line feed behind each word
            ends = np.concatenate([[0], np.flatnonzero(word_end[ids]) + 1])[line - np.arange(len(line))]
            known.add(w.hashes[new], ids, ends)
            number[at] = known.find(w.hashes[at])
        count = known.count[number]
        until = np.concatenate([[0], np.cumsum(count)])
        ids = known.ids[np.repeat(known.start[number] - until[:-1], count) + np.arange(until[-1])]
        border = until[w.first].tolist()
        for r in range(j - i):
            yield np.asarray(whole[r], dtype="<u4").tobytes() if r in whole else ids[border[r] : border[r + 1]].tobytes()


def cuts(n: int, capacity: int) -> list[int]:
    """Piece lengths of ``n`` tokens: whole sequences, then falling powers of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with a checksum of their ids."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text"), path), strict=True):
                    ids += end
                    at, n, view = 0, len(ids) // 4, memoryview(ids)
                    for size in cuts(n, capacity):
                        out.append((doc, at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), n))
                        at += size
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``found`` must be a stored table of ``pieces``: it is read twice."""
    workers = partitions(found.sparkSession)
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(workers)).cast("int")
    held = found.withColumn("worker", key)
    counts = held.groupBy("length", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "length", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("total"))
    # sequences of a class: the full ones and one for each binary digit of the number of pieces left over
    per = F.lit(capacity) / F.col("length")
    left = (F.col("total") % per).cast("long")
    classes = counts.select("length", "total").distinct().select("length", (F.floor(F.col("total") / per) + F.bit_count(left)).alias("sequences"))
    base = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # one row a class, 13 at most
    classes = classes.select("length", F.coalesce(F.sum("sequences").over(base), F.lit(0)).alias("base"))
    places = counts.join(F.broadcast(classes), "length")  # (workers x classes) rows
    order = Window.partitionBy("length", "worker").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    n = held.withColumn("n", F.row_number().over(order) - 1).join(F.broadcast(places), ["length", "worker"])
    n = n.select("*", (F.col("n") + F.col("before")).alias("i"), (F.lit(capacity) / F.col("length")).cast("long").alias("per"))
    n = n.select("*", (F.col("total") - F.col("total") % F.col("per")).alias("filled"), (F.col("total") % F.col("per")).alias("rest"))
    n = n.withColumn("r", F.col("i") - F.col("filled"))
    # the sequence of binary digit b of the rest starts at the rest's higher digits; b is the highest digit in which r and the rest differ
    n = n.withColumn("b", F.floor(F.log2(F.col("r").bitwiseXOR(F.col("rest")))).cast("int") + 1)
    n = n.withColumn("higher", F.expr("shiftleft(shiftright(rest, b), b)"))
    sequence, slot = F.bit_count("higher"), F.col("r") - F.col("higher")
    full = F.col("i") < F.col("filled")
    return n.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.when(full, F.floor(F.col("i") / F.col("per"))).otherwise(F.floor(F.col("filled") / F.col("per")) + sequence)).cast("long").alias("sequence_id"),
        (F.when(full, F.col("i") % F.col("per")).otherwise(slot) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); one row a piece."""
    return pack(materialise(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as sequences of at most 4096 tokens."""
    return pack_documents(table(spark, folder, "documents"), vocabulary())
