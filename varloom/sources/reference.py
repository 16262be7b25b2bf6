"""Reference sequence as a stored table of tiles, and window lookup by an equi-join on the tile key.

A reference arrives in pieces ``(contig, at, seq)``: ``at`` bases of the contig come before ``seq``. Pieces may have any length, so
lines of a FASTA file and slices of a long text are both fine and no contig is ever one row. ``land`` cuts them once into tiles of
equal size, gives each tile its right neighbour by an equi-join on ``tile + 1`` and stores the table; all lookups join that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from varloom.session import settle

#: Bases of a stored tile, and least of one that is put together for lookups.
TILE, WIDE = 256, 1024
#: Bytes of a text that are turned into bases at once.
SLICE = 1 << 20
#: Bytes of tiles, neighbours and keys that are sent to every executor; lookups in a larger reference are shuffled.
BROADCAST = 1 << 27
#: Bytes of a row that is sent, beside its bases.
ROW = 128


@dataclass
class Reference:
    """Stored tiles ``(contig, tile, seq, right)``: tile ``k`` holds bases ``k*size+1 ..``, ``right`` those of tile ``k+1``.

    Tile -1 is there too, empty, so a window that begins just before the contig is found. A contig without bases has an
    empty tile 0.
    """

    tiles: DataFrame
    size: int
    _counted: Row | None = None
    _coarser: dict[int, Reference] = field(default_factory=dict)

    def _counts(self) -> Row:
        """Rows, rows with a contig, distinct tiles, bases, and whether four bases fit three bytes; counted once."""
        if self._counted is None:
            self._counted = self.tiles.agg(
                F.count("*").alias("rows"), F.count(F.when(F.col("contig").isNotNull(), F.col("tile"))).alias("named"), F.count_distinct("contig", "tile").alias("distinct"),
                F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"), F.count_if(F.col("seq").rlike("[^A-Za-z0-9+/]")).alias("other"),
                F.count_distinct(F.when(F.col("tile") >= 0, F.col("contig"))).alias("contigs"), F.count_if(F.col("contig").isNotNull() & (F.col("tile") >= 0) & (F.col("right") == "")).alias("last"),
                F.count_if((F.col("tile") >= 0) & (F.col("right") != "") & (F.length("seq") != self.size)).alias("short"),
            ).first()
        return self._counted

    def packed(self) -> bool:
        """Whether ``pairs`` holds four bases in three bytes: read as base64, any letters come back as they were."""
        return self._counts()["other"] == 0

    def small(self, overlap: int | None = None) -> bool:
        """Whether every executor can hold all tiles, with ``overlap`` bases of their right neighbours (all if None)."""
        c = self._counts()
        bases = 2 * c["bases"] if overlap is None else c["bases"] + min(c["bases"], c["rows"] * overlap)
        return c["rows"] * ROW + bases * (0.75 if self.packed() else 1) <= BROADCAST

    def unique(self) -> bool:
        """Whether each tile is there once, so that a lookup keeps the number of rows."""
        return self._counts()["named"] == self._counts()["distinct"]

    def for_windows(self, longest: int) -> Reference:
        """The same bases in tiles as long as a window, or so that they can be sent to all tasks. Tiles that come twice or leave gaps stay as
        they are: what a lookup finds there depends on them."""
        c = self._counts()
        plain = self.unique() and c["last"] == c["contigs"] and not c["short"]
        if not plain or (longest <= self.size and self.small(min(self.size, 64))):
            return self
        times = -(-max(longest, WIDE) // self.size)
        if times not in self._coarser:
            seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "seq"))), lambda x: x["seq"]), "")
            own = self.tiles.filter("tile >= 0 AND contig IS NOT NULL").groupBy("contig", F.expr(f"tile div {times}").alias("at")).agg(seq.alias("seq"))
            self._coarser[times] = land(own.withColumn("at", F.col("at") * (times * self.size)), times * self.size, aligned=True)
        return self._coarser[times]

    def sizes(self) -> DataFrame:
        """(contig, size): number of bases of every contig; sent to all tasks where the reference is small."""
        own = self.tiles.filter("tile >= 0")
        rows = own.groupBy("contig").agg(F.max(F.col("tile") * self.size + F.length("seq")).alias("size"))
        return F.broadcast(rows) if self.small(0) else rows

    def pairs(self, overlap: int | None = None) -> DataFrame:
        """(contig, tile, wide): the tile and ``overlap`` bases of its neighbour, ``N`` before the contig and nothing behind it.

        Sent to all tasks where the reference is small: then no event is moved for a lookup, however many there are.
        """
        right = F.col("right") if overlap is None else F.substring("right", 1, overlap)
        seq = F.when(F.col("right") == "", F.col("seq")).otherwise(F.rpad("seq", self.size, "N"))
        rows = self.tiles.select("contig", "tile", F.concat(seq, right).alias("wide"))
        if self.packed():
            fours = F.rpad("wide", F.ceil(F.length("wide") / 4).cast("int") * 4, F.lit("N"))
            rows = rows.select("contig", "tile", F.unbase64(fours).alias("wide"))
        return F.broadcast(rows) if self.small(overlap) else rows

    def cut(self, size: int) -> DataFrame:
        """(contig, tile, seq) in smaller tiles, whose size divides the stored one."""
        if self.size % size:
            raise ValueError(f"{size} does not divide {self.size}")
        each = self.size // size
        parts = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.struct((F.col("tile") * each + i).alias("tile"), F.substring(F.col("seq"), i * size + 1, F.lit(size)).alias("seq")))
        rows = self.tiles.filter("tile >= 0").select("contig", F.explode(parts).alias("p"))
        return rows.select("contig", "p.tile", "p.seq").filter("seq <> ''")


def pieces_of_text(rows: DataFrame, contig: str, text: str, alphabet: dict[str, str], length: int = TILE) -> DataFrame:
    """``(contig, at, seq)`` of texts: letters found in ``alphabet`` become bases, all else is left out.

    A text is read in slices, so the memory beyond the text itself is bounded. All pieces but a contig's last have ``length``
    bases; a text without bases, or null, gives one empty piece.
    """
    base = np.zeros(256, dtype=np.uint8)
    for letter, value in alphabet.items():
        base[ord(letter)] = ord(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                data = np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.is_valid and len(value.as_buffer()) else np.zeros(0, np.uint8)
                at, rest = 0, np.zeros(0, dtype=np.uint8)
                for start in range(0, max(1, len(data)), SLICE):
                    found = base[data[start : start + SLICE]]
                    rest = np.concatenate([rest, found[found > 0]])
                    last = start + SLICE >= len(data)
                    n = len(rest) if last else len(rest) // length * length
                    if not n and not (last and at == 0):
                        continue
                    ends = np.minimum(np.arange(0, max(n, 1) + length, length), n)[: max(1, -(-n // length)) + 1]
                    seq = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rest[:n].copy())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(seq), pa.int64()), pa.array(at + ends[:-1], pa.int64()), seq], names=["contig", "at", "seq"])
                    at, rest = at + n, rest[n:]

    return rows.select(F.col(contig).cast("long").alias("contig"), F.col(text).alias("text")).mapInArrow(run, "contig long, at long, seq string")


def pieces_of_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, at, seq)`` of the FASTA files below ``path``, one piece a line; the contig is the first word after ``>``.

    Lines are numbered within the block of the file that a task reads; what a block inherits (the running contig and its
    bases so far) comes from one row a block, so neither a file nor a contig is read by one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"),
        F.trim("value").alias("value"),
    )
    head = F.col("value").startswith(">")
    lines = lines.select(
        "file", "block", "nr", F.when(~head, F.upper("value")).otherwise("").alias("seq"),
        F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"),
    )
    inside = Window.partitionBy("file", "block").orderBy("nr")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = settle(lines.select(
        "file", "block", "nr", "seq", "name", F.last("name", ignorenulls=True).over(so_far).alias("contig"),
        F.sum(F.length("seq")).over(so_far).alias("through"),
    ).withColumn("opened", F.last(F.when(F.col("name").isNotNull(), F.col("through")), ignorenulls=True).over(so_far)), "fasta-lines")
    ends = lines.groupBy("file", "block").agg(F.max("through").alias("bases"), F.max_by("contig", "nr").alias("ends_in"), F.max_by("opened", "nr").alias("opened_at"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("bases_before", F.coalesce(F.sum("bases").over(before), F.lit(0)))
    ends = ends.withColumn("opened_before", F.last(F.col("bases_before") + F.col("opened_at"), ignorenulls=True).over(before))
    ends = ends.select("file", "block", "bases_before", "opened_before", F.last("ends_in", ignorenulls=True).over(before).alias("inherited"))
    own = F.col("opened").isNotNull()
    at = F.col("through") - F.length("seq") - F.when(own, F.col("opened")).otherwise(F.col("opened_before") - F.col("bases_before"))
    rows = lines.join(ends, ["file", "block"]).select(F.when(own, F.col("contig")).otherwise(F.col("inherited")).alias("contig"), at.alias("at"), "seq", "name")
    return rows.filter(F.col("contig").isNotNull() & ((F.col("seq") != "") | F.col("name").isNotNull())).select("contig", "at", "seq")


def tiles_of_pieces(pieces: DataFrame, size: int, aligned: bool) -> DataFrame:
    """``(contig, tile, seq)``; ``aligned``: pieces are tiles already. Else a tile is put together from the pieces that touch it."""
    if aligned:
        return pieces.select("contig", F.expr(f"at div {size}").alias("tile"), "seq")
    last = F.greatest(F.col("at"), F.col("at") + F.length("seq") - 1)
    parts = pieces.select("contig", "at", "seq", F.explode(F.sequence(F.expr(f"at div {size}"), F.floor(last / size))).alias("tile"))
    low = F.greatest(F.col("tile") * size, F.col("at"))
    high = F.least((F.col("tile") + 1) * size, F.col("at") + F.length("seq"))
    parts = parts.select("contig", "tile", low.alias("low"), F.substring(F.col("seq"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    whole = F.array_sort(F.collect_list(F.struct("low", "part")))
    return parts.groupBy("contig", "tile").agg(F.array_join(F.transform(whole, lambda x: x["part"]), "").alias("seq"))


def land(pieces: DataFrame, size: int = TILE, aligned: bool = False) -> Reference:
    """Cut, join with the right neighbours and store."""
    tiles = tiles_of_pieces(pieces, size, aligned)
    right = tiles.select("contig", (F.col("tile") - 1).alias("tile"), F.col("seq").alias("right"))
    both = tiles.join(right, ["contig", "tile"], "full").select("contig", "tile", F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("right", F.lit("")).alias("right"))
    return Reference(settle(both, "reference-tiles"), size)


def window(text: Column, at: Column, length: Column, packed: bool = False) -> Column:
    """``length`` bases of ``text`` behind its first ``at``; ``N`` where ``text`` ends or is null. ``packed``: see ``Reference.packed``."""
    at = at.cast("int")
    if packed:  # the groups of four that the window touches; long ones come in lines
        four = F.floor(at / 4).cast("int")
        groups = F.floor((at % 4 + length + 3) / 4).cast("int")
        text, at = F.replace(F.base64(F.substring(text, four * 3 + 1, groups * 3)), F.lit("\r\n"), F.lit("")), at % 4
    return F.rpad(F.coalesce(F.substring(text, at + 1, length), F.lit("")), length, F.lit("N"))


def fetch_windows(
    events: DataFrame,
    reference: Reference,
    *,
    contig: str,
    start: str,
    length: str,
    out: str = "window",
    bound: Column | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Attach the reference bases ``start .. start+length-1`` (1-based, ``N`` outside the contig).

    Each row goes by its own length. A window of at most a tile's size lies in the pair that begins with its first tile, so
    the range lookup is one equi-join on (contig, tile) and nothing is exploded; longer windows take ``fetch_long_windows``.
    A small reference is broadcast; in a large one a hot
    locus is a skewed join key, which adaptive execution splits on the event side. Where the length comes from long expressions, ``bound``, any simpler column that is at
    least as large, decides instead: the filter is pushed down by substitution. ``longest`` says that no window is longer: then tiles are made as
    long (see ``for_windows``), rows are read once, and only as many bases of the neighbours are sent as such a window may need.
    """
    stored = reference.size
    reference = reference if longest is None else reference.for_windows(longest)
    tile = reference.size
    bound = F.col(length) if bound is None else bound
    within = longest is not None and longest <= tile
    overlap = -(-max(longest - 1, 0) // 64) * 64 if within else None  # lookups of like length share what is sent
    first = F.floor((F.col(start) - 1) / F.lit(tile)).cast("long")
    pairs = reference.pairs(overlap).withColumnsRenamed({"contig": "_on_contig", "tile": "_on_tile"})
    text = window(F.col("wide"), F.pmod(F.col(start) - 1, F.lit(tile)), F.col(length).cast("int"), reference.packed())
    if within and longest > stored:  # as for windows that are put together: no place, no bases
        text = F.when((F.col(length) <= stored) | (F.col(contig).isNotNull() & F.col(start).isNotNull()), text)
    near = events if within else events.filter(F.coalesce(bound <= tile, F.lit(True)))
    short = near.join(pairs, (F.col(contig) == F.col("_on_contig")) & (first == F.col("_on_tile")), "left").select(
        *events.columns, text.alias(out)
    )
    if within:
        return short
    far = events.filter(bound > tile)
    return short.unionByName(fetch_long_windows(far, reference, contig=contig, start=start, length=length, out=out))


def fetch_long_windows(events: DataFrame, reference: Reference, *, contig: str, start: str, length: str, out: str = "window") -> DataFrame:
    """Windows of any length: one row per touched tile of each distinct window, joined, then glued.

    Identical windows are fetched once, so a hot locus costs one lookup.
    """
    tile = reference.size
    span = events.select(
        F.col(contig).alias("contig"), F.col(start).alias("_start"), F.col(length).alias("_length")
    ).distinct()
    first = F.floor((F.col("_start") - 1) / F.lit(tile)).cast("long")
    last = F.floor((F.col("_start") + F.col("_length") - 2) / F.lit(tile)).cast("long")
    pieces = span.select("*", F.explode(F.sequence(first, last)).alias("tile"))
    tiles = reference.tiles.filter("tile >= 0").select("contig", "tile", "seq")
    tiles = F.broadcast(tiles) if reference.small() else tiles
    lo = F.greatest(F.col("_start") - F.col("tile") * tile, F.lit(1))
    hi = F.least(F.col("_start") + F.col("_length") - 1 - F.col("tile") * tile, F.lit(tile))
    part = F.substring(F.rpad(F.coalesce("seq", F.lit("")), tile, "N"), lo.cast("int"), (hi - lo + 1).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("tile", "part")))
    glued = (
        pieces.join(tiles, ["contig", "tile"], "left")
        .select("contig", "_start", "_length", "tile", part.alias("part"))
        .groupBy(F.col("contig").alias("_c"), F.col("_start").alias("_s"), F.col("_length").alias("_l"))
        .agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias(out))
    )
    same = (F.col(contig) == F.col("_c")) & (F.col(start) == F.col("_s")) & (F.col(length) == F.col("_l"))
    return events.join(glued, same, "left").drop("_c", "_s", "_l")


def window_counts(reference: Reference, size: int) -> DataFrame:
    """(w, n): how often each word of ``size`` bases occurs, windows with other letters left out.

    Each task sends one row a distinct word, at most ``4 ** size``; ``size`` is at most a tile and 31.
    """
    if size > min(31, reference.size):
        raise ValueError("words must be shorter than a tile and than 32 bases")
    code = np.full(256, -1, dtype=np.int64)
    code[[ord(c) for c in "ACGT"]] = np.arange(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            text = "\n".join(batch.column(0).to_pylist()).encode()
            c = code[np.frombuffer(text, dtype=np.uint8)]
            n = len(c) - size + 1
            if n <= 0:
                continue
            word, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            for i in range(size):
                word = word * 4 + c[i : i + n]
                bad |= c[i : i + n] < 0
            found, first = np.unique(word[~bad], return_counts=True)
            words, inverse = np.unique(np.concatenate([words, found]), return_inverse=True)
            total = np.zeros(len(words), dtype=np.int64)
            np.add.at(total, inverse, np.concatenate([counts, first]))
            counts = total
        letters = np.frombuffer(b"ACGT", dtype=np.uint8)[(words[:, None] >> (2 * np.arange(size - 1, -1, -1))) & 3]
        spelled = [row.tobytes().decode() for row in letters]
        yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), pa.array(counts)], names=["w", "n"])

    # windows that begin in the tile and end at most ``size - 1`` bases behind it
    rows = reference.tiles.filter("tile >= 0").select(F.concat("seq", F.substring("right", 1, size - 1)).alias("s"))
    return rows.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
