"""Secret scans: fixed patterns and likelihood ratios of random against ordinary text with false-discovery control.

Spans of the fixed kinds ``assign``, ``access`` and ``hex`` are always reported. The method looks at all other long runs of
key-like characters. A run's evidence is the ratio, in bits, of two probabilities: that of a random key in the encoding inferred
from its characters, and that under a model of ordinary text, a Markov chain over characters learnt from the words of the table
that are too short to be runs, and from a few fixed words. Every further character of a random key adds to it. Both are
probabilities over all runs of at least ``LEAST`` characters, so an ordinary run reaches ``b`` bits with a chance of at most
``2 ** -b`` whatever its length, and the rule of Benjamini and Hochberg holds for the ratios: among the distinct runs reported
as ``random`` the expected share of ordinary ones is at most ``rate``. Runs are counted over all documents in bins of one bit,
a table of fixed size.

Everything is column expressions. Null texts are empty; empty texts and tables have no spans; repeated rows are judged each
for itself; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.store import materialise

# Fixed values of the base kinds
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
LEAST = 16
BITS = (-60, 400)  # least and greatest bin of the evidence
RATE = 0.05

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
KEY = LOWER + UPPER + DIGITS + "+/-_"
#: (pattern, size of the alphabet), narrowest first
ENCODINGS = [
    ("^[0-9]+$", 10), ("^[0-9a-f]+$", 16), ("^[0-9A-F]+$", 16), ("^[a-z]+$", 26), ("^[A-Z]+$", 26), ("^[A-Z2-7]+$", 32), ("^[A-Z0-9]+$", 36), ("^[a-z0-9]+$", 36),
    ("^[A-Za-z]+$", 52), ("^[A-Za-z0-9]+$", 62), ("^[A-Za-z0-9+/]+$", 64), ("^[A-Za-z0-9_-]+$", 64), ("^", 66),
]

#: Words that any model knows, so that tables of few words have one: common words of some languages, names, numbers.
WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "information development international government university different important following available experience management application function number system service company language description "
    "der die das und ist nicht ein eine mit von sich auf werden auch haben wurde zwischen entwicklung geschichte gesellschaft verschiedene wissenschaft bedeutung arbeit schule zeit jahr "
    "le la les des une est dans pour que qui par sur pas avec sont plus cette comme gouvernement monde temps question histoire toujours quelques exemple nombre "
    "el los las una del con para por como pero sus desde cuando entre todos gobierno ciudad mundo nombre tiempo historia producto servicios "
    "user file name data test main index page section table value list item path image config server client python string object class method lib usr src http https www com org html php json "
    "getValue setName userId fileName toString isEmpty readFile nextPage HttpServer JavaScript GitHub YouTube McDonald mp3 utf8 v2 x86 h264 a4 b2b sha256 md5 base64 python3 covid19 "
    "0 1 2 3 4 5 6 7 8 9 10 11 12 15 16 20 22 24 25 30 32 42 50 64 75 99 100 128 150 200 256 360 404 500 512 1000 1024 1900 1945 1984 1999 2000 2001 2010 2012 2015 2019 2020 2021 2022 2023 2024 2025 10000 65536 20240131 123456789"
).split()


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (s, e, hit).

    The lengths of the parts between matches and of the matches add up to the positions. Texts without a match are
    only searched once.
    """
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), hit.alias("hit")))
    none = F.expr("cast(array() AS array<struct<s: bigint, e: bigint, hit: string>>)")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(F.length(x["hit"]), F.lit(0))
        new = F.when(x["hit"].isNull(), none).otherwise(F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit"))))
        return F.struct(e.alias("at"), F.concat(acc["out"], new).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def chain(pairs: dict[str, float]) -> tuple[np.ndarray, float]:
    """Bits of each step of the ordinary chain, and of reaching ``LEAST`` characters.

    ``pairs`` has weights of two characters that follow each other in words, where a blank stands before and after a word.
    State 0 is the blank, others are places in ``KEY``. Words may also be in capitals; a separator may follow any word and a word
    any separator; a character may repeat the last one or be any character at all.
    """
    place = {c: i for i, c in enumerate(" " + KEY)}
    n, marks = len(place), np.array([place[c] for c in "+/-_"])
    count = np.zeros((n, n))

    def add(pair: str, weight: float) -> None:
        first = pair[0] == " "
        for form, part in ((pair, 0.85), (pair.capitalize() if not first else pair.upper(), 0.1 if first else 0), (pair.upper(), 0.05)):
            if all(c in place for c in form):
                count[place[form[0]], place[form[1]]] += weight * part
        if not first and pair[0].islower():  # after a capital at the beginning
            count[place[pair[0].upper()], place[pair[1]]] += weight * 0.02

    for word in WORDS:
        for i in range(len(word) + 1):
            add((" " + word + " ")[i : i + 2], 1.0)
    for pair, weight in pairs.items():
        add(pair, weight)
    count[marks] = 0
    count[:, marks] = 0
    seen = count.sum(1, keepdims=True)
    common = count.sum(0) / count.sum()
    step = (count + 5 * common) / (seen + 5)
    step[0, 0] = 0.0
    end = step[:, 0].copy()
    end[0] = 0.1
    step[:, marks] += (end / 4 / len(marks))[:, None]
    step[1:, 0] = end[1:] * 3 / 4
    step[marks] = step[0]
    step[marks, 0] = 0.1
    step /= step.sum(1, keepdims=True)
    anything = np.full(n, 1 / (n - 1))
    anything[0] = 0
    step = 0.9 * step + 0.05 * anything + 0.05 * np.eye(n)
    step[0, 0] = 0
    step /= step.sum(1, keepdims=True)
    reach = step[0, 1:]
    for _ in range(LEAST - 1):
        reach = reach @ step[1:, 1:]
    return np.log2(np.maximum(step, 1e-12)), float(np.log2(reach.sum()))


def ordinary(docs: DataFrame) -> tuple[np.ndarray, float]:
    """``chain`` of the words of all of ``docs`` that are too short to be runs; a word counts by the root of its frequency."""
    words = docs.select(F.explode(F.split("text", "[^A-Za-z0-9+/_-]+")).alias("w")).where(F.length("w").between(1, LEAST - 1)).groupBy("w").agg(F.sqrt(F.count("*").cast("double")).alias("weight"))
    around = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(around, i, F.lit(2)))).alias("pair"), "weight")
    return chain({r["pair"]: r["weight"] for r in pairs.groupBy("pair").agg(F.sum("weight").alias("weight")).orderBy("pair").collect()})  # at most 67 x 67 rows


def evidence(runs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Add ``bin``, the whole bits for a random key, to rows with a run ``hit``."""
    steps, reach = model
    width = len(steps)
    bits = F.split(F.lit(",".join(f"{x:.5f}" for x in steps.ravel())), ",").cast("array<double>")
    out = runs.withColumn("body", F.regexp_replace("hit", "=+$", ""))
    size = F.coalesce(*[F.when(F.col("body").rlike(p), F.lit(float(k))) for p, k in ENCODINGS])
    out = out.withColumns({"n": F.length("body").cast("double"), "k": size, "v": F.transform(F.split("body", ""), lambda c: F.instr(F.lit(KEY), c))})
    along = F.aggregate(
        F.filter("v", lambda x: x > 0), F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.get(bits, a["last"] * width + x)).alias("sum")), lambda a: a["sum"] + F.get(bits, a["last"] * width))
    n = F.col("n")
    # a random key: an encoding, a length with chance LEAST / (n (n + 1)), and equally likely characters
    random = F.lit(float(np.log2(LEAST / len(ENCODINGS)))) - F.log2(n * (n + 1)) - n * F.log2("k")
    ratio = random - (along - reach)
    return out.withColumn("bin", F.floor(F.greatest(F.lit(BITS[0]), F.least(F.lit(BITS[1]), ratio))).cast("int")).drop("body", "n", "k", "v")


def threshold(tested: DataFrame, rate: float) -> int | None:
    """The least bin from which on runs are reported; none if no run has enough evidence. Equal runs count once."""
    found = tested.groupBy("run").agg(F.max("bin").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()  # one row a bin
    total = sum(r["n"] for r in found)
    least, above = None, 0
    for r in sorted(found, key=lambda r: -r["bin"]):
        above += r["n"]
        if total <= rate * above * 2.0 ** r["bin"]:
            least = r["bin"]
    return least


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row: doc_id and ``spans``, an array of (s, kind number, e) in order of start and kind."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id", located(t, ASSIGN).alias("assign"), located(t, ACCESS).alias("access"), located(t, HEX).alias("hex"), located(t, RUN).alias("runs"))
    plain = lambda kind, c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    kept = F.filter("assign", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    found = found.select("doc_id", F.array_sort(F.concat(plain(0, kept), plain(1, F.col("access")), plain(2, F.col("hex")))).alias("base"), "runs")
    found = materialise(found, "base-spans").withColumn("row", F.monotonically_increasing_id())
    runs = found.select("row", "base", F.explode("runs").alias("r")).select("row", "base", "r.*")
    free = runs.where(~F.exists("base", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"]))).drop("base")
    tested = evidence(free, ordinary(docs)).select("row", "s", "e", F.xxhash64("hit").alias("run"), "bin")
    tested = materialise(tested, "runs-tested")
    least = threshold(tested, rate)
    random = tested.where(F.lit(False) if least is None else F.col("bin") >= least)
    random = random.groupBy("row").agg(F.collect_list(F.struct("s", F.lit(3).alias("kind"), "e")).alias("random"))
    none = F.expr("cast(array() AS array<struct<s: bigint, kind: int, e: bigint>>)")
    return found.join(random, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("random", none))).alias("spans"))


def written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return secrets(table(spark, folder, "documents")).select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )
