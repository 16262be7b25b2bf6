"""Quality rules as a learned decision list.

Fixed counts of a text (words, characters, symbols, repeated lines and windows) give statistics that are easy to read. From
labelled rows, sequential covering learns an ordered list of rules for low quality: a rule grows, one threshold at a time,
by information gain on one part of the rows, is pruned on the other part, and is kept while it is right often enough; rows
it covers are then set aside for the next rule. The list is emitted as one conditional Spark expression.

Applying it is column expressions only. Null and empty texts have no words and fail the base rule. Without labels of both
kinds the list is empty and keeps every text that passes the base rule. Repeated rows are judged each for itself; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.registry import query, table
from varloom.llm.sampling import LONGEST

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Labelled rows of each label, about, that a fit reads; chosen by a hash of the id.
SAMPLE = 1500
#: Least share of low-quality rows among what a rule covers.
RIGHT = 0.8
STATISTICS = ["n_words", "mean_length", "symbols", "repeats", "lines_again", "capitals", "digits", "marks"]


def without(text: Column, chars: str) -> Column:
    """Length of ``text`` without ``chars``."""
    return F.length(F.translate(text, chars, ""))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with the base counts and a few more; temporary columns start with ``q_``."""
    out = docs.withColumn("q_t", F.coalesce(F.col("text"), F.lit("")))
    t = F.col("q_t")
    out = out.withColumns({"q_len": F.length(t), "q_w": F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")})
    out = out.withColumns({
        "n_words": F.size("q_w").cast("long"), "word_chars": without(t, BLANKS).cast("long"), "n_symbols": (F.col("q_len") - without(t, SYMBOLS)).cast("long"),
        "q_lines": F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
        "q_upper": F.col("q_len") - without(t, UPPER), "q_digits": F.col("q_len") - without(t, "0123456789"), "q_marks": F.col("q_len") - without(t, "!?"),
    })
    # 3-word windows as (hash, place), sorted: equal windows become neighbours
    last = F.greatest(F.size("q_w") - 3, F.lit(0))
    window = lambda i: F.struct(F.xxhash64(F.get("q_w", i), F.get("q_w", i + 1), F.get("q_w", i + 2)).alias("h"), i.alias("at"))
    none = F.expr("cast(array() AS array<struct<h: bigint, at: int>>)")
    out = out.withColumn("q_s", F.when(F.size("q_w") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), last), window))).otherwise(none))
    at = lambda j: F.get("q_s", j)["at"]
    same = lambda j: (  # noqa: E731  hashes meet and so do the words
        (F.get("q_s", j)["h"] == F.get("q_s", j - 1)["h"])
        & (F.get("q_w", at(j)) == F.get("q_w", at(j - 1))) & (F.get("q_w", at(j) + 1) == F.get("q_w", at(j - 1) + 1)) & (F.get("q_w", at(j) + 2) == F.get("q_w", at(j - 1) + 2)))
    out = out.withColumn("q_p", F.when(F.size("q_s") >= 2, F.filter(F.sequence(F.lit(1), F.greatest(F.size("q_s") - 1, F.lit(1))), same)).otherwise(F.expr("cast(array() AS array<int>)")))
    covered = F.array_distinct(F.flatten(F.transform("q_p", lambda j: F.array(at(j), at(j) + 1, at(j) + 2, at(j - 1), at(j - 1) + 1, at(j - 1) + 2))))
    return out.withColumns({"n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"), "n_repeat_words": F.size(covered).cast("long")})


def statistics(counted: DataFrame) -> DataFrame:
    """Add the statistics that rules may use."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return counted.withColumns({
        "mean_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n, "repeats": F.col("n_repeat_words") / n,
        "lines_again": F.col("n_dup_lines") / F.greatest(F.size("q_lines"), F.lit(1)), "capitals": F.col("q_upper") / chars, "digits": F.col("q_digits") / chars, "marks": F.col("q_marks") / n,
    })


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, STATISTICS.index(self.statistic)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold


def covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: np.ndarray, low: np.ndarray, longest: int = 4) -> list[Condition]:
    """Add the condition with the greatest information gain until only low-quality rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < longest and low[inside].any() and not low[inside].all():
        p, n = low[inside].sum(), (~low[inside]).sum()
        base, best, choice = np.log2(p / (p + n)), 1e-9, None
        for k, name in enumerate(STATISTICS):
            values = np.unique(x[inside, k])
            cuts = (values[1:] + values[:-1]) / 2
            if len(cuts) > 64:
                cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, 64)))
            for cut in cuts:
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    hit = inside & c.holds(x)
                    a, b = low[hit].sum(), (~low[hit]).sum()
                    if a and (gain := a * (np.log2(a / (a + b)) - base)) > best:
                        best, choice = gain, (c, hit)
        if choice is None:
            break
        rule.append(choice[0])
        inside = choice[1]
    return rule


def prune(rule: list[Condition], x: np.ndarray, low: np.ndarray) -> list[Condition]:
    """The beginning of ``rule`` that is most right on rows it was not grown on."""

    def worth(r: list[Condition]) -> float:
        hit = covers(r, x)
        return (low[hit].sum() - (~low[hit]).sum()) / max(1, hit.sum())

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn(x: np.ndarray, low: np.ndarray, right: float = RIGHT, rules: int = 12) -> list[list[Condition]]:
    """Ordered rules for low quality from statistics ``x`` and labels ``low``."""
    out: list[list[Condition]] = []
    while len(out) < rules and low.any() and not low.all():
        part = np.arange(len(x)) % 3 == 2
        rule = grow(x[~part], low[~part])
        rule = prune(rule, x[part], low[part]) if rule else rule
        hit = covers(rule, x)
        if not rule or hit.sum() < 3 or low[hit].mean() < right:
            break
        out.append(rule)
        x, low = x[~hit], low[~hit]
    return out


def expression(rules: list[list[Condition]]) -> Column:
    """Verdict of the list: false at the first rule that holds, else true."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = out.when(both, F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from about ``sample`` rows of either quality; only their statistics come to the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col("quality") == value, int(1_000_000 * min(1, sample / n)) + 1).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")  # ``chosen``: about 2 x sample rows
    found = sorted(statistics(counts(rows)).select("doc_id", "quality", *STATISTICS).collect())
    x = np.array([[float(v) for v in r[2:]] for r in found]).reshape(-1, len(STATISTICS))
    return learn(x, np.array([r["quality"] == 0 for r in found], dtype=bool))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed and kept."""
    n = F.col("n_words")
    out = statistics(counts(docs.select("doc_id", "text"))).withColumn("base_failed", (n < 50) | (F.col("n_repeat_words") * 100 > n * 50))
    kept = ~F.col("base_failed") & expression(rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


@query("op5_rules")
def op5_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document by the rules learnt from all labelled rows."""
    docs = table(spark, folder, "documents")
    return judge(docs, fit(docs, table(spark, folder, "labels")))
