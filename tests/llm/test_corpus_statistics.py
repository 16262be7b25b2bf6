"""Divergence, collocations and language-model scores against plain versions."""

import sys

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import fixtures
import plain
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from varloom.llm import op11_divergence, op12_collocations, op13_lm
from varloom.llm.queries import QUERIES
from varloom.llm.sampling import remainder


@pytest.fixture(scope="module")
def rows():
    return fixtures.documents()


@pytest.fixture(scope="module")
def awkward(tmp_path_factory, rows):
    return fixtures.write(str(tmp_path_factory.mktemp("statistics")), rows, [], [])


def table(folder, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_op11(spark, awkward):
    want = plain.op11(table(awkward, "lang", "source", "text"))
    assert {r[2] for r in want} <= {"pair", "term"} and found(QUERIES["op11_divergence"](spark, awkward)) == sorted(want)


def test_op11_many_sources(spark, monkeypatch):
    """Several blocks of terms and of sources; nulls, groups without terms, a language without kept terms, ties."""
    monkeypatch.setattr(op11_divergence, "BLOCK", 7)
    monkeypatch.setattr(op11_divergence, "SOURCES", 3)
    rng = np.random.default_rng(4)
    vocabulary = ["Ab", "ab", "é", "straße", "x", *[f"w{chr(97 + i)}" for i in range(26)]]
    docs = [("en", f"s{rng.integers(9)}", " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for _ in range(150)]
    docs += [("en", "empty", None), ("en", None, "12 34"), (None, "a", "ab x"), (None, "b", "ab"), (None, None, None), ("fr", "only", "ab " * 40)]
    docs += [("de", "a", "ab"), ("de", "b", "ab")] * 6
    schema = "lang string, source string, text string"
    got = found(op11_divergence.divergence(spark.createDataFrame(docs, schema)))
    assert got == sorted(plain.op11(docs)) and len({r[1] for r in got if r[0] == "en"}) > 9
    assert [r for r in got if r[0] == ""] and all(r[4] == 0 for r in got if r[0] == "")


def test_op11_slices(monkeypatch):
    monkeypatch.setattr(op11_divergence, "SLICE", 5)
    text = "Abc d3e Éf  " * 7 + "ghijklmnopqrst"
    assert [t for part in op11_divergence.tokens(text.encode()) for t in part] == [b"abc", b"d", b"e", "Éf".encode()] * 7 + [b"ghijklmnopqrst"]


def test_op12(spark, awkward):
    want = plain.op12(table(awkward, "lang", "text"))
    assert len(want) > 3 and found(QUERIES["op12_collocations"](spark, awkward)) == sorted(want)


@pytest.mark.parametrize("least,longest,top", [(2, 5, 2000), (3, 4, 7), (1, 5, 50), (10**9, 5, 10)])
def test_op12_low_counts(spark, awkward, monkeypatch, least, longest, top):
    """Many phrases, small chunks, split prefixes and several flushes."""
    for name, value in (("CHUNK", 2000), ("ENTRIES", 300), ("HEAVY", 40)):
        monkeypatch.setattr(op12_collocations, name, value)
    docs = [r for r in table(awkward, "lang", "text") if r[1] is None or len(r[1]) < 2000]
    got = op12_collocations.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(3), least, longest, top)
    assert found(got) == sorted(plain.op12(docs, least, longest, top))


def test_op12_long_text(spark):
    """One text of three million words, a third of them one word."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("the "), F.hex(i), F.lit(" of"))), " ")
    got = found(op12_collocations.collocations(spark.range(1).select(F.lit("en").alias("lang"), text.alias("text"))))
    assert got == [("en", 1, "of the", 999_999, 1_000_000, 1_000_000, 3_000_000, 2999)]


def close(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in (*r[:5], round(r[5], 6), round(r[6], 6)))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_op13(spark, awkward, rows):
    close([tuple(r) for r in QUERIES["op13_lm"](spark, awkward).collect()], plain.op13(rows, op13_lm.LEAST, op13_lm.DISCOUNT, op13_lm.GAIN))


@pytest.mark.parametrize("together,gain", [(1, -9.0), (1000, 0.7)])
def test_op13_many_ngrams(spark, rows, monkeypatch, together, gain):
    """All repeated n-grams, several blocks, chunks and flushes; texts walked side by side and one by one."""
    for name, value in (("CHUNK", 2000), ("ENTRIES", 500), ("HEAVY", 40), ("BLOCK", 20_000), ("TOGETHER", together)):
        monkeypatch.setattr(op13_lm, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op13_lm.score_documents(docs, remainder(7) == 2, least=2, gain=gain)
    want = plain.op13(rows, 2, op13_lm.DISCOUNT, gain)
    close([tuple(r) for r in got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()], want)
    assert sum(a[6] for a in want) > sum(a[5] for a in want)


def test_op13_without_training_rows(spark):
    held = [d for d in range(60) if plain.remainder(d, 7) == 2]
    docs = spark.createDataFrame([(d, "a b") for d in held] + [(held[0], None)], "doc_id long, text string")
    got = op13_lm.score_documents(docs, remainder(7) == 2).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)} and sorted(r["n_tokens"] for r in got) == [1] + [3] * len(held)


def test_op13_long_text(spark):
    """One text of two million distinct words and one word repeated: walked to its end."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2_000_000)), lambda i: F.when(i % 2 == 0, F.lit("the")).otherwise(F.hex(i))), " ")
    docs = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), text.alias("text"))
    r = op13_lm.score_documents(docs, F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (2_000_001, 2_000_001, 2_000_001) and r["score"] <= 0


def test_op13_lookups_do_not_grow_with_the_texts(monkeypatch):
    """Arcs of many tokens are looked up at once; cut into runs of a few tokens they give the same sums."""
    rng = np.random.default_rng(5)
    vocabulary = np.sort(rng.integers(1, 2**63, 8).astype(np.uint64))
    texts = [np.append(rng.choice(vocabulary, 200), op13_lm.END) for _ in range(20)]
    t, first = np.concatenate(texts), np.arange(21) * 201
    pairs = np.unique(op13_lm.fold(t[:-1], t[1:])[: 100])
    single = vocabulary, np.arange(8) + 20, np.linspace(-1, -0.1, 8)
    longer = pairs, np.linspace(-0.5, -0.2, len(pairs)), np.full(len(pairs), np.nan)
    calls = []
    find = op13_lm.Walk.find
    monkeypatch.setattr(op13_lm.Walk, "find", staticmethod(lambda *a: calls.append(1) or find(*a)))
    walk = op13_lm.Walk(t, first, single, longer, np.ones(20, dtype=bool), 4000, 9)
    whole = walk.scores()
    assert len(calls) < 10
    monkeypatch.setattr(op13_lm, "TOGETHER", 7)
    assert np.array_equal(whole, walk.scores()) and (whole < 0).all()
