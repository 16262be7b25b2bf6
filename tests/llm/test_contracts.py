"""Every query on small tables of awkward rows and on empty tables, against plain versions."""

import sys
import zlib

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import fixtures
import plain
from pyspark.sql import functions as F

import corpus_pipeline
from varloom.llm.queries import QUERIES

NAMES = sorted(QUERIES)


def by_none(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def rows():
    return fixtures.documents()


@pytest.fixture(scope="module")
def awkward(tmp_path_factory, rows):
    labels = [(r[0], i % 2 if i % 5 else None, (i // 2) % 2) for i, r in enumerate(rows)] + [(None, 1, 1), (9999, 0, 0), (1, 0, 1)]
    return fixtures.write(str(tmp_path_factory.mktemp("awkward")), rows, fixtures.items(rows), labels)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return fixtures.write(str(tmp_path_factory.mktemp("empty")), [], [], [])


def got(spark, folder, name, *columns):
    return by_none(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_op1(spark, awkward, rows):
    want = plain.op1(rows, fixtures.items(rows))
    assert sum(r[2] > 0 for r in want) > 6
    assert got(spark, awkward, "op1_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == by_none(want)


def test_op1_without_items(spark, tmp_path, rows):
    folder = fixtures.write(str(tmp_path), rows, [], [])
    assert got(spark, folder, "op1_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == by_none(plain.op1(rows, []))


def test_op2(spark, awkward, rows):
    assert got(spark, awkward, "op2_jaccard", "doc_id", "n_shingles", "component_id") == by_none(plain.op2(rows))


def test_op2_chains(spark, tmp_path):
    """Links that only lead to each other step by step, and many near copies of one text."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        docs.append((200 - i, " ".join(words)))
        words = words[3:] + [f"x{i}a", f"x{i}b", f"x{i}c"]
    base = [f"b{i}" for i in range(150)]
    for i in range(80):
        w = list(base)
        w[rng.randrange(150)] = f"c{i}"
        w[rng.randrange(150)] = f"d{i}"
        docs.append((1000 + i, " ".join(w)))
    folder = fixtures.write(str(tmp_path), docs, [], [])
    assert got(spark, folder, "op2_jaccard", "doc_id", "n_shingles", "component_id") == by_none(plain.op2(docs))


def test_op3(spark, awkward, rows):
    assert got(spark, awkward, "op3_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == by_none(plain.op3(rows))


def test_op3_random_runs(spark):
    """Random keys are reported, long ordinary words and readable names are not."""
    import random

    from varloom.llm.op3_secrets import secrets

    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    ordinary = [(i, "".join(rng.choice(["tion", "ing", "heit", "lich", "un", "ent"]) for _ in range(rng.randint(5, 12)))) for i in range(400)]
    keys = [(1000 + i, "key " + "".join(rng.choice(alphabet) for _ in range(44)) + " end") for i in range(60)]
    named = [(2000 + i, "see section_1_of_the_manual_page_22_and_others_aaaaaaaa_11111111") for i in range(60)]
    found = secrets(spark.createDataFrame(ordinary + keys + named, "doc_id long, text string")).selectExpr("doc_id", "size(spans) AS n").collect()
    hits = {r["doc_id"] for r in found if r["n"]}
    assert len([i for i in hits if 1000 <= i < 2000]) > 30
    assert not [i for i in hits if i < 1000 or i >= 2000]


def planted(spark, kinds, each=40):
    """How many of ``each`` random keys of every (alphabet, length) are reported beside 2,000 long ordinary words, and how many words."""
    import random

    from varloom.llm.op3_secrets import secrets

    rng = random.Random(7)
    rows = [(-1 - i, " ".join("".join(rng.choice(["tion", "ing", "heit", "lich", "un", "ent", "er", "ge", "sch"]) for _ in range(k)) for k in (2, 3, 8))) for i in range(2000)]
    rows += [(each * j + i, "key " + "".join(rng.choice(a) for _ in range(n)) + " end") for j, (a, n) in enumerate(kinds) for i in range(each)]
    hits = [r["doc_id"] for r in secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("exists(spans, x -> x.kind = 3)").collect()]
    return [sum(each * j <= d < each * (j + 1) for d in hits) for j in range(len(kinds))], sum(d < 0 for d in hits)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def test_op3_random_keys_of_all_lengths(spark):
    """Nearly every random key is reported, at each length."""
    found, wrong = planted(spark, [(LOWER + UPPER + DIGITS, n) for n in (20, 40, 128)] + [(LOWER + DIGITS, 20), (UPPER + DIGITS, 32)])
    assert min(found) >= 36 and wrong == 0


def test_op3_random_keys_without_digits_or_letters(spark):
    """Keys of one case, of letters only and of digits are candidates as all others are."""
    found, wrong = planted(spark, [(LOWER, 16), (UPPER, 16), (LOWER + UPPER, 16), (LOWER, 40), (DIGITS, 20)])
    assert min(found) >= 36 and wrong == 0


@pytest.mark.parametrize("name,divisor,left", [("op4_toxicity", 3, 1), ("op8_quality", 4, 2)])
def test_scores(spark, awkward, rows, name, divisor, left):
    found = QUERIES[name](spark, awkward).collect()
    assert by_none((r["doc_id"], r["held_out"]) for r in found) == by_none((d, plain.remainder(d, divisor) == left) for d, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)


@pytest.mark.parametrize("name,divisor,left,label,least", [("op4_toxicity", 3, 1, "toxic", 0.75), ("op8_quality", 4, 2, "quality", 0.95)])
def test_held_out(spark, name, divisor, left, label, least):
    """Area under the curve on rows that were not learnt from."""
    folder = "/root/testdata/sf0.01"
    found = QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    high, low = [r["score"] for r in found if r[label] == 1], [r["score"] for r in found if r[label] == 0]
    assert sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low)) > least


def test_op5(spark, awkward, rows):
    found = got(spark, awkward, "op5_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == by_none(plain.op5(rows))
    assert not [r for r in QUERIES["op5_rules"](spark, awkward).collect() if r["kept"] and r["base_failed"]]


def test_op5_long_text(spark):
    """Repeated windows count wherever they stand, also beyond two million words."""
    from varloom.llm.op5_rules import counts

    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 21)), lambda i: F.hex(i)), " "), F.lit(" g h i j g h i j"))
    found = counts(spark.range(1).select(text.alias("text"))).select("n_words", "n_repeat_words").first()
    assert tuple(found) == ((1 << 21) + 8, 8)


def test_op5_rules_are_found():
    import numpy as np

    from varloom.llm.op5_rules import STATISTICS, covers, learn

    rng = np.random.default_rng(1)
    x = rng.random((600, len(STATISTICS)))
    low = (x[:, 2] > 0.7) | ((x[:, 3] > 0.8) & (x[:, 5] < 0.5))
    rules = learn(x, low)
    hit = np.any([covers(r, x) for r in rules], axis=0)
    assert (hit == low).mean() > 0.97 and all(len(r) <= 4 for r in rules)


def test_op6(spark, awkward):
    found = got(spark, awkward, "op6_html", "page_id", "text", "n_chars")
    assert found == by_none([(1, "", 0), (2, "", 0), (3, "a & b\nc", 7), (3, "a & b\nc", 7), (None, "plain text", 10), (5, "never closed", 12)])


def test_op6_layouts():
    from varloom.llm.op6_html import main_text

    body = "A paragraph of the article that is long enough to count as a surge of text in any window of lines."
    page = f"<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><div id='top-menu'><a href='#'>Home</a> <a>About</a></div><div class='cookie-notice'>We use cookies.</div><div><h1>T &amp; t</h1><p>{body}<!-- x --></p><div class='ad'>Buy</div><p>Short\n end.</p></div><div id='comments'><p>{body}</p></div><footer>{body}</footer></body></html>"
    assert main_text(page) == f"T & t\n{body}\nShort end."
    assert main_text(f"<body><nav>x</nav><article><h1>Hi</h1><p>b</p><aside>{body}</aside><p>c</p></article><p>{body}</p></body>") == "Hi\nb\nc"


def test_op6_wrappers():
    """What wraps the article is no boilerplate, whatever its name; its controls, menus and comments still are."""
    from varloom.llm.op6_html import main_text

    body = "A paragraph of the article that is long enough to count as a surge of text in any window of lines."
    main = f"<main><h1>Hi</h1><p>{body}</p></main>"
    want = f"Hi\n{body}"
    assert main_text(f"<body><form id=f><select><option>a</option></select>{main}<button>Go</button></form></body>") == want
    assert main_text(f"<body><div class='layout has-sidebar'><article><h1>Hi</h1><p>{body}</p></article><div class='sidebar'>{body}</div></div></body>") == want
    for name in ("widget", "elementor-widget", "page header", "share", "related", "search notice"):
        assert main_text(f"<body><nav>x</nav><div class='{name}'>{main}</div></body>") == want
        assert main_text(f"<body><nav>x</nav><div class='{name}'><h1>Hi</h1><p>{body}</p></div></body>") == want
    assert main_text(f"<body><div class='elementor-widget'><p>{body}</p></div><div class='elementor-widget'><p>{body}</p></div></body>") == f"{body}\n{body}"
    comments = f"<div id='comments'><article>{body}</article><article>{body}</article></div>"
    assert main_text(f"<body><article><h1>Hi</h1><p>{body}</p></article>{comments}</body>") == want
    assert main_text(f"<body><main><article><h1>Hi</h1><p>{body}</p></article>{comments}</main></body>") == want


def test_op7(spark, awkward, rows):
    from varloom.llm.op7_packing import tokenizer, vocabulary

    found = QUERIES["op7_packing"](spark, awkward).collect()
    left = plain.op7(rows, tokenizer(vocabulary()))
    docs, sequences = {}, {}
    for doc, ids in left:
        docs.setdefault(doc, []).append(ids)
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["length"] for r in found) == sum(len(ids) // 4 for _, ids in left)
    for doc, parts in pieces.items():
        for r in parts:
            assert any(r["doc_tokens"] == len(ids) // 4 and zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for ids in docs[doc])
        if len(docs[doc]) == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == len(docs[doc][0]) // 4
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_op7_ids_of_odd_texts():
    import random

    import numpy as np
    import pyarrow as pa

    from varloom.llm.op7_packing import token_bytes, tokenizer, vocabulary

    rng = random.Random(2)
    texts = ["".join(rng.choice("aAzé ÉßÜ'sS'tll're12_-.,!?<|\t\n\xa0\x1c\x85²½İΣσ…“—漢é") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    want = [np.asarray(tokenizer(vocabulary()).encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(token_bytes(pa.array(texts), vocabulary())) == want


def test_op7_three_million_words():
    """A text with more distinct words than the table of words has slots at first."""
    import numpy as np
    import pyarrow as pa

    from varloom.llm.op7_packing import WordIds, token_bytes, tokenizer, vocabulary

    known, rng = WordIds(), np.random.default_rng(1)
    hashes = np.unique(rng.integers(1, 2**63, 3_000_000, dtype=np.uint64))
    known.add(hashes, np.arange(len(hashes), dtype="<u4"), np.arange(1, len(hashes) + 1))
    assert (known.find(hashes) == np.arange(1, len(hashes) + 1)).all() and not known.find(hashes + np.uint64(1)).any()
    text = " ".join(f"{i:x}" for i in range(16**5, 16**5 + 3_000_000))
    got = next(iter(token_bytes(pa.array([text]), vocabulary())))
    part = text[: text.index(" ", 70_000)]
    assert got.startswith(np.asarray(tokenizer(vocabulary()).encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes())


def test_op9(spark, awkward, rows):
    found = QUERIES["op9_language"](spark, awkward).collect()
    assert by_none((r["doc_id"], r["held_out"]) for r in found) == by_none((d, plain.remainder(d, 5) == 0) for d, _ in rows)
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {60, 61, 62, 67, 68}
    assert {r["lang_pred"] for r in found} <= {"en", "de", "und"} and all(0 <= r["score"] <= 1 for r in found)


def test_op9_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op9_language"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98


def test_op9_many_languages():
    from varloom.llm.op9_language import codewords

    for k in (1, 2, 3, 6, 9, 40):
        code = codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k


def test_op10(spark, awkward, rows):
    want = plain.op10(rows)
    assert sum(r[2] > 0 for r in want) > 8
    assert got(spark, awkward, "op10_substrings", "doc_id", "n_words", "n_removed", "kept_sha256") == by_none(want)


def test_pipeline(spark, awkward, rows):
    """Stage by stage on awkward rows: what must go goes, clean documents and columns stay, secrets are masked."""
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    columns, counts = docs.columns, []
    from varloom.llm.store import materialise

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, awkward), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert not [d for d, _ in texts if d in (60, 61, 62, 67, 68)]
    assert "AKIA0123" not in "".join(t for _, t in texts) and any(corpus_pipeline.MASK in t for _, t in texts)
    assert not [r for r in plain.op1(texts, fixtures.items(rows)) if r[-1] and r[0] != 80]
    components = plain.op2([(i, t) for i, (_, t) in enumerate(texts)])
    assert all(c == i for i, _, c in components)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, awkward)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in texts}


def test_pipeline_names_its_limit(spark, awkward, monkeypatch):
    """The stage of near duplicates does not depend on the defaults of the operator."""
    from varloom.llm import op2_jaccard

    asked = {}

    def components(docs, **limit):
        asked.update(limit)
        return docs.selectExpr("doc_id", "1L AS n_shingles", "doc_id AS component_id")

    monkeypatch.setattr(op2_jaccard, "jaccard_components", components)
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    assert corpus_pipeline.near_duplicates(spark, docs, awkward).count() == docs.count()
    assert asked == {"k": 4, "percent": 85}


def test_pipeline_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_components(spark):
    from varloom.llm.components import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(50, 60)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {x: 50 for x in [*range(50, 60), 100]}
