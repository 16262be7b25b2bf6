"""Steps that were rewritten to scale, against plain versions; all rows are built here."""

from __future__ import annotations

import collections
import math

import numpy as np

from varloom.evaluation import boosting


def test_margins_of_a_block_follow_every_tree():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 4):
        splits = 2**depth - 1
        b = rng.integers(0, 16, (5, 40)).astype(np.uint8)
        trees = [(rng.integers(0, 5, (3, splits)), rng.integers(0, 17, (3, splits)), rng.random((3, 2**depth))) for _ in range(2)]
        empty = np.zeros(3)
        start = rng.random((3, 40))
        want = start.copy()
        for feature, cut, value in trees:
            for model in range(3):
                for row in range(40):
                    node = 0
                    for _ in range(depth):
                        node = 2 * node + 1 + (b[feature[model, node], row] > cut[model, node])
                    want[model, row] += value[model, node - splits]
        got = boosting.margins(b, start, boosting.Models(empty, empty, empty, empty, empty, empty, trees), depth)
        assert np.allclose(got, want)


def test_boosting_keeps_rows_in_blocks(spark):
    rows = spark.range(500).selectExpr("id", "array(cast(id as double), cast(id % 7 as double)) AS x", "array(cast(id as double)) AS y", "array(cast(id % 2 + 1 as int)) AS fold")
    s = boosting.Settings(bins=16)
    data, models, width = boosting.prepare(rows.coalesce(1), "id", [boosting.Target("t", "regression")], 1, 2, s)
    assert width == 2 and data.count() == 1 and data.first()["n"] == 500
    back = boosting.row_by_row(data, "id", "bigint").collect()
    assert sorted(r["id"] for r in back) == list(range(500)) and all(r["y"] == [float(r["id"])] and r["fold"] == [r["id"] % 2 + 1] for r in back)


def test_ordinary_text_is_learnt_from_every_character(spark):
    from varloom.llm import op3_secrets as op3

    words = ["the", "qzj", "x9"] * 4000 + ["vvkw"] * 50  # the last ones lie behind the first 20,000 characters
    got = op3.ordinary(spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id long, text string"))
    pairs = collections.Counter()
    for word, n in collections.Counter(words).items():
        for i in range(len(word) + 1):
            pairs[(" " + word + " ")[i : i + 2]] += math.sqrt(n)
    want = op3.chain(pairs)
    assert np.allclose(got[0], want[0]) and math.isclose(got[1], want[1])


def test_sums_by_key_move_no_single_dimensions(spark, monkeypatch):
    """Small and large sets of vectors give the same moments, and nothing is shuffled behind the explosion into dimensions."""
    from varloom.operators import features as ft

    counts = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 1, 4), (None, 1, 1), (3, None, 1), (4, 9, 1)], "sample int, vec_id long, n long")
    basis = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0]), (2, None)], "vec_id long, embedding array<double>")
    for limit in (200_000, 1):
        monkeypatch.setattr(ft, "BROADCAST_VECTORS", limit, raising=False)
        out = ft.moments(counts, basis)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        first = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in first[: first.index("Generate")] and "Generate" in plan
        got = {(r["sample"], r["dim"]): r for r in out.collect()}
        assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)}
        # z of dimension 0 is -1 and 1, of the constant dimension 1 it is 0
        assert abs(got[1, 0]["mean"] + 1 / 3) < 1e-12 and abs(got[1, 0]["variance"] - 8 / 9) < 1e-12 and got[1, 1]["mean"] == 0
        assert got[2, 0]["mean"] == 1 and abs(got[2, 0]["variance"]) < 1e-12
