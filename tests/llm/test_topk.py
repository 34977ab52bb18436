import math

import numpy as np
import pytest

from leafstack.llm import topk
from leafstack.llm.queries.topk import op9_exact_topk
from leafstack.llm.topk import Cell, depths, top_k


def plain(rows, k=5):
    ok = [(i, v, [math.floor(256 * np.float64(np.float32(x))) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in ok:
        if v is not None and v % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(e, f)), w is None, w) for j, w, f in ok if j != i), key=lambda x: (x[0], x[1], x[2] or 0))
            out += [(v, r + 1, w, -s) for r, (s, _, w) in enumerate(scores[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [4096, 40])
def test_query(spark, documents, monkeypatch, least):
    monkeypatch.setattr(topk, "LEAST_CELL", least)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(700)]
    rows += [(50, rows[0][1]), (50, rows[0][1]), (None, rows[0][1]), (800, None), (850, [0.1, None]), (900, [float("nan")] * 16), (950, [float("inf")] * 16), (1000, [0.0] * 16), (1050, [0.5, 1.0]), (1100, [])]
    folder = documents([(*r, 1) for r in rows], "embeddings", "vec_id long, embedding array<float>, label int")
    assert sorted(str(tuple(r)) for r in op9_exact_topk(spark, folder).collect()) == plain(rows)


def test_ties_and_signs():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 40, (5000, 12)))
    x[1000:1200] = x[7]
    cell = Cell(x)
    for q in [x[7], x[11], -x[3], np.zeros(12), np.eye(12)[4], x[5][:5]]:
        want = x[:, :len(q)] @ q
        rows, score = cell.best(q, 5, own=7)
        assert (score == want[rows]).all() and 7 not in rows
        kth = np.sort(np.delete(want, 7))[-5]
        assert (np.flatnonzero(want >= kth).tolist() if kth > want[7] else np.flatnonzero((want >= kth) & (np.arange(5000) != 7)).tolist()) == sorted(rows.tolist())


def test_reading_stops_when_outsiders_cannot_qualify():
    """Rows whose components go together: the best are at the head of all lists."""
    rng = np.random.default_rng(3)
    x = np.floor(np.exp(rng.normal(0, 1.5, (8192, 1))) * rng.uniform(80, 120, (8192, 16)))
    cell = Cell(x)
    for k in range(30):
        q = np.floor(rng.uniform(1, 256, 16))
        rows, score = cell.best(q, 5)
        assert cell.depth <= 1024 and len(rows) == 5  # an eighth of each list, and nothing but the answer is resolved
        assert sorted(rows.tolist()) == sorted(np.argsort(-(x @ q), kind="stable")[:5].tolist())
    # independent components: the lists are read further, and still only the best are resolved
    x = np.floor(rng.normal(0, 32, (8192, 64)))
    cell = Cell(x)
    for k in range(5):
        rows, score = cell.best(x[k], 5, own=k)
        assert 5 <= len(rows) <= 8
    assert depths(100) == [3, 12, 50, 88, 94, 97, 99, 100]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, SCORE string"
    assert top_k(spark.createDataFrame([], schema)).collect() == []
    assert top_k(spark.createDataFrame([(50, [1.0], "a")], schema)).collect() == []
    got = top_k(spark.createDataFrame([(50, [1.0], "a"), (3, [-0.001], "b")], schema)).collect()
    assert [tuple(r) for r in got] == [(50, 1, 3, -256)]
