import math

import numpy as np
import pytest

from leafstack.llm import negatives
from leafstack.llm.negatives import CoverTree, Forest, _best_of, hard_negatives
from leafstack.llm.queries.negatives import op13_hard_negatives


def plain(rows):
    ok = []
    for v, e, label in rows:
        if e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        ok.append((v, [math.floor(256 * np.float64(np.float32(x))) for x in e], (label + 1) % 10 if v is not None and v % 7 == 0 else label))
    out = []
    for i, (a, e, label) in enumerate(ok):
        if a is None or a % 50:
            continue
        scores = sorted(((sum(x * y for x, y in zip(e, f)), w, m == label) for j, (w, f, m) in enumerate(ok) if j != i), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, p, _ in [s for s in scores if s[2]][:5]:
            hard = [s for s in scores if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(a, p, r + 1, w, ps, s) for r, (s, w, _) in enumerate(hard)]
    return sorted(map(str, out))


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("least", [4096, 40])
def test_query(spark, documents, monkeypatch, least):
    monkeypatch.setattr(negatives, "LEAST_CELL", least)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0.1, 0.2, 16).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(700)]
    rows += [(50, rows[0][1], 1), (50, rows[0][1], 1), (None, rows[0][1], 0), (800, None, 1), (850, [0.1, None], 1), (900, [float("nan")] * 16, 1), (950, [float("inf")] * 16, 2), (1000, [0.0] * 16, 3),
             (1050, [0.5, 1.0], 2), (1100, [], 1), (1150, rows[3][1], None), (1200, rows[4][1], 9), (1250, [-1.0] * 16, 1)]
    got = sorted(str(tuple(r)) for r in op13_hard_negatives(spark, documents(rows, "embeddings", SCHEMA)).collect())
    assert len(got) > 100 and got == plain(rows)


def clustered(rng, n, dims=8, clusters=20):
    centers = rng.normal(0, 200, (clusters, dims))
    return np.floor(centers[rng.integers(clusters, size=n)] + rng.normal(0, 6, (n, dims)))


def test_tree_invariants():
    rng = np.random.default_rng(2)
    x = np.concatenate([clustered(rng, 500), np.repeat(clustered(rng, 1), 40, axis=0)])
    t = CoverTree(x)
    square = (x**2).sum(axis=1)
    lifted = np.concatenate([x, np.sqrt(square.max() - square)[:, None]], axis=1)
    assert sorted(t.point[~t.again].tolist()) == list(range(len(x)))
    below = {}

    def points(node):
        out = {int(t.point[node])}
        for child in range(t.first[node], t.last[node]):
            assert t.radius[child] <= t.radius[node] + 1e-9 or not t.again[child]
            out |= points(child)
        below[node] = out
        return out

    assert points(0) == set(range(len(x)))
    for node, inside in below.items():
        d = np.linalg.norm(lifted[list(inside)] - lifted[t.point[node]], axis=1).max()
        assert d <= t.radius[node] + 1e-3 and (t.radius[node] <= d + 1e-3)


def test_descent_skips_what_is_outside_the_windows():
    rng = np.random.default_rng(3)
    x = clustered(rng, 4000)
    labels = rng.integers(3, size=4000)
    ids = rng.permutation(4000)
    f = Forest(x, labels)
    for at in range(0, 60):
        q, score = x[at], x @ x[at]
        top = np.sort(score)[-20]
        windows = np.array([(0.5 * top, np.floor(0.95 * top)), (0.9 * top, top), (-np.inf, np.inf)])
        rows, got = f.search(q, f.roots[f.labels != labels[at]], windows[:2], 3, at)
        assert (got == score[rows]).all() and len(set(rows.tolist())) == len(rows)
        assert len(rows) < 1500  # of some 2,700
        ok = np.flatnonzero(labels != labels[at])
        want = _best_of(windows[:2], ok, score[ok], ids, 3)
        assert [a.tolist() for a in _best_of(windows[:2], rows, got, ids, 3)] == [a.tolist() for a in want]
        rows, got = f.search(q, f.roots, windows[2:], 5, at)
        ok = np.delete(np.arange(4000), at)
        assert [a.tolist() for a in _best_of(windows[2:], rows, got, ids, 5)] == [a.tolist() for a in _best_of(windows[2:], ok, score[ok], ids, 5)]


def test_few_and_none(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA + ", RANK int")).collect() == []
    assert hard_negatives(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).collect() == []
    got = hard_negatives(spark.createDataFrame([(50, [1.0], 1), (3, [1.0], 1), (4, [0.5], 2), (5, [0.96], 2), (6, [0.95], 2), (8, [0.7], 0)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [(50, 3, 1, 6, 65536, 243 * 256), (50, 3, 2, 8, 65536, 179 * 256), (50, 3, 3, 4, 65536, 128 * 256)]
