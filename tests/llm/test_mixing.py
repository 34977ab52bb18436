import re
from collections import Counter, defaultdict

import pytest

from leafstack.llm.mixing import mix, mix_targets, mixed_documents
from leafstack.llm.queries.mixing import op2_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Give by weight, clip, share the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    free, left, out = set(order), share * sum(sizes.values()), {}
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        if not above:
            out |= {s: level * w[s] for s in free}
            break
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= above
    return out


def rows():
    texts = [None, "", "  \n ", "one", " x y\x0bz", "w " * 5000] + [f"some words here {i} " * (1 + i % 13) for i in range(700)]
    data = [(i, t, "en", f"s{'' if i % 3 else i % 11}", 0) for i, t in enumerate(texts)]
    data += [(900 + i, "tail text of null", "en", None, 0) for i in range(20)] + [(5000, "same row here", "en", "dup", 0)] * 100
    return data + [(6000, None, "en", "void", 0)]


def test_query(spark, documents):
    data = rows()
    folder = documents(data)
    out = op2_mixing(spark, folder).collect()
    assert len(out) == len(data)
    assert sorted((r.doc_id, r.size) for r in out) == sorted((i, len(WORD.findall(t or ""))) for i, t, *_ in data)
    sizes, of, taken = Counter(), {}, defaultdict(int)
    for i, t, _, s, _ in data:
        sizes[s] += len(WORD.findall(t or ""))
        of[i] = s
    want = targets(sizes)
    for r in out:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken >= r.size * int(want[s] // max(sizes[s], 1)) or not r.size
        taken[s] += r.taken
    for s in sizes:  # exact but for rounding
        assert abs(taken[s] - want[s]) <= 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = op2_mixing(spark, folder).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_weights_decide(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'a b c d e' text", "if(id < 3990, 'x', 'y') source", "if(id % 2 = 0, 1.0, 0.05) q")
    out = mix(df, weights=(1,), share=0.4, quality="q").collect()
    good, bad = (sum(r.taken for r in out if r.doc_id % 2 == k) for k in (0, 1))
    assert good > 3 * bad > 0


def test_documents_of_a_mix(spark):
    df = spark.createDataFrame([(1, "a b  c d", "s", 9), (2, None, "s", 9), (3, "x", "t", 9)], "doc_id long, text string, source string, Size int")
    mixed = mix(df, share=1.25)
    texts = [r.text for r in mixed_documents(mixed).collect()]
    assert mixed_documents(mixed).columns == ["doc_id", "text", "source"]
    assert sum(len(WORD.findall(t)) for t in texts) == sum(r.taken for r in mixed.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).collect() == []
    assert mix_targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).agg({"target": "sum"}).first()[0] == 0.0
