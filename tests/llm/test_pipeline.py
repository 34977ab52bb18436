"""Every stage of the pipeline on its own input, against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from leafstack.llm.packing import encoder
from test_mixing import WORD, targets
from test_substrings import plain

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input of the first stage and output of each, as written tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", "en", None, 0), (9003, "12345 !!! 67", "en", "src1", 12), (9004, "ещё один текст на другом языке " * 9, None, "src1", 279)], docs.schema)
    out = [docs.unionByName(odd)]
    out[0] = cp.written(out[0], "input")
    for name, stage in cp.STAGES:
        out.append(cp.written(stage(spark, out[-1], SF), name))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "mixing", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:5])


def test_language_stage_keeps_clean_documents(stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    assert before - after == {9001, 9002, 9003, 9004}


def test_near_dedup_stage(stages):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}

    before, after = ({r.doc_id: shingles(r.text) for r in s.collect()} for s in stages[1:3])
    assert set(after) <= set(before)
    near = lambda a, b: len(a & b) / len(a | b)
    gone = set(before) - set(after)
    for i in gone:  # nothing goes without a similar, earlier one that stays
        assert max(near(before[i], after[j]) for j in after if j < i) > 0.6
    kept = sorted(after)
    assert sum(near(after[i], after[j]) >= 0.9 for k, i in enumerate(kept) for j in kept[:k]) == 0


def test_substring_stage(stages):
    before = sorted(stages[2].collect())
    after = {r.doc_id: r for r in stages[3].collect()}
    assert len(after) == len(before)
    for r, (n, gone, _) in zip(before, plain([r.text for r in before]), strict=True):
        words = WORD.findall(after[r.doc_id].text)
        assert len(words) == n - gone and (gone or after[r.doc_id].text == r.text)
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text) or not gone


def test_mixing_stage(stages):
    sizes, taken, copies = Counter(), defaultdict(int), Counter()
    words = {}
    for r in stages[3].collect():
        words[r.doc_id] = WORD.findall(r.text or "")
        sizes[r.source] += len(words[r.doc_id])
    for r in stages[4].collect():
        own = WORD.findall(r.text)
        assert own == words[r.doc_id][:len(own)]
        taken[r.source] += len(own)
        copies[r.doc_id] += 1
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and max(copies.values()) <= 3


def test_packing_stage(stages):
    want = defaultdict(list)
    for r in stages[4].collect():
        want[r.doc_id].append(np.array([*encoder(None).encode_ordinary(r.text), 1], "<u4").tobytes())
    pieces = defaultdict(list)
    for r in stages[5].collect():
        pieces[r.doc_id].append(r)
        assert r.length * 4 == len(r.ids) and r.offset + r.length <= 2048
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert sum(len(r.ids) for r in own) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            assert b"".join(bytes(r.ids) for r in own) == want[i][0]


def test_run_and_empty(spark, tmp_path):
    assert cp.run(spark, SF).limit(1).count() == 1
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, empty, SF)
        assert out.collect() == []
        empty = out if out.columns == COLUMNS else empty
