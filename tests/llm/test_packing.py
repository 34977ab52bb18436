import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafstack.llm.packing import RoomTree, best_fit, encoder, pack
from leafstack.llm.queries.packing import op1_packing


@pytest.fixture(scope="module")
def reference_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [None, "", " ", "<|endoftext|> a", "x <|endoftext|><|endoftext|>  y <|endoftext",  "naïve — ☃ 𝄞   x", "a" * 3000, "\n \t" * 2000, "word " * 2047, "word " * 9000] + [f"text no {i} it's {'so ' * (i * 7 % 900)}" for i in range(400)]


def test_query(spark, documents, reference_ids):
    data = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "s", 0)] + [(9999, "same", "en", "s", 0)] * 30
    out = op1_packing(spark, documents(data)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t, *_ in data[:len(TEXTS)]:
        ids, own = reference_ids(t), sorted(pieces[i], key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(pieces[9999]) == 30 and len(pieces[None]) == 1
    used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used += at
    assert used / (2048 * len(sequences)) > 0.95


def test_long_runs_match(reference_ids):
    for text in (" " * 300_000, "ab" * 150_000, "é" * 100_000, "1" * 100_000):
        assert [*encoder(None).encode_ordinary(text), 1] == reference_ids(text)


def test_tree_finds_the_tightest():
    rng = np.random.default_rng(0)
    tree, open_ = RoomTree(100), []
    for n in range(2000):
        need = int(rng.integers(1, 101))
        fit = [r for r in open_ if r >= need]
        got = tree.tightest(need)
        assert got == (min(fit) if fit else -1)
        if got >= 0 and n % 3:
            tree.take(got)
            open_.remove(got)
        room = int(rng.integers(1, 101))
        tree.open(room, n)
        open_.append(room)


def test_best_fit_by_hand():
    assert [sorted(w) for w in best_fit([6, 5, 4, 3, 2], 10)] == [[0, 2], [1, 3, 4]]
    assert best_fit([], 10) == []


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert pack(empty).collect() == []
    df = spark.createDataFrame([("k", "a b c d e f g", 1)], "doc_id string, text string, OFFSET int")
    got = sorted(pack(df, window=4).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.length) for r in got] == [("k", 4), ("k", 4)]
