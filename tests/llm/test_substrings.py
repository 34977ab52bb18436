import hashlib
import random
import re
from collections import Counter

import numpy as np

from leafstack.llm import substrings
from leafstack.llm.queries.substrings import op7_substring_dedup
from leafstack.llm.substrings import Windows, cells, remove_repeats, sliding, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéï ") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "a " * 34, "a " * 35, "a " * 36, "ab " * 400, " ".join(passage[:35]), "\t".join(passage[:34])]
    for i in range(60):
        base = [word() for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            at, lo = rng.randint(0, len(base)), rng.randint(0, 20)
            base[at:at] = passage[lo:lo + rng.randint(30, 40)]
        texts.append(rng.choice([" ", "\n", " \x0b "]).join(base))
        if i % 7 == 0:
            texts += [texts[-1]] * 3 + [texts[-1] + " more", "  " + texts[-1]]
    texts.append(" ".join(word() for _ in range(30_000)) + " " + " ".join(passage))
    return texts


def test_query(spark, documents):
    texts = corpus()
    data = [(i if i != 5 else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = op7_substring_dedup(spark, documents(data)).collect()
    want = sorted(map(str, ((d[0], *x) for d, x in zip(data, plain(texts), strict=True))))
    assert sorted(str(tuple(r)) for r in out) == want
    assert any(0 < r.n_removed < r.n_words for r in out)


def test_full_sketch_loses_nothing(spark, documents, monkeypatch):
    """A sketch that answers 'maybe' to everything leaves the result as it is."""
    monkeypatch.setattr(substrings, "LEAST_CELLS", 2)
    texts = corpus(9)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(i, *x[:2]) for i, x in enumerate(plain(texts))]


def test_anchors_cover_equal_windows():
    texts = [(t or "").encode() for t in corpus(4)]
    for window in (5, 8, 35):
        w = Windows(texts, window)
        count = Counter(w.anchors.tolist())
        words = [WORD.findall((t or "")) for t in corpus(4)]
        flat = [(i, p) for i, ws in enumerate(words) for p in range(len(ws) - window + 1)]
        assert len(flat) == len(w.start)
        seen = Counter(tuple(words[i][p:p + window]) for i, p in flat)
        for (i, p), least in zip(flat, w.least.tolist(), strict=True):
            assert count[least] >= seen[tuple(words[i][p:p + window])]


def test_words_in_pieces(monkeypatch):
    data = (" ".join(t or "" for t in corpus(2)) + "x" * 5000 + "\n").encode()
    starts, ends, hashes = words_of(data)
    monkeypatch.setattr(substrings, "PIECE", 1000)
    again = words_of(data)
    assert all((a == b).all() for a, b in zip((starts, ends, hashes), again, strict=True))
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == data.split()
    by = {}
    for a, b, h in zip(starts, ends, hashes, strict=True):
        assert by.setdefault(data[a:b], h) == h
    assert len(set(by.values())) == len(by)


def test_sliding():
    x = np.random.default_rng(0).integers(0, 1000, 200)
    for width in (1, 2, 3, 7, 28):
        assert (sliding(x, width, np.minimum) == [x[i:i + width].min() for i in range(len(x) - width + 1)]).all()
    assert cells(x.astype(np.uint64), 1, 20).max() < 1 << 20


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, N_words string")
    out = remove_repeats(empty)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text"] and out.collect() == []
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "x a b c")], "doc_id long, text string")
    got = sorted((r.text, r.n_removed, r.kept_text) for r in remove_repeats(df, window=2).collect())
    assert got == [("a b c", 3, ""), ("a b c", 3, ""), ("x a b c", 3, "x")]
