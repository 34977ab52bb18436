import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.llm import ctw
from leafstack.llm.ctw import grams, long_grams, normal, with_scores
from leafstack.llm.queries.ctw import op11_ctw_scores


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


class Plain:
    """Context-tree weighting by its definition."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        self.seen = {}
        for text in texts:
            for context, so_far, bit in self.decisions(text):
                for d in range(depth + 1):
                    self.n[context[:d], so_far][bit] += 1
                    if d:
                        self.children[context[:d - 1], so_far].add(context[:d])

    def decisions(self, text):
        data = b"\n" * self.depth + b" ".join(words(text)) + b"\n"
        for i in range(self.depth, len(data)):
            context = data[i - self.depth:i][::-1]
            for k in range(8):
                yield context, 1 << k | data[i] >> 8 - k, data[i] >> 7 - k & 1

    def estimate(self, node):
        a, b = self.n.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, so_far):
        node = context, so_far
        if node not in self.seen:
            own = self.estimate(node)
            if len(context) == self.depth:
                self.seen[node] = own
            else:
                deeper = sum(self.weighted(c, so_far) for c in self.children.get(node, ()))
                self.seen[node] = math.log(0.5) + np.logaddexp(own, deeper)
        return self.seen[node]

    def chance(self, context, so_far, bit, d=0):
        node = context[:d], so_far
        n = self.n.get(node, (0, 0))
        kt = (n[bit] + 0.5) / (n[0] + n[1] + 1)
        if d == self.depth:
            return kt
        share = math.exp(math.log(0.5) + self.estimate(node) - self.weighted(*node))
        return share * kt + (1 - share) * self.chance(context, so_far, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.chance(*x)) for x in self.decisions(text))


def plain(rows, depth=4):
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    tokens = Counter(w for t in train for w in [*words(t), None])
    total, model, out = sum(tokens.values()), Plain(train, depth), []
    for d, t in rows:
        own = [*words(t), None]
        base = sum(math.log10((tokens[w] + 1) / (total + len(tokens) + 1)) for w in own)
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(own), sum(tokens[w] > 0 for w in own), total, base, model.score(t)))
    return out


def alike(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        np.testing.assert_allclose([r[k] for r in got], [r[k] for r in want], rtol=1e-7, atol=1e-6)


TEXTS = ["The cat sat on the mat.\nThe dog  sat", "the mat THE mat", "", None, "Ünïcode — wörds ünïcode", "a\x00b \x7f|c", "the cat sat on the mat", "zebra quagga", "\t \n"]


def test_query(spark, documents):
    rows = [(i, TEXTS[i % 9] if i % 4 else f"number {i} of the mats") for i in range(60)] + [(None, "the null cat"), (3, "the dog"), (3, "the dog")]
    got = op11_ctw_scores(spark, documents([(*r, "en", "s", 1) for r in rows], schema="doc_id long, text string, lang string, source string, n_chars int"))
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    alike([tuple(r)[:7] for r in got.collect()], plain(rows))


@pytest.mark.parametrize("depth", [2, 6])
def test_depths_and_long_texts(spark, depth):
    long = " ".join(f"w{i % 97} and w{i * i % 31}" for i in range(3000))
    rows = [(1, long), (2, "w1 and w2"), (9, "x" * 5000 + " y"), (11, "and and"), (12, "w5 w6 w7")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, SCORE string")
    got = with_scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, depth=depth)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    want = {r[0]: r for r in plain(rows, depth)}
    for r in got.collect():
        assert tuple(r)[1:4] == want[r.doc_id][2:5]
        assert math.isclose(r.score, want[r.doc_id][6], rel_tol=1e-7, abs_tol=1e-5) and math.isclose(r.base_score, want[r.doc_id][5], rel_tol=1e-9)


def test_pieces_change_nothing(monkeypatch):
    texts = [normal(x.encode()) for x in (" A  bc\n" * 400, "x" * 3000, "", "ab " * 9)]
    whole = [grams([t], 4) for t in texts]
    assert (grams(texts, 4) == np.concatenate(whole)).all()
    monkeypatch.setattr(ctw, "PIECE", 64)
    assert texts == [normal(x.encode()) for x in (" A  bc\n" * 400, "x" * 3000, "", "ab " * 9)]
    for t, w in zip(texts, whole, strict=True):
        assert (np.concatenate(list(long_grams(t, 4))) == w).all()


def test_probabilities_add_up():
    rng = np.random.default_rng(4)
    context = rng.integers(0, 5, (40, 4)).astype(np.uint64) @ (np.uint64(256) ** np.arange(4, 0, -1).astype(np.uint64))
    gram = np.unique((np.unique(context)[:, None] | np.arange(256, dtype=np.uint64)).ravel())
    n = rng.integers(0, 9, len(gram)) * (rng.random(len(gram)) < 0.05)
    levels, _, _ = ctw.climb(gram, n.astype(float), 4, 2)
    two = levels[-1][0]
    key = two.key >> np.uint64(16) << np.uint64(8) | two.key & np.uint64(255)
    k, at = np.unique(key, return_inverse=True)
    sums = [np.bincount(at, weights=x) for x in (two.zeros, two.ones, two.weighted)]
    above, left = ctw.shallow(list(zip(k.tolist(), *(s.tolist() for s in sums), strict=True)))
    chance = 10.0 ** (ctw.code_values(gram, n.astype(float), 4, 2, above, left) / ctw.UNIT)
    np.testing.assert_allclose(chance.reshape(-1, 256).sum(axis=1), 1, atol=1e-6)


def test_held_out_accuracy(spark):
    # words of two to seven of seven parts: about 1.3 bits a byte, and 4.2 decimals for a word not seen in training
    rng = np.random.default_rng(5)
    parts = ["ka", "lo", "mi", "ru", "ten", "so", "via"]
    rows = [(i, " ".join("".join(rng.choice(parts, rng.integers(2, 8))) for _ in range(80))) for i in range(120)]
    got = with_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 != 2).filter("doc_id % 7 = 2").collect()
    assert np.mean([r.bits_per_byte for r in got]) < 1.6
    [odd] = with_scores(spark.createDataFrame([*rows, (1003, "qzx wvw jjk")], "doc_id long, text string"), F.col("doc_id") < 1000).filter("doc_id = 1003").collect()
    assert odd.bits_per_byte > 6


def test_empty_and_no_training(spark, documents):
    assert op11_ctw_scores(spark, documents([])).collect() == []
    [row] = with_scores(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0) and math.isclose(row.score, 24 * math.log10(0.5), abs_tol=1e-8)
