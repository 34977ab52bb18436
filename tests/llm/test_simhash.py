import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from leafstack.llm import common, simhash
from leafstack.llm.common import among, written
from leafstack.llm.components import components
from leafstack.llm.queries.simhash import op10_simhash_near_dedup
from leafstack.llm.simhash import fingerprint_of, near_duplicates, near_links, one_of_each, similar_documents, spanning, trie_links

SPACE = " \t\n\v\f\r"


def plain_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts, word = [], ""
    for c in lower + " ":
        if c in SPACE:
            parts += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(ids, fps, budget=3):
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[top(i)].append(ids[i])
    return [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(ids))]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijÉé") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " \n ", "one", "One two", "ONE TWO THREE", "one two three", "é x y z", "w " * 9000]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(150, 400))]
        texts += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 5)):
            near = base[:]
            near[rng.randrange(len(near))] = word()
            texts.append("  ".join(near))
    return texts


def test_fingerprints():
    for t in corpus():
        assert fingerprint_of(t) == plain_fingerprint(t)


def test_query(spark, documents):
    data = [(i if i != 12 else None, t, "en", "s", 0) for i, t in enumerate(corpus())]
    data += data[-3:]
    out = op10_simhash_near_dedup(spark, documents(data)).collect()
    fps = [plain_fingerprint(t) for _, t, *_ in data]
    want = sorted(map(str, zip([d[0] for d in data], [f"{f:016x}" for f in fps], classes([d[0] for d in data], fps), strict=True)))
    assert sorted(str(tuple(r)) for r in out) == want
    assert len({r.component_id for r in out}) < len(set(fps))


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_every_pair(seed):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = f.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)
    dense = np.uint64(0xABCD << 48) | rng.integers(0, 1 << 8, 300).astype(np.uint64)
    f = np.unique(np.concatenate([f, near, dense]))
    for exact in (0, 16):
        want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f))
                if (int(f[i]) ^ int(f[j])).bit_count() <= 3 and (not exact or f[i] >> np.uint64(48) == f[j] >> np.uint64(48))}
        got = [(int(a), int(b)) for i, j in trie_links(f, 3, exact, 3) for a, b in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
    root = spanning(f, trie_links(f, 3, 0, 3))
    assert (root[root] == root).all()
    same = np.full(3000, f[0])
    assert sum(len(i) for i, _ in trie_links(same, 3, 16)) == 3000 * 2999 // 2


@pytest.mark.parametrize("budget", [3, 7])
def test_dealt_links_connect_what_pairs_connect(spark, budget):
    rng = random.Random(budget)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):
        f = rng.choice(fps)
        for k in rng.sample(range(64), rng.randint(0, budget + 1)):
            f ^= 1 << k
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, s, None) for i, s in enumerate(signed)], "node long, fingerprint long, proof binary")
    roots = {r.node: r.root for r in components(near_links(df, budget)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == classes(list(range(len(fps))), fps, budget)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 500 + i) for i in range(40)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert all(got.get(n, n) == up[n] for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "A b  c d", 3), (None, "a b c d", 4), (9, None, 5), (8, "", 6), (7, "other words here", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Component_Id int")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.Component_Id for r in kept.collect()) in ([2, 6, 7], [3, 6, 7])


def test_similar_documents(spark):
    """Texts with a shingle similarity well over 0.8 link, those well under it do not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    texts, copies = [], []
    for k in range(60):
        base = [word() for _ in range(rng.randint(200, 800))]
        near, far = base[:], base[:]
        for i in rng.sample(range(len(base)), max(1, len(base) // 120)):
            near[i] = word()
        for i in rng.sample(range(len(base)), len(base) // 10):
            far[i] = word()
        texts += [" ".join(base), " ".join(near), " ".join(far)]
    found = {r.label: r.component_id for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "label long, text string")).collect()}
    assert len(found) == len(texts)
    assert sum(found[3 * k + 1] == 3 * k for k in range(60)) >= 57
    assert all(found[3 * k] == 3 * k and found[3 * k + 2] == 3 * k + 2 for k in range(60))


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fingerprint string, root int")
    out = near_duplicates(df)
    assert out.columns == ["doc_id", "root", "fingerprint", "component_id"] and out.collect() == []


def shingle_sets(texts, words=5):
    parts = [t.lower().split() for t in texts]
    return [{tuple(p[i:i + words]) for i in range(len(p) - words + 1)} for p in parts]


@pytest.mark.parametrize("kind", ["edits", "block"])
def test_similarity_is_counted(spark, kind):
    """Pairs of similarity 0.8 and more link, others do not, wherever the difference lies."""
    rng = random.Random(17)
    common = [f"w{k}" for k in range(3000)]
    word = lambda: common[int(3000 * rng.random() ** 3)]
    texts = []
    for _ in range(250):
        base = [word() for _ in range(rng.randint(100, 1500))]
        share = rng.uniform(0.74, 0.93)
        if kind == "block":
            copy = base + [word() for _ in range(round(len(base) * (1 / share - 1)))]
        else:
            copy = base[:]
            for i in rng.sample(range(len(base)), round(len(base) * (1 - share) / 10)):
                copy[i] = word() + "x"
        texts += [" ".join(base), " ".join(copy)]
    sets = shingle_sets(texts)
    found = {r.label: r.component_id for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "label long, text string")).collect()}
    want = [5 * len(sets[k] & sets[k + 1]) >= 4 * len(sets[k] | sets[k + 1]) for k in range(0, 500, 2)]
    got = [found[k] == found[k + 1] for k in range(0, 500, 2)]
    assert 100 < sum(want) < 240 and got == want


def test_similar_in_a_mixed_band(spark):
    """Links between members of a band of which neither is its smallest."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(400)]
    texts = [" ".join(base + [f"t{v}x{k}" for k in range(n)]) for v, n in enumerate((95, 0, 60, 100, 130, 20, 80, 110))]
    texts += [" ".join(f"o{rng.random()}" for _ in range(50))]
    sets = shingle_sets(texts)
    found = {r.label: r.component_id for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "label long, text string")).collect()}
    up = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
    assert [found[i] for i in range(len(texts))] == up and len(set(up)) > 2


def test_small_sets_are_compared_too(spark):
    """Sets of few shingles, at and under 0.8, beside texts that share one line with all."""
    rng = random.Random(5)
    line = " ".join(f"c{k}" for k in range(12))
    texts = []
    for k in range(120):
        n = rng.randint(9, 24)
        base = [f"u{k}x{j}" for j in range(n)]
        texts += [" ".join(base), " ".join(base + [f"v{k}x{j}" for j in range(rng.randint(1, 6))]), line + " " + " ".join(f"o{k}x{j}" for j in range(rng.randint(4, 20)))]
    sets = shingle_sets(texts)
    found = {r.label: r.component_id for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "label long, text string")).collect()}
    want = [5 * len(sets[k] & sets[k + 1]) >= 4 * len(sets[k] | sets[k + 1]) for k in range(0, 360, 3)]
    assert 20 < sum(want) < 110 and [found[k] == found[k + 1] for k in range(0, 360, 3)] == want
    alone = [k for k in range(2, 360, 3) if found[k] == k]
    near = [k for k in range(2, 360, 3) if not any(j != k and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in range(2, 360, 3))]
    assert set(near) <= set(alone)


def test_one_of_each_links_fingerprints(spark):
    """Texts of one fingerprint and unlike shingle sets are one class, as `near_duplicates` has it, and join classes of similar sets."""
    line = "the same seven words come once more " * 200
    tails = [" ".join(f"w{k}x{i}" for i in range(10)) for k in range(3)]
    texts = [line + tails[0], line + tails[1], "quite another text of some other words", line + tails[1] + " end"]
    sets = shingle_sets(texts)
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    df = spark.createDataFrame([*enumerate(texts), (9, None), (8, "")], "doc_id long, text string")
    classes = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert classes[1] == 0 and classes[2] == 2
    assert sorted(r.doc_id for r in one_of_each(df, budget=3).collect()) == sorted(set(classes.values())) == [0, 2, 8]
    assert 1 in {r.doc_id for r in one_of_each(df).collect()}


def test_pipeline_stage_links_fingerprints(spark):
    import corpus_pipeline
    line = "the same seven words come once more " * 200
    df = spark.createDataFrame([(k, line + " ".join(f"w{k}x{i}" for i in range(10)), "en", "s", 1) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()] == [0]


@pytest.mark.parametrize("most", [200_000, 5])
def test_among_odd_numbers(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    asked = [0, -1, -513, 63, 64, 511, 512, 2**33, 2**33 + 5, 2**62, -2**63, 2**63 - 1, 7, 7]
    rows = sorted({*asked, *range(-600, 600), 2**33 + 1, 2**63 - 2})
    found = among(spark.createDataFrame([(n, "x") for n in rows], "n long, t string"), "n", spark.createDataFrame([(n,) for n in [*asked, None]], "a long"))
    assert found.columns == ["n", "t"] and sorted(r.n for r in found.collect()) == sorted(set(asked))


def test_signatures_stay_where_they_are(spark, monkeypatch):
    """More sets than a broadcast may have rows: their numbers are broadcast as bits, and no wide row is shuffled."""
    rng, plans = random.Random(11), {}
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)

    def traced(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, *more)

    monkeypatch.setattr(simhash, "written", traced)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(80)) for _ in range(200)]
    texts += [f"{t} end" for t in texts]
    found = {r.label: r.component_id for r in similar_documents(session.createDataFrame(list(enumerate(texts)), "label long, text string")).collect()}
    assert found == {i: i % 200 for i in range(400)}
    for name in ("tags", "cells", "spread"):
        assert "hashpartitioning" not in plans[name], name
