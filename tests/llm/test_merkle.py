import hashlib
import zlib
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.llm import merkle, queries
from leafstack.llm.merkle import Forest, absorb, finish, from_hex, leaf_hash, manifest, started, to_hex
from leafstack.llm.queries.merkle import op12_merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    trees, lines = {}, {}
    for d, text, lang, source, n in rows:
        bad = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        lines.setdefault(source, []).append(((d is not None, d or 0), leaf_of(d, source, lang, n, text), leaf_of(d, source, lang, n, bad), d))
    for s in lines:
        lines[s].sort(key=lambda x: x[:2])
        trees[s] = levels([x[1] for x in lines[s]])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    root = top[-1][0] if order else None
    out = []
    for k, s in enumerate(order):
        for i, (_, leaf, bad, d) in enumerate(lines[s]):
            value, proof = bad, []
            for at, tree in ((i, trees[s]), (k, top)):
                for level in tree[:-1]:
                    lo = at // 3 * 3
                    run = level[lo:lo + 3]
                    proof += run[:at - lo] + run[at - lo + 1:]
                    run[at - lo] = value
                    value, at = h(*run), at // 3
            out.append((d, leaf, trees[s][-1][0], root, h(*proof), value, value == root))
    return sorted(map(str, out))


def test_states_are_sha256():
    rng = np.random.default_rng(1)
    digests = [[hashlib.sha256(rng.bytes(9)).hexdigest() for _ in range(50)] for _ in range(3)]
    state = started(50)
    for k in range(4):
        assert to_hex(finish(state, np.full(50, k))) == [h(*(digests[j][i] for j in range(k))) for i in range(50)]
        if k < 3:
            state = absorb(state, from_hex(digests[k]))


def test_parents_retain_the_state_before_each_slot():
    leaves = [leaf_of(k) for k in range(8)]
    forest = Forest(from_hex(leaves), np.zeros(8, np.int64), np.arange(8), np.array([2]))
    level = forest.levels[0][0]
    assert (level.states[0] == merkle.START).all()
    assert to_hex(finish(level.states[2][:, 1:2], np.array([2]))) == [h(*leaves[3:5])]
    assert to_hex(forest.roots) == [levels(leaves)[-1][0]]


@pytest.mark.parametrize("levels", [8, 2])
def test_query(spark, documents, monkeypatch, levels):
    # two levels give several tiers of blocks, and many blocks in a batch
    monkeypatch.setattr(queries.merkle, "manifest", partial(manifest, levels=levels))
    rows = [(i, f"line {i}\nünd {i % 7}\n" * (i % 4), "en", f"s{i * i % 11 % 5}", i) for i in range(130)]
    rows += [(500, "only\none", None, "z", 1), (None, "x\n", "de", None, None), (7, None, "en", "s0", 3), (7, "line\n", "en", "s0", 3), (7, "line\n", "en", "s0", 3), (8, "", "en", "", 0), (9, "a\n" * 200_000, "en", "ß", 9), (10, "a|b:c", "-", "S", -1)]
    folder = documents(rows)
    assert sorted(str(tuple(r)) for r in op12_merkle_manifest(spark, folder).collect()) == plain(rows)


def test_changed_leaves_only_fail(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).alias("ROOT"), F.lit("x").alias("extra"), leaf_hash(F.col("id")).alias("leaf"))
    rows = rows.withColumn("changed", F.when(F.col("doc_id") == 77, leaf_hash(F.lit(None))).otherwise(F.col("leaf")))
    got = manifest(rows)
    assert got.columns == ["doc_id", "source", "extra", "leaf", "changed", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert [r.doc_id for r in got.filter("not verified").collect()] == [77]
    # one group: its subroot is the root
    assert got.filter("subroot <> root").isEmpty()


def test_empty(spark, documents):
    assert op12_merkle_manifest(spark, documents([])).collect() == []
    assert plain([]) == []
    [row] = op12_merkle_manifest(spark, documents([(3, "a\nb", "en", "s", 3)])).collect()
    assert [str(tuple(row))] == plain([(3, "a\nb", "en", "s", 3)])
    assert row.proof_sha256 == hashlib.sha256(b"").hexdigest() and row.subroot == row.leaf == row.root
