"""Skew-safe blocks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from leafstack import scale
from leafstack.sources.catalogue import greedy_shards


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ranks_with_a_hot_key(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", i * 3, rng.randrange(50)) for i in range(900)]
    df = spark.createDataFrame(data, "k string, pos long, v int")
    want = []
    for key in {k for k, _, _ in data}:
        want += [(key, p, i) for i, p in enumerate(sorted(p for k, p, _ in data if k == key))]
    assert rows_of(scale.rank_by_number(df, ["k"], "pos", "r", chunk=16), "k", "pos", "r") == sorted(want)
    assert rows_of(scale.rank_rows(df, ["k"], ["pos"], "r"), "k", "pos", "r") == sorted(want)
    by_value = scale.rank_rows(df, ["k"], [F.col("v").desc(), F.col("pos")], "r")
    want = []
    for key in {k for k, _, _ in data}:
        mine = sorted(((v, p) for k, p, v in data if k == key), key=lambda x: (-x[0], x[1]))
        want += [(key, p, i) for i, (_, p) in enumerate(mine)]
    assert rows_of(by_value, "k", "pos", "r") == sorted(want)


def test_running_values(spark):
    rng = random.Random(2)
    data = [("a" if i % 5 else "b", i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, n long, v long")
    sums, tops, want_s, want_m = {}, {}, [], []
    for k, n, v in data:
        sums[k] = sums.get(k, 0) + v
        tops[k] = max(tops.get(k, 0), v)
        want_s.append((k, n, sums[k]))
        want_m.append((k, n, tops[k]))
    assert rows_of(scale.running_sum(df, ["k"], "n", "v", "o", chunk=16), "k", "n", "o") == sorted(want_s)
    assert rows_of(scale.running_max(df, ["k"], "n", "v", "o", chunk=16), "k", "n", "o") == sorted(want_m)


@pytest.mark.parametrize("leaf_rows", [200_000, 20])
def test_slots_are_first_come_first_served(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(scale, "LEAF_ROWS", leaf_rows)
    rng = random.Random(3)
    rows = [(f"b{rng.randrange(2)}", rng.randrange(60), i) for i in range(120)]
    taken = [(f"b{b}", t) for b in range(2) for t in range(0, 70, 3)]
    used, want = set(taken), []
    for book, base, n in rows:
        slot = base
        while (book, slot) in used:
            slot += 1
        used.add((book, slot))
        want.append((book, n, slot))
    out = scale.claim_slots(spark.createDataFrame(rows, "book_id string, base long, n long"),
                            spark.createDataFrame(taken, "book_id string, slot long"), "base", ["n"])
    assert rows_of(out, "book_id", "n", "slot") == sorted(want)


def test_greedy_shards(spark):
    rng = random.Random(4)
    data = [(b, f"k{i}", i, rng.choice([0, 1, 5, 40, 130])) for b in ("x", "y") for i in range(150)]
    want = []
    for book in ("x", "y"):
        fill, shard = 1, 0
        for b, k, _, size in data:
            if b == book:
                fill += size
                want.append((book, k, shard))
                if fill >= 100:
                    fill, shard = 0, shard + 1
    df = spark.createDataFrame(data, "book_id string, key string, ord long, size long")
    assert rows_of(greedy_shards(df, 100), "book_id", "key", "shard") == sorted(want)


def test_chunked_lists_are_whole(spark):
    df = spark.createDataFrame([("p", i, f"c{i}") for i in range(25)], "p string, pos long, c string")
    chunks = {r["chunk"]: r["values"] for r in scale.chunked_list(df, ["p"], "pos", "c", 10).collect()}
    assert [v for k in sorted(chunks) for v in chunks[k]] == [f"c{i}" for i in range(25)]
