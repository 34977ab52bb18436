import zlib

import pytest

from leafstack.llm.queries.sharding import op4_sharding
from leafstack.llm.sharding import assign_shards, write_shards


def check_plan(rows, shards):
    """rows: (size, shard, slot) — slots gapless, bytes within one row of the target."""
    total, target = sum(r[0] for r in rows), sum(r[0] for r in rows) / shards
    for k in range(shards):
        own = [r for r in rows if r[1] == k]
        assert sorted(r[2] for r in own) == list(range(len(own)))
        assert abs(sum(r[0] for r in own) - target) <= max(r[0] for r in rows)
    assert {r[1] for r in rows} <= set(range(shards)) and total == sum(r[0] for r in rows)


def test_query(spark, documents):
    texts = [None, "", "é" * 50, "a" * 5000] + ["same text"] * 200 + [f"text {i} " * (i % 17) for i in range(800)]
    rows = [(i if i % 50 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(7, "x", "en", "s", 0)] * 40
    out = op4_sharding(spark, documents(rows)).collect()
    assert len(out) == len(rows)
    check_plan([(r.size, r.shard, r.slot) for r in out], 16)
    want = sorted(((i or -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted(((r.doc_id or -1), r.size, r.text_crc32) for r in out) == want
    ids = {k: [r.doc_id for r in out if r.shard == k and r.doc_id is not None] for k in range(16)}
    for k in range(15):  # contiguous in doc_id
        if ids[k] and ids[k + 1]:
            assert max(ids[k]) <= min(ids[k + 1])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, 0), (2, 0), (3, -4)], [(None, 5)] * 9])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, size long")
    out = assign_shards(df, 4).collect()
    assert len(out) == len(rows)
    for k in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_extra_columns(spark):
    df = spark.range(50).selectExpr("id doc_id", "id size", "'x' shard", "'y' SLOT", "1 __at", "2 other")
    out = assign_shards(df, 3)
    assert out.columns == ["doc_id", "size", "other", "shard", "slot"]
    check_plan([(r.size, r.shard, r.slot) for r in out.collect()], 3)


def test_written_shards(spark, tmp_path):
    df = spark.range(300).selectExpr("id doc_id", "repeat('ab ', int(id % 40)) text", "id * 2 other")
    write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    sizes = [r.b for r in back.groupBy("shard").agg({"text": "count"}).selectExpr("`count(text)` b").collect()]
    assert sum(sizes) == 300


def test_plan_is_that_of_plain_prefix_sums(spark):
    sizes = [(i * i * 7919) % 1000 + (20_000 if i % 211 == 0 else 0) for i in range(1500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, size long").repartition(7)
    total, before, want, slots = sum(sizes), 0, [], [0] * 16
    for i, s in enumerate(sizes):
        k = min((2 * before + s) * 16 // (2 * total), 15)  # where the row's middle lies
        want.append((i, k, slots[k]))
        slots[k] += 1
        before += s
    assert sorted((r.doc_id, r.shard, r.slot) for r in assign_shards(df).collect()) == want
