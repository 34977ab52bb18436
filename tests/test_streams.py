"""Index batches, compaction and refresh actions, called batch by batch."""

import datetime as dt
from pathlib import Path

from leafstack.plans import page_queries
from leafstack.streaming import streams as st

SCHEMA = "book_id string, item_id string, path string, mtime timestamp, content binary"


def rows(spark, *lines):
    return spark.createDataFrame([("b", i, p, dt.datetime(2024, 1, d), None if c is None else bytearray(c, "utf-8")) for i, p, d, c in lines], SCHEMA)


def index(spark, target):
    return sorted((r.item_id, r.path, r.content) for r in st.read_index(spark, target).collect())


def folders(target):
    return sorted(p.name for d in ("batches", "snapshots") for p in Path(target, d).glob("*=*"))


def test_purge_replay_and_compaction(spark, tmp_path):
    target = str(tmp_path / "index")
    assert index(spark, target) == [] and st.compact(spark, target) is None
    put = st.index_batch(spark, target)
    first = rows(spark, ("x", "a.html", 1, "<p>one"), ("x", "b.html", 1, "<p>two"), ("y", "a.html", 1, "<p>three"), ("x", "a.html", 1, "<p>one"), ("z", "a.html", 3, "<p>z"))
    put(first, 0)
    second = rows(spark, ("x", "a.html", 2, "<p>one new"), ("x", "b.html", 2, None), ("y", "", 2, None), ("z", "a.html", 2, "<p>older"))
    put(second, 1)
    want = [("x", "a.html", "one new"), ("z", "a.html", "z")]
    assert index(spark, target) == want
    put(second, 1)  # a replay overwrites its own folder
    assert index(spark, target) == want
    assert folders(target) == ["batch=0", "batch=1"]
    assert st.compact(spark, target) == 1 and st.compact(spark, target) == 1
    assert folders(target) == ["upto=1"] and index(spark, target) == want
    put(first, 0)  # replayed after it was merged: known by its number
    assert index(spark, target) == want
    # late rows of what is gone stay away, newer ones come back
    put(rows(spark, ("y", "a.html", 1, "<p>late"), ("x", "b.html", 1, "<p>late"), ("y", "c.html", 5, "<p>again")), 2)
    assert index(spark, target) == sorted([*want, ("y", "c.html", "again")])
    Path(target, "snapshots", "upto=9").mkdir()  # a snapshot that was never finished
    assert st.compact(spark, target) == 2
    assert index(spark, target) == sorted([*want, ("y", "c.html", "again")])
    assert not Path(target, "snapshots", "upto=1").exists() and not Path(target, "batches", "batch=2").exists()


def test_actions_of_the_last_batch(spark, tmp_path):
    target = str(tmp_path / "actions")
    for batch, lines in ((0, [("x", "a", "extract"), ("x", "b", "extract"), ("y", "a", "skip")]), (1, [("x", "a", "purge_path")])):
        spark.createDataFrame([("b", i, p, a, "") for i, p, a in lines], "book_id string, item_id string, path string, action string, reason string").write.parquet(f"{target}/batch={batch}")
    assert sorted((r.item_id, r.path, r.action) for r in st.read_actions(spark, target).collect()) == [("x", "a", "purge_path"), ("y", "a", "skip")]


def test_tables_arrive_from_files_and_folders(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "folder" / "numbers.parquet"))
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "numbers.parquet")
    for kind in ("folder", "file"):
        rows = page_queries._run_stream(page_queries.arriving(spark, str(tmp_path / kind), "numbers"), str(tmp_path / "run" / kind))
        assert sorted(r.id for r in rows.collect()) == list(range(40))


def test_no_actions_yet(spark, tmp_path):
    got = st.read_actions(spark, str(tmp_path / "none"))
    assert got.collect() == [] and got.columns == ["book_id", "item_id", "path", "action", "reason", "batch"]
