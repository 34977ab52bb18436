"""Closures and edits against a plain walk over small graphs."""

import random
import sys

import pytest

from leafstack.operators import edits as ed
from leafstack.operators import graph as gr
from leafstack.operators import tree as tr

sys.setrecursionlimit(10000)
EDGE = "book_id string, parent_id string, pos long, child_id string"
ITEM = "book_id string, item_id string, ord long, index string, create string, modify string"


def edges_of(spark, toc):
    return spark.createDataFrame([("b", p, i, c) for p, cs in toc.items() for i, c in enumerate(cs)], EDGE)


def items_of(spark, ids):
    return spark.createDataFrame([("b", x, i, f"{x}/index.html", "20200101000000000", "20200101000000000") for i, x in enumerate(ids)], ITEM)


def toc_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["parent_id"], []).append((r["pos"], r["child_id"]))
    for p, rows in out.items():
        assert [n for n, _ in sorted(rows)] == list(range(len(rows))), p
    return {p: [c for _, c in sorted(rows)] for p, rows in out.items()}


def visit(toc, roots):
    seen = {}

    def go(x):
        if x not in seen:
            seen[x] = True
            for c in toc.get(x, ()):
                go(c)
    for r in roots:
        go(r)
    return list(seen)


def random_toc(seed, cyclic):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    toc = {"root": rng.sample(nodes, 3)}
    for i, n in enumerate(nodes):
        pool = nodes if cyclic else nodes[i + 1:]
        kids = [rng.choice(pool) for _ in range(rng.randrange(4))] if pool else []
        if kids:
            toc[n] = kids
    return toc


@pytest.mark.parametrize("seed", range(4))
def test_reachable(spark, seed):
    toc = random_toc(seed, cyclic=seed % 2 == 0)
    edges = edges_of(spark, toc)
    assert {r["item_id"] for r in gr.reachable(edges, "root").collect()} == set(visit(toc, ["root"]))
    ordered = [r["item_id"] for r in gr.reachable(edges, "root", with_order=True).orderBy("addr").collect()]
    assert ordered == visit(toc, ["root"])


def test_preorder_cuts_cycles(spark):
    toc = {"root": ["a", "b"], "a": ["b"], "b": ["a", "c"]}
    got = [(r["item_id"], r["path"], r["cyc"]) for r in gr.preorder(edges_of(spark, toc), "root").orderBy("addr").collect()]
    assert got == [("a", ["root"], False), ("b", ["root", "a"], False), ("a", ["root", "a", "b"], True), ("c", ["root", "a", "b"], False),
                   ("b", ["root"], False), ("a", ["root", "b"], False), ("b", ["root", "b", "a"], True), ("c", ["root", "b"], False)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], EDGE)
    assert gr.reachable(none).count() == 0
    assert gr.preorder(none).count() == 0


def test_redirects(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")], "src string, dst string")
    got = {r["src"]: (r["final"], r["circular"]) for r in gr.redirect_targets(e).collect()}
    assert got == {"a": ("d", False), "b": ("d", False), "c": ("d", False), "x": (None, True), "y": (None, True), "z": (None, True), "s": (None, True)}


def test_copy_links_second_occurrence(spark):
    toc = {"root": ["a", "t"], "a": ["b", "c"], "b": ["a"], "c": ["b"]}
    items = items_of(spark, ["a", "b", "c", "t"])
    picks = spark.createDataFrame([("b", 0, "root", 0)], "book_id string, seq long, parent_id string, pos long")
    new_items, new_edges, ids = ed.copy_items(items, edges_of(spark, toc), picks, "t", "20240101000000000")
    m = {r["from_id"]: r["item_id"] for r in ids.collect()}
    assert m == {"a": "20240101000000000", "b": "20240101000000001", "c": "20240101000000002"}
    got = toc_of(new_edges)
    assert got["t"] == [m["a"]] and got[m["a"]] == [m["b"], m["c"]] and got[m["b"]] == [m["a"]] and got[m["c"]] == [m["b"]]
    assert {k: got[k] for k in toc} == toc
    assert {r["index"] for r in new_items.filter("item_id like '2024%'").collect()} == {f"{v}/index.html" for v in m.values()}


def test_add_then_delete_is_identity(spark):
    toc = {"root": ["a"], "a": ["b"]}
    items, edges = items_of(spark, ["a", "b"]), edges_of(spark, toc)
    new = spark.createDataFrame([("b", "n1", 0), ("b", "n2", 1)], "book_id string, item_id string, seq long")
    items2, edges2, _ = ed.add_items(items, edges, new, "a", 0, now="20240101000000000")
    assert toc_of(edges2)["a"] == ["n1", "n2", "b"]
    picks = spark.createDataFrame([("b", 0, "a", 0), ("b", 1, "a", 1)], "book_id string, seq long, parent_id string, pos long")
    items3, edges3, gone = ed.delete_items(items2, edges2, picks)
    assert toc_of(edges3) == toc and {r["item_id"] for r in items3.collect()} == {"a", "b"}
    assert {(r["item_id"], r["entry"]) for r in gone.collect()} == {("n1", None), ("n2", None)}


def test_rejected_batches(spark):
    items, edges = items_of(spark, ["a"]), edges_of(spark, {"root": ["a"]})
    dup = spark.createDataFrame([("b", "a", 0)], "book_id string, item_id string, seq long")
    with pytest.raises(ed.EditError):
        ed.add_items(items, edges, dup)
    bad = spark.createDataFrame([("b", 0, "root", 7)], "book_id string, seq long, parent_id string, pos long")
    with pytest.raises(ed.EditError):
        ed.move_items(items, edges, bad, "root")
    with pytest.raises(ed.EditError):
        ed.apply_batch(ed.Catalogue(items, edges), [("no_such", dup, {})])


def test_recycle_and_restore(spark):
    toc = {"root": ["a", "b"], "a": ["c"], "b": ["c"]}
    items, edges = items_of(spark, ["a", "b", "c"]), edges_of(spark, toc)
    picks = spark.createDataFrame([("b", 0, "root", 0), ("b", 1, "b", 0)], "book_id string, seq long, parent_id string, pos long")
    items2, edges2, _ = ed.recycle_items(items, edges, picks, "20240101000000000")
    # c stays below a, but a left the tree, so both are gone and both go to the bin
    assert toc_of(edges2) == {"root": ["b"], "a": ["c"], "recycle": ["a", "c"]}
    back = spark.createDataFrame([("b", 0, "recycle", 0), ("b", 1, "recycle", 1)], "book_id string, seq long, parent_id string, pos long")
    items3, edges3, _ = ed.unrecycle_items(items2, edges2, back)
    assert toc_of(edges3) == {"root": ["b", "a"], "a": ["c"], "b": ["c"]}
    assert items3.filter("parent is not null or recycled is not null").count() == 0


def test_unique_names_with_clashes(spark):
    names = ["a", "a", "a(1)", "a", "b", "a(1)", "a(2)", "b"]
    want, used = [], set()
    for i, n in enumerate(names):
        k, out = 0, n
        while out in used:
            k += 1
            out = f"{n}({k})"
        used.add(out)
        want.append((i, out))
    df = spark.createDataFrame([("s", n, i) for i, n in enumerate(names)], "s string, name string, n long")
    assert sorted((r["n"], r["out"]) for r in tr.unique_names(df, ["s"], "name", "n", "out").collect()) == want
