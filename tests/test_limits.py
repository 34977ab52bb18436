"""Inputs beyond limits that earlier versions had."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leafstack import scale
from leafstack.functions import datauri
from leafstack.functions.scalars import postit_text
from leafstack.operators.search import date_ranges, match_date_ranges, range_nodes
from leafstack.operators.transfer import export_payloads
from leafstack.runtime import ship
from leafstack.scale import claim_slots
from leafstack.sources import catalogue as cat
from leafstack.sources.archives import list_members, maff_pages
from leafstack.sources.files import directory_listing


def test_long_names(spark):
    name = "x" * 10_050
    files = spark.createDataFrame([(f"a/{name}", "file", 1)], "path string, type string, size long").withColumn("mtime", F.lit(None).cast("timestamp"))
    assert [r.name for r in directory_listing(files, "a").collect()] == [name]
    members = files.select(F.lit("z").alias("archive"), F.col("path").alias("member"), "type", "size", "mtime")
    assert [r.name for r in list_members(members, "a").collect()] == [name]


def test_data_uri_parameters(spark):
    many = ";".join(f"p{i}={i}" for i in range(1500))
    df = spark.createDataFrame([("data:text/plain;charset=a;CHARSET=b;x=1,ok",), (f"data:a/b;{many};P7=last,z",)], "u string")
    rows = df.select(datauri.columns("u")["params"].alias("p")).collect()
    assert rows[0].p == {"charset": "b", "x": "1"}
    assert len(rows[1].p) == 1500 and rows[1].p["p7"] == "last" and rows[1].p["p1499"] == "1499"
    for uri, row in zip([r.u for r in df.collect()], rows, strict=True):
        assert datauri.parse(uri)[2] == row.p


@pytest.mark.parametrize("page,want", [
    ("<html><pre>\n" + "<" * 20_000 + "\n</pre></html>", "<" * 20_000),
    ("<pre>a\nb\n</pre>", "a\nb"), ("<pre>\n</pre>", ""), ("<pre>\n\n</pre>", ""), ("no frame &lt;", "no frame <"),
    ("<pre>x</pre><pre>\ny &amp; z\n</pre>", "y & z"), ("<pre>open\n", "<pre>open\n"), ("</pre>\n", "</pre>\n"),
])
def test_postit_without_recursion(spark, page, want):
    assert spark.createDataFrame([(page,)], "t string").select(postit_text("t").alias("x")).first().x == want


def test_short_and_odd_dates_match(spark):
    dates = ["2024", "20240105", "20240105000000000", "2023123", "2024a", "2024 ", "x", "", None, "20250101", "99999999999999999", "202401"]
    items = spark.createDataFrame(list(enumerate(dates)), "k int, create string")
    ranges = date_ranges(spark.createDataFrame([(1, "2024", "2024"), (2, "", ""), (3, "20240104", ""), (4, "", "2023")], "r int, since string, until string"))
    bounds = {r.r: (r.lo, r.hi) for r in ranges.collect()}
    got = sorted((r.r, r.k) for r in match_date_ranges(items, ranges).collect())
    assert got == sorted((r, k) for r, (lo, hi) in bounds.items() for k, d in enumerate(dates) if d and lo <= d <= hi)


def test_a_range_is_few_nodes(spark):
    rng = random.Random(2)
    pairs = [(0, 0), (0, 129_999), (15, 16), (5, 4), (0, 65_535), (1, 65_536)] + [tuple(sorted((rng.randrange(130_000), rng.randrange(130_000)))) for _ in range(60)]
    for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", range_nodes(F.col("a"), F.col("b")).alias("n")).collect():
        spans = sorted((x.key * 16**x.level, (x.key + 1) * 16**x.level) for x in r.n)
        assert len(r.n) <= 2 * 15 * 5
        # side by side, and nothing twice
        assert [s for s, _ in spans[1:]] == [e for _, e in spans[:-1]] and (not spans or (spans[0][0], spans[-1][1]) == (r.a, r.b + 1)) and bool(spans) == (r.a <= r.b)


def test_ties_take_slots_in_order(spark):
    rows = spark.createDataFrame([("b", i, 1000) for i in range(300)], "book_id string, ord int, base long")
    taken = spark.createDataFrame([("b", 1000 + 2 * i) for i in range(50)], "book_id string, slot long")
    got = [r.slot for r in claim_slots(rows, taken, "base", ["ord"]).orderBy("ord").collect()]
    free = [s for s in range(1000, 2000) if s not in {1000 + 2 * i for i in range(50)}]
    assert got == free[:300]


def first_come(rows, taken):
    """Slots of (ord, base) rows, one after the other."""
    used, out, up = set(taken), {}, {}

    def free(s):
        trail = []
        while s in up or s in used:
            trail.append(s)
            s = up.get(s, s + 1)
        for x in trail:
            up[x] = s
        return s

    for k, base in sorted(rows):
        out[k] = free(base)
        used.add(out[k])
    return out


@pytest.mark.parametrize("leaf", [1, 40])
def test_mixed_slots_by_halving(spark, monkeypatch, leaf):
    monkeypatch.setattr(scale, "LEAF_ROWS", leaf)
    rng = random.Random(leaf)
    n = 150 if leaf == 40 else 10
    data = [(b, i, 1000 + rng.randrange(n // 3)) for b in "ab" for i in range(n)]
    rows = spark.createDataFrame(data, "book_id string, ord int, base long")
    taken = spark.createDataFrame([("a", 1000 + 5 * i) for i in range(30)], "book_id string, slot long")
    got = {(r.book_id, r.ord): r.slot for r in claim_slots(rows, taken, "base", ["ord"]).collect()}
    for b, used in (("a", {1000 + 5 * i for i in range(30)}), ("b", set())):
        want = first_come([(o, s) for x, o, s in data if x == b], used)
        assert {o: s for (x, o), s in got.items() if x == b} == want


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    real = scale._holes
    monkeypatch.setattr(scale, "_holes", lambda *a: rounds.append(1) or real(*a))
    rows = spark.range(100_000).select(F.lit("b").alias("book_id"), F.col("id").alias("ord"), (F.pmod(F.xxhash64("id"), F.lit(40)) * 7).alias("base"))
    taken = spark.createDataFrame([], "book_id string, slot long")
    got = {r.ord: r.slot for r in claim_slots(rows, taken, "base", ["ord"]).collect()}
    assert got == first_come([(r.ord, r.base) for r in rows.collect()], set())
    assert len(rounds) == 3 and [scale.halvings(x) for x in (1 << 14, 1 << 15, 10**9)] == [0, 1, 16]


def test_entry_lines_keep_unknown_properties(spark):
    items = spark.createDataFrame([("b", "i", 1, "t", None, {"foo": 'b"ar'}), ("b", "j", 2, None, False, {"a": "1"}), ("b", "k", 3, None, False, None), ("b", "l", 4, "x}", True, None)],
                                  "book_id string, item_id string, ord long, title string, marked boolean, extra map<string,string>")
    lines = [r.line for r in cat.entry_lines(items).orderBy("ord").collect()]
    assert lines == ['"i": {"title":"t","foo":"b\\"ar"}', '"j": {"a":"1"}', '"k": {}', '"l": {"title":"x}","marked":true}']


def test_page_text_stays_on_its_side(spark):
    """With a limit no page text goes through an exchange before the hits are known."""
    from leafstack.operators.search import Rule, SearchSpec, Term, search
    from leafstack.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    spec = SearchSpec(rules={None: Rule([Term("the")], [Term("zz")])}, sorts=(("title", False),), limit=5)
    out = search(fx.items(spark, sf), fx.edges(spark, sf), fx.fulltext(spark, sf), spec)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line or "Join Inner" in line]
    assert joins and out.count() == 5
    top = plan[plan.index("GlobalLimit"):]
    assert not any("content#" in line and ("Join" in line or "Sort" in line) for line in top.splitlines())


def windows(node):
    """Columns that the windows of a plan hold."""
    own = [node.output().mkString(" ")] if node.nodeName() == "Window" else []
    return own + [w for k in range(node.children().size()) for w in windows(node.children().apply(k))]


def test_shards_in_a_row(spark):
    """Shards after a gap are left out, one file of each number is read, and no window holds the texts of a book."""
    names = ["a/tree/meta.js", "a/tree/meta1.js", "a/tree/meta2.js", "a/tree/meta4.js", "b/tree/meta1.js", "x/c/tree/meta.js", "y/c/tree/meta.js", "a/tree/toc.js"]
    found = cat.shard_rows(spark.createDataFrame([(f"/{n}", f"text of {n}") for n in names], "file string, value string"), "meta")
    assert found.columns == ["book_id", "shard", "text", "file"]
    rows = found.collect()
    assert sorted((r.book_id, r.shard) for r in rows) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    assert all(r.text == f"text of {r.file[1:]}" for r in rows)
    held = windows(found._jdf.queryExecution().optimizedPlan())
    assert held and not any("text" in h or "value" in h for h in held)


def test_batches_of_python_workers_are_bounded(spark):
    own, asked = spark.newSession(), spark.newSession()
    asked.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "5m")
    for session, most in ((own, 2 << 20), (asked, 5 << 20)):
        ship(session)
        rows = session.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("t"))
        held = rows.mapInPandas(lambda batches: (b.t.str.len().agg(["sum"]).to_frame("n") for b in batches), "n long").collect()
        assert sum(r.n for r in held) == 12_000_000 and max(r.n for r in held) <= most


def test_payloads_keep_given_digests(spark):
    """Files and icons that bring a digest are not hashed again; others are."""
    key, one = "book_id string, item_id string", ("b", "i")
    manifest = spark.createDataFrame([(*one, 0, "20240101000000000")], f"{key}, n long, ets string")
    items = spark.createDataFrame([(*one, "i.html", "")], f"{key}, index string, icon string")
    files = spark.createDataFrame([("b", "i.html", bytearray(b"page")), ("b", "other.html", bytearray(b"no"))], "book_id string, path string, content binary")
    for given in (files, files.withColumn("digest", F.concat(F.lit("given "), "path"))):
        want = [r.digest for r in given.withColumn("digest", F.sha1("content") if given is files else F.col("digest")).filter("path = 'i.html'").collect()]
        entries, store = export_payloads(manifest, items, given, files.limit(0))
        assert [r.digest for r in entries.collect()] == want
        assert [(r.digest, bytes(r.content), r.size) for r in store.collect()] == [(want[0], b"page", 4)]


def test_maff_pages_need_one_worker(spark):
    def archive(*files):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zh:
            for name, text in files:
                zh.writestr(name, text)
        return buf.getvalue()

    def rdf(body):
        return ('<RDF:RDF xmlns:MAF="http://maf.mozdev.org/metadata/rdf#" xmlns:RDF="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
                f'<RDF:Description RDF:about="urn:root">{body}</RDF:Description></RDF:RDF>')

    named = rdf('<MAF:title RDF:resource="T"/><MAF:indexfilename RDF:resource="main.html"/>')
    broken = archive(("t/index.html", "some text"), ("u/index.html", "more")).replace(b"some text", b"same text", 1)
    rows = [("a", archive(("t/index.rdf", named), ("t/index.html", "x"), ("u/index.html", "y"), ("u/deep/index.html", "z"), ("v/index.rdf", "<no"), ("v/index.htm", "w"))),
            ("b", broken), ("c", b"not a zip"), ("d", None), ("e", archive(("t/index.rdf", rdf("")), ("index.html", "x")))]
    found = maff_pages(spark.createDataFrame(rows, "archive string, content binary"))
    assert sorted((r.archive, r.top, r.title, r.indexfilename) for r in found.collect()) == [
        ("a", "t", "T", "t/main.html"), ("a", "u", None, "u/index.html"), ("a", "v", None, "v/index.htm")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "EvalPython" not in plan
