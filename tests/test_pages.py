"""Golden values for page parsing, payloads, archives and the text index."""

import base64
import hashlib
from urllib.parse import quote
import io
import zipfile

from pyspark.sql import functions as F

from leafstack.functions import css, datauri, scalars
from leafstack.functions.charset import LABELS, codec_name, decode_bytes
from leafstack.functions.pagescan import PageScan, refresh_parts
from leafstack.functions.registry import register
from leafstack.functions.snippets import mark_text
from leafstack.operators import index as ix
from leafstack.operators import legacy as lg
from leafstack.operators import pages as pg
from leafstack.sources import archives as ar
from leafstack.sources import catalogue as cat
from leafstack.sources import files as fl


def text_of(html, path="index.html"):
    got = pg.scan_parts(html, path)
    return " ".join(" ".join(t for t, _ in got["segments"] if t is not None).split())


def test_excluded_elements():
    for tag in ("title", "style", "script", "template", "object", "audio", "canvas", "noscript", "textarea", "svg", "math"):
        assert text_of(f"<body>one<{tag}>hidden</{tag}>two<!-- c --></body>") == "one two", tag


def test_inline_content():
    assert text_of('a<a href="data:text/plain,in%20link">b</a>') == "a in link b"
    assert text_of('a<iframe srcdoc="&lt;p&gt;doc&lt;/p&gt;"></iframe>b') == "a doc b"
    got = pg.scan_parts('x<iframe src="f/y.html"></iframe><a href="z.html?q#h">z</a><a href="../up.html">u</a><a href="//h/x">v</a>', "sub/index.html")
    assert [f for _, f in got["segments"] if f] == ["sub/f/y.html"]
    assert got["links"] == ["sub/z.html", "up.html"]


def test_instant_redirect_replaces_text():
    got = pg.scan_parts('<meta http-equiv="refresh" content="0;url=data:text/plain,gone"><body>hidden</body>', "a.html")
    assert got["redirect"] and [t for t, _ in got["segments"]] == ["gone"]


def test_refresh_content():
    cases = {"0;url=a.html": (0, "a.html"), "5": (5, ""), " 3.5 , 'x y' z": (3, "x y"), '2;URL="a;b"': (2, "a;b"), "x": (None, None), "1 b.html": (1, "b.html")}
    assert {k: refresh_parts(k) for k in cases} == cases


def test_title_and_icon():
    s = PageScan.of('<html><head><svg><title>no</title></svg><title>a &amp; b</title><link rel="Shortcut ICON" href="i.ico"></head></html>')
    assert (s.title, s.icon) == ("a & b", "i.ico")


def test_css_urls():
    sheet = r'''@import url("a.css"); @import 'b\.css'; /* url(c) */ @font-face { src: url(f.woff) format("woff") } a { background: url( 'd\20 e.png' ), url(g.png); content: "url(h)" }'''
    assert css.css_urls(sheet) == [("import", "a.css"), ("import", "b.css"), ("font", "f.woff"), ("background", "d e.png"), ("background", "g.png")]


def test_data_uris(spark):
    uris = ["data:text/plain;charset=utf-8;base64,aGk=", "data:,a%20b", "data:;base64,AAAAA", "http://x", "data:image/png;base64,QUJD#x"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    c = datauri.columns("u")
    native = [None if r["p"] is None else (bytes(r["p"]), r["m"]) for r in df.select(c["payload"].alias("p"), c["mime"].alias("m")).collect()]
    local = [None if datauri.parse(u) is None else datauri.parse(u)[:2] for u in uris]
    assert native == local == [(b"hi", "text/plain"), (b"a b", ""), None, None, (b"ABC", "image/png")]


def test_charsets():
    table = LABELS
    assert table["latin1"] == "windows-1252" and table["iso88599"] == "windows-1254" and table["koi8"] == "KOI8-R" and table["tis-620"] == "windows-874"
    assert (codec_name("BIG5"), codec_name("x-none"), codec_name("x-user-defined")) == ("big5hkscs", "x-none", None)
    assert decode_bytes("é".encode("latin-1"), "iso-8859-1", html=False) == "é"
    assert decode_bytes(b"\xff\xfe" + "é".encode("utf-16-le")) == "é"
    assert decode_bytes('<meta charset="big5">中'.encode("big5")).endswith("中")


def test_marks():
    import re
    rx = [re.compile("b+", re.I), re.compile("abc"), re.compile("x*")]
    assert mark_text("abc<B", rx[:2]) == '<mark class="kw1">abc</mark>&lt;<mark class="kw0">B</mark>'
    assert mark_text("ab", [rx[2]]) == "ab"


def test_relative_urls(spark):
    df = spark.createDataFrame([("data/a b/i.html", "tree"), ("a", "a"), ("x/y", "x/y/z/w")], "p string, s string")
    got = [r[0] for r in df.select(scalars.relative_url("p", "s", path_is_dir=False)).collect()]
    assert got == ["../data/a%20b/i.html", ".", "../.."]


def test_legacy_ids(spark):
    ids = ["20200101000000000", "20200101000000001", "20200101000001500", "20200101000000002", "note", "20200101000000"]
    items = spark.createDataFrame([("b", x, i) for i, x in enumerate(ids)], "book_id string, item_id string, ord long")
    got = {r["item_id"]: r["legacy_id"] for r in lg.assign_legacy_ids(items, "20200101000000").collect()}
    assert got == {ids[0]: "20200101000000", ids[2]: "20200101000001", ids[1]: "20200101000002", ids[3]: "20200101000003",
                   "note": "20200101000004", ids[5]: "20200101000005"}


def test_frames_fold_once(spark):
    pages = [("i.html", 0, "one <iframe src='f.html'></iframe> three"), ("f.html", 1, "two <iframe src='i.html'></iframe>"), ("g.html", 2, "four <iframe src='f.html'></iframe>")]
    df = spark.createDataFrame([("b", "x", p, o, bytearray(t, "utf-8")) for p, o, t in pages], "book_id string, item_id string, path string, ord long, content binary")
    parts = ix.extract(df)
    got = {r["path"]: r["content"] for r in ix.inline_frames(parts).collect()}
    assert got == {"i.html": "one two three", "g.html": "four"}
    apart = {r["path"]: r["content"] for r in ix.inline_frames(parts, inclusive=False).collect()}
    assert apart == {"i.html": "one three", "f.html": "two", "g.html": "four"}


def test_embed_and_externalize(spark):
    pic = base64.b64encode(b"PNG").decode()
    files = [("a.html", b'<img src="p.png"><iframe src="b.html"></iframe><img src="no.png">'), ("b.html", b'<iframe src="a.html"></iframe>'), ("p.png", b"PNG")]
    df = spark.createDataFrame([("k", p, bytearray(c)) for p, c in files], "book_id string, path string, content binary")
    pages = df.filter("path like '%.html'").select("book_id", "path", F.decode("content", "UTF-8").alias("html"))
    out = {r["path"]: r["html"] for r in pg.embed(pages, df).collect()}
    inner = "%3Ciframe%20src%3D%22urn%3Ascrapbook%3Aconvert%3Acircular%3Aurl%3Aa.html%22%3E%3C/iframe%3E"
    assert out["a.html"] == (f'<img src="data:image/png;base64,{pic}"><iframe src="data:text/html,{inner}"></iframe>'
                             '<img src="urn:scrapbook:converter:error:url:no.png">')
    page = spark.createDataFrame([(1, f'<img src="data:image/png;base64,{pic}">')], "id int, html string")
    back, store, _ = pg.externalize(page, ["id"])
    name = hashlib.sha1(b"PNG").hexdigest() + ".png"
    assert back.first()["html"] == f'<img src="{name}">'
    assert [(r["name"], bytes(r["content"])) for r in store.collect()] == [(name, b"PNG")]


def test_references_are_rewritten_where_they_stand(spark):
    page = """<p title='p.png'>say "p.png" &amp; more</p>
<IMG
  SRCSET="p.png 2x, no.png 3x, p.png 4x" alt="p.png"><img src=p.png><img data-src='x' src = 'p.png' src="other"><a href=\"q.html?a=1&amp;b='2'\">"p.png"</a>"""
    files = spark.createDataFrame([("k", "p.png", bytearray(b"PNG"))], "book_id string, path string, content binary")
    pages = spark.createDataFrame([("k", "a.html", page), ("k", "b.html", None), ("k", "c.html", "no references")], "book_id string, path string, html string")
    out = {r["path"]: r["html"] for r in pg.embed(pages, files).collect()}
    pic, gone = "data:image/png;base64," + base64.b64encode(b"PNG").decode(), "urn:scrapbook:converter:error:url:no.png"
    assert out["a.html"] == f"""<p title='p.png'>say "p.png" &amp; more</p>
<IMG
  SRCSET="{pic} 2x, {gone} 3x, {pic} 4x" alt="p.png"><img src="{pic}"><img data-src='x' src = "{pic}" src="other"><a href="urn:scrapbook:converter:error:url:q.html?a=1&amp;b='2'">"p.png"</a>"""
    assert out["c.html"] == "no references"


def test_nested_frames_embed(spark):
    n = 7
    rows = [("k", f"p{i}.html", f'<iframe src="p{i + 1}.html"></iframe>' if i < n else "end") for i in range(n + 1)]
    pages = spark.createDataFrame(rows[:1], "book_id string, path string, html string")
    assert all(r[2] == pg.rewrite_references(r[2], {}) for r in rows)
    files = spark.createDataFrame([(b, p, bytearray(t.encode())) for b, p, t in rows[:4]], "book_id string, path string, content binary")
    assert "p4.html" in pg.embed(pages, files).first()["html"]


def test_shards_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("b", f"i{n}", n, f"t {n}", n % 2 == 0) for n in range(7)], "book_id string, item_id string, ord long, title string, marked boolean")
    out = str(tmp_path / "tree")
    cat.write_shards(cat.entry_lines(items), cat.meta_shards(items, 3).select("book_id", F.col("item_id").alias("key"), "shard"), "meta", out)
    shards = cat.read_written(spark, out, "meta")
    assert sorted(r["shard"] for r in shards.collect()) == [0, 1, 2]
    assert all(" " not in r["text"] for r in shards.collect())
    back = cat.load_items(cat.merge_shards(cat.parse_shards(shards)))
    assert sorted((r["item_id"], r["title"], r["marked"]) for r in back.collect()) == sorted((f"i{n}", f"t {n}", n % 2 == 0) for n in range(7))


def test_bad_catalogue_files(spark):
    rows = [("b", 0, '/* x */ s.meta({"a": {"title": "1"}, "b": null})'), ("b", 1, "no wrapper"), ("c", 0, "s.meta({bad)"), ("d", 0, "")]
    got = cat.parse_shards(spark.createDataFrame(rows, "book_id string, shard int, text string")).collect()
    assert sorted((r["book_id"], r["error"]) for r in got if r["error"]) == [("b", "malformed wrapping"), ("c", "malformed JSON")]
    assert sorted((r["key"], r["value"] is None) for r in got if not r["error"]) == [("a", False), ("b", True)]


def test_archive_listing(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zh:
        zh.writestr("x/y.txt", "1")
        zh.writestr("z/", "")
    rows = ar.members(spark.createDataFrame([("a", bytearray(buf.getvalue())), ("bad", bytearray(b"no"))], "archive string, content binary"))
    assert sorted((r["name"], r["type"]) for r in ar.list_members(rows).collect()) == [("x", "dir"), ("z", "dir")]
    assert [r["archive"] for r in rows.filter("error is not null").collect()] == ["bad"]
    assert {r["archive"] for r in ar.missing_folder(rows, "x").collect()} == {"bad"}


def test_directory_source(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name in ("p/index.html", "a.html", "a.files", "q.txt"):
        target = tmp_path / name
        (target / "x.html").parent.mkdir(exist_ok=True) if name.endswith(".files") else target.write_text("x")
    (tmp_path / "a.files" / "x.html").write_text("x")
    files = fl.list_files(spark, str(tmp_path)).withColumn("book_id", F.lit("b"))
    assert sorted(r["path"] for r in files.collect()) == ["a.files/x.html", "a.html", "p/index.html", "q.txt"]
    items, edges, _ = fl.ingest_directory(files, "20240101000000000")
    assert [(r["title"], r["type"], r["index"]) for r in items.orderBy("ord").collect()] == [("a.html", "", "a.html"), ("p", "", "p/index.html"), ("q.txt", "file", "q.txt")]
    assert edges.filter("parent_id = 'root'").count() == 3


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT page_text('<p>a<b>b</b>') t, highlight('xax', array('a')) h, safe_filename('a/b?.') f, ts_item_id(item_ts('20240102030405678')) i").first()
    assert tuple(row) == ("a b", 'x<mark class="kw0">a</mark>x', "a_b_", "20240102030405678")
    assert [r["url"] for r in spark.sql("SELECT * FROM page_refs('<img src=\"u.png\">')").collect()] == ["u.png"]
    assert [r["url"] for r in spark.sql("SELECT * FROM css_urls('a{background:url(v.png)}')").collect()] == ["v.png"]


def test_css_is_rewritten_where_it_stands():
    sheet = """/* url(a) */ @import 'b\\'c.css' x; @import url(d.css); @font-face { src: url( "f.woff" ) } p { background: URL(g\\(.png) } q::after { content: "url(h)" }"""
    assert css.rewrite_css(sheet, {}) == sheet
    assert [u for _, u in css.css_urls(sheet)] == ["b'c.css", "d.css", "f.woff", "g\\(.png"]
    assert css.rewrite_css(sheet, {0: 'x"y', 3: "a\\b\n"}) == sheet.replace("'b\\'c.css'", '"x\\"y"').replace("g\\(.png", '"a\\\\b\\a "')
    assert [css.unescape(x) for x in ("a\\62 c", "\\\\n", "x\\", "a\\\nb", "\\0", "\\110000 z", "\\a\\b")] == ["abc", "\\n", "x\\", "ab", "\ufffd", "\ufffdz", "\n\x0b"]


def test_style_sheets_embed(spark):
    page = """<base href="sub/"><link rel=stylesheet href="a.css"><style>@import "b.css"; i { background: url('p.png') }</style>
<p style='background: url(p.png); x: "&amp;"' title="url(p.png)">url(p.png)</p><template><style>u{background:url(p.png)}</style></template><link rel="stylesheet" href="no.css">"""
    files = [("sub/a.css", b"@import url(deep/c.css); b { background: url(p.png) }"), ("sub/b.css", b"@import 'a.css'; @import 'b.css';"), ("sub/deep/c.css", b'@import "../a.css"; u { background: url(../p.png) }'), ("sub/p.png", b"PNG"), ("p.png", b"WRONG")]
    files = spark.createDataFrame([("k", p, bytearray(c)) for p, c in files], "book_id string, path string, content binary")
    pages = spark.createDataFrame([("k", "x.html", page)], "book_id string, path string, html string")
    pic = '"data:image/png;base64,' + base64.b64encode(b"PNG").decode() + '"'
    data = lambda text: '"data:text/css,' + quote(text) + '"'
    c = f'@import "urn:scrapbook:convert:circular:url:../a.css"; u {{ background: url({pic}) }}'
    a = f"@import url({data(c)}); b {{ background: url({pic}) }}"
    # a sheet that imports itself refers to itself alone
    b = f'@import {data(a)}; @import "";'
    want = page.replace('href="a.css"', f"href={data(a)}").replace('"b.css"', data(b)).replace("url('p.png')", f"url({pic})").replace("""'background: url(p.png); x: "&amp;"'""", '"' + f'background: url({pic}); x: "&"'.replace("&", "&amp;").replace('"', "&quot;") + '"')
    want = want.replace('href="no.css"', 'href="urn:scrapbook:convert:error:url:no.css"')
    assert pg.embed(pages, files).first()["html"] == want


def test_data_uris_leave_styles(spark):
    page = '<style>b{background:url(data:image/png;base64,UE5H)}</style><i style="background:url(data:text/plain,x)">'
    back, store, _ = pg.externalize(spark.createDataFrame([(1, page)], "id int, html string"), ["id"])
    png, txt = (hashlib.sha1(x).hexdigest() for x in (b"PNG", b"x"))
    assert back.first()["html"] == f'<style>b{{background:url("{png}.png")}}</style><i style="background:url(&quot;{txt}.txt&quot;)">'
    assert store.count() == 2
