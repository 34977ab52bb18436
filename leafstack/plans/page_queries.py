"""Page-corpus jobs, text index, catalogue files, archives and streams."""

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import datauri
from ..operators import check as ck
from ..operators import index as ix
from ..operators import legacy as lg
from ..operators import pages as pg
from ..operators.ingest import ingest_pages
from ..operators.search import Rule, SearchSpec, Term
from ..runtime import ensure_checkpoint_dir
from ..sources import archives as ar
from ..sources import catalogue as cat
from ..sources import files as fl
from ..sources import rdf
from ..streaming import streams as st
from . import fixtures as fx
from .fixtures import ctes, stored, table
from .registry import query



def number():
    return F.col("page_id")


def pages(spark, sf):
    return table(spark, sf, "pages")


def body(html):
    """The whole page, free of markup characters."""
    return F.regexp_replace(html, r"[^A-Za-z ]+", "")


TEXT_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<title(?:\s[^>]*)?>.*?</title\s*>', ' ', 'g'), '(?is)<style(?:\s[^>]*)?>.*?</style\s*>', ' ', 'g'), '(?is)<script(?:\s[^>]*)?>.*?</script\s*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM b)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{0B}\x{A0}]+', ' ', 'g')) AS text FROM c"""


@query("J1_fast_text", TEXT_SQL)
def j1(spark, sf):
    return pages(spark, sf).select("page_id", pg.fast_text("html").alias("text"))


@query("J1_full_text", TEXT_SQL)
def j1b(spark, sf):
    parts = pg.page_parts(F.encode("html", "UTF-8"), F.lit("index.html"))
    return pages(spark, sf).withColumn("p", parts).select("page_id", pg.segments_text(F.col("p.segments")).alias("text"))


@query("J2_anchors", """
SELECT page_id, CAST(u.n - 1 AS INTEGER) AS ord, replace(u.url, '&amp;', '&') AS url FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref="([^"]*)"', 1) AS urls FROM pages), unnest(urls) WITH ORDINALITY AS u(url, n)""")
def j2(spark, sf):
    return pg.anchors(pages(spark, sf), ["page_id"]).select("page_id", "ord", "url")


PARTS_SQL = """SELECT page_id, 0 AS ord, 'link' AS tag, 'icon.png' AS url, 'icon' AS kind FROM pages UNION ALL SELECT page_id, 1, 'img', 'a' || (page_id % 9) || '.png', 'image' FROM pages
UNION ALL SELECT page_id, 2, 'img', 'b.png', 'image' FROM pages UNION ALL SELECT page_id, 3, 'iframe', 'f.html', 'frame' FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, CAST(u.n + 3 - page_id % 2 AS INTEGER), 'a', replace(u.url, '&amp;', '&'), 'link' FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref="([^"]*)"', 1) AS urls FROM pages), unnest(urls) WITH ORDINALITY AS u(url, n)"""


@query("J2_references", PARTS_SQL)
def j2b(spark, sf):
    head = F.concat(F.lit('<!DOCTYPE html><html><head><link rel="shortcut icon" href="icon.png"></head><body><p>'),
                    F.lit('<img src="a'), number() % 9, F.lit('.png" srcset="b.png 2x">'), F.when(number() % 2 == 0, '<iframe src="f.html"></iframe>').otherwise(""), F.col("html"))
    refs = pg.references(pages(spark, sf).select("page_id", head.alias("html")), ["page_id"])
    return refs.select("page_id", "ord", "tag", "url", "kind")


@query("J3_css_urls", """
SELECT page_id, 0 AS ord, 'import' AS kind, 'base' || (page_id % 5) || '.css' AS url FROM pages UNION ALL SELECT page_id, 1, 'font', 'f.woff' FROM pages
UNION ALL SELECT page_id, 2, 'background', 'bg ' || page_id || '.png' FROM pages""")
def j3(spark, sf):
    css = F.concat(F.lit('/* url(no.png) */ @import "base'), number() % 5, F.lit('.css"; @namespace url(ns); @font-face { src: url(f.woff) } p:after { content: "url(no)" } p { background: url("bg\\20 '), number(), F.lit('.png"); }'))
    return pg.css_references(pages(spark, sf).select("page_id", css.alias("css")), ["page_id"]).select("page_id", "ord", "kind", "url")


@query("J3_simple_css_urls", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)href="/([^"]*)"', 1)) AS INTEGER) AS n, regexp_extract(html, '(?i)href="/([^"]*)"', 1) AS first FROM pages""")
def j3b(spark, sf):
    css = F.regexp_replace("html", r'(?i)href="/([^"]*)"', "href url($1)")
    urls = pg.simple_css_urls(F.array_join(F.regexp_extract_all(css, F.lit(r"(href url\([^)]*\))"), F.lit(1)), " "))
    return pages(spark, sf).select("page_id", F.size(urls).alias("n"), F.get(urls, F.lit(0)).alias("first"))


@query("J4_refresh_content", """
SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL WHEN 3 THEN 10 ELSE page_id % 3 END AS seconds,
  CASE page_id % 5 WHEN 0 THEN 'p' || page_id || '.html' WHEN 1 THEN 'a b' WHEN 2 THEN '' WHEN 3 THEN url END AS target FROM pages""")
def j4(spark, sf):
    c = (F.when(number() % 5 == 0, F.concat(number() % 3, F.lit(" ; URL = p"), number(), F.lit(".html ")))
         .when(number() % 5 == 1, F.concat(number() % 3, F.lit(".5;url='a b'c"))).when(number() % 5 == 2, (number() % 3).cast("string"))
         .when(number() % 5 == 3, F.concat(F.lit("10,"), "url")).otherwise("url=x"))
    seconds, target = pg.refresh_columns(c)
    return pages(spark, sf).select("page_id", seconds.alias("seconds"), target.alias("target"))


@query("J4_refreshes", """
SELECT page_id, 0 AS ord, page_id % 4 AS seconds, 'x' || page_id || '.html' AS target, '' AS contexts FROM pages UNION ALL SELECT page_id, 1, 0, 'y.html', 'noscript' FROM pages""")
def j4b(spark, sf):
    html = F.concat(F.lit('<html><head><meta http-equiv="Refresh" content="'), number() % 4, F.lit(";url=x"), number(),
                    F.lit('.html"><noscript><meta http-equiv="refresh" content="0;y.html"></noscript></head><body>'), F.col("html"))
    out = pg.refreshes(pages(spark, sf).select("page_id", html.alias("html")), ["page_id"])
    return out.select("page_id", "ord", "seconds", "target", F.array_join("contexts", ",").alias("contexts"))


@query("J5_charset_census", """
SELECT codec, count(*) AS n FROM (SELECT CASE page_id % 6 WHEN 0 THEN 'UTF-8-SIG' WHEN 1 THEN 'big5hkscs' WHEN 2 THEN 'windows-1252' WHEN 3 THEN 'UTF-8' WHEN 4 THEN 'x-unknown' ELSE 'UTF-16-LE' END AS codec FROM pages) GROUP BY 1""")
def j5(spark, sf):
    bare = F.regexp_replace("html", '<meta charset="utf-8">', "")
    meta = (F.when(number() % 6 == 1, '<meta charset=Big5>').when(number() % 6 == 2, '<meta http-equiv="Content-Type" content="text/html; charset=latin1">')
            .when(number() % 6 == 4, '<meta charset="x-unknown">').otherwise(""))
    html = F.concat(meta, bare)
    mark = F.when(number() % 6 == 0, F.unhex(F.lit("EFBBBF"))).when(number() % 6 == 5, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    rows = pages(spark, sf).select(html.alias("html"), F.concat(mark, F.encode(html, "UTF-8")).alias("content"))
    return pg.charset_census(rows, content="content")


@stored
def saved_pages(spark, sf):
    """Pages as different savers leave them."""
    src = F.concat(F.lit("https://site.example.com/p/"), number())
    title = F.concat(F.lit("<title>"), body(F.col("html")), F.lit("</title>"))
    kind = number() % 5
    html = (F.when(kind == 0, F.concat(F.lit("<!-- saved from url=("), F.lpad(F.length(src), 4, "0"), F.lit(")"), src, F.lit(" --><html><head>"), title, F.lit("</head>")))
            .when(kind == 1, F.concat(F.lit("<html> <!--\n Page saved with SingleFile \n url: "), src, F.lit(" \n saved date: Tue Jan 02 2024 10:20:30 GMT+0800 (Taipei)\n--><head>"), title, F.lit("</head>")))
            .when(kind == 2, F.concat(F.lit('<html><head><meta name="savepage-url" content="'), src, F.lit('"><meta name="savepage-title" content="T'), number(),
                                     F.lit('"><meta name="savepage-date" content="Wed Jan 03 2024 01:02:03 GMT-0500 (EST)">'), title, F.lit("</head>")))
            .when(kind == 3, F.concat(F.lit("<html><!-- OriginalSrc: "), src, F.lit(' --><head><link rel="icon" href="i.png"></head>')))
            .otherwise(F.concat(F.lit('<html data-scrapbook-id="2024010100000'), F.lpad(number() % 10000, 4, "0"), F.lit('" data-scrapbook-type="note" data-scrapbook-title="N &amp; '), number(),
                                F.lit('"><head><svg><title>no</title></svg>'), title, F.lit("</head>"))))
    return pages(spark, sf).select("page_id", F.concat(html, F.lit("<body>"), body(F.col("html")), F.lit("</body></html>")).alias("html"))


META_SQL = r"""
WITH t AS (SELECT page_id, 'https://site.example.com/p/' || page_id AS src, regexp_replace(html, '[^A-Za-z ]+', '', 'g') AS title FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '2024010100000' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') END AS given_id, CASE page_id % 5 WHEN 4 THEN 'note' ELSE '' END AS type,
  CASE page_id % 5 WHEN 2 THEN 'T' || page_id WHEN 3 THEN CAST(page_id AS VARCHAR) WHEN 4 THEN 'N & ' || page_id ELSE title END AS title,
  CASE page_id % 5 WHEN 1 THEN '20240102022030000' WHEN 2 THEN '20240103060203000' ELSE '' END AS "create", CASE WHEN page_id % 5 <> 4 THEN src END AS source,
  CASE page_id % 5 WHEN 3 THEN 'i.png' END AS icon FROM t"""


@query("J6_page_metadata", META_SQL)
def j6(spark, sf):
    meta = pg.page_metadata(pg.page_marks(saved_pages(spark, sf), ["page_id"]))
    return meta.select("page_id", "given_id", "type", "title", "create", "source", "icon")


@query("J7_id_selection", """
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'G' || (page_id // 8) WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CASE WHEN page_id % 20 = 3 THEN 'root' END END AS given,
  CASE page_id % 4 WHEN 1 THEN '20230101000' || lpad(CAST(page_id % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS stem FROM pages),
q AS (SELECT *, CASE WHEN given IS NOT NULL THEN row_number() OVER (PARTITION BY given ORDER BY page_id) END AS k, try_strptime(substr(stem, 1, 14), '%Y%m%d%H%M%S') IS NOT NULL AS dated FROM p),
r AS (SELECT *, CASE WHEN given = 'root' THEN 'reserved' WHEN k > 1 THEN 'used' END AS problem,
  CASE WHEN given = 'root' OR k > 1 THEN NULL WHEN given IS NOT NULL THEN given WHEN dated THEN stem END AS id FROM q),
n AS (SELECT page_id, strftime(TIMESTAMP '2024-02-01 00:00:00' + to_milliseconds(row_number() OVER (ORDER BY page_id) - 1), '%Y%m%d%H%M%S%g') AS fresh FROM r WHERE id IS NULL AND problem IS NULL)
SELECT page_id, coalesce(id, fresh) AS item_id, problem FROM r LEFT JOIN n USING (page_id)""")
def j7(spark, sf):
    given = F.when(number() % 4 == 0, F.concat(F.lit("G"), F.floor(number() / 8))).when((number() % 4 == 3) & (number() % 20 == 3), "root")
    path = F.when(number() % 4 == 1, F.concat(F.lit("20230101000"), F.lpad(number() % 1000000, 6, "0"), F.lit("/index.html"))).otherwise(F.concat(F.lit("page"), number(), F.lit(".html")))
    rows = pages(spark, sf).select(F.lit("b").alias("book_id"), number().alias("ord"), path.alias("path"), given.alias("given_id"))
    return pg.choose_ids(rows, fx.items(spark, sf), "20240201000000000").select(F.col("ord").alias("page_id"), "item_id", "problem")


def uri(text):
    return (F.when(number() % 4 == 0, F.concat(F.lit("data:text/plain;charset=UTF-8;base64,"), F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))))
            .when(number() % 4 == 1, F.concat(F.lit("data:text/html;Charset=big5,a%20%ZZ%C3%A9"), number())).when(number() % 4 == 2, F.lit("data:image/png;base64,AAAAA"))
            .otherwise(F.lit("data:nothing")))


@query("J8_data_uris", """
WITH p AS (SELECT page_id, html AS t FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html' WHEN 2 THEN 'image/png' END AS mime, CASE page_id % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'big5' END AS charset,
  CASE page_id % 4 WHEN 0 THEN sha1(t) WHEN 1 THEN sha1('a %ZZé' || page_id) END AS digest FROM p""")
def j8(spark, sf):
    c = datauri.columns(uri(F.col("html")))
    return pages(spark, sf).select("page_id", c["mime"].alias("mime"), c["params"]["charset"].alias("charset"), F.sha1(c["payload"]).alias("digest"))


@stored
def picture_pages(spark, sf):
    """Whole pages beside a picture as data URI (one in twenty shared), twice, an error and a normal reference."""
    img = F.base64(F.encode(F.concat(F.lit("img"), number() % 20), "UTF-8"))
    html = F.concat(F.lit("<html><style>b{background:url(data:image/png;base64,"), img, F.lit(')}</style><body><img src="data:image/png;base64,'), img,
                    F.lit('"><img src="data:oops"><a href="x.html">'), F.col("html"), F.lit("</a></body></html>"))
    return pages(spark, sf).select(F.lit("b").alias("book_id"), "page_id", F.concat(F.lit("d"), number() % 7, F.lit("/p"), number(), F.lit(".html")).alias("path"), html.alias("html"))


@query("J9_externalised_pages", r"""
SELECT page_id, '<html><style>b{background:url("' || sha1('img' || (page_id % 20)) || '.png")}</style><body><img src="' || sha1('img' || (page_id % 20)) ||
  '.png"><img src="urn:scrapbook:convert:error:url:data:oops"><a href="x.html">' || html || '</a></body></html>' AS html FROM pages""")
def j9(spark, sf):
    return pg.externalize(picture_pages(spark, sf), ["page_id"])[0].select("page_id", "html")


@query("D8_payload_store", "SELECT sha1('img' || (page_id % 20)) || '.png' AS name, 'img' || (page_id % 20) AS content, 'image/png' AS mime, 2 * count(*) AS uses FROM pages GROUP BY 1, 2")
def d8(spark, sf):
    return pg.externalize(picture_pages(spark, sf), ["page_id"])[1].select("name", F.decode("content", "UTF-8").alias("content"), "mime", "uses")


@stored
def site(spark, sf):
    """(pages, files in one table): whole pages beside a linked and an imported style sheet and a picture; even pages frame the next one.

    The three sheets import each other in a circle.
    """
    k = number()
    page = F.concat(F.lit('<html><head><link rel="stylesheet" href="../css/s'), k % 3, F.lit('.css"><style>@import "../css/s'), (k + 1) % 3,
                    F.lit('.css";</style></head><body style="background: url(../img/'), k % 11, F.lit('.png)"><a href="missing.html">m</a><a href="https://x.example.com/">e</a>'),
                    F.when(k % 2 == 0, F.concat(F.lit('<frame src="p'), k + 1, F.lit('.html">'))).otherwise(""), F.col("html"), F.lit("</body></html>"))
    p = pages(spark, sf)

    def files(path, text):
        return p.select(F.lit("b").alias("book_id"), path.alias("path"), F.encode(text, "UTF-8").alias("content"))

    sheet = F.concat(F.lit('@import "s'), (k + 1) % 3, F.lit('.css"; b { background: url(../img/'), k % 3, F.lit(".png) }"))
    return (files(F.concat(F.lit("d/p"), k, F.lit(".html")), page)
            .unionByName(files(F.concat(F.lit("img/"), k % 11, F.lit(".png")), F.concat(F.lit("png"), k % 11)).distinct())
            .unionByName(files(F.concat(F.lit("css/s"), k % 3, F.lit(".css")), sheet).distinct()))


def site_pages(spark, sf):
    return site(spark, sf).filter("path like 'd/%'").select("book_id", "path", F.decode("content", "UTF-8").alias("html"))


@query("C16_page_resources", """
SELECT page_id, '../img/' || (page_id % 11) || '.png' AS url, 'found' AS status, 'image/png' AS mime, to_base64(encode('png' || (page_id % 11))) AS data FROM pages
UNION ALL SELECT page_id, '../css/s' || ((page_id + x) % 3) || '.css', 'found', 'text/css', NULL FROM pages, range(2) r(x)
UNION ALL SELECT page_id, 'missing.html', 'missing', 'text/html', NULL FROM pages UNION ALL SELECT page_id, 'https://x.example.com/', 'external', 'application/octet-stream', NULL FROM pages
UNION ALL SELECT page_id, replace(unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref="([^"]*)"', 1)), '&amp;', '&'), 'external', 'application/octet-stream', NULL FROM pages
UNION ALL SELECT page_id, 'p' || (page_id + 1) || '.html', CASE WHEN page_id + 1 < (SELECT count(*) FROM pages) THEN 'found' ELSE 'missing' END, 'text/html', NULL FROM pages WHERE page_id % 2 = 0""")
def c16(spark, sf):
    refs = pg.references(site_pages(spark, sf), ["book_id", "path"])
    j = pg.join_resources(refs, site(spark, sf))
    data = F.when(F.col("mime") == "image/png", F.base64("content"))
    return j.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("page_id"), "url", "status", "mime", data.alias("data"))


EMBED_SQL = """
WITH pic AS (SELECT i, 'data:image/png;base64,' || to_base64(encode('png' || i)) AS u FROM range(11) r(i)),
t3 AS (SELECT j, '@import "urn:scrapbook:convert:circular:url:s' || j || '.css"; b { background: url("' || u || '") }' AS t FROM range(3) r(j) JOIN pic ON i = (j + 2) % 3),
t2 AS (SELECT j, '@import "data:text/css,' || replace(url_encode(t), '%2F', '/') || '"; b { background: url("' || u || '") }' AS t FROM t3 JOIN pic ON i = (j + 1) % 3),
t1 AS (SELECT j, '@import "data:text/css,' || replace(url_encode(t), '%2F', '/') || '"; b { background: url("' || u || '") }' AS t FROM t2 JOIN pic ON i = j),
sheet AS (SELECT j, 'data:text/css,' || replace(url_encode(t), '%2F', '/') AS u FROM t1),
own AS (SELECT page_id, '<html><head><link rel="stylesheet" href="' || a.u || '"><style>@import "' || b.u || '";</style></head><body style="background: url(&quot;' || pic.u ||
          '&quot;)"><a href="urn:scrapbook:converter:error:url:missing.html">m</a><a href="https://x.example.com/">e</a>' AS head, html || '</body></html>' AS tail
        FROM pages JOIN sheet a ON a.j = page_id % 3 JOIN sheet b ON b.j = (page_id + 1) % 3 JOIN pic ON pic.i = page_id % 11)
SELECT 'd/p' || o.page_id || '.html' AS path, o.head || CASE WHEN o.page_id % 2 = 1 THEN '' ELSE '<frame src="' || CASE WHEN f.page_id IS NULL THEN 'urn:scrapbook:convert:error:url:p' || (o.page_id + 1) || '.html'
  ELSE 'data:text/html,' || replace(url_encode(f.head || f.tail), '%2F', '/') END || '">' END || o.tail AS html FROM own o LEFT JOIN own f ON f.page_id = o.page_id + 1"""


@query("J10_embedded_pages", EMBED_SQL)
def j10(spark, sf):
    return pg.embed(site_pages(spark, sf), site(spark, sf)).select("path", "html")


@query("J11_content_type_census", """
SELECT type, charset, count(*) AS n FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN 'image/png' END AS type,
  CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'big5' END AS charset FROM pages) GROUP BY 1, 2""")
def j11(spark, sf):
    h = (F.when(number() % 4 == 0, 'Text/HTML; Charset="UTF-8"; q=1').when(number() % 4 == 1, "application/xhtml+xml;charset=x; charset=Big5")
         .when(number() % 4 == 2, "image/png; =bad; charset=no").otherwise("nonsense"))
    return pg.content_type_census(pages(spark, sf).select(h.alias("header")))


@query("J12_plain_text", r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE trim(regexp_replace(text, '[\s\x{0B}\x{A0}\x{3000}]+', ' ', 'g')) END AS text FROM documents""")
def j12(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    mark = F.when(k == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    path = F.when(k == 2, "a.png").when(k == 1, "a.md").otherwise("a.txt")
    return d.select("doc_id", pg.plain_text(F.concat(mark, F.encode("text", "UTF-8")), path).alias("text"))


@query("D11_markup_census", """
SELECT count(*) AS pages, count(*) FILTER (page_id % 7 = 0) AS annotation_css, count(*) FILTER (page_id % 7 = 1) AS combine_css, count(*) FILTER (page_id % 7 = 2) AS combine_icon,
  count(*) FILTER (page_id % 7 = 3) AS annotation_class, count(*) FILTER (page_id % 7 = 4) AS annotation_attr, count(*) FILTER (page_id % 7 = 5) AS old_loader, count(*) FILTER (page_id % 14 = 6) AS shadowroot_attr,
  count(*) FILTER (page_id % 14 <> 13) AS any_rule FROM pages""")
def d11(spark, sf):
    extra = F.element_at(F.array(*[F.lit(x) for x in (
        '<link rel="stylesheet" href="chrome://scrapbook/skin/annotation.css">', '<link rel="stylesheet" href="chrome://scrapbook/skin/combine.css">',
        '<img src="chrome://scrapbook/skin/treenote.png">', '<span class="x linemarker-marked-line">', '<span data-sb-obj="inline">',
        '<script data-scrapbook-elem="canvas-loader">')]), F.least(number() % 7 + 1, F.lit(6)).cast("int"))
    tail = F.when(number() % 7 < 6, extra).when(number() % 14 == 6, '<div data-scrapbook-shadowroot="{}">').otherwise("")
    return lg.markup_census(pages(spark, sf).select(F.concat("html", tail).alias("html")))


# -- text index -------------------------------------------------------------------------

@query("H5_item_crawl", """
WITH RECURSIVE r AS (SELECT page_id, 'p' || (page_id % 5) AS path FROM pages UNION SELECT r.page_id, 'p' || ((CAST(substr(r.path, 2) AS INT) * 2 + 1) % 23) FROM r WHERE CAST(substr(r.path, 2) AS INT) <> 15)
SELECT page_id, path FROM r WHERE path <> 'p22'""")
def h5(spark, sf):
    items = pages(spark, sf).select(F.lit("b").alias("book_id"), F.concat(F.lit("i"), number()).alias("item_id"), "page_id")
    nums = items.select("book_id", "item_id", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("k"))
    links = nums.filter("k <> 15").select("book_id", "item_id", F.concat(F.lit("p"), "k").alias("path"), F.concat(F.lit("p"), (F.col("k") * 2 + 1) % 23).alias("target"))
    files = nums.filter("k <> 22").select("book_id", "item_id", F.concat(F.lit("p"), "k").alias("path"))
    seeds = items.select("book_id", "item_id", F.concat(F.lit("p"), number() % 5).alias("path"))
    out = ix.crawl(seeds, links, files)
    return out.select(F.expr("cast(substring(item_id, 2) as bigint)").alias("page_id"), "path")


@query("H6_inlined_frames", r"""
WITH t AS (SELECT page_id, trim(regexp_replace('w ' || regexp_replace(html, '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g')) AS t FROM pages)
SELECT a.page_id, a.t || CASE WHEN b.t IS NOT NULL THEN ' ' || b.t ELSE '' END || ' end' || CASE WHEN b.t IS NOT NULL THEN '' ELSE '' END AS content
FROM t a LEFT JOIN (SELECT page_id, t || ' end' AS t FROM t) b ON a.page_id % 2 = 0 AND b.page_id = a.page_id + 1 WHERE a.page_id % 2 = 0""")
def h6(spark, sf):
    html = F.concat(F.lit("<html><body>w "), body(F.col("html")), F.when(number() % 2 == 0, F.concat(F.lit('<iframe src="p'), number() + 1, F.lit('.html"></iframe>'))).otherwise(""), F.lit("<b>end</b></body></html>"))
    rows = pages(spark, sf).select(F.lit("b").alias("book_id"), F.concat(F.lit("i"), F.floor(number() / 10)).alias("item_id"), F.concat(F.lit("p"), number(), F.lit(".html")).alias("path"), number().alias("ord"),
                                   F.encode(html, "UTF-8").alias("content"))
    out = ix.inline_frames(ix.extract(rows))
    return out.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("page_id"), "content")


@stored
def dated_text(spark, sf):
    ev = table(spark, sf, "events").select(F.concat(F.lit("D"), "event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("src_mtime"))
    return fx.fulltext(spark, sf).select("book_id", "item_id", "path", "ord", F.length("content").alias("n")).join(ev, "item_id")


C11_SQL = ctes("items", "fulltext", "files") + """,
ft AS (SELECT f.*, e.ts AS src FROM fulltext f JOIN events e ON f.item_id = 'D' || e.event_id), hw AS (SELECT book_id, max(src) - INTERVAL 10 DAY AS m FROM ft GROUP BY 1),
it AS (SELECT * FROM items WHERE ord % 10 <> 9), pool AS (SELECT coalesce(i.book_id, c.book_id) AS book_id, coalesce(i.item_id, c.item_id) AS item_id, i.item_id IS NOT NULL AS has_meta, i.index, c.item_id IS NOT NULL AS cached, fi.mtime, hw.m
  FROM it i FULL JOIN (SELECT DISTINCT book_id, item_id FROM ft) c ON c.book_id = i.book_id AND c.item_id = i.item_id LEFT JOIN files fi ON fi.book_id = i.book_id AND fi.path = i.index LEFT JOIN hw ON hw.book_id = coalesce(i.book_id, c.book_id)),
st AS (SELECT *, CASE WHEN NOT has_meta OR index = '' OR mtime IS NULL THEN 'purge_item' WHEN cached AND (index LIKE '%.htz' OR index LIKE '%.maff') AND mtime <= m THEN 'skip' END AS whole FROM pool),
asked AS (SELECT DISTINCT book_id, item_id, path FROM (SELECT book_id, item_id, 'index.html' AS path FROM it WHERE index LIKE '%.htz' OR index LIKE '%/index.html' UNION ALL SELECT book_id, item_id, item_id || '.html' FROM it WHERE index LIKE '%.html' AND index NOT LIKE '%/%' UNION ALL SELECT book_id, item_id, path FROM ft))
SELECT book_id, item_id, '' AS path, whole AS action FROM st WHERE whole IS NOT NULL
UNION ALL SELECT a.book_id, a.item_id, a.path, CASE WHEN a.path = 'page2.html' THEN 'purge_path' WHEN c.path IS NOT NULL AND s.mtime <= s.m THEN 'skip' ELSE 'extract' END FROM asked a JOIN st s ON s.book_id = a.book_id AND s.item_id = a.item_id AND s.whole IS NULL
  LEFT JOIN ft c ON c.book_id = a.book_id AND c.item_id = a.item_id AND c.path = a.path"""


@query("C11_refresh_classes", C11_SQL)
def c11(spark, sf):
    return ix.classify(**refresh_tables(spark, sf)).select("book_id", "item_id", "path", "action")


def refresh_tables(spark, sf):
    """What the refresh classes are told from."""
    items, text, files = fx.items(spark, sf).filter("ord % 10 <> 9"), dated_text(spark, sf), fx.files(spark, sf)
    own = files.join(items.select("book_id", "item_id", F.col("index").alias("path")), ["book_id", "path"]).select("book_id", "item_id", "mtime")
    inside = own.withColumn("path", F.explode(F.array(F.lit("index.html"), F.concat("item_id", F.lit(".html")))))
    mark = ix.high_water(text).withColumn("last_modified", F.col("last_modified") - F.expr("interval 10 days"))
    return {"items": items, "fulltext": text, "index_files": files, "page_files": inside, "paths": ix.index_paths(items), "mark": mark}


@query("A10_index_paths", ctes("items") + """
SELECT book_id, item_id, CASE WHEN index LIKE '%.htz' OR index LIKE '%/index.html' THEN 'index.html' ELSE index END AS path FROM items WHERE index <> '' AND index NOT LIKE '%.maff'""")
def a10(spark, sf):
    return ix.index_paths(fx.items(spark, sf))


@query("D3_fingerprints", ctes("edges") + """, h AS (SELECT book_id, sha1('{"book_id":"' || book_id || '","child_id":"' || child_id || '","parent_id":"' || parent_id || '","pos":' || pos || '}') AS d FROM edges)
SELECT book_id, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(d, 1, 12) AS BIGINT)) AS VARCHAR) AS sum_a, CAST(sum(CAST('0x' || substr(d, 13, 12) AS BIGINT)) AS VARCHAR) AS sum_b FROM h GROUP BY 1""")
def d3(spark, sf):
    return ix.fingerprint(fx.edges(spark, sf))


@query("D4_high_water", ctes("fulltext") + "SELECT book_id, max(ts) AS last_modified FROM fulltext f JOIN events e ON f.item_id = 'D' || e.event_id GROUP BY 1")
def d4(spark, sf):
    return ix.high_water(dated_text(spark, sf)).select("book_id", F.col("last_modified").cast("timestamp_ntz").alias("last_modified"))


# -- files and archives ---------------------------------------------------------------------

@stored
def shard_files(spark, sf):
    """Catalogue files built from the documents: one shard per 500 document numbers."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    doc = F.concat(F.lit('"D'), k % 700, F.lit('":'),
                   F.when(k % 90 == 0, "null").otherwise(F.to_json(F.struct(F.col("text").alias("title"), "source", (k % 2 == 0).alias("marked")))))
    rows = d.select("lang", F.floor(k / 500).alias("shard"), k, doc.alias("doc"))
    text = (rows.groupBy("lang", "shard").agg(F.array_sort(F.collect_list(F.struct("doc_id", "doc"))).alias("l"))
            .withColumn("value", F.concat(F.lit("/* note */\nscrapbook.meta({"), F.array_join(F.transform("l", lambda s: s["doc"]), ",\n"), F.lit("})"))))
    name = F.when(F.col("shard") == 0, "meta.js").otherwise(F.concat(F.lit("meta"), "shard", F.lit(".js")))
    return text.select(F.concat(F.lit("/books/"), "lang", F.lit("/tree/"), name).alias("file"), "value", "shard")


@query("A1_catalogue_files", """
SELECT lang AS book_id, 'D' || (doc_id % 700) AS key, doc_id // 500 AS shard, doc_id % 90 = 0 AS deleted FROM documents""")
def a1(spark, sf):
    e = cat.parse_shards(cat.shard_rows(shard_files(spark, sf), "meta"))
    return e.select("book_id", "key", F.col("shard").cast("long").alias("shard"), F.col("value").isNull().alias("deleted"))


@query("A2_shard_merge", """
WITH e AS (SELECT lang AS book_id, 'D' || (doc_id % 700) AS key, doc_id, CASE WHEN doc_id % 90 = 0 THEN NULL ELSE source END AS source FROM documents)
SELECT book_id, key, arg_max(coalesce(source, ''), doc_id) AS source, CAST(row_number() OVER (PARTITION BY book_id ORDER BY min(doc_id)) - 1 AS BIGINT) AS place FROM e GROUP BY 1, 2 HAVING arg_max(coalesce(source, ''), doc_id) <> ''""")
def a2(spark, sf):
    from ..scale import rank_rows
    m = cat.merge_shards(cat.parse_shards(cat.shard_rows(shard_files(spark, sf), "meta")))
    items = cat.load_items(m)
    return rank_rows(items, ["book_id"], ["ord"], "place").select("book_id", F.col("item_id").alias("key"), "source", "place")


@query("F4_latest_shard", "SELECT lang AS book_id, 'D' || (doc_id % 700) AS key, CAST(max(doc_id) // 500 AS BIGINT) AS shard FROM documents GROUP BY 1, 2")
def f4(spark, sf):
    e = cat.parse_shards(cat.shard_rows(shard_files(spark, sf), "meta"))
    return e.groupBy("book_id", "key").agg(F.max("shard").cast("long").alias("shard"))


@query("A3_loaders", ctes("edges", "fulltext") + """
SELECT 'edge' AS kind, book_id, parent_id AS a, child_id AS b FROM (SELECT *, row_number() OVER (PARTITION BY book_id, parent_id ORDER BY pos, child_id) AS k FROM edges)
UNION ALL SELECT 'text', book_id, item_id, path || ':' || length(content) FROM fulltext""")
def a3(spark, sf):
    from ..operators.tree import children_lists
    # lists and texts written as catalogue entries, then loaded again
    toc = children_lists(fx.edges(spark, sf), 4096).select("book_id", F.col("parent_id").alias("key"), F.to_json("values").alias("value"), F.lit(0).alias("ord"))
    ft = fx.fulltext(spark, sf).groupBy("book_id", F.col("item_id").alias("key")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("path", F.struct("content"))))).alias("value"))
    e = cat.load_edges(toc).select(F.lit("edge").alias("kind"), "book_id", F.col("parent_id").alias("a"), F.col("child_id").alias("b"))
    t = cat.load_fulltext(ft).select(F.lit("text").alias("kind"), "book_id", F.col("item_id").alias("a"), F.concat("path", F.lit(":"), F.length("content")).alias("b"))
    return e.unionByName(t)


@query("A4_meta_shards", ctes("items") + "SELECT book_id, item_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY ord, item_id) // 100 AS INTEGER) AS shard FROM items")
def a4(spark, sf):
    return cat.meta_shards(fx.items(spark, sf), 100).select("book_id", "item_id", "shard")


@query("A4_text_shards", """
WITH RECURSIVE d AS (SELECT lang AS book_id, 'D' || doc_id AS key, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
w AS (SELECT book_id, key, k, 1 + n AS fill, 0 AS shard FROM d WHERE k = 1 UNION ALL SELECT d.book_id, d.key, d.k, CASE WHEN w.fill >= 20000 THEN 0 ELSE w.fill END + d.n, CASE WHEN w.fill >= 20000 THEN w.shard + 1 ELSE w.shard END
  FROM w JOIN d ON d.book_id = w.book_id AND d.k = w.k + 1)
SELECT book_id, key, shard FROM w""")
def a4b(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("book_id"), F.concat(F.lit("D"), "doc_id").alias("key"), F.col("doc_id").alias("ord"), F.length("text").cast("long").alias("size"))
    return cat.greedy_shards(d, 20000)


@query("A6_directory_listing", ctes("items", "files") + """, f AS (SELECT DISTINCT book_id, path FROM files)
SELECT DISTINCT book_id, path AS name, 'file' AS type FROM f UNION SELECT DISTINCT book_id, regexp_extract(path, '^([^/]+)/', 1), 'dir' FROM f WHERE contains(path, '/')
UNION SELECT DISTINCT book_id, regexp_extract(path, '^([^/]+/[^/]+)/', 1), 'dir' FROM f WHERE regexp_matches(path, '^[^/]+/[^/]+/')""")
def a6(spark, sf):
    f = fx.files(spark, sf).withColumn("type", F.lit("file")).dropDuplicates(["book_id", "path"])
    return fl.directory_listing(f, recursive=True, by=["book_id"]).select("book_id", "name", "type")


@query("A20_directory_ingest", "WITH m AS (" + META_SQL + """),
a AS (SELECT 'd' || k AS path, 'd' || k AS title, 'folder' AS type, '' AS index, '' AS "create", '' AS source, '' AS icon, NULL AS given, NULL AS stem, 'root' AS up FROM range(3) r(k) WHERE k IN (SELECT page_id % 3 FROM pages)
  UNION ALL SELECT f || '/' || name, title, type, f || '/' || name || CASE WHEN dated THEN '/index.html' ELSE '' END, "create", coalesce(source, ''), coalesce(icon, ''), given_id, CASE WHEN dated THEN name END, f FROM (
    SELECT *, 'd' || (page_id % 3) AS f, page_id % 4 = 1 AS dated, CASE WHEN page_id % 4 = 1 THEN '20230101000' || lpad(CAST(page_id AS VARCHAR), 6, '0') ELSE 'p' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '.html' END AS name FROM m)),
w AS (SELECT *, coalesce(given, stem) AS want, row_number() OVER (PARTITION BY coalesce(given, stem) IS NULL ORDER BY encode(path)) - 1 AS k FROM a),
i AS (SELECT *, coalesce(want, strftime(TIMESTAMP '2024-02-01 00:00:00' + to_milliseconds(k), '%Y%m%d%H%M%S%g')) AS item_id FROM w)
SELECT i.item_id, i.title, i.type, i.index, CASE WHEN i."create" = '' THEN '20240201000000000' ELSE i."create" END AS "create", CASE WHEN i.type = 'folder' THEN '20240201000000000' ELSE '20240115000000000' END AS modify, i.source, i.icon,
  coalesce(u.item_id, 'root') AS parent_id, row_number() OVER (PARTITION BY i.up ORDER BY encode(i.path)) - 1 AS pos FROM i LEFT JOIN i u ON u.path = i.up""")
def a20(spark, sf):
    """Saved pages in three folders, some as a folder of their own with a dated name."""
    k = number()
    name = F.when(k % 4 == 1, F.concat(F.lit("20230101000"), F.lpad(k.cast("string"), 6, "0"), F.lit("/index.html"))).otherwise(F.concat(F.lit("p"), F.lpad(k.cast("string"), 6, "0"), F.lit(".html")))
    content = F.encode("html", "UTF-8")
    files = saved_pages(spark, sf).select(
        F.lit("b").alias("book_id"), F.concat(F.lit("d"), k % 3, F.lit("/"), name).alias("path"), F.lit("file").alias("type"), F.octet_length(content).cast("long").alias("size"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("mtime"), content.alias("content"))
    items, edges, _ = ingest_pages(files, fx.items(spark, sf), "20240201000000000")
    rows = items.select("book_id", "item_id", "title", "type", "index", "create", "modify", "source", "icon")
    return rows.join(edges.withColumnRenamed("child_id", "item_id"), ["book_id", "item_id"]).drop("book_id")


@query("A20_files_and_folders")
def a20f(spark, sf):
    f = fx.files(spark, sf).withColumn("type", F.lit("file")).dropDuplicates(["book_id", "path"])
    items, edges, _ = fl.ingest_directory(f, "20240201000000000")
    return edges.join(items.select("book_id", F.col("item_id").alias("child_id"), "title", "type", "index"), ["book_id", "child_id"])


@query("A16_legacy_data_scan", """
SELECT strftime(o_orderdate, '%Y%m%d%H%M%S') AS legacy_id, max(o_orderkey % 2) = 1 AS has_sitemap FROM orders GROUP BY 1 HAVING max(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END) = 1""")
def a16(spark, sf):
    o = table(spark, sf, "orders")
    lid = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    names = F.explode(F.array(F.when(F.col("o_orderkey") % 3 != 0, "index.html").otherwise("x.png"), F.when(F.col("o_orderkey") % 2 == 1, "sitemap.xml").otherwise("y.png")))
    files = o.select(F.lit("b").alias("book_id"), lid.alias("lid"), F.col("o_orderdate").cast("timestamp").alias("mtime"), names.alias("name"))
    files = files.select("book_id", F.concat(F.lit("data/"), "lid", F.lit("/"), "name").alias("path"), "mtime")
    return fl.legacy_data_scan(files).select("legacy_id", "has_sitemap")


@F.pandas_udf(T.BinaryType())
def zip_up(ids: pd.Series, html: pd.Series) -> pd.Series:
    """A small archive per page; every 10th is broken, every 3rd is a MAFF with an RDF index."""
    def one(i, text):
        if i % 10 == 9:
            return b"not a zip"
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zh:
            if i % 3 == 0:
                zh.writestr("t1/index.rdf", '<RDF:RDF xmlns:MAF="http://maf.mozdev.org/metadata/rdf#" xmlns:RDF="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
                            f'<RDF:Description RDF:about="urn:root"><MAF:title RDF:resource="T{i}"/><MAF:indexfilename RDF:resource="main.html"/></RDF:Description></RDF:RDF>')
                zh.writestr("t1/main.html", text)
                zh.writestr("t2/index.html", text)
            else:
                if i % 4:
                    zh.writestr("index.html", text)
                zh.writestr("sub/", "")
                zh.writestr("sub/deep/a.txt", text)
        return buf.getvalue()
    return pd.Series([one(int(i), t) for i, t in zip(ids, html)])


@stored
def archives(spark, sf):
    return pages(spark, sf).select(F.concat(F.lit("a"), number(), F.when(number() % 3 == 0, ".maff").otherwise(".htz")).alias("archive"), zip_up("page_id", "html").alias("content"))


ARCH = "z AS (SELECT page_id AS i, 'a' || page_id || CASE WHEN page_id % 3 = 0 THEN '.maff' ELSE '.htz' END AS archive FROM pages WHERE page_id % 10 <> 9)"


@query("A7_archive_members", "WITH " + ARCH + """
SELECT archive, v.name, v.type FROM z, (VALUES ('t1', 'dir'), ('t1/index.rdf', 'file'), ('t1/main.html', 'file'), ('t2', 'dir'), ('t2/index.html', 'file')) v(name, type) WHERE i % 3 = 0
UNION ALL SELECT archive, v.name, v.type FROM z, (VALUES ('sub', 'dir'), ('sub/deep', 'dir'), ('sub/deep/a.txt', 'file')) v(name, type) WHERE i % 3 <> 0
UNION ALL SELECT archive, 'index.html', 'file' FROM z WHERE i % 3 <> 0 AND i % 4 <> 0""")
def a7(spark, sf):
    return ar.list_members(ar.members(archives(spark, sf)), recursive=True).select("archive", "name", "type")


@query("A8_member_classes", "WITH " + ARCH + """
SELECT archive, v.p AS probe, CASE v.p WHEN '' THEN 'root' WHEN 'index.html' THEN CASE WHEN i % 3 <> 0 AND i % 4 <> 0 THEN 'file' ELSE 'none' END WHEN 'index.html/x' THEN CASE WHEN i % 3 <> 0 AND i % 4 <> 0 THEN 'invalid' ELSE 'none' END
  WHEN 'sub/' THEN CASE WHEN i % 3 <> 0 THEN 'dir' ELSE 'none' END WHEN 'sub/deep' THEN CASE WHEN i % 3 <> 0 THEN 'implicit' ELSE 'none' END ELSE CASE WHEN i % 3 = 0 THEN 'implicit' ELSE 'none' END END AS kind
FROM z, (VALUES (''), ('index.html'), ('index.html/x'), ('sub/'), ('sub/deep'), ('t1')) v(p)""")
def a8(spark, sf):
    rows = ar.members(archives(spark, sf))
    probe = F.explode(F.array(*[F.lit(p) for p in ("", "index.html", "index.html/x", "sub/", "sub/deep", "t1")]))
    probes = rows.filter("error is null").select("archive").distinct().select("archive", probe.alias("probe"))
    return ar.classify_members(probes, rows)


@query("A9_maff_pages", "WITH " + ARCH + """
SELECT archive, 'T' || i AS title, 't1/main.html' AS indexfilename FROM z WHERE i % 3 = 0 UNION ALL SELECT archive, NULL, 't2/index.html' FROM z WHERE i % 3 = 0""")
def a9(spark, sf):
    return ar.maff_pages(archives(spark, sf).filter("archive like '%.maff'")).select("archive", "title", "indexfilename")


@query("M4_archive_validity", """
SELECT 'i' || page_id AS item_id, CASE WHEN page_id % 10 = 9 THEN 'corrupted_archive' ELSE 'missing_archive_index' END AS code FROM pages WHERE page_id % 10 = 9 OR (page_id % 3 <> 0 AND page_id % 4 = 0)""")
def m4(spark, sf):
    health = ar.archive_health(archives(spark, sf)).select(F.lit("b").alias("book_id"), F.col("archive").alias("path"), "error", "has_index", "n_pages")
    items = archives(spark, sf).select(F.lit("b").alias("book_id"), F.concat(F.lit("i"), F.regexp_extract("archive", "([0-9]+)", 1)).alias("item_id"), F.col("archive").alias("index"))
    return ck.check_archives(items, health).select("item_id", "code")


@F.pandas_udf(T.BinaryType())
def pack_export(ids: pd.Series, titles: pd.Series) -> pd.Series:
    """Export archives; some records are malformed, every 4th archive is version 1."""
    import json

    def one(i, title):
        buf = io.BytesIO()
        v1 = i % 4 == 3
        with zipfile.ZipFile(buf, "w") as zh:
            for k in range(1 if v1 else 2):
                ets = f"2024010100{i % 10000:04d}{k:03d}"
                rec = {"version": 1 if v1 else 2, "id": ets, "timestamp": ets, "timezone": 3600.0 if v1 else 3600,
                       "path": [{"id": "root", "title": ""}]}
                if not v1:
                    rec["index"] = "bad" if i % 6 == 0 and k == 1 else k
                top = "" if v1 else ets + "/"
                zh.writestr(f"{top}export.json", json.dumps(rec))
                zh.writestr(f"{top}meta.json", json.dumps({"id": f"x{i}", "title": title}))
        return buf.getvalue()
    return pd.Series([one(int(i), t) for i, t in zip(ids, titles)])


@stored
def export_files(spark, sf):
    return pages(spark, sf).select(F.concat(F.lit("e"), number()).alias("archive"), pack_export("page_id", body(F.col("html"))).alias("content"))


@query("A11_exports_v2", """
SELECT 'e' || page_id AS archive, 'x' || page_id AS item_id, CAST(k AS BIGINT) AS pos, 'root' AS top_folder FROM pages, (VALUES (0), (1)) v(k) WHERE page_id % 4 <> 3 AND NOT (page_id % 6 = 0 AND k = 1)""")
def a11(spark, sf):
    records, _ = ar.read_exports(export_files(spark, sf))
    return records.select("archive", "item_id", "pos", F.col("path")[0]["id"].alias("top_folder"))


@query("A12_exports_v1", "SELECT 'e' || page_id AS archive, 'x' || page_id AS item_id, 3600.0::DOUBLE AS tz_offset FROM pages WHERE page_id % 4 = 3")
def a12(spark, sf):
    records, _ = ar.read_exports(export_files(spark, sf), version=1)
    return records.select("archive", "item_id", "tz_offset")


@query("A15_legacy_rdf", """
SELECT 'item' AS kind, strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0') AS id, o_orderpriority AS detail FROM orders
UNION ALL SELECT 'edge', strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0'), CASE WHEN o_orderkey % 100 = 0 THEN 'root' ELSE '2000010100' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') END FROM orders""")
def a15(spark, sf):
    base = _folder(spark, "rdf")
    o = table(spark, sf, "orders")
    iid = F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lpad((F.col("o_orderkey") % 1000000000).cast("string"), 9, "0"))
    item = F.concat(F.lit('<RDF:Description RDF:about="urn:scrapbook:item'), iid, F.lit('" NS1:id="x" NS1:title="'), F.col("o_orderpriority"), F.lit('" NS1:type=""/>'))
    up = F.when(F.col("o_orderkey") % 100 == 0, "root").otherwise(F.concat(F.lit("item2000010100"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")))
    seq = F.concat(F.lit('<RDF:Seq RDF:about="urn:scrapbook:'), up, F.lit('"><RDF:li RDF:resource="urn:scrapbook:item'), iid, F.lit('"/></RDF:Seq>'))
    # one catalogue file per 5000 order numbers
    entries = o.select(F.floor(F.col("o_orderkey") / 5000).alias("book"), F.concat(item, F.lit("\n"), seq).alias("e"))
    docs = entries.groupBy("book").agg(F.array_join(F.collect_list("e"), "\n").alias("body")).select("book", F.concat(F.lit(
        '<?xml version="1.0"?>\n<RDF:RDF xmlns:NS1="http://amb.vis.ne.jp/mozilla/scrapbook-rdf#" xmlns:NC="http://home.netscape.com/NC-rdf#" '
        'xmlns:RDF="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'), "body", F.lit("\n</RDF:RDF>")).alias("value"))
    docs.write.partitionBy("book").text(f"{base}/rdf")
    items = rdf.read_records(spark, f"{base}/rdf/*").select(F.lit("item").alias("kind"), F.col("legacy_id").alias("id"), F.col("props")["title"].alias("detail"))
    edges = rdf.read_sequences(spark, f"{base}/rdf/*").select(F.lit("edge").alias("kind"), F.col("child_id").alias("id"), F.col("parent_id").alias("detail"))
    return items.unionByName(edges)


# -- streams ------------------------------------------------------------------------------------

def _folder(spark, name):
    """A fresh folder beside the checkpoints, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("N1_incremental_index", "WITH t AS (" + TEXT_SQL + r""")
SELECT page_id, text || CASE WHEN page_id % 4 = 1 THEN ' v3' WHEN page_id % 2 = 0 THEN ' v2' ELSE ' v1' END AS content FROM t WHERE page_id % 5 <> 0 AND page_id % 7 <> 0""")
def n1(spark, sf):
    """Whole pages in three versions; then some pages and items are gone, and a late row of one comes in.  The index is compacted twice."""
    base = _folder(spark, "index")

    def version(v, cond, content=None, path="index.html"):
        html = F.encode(F.concat("html", F.lit(f" v{v}")), "UTF-8") if content is None else F.lit(None).cast("binary")
        return pages(spark, sf).filter(cond).select(
            F.lit("b").alias("book_id"), F.concat(F.lit("i"), number()).alias("item_id"), F.lit(path).alias("path"),
            F.lit(f"2024-01-0{v} 00:00:00").cast("timestamp").alias("mtime"), html.alias("content"))

    arrivals = [version(1, "true"), version(2, "page_id % 2 = 0"), version(4, "page_id % 5 = 0", "gone").unionByName(version(4, "page_id % 7 = 0", "gone", "")), version(3, "page_id % 4 = 1")]
    for k, rows in enumerate(arrivals):
        rows.write.mode("append").parquet(f"{base}/in")
        st.index_stream(st.page_stream(spark, f"{base}/in", rows.schema), f"{base}/out", f"{base}/ckpt").awaitTermination()
        if k % 2:
            st.compact(spark, f"{base}/out")
    return st.read_index(spark, f"{base}/out").select(F.expr("cast(substring(item_id, 2) as bigint)").alias("page_id"), "content")


def arriving(spark, sf, name):
    """A table as a stream, be it a file or a folder of files: a pattern may name either, a plain path only a folder."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")


def _run_stream(df, base, mode="append"):
    (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/out")
     .trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


@query("N2_standing_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND NOT contains(lower(source), '1')")
def n2(spark, sf):
    base = _folder(spark, "search")
    d = arriving(spark, sf, "documents")
    rows = d.select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"))
    spec = SearchSpec(rules={"content": Rule([Term("the")]), "title": Rule([], [Term("1")])})
    return _run_stream(st.standing_search(rows, spec).select("doc_id"), base)


@query("N3_streaming_dedup", "SELECT DISTINCT 'u' || user_id AS eid FROM events")
def n3(spark, sf):
    base = _folder(spark, "dedup")
    e = arriving(spark, sf, "events")
    rows = e.select(F.lit("b").alias("book_id"), F.concat(F.lit("u"), "user_id").alias("eid"), F.col("ts").cast("timestamp").alias("exported_at"))
    return _run_stream(st.dedup_imports(rows).select("eid"), base)


@query("N4_change_feed", "SELECT * FROM (" + C11_SQL + ") WHERE item_id IN (SELECT 'D' || doc_id FROM documents WHERE doc_id % 3 = 0)")
def n4(spark, sf):
    """Refresh actions of every third document's item, as changes come in."""
    base = _folder(spark, "feed")
    changed = arriving(spark, sf, "documents")
    rows = changed.filter("doc_id % 3 = 0").select(F.concat(F.lit("D"), "doc_id").alias("item_id")).join(fx.items(spark, sf).select("book_id", "item_id"), "item_id")
    st.refresh_feed(rows, lambda batch_id: refresh_tables(spark, sf), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return st.read_actions(spark, f"{base}/out").select("book_id", "item_id", "path", "action")

