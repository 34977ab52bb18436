"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.mime import is_archive, is_compressible, is_html, with_mime
from . import fixtures as fx
from .fixtures import ctes, table
from .registry import query


@query("I1_timestamp_to_id", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S%g') AS id FROM events")
def i1(spark, sf):
    return table(spark, sf, "events").select("event_id", s.item_id_of("ts").alias("id"))


@query("I2_id_to_timestamp", """
WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y%m%d%H%M%S%g') WHEN 1 THEN '20240230' || '000000000'
  WHEN 2 THEN strftime(ts, '%Y%m%d%H%M%S') WHEN 3 THEN '2024010' || (event_id % 10) || '246000000' ELSE strftime(ts, '%Y') || '0101000059' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS id FROM events)
SELECT event_id, CASE WHEN regexp_full_match(id, '[0-9]{17}') THEN
  strftime(try_strptime(substr(id, 1, 14), '%Y%m%d%H%M%S') + to_milliseconds(CAST(substr(id, 15, 3) AS INTEGER)), '%Y-%m-%d %H:%M:%S.%g') END AS ts
FROM t""")
def i2(spark, sf):
    e = table(spark, sf, "events")
    n = F.col("event_id")
    ms = F.lpad((n % 1000).cast("string"), 3, "0")
    raw = (F.when(n % 5 == 0, s.item_id_of("ts")).when(n % 5 == 1, "20240230000000000")
           .when(n % 5 == 2, F.date_format("ts", "yyyyMMddHHmmss"))
           .when(n % 5 == 3, F.concat(F.lit("2024010"), n % 10, F.lit("246000000")))
           .otherwise(F.concat(F.date_format("ts", "yyyy"), F.lit("0101000059"), ms)))
    t = e.select("event_id", raw.alias("id"))
    return t.select("event_id", F.date_format(s.ts_of_item_id("id"), "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))


@query("I4_legacy_ids", """
SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d%H%M%S') AS legacy_id,
  strftime(date_trunc('second', ts) + to_microseconds(CAST(rpad(CAST(event_id % 1000 AS VARCHAR), 6, '0') AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS back
FROM events""")
def i4(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    lid = s.legacy_id_of("t", "Asia/Taipei")
    long = F.concat(lid, F.col("event_id") % 1000)
    return e.select("event_id", lid.alias("legacy_id"),
                    F.date_format(s.ts_of_legacy_id(long, "Asia/Taipei"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("back"))


@query("I5_js_millis_ids", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE strftime(make_timestamp(1700000000000000 + event_id * 86400123000 % 9000000000000000), '%Y%m%d%H%M%S%g') END AS id
FROM events""")
def i5(spark, sf):
    e = table(spark, sf, "events")
    n = F.col("event_id")
    ms = (F.lit(1700000000000) + n * 86400123 % 9000000000000).cast("string")
    raw = F.when(n % 7 == 0, F.concat(F.lit("x"), n)).otherwise(ms)
    return e.select("event_id", s.item_id_of_js_millis(raw).alias("id"))


@query("I6_infer_dates", ctes("items", "files") + """
SELECT i.book_id, i.item_id, coalesce(strftime(f.mtime, '%Y%m%d%H%M%S%g'), nullif(i.modify, '')) AS create_guess,
  coalesce(strftime(f.mtime, '%Y%m%d%H%M%S%g'), nullif(i.create, '')) AS modify_guess
FROM items i LEFT JOIN files f ON f.book_id = i.book_id AND f.path = i.index""")
def i6(spark, sf):
    f = fx.files(spark, sf).select("book_id", F.col("path").alias("index"), "mtime")
    it = fx.items(spark, sf).join(f, ["book_id", "index"], "left")
    return it.select("book_id", "item_id", s.infer_create("item_id", "mtime", "modify").alias("create_guess"),
                     s.infer_modify("mtime", "create").alias("modify_guess"))


@query("I7_infer_title", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'page ' || doc_id || '+x.html' WHEN 1 THEN NULL ELSE NULL END AS title FROM documents""")
def i7(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    url = (F.when(n % 3 == 0, F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/page%20"), n, F.lit("+x.html?q=1#f")))
           .when(n % 3 == 1, F.concat(F.lit("https://h/"), n, F.lit("/"))).otherwise(F.concat(F.lit("/a/"), n, F.lit(".html"))))
    return d.select("doc_id", s.infer_title(url).alias("title"))


@query("I8_safe_filename", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN substr(text, 1, 30) || ': a/b?' WHEN 1 THEN '  .' || substr(text, 1, 12) || '. .'
  WHEN 2 THEN 'con' WHEN 3 THEN 'Lpt1.txt' WHEN 4 THEN chr(1) || chr(127) ELSE chr(10) || substr(text, 20, 25) || chr(9) || '|"<>*' END AS n FROM documents),
a AS (SELECT doc_id, regexp_replace(n, '[\t\n\f\r]+', ' ', 'g') AS n FROM t),
b AS (SELECT doc_id, regexp_replace(n, '[\x{00}-\x{1F}\x{7F}-\x{9F}]+', '', 'g') AS n FROM a),
c AS (SELECT doc_id, regexp_replace(n, '[:"?*\\/|<>]', '_', 'g') AS n FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(n, '^ +', ''), '[. ]+$', ''), '^\.', '_.') AS n FROM c)
SELECT doc_id, coalesce(nullif(regexp_replace(n, '(?i)^(CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])((?:\..+)?)$', '\1_\2'), ''), '_') AS name FROM d""")
def i8(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id") % 6
    raw = (F.when(n == 0, F.concat(F.substring("text", 1, 30), F.lit(": a/b?")))
           .when(n == 1, F.concat(F.lit("  ."), F.substring("text", 1, 12), F.lit(". .")))
           .when(n == 2, "con").when(n == 3, "Lpt1.txt").when(n == 4, "\x01\x7f")
           .otherwise(F.concat(F.lit("\n"), F.substring("text", 20, 25), F.lit('\t|"<>*'))))
    return d.select("doc_id", s.safe_filename(raw).alias("name"))


@query("I9_crop", """
SELECT doc_id, CASE WHEN length(text) > 70 THEN substr(text, 1, 67) || '...' ELSE text END AS cropped FROM documents""")
def i9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", s.cropped("text", 70).alias("cropped"))


@query("I10_templates", ctes("items") + """
SELECT book_id, item_id,
  '100% ' || item_id || ' ' || coalesce(CASE WHEN "create" <> '' THEN substr("create", 1, 4) || '-' || substr("create", 5, 2) || '-' || substr("create", 7, 2) ELSE '' END, '')
    || '_' || coalesce(CASE WHEN "create" <> '' THEN '00' || substr("create", 9, 2) || '-' || substr("create", 11, 2) || '-' || substr("create", 13, 2) ELSE '' END, '') || '-' AS name
FROM items""")
def i10(spark, sf):
    it = fx.items(spark, sf)
    name = s.import_filename("100%% %ID% %CREATE:UTC_DATE%_%CREATE:TIME%-%NOPE%", "item_id", "item_id", "title", "source",
                             "create", "modify", F.lit("20240101000000000"))
    return it.select("book_id", "item_id", name.alias("name"))


@query("I11_human_size", """
WITH t AS (SELECT doc_id, n_chars * (1 + doc_id % 5 * 997) AS n FROM documents),
u AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS e FROM t)
SELECT doc_id, CASE WHEN e >= 1 AND n / pow(1024, e) < 10 THEN printf('%.1f', n / pow(1024, e)) ELSE printf('%.0f', n / pow(1024, e)) END
  || ' ' || ['B', 'KB', 'MB', 'GB'][e + 1] AS size FROM u""")
def i11(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", s.human_size(F.col("n_chars") * (F.lit(1) + F.col("doc_id") % 5 * 997)).alias("size"))


@query("I12_relative_url", ctes("items") + """, p AS (SELECT book_id, item_id, index, CASE WHEN index <> '' THEN index ELSE 'x y/' || title END AS page FROM items)
SELECT book_id, item_id, '../../data/' || replace(url_encode(page), '%2F', '/') AS from_tree,
  CASE WHEN contains(page, '/') THEN '../../tree/favicon/' ELSE '../tree/favicon/' END AS to_icons FROM p""")
def i12(spark, sf):
    it = fx.items(spark, sf)
    page = F.concat(F.lit("data/"), F.when(F.col("index") != "", F.col("index")).otherwise(F.concat(F.lit("x y/"), F.col("title"))))
    return it.select("book_id", "item_id", s.relative_url(page, F.lit("tree/sub"), path_is_dir=False).alias("from_tree"),
                     s.relative_url(F.lit("tree/favicon"), page, start_is_dir=False).alias("to_icons"))


@query("I13_sha1", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def i13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("sha1"))


@query("I14_postit_text", """
SELECT doc_id, replace(replace(text, chr(13), ''), '<', '') || ' & <b>' AS note, split_part(replace(replace(text, chr(13), ''), '<', '') || ' & <b>', chr(10), 1) AS title FROM documents""")
def i14(spark, sf):
    d = table(spark, sf, "documents")
    body = F.concat(F.replace(F.replace(F.col("text"), F.lit("\r"), F.lit("")), F.lit("<"), F.lit("")), F.lit(" & <b>"))
    page = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"UTF-8\"></head><body><pre>\n"), s.escape_html(body), F.lit("\n</pre></body></html>"))
    note = s.postit_text(page)
    return d.select("doc_id", note.alias("note"), s.postit_title(note).alias("title"))


@query("I15_html_escape", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def i15(spark, sf):
    return table(spark, sf, "pages").select("page_id", s.escape_html("html").alias("escaped"))


@query("I19_squeeze", r"""
SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS squeezed FROM documents""")
def i19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", s.squeeze("text").alias("squeezed"))


@query("I21_icon_file", ctes("items") + """
SELECT book_id, item_id, CASE WHEN icon LIKE '../tree/%' THEN CASE WHEN index LIKE '%/index.html' THEN 'data/' || substr(icon, 4) ELSE substr(icon, 4) END
  WHEN icon = 'favicon.ico' THEN CASE WHEN index LIKE '%/index.html' THEN 'data/' || item_id || '/favicon.ico' ELSE 'data/favicon.ico' END END AS file FROM items""")
def i21(spark, sf):
    return fx.items(spark, sf).select("book_id", "item_id", s.icon_file("icon", "index").alias("file"))


@query("I22_json_round_trip", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS doc FROM events""")
def i22(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("doc"))


MIMES = """mimes(ext, mime) AS (VALUES ('.html', 'text/html'), ('.htm', 'text/html'), ('.htz', 'application/html+zip'),
  ('.maff', 'application/x-maff'), ('.png', 'image/png'))"""


@query("B18_mime_predicates", ctes("items", "files") + ", " + MIMES + r"""
SELECT f.book_id, f.path, m.mime, coalesce(m.mime = 'text/html', false) AS html, coalesce(m.mime IN ('application/html+zip', 'application/x-maff'), false) AS archive,
  coalesce(m.mime LIKE 'text/%', false) AS compressible
FROM files f LEFT JOIN mimes m ON m.ext = lower(regexp_extract(f.path, '(\.[^./]*)$', 1))""")
def b18(spark, sf):
    f = with_mime(fx.files(spark, sf).select("book_id", "path"), "path")
    return f.select("book_id", "path", "mime", is_html("mime").alias("html"), is_archive("mime").alias("archive"),
                    is_compressible("mime").alias("compressible"))
