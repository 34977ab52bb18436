"""Search, its predicates and joins, sorts, limits, snippets and worklists."""

from pyspark.sql import functions as F

from ..functions.snippets import crop_at_first_hit, hit_count, mark_single, snippet
from ..operators import index as ix
from ..operators import search as se
from ..operators.search import Rule, SearchSpec, Term
from ..operators.transfer import union_books
from ..sources.sinks import feed_rows
from . import fixtures as fx
from .fixtures import ctes, table
from .registry import query

# every item row with its page texts, the shape predicates work on
HITS = "hits AS (SELECT i.*, coalesce(f.path, '') AS path, coalesce(f.content, '') AS content FROM items i LEFT JOIN fulltext f USING (book_id, item_id))"
PICK = "SELECT book_id, item_id, path FROM hits WHERE "


def hits(spark, sf):
    return se.with_text(fx.items(spark, sf), fx.fulltext(spark, sf))


def pick(spark, sf, **rules):
    default = rules.pop("default_fields", ("title", "comment", "content"))
    named = {(None if k == "any_" else k): v for k, v in rules.items()}
    spec = SearchSpec(rules=named, default_fields=default)
    return hits(spark, sf).filter(spec.to_column()).select("book_id", "item_id", "path")


def hsql(where):
    return ctes("items", "fulltext") + ", " + HITS + PICK + where


@query("B1_predicate_builder", hsql("""
  contains(lower(title), 'e') AND NOT contains(lower(title), 'zz') AND type IN ('note', 'postit')
  AND (contains(lower(comment), 'an') OR contains(lower(content), 'an')) AND marked"""))
def b1(spark, sf):
    return pick(spark, sf, title=Rule([Term("e")], [Term("zz")]), type=Rule([Term("note", whole=True), Term("postit", whole=True)]),
                any_=Rule([Term("an")]), marked=Rule([True]), default_fields=("comment", "content"))


@query("B2_term_modes", hsql(r"""
  contains(content, 'Th') AND regexp_matches(content, '(?im)^the .*on') AND NOT contains(lower(content), 'a.b') AND lower(item_id) <> 'd7'"""))
def b2(spark, sf):
    return pick(spark, sf, content=Rule([Term("Th", match_case=True), Term("^the .*on", regex=True)], [Term("a.b")]),
                id=Rule([], [Term("d7", whole=True)]))


@query("B3_text_and", hsql("contains(lower(content), 'the') AND contains(lower(content), 'on') AND NOT contains(lower(title), 'the') AND contains(source, 'src1')"))
def b3(spark, sf):
    return pick(spark, sf, content=Rule([Term("the"), Term("on")]), title=Rule([], [Term("the")]), source=Rule([Term("src1")]))


@query("B4_text_or", hsql("type IN ('note', 'bookmark') AND lower(item_id) NOT IN ('d3', 'd13')"))
def b4(spark, sf):
    return pick(spark, sf, type=Rule([Term("NOTE", whole=True), Term("bookmark", whole=True)]),
                id=Rule([], [Term("D3", whole=True), Term("d13", whole=True)]))


@query("B5_default_fields", hsql("""
  (contains(lower(title), 'en') AND NOT contains(lower(title), 'the')) OR (contains(lower(content), 'en') AND NOT contains(lower(content), 'the'))"""))
def b5(spark, sf):
    return pick(spark, sf, any_=Rule([Term("en")], [Term("the")]), default_fields=("title", "content"))


@query("B7_date_ranges", ctes("items") + """
SELECT book_id, item_id FROM items WHERE "create" <> '' AND modify <> ''
  AND ("create" BETWEEN '20240103000000000' AND '20240110000000000' OR "create" BETWEEN '20240120000000000' AND '99999999999999999')
  AND NOT modify BETWEEN '20240105000000000' AND '20240106000000000'""")
def b7(spark, sf):
    spec = SearchSpec(rules={
        "create": Rule([("20240103000000000", "20240110000000000"), ("20240120000000000", "9" * 17)]),
        "modify": Rule([], [("20240105000000000", "20240106000000000")])})
    return fx.items(spark, sf).filter(spec.item_predicate()).select("book_id", "item_id")


RANGES = """r0 AS (SELECT r_regionkey AS k, CASE r_regionkey WHEN 0 THEN '' WHEN 1 THEN '20240105' WHEN 2 THEN '202400' WHEN 3 THEN '2023133199' ELSE '20240110123456789' END AS since,
    CASE r_regionkey WHEN 0 THEN '2024010212' WHEN 1 THEN '202401' WHEN 2 THEN '20240108' WHEN 3 THEN '' ELSE '20240120' END AS until FROM region),
  p AS (SELECT k, side, txt, rpad(txt, 17, '0') AS t FROM (SELECT k, 0 AS side, since AS txt FROM r0 UNION ALL SELECT k, 1, until FROM r0)),
  q AS (SELECT *, CAST(substr(t, 1, 4) AS INT) AS y, greatest(CAST(substr(t, 5, 2) AS INT), 1) AS m, greatest(CAST(substr(t, 7, 2) AS INT), 1) AS d FROM p),
  b AS (SELECT k, side, CASE WHEN txt = '' THEN CASE side WHEN 0 THEN '00000000000000000' ELSE '99999999999999999' END
    ELSE strftime(make_timestamp(CASE WHEN m > 12 THEN y + m // 12 ELSE y END, CASE WHEN m > 12 THEN m % 12 ELSE m END, 1, 0, 0, 0) + to_days(d - 1)
      + to_hours(CAST(substr(t, 9, 2) AS INT)) + to_minutes(CAST(substr(t, 11, 2) AS INT)) + to_seconds(CAST(substr(t, 13, 2) AS INT))
      + to_milliseconds(CAST(substr(t, 15, 3) AS INT)), '%Y%m%d%H%M%S%g') END AS v FROM q),
  ranges AS (SELECT a.k, a.v AS lo, z.v AS hi FROM b a JOIN b z ON a.k = z.k AND a.side = 0 AND z.side = 1)"""


@query("B8_date_range_join", ctes("items") + ", " + RANGES + """
SELECT i.book_id, i.item_id, CAST(r.k AS BIGINT) AS k, r.lo, r.hi FROM items i JOIN ranges r ON i."create" <> '' AND i."create" BETWEEN r.lo AND r.hi""")
def b8(spark, sf):
    k = F.col("r_regionkey")
    since = F.when(k == 0, "").when(k == 1, "20240105").when(k == 2, "202400").when(k == 3, "2023133199").otherwise("20240110123456789")
    until = F.when(k == 0, "2024010212").when(k == 1, "202401").when(k == 2, "20240108").when(k == 3, "").otherwise("20240120")
    raw = table(spark, sf, "region").select(k.cast("long").alias("k"), since.alias("since"), until.alias("until"))
    return se.match_date_ranges(fx.items(spark, sf), se.date_ranges(raw)).select("book_id", "item_id", "k", "lo", "hi")


@query("B9_flags", ctes("items") + "SELECT book_id, item_id FROM items WHERE marked AND NOT locked AND location = ''")
def b9(spark, sf):
    spec = SearchSpec(rules={"marked": Rule([True]), "locked": Rule([], [True]), "location": Rule([], [True])})
    return fx.items(spark, sf).filter(spec.item_predicate()).select("book_id", "item_id")


@query("B10_conjunction", hsql("charset = 'utf-8' AND contains(lower(index), 'html') AND icon <> '' AND contains(lower(content), 'an') AND \"create\" BETWEEN '20240101000000000' AND '20240125000000000'"))
def b10(spark, sf):
    return pick(spark, sf, charset=Rule([Term("UTF-8")]), index=Rule([Term("html")]), icon=Rule([Term(".", regex=True)]),
                content=Rule([Term("an")]), create=Rule([("20240101000000000", "20240125000000000")]))


@query("B11_book_selection", ctes("items") + """
SELECT book_id, item_id, CAST(CASE book_id WHEN 'fr' THEN 1 ELSE 3 END AS BIGINT) AS book_ord FROM items WHERE book_id IN ('fr', 'de')""")
def b11(spark, sf):
    spec = SearchSpec(books=("fr", "en", "de", "xx"), books_exclude=("en",))
    return se.select_books(fx.items(spark, sf), spec).select("book_id", "item_id", "book_ord")


@query("B12_root_selection", ctes("edges") + """
SELECT DISTINCT book_id, child_id AS item_id FROM edges WHERE parent_id IN ('hidden', 'S1', 'S2')
  AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.book_id = edges.book_id AND x.parent_id = 'root' AND x.child_id = edges.child_id)
UNION SELECT DISTINCT book_id, r FROM edges, (VALUES ('hidden')) v(r)""")
def b12(spark, sf):
    # everything under hidden, S1 and S2 that is not also listed directly under the root
    e = fx.edges(spark, sf)
    direct = e.filter("parent_id = 'root'").select("book_id", F.col("child_id").alias("item_id")).distinct()
    spec = SearchSpec(roots=("hidden", "S1", "S2"))
    return se.in_scope(e, spec, with_order=False).join(direct, ["book_id", "item_id"], "left_anti").select("book_id", "item_id")


FULL_SQL = ctes("items", "edges", "fulltext") + """,
scope AS (SELECT book_id, id AS item_id, min(addr) AS addr FROM (
  SELECT e.book_id, e.child_id AS id, [CAST(0 AS BIGINT), e.pos] AS addr FROM edges e WHERE e.parent_id = 'root'
  UNION ALL SELECT c.book_id, c.child_id, [0, p.pos, c.pos] FROM edges p JOIN edges c ON p.book_id = c.book_id AND p.parent_id = 'root' AND c.parent_id = p.child_id) GROUP BY 1, 2),
hits AS (SELECT i.*, s.addr, coalesce(f.path, '') AS path, coalesce(f.content, '') AS content FROM items i JOIN scope s USING (book_id, item_id)
  LEFT JOIN fulltext f USING (book_id, item_id))
"""


@query("B13_full_search", FULL_SQL + r""", top AS (
SELECT * FROM hits WHERE contains(lower(content), 'the') AND NOT contains(lower(title), 'zz') AND type IN ('note', 'postit') AND "create" BETWEEN '20240101000000000' AND '20240229000000000'
ORDER BY book_id, title, addr, path LIMIT 20),
cut AS (SELECT *, substr(content, greatest(CAST(floor(instr(lower(content), 'the') - 1 - 20) AS INT), 0) + 1) AS c FROM top),
crop AS (SELECT *, CASE WHEN length(c) > 80 THEN substr(c, 1, 79) ELSE c END AS k, CASE WHEN length(c) > 80 THEN '…' ELSE '' END AS ell FROM cut)
SELECT book_id, item_id, path, title, regexp_replace(replace(replace(replace(replace(replace(k, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
  '(?i)the', '<mark class="kw0">\0</mark>', 'g') || ell AS snippet FROM crop""")
def b13(spark, sf):
    spec = SearchSpec(
        rules={"content": Rule([Term("the")]), "title": Rule([], [Term("zz")]),
               "type": Rule([Term("note", whole=True), Term("postit", whole=True)]),
               "create": Rule([("20240101000000000", "20240229000000000")])},
        sorts=(("title", False),), limit=20)
    out = se.search(fx.items(spark, sf), fx.edges(spark, sf), fx.fulltext(spark, sf), spec, context={"fulltext": 80})
    return out.select("book_id", "item_id", "path", "title", F.col("snip_fulltext").alias("snippet"))


@query("B15_feed_eligible", ctes("items") + """
SELECT book_id, item_id FROM items WHERE type NOT IN ('folder', 'separator') AND ((type <> 'bookmark' AND index <> '') OR (type = 'bookmark' AND source <> ''))""")
def b15(spark, sf):
    return fx.items(spark, sf).filter(se.feed_eligible()).select("book_id", "item_id")


FORMAT = """CASE WHEN index = '' THEN NULL WHEN index LIKE '%/index.html' THEN 'folder' WHEN index LIKE '%.htz' THEN 'htz' WHEN index LIKE '%.maff' THEN 'maff' ELSE 'single_file' END"""


@query("B16_conversion_worklist", ctes("items") + f"SELECT book_id, item_id, {FORMAT} AS format FROM items WHERE type IN ('', 'note') AND {FORMAT} <> 'htz'")
def b16(spark, sf):
    return se.conversion_worklist(fx.items(spark, sf), ["", "note"], "htz").select("book_id", "item_id", "format")


@query("B17_subset_filter", ctes("items", "files") + """
, want AS (SELECT DISTINCT split_part(path, '/', 1) AS p FROM files WHERE size % 3 = 0)
SELECT DISTINCT f.book_id, f.path FROM files f JOIN want w ON f.path = w.p OR starts_with(f.path, w.p || '/')""")
def b17(spark, sf):
    f = fx.files(spark, sf)
    want = f.filter("size % 3 = 0").select(F.substring_index("path", "/", 1).alias("prefix")).distinct()
    return se.under_any(f.select("book_id", "path").distinct(), want)


@query("C1_items_left_text", ctes("items", "fulltext") + """
SELECT i.book_id, i.item_id, coalesce(f.path, '') AS path, length(f.content) AS n_chars FROM items i LEFT JOIN fulltext f USING (book_id, item_id)""")
def c1(spark, sf):
    return hits(spark, sf).select("book_id", "item_id", "path", F.length("content").cast("long").alias("n_chars"))


@query("C2_reachable_items", ctes("items", "edges", recursive=True) + """, walk AS (
  SELECT DISTINCT book_id, 'root' AS id FROM edges UNION SELECT e.book_id, e.child_id FROM walk w JOIN edges e ON e.book_id = w.book_id AND e.parent_id = w.id)
SELECT i.book_id, i.item_id, i.title FROM items i JOIN walk w ON i.book_id = w.book_id AND i.item_id = w.id""")
def c2(spark, sf):
    scope = se.in_scope(fx.edges(spark, sf), SearchSpec(), with_order=False)
    return fx.items(spark, sf).join(scope, ["book_id", "item_id"]).select("book_id", "item_id", "title")


@query("C3_scope_minus_excluded", ctes("edges", recursive=True) + """,
a AS (SELECT DISTINCT book_id, 'root' AS id FROM edges UNION SELECT e.book_id, e.child_id FROM a w JOIN edges e ON e.book_id = w.book_id AND e.parent_id = w.id),
b AS (SELECT DISTINCT book_id, v.r AS id FROM edges, (VALUES ('S3'), ('S4')) v(r) UNION SELECT e.book_id, e.child_id FROM b w JOIN edges e ON e.book_id = w.book_id AND e.parent_id = w.id)
SELECT book_id, id AS item_id FROM a EXCEPT SELECT book_id, id FROM b""")
def c3(spark, sf):
    return se.in_scope(fx.edges(spark, sf), SearchSpec(roots_exclude=("S3", "S4")), with_order=False).select("book_id", "item_id")


@query("G1_stable_multi_sort", FULL_SQL + """
SELECT book_id, item_id, path, row_number() OVER (ORDER BY CASE book_id WHEN 'fr' THEN 1 WHEN 'es' THEN 2 WHEN 'en' THEN 3 ELSE 4 END, modify DESC, title, addr, path) AS n FROM hits""")
def g1(spark, sf):
    from ..scale import rank_rows
    spec = SearchSpec(books=("fr", "es", "en", "de"), sorts=(("title", False), ("modify", True)))
    out = se.search(fx.items(spark, sf), fx.edges(spark, sf), fx.fulltext(spark, sf), spec)
    ranked = rank_rows(out.drop("content"), [], se.sort_columns(spec), "n")
    return ranked.select("book_id", "item_id", "path", (F.col("n") + 1).alias("n"))


@query("G2_limit_over_books", FULL_SQL + "SELECT book_id, item_id, path FROM hits WHERE contains(lower(content), 'en') ORDER BY book_id, addr, path LIMIT 25")
def g2(spark, sf):
    spec = SearchSpec(rules={"content": Rule([Term("EN")])}, limit=25)
    return se.search(fx.items(spark, sf), fx.edges(spark, sf), fx.fulltext(spark, sf), spec).select("book_id", "item_id", "path")


ELIGIBLE = "type NOT IN ('folder', 'separator') AND ((type <> 'bookmark' AND index <> '') OR (type = 'bookmark' AND source <> ''))"


@query("G3_latest_k", ctes("items") + f"SELECT book_id, item_id, modify AS updated_id FROM items WHERE {ELIGIBLE} ORDER BY modify DESC, ord DESC LIMIT 50")
def g3(spark, sf):
    return se.feed_entries(fx.items(spark, sf), 50).select("book_id", "item_id", "updated_id")


@query("G3_latest_k_per_book", ctes("items") + f"""
SELECT book_id, item_id, updated_id, n AS rank FROM (SELECT book_id, item_id, modify AS updated_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY modify DESC, ord DESC) AS BIGINT) AS n
  FROM items WHERE {ELIGIBLE}) WHERE n <= 20""")
def g3b(spark, sf):
    return se.feed_entries(fx.items(spark, sf), 20, per_book=True).select("book_id", "item_id", "updated_id", F.col("rank").cast("long").alias("rank"))


@query("G5_path_order", ctes("items", "files") + "SELECT book_id, path, row_number() OVER (PARTITION BY book_id ORDER BY path) - 1 AS n FROM (SELECT DISTINCT book_id, path FROM files)")
def g5(spark, sf):
    from ..scale import rank_rows
    return rank_rows(fx.files(spark, sf).select("book_id", "path").distinct(), ["book_id"], ["path"], "n")


@query("A17_feed", ctes("items") + f"""
SELECT book_id, item_id, 'urn:feed:site.example.com/books:' || item_id AS entry_id,
  CASE WHEN type = 'bookmark' THEN source ELSE 'https://site.example.com/books/data/' || index END AS link, title,
  coalesce(strftime(try_strptime(nullif(substr("create", 1, 14), ''), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%SZ'), '1970-01-01T00:00:00Z') AS published,
  coalesce(strftime(try_strptime(nullif(substr(modify, 1, 14), ''), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%SZ'), '1970-01-01T00:00:00Z') AS updated
FROM items WHERE {ELIGIBLE} ORDER BY modify DESC, ord DESC LIMIT 50""")
def a17(spark, sf):
    return feed_rows(fx.items(spark, sf), "https://site.example.com/books", "urn:feed").drop("ord")


@query("A21_result_lines", hsql("contains(lower(content), 'the')").replace("SELECT book_id, item_id, path FROM hits",
       "SELECT book_id, '{\"item_id\":\"' || item_id || '\",\"path\":\"' || path || '\",\"type\":\"' || type || '\"}' AS line FROM hits"))
def a21(spark, sf):
    spec = SearchSpec(rules={"content": Rule([Term("the")])})
    return se.result_lines(hits(spark, sf).filter(spec.to_column()), ["item_id", "path", "type"])


@query("I16_snippet_crop", r"""
WITH t AS (SELECT doc_id, text, least(CASE WHEN instr(lower(text), 'the') > 0 THEN instr(lower(text), 'the') - 1 END, CASE WHEN instr(lower(text), 'que') > 0 THEN instr(lower(text), 'que') - 1 END) AS hit FROM documents),
c AS (SELECT doc_id, CASE WHEN hit IS NULL THEN text ELSE substr(text, CAST(greatest(floor(hit - 25.0), 0) AS INT) + 1) END AS c FROM t)
SELECT doc_id, CASE WHEN length(c) > 100 THEN substr(c, 1, 99) || '…' ELSE c END AS snippet FROM c""")
def i16(spark, sf):
    pats = [Term("the").java(), Term("que").java()]
    return table(spark, sf, "documents").select("doc_id", crop_at_first_hit(F.col("text"), pats, 100).alias("snippet"))


@query("I17_highlight_single", r"""
SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(?i)on', '<mark class="kw0">\0</mark>', 'g') AS marked FROM documents""")
def i17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mark_single(F.col("text"), Term("on").java()).alias("marked"))


@query("I17_highlight_many")
def i17b(spark, sf):
    terms = [Term("the"), Term("th"), Term("e[nr]", regex=True)]
    return table(spark, sf, "documents").select("doc_id", snippet(F.col("text"), terms, 160).alias("marked"))


@query("D7_ordered_distinct", """
SELECT user_id, CAST(row_number() OVER (ORDER BY first_id) - 1 AS BIGINT) AS n FROM (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY 1)""")
def d7(spark, sf):
    from ..scale import rank_rows
    firsts = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    return rank_rows(firsts, [], ["first_id"], "n").select("user_id", "n")


@query("D9_hit_counts", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)the')) + len(regexp_extract_all(text, '(?i)on')) AS BIGINT) AS hits FROM documents""")
def d9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hit_count(F.col("text"), [Term("the").java(), Term("on").java()]).alias("hits"))


@query("D10_format_census", ctes("items") + f"SELECT book_id, type, charset, coalesce({FORMAT}, 'none') AS format, count(*) AS n FROM items GROUP BY 1, 2, 3, 4")
def d10(spark, sf):
    it = fx.items(spark, sf).withColumn("format", F.coalesce(se.index_format(), F.lit("none")))
    return it.groupBy("book_id", "type", "charset", "format").agg(F.count(F.lit(1)).alias("n"))


@query("K1_union_books", """
SELECT 'D' || doc_id AS item_id, 0 AS book_ord FROM documents UNION ALL SELECT 'P' || page_id, 1 FROM pages UNION ALL SELECT DISTINCT 'V' || conv_id, 2 FROM conversations""")
def k1(spark, sf):
    def ids(name, letter, col):
        return table(spark, sf, name).select(F.concat(F.lit(letter), F.col(col)).alias("item_id"))
    return union_books(ids("documents", "D", "doc_id"), ids("pages", "P", "page_id"), ids("conversations", "V", "conv_id").distinct())


@query("K2_id_pool", ctes("items", "fulltext") + """
SELECT book_id, item_id, CAST(min(src) AS BIGINT) AS src FROM (SELECT book_id, item_id, 0 AS src FROM items WHERE ord % 11 <> 0 UNION ALL SELECT book_id, item_id, 1 FROM fulltext) GROUP BY 1, 2""")
def k2(spark, sf):
    pool = ix.id_pool(fx.items(spark, sf).filter("ord % 11 <> 0"), fx.fulltext(spark, sf))
    return pool.select("book_id", "item_id", F.col("src").cast("long").alias("src"))
