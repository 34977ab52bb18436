"""Integrity findings, totals and repairs."""

from pyspark.sql import functions as F

from ..operators import check as ck
from . import fixtures as fx
from .fixtures import ctes, table
from .registry import query

# damaged tree: every 11th item gone, two lists of unknown owners, references to special ids
BAD_SQL = """, bad_items AS (SELECT * FROM items WHERE ord % 11 <> 3),
bad_edges AS (SELECT * FROM edges WHERE NOT (pos % 13 = 5 AND child_id LIKE 'D%')
  UNION ALL SELECT book_id, 'ghost' || (pos % 2), pos, child_id FROM edges WHERE pos % 40 = 7 AND child_id LIKE 'D%'
  UNION ALL SELECT book_id, parent_id, pos + 5000000, 'hidden' FROM edges WHERE pos % 100 = 9 AND child_id LIKE 'D%')"""


def bad_items(spark, sf):
    return fx.items(spark, sf).filter("ord % 11 <> 3")


def bad_edges(spark, sf):
    e = fx.edges(spark, sf)
    doc = F.col("child_id").like("D%")
    return (e.filter(~((F.col("pos") % 13 == 5) & doc))
            .unionByName(e.filter((F.col("pos") % 40 == 7) & doc).withColumn("parent_id", F.concat(F.lit("ghost"), F.col("pos") % 2)))
            .unionByName(e.filter((F.col("pos") % 100 == 9) & doc).withColumn("pos", F.col("pos") + 5000000).withColumn("child_id", F.lit("hidden"))))


def show(df):
    return df.select("book_id", "item_id", "path", "severity", "code")


C4_SQL = """SELECT book_id, item_id, index AS path, 'error' AS severity, 'missing_index_file' AS code FROM bad_items i WHERE index <> '' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.book_id = i.book_id AND f.path = i.index)
UNION ALL SELECT book_id, item_id, NULL, 'error', 'missing_index' FROM bad_items WHERE index = '' AND type NOT IN ('folder', 'separator', 'bookmark')
UNION ALL SELECT book_id, item_id, index, 'warn', 'unexpected_index' FROM bad_items WHERE index <> '' AND type IN ('folder', 'separator')
UNION ALL SELECT book_id, item_id, index, 'warn', 'bookmark_index' FROM bad_items WHERE index <> '' AND type = 'bookmark' AND lower(index) NOT LIKE '%.htm'"""
ODD_SQL = """, odd AS (SELECT * REPLACE (CASE WHEN ord % 6 = 0 AND ord >= 0 THEN CASE WHEN index = '' THEN item_id || '.htz' ELSE '' END ELSE index END AS index) FROM items)"""


def odd_items(spark, sf):
    flip = (F.col("ord") % 6 == 0) & (F.col("ord") >= 0)
    return fx.items(spark, sf).withColumn("index", F.when(flip, F.when(F.col("index") == "", F.concat("item_id", F.lit(".htz"))).otherwise("")).otherwise(F.col("index")))


@query("C4_missing_index_file", ctes("items", "files") + ODD_SQL + C4_SQL.replace("bad_items", "odd"))
def c4(spark, sf):
    return show(ck.check_index(odd_items(spark, sf), fx.files(spark, sf)))


@query("C5_invalid_toc_owner", ctes("items", "edges") + BAD_SQL + """
SELECT DISTINCT book_id, parent_id AS item_id, CAST(NULL AS VARCHAR) AS path, 'error' AS severity, 'invalid_toc_owner' AS code FROM bad_edges e
WHERE parent_id NOT IN ('root', 'hidden', 'recycle') AND NOT EXISTS (SELECT 1 FROM bad_items i WHERE i.book_id = e.book_id AND i.item_id = e.parent_id)""")
def c5(spark, sf):
    return show(ck.check_toc_owners(bad_items(spark, sf), bad_edges(spark, sf)))


C6_SQL = """SELECT book_id, child_id AS item_id, parent_id AS path, 'error' AS severity, 'special_toc_reference' AS code FROM bad_edges WHERE child_id IN ('root', 'hidden', 'recycle')
UNION ALL SELECT book_id, child_id, parent_id, 'error', 'invalid_toc_reference' FROM bad_edges e WHERE child_id NOT IN ('root', 'hidden', 'recycle')
  AND NOT EXISTS (SELECT 1 FROM bad_items i WHERE i.book_id = e.book_id AND i.item_id = e.child_id)"""


@query("C6_invalid_toc_reference", ctes("items", "edges") + BAD_SQL + C6_SQL)
def c6(spark, sf):
    return show(ck.check_toc_references(bad_items(spark, sf), bad_edges(spark, sf)))


C7_SQL = """SELECT book_id, item_id, CAST(NULL AS VARCHAR) AS path, 'error' AS severity, 'unlisted_item' AS code FROM bad_items i
WHERE NOT EXISTS (SELECT 1 FROM bad_edges e WHERE e.book_id = i.book_id AND e.child_id = i.item_id)"""


@query("C7_unlisted_items", ctes("items", "edges") + BAD_SQL + C7_SQL)
def c7(spark, sf):
    return show(ck.check_unlisted(bad_items(spark, sf), bad_edges(spark, sf)))


C8_CTES = r"""used AS (SELECT DISTINCT i.book_id, i.index AS path FROM {items} i JOIN files f ON f.book_id = i.book_id AND f.path = i.index WHERE i.index <> ''),
pages AS (SELECT DISTINCT book_id, path FROM files WHERE regexp_matches(lower(path), '\.(html|htz|maff|htm|xhtml|xht|svg)$') EXCEPT SELECT * FROM used),
shut AS (SELECT book_id, regexp_replace(path, '/index.html$', '') AS d FROM used WHERE path LIKE '%/index.html'
  UNION SELECT book_id, regexp_replace(path, '\.[^./]*$', '') || s FROM (SELECT * FROM pages UNION SELECT * FROM used WHERE path NOT LIKE '%/index.html'), (VALUES ('.files'), ('_files')) v(s) WHERE lower(path) LIKE '%.htm%'),
claim AS (SELECT book_id, path, regexp_replace(path, '/index.html$', '') AS d FROM pages WHERE path LIKE '%/index.html')"""
C8_SQL = r"""SELECT p.book_id, CAST(NULL AS VARCHAR) AS item_id, p.path, 'warn' AS severity, 'unindexed_file' AS code FROM pages p
WHERE NOT EXISTS (SELECT 1 FROM shut s WHERE s.book_id = p.book_id AND starts_with(p.path, s.d || '/'))
  AND NOT EXISTS (SELECT 1 FROM claim c WHERE c.book_id = p.book_id AND c.path <> p.path AND starts_with(p.path, c.d || '/'))"""


@query("C8_unindexed_files", ctes("items", "files") + ", " + C8_CTES.replace("{items}", "items") + " SELECT book_id, path, severity, code FROM (" + C8_SQL + ")")
def c8(spark, sf):
    return ck.check_unindexed(fx.items(spark, sf), fx.files(spark, sf)).select("book_id", "path", "severity", "code")


@query("C9_duplicate_index", ctes("items", "files") + """, twins AS (SELECT *, row_number() OVER (PARTITION BY book_id, index ORDER BY ord, item_id) AS k FROM (
  SELECT book_id, item_id, ord, CASE WHEN ord % 17 = 3 AND ord >= 0 THEN 'shared.html' ELSE index END AS index FROM items) WHERE index <> '')
SELECT book_id, item_id, index AS path, 'warn' AS severity, 'duplicate_index' AS code FROM twins WHERE k > 1""")
def c9(spark, sf):
    twin = (F.col("ord") % 17 == 3) & (F.col("ord") >= 0)
    it = fx.items(spark, sf).withColumn("index", F.when(twin, "shared.html").otherwise(F.col("index")))
    return show(ck.check_duplicate_index(it))


@query("C10_icon_urls", ctes("items") + """
SELECT book_id, item_id, icon AS path, CASE WHEN icon LIKE 'https:%' THEN 'warn' ELSE 'error' END AS severity,
  CASE WHEN icon LIKE 'https:%' THEN 'absolute_icon' WHEN icon LIKE '//%' THEN 'protocol_relative_icon' ELSE 'root_relative_icon' END AS code
FROM items WHERE icon LIKE 'https:%' OR icon LIKE '/%'""")
def c10(spark, sf):
    return show(ck.check_icon_urls(fx.items(spark, sf)))


ICON_CTES = """, ic AS (SELECT book_id, item_id, CASE WHEN icon LIKE '../tree/%' THEN CASE WHEN index LIKE '%/index.html' THEN 'data/' || substr(icon, 4) ELSE substr(icon, 4) END
  WHEN icon = 'favicon.ico' THEN CASE WHEN index LIKE '%/index.html' THEN 'data/' || replace(index, '/index.html', '/favicon.ico') ELSE 'data/favicon.ico' END END AS path FROM {items}),
have AS (SELECT DISTINCT lang AS book_id, 'tree/favicon/' || md5(source) || '.png' AS path FROM documents UNION SELECT lang, 'data/favicon.ico' FROM documents WHERE lang = 'en'
  UNION SELECT DISTINCT lang, 'tree/favicon/' || md5(CAST(doc_id AS VARCHAR)) || '.png' FROM documents WHERE doc_id % 40 = 0)"""
ICON_SQL = """SELECT book_id, item_id, path, 'error' AS severity, 'missing_icon_file' AS code FROM ic WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM have h WHERE h.book_id = ic.book_id AND h.path = ic.path)
UNION ALL SELECT book_id, NULL, path, 'warn', 'unused_icon' FROM have h WHERE path LIKE 'tree/favicon/%' AND NOT EXISTS (SELECT 1 FROM ic WHERE ic.book_id = h.book_id AND ic.path = h.path)"""


def icon_files(spark, sf):
    """A cached icon per source, one in forty that nobody uses, and a plain icon in one book."""
    d = table(spark, sf, "documents")

    def have(df, *path):
        return df.select(F.col("lang").alias("book_id"), F.concat(*path).alias("path")).distinct()
    png = F.lit(".png")
    return (have(d, F.lit("tree/favicon/"), F.md5("source"), png).unionByName(have(d.filter("lang = 'en'"), F.lit("data/favicon.ico")))
            .unionByName(have(d.filter("doc_id % 40 = 0"), F.lit("tree/favicon/"), F.md5(F.col("doc_id").cast("string")), png)))


@query("C10_icon_files", ctes("items") + ICON_CTES.replace("{items}", "items") + ICON_SQL)
def c10b(spark, sf):
    it, files = fx.items(spark, sf), icon_files(spark, sf)
    return show(ck.check_icon_files(it, files).unionByName(ck.check_unused_icons(it, files)))


M1_SQL = """SELECT book_id, item_id, CAST(NULL AS VARCHAR) AS path, 'error' AS severity, 'missing_create' AS code FROM {t} WHERE "create" = ''
UNION ALL SELECT book_id, item_id, NULL, 'error', 'missing_modify' FROM {t} WHERE modify = ''
UNION ALL SELECT book_id, item_id, NULL, 'error', 'invalid_id' FROM {t} WHERE item_id IN ('root', 'hidden', 'recycle')"""


@query("M1_invalid_meta", ctes("items") + ", named AS (SELECT * REPLACE (CASE WHEN ord = 4 THEN 'root' WHEN ord % 400 = 5 THEN 'recycle' ELSE item_id END AS item_id) FROM items) " + M1_SQL.format(t="named"))
def m1(spark, sf):
    it = fx.items(spark, sf).withColumn("item_id", F.when(F.col("ord") == 4, "root").when(F.col("ord") % 400 == 5, "recycle").otherwise(F.col("item_id")))
    return show(ck.check_meta(it))


M2_SQL = """SELECT i.book_id, i.item_id, i.index AS path, 'warn' AS severity, 'older_modify' AS code FROM bad_items i JOIN files f ON f.book_id = i.book_id AND f.path = i.index
WHERE i.modify <> '' AND strftime(f.mtime - INTERVAL 600 SECOND, '%Y%m%d%H%M%S%g') > i.modify"""


@query("M2_older_modify", ctes("items", "files") + M2_SQL.replace("bad_items", "items"))
def m2(spark, sf):
    return show(ck.check_older_modify(fx.items(spark, sf), fx.files(spark, sf)))


LISTS_SQL = """SELECT lang AS book_id, 'D' || doc_id AS item_id, CAST(NULL AS VARCHAR) AS path, 'warn' AS severity, 'empty_toc_list' AS code FROM documents
WHERE length(text) - length(replace(text, chr(10), '')) = 0"""


def toc_lists(spark, sf):
    """A document's lines but the first as its list of children."""
    parts = F.split("text", "\n")
    lines = F.slice(parts, F.lit(2), F.size(parts))
    return table(spark, sf, "documents").select(F.col("lang").alias("book_id"), F.concat(F.lit("D"), "doc_id").alias("parent_id"), lines.alias("children"))


@query("M3_empty_lists", LISTS_SQL)
def m3(spark, sf):
    return show(ck.check_empty_lists(toc_lists(spark, sf)))


def archive_health(spark, sf):
    """What a scan of the items' archives would tell."""
    k = F.col("ord")
    return fx.items(spark, sf).filter("index like '%.htz' or index like '%.maff'").select(
        "book_id", F.col("index").alias("path"), F.when(k % 20 == 9, "bad archive").alias("error"), (k % 3 != 0).alias("has_index"), (k % 8).cast("int").alias("n_pages"))


ARCHIVES_SQL = """SELECT b.book_id, b.item_id, b.index AS path, 'error' AS severity, CASE WHEN i.ord % 20 = 9 THEN 'corrupted_archive' WHEN b.index LIKE '%.htz' THEN 'missing_archive_index' ELSE 'no_archive_page' END AS code
FROM bad_items b JOIN items i ON i.book_id = b.book_id AND i.index = b.index WHERE b.index LIKE '%.htz' AND (i.ord % 20 = 9 OR i.ord % 3 = 0) OR b.index LIKE '%.maff' AND (i.ord % 20 = 9 OR i.ord % 8 = 0)"""


ALL_SQL = ("SELECT * FROM (" + C4_SQL + ") UNION ALL " + C6_SQL + " UNION ALL " + C7_SQL + " UNION ALL " + M1_SQL.format(t="bad_items") + " UNION ALL " + M2_SQL + """
UNION ALL SELECT DISTINCT book_id, parent_id, NULL, 'error', 'invalid_toc_owner' FROM bad_edges e
  WHERE parent_id NOT IN ('root', 'hidden', 'recycle') AND NOT EXISTS (SELECT 1 FROM bad_items i WHERE i.book_id = e.book_id AND i.item_id = e.parent_id)
UNION ALL SELECT book_id, item_id, icon, CASE WHEN icon LIKE 'https:%' THEN 'warn' ELSE 'error' END,
  CASE WHEN icon LIKE 'https:%' THEN 'absolute_icon' WHEN icon LIKE '//%' THEN 'protocol_relative_icon' ELSE 'root_relative_icon' END
  FROM bad_items WHERE icon LIKE 'https:%' OR icon LIKE '/%'""")


ALL_SQL += " UNION ALL " + C8_SQL + " UNION ALL " + LISTS_SQL + " UNION ALL " + ARCHIVES_SQL + " UNION ALL " + ICON_SQL
ALL_CTES = ctes("items", "edges", "files") + BAD_SQL + ", " + C8_CTES.replace("{items}", "bad_items") + ICON_CTES.replace("{items}", "bad_items")


def findings(spark, sf):
    """Every finding of the checks over items, tree, files, lists, archives and icons."""
    return ck.run_checks(bad_items(spark, sf), bad_edges(spark, sf), fx.files(spark, sf), toc_lists(spark, sf), archive_health(spark, sf), icon_files(spark, sf))


@query("L11_all_checks", ALL_CTES + " " + ALL_SQL)
def l11(spark, sf):
    return show(findings(spark, sf))


@query("D2_finding_counts", ALL_CTES + ", found AS (" + ALL_SQL + """)
SELECT book_id, code, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings FROM found GROUP BY 1, 2""")
def d2(spark, sf):
    return ck.finding_counts(findings(spark, sf), ["book_id", "code"])


@query("D1_book_totals", ctes("items", "files") + r""",
n AS (SELECT book_id, count(*) AS n_items FROM items GROUP BY 1), f AS (SELECT book_id, count(*) AS n_files, sum(size) AS n_bytes FROM files GROUP BY 1),
dirs AS (SELECT book_id, count(DISTINCT d) AS n_dirs FROM (SELECT book_id, split_part(path, '/', 1) AS d FROM files WHERE contains(path, '/')
  UNION SELECT book_id, regexp_extract(path, '^([^/]+/[^/]+)/', 1) FROM files WHERE regexp_matches(path, '^[^/]+/[^/]+/')) GROUP BY 1)
SELECT book_id, n_items, n_dirs, n_files, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN n_bytes >= 1048576 THEN CASE WHEN n_bytes / 1048576 < 10 THEN printf('%.1f MB', n_bytes / 1048576) ELSE printf('%.0f MB', n_bytes / 1048576) END
  ELSE CASE WHEN n_bytes / 1024 < 10 THEN printf('%.1f KB', n_bytes / 1024) ELSE printf('%.0f KB', n_bytes / 1024) END END AS size_text FROM n JOIN f USING (book_id) JOIN dirs USING (book_id)""")
def d1(spark, sf):
    return ck.book_totals(fx.items(spark, sf), fx.files(spark, sf))


REPAIR_SQL = ctes("items", "edges", "files") + BAD_SQL + """,
kept AS (SELECT i.* FROM bad_items i WHERE NOT (index = '' AND type NOT IN ('folder', 'separator', 'bookmark'))
  AND NOT (index <> '' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.book_id = i.book_id AND f.path = i.index))),
k2 AS (SELECT k.*, strftime(f.mtime, '%Y%m%d%H%M%S%g') AS ft, strftime(f.mtime - INTERVAL 600 SECOND, '%Y%m%d%H%M%S%g') > k.modify AND k.modify <> '' AS late FROM kept k LEFT JOIN files f ON f.book_id = k.book_id AND f.path = k.index),
fixed AS (SELECT book_id, item_id, ord, coalesce(nullif("create", ''), ft, modify) AS "create", CASE WHEN late THEN ft ELSE coalesce(nullif(modify, ''), ft, nullif("create", ''), '') END AS modify FROM k2)"""


@query("L10_repair_items", REPAIR_SQL + """SELECT book_id, item_id, "create", modify FROM fixed""")
def l10(spark, sf):
    items, _ = ck.repair(bad_items(spark, sf), bad_edges(spark, sf), fx.files(spark, sf), findings(spark, sf))
    return items.select("book_id", "item_id", "create", "modify")


@query("L10_repair_tree", REPAIR_SQL + """,
good AS (SELECT e.* FROM bad_edges e WHERE (parent_id IN ('root', 'hidden', 'recycle') OR EXISTS (SELECT 1 FROM kept k WHERE k.book_id = e.book_id AND k.item_id = e.parent_id))),
bad_ref AS (SELECT g.book_id, g.parent_id, g.child_id, min(pos) AS pos FROM good g WHERE child_id IN ('root', 'hidden', 'recycle') OR NOT EXISTS (SELECT 1 FROM kept k WHERE k.book_id = g.book_id AND k.item_id = g.child_id) GROUP BY 1, 2, 3),
lost AS (SELECT book_id, item_id, row_number() OVER (PARTITION BY book_id ORDER BY ord, item_id) - 1 AS n FROM kept k WHERE NOT EXISTS (SELECT 1 FROM bad_edges e WHERE e.book_id = k.book_id AND e.child_id = k.item_id))
SELECT book_id, parent_id, child_id, pos FROM good g WHERE NOT EXISTS (SELECT 1 FROM bad_ref b WHERE b.book_id = g.book_id AND b.parent_id = g.parent_id AND b.child_id = g.child_id AND b.pos = g.pos)
UNION ALL SELECT l.book_id, 'root', l.item_id, CAST(m.top + 1 + l.n AS BIGINT) FROM lost l JOIN (SELECT book_id, max(pos) AS top FROM good g WHERE parent_id = 'root'
  AND NOT EXISTS (SELECT 1 FROM bad_ref b WHERE b.book_id = g.book_id AND b.parent_id = g.parent_id AND b.child_id = g.child_id AND b.pos = g.pos) GROUP BY 1) m USING (book_id)""")
def l10b(spark, sf):
    _, edges = ck.repair(bad_items(spark, sf), bad_edges(spark, sf), fx.files(spark, sf), findings(spark, sf))
    return edges.select("book_id", "parent_id", "child_id", "pos")
