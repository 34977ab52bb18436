"""Closures, paths, positions, lists, layouts and sorting."""

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import tree as tr
from ..scale import rank_rows
from ..schema import SPECIAL_IDS
from . import fixtures as fx
from .fixtures import ctes, table
from .registry import query

WALK = """, walk AS (
  SELECT r AS id FROM (VALUES ('root'), ('hidden'), ('recycle')) v(r) UNION SELECT e.child_id FROM walk w JOIN star_edges e ON e.parent_id = w.id)"""


@query("H1_reachable", ctes("star_edges", recursive=True) + WALK + " SELECT 'star' AS book_id, id AS item_id FROM walk")
def h1(spark, sf):
    return gr.reachable(fx.star_edges(spark, sf)).select("book_id", "item_id")


@query("H1_first_visit_order", ctes("talk_edges", recursive=True) + ", " + fx.SQL["talk_paths"] + """
SELECT item_id, CAST(row_number() OVER (ORDER BY min(addr)) - 1 AS BIGINT) AS n FROM talk_paths GROUP BY 1""")
def h1b(spark, sf):
    from ..scale import rank_rows
    seen = gr.reachable(fx.talk_edges(spark, sf), SPECIAL_IDS, with_order=True)
    return rank_rows(seen, [], ["addr"], "n").select("item_id", "n")


@query("H2_preorder_paths", ctes("talk_edges", recursive=True) + ", " + fx.SQL["talk_paths"] + """
SELECT item_id, pos, array_to_string(addr, '.') AS addr, array_to_string(path, '/') AS path, cyc FROM talk_paths WHERE pos IS NOT NULL""")
def h2(spark, sf):
    rows = gr.preorder(fx.talk_edges(spark, sf))
    return rows.select("item_id", "pos", F.array_join(F.transform("addr", lambda x: x.cast("string")), ".").alias("addr"),
                       F.array_join("path", "/").alias("path"), "cyc")


@query("H3_addresses", ctes("talk_edges", recursive=True) + ", " + fx.SQL["talk_paths"] + """
SELECT DISTINCT item_id, array_to_string(addr[2:], '.') AS steps FROM talk_paths
WHERE pos IS NOT NULL AND path[1] = 'root' AND addr[2] % 3 = 0""")
def h3(spark, sf):
    e = fx.talk_edges(spark, sf)
    # every third conversation by address, and its first turn once more
    tops = e.filter("parent_id = 'root' and pos % 3 = 0").select("book_id", F.lit("root").alias("root_id"), F.array("pos").alias("steps"))
    again = tops.withColumn("steps", F.concat("steps", F.array(F.lit(0).cast("long"))))
    out = gr.expand_addresses(e, tops.unionByName(again))
    return out.select("item_id", F.array_join(F.transform("steps", lambda x: x.cast("string")), ".").alias("steps"))


HOPS = """e AS (SELECT page_id AS src, CASE WHEN page_id % 50 = 2 THEN (page_id + 50) % 200 ELSE (page_id * 7 + 3) % (SELECT count(*) FROM pages) END AS dst FROM pages WHERE page_id % 2 = 0),
  w AS (SELECT src, dst AS at, 1 AS hops, [src, dst] AS seen, src = dst AS circ FROM e UNION ALL SELECT w.src, e.dst, w.hops + 1, list_append(seen, e.dst), list_contains(seen, e.dst)
    FROM w JOIN e ON e.src = w.at AND NOT w.circ)"""


@query("H4_redirect_chains", "WITH RECURSIVE " + HOPS + """
SELECT w.src, CASE WHEN w.circ THEN NULL ELSE w.at END AS final, w.circ AS circular FROM w
WHERE w.circ OR NOT EXISTS (SELECT 1 FROM e WHERE e.src = w.at)""")
def h4(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    n, i = p.count(), F.col("page_id")
    edges = p.filter(i % 2 == 0).select(i.alias("src"), F.when(i % 50 == 2, (i + 50) % 200).otherwise((i * 7 + 3) % n).alias("dst"))
    return gr.redirect_targets(edges).select("src", "final", "circular")


@query("F1_sibling_positions", ctes("star_edges") + """
SELECT parent_id, child_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY pos, child_id) - 1 AS BIGINT) AS pos FROM star_edges""")
def f1(spark, sf):
    return tr.dense_positions(fx.star_edges(spark, sf)).select("parent_id", "child_id", "pos")


@query("F3_padded_prefix", ctes("star_edges") + """
SELECT parent_id, child_id, lpad(CAST(row_number() OVER (PARTITION BY parent_id ORDER BY pos, child_id) AS VARCHAR),
  CAST(length(CAST(count(*) OVER (PARTITION BY parent_id) AS VARCHAR)) AS INT), '0') AS prefix FROM star_edges""")
def f3(spark, sf):
    return tr.ordinal_prefix(fx.star_edges(spark, sf)).select("parent_id", "child_id", "prefix")


@query("F2_unique_names", """
WITH t AS (SELECT l_returnflag AS scope, CAST(l_suppkey AS VARCHAR) AS base, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem)
SELECT scope, n, CASE WHEN k = 1 THEN base ELSE base || '(' || (k - 1) || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY scope, base ORDER BY n) AS k FROM t)""")
def f2(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate"]
    rows = rank_rows(table(spark, sf, "lineitem").select(*order), [], order, "n").select(
        F.col("l_returnflag").alias("scope"), F.col("l_suppkey").cast("string").alias("base"), "n")
    return tr.unique_names(rows, ["scope"], "base", "n", "name").select("scope", "n", "name")


@query("F7_first_reference", ctes("talk_edges", recursive=True) + ", " + fx.SQL["talk_paths"] + """,
  f AS (SELECT item_id, min(addr) AS addr FROM talk_paths WHERE addr[1] = 0 GROUP BY 1)
SELECT p.path[len(p.path)] AS parent_id, p.item_id AS child_id FROM talk_paths p JOIN f ON f.item_id = p.item_id AND f.addr = p.addr WHERE p.pos IS NOT NULL""")
def f7(spark, sf):
    return tr.first_references(fx.talk_edges(spark, sf)).select("parent_id", "child_id")


@query("K3_pool_intersection", ctes("star_edges", "star_items", recursive=True) + """, walk AS (
  SELECT r AS id FROM (VALUES ('R1'), ('N3')) v(r) UNION SELECT e.child_id FROM walk w JOIN star_edges e ON e.parent_id = w.id)
SELECT item_id FROM star_items INTERSECT SELECT id FROM walk""")
def k3(spark, sf):
    from ..operators.transfer import export_pool
    it = fx.star_items(spark, sf)
    asked = it.filter("item_id in ('R1', 'N3')")
    return export_pool(it, fx.star_edges(spark, sf), asked, recursive=True).select("item_id")


@query("K4_pool_without_recycled", ctes("star_edges", "star_items") + """
SELECT item_id FROM star_items EXCEPT SELECT child_id FROM star_edges WHERE parent_id = 'recycle'""")
def k4(spark, sf):
    from ..operators.transfer import export_pool
    return export_pool(fx.star_items(spark, sf), fx.star_edges(spark, sf)).select("item_id")


@query("K5_newly_unreachable", ctes("star_edges", recursive=True) + """, left_edges AS (SELECT * FROM star_edges WHERE parent_id <> 'R0' AND NOT (parent_id = 'recycle' AND pos % 2 = 0)),
a AS (SELECT r AS id FROM (VALUES ('root'), ('hidden'), ('recycle')) v(r) UNION SELECT e.child_id FROM a w JOIN star_edges e ON e.parent_id = w.id),
b AS (SELECT r AS id FROM (VALUES ('root'), ('hidden'), ('recycle')) v(r) UNION SELECT e.child_id FROM b w JOIN left_edges e ON e.parent_id = w.id)
SELECT id AS item_id FROM a EXCEPT SELECT id FROM b""")
def k5(spark, sf):
    e = fx.star_edges(spark, sf)
    left = e.filter("parent_id <> 'R0' and not (parent_id = 'recycle' and pos % 2 = 0)")
    return gr.newly_unreachable(e, left).select("item_id")


DENSE = """, dense AS (SELECT book_id, parent_id, child_id, CAST(row_number() OVER (PARTITION BY book_id, parent_id ORDER BY pos, child_id) - 1 AS BIGINT) AS pos FROM star_edges)"""


@query("D5_children_lists", ctes("star_edges") + DENSE + """
SELECT parent_id, pos // 64 AS chunk, string_agg(child_id, ',' ORDER BY pos) AS children FROM dense GROUP BY 1, 2""")
def d5(spark, sf):
    out = tr.children_lists(fx.star_edges(spark, sf), 64)
    return out.select("parent_id", "chunk", F.array_join("values", ",").alias("children"))


@query("C15_parents_of", ctes("star_edges") + """
SELECT child_id, CAST(row_number() OVER (PARTITION BY child_id ORDER BY parent_id, pos) - 1 AS BIGINT) AS nth, parent_id, pos FROM star_edges""")
def c15(spark, sf):
    return tr.parents_of(fx.star_edges(spark, sf)).select("child_id", "nth", "parent_id", "pos")


@query("B14_item_cards", ctes("star_edges", "star_items") + DENSE + """, asked AS (SELECT item_id AS id FROM star_items WHERE item_id LIKE 'C%' AND ord % 50 < 3 UNION SELECT 'N' || n_nationkey FROM nation),
k AS (SELECT parent_id, pos // 1024 AS chunk, '["' || string_agg(child_id, '","' ORDER BY pos) || '"]' AS payload FROM dense WHERE parent_id IN (SELECT id FROM asked) GROUP BY 1, 2),
u AS (SELECT child_id, '["' || string_agg(parent_id || ':' || pos, '","' ORDER BY parent_id, pos) || '"]' AS payload FROM dense WHERE child_id IN (SELECT id FROM asked) GROUP BY 1)
SELECT item_id, 'meta' AS part, 0 AS chunk, '{"title":"' || title || '","type":"' || type || '","create":"' || "create" || '"}' AS payload FROM star_items WHERE item_id IN (SELECT id FROM asked)
UNION ALL SELECT parent_id, 'children', chunk, payload FROM k UNION ALL SELECT child_id, 'parents', 0, payload FROM u""")
def b14(spark, sf):
    it = fx.star_items(spark, sf)
    ids = it.filter("(item_id like 'C%' and ord % 50 < 3) or item_id like 'N%'").select("book_id", "item_id")
    ghost = ids.limit(1).withColumn("item_id", F.lit("nobody"))
    return tr.item_cards(it, fx.star_edges(spark, sf), ids.unionByName(ghost), include_parents=True).select("item_id", "part", "chunk", "payload")


SORT = """, keyed AS (SELECT e.*, CASE i.type WHEN 'folder' THEN -1 WHEN 'bookmark' THEN 1 WHEN 'postit' THEN 2 WHEN 'note' THEN 3 ELSE 0 END AS k, coalesce(i."create", '') AS c
  FROM star_edges e LEFT JOIN star_items i ON i.item_id = e.child_id)"""


@query("G4_sort_children", ctes("star_edges", "star_items") + SORT + """
SELECT parent_id, child_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY k DESC, pos) - 1 AS BIGINT) AS pos FROM keyed""")
def g4(spark, sf):
    out = tr.sort_children(fx.star_edges(spark, sf), fx.star_items(spark, sf), key="type", reverse=True)
    return out.select("parent_id", "child_id", "pos")


@query("G4_sort_subtree", ctes("star_edges", "star_items", recursive=True) + SORT + """,
walk AS (SELECT 'R2' AS id UNION SELECT e.child_id FROM walk w JOIN star_edges e ON e.parent_id = w.id)
SELECT parent_id, child_id, CASE WHEN parent_id IN (SELECT id FROM walk) THEN CAST(row_number() OVER (PARTITION BY parent_id ORDER BY c, pos) - 1 AS BIGINT) ELSE pos END AS pos FROM keyed""")
def g4b(spark, sf):
    it = fx.star_items(spark, sf)
    top = it.filter("item_id = 'R2'").select("book_id", "item_id")
    return tr.sort_children(fx.star_edges(spark, sf), it, top, key="create", recursively=True).select("parent_id", "child_id", "pos")


# the talk edges renumbered, all paths over known items, then the file names along each path
LAYOUT = ctes("talk_edges", "talk_items", recursive=True) + """,
dense AS (SELECT book_id, parent_id, child_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY pos, child_id) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY parent_id) AS n FROM talk_edges),
named AS (SELECT d.*, i.type, i.title, i.index, i.source, i.icon,
    lpad(CAST(d.pos + 1 AS VARCHAR), CAST(length(CAST(d.n AS VARCHAR)) AS INT), '0') || '-' ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN i.title <> '' THEN i.title WHEN i.type <> 'separator' THEN i.item_id ELSE '----' END,
      '[\\t\\n\\f\\r]+', ' ', 'g'), '[:"?*\\\\/|<>]', '_', 'g'), '^ +', ''), '[. ]+$', '') AS name
  FROM dense d JOIN talk_items i ON i.item_id = d.child_id),
paths AS (SELECT child_id AS item_id, [CAST(0 AS BIGINT), pos] AS addr, ['root'] AS up, false AS cyc, name AS path FROM named WHERE parent_id = 'root'
  UNION ALL SELECT n.child_id, list_append(p.addr, n.pos), list_append(p.up, p.item_id), list_contains(list_append(p.up, p.item_id), n.child_id), p.path || '/' || n.name
  FROM paths p JOIN named n ON n.parent_id = p.item_id AND NOT p.cyc)"""


@query("A19_layout_paths", LAYOUT + """
SELECT p.item_id, array_to_string(p.addr, '.') AS addr, p.path || CASE i.type WHEN 'folder' THEN '' WHEN 'separator' THEN '.-' WHEN 'bookmark' THEN CASE WHEN i.source <> '' THEN '.htm' END
  ELSE CASE WHEN i.index = '' THEN NULL WHEN i.index LIKE '%/index.html' THEN '.htd' ELSE '.txt' END END AS target
FROM paths p JOIN talk_items i USING (item_id)""")
def a19(spark, sf):
    out = tr.layout_paths(fx.talk_edges(spark, sf), fx.talk_items(spark, sf))
    return out.select("item_id", F.array_join(F.transform("addr", lambda x: x.cast("string")), ".").alias("addr"), "target")


@query("A18_static_index", LAYOUT + """,
opened AS (SELECT DISTINCT addr[1:len(addr) - 1] AS addr FROM paths),
ev AS (SELECT p.addr, v.event, v.ph, (len(p.addr) - 1) * 2 - 1 AS level, p.item_id, CASE WHEN i.type <> 'separator' AND i.title = '' THEN i.item_id ELSE i.title END AS title,
    CASE WHEN i.type IN ('separator', 'folder') THEN '' WHEN i.type = 'bookmark' AND i.source <> '' THEN i.source WHEN i.index <> '' THEN '../data/' || i.index ELSE '' END AS url,
    CASE WHEN i.type = 'separator' THEN '' WHEN i.icon <> '' THEN CASE WHEN i.index LIKE '%/index.html' THEN '../data/' || i.item_id || '/' ELSE '../data/' END || i.icon ELSE '' END AS icon
  FROM paths p JOIN talk_items i USING (item_id), (VALUES ('start', 0), ('end', 3)) v(event, ph)
  UNION ALL SELECT o.addr, v.event, v.ph, (len(o.addr) - 1) * 2, NULL, NULL, NULL, NULL FROM opened o, (VALUES ('start-container', 1), ('end-container', 2)) v(event, ph))
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN ph >= 2 THEN list_append(list_append(addr, 9223372036854775807), ph) ELSE list_append(addr, ph - 2) END) - 1 AS BIGINT) AS n,
  event, CAST(level AS BIGINT) AS level, item_id, title, url, icon FROM ev""")
def a18(spark, sf):
    from ..scale import rank_rows
    out = tr.static_index(fx.talk_edges(spark, sf), fx.talk_items(spark, sf))
    return rank_rows(out, ["book_id"], ["seq_key"], "n").select("n", "event", F.col("level").cast("long").alias("level"), "item_id", "title", "url", "icon")
