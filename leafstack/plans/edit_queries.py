"""Batch edits, id assignment, export and import, old layouts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits as ed
from ..operators import legacy as lg
from ..operators import transfer as tf
from ..functions.scalars import item_id_of
from . import fixtures as fx
from .fixtures import ctes, stored, table
from .registry import query

DENSE = ", dense AS (SELECT book_id, parent_id, child_id, CAST(row_number() OVER (PARTITION BY book_id, parent_id ORDER BY pos, child_id) - 1 AS BIGINT) AS pos FROM star_edges)"
WALK = """{n} AS (SELECT r AS id FROM (VALUES ('root'), ('hidden'), ('recycle')) v(r) UNION SELECT e.child_id FROM {n} w JOIN {e} e ON e.parent_id = w.id)"""


@stored
def dense_star(spark, sf):
    from ..operators.tree import dense_positions
    return dense_positions(fx.star_edges(spark, sf))


def order_picks(spark, sf, cond):
    """Picked order edges; the order number is the tree order."""
    e = dense_star(spark, sf).filter("child_id like 'O%'")
    key = F.substring("child_id", 2, 20).cast("long")
    return e.withColumn("seq", key).filter(cond).select("book_id", "seq", "parent_id", "pos")


@query("I3_free_ids", """
SELECT event_id, strftime(date_trunc('hour', ts) + to_milliseconds(row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) - 1 + CASE WHEN hour(ts) % 2 = 0 THEN 1 ELSE 0 END), '%Y%m%d%H%M%S%g') AS item_id FROM events""")
def i3(spark, sf):
    e = table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    wanted = e.select(F.lit("b").alias("book_id"), F.col("event_id").alias("seq"), item_id_of(hour).alias("base_id"))
    taken = e.filter(F.hour("ts") % 2 == 0).select(F.lit("b").alias("book_id"), item_id_of(hour).alias("item_id")).distinct()
    return ed.assign_ids(wanted, taken).select(F.col("seq").alias("event_id"), "item_id")


def new_items(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.lit("star").alias("book_id"), F.concat(F.lit("P"), "p_partkey").alias("item_id"), F.col("p_partkey").alias("seq"),
                    F.col("p_name").alias("title"), F.lit("note").alias("type"),
                    F.when(F.col("p_partkey") % 2 == 0, "20230101000000000").alias("create"))


def with_dates(items):
    return items.withColumn("modify", F.lit("")).withColumn("index", F.when(F.col("item_id").like("O%"), F.concat("item_id", F.lit("/index.html"))).otherwise(""))


@query("C14_new_item_problems", ctes("star_items") + """, new AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'O' || p_partkey WHEN 1 THEN 'hidden' WHEN 2 THEN 'X' || (p_partkey % 50) ELSE 'P' || p_partkey END AS item_id FROM part)
SELECT DISTINCT item_id, problem FROM (SELECT item_id, 'reserved' AS problem FROM new WHERE item_id IN ('root', 'hidden', 'recycle')
  UNION ALL SELECT item_id, 'exists' FROM new WHERE item_id IN (SELECT item_id FROM star_items) UNION ALL SELECT item_id, 'repeated' FROM new GROUP BY 1 HAVING count(*) > 1)""")
def c14(spark, sf):
    n = F.col("p_partkey")
    iid = (F.when(n % 5 == 0, F.concat(F.lit("O"), n)).when(n % 5 == 1, "hidden").when(n % 5 == 2, F.concat(F.lit("X"), n % 50)).otherwise(F.concat(F.lit("P"), n)))
    new = table(spark, sf, "part").select(F.lit("star").alias("book_id"), iid.alias("item_id"))
    return ed.check_new_items(fx.star_items(spark, sf), new).select("item_id", "problem")


@query("L1_add_items", ctes("star_edges", "star_items") + DENSE + """
SELECT 'edge' AS kind, parent_id AS a, child_id AS b, CASE WHEN parent_id = 'R1' AND pos >= 2 THEN pos + (SELECT count(*) FROM part) ELSE pos END AS n FROM dense
UNION ALL SELECT 'edge', 'R1', 'P' || p_partkey, 2 + row_number() OVER (ORDER BY p_partkey) - 1 FROM part
UNION ALL SELECT 'item', 'P' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '20230101000000000' ELSE '20240201000000000' END, (SELECT max(ord) FROM star_items) + row_number() OVER (ORDER BY p_partkey) FROM part
UNION ALL SELECT 'item', item_id, '', ord FROM star_items""")
def l1(spark, sf):
    items, edges, _ = ed.add_items(with_dates(fx.star_items(spark, sf)), dense_star(spark, sf), new_items(spark, sf), "R1", 2, now="20240201000000000")
    e = edges.select(F.lit("edge").alias("kind"), F.col("parent_id").alias("a"), F.col("child_id").alias("b"), F.col("pos").alias("n"))
    return e.unionByName(items.select(F.lit("item").alias("kind"), F.col("item_id").alias("a"), F.col("modify").alias("b"), F.col("ord").alias("n")))


@query("L2_update_items", ctes("star_items") + """
SELECT item_id, CASE WHEN item_id LIKE 'O%' AND ord % 3 = 0 THEN 'new ' || ord ELSE title END AS title, CASE WHEN item_id LIKE 'O%' AND ord % 5 = 0 AND ord % 3 <> 0 THEN 'bookmark' ELSE type END AS type,
  CASE WHEN item_id LIKE 'O%' AND (ord % 3 = 0 OR ord % 5 = 0) THEN '20240201000000000' ELSE '' END AS modify FROM star_items""")
def l2(spark, sf):
    it = with_dates(fx.star_items(spark, sf))
    o = it.filter("item_id like 'O%'")
    first = o.filter("ord % 3 = 0").select("book_id", "item_id", F.col("ord").alias("seq"), F.create_map(F.lit("title"), F.concat(F.lit("new "), "ord")).alias("props"))
    # the second change of an id is ignored
    second = o.filter("ord % 5 = 0").select("book_id", "item_id", (F.col("ord") + 100000000).alias("seq"), F.create_map(F.lit("type"), F.lit("bookmark")).alias("props"))
    return ed.update_items(it, first.unionByName(second), now="20240201000000000").select("item_id", "title", "type", "modify")


MOVE_SQL = ctes("star_edges", "star_items", recursive=True) + DENSE + """,
picks AS (SELECT *, CAST(substr(child_id, 2) AS BIGINT) AS seq FROM dense WHERE child_id LIKE 'O%' AND CAST(substr(child_id, 2) AS BIGINT) % 40 = 1
  UNION ALL SELECT *, CAST(substr(child_id, 2) AS BIGINT) - 1000 FROM dense WHERE parent_id LIKE 'R%'),
up AS (SELECT 'C7' AS id UNION SELECT e.parent_id FROM up JOIN dense e ON e.child_id = up.id),"""


@query("L3_move_items", MOVE_SQL + """
tasks AS (SELECT * FROM picks WHERE parent_id = 'C7' OR child_id NOT IN (SELECT id FROM up)),
rest AS (SELECT d.parent_id, d.child_id, CAST(row_number() OVER (PARTITION BY d.parent_id ORDER BY d.pos) - 1 AS BIGINT) AS pos FROM dense d ANTI JOIN tasks t ON t.parent_id = d.parent_id AND t.pos = d.pos),
p AS (SELECT least(1 - (SELECT count(*) FROM tasks WHERE parent_id = 'C7' AND pos < least(1, (SELECT count(*) FROM dense WHERE parent_id = 'C7'))), (SELECT count(*) FROM rest WHERE parent_id = 'C7')) AS spot, (SELECT count(*) FROM tasks) AS k)
SELECT parent_id, child_id, CASE WHEN parent_id = 'C7' AND pos >= p.spot THEN pos + k ELSE pos END AS pos FROM rest, p
UNION ALL SELECT 'C7', child_id, p.spot + row_number() OVER (ORDER BY seq) - 1 FROM tasks, p""")
def l3(spark, sf):
    tops = dense_star(spark, sf).filter("parent_id like 'R%'").select("book_id", (F.substring("child_id", 2, 20).cast("long") - 1000).alias("seq"), "parent_id", "pos")
    picks = order_picks(spark, sf, "seq % 40 = 1").unionByName(tops)
    return ed.move_items(fx.star_items(spark, sf), dense_star(spark, sf), picks, "C7", 1).select("parent_id", "child_id", "pos")


@query("L4_link_items", MOVE_SQL + """
len AS (SELECT count(*) AS n FROM dense WHERE parent_id = 'C7')
SELECT parent_id, child_id, pos FROM dense UNION ALL SELECT 'C7', child_id, n + row_number() OVER (ORDER BY seq) - 1 FROM picks, len WHERE seq >= 0 AND child_id LIKE 'O%'""")
def l4(spark, sf):
    return ed.link_items(fx.star_items(spark, sf), dense_star(spark, sf), order_picks(spark, sf, "seq % 40 = 1"), "C7").select("parent_id", "child_id", "pos")


# a third of the picked orders is listed twice, so it stays reachable
BIN = """, bin0 AS (SELECT * FROM dense WHERE child_id LIKE 'O%' AND parent_id LIKE 'C%' AND CAST(substr(child_id, 2) AS BIGINT) % 30 = 2 AND child_id IN (SELECT item_id FROM star_items)),
left_edges AS (SELECT d.parent_id, d.child_id, CAST(row_number() OVER (PARTITION BY d.parent_id ORDER BY d.pos) - 1 AS BIGINT) AS pos FROM dense d ANTI JOIN bin0 t ON t.parent_id = d.parent_id AND t.pos = d.pos),"""


def bin_picks(spark, sf):
    it = fx.star_items(spark, sf).select("book_id", F.col("item_id").alias("child_id"))
    e = dense_star(spark, sf).filter("child_id like 'O%' and parent_id like 'C%'").join(it, ["book_id", "child_id"], "left_semi")
    return e.withColumn("seq", F.substring("child_id", 2, 20).cast("long")).filter("seq % 30 = 2").select("book_id", "seq", "parent_id", "pos")


@query("L6_recycle_items", ctes("star_edges", "star_items", recursive=True) + DENSE + BIN + WALK.format(n="w", e="left_edges") + """,
lost AS (SELECT *, CAST(substr(child_id, 2) AS BIGINT) AS seq FROM bin0 WHERE child_id NOT IN (SELECT id FROM w))
SELECT 'edge' AS kind, parent_id AS a, child_id AS b, pos AS n FROM left_edges
UNION ALL SELECT 'edge', 'recycle', child_id, (SELECT count(*) FROM left_edges WHERE parent_id = 'recycle') + row_number() OVER (ORDER BY seq) - 1 FROM lost
UNION ALL SELECT 'item', child_id, parent_id, 0 FROM lost""")
def l6(spark, sf):
    items, edges, _ = ed.recycle_items(fx.star_items(spark, sf), dense_star(spark, sf), bin_picks(spark, sf), "20240201000000000")
    e = edges.select(F.lit("edge").alias("kind"), F.col("parent_id").alias("a"), F.col("child_id").alias("b"), F.col("pos").alias("n"))
    marked = items.filter("recycled is not null").select(F.lit("item").alias("kind"), F.col("item_id").alias("a"), F.col("parent").alias("b"), F.lit(0).cast("long").alias("n"))
    return e.unionByName(marked)


RESTORE = """, remembered AS (SELECT 'O' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'C' || o_custkey WHEN o_orderkey % 4 = 1 THEN 'gone' WHEN o_orderkey % 4 = 2 THEN 'hidden' END AS want FROM orders),
picked AS (SELECT d.*, CAST(substr(child_id, 2) AS BIGINT) AS seq, CASE WHEN want IN ('root', 'hidden', 'recycle') OR want IN (SELECT item_id FROM star_items) THEN want ELSE 'root' END AS dest
  FROM dense d JOIN remembered r ON r.id = d.child_id WHERE d.parent_id = 'recycle' AND CAST(substr(child_id, 2) AS BIGINT) % 8 < 4 AND d.child_id IN (SELECT item_id FROM star_items)),
rest AS (SELECT d.parent_id, d.child_id, CAST(row_number() OVER (PARTITION BY d.parent_id ORDER BY d.pos) - 1 AS BIGINT) AS pos FROM dense d ANTI JOIN picked t ON t.parent_id = d.parent_id AND t.pos = d.pos),
sizes AS (SELECT parent_id, count(*) AS n FROM rest GROUP BY 1)"""


@query("L7_unrecycle_items", ctes("star_edges", "star_items") + DENSE + RESTORE + """
SELECT parent_id, child_id, pos FROM rest UNION ALL SELECT dest, child_id, coalesce(n, 0) + row_number() OVER (PARTITION BY dest ORDER BY seq) - 1 FROM picked LEFT JOIN sizes s ON s.parent_id = dest""")
def l7(spark, sf):
    _, edges, _ = ed.unrecycle_items(*recycled_book(spark, sf))
    return edges.select("parent_id", "child_id", "pos")


def recycled_book(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    want = F.when(k % 4 == 0, F.concat(F.lit("C"), "o_custkey")).when(k % 4 == 1, "gone").when(k % 4 == 2, "hidden")
    marks = o.select(F.concat(F.lit("O"), k).alias("item_id"), want.alias("parent"))
    items = fx.star_items(spark, sf).join(marks, "item_id", "left")
    known = items.select("book_id", F.col("item_id").alias("child_id"))
    picks = (dense_star(spark, sf).filter("parent_id = 'recycle'").join(known, ["book_id", "child_id"], "left_semi")
             .withColumn("seq", F.substring("child_id", 2, 20).cast("long")).filter("seq % 8 < 4").select("book_id", "seq", "parent_id", "pos"))
    return items, dense_star(spark, sf), picks


@query("D6_restored_by_parent", ctes("star_edges", "star_items") + DENSE + RESTORE + "SELECT dest AS parent_id, count(*) AS n, min(seq) AS first_seq FROM picked GROUP BY 1")
def d6(spark, sf):
    _, _, restored = ed.unrecycle_items(*recycled_book(spark, sf))
    return restored.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("L8_delete_items", ctes("star_edges", "star_items", recursive=True) + DENSE + """,
cut AS (SELECT * FROM dense WHERE parent_id = 'R0' OR (parent_id = 'recycle' AND CAST(substr(child_id, 2) AS BIGINT) % 3 = 0)),
left_edges AS (SELECT d.parent_id, d.child_id, CAST(row_number() OVER (PARTITION BY d.parent_id ORDER BY d.pos) - 1 AS BIGINT) AS pos FROM dense d ANTI JOIN cut t ON t.parent_id = d.parent_id AND t.pos = d.pos),
""" + WALK.format(n="a", e="dense") + ", " + WALK.format(n="b", e="left_edges") + """, gone AS (SELECT id FROM a EXCEPT SELECT id FROM b)
SELECT 'edge' AS kind, parent_id AS a, child_id AS b, pos AS n FROM left_edges WHERE parent_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'item', item_id, NULL, ord FROM star_items WHERE item_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'purge', id, CASE WHEN id LIKE 'O%' AND id IN (SELECT item_id FROM star_items) THEN id END, 0 FROM gone""")
def l8(spark, sf):
    e = dense_star(spark, sf)
    key = F.substring("child_id", 2, 20).try_cast("long")
    picks = e.filter((F.col("parent_id") == "R0") | ((F.col("parent_id") == "recycle") & (key % 3 == 0))).select("book_id", key.alias("seq"), "parent_id", "pos")
    items, edges, gone = ed.delete_items(with_dates(fx.star_items(spark, sf)), e, picks)
    none = F.lit(None).cast("string")
    parts = [edges.select(F.lit("edge").alias("kind"), F.col("parent_id").alias("a"), F.col("child_id").alias("b"), F.col("pos").alias("n")),
             items.select(F.lit("item").alias("kind"), F.col("item_id").alias("a"), none.alias("b"), F.col("ord").alias("n")),
             gone.select(F.lit("purge").alias("kind"), F.col("item_id").alias("a"), F.col("entry").alias("b"), F.lit(0).cast("long").alias("n"))]
    return reduce(DataFrame.unionByName, parts)


@query("L9_edit_batch", ctes("star_edges", "star_items") + """
SELECT 'P' || p_partkey AS item_id FROM part UNION SELECT item_id FROM star_items WHERE item_id LIKE 'R%' UNION SELECT 'R4' """)
def l9(spark, sf):
    cat = ed.Catalogue(with_dates(fx.star_items(spark, sf)), dense_star(spark, sf))
    names = fx.star_items(spark, sf).filter("item_id like 'R%'").select("book_id", "item_id", F.col("ord").alias("seq"), F.create_map(F.lit("title"), F.lit("x")).alias("props"))
    out = ed.apply_batch(cat, [
        ("add_items", new_items(spark, sf), {"target_parent": "R4", "now": "20240201000000000"}),
        ("link_items", order_picks(spark, sf, "seq % 40 = 1"), {"target_parent": "R1", "target_index": 0}),
        ("update_items", names, {"now": "20240201000000000"})])
    return out.changed_ids().select("item_id")


# -- export and import --------------------------------------------------------------------

EXPORT = ctes("talk_edges", "talk_items", recursive=True) + ", " + fx.SQL["talk_paths"].replace("JOIN talk_edges e", "JOIN dense e").replace("talk_paths AS (", """dense AS (
  SELECT book_id, parent_id, child_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY pos, child_id) - 1 AS BIGINT) AS pos FROM talk_edges),
talk_paths AS (""") + """,
occ AS (SELECT *, row_number() OVER (ORDER BY addr) - 1 AS n FROM talk_paths WHERE pos IS NOT NULL AND item_id IN (SELECT item_id FROM talk_items))"""
STAMP = "strftime(TIMESTAMP '2024-02-01 00:00:00' + to_milliseconds({}), '%Y%m%d%H%M%S%g')"


@query("L5_copy_items", EXPORT + f""",
scope AS (SELECT item_id, min(addr[2:]) AS a FROM talk_paths WHERE pos IS NOT NULL AND addr[1] = 0 AND addr[2] % 5 = 0 AND item_id IN (SELECT item_id FROM talk_items) GROUP BY 1),
ids AS (SELECT item_id, {STAMP.format('row_number() OVER (ORDER BY a) - 1')} AS nid FROM scope)
SELECT parent_id, pos, child_id FROM dense
UNION ALL SELECT p.nid, row_number() OVER (PARTITION BY p.nid ORDER BY d.pos, c.nid) - 1, c.nid FROM dense d JOIN ids p ON d.parent_id = p.item_id JOIN ids c ON d.child_id = c.item_id
UNION ALL SELECT 'root', (SELECT count(*) FROM dense WHERE parent_id = 'root') + row_number() OVER (ORDER BY d.pos) - 1, i.nid FROM dense d JOIN ids i ON i.item_id = d.child_id WHERE d.parent_id = 'root' AND d.pos % 5 = 0""")
def l5(spark, sf):
    from ..operators.tree import dense_positions
    e = dense_positions(fx.talk_edges(spark, sf))
    picks = e.filter("parent_id = 'root' and pos % 5 = 0").select("book_id", F.col("pos").alias("seq"), "parent_id", "pos")
    items, edges, ids = ed.copy_items(fx.talk_items(spark, sf), e, picks, "root", "20240201000000000")
    return edges.select("parent_id", "pos", "child_id")


@query("F5_export_ids", EXPORT + f"SELECT n, item_id, {STAMP.format('n')} AS ets, {STAMP.format('min(n) OVER (PARTITION BY item_id)')} AS eid FROM occ")
def f5(spark, sf):
    return tf.export_manifest(fx.talk_items(spark, sf), fx.talk_edges(spark, sf), "20240201000000000").select("n", "item_id", "ets", "eid")


@query("A13_export_manifest", EXPORT + f""", up AS (SELECT o.n, u.d, coalesce(i.title, '') AS title, u.id FROM occ o, unnest(o.path) WITH ORDINALITY AS u(id, d) LEFT JOIN talk_items i ON i.item_id = u.id)
SELECT n, item_id, {STAMP.format('n')} AS ets, pos, (SELECT string_agg(id || '=' || title, '/' ORDER BY d) FROM up WHERE up.n = occ.n) AS path FROM occ""")
def a13(spark, sf):
    m = tf.export_manifest(fx.talk_items(spark, sf), fx.talk_edges(spark, sf), "20240201000000000")
    return m.select("n", "item_id", "ets", "pos", F.array_join(F.transform("path", lambda s: F.concat(s["id"], F.lit("="), s["title"])), "/").alias("path"))


PAYLOADS = ctes("items", "edges", "files") + """,
uses AS (SELECT book_id, child_id AS item_id, count(*) AS uses FROM edges GROUP BY 1, 2),
asked AS (SELECT i.*, uses, CASE WHEN index LIKE '%/index.html' THEN substr(index, 1, len(index) - 11) ELSE index END AS src, CAST(substr(item_id, 2) AS BIGINT) AS doc_id
  FROM items i JOIN uses USING (book_id, item_id) WHERE item_id LIKE 'D%' AND CAST(substr(item_id, 2) AS BIGINT) % 5 = 0),
held AS (SELECT f.book_id, f.path, d.text AS content FROM files f JOIN documents d ON d.doc_id = try_cast(regexp_extract(f.path, '^D([0-9]+)', 1) AS BIGINT)),
entries AS (SELECT a.book_id, a.item_id, 'data/' || h.path AS name, h.content, uses FROM asked a JOIN held h ON h.book_id = a.book_id AND (h.path = a.src OR starts_with(h.path, a.src || '/')) WHERE a.index <> ''
  UNION ALL SELECT a.book_id, a.item_id, 'favicon/' || md5(d.source) || '.png', d.source, uses FROM asked a JOIN documents d USING (doc_id) WHERE a.icon LIKE '../tree/favicon/%' AND a.index NOT LIKE '%/%')
"""


def payloads(spark, sf):
    """Every fifth document's item with its files, which hold the documents' texts, and its icon."""
    items, edges = fx.items(spark, sf), fx.edges(spark, sf)
    d = table(spark, sf, "documents")
    files = (fx.files(spark, sf).withColumn("doc_id", F.regexp_extract("path", "^D([0-9]+)", 1).try_cast("long"))
             .join(d.select("doc_id", "text", F.sha1(F.encode("text", "UTF-8")).alias("digest")), "doc_id").select("book_id", "path", F.encode("text", "UTF-8").alias("content"), "digest"))
    icons = d.select(F.col("lang").alias("book_id"), F.concat(F.lit("tree/favicon/"), F.md5("source"), F.lit(".png")).alias("path"), F.encode("source", "UTF-8").alias("content")).distinct()
    ids = items.filter("item_id like 'D%' and cast(substring(item_id, 2) as bigint) % 5 = 0").select("book_id", "item_id")
    return tf.export_payloads(tf.export_manifest(items, edges, "20240201000000000", ids), items, files, icons)


@query("A13_payload_entries", PAYLOADS + "SELECT book_id, item_id, name, sha1(content) AS digest, uses FROM entries")
def a13p(spark, sf):
    rows = payloads(spark, sf)[0].withColumn("name", F.expr("substring(name, 19)"))
    return rows.groupBy("book_id", "item_id", "name", "digest").agg(F.count(F.lit(1)).alias("uses"))


@query("A13_payload_store", PAYLOADS + "SELECT DISTINCT sha1(content) AS digest, content, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM entries")
def a13s(spark, sf):
    return payloads(spark, sf)[1].withColumn("content", F.decode("content", "UTF-8"))


@query("A13_export_some", ctes("items", "edges") + """, dense AS (SELECT *, row_number() OVER (PARTITION BY book_id, parent_id ORDER BY pos, child_id) - 1 AS p FROM edges)
SELECT a.book_id, a.child_id AS item_id, a.p AS pos, CASE WHEN b.parent_id IS NULL THEN a.parent_id ELSE b.parent_id || '/' || a.parent_id END AS path
FROM dense a LEFT JOIN dense b ON b.book_id = a.book_id AND b.child_id = a.parent_id WHERE a.child_id LIKE 'D%' AND CAST(substr(a.child_id, 2) AS BIGINT) % 50 = 7""")
def a13o(spark, sf):
    ids = fx.items(spark, sf).filter("item_id like 'D%' and cast(substring(item_id, 2) as bigint) % 50 = 7").select("book_id", "item_id")
    m = tf.export_manifest(fx.items(spark, sf), fx.edges(spark, sf), "20240201000000000", ids)
    return m.select("book_id", "item_id", "pos", F.array_join(F.transform("path", lambda s: s["id"]), "/").alias("path"))


@query("A14_export_files_v1", EXPORT + f""", named AS (SELECT n, {STAMP.format('n')} || '-' || title AS t FROM occ JOIN talk_items USING (item_id))
SELECT n, regexp_replace(regexp_replace(regexp_replace(t, '[\\t\\n\\f\\r]+', ' ', 'g'), '[:"?*\\\\/|<>]', '_', 'g'), '[. ]+$', '') || '.wsba' AS file FROM named""")
def a14(spark, sf):
    m = tf.export_manifest(fx.talk_items(spark, sf), fx.talk_edges(spark, sf), "20240201000000000")
    return tf.export_files_v1(m, fx.talk_items(spark, sf)).select("n", "file")


@stored
def incoming(spark, sf):
    """Orders as export records: several per customer id, some known to the book."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    path = F.array(F.struct(F.lit("root").alias("id"), F.lit("").alias("title")),
                   F.struct(F.concat(F.lit("F"), k % 7).alias("id"), F.concat(F.lit("Folder "), k % 7).alias("title")))
    return o.select(F.lit("star").alias("book_id"), k.alias("ord"), F.concat(F.lit("e"), "o_custkey").alias("eid"),
                    F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("C"), "o_custkey")).otherwise(F.concat(F.lit("I"), "o_custkey")).alias("item_id"),
                    path.alias("path"), (k % 4).alias("pos"), F.col("o_orderpriority").alias("title"),
                    F.when(k % 2 == 0, F.concat(F.lit("x"), k, F.lit(".html"))).otherwise("").alias("index"))


IN_SQL = """inc AS (SELECT o_orderkey AS ord, 'e' || o_custkey AS eid, CASE WHEN o_custkey % 3 = 0 THEN 'C' || o_custkey ELSE 'I' || o_custkey END AS item_id,
  'F' || (o_orderkey % 7) AS folder, o_orderkey % 4 AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'x' || o_orderkey || '.html' ELSE '' END AS index FROM orders)"""


@query("F8_import_dedup", "WITH " + IN_SQL + """
SELECT eid, folder, pos, min(ord) AS ord, min(ord) = any_value(f) AS imports_data FROM (SELECT *, min(ord) OVER (PARTITION BY eid) AS f FROM inc) GROUP BY 1, 2, 3""")
def f8(spark, sf):
    out = tf.dedup_occurrences(incoming(spark, sf), rebuild_folders=True)
    return out.select("eid", F.element_at("path", -1)["id"].alias("folder"), "pos", "ord", "imports_data")


FIRST = ", one AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY eid ORDER BY ord) = 1)"


@query("C12_import_conflicts", ctes("star_items") + ", " + IN_SQL + FIRST + """
SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM star_items) THEN CASE WHEN index = '' THEN 'replace' ELSE 'error' END ELSE 'add' END AS action FROM one""")
def c12(spark, sf):
    occ = tf.dedup_occurrences(incoming(spark, sf)).filter("imports_data")
    return tf.resolve_conflicts(occ, with_dates(fx.star_items(spark, sf)), "replace").select("item_id", "action")


@query("C12_import_new_ids", ctes("star_items") + ", " + IN_SQL + FIRST + f""", c AS (SELECT item_id, ord FROM one WHERE item_id IN (SELECT item_id FROM star_items))
SELECT item_id, item_id AS new_id FROM one WHERE item_id NOT IN (SELECT item_id FROM star_items) UNION ALL SELECT item_id, {STAMP.format('row_number() OVER (ORDER BY ord) - 1')} FROM c""")
def c12b(spark, sf):
    occ = tf.dedup_occurrences(incoming(spark, sf)).filter("imports_data")
    return tf.resolve_conflicts(occ, with_dates(fx.star_items(spark, sf)), "new", "20240201000000000").select("item_id", "new_id")


@query("H7_rebuild_folders", ctes("star_items") + ", " + IN_SQL + FIRST + f""",
occ AS (SELECT i.* FROM (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY eid, folder, pos ORDER BY ord) = 1) i WHERE eid IN (SELECT eid FROM one WHERE item_id NOT IN (SELECT item_id FROM star_items))),
fold AS (SELECT folder, min(ord) AS o FROM occ GROUP BY 1),
made AS (SELECT folder, {STAMP.format('row_number() OVER (ORDER BY o) - 1')} AS id FROM fold)
SELECT 'root' AS parent_id, id AS child_id, CAST(1 AS BIGINT) AS n FROM made UNION ALL SELECT m.id, o.item_id, count(*) FROM occ o JOIN made m USING (folder) GROUP BY 1, 2""")
def h7(spark, sf):
    items = with_dates(fx.star_items(spark, sf))
    occ = tf.dedup_occurrences(incoming(spark, sf), rebuild_folders=True)
    ok = tf.resolve_conflicts(occ.filter("imports_data"), items, "skip").filter("action <> 'error'")
    put = occ.join(ok.select("book_id", "eid"), ["book_id", "eid"], "left_semi")
    id_map = ok.select("book_id", F.col("item_id").alias("old_id"), "new_id").distinct()
    _, edges = tf.rebuild_folders(put, items, id_map, "20240201000000000")
    return edges.groupBy("parent_id", "child_id").agg(F.count(F.lit(1)).alias("n"))


@query("A11_import_merge", ctes("star_items", "star_edges") + ", " + IN_SQL + FIRST + """, ok AS (SELECT * FROM one WHERE item_id NOT IN (SELECT item_id FROM star_items)),
len AS (SELECT count(*) AS n FROM star_edges WHERE parent_id = 'root')
SELECT child_id, CAST(row_number() OVER (ORDER BY pos, child_id) - 1 AS BIGINT) AS pos FROM star_edges WHERE parent_id = 'root'
UNION ALL SELECT item_id, n + row_number() OVER (ORDER BY ord) - 1 FROM ok, len""")
def a11m(spark, sf):
    _, edges, _ = tf.import_exports(incoming(spark, sf), with_dates(fx.star_items(spark, sf)), fx.star_edges(spark, sf))
    return edges.filter("parent_id = 'root'").select("child_id", "pos")


@query("H8_substitute_ids", ctes("star_edges") + """
SELECT CASE WHEN parent_id LIKE 'C%' THEN 'K' || substr(parent_id, 2) ELSE parent_id END AS parent_id, pos, CASE WHEN child_id LIKE 'C%' THEN 'K' || substr(child_id, 2) ELSE child_id END AS child_id FROM star_edges""")
def h8(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("star").alias("book_id"), F.concat(F.lit("C"), "c_custkey").alias("old_id"), F.concat(F.lit("K"), "c_custkey").alias("new_id"))
    return tf.substitute_ids(fx.star_edges(spark, sf), c).select("parent_id", "pos", "child_id")


# -- the older layout ---------------------------------------------------------------------------

@stored
def stamped(spark, sf):
    """Events as items: millisecond ids crowded into few seconds, some ids that are no dates."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    ts = F.timestamp_millis(F.lit(1704067200000) + (k % 40) * 1000 + F.floor(k / 40) % 1000)
    return e.select(F.concat(F.lit("u"), F.floor(k / 40000)).alias("book_id"), F.when(k % 100 == 7, F.concat(F.lit("z"), k)).otherwise(item_id_of(ts)).alias("item_id"), k.alias("ord"))


SECONDS = """ev AS (SELECT 'u' || (event_id // 40000) AS book_id, CASE WHEN event_id % 100 = 7 THEN 'z' || event_id
  ELSE strftime(make_timestamp(1704067200000000 + (event_id % 40) * 1000000 + (event_id // 40 % 1000) * 1000), '%Y%m%d%H%M%S%g') END AS item_id, event_id AS ord FROM events)"""


@query("F6_legacy_id_winners", "WITH " + SECONDS + """
SELECT book_id, item_id, substr(item_id, 1, 14) AS legacy_id FROM ev WHERE item_id LIKE '2%' QUALIFY row_number() OVER (PARTITION BY book_id, substr(item_id, 1, 14) ORDER BY ord, item_id) = 1""")
def f6(spark, sf):
    return lg.legacy_winners(lg.legacy_candidates(stamped(spark, sf))).select("book_id", "item_id", "legacy_id")


@query("F6_legacy_ids", "WITH " + SECONDS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY book_id, substr(item_id, 1, 14) ORDER BY ord, item_id) = 1 AND item_id LIKE '2%' AS first FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, item_id LIKE 'z%' ORDER BY ord) - 1 AS k FROM r WHERE NOT first)
SELECT book_id, item_id, substr(item_id, 1, 14) AS legacy_id FROM r WHERE first UNION ALL
SELECT book_id, item_id, strftime(make_timestamp((CASE WHEN item_id LIKE 'z%' THEN 1706745600 ELSE 1704067240 END + k) * 1000000), '%Y%m%d%H%M%S') FROM n""")
def f6b(spark, sf):
    return lg.assign_legacy_ids(stamped(spark, sf), now="20240201000000")


@query("I18_to_legacy", ctes("items") + """
SELECT item_id, CASE WHEN type = 'separator' THEN 'BookmarkSeparator' ELSE 'Description' END AS element,
  CASE WHEN marked AND type = '' THEN 'marked' WHEN type = 'postit' THEN 'note' WHEN type = 'note' THEN 'notex' ELSE type END AS type,
  replace(comment, chr(10), ' __BR__ ') AS comment, nullif(substr("create", 1, 14), '') AS "create", CASE WHEN locked THEN 'true' ELSE '' END AS lock FROM items""")
def i18(spark, sf):
    it = fx.items(spark, sf)
    ids = it.select("book_id", "item_id", F.col("item_id").alias("legacy_id"))
    return lg.to_legacy(it, ids).select("item_id", "element", "type", "comment", "create", "lock")


@query("I18_from_legacy", """
WITH o AS (SELECT '2023' || lpad(CAST(o_orderkey % 10000000000 AS VARCHAR), 10, '0') AS raw, o_orderkey AS k, o_orderdate AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT k, CASE substr(p, 1, 1) WHEN '1' THEN 'postit' WHEN '2' THEN 'note' WHEN '3' THEN '' WHEN '4' THEN 'bookmark' ELSE 'folder' END AS type,
  substr(p, 1, 1) = '3' AS marked, CASE WHEN substr(p, 1, 1) IN ('1', '2', '3') THEN strftime(d, '%Y%m%d%H%M%S') || '/index.html' END AS index,
  strftime(d, '%Y%m%d%H%M%S') || '000' AS "create", p || chr(10) || s AS comment, s = 'F' AS locked,
  CASE WHEN k % 3 = 0 THEN CASE WHEN substr(p, 1, 1) IN ('1', '2', '3') THEN '../../icon/a%20b.png' ELSE '../icon/a%20b.png' END WHEN k % 3 = 1 THEN '' ELSE 'favicon.ico' END AS icon FROM o""")
def i18b(spark, sf):
    o = table(spark, sf, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    k = F.col("o_orderkey")
    kind = F.when(p == "1", "note").when(p == "2", "notex").when(p == "3", "marked").when(p == "4", "bookmark").otherwise("folder")
    icon = F.when(k % 3 == 0, "resource://scrapbook/icon/a%20b.png").when(k % 3 == 1, "moz-icon://x.pdf").otherwise("favicon.ico")
    props = F.create_map(F.lit("type"), kind, F.lit("comment"), F.concat("o_orderpriority", F.lit(" __BR__ "), "o_orderstatus"),
                         F.lit("lock"), F.when(F.col("o_orderstatus") == "F", "true").otherwise(""), F.lit("icon"), icon)
    rows = o.select(F.lit("b").alias("book_id"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("legacy_id"), k.alias("ord"), props.alias("props"))
    out = lg.from_legacy(rows)
    return out.select(F.col("ord").alias("k"), "type", "marked", "index", "create", "comment", "locked", "icon")


@query("C13_icon_targets", ctes("items") + """
SELECT book_id, item_id, CASE WHEN icon = '' THEN '' WHEN icon LIKE 'https:%' OR icon LIKE '/%' THEN icon
  WHEN icon LIKE '../tree/%' AND index NOT LIKE '%/index.html' THEN 'resource://scrapbook/icon/' || substr(icon, 17)
  WHEN icon LIKE '../tree/%' THEN 'resource://scrapbook/data/' || substr(icon, 4)
  WHEN index LIKE '%/index.html' THEN 'resource://scrapbook/data/L' || substr(item_id, 2) || '/favicon.ico' ELSE 'resource://scrapbook/data/favicon.ico' END AS legacy_icon FROM items""")
def c13(spark, sf):
    it = fx.items(spark, sf)
    ids = it.select("book_id", "item_id", F.concat(F.lit("L"), F.expr("substring(item_id, 2)")).alias("legacy_id"))
    return lg.icon_targets(it, ids).select("book_id", "item_id", "legacy_icon")
