"""Catalogue tables derived from the test parquet tables.

``book_*`` functions build them with the DataFrame API; ``SQL`` holds the same
derivations as DuckDB common table expressions for the oracles.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import item_id_of
from ..runtime import keep


_STORED = {}


def stored(fn):
    """Keep a derived table as a stored one for the life of the Spark application.

    Catalogue tables are files in real use; deriving them is not part of a query.
    """

    @wraps(fn)
    def get(spark, sf):
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _STORED:
            _STORED[key] = keep(fn(spark, sf))
        return _STORED[key]

    return get


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stamp(spark, sf, shift, name):
    """doc_id -> 17-digit id of the event with that number."""
    ev = table(spark, sf, "events")
    return ev.select((F.col("event_id") - shift).alias("doc_id"), item_id_of("ts").alias(name), F.col("ts").alias(f"{name}_ts"))


def documents(spark, sf) -> DataFrame:
    """Documents with their kind and dates."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    n = F.col("doc_id") % 10
    kind = (F.when(F.col("quality") == 1, "note").when(F.col("quality") == 0, "postit")
            .when(n == 3, "bookmark").when(n == 4, "separator").when(n == 5, "folder").when(n == 6, "file").otherwise(""))
    return (d.join(l, "doc_id", "left").join(_stamp(spark, sf, 0, "c"), "doc_id", "left")
            .join(_stamp(spark, sf, 1, "m"), "doc_id", "left").withColumn("type", kind))


@stored
def items(spark, sf) -> DataFrame:
    """One book per language; a folder per source, an item per document."""
    d = documents(spark, sf)
    n = F.col("doc_id")
    iid = F.concat(F.lit("D"), n)
    index = (F.when(F.col("type").isin("folder", "separator", "bookmark"), "")
             .when(n % 4 == 1, F.concat(iid, F.lit(".htz"))).when(n % 4 == 2, F.concat(iid, F.lit(".html")))
             .when(n % 4 == 3, F.concat(iid, F.lit(".maff"))).otherwise(F.concat(iid, F.lit("/index.html"))))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/page%20"),
                   n, F.lit(".html#s"), n % 3)
    icon = (F.when(n % 7 == 0, "https://icons.example.com/a.png").when(n % 7 == 1, "//icons.example.com/b.png")
            .when(n % 7 == 2, "/favicon.ico").when(n % 7 == 3, "favicon.ico")
            .when(n % 7 == 4, F.concat(F.lit("../tree/favicon/"), F.md5(F.col("source")), F.lit(".png"))).otherwise(""))
    blank = n % 13 == 0
    docs = d.select(
        F.col("lang").alias("book_id"), iid.alias("item_id"), n.alias("ord"), index.alias("index"),
        F.substring("text", 1, 40).alias("title"), "type",
        F.when(blank, "").otherwise(F.col("c")).alias("create"), F.when(blank, "").otherwise(F.col("m")).alias("modify"),
        F.when(n % 17 == 0, "").otherwise(url).alias("source"), icon.alias("icon"),
        F.substring("text", 41, 60).alias("comment"),
        F.when(n % 5 == 0, "utf-8").when(n % 5 == 1, "big5").otherwise("").alias("charset"),
        F.when(n % 31 == 0, '{"lat":1}').otherwise("").alias("location"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("marked"), (n % 11 == 0).alias("locked"))
    k = F.regexp_extract("source", "([0-9]+)$", 1)
    folders = table(spark, sf, "documents").select("lang", "source").distinct().select(
        F.col("lang").alias("book_id"), F.concat(F.lit("S"), k).alias("item_id"),
        (k.cast("long") - 1000000).alias("ord"), F.lit("").alias("index"), F.col("source").alias("title"),
        F.lit("folder").alias("type"), F.lit("").alias("create"), F.lit("").alias("modify"), F.lit("").alias("source"),
        F.lit("").alias("icon"), F.lit("").alias("comment"), F.lit("").alias("charset"), F.lit("").alias("location"),
        F.lit(False).alias("marked"), F.lit(False).alias("locked"))
    return docs.unionByName(folders)


@stored
def edges(spark, sf) -> DataFrame:
    """root -> source folder -> document; some documents hidden, recycled or listed twice."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    k = F.regexp_extract("source", "([0-9]+)$", 1)
    n, iid = F.col("doc_id"), F.concat(F.lit("D"), F.col("doc_id"))
    folder = F.concat(F.lit("S"), k)
    tops = d.select(F.col("lang").alias("book_id"), F.lit("root").alias("parent_id"), k.cast("long").alias("pos"),
                    folder.alias("child_id")).distinct()
    parent = F.when(n % 19 == 0, "hidden").when(n % 23 == 0, "recycle").otherwise(folder)
    docs = d.select(F.col("lang").alias("book_id"), parent.alias("parent_id"), n.alias("pos"), iid.alias("child_id"))
    extra = d.filter(n % 29 == 0).select(F.col("lang").alias("book_id"), F.lit("root").alias("parent_id"),
                                         (n + 1000000).alias("pos"), iid.alias("child_id"))
    return tops.unionByName(docs).unionByName(extra)


def fulltext(spark, sf) -> DataFrame:
    """index.html for most documents, a second page for some."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    base = [F.col("lang").alias("book_id"), F.concat(F.lit("D"), F.col("doc_id")).alias("item_id")]
    first = d.filter("doc_id % 7 <> 0").select(*base, F.lit("index.html").alias("path"), F.lit(0).cast("long").alias("ord"),
                                               F.col("text").alias("content"))
    second = d.filter("doc_id % 50 = 1").select(*base, F.lit("page2.html").alias("path"), F.lit(1).cast("long").alias("ord"),
                                                F.substring("text", 1, 200).alias("content"))
    return first.unionByName(second)


@stored
def files(spark, sf) -> DataFrame:
    """Data files of most items, unindexed extras, favicons."""
    it = items(spark, sf).filter("index <> ''").select("book_id", "index", "ord")
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    stamp = _stamp(spark, sf, 1, "m").select("doc_id", "m_ts")
    have = (it.filter("ord % 9 <> 2").withColumnRenamed("ord", "doc_id")
            .join(d.select("doc_id", "n_chars"), "doc_id").join(stamp, "doc_id")
            .select("book_id", F.col("index").alias("path"), F.col("n_chars").alias("size"),
                    (F.col("m_ts").cast("timestamp") + F.make_interval(mins=(F.col("doc_id") % 3 * 9).cast("int"))).alias("mtime")))
    fixed = F.lit("2024-01-15 00:00:00").cast("timestamp").alias("mtime")

    def extra(cond, *path):
        return d.filter(cond).select(F.col("lang").alias("book_id"), F.concat(*path).alias("path"),
                                     F.col("n_chars").alias("size"), fixed)

    n, x = F.col("doc_id").cast("string"), F.lit
    out = have
    for part in (
        extra("doc_id % 12 = 5", x("X"), n, x(".html")),
        extra("doc_id % 12 = 5", x("X"), n, x(".files/a.html")),
        extra("doc_id % 12 = 7", x("Y"), n, x("/index.html")),
        extra("doc_id % 12 = 7", x("Y"), n, x("/sub/b.html")),
        extra("doc_id % 12 = 8", x("Z"), n, x("/c.HTM")),
        extra("doc_id % 12 = 8", x("Z"), n, x("/c.png")),
        extra("doc_id % 4 = 0", x("D"), n, x("/inner.html")),
        extra("doc_id % 4 = 2", x("D"), n, x("_files/frame.html")),
    ):
        out = out.unionByName(part)
    return out


SQL = {}

SQL["docs"] = """docs AS (
  SELECT d.*, l.toxic, c.ts AS c_ts, m.ts AS m_ts, strftime(c.ts, '%Y%m%d%H%M%S%g') AS c, strftime(m.ts, '%Y%m%d%H%M%S%g') AS m,
    CASE WHEN l.quality = 1 THEN 'note' WHEN l.quality = 0 THEN 'postit' WHEN d.doc_id % 10 = 3 THEN 'bookmark'
      WHEN d.doc_id % 10 = 4 THEN 'separator' WHEN d.doc_id % 10 = 5 THEN 'folder' WHEN d.doc_id % 10 = 6 THEN 'file' ELSE '' END AS type
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN events c ON c.event_id = d.doc_id
  LEFT JOIN events m ON m.event_id = d.doc_id + 1)"""
SQL["items"] = SQL["docs"] + """, items AS (
  SELECT lang AS book_id, 'D' || doc_id AS item_id, doc_id AS ord,
    CASE WHEN type IN ('folder', 'separator', 'bookmark') THEN '' WHEN doc_id % 4 = 1 THEN 'D' || doc_id || '.htz'
      WHEN doc_id % 4 = 2 THEN 'D' || doc_id || '.html' WHEN doc_id % 4 = 3 THEN 'D' || doc_id || '.maff'
      ELSE 'D' || doc_id || '/index.html' END AS index,
    substr(text, 1, 40) AS title, type,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE c END AS create, CASE WHEN doc_id % 13 = 0 THEN '' ELSE m END AS modify,
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'https://' || source || '.example.com/' || lang || '/page%20' || doc_id || '.html#s' || (doc_id % 3) END AS source,
    CASE doc_id % 7 WHEN 0 THEN 'https://icons.example.com/a.png' WHEN 1 THEN '//icons.example.com/b.png' WHEN 2 THEN '/favicon.ico'
      WHEN 3 THEN 'favicon.ico' WHEN 4 THEN '../tree/favicon/' || md5(source) || '.png' ELSE '' END AS icon,
    substr(text, 41, 60) AS comment,
    CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'big5' ELSE '' END AS charset,
    CASE WHEN doc_id % 31 = 0 THEN '{"lat":1}' ELSE '' END AS location,
    coalesce(toxic, 0) = 1 AS marked, doc_id % 11 = 0 AS locked
  FROM docs
  UNION ALL
  SELECT DISTINCT lang, 'S' || regexp_extract(source, '([0-9]+)$', 1), CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) - 1000000,
    '', source, 'folder', '', '', '', '', '', '', '', false, false FROM documents)"""
SQL["edges"] = """edges AS (
  SELECT DISTINCT lang AS book_id, 'root' AS parent_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS pos,
    'S' || regexp_extract(source, '([0-9]+)$', 1) AS child_id FROM documents
  UNION ALL SELECT lang, CASE WHEN doc_id % 19 = 0 THEN 'hidden' WHEN doc_id % 23 = 0 THEN 'recycle'
    ELSE 'S' || regexp_extract(source, '([0-9]+)$', 1) END, doc_id, 'D' || doc_id FROM documents
  UNION ALL SELECT lang, 'root', doc_id + 1000000, 'D' || doc_id FROM documents WHERE doc_id % 29 = 0)"""
SQL["fulltext"] = """fulltext AS (
  SELECT lang AS book_id, 'D' || doc_id AS item_id, 'index.html' AS path, 0 AS ord, text AS content FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT lang, 'D' || doc_id, 'page2.html', 1, substr(text, 1, 200) FROM documents WHERE doc_id % 50 = 1)"""
SQL["files"] = """files AS (
  SELECT i.book_id, i.index AS path, d.n_chars AS size, d.m_ts + to_minutes(CAST(d.doc_id % 3 * 9 AS BIGINT)) AS mtime
    FROM items i JOIN docs d ON i.item_id = 'D' || d.doc_id WHERE i.index <> '' AND d.doc_id % 9 <> 2
  UNION ALL SELECT lang, 'X' || doc_id || '.html', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 12 = 5
  UNION ALL SELECT lang, 'X' || doc_id || '.files/a.html', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 12 = 5
  UNION ALL SELECT lang, 'Y' || doc_id || '/index.html', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 12 = 7
  UNION ALL SELECT lang, 'Y' || doc_id || '/sub/b.html', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 12 = 7
  UNION ALL SELECT lang, 'Z' || doc_id || '/c.HTM', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 12 = 8
  UNION ALL SELECT lang, 'Z' || doc_id || '/c.png', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 12 = 8
  UNION ALL SELECT lang, 'D' || doc_id || '/inner.html', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT lang, 'D' || doc_id || '_files/frame.html', n_chars, TIMESTAMP '2024-01-15 00:00:00' FROM documents WHERE doc_id % 4 = 2)"""


# -- the star schema as one deep book ---------------------------------------------

@stored
def star_edges(spark, sf) -> DataFrame:
    """root > region > nation > customer > order; ``F`` orders recycled; back links customer > nation."""
    def e(df, parent, pos, child):
        return df.select(F.lit("star").alias("book_id"), parent.alias("parent_id"), pos.cast("long").alias("pos"), child.alias("child_id"))

    def tag(letter, col):
        return F.concat(F.lit(letter), F.col(col))

    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    parent = F.when(F.col("o_orderstatus") == "F", "recycle").otherwise(tag("C", "o_custkey"))
    return (e(r, F.lit("root"), F.col("r_regionkey"), tag("R", "r_regionkey"))
            .unionByName(e(n, tag("R", "n_regionkey"), F.col("n_nationkey"), tag("N", "n_nationkey")))
            .unionByName(e(c, tag("N", "c_nationkey"), F.col("c_custkey"), tag("C", "c_custkey")))
            .unionByName(e(o, parent, F.col("o_orderkey"), tag("O", "o_orderkey")))
            .unionByName(e(c.filter("c_custkey % 50 = 0"), tag("C", "c_custkey"), F.col("c_custkey") + 1000000000,
                           F.concat(F.lit("N"), F.col("c_custkey") % 25))))


@stored
def star_items(spark, sf) -> DataFrame:
    """Regions, nations and customers as folders, orders as pages (every 97th order has no item)."""
    def i(df, letter, key, title, kind, create):
        return df.select(F.lit("star").alias("book_id"), F.concat(F.lit(letter), F.col(key)).alias("item_id"),
                         F.col(key).cast("long").alias("ord"), title.alias("title"), kind.alias("type"), create.alias("create"))

    o = table(spark, sf, "orders").filter("o_orderkey % 97 <> 5")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("", "bookmark", "note", "postit", "folder")]),
                         F.substring("o_orderpriority", 1, 1).cast("int"))
    folder, blank = F.lit("folder"), F.lit("")
    return (i(table(spark, sf, "region"), "R", "r_regionkey", F.col("r_name"), folder, blank)
            .unionByName(i(table(spark, sf, "nation"), "N", "n_nationkey", F.col("n_name"), folder, blank))
            .unionByName(i(table(spark, sf, "customer"), "C", "c_custkey", F.col("c_mktsegment"), folder, blank))
            .unionByName(i(o, "O", "o_orderkey", F.col("o_orderpriority"), kinds, item_id_of("o_orderdate"))))


SQL["star_edges"] = """star_edges AS (
  SELECT 'star' AS book_id, 'root' AS parent_id, CAST(r_regionkey AS BIGINT) AS pos, 'R' || r_regionkey AS child_id FROM region
  UNION ALL SELECT 'star', 'R' || n_regionkey, n_nationkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'star', 'N' || c_nationkey, c_custkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'star', CASE WHEN o_orderstatus = 'F' THEN 'recycle' ELSE 'C' || o_custkey END, o_orderkey, 'O' || o_orderkey FROM orders
  UNION ALL SELECT 'star', 'C' || c_custkey, c_custkey + 1000000000, 'N' || (c_custkey % 25) FROM customer WHERE c_custkey % 50 = 0)"""
SQL["star_items"] = """star_items AS (
  SELECT 'star' AS book_id, 'R' || r_regionkey AS item_id, CAST(r_regionkey AS BIGINT) AS ord, r_name AS title, 'folder' AS type, '' AS create FROM region
  UNION ALL SELECT 'star', 'N' || n_nationkey, n_nationkey, n_name, 'folder', '' FROM nation
  UNION ALL SELECT 'star', 'C' || c_custkey, c_custkey, c_mktsegment, 'folder', '' FROM customer
  UNION ALL SELECT 'star', 'O' || o_orderkey, o_orderkey, o_orderpriority,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '' WHEN '2' THEN 'bookmark' WHEN '3' THEN 'note' WHEN '4' THEN 'postit' ELSE 'folder' END,
    strftime(o_orderdate, '%Y%m%d%H%M%S%g') FROM orders WHERE o_orderkey % 97 <> 5)"""


# -- conversations as a tree with shared parents and cycles ------------------------

@stored
def talk_edges(spark, sf) -> DataFrame:
    """Answers hang under the turn before; every 10th conversation loops; every 7th is hidden as well."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    conv = F.concat(F.lit("V"), F.col("conv_id"))

    def turn(x):
        return F.concat(conv, F.lit("."), x)

    def e(df, parent, pos, child):
        return df.select(F.lit("talk").alias("book_id"), parent.alias("parent_id"), pos.cast("long").alias("pos"), child.alias("child_id"))

    nested = (F.col("role") == "assistant") & (F.col("turn") > 0)
    convs = t.select("conv_id").distinct()
    return (e(convs, F.lit("root"), F.col("conv_id"), conv)
            .unionByName(e(t.filter(~nested), conv, F.col("turn"), turn(F.col("turn"))))
            .unionByName(e(t.filter(nested), turn(F.col("turn") - 1), F.lit(0), turn(F.col("turn"))))
            .unionByName(e(t.filter("conv_id % 10 = 0 and turn = 1"), turn(F.col("turn")), F.lit(1), conv))
            .unionByName(e(convs.filter("conv_id % 7 = 0"), F.lit("hidden"), F.col("conv_id"), conv)))


@stored
def talk_items(spark, sf) -> DataFrame:
    """Conversations are folders; turns are notes, bookmarks (system) or separators (empty titles)."""
    t = table(spark, sf, "conversations")
    conv = F.concat(F.lit("V"), F.col("conv_id"))
    folders = t.select("conv_id").distinct().select(
        F.lit("talk").alias("book_id"), conv.alias("item_id"), (F.col("conv_id") * 1000).alias("ord"),
        F.concat(F.lit("Talk "), F.col("conv_id") % 5).alias("title"), F.lit("folder").alias("type"),
        F.lit("").alias("index"), F.lit("").alias("source"), F.lit("").alias("icon"))
    kind = F.when(F.col("role") == "system", "bookmark").when(F.col("turn") % 4 == 3, "separator").otherwise("")
    iid = F.concat(conv, F.lit("."), F.col("turn"))
    turns = t.select(
        F.lit("talk").alias("book_id"), iid.alias("item_id"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("ord"),
        F.when(kind == "separator", "").otherwise(F.substring("text", 1, 12)).alias("title"), kind.alias("type"),
        F.when(kind == "", F.concat(iid, F.when(F.col("turn") % 2 == 0, "/index.html").otherwise(".txt"))).otherwise("").alias("index"),
        F.when(kind == "bookmark", F.concat(F.lit("https://talk.example.com/"), F.col("conv_id"), F.lit("?a=1&b"))).otherwise("").alias("source"),
        F.when(F.col("turn") == 0, "../favicon.png").otherwise("").alias("icon"))
    return folders.unionByName(turns)


SQL["talk_edges"] = """talk_edges AS (
  SELECT DISTINCT 'talk' AS book_id, 'root' AS parent_id, conv_id AS pos, 'V' || conv_id AS child_id FROM conversations
  UNION ALL SELECT 'talk', 'V' || conv_id, turn, 'V' || conv_id || '.' || turn FROM conversations WHERE NOT (role = 'assistant' AND turn > 0)
  UNION ALL SELECT 'talk', 'V' || conv_id || '.' || (turn - 1), 0, 'V' || conv_id || '.' || turn FROM conversations WHERE role = 'assistant' AND turn > 0
  UNION ALL SELECT 'talk', 'V' || conv_id || '.' || turn, 1, 'V' || conv_id FROM conversations WHERE conv_id % 10 = 0 AND turn = 1
  UNION ALL SELECT DISTINCT 'talk', 'hidden', conv_id, 'V' || conv_id FROM conversations WHERE conv_id % 7 = 0)"""
SQL["talk_items"] = """talk_items AS (
  SELECT DISTINCT 'talk' AS book_id, 'V' || conv_id AS item_id, conv_id * 1000 AS ord, 'Talk ' || (conv_id % 5) AS title, 'folder' AS type,
    '' AS index, '' AS source, '' AS icon FROM conversations
  UNION ALL SELECT 'talk', 'V' || conv_id || '.' || turn, conv_id * 1000 + turn + 1, CASE WHEN kind = 'separator' THEN '' ELSE substr(text, 1, 12) END, kind,
    CASE WHEN kind = '' THEN 'V' || conv_id || '.' || turn || CASE WHEN turn % 2 = 0 THEN '/index.html' ELSE '.txt' END ELSE '' END,
    CASE WHEN kind = 'bookmark' THEN 'https://talk.example.com/' || conv_id || '?a=1&b' ELSE '' END,
    CASE WHEN turn = 0 THEN '../favicon.png' ELSE '' END
  FROM (SELECT *, CASE WHEN role = 'system' THEN 'bookmark' WHEN turn % 4 = 3 THEN 'separator' ELSE '' END AS kind FROM conversations))"""
SQL["talk_paths"] = """talk_paths AS (
  SELECT 'talk' AS book_id, r.id AS item_id, CAST(NULL AS BIGINT) AS pos, [r.k] AS addr, CAST([] AS VARCHAR[]) AS path, false AS cyc
  FROM (VALUES ('root', CAST(0 AS BIGINT)), ('hidden', 1), ('recycle', 2)) r(id, k)
  UNION ALL
  SELECT e.book_id, e.child_id, e.pos, list_append(p.addr, e.pos), list_append(p.path, p.item_id),
    list_contains(list_append(p.path, p.item_id), e.child_id)
  FROM talk_paths p JOIN talk_edges e ON e.parent_id = p.item_id AND NOT p.cyc)"""


def ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named derivations, in order."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names) + "\n"
