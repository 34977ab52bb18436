"""Text index: what to refresh, how pages of an item are found, how frames fold in."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mime import path_is_archive
from ..runtime import BROADCAST_ROWS, stage
from .graph import reachable
from .pages import page_parts
from .search import value

KEY = ["book_id", "item_id"]


def fingerprint(df: DataFrame, by=("book_id",)) -> DataFrame:
    """Order-free fingerprint of a table per book: row count and two sums of row hashes.

    Sums of hashes combine on the map side, so a book of any size needs one small
    row per task.  Equal tables have equal fingerprints; the order of rows is a
    column (``ord``, ``pos``), hence part of every row's hash.
    """
    doc = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    digest = F.sha1(doc)

    def part(start):
        return F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(20,0)")

    return (df.select(*by, part(1).alias("__a"), part(13).alias("__b"))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.sum("__a").cast("string").alias("sum_a"), F.sum("__b").cast("string").alias("sum_b")))


def changed_books(old: DataFrame, new: DataFrame) -> DataFrame:
    """Books whose table differs: only these need a new snapshot."""
    a = fingerprint(old).withColumnsRenamed({"n_rows": "n0", "sum_a": "a0", "sum_b": "b0"})
    b = fingerprint(new)
    j = a.join(b, "book_id", "full_outer")
    same = (F.col("n0").eqNullSafe(F.col("n_rows")) & F.col("a0").eqNullSafe(F.col("sum_a")) & F.col("b0").eqNullSafe(F.col("sum_b")))
    return j.filter(~same).select("book_id")


def high_water(fulltext: DataFrame) -> DataFrame:
    """Newest source time in the text table per book; the epoch when there is none."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return fulltext.groupBy("book_id").agg(F.coalesce(F.max("src_mtime"), epoch).alias("last_modified"))


def id_pool(items: DataFrame, fulltext: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Ids with metadata or text, in that order, each once; optionally only the asked ones."""
    a = items.select(*KEY, F.lit(0).alias("src"), "ord")
    b = fulltext.select(*KEY, F.lit(1).alias("src"), F.col("ord"))
    pool = (a.unionByName(b).groupBy(*KEY).agg(F.min(F.struct("src", "ord")).alias("o"))
            .select(*KEY, F.col("o.src").alias("src"), F.col("o.ord").alias("ord")))
    return pool if ids is None else pool.join(ids.select(*KEY).distinct(), KEY, "left_semi")


def index_paths(items: DataFrame, maff_pages: DataFrame | None = None) -> DataFrame:
    """(book_id, item_id, path): page paths an item's index stands for.

    A MAFF archive gives all its pages (``maff_pages``: book_id, archive, indexfilename),
    an HTZ its index.html, any other index its base name.
    """
    it = items.filter(value("index") != "")
    ext = F.lower(F.regexp_extract("index", r"\.([^./]*)$", 1))
    plain = it.filter(ext != "maff").select(
        *KEY, F.when(ext == "htz", "index.html").otherwise(F.regexp_extract("index", "([^/]*)$", 1)).alias("path"))
    if maff_pages is None:
        return plain
    pages = maff_pages.select("book_id", F.col("archive").alias("index"), F.col("indexfilename").alias("path"))
    return plain.unionByName(it.filter(ext == "maff").join(pages, ["book_id", "index"]).select(*KEY, "path"))


def classify(items: DataFrame, fulltext: DataFrame, index_files: DataFrame, page_files: DataFrame,
             paths: DataFrame, mark: DataFrame | None = None) -> DataFrame:
    """Refresh action per (item, path): purge_item, purge_path, skip, or extract.

    ``index_files``: (book_id, path, mtime) of index files; ``page_files``: (book_id,
    item_id, path, mtime) of the pages inside items; ``paths``: index paths per item;
    ``mark``: high-water times (from ``fulltext`` by default).
    """
    mark = high_water(fulltext) if mark is None else mark
    cached = fulltext.select(*KEY, "path").distinct()
    have = fulltext.select(*KEY).distinct().withColumn("__cached_item", F.lit(True))
    files = index_files.select("book_id", F.col("path").alias("index"), F.col("mtime").alias("__index_mtime"))
    pool = (items.select(*KEY, value("index").alias("index"), F.lit(True).alias("__meta"))
            .join(have, KEY, "full_outer").join(files, ["book_id", "index"], "left").join(mark, "book_id", "left"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    since = F.coalesce("last_modified", epoch)
    reason = (F.when(F.col("__meta").isNull(), "no metadata").when(F.coalesce("index", F.lit("")) == "", "no index")
              .when(F.col("__index_mtime").isNull(), "no index file"))
    still = path_is_archive("index") & F.coalesce("__cached_item", F.lit(False)) & (F.col("__index_mtime") <= since)
    state = (F.when(reason.isNotNull(), "purge_item").when(still, "skip_archive").otherwise("look"))
    pool = pool.withColumn("state", state).withColumn("reason", reason).withColumn("since", since)
    whole = pool.filter("state <> 'look'").select(
        *KEY, F.lit("").alias("path"), F.when(F.col("state") == "purge_item", "purge_item").otherwise("skip").alias("action"),
        F.coalesce("reason", F.lit("archive not newer")).alias("reason"))
    whole = whole.filter((F.col("action") == "skip") | F.col("reason").isNotNull())
    asked = (paths.unionByName(cached).distinct().join(pool.filter("state = 'look'").select(*KEY, "since"), KEY)
             .join(cached.withColumn("__cached", F.lit(True)), [*KEY, "path"], "left")
             .join(page_files.select(*KEY, "path", "mtime"), [*KEY, "path"], "left"))
    action = (F.when(F.col("mtime").isNull(), F.when(F.col("__cached"), "purge_path").otherwise("ignore"))
              .when(F.coalesce("__cached", F.lit(False)) & (F.col("mtime") <= F.col("since")), "skip").otherwise("extract"))
    why = (F.when(F.col("mtime").isNull(), "no file")
           .when(F.coalesce("__cached", F.lit(False)) & (F.col("mtime") <= F.col("since")), "not newer").otherwise("new or newer"))
    return whole.unionByName(asked.withColumn("action", action).withColumn("reason", why)
                             .filter("action <> 'ignore'").select(*KEY, "path", "action", "reason"))


def crawl(seeds: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Pages of every item reachable from its seeds over relative links to existing files.

    ``seeds``: (key, path); ``links``: (key, path, target); ``files``: (key, path).
    ``hop`` is the round a page was found in.
    """
    node = [*KEY, "path"]
    have = files.select(*node).distinct()
    seen = stage(seeds.select(*node).distinct().join(have, node, "left_semi").withColumn("hop", F.lit(0)))
    frontier, parts, hop = seen, [seen], 0
    while True:
        n = frontier.count()
        if n == 0:
            return reduce(DataFrame.unionByName, parts)
        hop += 1
        small = F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier
        step = links.join(small.select(*node), node).select(*KEY, F.col("target").alias("path")).distinct()
        known = reduce(DataFrame.unionByName, parts).select(*node)
        frontier = stage(step.join(have, node, "left_semi").join(known, node, "left_anti").withColumn("hop", F.lit(hop)))
        parts.append(frontier)
        if len(parts) > 32:
            parts = [stage(reduce(DataFrame.unionByName, parts))]


def inline_frames(pages: DataFrame, inclusive: bool = True) -> DataFrame:
    """Page texts with framed pages folded into the page that frames them.

    ``pages``: (key, path, ord, segments) with ``segments`` as ``pages.page_parts`` gives
    them.  Pages are visited in ``ord``, frames in place; a page met first inside
    a frame is folded there and has no row of its own.  That is a depth-first first
    visit, so the visit address says both who is folded and where its text goes.
    """
    node = [*KEY, "path"]
    segs = stage(pages.select(*node, "ord", F.posexplode("segments").alias("k", "s")).select(
        *node, "ord", "k", F.col("s.text").alias("text"), F.col("s.frame").alias("frame")))
    own = segs.filter("frame is null").select(*node, "k", "text")
    if not inclusive:
        return _join_text(own, pages)
    group = F.concat_ws("\x01", *KEY)
    top = pages.select(group.alias("book_id"), F.lit("").alias("parent_id"), F.col("ord").cast("long").alias("pos"), F.col("path").alias("child_id"))
    inner = segs.filter("frame is not null").select(
        group.alias("book_id"), F.col("path").alias("parent_id"), F.col("k").cast("long").alias("pos"), F.col("frame").alias("child_id"))
    seen = reachable(top.unionByName(inner), "", with_order=True).filter("item_id <> ''")
    halves = F.split("book_id", "\x01")
    placed = stage(seen.select(F.get(halves, F.lit(0)).alias("book_id"), F.get(halves, F.lit(1)).alias("item_id"),
                               F.col("item_id").alias("path"), F.element_at("addr", 2).alias("ord"),
                               F.slice("addr", F.lit(3), F.size("addr")).alias("place")))
    roots = placed.filter(F.size("place") == 0)
    outer = roots.select(*KEY, "ord", F.col("path").alias("outer"))
    parts = (own.join(placed, node).join(outer, [*KEY, "ord"])
             .select(*KEY, F.col("outer").alias("path"), F.concat("place", F.array(F.col("k").cast("long"))).alias("k"), "text"))
    return _join_text(parts, roots)


def _join_text(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """Concatenate the pieces of each page; bounded by what one page (with its frames) holds."""
    from ..functions.scalars import squeeze
    node = [*KEY, "path"]
    text = parts.groupBy(*node).agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("__t")).select(
        *node, squeeze(F.array_join(F.transform("__t", lambda s: s["text"]), " ")).alias("content"))
    return pages.select(*node).distinct().join(text, node, "left").withColumn("content", F.coalesce("content", F.lit("")))


def extract(files: DataFrame, charset: str | None = None) -> DataFrame:
    """Files (key, path, ord, content) -> the same with ``segments``, ``links`` and ``redirect``."""
    parts = page_parts(F.col("content"), F.col("path"), F.col(charset) if charset else None)
    return files.withColumn("__p", parts).select(*[c for c in files.columns if c != "content"], "__p.*")


def apply_refresh(fulltext: DataFrame, actions: DataFrame, extracted: DataFrame) -> DataFrame:
    """New text snapshot: purged and re-extracted rows out, extracted rows in."""
    gone_items = actions.filter("action = 'purge_item'").select(*KEY).distinct()
    gone_paths = actions.filter("action in ('purge_path', 'extract')").select(*KEY, "path").distinct()
    kept = fulltext.join(gone_items, KEY, "left_anti").join(gone_paths, [*KEY, "path"], "left_anti")
    return kept.unionByName(extracted.select(*fulltext.columns))
