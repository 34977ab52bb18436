"""Directory listings as tables, and directories turned into catalogues."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mime import path_is_html
from ..functions.scalars import item_id_of
from ..runtime import stage
from ..scale import rank_rows
from ..schema import ROOT, SUPPORT_SUFFIXES


def list_files(spark: SparkSession, base: str, pattern: str | None = None, content: bool = False) -> DataFrame:
    """Files below ``base``: path (relative), type, size, mtime; bytes only when asked."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = base.rstrip("/")
    raw = reader.load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^.*?" + root.replace(".", r"\.") + "/", "")
    cols = [rel.alias("path"), F.lit("file").alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return raw.select(*cols, *([F.col("content")] if content else []))


def ancestors(path: Column) -> Column:
    """Array of all proper ancestor folders of a path."""
    segs = F.split(path, "/")
    return F.when(F.size(segs) > 1, F.transform(
        F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def with_folders(files: DataFrame, by=()) -> DataFrame:
    """Listing with one ``dir`` row per folder; folders have no size and no time."""
    dirs = (files.select(*by, F.explode(ancestors(F.col("path"))).alias("path")).distinct()
            .select(*by, "path", F.lit("dir").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime")))
    return files.select(*by, "path", "type", "size", "mtime").unionByName(dirs)


def directory_listing(files: DataFrame, folder: str = "", recursive: bool = False, by=()) -> DataFrame:
    """Entries in (or below) one folder, names relative to it."""
    everything = with_folders(files, by)
    base = folder.rstrip("/") + "/" if folder else ""
    inside = everything.filter(F.col("path").startswith(base)).withColumn("name", F.substr(F.col("path"), F.lit(len(base) + 1)))
    if not recursive:
        inside = inside.filter(~F.col("name").contains("/"))
    return inside.select(*by, "name", "type", "size", "mtime")


def ingest_directory(files: DataFrame, now: str, suffixes=SUPPORT_SUFFIXES):
    """Files -> (items, edges, entries): folders become folder items, pages and files become items.

    A folder with an index.html is one item; support folders of pages are skipped.
    ``entries``: (book_id, path, item_id) for metadata extraction.  Order is path order.
    """
    dirs = stage(with_folders(files, ["book_id"]))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    whole = (dirs.filter("type = 'file'").filter(F.regexp_extract("path", r"([^/]+)$", 1) == "index.html")
             .filter(F.col("path").contains("/")).select("book_id", folder.alias("path"), F.lit("page").alias("role")).distinct())
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    support = (dirs.filter("type = 'file'").filter(path_is_html("path"))
               .select("book_id", F.explode(F.array(*[F.concat(stem, F.lit(s)) for s in suffixes])).alias("path")).distinct())
    closed = whole.select("book_id", F.col("path").alias("up")).unionByName(support.select("book_id", F.col("path").alias("up"))).distinct()
    hidden = (dirs.select("book_id", "path", F.explode(ancestors(F.col("path"))).alias("up"))
              .join(closed, ["book_id", "up"], "left_semi").select("book_id", "path").distinct())
    seen = (dirs.join(hidden, ["book_id", "path"], "left_anti")
            .join(support, ["book_id", "path"], "left_anti").join(whole, ["book_id", "path"], "left"))
    kind = F.when(F.col("type") == "file", "file").when(F.col("role").isNotNull(), "page").otherwise("folder")
    ranked = rank_rows(seen.select("book_id", "path", kind.alias("kind"), "mtime"), ["book_id"], ["path"], "ord")
    millis = F.unix_millis(F.to_timestamp(F.lit(now[:14]), "yyyyMMddHHmmss")) + F.lit(int(now[14:17]))
    ided = stage(ranked.withColumn("item_id", F.date_format(F.timestamp_millis(millis + F.col("ord")), "yyyyMMddHHmmssSSS")))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    title = F.when(F.col("kind") == "folder", F.regexp_replace(name, r"(?i)(?<=.)\.htd$", "")).otherwise(name)
    page_like = F.col("path").rlike(r"(?i)\.(html|htz|maff|htm|xhtml|xht|svg)$")
    items = ided.select(
        "book_id", "item_id", "ord", title.alias("title"),
        F.when(F.col("kind") == "folder", "folder").when((F.col("kind") == "file") & ~page_like, "file").otherwise("").alias("type"),
        F.when(F.col("kind") == "page", F.concat("path", F.lit("/index.html"))).when(F.col("kind") == "file", F.col("path")).otherwise("").alias("index"),
        F.lit(now).alias("create"), F.coalesce(item_id_of("mtime"), F.lit(now)).alias("modify"))
    up = ided.select("book_id", F.col("path").alias("up"), F.col("item_id").alias("__parent"))
    linked = ided.withColumn("up", folder).join(up, ["book_id", "up"], "left").withColumn("parent_id", F.coalesce("__parent", F.lit(ROOT)))
    edges = (rank_rows(linked.select("book_id", "parent_id", "path", "item_id"), ["book_id", "parent_id"], ["path"], "pos")
             .select("book_id", "parent_id", "pos", F.col("item_id").alias("child_id")))
    return items, edges, ided.select("book_id", "path", "item_id", "kind")


def legacy_data_scan(files: DataFrame) -> DataFrame:
    """Old data folders named by a 14..23-digit id: time of their index.html and a sitemap flag."""
    rx = r"^data/([0-9]{14,23}[^/]*)/(index\.html|sitemap\.xml)$"
    rows = files.filter(F.col("path").rlike(rx)).select(
        "book_id", F.regexp_extract("path", rx, 1).alias("legacy_id"), F.regexp_extract("path", rx, 2).alias("name"), "mtime")
    agg = rows.groupBy("book_id", "legacy_id").agg(
        F.max(F.when(F.col("name") == "index.html", F.col("mtime"))).alias("__m"), F.max(F.col("name") == "sitemap.xml").alias("has_sitemap"))
    return agg.filter("__m is not null").select("book_id", "legacy_id", item_id_of("__m").alias("modify"), "has_sitemap")
