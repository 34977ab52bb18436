"""Pages of a directory as items of a book, with what the pages say of themselves."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import item_id_of
from ..runtime import stage
from ..scale import rank_rows
from ..schema import ROOT
from ..sources.files import ingest_directory
from .pages import choose_ids, page_marks, page_metadata

PAGE_KEY = ["book_id", "path"]


def ingest_pages(files: DataFrame, items: DataFrame, now: str, html: str = r"(?i)\.(html|htm|xhtml|xht)$"):
    """``files`` (book_id, path, type, size, mtime, content) -> (items, edges, problems).

    Folders become folder items, pages and files become items, as in ``ingest_directory``.  A page's
    title, type, times, source, icon, comment and charset are those it names itself; without a title
    the file name is the title.  An item takes the id that its page asks for, else a date in its file
    or folder name that is free, else the next free one from ``now``, all in one allocation in path
    order against the ids of ``items``.  Pages that ask for a reserved or used id are ``problems``
    (book_id, path, given_id, problem) and are left out.
    """
    plain, links, entries = ingest_directory(files.drop("content"), now)
    plain, links = stage(plain), stage(links)
    known = stage(entries.select(*PAGE_KEY, "item_id", "kind").join(plain.select("book_id", "item_id", "ord", "index"), ["book_id", "item_id"]))
    texts = files.select("book_id", F.col("path").alias("index"), F.decode("content", "UTF-8").alias("html"))
    times = files.select("book_id", F.col("path").alias("index"), item_id_of("mtime").alias("__time"))
    pages = known.filter(F.col("index").rlike(html)).select(*PAGE_KEY, "index").join(texts, ["book_id", "index"]).select(*PAGE_KEY, "html")
    meta = stage(page_metadata(page_marks(pages, PAGE_KEY)).withColumn("__page", F.lit(True)))
    wanted = known.join(meta.select(*PAGE_KEY, "given_id"), PAGE_KEY, "left").select("book_id", "ord", "path", "given_id", F.col("item_id").alias("__old"))
    chosen = stage(choose_ids(wanted, items, now))
    good = chosen.filter("problem is null").select("book_id", "path", "__old", "item_id")

    def said(name, other):
        return F.coalesce(F.when(F.coalesce(F.col(f"m.{name}"), F.lit("")) != "", F.col(f"m.{name}")), other).alias(name)

    none = F.lit("")
    out = (good.alias("g").join(plain.alias("p").withColumnRenamed("item_id", "__old"), ["book_id", "__old"])
           .join(times, ["book_id", "index"], "left").join(meta.alias("m"), PAGE_KEY, "left")
           .select("book_id", F.col("g.item_id").alias("item_id"), "p.ord", said("title", F.col("p.title")), said("type", F.col("p.type")), "index",
                   said("create", F.col("p.create")), said("modify", F.coalesce("__time", F.col("p.modify"))), *(said(c, none) for c in ("source", "icon", "comment", "charset"))))
    child = good.select("book_id", F.col("__old").alias("child_id"), F.col("item_id").alias("__child"))
    parent = good.select("book_id", F.col("__old").alias("parent_id"), F.col("item_id").alias("__parent"))
    kept = (links.join(child, ["book_id", "child_id"]).join(parent, ["book_id", "parent_id"], "left")
            .select("book_id", F.coalesce("__parent", F.lit(ROOT)).alias("parent_id"), F.col("pos").alias("__pos"), F.col("__child").alias("child_id")))
    edges = rank_rows(kept, ["book_id", "parent_id"], ["__pos"], "pos").select("book_id", "parent_id", "pos", "child_id")
    return out, edges, chosen.filter("problem is not null").select(*PAGE_KEY, "given_id", "problem")
