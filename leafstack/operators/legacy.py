"""Mapping catalogues to and from the older RDF layout."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    icon_file, item_id_of, legacy_id_of, percent_decode, percent_encode, relative_path, ts_of_item_id, ts_of_legacy_id,
)
from ..runtime import stage
from ..scale import claim_slots
from ..schema import INDEX_OPTIONAL_TYPES
from .search import value

# --- fixed values -----------------------------------------------------------
TYPE_IN = {"note": "postit", "notex": "note"}
TYPE_OUT = {"postit": "note", "note": "notex"}
RESOURCE_BASE = "resource://scrapbook/"
MOZ_ICON_BASE = "moz-icon://"
LINE_BREAK = " __BR__ "
HOUSEKEEPING = ("folder", "exported", "container")
# page markup that a migration would rewrite: rule -> pattern
MARKUP_RULES = {
    "annotation_css": r"(?i)<link\b[^>]*href=[\"']?chrome://scrapbook/skin/annotation\.css",
    "combine_css": r"(?i)<link\b[^>]*href=[\"']?chrome://scrapbook/skin/combine\.css",
    "combine_icon": r"(?i)<img\b[^>]*src=[\"']?chrome://scrapbook/skin/tree(?:folder|note|notex|item)\.png",
    "annotation_class": r"(?i)class=[\"'](?:[^\"']* )?(?:linemarker-marked-line|scrapbook-inline|scrapbook-sticky"
                        r"|scrapbook-sticky-header|scrapbook-sticky-footer|scrapbook-block-comment)[ \"']",
    "annotation_attr": r"(?i)<[a-z][^>]*\sdata-sb-(?:obj|id|orig-[a-z]+)=",
    "old_loader": r"(?i)<script\b[^>]*data-scrapbook-elem=[\"']?(?:canvas-loader|shadowroot-loader)",
    "shadowroot_attr": r"(?i)<[a-z][^>]*\sdata-scrapbook-shadowroot=",
}
# ----------------------------------------------------------------------------


def markup_flags(html: Column) -> list:
    return [html.rlike(rx).alias(name) for name, rx in MARKUP_RULES.items()]


def markup_census(pages: DataFrame, html: str = "html", by=()) -> DataFrame:
    """Pages needing each rewrite."""
    flags = pages.select(*by, *markup_flags(F.col(html)))
    sums = [F.count_if(F.col(n)).alias(n) for n in MARKUP_RULES]
    any_ = reduce(lambda a, b: a | b, [F.col(n) for n in MARKUP_RULES])
    return flags.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), *sums, F.count_if(any_).alias("any_rule"))


def from_legacy(rows: DataFrame, modified: DataFrame | None = None, tz: str = "UTC") -> DataFrame:
    """Old records -> item columns.

    ``rows``: book_id, legacy_id, ord, props MAP<STRING,STRING>.  ``modified``: book_id,
    legacy_id, modify (from the data folder) and has_sitemap.
    """
    p = F.col("props")

    def get(k):
        return F.coalesce(p[k], F.lit(""))

    if modified is not None:
        rows = rows.join(modified.select("book_id", "legacy_id", F.col("modify").alias("__m"), F.col("has_sitemap").alias("__s")),
                         ["book_id", "legacy_id"], "left")
    else:
        rows = rows.withColumn("__m", F.lit(None).cast("string")).withColumn("__s", F.lit(False))
    kind = get("type")
    mapped = F.coalesce(*[F.when(kind == a, b) for a, b in TYPE_IN.items()], kind)
    new_type = F.when(mapped == "marked", F.when(F.coalesce("__s", F.lit(False)), "site").otherwise("")).otherwise(mapped)
    own_icon = get("icon").startswith(F.concat(F.lit(f"{RESOURCE_BASE}data/"), F.col("legacy_id"), F.lit("/")))
    paged = ~new_type.isin(*INDEX_OPTIONAL_TYPES) | own_icon
    index = F.when(paged, F.concat("legacy_id", F.lit("/index.html")))

    def stamp(c):
        return item_id_of(ts_of_legacy_id(c, tz))

    create = F.when(get("create") != "", stamp(get("create"))).otherwise(stamp(F.col("legacy_id")))
    modify = F.when(get("modify") != "", stamp(get("modify"))).otherwise(F.coalesce("__m", create))
    resource = get("icon").startswith(RESOURCE_BASE)
    dest = percent_decode(F.substr(get("icon"), F.lit(len(RESOURCE_BASE) + 1)))
    start = F.when(index.isNotNull(), F.concat(F.lit("data/"), F.col("legacy_id"))).otherwise("data")
    # old books keep their data in a "data" folder; icons are rewritten relative to the page
    icon = (F.when(resource, percent_encode(relative_path(dest, start)))
            .when(get("icon").startswith(MOZ_ICON_BASE), "").otherwise(p["icon"]))
    known = ("id", "type", "create", "modify", "icon", "comment", "chars", "lock", "title", "source", "marked", *HOUSEKEEPING)
    extra = F.map_filter(p, lambda k, v: ~k.isin(*known))
    moz = F.when(get("icon").startswith(MOZ_ICON_BASE), F.create_map(F.lit("icon-moz"), p["icon"])).otherwise(
        F.create_map().cast("map<string,string>"))
    return rows.select(
        "book_id", F.col("legacy_id").alias("item_id"), "ord", index.alias("index"), p["title"].alias("title"),
        new_type.alias("type"), create.alias("create"), modify.alias("modify"), p["source"].alias("source"),
        icon.alias("icon"), F.replace(p["comment"], F.lit(LINE_BREAK), F.lit("\n")).alias("comment"),
        F.when(get("chars") != "", p["chars"]).alias("charset"),
        (mapped == "marked").alias("marked"), (get("lock") != "").alias("locked"), F.map_concat(extra, moz).alias("extra"))


def to_legacy(items: DataFrame, id_map: DataFrame, tz: str = "UTC") -> DataFrame:
    """Items -> old record columns; ``id_map``: (book_id, item_id, legacy_id)."""
    kind = value("type")
    mapped = F.coalesce(*[F.when(kind == a, b) for a, b in TYPE_OUT.items()], kind)
    marked = F.coalesce("marked", F.lit(False))

    def stamp(name):
        return F.when(value(name) != "", legacy_id_of(ts_of_item_id(name), tz))

    return items.join(id_map, ["book_id", "item_id"]).select(
        "book_id", "item_id", "legacy_id",
        F.when(kind == "separator", "BookmarkSeparator").otherwise("Description").alias("element"),
        F.when(marked & (mapped == ""), "marked").otherwise(mapped).alias("type"),
        value("title").alias("title"), value("charset").alias("chars"), value("source").alias("source"),
        F.replace(value("comment"), F.lit("\n"), F.lit(LINE_BREAK)).alias("comment"),
        stamp("create").alias("create"), stamp("modify").alias("modify"),
        F.when(F.col("locked").isNotNull(), F.when(F.col("locked"), "true").otherwise("")).alias("lock"))


def legacy_candidates(items: DataFrame, tz: str = "UTC") -> DataFrame:
    """Item ids with the legacy id they convert to, null when they do not."""
    plain = ts_of_item_id("item_id")
    cand = F.when(plain.isNotNull(), legacy_id_of(plain, tz)).when(ts_of_legacy_id("item_id").isNotNull(), F.col("item_id"))
    return items.select("book_id", "item_id", "ord", cand.alias("candidate"))


def legacy_winners(candidates: DataFrame) -> DataFrame:
    """First holder of every candidate; the others look for a free second."""
    one = candidates.filter("candidate is not null").groupBy("book_id", "candidate").agg(F.min_by("item_id", F.struct("ord", "item_id")).alias("item_id"))
    return one.select("book_id", "item_id", F.col("candidate").alias("legacy_id"))


def assign_legacy_ids(items: DataFrame, now: str, tz: str = "UTC") -> DataFrame:
    """(book_id, item_id, legacy_id): first holders keep their second, the rest move to the next free one.

    The rest choose in item order, one after the other (see ``scale.claim_slots``); an
    id that is no date starts at ``now``.
    """
    cand = stage(legacy_candidates(items, tz))
    fixed = stage(legacy_winners(cand))
    rest = cand.join(fixed.select("book_id", "item_id"), ["book_id", "item_id"], "left_anti")
    rows = rest.select("book_id", "item_id", "ord", F.unix_seconds(ts_of_legacy_id(F.coalesce("candidate", F.lit(now)))).alias("base"))
    taken = fixed.filter(F.length("legacy_id") == 14).select("book_id", F.unix_seconds(ts_of_legacy_id("legacy_id")).alias("slot"))
    placed = claim_slots(rows, taken, "base", ["ord", "item_id"]).select(
        "book_id", "item_id", F.date_format(F.timestamp_seconds("slot"), "yyyyMMddHHmmss").alias("legacy_id"))
    return fixed.select("book_id", "item_id", "legacy_id").unionByName(placed)


def icon_targets(items: DataFrame, id_map: DataFrame, data_dir: str = "data", tree_dir: str = "tree") -> DataFrame:
    """Where each relative icon goes in the old layout: icon cache, item folder, data folder, or other.

    Folder containment is an equi-join on the icon path's ancestor folders; among
    several folders the first in item order wins.
    """
    key = ["book_id", "item_id"]
    path = icon_file("icon", "index", data_dir)
    rows = stage(items.withColumn("file", path).select(*key, "icon", "file"))
    # an icon that is already a plain URL stays; data paths are book-relative
    local = rows.filter("file is not null")
    folders = (items.filter(value("index").endswith("/index.html")).join(id_map, key)
               .select("book_id", F.concat(F.lit(f"{data_dir}/"), F.regexp_replace("index", "/index.html$", "")).alias("folder"), "legacy_id", "ord"))
    folders = folders.groupBy("book_id", "folder").agg(F.min(F.struct("ord", "legacy_id")).alias("__f"))
    segs = F.split("file", "/")
    ups = F.when(F.size(segs) > 1, F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/")))
    hit = (local.select(*key, "file", F.explode(ups).alias("folder")).join(folders, ["book_id", "folder"])
           .groupBy(*key).agg(F.min_by("folder", "__f").alias("folder"), F.min("__f")["legacy_id"].alias("owner")))
    cache = f"{tree_dir}/favicon/"
    out = rows.join(hit, key, "left")
    enc = percent_encode
    target = (F.when(F.col("file").isNull(), value("icon"))
              .when(F.col("file").startswith(cache), F.concat(F.lit(f"{RESOURCE_BASE}icon/"), enc(F.substr(F.col("file"), F.lit(len(cache) + 1)))))
              .when(F.col("owner").isNotNull(), F.concat(F.lit(f"{RESOURCE_BASE}data/"), "owner", F.lit("/"),
                                                        enc(F.expr("substring(file, length(folder) + 2)"))))
              .when(F.col("file").startswith(f"{data_dir}/"), F.concat(F.lit(f"{RESOURCE_BASE}data/"), enc(F.substr(F.col("file"), F.lit(len(data_dir) + 2)))))
              .otherwise(F.concat(F.lit(RESOURCE_BASE), enc(F.col("file")))))
    return out.select(*key, "icon", "file", target.alias("legacy_icon"))
