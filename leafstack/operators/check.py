"""Integrity findings as anti-joins, their counts, and opt-in repairs."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mime import extension_of, path_is_html
from ..functions.scalars import (
    human_size, icon_file, infer_create, infer_modify, item_id_of, normal_path, url_netloc, url_path, url_scheme,
)
from ..runtime import stage
from ..scale import rank_rows
from ..schema import (
    INDEX_EXTENSIONS, INDEX_OPTIONAL_TYPES, MTIME_TOLERANCE_SECONDS, ROOT, SPECIAL_IDS, SUPPORT_SUFFIXES,
)
from .search import value

ERROR, WARN = "error", "warn"


def finding(df: DataFrame, severity, code, item="item_id", path=None, detail=None) -> DataFrame:
    def col(x):
        return F.lit(None).cast("string") if x is None else (F.col(x) if isinstance(x, str) else x)

    def lit(x):
        return F.lit(x) if isinstance(x, str) else x

    return df.select("book_id", col(item).alias("item_id"), col(path).alias("path"), lit(severity).alias("severity"),
                     lit(code).alias("code"), col(detail).cast("string").alias("detail"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _file_keys(files: DataFrame) -> DataFrame:
    return files.select("book_id", F.col("path").alias("index")).distinct()


# -- item table -------------------------------------------------------------------

def check_index(items: DataFrame, files: DataFrame) -> DataFrame:
    """Missing index files and properties, and indexes that do not fit the type."""
    it = items.withColumn("index", value("index")).withColumn("type", value("type"))
    has = it.filter("index <> ''")
    gone = finding(has.join(_file_keys(files), ["book_id", "index"], "left_anti"), ERROR, "missing_index_file", path="index")
    odd = has.filter(F.col("type").isin("folder", "separator"))
    mark = has.filter((F.col("type") == "bookmark") & ~F.lower("index").endswith(".htm"))
    none = it.filter((F.col("index") == "") & ~F.col("type").isin(*INDEX_OPTIONAL_TYPES))
    return (gone.unionByName(finding(odd, WARN, "unexpected_index", path="index", detail="type"))
            .unionByName(finding(mark, WARN, "bookmark_index", path="index"))
            .unionByName(finding(none, ERROR, "missing_index", detail="type")))


def check_meta(items: DataFrame) -> DataFrame:
    """Reserved ids and missing dates."""
    return (finding(items.filter(F.col("item_id").isin(*SPECIAL_IDS)), ERROR, "invalid_id")
            .unionByName(finding(items.filter(value("create") == ""), ERROR, "missing_create"))
            .unionByName(finding(items.filter(value("modify") == ""), ERROR, "missing_modify")))


def check_older_modify(items: DataFrame, files: DataFrame) -> DataFrame:
    """``modify`` more than ten minutes older than the index file."""
    f = files.select("book_id", F.col("path").alias("index"), "mtime")
    limit = F.col("mtime") - F.make_dt_interval(secs=F.lit(MTIME_TOLERANCE_SECONDS))
    late = items.filter(value("modify") != "").join(f, ["book_id", "index"]).filter(item_id_of(limit) > F.col("modify"))
    return finding(late, WARN, "older_modify", path="index", detail=item_id_of("mtime"))


def check_duplicate_index(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Second and later items with the same index path."""
    used = items.filter(value("index") != "").select("book_id", "item_id", "ord", "index")
    if files is not None:
        used = used.join(_file_keys(files), ["book_id", "index"], "left_semi")
    owner = used.groupBy("book_id", "index").agg(
        F.min(F.struct("ord", "item_id")).alias("__o"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    later = used.join(owner, ["book_id", "index"]).filter(F.struct("ord", "item_id") > F.col("__o"))
    return finding(later, WARN, "duplicate_index", path="index")


def icon_kind(icon: Column) -> Column:
    """absolute, protocol_relative, root_relative or relative; null without an icon."""
    return (F.when(F.coalesce(icon, F.lit("")) == "", F.lit(None).cast("string"))
            .when(url_scheme(icon) != "", "absolute").when(url_netloc(icon) != "", "protocol_relative")
            .when(url_path(icon).startswith("/"), "root_relative").otherwise("relative"))


def check_icon_urls(items: DataFrame) -> DataFrame:
    it = items.withColumn("kind", icon_kind(F.col("icon"))).filter(F.col("kind").isin("absolute", "protocol_relative", "root_relative"))
    return finding(it, F.when(F.col("kind") == "absolute", WARN).otherwise(ERROR),
                   F.concat(F.col("kind"), F.lit("_icon")), path="icon")


def check_icon_files(items: DataFrame, files: DataFrame, data_dir: str = "data") -> DataFrame:
    """Relative icons without a file.  ``files`` holds book-relative paths here."""
    it = (items.filter(icon_kind(F.col("icon")) == "relative")
          .withColumn("__file", F.coalesce(icon_file("icon", "index", data_dir),
                                           normal_path(F.concat_ws("/", F.lit(data_dir), folder_of(value("index")))))))
    have = files.select("book_id", F.col("path").alias("__file")).distinct()
    return finding(it.join(have, ["book_id", "__file"], "left_anti"), ERROR, "missing_icon_file", path="__file")


def check_unused_icons(items: DataFrame, files: DataFrame, tree_dir: str = "tree", data_dir: str = "data") -> DataFrame:
    """Cached icons no item points to."""
    prefix = f"{tree_dir}/favicon/"
    used = items.select("book_id", icon_file("icon", "index", data_dir).alias("path")).filter(F.col("path").isNotNull()).distinct()
    cached = files.filter(F.col("path").startswith(prefix))
    return finding(cached.join(used, ["book_id", "path"], "left_anti"), WARN, "unused_icon", item=None, path="path")


def check_archives(items: DataFrame, archives: DataFrame) -> DataFrame:
    """``archives``: (book_id, path, error, has_index, n_pages) of the archive files."""
    a = archives.withColumnRenamed("path", "index")
    it = items.filter(value("index") != "").join(a, ["book_id", "index"])
    broken = it.filter(F.col("error").isNotNull())
    sound = it.filter(F.col("error").isNull())
    return (finding(broken, ERROR, "corrupted_archive", path="index", detail="error")
            .unionByName(finding(sound.filter(extension_of("index").isin(".htz") & ~F.col("has_index")), ERROR, "missing_archive_index", path="index"))
            .unionByName(finding(sound.filter((extension_of("index") == ".maff") & (F.col("n_pages") == 0)), ERROR, "no_archive_page", path="index")))


# -- tree ---------------------------------------------------------------------------

def _solid(items: DataFrame) -> DataFrame:
    """Ids whose metadata is not empty."""
    if "meta_empty" in items.columns:
        items = items.filter(~F.coalesce("meta_empty", F.lit(False)))
    return items.select("book_id", "item_id").distinct()


def check_toc_owners(items: DataFrame, edges: DataFrame) -> DataFrame:
    owners = edges.select("book_id", F.col("parent_id").alias("item_id")).distinct()
    bad = owners.filter(~F.col("item_id").isin(*SPECIAL_IDS)).join(_solid(items), ["book_id", "item_id"], "left_anti")
    return finding(bad, ERROR, "invalid_toc_owner")


def check_toc_references(items: DataFrame, edges: DataFrame) -> DataFrame:
    refs = edges.withColumnRenamed("child_id", "item_id")
    special = refs.filter(F.col("item_id").isin(*SPECIAL_IDS))
    bad = refs.filter(~F.col("item_id").isin(*SPECIAL_IDS)).join(_solid(items), ["book_id", "item_id"], "left_anti")
    return (finding(special, ERROR, "special_toc_reference", path="parent_id", detail="pos")
            .unionByName(finding(bad, ERROR, "invalid_toc_reference", path="parent_id", detail="pos")))


def check_unlisted(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items in nobody's list (reachability from the roots is not asked)."""
    listed = edges.select("book_id", F.col("child_id").alias("item_id")).distinct()
    return finding(items.filter(~F.col("item_id").isin(*SPECIAL_IDS)).join(listed, ["book_id", "item_id"], "left_anti"), ERROR, "unlisted_item")


def check_empty_lists(toc_lists: DataFrame) -> DataFrame:
    """``toc_lists``: the array form (book_id, parent_id, children); edges cannot show an empty list."""
    return finding(toc_lists.filter(F.size("children") == 0), WARN, "empty_toc_list", item="parent_id")


# -- files --------------------------------------------------------------------------

def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def check_unindexed(items: DataFrame, files: DataFrame) -> DataFrame:
    """Page files in the data folder that no item uses.

    Not searched: folders of used ``*/index.html`` files, support folders of page
    files, and everything beside or below a folder whose own unused index.html was
    reported.  Paths are exploded to their ancestor folders, so each exclusion is an
    equi anti-join.
    """
    used = (items.filter(value("index") != "").select("book_id", F.col("index").alias("path")).distinct()
            .join(files.select("book_id", "path"), ["book_id", "path"], "left_semi"))
    pages = stage(files.filter(extension_of("path").isin(*INDEX_EXTENSIONS)).select("book_id", "path").distinct()
                  .join(used, ["book_id", "path"], "left_anti"))

    def support(df, at):
        return reduce(DataFrame.unionByName, [
            df.filter(path_is_html("path")).select("book_id", F.concat(at, F.lit(s)).alias("folder")) for s in SUPPORT_SUFFIXES])

    own = used.filter(F.col("path").endswith("/index.html")).select("book_id", folder_of(F.col("path")).alias("folder"))
    plain = used.filter(~F.col("path").endswith("/index.html"))
    folder, stem = folder_of(F.col("path")), _stem(F.col("path"))
    # a used page names its support folder by its whole path, looked up beside the page
    used_support = support(plain, F.when(folder == "", stem).otherwise(F.concat(folder, F.lit("/"), stem)))
    closed = own.unionByName(used_support).unionByName(support(pages, stem)).distinct()
    claimed = (pages.filter(F.regexp_extract("path", r"([^/]*)$", 1) == "index.html")
               .select("book_id", folder.alias("folder"), F.col("path").alias("claim")))
    segs = F.split(folder, "/")
    ups = F.concat(F.array(F.lit("")), F.when(folder == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))))
    above = stage(pages.withColumn("folder", F.explode(ups)))
    shut = above.join(closed, ["book_id", "folder"], "left_semi").select("book_id", "path")
    # the claiming index.html itself stays visible
    taken = (above.join(claimed, ["book_id", "folder"]).filter(F.col("path") != F.col("claim")).select("book_id", "path"))
    visible = pages.join(shut.unionByName(taken).distinct(), ["book_id", "path"], "left_anti")
    return finding(visible, WARN, "unindexed_file", item=None, path="path")


# -- driver, totals, counts -----------------------------------------------------------

def run_checks(items: DataFrame, edges: DataFrame, files: DataFrame | None = None, toc_lists: DataFrame | None = None,
               archives: DataFrame | None = None, book_files: DataFrame | None = None) -> DataFrame:
    """All findings of the checks whose inputs are given."""
    parts = [check_meta(items), check_icon_urls(items), check_toc_owners(items, edges),
             check_toc_references(items, edges), check_unlisted(items, edges)]
    if files is not None:
        parts += [check_index(items, files), check_older_modify(items, files),
                  check_duplicate_index(items, files), check_unindexed(items, files)]
    if toc_lists is not None:
        parts.append(check_empty_lists(toc_lists))
    if archives is not None:
        parts.append(check_archives(items, archives))
    if book_files is not None:
        parts += [check_icon_files(items, book_files), check_unused_icons(items, book_files)]
    return reduce(DataFrame.unionByName, parts)


def book_totals(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items, folders, files and bytes per book; ``files`` without folder rows (folders are path prefixes)."""
    n = items.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_items"))
    f = files.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
    folder = folder_of(F.col("path"))
    segs = F.split(folder, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda k: F.array_join(F.slice(segs, F.lit(1), k), "/"))
    # distinct folders first, then their distinct ancestors: both steps combine on the map side
    dirs = (files.select("book_id", folder.alias("path2")).filter("path2 <> ''").distinct()
            .withColumnRenamed("path2", "path").withColumn("path", F.concat("path", F.lit("/x")))
            .select("book_id", F.explode(ups).alias("dir")).distinct()
            .groupBy("book_id").agg(F.count(F.lit(1)).alias("n_dirs")))
    out = n.join(f, "book_id", "full_outer").join(dirs, "book_id", "left")
    zero = {"n_items": 0, "n_files": 0, "n_bytes": 0, "n_dirs": 0}
    return out.na.fill(zero).withColumn("size_text", human_size("n_bytes"))


def finding_counts(findings: DataFrame, by=("book_id",)) -> DataFrame:
    return findings.groupBy(*by).agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARN).alias("warnings"))


# -- repairs ------------------------------------------------------------------------

def _ids(findings: DataFrame, *codes) -> DataFrame:
    return findings.filter(F.col("code").isin(*codes)).select("book_id", "item_id").distinct()


def drop_items(items: DataFrame, findings: DataFrame, *codes) -> DataFrame:
    """Without the items named by findings of these codes."""
    return items.join(_ids(findings, *codes), ["book_id", "item_id"], "left_anti")


def fill_dates(items: DataFrame, files: DataFrame) -> DataFrame:
    """Missing ``create`` / ``modify`` inferred; files carry ``mtime`` and, if known, ``ctime``."""
    ctime = F.col("ctime") if "ctime" in files.columns else F.col("mtime")
    f = files.select("book_id", F.col("path").alias("index"), ctime.alias("__c"), F.col("mtime").alias("__m"))
    out = items.join(f, ["book_id", "index"], "left")
    out = out.withColumn("create", F.when(value("create") != "", F.col("create")).otherwise(
        F.coalesce(infer_create("item_id", "__c", "modify"), F.col("create"))))
    out = out.withColumn("modify", F.when(value("modify") != "", F.col("modify")).otherwise(
        F.coalesce(infer_modify("__m", "create"), F.col("modify"))))
    return out.select(*items.columns)


def raise_modify(items: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """``modify`` of items with an ``older_modify`` finding raised to the file time."""
    late = _ids(findings, "older_modify").withColumn("__late", F.lit(True))
    f = files.select("book_id", F.col("path").alias("index"), item_id_of("mtime").alias("__m"))
    out = items.join(late, ["book_id", "item_id"], "left").join(f, ["book_id", "index"], "left")
    up = F.coalesce(F.col("__late"), F.lit(False)) & (F.col("__m") > F.col("modify"))
    return out.withColumn("modify", F.when(up, F.col("__m")).otherwise(F.col("modify"))).select(*items.columns)


def drop_invalid_toc(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Without lists of unknown owners and without references to unknown or reserved ids."""
    owners = _ids(findings, "invalid_toc_owner").withColumnRenamed("item_id", "parent_id")
    refs = (findings.filter(F.col("code").isin("special_toc_reference", "invalid_toc_reference"))
            .select("book_id", F.col("path").alias("parent_id"), F.col("item_id").alias("child_id")).distinct())
    kept = edges.join(owners, ["book_id", "parent_id"], "left_anti")
    # one removal per (list, id): a repeated invalid id loses its first entry only
    firsts = (kept.join(refs, ["book_id", "parent_id", "child_id"], "left_semi")
              .groupBy("book_id", "parent_id", "child_id").agg(F.min("pos").alias("pos")))
    return kept.join(firsts, ["book_id", "parent_id", "child_id", "pos"], "left_anti").select(*edges.columns)


def list_unlisted(edges: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """Unlisted items appended to the root in item order."""
    lost = _ids(findings, "unlisted_item").join(items.select("book_id", "item_id", "ord"), ["book_id", "item_id"])
    ends = (edges.filter(F.col("parent_id") == ROOT).groupBy("book_id").agg((F.max("pos") + 1).alias("__end")))
    new = (rank_rows(lost, ["book_id"], ["ord", "item_id"], "__n").join(ends, "book_id", "left")
           .select("book_id", F.lit(ROOT).alias("parent_id"),
                   (F.coalesce("__end", F.lit(0)) + F.col("__n")).cast("long").alias("pos"), F.col("item_id").alias("child_id")))
    return edges.unionByName(new)


def drop_empty_lists(toc_lists: DataFrame) -> DataFrame:
    return toc_lists.filter(F.size("children") > 0)


def drop_unused_icons(book_files: DataFrame, findings: DataFrame) -> DataFrame:
    gone = findings.filter(F.col("code") == "unused_icon").select("book_id", "path").distinct()
    return book_files.join(gone, ["book_id", "path"], "left_anti")


def repair(items: DataFrame, edges: DataFrame, files: DataFrame, findings: DataFrame, only=None):
    """All repairs (or the named ones) in the order metadata, dates, tree.

    The tree repairs look at the tree again after the item repairs, because
    dropped items leave dangling references.
    """
    def on(name):
        return only is None or name in only

    # read by every step below
    findings = stage(findings)
    if on("invalid_id"):
        items = drop_items(items, findings, "invalid_id")
    if on("missing_index"):
        items = drop_items(items, findings, "missing_index")
    if on("missing_index_file"):
        items = drop_items(items, findings, "missing_index_file")
    if on("missing_date"):
        items = stage(fill_dates(items, files))
    if on("older_mtime"):
        items = raise_modify(items, files, findings)
    items = stage(items)
    tree = stage(check_toc_owners(items, edges).unionByName(check_toc_references(items, edges)))
    unlisted = stage(check_unlisted(items, edges))
    if on("toc_invalid"):
        edges = stage(drop_invalid_toc(edges, tree))
    if on("toc_unreachable"):
        edges = list_unlisted(edges, items, unlisted)
    return items, edges

