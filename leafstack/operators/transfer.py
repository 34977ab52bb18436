"""Export manifests and import merges."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cropped, icon_file, safe_filename, ts_of_item_id
from ..runtime import broadcast_if_small, stage
from ..scale import rank_rows
from ..schema import RECYCLE, ROOT, SPECIAL_IDS
from .edits import append_edges, assign_ids
from .graph import preorder, reachable
from .search import value
from .tree import dense_positions, unique_names

KEY = ["book_id", "item_id"]


# -- export --------------------------------------------------------------------------

def export_pool(items: DataFrame, edges: DataFrame, ids: DataFrame | None = None, recursive: bool = False) -> DataFrame:
    """Ids to export: the asked ones (with all below when recursive), else all but the recycled."""
    have = items.select(*KEY)
    if ids is None:
        binned = reachable(edges, RECYCLE)
        return have.join(binned, KEY, "left_anti")
    asked = ids.select(*KEY).distinct()
    if recursive:
        asked = reachable(edges, asked)
    return have.join(asked, KEY, "left_semi")


def number_occurrences(rows: DataFrame, order, base_id: str, singleton: bool = False) -> DataFrame:
    """Add ``n`` (export order in the book), ``ets`` and ``eid``.

    ``ets`` is the base time plus n ms; ``eid`` is the ``ets`` of the item's first
    occurrence.  ``singleton`` keeps first occurrences only.
    """
    first_order = F.struct(*order)
    if singleton:
        keep = [c for c in rows.columns if c not in KEY]
        rows = rows.groupBy(*KEY).agg(F.min_by(F.struct(*keep), first_order).alias("__r")).select(*KEY, "__r.*")
    ranked = rank_rows(rows, ["book_id"], order, "n")
    firsts = ranked.groupBy(*KEY).agg(F.min("n").alias("__first"))
    base = F.unix_millis(ts_of_item_id(F.lit(base_id)))

    def stamp(n):
        return F.date_format(F.timestamp_millis(base + n), "yyyyMMddHHmmssSSS")

    return (ranked.join(firsts, KEY).withColumn("ets", stamp(F.col("n")))
            .withColumn("eid", stamp(F.col("__first"))).drop("__first"))


def export_manifest(items: DataFrame, edges: DataFrame, base_id: str, ids: DataFrame | None = None,
                    recursive: bool = False, singleton: bool = False, tz_offset: int = 0) -> DataFrame:
    """One record per exported occurrence, in tree order, with the titled path and the item as JSON.

    With ``ids``, paths are expanded only through the ancestors of what is exported, found by walking
    back from it; other branches of the book are not touched.
    """
    if ids is not None:
        pool = stage(export_pool(items, edges, ids, recursive))
        above = stage(ancestors(edges, pool))
        # an ancestor's whole list counts its positions, but only ancestors are expanded
        own = edges.join(above.withColumnRenamed("item_id", "parent_id"), ["book_id", "parent_id"], "left_semi")
        rows = preorder(stage(dense_positions(own)), SPECIAL_IDS, above).join(pool, KEY, "left_semi")
    else:
        dense = stage(dense_positions(edges))
        pool = export_pool(items, dense, ids, recursive)
        rows = preorder(dense, SPECIAL_IDS).join(pool, KEY, "left_semi")
    numbered = stage(number_occurrences(rows, ["addr"], base_id, singleton))
    ups = numbered.select("book_id", "n", F.posexplode("path").alias("d", "item_id"))
    titles = items.select(*KEY, value("title").alias("title"))
    paths = (ups.join(titles, KEY, "left")
             .groupBy("book_id", "n")
             .agg(F.array_sort(F.collect_list(F.struct("d", F.col("item_id").alias("id"), F.coalesce("title", F.lit("")).alias("title")))).alias("__p"))
             .select("book_id", "n", F.transform("__p", lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"))).alias("titled_path")))
    props = [c for c in items.columns if c not in ("book_id", "ord", "meta_empty")]
    meta = items.select(*KEY, F.to_json(F.struct(*[F.col(c).alias("id" if c == "item_id" else c) for c in props])).alias("meta"))
    return (numbered.drop("path").join(paths, ["book_id", "n"]).join(meta, KEY)
            .select("book_id", "n", F.lit(2).alias("version"), "eid", "ets", F.lit(tz_offset).alias("tz_offset"),
                    "item_id", F.col("titled_path").alias("path"), "pos", "meta"))


def ancestors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` and all ids from which they can be reached, (book_id, item_id)."""
    back = edges.select("book_id", F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))
    return reachable(back, ids)


def export_payloads(manifest: DataFrame, items: DataFrame, files: DataFrame, icons: DataFrame, data_dir: str = "data", tree_dir: str = "tree"):
    """What an export holds besides its records: (entries, store).

    ``files`` (book_id, path, content) lie under the data folder, ``icons`` likewise, by book path, in
    the icon cache.  An occurrence takes its index file, or the folder of an ``index.html`` with all
    in it, and its cached icon.  ``entries``: book_id, n, item_id, name (in the archive), digest; they
    move no bytes.  ``store``: digest, content, size, each content once however often it is used.
    ``files`` and ``icons`` that bring a ``digest``, the SHA-1 of the content, are not read for it.
    """
    files, icons = (t if "digest" in t.columns else t.withColumn("digest", F.sha1("content")) for t in (files, icons))
    index = value("index")
    source = F.when(index.endswith("/index.html"), F.regexp_replace(index, "/index.html$", "")).when(index != "", index)
    taken = manifest.select(*KEY, "n", "ets").join(items.select(*KEY, source.alias("source"), icon_file("icon", "index", data_dir).alias("icon")), KEY)
    segments = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "/"))
    marked = files.select("book_id", "path", "digest")
    inside = marked.withColumn("source", F.explode(folders))  # as many rows as the path is deep
    name = F.concat("ets", F.lit("/data/"), F.regexp_extract("source", "([^/]*)$", 1), F.expr("substring(path, length(source) + 1)"))
    data = taken.filter("source is not null").join(inside, ["book_id", "source"]).select("book_id", "n", "item_id", name.alias("name"), "digest")
    cached = icons.select("book_id", F.col("path").alias("icon"), "digest").filter(F.col("icon").startswith(f"{tree_dir}/favicon/"))
    icon = taken.join(cached, ["book_id", "icon"]).select(
        "book_id", "n", "item_id", F.concat("ets", F.lit("/favicon/"), F.regexp_extract("icon", "([^/]*)$", 1)).alias("name"), "digest")
    entries = stage(data.unionByName(icon))
    both = files.select("digest", "content").unionByName(icons.select("digest", "content"))
    used = both.join(broadcast_if_small(entries.select("digest").distinct()), "digest", "left_semi")
    store = used.groupBy("digest").agg(F.first("content").alias("content")).withColumn("size", F.octet_length("content").cast("long"))
    return entries, store


def export_files_v1(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """File name per record of a version 1 export: ``ets-title`` made safe, cut to 128, unique."""
    titles = items.select(*KEY, value("title").alias("__t"))
    base = cropped(safe_filename(F.concat(F.col("ets"), F.lit("-"), F.coalesce("__t", F.lit("")))), 128)
    named = manifest.join(titles, KEY, "left").withColumn("base", base).drop("__t")
    return (unique_names(named, ["book_id"], "base", "n", "name", style="-")
            .withColumn("file", F.concat("name", F.lit(".wsba"))).drop("base", "name"))


# -- import --------------------------------------------------------------------------

def merge_versions(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Version 1 and 2 records in one table; version 1 has no position."""
    return v2.unionByName(v1, allowMissingColumns=True)


def dedup_occurrences(exports: DataFrame, rebuild_folders: bool = False, target_id: str = ROOT) -> DataFrame:
    """Occurrences to insert, first per (eid, parent, position) or per (eid, target).

    ``imports_data`` marks the first occurrence of each eid: only that one brings data.
    ``ord`` is the archive order.
    """
    where = (F.to_json(F.struct(F.element_at("path", -1)["id"].alias("p"), F.col("pos").alias("i")))
             if rebuild_folders else F.lit(target_id))
    keyed = exports.withColumn("ref_key", where)
    keep = [c for c in keyed.columns if c not in ("book_id", "eid", "ref_key")]
    one = keyed.groupBy("book_id", "eid", "ref_key").agg(F.min_by(F.struct(*keep), "ord").alias("__r")).select(
        "book_id", "eid", "ref_key", "__r.*")
    firsts = exports.groupBy("book_id", "eid").agg(F.min("ord").alias("__f"))
    return one.join(firsts, ["book_id", "eid"]).withColumn("imports_data", F.col("ord") == F.col("__f")).drop("__f")


def _ext(index):
    return F.regexp_extract(index, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)


def resolve_conflicts(incoming: DataFrame, items: DataFrame, mode: str = "skip", now: str | None = None) -> DataFrame:
    """Decide per incoming item: ``add``, ``replace``, ``new`` (with ``new_id``) or ``error``.

    ``incoming``: (book_id, item_id, index, ord).  Reserved ids are errors.  Replacing
    needs the same kind of index.
    """
    if mode not in ("skip", "replace", "new"):
        raise ValueError(f"unknown mode: {mode}")
    old = items.select("book_id", "item_id", value("index").alias("__old"), F.lit(True).alias("__used"))
    j = incoming.join(old, KEY, "left")
    used = F.coalesce("__used", F.lit(False))
    index = value("index")
    same_kind = (_ext(index) == _ext(F.col("__old"))) & (index.endswith("/index.html") == F.col("__old").endswith("/index.html"))
    on_used = {"skip": F.lit("error"), "new": F.lit("new"), "replace": F.when(same_kind, "replace").otherwise("error")}[mode]
    action = F.when(F.col("item_id").isin(*SPECIAL_IDS), "error").when(used, on_used).otherwise("add")
    reason = (F.when(F.col("item_id").isin(*SPECIAL_IDS), "reserved id")
              .when(used & F.lit(mode == "skip"), "id exists")
              .when(used & F.lit(mode == "replace") & ~same_kind, "index type not match"))
    out = j.withColumn("action", action).withColumn("reason", reason)
    if mode != "new":
        return out.withColumn("new_id", F.when(F.col("action") != "error", F.col("item_id"))).drop("__old", "__used")
    out = stage(out.drop("__old", "__used"))
    clash = out.filter("action = 'new'").select(*KEY, F.col("ord").alias("seq"), F.lit(now).alias("base_id"))
    taken = items.select(*KEY).unionByName(out.filter("action = 'add'").select(*KEY))
    fresh = assign_ids(clash.withColumnRenamed("item_id", "__from"), taken).select(
        "book_id", F.col("__from").alias("item_id"), F.col("seq").alias("ord"), F.col("item_id").alias("new_id"))
    return (out.join(fresh, [*KEY, "ord"], "left")
            .withColumn("new_id", F.when(F.col("action") == "add", F.col("item_id")).otherwise(F.col("new_id"))))


def substitute_ids(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Replace ids on both ends of the edges; ``id_map``: (book_id, old_id, new_id)."""
    p = id_map.select("book_id", F.col("old_id").alias("parent_id"), F.col("new_id").alias("__p"))
    c = id_map.select("book_id", F.col("old_id").alias("child_id"), F.col("new_id").alias("__c"))
    return (edges.join(p, ["book_id", "parent_id"], "left").join(c, ["book_id", "child_id"], "left")
            .select("book_id", F.coalesce("__p", "parent_id").alias("parent_id"), "pos", F.coalesce("__c", "child_id").alias("child_id")))


def rebuild_folders(occurrences: DataFrame, items: DataFrame, id_map: DataFrame, now: str, target_id: str | None = None):
    """Anchor every imported occurrence in the tree, creating the folders that are missing.

    ``occurrences``: (book_id, ord, item_id, path ARRAY<STRUCT<id,title>>), ids already
    final; ``id_map``: (book_id, old_id, new_id) of this import.  The anchor is the
    deepest path entry that is special, imported, or (without a target) in the book.
    Returns (folders, edges): new folder items and edges (book_id, parent_id, seq, child_id).

    With a target, special roots stand for the target and only ids of this import count.
    """
    occ = occurrences.select("book_id", "ord", "item_id", "path")
    steps = occ.select("book_id", "ord", F.col("item_id").alias("self"), F.posexplode("path").alias("d", "s")).select(
        "book_id", "ord", "self", "d", F.col("s.id").alias("old_id"), F.col("s.title").alias("title"))
    mapped = id_map.select("book_id", "old_id", F.col("new_id").alias("__m"))
    have = items.select("book_id", F.col("item_id").alias("old_id"), F.lit(True).alias("__have"))
    steps = steps.join(mapped, ["book_id", "old_id"], "left").join(have, ["book_id", "old_id"], "left")
    special = F.col("old_id").isin(*SPECIAL_IDS)
    root = F.lit(target_id) if target_id is not None else F.col("old_id")
    at_home = F.col("__m").isNotNull() if target_id is not None else (F.col("__m").isNotNull() | F.coalesce("__have", F.lit(False)))
    resolved = F.when(special, root).when(at_home, F.coalesce("__m", "old_id"))
    # an item is no anchor for itself
    steps = steps.withColumn("at", F.when(F.coalesce(resolved == F.col("self"), F.lit(False)), F.lit(None).cast("string")).otherwise(resolved))
    steps = steps.withColumn("is_self", F.coalesce(resolved == F.col("self"), F.lit(False)))
    steps = stage(steps)
    anchors = steps.filter("at is not null").groupBy("book_id", "ord").agg(F.max("d").alias("__d"), F.max_by("at", "d").alias("anchor"))
    below = steps.join(anchors, ["book_id", "ord"], "left").filter(F.col("__d").isNull() | (F.col("d") > F.col("__d")))
    missing = (below.filter(~F.col("is_self")).groupBy("book_id", "old_id")
               .agg(F.min(F.struct("ord", "d", "title")).alias("f")).select("book_id", "old_id", "f.*"))
    ranked = rank_rows(missing, ["book_id"], ["ord", "d", "old_id"], "seq").withColumn("base_id", F.lit(now))
    taken = items.select(*KEY).unionByName(id_map.select("book_id", F.col("new_id").alias("item_id")))
    folders = stage(assign_ids(ranked, taken).select("book_id", "old_id", "item_id", "title", "seq", F.lit("folder").alias("type")))
    made = folders.select("book_id", "old_id", F.col("item_id").alias("__new"))
    chain = (below.join(made, ["book_id", "old_id"], "left")
             .groupBy("book_id", "ord")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", F.coalesce("__new", "self").alias("i")))), lambda s: s["i"]).alias("mid")))
    fallback = F.lit(target_id) if target_id is not None else F.lit(ROOT)
    line = (occ.drop("path").join(anchors.drop("__d"), ["book_id", "ord"], "left").join(chain, ["book_id", "ord"], "left")
            .withColumn("line", F.concat(F.array(F.coalesce("anchor", fallback)),
                                         F.coalesce("mid", F.array().cast("array<string>")), F.array("item_id"))))
    pairs = (line.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("line") - 1)))
             .select("book_id", "ord", "k", (F.col("k") == F.size("line") - 1).alias("last"),
                     F.element_at("line", F.col("k")).alias("parent_id"), F.element_at("line", F.col("k") + 1).alias("child_id"))
             )
    inner = (pairs.filter("not last").groupBy("book_id", "parent_id", "child_id").agg(F.min(F.struct("ord", "k")).alias("__o"))
             .select("book_id", "parent_id", "child_id", "__o.*"))
    leaf = pairs.filter("last").select("book_id", "parent_id", "child_id", "ord", "k")
    edges = rank_rows(inner.unionByName(leaf), ["book_id"], ["ord", "k", "child_id"], "seq").select("book_id", "parent_id", "seq", "child_id")
    return folders, edges


def import_exports(exports: DataFrame, items: DataFrame, edges: DataFrame, mode: str = "skip", now: str = "20240101000000000",
                   target_id: str | None = None, folders: bool = False):
    """Merge an export table into a book; returns (items, edges, log).

    ``exports`` columns: book_id, ord, eid, item_id, path, pos, and the item columns to
    store (``index``, ``title`` ...).  Runs conflict -> dedup -> tree.
    """
    edges = stage(dense_positions(edges))
    occ = stage(dedup_occurrences(exports, folders, target_id or ROOT))
    decided = stage(resolve_conflicts(occ.filter("imports_data"), items, mode, now))
    ok = decided.filter("action <> 'error'")
    ids = ok.select("book_id", "eid", "new_id", "action")
    cols = [c for c in items.columns if c not in ("book_id", "item_id", "ord")]
    top = items.groupBy("book_id").agg(F.max("ord").alias("__top"))
    # a replaced item keeps its place and its index path
    old = items.select("book_id", F.col("item_id").alias("new_id"), F.col("ord").alias("__ord"), value("index").alias("__index"))
    swap = F.col("action") == "replace"
    rows = (ok.join(top, "book_id", "left").join(old, ["book_id", "new_id"], "left")
            .withColumn("index", F.when(swap & (value("index") != ""), F.col("__index")).otherwise(F.col("index")))
            .withColumn("ord", F.when(swap, F.col("__ord")).otherwise(F.coalesce("__top", F.lit(-1)) + 1 + F.col("ord"))))
    stored = rows.select("book_id", F.col("new_id").alias("item_id"), "ord",
                         *[F.col(c) if c in ok.columns else F.lit(None).cast(items.schema[c].dataType).alias(c) for c in cols])
    replaced = ok.filter("action = 'replace'").select(*KEY)
    kept = items.join(replaced, KEY, "left_anti")
    out_items = kept.unionByName(stored.select(*items.columns))
    # a replaced item stays where it is; the others are inserted once per occurrence
    put = (occ.drop("imports_data").join(ids.filter("action <> 'replace'"), ["book_id", "eid"])
           .withColumn("__old", F.col("item_id")).withColumn("item_id", F.col("new_id")))
    if not folders:
        new = put.select("book_id", F.lit(target_id or ROOT).alias("parent_id"), F.col("ord").alias("seq"), F.col("item_id").alias("child_id"))
        return out_items, append_edges(edges, new), decided
    id_map = ok.select("book_id", F.col("item_id").alias("old_id"), "new_id").distinct()
    made, new = rebuild_folders(put.select("book_id", "ord", "item_id", "path"), items, id_map, now, target_id)
    fresh = made.join(top, "book_id", "left")
    width = occ.groupBy("book_id").agg((F.max("ord") + 1).alias("__w"))
    fresh = fresh.join(width, "book_id").withColumn("ord", F.coalesce("__top", F.lit(-1)) + 1 + F.col("__w") + F.col("seq"))
    fresh = fresh.withColumn("create", F.lit(now)).withColumn("modify", F.lit(now))
    out_items = out_items.unionByName(fresh.select(*[
        F.col(c) if c in fresh.columns else F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns]))
    return out_items, append_edges(edges, new), decided


def union_books(*tables: DataFrame) -> DataFrame:
    """Books in order: ``book_ord`` is the argument position."""
    parts = [t.withColumn("book_ord", F.lit(i).cast("long")) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts)
