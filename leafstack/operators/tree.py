"""Ordered adjacency: positions, lists, item cards, sorting, names and layouts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cropped, relative_url, safe_filename, url_fragment, url_scheme
from ..runtime import stage
from ..scale import chunked_list, rank_by_number, rank_rows, running_max
from ..schema import ROOT, SPECIAL_IDS
from .graph import preorder, reachable
from .search import value

# --- fixed values -----------------------------------------------------------
TYPE_RANK = {"folder": -1, "bookmark": 1, "postit": 2, "note": 3}
SORT_KEYS = ("reverse", "id", "type", "title", "index", "source", "create", "modify", "marked")
# ----------------------------------------------------------------------------

PARENT = ["book_id", "parent_id"]


def dense_positions(edges: DataFrame) -> DataFrame:
    """Edges with ``pos`` renumbered 0..n-1 under every parent."""
    return (rank_by_number(edges, PARENT, "pos", "__dense", ties=["child_id"])
            .withColumn("pos", F.col("__dense")).select("book_id", "parent_id", "pos", "child_id"))


def children_lists(edges: DataFrame, size: int = 1024) -> DataFrame:
    """Children in order, as list chunks (see ``scale.chunked_list``)."""
    return chunked_list(dense_positions(edges), PARENT, "pos", "child_id", size)


def parents_of(edges: DataFrame) -> DataFrame:
    """Reverse tree: child -> (parent, position), numbered per child."""
    return rank_rows(edges, ["book_id", "child_id"], ["parent_id", "pos"], "nth")


def parents_lists(edges: DataFrame, size: int = 1024) -> DataFrame:
    """Parents per child as chunks of ``parent:pos`` strings."""
    named = parents_of(edges).withColumn("at", F.concat_ws(":", "parent_id", "pos"))
    return chunked_list(named, ["book_id", "child_id"], "nth", "at", size)


def item_cards(items: DataFrame, edges: DataFrame, ids: DataFrame, include_parents: bool = False) -> DataFrame:
    """Everything known about the asked ids, one row per part.

    ``part`` is ``meta`` (a JSON document), ``children`` or ``parents`` (list
    chunks as JSON).  Absent parts and unknown ids give no rows.
    """
    asked = ids.select("book_id", "item_id").distinct()
    key = ["book_id", "item_id"]
    props = [c for c in items.columns if c not in ("book_id", "item_id", "ord")]
    meta = items.join(asked, key, "left_semi").select(
        *key, F.lit("meta").alias("part"), F.lit(0).cast("long").alias("chunk"),
        F.to_json(F.struct(*props)).alias("payload"))
    # only the asked parents' edges are numbered
    mine = edges.join(asked.withColumnRenamed("item_id", "parent_id"), PARENT, "left_semi")
    kids = children_lists(mine).select(
        "book_id", F.col("parent_id").alias("item_id"), F.lit("children").alias("part"), "chunk",
        F.to_json("values").alias("payload"))
    out = meta.unionByName(kids)
    if include_parents:
        ups = dense_positions(edges).join(asked.withColumnRenamed("item_id", "child_id"), ["book_id", "child_id"], "left_semi")
        out = out.unionByName(parents_lists(ups).select(
            "book_id", F.col("child_id").alias("item_id"), F.lit("parents").alias("part"), "chunk",
            F.to_json("values").alias("payload")))
    return out


def sort_children(edges: DataFrame, items: DataFrame, parents=None, key: str = "title",
                  reverse: bool = False, recursively: bool = False) -> DataFrame:
    """Edges with the children of the given parents re-ordered; other parents keep their order.

    ``parents`` is a table (book_id, item_id), ids, or None for all.  A reverse sort
    keeps ties in their old order.
    """
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key: {key}")
    scope = None
    if parents is not None:
        scope = reachable(edges, parents) if recursively else parents
        scope = scope.select("book_id", F.col("item_id").alias("parent_id")).distinct()
    picked = edges if scope is None else edges.join(scope, PARENT, "left_semi")
    rest = None if scope is None else edges.join(scope, PARENT, "left_anti")
    if key in ("reverse", "id"):
        keyed = picked.withColumn("__k", F.col("child_id"))
        order = [F.col("pos").desc()] if key == "reverse" else [F.col("__k").desc() if reverse else F.col("__k").asc(), F.col("pos")]
    else:
        if key == "type":
            k = F.coalesce(*[F.when(value("type") == t, r) for t, r in TYPE_RANK.items()], F.lit(0))
        elif key == "marked":
            k = F.coalesce("marked", F.lit(False))
        else:
            k = value(key)
        props = items.select("book_id", F.col("item_id").alias("child_id"), k.alias("__k"))
        missing = {"type": F.lit(0), "marked": F.lit(False)}.get(key, F.lit(""))
        keyed = (picked.join(props, ["book_id", "child_id"], "left")
                 .withColumn("__k", F.coalesce("__k", missing)))
        order = [F.col("__k").desc() if reverse else F.col("__k").asc(), F.col("pos")]
    out = (rank_rows(keyed, PARENT, order, "__new").select("book_id", "parent_id", F.col("__new").alias("pos"), "child_id"))
    return out if rest is None else out.unionByName(rest.select(*out.columns))


def ordinal_prefix(edges: DataFrame) -> DataFrame:
    """Edges with ``prefix``: the 1-based position padded to the width of the sibling count."""
    dense = dense_positions(edges)
    counts = edges.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("__n"))
    return (dense.join(counts, PARENT)
            .withColumn("prefix", padded(F.col("pos") + 1, F.col("__n"))).drop("__n"))


def padded(number: Column, total: Column) -> Column:
    text = number.cast("string")
    width = F.length(total.cast("string"))
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)


def numbered(name: Column, n: Column, style: str = "()") -> Column:
    suffix = F.concat(F.lit("("), n, F.lit(")")) if style == "()" else F.concat(F.lit("-"), n)
    return F.when(n == 0, name).otherwise(F.concat(name, suffix))


def unique_names(df: DataFrame, scope, name: str, order: str, out: str, style: str = "()") -> DataFrame:
    """First come, first served unique names: ``name``, ``name(1)``, ``name(2)``, ...

    The n-th holder of a name starts at suffix n.  A generated name may clash with
    a real one; then the later row moves on, and with it the rows behind it.
    Rounds repeat while there is a clash, usually none.  ``order`` is a unique
    integer column.
    """
    group = [*scope, name]
    cur = stage(rank_rows(df, group, [order], "__rank").withColumn("__n", F.col("__rank")))
    while True:
        cur = cur.withColumn(out, numbered(F.col(name), F.col("__n"), style))
        holders = (cur.groupBy(*scope, out).agg(F.min(order).alias("__holder"), F.count(F.lit(1)).alias("__c"))
                   .filter("__c > 1").drop("__c"))
        marked = stage(cur.join(holders, [*scope, out], "left")
                       .withColumn("__lost", F.col("__holder").isNotNull() & (F.col("__holder") < F.col(order))).drop("__holder"))
        if marked.filter("__lost").isEmpty():
            return marked.drop("__rank", "__n", "__lost")
        bumped = marked.withColumn("__gap", F.col("__n") + F.col("__lost").cast("long") - F.col("__rank"))
        cur = stage(running_max(bumped, group, "__rank", "__gap", "__gap2")
                    .withColumn("__n", F.col("__gap2") + F.col("__rank")).drop("__gap", "__gap2", "__lost", out))


def layout_paths(edges: DataFrame, items: DataFrame, prefix: bool = True) -> DataFrame:
    """Planned target path of every occurrence below the root when a book is laid out as files.

    ``target`` is null for items that make no file; folders, pages, bookmarks and
    (with prefixes) separators do.
    """
    key = ["book_id", "item_id"]
    known = items.select(*key).filter(~F.col("item_id").isin(*SPECIAL_IDS))
    dense = dense_positions(edges)
    widths = edges.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("siblings")).withColumnRenamed("parent_id", "__up")
    rows = (preorder(dense, ROOT, expandable=known)
            .withColumn("__up", F.element_at("path", -1)).join(widths, ["book_id", "__up"])
            .join(items.select(*key, "title", "type", "index", "source"), key))
    title = F.when(value("title") != "", F.col("title")).when(value("type") != "separator", F.col("item_id")).otherwise("----")
    lead = F.concat(padded(F.col("pos") + 1, F.col("siblings")), F.lit("-")) if prefix else F.lit("")
    rows = rows.withColumn("base", cropped(F.concat(lead, safe_filename(title)), 128))
    rows = rows.withColumn("up_addr", F.slice("addr", F.lit(1), F.size("addr") - 1))
    if prefix:
        # the ordinal already makes siblings distinct
        named = stage(rows.withColumn("name", F.col("base")))
    else:
        named = stage(unique_names(rows, ["book_id", "up_addr"], "base", "pos", "name"))
    ups = (named.select("book_id", "addr", F.posexplode(F.transform(
               F.sequence(F.lit(2), F.size("addr")), lambda n: F.slice("addr", F.lit(1), n))).alias("__d", "__a"))
           .join(named.select("book_id", F.col("addr").alias("__a"), F.col("name").alias("__s")), ["book_id", "__a"]))
    full = (ups.groupBy("book_id", "addr")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__d", "__s"))), lambda s: s["__s"]), "/").alias("path_text")))
    index, kind = value("index"), value("type")
    ext = F.regexp_extract(index, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)
    tail = (F.when(kind == "folder", "")
            .when(kind == "separator", F.lit(".-") if prefix else F.lit(None).cast("string"))
            .when(kind == "bookmark", F.when(value("source") != "", ".htm"))
            .when(index == "", F.lit(None).cast("string"))
            .when(index.endswith("/index.html"), ".htd")
            .otherwise(F.when(ext == "", "._").otherwise(ext)))
    return (named.join(full, ["book_id", "addr"])
            .withColumn("target", F.concat("path_text", tail))
            .select("book_id", "item_id", "addr", "cyc", "name", "path_text", "target"))


def static_index(edges: DataFrame, items: DataFrame, data_dir: str = "data", tree_dir: str = "tree") -> DataFrame:
    """Flattened tree as an event table.

    One row per start, end, start-container and end-container.  ``addr`` and
    ``phase`` give the order: a node's events surround those of the nodes below it.
    """
    key = ["book_id", "item_id"]
    dense = dense_positions(edges)
    shown = items.select(*key)
    rows = stage(preorder(dense, ROOT, expandable=shown))
    # a container opens under the root and under every expanded node with shown children
    opened = (rows.select("book_id", F.slice("addr", F.lit(1), F.size("addr") - 1).alias("addr"))
              .distinct().withColumn("depth", F.size("addr")))
    index, source, icon, kind = value("index"), value("source"), value("icon"), value("type")
    page = relative_url(F.concat_ws("/", F.lit(data_dir), index), F.lit(tree_dir), path_is_dir=False)
    anchor = F.when(url_fragment(source) != "", F.concat(F.lit("#"), url_fragment(source))).otherwise("")
    href = (F.when(kind.isin("separator", "folder"), "")
            .when((kind == "bookmark") & (source != ""), source)
            .when(index != "", F.concat(page, anchor)).otherwise(""))
    folder = F.regexp_replace(index, r"/?[^/]*$", "")
    base = relative_url(F.concat_ws("/", F.lit(data_dir), folder), F.lit(tree_dir))
    icon_url = (F.when(kind == "separator", "")
                .when((icon != "") & (url_scheme(icon) == ""), F.concat(base, icon)).otherwise(icon))
    title = F.when((kind != "separator") & (value("title") == ""), F.col("item_id")).otherwise(value("title"))
    level = (F.size("addr") - 1) * 2 - 1
    marked = F.coalesce("marked", F.lit(False)) if "marked" in items.columns else F.lit(False)
    comment = value("comment") if "comment" in items.columns else F.lit("")
    nodes = (rows.join(items, key)
             .select("book_id", "addr", "item_id", kind.alias("type"), title.alias("title"), href.alias("url"),
                     icon_url.alias("icon"), source.alias("source"), marked.alias("marked"), comment.alias("comment"), level.alias("level"),
                     F.explode(F.array(F.struct(F.lit(0).alias("phase"), F.lit("start").alias("event")),
                                       F.struct(F.lit(3).alias("phase"), F.lit("end").alias("event")))).alias("__e"))
             .select("book_id", "addr", "__e.*", "level", "item_id", "type", "title", "url", "icon", "source", "marked", "comment"))
    none = F.lit(None).cast("string")
    boxes = (opened.select(
        "book_id", "addr",
        F.explode(F.array(F.struct(F.lit(1).alias("phase"), F.lit("start-container").alias("event")),
                          F.struct(F.lit(2).alias("phase"), F.lit("end-container").alias("event")))).alias("__e"),
        ((F.col("depth") - 1) * 2).alias("level"))
        .select("book_id", "addr", "__e.*", "level", none.alias("item_id"), none.alias("type"), none.alias("title"),
                none.alias("url"), none.alias("icon"), none.alias("source"), none.cast("boolean").alias("marked"), none.alias("comment")))
    # closing events sort after everything below: pad their address with a value above all positions
    last = F.lit(9223372036854775807)
    sort_key = F.when(F.col("phase") >= 2, F.concat("addr", F.array(last, F.col("phase").cast("long")))).otherwise(
        F.concat("addr", F.array(F.col("phase").cast("long") - 2)))
    return nodes.unionByName(boxes).withColumn("seq_key", sort_key)


def first_references(edges: DataFrame, roots=ROOT) -> DataFrame:
    """Edges kept when every item may appear once: under its first parent in depth-first order.

    An edge survives when it is the one through which its child is first visited,
    that is, when the child's visit address extends its parent's by this position.
    """
    dense = dense_positions(edges)
    seen = stage(reachable(dense, roots, with_order=True))
    up = seen.select("book_id", F.col("item_id").alias("parent_id"), F.col("addr").alias("__p"))
    down = seen.select("book_id", F.col("item_id").alias("child_id"), F.col("addr").alias("__c"))
    return (dense.join(up, PARENT).join(down, ["book_id", "child_id"])
            .filter(F.col("__c") == F.concat("__p", F.array(F.col("pos"))))
            .select("book_id", "parent_id", "pos", "child_id"))

