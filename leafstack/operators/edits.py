"""Bulk tree edits on snapshots.

An edit takes whole tables and returns whole tables.  Positions in a batch refer to
the state before it.  Every batch has one target per book, as the single commands
have; tables of picks are ``(book_id, seq, parent_id, pos)`` in tree order.
"""

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import item_id_of, safe_filename, ts_of_item_id
from ..runtime import stage
from ..scale import claim_slots, rank_rows
from ..schema import RECYCLE, ROOT, SPECIAL_IDS
from .graph import newly_unreachable, reachable
from .tree import dense_positions

EDGE = ["book_id", "parent_id", "pos", "child_id"]
PARENT = ["book_id", "parent_id"]


class EditError(ValueError):
    """A batch was rejected; nothing of it applies."""


def _require(ok: bool, message: str):
    if not ok:
        raise EditError(message)


def _known_parent(items: DataFrame, parent_id: str, books: DataFrame):
    if parent_id in SPECIAL_IDS:
        return
    owners = items.filter(F.col("item_id") == parent_id).select("book_id")
    _require(books.join(owners, "book_id", "left_anti").isEmpty(), f"invalid target parent: {parent_id}")


def resolve_picks(edges: DataFrame, picks: DataFrame) -> DataFrame:
    """Picks with their child id, repeated picks collapsed to the first; unknown ones reject the batch."""
    one = picks.groupBy("book_id", "parent_id", "pos").agg(F.min("seq").alias("seq"))
    found = stage(one.join(edges, ["book_id", "parent_id", "pos"], "left"))
    _require(found.filter("child_id is null").isEmpty(), "a picked position does not exist")
    return found.select("book_id", "seq", "parent_id", "pos", "child_id")


def remove_edges(edges: DataFrame, picked: DataFrame) -> DataFrame:
    """Edges without the picked ones; only the lists that lost entries are renumbered."""
    gone = picked.select("book_id", "parent_id", "pos")
    touched = gone.select(*PARENT).distinct()
    left = edges.join(gone, ["book_id", "parent_id", "pos"], "left_anti")
    return (dense_positions(left.join(touched, PARENT, "left_semi"))
            .unionByName(left.join(touched, PARENT, "left_anti").select(*EDGE)))


def insert_block(edges: DataFrame, block: DataFrame, target_parent: str, target_index: int | None = None,
                 new_at_top: bool = False, before: Column | None = None) -> DataFrame:
    """``block`` (book_id, seq, child_id) inserted under the target of each book, in ``seq`` order.

    Without an index the block goes to the end, or to the top with ``new_at_top``; a
    larger index means the end.  ``before``: a Column of ``block`` books lowering the index.
    """
    if target_index is None:
        target_index = 0 if new_at_top else None
    ranked = rank_rows(block, ["book_id"], ["seq"], "__i")
    sizes = ranked.groupBy("book_id").agg(F.count(F.lit(1)).alias("__k"),
                                          *([F.max(before).alias("__less")] if before is not None else [F.lit(0).alias("__less")]))
    mine = edges.filter(F.col("parent_id") == target_parent)
    lengths = mine.groupBy("book_id").agg(F.count(F.lit(1)).alias("__len"))
    place = sizes.join(lengths, "book_id", "left").withColumn("__len", F.coalesce("__len", F.lit(0)))
    at = F.col("__len") if target_index is None else F.least(F.lit(target_index) - F.col("__less"), F.col("__len"))
    place = place.select("book_id", "__k", at.cast("long").alias("__at"))
    moved = (mine.join(place, "book_id", "left")
             .withColumn("pos", F.col("pos") + F.when(F.col("pos") >= F.col("__at"), F.col("__k")).otherwise(0))
             .select(*EDGE))
    new = (ranked.join(place, "book_id")
           .select("book_id", F.lit(target_parent).alias("parent_id"), (F.col("__at") + F.col("__i")).alias("pos"), "child_id"))
    return edges.filter(F.col("parent_id") != target_parent).select(*EDGE).unionByName(moved).unionByName(new)


# -- items -------------------------------------------------------------------------

def check_new_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Problems of a batch add: reserved, existing or repeated ids; empty when the batch is fine."""
    named = new.filter(F.col("item_id").isNotNull())
    keys = ["book_id", "item_id"]
    bad = [named.filter(F.col("item_id").isin(*SPECIAL_IDS)).select(*keys, F.lit("reserved").alias("problem")),
           named.join(items.select(*keys), keys, "left_semi").select(*keys, F.lit("exists").alias("problem")),
           named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit("repeated").alias("problem"))]
    return reduce(DataFrame.unionByName, bad).distinct()


def assign_ids(wanted: DataFrame, taken: DataFrame, base: str = "base_id", out: str = "item_id") -> DataFrame:
    """Next free millisecond id at or after ``base_id`` for every row of (book_id, seq, base_id).

    Rows choose in ``seq`` order; ``taken`` holds the ids in use.
    """
    def millis(c):
        return F.unix_millis(ts_of_item_id(c))

    rows = wanted.withColumn("__base", millis(base))
    used = taken.select("book_id", millis("item_id").alias("slot")).filter("slot is not null")
    return (claim_slots(rows, used, "__base", ["seq"], "__slot")
            .withColumn(out, F.date_format(F.timestamp_millis("__slot"), "yyyyMMddHHmmssSSS")).select(*wanted.columns, out))


def add_items(items: DataFrame, edges: DataFrame, new: DataFrame, target_parent: str | None = ROOT,
              target_index: int | None = None, new_at_top: bool = False, now: str | None = None):
    """Add rows of item columns plus ``seq``; returns (items, edges, added).

    Rows without an id get the next free one from ``now``; missing ``create`` is
    ``now`` and missing ``modify`` is ``create``.
    """
    books = new.select("book_id").distinct()
    if target_parent is not None:
        _known_parent(items, target_parent, books)
    _require(target_index is None or target_index >= 0, f"invalid index: {target_index}")
    _require(check_new_items(items, new).isEmpty(), "an id is reserved, used or repeated")
    now_col = F.lit(now) if now else item_id_of(F.current_timestamp())
    rows = new
    for c in items.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(items.schema[c].dataType))
    nameless = rows.filter("item_id is null").withColumn("base_id", now_col)
    named = rows.filter("item_id is not null")
    if not nameless.isEmpty():
        taken = items.select("book_id", "item_id").unionByName(named.select("book_id", "item_id"))
        nameless = assign_ids(nameless.drop("item_id"), taken).select(*named.columns)
        rows = named.unionByName(nameless)
    create = F.coalesce(F.col("create"), now_col)
    top = items.groupBy("book_id").agg(F.max("ord").alias("__top"))
    added = (rank_rows(rows.withColumn("create", create).withColumn("modify", F.coalesce("modify", create)), ["book_id"], ["seq"], "__n")
             .join(top, "book_id", "left").withColumn("ord", F.coalesce("__top", F.lit(-1)) + 1 + F.col("__n")))
    added = stage(added.select(*items.columns, "seq"))
    out = items.unionByName(added.select(*items.columns))
    if target_parent is None:
        return out, edges, added
    block = added.select("book_id", "seq", F.col("item_id").alias("child_id"))
    return out, insert_block(edges, block, target_parent, target_index, new_at_top), added


def update_items(items: DataFrame, changes: DataFrame, auto_modify: bool = True, now: str | None = None) -> DataFrame:
    """Partial updates: ``changes`` is (book_id, item_id, seq, props MAP<STRING,STRING>).

    The first change of an id wins, an unknown id rejects the batch, ``modify`` becomes
    ``now`` unless switched off.  Keys that are not columns go to ``extra`` if there is one.
    """
    keys = ["book_id", "item_id"]
    first = changes.groupBy(*keys).agg(F.min_by("props", "seq").alias("__p"))
    _require(first.join(items.select(*keys), keys, "left_anti").isEmpty(), "an updated item does not exist")
    joined = items.join(first, keys, "left")
    hit = F.col("__p").isNotNull()
    out = []
    for f in items.schema.fields:
        if f.name in keys or f.name in ("ord", "extra"):
            c = F.col(f.name)
        else:
            c = F.when(hit & F.map_contains_key("__p", F.lit(f.name)), F.col("__p")[f.name].cast(f.dataType)).otherwise(F.col(f.name))
            if f.name == "modify" and auto_modify:
                c = F.when(hit, F.lit(now) if now else item_id_of(F.current_timestamp())).otherwise(F.col("modify"))
        if f.name == "extra":
            foreign = F.map_filter("__p", lambda k, v: ~k.isin(*items.columns))
            old = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")),
                               lambda k, v: ~F.map_contains_key(foreign, k))
            c = F.when(hit, F.map_concat(old, foreign)).otherwise(F.col("extra"))
        out.append(c.alias(f.name))
    return joined.select(*out)


# -- edges -------------------------------------------------------------------------

def _above(edges: DataFrame, target: str) -> DataFrame:
    """Ids from which ``target`` can be reached, itself included."""
    flipped = edges.select("book_id", F.col("child_id").alias("parent_id"), F.lit(0).alias("pos"), F.col("parent_id").alias("child_id"))
    start = edges.select("book_id").distinct().withColumn("item_id", F.lit(target))
    return reachable(flipped, start)


def move_items(items: DataFrame, edges: DataFrame, picks: DataFrame, target_parent: str,
               target_index: int | None = None, new_at_top: bool = False) -> DataFrame:
    """Move picked edges; a move below the item itself is left out unless it stays in its own list."""
    edges = stage(dense_positions(edges))
    _known_parent(items, target_parent, picks.select("book_id").distinct())
    _require(target_index is None or target_index >= 0, f"invalid index: {target_index}")
    tasks = resolve_picks(edges, picks)
    loops = _above(edges, target_parent).withColumnRenamed("item_id", "child_id")
    free = tasks.filter(F.col("parent_id") != target_parent).join(loops, ["book_id", "child_id"], "left_anti")
    tasks = stage(tasks.filter(F.col("parent_id") == target_parent).unionByName(free.select(*tasks.columns)))
    lengths = edges.filter(F.col("parent_id") == target_parent).groupBy("book_id").agg(F.count(F.lit(1)).alias("__len"))
    at = F.col("__len") if target_index is None and not new_at_top else F.least(F.lit(target_index or 0), F.col("__len"))
    earlier = (tasks.filter(F.col("parent_id") == target_parent).join(lengths, "book_id")
               .filter(F.col("pos") < at).groupBy("book_id").agg(F.count(F.lit(1)).alias("__b")))
    block = tasks.select("book_id", "seq", "child_id").join(earlier, "book_id", "left").withColumn("__b", F.coalesce("__b", F.lit(0)))
    return insert_block(remove_edges(edges, tasks), block, target_parent, target_index, new_at_top, before=F.col("__b"))


def link_items(items: DataFrame, edges: DataFrame, picks: DataFrame, target_parent: str,
               target_index: int | None = None, new_at_top: bool = False) -> DataFrame:
    """Give picked items one more parent."""
    edges = stage(dense_positions(edges))
    _known_parent(items, target_parent, picks.select("book_id").distinct())
    tasks = resolve_picks(edges, picks)
    return insert_block(edges, tasks.select("book_id", "seq", "child_id"), target_parent, target_index, new_at_top)


def recycle_items(items: DataFrame, edges: DataFrame, picks: DataFrame, now: str, new_at_top: bool = False):
    """Unlink picked items; those that became unreachable go to the recycle bin.

    Returns (items, edges, recycled): the bin remembers the old parent and the time.
    """
    edges = stage(dense_positions(edges))
    tasks = resolve_picks(edges, picks)
    ids = tasks.select("book_id", F.col("child_id").alias("item_id"))
    _require(ids.join(items.select("book_id", "item_id"), ["book_id", "item_id"], "left_anti").isEmpty(), "a picked item does not exist")
    left = stage(remove_edges(edges, tasks))
    alive = reachable(left, edges.select("book_id").distinct().withColumn(
        "item_id", F.explode(F.array(*[F.lit(s) for s in SPECIAL_IDS]))))
    lost = (tasks.withColumnRenamed("child_id", "item_id").join(alive, ["book_id", "item_id"], "left_anti"))
    recycled = stage(lost.groupBy("book_id", "item_id").agg(
        F.min_by("parent_id", "seq").alias("parent"), F.min("seq").alias("seq")))
    block = recycled.select("book_id", "seq", F.col("item_id").alias("child_id"))
    marks = recycled.select("book_id", "item_id", F.col("parent").alias("__parent"))
    out = _with_columns(items, ("parent", "recycled")).join(marks, ["book_id", "item_id"], "left")
    gone = F.col("__parent").isNotNull()
    out = (out.withColumn("parent", F.when(gone, F.col("__parent")).otherwise(F.col("parent")))
           .withColumn("recycled", F.when(gone, F.lit(now)).otherwise(F.col("recycled"))).drop("__parent"))
    return out, insert_block(left, block, RECYCLE, None, new_at_top), recycled


def _with_columns(df: DataFrame, names) -> DataFrame:
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
    return df


def unrecycle_items(items: DataFrame, edges: DataFrame, picks: DataFrame, new_at_top: bool = False):
    """Put picked entries back under their recorded parent, or the root when it is gone.

    Returns (items, edges, restored).
    """
    edges = stage(dense_positions(edges))
    items = _with_columns(items, ("parent", "recycled"))
    tasks = resolve_picks(edges, picks)
    left = remove_edges(edges, tasks)
    one = tasks.groupBy("book_id", "child_id").agg(F.min("seq").alias("seq"))
    info = items.select("book_id", F.col("item_id").alias("child_id"), F.col("parent").alias("__want"))
    known = items.select("book_id", F.col("item_id").alias("__want"), F.lit(True).alias("__known"))
    _require(one.join(info, ["book_id", "child_id"], "left_anti").isEmpty(), "a picked item does not exist")
    restored = stage(one.join(info, ["book_id", "child_id"]).join(known, ["book_id", "__want"], "left")
                     .withColumn("parent_id", F.when(F.col("__want").isin(*SPECIAL_IDS) | F.coalesce("__known", F.lit(False)),
                                                     F.col("__want")).otherwise(ROOT))
                     .select("book_id", "parent_id", "seq", "child_id"))
    grown = append_edges(left, restored, new_at_top)
    back = restored.select("book_id", F.col("child_id").alias("item_id"), F.lit(True).alias("__back"))
    out = items.join(back, ["book_id", "item_id"], "left")
    for c in ("parent", "recycled"):
        out = out.withColumn(c, F.when(F.col("__back").isNull(), F.col(c)))
    return out.drop("__back"), grown, restored


def append_edges(edges: DataFrame, new: DataFrame, at_top: bool = False) -> DataFrame:
    """``new`` (book_id, parent_id, seq, child_id) appended to each parent's list in ``seq`` order."""
    ranked = rank_rows(new, PARENT, ["seq"], "__i")
    sizes = edges.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("__len"))
    if not at_top:
        put = (ranked.join(sizes, PARENT, "left")
               .select("book_id", "parent_id", (F.coalesce("__len", F.lit(0)) + F.col("__i")).alias("pos"), "child_id"))
        return edges.select(*EDGE).unionByName(put)
    blocks = new.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("__k"))
    moved = edges.join(blocks, PARENT, "left").select(
        "book_id", "parent_id", (F.col("pos") + F.coalesce("__k", F.lit(0))).alias("pos"), "child_id")
    return moved.unionByName(ranked.select("book_id", "parent_id", F.col("__i").alias("pos"), "child_id"))


def delete_items(items: DataFrame, edges: DataFrame, picks: DataFrame):
    """Unlink picked entries and purge all that became unreachable.

    Returns (items, edges, deleted): ``deleted`` carries the file or folder to remove.
    """
    edges = stage(dense_positions(edges))
    tasks = resolve_picks(edges, picks)
    left = stage(remove_edges(edges, tasks))
    gone = stage(newly_unreachable(edges, left))
    keys = ["book_id", "item_id"]
    kept_items = items.join(gone, keys, "left_anti")
    kept_edges = left.join(gone.withColumnRenamed("item_id", "parent_id"), PARENT, "left_anti")
    entry = (F.when(F.col("index").endswith("/index.html"), F.regexp_replace("index", "/index.html$", ""))
             .when(F.col("index") != "", F.col("index"))) if "index" in items.columns else F.lit(None).cast("string")
    deleted = gone.join(items, keys, "left").select(*keys, entry.alias("entry"))
    return kept_items, kept_edges, deleted


def copy_items(items: DataFrame, edges: DataFrame, picks: DataFrame, target_parent: str, now: str,
               target_index: int | None = None, recursively: bool = True, target_book: str | None = None, new_at_top: bool = False):
    """Copy picked items (and all below) once per source id; further occurrences link to the copy.

    The id is kept when it is free in the target book; otherwise the copy gets the next
    free id from ``now``.  Returns (items, edges, id_map).
    """
    edges = stage(dense_positions(edges))
    tasks = resolve_picks(edges, picks)
    keys = ["book_id", "item_id"]
    tops = tasks.select("book_id", F.col("child_id").alias("item_id"), F.col("seq").alias("rank"))
    _require(tops.join(items.select(*keys), keys, "left_anti").isEmpty(), "a picked item does not exist")
    starts = tops.groupBy(*keys).agg(F.min("rank").alias("rank"))
    scope = reachable(edges, starts, with_order=True) if recursively else starts.withColumn("addr", F.array("rank"))
    source = stage(scope.join(items, keys))
    dest = F.col("book_id") if target_book is None else F.lit(target_book)
    ranked = rank_rows(source.select(F.col("book_id").alias("from_book"), dest.alias("book_id"), F.col("item_id").alias("from_id"), "addr"),
                       ["book_id"], ["from_book", "addr"], "seq")
    there = items.select("book_id", F.col("item_id").alias("from_id"))
    clash = ranked.join(there, ["book_id", "from_id"], "left_semi")
    same = ranked.join(there, ["book_id", "from_id"], "left_anti").withColumn("item_id", F.col("from_id"))
    taken = items.select(*keys).unionByName(same.select(*keys))
    fresh = assign_ids(clash.withColumn("base_id", F.lit(now)), taken).drop("base_id")
    id_map = stage(same.select("from_book", "from_id", "book_id", "item_id", "seq")
                   .unionByName(fresh.select("from_book", "from_id", "book_id", "item_id", "seq")))
    twin = source.withColumnsRenamed({"book_id": "from_book", "item_id": "from_id"}).join(
        id_map.select("from_book", "from_id", "book_id", "item_id", F.col("seq").alias("__n")), ["from_book", "from_id"])
    if "index" in items.columns:
        ext = F.regexp_extract("index", r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)
        name = safe_filename("item_id")
        twin = twin.withColumn("index", F.when(F.col("index").endswith("/index.html"), F.concat(name, F.lit("/index.html")))
                               .when(F.col("index") != "", F.concat(name, ext)).otherwise(F.col("index")))
    top = items.groupBy("book_id").agg(F.max("ord").alias("__top"))
    twin = twin.join(top, "book_id", "left").withColumn("ord", F.coalesce("__top", F.lit(-1)) + 1 + F.col("__n"))
    all_items = items.unionByName(twin.select(*items.columns))
    # inner edges between copies keep their order; a child without metadata has no copy
    a = id_map.select(F.col("from_book").alias("book_id"), F.col("from_id").alias("parent_id"), F.col("book_id").alias("__book"), F.col("item_id").alias("__p"))
    b = id_map.select(F.col("from_book").alias("book_id"), F.col("from_id").alias("child_id"), F.col("item_id").alias("__c"))
    out_edges = edges
    if recursively:
        inner = edges.join(a, PARENT).join(b, ["book_id", "child_id"]).select(
            F.col("__book").alias("book_id"), F.col("__p").alias("parent_id"), "pos", F.col("__c").alias("child_id"))
        out_edges = edges.unionByName(dense_positions(inner))
    block = tasks.join(b, ["book_id", "child_id"]).select(dest.alias("book_id"), "seq", F.col("__c").alias("child_id"))
    return all_items, insert_block(stage(out_edges), block, target_parent, target_index, new_at_top), id_map


# -- batches -------------------------------------------------------------------------

@dataclass
class Catalogue:
    """A snapshot of the two tables edits work on, and the ids changed so far."""

    items: DataFrame
    edges: DataFrame
    changed: list = field(default_factory=list)

    def changed_ids(self) -> DataFrame:
        if not self.changed:
            return self.items.select("book_id", "item_id").limit(0)
        return reduce(DataFrame.unionByName, self.changed).distinct()


def _note(cat: Catalogue, items, edges, ids: DataFrame | None) -> Catalogue:
    extra = [] if ids is None else [ids.select("book_id", "item_id")]
    return replace(cat, items=items, edges=edges, changed=cat.changed + extra)


def apply_batch(cat: Catalogue, steps) -> Catalogue:
    """Apply ``(command, table, options)`` steps in order; all or nothing.

    One step is a whole table of like edits.  A rejected step raises before anything
    is written, so the caller still holds the old snapshot.  The result's
    ``changed_ids`` feed the text-index refresh.
    """
    for command, table, options in steps:
        if command == "add_items":
            i, e, added = add_items(cat.items, cat.edges, table, **options)
            cat = _note(cat, i, e, added)
        elif command == "update_items":
            cat = _note(cat, update_items(cat.items, table, **options), cat.edges, table)
        elif command == "move_items":
            cat = _note(cat, cat.items, move_items(cat.items, cat.edges, table, **options), None)
        elif command == "link_items":
            cat = _note(cat, cat.items, link_items(cat.items, cat.edges, table, **options), None)
        elif command == "copy_items":
            i, e, ids = copy_items(cat.items, cat.edges, table, **options)
            cat = _note(cat, i, e, ids)
        elif command == "recycle_items":
            i, e, ids = recycle_items(cat.items, cat.edges, table, **options)
            cat = _note(cat, i, e, None)
        elif command == "unrecycle_items":
            i, e, ids = unrecycle_items(cat.items, cat.edges, table, **options)
            cat = _note(cat, i, e, None)
        elif command == "delete_items":
            i, e, ids = delete_items(cat.items, cat.edges, table, **options)
            cat = _note(cat, i, e, ids)
        else:
            raise EditError(f"invalid command: {command}")
    return cat
