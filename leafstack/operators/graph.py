"""Closure, path expansion and redirect chains over ordered edges.

Fixpoints are driver loops of joins.  Each round stages only the frontier; the
edge table is never copied.  A frontier whose counted size is small is broadcast,
a larger one is joined by shuffle, where adaptive execution splits hub parents.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, stage
from ..schema import SPECIAL_IDS


def _roots(edges: DataFrame, roots) -> DataFrame:
    """Rows (book_id, item_id, rank): every book gets the literal roots; a table is taken as it is."""
    if isinstance(roots, DataFrame):
        cols = roots.columns
        rank = F.col("rank") if "rank" in cols else F.lit(0)
        return roots.select("book_id", "item_id", rank.cast("long").alias("rank"))
    if isinstance(roots, str):
        roots = (roots,)
    listed = F.array(*[F.struct(F.lit(r).alias("item_id"), F.lit(i).cast("long").alias("rank"))
                       for i, r in enumerate(dict.fromkeys(roots))])
    return (edges.select("book_id").distinct()
            .withColumn("__r", F.explode(listed)).select("book_id", "__r.*"))


def _hint(df: DataFrame, rows: int, width: int = 1) -> DataFrame:
    """Broadcast a counted side; ``width`` is the number of ids or positions a row carries."""
    return F.broadcast(df) if rows * width <= BROADCAST_ROWS else df


def reachable(edges: DataFrame, roots=SPECIAL_IDS, with_order: bool = False) -> DataFrame:
    """Ids reachable from ``roots`` (roots included), cycle-safe.

    ``with_order`` adds ``addr``, the smallest list of child positions leading to
    the id: sorting by it gives the depth-first first-visit order.
    """
    start = _roots(edges, roots)
    if with_order:
        return _reach_ordered(edges, start)
    seen = stage(start.select("book_id", "item_id").distinct())
    frontier, parts = seen, [seen]
    links = edges.select("book_id", F.col("parent_id").alias("item_id"), "child_id")
    while True:
        n = frontier.count()
        if n == 0:
            break
        step = (links.join(_hint(frontier, n), ["book_id", "item_id"])
                .select("book_id", F.col("child_id").alias("item_id")).distinct())
        known = reduce(DataFrame.unionByName, parts)
        frontier = stage(step.join(known, ["book_id", "item_id"], "left_anti"))
        parts.append(frontier)
        if len(parts) > 32:
            parts = [stage(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def _reach_ordered(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Each round stages what it found better, and only that; the best of all rounds is taken at the end."""
    key = ["book_id", "item_id"]

    def best(df):
        return df.groupBy(*key).agg(F.min("addr").alias("addr"))

    frontier = stage(best(start.select(*key, F.array("rank").alias("addr"))))
    parts, links, depth = [frontier], edges.select("book_id", F.col("parent_id").alias("item_id"), F.col("pos").cast("long").alias("pos"), "child_id"), 0
    while True:
        n, depth = frontier.count(), depth + 1
        if n == 0:
            return best(reduce(DataFrame.unionByName, parts))
        step = stage(best(links.join(_hint(frontier, n, depth), key)
                          .select("book_id", F.col("child_id").alias("item_id"), F.concat("addr", F.array("pos")).alias("addr"))))
        met = reduce(DataFrame.unionByName, parts).join(step.select(*key), key, "left_semi")
        frontier = stage(step.join(best(met).withColumnRenamed("addr", "__old"), key, "left")
                         .filter(F.col("__old").isNull() | (F.col("addr") < F.col("__old"))).drop("__old"))
        parts.append(frontier)
        if len(parts) > 32:
            parts = [stage(best(reduce(DataFrame.unionByName, parts)))]


def newly_unreachable(before: DataFrame, after: DataFrame, roots=SPECIAL_IDS) -> DataFrame:
    """Ids reachable over the edges ``before`` but not ``after``."""
    return reachable(before, roots).join(reachable(after, _roots(before, roots)), ["book_id", "item_id"], "left_anti")


def preorder(edges: DataFrame, roots=SPECIAL_IDS, expandable: DataFrame | None = None) -> DataFrame:
    """Every path below the roots, in depth-first order of ``addr``.

    A node already on its own ancestor path is emitted once more and not expanded.
    ``expandable`` (book_id, item_id) restricts the nodes that appear at all.
    Columns: book_id, item_id, pos, addr (positions from the root list on),
    path (ancestor ids, root first), cyc.
    """
    links = edges.select("book_id", F.col("parent_id").alias("__p"), F.col("pos").cast("long").alias("__pos"), "child_id")
    if expandable is not None:
        ok = expandable.select("book_id", F.col("item_id").alias("child_id")).distinct()
        links = links.join(ok, ["book_id", "child_id"], "left_semi")
    start = _roots(edges, roots).select(
        "book_id", "item_id", F.array("rank").alias("addr"),
        F.array().cast("array<string>").alias("path"), F.lit(False).alias("cyc"))
    frontier, levels = stage(start), []
    while True:
        n = frontier.filter("not cyc").count()
        if n == 0:
            break
        up = _hint(frontier.filter("not cyc").withColumnRenamed("item_id", "__p"), n, 2 * len(levels) + 2)
        step = (links.join(up, ["book_id", "__p"])
                .select("book_id", F.col("child_id").alias("item_id"), F.col("__pos").alias("pos"),
                        F.concat("addr", F.array("__pos")).alias("addr"),
                        F.concat("path", F.array("__p")).alias("path"),
                        F.array_contains(F.concat("path", F.array("__p")), F.col("child_id")).alias("cyc")))
        frontier = stage(step)
        levels.append(frontier)
    if not levels:
        return frontier.withColumn("pos", F.lit(0).cast("long")).limit(0).select(
            "book_id", "item_id", "pos", "addr", "path", "cyc")
    return reduce(DataFrame.unionByName, levels)


def expand_addresses(edges: DataFrame, addresses: DataFrame, recursive: bool = True) -> DataFrame:
    """Occurrences named by positional addresses ``(book_id, root_id, steps)``, optionally with all below.

    Deduplicated by the full address, so overlapping selections give each
    occurrence once.  Addresses that do not exist are dropped.
    """
    links = edges.select("book_id", F.col("parent_id").alias("__p"), F.col("pos").cast("long").alias("__pos"), "child_id")
    todo = stage(addresses.filter(F.size("steps") > 0).distinct().select(
        "book_id", "root_id", F.col("steps").cast("array<bigint>").alias("steps"), F.lit(0).alias("depth"),
        F.col("root_id").alias("item_id"), F.array().cast("array<string>").alias("path")))
    found = []
    while True:
        n = todo.count()
        if n == 0:
            break
        want = todo.withColumn("__pos", F.element_at("steps", F.col("depth") + 1)).withColumnRenamed("item_id", "__p")
        step = stage(links.join(_hint(want, n, 2 * len(found) + 2), ["book_id", "__p", "__pos"]).select(
            "book_id", "root_id", "steps", (F.col("depth") + 1).alias("depth"),
            F.col("child_id").alias("item_id"), F.concat("path", F.array("__p")).alias("path")))
        found.append(step.filter(F.col("depth") == F.size("steps")))
        todo = step.filter(F.col("depth") < F.size("steps"))
    out = ["book_id", "root_id", "steps", "item_id", "path"]
    if not found:
        return todo.select(*out)
    picked = reduce(DataFrame.unionByName, found).select(*out)
    if not recursive:
        return picked
    levels, frontier = [picked], picked
    while True:
        open_ = frontier.filter(~F.array_contains("path", F.col("item_id")))
        n = open_.count()
        if n == 0:
            break
        frontier = stage(links.join(_hint(open_.withColumnRenamed("item_id", "__p"), n, 2 * len(levels) + 2), ["book_id", "__p"]).select(
            "book_id", "root_id", F.concat("steps", F.array("__pos")).alias("steps"),
            F.col("child_id").alias("item_id"), F.concat("path", F.array("__p")).alias("path")))
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels).dropDuplicates(["book_id", "root_id", "steps"])


def redirect_targets(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Final target of every redirecting node, by pointer doubling.

    ``edges`` has at most one row per source; a target that does not redirect ends
    the chain.  Columns: src, final, hops, circular (final is null then).  After k
    rounds chains of 2^k hops are resolved; chains still open after more rounds
    than the number of nodes can need are cycles.
    """
    hops = stage(edges.select(F.col(source).alias("src"), F.col(target).alias("at"), F.lit(1).cast("long").alias("hops")))
    limit = max(hops.count(), 1)
    settled, span = [], 1
    while True:
        nxt = hops.select(F.col("src").alias("at"), F.col("at").alias("__to"), F.col("hops").alias("__n"))
        moved = stage(hops.join(nxt, "at", "left"))
        done = moved.filter(F.col("__to").isNull()).select("src", F.col("at").alias("final"), "hops")
        settled.append(done.withColumn("circular", F.lit(False)))
        rest = moved.filter(F.col("__to").isNotNull())
        if rest.isEmpty():
            break
        if span > limit:
            settled.append(rest.select("src", F.lit(None).cast(hops.schema["at"].dataType).alias("final"),
                                       F.lit(None).cast("long").alias("hops"), F.lit(True).alias("circular")))
            break
        # settled chains stay reachable through their end, so keep them as one-hop pointers
        hops = stage(rest.select("src", F.col("__to").alias("at"), (F.col("hops") + F.col("__n")).alias("hops"))
                     .unionByName(done.select("src", F.col("final").alias("at"), "hops")))
        settled = []
        span *= 2
    return reduce(DataFrame.unionByName, settled)
