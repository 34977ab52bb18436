"""Catalogue files: JSON in a script wrapper, split in shards.

A shard file is read by one task; the writer keeps shards bounded.  Everything
after parsing is a table.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, stage
from ..scale import rank_rows, running_sum
from ..schema import FLAG_PROPS, META_SHARD, TEXT_PROPS, TEXT_SHARD, TOC_SHARD

# --- fixed values -----------------------------------------------------------
WRAPPER = r"(?s)^(?:/\*[^\n]*\*/|[^(])+\((.*)\)(?:/\*[^\n]*\*/|[\s;])*$"
WRAP_HEAD = {
    "meta": "/* Feel free to edit this file, but keep data code valid JSON format. */\nscrapbook.meta(",
    "toc": "/* Feel free to edit this file, but keep data code valid JSON format. */\nscrapbook.toc(",
    "fulltext": "/* This file is generated and is not intended to be edited. */\nscrapbook.fulltext(",
}
# ----------------------------------------------------------------------------


def read_shards(spark: SparkSession, paths, name: str) -> DataFrame:
    """(book_id, shard, text) of ``<book>/tree/<name><n>.js`` files; shards after a gap are left out."""
    raw = spark.read.text(paths, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return shard_rows(raw, name)


def shard_rows(raw: DataFrame, name: str) -> DataFrame:
    """``raw``: (file, value).  The first file has no number, the next is 1, and so on."""
    rx = rf"([^/]*)/[^/]*/{name}([0-9]*)\.js$"
    rows = (raw.filter(F.col("file").rlike(rx))
            .select(F.regexp_extract("file", rx, 1).alias("book_id"),
                    F.coalesce(F.regexp_extract("file", rx, 2).try_cast("int"), F.lit(0)).alias("shard"),
                    F.col("value").alias("text"), "file"))
    # which shards follow each other is told from their numbers alone, one row per shard; texts stay where they are
    earlier = Window.partitionBy("book_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbers = rows.groupBy("book_id", "shard").agg(F.count(F.lit(1)).alias("__files"))
    placed = numbers.withColumn("__n", F.coalesce(F.sum("__files").over(earlier), F.lit(0))).filter("__n = shard").drop("__n")
    found = rows.join(broadcast_if_small(placed), ["book_id", "shard"])
    # of files that share a number any one is read
    twins = found.filter("__files > 1").dropDuplicates(["book_id", "shard"])
    return found.filter("__files = 1").unionByName(twins).select(*rows.columns)


def parse_shards(shards: DataFrame) -> DataFrame:
    """(book_id, shard, ord, key, value JSON, error): one row per entry, or one with the error of a bad file."""
    text = F.col("text")
    body = F.regexp_extract(text, WRAPPER, 1)
    wrapped = text.rlike(WRAPPER)
    parsed = F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})
    error = F.when(F.trim(text) == "", F.lit(None).cast("string")).when(~wrapped, "malformed wrapping").when(parsed.isNull(), "malformed JSON")
    tagged = shards.withColumn("__e", error).withColumn("__m", parsed)
    good = (tagged.filter("__e is null and text <> ''")
            .select("book_id", "shard", F.posexplode("__m").alias("ord", "key", "value"))
            .withColumn("ord", F.col("ord").cast("long")).withColumn("error", F.lit(None).cast("string")))
    bad = tagged.filter("__e is not null").select(
        "book_id", "shard", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("string").alias("value"), F.col("__e").alias("error"))
    return good.unionByName(bad)


def merge_shards(entries: DataFrame, keys=("book_id", "key")) -> DataFrame:
    """Last shard wins, first position stays, a null value deletes.

    ``entries``: keys, shard, ord, value.  ``ord`` of the result orders by the shard and
    place where the key was first seen.
    """
    return (entries.groupBy(*keys)
            .agg(F.max_by(F.struct("value"), F.struct("shard", "ord")).alias("__v"), F.min(F.struct("shard", "ord")).alias("__o"))
            .filter(F.col("__v.value").isNotNull())
            .select(*keys, F.col("__v.value").alias("value"),
                    (F.col("__o.shard").cast("long") * (1 << 40) + F.col("__o.ord")).alias("ord")))


def load_items(entries: DataFrame) -> DataFrame:
    """Merged ``meta`` entries -> item columns; unknown properties go to ``extra``."""
    props = F.from_json("value", "map<string,string>")
    rows = entries.withColumn("p", props)
    flags = [F.when(F.lower(F.coalesce(F.col("p")[n], F.lit(""))).isin("", "false", "null", "0"), False).otherwise(True).alias(n) for n in FLAG_PROPS]
    extra = F.map_filter("p", lambda k, v: ~k.isin(*TEXT_PROPS, *FLAG_PROPS))
    return rows.select("book_id", F.col("key").alias("item_id"), "ord", *[F.col("p")[n].alias(n) for n in TEXT_PROPS], *flags,
                       (F.size("p") == 0).alias("meta_empty"), extra.alias("extra"))


def load_edges(entries: DataFrame) -> DataFrame:
    """Merged ``toc`` entries -> edges."""
    return (entries.select("book_id", F.col("key").alias("parent_id"), F.posexplode(F.from_json("value", "array<string>")).alias("pos", "child_id"))
            .select("book_id", "parent_id", F.col("pos").cast("long").alias("pos"), "child_id"))


def load_toc_lists(entries: DataFrame) -> DataFrame:
    """The array form, which can show an empty list."""
    return entries.select("book_id", F.col("key").alias("parent_id"), F.from_json("value", "array<string>").alias("children"))


def load_fulltext(entries: DataFrame) -> DataFrame:
    """Merged ``fulltext`` entries -> one row per page text."""
    pages = F.from_json("value", "map<string,struct<content:string>>")
    return (entries.select("book_id", F.col("key").alias("item_id"), F.posexplode(pages).alias("ord", "path", "v"))
            .select("book_id", "item_id", "path", F.col("ord").cast("long").alias("ord"), F.col("v.content").alias("content")))


# -- writing ---------------------------------------------------------------------------

def meta_shards(items: DataFrame, threshold: int = META_SHARD) -> DataFrame:
    """Shard of every item: the first shard holds threshold-1 items, the others threshold."""
    ranked = rank_rows(items.select("book_id", "item_id", "ord"), ["book_id"], ["ord", "item_id"], "n")
    return ranked.select("book_id", "item_id", "ord", F.floor((F.col("n") + 1) / F.lit(threshold)).cast("int").alias("shard"))


def greedy_shards(sizes: DataFrame, threshold: int, first_fill: int = 1) -> DataFrame:
    """Shard of every (book_id, key, ord, size) row: a shard closes when its sum reaches ``threshold``.

    Where a shard ends depends on where it starts, so the greedy fill is a pointer chain.
    With prefix sums, the row that closes a shard started at any row is one rank away;
    doubling these pointers finds the starts met from the first row in log2(shards)
    rounds.  No task holds a whole book.
    """
    ranked = rank_rows(sizes.select("book_id", "key", "ord", "size"), ["book_id"], ["ord", "key"], "n")
    sums = stage(running_sum(ranked.select("book_id", "key", "n", "size"), ["book_id"], "n", "size", "upto"))
    goal = F.col("upto") - F.col("size") + F.lit(threshold) - F.when(F.col("n") == 0, first_fill).otherwise(0)
    both = sums.select("book_id", "n", goal.alias("v"), F.lit(0).alias("side")).unionByName(
        sums.select("book_id", "n", F.col("upto").alias("v"), F.lit(1).alias("side")))
    # rows below the goal: rank among both sides minus the goals before (goals rise with n)
    spot = rank_rows(both, ["book_id"], ["v", "side", "n"], "r").filter("side = 0")
    jump = stage(spot.select("book_id", "n", (F.col("r") - F.col("n") + 1).alias("to")))
    starts = stage(sums.filter("n = 0").select("book_id", "n"))
    known = sums.select("book_id", "n")
    while True:
        new = starts.join(jump, ["book_id", "n"]).select("book_id", F.col("to").alias("n"))
        new = stage(new.join(known, ["book_id", "n"], "left_semi").join(starts, ["book_id", "n"], "left_anti"))
        if new.isEmpty():
            break
        starts = stage(starts.unionByName(new))
        hop = jump.select("book_id", F.col("n").alias("to"), F.col("to").alias("__far"))
        jump = stage(jump.join(hop, ["book_id", "to"]).select("book_id", "n", F.col("__far").alias("to")))
    flagged = sums.join(starts.withColumn("__s", F.lit(1)), ["book_id", "n"], "left").withColumn("__s", F.coalesce("__s", F.lit(0)))
    return (running_sum(flagged, ["book_id"], "n", "__s", "__k")
            .select("book_id", "key", (F.col("__k") - 1).cast("int").alias("shard")))


def toc_shards(edges: DataFrame, order: DataFrame, threshold: int = TOC_SHARD) -> DataFrame:
    """Shard of every list; a list counts one plus its length.  ``order``: (book_id, key, ord) of the lists."""
    sizes = edges.groupBy("book_id", F.col("parent_id").alias("key")).agg((F.count(F.lit(1)) + 1).alias("size"))
    return greedy_shards(sizes.join(order, ["book_id", "key"]), threshold)


def text_shards(fulltext: DataFrame, order: DataFrame, threshold: int = TEXT_SHARD) -> DataFrame:
    """Shard of every item's text by characters."""
    sizes = fulltext.groupBy("book_id", F.col("item_id").alias("key")).agg(F.sum(F.length("content")).cast("long").alias("size"))
    return greedy_shards(sizes.join(order, ["book_id", "key"]), threshold)


def script_safe(json: Column) -> Column:
    """Escape the two line separators that break script strings."""
    return F.replace(F.replace(json, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def entry_lines(items: DataFrame) -> DataFrame:
    """(book_id, key, ord, line): ``"id": {...}`` lines of meta files."""
    names = [n for n in (*TEXT_PROPS, *FLAG_PROPS) if n in items.columns]
    # flags that are not set, and properties that are null, are not written: empty metadata stay {}
    doc = F.to_json(F.struct(*[F.when(F.col(n), True).alias(n) if n in FLAG_PROPS else F.col(n) for n in names]))
    if "extra" in items.columns:
        more = F.to_json(F.coalesce("extra", F.create_map().cast("map<string,string>")))
        doc = F.when(more == "{}", doc).when(doc == "{}", more).otherwise(
            F.concat(F.regexp_replace(doc, r"\}$", ","), F.regexp_replace(more, r"^\{", "")))
    return items.select("book_id", F.col("item_id").alias("key"), "ord",
                        script_safe(F.concat(F.to_json(F.struct(F.col("item_id").alias("k"))), F.lit(""))).alias("__k"), script_safe(doc).alias("value")).select(
        "book_id", "key", "ord", F.concat(F.regexp_extract("__k", r'^\{"k":(.*)\}$', 1), F.lit(": "), "value").alias("line"))


def write_shards(lines: DataFrame, shards: DataFrame, name: str, out: str) -> None:
    """Write one wrapped script file per shard under ``out/book_id=<book>/<name>_shard=<n>/``.

    ``lines``: (book_id, key, ord, line); ``shards``: (book_id, key, shard).  A shard is
    bounded, so it is laid out on one task and streamed in order through Spark's text writer.
    """
    part = f"{name}_shard"
    rows = lines.join(shards.withColumnRenamed("shard", part), ["book_id", "key"]).select("book_id", part, "ord", "line")
    ends = rows.groupBy("book_id", part).agg(F.min("ord").alias("__first"))
    body = rows.join(ends, ["book_id", part]).withColumn(
        "line", F.concat(F.when(F.col("ord") == F.col("__first"), "  ").otherwise(", "), F.col("line")))
    framed = (body.select("book_id", part, F.lit(1).alias("__k"), "ord", "line")
              .unionByName(ends.select("book_id", part, F.lit(0).alias("__k"), F.lit(0).cast("long").alias("ord"), F.lit(WRAP_HEAD[name] + "{").alias("line")))
              .unionByName(ends.select("book_id", part, F.lit(2).alias("__k"), F.lit(0).cast("long").alias("ord"), F.lit("})").alias("line"))))
    (framed.repartition("book_id", part).sortWithinPartitions("book_id", part, "__k", "ord")
     .select("book_id", part, "line").write.partitionBy("book_id", part).mode("overwrite").text(out))


def read_written(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Shards written by ``write_shards``: (book_id, shard, text, file)."""
    raw = spark.read.text(f"{out}/book_id=*/{name}_shard=*", wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return raw.select(F.regexp_extract("file", r"book_id=([^/]*)/", 1).alias("book_id"),
                      F.regexp_extract("file", rf"{name}_shard=([0-9]+)/", 1).cast("int").alias("shard"), F.col("value").alias("text"), "file")
