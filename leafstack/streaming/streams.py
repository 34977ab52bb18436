"""Incremental forms of indexing, search and import on Structured Streaming.

State lives in the checkpoint of the query; sinks are keyed and idempotent, so a
replayed batch gives the same table.
"""

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import KEY, classify, extract
from ..operators.pages import segments_text
from ..operators.search import SearchSpec
from ..runtime import broadcast_if_small, stage


def page_stream(spark: SparkSession, folder: str, schema, max_files: int = 1000) -> DataFrame:
    """Arriving page files (parquet) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


PAGE = [*KEY, "path"]


def index_batch(spark: SparkSession, target: str):
    """``foreachBatch`` function of the text index: one folder of rows per batch.

    The folder name is the batch id, so a replay overwrites its own output.  A page without content
    is gone; with path '' too, the whole item is.  Which row of a page is its newest is settled by
    keys; only those rows' bytes are read further.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("__stamp", F.struct("mtime", F.col("content").isNull().alias("gone"), F.xxhash64("content").alias("hash")))
        newest = marked.groupBy(*PAGE).agg(F.max("__stamp").alias("__stamp"))
        rows = marked.join(newest, [*PAGE, "__stamp"], "left_semi").drop("__stamp")
        done = extract(rows.filter("content is not null").withColumn("ord", F.lit(0))).withColumn("content", segments_text(F.col("segments")))
        texts = done.select(*PAGE, F.col("mtime").alias("src_mtime"), "content", F.lit(False).alias("gone"))
        gone = rows.filter("content is null").select(*PAGE, F.col("mtime").alias("src_mtime"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("gone"))
        texts.unionByName(gone).dropDuplicates(PAGE).write.mode("overwrite").parquet(f"{target}/batches/batch={batch_id}")

    return handle


def index_stream(pages: DataFrame, target: str, checkpoint: str, **options):
    """Start the text index over (book_id, item_id, path, mtime, content) pages."""
    return (pages.writeStream.foreachBatch(index_batch(pages.sparkSession, target))
            .option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start())


def _folders(spark: SparkSession, place: str, name: str) -> dict[int, str]:
    """Finished folders ``name=number`` in ``place``, by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    found = [str(f.getPath().toString()) for f in fs.listStatus(path)]
    own = {int(f.rsplit("=", 1)[1]): f for f in found if re.search(rf"/{name}=\d+$", f)}
    return {n: f for n, f in own.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))}


def _stored(spark: SparkSession, target: str) -> tuple[DataFrame | None, int]:
    """Rows of the last snapshot and of the batches after it, with their batch, and the last of those."""
    shots, batches = _folders(spark, f"{target}/snapshots", "upto"), _folders(spark, f"{target}/batches", "batch")
    upto = max(shots, default=-1)
    parts = [spark.read.parquet(f).withColumn("batch", F.lit(n).cast("long"))
             for n, f in [*([(upto, shots[upto])] if shots else []), *((n, f) for n, f in batches.items() if n > upto)]]
    return (reduce(DataFrame.unionByName, parts) if parts else None), max([upto, *batches])


def _current(rows: DataFrame) -> DataFrame:
    """Newest row of every page, and of every item that is gone as a whole; pages that went with it are left out."""
    stamp = F.struct("src_mtime", "batch")
    newest = rows.groupBy(*PAGE).agg(F.max(stamp).alias("__stamp"))
    ends = newest.filter("path = ''").select(*KEY, F.col("__stamp.src_mtime").alias("__end"))
    alive = newest.join(ends, KEY, "left").filter("path = '' or __end is null or __stamp.src_mtime > __end").select(*PAGE, "__stamp")
    return rows.withColumn("__stamp", stamp).join(alive, [*PAGE, "__stamp"], "left_semi").drop("__stamp")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """Current text table: (book_id, item_id, path, src_mtime, content) of all pages that are there."""
    rows, _ = _stored(spark, target)
    if rows is None:
        return spark.createDataFrame([], "book_id string, item_id string, path string, src_mtime timestamp, content string")
    return _current(rows).filter("not gone").drop("gone", "batch")


def compact(spark: SparkSession, target: str) -> int | None:
    """Merge the last snapshot and all batches into one snapshot; the number of the last batch in it, or None.

    The snapshot is written aside and renamed, so readers see the old state or the new one; batches
    and older snapshots go only after that, and a batch replayed later is known by its number.
    What is gone stays noted, so that a late row of it does not come back.
    """
    rows, upto = _stored(spark, target)
    shots = _folders(spark, f"{target}/snapshots", "upto")
    if rows is None or upto in shots:
        return upto if upto in shots else None
    aside, place = f"{target}/aside-{uuid.uuid4().hex}", f"{target}/snapshots/upto={upto}"
    _current(rows).drop("batch").write.parquet(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{target}/snapshots"))
    if not fs.rename(path(aside), path(place)):
        raise RuntimeError(f"another compaction wrote {place}")
    old = [f for n, f in _folders(spark, f"{target}/batches", "batch").items() if n <= upto] + [f for n, f in shots.items() if n < upto]
    for folder in old:
        fs.delete(path(folder), True)
    return upto


def standing_search(items: DataFrame, spec: SearchSpec) -> DataFrame:
    """Hits among arriving rows (items with ``path`` and ``content``), as they come; no sort, no limit."""
    return items.filter(spec.to_column())


def dedup_imports(exports: DataFrame) -> DataFrame:
    """First record per export id.

    An import remembers every id it has seen, so no watermark lets ids go or drops late rows; the
    state is one row per id (use the RocksDB state store for many).
    """
    return exports.dropDuplicates(["book_id", "eid"])


def change_feed(changes: DataFrame, refresh, checkpoint: str):
    """Collect changed ids per batch and hand them, distinct, to ``refresh(ids, batch_id)``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        refresh(batch.select(*KEY).distinct(), batch_id)

    return (changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def refresh_feed(changes: DataFrame, snapshot, target: str, checkpoint: str):
    """Refresh actions of changed items, once per batch of changes.

    ``snapshot(batch_id)`` gives the tables as they are for that batch, the same on a replay: a dict
    of the arguments of ``classify``.  Only rows of changed items are classified.  A batch writes its
    own folder, which a replay overwrites.
    """

    def refresh(ids: DataFrame, batch_id: int) -> None:
        tables = dict(snapshot(batch_id))
        ids = broadcast_if_small(stage(ids))
        for name in ("items", "fulltext", "page_files", "paths"):
            tables[name] = tables[name].join(ids, KEY, "left_semi")
        classify(**tables).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return change_feed(changes, refresh, checkpoint)


def read_actions(spark: SparkSession, target: str) -> DataFrame:
    """(book_id, item_id, path, action, reason, batch) by the last batch that an item changed in; no rows before the first one."""
    if not _folders(spark, target, "batch"):
        return spark.createDataFrame([], "book_id string, item_id string, path string, action string, reason string, batch int")
    rows = spark.read.option("basePath", target).parquet(target)
    last = rows.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*KEY, "batch"], "left_semi")
