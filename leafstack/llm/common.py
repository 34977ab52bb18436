"""Helpers shared by the operators: written tables, size-checked broadcasts, column names, words."""

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words everywhere in this package: maximal runs of anything but ASCII white space.  In Python
# `bytes.split()` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"

# A side is broadcast only after both were checked.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="leafstack-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# Folders of all tables written so far.
TABLES = []


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete these written tables, which nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        TABLES.remove(path)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, keeps column pruning, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/leafstack-{name}-{uuid.uuid4().hex}"
    TABLES.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> bool:
    """True when `df`, at `row_bytes` a row, stays within the rows and bytes a broadcast may have."""
    most = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    return df.limit(most + 1).count() <= most


def beside(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df` as the right side of a join: broadcast if its checked size allows, else left to a shuffle join."""
    return F.broadcast(df) if small(df, row_bytes) else df


# Longs of a row of marks, and the numbers that it tells about, one bit each.
MARKS, MARKED = 8, 512


def marks(numbers: DataFrame, name: str = "marks") -> DataFrame:
    """The longs of the one column of `numbers` as a written table of bits: a row for MARKED numbers in a row, if any is there."""
    n = F.col(f"`{numbers.columns[0]}`")
    place, bit = F.shiftright(n, 6).bitwiseAND(F.lit(MARKS - 1)), F.expr(f"shiftleft(1L, cast(`{numbers.columns[0]}` & 63 as int))")
    return written(numbers.filter(n.isNotNull()).groupBy(F.shiftright(n, 9).alias("__page"))
                   .agg(*[F.coalesce(F.bit_or(F.when(place == k, bit)), F.lit(0)).alias(f"__m{k}") for k in range(MARKS)]), name)


def among(df: DataFrame, column: str, numbers: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """The rows of `df` whose long `column` is one of `numbers` (one column); `marked`: their marks, if they are at hand.

    Numbers handed out in a row take some two bits each when broadcast, so that wide rows stay where
    they are up to tens of millions of numbers; only beyond, or if the numbers are too scattered, they are shuffled.
    """
    marked = marks(numbers) if marked is None else marked
    if not small(marked, 96):
        return df.join(numbers.toDF(column).distinct(), column, "left_semi")
    longs = F.array(*[F.col(f"__m{k}") for k in range(MARKS)])
    held = F.get(longs, F.shiftright(column, 6).bitwiseAND(F.lit(MARKS - 1)).cast("int"))
    there = F.expr(f"cast(`{column}` & 63 as int)")
    return (df.join(F.broadcast(marked), F.shiftright(column, 9) == F.col("__page"))
            .filter(F.call_function("getbit", held, there) == 1).select(*[F.col(f"`{c}`") for c in df.columns]))


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart, null as empty: the same on every reading, unlike a row's number."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns of these names in any case: an operator's own columns replace those of its input."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def only(df: DataFrame, **columns: Column) -> DataFrame:
    """Just these columns; whatever else `df` has, under whatever name, plays no part."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


# Columns that `ordered_sums` makes; input columns of these names are replaced.
SUMS = ("__before", "__rank", "__total", "__salt", "__at", "__piece", "__p", "__v", "__n", "__v0", "__n0", "__upto", "__k")


def ordered_sums(df: DataFrame, group, order, value: str, name: str) -> DataFrame:
    """`df` with `__before` (sum of `value` in earlier rows of the group), `__rank` (their number) and `__total`.

    Rows are range-partitioned by group and order together, so a hot group is cut along its order.
    The ordered rows are written once; sums inside a partition then only need the totals of the
    group's earlier partitions.  Rows that tie fall in some order, the same for all readers.
    """
    df = without(df, *SUMS)
    sort = [F.col(f"`{c}`") for c in [*group, *order]] + [F.col("__salt")]
    laid = written(df.withColumn("__salt", F.monotonically_increasing_id())  # equal keys still spread over partitions
                   .repartitionByRange(*sort).sortWithinPartitions(*sort).drop("__salt")
                   .withColumn("__at", F.monotonically_increasing_id())
                   .withColumn("__piece", F.shiftright("__at", 33)), name)
    keys = [F.col(f"`{g}`") for g in group]
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition
    totals = (laid.groupBy(*keys, "__piece").agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
              .select(*[k.alias(f"__g{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__p"),
                      F.sum("__v").over(Window.partitionBy(*keys)).alias("__total"),
                      F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias("__v0"),
                      F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0")))
    inside = Window.partitionBy(*keys, "__piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col("__piece") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(f"__g{i}"))
    if not group:
        totals = F.broadcast(totals)  # one row per range partition, however many rows there are
    return (laid.withColumn("__upto", F.sum(value).over(inside)).withColumn("__k", F.row_number().over(inside))
            .join(totals, on)
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__v0") + F.col("__upto") - F.col(value)).alias("__before"),
                    (F.col("__n0") + F.col("__k") - 1).cast("long").alias("__rank"), "__total"))


# Bytes of text that a task works on at once.
PIECE = 1 << 18


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and an executor may hold several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def text_groups(batches, size: int = PIECE):
    """(texts as bytes, batch) for groups of rows of some `size` bytes; the text, or binary, is the last column; null is empty."""
    try:
        yield from _text_groups(batches, size)
    finally:
        give_back()


def _text_groups(batches, size: int):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        group, first, held = [], 0, 0
        for i in range(batch.num_rows):
            value = texts[i].as_py() or b""
            group.append(value.encode() if isinstance(value, str) else value)
            held += len(group[-1]) + 1
            if held >= size:
                yield group, batch.slice(first, i + 1 - first)
                group, first, held = [], i + 1, 0
        if group:
            yield group, batch.slice(first)
