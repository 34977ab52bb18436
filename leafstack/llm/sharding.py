"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are put in one global order.  Each range partition gives its total; the totals before it, and
the running total inside it, give every row its place on the byte axis, which is cut at equal
targets.  Only columns handed in take part, so a plan over (id, size) moves no text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SUMS, ordered_sums, without


def assign_shards(df: DataFrame, shards: int = 16, size: str = "size", order=("doc_id",)) -> DataFrame:
    """All rows of `df` with `shard` int (0 to shards - 1) and `slot` long (gapless from 0 in its shard).

    Shards are contiguous in `order` (nulls first).  A row goes where its middle byte lies, so a
    shard's bytes miss the equal target by less than one row at either end.  A null or negative
    size counts as 0; where all sizes are 0 every row is in shard 0.  Ties in `order` fall in some
    order, once and for all, as the ordered rows are written before they are summed; equal rows
    are interchangeable.  An empty table gives no rows.  Input columns named like an output are
    replaced.
    """
    df = without(df, "shard", "slot", "__bytes", "__start", *SUMS)
    sized = df.withColumn("__bytes", F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).cast("long"))
    # twice the row's middle, to stay in integers
    placed = ordered_sums(sized, [], order, "__bytes", "shards").withColumn("shard", F.expr(
        f"cast(if(__total = 0, 0, least((2 * __before + __bytes) * {shards} div (2 * greatest(__total, 1)), {shards - 1})) as int)"))
    # one row per shard
    starts = placed.groupBy("shard").agg(F.min("__rank").alias("__start"))
    return (placed.join(F.broadcast(starts), "shard")
            .select(*[F.col(f"`{c}`") for c in df.columns], "shard", (F.col("__rank") - F.col("__start")).cast("long").alias("slot")))


def write_shards(df: DataFrame, path: str, shards: int = 16, text: str = "text", key: str = "doc_id") -> None:
    """Write whole rows as one Parquet folder per shard (`shard=K`), in slot order.

    Only (key, size) is ranked.  The rows are then tagged by comparing their key with the first key
    of each shard, so text moves once, into its shard; rows that share a key stay together.
    """
    sized = df.select(F.col(f"`{key}`").alias("__key"), (F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + 1).alias("bytes"))
    cuts = assign_shards(sized, shards, "bytes", ("__key",)).groupBy("shard").agg(F.min("__key").alias("__first"))
    # at most `shards` keys
    firsts = [r["__first"] for r in cuts.filter("shard > 0 and __first is not null").collect()]
    tag = sum((F.when(F.col(f"`{key}`") >= F.lit(x), 1).otherwise(0) for x in firsts), F.lit(0))
    (without(df, "shard").withColumn("shard", tag.cast("int")).repartitionByRange(F.col("shard"), F.col(f"`{key}`"))
     .sortWithinPartitions("shard", F.col(f"`{key}`")).write.partitionBy("shard").parquet(path))
