"""Query of sharding."""

from pyspark.sql import functions as F

from ..common import only
from ..registry import query, table
from ..sharding import assign_shards


@query("op4_sharding")
def op4_sharding(spark, sf):
    """All documents in shards 0 to 15 of near equal bytes, contiguous in doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = only(table(spark, sf, "documents"), doc_id=F.col("doc_id"), size=(F.octet_length(text) + 1).cast("long"),
                text_crc32=F.crc32(text.cast("binary")))
    return (assign_shards(docs, 16, "size", ("doc_id", "text_crc32", "size"))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
