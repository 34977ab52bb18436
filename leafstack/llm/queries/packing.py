"""Query of packing."""

from pyspark.sql import functions as F

from ..packing import pack
from ..registry import query, table


@query("op1_packing")
def op1_packing(spark, sf):
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
