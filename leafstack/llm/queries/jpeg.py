"""Query of JPEG media columns."""

from pyspark.sql import functions as F

from ..common import only
from ..jpeg import with_features, with_media
from ..registry import query, table


@query("op8_jpeg_media")
def op8_jpeg_media(spark, sf):
    """Every text stored as a baseline JPEG, read back, with its dimensions and thumbnail hash."""
    docs = only(table(spark, sf, "documents"), doc_id=F.col("doc_id"), text=F.col("text"), n_bytes=F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    read = with_features(with_media(docs).drop("text"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature"))
