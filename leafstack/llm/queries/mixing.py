"""Query of mixing."""

from pyspark.sql import functions as F

from ..common import only
from ..mixing import mix
from ..registry import query, table


@query("op2_mixing")
def op2_mixing(spark, sf):
    """Words taken from each document when sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    docs = only(table(spark, sf, "documents"), doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
