"""Query of SimHash near-duplicates."""

from pyspark.sql import functions as F

from ..common import only
from ..registry import query, table
from ..simhash import near_duplicates


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark, sf):
    """Every document's fingerprint of 3-word shingles and the class that links of at most 3 bits give."""
    docs = only(table(spark, sf, "documents"), doc_id=F.col("doc_id"), text=F.col("text"))
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
