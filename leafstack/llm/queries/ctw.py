"""Query of language-model scores."""

from pyspark.sql import functions as F

from ..common import only
from ..ctw import with_scores
from ..registry import query, table


@query("op11_ctw_scores")
def op11_ctw_scores(spark, sf):
    """All documents under a context-tree model that learns from six in seven of them."""
    docs = only(table(spark, sf, "documents"), doc_id=F.col("doc_id"), text=F.col("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return with_scores(docs.withColumn("held_out", held), ~F.col("held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
