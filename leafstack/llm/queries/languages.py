"""Query of language identification."""

from pyspark.sql import functions as F

from ..common import only
from ..languages import declared_of, fit, host_of, identify
from ..registry import query, table


@query("op3_language_id")
def op3_language_id(spark, sf):
    """Language of every document and every page, by a model fitted on labelled documents.

    A document's source stands for its host and its label for the declared language; a page has
    both, and an address suffix, of its own.  `kept` is false where no language can be told.
    """
    documents = table(spark, sf, "documents")
    model = fit(documents)
    docs = only(documents, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"), lang=F.col("lang"))
    docs = identify(docs, model, "text", host=F.col("source"), declared=F.col("lang")).withColumn("page_id", F.lit(None).cast("long"))
    pages = only(table(spark, sf, "pages"), page_id=F.col("page_id"), url=F.col("url"), html=F.col("html"))
    pages = identify(pages, model, "html", markup=True, host=host_of(F.col("url")), declared=declared_of(F.col("html"))).withColumn("doc_id", F.lit(None).cast("long"))
    columns = ["doc_id", "page_id", "language", "confidence", "text_language", "declared", "host", (F.col("language") != "und").alias("kept")]
    return docs.select(*columns).unionByName(pages.select(*columns))
