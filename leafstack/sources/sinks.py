"""Tables written out: feed entries, grouped search results, manifests."""

from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent_encode, ts_of_item_id
from ..operators.search import feed_entries, value
from ..schema import FEED_SIZE

FEED_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def feed_rows(items: DataFrame, site: str, urn: str, count: int = FEED_SIZE, data_dir: str = "data/", per_book: bool = False) -> DataFrame:
    """Feed entries, newest first.  ``site`` must be absolute; ``urn`` prefixes the entry ids."""
    root = site.rstrip("/") + "/"
    parts = urlsplit(root)
    if not (parts.scheme and parts.netloc):
        raise ValueError(f"invalid site URL: {site}")
    prefix = f"{urn}:{parts.netloc}{parts.path}".rstrip("/")
    data_url = urljoin(root, data_dir)
    top = feed_entries(items, count, per_book)
    zero = F.lit(0).cast("timestamp")

    def when(col):
        return F.date_format(F.coalesce(ts_of_item_id(col), zero), FEED_TIME)

    link = F.when(value("type") == "bookmark", value("source")).otherwise(F.concat(F.lit(data_url), percent_encode(value("index"))))
    return top.select(
        "book_id", "item_id", "ord", F.concat(F.lit(f"{prefix}:"), percent_encode("item_id")).alias("entry_id"), link.alias("link"),
        value("title").alias("title"), when(value("create")).alias("published"), when(F.col("updated_id")).alias("updated"))


def write_feed(rows: DataFrame, out: str) -> None:
    """Feed entries as XML rows."""
    rows.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").mode("overwrite").save(out)


def write_results(hits: DataFrame, columns, out: str) -> None:
    """Search results as JSON lines, one folder per book."""
    hits.select("book_id", *columns).write.partitionBy("book_id").mode("overwrite").json(out)


def write_manifest(manifest: DataFrame, out: str, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """Export manifest as Parquet or JSON, one folder per book."""
    (manifest.write.partitionBy("book_id").option("maxRecordsPerFile", rows_per_file).mode("overwrite").format(fmt).save(out))
