"""Query of license scans."""

from pyspark.sql import functions as F

from ..common import only
from ..licenses import scan_licenses
from ..registry import query, table


@query("op5_license_scan")
def op5_license_scan(spark, sf):
    """Licenses found in all documents."""
    return scan_licenses(only(table(spark, sf, "documents"), doc_id=F.col("doc_id"), text=F.col("text")))
