"""SQL functions: ``register(spark)`` makes them usable from ``spark.sql``."""

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import css
from .pagescan import PageScan, squeeze_text
from .scalars import FILENAME_STEPS
from .snippets import mark_text



@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """Visible text of a page."""
    return pages.map(lambda t: None if t is None else squeeze_text(" ".join(PageScan.of(t).pieces)))


@F.pandas_udf(T.StringType())
def highlight(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Text with the hits of an array of regular expressions marked."""
    def one(t, ps):
        return None if t is None else mark_text(t, [re.compile(p, re.I | re.M) for p in ps])
    return pd.Series([one(t, ps) for t, ps in zip(texts, patterns)], dtype=object)


@F.udtf(returnType="ord int, tag string, attr string, url string, kind string")
class PageRefs:
    """References of a page."""

    def eval(self, page: str):
        for i, (tag, attr, url, kind, _) in enumerate(PageScan.of(page or "").refs):
            yield i, tag, attr, url, kind


@F.udtf(returnType="ord int, kind string, url string")
class CssUrls:
    """URLs of a style sheet."""

    def eval(self, sheet: str):
        for i, (kind, url) in enumerate(css.css_urls(sheet)):
            yield i, kind, url


@F.udtf(returnType="member string, size bigint")
class ZipMembers:
    """Members of an archive; none for a broken one."""

    def eval(self, data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(data))) as zh:
                for info in zh.infolist():
                    yield info.filename, info.file_size
        except (zipfile.BadZipFile, TypeError):
            return


@F.pandas_udf(T.StringType())
def page_unescape(texts: pd.Series) -> pd.Series:
    """All named and numeric character references decoded."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def register(spark: SparkSession) -> None:
    """Publish the functions; the id and name ones are SQL functions, so they stay in codegen."""
    for name, fn in (("page_text", page_text), ("highlight", highlight), ("page_unescape", page_unescape)):
        spark.udf.register(name, fn)
    for name, cls in (("page_refs", PageRefs), ("css_urls", CssUrls), ("zip_members", ZipMembers)):
        spark.udtf.register(name, cls)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ts_item_id(ts TIMESTAMP) RETURNS STRING RETURN date_format(ts, 'yyyyMMddHHmmssSSS')")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION item_ts(id STRING) RETURNS TIMESTAMP RETURN
      CASE WHEN id rlike '^[0-9]{17}$' AND substr(id, 1, 4) <> '0000' AND substr(id, 13, 2) < '60' THEN try_make_timestamp(
        int(substr(id, 1, 4)), int(substr(id, 5, 2)), int(substr(id, 7, 2)), int(substr(id, 9, 2)), int(substr(id, 11, 2)),
        cast(concat(substr(id, 13, 2), '.', substr(id, 15, 3)) as decimal(8, 6))) END""")
    expr = "name"
    for rx, to in FILENAME_STEPS:
        expr = f"regexp_replace({expr}, r'{rx}', '{to}')"
    expr = f"regexp_replace({expr}, r'(?i)^(CON|PRN|AUX|NUL|COM\\d|LPT\\d)((?:\\..+)?)$', '$1_$2')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION safe_filename(name STRING) RETURNS STRING RETURN coalesce(nullif({expr}, ''), '_')")
