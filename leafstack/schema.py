"""Canonical table layouts and the ids with a fixed meaning."""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
ROOT, HIDDEN, RECYCLE = "root", "hidden", "recycle"
SPECIAL_IDS = (ROOT, HIDDEN, RECYCLE)
INDEX_OPTIONAL_TYPES = ("folder", "separator", "bookmark")
INDEX_EXTENSIONS = (".html", ".htz", ".maff", ".htm", ".xhtml", ".xht", ".svg")
SUPPORT_SUFFIXES = (".files", "_files")
ID_MIN, ID_MAX = "00010101000000000", "99991231235959999"
DATE_OPEN_LOW, DATE_OPEN_HIGH = "0" * 17, "9" * 17
MTIME_TOLERANCE_SECONDS = 600
FEED_SIZE = 50
META_SHARD, TOC_SHARD, TEXT_SHARD = 256 * 1024, 4 * 1024 * 1024, 128 * 1024 * 1024
# ----------------------------------------------------------------------------

TEXT_PROPS = (
    "index", "title", "type", "create", "modify", "source", "icon", "comment",
    "charset", "location", "parent", "recycled",
)
FLAG_PROPS = ("marked", "locked")

ITEMS = T.StructType(
    [T.StructField("book_id", T.StringType()), T.StructField("item_id", T.StringType()),
     T.StructField("ord", T.LongType())]
    + [T.StructField(p, T.StringType()) for p in TEXT_PROPS]
    + [T.StructField(p, T.BooleanType()) for p in FLAG_PROPS]
    + [T.StructField("meta_empty", T.BooleanType()),
       T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)

EDGES = T.StructType([
    T.StructField("book_id", T.StringType()), T.StructField("parent_id", T.StringType()),
    T.StructField("pos", T.LongType()), T.StructField("child_id", T.StringType()),
])

FULLTEXT = T.StructType([
    T.StructField("book_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("ord", T.LongType()),
    T.StructField("content", T.StringType()), T.StructField("src_mtime", T.TimestampType()),
])

FINDINGS = T.StructType([
    T.StructField("book_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("code", T.StringType()), T.StructField("detail", T.StringType()),
])
