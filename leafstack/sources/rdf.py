"""Old RDF catalogues through Spark's XML reader."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
ITEM_URN = r"^urn:scrapbook:item([0-9]{14,23})"
SEQ_URN = r"^urn:scrapbook:(?:item([0-9]{14,23})|(root))"
PROPS = ("type", "title", "chars", "source", "icon", "comment", "create", "modify", "lock", "folder", "exported", "container")
PREFIXES = ("NS1", "NS2")
# ----------------------------------------------------------------------------


def _read(spark: SparkSession, path, tag: str, schema: str) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "@").schema(schema).load(path))


def read_records(spark: SparkSession, path) -> DataFrame:
    """(legacy_id, element, props): description and separator records; later attributes of an id win."""
    attrs = ", ".join(f"`@{ns}:{p}` string" for ns in PREFIXES for p in PROPS)
    schema = f"`@RDF:about` string, {attrs}"
    parts = []
    for tag in ("RDF:Description", "NC:BookmarkSeparator"):
        rows = _read(spark, path, tag, schema)
        pairs = F.map_from_arrays(F.array(*[F.lit(p) for p in PROPS]),
                                  F.array(*[F.coalesce(*[F.col(f"`@{ns}:{p}`") for ns in PREFIXES]) for p in PROPS]))
        parts.append(rows.select(F.regexp_extract("`@RDF:about`", ITEM_URN, 1).alias("legacy_id"), F.lit(tag.split(":")[1]).alias("element"),
                                 F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("props")))
    return parts[0].unionByName(parts[1]).filter("legacy_id <> ''")


def read_sequences(spark: SparkSession, path) -> DataFrame:
    """(parent_id, pos, child_id) from the sequence elements."""
    schema = "`@RDF:about` string, `RDF:li` array<struct<`@RDF:resource`: string>>"
    rows = _read(spark, path, "RDF:Seq", schema)
    parent = F.coalesce(*[F.when(F.regexp_extract("`@RDF:about`", SEQ_URN, i) != "", F.regexp_extract("`@RDF:about`", SEQ_URN, i)) for i in (1, 2)])
    ids = F.filter(F.transform("`RDF:li`", lambda s: F.regexp_extract(s["@RDF:resource"], ITEM_URN, 1)), lambda s: s != "")
    return (rows.select(parent.alias("parent_id"), F.posexplode(ids).alias("pos", "child_id"))
            .filter("parent_id is not null").withColumn("pos", F.col("pos").cast("long")))
