"""Archive members, MAFF pages and export archives.

An archive file is opened by the task that holds it; one row per member comes out.
"""

import io
import json
import zipfile
from datetime import datetime, timezone
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MAF_NS = "http://maf.mozdev.org/metadata/rdf#"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
MEMBER_COLUMNS = "archive string, member string, type string, size long, mtime timestamp, error string"
MAFF_FIELDS = ("title", "originalurl", "archivetime", "indexfilename", "charset")
# ----------------------------------------------------------------------------


def _zip_time(info: zipfile.ZipInfo):
    try:
        return datetime(*info.date_time, tzinfo=timezone.utc).replace(tzinfo=None)
    except ValueError:
        return None


def members(archives: DataFrame, content: bool = False, pattern: str | None = None) -> DataFrame:
    """One row per stored member; a bad archive gives one row with ``error``.

    ``archives``: (archive, content).  ``pattern`` limits the members that are read.
    """
    import re
    schema = MEMBER_COLUMNS + (", content binary" if content else "")
    names = [c.split()[0] for c in schema.split(", ")]
    wanted = re.compile(pattern) if pattern else None

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["archive"], pdf["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as zh:
                        for info in zh.infolist():
                            if wanted and not wanted.search(info.filename):
                                continue
                            folder = info.filename.endswith("/")
                            row = [name, info.filename.rstrip("/"), "dir" if folder else "file", None if folder else info.file_size, _zip_time(info), None]
                            rows.append(row + ([None if folder else zh.read(info)] if content else []))
                except (zipfile.BadZipFile, OSError, TypeError) as exc:
                    rows = [[name, None, None, None, None, str(exc) or "bad archive"] + ([None] if content else [])]
                # one frame per archive keeps memory to one archive
                if rows:
                    out = pd.DataFrame(rows, columns=names)
                    out["size"] = out["size"].astype("Int64")
                    out["mtime"] = pd.to_datetime(out["mtime"])
                    yield out

    return archives.select("archive", "content").mapInPandas(run, schema)


def with_implicit_dirs(rows: DataFrame) -> DataFrame:
    """Members plus ``dir`` rows for folders that exist only as a prefix."""
    from .files import ancestors
    good = rows.filter("member is not null and member <> ''").select("archive", "member", "type", "size", "mtime")
    implied = (good.select("archive", F.explode(ancestors(F.col("member"))).alias("member")).distinct()
               .join(good.select("archive", "member"), ["archive", "member"], "left_anti")
               .select("archive", "member", F.lit("dir").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime")))
    return good.unionByName(implied)


def list_members(rows: DataFrame, folder: str = "", recursive: bool = False) -> DataFrame:
    """Entries in (or below) a folder of every archive that has it, names relative to it."""
    base = folder.rstrip("/") + "/" if folder.rstrip("/") else ""
    inside = with_implicit_dirs(rows).filter(F.col("member").startswith(base)).withColumn("name", F.substr(F.col("member"), F.lit(len(base) + 1)))
    inside = inside.filter("name <> ''")
    if not recursive:
        inside = inside.filter(~F.col("name").contains("/"))
    return inside.select("archive", "name", "type", "size", "mtime")


def missing_folder(rows: DataFrame, folder: str) -> DataFrame:
    """Archives without the folder."""
    name = folder.rstrip("/")
    have = rows.filter((F.col("member").startswith(f"{name}/")) | ((F.col("member") == name) & (F.col("type") == "dir")))
    return rows.select("archive").distinct().join(have.select("archive").distinct(), "archive", "left_anti")


def classify_members(probes: DataFrame, rows: DataFrame) -> DataFrame:
    """What each probed path is: root, invalid (an ancestor is a file), file, dir, implicit, none.

    ``probes``: (archive, probe).  Ancestors and descendants are equi-joins on
    exploded prefixes.
    """
    from .files import ancestors
    p = probes.withColumn("__base", F.regexp_replace("probe", "/+$", ""))
    kinds = rows.select("archive", "member", "type")
    up_files = kinds.filter("type = 'file'").select("archive", F.col("member").alias("__up")).distinct()
    bad = (p.select("archive", "probe", F.explode(ancestors(F.col("__base"))).alias("__up"))
           .join(up_files, ["archive", "__up"], "left_semi").select("archive", "probe").distinct().withColumn("__bad", F.lit(True)))
    exact = kinds.groupBy("archive", F.col("member").alias("__base")).agg(F.max(F.col("type") == "file").alias("__file"))
    prefixes = kinds.select("archive", F.explode(ancestors(F.col("member"))).alias("__base")).distinct().withColumn("__implied", F.lit(True))
    j = (p.join(bad, ["archive", "probe"], "left").join(exact, ["archive", "__base"], "left")
         .join(prefixes, ["archive", "__base"], "left"))
    kind = (F.when(F.col("__base") == "", "root").when(F.col("__bad"), "invalid").when(F.col("__file"), "file")
            .when(F.col("__file").isNotNull(), "dir").when(F.col("__implied"), "implicit").otherwise("none"))
    return j.select("archive", "probe", kind.alias("kind"))


def maff_pages(archives: DataFrame) -> DataFrame:
    """Pages of MAFF archives from each top folder's index.rdf, else its ``index.*`` members."""
    import re
    names, wanted = ["archive", "member", *MAFF_FIELDS], re.compile(r"^[^/]+/index\.[^/]*$")

    def fields(data):
        try:
            node = ElementTree.fromstring(data).find(f"{{{RDF_NS}}}Description")
            got = [node.find(f"{{{MAF_NS}}}{f}") for f in MAFF_FIELDS]
            return [None if g is None else g.get(f"{{{RDF_NS}}}resource") for g in got]
        except (ElementTree.ParseError, AttributeError, TypeError):
            return [None] * len(MAFF_FIELDS)

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["archive"], pdf["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as zh:
                        for info in zh.infolist():
                            if not wanted.search(info.filename):
                                continue
                            if info.filename.endswith("/index.rdf"):
                                rows.append([name, info.filename, *fields(zh.read(info))])
                                continue
                            with zh.open(info) as member:  # read to its end, for its check sum
                                while member.read(1 << 16):
                                    pass
                            rows.append([name, info.filename, *[None] * len(MAFF_FIELDS)])
                except (zipfile.BadZipFile, OSError, TypeError):
                    rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    # indexes are parsed where the archive is read: no second worker beside it, and no contents leave it
    inner = archives.select("archive", "content").mapInPandas(run, ", ".join(f"{n} string" for n in names))
    tagged = inner.withColumn("top", F.regexp_extract("member", r"^([^/]+)/", 1))
    named = (tagged.filter(F.col("member").endswith("/index.rdf") & F.col("indexfilename").isNotNull())
             .select("archive", "top", "title", "originalurl", "archivetime", F.concat("top", F.lit("/"), "indexfilename").alias("indexfilename"), "charset"))
    rest = tagged.filter(~F.col("member").endswith("/index.rdf")).join(named.select("archive", "top"), ["archive", "top"], "left_anti")
    none = F.lit(None).cast("string")
    return named.unionByName(rest.select("archive", "top", none.alias("title"), none.alias("originalurl"), none.alias("archivetime"),
                                         F.col("member").alias("indexfilename"), none.alias("charset")))


def archive_health(archives: DataFrame) -> DataFrame:
    """(archive, error, has_index, n_pages) for the integrity check."""
    rows = members(archives)
    pages = maff_pages(archives).groupBy("archive").agg(F.count(F.lit(1)).alias("n_pages"))
    seen = rows.groupBy("archive").agg(F.max("error").alias("error"), F.coalesce(F.max(F.col("member") == "index.html"), F.lit(False)).alias("has_index"))
    return (archives.select("archive").join(seen, "archive", "left").join(pages, "archive", "left")
            .withColumn("has_index", F.coalesce("has_index", F.lit(False))).withColumn("n_pages", F.coalesce("n_pages", F.lit(0))))


EXPORT_V2 = "version int, id string, timestamp string, timezone int, path array<struct<id: string, title: string>>, index int"


def _bad_field(version: int):
    """Name of the first ill-typed field of an export record, None when all are fine."""
    want = {"id": str, "timestamp": str, "timezone": int if version == 2 else float, "path": list}
    if version == 2:
        want["index"] = int

    @F.pandas_udf("string")
    def check(docs: pd.Series) -> pd.Series:
        def one(text):
            try:
                doc = json.loads(text)
            except (TypeError, ValueError):
                return "unreadable export.json"
            if not isinstance(doc, dict) or doc.get("version") != version:
                return "unsupported version"
            for name, kind in want.items():
                if not isinstance(doc.get(name), kind):
                    return "malformed export.json"
            return None
        return pd.Series([one(t) for t in docs], dtype=object)

    return check


def read_exports(archives: DataFrame, version: int = 2):
    """Export archives -> (records, errors).

    Version 2 has one top folder per record, version 1 is one record at the archive
    root.  ``archives``: (archive, content).  Records are ordered by (archive, top).
    """
    rx = r"^(?:[^/]+/)?(?:export|meta)\.json$"
    rows = members(archives, content=True, pattern=rx)
    broken = rows.filter("error is not null").select("archive", F.lit("").alias("top"), "error")
    top = F.regexp_extract("member", r"^([^/]+)/", 1) if version == 2 else F.lit("")
    inside = rows.filter("error is null and type = 'file'").withColumn("top", top).withColumn("text", F.decode("content", "UTF-8"))
    if version == 2:
        inside = inside.filter("top <> ''")
    else:
        inside = inside.filter(~F.col("member").contains("/"))
    base = F.regexp_extract("member", r"([^/]+)$", 1)
    pair = inside.groupBy("archive", "top").agg(
        F.max(F.when(base == "export.json", F.col("text"))).alias("export"), F.max(F.when(base == "meta.json", F.col("text"))).alias("meta"))
    judged = pair.withColumn("error", F.coalesce(
        _bad_field(version)("export"), F.when(F.from_json("meta", "map<string,string>").isNull(), "unreadable meta.json")))
    bad = judged.filter("error is not null").select("archive", "top", "error").unionByName(broken)
    doc = F.from_json("export", EXPORT_V2.replace("timezone int", "timezone double"))
    good = judged.filter("error is null").withColumn("e", doc).withColumn("m", F.from_json("meta", "map<string,string>"))
    records = good.select(
        "archive", "top", F.lit(version).alias("version"), F.col("e.id").alias("eid"), F.col("e.timestamp").alias("ets"),
        F.col("e.timezone").alias("tz_offset"), F.col("m")["id"].alias("item_id"), F.col("e.path").alias("path"),
        *([F.col("e.index").cast("long").alias("pos")] if version == 2 else []), F.map_filter("m", lambda k, v: k != "id").alias("meta"))
    return records, bad
