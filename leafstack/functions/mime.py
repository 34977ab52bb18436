"""MIME lookup as a broadcast dimension join, and predicates on the result.

The dimension is built from Python's own registry plus the overrides below, so
its size is fixed (about a thousand rows) whatever the data.
"""

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
OVERRIDES = {
    ".htz": "application/html+zip",
    ".maff": "application/x-maff",
    ".wsba": "application/wsba+zip",
    ".md": "text/markdown",
    ".mkd": "text/markdown",
    ".mkdn": "text/markdown",
    ".mdwn": "text/markdown",
    ".mdown": "text/markdown",
    ".markdown": "text/markdown",
    ".rss": "application/rss+xml",
    ".atom": "application/atom+xml",
    ".woff": "font/woff",
    ".woff2": "font/woff2",
    ".webp": "image/webp",
    ".weba": "audio/weba",
    ".webm": "video/webm",
    ".oga": "audio/ogg",
    ".ogv": "video/ogg",
    ".ogx": "application/ogg",
    ".ogg": "application/ogg",
    ".vtt": "text/vtt",
    ".swf": "application/x-shockwave-flash",
    ".jar": "application/java-archive",
    ".class": "application/java-vm",
    ".epub": "application/epub+zip",
    ".7z": "application/x-7z-compressed",
    ".rar": "application/vnd.rar",
    ".js": "text/javascript",
    ".bmp": "image/bmp",
    ".ico": "image/x-icon",
    ".zip": "application/zip",
    ".xhtml": "application/xhtml+xml",
    ".xht": "application/xhtml+xml",
    ".shtml": "text/html",
}
COMMON_EXTENSION = {
    "application/octet-stream": "",
    "text/html": ".html",
    "application/xhtml+xml": ".xhtml",
    "image/svg+xml": ".svg",
    "image/jpeg": ".jpg",
    "audio/mpeg": ".mp3",
    "audio/ogg": ".oga",
    "video/mpeg": ".mpeg",
    "video/mp4": ".mp4",
    "video/ogg": ".ogv",
    "application/ogg": ".ogx",
}
COMPRESSIBLE_TYPES = (
    "application/xml", "application/javascript", "application/ecmascript",
    "application/x-ecmascript", "application/x-javascript", "application/json",
)
HTML_TYPES = ("text/html", "application/xhtml+xml")
ARCHIVE_TYPES = ("application/html+zip", "application/x-maff")
# ----------------------------------------------------------------------------


# the bundled registry only: system files differ between machines
_REGISTRY = mimetypes.MimeTypes(filenames=())


def extension_table() -> dict:
    table = {ext.lower(): t for ext, t in _REGISTRY.types_map[1].items()}
    table.update(OVERRIDES)
    return table


def guess(path: str):
    """Python twin of the join, for use inside page parsers."""
    base = path.rsplit("/", 1)[-1]
    stem = base.lstrip(".")
    ext = "." + stem.rsplit(".", 1)[1].lower() if "." in stem else ""
    if ext in (".gz", ".bz2", ".xz", ".br", ".z"):
        return guess(base[: -len(ext)])
    return _TABLE.get(ext)


def extension_for(mime: str) -> str:
    """Preferred extension of a MIME type, empty when unknown."""
    if mime in COMMON_EXTENSION:
        return COMMON_EXTENSION[mime]
    for ext, t in OVERRIDES.items():
        if t == mime:
            return ext
    return _REGISTRY.guess_extension(mime or "") or ""


_TABLE = extension_table()


def mime_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(_TABLE.items()), "ext string, mime string")


def extension_dimension(spark: SparkSession) -> DataFrame:
    rows = [(m, extension_for(m)) for m in sorted(set(_TABLE.values()) | set(COMMON_EXTENSION))]
    return spark.createDataFrame(rows, "mime string, ext string")


def extension_of(path) -> Column:
    """Lower-case extension of the last path segment; leading dots are part of the name."""
    path = F.col(path) if isinstance(path, str) else path
    bare = F.regexp_replace(path, r"(?i)\.(gz|bz2|xz|br|z)$", "")
    return F.lower(F.regexp_extract(bare, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1))


def with_mime(df: DataFrame, path: str, out: str = "mime") -> DataFrame:
    """Attach the MIME type of ``path``; unknown types are null."""
    dim = mime_dimension(df.sparkSession).withColumnsRenamed({"ext": "__ext", "mime": out})
    return (df.withColumn("__ext", extension_of(path))
            .join(F.broadcast(dim), "__ext", "left").drop("__ext"))


def is_html(mime) -> Column:
    return F.coalesce(_m(mime).isin(*HTML_TYPES), F.lit(False))


def is_xhtml(mime) -> Column:
    return F.coalesce(_m(mime) == "application/xhtml+xml", F.lit(False))


def is_svg(mime) -> Column:
    return F.coalesce(_m(mime) == "image/svg+xml", F.lit(False))


def is_archive(mime) -> Column:
    return F.coalesce(_m(mime).isin(*ARCHIVE_TYPES), F.lit(False))


def is_markdown(mime) -> Column:
    return F.coalesce(_m(mime) == "text/markdown", F.lit(False))


def is_export_archive(mime) -> Column:
    return F.coalesce(_m(mime) == OVERRIDES[".wsba"], F.lit(False))


def is_compressible(mime) -> Column:
    m = _m(mime)
    hit = m.startswith("text/") | m.isin(*COMPRESSIBLE_TYPES) | m.endswith("+xml") | m.endswith("+json")
    return F.coalesce(hit, F.lit(False))


def _m(mime) -> Column:
    return F.col(mime) if isinstance(mime, str) else mime


# extension-only shortcuts for the container formats (no join needed)
def path_is_htz(path) -> Column:
    return extension_of(path) == ".htz"


def path_is_maff(path) -> Column:
    return extension_of(path) == ".maff"


def path_is_archive(path) -> Column:
    return extension_of(path).isin(".htz", ".maff")


def path_is_html(path) -> Column:
    return extension_of(path).isin(".html", ".htm", ".xhtml", ".xht", ".shtml")
