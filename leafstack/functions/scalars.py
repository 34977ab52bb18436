"""Scalar Column builders: ids and dates, file names, sizes, templates, text.

All are native expressions.  The session time zone is expected to be UTC.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ID_MAX, ID_MIN

# --- fixed values -----------------------------------------------------------
ID_FORMAT = "yyyyMMddHHmmssSSS"
LEGACY_ID_FORMAT = "yyyyMMddHHmmss"
UNITS_BINARY = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
UNITS_SI = ("B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
RESERVED_DEVICE_NAME = r"(?i)^(CON|PRN|AUX|NUL|COM\d|LPT\d)((?:\..+)?)$"
JS_MILLIS_MIN, JS_MILLIS_MAX = -62135596800000, 253402300799999
# ----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _int(text: Column) -> Column:
    return text.try_cast("int")


def item_id_of(ts) -> Column:
    """Timestamp -> 17-digit UTC id, truncated to milliseconds, clamped to years 1..9999."""
    ts = _c(ts)
    return (F.when(F.year(ts) > 9999, ID_MAX).when(F.year(ts) < 1, ID_MIN)
            .otherwise(F.date_format(ts, ID_FORMAT)))


def _assemble(t: Column, seconds: Column) -> Column:
    """Timestamp from the first 12 digits and a seconds value; null when any part is out of range."""
    made = F.try_make_timestamp(
        _int(F.substring(t, 1, 4)), _int(F.substring(t, 5, 2)), _int(F.substring(t, 7, 2)),
        _int(F.substring(t, 9, 2)), _int(F.substring(t, 11, 2)), seconds)
    in_range = (F.substring(t, 1, 4) != "0000") & (_int(F.substring(t, 13, 2)) < 60)
    return F.when(in_range, made)


def ts_of_item_id(item_id) -> Column:
    """17-digit id -> timestamp; null when malformed or not a real date."""
    t = _c(item_id)
    seconds = (F.concat(F.substring(t, 13, 2), F.lit("."), F.substring(t, 15, 3))).try_cast("decimal(8,6)")
    return F.when(t.rlike(r"^[0-9]{17}$"), _assemble(t, seconds))


def legacy_id_of(ts, tz: str = "UTC") -> Column:
    """UTC timestamp -> 14-digit id in the local zone ``tz``."""
    return F.date_format(F.from_utc_timestamp(_c(ts), tz), LEGACY_ID_FORMAT)


def ts_of_legacy_id(legacy_id, tz: str = "UTC") -> Column:
    """14..23-digit local id -> UTC timestamp; the trailing digits are a fraction of a second."""
    t = _c(legacy_id)
    micros = F.rpad(F.substring(t, 15, 6), 6, "0")
    seconds = F.concat(F.substring(t, 13, 2), F.lit("."), micros).try_cast("decimal(8,6)")
    return F.when(t.rlike(r"^[0-9]{14,23}$"), F.to_utc_timestamp(_assemble(t, seconds), tz))


def item_id_of_js_millis(text) -> Column:
    """Millisecond epoch text -> 17-digit id; anything else is returned unchanged."""
    t = _c(text)
    millis = F.when(t.rlike(r"^[+-]?[0-9]{1,15}$"), t.try_cast("long"))
    ok = millis.between(JS_MILLIS_MIN, JS_MILLIS_MAX)
    return F.when(ok, F.date_format(F.timestamp_millis(millis), ID_FORMAT)).otherwise(t)


def blank_to_null(x) -> Column:
    x = _c(x)
    return F.when(x != "", x)


def infer_create(item_id, ctime, modify) -> Column:
    """id time, else file creation time, else modify."""
    return F.coalesce(item_id_of(ts_of_item_id(item_id)), item_id_of(ctime), blank_to_null(modify))


def infer_modify(mtime, create) -> Column:
    """file modification time, else create."""
    return F.coalesce(item_id_of(mtime), blank_to_null(create))


def percent_decode(x) -> Column:
    """Percent-decoding that leaves ``+`` and stray ``%`` alone."""
    x = _c(x)
    safe = F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def percent_encode(x) -> Column:
    """Percent-encoding of a path: unreserved characters and ``/`` stay."""
    out = F.url_encode(_c(x))
    for enc, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(enc), F.lit(plain))
    return out


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(url) -> Column:
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_fragment(url) -> Column:
    return F.regexp_extract(_c(url), r"(?s)#(.*)$", 1)


def infer_title(source) -> Column:
    """Decoded base name of the source URL's path; null without a scheme or a name."""
    src = _c(source)
    name = F.regexp_extract(percent_decode(url_path(src)), r"(?s)([^/]*)$", 1)
    return F.when(url_scheme(src) != "", blank_to_null(name))


# Replacements in a file name, in this order.
FILENAME_STEPS = ((r"[\t\n\f\r]+", " "), (r"[\x00-\x1f\x7f-\x9f]+", ""), (r'[:"?*\\/|<>]', "_"), (r"^ +", ""), (r"[. ]+$", ""), (r"^\.", "_."))


def safe_filename(name, force_ascii: bool = False) -> Column:
    fn = _c(name)
    for pattern, by in FILENAME_STEPS:
        fn = F.regexp_replace(fn, pattern, by)
    fn = F.regexp_replace(fn, RESERVED_DEVICE_NAME, "$1_$2")
    if force_ascii:
        # only non-ASCII characters, blanks and quotes change under the wide safe set
        pieces = F.regexp_extract_all(fn, F.lit(r'([^\x00-\x7F ]+|[^\x80-\x{10FFFF}]+| )'), F.lit(1))
        fn = F.array_join(F.transform(pieces, lambda s: F.when(
            s.rlike(r"[^\x00-\x7F]"), percent_encode(s)).otherwise(F.replace(s, F.lit(" "), F.lit("%20")))), "")
    return F.coalesce(blank_to_null(fn), F.lit("_"))


def cropped(text, width: int, ellipsis: str = "...") -> Column:
    """The text cut to ``width`` characters, the ellipsis counted in."""
    text = _c(text)
    keep = max(width - len(ellipsis), 0)
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, keep), F.lit(ellipsis))).otherwise(text)


def template(text: str, values: dict, name_pattern: str = r"\w*") -> Column:
    """``%NAME%`` template: parsed once on the driver, evaluated as a concat.

    ``%%`` is a percent sign and an unknown name is empty.  ``values`` maps names
    to Columns; a callable value is asked with the full name.
    """
    parts, last = [], 0
    for m in re.finditer(f"%({name_pattern})%", text):
        parts.append(F.lit(text[last:m.start()]))
        last = m.end()
        name = m.group(1)
        if name == "":
            parts.append(F.lit("%"))
        elif name in values:
            parts.append(F.coalesce(values[name], F.lit("")))
    parts.append(F.lit(text[last:]))
    return F.concat(*parts)


_DATE_PARTS = {
    "DATE": "yyyy-MM-dd", "YEAR": "yyyy", "MONTH": "MM", "DAY": "dd",
    "HOURS": "HH", "MINUTES": "mm", "SECONDS": "ss",
}


def _date_values(name: str, item_id: Column, tz: str) -> dict:
    utc = ts_of_item_id(item_id)
    local = F.from_utc_timestamp(utc, tz)
    out = {name: item_id, f"{name}:": item_id}
    for part, fmt in _DATE_PARTS.items():
        out[f"{name}:UTC_{part}"] = F.date_format(utc, fmt)
        out[f"{name}:{part}"] = F.date_format(local, fmt)
    out[f"{name}:UTC_TIME"] = F.date_format(utc, "HH-mm-ss")
    # the local time pads its hours to four digits
    out[f"{name}:TIME"] = F.concat(F.lit("00"), F.date_format(local, "HH-mm-ss"))
    return out


def import_filename(pattern: str, item_id, eid, title, source, create, modify, exported, tz: str = "UTC") -> Column:
    """Target file name of an imported item; each ``/`` segment is made safe."""
    values = {
        "ID": _c(item_id), "EID": _c(eid), "UUID": F.uuid(), "TITLE": _c(title), "SOURCE": _c(source),
        **_date_values("CREATE", _c(create), tz), **_date_values("MODIFY", _c(modify), tz),
        **_date_values("EXPORT", _c(exported), tz),
    }
    raw = template(pattern, values, "[^%]*")
    return F.array_join(F.transform(F.split(raw, "/"), lambda s: safe_filename(s)), "/")


def human_size(n, si: bool = False, space: str = " ") -> Column:
    n = _c(n).cast("long")
    base, units = (1000, UNITS_SI) if si else (1024, UNITS_BINARY)
    power = F.least(F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(float(base)))),
                    F.lit(len(units) - 1)).cast("int")
    scaled = n.cast("double") / F.pow(F.lit(float(base)), power)
    one = F.format_string("%s", F.bround(scaled, 1))
    whole = F.bround(scaled, 0).cast("long").cast("string")
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), power + 1)
    number = F.when((power >= 1) & (scaled < 10), one).otherwise(whole)
    return F.coalesce(F.concat(number, F.lit(space), unit), F.lit(""))


def normal_segments(path) -> Column:
    """Path -> segments without ``.`` and with ``..`` folded into its parent."""
    segs = F.filter(F.split(_c(path), "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    return F.aggregate(
        segs, empty,
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(s))))


def normal_path(path) -> Column:
    return F.array_join(normal_segments(path), "/")


def relative_path(path, start) -> Column:
    """Relative path from folder ``start`` to ``path``; ``.`` when they are the same."""
    a, b = normal_segments(path), normal_segments(start)
    shared = F.aggregate(
        F.when(F.least(F.size(a), F.size(b)) > 0, F.sequence(F.lit(1), F.least(F.size(a), F.size(b))))
        .otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.try_element_at(a, i) == F.try_element_at(b, i)), i).otherwise(n))
    ups = F.array_repeat(F.lit(".."), F.size(b) - shared)
    rest = F.slice(a, shared + 1, F.size(a))
    return F.coalesce(blank_to_null(F.array_join(F.concat(ups, rest), "/")), F.lit("."))


def relative_url(path, start, path_is_dir: bool = True, start_is_dir: bool = True) -> Column:
    start = _c(start)
    if not start_is_dir:
        start = F.regexp_replace(start, r"/?[^/]*$", "")
    rel = relative_path(path, start)
    if path_is_dir:
        rel = F.when(rel.endswith("/"), rel).otherwise(F.concat(rel, F.lit("/")))
    return percent_encode(rel)


# common named entities; numeric forms are left to the page parser; ``&amp;`` must come last
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"))


def unescape_entities(x) -> Column:
    out = _c(x)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def escape_html(x) -> Column:
    out = _c(x)
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def postit_text(page) -> Column:
    """Note text of a post-it page; a page without the frame is returned as it is.

    The frame is the first <pre> whose text, up to the next </pre>, ends with a line feed.
    """
    page = _c(page)
    parts = F.split(page, "</pre>")
    framed = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.contains("<pre>") & x.endswith("\n"))
    frame = F.get(framed, F.lit(0))
    start = F.instr(frame, "<pre>") + F.lit(5)
    note = F.regexp_replace(F.substr(frame, start, F.length(frame) - start), r"\A\n", "")
    return unescape_entities(F.when(frame.isNotNull(), note).otherwise(page))


def postit_title(text) -> Column:
    return F.substring_index(_c(text), "\n", 1)


def squeeze(x) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)[\s\x1c-\x1f]+", " "))


def icon_file(icon, index, data_dir: str = "data") -> Column:
    """Path of a relative icon; null for absolute, protocol- or root-relative and pure query URLs."""
    icon = F.coalesce(_c(icon), F.lit(""))
    path = url_path(icon)
    folder = F.regexp_replace(F.coalesce(_c(index), F.lit("")), r"/?[^/]*$", "")
    usable = (icon != "") & (url_scheme(icon) == "") & (url_netloc(icon) == "") & (path != "") & ~path.startswith("/")
    return F.when(usable, normal_path(F.concat_ws("/", F.lit(data_dir), folder, percent_decode(path))))
