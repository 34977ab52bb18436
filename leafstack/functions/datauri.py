"""Data URI parsing, native and for page parsers."""

import base64
import binascii
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(uri: str):
    """(bytes, mime, parameters); None when malformed.  Of a repeated parameter the last one holds."""
    scheme, _, rest = uri.partition(":")
    media, comma, data = rest.partition(",")
    if scheme.lower() != "data" or not comma:
        return None
    mime, *fields = media.split(";")
    coded = bool(fields) and fields[-1].lower() == "base64"
    data = data.partition("#")[0]
    try:
        payload = base64.b64decode(data) if coded else unquote_to_bytes(data)
    except binascii.Error:
        return None
    named = [f.partition("=") for f in (fields[:-1] if coded else fields)]
    return payload, mime, {name.lower(): value for name, equals, value in named if equals}


def _percent_bytes(data: Column) -> Column:
    """Percent-decoding to bytes: escapes become the byte, the rest its UTF-8 form."""
    pieces = F.regexp_extract_all(data, F.lit(r"(%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))
    hexes = F.transform(pieces, lambda p: F.when(
        p.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.unhex(F.array_join(hexes, ""))


def _base64_bytes(data: Column) -> Column:
    """Lenient base64: foreign characters are dropped, missing padding is an error."""
    clean = F.regexp_replace(data, r"[^A-Za-z0-9+/=]", "")
    core = F.regexp_extract(clean, r"^([^=]*)", 1)
    pads = F.length(clean) - F.length(core)
    over = F.length(core) % 4
    need = F.when(over == 2, 2).when(over == 3, 1).otherwise(0)
    whole = F.concat(core, F.repeat(F.lit("="), need))
    return F.when((over != 1) & (pads >= need), F.try_to_binary(whole, F.lit("base64")))


def columns(uri) -> dict:
    """``mime``, ``params`` (map), ``is_base64``, ``payload`` (null when malformed) and ``ok``."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    # scheme and media type end at the first comma, the data at the first number sign after it
    head = F.substring_index(uri, ",", 1)
    form = uri.contains(",") & (F.lower(F.substring(head, 1, 5)) == "data:")
    data = F.substring_index(F.substr(uri, F.length(head) + 2), "#", 1)
    fields = F.split(F.substr(head, F.lit(6)), ";")
    b64 = (F.size(fields) > 1) & (F.lower(F.element_at(fields, -1)) == "base64")
    named = F.slice(fields, F.lit(2), F.size(fields) - F.when(b64, 2).otherwise(1))
    pairs = F.transform(F.filter(named, lambda p: p.contains("=")), lambda p: F.struct(
        F.lower(F.substring_index(p, "=", 1)).alias("k"), F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2).alias("v")))
    # the last of a repeated parameter holds
    params = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))
    payload = F.when(form, F.when(b64, _base64_bytes(data)).otherwise(_percent_bytes(data)))
    return {
        "mime": F.when(form, F.get(fields, F.lit(0))),
        "params": F.when(form, params),
        "is_base64": form & b64,
        "payload": payload,
        "ok": payload.isNotNull(),
    }
