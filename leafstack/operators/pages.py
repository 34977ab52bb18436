"""Jobs over tables of pages: text, references, refreshes, charsets, metadata, payloads.

Native expressions where the pattern allows; full markup goes through one Arrow
batch per task.  Nothing here looks at more than one page at a time.
"""

import json
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import charset as charsets
from ..functions import datauri
from ..functions.css import css_urls, rewrite_css
from ..functions.mime import extension_dimension, guess, is_compressible, is_html, is_svg, with_mime
from ..functions.pagescan import REFRESH, PageScan, rewrite_references, squeeze_text
from ..functions.scalars import (
    blank_to_null, infer_title, item_id_of, normal_path, percent_decode, squeeze, ts_of_item_id, unescape_entities,
)
from ..runtime import stage
from ..schema import SPECIAL_IDS

# --- fixed values -----------------------------------------------------------
SAVED_FROM = r"(?s)^\s*saved from url=\((\d+)\)(\S+)\s*"
SINGLE_FILE = r"(?s)^\s+Page saved with SingleFile\s+url: (\S+)\s+saved date: ([^()]+)"
ORIGINAL_SRC = r"(?s)^\s*OriginalSrc: (\S+)"
JS_DATE = r"^\w{3} (\w{3}) (\d{2}) (\d{4}) (\d{2}:\d{2}:\d{2}) GMT([+-]\d{2}):?(\d{2})"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
ERROR_URN, FILE_ERROR_URN = "urn:scrapbook:convert:error:url:", "urn:scrapbook:converter:error:url:"
CIRCULAR_URN, SKIP_URN = "urn:scrapbook:convert:circular:url:", "urn:scrapbook:convert:skip:url:"
HIDDEN_BLOCKS = ("title", "style", "script", "template", "iframe", "object", "applet", "audio", "video", "canvas",
                 "noframes", "noscript", "noembed", "textarea", "svg", "math")
HTTP_TOKEN = r"[!#$%&'*+.0-9A-Z^_`a-z|~-]+"
HTTP_PARAMETER = r"""[\t ]*;[\t ]*([!#$%&'*+.0-9A-Z^_`a-z|~-]+)=([^\t ;"]*(?:(?:"[^"]*(?:\.[^"]*)*")[^\t ;"]*)*)"""
# ----------------------------------------------------------------------------


# -- text -----------------------------------------------------------------------------

def fast_text(html) -> Column:
    """Visible text by patterns: comments, hidden blocks and tags out, entities decoded, squeezed."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    # one pass for all of them; the end tag is that of the block that began
    c = F.regexp_replace(c, rf"(?is)<({'|'.join(HIDDEN_BLOCKS)})(?:\s[^>]*)?>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    return squeeze(unescape_entities(c))


def relative_target(path: str, url: str):
    """Path inside the item that ``url`` on page ``path`` names; None when it leaves the item or is the page."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    if path is None or parts.scheme or parts.netloc or parts.path.startswith("/"):
        return None
    base = "file:///!/"
    here = urljoin(base, path)
    there = urljoin(here, parts.path)
    if not there.startswith(base) or unquote(there) == unquote(here):
        return None
    return unquote(there[len(base):])


PARTS = T.StructType([
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("frame", T.StringType())]))),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("redirect", T.BooleanType()),
])


def _embedded(payload, mime, path, out):
    if mime in ("text/html", "application/xhtml+xml"):
        scan_parts(charsets.decode_bytes(payload), path, out)
    elif (mime or "").startswith("text/"):
        out["segments"].append((squeeze_text(charsets.decode_bytes(payload, html=False)), None))


def scan_parts(html: str, path, out=None) -> dict:
    """Text segments, frame targets in place, linked paths, and whether the page redirects at once.

    Data-URL and srcdoc content is scanned in place; inside data URLs relative links
    have no meaning, so ``path`` is None there.
    """
    out = out if out is not None else {"segments": [], "links": [], "redirect": False}
    scan = PageScan.of(html)
    for target in scan.live_refreshes():
        if target.startswith("data:"):
            data = datauri.parse(target)
            if data:
                _embedded(data[0], data[1], None, out)
        else:
            hit = relative_target(path, target)
            if hit:
                out["links"].append(hit)
    if scan.instant_redirect:
        out["redirect"] = True
        return out
    inline = [(at, 0, i, html_) for i, (at, html_) in enumerate(scan.srcdocs)]
    inline += [(at, 1, i, (tag, kind, url)) for i, (tag, name, url, kind, at) in enumerate(scan.refs)
               if (kind in ("link", "inert") and tag in ("a", "area")) or (kind == "frame" and tag in ("frame", "iframe"))]
    inline.sort(key=lambda x: (x[0], x[1], x[2]))
    done = 0
    for at, sort, _, what in inline:
        out["segments"] += [(p, None) for p in scan.pieces[done:at]]
        done = max(done, at)
        if sort == 0:
            inner = scan_parts(what, path, {"segments": [], "links": out["links"], "redirect": False})
            out["segments"] += inner["segments"]
            continue
        tag, kind, url = what
        if url.startswith("data:"):
            data = datauri.parse(url)
            if data:
                inner = {"segments": [], "links": out["links"], "redirect": False}
                _embedded(data[0], data[1], None, inner)
                out["segments"] += inner["segments"]
            continue
        hit = relative_target(path, url)
        if hit and kind == "frame":
            out["segments"].append((None, hit))
        elif hit:
            out["links"].append(hit)
    out["segments"] += [(p, None) for p in scan.pieces[done:]]
    return out


def page_parts(content, path, charset=None, mime=None) -> Column:
    """Binary page -> PARTS struct; HTML is scanned, other text decoded, the rest null."""

    @F.pandas_udf(PARTS)
    def run(contents: pd.Series, paths: pd.Series, sets: pd.Series, mimes: pd.Series) -> pd.DataFrame:
        rows = []
        for data, p, cs, m in zip(contents, paths, sets, mimes):
            m = m or guess(p or "")
            if data is None or not m:
                rows.append((None, None, None))
            elif m in ("text/html", "application/xhtml+xml"):
                got = scan_parts(charsets.decode_bytes(bytes(data), cs), p)
                rows.append(([{"text": t, "frame": f} for t, f in got["segments"]], list(dict.fromkeys(got["links"])), got["redirect"]))
            elif m.startswith("text/"):
                text = charsets.decode_bytes(bytes(data), cs, html=False)
                rows.append(([{"text": text, "frame": None}], [], False))
            else:
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["segments", "links", "redirect"])

    none = F.lit(None).cast("string")
    return run(content, path, charset if charset is not None else none, mime if mime is not None else none)


def segments_text(segments: Column) -> Column:
    """Own text of a page: its segments without frame content, squeezed."""
    texts = F.transform(F.filter(segments, lambda s: s["text"].isNotNull()), lambda s: s["text"])
    return squeeze(F.array_join(texts, " "))


def plain_text(content, path, charset=None) -> Column:
    """Text of a text file: mark, item charset, UTF-8; bad bytes replaced; other MIME types null."""

    @F.pandas_udf("string")
    def run(contents: pd.Series, paths: pd.Series, sets: pd.Series) -> pd.Series:
        def one(data, p, cs):
            m = guess(p or "") or ""
            if data is None or not m.startswith("text/") or m == "text/html":
                return None
            return squeeze_text(charsets.decode_bytes(bytes(data), cs, html=False))
        return pd.Series([one(*row) for row in zip(contents, paths, sets)], dtype=object)

    return run(content, path, charset if charset is not None else F.lit(None).cast("string"))


# -- references -------------------------------------------------------------------------

def anchors(pages: DataFrame, key, html: str = "html") -> DataFrame:
    """Anchor targets by pattern, in order."""
    urls = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\b[^>]*?\shref="([^"]*)"'), F.lit(1))
    return pages.select(*key, F.posexplode(urls).alias("ord", "url")).withColumn("url", unescape_entities("url"))


def _rows(pages: DataFrame, key, cols, extra: str, one) -> DataFrame:
    """mapInPandas over (key, cols): ``one(values)`` yields tuples of the extra columns."""
    ins = pages.select(*key, *cols)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ins.schema.fields if f.name in key)
    names = [c.split()[0] for c in extra.split(", ")]

    def run(batches):
        for pdf in batches:
            out = {c: [] for c in [*key, *names]}
            for rec in pdf.itertuples(index=False, name=None):
                head, tail = rec[:len(key)], rec[len(key):]
                for row in one(*tail):
                    for k, v in zip(key, head):
                        out[k].append(v)
                    for k, v in zip(names, row):
                        out[k].append(v)
            if out[names[0]]:  # an empty frame has no array types
                yield pd.DataFrame(out, columns=[*key, *names])

    return ins.mapInPandas(run, f"{fields}, {extra}")


def references(pages: DataFrame, key, html: str = "html") -> DataFrame:
    """All references of a page: (key, ord, tag, attr, url, kind, base).

    Those of style elements (attr '') and ``style`` attributes are of kind import, font or
    background.  ``base`` is the href of the page's first base element, null if it has none.
    """

    def one(text):
        scan = PageScan.of(text)
        for i, (tag, attr, url, kind, _) in enumerate(scan.refs):
            yield i, tag, attr, url, kind, scan.base

    return _rows(pages, list(key), [html], "ord int, tag string, attr string, url string, kind string, base string", one)


def css_references(sheets: DataFrame, key, css: str = "css") -> DataFrame:
    """URLs of style sheets: (key, ord, kind, url)."""

    def one(text):
        for i, (kind, url) in enumerate(css_urls(text)):
            yield i, kind, url

    return _rows(sheets, list(key), [css], "ord int, kind string, url string", one)


def simple_css_urls(css) -> Column:
    """Array of plain ``url(...)`` values by pattern."""
    c = F.col(css) if isinstance(css, str) else css
    return F.regexp_extract_all(c, F.lit(r"""(?i)url\(\s*["']?([^"')\s]+)["']?\s*\)"""), F.lit(1))


def refreshes(pages: DataFrame, key, html: str = "html") -> DataFrame:
    """Refreshes of a page: (key, ord, seconds, target, contexts)."""

    def one(text):
        for i, (seconds, target, contexts) in enumerate(PageScan.of(text).refreshes):
            yield i, seconds, target, list(contexts)

    return _rows(pages, list(key), [html], "ord int, seconds long, target string, contexts array<string>", one)


def refresh_columns(content) -> tuple:
    """(seconds, target) of a refresh content value, native; null seconds when it is none."""
    c = F.col(content) if isinstance(content, str) else content
    target = F.regexp_extract(c, REFRESH, 2)
    quoted = F.when(target.startswith('"'), F.regexp_extract(target, r'^"([^"]*)', 1)).when(
        target.startswith("'"), F.regexp_extract(target, r"^'([^']*)", 1)).otherwise(target)
    trimmed = F.regexp_replace(quoted, r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", "")
    hit = c.rlike(REFRESH)
    return F.when(hit, F.regexp_extract(c, REFRESH, 1).try_cast("long")), F.when(hit, trimmed)


def redirect_edges(refresh_rows: DataFrame, key, path: str = "path") -> DataFrame:
    """(key, src, dst): first refresh outside any context, when it is instant and stays inside."""
    plain = refresh_rows.filter(F.size("contexts") == 0)
    first = plain.groupBy(*key, path).agg(F.min_by(F.struct("seconds", "target"), "ord").alias("__f"))
    go = first.filter((F.col("__f.seconds") == 0) & (F.col("__f.target") != ""))
    target = F.col("__f.target")
    local = go.filter(~target.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|//)"))
    clean = percent_decode(F.regexp_replace(target, r"[?#].*$", ""))
    folder = F.regexp_replace(F.col(path), r"[^/]*$", "")
    dst = F.when(clean == "", F.col(path)).otherwise(normal_path(F.concat(folder, clean)))
    return local.select(*key, F.col(path).alias("src"), dst.alias("dst"))


# -- charset ------------------------------------------------------------------------------

def charset_columns(pages: DataFrame, content: str | None = None, html: str = "html") -> DataFrame:
    """Add ``label`` and ``codec``: mark, then meta charset, then content-type meta, then UTF-8."""
    label = charsets.declared_charset(html)
    bom = charsets.bom_of(content) if content else F.lit(None).cast("string")
    dim = charsets.codec_dimension(pages.sparkSession).select(F.col("label").alias("__l"), F.col("codec").alias("__c"))
    out = pages.withColumn("label", F.lower(label)).withColumn("__l", F.col("label"))
    out = out.join(F.broadcast(dim.withColumn("__known", F.lit(True))), "__l", "left")
    codec = F.coalesce(bom, F.when(F.col("__known"), F.col("__c")).otherwise(F.col("label")), F.lit("UTF-8"))
    return out.withColumn("codec", codec).drop("__l", "__c", "__known")


def charset_census(pages: DataFrame, **kw) -> DataFrame:
    return charset_columns(pages, **kw).groupBy("codec").agg(F.count(F.lit(1)).alias("n"))


# -- page metadata ----------------------------------------------------------------------------

def js_date_id(text: Column) -> Column:
    """``Mon Jan 01 2024 10:00:00 GMT+0800 (zone)`` -> 17-digit id."""
    at = F.position(F.regexp_extract(text, JS_DATE, 1), F.lit(MONTHS))
    num = F.lpad(F.floor((at + 2) / 3).cast("string"), 2, "0")
    iso = F.concat(F.regexp_extract(text, JS_DATE, 3), F.lit("-"), num, F.lit("-"), F.regexp_extract(text, JS_DATE, 2),
                   F.lit(" "), F.regexp_extract(text, JS_DATE, 4), F.regexp_extract(text, JS_DATE, 5), F.lit(":"),
                   F.regexp_extract(text, JS_DATE, 6))
    return item_id_of(iso.try_cast("timestamp"))


META_FIELDS = ("title", "icon", "lead_comment", "inner_comment")


def page_marks(pages: DataFrame, key, html: str = "html") -> DataFrame:
    """Raw marks of a page: title, icon, comments, root attributes, named metas."""

    def one(text):
        s = PageScan.of(text)
        names = {k: v for k, v in s.meta.items() if k.startswith("savepage-")}
        yield s.title, s.icon, s.lead_comment, s.inner_comment, list((s.root_attrs or {}).items()), list(names.items())

    pairs = "array<struct<k: string, v: string>>"
    raw = _rows(pages, list(key), [html],
                f"title string, icon string, lead_comment string, inner_comment string, attrs {pairs.replace(', ', ',')}, "
                f"metas {pairs.replace(', ', ',')}", one)
    return (raw.withColumn("attrs", F.map_from_entries("attrs")).withColumn("metas", F.map_from_entries("metas")))


def page_metadata(marks: DataFrame) -> DataFrame:
    """Item properties from the marks: saver comments and metas, then root attributes on top."""
    def get(m, k):
        return F.col(m)[k]

    lead, inner = F.coalesce("lead_comment", F.lit("")), F.coalesce("inner_comment", F.lit(""))
    saved = F.regexp_extract(lead, SAVED_FROM, 2)
    saved_ok = F.length(saved) == F.regexp_extract(lead, SAVED_FROM, 1).try_cast("int")
    single = inner.rlike(SINGLE_FILE)
    source = F.coalesce(
        get("attrs", "source"),
        blank_to_null(F.regexp_extract(inner, ORIGINAL_SRC, 1)),
        get("metas", "savepage-url"),
        F.when(single, F.regexp_extract(inner, SINGLE_FILE, 1)),
        F.when(F.coalesce(saved_ok, F.lit(False)), saved))
    create = F.coalesce(
        get("attrs", "create"), js_date_id(F.regexp_extract(get("metas", "savepage-date"), "^([^()]+)", 1)),
        F.when(single, js_date_id(F.regexp_extract(inner, SINGLE_FILE, 2))), F.lit(""))
    own_title = F.coalesce(get("attrs", "title"), get("metas", "savepage-title"))
    page_title = F.when(squeeze(F.col("title")) != "", F.col("title"))
    return marks.select(
        *[c for c in marks.columns if c not in (*META_FIELDS, "attrs", "metas")],
        get("attrs", "id").alias("given_id"), F.coalesce(get("attrs", "type"), F.lit("")).alias("type"),
        F.coalesce(own_title, page_title, infer_title(source), F.lit("")).alias("title"),
        create.alias("create"), F.coalesce(get("attrs", "modify"), F.lit("")).alias("modify"),
        source.alias("source"), F.coalesce(get("attrs", "icon"), F.col("icon")).alias("icon"),
        get("attrs", "comment").alias("comment"), get("attrs", "charset").alias("charset"))


def choose_ids(pages: DataFrame, items: DataFrame, now: str, path: str = "path", given: str = "given_id") -> DataFrame:
    """Id of every page to be indexed: the given one, else the file stem when it is a free timestamp id, else a new one.

    ``pages``: book_id, ord, path, given_id.  A given id that is reserved, used, or
    given twice (after the first) is an error.  Columns added: item_id, problem.
    """
    from .edits import assign_ids
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    inner = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    name = F.when((base == "index.html") & (inner != ""), inner).otherwise(base)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    used = items.select("book_id", F.col("item_id").alias("__want"), F.lit(True).alias("__used"))
    want = F.when(F.col(given).isNotNull(), F.col(given)).when(ts_of_item_id(stem).isNotNull(), stem)
    rows = stage(pages.withColumn("__want", want).join(used, ["book_id", "__want"], "left"))
    first = (rows.filter("__want is not null").groupBy("book_id", "__want").agg(F.min("ord").alias("__first")))
    rows = rows.join(first, ["book_id", "__want"], "left")
    late = F.coalesce(F.col("ord") > F.col("__first"), F.lit(False))
    taken = F.coalesce("__used", F.lit(False)) | late
    problem = (F.when(F.col(given).isin(*SPECIAL_IDS), "reserved").when(F.col(given).isNotNull() & taken, "used"))
    rows = stage(rows.withColumn("problem", problem)
                 .withColumn("item_id", F.when(F.col("__want").isNotNull() & ~taken & problem.isNull(), F.col("__want"))))
    keep = [*pages.columns, "item_id", "problem"]
    lacking = rows.filter("item_id is null and problem is null").select("book_id", F.col("ord").alias("seq"), F.lit(now).alias("base_id"))
    ids = items.select("book_id", "item_id").unionByName(rows.filter("item_id is not null").select("book_id", "item_id"))
    fresh = assign_ids(lacking, ids).select("book_id", F.col("seq").alias("ord"), F.col("item_id").alias("__new"))
    return (rows.join(fresh, ["book_id", "ord"], "left")
            .withColumn("item_id", F.coalesce("item_id", "__new")).select(*keep))


# -- content types ---------------------------------------------------------------------------

def content_type_columns(header) -> tuple:
    """(type, parameters map) of a content-type value; keys lower-cased, quotes removed."""
    c = F.col(header) if isinstance(header, str) else header
    kind = F.regexp_extract(c, f"^({HTTP_TOKEN}/{HTTP_TOKEN})", 1)
    rest = F.substring(c, F.length(kind) + 1, F.length(c))
    # only the unbroken run of parameters after the type counts
    run = F.regexp_extract(rest, rf"^((?:{HTTP_PARAMETER})*)", 1)
    keys = F.regexp_extract_all(run, F.lit(HTTP_PARAMETER), F.lit(1))
    vals = F.regexp_extract_all(run, F.lit(HTTP_PARAMETER), F.lit(2))
    pairs = F.zip_with(keys, vals, lambda k, v: F.struct(
        F.lower(k).alias("k"), F.when(v.startswith('"'), F.regexp_replace(v, r'^"|.$', "")).otherwise(v).alias("v")))
    # a repeated key keeps its last value
    size = F.size(pairs)
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(size - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    valid = kind != ""
    return F.when(valid, F.lower(kind)), F.when(valid, F.map_from_entries(last))


def content_type_census(headers: DataFrame, header: str = "header") -> DataFrame:
    kind, params = content_type_columns(header)
    return (headers.select(kind.alias("type"), F.lower(params["charset"]).alias("charset"))
            .groupBy("type", "charset").agg(F.count(F.lit(1)).alias("n")))


# -- payloads ---------------------------------------------------------------------------------

def payload_store(payloads: DataFrame, content: str = "payload", mime: str = "mime", order=("ord",)) -> DataFrame:
    """Content-addressed store: one row per (sha1, extension) with its first bytes and use count."""
    named = payload_names(payloads, content, mime)
    return (named.groupBy("name").agg(F.min_by(content, F.struct(*order)).alias("content"),
                                      F.min_by(mime, F.struct(*order)).alias("mime"), F.count(F.lit(1)).alias("uses")))


def payload_names(payloads: DataFrame, content: str = "payload", mime: str = "mime") -> DataFrame:
    """Add ``name``: sha1 of the bytes plus the MIME type's extension."""
    dim = extension_dimension(payloads.sparkSession).withColumnsRenamed({"mime": "__m", "ext": "__e"})
    return (payloads.withColumn("__m", F.col(mime)).join(F.broadcast(dim), "__m", "left")
            .withColumn("name", F.concat(F.sha1(content), F.coalesce("__e", F.lit("")))).drop("__m", "__e"))


def externalize(pages: DataFrame, key, html: str = "html"):
    """Data-URI payloads moved out of the pages.

    Returns (pages with references rewritten, store, references).  Malformed URIs become
    an error URN.  A page is rewritten from its own references only.
    """
    refs = references(pages, key, html).filter(F.lower(F.substring("url", 1, 5)) == "data:")
    cols = datauri.columns("url")
    parsed = refs.select(*key, "ord", "url", cols["mime"].alias("mime"), cols["payload"].alias("payload"))
    named = stage(payload_names(parsed))
    new = F.when(F.col("payload").isNotNull(), F.col("name")).otherwise(F.concat(F.lit(ERROR_URN), "url"))
    swaps = named.groupBy(*key).agg(_changes(F.col("ord"), new))
    out = pages.join(swaps, list(key), "left").withColumn(html, _rewritten(F.col(html))).drop("__swaps")
    good = named.filter("payload is not null")
    return out, payload_store(good, order=(*key, "ord")), named.drop("payload")


def _changes(number: Column, new: Column) -> Column:
    """Aggregate of the new values of a page's references, by their number, as ``__swaps``."""
    return F.to_json(F.collect_list(F.struct(number.alias("n"), new.alias("v")))).alias("__swaps")


def _rewritten(html: Column, sheet: Column | None = None) -> Column:
    """The page, or style sheet, with the values of ``__swaps`` in their places; only those that have some are parsed."""

    @F.pandas_udf("string")
    def rewrite(pages: pd.Series, swaps: pd.Series, sheets: pd.Series) -> pd.Series:
        return pd.Series([(rewrite_css if css else rewrite_references)(page, {x["n"]: x["v"] for x in json.loads(s)}) if s and page is not None else page
                          for page, s, css in zip(pages, swaps, sheets)], dtype=object)

    return F.when(F.col("__swaps").isNull(), html).otherwise(rewrite(html, F.col("__swaps"), F.lit(False) if sheet is None else sheet))


def resolve_references(refs: DataFrame, path: str = "path") -> DataFrame:
    """Add ``target``: file path a relative reference names; null for other URLs.

    A page's ``base``, if there is such a column, is resolved first, and references start from it; a
    reference without a path names the base itself, if that is another file.
    """
    url, beyond = F.col("url"), r"^([A-Za-z][A-Za-z0-9+.\-]*:|//|/)"

    def place(u):
        return percent_decode(F.regexp_replace(u, r"(?s)[?#].*$", ""))

    base = F.coalesce(F.col("base"), F.lit("")) if "base" in refs.columns else F.lit("")
    start = F.concat(F.regexp_replace(F.col(path), r"[^/]*$", ""), place(base))
    clean = F.when(place(url) != "", F.concat(F.regexp_replace(start, r"[^/]*$", ""), place(url))).when(place(base) != "", start)
    outside = url.rlike(beyond) | base.rlike(beyond) | clean.isNull()
    return refs.withColumn("target", F.when(~outside, normal_path(clean)))


def join_resources(refs: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """References with the bytes and MIME type of their file.

    ``files``: book_id, path and, if wanted, content.  ``status``: found, self, missing, or external.
    """
    r = resolve_references(refs, path)
    f = files.withColumnRenamed("path", "target").withColumn("__hit", F.lit(True))
    out = with_mime(r.join(f, ["book_id", "target"], "left"), "target")
    status = (F.when(F.col("target").isNull(), "external").when(F.col("target") == F.col(path), "self")
              .when(F.col("__hit").isNotNull(), "found").otherwise("missing"))
    return out.withColumn("mime", F.coalesce("mime", F.lit("application/octet-stream"))).withColumn("status", status).drop("__hit")


def data_uri(content: Column, mime: Column) -> Column:
    """Bytes -> data URI: percent-encoded when compressible, else base64."""
    plain = F.concat(F.lit("data:"), mime, F.lit(","), _quote_bytes(content))
    coded = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
    return F.when(is_compressible(mime), plain).otherwise(F.replace(coded, F.lit("\r\n"), F.lit("")))


def _quote_bytes(content: Column) -> Column:
    """Percent-encode bytes, keeping unreserved characters and ``/``."""
    latin = F.decode(content, "ISO-8859-1")
    plain = F.regexp_extract_all(latin, F.lit(r"([A-Za-z0-9_.\-~/]+|[^A-Za-z0-9_.\-~/])"), F.lit(1))
    return F.array_join(F.transform(plain, lambda s: F.when(
        s.rlike(r"^[A-Za-z0-9_.\-~/]"), s).otherwise(F.concat(F.lit("%"), F.hex(F.encode(s, "ISO-8859-1"))))), "")


def embed(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages with their resources inside as data URIs.

    ``pages``: book_id, path, html; ``files``: book_id, path, content.  Framed pages, linked style
    sheets and those that they import are embedded documents themselves, whose URLs are rewritten
    where they stand; so are URLs in style elements and attributes.  The tree of documents of every
    page is expanded by joins, one level per round; an ancestor met again becomes a circular URN.
    Then levels are folded from the deepest up.  As no document is met twice on a path, the rounds
    end with the deepest nesting.  File names travel between the rounds, bytes are joined once a
    level, per file and not per reference.
    """
    key = ["book_id", "root", "addr"]
    docs = files.select("book_id", F.col("path").alias("doc"), F.decode("content", "UTF-8").alias("html"))
    level = stage(pages.select("book_id", F.col("path").alias("root"), F.array().cast("array<int>").alias("addr"),
                               F.col("path").alias("doc"), F.array("path").alias("chain"), F.lit(False).alias("sheet"), "html"))
    levels = []
    named = files.select("book_id", "path")
    while not level.isEmpty():
        asked = level.withColumn("chain_text", F.to_json("chain"))
        of = [*key, "doc", "chain_text"]
        refs = references(asked.filter("not sheet"), of, "html").drop("tag", "attr").unionByName(
            css_references(asked.filter("sheet"), of, "html").withColumn("base", F.lit(None).cast("string")))
        refs = refs.withColumn("chain", F.from_json("chain_text", "array<string>")).drop("chain_text")
        joined = join_resources(refs, named, path="doc")
        styles = F.col("kind").isin("style", "import")
        nested = styles | (F.col("kind") == "frame") & is_html(F.col("mime")) | is_svg(F.col("mime"))
        again = nested & F.array_contains("chain", F.col("target"))
        joined = stage(joined.withColumn("nested", nested & ~again & (F.col("status") == "found"))
                       .withColumn("circular", again & (F.col("status") != "self")))
        levels.append((level, joined))
        kids = joined.filter("nested").select(
            "book_id", "root", F.concat("addr", F.array("ord")).alias("addr"), F.col("target").alias("doc"),
            F.concat("chain", F.array("target")).alias("chain"), styles.alias("sheet"))
        level = stage(kids.join(docs, ["book_id", "doc"]).select("book_id", "root", "addr", "doc", "chain", "sheet", "html"))
    if not levels:
        return level.select("book_id", F.col("root").alias("path"), "html")
    done = None
    for level, refs in reversed(levels):
        at = F.concat("addr", F.array("ord"))
        rows = refs.withColumn("__at", at)
        if done is not None:
            rows = rows.join(done.select("book_id", "root", F.col("addr").alias("__at"), F.col("html").alias("__inner")),
                             ["book_id", "root", "__at"], "left")
        else:
            rows = rows.withColumn("__inner", F.lit(None).cast("string"))
        whole = files.select("book_id", F.col("path").alias("target"), "content")
        rows = rows.join(whole, ["book_id", "target"], "left")
        inner_uri = F.concat(F.lit("data:"), F.col("mime"), F.lit(","), _quote_bytes(F.encode("__inner", "UTF-8")))
        fragment = F.regexp_extract("url", r"(?s)((?:\?[^#]*)?(?:#.*)?)$", 1)
        missing = F.when((F.col("kind") == "frame") & is_html(F.col("mime")) | F.col("kind").isin("style", "import"), F.lit(ERROR_URN)).otherwise(F.lit(FILE_ERROR_URN))
        new = (F.when(F.col("status") == "external", F.col("url"))
               .when(F.col("status") == "self", fragment)
               .when(F.col("circular"), F.concat(F.lit(CIRCULAR_URN), "url"))
               .when(F.col("status") == "missing", F.concat(missing, F.col("url")))
               .when(F.col("__inner").isNotNull(), inner_uri)
               .otherwise(data_uri(F.col("content"), F.col("mime"))))
        swaps = rows.withColumn("__new", new).filter((F.col("kind") != "base") & (F.col("__new") != F.col("url"))).groupBy(*key).agg(_changes(F.col("ord"), F.col("__new")))
        done = stage(level.join(swaps, key, "left").withColumn("html", _rewritten(F.col("html"), F.col("sheet")))
                     .select(*key, "doc", "html"))
    return done.select("book_id", F.col("root").alias("path"), "html")

