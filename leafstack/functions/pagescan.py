"""One pass over a page: text, references, refreshes, title, icon, saver marks.

A small per-row helper for Arrow-batched tasks; Spark does the partitioning.
"""

import re
from html import unescape
from html.parser import HTMLParser

from .css import css_places, css_string, replaced

# --- fixed values -----------------------------------------------------------
TEXT_EXCLUDED = {
    "title", "style", "script", "template", "frame", "iframe", "object", "applet", "audio", "video",
    "canvas", "noframes", "noscript", "noembed", "textarea", "svg", "math",
}
REFRESH_CONTEXT = {"title", "iframe", "noframes", "noscript", "noembed", "textarea", "template", "xmp"}
REFRESH_FORBIDDEN = {"title", "textarea", "template", "xmp"}
TITLE_EXCLUDED = {"xmp", "svg", "template"}
ROOT_ATTR_PREFIX = "data-scrapbook-"
ROOT_ATTRS = ("id", "title", "type", "create", "modify", "source", "icon", "comment", "charset")
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "link",
        "meta", "param", "source", "track", "wbr"}
# (tag, attribute) -> kind of reference
REF_ATTRS = {
    ("a", "href"): "link", ("area", "href"): "link",
    ("frame", "src"): "frame", ("iframe", "src"): "frame", ("object", "data"): "frame",
    ("script", "src"): "script",
    ("img", "src"): "image", ("audio", "src"): "media", ("video", "src"): "media", ("video", "poster"): "image",
    ("source", "src"): "media", ("track", "src"): "media", ("embed", "src"): "media",
    ("applet", "code"): "media", ("applet", "archive"): "media",
    ("body", "background"): "image", ("table", "background"): "image", ("tr", "background"): "image",
    ("th", "background"): "image", ("td", "background"): "image",
}
SRCSET_TAGS = {"img", "source"}
# seconds and target of a refresh; the same in Python and Java
REFRESH = r"(?i)^[\t\n\f\r ]*(\d+)(?:\.[\d.]*)?(?:(?=[\t\n\f\r ;,])[\t\n\f\r ]*[;,]?[\t\n\f\r ]*(?:url[\t\n\f\r ]*=[\t\n\f\r ]*)?(.*))?$"
SRCSET_URL = re.compile(r"\s*([^ ,][^ ]*[^ ,])\s*(?: [^ ,]+)?\s*(?:,|$)")
# ----------------------------------------------------------------------------

_SPACE = re.compile(r"\s+")


def squeeze_text(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def refresh_parts(content: str):
    """Refresh content -> (seconds, target); (None, None) when it is not a refresh."""
    m = re.search(REFRESH, content or "")
    if not m:
        return None, None
    target = m.group(2) or ""
    if target[:1] in ("'", '"'):
        target = target[1:].split(target[0], 1)[0]
    return int(m.group(1)), target.strip("\t\n\f\r ")


class PageScan(HTMLParser):
    """Collects facts while the page is fed; read them as attributes afterwards."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []          # open element names
        self.excluded = 0       # how many open elements hide their text
        self.pieces = []        # visible text, split at element borders
        self.fresh = True       # next data starts a new piece
        self.refs = []          # (tag, attr, url, kind, piece position)
        self.places = []        # of each: where its tag starts, the tag's text, and its range in the attribute's value
        self.base = None        # href of the first base element
        self.bases = 0
        self.sheet = None       # place and text of an open style element
        self.refreshes = []     # (seconds, target, contexts)
        self.srcdocs = []       # (piece position, html)
        self.title = None
        self.title_on = False
        self.title_done = False
        self.icon = None
        self.meta = {}          # name -> content, first of each
        self.root_attrs = None
        self.lead_comment = None
        self.inner_comment = None
        self.root_empty = True

    @classmethod
    def of(cls, html: str) -> "PageScan":
        scan = cls()
        scan.feed(html or "")
        scan.close()
        return scan

    # -- events ---------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID:
            self._leave(tag)
            return
        self.open.append(tag)
        if tag in TEXT_EXCLUDED:
            self.excluded += 1
        if tag == "title" and not self.title_done and not TITLE_EXCLUDED & set(self.open):
            self.title_on, self.title = True, ""
        if tag == "style" and not {"template", "math"} & set(self.open):
            self.sheet = None, ""

    def handle_startendtag(self, tag, attrs):
        # "/>" closes foreign elements only; HTML elements stay open
        self.handle_starttag(tag, attrs)
        if tag not in VOID and {"svg", "math"} & set(self.open):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.fresh = True
        if tag == "style":
            self._end_sheet()
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            self._leave(top)
            if top in TEXT_EXCLUDED:
                self.excluded -= 1
            if top == "title" and self.title_on:
                self.title_on, self.title_done = False, True
            if top == tag:
                return

    def close(self):
        super().close()
        self._end_sheet()

    def _end_sheet(self):
        """The URLs of a style element, by their places in it."""
        if self.sheet is not None and self.sheet[0] is not None:
            place, text = self.sheet
            for kind, url, lo, hi in css_places(text):
                self.refs.append(("style", "", url, kind, len(self.pieces)))
                self.places.append((place, text, (lo, hi)))
        self.sheet = None

    def handle_data(self, data):
        if self.sheet is not None:
            self.sheet = self.sheet[0] or self.getpos(), self.sheet[1] + data
        if self.title_on:
            self.title += data
        if self.open and data.strip():
            self.root_empty = False
        if self.excluded:
            return
        if self.fresh or not self.pieces:
            self.pieces.append(data)
            self.fresh = False
        else:
            self.pieces[-1] += data

    def handle_comment(self, data):
        if self.root_attrs is None:
            self.lead_comment = data
        elif self.inner_comment is None and self.root_empty:
            self.inner_comment = data

    # -- helpers --------------------------------------------------------------
    def _leave(self, tag):
        self.fresh = True

    def _start(self, tag, attrs):
        self.fresh = True
        attr = {}
        for k, v in attrs:
            attr.setdefault(k, v)
        if self.root_attrs is None:
            if tag == "html":
                self.root_attrs = {k[len(ROOT_ATTR_PREFIX):]: v or "" for k, v in attr.items()
                                   if k.startswith(ROOT_ATTR_PREFIX) and k[len(ROOT_ATTR_PREFIX):] in ROOT_ATTRS}
                return
            self.root_attrs = {}
        self.root_empty = False
        context = next((t for t in self.open if t in ("template", "svg", "math")), "html")
        if tag in ("template", "svg", "math") and context == "html":
            context = tag
        if context in ("html", "svg") and attr.get("style"):
            for kind, url, lo, hi in css_places(attr["style"]):
                if kind == "background":
                    self._ref(tag, "style", url, kind, (lo, hi))
        if tag == "base":
            self.bases += 1
            if self.bases == 1:
                self.base = attr.get("href")
        if context == "svg":
            for name in ("href", "xlink:href"):
                self._ref(tag, name, attr.get(name), "svg")
        if tag == "meta":
            self._meta(attr)
        elif tag == "link":
            self._link(attr, context)
        if context == "html":
            self._html_refs(tag, attr)
        elif tag in ("a", "area") and context != "svg":
            self._ref(tag, "href", attr.get("href"), "inert")

    def _ref(self, tag, name, url, kind, within=None):
        if url is not None:
            self.refs.append((tag, name, url, kind, len(self.pieces)))
            self.places.append((self.getpos(), self.get_starttag_text(), within))

    def _html_refs(self, tag, attr):
        if tag == "base" and attr.get("href") is not None:
            self._ref(tag, "href", attr["href"], "base")
        if tag == "iframe" and attr.get("srcdoc") is not None:
            self.srcdocs.append((len(self.pieces), attr["srcdoc"]))
            return
        for name, value in attr.items():
            kind = REF_ATTRS.get((tag, name))
            if kind:
                self._ref(tag, name, value, kind)
            elif name == "srcset" and tag in SRCSET_TAGS and value:
                for m in SRCSET_URL.finditer(value):
                    self._ref(tag, name, m.group(1), "image", m.span(1))
            elif name == "src" and tag == "input" and (attr.get("type") or "").lower() == "image":
                self._ref(tag, name, value, "image")

    def _link(self, attr, context):
        rels = (attr.get("rel") or "").lower().split()
        if "icon" in rels and self.icon is None:
            self.icon = attr.get("href") or ""
        if context != "html":
            return
        if "stylesheet" in rels:
            self._ref("link", "href", attr.get("href"), "style")
        elif "icon" in rels:
            self._ref("link", "href", attr.get("href"), "icon")

    def _meta(self, attr):
        if attr.get("name") and attr.get("content") is not None:
            self.meta.setdefault(attr["name"], attr["content"])
        if (attr.get("http-equiv") or "").lower() == "refresh":
            seconds, target = refresh_parts(attr.get("content") or "")
            contexts = [t for t in self.open if t in REFRESH_CONTEXT]
            self.refreshes.append((seconds, target, contexts))

    # -- results --------------------------------------------------------------
    @property
    def instant_redirect(self) -> bool:
        return any(s == 0 and not ctx for s, _, ctx in self.refreshes)

    def live_refreshes(self):
        """Targets of refreshes outside the contexts where they never work."""
        return [t for _, t, ctx in self.refreshes if t and not REFRESH_FORBIDDEN & set(ctx)]


# name and, if given, value of an attribute within a start tag
_ATTRIBUTE = re.compile(r"""([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def _value_span(tag_text: str, name: str):
    """(start, end, value) of the first attribute of that name, quotes included in the span; None without a value."""
    start = re.match(r"<[^\s/>]*", tag_text).end()
    for m in _ATTRIBUTE.finditer(tag_text, start):
        if m.group(1).lower() == name:
            raw = m.group(2)
            if raw is None:
                return None
            plain = raw[1:-1] if raw[:1] in ("'", '"') and len(raw) > 1 else raw
            return m.start(2), m.end(2), unescape(plain)
    return None


def rewrite_references(html: str, values: dict) -> str:
    """The page with new values for some of its references, by their number in ``PageScan.refs``.

    Values are replaced where they stand, once, and nothing else of the page changes.
    """
    scan = PageScan.of(html)
    lines = [0, *(m.end() for m in re.finditer("\n", html))]
    changes, edits = {}, []
    for number, new in values.items():
        (line, column), tag_text, within = scan.places[number]
        at, name = lines[line - 1] + column, scan.refs[number][1]
        if name == "style":
            new = css_string(new)
        if name:
            changes.setdefault((at, name), (tag_text, []))[1].append((within, new))
        elif html.startswith(tag_text, at):  # a style element
            edits.append((at + within[0], at + within[1], css_string(new)))
    for (at, name), (tag_text, parts) in changes.items():
        span = _value_span(tag_text, name)
        if span is None:
            continue
        start, end, value = span
        value = replaced(value, [(*(within or (0, len(value))), new) for within, new in parts])
        edits.append((at + start, at + end, '"' + value.replace("&", "&amp;").replace('"', "&quot;") + '"'))
    return replaced(html, edits)
