"""URLs in style sheets."""

import re

_STRING = r'"(?:[^"\\]|\\[\s\S])*"' + "|" + r"'(?:[^'\\]|\\[\s\S])*'"
_GAP = r"(?:\s|/\*[\s\S]*?(?:\*/|\Z))*"
_URL = (r"(?<![\w-])url\(\s*(?:(?P<{0}q>" + _STRING + r")|(?P<{0}b>(?:[^\s\"'()\\]|\\[^\r\n\f])*))\s*\)")
_SCAN = re.compile(
    r"(?P<skip>/\*[\s\S]*?(?:\*/|\Z))"
    r"|@import" + _GAP + r"(?:" + _URL.format("i") + r"|(?P<istr>" + _STRING + r"))"
    r"|@namespace" + _GAP + r"(?:[^\s;\"'{}()]+" + _GAP + r")?(?:" + _URL.format("n") + r"|" + _STRING + r")"
    r"|(?P<face>@font-face" + _GAP + r"\{)"
    r"|(?P<close>\})"
    r"|" + _URL.format("u") +
    r"|(?P<text>" + _STRING + r"|\\[\s\S])", re.I)
_HEX = frozenset("0123456789abcdefABCDEF")


def _character(value: int) -> str:
    """The character of a code point; the replacement character where there is none."""
    return chr(value) if 0 < value < 0xD800 or 0xDFFF < value < 0x110000 else "\N{REPLACEMENT CHARACTER}"


def unescape(text: str) -> str:
    """The value of a string or URL token: escapes stand for a code point, a character, or, before a line end, for nothing."""
    out, at = [], 0
    while (back := text.find("\\", at)) >= 0:
        out.append(text[at:back])
        at = back + 1
        digits = at
        while digits < min(len(text), at + 6) and text[digits] in _HEX:
            digits += 1
        if digits > at:
            out.append(_character(int(text[at:digits], 16)))
            at = digits + (text[digits:digits + 1] == " ")
        elif at == len(text):
            out.append("\\")
        elif text[at] in "\r\n\f":
            at += 2 if text[at:at + 2] == "\r\n" else 1
        else:
            out.append(text[at])
            at += 1
    return "".join([*out, text[at:]])


def css_places(text: str):
    """(kind, url, start, end) of every rewritable URL: its kind is ``import``, ``font`` or ``background``, its place that of the value, quotes included."""
    out, in_face = [], False
    for m in _SCAN.finditer(text or ""):
        if m["face"]:
            in_face = True
        elif m["close"]:
            in_face = False
        for name, kind in (("istr", "import"), ("iq", "import"), ("ib", "import"), ("uq", "font" if in_face else "background"), ("ub", "font" if in_face else "background")):
            if m[name] is not None:
                url = m[name] if name.endswith("b") else unescape(m[name][1:-1])
                out.append((kind, url, *m.span(name)))
    return out


def css_urls(text: str):
    """(kind, url) of every rewritable URL, in order."""
    return [(kind, url) for kind, url, _, _ in css_places(text)]


def css_string(value: str) -> str:
    """A string token with this value."""
    return '"' + re.sub(r'["\\]', r"\\\g<0>", value).replace("\n", "\\a ").replace("\r", "\\d ").replace("\f", "\\c ") + '"'


def replaced(text: str, edits) -> str:
    """The text with (start, end, new) put in place."""
    out, done = [], 0
    for start, end, new in sorted(edits):
        out += [text[done:start], new]
        done = end
    return "".join([*out, text[done:]])


def rewrite_css(text: str, values: dict) -> str:
    """The sheet with new values for some of its URLs, by their number; nothing else of it changes."""
    places = css_places(text)
    return replaced(text, [(places[n][2], places[n][3], css_string(new)) for n, new in values.items()])
