"""Search snippets: crop around the first hit, mark the hits."""

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import escape_html

ELLIPSIS = "…"
HEAD_RATIO = 0.25
# noncharacters: stand-ins for the tags while the text is escaped
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def crop_parts(text: Column, width: int):
    """(kept text, ellipsis or empty)."""
    long = F.length(text) > width
    kept = F.when(long, F.substring(text, 1, max(width - len(ELLIPSIS), 0))).otherwise(text)
    return kept, F.when(long, F.lit(ELLIPSIS)).otherwise(F.lit(""))


def from_first_hit(text: Column, patterns, width: int) -> Column:
    """The text from a quarter of ``width`` before the earliest hit on."""
    firsts = [F.when(text.rlike(p), F.length(F.get(F.split(text, p, 2), F.lit(0)))) for p in patterns]
    if not firsts:
        return text
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    start = F.greatest(F.floor(first - F.lit(width * HEAD_RATIO)), F.lit(0)).cast("int")
    return F.when(first.isNotNull(), F.substring(text, start + 1, F.length(text))).otherwise(text)


def crop_at_first_hit(text: Column, patterns, width: int) -> Column:
    """Window of ``width`` that starts a quarter of it before the earliest hit."""
    return F.concat(*crop_parts(from_first_hit(text, patterns, width), width))


def mark_single(text: Column, pattern: str, index: int = 0) -> Column:
    """Hits of one pattern in ``<mark>``, all text HTML-escaped; native."""
    tagged = F.replace(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), F.lit(_OPEN + _CLOSE), F.lit(""))
    out = escape_html(tagged)
    out = F.replace(out, F.lit(_OPEN), F.lit(f'<mark class="kw{index}">'))
    return F.replace(out, F.lit(_CLOSE), F.lit("</mark>"))


def mark_text(text: str, regexes) -> str:
    """Hits of several patterns: by start, ties by pattern order, overlaps dropped."""
    spans = sorted(((m.start(), i, m.end()) for i, rx in enumerate(regexes) for m in rx.finditer(text)),
                   key=lambda s: s[:2])
    out, at = [], 0
    for start, i, end in spans:
        if start < at:
            continue
        out.append(html.escape(text[at:start]))
        if end > start:
            out.append(f'<mark class="kw{i}">{html.escape(text[start:end])}</mark>')
        at = end
    out.append(html.escape(text[at:]))
    return "".join(out)


def mark_many(text: Column, python_patterns) -> Column:
    """Several patterns at once; an Arrow-batched UDF over the few rows that survive the limit."""
    sources = list(python_patterns)

    @F.pandas_udf("string")
    def mark(series: pd.Series) -> pd.Series:
        regexes = [re.compile(p) for p in sources]
        return series.map(lambda t: None if t is None else mark_text(t, regexes))

    return mark(text)


def snippet(text: Column, terms, width: int = -1, from_start: bool = False) -> Column:
    """Cropped and marked text of one field.  ``terms`` are ``search.Term`` values."""
    text, tail = F.coalesce(text, F.lit("")), F.lit("")
    java = [t.java() for t in terms]
    if width >= 0:
        text, tail = crop_parts(text if from_start else from_first_hit(text, java, width), width)
    if not terms:
        body = escape_html(text)
    elif len(terms) == 1:
        body = mark_single(text, java[0])
    else:
        body = mark_many(text, [t.python() for t in terms])
    return F.concat(body, tail)


def hit_count(text: Column, patterns) -> Column:
    """Matches of all patterns in a text."""
    counts = [F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for p in patterns]
    total = F.lit(0)
    for c in counts:
        total = total + c
    return total.cast("long")
