"""Declarative search over items and their extracted text.

A ``SearchSpec`` is turned into one Column predicate; the plan is
reachable ids -> items -> text -> filter -> sort -> limit -> snippets.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.snippets import snippet
from ..scale import all_of, any_of
from ..schema import DATE_OPEN_HIGH, DATE_OPEN_LOW, ID_MAX, ID_MIN, ROOT
from .graph import reachable

TEXT_FIELDS = ("title", "comment", "content", "file", "index", "charset", "source", "icon")
OR_FIELDS = ("id", "type")
DATE_FIELDS = ("create", "modify")
FLAG_FIELDS = ("marked", "locked", "location")
DEFAULT_ALLOWED = TEXT_FIELDS + OR_FIELDS + DATE_FIELDS
SORT_FIELDS = ("id", "file", "content", "title", "comment", "source", "type", "create", "modify")
COLUMN_OF = {"id": "item_id", "file": "path"}


class SpecError(ValueError):
    """The search specification is not valid."""


@dataclass(frozen=True)
class Term:
    """One search term: literal or regex, case-sensitive or not, optionally the whole value."""

    text: str
    regex: bool = False
    match_case: bool = False
    whole: bool = False

    def __post_init__(self):
        if self.regex:
            try:
                re.compile(self.text)
            except re.error as exc:
                raise SpecError(f"invalid regex: {self.text}") from exc
            if re.search(r"\(\?P[<=]", self.text):
                raise SpecError(f"named groups are written differently in Spark: {self.text}")

    def java(self) -> str:
        flags = "(?dm)" if self.match_case else "(?iudm)"
        if self.regex:
            return flags + self.text
        quoted = "\\Q" + self.text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return flags + (f"^{quoted}$" if self.whole else quoted)

    def python(self) -> str:
        flags = "(?m)" if self.match_case else "(?im)"
        if self.regex:
            return flags + self.text
        quoted = re.escape(self.text)
        return flags + (f"^{quoted}$" if self.whole else quoted)


@dataclass
class Rule:
    """Terms a field must have and must not have."""

    include: list = field(default_factory=list)
    exclude: list = field(default_factory=list)


@dataclass
class SearchSpec:
    """``rules`` maps a field name, or ``None`` for the default fields, to a Rule.

    Date rules hold ``(since, until)`` pairs of 17-digit ids; flag rules hold any
    true value.  ``sorts`` lists ``(field, descending)`` in the order given: the
    last one is the most significant.
    """

    rules: dict = field(default_factory=dict)
    default_fields: tuple = ("title", "comment", "content")
    books: tuple = ()
    books_exclude: tuple = ()
    roots: tuple = (ROOT,)
    roots_exclude: tuple = ()
    sorts: tuple = ()
    limit: int | None = None

    def __post_init__(self):
        known = set(TEXT_FIELDS + OR_FIELDS + DATE_FIELDS + FLAG_FIELDS) | {None}
        for name in self.rules:
            if name not in known:
                raise SpecError(f"unknown field: {name}")
        for name in self.default_fields:
            if name not in DEFAULT_ALLOWED:
                raise SpecError(f"invalid default field: {name}")
        for name, _ in self.sorts:
            if name not in SORT_FIELDS:
                raise SpecError(f"invalid sort: {name}")
        if self.limit is not None and self.limit < 0:
            raise SpecError(f"invalid limit: {self.limit}")

    # -- predicates -----------------------------------------------------------
    def item_predicate(self) -> Column:
        """Rules that need no page text: usable before the text is joined."""
        return all_of(self._rule(n, r) for n, r in self.rules.items() if not self._needs_text(n))

    def text_predicate(self, told: dict | None = None) -> Column:
        """``told``: columns that say whether the content alone meets a rule, by the rule's name."""
        return all_of(self._rule(n, r, (told or {}).get(n)) for n, r in self.rules.items() if self._needs_text(n))

    def content_rules(self) -> dict:
        """Rules that read page text."""
        return {n: r for n, r in self.rules.items() if "content" in (self.default_fields if n is None else (n,))}

    def to_column(self) -> Column:
        """All rules as one predicate, cheap metadata tests first."""
        return self.item_predicate() & self.text_predicate()

    def _needs_text(self, name) -> bool:
        fields = self.default_fields if name is None else (name,)
        return bool({"content", "file"} & set(fields))

    def _rule(self, name, rule: Rule, told: Column | None = None) -> Column:
        if name is None:
            return any_of(told if f == "content" and told is not None else text_all(value(f), rule) for f in self.default_fields)
        if name == "content" and told is not None:
            return told
        if name in OR_FIELDS:
            return text_any(value(name), rule)
        if name in DATE_FIELDS:
            return date_any(value(name), rule)
        if name in FLAG_FIELDS:
            return flag(truthy(name), rule)
        return text_all(value(name), rule)

    def markers(self, name: str) -> list:
        """Terms highlighted in a field: default terms where they apply, then its own."""
        terms = list(self.rules[None].include) if None in self.rules and name in self.default_fields else []
        return terms + (list(self.rules[name].include) if name in self.rules else [])


def value(name: str) -> Column:
    return F.coalesce(F.col(f"`{COLUMN_OF.get(name, name)}`"), F.lit(""))


def truthy(name: str) -> Column:
    if name == "location":
        return F.coalesce(F.col(name) != "", F.lit(False))
    return F.coalesce(F.col(name), F.lit(False))


def text_all(text: Column, rule: Rule) -> Column:
    """No exclude hits and every include hits."""
    return all_of([~text.rlike(t.java()) for t in rule.exclude] + [text.rlike(t.java()) for t in rule.include])


def text_any(text: Column, rule: Rule) -> Column:
    """No exclude hits and some include hits (or there is none)."""
    out = all_of(~text.rlike(t.java()) for t in rule.exclude)
    return out & any_of(text.rlike(t.java()) for t in rule.include) if rule.include else out


def date_any(date: Column, rule: Rule) -> Column:
    """Inclusive string ranges; a missing date fails whatever the rule."""
    out = (date != "") & all_of(~date.between(*r) for r in rule.exclude)
    return out & any_of(date.between(*r) for r in rule.include) if rule.include else out


def flag(on: Column, rule: Rule) -> Column:
    return all_of(([~on] if rule.exclude else []) + ([on] if rule.include else []))


# -- date ranges --------------------------------------------------------------

def date_bound(digits: Column, tz: str = "UTC") -> Column:
    """Partial local date (1..17 digits) -> UTC 17-digit id.

    Padded with zeros; month and day 0 count as 1; parts beyond their range carry
    over; results are clamped to the years 1..9999.
    """
    def bind(value, fn):
        # a lambda variable is evaluated once, however often it is used
        return F.get(F.transform(F.array(value), fn), F.lit(0))

    def part(t, start, size):
        return F.substring(t, start, size).try_cast("int")

    def finish(year, utc):
        return (F.when(year > 9999, ID_MAX).when(year < 1, ID_MIN)
                .when(F.year(utc) > 9999, ID_MAX).when(F.year(utc) < 1, ID_MIN)
                .otherwise(F.date_format(utc, "yyyyMMddHHmmssSSS")))

    def build(t):
        month = F.greatest(part(t, 5, 2), F.lit(1))
        year = part(t, 1, 4) + F.when(month > 12, F.floor(month / 12)).otherwise(0).cast("int")
        month = F.when(month > 12, month % 12).otherwise(month)
        first = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
        day = F.greatest(part(t, 7, 2), F.lit(1))
        seconds = (((day - 1).cast("long") * 24 + part(t, 9, 2)) * 60 + part(t, 11, 2)) * 60 + part(t, 13, 2)
        moved = F.timestamp_millis(F.unix_millis(first) + seconds * 1000 + part(t, 15, 3))
        return bind(year, lambda y: bind(F.to_utc_timestamp(moved, tz), lambda utc: finish(y, utc)))

    return bind(F.rpad(digits, 17, "0"), build)


def date_ranges(ranges: DataFrame, since: str = "since", until: str = "until", tz: str = "UTC") -> DataFrame:
    """Normalise a table of partial ranges; a missing side is open, a malformed one drops the row."""
    low, high = F.coalesce(F.col(since), F.lit("")), F.coalesce(F.col(until), F.lit(""))
    ok = low.rlike("^[0-9]{0,17}$") & high.rlike("^[0-9]{0,17}$")
    return (ranges.filter(ok)
            .withColumn("lo", F.when(low == "", DATE_OPEN_LOW).otherwise(date_bound(low, tz)))
            .withColumn("hi", F.when(high == "", DATE_OPEN_HIGH).otherwise(date_bound(high, tz))))


def match_date_ranges(items: DataFrame, ranges: DataFrame, column: str = "create") -> DataFrame:
    """Items x ranges where the date lies in the range, joined on month slots.

    Months are the leaves of a tree with BRANCH children a node.  A range is the union of the few
    largest nodes inside it, at most two runs of under BRANCH on each of LEVELS levels; an item has
    one node on each level.  So the join is an equi-join, with the exact bounds as a residual filter,
    and no item meets a range twice.
    """
    def month_key(date):
        # 13 slots a year: never decreasing in the text order of the dates, whatever their month digits.  What
        # is no digit, or missing, counts as the nearest digit.
        digits = F.regexp_extract(date, "^[0-9]*", 0)
        after = F.substr(F.col(date), F.length(digits) + 1, F.lit(1))
        c = F.when(after > "9", F.rpad(digits, 6, "9")).otherwise(F.rpad(digits, 6, "0"))
        return F.substring(c, 1, 4).cast("int") * 13 + F.least(F.substring(c, 5, 2).cast("int"), F.lit(12))

    ids = items.filter(F.coalesce(F.col(column), F.lit("")) != "")
    spread = (ranges.withColumn("__a", month_key("lo")).withColumn("__b", month_key("hi"))
              .filter(F.col("__a") <= F.col("__b")).withColumn("__node", F.explode(range_nodes(F.col("__a"), F.col("__b")))))
    spread = spread.select(*ranges.columns, F.col("__node.level").alias("__level"), F.col("__node.key").alias("__key"))
    month = month_key(column)
    own = F.array(*[_node(level, F.call_function("div", month, F.lit(BRANCH**level))) for level in range(LEVELS)])
    keyed = ids.withColumn("__node", F.explode(own)).withColumn("__level", F.col("__node.level")).withColumn("__key", F.col("__node.key")).drop("__node")
    joined = keyed.join(spread, ["__level", "__key"])
    return joined.filter(F.col(column).between(F.col("lo"), F.col("hi"))).drop("__level", "__key")


# children of a node and levels of the tree over months; 10,000 years have 130,000 of them
BRANCH, LEVELS = 16, 5


def _node(level: int, key: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), key.cast("long").alias("key"))


def range_nodes(first: Column, last: Column) -> Column:
    """Array of the largest nodes of the tree over months that together make the months ``first`` to ``last``."""
    def whole(level):
        """Nodes of a level that lie within the range: from the first to before the second."""
        width = BRANCH**level
        return F.call_function("div", first + (width - 1), F.lit(width)), F.call_function("div", last + 1, F.lit(width))

    def nodes(level, lo, hi):
        none = F.array().cast("array<struct<level:int,key:bigint>>")
        return F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda k: _node(level, k))).otherwise(none)

    parts = []
    for level in range(LEVELS):
        lo, hi = whole(level)
        if level + 1 == LEVELS:
            parts.append(nodes(level, lo, hi))
            continue
        up_lo, up_hi = whole(level + 1)
        parts.append(F.when(up_lo < up_hi, F.concat(nodes(level, lo, BRANCH * up_lo), nodes(level, BRANCH * up_hi, hi))).otherwise(nodes(level, lo, hi)))
    return F.concat(*parts)


# -- the search itself ----------------------------------------------------------

def select_books(df: DataFrame, spec: SearchSpec, books: DataFrame | None = None) -> DataFrame:
    """Book filter plus ``book_ord``: the order of the include list, else of ``books``."""
    if spec.books:
        df = df.filter(F.col("book_id").isin(*spec.books))
        order = F.array_position(F.array(*[F.lit(b) for b in dict.fromkeys(spec.books)]), F.col("book_id"))
        df = df.withColumn("book_ord", order.cast("long"))
    elif books is not None:
        df = df.join(books.filter("not no_tree").select("book_id", "book_ord"), "book_id")
    else:
        df = df.withColumn("book_ord", F.lit(0).cast("long"))
    if spec.books_exclude:
        df = df.filter(~F.col("book_id").isin(*spec.books_exclude))
    return df


def in_scope(edges: DataFrame, spec: SearchSpec, with_order: bool = True) -> DataFrame:
    """Ids under the included roots minus those under the excluded ones."""
    scope = reachable(edges, spec.roots, with_order=with_order)
    if spec.roots_exclude:
        scope = scope.join(reachable(edges, spec.roots_exclude), ["book_id", "item_id"], "left_anti")
    return scope


def with_text(items: DataFrame, fulltext: DataFrame) -> DataFrame:
    """One row per item and text file; an item without text keeps one row with an empty path."""
    text = fulltext.withColumnRenamed("ord", "text_ord").select(
        "book_id", "item_id", "path", "text_ord", *[c for c in fulltext.columns if c == "content" or c.startswith("__told")])
    return (items.join(text, ["book_id", "item_id"], "left")
            .withColumn("path", F.coalesce("path", F.lit("")))
            .withColumn("text_ord", F.coalesce("text_ord", F.lit(0).cast("long"))))


def sort_columns(spec: SearchSpec) -> list:
    """Stable multi-key order: later sorts first, then the visit order."""
    keys = [F.col("book_ord"), F.col("book_id")]
    for name, descending in reversed(spec.sorts):
        keys.append(value(name).desc() if descending else value(name).asc())
    return keys + [F.col("visit"), F.col("ord"), F.col("item_id"), F.col("text_ord"), F.col("path")]


def search(items: DataFrame, edges: DataFrame, fulltext: DataFrame, spec: SearchSpec,
           books: DataFrame | None = None, context: dict | None = None) -> DataFrame:
    """Hits in order, with ``snip_<field>`` columns for the fields named in ``context``.

    Metadata rules run before the text join.  When there is a limit, only ids,
    paths and sort keys are sorted; page text is fetched again for the survivors.
    """
    pool = select_books(items, spec, books).filter(spec.item_predicate())
    scoped_edges = select_books(edges, spec, books).select("book_id", "parent_id", "pos", "child_id")
    scope = in_scope(scoped_edges, spec).withColumnRenamed("addr", "visit")
    # what a rule wants of the text is settled where the text is read
    rules = spec.content_rules()
    text, told = fulltext.select("book_id", "item_id", "path", "ord", "content"), {}
    for i, (name, rule) in enumerate(rules.items()):
        text = text.withColumn(f"__told{i}", text_all(value("content"), rule))
        told[name] = F.coalesce(F.col(f"__told{i}"), text_all(F.lit(""), rule))
    by_content = any(n == "content" for n, _ in spec.sorts)
    if spec.limit is not None and not by_content:
        text = text.drop("content")
    flags = [f"__told{i}" for i in range(len(rules))]
    hits = with_text(pool.join(scope, ["book_id", "item_id"]), text).filter(spec.text_predicate(told)).drop(*flags)
    order = sort_columns(spec)
    if spec.limit is not None:
        if not by_content:
            top = hits.orderBy(*order).limit(spec.limit)
            text = fulltext.select("book_id", "item_id", "path", "content")
            hits = top.join(text, ["book_id", "item_id", "path"], "left")
        else:
            hits = hits.orderBy(*order).limit(spec.limit)
    for name, width in (context or {}).items():
        col = "content" if name == "fulltext" else name
        hits = hits.withColumn(f"snip_{name}", snippet(value(col), spec.markers(col), width, from_start=col == "source"))
    return hits.orderBy(*order)


# -- worklists and feed -----------------------------------------------------------

def feed_eligible() -> Column:
    """Items with something to show: an index, or for a bookmark a source."""
    kind = value("type")
    has = F.when(kind == "bookmark", value("source") != "").otherwise(value("index") != "")
    return ~kind.isin("folder", "separator") & has


def feed_entries(items: DataFrame, count: int, per_book: bool = False) -> DataFrame:
    """Latest ``count`` entries: by modify (else create), ties to the later item.

    With ``per_book`` the list is kept for every book by a bounded top-k aggregate.
    """
    stamp = F.coalesce(F.col("modify"), F.col("create"), F.lit(""))
    pool = items.filter(feed_eligible()).withColumn("updated_id", stamp)
    if not per_book:
        return pool.orderBy(F.col("updated_id").desc(), F.col("ord").desc()).limit(count)
    # two-level top-k: first inside hash slices of a book, then across its slices
    from pyspark.sql import Window
    order = [F.col("updated_id").desc(), F.col("ord").desc()]
    sliced = pool.withColumn("__slice", F.pmod(F.xxhash64("item_id"), F.lit(64)))
    w1 = Window.partitionBy("book_id", "__slice").orderBy(*order)
    w2 = Window.partitionBy("book_id").orderBy(*order)
    part = sliced.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= count)
    return (part.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= count)
            .drop("__slice", "__r"))


def index_format() -> Column:
    """folder, htz, maff or single_file; null without an index."""
    from ..functions.mime import path_is_htz, path_is_maff
    index = F.col("index")
    return (F.when(F.coalesce(index, F.lit("")) == "", F.lit(None).cast("string"))
            .when(index.endswith("/index.html"), "folder")
            .when(path_is_htz("index"), "htz").when(path_is_maff("index"), "maff")
            .otherwise("single_file"))


def conversion_worklist(items: DataFrame, types, target: str) -> DataFrame:
    """Items of the given types whose stored format differs from ``target``."""
    return (items.withColumn("format", index_format())
            .filter(value("type").isin(*types) & F.col("format").isNotNull() & (F.col("format") != target)))


def under_any(entries: DataFrame, filters: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """Entries that equal a filter or lie under one.

    Each path is expanded to its ancestor prefixes (bounded by its depth), which
    turns the prefix test into an equi semi-join.
    """
    segs = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))
    keys = filters.select(F.rtrim(F.col(prefix)).alias("__p")).distinct()
    keyed = entries.withColumn("__p", F.explode(prefixes))
    hit = keyed.join(keys, "__p", "left_semi").drop("__p")
    return hit.dropDuplicates(entries.columns)


def result_lines(hits: DataFrame, columns) -> DataFrame:
    """One JSON document per hit; lines are grouped by writing with ``partitionBy('book_id')``."""
    return hits.select("book_id", F.to_json(F.struct(*columns)).alias("line"))
