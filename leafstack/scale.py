"""Skew-safe building blocks: ranks, running sums, first-of-group.

A plain window puts a whole group on one task.  A book, a folder or a source
may hold a third of all rows, so ranks and running sums here are two-level: rows
are cut into bounded pieces, ranked inside a piece, and shifted by the totals of
the earlier pieces (a table with one row per piece).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stage

CHUNK = 1 << 16


def _cols(names):
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _slice(number: str, width: int) -> Column:
    return F.call_function("div", F.col(number).cast("long"), F.lit(width).cast("long"))


def first_per(df: DataFrame, keys, order, keep=None) -> DataFrame:
    """One row per key: the one smallest by ``order``.

    A partially aggregated ``min_by`` instead of ``row_number() = 1``: the map
    side already reduces a hot key to one row per task.
    """
    keep = keep or [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*keep), F.struct(*_cols(order))).alias("__r")
    return df.groupBy(*keys).agg(packed).select(*keys, "__r.*")


def rank_by_number(df: DataFrame, keys, number, out, ties=(), chunk: int = CHUNK) -> DataFrame:
    """0-based dense rank within ``keys`` ordered by the integer column ``number``.

    Lazy.  ``number`` is cut into fixed-width chunks; only one row per chunk
    takes part in the running total, so a hub parent spreads over many tasks.
    """
    piece = df.withColumn("__chunk", _slice(number, chunk))
    w_piece = Window.partitionBy(*keys, "__chunk").orderBy(F.col(number), *_cols(ties))
    w_prev = (Window.partitionBy(*keys).orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (piece.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__off", F.coalesce(F.sum("__n").over(w_prev), F.lit(0)))
               .drop("__n"))
    return (piece.withColumn("__rn", F.row_number().over(w_piece))
            .join(offsets, [*keys, "__chunk"])
            .withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("long"))
            .drop("__chunk", "__rn", "__off"))


def rank_rows(df: DataFrame, keys, order, out) -> DataFrame:
    """0-based row number within ``keys`` by any sort expressions.

    Rows are range-partitioned on keys and order together, so a hot key is cut at
    its order column.  The sorted rows are staged once: both the piece totals and
    the final join must read the same partitioning.
    """
    sort = [*_cols(keys), *_cols(order)]
    laid = stage(df.repartitionByRange(*sort).sortWithinPartitions(*sort)
                 .withColumn("__at", F.monotonically_increasing_id())
                 .withColumn("__piece", F.shiftright("__at", 33)))
    runs = laid.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    if not keys:
        # one row per range partition
        runs = F.broadcast(runs)
    on = reduce(lambda a, b: a & b,
                [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__piece"]])
    joined = laid.alias("l").join(runs.alias("r"), on)
    rank = (F.col("l.__at") - F.col("r.__first") + F.col("r.__off")).cast("long").alias(out)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], rank)


def group_ordinals(df: DataFrame, keys, order, out, total=None) -> DataFrame:
    """``rank_rows`` plus, optionally, the group's row count in ``total``."""
    ranked = rank_rows(df, keys, order, out)
    if total is None:
        return ranked
    counts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    return ranked.join(counts, list(keys))


def running_max(df: DataFrame, keys, order_number, value, out, chunk: int = CHUNK) -> DataFrame:
    """Running maximum of ``value`` within ``keys`` by the integer ``order_number``, two-level."""
    piece = df.withColumn("__chunk", _slice(order_number, chunk))
    w_in = (Window.partitionBy(*keys, "__chunk").orderBy(order_number)
            .rowsBetween(Window.unboundedPreceding, 0))
    w_prev = (Window.partitionBy(*keys).orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    tops = (piece.groupBy(*keys, "__chunk").agg(F.max(value).alias("__m"))
            .withColumn("__prev", F.max("__m").over(w_prev)).drop("__m"))
    return (piece.withColumn("__in", F.max(value).over(w_in))
            .join(tops, [*keys, "__chunk"])
            .withColumn(out, F.greatest("__in", "__prev"))
            .drop("__chunk", "__in", "__prev"))


def running_sum(df: DataFrame, keys, order_number, value, out, chunk: int = CHUNK) -> DataFrame:
    """Running sum of ``value`` (this row included) within ``keys`` by the unique integer ``order_number``."""
    piece = df.withColumn("__chunk", _slice(order_number, chunk))
    w_in = (Window.partitionBy(*keys, "__chunk").orderBy(order_number)
            .rowsBetween(Window.unboundedPreceding, 0))
    w_prev = (Window.partitionBy(*keys).orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = (piece.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__s"))
              .withColumn("__prev", F.coalesce(F.sum("__s").over(w_prev), F.lit(0))).drop("__s"))
    return (piece.withColumn("__in", F.sum(value).over(w_in))
            .join(before, [*keys, "__chunk"])
            .withColumn(out, F.col("__in") + F.col("__prev"))
            .drop("__chunk", "__in", "__prev"))


def chunked_list(df: DataFrame, keys, pos, value, size: int = 1024) -> DataFrame:
    """Ordered lists cut into chunks of ``size`` positions: ``(keys, chunk, values)``.

    The concatenation of a key's chunks is its whole list; no row ever holds an
    unbounded group.  ``pos`` must be a dense 0-based position.
    """
    return (df.withColumn("chunk", _slice(pos, size))
            .groupBy(*keys, "chunk")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("__l"))
            .select(*keys, "chunk", F.transform("__l", lambda s: s["v"]).alias("values")))


def count_upto(rows: DataFrame, value: str, marks: DataFrame, mark: str, out: str, inclusive: bool, ties=(), keys=("book_id",)) -> DataFrame:
    """Number of ``marks`` below (or up to) each row's ``value``, per key; a merge by rank, no range join.

    ``ties`` are columns of ``rows`` that tell rows of one value apart, so that those spread over partitions.
    """
    ours = rows.withColumn("__v", F.col(value)).withColumn("__side", F.lit(1 if inclusive else 0))
    theirs = marks.select(*keys, F.col(mark).alias("__v"), F.lit(0 if inclusive else 1).alias("__side"))
    merged = ours.withColumn("__m", F.lit(0)).unionByName(theirs.withColumn("__m", F.lit(1)), allowMissingColumns=True)
    ranked = rank_rows(merged, list(keys), ["__v", "__side", *ties], "__n")
    counted = running_sum(ranked, list(keys), "__n", "__m", out)
    return counted.filter("__m = 0").select(*rows.columns, out)


# Rows that compete for the same slots are halved until so many are left, which one task settles.
LEAF_ROWS = 1 << 14


def leftmost_slots(rows: DataFrame, keys, base: str, ties, out: str, stretch: str = "__top") -> DataFrame:
    """The slots that the rows of each key use together: whatever their order, the n-th by base takes n + max(base - n) so far, its ``stretch``."""
    lined = rank_rows(rows, keys, [base, *ties], "__n").withColumn("__d", F.col(base) - F.col("__n"))
    return running_max(lined, keys, "__n", "__d", stretch).withColumn(out, F.col("__n") + F.col(stretch)).drop("__d", "__n")


def claim_slots(rows: DataFrame, taken: DataFrame, base: str, order, out: str = "slot") -> DataFrame:
    """First come, first served: every row takes the first free integer at or after its ``base``.

    ``rows``: book_id, ``base`` (bigint), order columns (unique together); ``taken``: (book_id,
    slot).  Rows choose in ``order``.

    Counted in free slots only, the set of slots used is a running maximum, and it falls apart into
    busy stretches that do not touch each other.  Where all rows of a stretch have one base, the k-th
    row takes its k-th slot.  Other stretches are halved by order: the earlier half does not depend
    on the later one, and which slots it takes together is a running maximum again; counted in the
    slots that it leaves, the later half is a problem of its own.  So the rounds grow with the
    logarithm of a stretch's rows.
    """
    marks = taken.select("book_id", F.col("slot").cast("long").alias("__t")).distinct()
    crowded = not marks.isEmpty()
    cur = rows.withColumn("__base", F.col(base).cast("long"))
    if crowded:
        cur = count_upto(cur, "__base", marks, "__t", "__below", inclusive=False, ties=order)
        cur = cur.withColumn("__base", F.col("__base") - F.col("__below")).drop("__below")
    lined = stage(leftmost_slots(cur, ["book_id"], "__base", order, "__at", "__stretch"))
    sizes = (lined.groupBy("book_id", "__stretch")
             .agg(F.count(F.lit(1)).alias("__size"), (F.min("__base") != F.max("__base")).alias("__mixed")).filter("__mixed"))
    mixed = stage(lined.join(sizes, ["book_id", "__stretch"], "left"))
    done = mixed.filter("__mixed is null").select(*rows.columns, F.col("__at").alias("__slot"))
    most = mixed.filter("__mixed").agg(F.max("__size")).first()[0]
    if most:
        done = done.unionByName(_settle_stretches(mixed.filter("__mixed"), most, rows.columns, list(order)))
    if not crowded:
        return done.withColumnRenamed("__slot", out)
    return _past(done, _holes(marks, ["book_id"], "__t"), ["book_id"], "__slot", order).withColumnRenamed("__slot", out)


def _holes(marks: DataFrame, keys, mark: str) -> DataFrame:
    """Taken slots by the number of free ones before them."""
    return rank_rows(marks, keys, [mark], "__r").select(*keys, (F.col(mark) - F.col("__r")).alias("__h"))


def _past(rows: DataFrame, holes: DataFrame, keys, slot: str, ties) -> DataFrame:
    """``slot`` from its number among the free slots: add the taken ones passed on the way."""
    counted = count_upto(rows, slot, holes, "__h", "__passed", inclusive=True, ties=ties, keys=keys)
    return counted.withColumn(slot, F.col(slot) + F.col("__passed")).drop("__passed")


def halvings(rows: int, leaf: int | None = None) -> int:
    """Rounds that it takes to cut so many rows into leaves."""
    leaf, out = leaf or LEAF_ROWS, 0
    while rows > leaf:
        rows, out = -(-rows // 2), out + 1
    return out


def _settle_stretches(rows: DataFrame, most: int, columns, order) -> DataFrame:
    """Slots of mixed stretches, of at most ``most`` rows each: halved by order, settled, and counted back."""
    stretch = ["book_id", "__stretch"]
    # __part: the halves a row went through, later ones as 1; __turn: its place in its part
    state = rank_rows(rows.select(*columns, "__stretch", "__base", "__size"), stretch, order, "__turn").withColumn("__part", F.lit(0).cast("long"))
    keys, gaps = [*stretch, "__part"], []
    for _ in range(halvings(most)):
        state = stage(state.withColumn("__half", F.call_function("div", F.col("__size") + 1, F.lit(2).cast("long"))).withColumn("__later", (F.col("__turn") >= F.col("__half")).cast("long")))
        used = leftmost_slots(state.filter("__later = 0").select(*keys, "__base", *order), keys, "__base", order, "__t").select(*keys, "__t")
        used = stage(used)
        late = count_upto(state.filter("__later = 1"), "__base", used, "__t", "__below", inclusive=False, ties=order, keys=keys)
        late = late.withColumn("__base", F.col("__base") - F.col("__below")).withColumn("__turn", F.col("__turn") - F.col("__half")).withColumn("__size", F.col("__size") - F.col("__half"))
        early = state.filter("__later = 0").withColumn("__size", F.least("__size", "__half"))
        gaps.append(stage(_holes(used, keys, "__t")))
        state = (early.unionByName(late.drop("__below")).withColumn("__part", 2 * F.col("__part") + F.col("__later")).drop("__half", "__later"))
    placed = stage(_settle_leaves(state, keys, columns, order))
    for holes in reversed(gaps):
        # only later halves passed the slots of the earlier ones
        late = placed.filter("__part % 2 = 1").withColumn("__part", F.shiftright("__part", 1))
        early = placed.filter("__part % 2 = 0").withColumn("__part", F.shiftright("__part", 1))
        placed = stage(early.unionByName(_past(late, holes, keys, "__slot", order)))
    return placed.select(*columns, "__slot")


def _settle_leaves(rows: DataFrame, keys, columns, order) -> DataFrame:
    """In each part each slot goes to the earliest row that waits for one; a part has at most LEAF_ROWS rows."""
    import heapq

    def settle(pdf):
        pdf = pdf.sort_values("__turn", kind="stable").reset_index(drop=True)
        by_base = pdf["__base"].argsort(kind="stable").tolist()
        bases = pdf["__base"].tolist()
        slots, waiting, nxt, at = [0] * len(pdf), [], 0, 0
        for _ in range(len(pdf)):
            if not waiting:
                at = max(at, bases[by_base[nxt]])
            while nxt < len(by_base) and bases[by_base[nxt]] <= at:
                heapq.heappush(waiting, by_base[nxt])
                nxt += 1
            slots[heapq.heappop(waiting)] = at
            at += 1
        pdf["__slot"] = slots
        return pdf[[*columns, "__stretch", "__part", "__slot"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns)
    kept = rows.select(*columns, "__stretch", "__part", "__base", "__turn")
    return kept.groupBy(*keys).applyInPandas(settle, f"{fields}, __stretch long, __part long, __slot long")


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))
