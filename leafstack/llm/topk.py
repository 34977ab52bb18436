"""Exact top-k search by inner product, with no random access until the end.

A cell of candidates keeps one list per dimension, sorted by component.  A query reads all lists in
step, each from the end that its weight's sign asks for.  What it has read gives every candidate a
lower and an upper bound; a candidate whose upper bound falls below the k-th best lower bound is out
for good.  Reading stops when no outsider can qualify any more, that is when only k candidates are
left, or more that tie to the end; only then are their scores resolved.  Each query meets every cell
once and the cells' results are merged.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
# Candidates of a cell: at least, so that sorting pays; and the bytes of its matrix at most.
LEAST_CELL, CELL_BYTES = 4096, 16 << 20


# Rows at both ends of every list whose bounds are followed from the start.
HEADS = 4


def depths(n: int) -> list[int]:
    """Where a reader of lists of `n` stops to compare bounds: a 32nd, an 8th, half, 7 eighths, then each time half of the rest."""
    out, left = [n // 32, n // 8, n // 2], n // 4
    while left > 1:
        left //= 2
        out.append(n - left)
    return sorted({d for d in out if d > 0} | {n})


class Cell:
    """Sorted lists over the rows of `matrix` (whole numbers as float64): the values of each, and the step at which it shows each row."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        order = np.argsort(-matrix, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(matrix, order, axis=0).T)
        self.step = np.empty(matrix.shape, np.int32)
        np.put_along_axis(self.step, order, np.arange(len(matrix), dtype=np.int32)[:, None], axis=0)
        self.heads = np.unique(np.concatenate((order[:HEADS], order[-HEADS:])))
        self.depth = 0  # to which the last query read

    def best(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the `k` best, ties included; row `own` does not count."""
        n, dims = self.matrix.shape
        weights = np.zeros(dims)
        weights[:min(dims, len(query))] = query[:dims]
        lists = np.flatnonzero(weights)
        values, weigh, rising = self.values[lists], weights[lists], weights[lists] < 0  # those are read from their other end
        last = np.where(rising, values[:, 0], values[:, -1]) * weigh

        def read(rows):
            """Components and steps of these rows in the lists that count."""
            return tuple(x[rows] if len(lists) == dims else x[np.ix_(rows, lists)] for x in (self.matrix, self.step))

        def bounds(part, step, front):
            seen = (step < np.where(rising, n - self.depth, self.depth)) ^ rising
            told = seen.astype(float) @ np.stack((front, last), axis=1)
            known = (part * seen) @ weigh
            return known + last.sum() - told[:, 1], known + front.sum() - told[:, 0]

        def kth(lower):
            return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf

        heads = read(self.heads[self.heads != own])
        left = np.delete(np.arange(n), own) if own >= 0 else np.arange(n)
        held = None
        for self.depth in depths(n) if len(lists) else ():
            if len(left) <= k:
                break
            front = np.where(rising, values[:, n - self.depth], values[:, self.depth - 1]) * weigh
            # while a row that no list has shown could still qualify, reading goes on at once
            if held is None and self.depth < n and front.sum() > kth(bounds(*heads, front)[0]):
                continue
            held = held or read(left)
            lower, upper = bounds(*held, front)
            # sums of whole numbers, so bounds are exact
            able = np.flatnonzero(upper >= kth(lower))
            if len(able) < len(left):
                left, held = left[able], tuple(x[able] for x in held)
        return left, self.matrix[left] @ weights


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def top_k(vectors: DataFrame, k: int = 5, is_query: str = "vec_id % 50 = 0", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score long): the `k` rows of highest score for each row that is a query.

    Components become floor(SCALE * x); the score is their inner product, shorter vectors counting
    as filled up with zeros.  All rows but the query's own are candidates; equal scores go by smaller
    id, null ids last.  Vectors that are null or hold a null or a non-finite component take no
    part.  Repeated rows are rows of their own, as candidates and as queries.  Fewer candidates
    than `k` give all of them, an empty table gives no rows; other columns play no part.  Sums of
    products must stay below 2**53.
    """
    x = F.col("x")
    taken = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("x"), F.expr(is_query).alias("asks")).filter(
        F.col("x").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = written(taken.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce("asks", F.lit(False)).alias("asks"),
                                 F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("x")), "vectors")
    # as few cells as keep all cores busy, and as many as bound a task's memory
    n, wide = whole.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    cores, most = vectors.sparkSession.sparkContext.defaultParallelism, max(CELL_BYTES // (8 * max(wide or 1, 1)), 1)
    cells = max(-(-n // most), min(-(-n // LEAST_CELL), 4 * cores), 1)
    rows = whole.select(F.expr(f"int(pmod(xxhash64(row), {cells}))").alias("cell"), F.lit(0).alias("kind"), "row", "vec_id", "x")
    # queries are copied to every cell, not candidates to every query
    asks = whole.filter("asks").select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "row", "vec_id", "x")

    def search(batches):
        now, held, cell, keys, ids = None, [], None, None, None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.diff(number) != 0) + 1
            for lo, hi in zip([0, *cut], [*cut, len(number)], strict=True):
                if number[lo] != now:
                    now, held, cell = number[lo], [], None
                part = batch.slice(lo, hi - lo)
                first = int(np.searchsorted(kind[lo:hi], 1))
                if first:
                    held.append(part.slice(0, first))
                if first == hi - lo:
                    continue
                if cell is None and held:
                    cell = Cell(_stacked([_matrix(h.column(4)) for h in held]))
                    keys = np.concatenate([h.column(2).to_numpy() for h in held])
                    ids = np.concatenate([np.array(h.column(3).fill_null((1 << 63) - 1)) for h in held])
                    own = {r: i for i, r in enumerate(keys.tolist())}
                if cell is None:
                    continue
                asked = part.slice(first)
                found = []
                asking, queries = asked.column(2).to_numpy(), _matrix(asked.column(4))
                for row, query in zip(asking.tolist(), queries, strict=True):
                    near, score = cell.best(query, k, own.get(row, -1))
                    best = np.lexsort((ids[near], -score))[:k]
                    found.append((np.full(len(best), row), ids[near[best]], score[best].astype(np.int64)))
                out = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["row", "vec_id", "score"])

    met = (rows.unionByName(asks).repartition(cells, "cell").sortWithinPartitions("cell", "kind")
           .mapInArrow(search, "row long, vec_id long, score long"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id"))
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return (ranked.join(whole.filter("asks").select("row", F.col("vec_id").alias("query_id")), "row")
            .select("query_id", "rank", F.nullif("vec_id", F.lit((1 << 63) - 1)).alias("vec_id"), "score"))
