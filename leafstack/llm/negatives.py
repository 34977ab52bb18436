"""Hard negatives by best-first descent of cover trees.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm of its tree, so that all
have norm M and distance and inner product with a query tell each other.  A cover tree over them has
levels whose radii halve; every node covers all points that hang below it within its covering
radius, which bounds their inner products from both sides.  A query goes down best bound first,
skips nodes that lie outside its windows or cannot beat what it has, and scores exactly every point
that it meets.  Trees hold rows of one label; a cell of rows has a tree for each of its labels, and
cut at TREE rows more of them, and every query meets every cell once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .topk import SCALE, _matrix, _stacked

# Rows of a tree at most: it is built in the square of them.
TREE = 2048
# Rows of a cell: at least, so that a query's start pays, and at most, so that a task holds them; and the bytes of their matrix.
LEAST_CELL, MOST_CELL, CELL_BYTES = 4096, 1 << 14, 64 << 20
# Nodes opened at once: at first, and at most.
OPEN, MOST_OPEN = 16, 1024
NO_ID = (1 << 63) - 1


class CoverTree:
    """A cover tree over the rows of `x` (whole numbers as float64), farthest first.

    Level i has the points that were more than top / 2**i from all points before them; each hangs
    from its nearest point of the levels above.  A point that keeps getting children on lower levels
    has a node for each of those levels.  Points equal to an earlier one hang from it at distance 0.
    Node arrays: `point`, `radius` (greatest distance to a point below it), `first` and `last` (its
    children, other nodes), `again` (the parent has the same point).
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        square = np.einsum("ij,ij->i", x, x)
        self.square = float(square.max(initial=0))
        self.x = x
        lift = np.sqrt(np.maximum(self.square - square, 0))
        dist, nearest = np.full(n, np.inf), np.zeros(n, np.int64)
        parent, level = np.zeros(n, np.int64), np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        at, radius, depth, above = 0, None, 0, nearest
        while True:
            # distance to the new point, by the inner product
            d = np.sqrt(np.maximum(square + square[at] - 2 * (x @ x[at]) + (lift - lift[at]) ** 2, 0))
            d[at] = 0
            taken[at] = True
            closer = d < dist
            dist[closer], nearest[closer] = d[closer], at
            rest = np.where(taken, -1.0, dist)
            at = int(rest.argmax())
            far = rest[at]
            if radius is None:
                radius = far
                above = nearest.copy()
            if far <= 1e-6 * (radius + 1):
                break
            while far <= radius / 2**depth:
                # a new level: all points are within its radius of the points so far
                depth += 1
                above = nearest.copy()
            parent[at], level[at] = above[at], depth
        left = np.flatnonzero(~taken)
        parent[left], level[left] = nearest[left], depth + 1
        self._lay(x, square, lift, parent, level)

    def _lay(self, x, square, lift, parent, level):
        """Node arrays from each point's parent and level; point 0 is the root."""
        n = len(x)
        order = np.lexsort((np.arange(n), level, parent))
        order = order[order != 0]
        owner = parent[order]
        # a run: the children of one point on one level
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (level[order][1:] != level[order][:-1]))) if len(order) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        run_owner = owner[starts]
        more = np.concatenate((run_owner[1:] == run_owner[:-1], [False])) if len(starts) else np.zeros(0, bool)
        sizes = np.diff(np.concatenate((starts, [len(order)]))) + more  # the children, and the owner again if it has later runs
        begin = np.cumsum(sizes) - sizes + 1  # node 0 is the root
        total = 1 + int(sizes.sum())
        self.point, self.again = np.zeros(total, np.int64), np.zeros(total, bool)
        self.first, self.last = np.zeros(total, np.int64), np.zeros(total, np.int64)
        node = begin[run] + np.arange(len(order)) - starts[run]
        self.point[node] = order
        own = begin[more] + sizes[more] - 1
        self.point[own], self.again[own] = run_owner[more], True
        # which node opens which run: the point's first node its first run, the owner's later nodes its later runs
        opens = np.zeros(len(starts), np.int64)
        lead = np.concatenate(([True], ~more[:-1])) if len(starts) else np.zeros(0, bool)
        node_of = np.zeros(n, np.int64)
        node_of[order] = node
        opens[lead] = node_of[run_owner[lead]]
        opens[np.flatnonzero(more) + 1] = own
        self.first[opens], self.last[opens] = begin, begin + sizes
        # covering radii: every point tells all nodes that it hangs below, starting with the one over it
        up = np.zeros(total, np.int64)
        up[node] = opens[run]
        up[own] = opens[np.flatnonzero(more)]
        self.radius = np.zeros(total)
        points, now = order, up[node]
        while len(points):
            c = self.point[now]
            d = np.sqrt(np.maximum(square[points] + square[c] - 2 * np.einsum("ij,ij->i", x[points], x[c]) + (lift[points] - lift[c]) ** 2, 0))
            np.maximum.at(self.radius, now, d)
            points, now = points[now != 0], up[now[now != 0]]


class Forest:
    """Trees side by side: one set of node arrays over the rows of `x`, with the label of each root."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.x, roots, parts, at, nodes = x, [], [], 0, 0
        self.row = np.argsort(labels, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(labels[self.row]) != 0, [True])))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            for k in range(lo, hi, TREE):
                rows = self.row[k:min(k + TREE, hi)]
                tree = CoverTree(x[rows])
                roots.append((nodes, labels[rows[0]]))
                parts.append((rows[tree.point], tree.radius, tree.first + nodes, tree.last + nodes, tree.again, np.full(len(tree.point), tree.square)))
                nodes += len(tree.point)
        self.point, self.radius, self.first, self.last, self.again, self.square = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.roots, self.labels = (np.array(c) for c in zip(*roots, strict=True))

    def search(self, query: np.ndarray, starts: np.ndarray, windows: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores met below the root nodes `starts`: among them, for each window (least and greatest score), the `k` best and their ties.

        Row `own` does not count.
        """
        low, high = windows[:, :1], windows[:, 1:]
        best = np.full((len(windows), k), -np.inf)
        length = float(query @ query)
        met, scored = [], []
        nodes, opened = starts, OPEN
        score = self.x[self.point[nodes]] @ query
        fresh = np.ones(len(nodes), bool)
        front = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0)
        while True:
            # what is met is scored exactly, and may raise the windows' k-th best
            seen = fresh & (self.point[nodes] != own)
            met.append(self.point[nodes[seen]])
            scored.append(score[seen])
            inside = np.where((score[seen] >= low) & (score[seen] <= high), score[seen], -np.inf)
            best = np.partition(np.concatenate((best, inside), axis=1), -k, axis=1)[:, -k:]
            floor = np.maximum(low, best.min(axis=1, keepdims=True))
            # bounds of all that hangs below the new nodes that have children
            deep = self.last[nodes] > self.first[nodes]
            nodes, score = nodes[deep], score[deep]
            whole = length + self.square[nodes]
            slack = 1e-9 * whole + 1e-3
            apart = np.sqrt(np.maximum(whole - 2 * score, 0))
            most = (whole - np.maximum(apart - self.radius[nodes], 0) ** 2) / 2 + slack
            least = (whole - (apart + self.radius[nodes]) ** 2) / 2 - slack
            front = tuple(np.concatenate(c) for c in zip(front, (nodes, score, most, least), strict=True))
            # outside every window, or unable to reach its k-th best
            use = (front[2] >= floor) & (front[3] <= high)
            keep = use.any(axis=0)
            if not keep.any():
                return np.concatenate(met), np.concatenate(scored)
            front, use = tuple(c[keep] for c in front), use[:, keep]
            if len(front[0]) > opened:
                promise = np.where(use, np.minimum(front[2], high), -np.inf).max(axis=0)
                first = np.argpartition(-promise, opened - 1)
                go, stay = first[:opened], first[opened:]
            else:
                go, stay = np.arange(len(front[0])), np.zeros(0, np.int64)
            opened = min(2 * opened, MOST_OPEN)
            parents, known = front[0][go], front[1][go]
            front = tuple(c[stay] for c in front)
            n = self.last[parents] - self.first[parents]
            nodes = np.arange(n.sum()) + np.repeat(self.first[parents] - (np.cumsum(n) - n), n)
            score = np.repeat(known, n)
            fresh = ~self.again[nodes]
            score[fresh] = self.x[self.point[nodes[fresh]]] @ query


def _best_of(windows: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """(window, id, score) of the `k` best scores in each window, ties by smaller id."""
    order = np.lexsort((ids[rows], -score))
    rows, score = rows[order], score[order]
    inside = (score >= windows[:, :1]) & (score <= windows[:, 1:])
    inside &= np.cumsum(inside, axis=1) <= k
    window, at = np.nonzero(inside)
    return window, ids[rows[at]], score[at].astype(np.int64)


def _searched(rows: DataFrame, asks: DataFrame, cells: int, k: int, same: bool) -> DataFrame:
    """(row, part, vec_id, score): for each window of each query the `k` best of each cell.

    `rows` (cell, row, vec_id, label, x) are the candidates, `asks` (cell, row, label, x, windows) the
    queries; with `same` rows of the query's label are sought, else rows of other labels.
    """
    candidates = rows.select("cell", F.lit(0).alias("kind"), "row", "vec_id", "label", "x", F.lit(None).cast("array<struct<part:int,low:double,high:double>>").alias("windows"))
    queries = asks.select("cell", F.lit(1).alias("kind"), "row", F.lit(0).cast("long").alias("vec_id"), "label", "x", "windows")

    def search(batches):
        now, held, forest, ids, own = None, [], None, None, None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.diff(number) != 0) + 1
            for lo, hi in zip([0, *cut], [*cut, len(number)], strict=True):
                if number[lo] != now:
                    now, held, forest = number[lo], [], None
                part = batch.slice(lo, hi - lo)
                first = int(np.searchsorted(kind[lo:hi], 1))
                if first:
                    held.append(part.slice(0, first))
                if first == hi - lo:
                    continue
                if forest is None and held:
                    forest = Forest(_stacked([_matrix(h.column(5)) for h in held]), np.concatenate([h.column(4).to_numpy() for h in held]))
                    ids = np.concatenate([np.array(h.column(3).fill_null(NO_ID)) for h in held])
                    own = {r: i for i, r in enumerate(np.concatenate([h.column(2).to_numpy() for h in held]).tolist())}
                    held = []
                if forest is None:
                    continue
                asked, found = part.slice(first), []
                wide = forest.x.shape[1]
                vectors = _matrix(asked.column(5))[:, :wide]
                vectors = np.pad(vectors, ((0, 0), (0, wide - vectors.shape[1])))
                for row, label, query, spans in zip(asked.column(2).to_pylist(), asked.column(4).to_pylist(), vectors, asked.column(6).to_pylist(), strict=True):
                    starts = forest.roots[(forest.labels == label) == same]
                    if not len(starts):
                        continue
                    windows = np.array([(w["low"], w["high"]) for w in spans])
                    which, vec_id, score = _best_of(windows, *forest.search(query, starts, windows, k, own.get(row, -1)), ids, k)
                    found.append((np.full(len(which), row), np.array([w["part"] for w in spans], np.int32)[which], vec_id, score))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["row", "part", "vec_id", "score"])

    return (candidates.unionByName(queries).repartition(cells, "cell").sortWithinPartitions("cell", "kind")
            .mapInArrow(search, "row long, part int, vec_id long, score long"))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, is_anchor: str = "vec_id % 50 = 0",
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score).

    Components become floor(SCALE * x); a row's score is its integer inner product with the anchor,
    shorter vectors counting as filled up with zeros; higher scores come first, ties by smaller id, null
    ids last.  An anchor's positives are its first `positives` other rows of the same label.  For each,
    the first `negatives` rows of other labels are returned whose score is from `low` to `high` percent of
    the positive's, both included; there is none below a negative score.  Rows with null label or
    vector, or a null or non-finite component, take no part.  Repeated rows are rows of their own.  An
    empty table gives no rows; other columns play no part.  Sums of products must stay below 2**53.
    """
    x = F.col("x")
    taken = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("x"), F.expr(is_anchor).alias("asks")).filter(
        F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    # rows are numbered once, and the numbers are written with them
    whole = written(taken.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.coalesce("asks", F.lit(False)).alias("asks"),
                                 F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("x")), "vectors")
    n, wide = whole.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    most = max(min(MOST_CELL, CELL_BYTES // (8 * max(wide or 1, 1))), 1)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    cells = max(-(-n // most), min(-(-n // LEAST_CELL), 2 * cores), 1)
    rows = whole.withColumn("cell", F.expr(f"int(pmod(xxhash64(row), {cells}))"))
    # queries are copied to every cell, not candidates to every query
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    asks = whole.filter("asks").select("row", "label", "x")

    def span(part, lo, hi):
        return F.struct(F.lit(part).cast("int").alias("part"), lo.cast("double").alias("low"), hi.cast("double").alias("high"))

    # one window without ends finds the positives
    one = F.array(span(0, F.lit(float("-inf")), F.lit(float("inf"))))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id"))  # at most `positives` rows of each cell
    near = written(_searched(rows, asks.select(everywhere, "row", "label", "x", one.alias("windows")), cells, positives, True)
                   .withColumn("part", F.row_number().over(order)).filter(F.col("part") <= positives), "positives")
    # the scores that whole numbers in the window can have
    ends = near.filter("score >= 0").groupBy("row").agg(F.collect_list(F.struct(
        "part", F.ceil(F.col("score") * low / 100).cast("double").alias("low"), F.floor(F.col("score") * high / 100).cast("double").alias("high"))).alias("windows"))
    found = _searched(rows, asks.join(ends, "row").select(everywhere, "row", "label", "x", "windows"), cells, negatives, False)
    order = Window.partitionBy("row", "part").orderBy(F.desc("score"), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = near.select("row", "part", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (ranked.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(named, ["row", "part"])
            .join(whole.filter("asks").select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"), "rank", F.nullif("negative_id", F.lit(NO_ID)).alias("negative_id"), "positive_score", "negative_score"))
