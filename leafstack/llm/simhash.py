"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints within the error budget agree on at least one of budget + 1 blocks of bits.  For each
block the fingerprints are rotated so that it comes first and dealt out by it; each task then holds
a trie of whole blocks (a sorted array, whose nodes are ranges).  Below the block, node pairs go
down together: descending into different children adds one differing bit, and a pair is dropped
as soon as the bits exceed the budget.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TABLES, among, beside, marks, removed, text_groups, text_key, without, written
from .components import components

# Hashes counted at once.
BATCH = 1 << 16
# Pairs of fingerprints compared at once, and the node size below which all pairs of a node pair are compared.
PAIRS, LEAF = 1 << 21, 64
# Fingerprints that a task holds; only sets the number of tasks.
TASK_ROWS = 200_000
# Bits of a block, and bits that fingerprints are dealt by where a block may differ.
BLOCK, DEAL = 16, 8
# Words of a fingerprint's shingles.
FINGERPRINT_WORDS = 3
# For similar texts: bands of least hashes and hashes of a band.  Sets of similarity s share a band
# with probability 1 - (1 - s^4)^24, at 0.8 all but 3 of a million.
BANDS, BAND = 24, 4
# Two sets are similar if 5 x common shingles >= 4 x shingles of both.
COMMON, BOTH = 5, 4
# Before shingles are read: two bits of each least hash make a sketch of SKETCH longs.  Sketches of
# sets of similarity 0.8 differ in 19 bits, give or take 5, whatever the sets' sizes.
SKETCH, SKETCH_BUDGET = 2 * BANDS * BAND // 64, 50


def shingle_hashes(parts: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `words` words, joined by blanks; of the whole if there are fewer, of nothing if there is none."""
    if not parts:
        return np.zeros(0, "<u8")
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:max(len(parts) - words + 1, 1)].tolist()
    ends = ends[min(words, len(parts)) - 1:].tolist()
    return np.array([hashed(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], "<u8")


def majority(h: np.ndarray) -> int:
    """64 bits: those that are set in over half of the hashes; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), BATCH):
        total += np.unpackbits(h[at:at + BATCH].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def words_in(text: bytes) -> list[bytes]:
    """The words, A-Z in lower case."""
    return text.lower().split()


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """Bit k is set where over half the shingles' hashes have it; 0 for a text without words."""
    return majority(shingle_hashes(words_in((text or "").encode()), words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """`docs` without its text, with `fingerprint` long (the 64 bits, as a signed number)."""
    docs = without(docs, "fingerprint")
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fingerprint", T.LongType())])

    def add(batches):
        for group, batch in text_groups(batches):
            bits = pa.array(np.array([majority(shingle_hashes(words_in(data), words)) for data in group], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bits], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(add, schema)


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least values of the hashes `h` under BANDS x BAND multiplications, 0 for none."""
    if not len(h):
        return np.zeros(BANDS * BAND, np.uint64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), BATCH >> 4):
        part = h[at:at + (BATCH >> 4)]
        for k, m in enumerate(MULTIPLIERS):
            least[k] = min(least[k], (part * m).min())
    return least


def bands_of(least: np.ndarray) -> list[int]:
    """A number for each band of least hashes."""
    return np.array([xxhash.xxh64_intdigest(least[k * BAND:(k + 1) * BAND].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketch_of(least: np.ndarray) -> list[int]:
    """Two bits of each least hash."""
    two = spread(least).view(np.uint8).reshape(-1, 8)[:, 0]
    return np.packbits(np.concatenate((two & 1, two >> 1 & 1))).view("<i8").tolist()


def shingle_sets(docs: DataFrame, text: str, words: int, fingerprint_words: int | None = None) -> DataFrame:
    """`docs` without its text, with each document's distinct shingles of `words` words.

    These are `set_key` (16 bytes, equal for equal sets), `bands` and `sketch` of the least hashes,
    `size`, their number, and `shingles`, their hashes cut to 40 bits, in order; and, if asked for, the
    `fingerprint` of shingles of `fingerprint_words` words, as `fingerprints` makes it.
    """
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
        T.StructField("size", T.IntegerType()), T.StructField("shingles", T.BinaryType()),
        *([T.StructField("fingerprint", T.LongType())] if fingerprint_words else [])])
    types = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), *([pa.int64()] if fingerprint_words else [])]

    def add(batches):
        for group, batch in text_groups(batches):
            rows = []
            for data in group:
                parts = words_in(data)
                h = np.unique(shingle_hashes(parts, words))
                least, cut = least_hashes(h), np.unique(h >> np.uint64(24))
                bits = [np.uint64(majority(shingle_hashes(parts, fingerprint_words))).view(np.int64)] if fingerprint_words else []
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), bands_of(least), sketch_of(least), len(cut), packed(cut), *bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(add, schema)


def spread(h: np.ndarray) -> np.ndarray:
    """Other 64 bits of the same hashes: a bijection that mixes them all."""
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(k)
    return h ^ (h >> np.uint64(31))


# Odd numbers, by which least hashes are taken.
MULTIPLIERS = spread(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def packed(h: np.ndarray) -> bytes:
    """The numbers, of 40 bits, as five bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _oversize(alo, ahi, blo, bhi) -> list:
    """The leaf pairs cut so that each has at most PAIRS pairs of fingerprints."""
    out = []
    for lo, hi, x, y in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist(), strict=True):
        rows = max(1, PAIRS // max(y - x, 1))
        out += [(at, min(at + rows, hi), x, y) for at in range(lo, hi, rows)]
    return out


def trie_links(f: np.ndarray, budget: int, exact: int, first: int = 0, home: int | None = None):
    """Pairs (i, j), i < j, of the sorted `f` (uint64) that differ in at most `budget` bits, in chunks.

    Nodes below the first `exact` bits meet only themselves; with `home`, the node of that prefix
    meets itself and all later ones.  Within the first BLOCK bits at most `first` may differ.
    """
    if len(f) < 2:
        return
    head = f >> np.uint64(64 - exact) if exact else np.zeros(len(f), np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    if home is None:
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        stack = [(exact, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    else:
        err = np.bitwise_count(head[lo] ^ np.uint64(home)).astype(np.int64)
        mine = np.full(len(lo), np.flatnonzero(err == 0)[0]) if (err == 0).any() else np.zeros(0, np.int64)
        stack = [(exact, lo[mine], hi[mine], lo[:len(mine)], hi[:len(mine)], err[:len(mine)])]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > PAIRS // LEAF:  # keeps the frontier in bounds: go down with one half after the other
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
            stack.append((depth, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half]))
            continue
        leaf = (ahi - alo) * (bhi - blo) <= LEAF
        if depth >= 64:
            leaf[:] = True
        parts = [(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf])] if leaf.any() else []
        if parts and int(((ahi - alo) * (bhi - blo))[leaf].sum()) > PAIRS + LEAF * len(alo):
            parts = [tuple(np.array([v]) for v in x) for x in _oversize(*parts[0])]
        for a, a_end, b, b_end in parts:
            na, nb = a_end - a, b_end - b
            n = na * nb
            pair = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a[pair] + off // nb[pair], b[pair] + off % nb[pair]
            near = (i < j) & (np.bitwise_count(f[i] ^ f[j]) <= budget)
            yield i[near], j[near]
        rest = ~leaf
        if not rest.any():
            continue
        alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        bit, below = np.uint64(1 << (63 - depth)), np.uint64((1 << (64 - depth)) - 1)
        amid = np.clip(np.searchsorted(f, (f[alo] & ~below) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(f, (f[blo] & ~below) | bit), blo, bhi)
        own, most = alo == blo, first if depth < BLOCK else budget
        pairs = [(alo, amid, blo, bmid, err, True), (amid, ahi, bmid, bhi, err, True),
                 (alo, amid, bmid, bhi, err + 1, True), (amid, ahi, blo, bmid, err + 1, ~own)]
        keep = [(x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= most) & x[5] for x in pairs]
        stack.append((depth + 1, *(np.concatenate([x[k][m] for x, m in zip(pairs, keep, strict=True)]) for k in range(5))))


def spanning(f: np.ndarray, links, agree=None) -> np.ndarray:
    """For each of the fingerprints `f` the index of its component's first one, by the `links` for which agree(i, j)."""
    root = np.arange(len(f))
    for i, j in links:
        if agree is not None:
            well = agree(i, j)
            i, j = i[well], j[well]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while len(i) and not np.array_equal(up := root[root], root):
                root = up
    return root


def near_links(bits: DataFrame, budget: int = 3, proof_budget: int | None = None) -> DataFrame:
    """`bits` (node, fingerprint, proof) -> edges (a, b) of nodes that connect just what the links connect.

    Two nodes link whose fingerprints differ in at most `budget` bits and, with `proof_budget`, whose
    proofs (16 bytes) differ in at most that many.  Of four blocks of BLOCK bits one has at most
    budget // 4 of the differing bits, so for each block, rotated to the front, fingerprints are
    dealt by their first bits; if those may differ, a fingerprint also visits the smaller prefixes
    within reach.  A task turns the links it finds into one edge per fingerprint, so a dense group
    gives as many rows as it has fingerprints and block, not its pairs.
    """
    first = budget // 4
    deal = BLOCK if not first else DEAL
    masks = [0] if not first else [m for m in range(1 << deal) if m.bit_count() <= first]
    turns = F.explode(F.array(*[F.struct(F.lit(r).alias("turn"), F.expr(
        f"shiftleft(fingerprint, {r * BLOCK}) | shiftrightunsigned(fingerprint, {64 - r * BLOCK})" if r else "fingerprint").alias("f")) for r in range(4)]))
    turned = bits.select("node", "proof", turns.alias("x")).select("node", "proof", "x.turn", "x.f")
    dealt = (turned.withColumn("own", F.shiftrightunsigned("f", 64 - deal)).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
             .withColumn("key", F.col("own").bitwiseXOR(F.col("mask"))).filter("key <= own").select("turn", "key", "f", "node", "proof"))
    # each mask but 0 keeps half of its rows
    tasks = max(1, -(-bits.count() * 4 * (len(masks) + 1) // (2 * TASK_ROWS)))

    def join(batches):
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if table is None:
            return
        turn, key, f, node = (table.column(k).to_numpy() for k in range(4))
        f = f.view(np.uint64)
        proof = None if proof_budget is None else np.frombuffer(b"".join(table.column(4).to_pylist()), "<u8").reshape(-1, 2)
        # without visitors all blocks of a turn are one trie
        group = turn if not first else turn.astype(np.int64) << deal | key
        order = np.lexsort((f, group))
        group, f, node = group[order], f[order], node[order]
        proof = proof[order] if proof is not None else None
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            mine, own = slice(lo, hi), proof[lo:hi] if proof is not None else None
            agree = None if own is None else lambda i, j, own=own: np.bitwise_count(own[i] ^ own[j]).sum(axis=1) <= proof_budget
            root = spanning(f[mine], trie_links(f[mine], budget, deal, first, int(group[lo]) & (1 << deal) - 1 if first else None), agree)
            moved = np.flatnonzero(root != np.arange(hi - lo))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[mine][root[moved]]), pa.array(node[mine][moved])], names=["a", "b"])

    by = ["turn", "key"]
    return dealt.repartition(tasks, *by).mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """One row per document: its columns but the text, `fingerprint` long and `component_id`.

    Documents whose fingerprints differ in at most `budget` bits are linked; `component_id` is the
    smallest id reachable (null ids do not count, and stay null if there is no other).  Null, empty
    and wordless texts have fingerprint 0, which links like any other.  Equal rows are rows of the
    same component.  An empty table gives no rows; input columns named like an output are replaced.
    """
    docs = without(docs, "component_id", "fingerprint", "__least", "__fp")
    marked = written(fingerprints(docs, text, words), "fingerprints")
    bits = written(marked.groupBy("fingerprint").agg(F.min(F.col(f"`{doc_id}`")).alias("__least")), "bits")
    nodes = bits.select(F.col("fingerprint").alias("node"), "fingerprint", F.lit(None).cast("binary").alias("proof"))
    roots = components(near_links(nodes, budget))
    rooted = written(bits.join(roots, F.col("fingerprint") == F.col("node"), "left")
                     .select(F.col("fingerprint").alias("__fp"), "__least", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
    classes = written(rooted.join(least, "root").select("__fp", "component_id"), "classes")
    return (marked.join(classes, F.col("fingerprint") == F.col("__fp"))
            .select(*[F.col(f"`{c}`") for c in marked.columns], "component_id"))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The `pairs` (a, b) whose sets of shingles, by `sets` (node, shingles), are similar; every pair is compared whole."""
    needed = among(sets.select("node", "shingles"), "node", pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left, right = (needed.select(F.col("node").alias(c), F.col("shingles").alias(f"__{c}")) for c in ("a", "b"))

    def compare(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = []  # sets of one pair at a time
            for x, y in zip(a, b, strict=True):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(COMMON * common >= BOTH * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "__a", "__b").mapInArrow(compare, "a long, b long")


def similar_links(nodes: DataFrame) -> DataFrame:
    """`nodes` (node, bands, sketch, size, shingles) -> edges (a, b) that connect just what similar pairs connect.

    Candidates share a band, and their sizes and sketches do not rule them out.  First each node is
    compared with the smallest one of its bands, then, where bands are not yet connected, with the one
    whose shingles are the most common there: in a group of copies that is one near their origin.  That
    settles most of a dense group by two comparisons per node.  What is still apart meets by
    `prefix_pairs`, not band by band.
    """
    sketch = [f"s{k}" for k in range(SKETCH)]
    tags = written(nodes.select("node", "size", *[F.col("sketch")[k].alias(n) for k, n in enumerate(sketch)]), "tags")

    def possible(x, y):
        bits = " + ".join(f"bit_count({x}{n} ^ {y}{n})" for n in sketch)
        return f"{COMMON} * {x}size >= {BOTH} * {y}size and {COMMON} * {y}size >= {BOTH} * {x}size and {bits} <= {SKETCH_BUDGET}"

    cells = written(nodes.select("node", F.explode("bands").alias("cell")), "cells")
    heads = written(cells.groupBy("cell").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell", "head"), "heads")
    shared = written(cells.join(heads, "cell"), "shared")
    star = shared.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    sides = [tags.select(*[F.col(c).alias(f"{s}_{c}") for c in tags.columns]) for s in ("x", "y")]
    star = (star.join(sides[0], F.col("a") == F.col("x_node")).join(sides[1], F.col("b") == F.col("y_node"))
            .filter(possible("x_", "y_")).select("a", "b"))
    links = written(alike(written(star, "star"), nodes), "star_links")

    def apart(links):
        """Nodes with their roots, by cell, of all cells with several roots."""
        rooted = tags.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = written(shared.select("cell", "node").join(rooted, "node"), "placed")
        # two rows are a star's one pair
        split = placed.groupBy("cell").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most and n > 2").select("cell")
        return written(placed.join(split, "cell", "left_semi"), "apart")

    placed = apart(links)
    members = written(placed.select("node").distinct(), "members")
    shingles = written(common_shingles(members, nodes), "shingles")
    weight = shingles.groupBy("node").agg((F.sum("n") / F.count(F.lit(1))).alias("weight"))
    weighed = written(placed.join(weight, "node"), "weighed")
    center = weighed.groupBy("cell").agg(F.max_by(F.struct("node", "size", "root", *sketch), F.struct("weight", "node")).alias("c"))
    again = (weighed.select("cell", *[F.col(c).alias(f"x_{c}") for c in ("node", "size", "root", *sketch)])
             .join(center.select("cell", *[F.col(f"c.{c}").alias(f"y_{c}") for c in ("node", "size", "root", *sketch)]), "cell")
             .filter(f"x_root <> y_root and {possible('x_', 'y_')}").select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())
    links = written(links.unionByName(alike(written(again, "again"), nodes)), "center_links")
    members = written(apart(links).select("node", "root", "size", *sketch).distinct(), "mixed")
    rest = prefix_pairs(members, shingles, possible("x_", "y_"))
    return links.unionByName(alike(written(rest, "rest"), nodes))


def common_shingles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingle, n): the shingles of `members` (node), by `nodes` (node, shingles), and how many of them have each."""
    def spread_out(batches):
        for batch in batches:
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = unpacked(data.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own)], names=["node", "shingle"])

    own = among(nodes.select("node", "shingles"), "node", members.select("node"))
    rows = written(own.mapInArrow(spread_out, "node long, shingle long"), "spread")
    return rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle").select("node", "shingle", "n")


def prefix_pairs(members: DataFrame, shingles: DataFrame, possible: str) -> DataFrame:
    """Pairs (a, b) of `members` (node, root, size and what `possible` asks of x_ and y_) with different roots; none that is similar is left out.

    With the shingles (node, shingle, n) of each set in one order, rare ones first, two similar sets
    share one within the first size - ceil(0.8 size) + 1 of both, and the first that they share has
    enough behind it on both sides for the overlap that they need.  So copies that differ in places of
    their own do not meet.
    """
    order = Window.partitionBy("node").orderBy("n", "shingle")  # the shingles of one text
    placed = shingles.withColumn("place", F.row_number().over(order)).filter("n > 1")
    least = f"cast(ceil({BOTH} * size / {COMMON}) as int)"
    prefix = written(placed.join(members, "node").filter(f"place <= size - {least} + 1"), "prefix")
    x, y = (prefix.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in (*members.columns, "place")]) for s in ("x", "y"))
    # similarity s of sets of x and y shingles needs s (x + y) / (1 + s) in common
    enough = f"least(x_size - x_place, y_size - y_place) + 1 >= {BOTH} * (x_size + y_size) / {BOTH + COMMON}"
    return (x.join(y, "shingle").filter(f"x_root < y_root and {enough} and {possible}")
            .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())


def _components(marked: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """`marked` (label, set_key and the other columns of shingle_sets) -> (label, component_id).

    `more`: further links (a, b) of sets, by their smallest labels.
    """
    nodes = written(marked.groupBy("set_key").agg(F.min("label").alias("node")), "nodes")
    # the sets are read several times, and wide: no reading shuffles them
    sets = marked.select(F.col("label").alias("node"), "bands", "sketch", "size", "shingles")
    links = similar_links(among(sets, "node", nodes.select("node"), marks(nodes.select("node"))))
    roots = written(components(links if more is None else links.unionByName(more)), "roots")
    rooted = written(nodes.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id")), "rooted")
    return marked.select("label", "set_key").join(rooted, "set_key").select("label", "component_id")


def similar_documents(docs: DataFrame, label: str = "label", text: str = "text", words: int = 5) -> DataFrame:
    """One row per document: `label` (unique long), and `component_id`, the smallest label its links reach.

    Two texts link if their shingle sets of `words` words have a similarity of 0.8 or more, counted
    over the whole sets.  Of pairs of similarity 0.8 the candidates (BANDS) leave out 3 in a million,
    of closer ones fewer.
    """
    asked = docs.select(F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{text}`").alias("text"))
    return _components(written(shingle_sets(asked, "text", words), "signatures"))


def fingerprint_links(marked: DataFrame, budget: int = 3) -> DataFrame:
    """`marked` (label, set_key, fingerprint) -> edges (a, b) of the sets' smallest labels.

    They connect just the sets that texts of equal fingerprints, or of fingerprints within `budget` bits, connect.
    """
    sets = written(marked.groupBy("set_key").agg(F.min("label").alias("node")), "fingerprint_sets")
    held = written(marked.select("set_key", "fingerprint").distinct().join(sets, "set_key").select("node", "fingerprint"), "fingerprint_nodes")
    # a fingerprint's smallest set stands for it; one set may have several fingerprints, and one fingerprint several sets
    heads = written(held.groupBy("fingerprint").agg(F.min("node").alias("head")), "fingerprint_heads")
    near = near_links(heads.select(F.col("fingerprint").alias("node"), "fingerprint", F.lit(None).cast("binary").alias("proof")), budget)
    left, right = (heads.select(F.col("fingerprint").alias(c), F.col("head").alias(f"__{c}")) for c in ("a", "b"))
    apart = near.join(left, "a").join(right, "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    return held.join(heads, "fingerprint").select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(apart)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, budget: int | None = None) -> DataFrame:
    """`docs` with one document of each class of `similar_documents`: that with the smallest id (null ids last).

    With a `budget` texts also link whose SimHash fingerprints, those of `near_duplicates`, differ in at
    most that many bits, by its trie join; the classes are those of all links together.
    Rows are told apart by id and text, so `docs` may come in any order and partitioning at each
    reading; of rows that have both in common any one stays.  Null, empty and wordless texts are one
    class.  An empty table gives no rows.  Texts are not shuffled while the rows to drop are few
    enough to be broadcast; but rows with id and text in common are grouped.
    """
    own, start = without(docs, "__told").columns, len(TABLES)
    told = F.concat_ws("\x00", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.col(f"`{doc_id}`").isNull().cast("string"), F.hex(text_key(F.col(f"`{text}`"))))
    keyed = docs.select(*[F.col(f"`{c}`") for c in own], F.unhex(F.md5(told.cast("binary"))).alias("__told"))
    # the labels are written with the signatures, and the texts are not labelled again
    asked = keyed.select(F.monotonically_increasing_id().alias("label"), F.col(f"`{doc_id}`").alias("id"), F.col("__told").alias("told"), F.col(f"`{text}`").alias("text"))
    if budget is None:
        marked, more = written(shingle_sets(asked, "text", words), "signatures"), None
    else:
        marked = written(shingle_sets(asked, "text", words, FINGERPRINT_WORDS), "signatures")
        more = fingerprint_links(marked, budget)
    classes = written(marked.select("label", "id", "told").join(_components(marked, more), "label"), "near")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("label"))
    best = classes.groupBy("component_id").agg(F.min_by("told", order).alias("best"))
    judged = written(classes.join(best, "component_id").groupBy("told").agg(F.max(F.col("told") == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("n"))
                     .filter("not stays or n > 1"), "judged")
    removed(docs.sparkSession, TABLES[start:-1])  # the signatures are nearly as large as the texts
    one = beside(judged.filter("stays").select(F.col("told").alias("__told")), 48)
    twins = keyed.join(one, "__told", "left_semi").groupBy("__told").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in own])).alias("__r")).select("__r.*")
    return keyed.join(beside(judged.select(F.col("told").alias("__told")), 48), "__told", "left_anti").select(*[F.col(f"`{c}`") for c in own]).unionByName(twins)
