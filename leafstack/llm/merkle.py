"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, and one over the groups.

A node is the digest of the hex digests of up to ARITY children.  A hex digest is just one block of
SHA-256, so the hash state before a child slot is eight words.  Every parent retains a copy of its
state before each slot.  To fold a replaced leaf to the root, each parent resumes the state of the
slot with the replacement and its right siblings alone.  The leaves of a group are cut into blocks
of ARITY ** LEVELS; a task builds whole blocks, many at once, and the blocks' roots are the leaves
of the next tier.  A block learns the states and siblings above it from its path, so no task holds
more than its blocks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, ordered_sums, without, written

ARITY = 3
# Levels that a block of leaves has.
LEVELS = 8
# Leaves that a task works on at once; whole blocks, so at most one block more.
BATCH = 1 << 14
# Words of a path's record: state, slot, number of children, their digests.
RECORD = 8 + 2 + 8 * ARITY


def _root_bits(prime: int, degree: int) -> int:
    """The first 32 bits behind the point of the square or cube root of `prime`."""
    want = prime << 32 * degree
    lo, hi = 0, 1 << 40
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**degree <= want else (lo, mid - 1)
    return lo & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % k for k in range(2, int(n**0.5) + 1))][:64]
START = np.array([[_root_bits(p, 2)] for p in _PRIMES[:8]], np.uint32)
ROUND = [np.uint32(_root_bits(p, 3)) for p in _PRIMES]
# The four hex digits of 16 bits, as a word.
_DIGIT = np.array([ord(c) for c in "0123456789abcdef"], np.uint32)
_HALF = np.arange(1 << 16, dtype=np.uint32)
HEX = _DIGIT[_HALF >> 12] << 24 | _DIGIT[_HALF >> 8 & 15] << 16 | _DIGIT[_HALF >> 4 & 15] << 8 | _DIGIT[_HALF & 15]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(state: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """SHA-256 states (8, n) after one more block each, given as 16 arrays of n words."""
    w = list(words)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turned(a, 7) ^ _turned(a, 18) ^ a >> np.uint32(3)) + (_turned(b, 17) ^ _turned(b, 19) ^ b >> np.uint32(10)))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        up = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ e & (f ^ g)) + ROUND[t] + w[t]
        top = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = up + top, a, b, c, d + up, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """States after the hex form of the digests (8, n)."""
    words = [HEX[half] for x in digest for half in (x >> np.uint32(16), x & np.uint32(0xFFFF))]
    return compress(state, words)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of that many whole blocks."""
    zero = np.zeros(state.shape[1], np.uint32)
    return compress(state, [zero + np.uint32(1 << 31), *[zero] * 14, blocks.astype(np.uint32) * np.uint32(512)])


def started(n: int) -> np.ndarray:
    return np.repeat(START, n, axis=1)


def from_hex(digests: list[str]) -> np.ndarray:
    """Digests (8, n) from their hex forms."""
    return np.frombuffer(bytes.fromhex("".join(digests)), ">u4").astype(np.uint32).reshape(-1, 8).T.copy()


def to_hex(digests: np.ndarray) -> list[str]:
    text = digests.T.astype(">u4").tobytes().hex()
    return [text[k:k + 64] for k in range(0, len(text), 64)]


def height(total: np.ndarray) -> np.ndarray:
    """Levels above so many leaves."""
    total, out = total.copy(), np.zeros(len(total), np.int64)
    while (total > 1).any():
        out += total > 1
        total = -(-total // ARITY)
    return out


class Level:
    """The parents of one level: children, their number, states before each slot; and of each child its parent and slot."""

    def __init__(self, digests: np.ndarray, first: np.ndarray, slot: np.ndarray):
        self.parent, self.slot = np.cumsum(first) - 1, slot
        n = int(self.parent[-1]) + 1
        self.size = np.bincount(self.parent, minlength=n)
        self.children = np.zeros((ARITY, 8, n), np.uint32)
        self.children[slot, :, self.parent] = digests.T
        self.states = np.zeros((ARITY, 8, n), np.uint32)
        state = started(n)
        for j in range(ARITY):
            self.states[j] = state
            there = np.flatnonzero(self.size > j)
            state[:, there] = absorb(state[:, there], self.children[j][:, there])
        self.digests = finish(state, self.size)


class Forest:
    """The trees over the leaves (8, n) of consecutive segments, each `steps` levels high."""

    def __init__(self, leaves: np.ndarray, segment: np.ndarray, position: np.ndarray, steps: np.ndarray):
        self.segment, self.levels = segment, []
        self.roots = np.zeros((8, len(steps)), np.uint32)
        at = np.arange(len(segment))  # each leaf's node in the level
        digests, seg, pos, here = leaves, segment, position, at
        for depth in range(int(steps.max(initial=0)) + 1):
            done = steps[seg] <= depth
            self.roots[:, seg[done]] = digests[:, done]
            digests, seg, pos = digests[:, ~done], seg[~done], pos[~done]
            if not len(seg):
                break
            place = np.cumsum(~done) - 1
            climbing = np.flatnonzero(steps[segment] > depth)
            here = place[here[np.isin(at, climbing)]] if depth else place[climbing]
            at = climbing
            first = (pos % ARITY == 0) | (seg != np.concatenate(([-1], seg[:-1])))
            level = Level(digests, first, pos % ARITY)
            self.levels.append((level, at, here))
            here = level.parent[here]
            starts = np.flatnonzero(first)
            digests, seg, pos = level.digests, seg[starts], pos[starts] // ARITY


def resume(states: np.ndarray, slot: np.ndarray, size: np.ndarray, children, value: np.ndarray) -> np.ndarray:
    """Parents' digests with `value` in the slot: only it and its right siblings are hashed."""
    state = absorb(states, value)
    for j in range(1, ARITY):
        right = np.flatnonzero((slot < j) & (size > j))
        if len(right):
            state[:, right] = absorb(state[:, right], children[j][:, right])
    return finish(state, size)


def add_siblings(proof: np.ndarray, count: np.ndarray, slot: np.ndarray, size: np.ndarray, children) -> None:
    """Take the slots' siblings, left to right, into the proofs' states."""
    for j in range(ARITY):
        other = np.flatnonzero((slot != j) & (size > j))
        if len(other):
            proof[:, other] = absorb(proof[:, other], children[j][:, other])
            count[other] += 1


def _blocks(batches, keys: int):
    """(columns of whole blocks, segment of each row); rows come ordered by their first `keys` columns and are cut only between blocks."""
    held = []

    def cut(table, last):
        change = np.zeros(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).combine_chunks()
            code = column.dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(change)
        end = table.num_rows if last else int(starts[-1]) if len(starts) else 0
        return table.slice(0, end), table.slice(end), np.cumsum(change[:end])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            whole, rest, segment = cut(pa.Table.from_batches(held), False)
            held = rest.to_batches()
            if whole.num_rows:
                yield whole, segment
    if held and (table := pa.Table.from_batches(held)).num_rows:
        whole, _, segment = cut(table, True)
        yield whole, segment


def _forest(table: pa.Table, segment: np.ndarray, levels: int) -> tuple[Forest, np.ndarray]:
    """The forest over columns __g, __block, __rank, __total and digest, and the first row of each segment."""
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    steps = np.minimum(height(table.column("__total").to_numpy()[first]), levels)
    leaves, place = from_hex(table.column("digest").to_pylist()), table.column("__rank").to_numpy() % ARITY**levels
    return Forest(leaves, segment, place, steps), first


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes, whole blocks together and in order."""
    blocked = nodes.withColumn("__block", F.expr(f"__rank div {ARITY**levels}"))
    rest = [c for c in nodes.columns if c not in ("__g", "__rank")]
    return (blocked.select("__g", "__block", "__rank", *[F.col(f"`{c}`") for c in rest])
            .repartition("__g", "__block").sortWithinPartitions("__g", "__block", "__rank"))


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """`nodes` (__g, __rank, __total, digest) -> the roots of their blocks, as nodes of the next tier."""
    def build(batches):
        for table, segment in _blocks(batches, 2):
            forest, first = _forest(table, segment, levels)
            yield pa.RecordBatch.from_arrays([
                table.column("__g").combine_chunks().take(pa.array(first)), table.column("__block").combine_chunks().take(pa.array(first)),
                pa.array(-(-table.column("__total").to_numpy()[first] // ARITY**levels)), pa.array(to_hex(forest.roots))], names=["__g", "__rank", "__total", "digest"])

    kept = nodes.select("__g", "__rank", "__total", "digest")
    return written(_dealt(kept, levels).mapInArrow(build, "__g string, __rank long, __total long, digest string"), "tier")


def _with_path(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The first node of each block carries the block's path."""
    heads = paths.select(F.col("__g").alias("__pg"), (F.col("__rank") * ARITY**levels).alias("__first"), "path")
    return nodes.join(beside(heads, 4096), (F.col("__g") == F.col("__pg")) & (F.col("__rank") == F.col("__first")), "left").drop("__pg", "__first")


def _descend(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Paths (__g, __rank, path) of `nodes`, which are the blocks of the tier below, from those of their own blocks."""
    def spread(batches):
        for table, segment in _blocks(batches, 2):
            forest, first = _forest(table, segment, levels)
            above = [table.column("path")[int(k)].as_py() for k in first]
            records = [[] for _ in segment]
            for level, at, here in forest.levels:
                parent, slot = level.parent[here], level.slot[here]
                rows = np.concatenate([level.states[slot, :, parent], slot[:, None], level.size[parent][:, None],
                                       level.children[:, :, parent].reshape(8 * ARITY, -1).T], axis=1).astype("<u4")
                for k, row in zip(at.tolist(), rows, strict=True):
                    records[k].append(row.tobytes())
            out = [b"".join(own) + above[s] for own, s in zip(records, segment.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("__g").combine_chunks(), table.column("__rank").combine_chunks(), pa.array(out, pa.binary())], names=["__g", "__rank", "path"])

    return written(_dealt(_with_path(nodes, paths, levels), levels).mapInArrow(spread, "__g string, __rank long, path binary"), "paths")


def _settle(table: pa.Table, segment: np.ndarray, changed: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Proofs of the leaves and the roots that they fold to once replaced by `changed`."""
    forest, first = _forest(table, segment, levels)
    n = len(segment)
    value, proof, count = changed.copy(), started(n), np.zeros(n, np.int64)
    for level, at, here in forest.levels:
        parent, slot = level.parent[here], level.slot[here]
        size, children = level.size[parent], level.children[:, :, parent]
        value[:, at] = resume(level.states[slot, :, parent].T, slot, size, children, value[:, at])
        own, counted = proof[:, at], count[at]
        add_siblings(own, counted, slot, size, children)
        proof[:, at], count[at] = own, counted
    paths = [np.frombuffer(table.column("path")[int(k)].as_py(), "<u4").reshape(-1, RECORD) for k in first]
    length = np.array([len(p) for p in paths])
    for depth in range(int(length.max(initial=0))):
        at = np.flatnonzero(length[segment] > depth)
        rows = np.stack([p[depth] if len(p) > depth else np.zeros(RECORD, "<u4") for p in paths]).astype(np.uint32)[segment[at]].T
        slot, size, children = rows[8].astype(np.int64), rows[9].astype(np.int64), rows[10:].reshape(ARITY, 8, -1)
        value[:, at] = resume(rows[:8], slot, size, children, value[:, at])
        own, counted = proof[:, at], count[at]
        add_siblings(own, counted, slot, size, children)
        proof[:, at], count[at] = own, counted
    return finish(proof, count), value


def leaf_hash(*columns: Column) -> Column:
    """Hex SHA-256 of the values' text forms, each as `-` if null, else its UTF-8 byte count, `:` and itself."""
    forms = []
    for c in columns:
        text = c.cast("string")
        forms.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*forms), 256)


def manifest(rows: DataFrame, leaf: str = "leaf", changed: str = "changed", group: str = "source", order: tuple[str, ...] = ("doc_id",), levels: int = LEVELS) -> DataFrame:
    """`rows` with `subroot`, `root`, `proof_sha256`, `folded_root` and `verified`.

    `leaf` is a row's hex SHA-256 and `changed` that of the row as it is found now.  Per group the
    leaves ascend by `order` (nulls first; ties by leaf, so equal rows swap places without effect),
    every ARITY consecutive nodes become their parent until one, the subroot, is left, and the
    subroots, ordered by group (null first, then bytewise), likewise give the root.  The proof is the
    digest of a leaf's siblings, level by level up to the root.  `folded_root` is the root with
    `changed` in the leaf's place; `verified` tells whether it is the root.  Null leaves are not
    allowed; the others come from `leaf_hash`.  An empty table gives no rows; other columns stay,
    and those named like an output are replaced.
    """
    rows = without(rows, "subroot", "root", "proof_sha256", "folded_root", "verified", "digest", "path", "__g", "__block", "__one", "__subroot")
    names = rows.columns
    keyed = rows.withColumn("__g", F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))).withColumn("__one", F.lit(1).cast("long"))
    leaves = written(ordered_sums(keyed, ["__g"], [*order, leaf], "__one", "ordered").drop("__before", "__one").withColumn("digest", F.col(f"`{leaf}`")), "leaves")

    def climbed(nodes):
        """All tiers of nodes, the last with one node per group."""
        tiers = [nodes.select("__g", "__rank", "__total", "digest")]
        while len(tiers) == 1 or (tiers[-1].agg(F.max("__total")).first()[0] or 0) > 1:
            tiers.append(_climb(tiers[-1], levels))
        return tiers

    def paths_above(tiers, paths):
        """Paths of the blocks of the lowest tier, from those of the single nodes of the last."""
        for nodes in tiers[-2:0:-1]:
            paths = _descend(nodes, paths, levels)
        return paths

    groups = climbed(leaves)
    subroots = groups[-1].select(F.col("__g").alias("__of"), F.col("digest"), F.lit("").alias("__g"), F.lit(1).cast("long").alias("__one"))
    tops = written(ordered_sums(subroots, ["__g"], ["__of"], "__one", "subroots").select("__g", "__of", "__rank", "__total", "digest"), "subroots")
    above = climbed(tops)
    root = above[-1].first()
    root = root["digest"] if root is not None else None
    paths = paths_above(above, above[-1].select("__g", "__rank", F.lit(b"").alias("path")))
    at_top = _descend(tops.select("__g", "__rank", "__total", "digest"), paths, levels)
    named = at_top.select(F.col("__rank").alias("__top"), "path").join(tops.select("__of", F.col("__rank").alias("__top")), "__top")
    paths = paths_above(groups, written(named.select(F.col("__of").alias("__g"), F.lit(0).cast("long").alias("__rank"), "path"), "paths"))

    schema = T.StructType([*rows.schema.fields, T.StructField("__g", T.StringType()), T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())])

    def settle(batches):
        for table, segment in _blocks(batches, 2):
            proof, folded = _settle(table, segment, from_hex(table.column(changed).to_pylist()), levels)
            out = pa.table([*(table.column(c) for c in names), table.column("__g"), pa.array(to_hex(proof)), pa.array(to_hex(folded))], names=schema.names)
            yield from out.combine_chunks().to_batches()

    told = _dealt(_with_path(leaves, paths, levels), levels).mapInArrow(settle, schema)
    tops = beside(tops.select(F.col("__of").alias("__g"), F.col("digest").alias("subroot")), 256)
    return (told.join(tops, "__g").withColumn("root", F.lit(root).cast("string"))
            .select(*[F.col(f"`{c}`") for c in names], "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))
