"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions.  Each has a context tree over the bytes before it: a node is the last
d bytes, for d from 0 to `depth`, together with the bits of the byte so far, and holds the counts of
its zeros and ones.  Its Krichevsky-Trofimov estimate is mixed, half and half, with the product of what
its children one byte deeper say.  What is learned are the counts of whole grams (`depth` bytes and the
next); all shallower counts are sums of them.  The tree is worked out bottom up in cells of grams with
the same last two bytes of context, joined over the at most 65,280 nodes of the first two levels, and
read top down: the weights of each depth then give the probability of each bit, and a gram its code
length.

Texts are cut into chunks.  Each chunk asks for the grams and words that it holds and gets their
values by a join, so no task needs the whole model, and nothing that grows with the corpus is
broadcast or goes to the driver.
"""

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_groups, without, written

DEPTH = 4
# Text of a chunk, and bytes worked on at once.
CHUNK, PIECE = 64 << 20, 1 << 20
# Different grams or words that a task holds before it sends them.
HELD = 1 << 20
# Scores are sums of whole billionths, so that they do not depend on the order of adding.
UNIT = 1_000_000_000
END = b"\n"
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SHIFTS = np.arange(8, dtype=np.uint64)


def pieces(data: bytes):
    """Parts of `data` of some PIECE bytes, cut at white space only."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.end() if gap else len(data)
        yield data[at:end]
        at = end


def normal(data: bytes) -> bytes:
    """The words, A-Z in lower case, with a blank between and END behind."""
    return b" ".join(words for p in pieces(data) if (words := b" ".join(p.lower().split()))) + END


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """For every byte of the texts the `depth` bytes before it, nearest first, and itself, as one number; before a text come ENDs."""
    pad = END * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8).astype(np.uint64)
    out = data[depth:].copy()
    for back in range(1, depth + 1):
        out |= data[depth - back:len(data) - back] << np.uint64(8 * (depth - back + 1))
    if len(texts) == 1:
        return out
    inside = np.ones(len(out), bool)
    ends = np.cumsum([len(t) + depth for t in texts])[:-1] - depth  # where the next text's pad begins
    inside[(ends[:, None] + np.arange(depth)).ravel()] = False
    return out[inside]


def long_grams(text: bytes, depth: int):
    """`grams` of one text, PIECE bytes at a time."""
    if len(text) <= PIECE:
        yield grams([text], depth)
        return
    for at in range(0, len(text), PIECE):
        yield grams([text[at:at + PIECE]], depth) if not at else grams([text[at - depth:at + PIECE]], depth)[depth:]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + k) for k in range(8))


class Nodes:
    """The nodes of one depth: sorted keys (context << 8 | bits so far, from 1), zeros, ones, and the log of what their children say (None at the deepest)."""

    def __init__(self, key, zeros, ones, children=None):
        self.key, self.zeros, self.ones = key, zeros, ones
        total = zeros + ones + 1
        estimate = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(total) - np.log(np.pi)
        # share of the node's own estimate in the mix, and of what is deeper
        if children is None:
            self.weighted, self.own, self.deeper = estimate, np.ones(len(key)), np.zeros(len(key))
        else:
            self.weighted = np.logaddexp(estimate, children) + np.log(0.5)
            self.own, self.deeper = (np.exp(x + np.log(0.5) - self.weighted) for x in (estimate, children))
        self.chance = np.stack((zeros + 0.5, ones + 0.5)) / total

    def parents(self) -> tuple["Nodes", np.ndarray]:
        """The nodes one byte of context shallower, and each node's index among them."""
        key, up = np.unique(self.key >> np.uint64(16) << np.uint64(8) | self.key & np.uint64(255), return_inverse=True)
        zeros, ones, weighted = (np.bincount(up, weights=x, minlength=len(key)) for x in (self.zeros, self.ones, self.weighted))
        return Nodes(key, zeros, ones, weighted), up

    def told(self, above: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of a zero and a one by all depths down to this one, and the weight left for deeper ones, given those of the parents."""
        return above + left * self.own * self.chance, left * self.deeper


def deepest(gram: np.ndarray, n: np.ndarray) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """The deepest nodes of sorted `gram` with counts `n`; for each of a gram's eight decisions its node and its bit."""
    byte = gram & np.uint64(255)
    bit = (byte[None, :] >> (np.uint64(7) - _SHIFTS)[:, None]) & np.uint64(1)
    so_far = np.uint64(1) << _SHIFTS[:, None] | byte[None, :] >> (np.uint64(8) - _SHIFTS)[:, None]
    key, at = np.unique(gram & ~np.uint64(255) | so_far, return_inverse=True)
    at = at.reshape(8, -1)
    ones = np.bincount(at.ravel(), weights=(bit * n).ravel(), minlength=len(key))
    total = np.bincount(at.ravel(), weights=np.tile(n, 8), minlength=len(key))
    return Nodes(key, total - ones, ones), at, bit.astype(np.int64)


def climb(gram: np.ndarray, n: np.ndarray, depth: int, top: int):
    """Nodes of the depths from `depth` to `top`, each with its nodes' parents' indices, and the grams' decisions."""
    nodes, at, bit = deepest(gram, n)
    out = [(nodes, None)]
    for _ in range(depth - top):
        parent, up = out[-1][0].parents()
        out[-1] = (out[-1][0], up)
        out.append((parent, None))
    return out, at, bit


def code_values(gram: np.ndarray, n: np.ndarray, depth: int, top: int, above: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Log10 probability of each gram's byte, in billionths; `above` and `left` tell the depths before `top` for nodes (last byte << 8 | bits so far)."""
    levels, at, bit = climb(gram, n, depth, top)
    parent = (levels[-1][0].key >> np.uint64(16) << np.uint64(8) | levels[-1][0].key & np.uint64(255)).astype(np.int64) if top > 1 else None
    chance, rest = (above[:, parent], left[parent]) if top > 1 else (np.zeros((2, len(levels[-1][0].key))), np.ones(len(levels[-1][0].key)))
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k][0]
        chance, rest = nodes.told(chance, rest)
        if k:
            up = levels[k - 1][1]
            chance, rest = chance[:, up], rest[up]
    return np.rint(np.log10(chance[bit, at]).sum(axis=0) * UNIT).astype(np.int64)


def shallow(rows) -> tuple[np.ndarray, np.ndarray]:
    """`above` and `left` after the depths 0 and 1, from (key, zeros, ones, weighted) of all nodes of depth 1."""
    key = np.array([r[0] for r in rows], np.uint64)
    zeros, ones, children = (np.array([r[k] for r in rows], float) for k in (1, 2, 3))
    order = np.argsort(key)
    one = Nodes(key[order], zeros[order], ones[order], children[order])
    # depth 0 has no context
    bits, up = np.unique(one.key & np.uint64(255), return_inverse=True)
    root = Nodes(bits, *(np.bincount(up, weights=x, minlength=len(bits)) for x in (one.zeros, one.ones, one.weighted)))
    chance, rest = root.told(np.zeros((2, len(bits))), np.ones(len(bits)))
    chance, rest = one.told(chance[:, up], rest[up])
    above, left = np.zeros((2, 1 << 16)), np.zeros(1 << 16)
    above[:, one.key.astype(np.int64)], left[one.key.astype(np.int64)] = chance, rest
    return above, left


def _prepared(docs: DataFrame, train: Column, text: str) -> tuple[DataFrame, list[str]]:
    """The documents, normal and numbered, as a written table: their columns but the text, __row, __chunk, __train, __data."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("__train", T.BooleanType()), T.StructField("__row", T.LongType()),
                           T.StructField("__chunk", T.LongType()), T.StructField("__data", T.BinaryType())])

    def prepare(batches):
        part = TaskContext.get().partitionId() << 33
        row, chunk, held = part, part, 0
        for group, batch in text_groups(batches):
            data = [normal(t) for t in group]
            n = len(data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(row, row + n)), pa.array(np.full(n, chunk)), pa.array(data, pa.binary())], names=schema.names)
            row, held = row + n, held + sum(map(len, data))
            if held >= CHUNK:
                chunk, held = chunk + 1, 0

    asked = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(train, F.lit(True)).alias("__train"), F.col(f"`{text}`").alias("__data"))
    return written(asked.mapInArrow(prepare, schema), "texts", "zstd"), kept


def _seen(texts: DataFrame, depth: int) -> DataFrame:
    """(chunk, gram, word, n): the grams and words of each chunk, with their counts in training texts; a chunk may tell one twice."""
    def count(batches):
        now, held, words = None, [], Counter()

        def send():
            pairs = np.concatenate([h[0] for h in held])
            key, at = np.unique(pairs >> np.uint64(1), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([h[1] for h in held]) * (pairs & np.uint64(1)), minlength=len(key)).astype(np.int64)
            total = len(key) + len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(total, now)), pa.concat_arrays([pa.array(key.astype(np.int64)), pa.nulls(len(words), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(key), pa.binary()), pa.array(list(words), pa.binary())]), pa.array(np.concatenate((n, np.fromiter(words.values(), np.int64, len(words)))))],
                names=["chunk", "gram", "word", "n"])

        def take(texts, train):
            for code in long_grams(texts[0], depth) if len(texts) == 1 else [grams(texts, depth)]:
                held.append(np.unique(code << np.uint64(1) | np.uint64(train), return_counts=True))
            for text in texts:
                for piece in pieces(text):
                    if train:
                        words.update(piece.split())
                    else:
                        words.update(dict.fromkeys(piece.split(), 0))
            return sum(len(h[0]) for h in held) + len(words)

        for group, batch in text_groups(batches):
            chunks, train = batch.column(0).to_numpy(), np.array(batch.column(1))
            for chunk in np.unique(chunks).tolist():
                if chunk != now and held:
                    yield from send()
                    held.clear(), words.clear()
                now = chunk
                for kind in (0, 1):
                    mine = [t for t, c, k in zip(group, chunks.tolist(), train.tolist(), strict=True) if c == chunk and k == bool(kind)]
                    if mine and take(mine, kind) >= HELD:
                        pairs, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                        held[:] = [(pairs, np.bincount(at, weights=np.concatenate([h[1] for h in held])))]
                        if len(pairs) + len(words) >= HELD:
                            yield from send()
                            held.clear(), words.clear()
        if held:
            yield from send()

    return written(texts.select("__chunk", "__train", "__data").mapInArrow(count, "chunk long, gram long, word binary, n long"), "seen", "zstd")


def _by_cell(batches):
    """(cell, grams, counts) of rows (cell, gram, n) that come cell by cell."""
    now, held = None, []
    for batch in batches:
        cell = batch.column(0).to_numpy()
        cut = np.flatnonzero(np.diff(cell) != 0) + 1
        for lo, hi in zip([0, *cut], [*cut, len(cell)], strict=True):
            if hi == lo:
                continue
            if cell[lo] != now and held:
                yield now, *(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            now = cell[lo]
            held.append((batch.column(1).to_numpy()[lo:hi].astype(np.uint64), batch.column(2).to_numpy()[lo:hi].astype(float)))
    if held:
        yield now, *(np.concatenate(c) for c in zip(*held, strict=True))


def gram_values(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`counts` (gram, n; one row a gram) -> (gram, value): log10 of the probability of the gram's byte, in billionths."""
    spark = counts.sparkSession
    counts = written(counts, "grams")
    # a cell has the last two bytes of context in common, so at most 256 ** (depth - 1) grams
    cells = counts.select(F.shiftright("gram", 8 * (depth - 1)).alias("cell"), "gram", "n").repartition("cell").sortWithinPartitions("cell", "gram")

    def up(batches):
        for _, gram, n in _by_cell(batches):
            nodes = climb(gram, n, depth, 2)[0][-1][0]
            whole = np.floor(nodes.weighted)
            key = nodes.key >> np.uint64(16) << np.uint64(8) | nodes.key & np.uint64(255)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, nodes.zeros, nodes.ones, whole, np.rint((nodes.weighted - whole) * UNIT))], names=["key", "zeros", "ones", "whole", "part"])

    nodes = cells.mapInArrow(up, "key long, zeros long, ones long, whole long, part long")
    # at most 256 x 255 nodes of depth 1, whatever the corpus; whole numbers, so that reruns agree
    rows = nodes.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "whole", "part")]).collect()
    told = spark.sparkContext.broadcast(shallow([(r["key"], r["zeros"], r["ones"], r["whole"] + r["part"] / UNIT) for r in rows]))

    def down(batches):
        for _, gram, n in _by_cell(batches):
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(code_values(gram, n, depth, 2, *told.value))], names=["gram", "value"])

    return written(cells.mapInArrow(down, "gram long, value long"), "values")


def with_scores(docs: DataFrame, train: Column, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """`docs` without its text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    The model learns from the documents for which `train` holds (null counts as true) and scores all.
    Texts are whole; A-Z count as lower case; tokens are the words and one end.  `score` is the log10
    probability of the text's words, one blank between, and the end, byte by byte; `bits_per_byte` is its
    code length per byte.  `base_score` adds log10((c + 1) / (N + V + 1)) over the tokens, where c is the
    token's count, N that of all and V that of distinct tokens in training (`train_tokens` is N);
    `n_known` counts tokens with c > 0.  Null and empty texts have just the end.  Equal texts have equal
    scores, repeated rows count as often as they come.  Without training documents all estimates are
    even.  An empty table gives no rows; input columns named like an output are replaced.  `depth` is
    from 2 to 6.
    """
    docs = without(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "__train", "__row", "__chunk", "__data")
    texts, kept = _prepared(docs, train, text)
    seen = _seen(texts, depth)
    chunks, ends = texts.agg(F.count_distinct("__chunk"), F.count_if(F.col("__train"))).first()
    values = gram_values(seen.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), depth)
    words = written(seen.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    known, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, base = known + ends, np.log10(known + ends + distinct + (ends > 0) + 1)

    # by kind: 0 a gram and its value, 1 a word and its count, 2 a text and its row
    def rows(df, kind, key, number, data):
        return df.select("chunk", F.lit(kind).alias("kind"), key.cast("long").alias("key"), number.cast("long").alias("number"), data.cast("binary").alias("data"))

    gram_rows = rows(seen.filter("gram is not null").select("chunk", "gram").join(values, "gram"), 0, F.col("gram"), F.col("value"), F.lit(None))
    # a word that is not sent has count 0
    word_rows = rows(seen.filter("word is not null").select("chunk", "word").join(words.filter("c > 0"), "word"), 1, F.lit(None), F.col("c"), F.col("word"))
    text_rows = rows(texts.withColumn("chunk", F.col("__chunk")), 2, F.col("__row"), F.lit(None), F.col("__data"))
    met = gram_rows.unionByName(word_rows).unionByName(text_rows).repartition(max(chunks, 1), "chunk").sortWithinPartitions("chunk", "kind", "key")

    def score(batches):
        now, keys, codes, counts = None, [], [], {}
        for batch in batches:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turn = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *turn], [*turn, len(chunk)], strict=True):
                if hi == lo:
                    continue
                if chunk[lo] != now:
                    now, keys, codes, counts = chunk[lo], [], [], {}
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    keys.append(part.column(2).to_numpy().astype(np.uint64)), codes.append(part.column(3).to_numpy())
                elif kind[lo] == 1:
                    counts.update(zip(part.column(4).to_pylist(), part.column(3).to_pylist(), strict=True))
                else:
                    keys, codes = [np.concatenate(keys)], [np.concatenate(codes)]
                    yield from told(part, keys[0], codes[0], counts)

    def told(batch, keys, codes, counts):
        for group, part in text_groups([batch.select([2, 4])]):
            if len(group) == 1:
                scores = [sum(int(codes[np.searchsorted(keys, code)].sum()) for code in long_grams(group[0], depth))]
            else:
                ends = np.cumsum([len(t) for t in group])
                scores = np.add.reduceat(codes[np.searchsorted(keys, grams(group, depth))], np.concatenate(([0], ends[:-1])))
            lines = []
            for data in group:
                n, heard, logs = 1, int(ends_known), float(np.log10(end_count + 1))
                for piece in pieces(data):
                    own = piece.split()
                    c = np.fromiter(map(counts.get, own, repeat(0)), np.int64, len(own))
                    n, heard, logs = n + len(own), heard + int((c > 0).sum()), logs + float(np.log10(c + 1).sum())
                lines.append((n, heard, logs - n * base))
            n, heard, logs = zip(*lines, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(heard, pa.int64()), pa.array(logs, pa.float64()), pa.array([int(s) for s in scores], pa.int64()), pa.array([len(t) for t in group], pa.int64())],
                                             names=["__row", "n_tokens", "n_known", "base_score", "nano", "bytes"])

    end_count, ends_known, base = ends, ends > 0, float(base)
    scored = written(met.mapInArrow(score, "__row long, n_tokens long, n_known long, base_score double, nano long, bytes long"), "scored")
    out = texts.select(*[F.col(f"`{c}`") for c in kept], "__row").join(scored, "__row")
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score",
                      (F.col("nano") / UNIT).alias("score"), (-F.col("nano") / UNIT * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"))
