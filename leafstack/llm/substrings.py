"""Removal of repeated passages, with a count-min prefilter.

A window is `window` consecutive words.  Pass one counts windows in a count-min sketch: every
partition sends its own sketch, as sorted cells per block, and the blocks are merged by adding.
A window is counted by its anchors, the words that hold the least hash of GRAM words inside it:
equal windows have equal anchors at different places, so the sketch can only overestimate, and it
gets one entry for some fifteen windows.  Pass two groups exactly, by a 128-bit hash of their
words, only those windows whose estimate is two or more.  The merged sketch is one bit per cell
(repeated or not), of a size that follows the input up to MAX_CELLS; beyond that, or for skewed
texts, it lets more windows through to the exact pass, and never loses one.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, text_groups, text_key, without, written

GRAM = 8
# Cells of the sketch: one for this many bytes of text, in ROWS rows of a power of two.
BYTES_PER_CELL, ROWS = 8, 2
LEAST_CELLS, MAX_CELLS = 1 << 17, 1 << 30
BLOCK = 1 << 16
# Text hashed at once, anchors that a task holds, and windows in an output batch.
PIECE, HELD, BATCH = 1 << 18, 1 << 18, 1 << 16

BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of BASE and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(max(n, 2), base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end]; it depends on the values alone."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of `data`, which ends with white space; works through it in pieces."""
    out, at = [], 0
    raw = np.frombuffer(data, np.uint8)
    blank = SPACES[raw]
    gaps = np.flatnonzero(blank)
    while at < len(raw):
        # up to the last white space within the piece, or the first one after it
        k = np.searchsorted(gaps, at + PIECE)
        end = gaps[k - 1] + 1 if k and gaps[k - 1] >= at else gaps[k] + 1
        edge = np.diff(blank[at:end].astype(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out.append((starts + at, ends + at, runs_hashed(raw[at:end].astype(np.uint64) + np.uint64(1), starts, ends)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over x[i:i + width]."""
    done, size = x, 1
    while 2 * size <= width:
        done = of(done[:-size], done[size:])
        size *= 2
    return of(done[:len(done) - (width - size)], done[width - size:]) if width > size else done


class Windows:
    """The windows of some texts: word places, least gram hash per window start, and anchor hashes."""

    def __init__(self, texts: list[bytes], window: int):
        gram = min(GRAM, window)
        self.data, self.joined = b"\n".join(texts) + b"\n", None
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ends, hashes = words_of(self.data)
        self.first = np.searchsorted(starts, at)  # word numbers at which the texts begin
        self.size = ends - starts
        n, span = len(starts), window - gram + 1
        self.start, self.least, self.anchors = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if n < window:
            return
        k = np.arange(n - gram + 1)
        grams = runs_hashed(hashes, k, k + gram)
        least = sliding(grams, span, np.minimum)
        last = np.repeat(self.first[1:], np.diff(self.first))[:len(least)]
        whole = np.arange(len(least)) + window <= last
        self.start = np.flatnonzero(whole)
        self.least = least[whole]
        # a gram is an anchor if it is the least of some whole window around it
        pad = np.zeros(span - 1, np.uint64)
        most = sliding(np.concatenate([pad, np.where(whole, least, np.uint64(0)), pad]), span, np.maximum)
        self.anchors = grams[most == grams]

    def digests(self, starts: np.ndarray, window: int) -> np.ndarray:
        """128-bit hashes of the words of the windows at `starts`, as two columns."""
        if self.joined is None:
            self.joined = b" ".join(self.data.split())
        joined, end = self.joined, np.cumsum(self.size + 1) - 1
        begin = (end - self.size)[starts].tolist()
        end = end[starts + window - 1].tolist()
        digest = xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(begin, end, strict=True)]), "<i8").reshape(-1, 2)


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each value in a row of 2**bits cells."""
    return (mixed(values + np.uint64(row * BASE & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_cells(texts: DataFrame, window: int, bits: int) -> np.ndarray:
    """The merged sketch over `texts` (one text column): for ROWS rows of 2**bits cells, packed bits of the cells counted twice or more."""
    def sketch(batches):
        held, n = [], 0

        def send():
            for row in range(ROWS):
                cell, count = np.unique(cells(np.concatenate(held), row, bits), return_counts=True)
                cell = np.repeat(cell, np.minimum(count, 2))  # two is as good as many
                block, first = np.unique(cell // BLOCK, return_index=True)
                low = (cell % BLOCK).astype("<u2")
                parts = [x.tobytes() for x in np.split(low, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(block + (row << bits) // BLOCK), pa.array(parts, pa.binary())], names=["block", "cells"])

        for group, _ in text_groups(batches):
            anchors = Windows(group, window).anchors
            held.append(anchors)
            n += len(anchors)
            if n >= HELD:
                yield from send()
                held, n = [], 0
        if n:
            yield from send()

    def merge(batches):
        now, count = None, np.zeros(BLOCK, np.int64)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(count >= 2).tobytes()], pa.binary())], names=["block", "twice"])

        for batch in batches:
            for block, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if now is not None and (count >= 2).any():
                        yield done()
                    now, count = block, np.zeros(BLOCK, np.int64)
                count += np.bincount(np.frombuffer(low.as_buffer(), "<u2"), minlength=BLOCK)
        if now is not None and (count >= 2).any():
            yield done()

    merged = (texts.mapInArrow(sketch, "block long, cells binary").repartition("block").sortWithinPartitions("block")
              .mapInArrow(merge, "block long, twice binary"))
    out = np.zeros(ROWS << bits >> 3, np.uint8)
    for r in merged.toLocalIterator():  # at most MAX_CELLS bits in all
        out[r["block"] * (BLOCK >> 3):(r["block"] + 1) * (BLOCK >> 3)] = np.frombuffer(r["twice"], np.uint8)
    return out


def maybe_repeated(values: np.ndarray, twice: np.ndarray, bits: int) -> np.ndarray:
    """False only for values whose count is surely below two."""
    out = np.ones(len(values), bool)
    for row in range(ROWS):
        c = cells(values[out], row, bits) + (row << bits)
        out[out] = twice[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 > 0
    return out


def repeated_spans(texts: DataFrame, window: int = 35) -> DataFrame:
    """`texts` (text) -> (key binary, whole boolean, spans array<struct<lo int, hi int>>).

    One row for each text with a repeated window, by its `text_key`: `spans` are the runs of windows
    (first and last start word) that start anywhere else too, in the same text or another.  `whole`
    marks texts of which there are copies: one of them takes part in the passes, and all of its
    windows are repeated.
    """
    # shorter texts have no window
    long_enough = F.octet_length("text") >= 2 * window - 1
    keyed = texts.filter(long_enough).select(text_key(F.col("text")).alias("key"), "text")
    copied = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "copied")
    firsts = written(keyed.join(beside(copied, 48), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "firsts")
    once = keyed.join(beside(copied, 48), "key", "left_anti").unionByName(firsts)

    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(max(total // BYTES_PER_CELL, LEAST_CELLS), MAX_CELLS)
    bits = max((size // ROWS - 1).bit_length(), 16)
    twice = texts.sparkSession.sparkContext.broadcast(repeated_cells(once.select("text"), window, bits))

    def windows(batches):
        for group, batch in text_groups(batches):
            w = Windows(group, window)
            start = w.start[maybe_repeated(w.least, twice.value, bits)]
            text = np.searchsorted(w.first, start, side="right") - 1
            for k in range(0, len(start), BATCH):
                part = slice(k, k + BATCH)
                high_low = w.digests(start[part], window)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[part])), *(pa.array(x) for x in (
                    (start - w.first[text]).astype(np.int32)[part], high_low[:, 0].copy(), high_low[:, 1].copy()))], names=["key", "pos", "h1", "h2"])

    found = written(once.mapInArrow(windows, "key binary, pos int, h1 long, h2 long"), "windows")
    repeated = written(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    hits = found.join(repeated, ["h1", "h2"], "left_semi").select("key", "pos")
    # of a copied text only `whole` counts
    hits = hits.join(beside(copied, 48), "key", "left_anti")
    runs = (hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("key").orderBy("pos")))
            .groupBy("key", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
            .groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    whole = copied.select("key", F.lit(True).alias("whole"), F.array().cast("array<struct<lo:int,hi:int>>").alias("spans"))
    out = written(whole.unionByName(runs.select("key", F.lit(False).alias("whole"), "spans")), "spans")
    twice.destroy()
    return out


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """All rows of `docs` with `n_words` long, `n_removed` long and `kept_text`.

    Every word is removed that lies in a window whose words also start anywhere else, as judged on
    the input.  `kept_text` has the other words, unchanged, joined by one space.  Null text has no
    words.  Windows may overlap their repeats; equal rows repeat each other.  Rows are told apart by
    their texts alone, so `docs` may come in any order and partitioning at each reading; an empty
    table gives no rows, input columns named like an output are replaced.
    """
    docs = without(docs, "n_words", "n_removed", "kept_text", "__key", "__whole", "__spans", "__text")
    filled = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    spans = repeated_spans(filled.select(F.col("__text").alias("text")), window)
    side = spans.select(F.col("key").alias("__key"), F.col("whole").alias("__whole"), F.col("spans").alias("__spans"))
    joined = filled.withColumn("__key", text_key(F.col("__text"))).join(beside(side, 96), "__key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__whole", "__spans", "__text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def apply(batches):
        for group, batch in text_groups(batches):
            counts, removed, kept = [], [], []
            whole, spans = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2))
            for data, all_, own in zip(group, whole, spans, strict=True):
                parts = data.split()
                left = parts
                if all_ and len(parts) >= window:
                    left = []
                elif own:
                    gone = bytearray(len(parts))
                    for s in own:
                        gone[s["lo"]:s["hi"] + window] = b"\1" * (s["hi"] + window - s["lo"])
                    left = [p for p, g in zip(parts, gone, strict=True) if not g]
                counts.append(len(parts))
                removed.append(len(parts) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return joined.mapInArrow(apply, schema)
