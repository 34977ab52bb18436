"""Best-fit-decreasing packing of token sequences.

Overlong documents are first cut into full windows.  Their rests and the short documents of a block
are placed longest first, each in the open window with the least room that still holds it; a
segment tree over remaining room finds that window.  Blocks live within a task, so nothing is
shuffled and a repeated task packs alike.
"""

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

# Documents and tokens that a task packs together; bounds its memory.
BLOCK_DOCUMENTS = 8192
BLOCK_TOKENS = 8 << 20
# Windows left emptier than this are packed again with the next block.
LOOSE = 0.02


class RoomTree:
    """Counts of open windows by remaining room, under a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows = [[] for _ in range(self.leaves)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def open(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> int:
        """Least remaining room of at least `need`, or -1."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a sibling to the right has windows
                i >>= 1
            if i == 1:
                return -1
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.windows[room].pop()


def best_fit(lengths, capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers; every length is between 1 and `capacity`."""
    tree, windows = RoomTree(capacity), []
    for k in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable").tolist():
        need = lengths[k]
        room = tree.tightest(need)
        if room < 0:
            room, window = capacity, len(windows)
            windows.append([])
        else:
            window = tree.take(room)
        windows[window].append(k)
        if room > need:
            tree.open(room - need, window)
    return windows


# Fixed value of the public vocabulary: its added token.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None):
    """Byte-level BPE from a rank file; without one, that of the public 50k vocabulary, whose one added token is cut out of texts first."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if vocabulary else ADDED)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """All tokens of all documents in sequences of at most `window`, one row per piece.

    Columns: the id, `start` and `length` of the piece in its document's ids, `ids` (little-endian
    unsigned 32-bit), `doc_tokens`, `sequence_id` and `offset` of the piece in its sequence.  A
    document's ids are those of its whole text, then `end_id`; where the text has the string of the
    public vocabulary's added token, it is that token, as in its JSON file.  Null and empty text give that one
    id.  Documents up to `window` are never cut, longer ones only into full windows and a rest.  A
    null id stays null, equal rows are packed one by one, an empty table gives no rows; other
    columns play no part.  `sequence_id` is unique, not dense.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField(doc_id, docs.schema["id"].dataType)] + [
        T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")])
    names = schema.names

    def packed(batches):
        encode, sequence = partial(encoder(vocabulary).encode, allowed_special="all"), (TaskContext.get().partitionId()) << 40
        held, held_tokens = [], 0  # (id, start, ids, doc_tokens)
        rows, rows_bytes = [], 0

        def lay(pieces):
            nonlocal sequence, rows_bytes
            at = 0
            for key, start, ids, total in pieces:
                rows.append((key, start, len(ids), ids.tobytes(), total, sequence, at))
                at += len(ids)
            rows_bytes += 4 * at
            sequence += 1

        def close(last):
            nonlocal held, held_tokens
            loose = []
            for bin_ in best_fit([len(h[2]) for h in held], window):
                pieces = [held[k] for k in bin_]
                if not last and sum(len(p[2]) for p in pieces) < (1 - LOOSE) * window:
                    loose.append(pieces)
                else:
                    lay(pieces)
            keep = sum(map(len, loose)) <= BLOCK_DOCUMENTS // 2 and sum(len(p[2]) for w in loose for p in w) <= BLOCK_TOKENS // 2
            if not keep:
                for pieces in loose:
                    lay(pieces)
                loose = []
            held = [p for w in loose for p in w]
            held_tokens = sum(len(p[2]) for p in held)

        def flush():
            nonlocal rows_bytes
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [id_type, *[pa.binary() if n == "ids" else pa.int64() for n in names[1:]]]
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                rows.clear()
                rows_bytes = 0
                yield out

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(value.as_py() or ""), end_id], dtype="<u4")
                full = len(ids) // window * window
                for start in range(0, full, window):
                    lay([(key, start, ids[start:start + window], len(ids))])
                if full < len(ids):
                    held.append((key, full, ids[full:], len(ids)))
                    held_tokens += len(ids) - full
                if len(held) >= BLOCK_DOCUMENTS or held_tokens >= BLOCK_TOKENS:
                    close(False)
                if rows_bytes >= 4 << 20:
                    yield from flush()
        close(True)
        yield from flush()
        give_back()

    return docs.mapInArrow(packed, schema)
