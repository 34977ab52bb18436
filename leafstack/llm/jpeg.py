"""Baseline JPEG columns in numpy.

Reading: markers are parsed, entropy-coded scans are split at their restart markers, and all
segments of many images are Huffman-decoded side by side, one symbol of each per step.  The DC
values of the first component make a luminance thumbnail of one pixel a block.

Writing: bytes become the quantised coefficients of a grey image, 64 a block in zigzag order, under
a quantisation table of ones; coefficients are coded without loss, so the bytes come back exactly.
"""

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_groups, without

# Blocks between restart markers, and blocks in a row at most.
RESTART, WIDEST = 8, 8191
# Blocks coded at once (whole rounds of the eight restart markers), and segments of a long scan decoded at once.
RUN, LANES = 1 << 13, 1 << 11
# Fixed Huffman tables: symbols by code length.  Letters (7 bits) and other ASCII (6) are the usual case.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {0x07: 1, 0x06: 2, 0x08: 4, 0x04: 5, 0x00: 5} | {
    s: 11 for s in [0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))] if s not in (0x04, 0x06, 0x07, 0x08)}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The body of a DHT segment, and each symbol's (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(lengths[s] == n for s in order) for n in range(1, 17)]
    return bytes(counts) + bytes(order), _codes(counts, order)


def _codes(counts, symbols) -> dict[int, tuple[int, int]]:
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def _lookup(counts, symbols) -> np.ndarray:
    """For every 16 bits ahead: length << 8 | symbol, 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in _codes(counts, symbols).items():
        table[code << (16 - length):(code + 1) << (16 - length)] = length << 8 | symbol
    return table


# ---------------------------------------------------------------- writing

_DC_BODY, _DC_CODES = _canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = _canonical(AC_LENGTHS)
_CODE = {k: np.zeros(256, np.uint64) for k in ("dc", "ac")}
_LENGTH = {k: np.zeros(256, np.int64) for k in ("dc", "ac")}
for _kind, _table in (("dc", _DC_CODES), ("ac", _AC_CODES)):
    for _symbol, (_c, _n) in _table.items():
        _CODE[_kind][_symbol], _LENGTH[_kind][_symbol] = _c, _n
_SIZE = np.array([int(v).bit_length() for v in range(1 << 12)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down for so many blocks; the last row is filled up with zeros."""
    across = min(int(np.ceil(np.sqrt(blocks))), WIDEST)
    return across, -(-blocks // across)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of 64; a comment has the length.

    Long payloads are coded RUN blocks at a time, so memory does not grow with them but for the bytes themselves.
    """
    shapes = [grid(len(p) // 64) for p in payloads]
    scans = [[] for _ in payloads]
    held = []

    def code():
        for (k, _), scan in zip(held, _coded([b for _, b in held]), strict=True):
            scans[k].append(scan)
        held.clear()

    for k, (payload, (across, down)) in enumerate(zip(payloads, shapes, strict=True)):
        for at in range(0, across * down, RUN):
            n = min(RUN, across * down - at)
            held.append((k, np.frombuffer(payload[64 * at:64 * (at + n)].ljust(64 * n, b"\0"), np.uint8).reshape(-1, 64)))
            if sum(len(b) for _, b in held) >= RUN:
                code()
    if held:
        code()
    files = []
    for payload, (across, down), scan in zip(payloads, shapes, scans, strict=True):
        head = (b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % len(payload)) + _segment(0xDB, b"\0" + b"\1" * 64)
                + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * down, 8 * across, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + _DC_BODY)
                + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xDD, struct.pack(">H", RESTART)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])))
        files.append(head + b"\xff\xd7".join(scan) + b"\xff\xd9")
    return files


def _coded(parts: list[np.ndarray]) -> list[bytes]:
    """The scan of each array of blocks, beginning with a restart."""
    size = np.array([len(p) for p in parts])
    blocks = np.concatenate(parts).astype(np.int64)
    first = np.cumsum(size) - size
    number = np.arange(len(blocks)) - np.repeat(first, size)  # of the block in its image
    fresh = number % RESTART == 0

    bits, length = np.zeros((len(blocks), 65), np.uint64), np.zeros((len(blocks), 65), np.int64)
    step = blocks[:, 0] - np.where(fresh, 0, np.concatenate(([0], blocks[:-1, 0])))
    wide = _SIZE[np.abs(step)]
    bits[:, 0] = _CODE["dc"][wide] << wide.astype(np.uint64) | np.where(step < 0, step + (1 << wide) - 1, step).astype(np.uint64)
    length[:, 0] = _LENGTH["dc"][wide] + wide
    row, col = np.nonzero(blocks[:, 1:])
    value = blocks[row, col + 1]
    before = np.where(np.concatenate(([-1], row[:-1])) == row, np.concatenate(([0], col[:-1])), -1)
    run = col - before - 1
    wide = _SIZE[value]
    symbol = (run & 15) << 4 | wide
    zeros, zero_bits = run >> 4, _LENGTH["ac"][0xF0]  # each run of sixteen zeros is a symbol of its own
    skip = np.array([int(f"{_AC_CODES[0xF0][0]:0{zero_bits}b}" * k or "0", 2) for k in range(4)], np.uint64)
    own = _LENGTH["ac"][symbol] + wide
    bits[row, col + 1] = skip[zeros] << own.astype(np.uint64) | _CODE["ac"][symbol] << wide.astype(np.uint64) | value.astype(np.uint64)
    length[row, col + 1] = own + zeros * zero_bits
    short = blocks[:, 63] == 0
    bits[short, 64], length[short, 64] = _CODE["ac"][0], _LENGTH["ac"][0]

    # bit places: a segment begins at a whole byte
    segment = np.cumsum(fresh) - 1
    in_segment = np.bincount(segment, length.sum(axis=1)).astype(np.int64)
    n_bytes = -(-in_segment // 8)
    begin = np.cumsum(n_bytes) - n_bytes
    at = np.cumsum(length.ravel()) - length.ravel()
    at += np.repeat((8 * begin - (np.cumsum(in_segment) - in_segment))[segment], 65)
    bits, length = bits.ravel(), length.ravel()
    there = length > 0
    bits, length, at = bits[there], length[there], at[there]
    word, over = at >> 6, (at & 63) + length - 64
    left = np.where(over <= 0, bits << np.maximum(-over, 0).astype(np.uint64), bits >> np.maximum(over, 0).astype(np.uint64))
    words = np.zeros((int(n_bytes.sum()) >> 3) + 2, np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[starts]] = np.bitwise_or.reduceat(left, starts)
    cut = over > 0
    words[word[cut] + 1] |= bits[cut] << (64 - over[cut]).astype(np.uint64)
    data = words.astype(">u8").view(np.uint8)[:int(n_bytes.sum())].copy()
    data[begin + n_bytes - 1] |= ((1 << (8 * n_bytes - in_segment)) - 1).astype(np.uint8)  # the rest of the byte is ones

    # a zero after each 0xFF, a marker after each segment but an image's last
    full = data == 0xFF
    image = np.searchsorted(first, np.flatnonzero(fresh), side="right") - 1
    inner = np.concatenate((image[1:] == image[:-1], [False]))
    ends = begin + n_bytes - 1
    repeat = 1 + full.astype(np.int64)
    repeat[ends[inner]] += 2
    place = np.cumsum(repeat) - repeat
    out = np.zeros(int(repeat.sum()), np.uint8)
    out[place] = data
    marker = place[ends[inner]] + 1 + full[ends[inner]]
    out[marker], out[marker + 1] = 0xFF, 0xD0 + (number[fresh][inner] // RESTART & 7)
    image_end = [int(place[e] + repeat[e]) for e in ends[~inner]]
    raw = out.tobytes()
    return [raw[lo:hi] for lo, hi in zip([0, *image_end], image_end, strict=False)]


# ---------------------------------------------------------------- reading

@dataclass
class Image:
    """What the markers of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    scan: tuple[int, int] = (0, 0)
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, number) -> (counts, symbols)
    parts: list = field(default_factory=list)  # (id, across, down, quantisation table)
    uses: dict = field(default_factory=dict)  # id -> (DC table, AC table)

    def layout(self) -> list[int]:
        """Component of each block of an MCU."""
        if len(self.parts) == 1:
            return [0]
        return [k for k, (_, h, v, _) in enumerate(self.parts) for _ in range(h * v)]

    def mcus(self) -> tuple[int, int]:
        h, v = (max(p[k] for p in self.parts) if len(self.parts) > 1 else 1 for k in (1, 2))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Image:
    """Markers of a baseline, sequential, 8-bit JPEG with one interleaved scan; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at = Image(), 2
    try:
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4:at + 2 + size], at + 2 + size
            if marker == 0xC0:
                depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                if depth != 8 or not image.width or not image.height:
                    raise ValueError("only 8 bits and known sizes are read")
            elif marker in (*range(0xC1, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1:k + 17]
                    image.tables[body[k] >> 4, body[k] & 15] = (bytes(counts), bytes(body[k + 17:k + 17 + sum(counts)]))
                    k += 17 + sum(counts)
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    image.quant[body[k] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, k + 1)
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xDD:
                image.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                image.comment = bytes(body)
            elif marker == 0xDA:
                if body[0] != len(image.parts):
                    raise ValueError("only one interleaved scan is read")
                image.uses = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                end = data.rfind(b"\xff\xd9")
                image.scan = (at, end if end >= at else len(data))
                return image
            elif marker == 0xD9:
                raise ValueError("no scan")
    except (IndexError, struct.error) as e:
        raise ValueError("damaged JPEG") from e


def decode(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """For each file its markers and its coefficients, one row of 64 per block in scan order."""
    images = [parse(f) for f in files]
    alike = {}
    for k, m in enumerate(images):
        layout = tuple((m.tables[0, m.uses[m.parts[c][0]][0]], m.tables[1, m.uses[m.parts[c][0]][1]], c) for c in m.layout())
        alike.setdefault((layout, m.restart), []).append(k)
    out = [None] * len(files)
    for (layout, restart), own in alike.items():
        for k in [k for k in own if restart and images[k].scan[1] - images[k].scan[0] > LANES * RESTART * 64]:
            own.remove(k)
            out[k] = (images[k], _long_scan(files[k][slice(*images[k].scan)], int(np.prod(images[k].mcus())), layout, restart))
        if not own:
            continue
        for k, blocks in zip(own, _scans([files[k][slice(*images[k].scan)] for k in own], [int(np.prod(images[k].mcus())) for k in own], layout, restart), strict=True):
            out[k] = (images[k], blocks)
    return out


def _long_scan(scan: bytes, mcus: int, layout, restart: int) -> np.ndarray:
    """Blocks of one scan, LANES segments at a time."""
    data = np.frombuffer(scan, np.uint8)
    mark = np.flatnonzero(data[:-1] == 0xFF)
    cuts = mark[data[mark + 1] & 0xF8 == 0xD0]
    begin, end = np.concatenate(([0], cuts + 2)), np.concatenate((cuts, [len(data)]))
    if len(begin) != -(-mcus // restart):
        raise ValueError("segments do not match the restart interval")
    out = np.empty((mcus * len(layout), 64), np.int16)
    for lo in range(0, len(begin), LANES):
        hi = min(lo + LANES, len(begin))
        first, last = lo * restart, min(hi * restart, mcus)
        out[first * len(layout):last * len(layout)] = _scans([scan[begin[lo]:end[hi - 1]]], [last - first], layout, restart)[0]
    return out


def _scans(scans: list[bytes], mcus: list[int], layout, restart: int) -> list[np.ndarray]:
    """Blocks of scans that share tables and layout; the lanes are all their segments."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    origin = np.cumsum([0, *map(len, scans)])
    mark = np.flatnonzero(data[:-1] == 0xFF)
    stuffed = mark[data[mark + 1] == 0] + 1
    cuts = mark[data[mark + 1] & 0xF8 == 0xD0]
    keep = np.ones(len(data), bool)
    keep[stuffed] = keep[cuts] = keep[cuts + 1] = False
    moved = np.concatenate(([0], np.cumsum(keep)))
    plain = data[keep]
    lanes = np.sort(np.concatenate((origin[:-1], cuts + 2)))  # where segments begin
    image = np.searchsorted(origin, lanes, side="right") - 1
    each = np.array(mcus)
    step = restart or int(each.max(initial=1))
    if not np.array_equal(np.bincount(image, minlength=len(scans)), -(-each // step)):
        raise ValueError("segments do not match the restart interval")
    first_lane = np.searchsorted(image, np.arange(len(scans)))
    nth = np.arange(len(lanes)) - first_lane[image]
    per = len(layout)
    count = np.minimum(step, each[image] - nth * step) * per
    first_block = (np.cumsum(each) - each)[image] * per + nth * step * per

    tables = {}
    for dc, ac, _ in layout:
        tables.setdefault(dc, len(tables))
        tables.setdefault(ac, len(tables))
    lookup = np.stack([_lookup(*t) for t in tables]).ravel()
    dc_table = np.array([tables[x[0]] << 16 for x in layout])
    ac_table = np.array([tables[x[1]] << 16 for x in layout])
    part = np.array([x[2] for x in layout])
    padded = np.concatenate((plain, np.full(16, 0xFF, np.uint8))).astype(np.uint64)
    ahead = np.zeros(len(plain) + 8, np.uint64)
    for k in range(8):
        ahead |= padded[k:k + len(ahead)] << np.uint64(56 - 8 * k)

    blocks = np.zeros(int(each.sum()) * per * 64, np.int16)
    place = moved[lanes] * 8  # bit reached
    limit = np.concatenate((place[1:], [8 * len(plain)]))
    base, left, k, nth_block = first_block * 64, count.copy(), np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    told = np.zeros((len(lanes), int(part.max()) + 1), np.int64)
    live = np.flatnonzero(left > 0)
    while len(live):
        p, at = place[live], k[live]
        x = ahead[p >> 3] << (p & 7).astype(np.uint64)
        slot = nth_block[live] % per if per > 1 else 0
        first = at == 0
        entry = lookup[np.where(first, dc_table[slot], ac_table[slot]) + (x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, symbol = entry >> 8, entry & 255
        size = np.where(first, symbol, symbol & 15)
        # the value's bits; a leading 0 means a negative one
        raw = ((x << used.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((raw << 1) >> size > 0, raw, raw - (1 << size) + 1)
        value[size == 0] = 0
        p = p + used + size
        if (used == 0).any() or (p > limit[live]).any():
            raise ValueError("damaged scan")
        place[live] = p
        dc = np.flatnonzero(first)
        if len(dc):
            own, which = live[dc], (part[slot[dc]] if per > 1 else 0)
            told[own, which] += value[dc]
            value[dc] = told[own, which]
        run = np.where(first, 0, symbol >> 4)
        at = at + run
        rest = ~first & (size == 0)
        put = ~rest & (at < 64)
        blocks[base[live[put]] + at[put]] = value[put]
        at = np.where(rest & (run != 15), 64, at + 1)
        done = at >= 64
        at[done] = 0
        k[live] = at
        if done.any():
            own = live[done]
            base[own] += 64
            nth_block[own] += 1
            left[own] -= 1
            live = live[left[live] > 0]
    ends = np.cumsum(each * per)
    return np.split(blocks.reshape(-1, 64), ends[:-1])


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance at one pixel a block, from the DC values of the first component alone."""
    across, down = image.mcus()
    h, v = image.parts[0][1:3] if len(image.parts) > 1 else (1, 1)
    dc = blocks.reshape(down, across, -1, 64)[:, :, :h * v, 0].astype(np.float64).reshape(down, across, v, h)
    grey = np.clip(np.rint(dc.transpose(0, 2, 1, 3).reshape(down * v, across * h) * image.quant[image.parts[0][3]][0] / 8 + 128), 0, 255)
    return grey.astype(np.uint8)[:-(-image.height // 8), :-(-image.width // 8)]


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 samples darker than its right neighbour."""
    rows, cols = ((np.arange(n) * 2 + 1) * s // (2 * n) for n, s in ((8, grey.shape[0]), (9, grey.shape[1])))
    small = grey[rows][:, cols].astype(np.int64)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    """The bytes, filled up with zeros to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `media`: a JPEG whose coefficients are the text's UTF-8 bytes, filled up with zeros to a positive multiple of 64.

    Null text is empty; equal texts give equal media, repeated rows one each.  Very long texts take
    memory for a few copies of their bytes.  An empty table gives no rows; an input column named
    `media` is replaced.
    """
    docs = without(docs, "media", "__text")
    schema = T.StructType([*docs.schema.fields, T.StructField("media", T.BinaryType())])

    def write(batches):
        for group, batch in text_groups(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(encode([payload_of(t) for t in group]), pa.binary())], names=schema.names)

    return docs.withColumn("__text", F.col(f"`{text}`")).mapInArrow(write, schema)


def with_features(rows: DataFrame, media: str = "media") -> DataFrame:
    """`rows` with `width`, `height`, `thumbnail_hash`, and `payload`: the bytes stored as coefficients, where a comment says how many.

    Media that are null or no baseline JPEG give nulls.  Long scans with restart markers are decoded
    in runs.  An empty table gives no rows; input columns named like an output are replaced.
    """
    rows = without(rows, "width", "height", "thumbnail_hash", "payload", "__media")
    new = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("thumbnail_hash", T.StringType()), T.StructField("payload", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields, *new])

    def features(files):
        try:
            found = decode(files)
        except ValueError:  # one is damaged: all but that one
            return [features([f])[0] for f in files] if len(files) > 1 else [(None, None, None, None)]
        out = []
        for image, blocks in found:
            n = int(image.comment[6:]) if image.comment[:6] == b"bytes=" and image.comment[6:].isdigit() else None
            payload = blocks.ravel()[:n].astype(np.uint8).tobytes() if n is not None else None
            out.append((image.width, image.height, thumbnail_hash(thumbnail(image, blocks)), payload))
        return out

    def read(batches):
        for group, batch in text_groups(batches):
            there = [f for f in group if f]
            found = iter(features(there) if there else [])
            columns = zip(*[next(found) if f else (None,) * 4 for f in group], strict=True)
            types = [pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return rows.withColumn("__media", F.col(f"`{media}`")).mapInArrow(read, schema)
