import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from leafstack.llm import jpeg as J
from leafstack.llm.queries.jpeg import op8_jpeg_media

# DC and AC code lengths (counts, symbols) of a small table of our own.
DC = {s: 4 for s in range(12)}
AC = {s: 8 for s in [0x00, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 11))]}


def slow_jpeg(width, height, parts, coefficients, restart=0, quant=2, comment=None):
    """Straight from the format: parts are (across, down) factors, coefficients[mcu][block] in zigzag order."""
    out, bits, told, marker = bytearray(), "", [0] * len(parts), 0
    layout = [0] if len(parts) == 1 else [k for k, (h, v) in enumerate(parts) for _ in range(h * v)]
    dc_body, dc = J._canonical(DC)
    ac_body, ac = J._canonical({**dict.fromkeys(AC, 9), 0x00: 3, 0x01: 3, 0xF0: 4})
    def number(v):  # noqa: E306
        n = abs(v).bit_length()
        return n, (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            out.append(int(bits[k:k + 8], 2))
            if out[-1] == 0xFF:
                out.append(0)
        bits = ""

    for m, mcu in enumerate(coefficients):
        if restart and m and m % restart == 0:
            flush()
            out.extend([0xFF, 0xD0 + marker % 8])
            marker, told = marker + 1, [0] * len(parts)
        for c, block in zip(layout, mcu, strict=True):
            n, raw = number(block[0] - told[c])
            told[c] = block[0]
            bits += f"{dc[n][0]:0{dc[n][1]}b}{raw}"
            run = 0
            for v in block[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += f"{ac[0xF0][0]:0{ac[0xF0][1]}b}"
                    run -= 16
                n, raw = number(v)
                code = ac[run << 4 | n]
                bits, run = bits + f"{code[0]:0{code[1]}b}{raw}", 0
            if run:
                bits += f"{ac[0][0]:0{ac[0][1]}b}"
    flush()
    head = b"\xff\xd8" + J._segment(0xE0, b"JFIF\0junk") + (J._segment(0xFE, comment) if comment else b"") + J._segment(0xDB, b"\0" + bytes([quant]) * 64)
    head += J._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(parts)))
    head += J._segment(0xC4, b"\x01" + dc_body + b"\x12" + ac_body) + (J._segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    head += J._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([k + 1, 0x12]) for k in range(len(parts))) + b"\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("parts,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_decodes_any_baseline(parts, restart):
    rng = random.Random(len(parts) + restart)
    width, height = 83, 41
    h, v = (max(p[k] for p in parts) if len(parts) > 1 else 1 for k in (0, 1))
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    per = sum(a * b for a, b in parts) if len(parts) > 1 else 1
    block = lambda: [rng.randint(-500, 500)] + [rng.choice([0, 0, 0, 0, 0, 0, rng.randint(-1000, 1000)]) * (i < 50) for i in range(63)]
    want = [[block() for _ in range(per)] for _ in range(across * down)]
    files = [slow_jpeg(width, height, parts, want, restart)] * 2
    for image, blocks in J.decode(files):
        assert (image.width, image.height) == (width, height)
        assert (blocks == np.array(want).reshape(-1, 64)).all()
        grey = J.thumbnail(image, blocks)
        assert grey.shape == (6, 11)
        y, x = 3, 5  # by hand: MCU and block that hold this pixel
        mcu = want[y // v * across + x // h][(y % v) * h + x % h if len(parts) > 1 else 0]
        assert grey[y, x] == min(max(round(mcu[0] * 2 / 8 + 128), 0), 255)


def test_round_trip():
    rng = np.random.default_rng(0)
    payloads = [bytes(64), b"\xff" * 128, J.payload_of("naïve text, " .encode() * 300), J.payload_of(b""), rng.integers(0, 256, 64 * 301, dtype=np.uint8).tobytes(),
                b"".join(bytes([1]) + bytes(40) + bytes([200]) + bytes(21) + bytes([k]) for k in range(90)), J.payload_of(b"a" * 100_000)]
    files = J.encode(payloads)
    for (image, blocks), payload, one in zip(J.decode(files), payloads, files, strict=True):
        assert blocks.ravel()[:len(payload)].astype(np.uint8).tobytes() == payload
        assert image.width * image.height >= len(payload) and image.comment == b"bytes=%d" % len(payload)
        assert J.encode([payload]) == [one]


def test_query(spark, documents):
    texts = [None, "", "a", "é" * 31 + "xx", "é" * 32, "x" * 65, "word " * 30_000, "\0\0 null bytes \0" * 9] + [f"text {i} " * (i % 60) for i in range(200)] + ["same"] * 5
    data = [(i if i != 9 else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = op8_jpeg_media(spark, documents(data)).collect()
    want = []
    for i, t, *_ in data:
        payload = J.payload_of((t or "").encode())
        want.append((i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(str(tuple(r)[:5]) for r in out) == sorted(map(str, want))
    same = {(r.payload_sha256): {x[5:] for x in out if x.payload_sha256 == r.payload_sha256} for r in out}
    assert all(len(v) == 1 for v in same.values())
    assert all(r.media_bytes > 0 and r.feature.split("x")[0].isdigit() for r in out)


def test_damaged_and_missing(spark):
    good = J.encode([J.payload_of(b"fine")])[0]
    df = spark.createDataFrame([(1, good, "p"), (2, None, "p"), (3, b"no", "p"), (4, good[:-20], "p"), (5, good.replace(b"\xff\xc0", b"\xff\xc2"), "p"), (6, slow_jpeg(8, 8, [(1, 1)], [[[5] + [0] * 63]]), "p")],
                               "k int, media binary, Payload string")
    rows = {r.k: r for r in J.with_features(df).collect()}
    assert rows[1].payload[:4] == b"fine" and rows[6].width == 8 and rows[6].payload is None
    assert all(rows[k].width is None and rows[k].thumbnail_hash is None for k in (2, 3, 4, 5))
    assert J.with_media(df.limit(0).selectExpr("string(k) text")).collect() == []


def test_long_payloads_in_runs(monkeypatch):
    rng = np.random.default_rng(6)
    text = " ".join("".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(60_000)).encode()
    payloads = [J.payload_of(x) for x in (text, b"short", text[:70_000] + bytes(range(256)) * 40, b"")]
    whole = J.encode(payloads)
    monkeypatch.setattr(J, "RUN", 128)
    assert J.encode(payloads) == whole
    monkeypatch.setattr(J, "LANES", 5)
    for p, (_, blocks) in zip(payloads, J.decode(whole), strict=True):
        assert blocks.ravel()[:len(p)].astype(np.uint8).tobytes() == p


def test_memory_of_a_long_text():
    text = J.payload_of(b"some long text with words, " * 400_000)  # 11 MB
    tracemalloc.start()
    [file] = J.encode([text])
    assert tracemalloc.get_traced_memory()[1] < 9 * len(text)
    tracemalloc.reset_peak()
    [(_, blocks)] = J.decode([file])
    assert tracemalloc.get_traced_memory()[1] < 9 * len(text)
    tracemalloc.stop()
    assert blocks.ravel()[:len(text)].astype(np.uint8).tobytes() == text
