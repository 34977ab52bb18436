import io
import struct
import zipfile
import zlib

import pytest
from pyarrow import fs as pafs

from leafstack.llm import warc as W
from leafstack.llm.queries.warc import op6_warc


def plain(rows, least=0):
    first = {}
    for r, (page, _, html) in enumerate(rows):
        key = (page is None, page or 0, r)
        body = (html or "").encode()
        first[body] = min(first.get(body, key), key)
    out = []
    for r, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        revisit = len(body) >= least and first[body][2] != r
        out.append((page, len(body), W.digest_of(body), "revisit" if revisit else "response", (None if first[body][0] else first[body][1]) if revisit else None))
    return sorted(map(str, out))


ROWS = ([(i, f"http://h.example/{i}?q=a b", f"<p>page {i % 37}</p>" * (i % 5)) for i in range(300)]
        + [(400, None, None), (401, "", ""), (402, "http://x/\r\nEvil: 1", "é ☃\r\n\r\nbody\r\n\r\n"), (None, "u", "no id"), (None, "u", "no id"), (5, "dup", "<p>page 5</p>" * 0), (403, "big", "x" * 400_000)])


def test_query(spark, documents):
    folder = documents(ROWS, "pages", "page_id long, url string, html string", parts=1)
    assert sorted(str(tuple(r)) for r in op6_warc(spark, folder).collect()) == plain(ROWS)


def test_payloads_and_small_archives(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/t") or spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 5000)
    manifest = W.write_archives(df, f"file://{tmp_path}/out", least_bytes=20)
    assert manifest.count() > 3
    got = W.read_records(W.archive_index(manifest)).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == plain(ROWS, 20)
    bodies = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(bodies[i] == (h or "").encode() for i, _, h in ROWS if i in bodies and i not in (5, None))
    one = next(m.path for m in manifest.collect())
    with zipfile.ZipFile(one.removeprefix("file://")) as z:  # other tools can read it
        assert z.testzip() is None and z.namelist() == [W.DATA, W.INDEX]
        plainly = zlib.decompressobj(31).decompress(z.read(W.DATA))
        assert plainly.startswith(b"WARC/1.1\r\nWARC-Type: ")


@pytest.mark.parametrize("wide", [False, True])
def test_other_zip_files(wide):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k in range(3):
            with z.open(zipfile.ZipInfo(f"é{k}.bin"), "w", force_zip64=wide) as f:
                f.write(bytes([k]) * 1000)
        z.writestr("packed", "a" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    data = raw.getvalue()
    members = W.zip_members(len(data), lambda at, n: data[at:at + n])
    assert [m["name"] for m in members] == ["é0.bin", "é1.bin", "é2.bin", "packed"] and members[3]["method"] == 8
    for k, m in enumerate(members[:3]):
        assert data[m["data"]:m["data"] + m["size"]] == bytes([k]) * 1000
    with pytest.raises(ValueError):
        W.zip_members(100, lambda at, n: bytes(n))


def test_zip64_directory():
    out = io.BytesIO()
    z = W.ZipWriter(out)
    for name in ("a", "b"):
        z.begin(name)
        z.write(name.encode() * 10)
        z.end()
    z.close()
    data = out.getvalue()
    assert struct.unpack_from("<I", data, len(data) - 6)[0] == W.FULL32
    assert [(m["name"], data[m["data"]:m["data"] + m["size"]]) for m in W.zip_members(len(data), lambda at, n: data[at:at + n])] == [("a", b"a" * 10), ("b", b"b" * 10)]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string, Path string")
    manifest = W.write_archives(df)
    assert manifest.collect() == [] and W.read_records(W.archive_index(manifest)).collect() == []
    assert pafs.FileSystem.from_uri(f"file://{tmp_path}")
