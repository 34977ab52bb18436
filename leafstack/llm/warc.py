"""WARC records in ZIP-packaged archives: written in streams, read back by ranges.

An archive is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member
per record, and `indexes/index.cdxj`, one line per record.  A reader parses the central directory
(ZIP64 too), finds both members, and then fetches single records by offset and length; nothing is
extracted.  Files are reached through `pyarrow.fs`, so the folder may be local and shared, or an
object store.
"""

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, shared_folder, written

# An archive is closed at this size; index entries are dealt to readers by spans of this size.
ARCHIVE_BYTES, SPAN_BYTES = 1 << 30, 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the ZIP format: signatures and the fields behind them.
LOCAL, CENTRAL, DESCRIPTOR = b"PK\3\4", b"PK\1\2", b"PK\7\x08"
END, END64, LOCATOR64 = b"PK\5\6", b"PK\6\6", b"PK\6\7"
LOCAL_FIELDS, CENTRAL_FIELDS = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I")
END_FIELDS, END64_FIELDS, LOCATOR64_FIELDS = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class ZipWriter:
    """Stored members into a stream that is only appended to; always with ZIP64 sizes and directory."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def begin(self, name: str) -> None:
        self.name, self.start = name.encode(), self.at
        extra = struct.pack("<2H2Q", 1, 16, 0, 0)
        self.crc = 0
        self.write(LOCAL_FIELDS.pack(LOCAL, 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(self.name), len(extra)) + self.name + extra)
        self.crc, self.data = 0, self.at

    def end(self) -> None:
        size, crc = self.at - self.data, self.crc
        self.write(struct.pack("<4sI2Q", DESCRIPTOR, crc, size, size))
        self.members.append((self.name, self.start, size, crc))

    def close(self) -> None:
        start = self.at
        for name, at, size, crc in self.members:
            extra = struct.pack("<2H3Q", 1, 24, size, size, at)
            self.write(CENTRAL_FIELDS.pack(CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        size, n = self.at - start, len(self.members)
        end64 = self.at
        self.write(END64_FIELDS.pack(END64, END64_FIELDS.size - 12, 45, 45, 0, 0, n, n, size, start))
        self.write(LOCATOR64_FIELDS.pack(LOCATOR64, 0, end64, 1))
        self.write(END_FIELDS.pack(END, 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 0))


def zip_members(size: int, read) -> list[dict]:
    """Members of a ZIP file of `size` bytes, of which read(offset, length) gives any range: name, method, sizes, and where its data begins."""
    tail_at = max(0, size - END_FIELDS.size - FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + END_FIELDS.size > len(tail) or at + END_FIELDS.size + END_FIELDS.unpack_from(tail, at)[-1] > len(tail)):
        at = tail.rfind(END, 0, at)  # those bytes stood in a comment
    if at < 0:
        raise ValueError("no ZIP directory")
    *_, count, length, start, _ = END_FIELDS.unpack_from(tail, at)
    at += tail_at
    if FULL16 == count or FULL32 in (length, start):
        locator = read(at - LOCATOR64_FIELDS.size, LOCATOR64_FIELDS.size) if at >= LOCATOR64_FIELDS.size else b""
        if locator[:4] == LOCATOR64:
            *_, count, length, start = END64_FIELDS.unpack(read(LOCATOR64_FIELDS.unpack(locator)[2], END64_FIELDS.size))
    directory, at, out = read(start, length), 0, []
    for _ in range(count):
        sign, _, _, flags, method, _, _, crc, packed, full, names, extras, notes, *_, offset = CENTRAL_FIELDS.unpack_from(directory, at)
        if sign != CENTRAL:
            raise ValueError("damaged ZIP directory")
        at += CENTRAL_FIELDS.size
        name = directory[at:at + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + names:at + names + extras], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, k)
            if kind == 1:  # the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            k += 4 + n
        at += names + extras + notes
        local = LOCAL_FIELDS.unpack(read(offset, LOCAL_FIELDS.size))
        out.append({"name": name, "method": method, "size": full, "packed": packed, "crc": crc, "data": offset + LOCAL_FIELDS.size + local[-2] + local[-1]})
    return out


def _header(name: str, value) -> bytes:
    # control characters would end the line
    return f"{name}: {re.sub(r'[\x00-\x20\x7f]', lambda m: quote(m[0]), str(value))}\r\n".encode()


def record_id(page, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {row}')}>"


def warc_record(page, row, url, payload: bytes, digest: str, first: tuple | None) -> bytes:
    """A gzip member with one record; with `first`, the (page, row) of the response, a revisit, which keeps only the HTTP head."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page, row)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", url)] if url is not None else []
    head += [("WARC-Page-ID", page)] if page is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        block += payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*first))]
        head += [("WARC-Refers-To-Page-ID", first[0])] if first[0] is not None else []
    lines = b"".join(_header(n, v) for n, v in head) + b"Content-Type: application/http; msgtype=response\r\n" + f"Content-Length: {len(block)}\r\n".encode()
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse_record(data: bytes) -> tuple[dict, dict, bytes]:
    """Lower-cased WARC headers, HTTP headers, and the HTTP body of a record's gzip member."""
    plain = zlib.decompressobj(31).decompress(data)
    top, _, rest = plain.partition(b"\r\n\r\n")
    pairs = lambda lines: {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    head = pairs(top.split(b"\r\n")[1:])
    block = rest[:int(head["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return head, pairs(http.split(b"\r\n")[1:]), body


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record for every row of `pages` and give the manifest (path, bytes, records), one row per archive.

    The payload is the UTF-8 text, empty if null.  Of rows with equal payloads of at least
    `least_bytes` bytes the one with the smallest id (null last, then the first row) is a response
    and the others are revisits of it; all others are responses.  Tasks stream to files whose names
    hold the attempt, and only finished attempts get into the manifest, so repeated or lost tasks do
    no harm.  Only digests that occur twice are joined back; texts move only if those are too many to broadcast.
    Rows are numbered once, and the numbers are written with them.  An empty table gives an empty
    manifest; other columns play no part.
    """
    folder = f"{(folder or shared_folder(pages.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    keyed = written(pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{page_id}`").alias("page"), F.col(f"`{url}`").alias("url"),
                                 payload.alias("payload"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha1")), "pages")
    order = F.struct(F.col("page").isNull().alias("none"), F.col("page").alias("page"), F.col("row").alias("row"))
    firsts = written(keyed.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("sha1", F.col("first.page").alias("first_page"), F.col("first.row").alias("first_row")), "firsts")
    marked = keyed.join(beside(firsts, 64), "sha1", "left").select("row", "page", "url", "sha1", "first_page", "first_row", (F.octet_length("payload") >= least_bytes).alias("counts"), "payload")

    def write(batches):
        task, k, out, zipped = TaskContext.get(), 0, None, None

        def close():
            zipped.end()
            zipped.begin(INDEX)
            zipped.write("".join(lines).encode())
            zipped.end()
            zipped.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([zipped.at]), pa.array([len(lines)])], names=["path", "bytes", "records"])

        for batch in batches:
            for row, page, link, sha1, first_page, first_row, counts, text in zip(*batch.columns, strict=True):
                if out is None:
                    store, place = pafs.FileSystem.from_uri(folder)
                    store.create_dir(place, recursive=True)
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.wacz"
                    out, k = store.open_output_stream(pafs.FileSystem.from_uri(path)[1], buffer_size=1 << 20), k + 1
                    zipped, lines = ZipWriter(out), []
                    zipped.begin(DATA)
                row, page, link = row.as_py(), page.as_py(), link.as_py()
                again = counts.as_py() and first_row.as_py() is not None and first_row.as_py() != row
                digest = base64.b32encode(sha1.as_py()).decode()
                record = warc_record(page, row, link, text.as_py().encode(), digest, (first_page.as_py(), first_row.as_py()) if again else None)
                entry = {"offset": zipped.at - zipped.data, "length": len(record), "digest": digest, "page": page}
                lines.append(f"{quote(link or '-', safe=':/?&=%')} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}\n")
                zipped.write(record)
                if zipped.at >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(marked.mapInArrow(write, "path string, bytes long, records long"), "manifest")


def archive_index(manifest: DataFrame) -> DataFrame:
    """`manifest` (path) -> a row per record: path, where in the file it lies (`at`, `length`), and its index line as `entry`."""
    def index(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    read = lambda at, n, f=f: f.read_at(n, at)
                    members = {m["name"]: m for m in zip_members(f.size(), read)}
                    for m in members.values():
                        if m["method"] and m["name"] in (DATA, INDEX):
                            raise ValueError(f"{path}: {m['name']} is not stored")
                    lines = read(members[INDEX]["data"], members[INDEX]["size"]).decode().splitlines()
                entries = [line.split(" ", 2)[2] for line in lines]
                spans = [(e["offset"] + members[DATA]["data"], e["length"]) for e in map(json.loads, entries)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64()), pa.array(entries, pa.string())],
                                                 names=["path", "at", "length", "entry"])

    tasks = manifest.select("path").repartition("path")
    return tasks.mapInArrow(index, "path string, at long, length long, entry string")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records at the index's ranges: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for, `payload`.

    Records next to each other go to one task, which fetches each by its range.  Bytes and digest
    of a response are those of the payload read; a revisit has none (null) and gives what its head
    says of it.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    names = [c.split()[0] for c in schema.split(", ")]

    def fetch(batches):
        path, f = None, None
        for batch in batches:
            rows, held = [], 0

            def out(rows=rows):
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

            for name, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != path:
                    if f is not None:
                        f.close()
                    store, place = pafs.FileSystem.from_uri(name)
                    path, f = name, store.open_input_file(place)
                head, http, body = parse_record(f.read_at(length, at))
                number = lambda key, head=head: int(head[key]) if key in head else None
                revisit = head["warc-type"] == "revisit"
                size, digest = (int(http["content-length"]), head["warc-payload-digest"].partition(":")[2]) if revisit else (len(body), digest_of(body))
                rows.append((number("warc-page-id"), head.get("warc-target-uri"), head["warc-type"], number("warc-refers-to-page-id"), size, digest, *([None if revisit else body] * payload)))
                held += len(body) * payload
                if held >= SPAN_BYTES:
                    yield out()
                    rows.clear()
                    held = 0
            if rows:
                yield out()
        if f is not None:
            f.close()

    spans = index.select("path", "at", "length").repartition("path", F.expr(f"at div {SPAN_BYTES}")).sortWithinPartitions("path", "at")
    return spans.mapInArrow(fetch, schema)
