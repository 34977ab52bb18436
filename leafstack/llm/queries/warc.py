"""Query of WARC archives, with its SQL."""

from ..registry import query, table
from ..warc import archive_index, read_records, write_archives

SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, first_value(r) OVER (PARTITION BY b ORDER BY page_id NULLS LAST, r) AS fr, first_value(page_id) OVER (PARTITION BY b ORDER BY page_id NULLS LAST, r) AS fp FROM p)
SELECT page_id, CAST(octet_length(encode(b)) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN r = fr THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> fr THEN fp END AS refers_to
FROM f
"""


@query("op6_warc", SQL)
def op6_warc(spark, sf):
    """Every page written to ZIP-packaged WARC archives and read back by ranges."""
    manifest = write_archives(table(spark, sf, "pages"))
    return read_records(archive_index(manifest), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
