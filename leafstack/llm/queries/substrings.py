"""Query of repeated passages, with its SQL."""

from pyspark.sql import functions as F

from ..common import only
from ..registry import query, table
from ..substrings import remove_repeats

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
x AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM p),
t AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM x SEMI JOIN t USING (k)),
a AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(coalesce(gone, []), i)], ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""


@query("op7_substring_dedup", SQL)
def op7_substring_dedup(spark, sf):
    """Words that windows of 35 words, starting elsewhere too, take from each document."""
    docs = only(table(spark, sf, "documents"), doc_id=F.col("doc_id"), text=F.col("text"))
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
