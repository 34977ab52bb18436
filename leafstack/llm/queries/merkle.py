"""Query of the Merkle manifest, with its SQL."""

from pyspark.sql import functions as F

from ..common import only
from ..merkle import leaf_hash, manifest
from ..registry import query, table

# CRC-32 bit by bit, the trees level by level, and every leaf's walk to the root
SQL = """
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS s FROM documents),
crc AS (SELECT r, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM d WHERE doc_id IS NOT NULL
  UNION ALL SELECT r, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT r, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE i < 8 * length(s))),
odd AS (SELECT r, c & 1 AS low FROM crc WHERE i = 8 * length(s)),
t AS (SELECT d.*, CASE WHEN low = 1 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM d LEFT JOIN odd USING (r)),
h AS (SELECT r, doc_id, source, concat(coalesce(strlen(s) || ':' || s, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
  coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, text, tampered FROM t),
leaf AS (SELECT r, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS changed FROM h),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf),
tree AS (SELECT g, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL SELECT g, any_value(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, pos // 3),
subs AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS digest, n FROM subs
  UNION ALL SELECT any_value(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY pos // 3),
runs AS (SELECT g, level, pos // 3 AS parent, list(digest ORDER BY pos) AS kids FROM tree WHERE n > 1 GROUP BY ALL),
tops AS (SELECT level, pos // 3 AS parent, list(digest ORDER BY pos) AS kids FROM top WHERE n > 1 GROUP BY ALL),
up AS (SELECT r, g, 0 AS level, pos, changed AS value, '' AS proof FROM placed
  UNION ALL SELECT r, up.g, up.level + 1, pos // 3, sha256(array_to_string(kids[:pos % 3], '') || value || array_to_string(kids[pos % 3 + 2:], '')),
    proof || array_to_string(kids[:pos % 3], '') || array_to_string(kids[pos % 3 + 2:], '') FROM up JOIN runs ON runs.g = up.g AND runs.level = up.level AND parent = pos // 3),
mid AS (SELECT r, g, value, proof FROM up QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
over AS (SELECT r, 0 AS level, subs.pos, value, proof FROM mid JOIN subs USING (g)
  UNION ALL SELECT r, over.level + 1, pos // 3, sha256(array_to_string(kids[:pos % 3], '') || value || array_to_string(kids[pos % 3 + 2:], '')),
    proof || array_to_string(kids[:pos % 3], '') || array_to_string(kids[pos % 3 + 2:], '') FROM over JOIN tops ON tops.level = over.level AND parent = pos // 3),
done AS (SELECT r, value, proof FROM over QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
root AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, value AS folded_root, value = root AS verified FROM placed JOIN done USING (r) JOIN subs USING (g), root
"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark, sf):
    """Every document's leaf, proof and subroot, and the root that it folds to once the line feeds of every other text are lost."""
    docs = table(spark, sf, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = only(docs, doc_id=F.col("doc_id"), source=F.col("source"), leaf=leaf_hash(*fields, F.col("text")), changed=leaf_hash(*fields, tampered))
    return manifest(leaves).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
