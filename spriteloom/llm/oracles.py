"""DuckDB SQL of the corpus queries that SQL can express; written from their definitions, not from their plans."""

from __future__ import annotations

from . import line_frequency as L
from . import mixture as M

_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"'[\x20\x09-\x0D]+'"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rowno, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS words, string_split(text, chr(10)) AS parts FROM d),
win AS (SELECT rowno, i, array_to_string(words[i:i + {L.WINDOW - 1}], ' ') AS win FROM (SELECT rowno, words, unnest(range(1, len(words) - {L.WINDOW - 2})) AS i FROM w WHERE len(words) >= {L.WINDOW})),
often AS (SELECT rowno, i FROM (SELECT *, count(*) OVER (PARTITION BY rowno, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT rowno, count(DISTINCT i + k) AS n_repeat FROM often, range({L.WINDOW}) t(k) GROUP BY rowno),
line AS (SELECT rowno, doc_id, host, text, unnest(parts) AS part FROM w),
full_line AS (SELECT *, trim(regexp_replace(regexp_replace(lower(part), '[0-9]+', '0', 'g'), {_SPACE}, ' ', 'g')) AS line, len(regexp_extract_all(part, {_WORD})) AS n FROM line WHERE regexp_matches(part, {_WORD})),
dup AS (SELECT rowno, count(*) - count(DISTINCT part) AS n_dup FROM full_line GROUP BY rowno),
freq AS (SELECT host, line, count(DISTINCT text) AS n_docs, min(doc_id) AS first FROM full_line GROUP BY host, line),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM full_line GROUP BY host),
high AS (SELECT freq.* FROM freq JOIN hosts ON freq.host IS NOT DISTINCT FROM hosts.host WHERE n_docs > greatest({L.LEAST_DOCS}, {L.SHARE} * host_docs)),
lost AS (SELECT rowno, sum(n) AS lost_words, count(*) AS lost_lines FROM full_line f JOIN high h ON f.host IS NOT DISTINCT FROM h.host AND f.line = h.line AND f.doc_id IS DISTINCT FROM h.first GROUP BY rowno),
m AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, {_SPACE}, '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words, CAST(coalesce(lost_lines, 0) AS BIGINT) AS lost_lines
 FROM w LEFT JOIN dup ON dup.rowno = w.rowno LEFT JOIN rep ON rep.rowno = w.rowno LEFT JOIN lost ON lost.rowno = w.rowno),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (lost_words > 0 AND (n_words - lost_words < {L.KEEP_WORDS} OR n_words - lost_words < {L.KEEP_PART} * n_words)) AS kept FROM b
"""

MIXTURE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([{', '.join(map(str, M.WEIGHTS))}][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(M.WEIGHTS)} + 1 AS INT)] AS DOUBLE) AS weight, CAST({M.CAP} * source_size AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS pool FROM s0),
s2 AS (SELECT *, (pool - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY most / weight, source ASC NULLS LAST) AS nr FROM s1),
lv AS (SELECT arg_min(level, nr) AS level FROM s2 WHERE most >= weight * level),
s3 AS (SELECT source, source_size, least(most, weight * lv.level) AS target FROM s2, lv),
bl AS (SELECT CAST(greatest(1, least({M.LARGEST_BLOCK}, floor(min(CASE WHEN target > 0 THEN target END) / {M.BLOCKS}))) AS BIGINT) AS block FROM s3),
s4 AS (SELECT s3.*, block, CAST(floor(sum(target) OVER () / block + 0.5) AS BIGINT) AS blocks, CAST({M.CAP} * ceil(source_size / CAST(block AS DOUBLE)) AS BIGINT) AS room, CAST(greatest(1, ceil(source_size / CAST({M.SHARD_TOKENS} AS DOUBLE))) AS BIGINT) AS shards FROM s3, bl),
q AS (SELECT source, blocks, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source ASC NULLS LAST) AS r FROM (SELECT source, target, blocks, unnest(range(room)) AS k FROM s4)),
quota AS (SELECT source, count(*) AS quota FROM q WHERE r <= blocks GROUP BY source),
s5 AS (SELECT s4.*, coalesce(quota, 0) AS quota FROM s4 LEFT JOIN quota ON s4.source IS NOT DISTINCT FROM quota.source),
o AS (SELECT d.*, source_size, target, block, quota, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '/{M.SEED}') AS ord, shards FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
o2 AS (SELECT *, CAST('0x' || substr(ord, 25, 8) AS BIGINT) % shards AS shard FROM o),
h AS (SELECT source, shard, sum(size) AS shard_size, any_value(quota) AS quota, CAST(ceil(sum(size) / CAST(any_value(block) AS DOUBLE)) AS BIGINT) AS n FROM o2 GROUP BY source, shard),
hq AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY CAST(shard_size AS DOUBLE) / (2 * k + 1) DESC, shard) AS r FROM (SELECT *, unnest(range({M.CAP} * n)) AS k FROM h)),
hs AS (SELECT source, shard, count(*) AS sq FROM hq WHERE r <= quota GROUP BY source, shard),
x AS (SELECT o2.*, coalesce(sq, 0) AS sq, n, sum(size) OVER (PARTITION BY o2.source, o2.shard ORDER BY ord, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o2 JOIN h ON o2.source IS NOT DISTINCT FROM h.source AND o2.shard = h.shard LEFT JOIN hs ON o2.source IS NOT DISTINCT FROM hs.source AND o2.shard = hs.shard)
SELECT doc_id, source, size, source_size, target, CAST(CASE WHEN n > 0 THEN sq // n * size + greatest(0, least(upto, (sq - sq // n * n) * block) - (upto - size)) ELSE 0 END AS BIGINT) AS taken FROM x
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM q
"""
