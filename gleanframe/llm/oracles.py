"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# Words of a text: runs of characters other than x20 and x09-x0D.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SOURCE_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2 * source_size AS cap, sum(source_size) OVER () * 1.5 AS budget
  FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), level AS (
  SELECT arg_min(level, (cap / weight, coalesce(source, chr(1114111)))) AS level FROM levels WHERE cap > level * weight
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM level) * weight, cap::DOUBLE)) AS target FROM weighed
), timed AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queue AS (
  SELECT *, coalesce((cum + pass * source_size) / nullif(target, 0), 0) AS finish FROM timed, range(2) AS r(pass)
), run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, cum ROWS UNBOUNDED PRECEDING) AS upto FROM queue
)
SELECT doc_id, any_value(size) AS size, any_value(source_size)::BIGINT AS source_size, any_value(target) AS target,
       sum(CASE WHEN upto <= (SELECT sum(size) * 1.5 FROM sized) THEN size ELSE 0 END)::BIGINT AS taken
FROM run GROUP BY doc_id
"""

# CRC-32: its table of 256 entries by the polynomial, then one step per byte.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps
)"""


def crc32(text: str) -> str:
    """Of characters up to U+00FF, with ``steps`` of the table at hand."""
    code = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    utf8 = f"flatten(list_transform({code}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END))"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {utf8}),
      lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1])), 4294967295)"""


SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, times, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc
), made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
  FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), gone AS (
  SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM gone a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word FROM gone a JOIN words w ON a.rest = w.word
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS form, max(o.n) AS form_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
         CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), steps_up AS (
  SELECT word, word AS top FROM forms UNION ALL
  SELECT s.word, f.form FROM steps_up s JOIN forms f ON f.word = s.top WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.top AS root, f.n, f.n_near, f.form_n FROM forms f
JOIN steps_up s ON s.word = f.word JOIN forms last ON last.word = s.top AND last.form IS NULL
"""

CONVERSATION_TRIE = f"""
WITH {CRC_TABLE}, ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered), crc
), rebuilt AS (
  SELECT h.conv_id, 0 AS part, pos, role, text FROM heads h JOIN ordered o ON o.conv_id = h.base AND pos < h.h
  UNION ALL SELECT h.conv_id, 1, pos, role, text FROM heads h JOIN ordered o ON o.conv_id = h.conv_id AND pos >= h.h
), sequences AS (
  SELECT h.conv_id, coalesce(list([role, text] ORDER BY part, pos) FILTER (WHERE role IS NOT NULL), []) AS said
  FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id
), begun AS (
  SELECT conv_id, said[1:depth] AS key, depth, len(said) = depth AS ends
  FROM (SELECT *, unnest(range(len(said) + 1)) AS depth FROM sequences)
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM begun GROUP BY key, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.key[1:n.depth] = n.key) AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.key[n.depth][2]) END AS own
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
), up AS (
  SELECT key[1:above] AS key, above, own, n_children FROM (SELECT *, unnest(range(depth + 1)) AS above FROM linked)
), totals AS (
  SELECT key, above AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM up GROUP BY ALL
)
SELECT conv_id, l.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ids) AS ends_sha256
FROM linked l JOIN totals t ON t.key = l.key AND t.depth = l.depth
"""

ORACLES: dict[str, str] = {
    "op10_source_mix": SOURCE_MIX,
    "op12_spelling_variants": SPELLING,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
