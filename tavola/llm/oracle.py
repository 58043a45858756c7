"""DuckDB SQL for the queries that SQL can state, written apart from the Spark code; only the licence texts are shared."""

from __future__ import annotations

from tavola.llm.licenses import TEMPLATES

OP9 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


# The permutation's rounds: shift, factor and addend from a linear congruence modulo 2^31 - 1.
OP6 = """
WITH RECURSIVE congruence(i, x) AS (
  SELECT 0, CAST(20240917 AS BIGINT) UNION ALL SELECT i + 1, (x * 48271 + 11) % 2147483647 FROM congruence WHERE i < 36),
keys AS MATERIALIZED (
  SELECT (i - 1) // 3 AS r, max(x) FILTER (WHERE i % 3 = 1) AS shift, max(x + 1 - x % 2) FILTER (WHERE i % 3 = 2) AS factor, max(x) FILTER (WHERE i % 3 = 0) AS addend
  FROM congruence WHERE i > 0 GROUP BY 1),
sizes AS MATERIALIZED (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sizes GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM per),
w AS (SELECT *, CASE ord % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM weighed),
filled AS (
  SELECT *, (1.5 * (SELECT CAST(sum(s) AS DOUBLE) FROM w)
      - CAST(coalesce(sum(2 * s) OVER (ORDER BY 2.0 * s / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER (ORDER BY 2.0 * s / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
lvl AS (SELECT coalesce(min_by(level, 2.0 * s / w) FILTER (WHERE level * w <= 2.0 * s), 0) AS level FROM filled),
targets AS (
  SELECT source, ord, s, least(CAST(2.0 * s AS DOUBLE), (SELECT level FROM lvl) * w) AS target, (s + 127) // 128 AS blocks FROM w),
t AS (
  SELECT *, CASE WHEN s > 0 THEN CAST(floor(target * blocks / s + 0.5) AS BIGINT) ELSE 0 END AS slots FROM targets),
placed AS MATERIALIZED (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY ord
      ORDER BY CAST('0x' || substr(k, 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1) FROM documents), k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off0
  FROM (SELECT doc_id, size, ord, s, target, blocks, slots, row_number() OVER () AS rid,
      md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || coalesce(text, '')) AS k
    FROM sizes JOIN t ON sizes.source IS NOT DISTINCT FROM t.source)),
idx AS (SELECT ord, blocks, slots, unnest(range(blocks)) AS i FROM t),
slots AS (
  SELECT ord, blocks, pass, i AS idx, i + pass * blocks AS slot, ord * 2 + pass AS k
  FROM idx, (VALUES (0), (1)) v(pass) WHERE i + pass * blocks < slots),
step AS (
  SELECT ord, slot, blocks, k, idx AS x, 0 AS r FROM slots
  UNION ALL
  SELECT ord, slot, blocks, k, CASE WHEN ((((greatest(x, p) % 2147483647) * factor + addend + k * 69069) % 2147483647) // 65536) % 2 = 1 THEN p ELSE x END, r + 1
  FROM (SELECT ord, slot, blocks, k, x, step.r, factor, addend, ((shift + k * 40503) % blocks - x + blocks) % blocks AS p FROM step JOIN keys ON keys.r = step.r)),
shards AS (SELECT greatest(1, (sum(slots) + 1023) // 1024) AS n FROM t),
used AS MATERIALIZED (
  SELECT ord, x AS block, CAST('0x' || substr(md5('784588716:' || ord || ':' || slot), 1, 8) AS BIGINT) % CAST(n AS BIGINT) AS shard FROM step, shards WHERE r = 12),
cut AS (SELECT rid, ord, off0, size, unnest(range(off0 // 128, (off0 + size - 1) // 128 + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT rid, CAST(sum(least(off0 + size, (block + 1) * 128) - greatest(off0, block * 128)) AS BIGINT) AS taken, array_to_string(list_sort(list(DISTINCT shard)), ',') AS shards
  FROM cut JOIN used USING (ord, block) GROUP BY rid)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0) AS taken, coalesce(taken.shards, '') AS shards FROM placed LEFT JOIN taken USING (rid)
"""


OP8 = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM docs WHERE len(w) >= 20),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS k FROM starts),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM docs),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone.q IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (WHERE gone.q IS NULL) AS kept
  FROM words LEFT JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

_NOTICES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in item)) for item in TEMPLATES.items())

# A unit and a template can only reach a Dice coefficient of 0.8 if neither has more than 1.5 times the other's bigrams.
OP10 = f"""
WITH texts(name, text) AS (VALUES {_NOTICES}),
listed_words AS (
  SELECT name, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM texts),
notices AS MATERIALIZED (SELECT name, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS notice FROM listed_words),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT rid, list_concat([text], string_split(text, chr(10))) AS units FROM d),
u AS (SELECT rid, unnest(units) AS text, unnest(range(len(units))) AS unit FROM listed),
w AS (
  SELECT rid, unit, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS words
  FROM u),
g AS (SELECT rid, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w),
hits AS (
  SELECT rid, unit, name, 2.0 * len(list_intersect(grams, notice)) / (len(grams) + len(notice)) AS dice
  FROM g JOIN notices ON len(grams) > 0 AND 3 * len(grams) >= 2 * len(notice) AND 2 * len(grams) <= 3 * len(notice)),
best AS (
  SELECT rid, arg_min(struct_pack(name := name, dice := dice, unit := unit), row(-dice, unit, name)) AS h, count(DISTINCT unit) AS n_units
  FROM hits WHERE dice >= 0.8 GROUP BY rid)
SELECT doc_id, h.name AS license, CAST(h.dice AS DOUBLE) AS dice, CAST(h.unit AS INTEGER) AS unit, coalesce(n_units, 0) AS n_units
FROM d LEFT JOIN best USING (rid)
"""


# A start copies the first place of its longest power-of-two prefix that occurs earlier; the copy is their whole common prefix.
OP4 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
counted AS (SELECT *, regexp_matches(x, '[^\\x20\\x09-\\x0D]') AS worded FROM lines),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM counted WHERE worded),
docs AS MATERIALIZED (SELECT doc_id, list(md5(x) ORDER BY q) AS l FROM placed GROUP BY doc_id),
starts AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS q FROM docs),
prefixes AS (SELECT doc_id, q, m, md5(array_to_string(l[q:q + m - 1], ',')) AS k FROM starts, (SELECT 1 << j AS m FROM range(20) t(j)) WHERE q + m - 1 <= len(l)),
known AS (SELECT doc_id, q, m, min(row(doc_id, q)) OVER (PARTITION BY k) AS home FROM prefixes),
copies AS (SELECT doc_id, q, max_by(home, m) AS home, max(m) AS m FROM known WHERE row(doc_id, q) <> home GROUP BY ALL),
runs AS (
  SELECT c.doc_id, q, m + coalesce(list_position(list_transform(range(m, 2 * m), lambda e: a.l[q + e] IS NULL OR a.l[q + e] IS DISTINCT FROM b.l[home[2] + e]), true), m + 1) - 1 AS n
  FROM copies c JOIN docs a ON a.doc_id = c.doc_id JOIN docs b ON b.doc_id = c.home[1]),
gone AS (SELECT doc_id, unnest(range(q, q + n)) AS q, n FROM runs),
cut AS (SELECT doc_id, q, max(n) AS n FROM gone GROUP BY ALL),
marked AS (
  SELECT c.doc_id, c.i, c.x, c.worded, g.q IS NOT NULL AS removed, p.q, g.n
  FROM counted c LEFT JOIN placed p ON p.doc_id = c.doc_id AND p.i = c.i LEFT JOIN cut g ON g.doc_id = c.doc_id AND g.q = p.q),
heads AS (SELECT g.doc_id, count(*) AS n_runs FROM cut g LEFT JOIN cut h ON h.doc_id = g.doc_id AND h.q = g.q - 1 WHERE h.q IS NULL GROUP BY g.doc_id)
SELECT doc_id, count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed, any_value(coalesce(n_runs, 0)) AS n_runs,
  CAST(coalesce(max(n), 0) AS BIGINT) AS longest_run, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '') AS text
FROM marked LEFT JOIN heads USING (doc_id) GROUP BY doc_id
"""

# CRC32 of the ids' digits by its byte table; prefixes are keyed by the MD5 of their joined turn codes.
OP11 = """
WITH RECURSIVE bytes(i, c, k) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bytes WHERE k < 8),
tab AS MATERIALIZED (SELECT i, c FROM bytes WHERE k = 8),
turns AS MATERIALIZED (
  SELECT conv_id, text, code, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS p
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code
        FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id FROM turns),
crc(conv_id, s, c) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT conv_id, s[2:], xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.i = xor(crc.c, CAST(ascii(s) AS BIGINT)) % 256 WHERE s <> ''),
heads AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(c, 4294967295) % 9 AS h FROM crc WHERE s = ''),
rebuilt AS (
  SELECT heads.conv_id, 0 AS part, p, code, strlen(text) AS size FROM heads JOIN turns ON turns.conv_id = heads.base AND p <= h
  UNION ALL SELECT heads.conv_id, 1, p, code, strlen(text) FROM heads JOIN turns USING (conv_id) WHERE p > h),
seqs AS MATERIALIZED (
  SELECT conv_id, coalesce(list(code ORDER BY part, p) FILTER (WHERE code IS NOT NULL), []) AS codes, coalesce(list(size ORDER BY part, p) FILTER (WHERE code IS NOT NULL), []) AS sizes
  FROM heads LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
paths AS (SELECT conv_id, codes, sizes, unnest(range(0, len(codes) + 1)) AS depth FROM seqs),
keyed AS MATERIALIZED (
  SELECT conv_id, depth, md5(array_to_string(codes[1:depth], ',')) AS k, codes[1:depth] AS path, CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size, len(codes) = depth AS ends
  FROM paths),
nodes AS MATERIALIZED (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(path) AS path, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM keyed GROUP BY k, depth),
parents AS (SELECT md5(array_to_string(path[1:depth - 1], ',')) AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN parents USING (k, depth)),
above AS (SELECT n_children, (n_convs - 1) * size AS saved, path, unnest(range(0, depth + 1)) AS up FROM own),
trees AS (
  SELECT md5(array_to_string(path[1:up], ',')) AS k, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN trees USING (k, depth) LEFT JOIN own up ON own.depth > 0 AND up.depth = own.depth - 1 AND up.k = md5(array_to_string(own.path[1:own.depth - 1], ','))
"""

OP12 = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM docs WHERE len(words) > 0),
tf AS (SELECT d, word, count(*) AS tf FROM (SELECT d, unnest(words) AS word FROM docs) GROUP BY ALL),
asked AS (
  SELECT item, item_id, word, count(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark)
  GROUP BY ALL),
known AS (SELECT * FROM tf WHERE word IN (SELECT word FROM asked)),
weights AS (
  SELECT word, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM known, corpus GROUP BY word, n_docs),
valued AS (
  SELECT d, doc_id, word, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(words) * n_docs) // n_words)) AS v FROM known JOIN docs USING (d), corpus),
scores AS (
  SELECT item, item_id, d, doc_id, CAST(sum(times * w * v) AS BIGINT) AS score FROM asked JOIN valued USING (word) JOIN weights USING (word) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4, "op6_mix_sources": OP6, "op8_substring_dedup": OP8, "op9_exact_dedup": OP9, "op10_license_scan": OP10, "op11_prefix_trie": OP11, "op12_lexical_search": OP12}
