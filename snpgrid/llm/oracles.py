"""DuckDB SQL for the queries that SQL can express."""

U, L = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{U}', '{L}')"
WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s FROM spot),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.x = d.doc_id
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(d, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS g, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(g, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 15), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 10) & 31), 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> 5) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM v
"""

OP4 = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS h, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, h AS text_sha256
FROM d
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS win
         FROM (SELECT item, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
spot AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d WHERE len(ws) > 0),
hit AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM spot, lens WHERE i + n - 1 <= len(ws)) x JOIN wins USING (n) WHERE s = win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
r AS (SELECT source, s, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST) AS k FROM r),
c AS (SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
f AS (SELECT min(k) AS k FROM c WHERE w * rest <= 3 * s * ws),
g AS (SELECT c.source, c.s, CASE WHEN c.k < f.k THEN CAST(3 * c.s AS DOUBLE) ELSE CAST(c.w * x.rest AS DOUBLE) / CAST(x.ws AS DOUBLE) END AS target
      FROM c, f, c x WHERE x.k = f.k),
t AS (SELECT d.doc_id, d.source, d.size, g.s AS source_size, g.target, CASE WHEN g.s > 0 THEN g.target / g.s ELSE 0.0 END AS rate,
             CAST('0x' || substr(md5('mix-1:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u,
             CAST('0x' || substr(md5('mix-1:source:' || coalesce(d.source, 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u0
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
z AS (SELECT source, size, any_value(rate - floor(rate)) AS part, any_value(u0) AS u0, count(*) AS n FROM t GROUP BY 1, 2),
y AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY size) AS upto FROM z),
k AS (SELECT source, size, floor(CAST(upto AS DOUBLE) * part + u0) - floor(CAST(upto - n AS DOUBLE) * part + u0) AS k FROM y),
x AS (SELECT t.*, row_number() OVER (PARTITION BY source, size ORDER BY u) AS place FROM t)
SELECT doc_id, x.size, source_size, target, CAST(x.size * (floor(rate) + CASE WHEN place <= k THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x JOIN k ON x.source IS NOT DISTINCT FROM k.source AND x.size = k.size
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
spot AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 34)) AS i, ws FROM d WHERE len(ws) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM spot),
rep AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win WHERE m IN (SELECT m FROM rep)),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS p FROM d WHERE len(ws) > 0) x
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP11 = OP2.replace("len(ws) - 4", "len(ws) - 2").replace("len(ws) < 5", "len(ws) < 3").replace("i + 4", "i + 2").replace("100 * k >= 75", "100 * k >= 90")
OP11 = OP11.replace(", coalesce(c.c, d.doc_id) = d.doc_id AS kept", "")

#: The table of CRC-32 (reflected, 0xEDB88320).
CRC_TABLE = """start(v, byte, n) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END, byte, n + 1 FROM start WHERE n < 8),
tab AS (SELECT list(v ORDER BY byte) AS t FROM start WHERE n = 8)"""


def crc32(h: str, t: str) -> str:
    """SQL of the checksum of the bytes whose hexadecimal digits ``h`` gives; ``t``: the table."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length({h}) // 2), lambda i: CAST('0x' || substr({h}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor({t}[1 + (xor(c, b) & 255)], c >> 8)), CAST(4294967295 AS BIGINT))"


_FEATURES = rf"""
WITH RECURSIVE {CRC_TABLE},
w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
words AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (SELECT f, {crc32("h", "t")} % 10000 AS bucket FROM words, tab)"""

OP12 = _FEATURES + r""",
s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM df) + 10000 AS DOUBLE)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM bf) + 10000 AS DOUBLE)))) AS BIGINT) AS g
         FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
mean AS (SELECT doc_id, count(*) AS n, sum(g) AS total FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
                  CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
                  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
           FROM w LEFT JOIN mean USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 25 * n // 100 THEN CAST(r AS BIGINT) END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

#: Runs of exponent 4 repeat three words in a row at the distance of their period, so pairs of equal triples hold all of them.
OP13 = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, {crc32("hex(encode(CAST(doc_id AS VARCHAR)))", "t")} AS h FROM documents, tab),
x AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM o),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS BIGINT)]) ELSE ws END AS ws FROM x),
word AS (SELECT doc_id, n, CAST(unnest(range(0, n)) AS BIGINT) AS i, unnest(ws) AS w FROM d),
three AS (SELECT doc_id, n, i, hash(w, lead(w) OVER p, lead(w, 2) OVER p) AS t FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(w, 2) OVER p IS NOT NULL),
same AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM three a JOIN three b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, min(i) AS s, max(i) + 3 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s AS start, e - s AS length, min(q) AS period FROM island GROUP BY 1, 2, e HAVING e - s >= greatest(6, 4 * min(q))),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
text AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(text.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN text ON text.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
