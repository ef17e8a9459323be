"""DuckDB SQL of the registered queries; the derived tables' CTEs come first."""

CALLED = "base IN ('A', 'C', 'G', 'T')"

_RULES = f""", sub AS (SELECT * FROM calls WHERE {CALLED} {{where}}),
size AS (SELECT genotype, count(*) AS size FROM genotypes GROUP BY 1),
share AS (SELECT g.genotype, pos, base, count(*) AS n FROM sub JOIN genotypes g USING (sample_id) GROUP BY 1, 2, 3),
full_ AS (SELECT share.*, n >= size AS f FROM share JOIN size USING (genotype))"""
_SCHEME_RULES = _RULES.format(where="")
_ALLOWED = (
    _SCHEME_RULES
    + """, states AS (SELECT pos, list(DISTINCT base) AS st FROM full_ GROUP BY 1),
own AS (SELECT genotype, pos, list(DISTINCT base) AS ow FROM full_ GROUP BY 1, 2),
allowed AS (SELECT g.genotype, s.pos, list_sort(coalesce(ow, st)) AS al FROM (SELECT DISTINCT genotype FROM full_) g CROSS JOIN states s LEFT JOIN own o ON o.genotype = g.genotype AND o.pos = s.pos)"""
)
_FEATURES = """, feat AS (SELECT DISTINCT pos, ref AS ref_state, base AS alt_state, 'snp_' || ref || '_' || (pos + 1) || '_' || base AS mk FROM calls WHERE base <> ref)"""

GENOTYPE_CALLS = (
    _ALLOWED
    + _FEATURES
    + """, sc AS (SELECT sample_id, a.genotype, sum(CAST(list_contains(al, base) AS INT)) AS m, count(*) AS t FROM sub JOIN allowed a USING (pos) GROUP BY 1, 2),
ds AS (SELECT sample_id, genotype, 1 - m / t AS dist, min(1 - m / t) OVER (PARTITION BY sample_id) AS best FROM sc),
cl AS (SELECT sample_id, min(best) AS dist, string_agg(genotype, ';' ORDER BY genotype) FILTER (WHERE dist = best AND dist <= 0) AS g, count(*) FILTER (WHERE dist = best AND dist <= 0) AS n FROM ds GROUP BY 1),
det AS (SELECT sample_id, count(DISTINCT pos) AS nd FROM sub GROUP BY 1),
mu AS (SELECT sample_id, string_agg(mk, ';' ORDER BY mk) AS mut FROM (SELECT DISTINCT sample_id, mk FROM sub JOIN feat ON feat.pos = sub.pos AND feat.alt_state = sub.base) GROUP BY 1),
np AS (SELECT count(DISTINCT pos) AS np FROM full_)
SELECT s.sample_id, coalesce(g, '') AS predicted_genotype, round(coalesce(dist, 1.0), 9) AS predicted_genotype_distance, CAST(coalesce(nd, 0) AS BIGINT) AS num_detected_positions,
  CASE WHEN coalesce(nd, 0) < np THEN 'Fail' WHEN n = 1 THEN 'Pass' ELSE 'Warning' END AS qc_status,
  CASE WHEN coalesce(nd, 0) < np THEN 'too few positions detected' WHEN n = 1 THEN '' WHEN n > 1 THEN 'ambiguous genotype' ELSE 'no genotype' END AS qc_messages, coalesce(mut, '') AS detected_alt_mutations
FROM samples s LEFT JOIN cl USING (sample_id) LEFT JOIN det USING (sample_id) LEFT JOIN mu USING (sample_id) CROSS JOIN np"""
)
SITE_FILTER = f"""SELECT chrom, pos, round(1 - count(*) FILTER (WHERE {CALLED}) / (SELECT count(*) FROM samples), 9) AS missing, CAST(count(DISTINCT base) FILTER (WHERE {CALLED}) AS BIGINT) AS states,
  1 - count(*) FILTER (WHERE {CALLED}) / (SELECT count(*) FROM samples) > 0.05 OR count(DISTINCT base) FILTER (WHERE {CALLED}) = 1 AS removed FROM calls GROUP BY chrom, pos"""
FILTERED_CALLS = f"""SELECT pos, count(*) AS n_calls FROM calls GROUP BY pos
  HAVING count(*) FILTER (WHERE NOT ({CALLED})) / count(*) <= 0.5 AND count(DISTINCT base) FILTER (WHERE {CALLED}) NOT IN (1, 4)"""
BASE_COUNTS = f"""SELECT chrom, pos, count(*) FILTER (WHERE base = 'A') AS n_a, count(*) FILTER (WHERE base = 'C') AS n_c, count(*) FILTER (WHERE base = 'G') AS n_g, count(*) FILTER (WHERE base = 'T') AS n_t,
  count(*) FILTER (WHERE NOT ({CALLED})) AS n_n FROM calls GROUP BY chrom, pos"""
VARIANT_POSITIONS = f"SELECT chrom, pos FROM calls WHERE {CALLED} GROUP BY chrom, pos HAVING count(DISTINCT base) > 1"
CONSENSUS = f"""SELECT chrom, pos, coalesce(map(['A','C','G','T','AG','CT','CG','AT','GT','AC','CGT','AGT','ACT','ACG','ACGT'], ['A','C','G','T','R','Y','S','W','K','M','B','D','H','V','N'])[string_agg(DISTINCT base, '' ORDER BY base)], '-') AS code
  FROM calls WHERE {CALLED} GROUP BY chrom, pos"""
ALT_BASES = """, n AS (SELECT chrom, pos, b, count(*) FILTER (WHERE base = b) AS n FROM calls, (SELECT unnest(['A','C','G','T']) AS b) GROUP BY 1, 2, 3)
SELECT chrom, pos, min(b) FILTER (WHERE n <= 1) AS alt_base, coalesce(string_agg(b, '' ORDER BY b) FILTER (WHERE n <= 1), '') AS candidates FROM n GROUP BY 1, 2"""
SPARSE = "SELECT sample_id, count(*) AS n_variants FROM calls WHERE base <> ref GROUP BY 1"

_DIST = f""", cc AS (SELECT c.*, s.ord FROM calls c JOIN samples s USING (sample_id) WHERE {CALLED}),
df AS (SELECT a.sample_id AS s1, b.sample_id AS s2, count(*) AS d FROM cc a JOIN cc b ON a.pos = b.pos AND a.chrom = b.chrom AND a.ord < b.ord AND a.base <> b.base GROUP BY 1, 2),
dist AS (SELECT a.sample_id AS s1, b.sample_id AS s2, CAST(coalesce(d, 0) AS BIGINT) AS d FROM samples a JOIN samples b ON a.ord < b.ord LEFT JOIN df ON df.s1 = a.sample_id AND df.s2 = b.sample_id)"""
DISTANCES = _DIST + " SELECT s1, s2, d FROM dist"
HISTOGRAM = _DIST + " SELECT d, count(*) AS n FROM dist GROUP BY d"
TROUGHS = _DIST + """, h AS (SELECT d, count(*) AS n FROM dist GROUP BY d), dense AS (SELECT x AS d, coalesce(n, 0) AS y FROM (SELECT unnest(generate_series(0, (SELECT max(d) + 1 FROM h))) AS x) LEFT JOIN h ON h.d = x),
f AS (SELECT *, CASE WHEN y = lag(y) OVER (ORDER BY d) THEN 0 ELSE 1 END AS new FROM dense), r AS (SELECT *, sum(new) OVER (ORDER BY d) AS run FROM f),
g AS (SELECT run, min(d) AS l, max(d) AS r, min(y) AS y FROM r GROUP BY run), e AS (SELECT *, lag(y) OVER (ORDER BY run) AS b, lead(y) OVER (ORDER BY run) AS a FROM g)
SELECT CAST((l + r) // 2 AS BIGINT) AS threshold FROM e WHERE b > y AND a > y"""
WITHIN = _DIST + """ SELECT x.clade, CAST(sum(d) AS BIGINT) AS total_within, count(*) AS n_within, round(avg(d), 9) AS ave_within FROM dist JOIN membership x ON x.sample_id = s1 JOIN membership y ON y.sample_id = s2 AND x.clade = y.clade GROUP BY 1"""
_BOTH = _DIST + ", both_ AS (SELECT s1, s2, d FROM dist UNION ALL SELECT s2, s1, d FROM dist)"
OUTSIDE = _BOTH + """, o AS (SELECT m.clade, b.s1, b.s2, b.d, x.ord AS o1, y.ord AS o2, x.path AS p1, y.path AS p2 FROM both_ b JOIN membership m ON m.sample_id = b.s1 JOIN samples x ON x.sample_id = b.s1 JOIN samples y ON y.sample_id = b.s2
  WHERE NOT list_contains(y.path, m.clade)),
k AS (SELECT *, row_number() OVER (PARTITION BY clade ORDER BY d DESC, o1, o2) AS rn, min(d) OVER (PARTITION BY clade) AS nearest_dist FROM o)
SELECT clade, s1 AS clade_sample_id, s2 AS closest_sample_id, d AS closest_sample_dist, p1[CASE WHEN p1[3] = p2[3] THEN 3 WHEN p1[2] = p2[2] THEN 2 ELSE 1 END] AS closest_clade_id, nearest_dist FROM k WHERE rn = 1"""
CONSERVED = """, m AS (SELECT min(pos) AS f, max(pos) AS l FROM calls), g AS (SELECT CASE WHEN 3000 - 1 - l - 1 > l - f - 2 THEN l + 1 ELSE f + 1 END AS s, CASE WHEN 3000 - 1 - l - 1 > l - f - 2 THEN 2999 ELSE l - 1 END AS e FROM m)
SELECT CAST(s AS INT) AS start, CAST(e AS INT) AS "end", CAST(s + (e - s) // 2 AS INT) AS pos FROM g"""

_OVER = f""", good AS (SELECT * FROM calls WHERE {CALLED}), sizes AS (SELECT clade, count(*) AS n_members, min(ord) AS o, min(depth) AS dp FROM membership GROUP BY 1),
bb AS (SELECT chrom, pos, base, clade, count(*) AS overlap, max(CAST(base = ref AS INT)) AS is_ref FROM good JOIN membership USING (sample_id) GROUP BY 1, 2, 3, 4),
ov AS (SELECT *, sum(overlap) OVER (PARTITION BY chrom, pos, clade) AS n_clade FROM bb),
ca AS (SELECT chrom, pos, base, count(*) AS carriers, sum(count(*)) OVER (PARTITION BY chrom, pos) AS n_called FROM good GROUP BY 1, 2, 3),
al AS (SELECT ov.*, carriers, n_called, n_members, o, dp FROM ov JOIN ca USING (chrom, pos, base) JOIN sizes USING (clade)),
can AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, base ORDER BY o, dp) AS rn FROM al WHERE overlap = carriers AND overlap = n_clade) WHERE rn = 1)"""
CANONICAL = _OVER + " SELECT chrom, pos, base, clade, CAST(n_clade AS BIGINT) AS num_clade_members, n_members AS num_members, is_ref = 1 AS is_ref FROM can"
ASSIGNED = "WITH RECURSIVE" + """{cte}""" + _OVER + """, cand AS (SELECT *, CAST(n_called - n_clade AS BIGINT) AS outside, row_number() OVER (PARTITION BY chrom, pos, base ORDER BY o, dp) AS k FROM al WHERE overlap = carriers),
tb AS (SELECT *, CAST(overlap AS BIGINT) AS a, outside AS b, CAST(n_clade AS BIGINT) AS c, CAST(outside + overlap AS BIGINT) AS e FROM cand),
st AS (SELECT *, CASE WHEN a + b = 0 OR c + e = 0 OR a + c = 0 OR b + e = 0 THEN NULL WHEN b = 0 OR c = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(a * e AS DOUBLE) / (b * c) END AS oddsr,
  CASE WHEN a + b = 0 OR c + e = 0 OR a + c = 0 OR b + e = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda x: exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + e + 1) - lgamma(a + c - x + 1) - lgamma(c + e - a - c + x + 1)
    - lgamma(a + b + c + e + 1) + lgamma(a + c + 1) + lgamma(b + e + 1))))) END AS p FROM tb),
fold AS (SELECT chrom, pos, base, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS clade, 0.0::DOUBLE AS oddsr, 1.0::DOUBLE AS p, CAST(0 AS BIGINT) AS nc, CAST(0 AS BIGINT) AS nm, false AS canonical FROM (SELECT DISTINCT chrom, pos, base FROM good)
  UNION ALL SELECT f.chrom, f.pos, f.base, s.k,
    CASE WHEN t.better THEN s.clade ELSE f.clade END, CASE WHEN t.better THEN coalesce(s.oddsr, CAST('nan' AS DOUBLE)) ELSE f.oddsr END, CASE WHEN t.better THEN s.p ELSE f.p END, CASE WHEN t.better THEN s.c ELSE f.nc END, CASE WHEN t.better THEN s.n_members ELSE f.nm END, f.canonical OR (t.better AND s.overlap = s.n_clade)
    FROM fold f JOIN st s ON s.chrom = f.chrom AND s.pos = f.pos AND s.base = f.base AND s.k = f.k + 1, LATERAL (SELECT NOT f.canonical AND (s.overlap = s.n_clade OR coalesce(s.oddsr, CAST('nan' AS DOUBLE)) > f.oddsr OR s.p < f.p) AS better) t)
SELECT chrom, pos, base, coalesce(clade, '-1') AS clade, canonical AS is_canonical, nc AS num_clade_members, nm AS num_members, CASE WHEN oddsr = CAST('inf' AS DOUBLE) THEN -1.0 ELSE round(oddsr, 6) END AS oddsr, round(p, 6) AS p_value
FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, base ORDER BY k DESC) AS rn FROM fold) WHERE rn = 1"""
_VALID = _OVER + """, every AS (SELECT ca.chrom, ca.pos, ca.base, can.base IS NOT NULL AS is_canonical, ca.carriers AS num_members, count(*) OVER (PARTITION BY ca.chrom, ca.pos) AS states FROM ca LEFT JOIN can USING (chrom, pos, base)),
ok AS (SELECT chrom, pos, base, is_canonical, num_members, states <= 3 AND NOT (is_canonical AND num_members < 2) AS is_valid FROM every)"""
VALID_SNPS = _VALID + " SELECT * FROM ok"
SNP_SUMMARY = _VALID + " SELECT count(*) AS n_positions, CAST(coalesce(sum(CAST(c AS INT)), 0) AS BIGINT) AS n_canonical, CAST(coalesce(sum(CAST(v AS INT)), 0) AS BIGINT) AS n_valid FROM (SELECT bool_or(is_canonical) AS c, bool_or(is_valid) AS v FROM ok GROUP BY chrom, pos)"
CLADE_SNPS = _OVER + " SELECT clade, count(*) AS n_snps, string_agg(pos || base, ',' ORDER BY chrom, pos, base) AS snps FROM can GROUP BY 1"
PRUNED = _OVER + " SELECT clade, pos, base FROM (SELECT *, row_number() OVER (PARTITION BY clade ORDER BY chrom, pos, base) AS r2 FROM can) WHERE r2 = 1"
VALID_NODES = _OVER + " SELECT clade, n_members AS num_members, n_snps FROM (SELECT clade, count(*) AS n_snps FROM can GROUP BY 1) JOIN sizes USING (clade)"
SUPPORTED = _OVER + """, v AS (SELECT DISTINCT clade FROM can), g AS (SELECT sample_id, string_agg(clade, '.' ORDER BY depth) AS genotype FROM membership WHERE clade IN (SELECT clade FROM v) GROUP BY 1)
SELECT s.sample_id, coalesce(genotype, '') AS genotype FROM samples s LEFT JOIN g USING (sample_id)"""
NODE_COUNTS = "SELECT clade, count(*) AS num_members FROM membership GROUP BY 1"
_EDGES = ", edges AS (SELECT DISTINCT p.clade AS parent, c.clade AS child FROM membership p JOIN membership c ON p.sample_id = c.sample_id AND c.depth = p.depth + 1)"
EDGES = _EDGES + " SELECT parent, child FROM edges"
BIFURCATING = _EDGES + " SELECT parent AS clade, count(*) AS n_children FROM edges GROUP BY 1 HAVING count(*) > 1"
TERMINAL = "SELECT DISTINCT path[4] AS clade FROM samples"
PREFIXES = "SELECT node, count(*) AS n FROM (SELECT array_to_string(path[1:d], '.') AS node FROM samples, (SELECT unnest([1, 2, 3]) AS d)) GROUP BY 1"
DELIMITER = "SELECT d AS delimiter, CAST(sum(length(genotype) - length(replace(genotype, d, ''))) AS BIGINT) AS n FROM genotypes, (SELECT unnest(['-', ':', ';', '.', '/', '|', ',', ' ']) AS d) GROUP BY 1"
BINS = _DIST + """, w AS (SELECT x.clade, avg(d) AS dist FROM dist JOIN membership x ON x.sample_id = s1 JOIN membership y ON y.sample_id = s2 AND x.clade = y.clade GROUP BY 1)
SELECT CAST(i AS INT) AS bin, t AS threshold, clade FROM w JOIN (SELECT unnest([0, 1, 2, 3]) AS i, unnest([120.0::DOUBLE, 130, 136, 1000]) AS t) ON dist <= t"""
PARTITIONS = "WITH RECURSIVE{cte}" + _DIST + """, c AS (SELECT d, count(*) AS n, row_number() OVER (ORDER BY d) AS k FROM dist GROUP BY d), tot AS (SELECT sum(n) // 10 AS target, max(k) AS top FROM c),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS held, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS closed
  UNION ALL SELECT c.k, CASE WHEN held > target THEN 0 ELSE held END + n, c.d, CASE WHEN held > target THEN last END FROM f JOIN c ON c.k = f.k + 1, tot)
SELECT DISTINCT CAST(t AS DOUBLE) AS threshold FROM (SELECT closed AS t FROM f UNION ALL SELECT last FROM f, tot WHERE k = top) WHERE t IS NOT NULL"""
REDUNDANT = _EDGES + " SELECT DISTINCT child AS clade FROM edges WHERE child NOT IN (SELECT parent FROM edges GROUP BY 1 HAVING count(*) > 1)"
GENOTYPE_COUNTS = _RULES.format(where="") + " SELECT genotype, pos, base, n FROM share"
RULES = _RULES.format(where="") + " SELECT pos, base, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE f), '') AS positive, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE NOT f), '') AS partial FROM full_ GROUP BY 1, 2"
STATES = _RULES.format(where="") + " SELECT genotype, pos, string_agg(base, '' ORDER BY base) AS bases FROM share GROUP BY 1, 2"
ALLOWED = _ALLOWED + " SELECT genotype, pos, array_to_string(al, '') AS allowed FROM allowed"
MUTATIONS = _FEATURES + f""", u AS (SELECT * FROM calls WHERE {CALLED} AND pos IN (SELECT pos FROM feat)), m AS (SELECT sample_id, string_agg(mk, ';' ORDER BY mk) AS mut FROM (SELECT DISTINCT sample_id, mk FROM u JOIN feat ON feat.pos = u.pos AND alt_state = base) GROUP BY 1)
SELECT sample_id, count(DISTINCT pos) AS n_detected, coalesce(any_value(mut), '') AS mutations FROM u LEFT JOIN m USING (sample_id) GROUP BY 1"""
_META = ", long AS (SELECT sample_id, 'host' AS field, host AS value FROM samples UNION ALL SELECT sample_id, 'location', location FROM samples), mc AS (SELECT clade, field, value, count(*) AS n FROM membership JOIN long USING (sample_id) GROUP BY 1, 2, 3)"
METADATA = _META + " SELECT clade, field, value, n FROM mc"
FISHER = _META + """, v AS (SELECT field, value, count(*) AS nv FROM long GROUP BY 1, 2), c AS (SELECT clade, count(*) AS nc FROM membership GROUP BY 1),
t AS (SELECT clade, field, value, n AS pp, nv - n AS pn, nc - n AS np, (SELECT count(*) FROM samples) - nv - nc + n AS nn FROM mc JOIN v USING (field, value) JOIN c USING (clade) WHERE nv - n <= 0.2 * nc)
SELECT clade, field, value, pp, pn, np, nn, CASE WHEN pp + pn = 0 OR np + nn = 0 OR pp + np = 0 OR pn + nn = 0 THEN -2.0 WHEN pn = 0 OR np = 0 THEN -1.0 ELSE round(CAST(pp * nn AS DOUBLE) / (pn * np), 6) END AS oddsr,
  round(CASE WHEN pp + pn = 0 OR np + nn = 0 OR pp + np = 0 OR pn + nn = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(pp, least(pp + pn, pp + np) + 1), lambda x: exp(lgamma(pp + pn + 1) - lgamma(x + 1) - lgamma(pp + pn - x + 1) + lgamma(np + nn + 1) - lgamma(pp + np - x + 1) - lgamma(nn - pp + x + 1)
    - lgamma(pp + pn + np + nn + 1) + lgamma(pp + np + 1) + lgamma(pn + nn + 1))))) END, 6) AS p FROM t"""
TEMPORAL = _BOTH + """, pr AS (SELECT b.s1, b.s2, b.d, x.year AS y1, y.year AS y2, y.ord AS o2 FROM both_ b JOIN samples x ON x.sample_id = b.s1 JOIN samples y ON y.sample_id = b.s2),
lst AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY o2 DESC) AS rn FROM pr), pts AS (SELECT s1, s2, d, y2 AS year FROM pr UNION ALL SELECT s1, s2, d, y1 FROM lst WHERE rn = 1),
ex AS (SELECT m.clade, d, year FROM pts JOIN membership m ON m.sample_id = s1 JOIN membership k ON k.sample_id = s2 AND k.clade = m.clade),
rk AS (SELECT *, rank() OVER (PARTITION BY clade ORDER BY d) + (count(*) OVER (PARTITION BY clade, d) - 1) / 2.0 AS rd, rank() OVER (PARTITION BY clade ORDER BY year) + (count(*) OVER (PARTITION BY clade, year) - 1) / 2.0 AS ry FROM ex)
SELECT clade, count(*) AS n, round(corr(d, year), 6) AS pearson, round(corr(rd, ry), 6) AS spearman FROM rk GROUP BY 1 HAVING count(DISTINCT d) >= 3 AND count(DISTINCT year) >= 3"""
RANGES = """, i AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM (SELECT DISTINCT chrom, pos FROM calls)) SELECT chrom, min(pos) AS first, max(pos) AS last FROM i GROUP BY chrom, k"""
_LABELS = ", labels_ AS (SELECT sample_id, array_to_string(path[1:3], '.') AS submitted, CASE WHEN ord % 7 = 0 THEN array_to_string(path[1:2], '.') ELSE array_to_string(path[1:3], '.') END AS predicted FROM samples)"
F1 = _LABELS + """, names AS (SELECT submitted AS label FROM labels_ UNION SELECT predicted FROM labels_),
e AS (SELECT label, count(*) FILTER (WHERE submitted = label) AS ns, count(*) FILTER (WHERE predicted = label) AS np, avg(CAST(predicted = submitted AS INT)) AS f FROM names JOIN labels_ ON contains(predicted, label) OR contains(submitted, label) GROUP BY 1)
SELECT 'overall' AS label, count(*) AS num_submitted, count(*) AS num_predicted, round(avg(CAST(predicted = submitted AS INT)), 9) AS f1_score FROM labels_
UNION ALL SELECT label, CASE WHEN ns = 0 OR np = 0 THEN 0 ELSE ns END, CASE WHEN ns = 0 OR np = 0 THEN 0 ELSE np END, CASE WHEN ns = 0 OR np = 0 THEN 0.0 ELSE round(f, 9) END FROM e"""
INCLUDE = _LABELS + " SELECT sample_id, submitted, predicted FROM labels_ WHERE contains(predicted, '0.r1') OR contains(submitted, '0.r1')"
EXCLUDE = _LABELS + " SELECT sample_id, submitted, predicted FROM labels_ WHERE NOT (contains(predicted, '0.r1') OR contains(submitted, '0.r1'))"
LABEL_COUNTS = _LABELS + " SELECT predicted, count(*) AS n FROM labels_ GROUP BY 1"
PROBLEMS = _ALLOWED + """, w AS (SELECT s.sample_id, g.submitted FROM samples s JOIN (SELECT DISTINCT nation, array_to_string(path[1:3], '.') AS submitted FROM samples) g ON g.nation = (s.nation + 1) % 25),
b AS (SELECT sample_id, string_agg((pos + 1) || ':' || base, ',' ORDER BY pos, base) AS t FROM sub JOIN w USING (sample_id) JOIN allowed a USING (pos) WHERE a.genotype = w.submitted AND NOT list_contains(al, base) GROUP BY 1)
SELECT w.sample_id, coalesce(t, '') AS problem_features FROM w LEFT JOIN b USING (sample_id)"""
RENAME = "SELECT sample_id, path[1] || ',' || location || ',' || path[3] || ',' || path[4] AS nodes FROM samples"
MISSING = """, t AS (SELECT sample_id FROM samples WHERE ord % 10 <> 0), c AS (SELECT DISTINCT sample_id FROM calls WHERE sample_id <> 'S3'), m AS (SELECT sample_id FROM samples WHERE ord % 11 <> 0), u AS (FROM t UNION FROM c UNION FROM m)
SELECT 'tree' AS input, sample_id FROM u WHERE sample_id NOT IN (FROM t) UNION ALL SELECT 'calls', sample_id FROM u WHERE sample_id NOT IN (FROM c) UNION ALL SELECT 'meta', sample_id FROM u WHERE sample_id NOT IN (FROM m)"""
INTEGER_IDS = "SELECT sample_id, false AS id_is_int, true AS number_is_int FROM samples"
SEQUENCES = """SELECT seq_id, length(seq) AS len, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp_md5, md5(seq) AS md5,
  CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS BIGINT) AS homopolymer FROM seqs"""
KMERS = """, k AS (SELECT substr(seq, i, 9) AS k FROM (SELECT seq, unnest(generate_series(1, length(seq) - 8)) AS i FROM seqs WHERE length(seq) >= 9)) SELECT least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM k GROUP BY 1"""
CODONS = """, c AS (SELECT substr(seq, i, 3) AS seq FROM (SELECT seq, unnest(generate_series(1, length(seq) - 2, 3)) AS i FROM seqs WHERE length(seq) >= 3)) SELECT substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((instr('TCAG', substr(seq, 1, 1)) - 1) * 16 + (instr('TCAG', substr(seq, 2, 1)) - 1) * 4 + instr('TCAG', substr(seq, 3, 1)) AS INT), 1) AS aa, count(*) AS n
  FROM c GROUP BY 1"""
ENTROPY = _RULES.format(where="") + " SELECT pos, base, round(ln(count(*)), 9) AS entropy FROM full_ GROUP BY 1, 2"
ARI = _LABELS + """, c AS (SELECT submitted, predicted, count(*) AS k FROM labels_ GROUP BY 1, 2), i AS (SELECT sum(k * (k - 1) / 2) AS i, sum(k) AS n FROM c), x AS (SELECT sum(k * (k - 1) / 2) AS x FROM (SELECT sum(k) AS k FROM c GROUP BY submitted)),
y AS (SELECT sum(k * (k - 1) / 2) AS y FROM (SELECT sum(k) AS k FROM c GROUP BY predicted)) SELECT round((i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 9) AS ari FROM i, x, y"""
_PROBES = """, pr AS (SELECT seq_id, pos, unnest(generate_series(greatest(0, pos - 8), pos - 1)) AS st, seq FROM seqs, (SELECT DISTINCT pos FROM calls) WHERE length(seq) > pos AND pos > 0),
ex AS (SELECT seq_id, pos, st, substr(seq, st + 1, 9) AS kmer FROM pr WHERE length(substr(seq, st + 1, 9)) = 9),
pk AS (SELECT DISTINCT kmer FROM ex),
win AS (SELECT seq_id, substr(seq, i, 9) AS w FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 8)) AS i FROM seqs WHERE length(seq) >= 9)),
hits AS (SELECT kmer, seq_id, count(*) AS n FROM win JOIN (SELECT kmer, kmer AS w FROM pk UNION SELECT kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM pk) USING (w) GROUP BY 1, 2)"""
KMER_EXTRACTION = _PROBES + ' SELECT CAST(pos AS INT) AS pos, CAST(st AS INT) AS start, CAST(st + 9 AS INT) AS "end", kmer, count(*) AS n FROM ex GROUP BY 1, 2, 3, 4'
KMER_SEARCH = _PROBES + " SELECT kmer, seq_id, n FROM hits"
KMER_RULES = _PROBES + """, g AS (SELECT seq_id, 'g' || (seq_id % 5) AS genotype FROM seqs), z AS (SELECT genotype, count(*) AS size FROM g GROUP BY 1), s AS (SELECT kmer, genotype, count(DISTINCT seq_id) AS k FROM hits JOIN g USING (seq_id) GROUP BY 1, 2)
SELECT kmer, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE k >= 0.1 * size), '') AS positive, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE k < 0.1 * size), '') AS partial FROM s JOIN z USING (genotype) GROUP BY 1"""
KMER_MULTI = _PROBES + " SELECT DISTINCT kmer FROM hits WHERE n > 1"
WITHOUT_KMER = f" SELECT DISTINCT pos, base FROM calls WHERE {CALLED} EXCEPT SELECT pos, base FROM calls WHERE pos % 3 = 0 AND base IN ('A', 'C')"
OPTIMAL_STARTS = f""", v AS (SELECT pos FROM calls WHERE {CALLED} GROUP BY chrom, pos HAVING count(DISTINCT base) > 1), st AS (SELECT pos, unnest(generate_series(greatest(0, pos - 17), pos)) AS start FROM v),
c AS (SELECT st.pos, st.start, count(v.pos) AS nv, count(v.pos) FILTER (WHERE v.pos % 5 = 0) AS ng FROM st LEFT JOIN v ON v.pos BETWEEN st.start AND st.pos GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY nv, ng, start DESC) AS rn FROM c) SELECT pos, CAST(start AS INT) AS start, nv AS n_variable, ng AS n_gapped FROM r WHERE rn = 1"""
_SCHEME = _SCHEME_RULES + """, rl AS (SELECT pos, base, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE f), '') AS positive, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE NOT f), '') AS partial, count(*) AS n, count(*) FILTER (WHERE f) AS np FROM full_ GROUP BY 1, 2),
rf AS (SELECT DISTINCT pos, ref FROM calls), al AS (SELECT rl.pos, ref, base AS alt FROM rl JOIN rf USING (pos) WHERE base <> ref),
ro AS (SELECT al.*, state, CASE WHEN state = 'alt' THEN alt ELSE ref END AS base FROM al, (SELECT unnest(['ref', 'alt']) AS state)),
rw AS (SELECT ro.*, coalesce(positive, '') AS positive, coalesce(partial, '') AS partial, coalesce(n, 0) AS n, max(coalesce(np, 0)) OVER (PARTITION BY ro.pos, alt) AS best FROM ro LEFT JOIN rl ON rl.pos = ro.pos AND rl.base = ro.base),
sc AS (SELECT *, CASE WHEN n > 0 THEN ln(n) ELSE (SELECT max(ln(n)) FROM rw WHERE n > 0 AND best > 0) END AS e FROM rw WHERE best > 0)"""
SNP_SCHEME = _SCHEME + """ SELECT 'snp_' || ref || '_' || (pos + 1) || '_' || alt AS mutation_key, ref || (pos + 1) || base AS dna_name, state, ref AS ref_state, alt AS alt_state, base AS target_variant, CAST(pos + 1 AS BIGINT) AS variant_start, round(e, 9) AS kmer_entropy,
  positive AS positive_genotypes, partial AS partial_genotypes FROM sc"""
SCHEME_SUMMARY = _SCHEME + " SELECT count(*) AS n_features, count(DISTINCT pos) AS n_positions, count(DISTINCT ref || pos || alt) AS n_mutations FROM sc"
FEATURES = """, f AS (SELECT ord, sample_id AS gene, ord * 37 % 2300 AS a FROM samples), p AS (SELECT DISTINCT pos FROM calls), h AS (SELECT pos, arg_min(gene, ord) AS gene FROM p JOIN f ON pos BETWEEN a AND a + 60 GROUP BY 1)
SELECT p.pos, coalesce(gene, '') AS gene_name FROM p LEFT JOIN h ON h.pos = p.pos"""
REFINED = _RULES.format(where="") + """, w AS (SELECT *, bool_or(f) OVER (PARTITION BY pos, genotype) AS settled, count(*) OVER (PARTITION BY pos, genotype) AS nb FROM full_),
r AS (SELECT pos, base, genotype, f OR (NOT settled AND nb = 1) AS f FROM w UNION ALL SELECT p.pos, 'A', g.genotype, true FROM (SELECT DISTINCT pos FROM full_) p CROSS JOIN (SELECT DISTINCT genotype FROM genotypes) g WHERE NOT EXISTS (SELECT 1 FROM full_ x WHERE x.pos = p.pos AND x.genotype = g.genotype))
SELECT pos, base, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE f), '') AS positive, coalesce(string_agg(genotype, ',' ORDER BY genotype) FILTER (WHERE NOT f), '') AS partial FROM r GROUP BY 1, 2"""
BEST_FIT = """, c AS (SELECT sample_id, nation * 2 + CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END AS cluster FROM samples), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1), z AS (SELECT clade, count(*) AS nn, min(ord) AS o, min(depth) AS dp FROM membership GROUP BY 1),
k AS (SELECT cluster, clade, count(*) AS k FROM c JOIN membership USING (sample_id) GROUP BY 1, 2), b AS (SELECT cluster, clade, row_number() OVER (PARTITION BY cluster ORDER BY nn - n, o, dp) AS rn FROM k JOIN n USING (cluster) JOIN z USING (clade) WHERE k = n)
SELECT n.cluster, coalesce(clade, '0') AS clade FROM n LEFT JOIN b ON b.cluster = n.cluster AND rn = 1"""

DEGENERATE = """WITH RECURSIVE {cte}, w AS (SELECT seq_id, i - 1 AS "at", translate(substr(seq, i, 5), 'ACGT', 'RYNT') AS code FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 4)) AS i FROM seqs WHERE length(seq) >= 5)),
meant(c, b) AS (VALUES ('R', 'A'), ('R', 'G'), ('Y', 'C'), ('Y', 'T'), ('N', 'A'), ('N', 'C'), ('N', 'G'), ('N', 'T'), ('T', 'T')),
ex(code, i, word) AS (SELECT DISTINCT code, 1, '' FROM w UNION ALL SELECT code, i + 1, word || b FROM ex JOIN meant ON c = substr(code, i, 1)),
n AS (SELECT code, count(*) AS n, md5(string_agg(word, ',' ORDER BY word)) AS words_md5 FROM ex WHERE i = 6 GROUP BY code)
SELECT seq_id, "at", code, n, words_md5 FROM w JOIN n USING (code)"""
KMER_INDEX = _PROBES + """, ix AS (SELECT kmer, dense_rank() OVER (ORDER BY kmer) - 1 AS kidx FROM ex),
sh AS (SELECT DISTINCT pos, substr(ex.kmer, CAST(pos - st + 1 AS BIGINT), 1) AS base, kidx, ex.kmer AS kmer FROM ex JOIN (SELECT DISTINCT kmer, kidx FROM ix) d ON d.kmer = ex.kmer)
SELECT CAST(pos AS INT) AS pos, base, count(*) AS n, md5(string_agg(kidx || ':' || kmer, ',' ORDER BY kidx)) AS kmers_md5 FROM sh WHERE base IN ('A', 'C', 'G', 'T') GROUP BY 1, 2"""
NOMENCLATURE = """, l AS (SELECT sample_id, CAST(unnest([1 + region, 10 + nation, 100 + 2 * nation + CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END]) AS VARCHAR) AS cluster, unnest([1, 2, 3]) AS i FROM samples),
n AS (SELECT cluster, count(DISTINCT sample_id) AS n FROM l GROUP BY 1), z AS (SELECT clade, count(*) AS n_node, min(ord) AS o, min(depth) AS dp FROM membership GROUP BY 1),
ov AS (SELECT cluster, clade, count(*) AS k FROM l JOIN membership USING (sample_id) GROUP BY 1, 2),
fit AS (SELECT cluster, clade FROM ov JOIN n USING (cluster) JOIN z USING (clade) WHERE k = n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n_node - n, o, dp) = 1),
p AS (SELECT sample_id, i, coalesce(clade, '0') AS clade, lag(coalesce(clade, '0')) OVER (PARTITION BY sample_id ORDER BY i) AS before FROM l LEFT JOIN fit USING (cluster))
SELECT sample_id, string_agg(clade, '.' ORDER BY i) AS genotype FROM p WHERE i < 3 AND (before IS NULL OR before <> clade) GROUP BY 1"""
