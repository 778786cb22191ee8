"""DuckDB SQL for the queries that SQL can express."""

from .url_filter import TWO_LABEL_SUFFIXES

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _prior(tag: str, source: str) -> str:
    """CTEs t_<tag> (sums) and b_<tag> (p, s): the moment fit of a beta prior to groups (n, k)."""
    return f"""t_{tag} AS (SELECT sum(n) * 1.0 AS n, sum(k) * 1.0 AS k, sum(n * n) * 1.0 AS n2, count(*) AS g, sum(k * k * 1.0 / n) AS k2n FROM {source}),
p_{tag} AS (SELECT *, k / n AS p, (k / n) * (1 - k / n) * (n - n2 / n - (g - 1)) AS spread FROM t_{tag}),
r_{tag} AS (SELECT p, least(0.5, greatest(0.001, CASE WHEN spread > 0 THEN (k2n - k * p - p * (1 - p) * (g - 1)) / spread ELSE 0.001 END)) AS rho FROM p_{tag}),
b_{tag} AS (SELECT coalesce(p, 0.5) AS p, CASE WHEN p IS NULL THEN 2.0 ELSE (1 - rho) / rho END AS s FROM r_{tag})"""


OP3 = f"""WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
o AS (SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM labels GROUP BY 1),
hh AS (SELECT host, CASE WHEN d2 IN {TWO_LABEL_SUFFIXES} THEN d3 ELSE d2 END AS domain, CASE WHEN d2 IN {TWO_LABEL_SUFFIXES} THEN d2 ELSE string_split(host, '.')[-1] END AS suffix
 FROM (SELECT DISTINCT host, array_to_string(string_split(host, '.')[-2:], '.') AS d2, array_to_string(string_split(host, '.')[-3:], '.') AS d3 FROM h)),
g AS (SELECT host, n, k, domain, suffix FROM (SELECT host, count(*) AS n, sum(bad) AS k FROM h JOIN o USING (page_id) WHERE bad IS NOT NULL GROUP BY host) JOIN hh USING (host)),
gd AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM g GROUP BY ALL), gs AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM g GROUP BY ALL),
{_prior("s", "gs")}, {_prior("d", "gd")}, {_prior("h", "g")},
ms AS (SELECT suffix, (k + s * p) / (n + s) AS m FROM gs, b_s), md AS (SELECT domain, (gd.k + b_d.s * ms.m) / (gd.n + b_d.s) AS m FROM gd JOIN ms USING (suffix), b_d),
ab AS (SELECT hh.host, coalesce(g.n, 0) AS n, coalesce(g.k, 0) AS k, coalesce(md.m, ms.m, (t.k + 1) / (t.n + 2)) AS m, CASE WHEN coalesce(md.m, ms.m) IS NULL THEN least(b_h.s, t.n + 2) ELSE b_h.s END AS s
 FROM hh LEFT JOIN g ON g.host = hh.host LEFT JOIN md ON md.domain = hh.domain LEFT JOIN ms ON ms.suffix = hh.suffix CROSS JOIN b_h CROSS JOIN (SELECT coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM t_h) t),
low AS (SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) AS lower FROM (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM ab))
SELECT page_id, v.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM v LEFT JOIN low ON v.host = low.host"""

OP4 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, chr(1)) AS site FROM documents),
l AS (SELECT rid, text, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, {_LOW.format("regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')")} AS key FROM l),
cand AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
sh AS (SELECT DISTINCT text, site, key FROM k SEMI JOIN cand USING (key)),
tx AS (SELECT row_number() OVER () AS t, text, regexp_extract_all({_LOW.format("text")}, '[^ \\t-\\r]+') AS w FROM (SELECT DISTINCT text FROM (SELECT rid, text, sum(length(line) + 1) AS size FROM k SEMI JOIN cand USING (key) GROUP BY rid, text) WHERE 4 * size >= length(text))),
s AS (SELECT t, md5(text) AS m, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' '))[1:8])))[1:64] AS s FROM tx WHERE len(w) > 0),
b AS (SELECT t, m, s, unnest(s[1:3]) AS key FROM s),
f1 AS (SELECT key, min({{'m': m, 't': t, 's': s}}) AS one FROM b GROUP BY key HAVING count(*) > 1),
p AS (SELECT DISTINCT one.t AS a, t AS b, one.s AS o, s FROM b JOIN f1 USING (key) WHERE t <> one.t),
e0 AS (SELECT a, b, list_sort(list_distinct(o || s))[1:64] AS least, list_intersect(o, s) AS common FROM p),
e1 AS MATERIALIZED (SELECT DISTINCT a, b FROM e0 WHERE 8 * len(list_intersect(least, common)) >= 5 * len(least)),
one AS (SELECT text, min(rid) AS rid FROM d GROUP BY text),
rw AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS rest FROM k ANTI JOIN cand USING (key) GROUP BY rid),
kw AS (SELECT t, w, regexp_extract_all({_LOW.format("coalesce(rest, '')")}, '[^ \\t-\\r]+') AS r FROM tx JOIN one USING (text) LEFT JOIN rw USING (rid) WHERE t IN (SELECT a FROM e1 UNION SELECT b FROM e1)),
kn AS MATERIALIZED (SELECT t, list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS everything,
 list_distinct(list_transform(range(1, greatest(1, len(r) - 2) + 1), lambda i: array_to_string(r[i:i + 2], ' '))) AS own, 20 * len(r) <= len(w) AS few FROM kw),
e2 AS (SELECT a, b FROM e1 JOIN kn x ON x.t = a JOIN kn y ON y.t = b
 WHERE (x.few OR 2 * len(list_intersect(x.own, y.everything)) >= len(x.own)) AND (y.few OR 2 * len(list_intersect(y.own, x.everything)) >= len(y.own))),
e AS MATERIALIZED (SELECT a, b FROM e2 UNION SELECT b, a FROM e2),
r AS (SELECT t, t AS r FROM tx UNION SELECT r.t, e.b FROM r JOIN e ON r.r = e.a),
c AS (SELECT text, coalesce(min(r), 1000000000 + row_number() OVER ()) AS copy FROM (SELECT DISTINCT text FROM sh) LEFT JOIN tx USING (text) LEFT JOIN r USING (t) GROUP BY text),
bp AS (SELECT key FROM (SELECT key, copy, min(site) AS site FROM sh JOIN c USING (text) GROUP BY key, copy) GROUP BY key HAVING count(DISTINCT site) >= 10),
f AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (bp.key IS NULL) AS n_kept, count(*) FILTER (bp.key IS NULL AND k.key <> '') AS n_own, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bp.key IS NULL), '') AS clean FROM k LEFT JOIN bp USING (key) GROUP BY rid),
o AS (SELECT doc_id, text, coalesce(n_lines, 0) AS n_lines, coalesce(n_own > 0 AND n_kept < n_lines, false) AS takes, n_lines - n_kept AS gone, clean FROM d LEFT JOIN f USING (rid))
SELECT doc_id, n_lines::BIGINT AS n_lines, CASE WHEN takes THEN gone ELSE 0 END::BIGINT AS n_removed, md5(coalesce(CASE WHEN takes THEN clean ELSE text END, '')) AS kept_md5 FROM o"""

OP7 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^ \\t-\\r]+') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g),
c AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM m WHERE c > 1) GROUP BY rid),
ll AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \\t-\\r]') GROUP BY rid),
b AS (SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN ll USING (rid) LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
g2 AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source), {_prior("d", "g2")},
q AS (SELECT source, n, (k + s * p) / (n + s) AS mean, s FROM g2, b_d)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND coalesce(mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)), 0) <= 0.5 AS kept FROM f LEFT JOIN q USING (source)"""
