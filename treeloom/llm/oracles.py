"""DuckDB SQL for those operators that SQL can express."""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT rid, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM pos WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE k > 1) GROUP BY rid),
f AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
r AS (SELECT rid, lang, source, base_failed, unnest([
        {'rate': 'r_symbols', 'v': 1000 * n_symbols // n_words, 'slack': 100, 'low': false},
        {'rate': 'r_dup_lines', 'v': 1000 * n_dup_lines // n_words, 'slack': 30, 'low': false},
        {'rate': 'r_repeat', 'v': 1000 * n_repeat_words // n_words, 'slack': 300, 'low': false},
        {'rate': 'r_chars', 'v': 100 * word_chars // n_words, 'slack': 100, 'low': true}], recursive := true) FROM b WHERE n_words > 0),
s AS (SELECT *, CASE WHEN v < 256 THEN v ELSE (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) END AS bin FROM r WHERE NOT base_failed),
q1 AS (SELECT lang, source, rate, count(*) AS n, quantile_disc(bin, 0.25) AS lo, quantile_disc(bin, 0.75) AS hi FROM s GROUP BY ALL),
q2 AS (SELECT lang, rate, count(*) AS n, quantile_disc(bin, 0.25) AS lo, quantile_disc(bin, 0.75) AS hi FROM s GROUP BY ALL),
q3 AS (SELECT rate, quantile_disc(bin, 0.25) AS lo, quantile_disc(bin, 0.75) AS hi FROM s GROUP BY ALL),
g AS (SELECT r.rid, r.v, r.slack, r.low,
        CASE WHEN q1.n >= 30 THEN q1.lo WHEN q2.n >= 30 THEN q2.lo ELSE q3.lo END AS lo,
        CASE WHEN q1.n >= 30 THEN q1.hi WHEN q2.n >= 30 THEN q2.hi ELSE q3.hi END AS hi
      FROM r LEFT JOIN q1 ON r.lang IS NOT DISTINCT FROM q1.lang AND r.source IS NOT DISTINCT FROM q1.source AND r.rate = q1.rate
             LEFT JOIN q2 ON r.lang IS NOT DISTINCT FROM q2.lang AND r.rate = q2.rate LEFT JOIN q3 ON r.rate = q3.rate),
o AS (SELECT rid, bool_or(v > hi + 3 * (hi - lo) + slack OR (low AND v < lo - 3 * (hi - lo) - slack)) AS outside FROM g GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(outside, false) AS kept
FROM b LEFT JOIN o USING (rid)
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _rest(url: str) -> str:
    return f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END, '')"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '^[^/?#]*'), {_AZ})"


def _node(url: str) -> str:
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || regexp_extract({_rest(url)}, '^[^/?#]*([^#]*)', 1) END"


def _attribute(name: str) -> str:
    found = f"coalesce(vals[list_position(names, '{name}')], '')"
    return f"""trim(replace(regexp_replace({found}, '^["'']|["'']$', '', 'g'), '&amp;', '&'))"""


_RAW = "|".join(rf"<{t}\b[^<>]*>(?:.*?</{t}\s*>|.*)" for t in "script style textarea title template noscript iframe xmp noembed noframes".split())
_TAG = rf"""'(?is)<!--(?:.*?-->|.*)|{_RAW}|<(?:link|meta)\b[^<>"'']*(?:"[^"]*"[^<>"'']*|''[^'']*''[^<>"'']*)*>'"""
_PAIR = r"""'(?s)([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?'"""

OP10 = (
    rf"""
WITH RECURSIVE parts AS (SELECT page_id, url, html, {_host('url')} AS host, regexp_extract({_rest('url')}, '^[^/?#]*([^?#]*)', 1) AS path, {_node('url')} AS node FROM pages),
rules(rule, said, domain, start) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
                                            ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
seen AS (SELECT url, host, path, node, unnest(regexp_extract_all(html, {_TAG})) AS tag FROM parts WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
tags AS (SELECT *, list_transform(regexp_extract_all(tag, {_PAIR}, 1), lambda x: translate(x, {_AZ})) AS names, regexp_extract_all(tag, {_PAIR}, 2) AS vals FROM seen WHERE regexp_matches(tag, '^(?i)<(?:link|meta)')),
said AS (SELECT *, {_attribute('rel')} AS rel, {_attribute('href')} AS href, {_attribute('http-equiv')} AS equiv, {_attribute('content')} AS content FROM tags),
aim AS (SELECT url, host, path, node, CASE WHEN translate(rel, {_AZ}) = 'canonical' THEN href WHEN translate(equiv, {_AZ}) = 'refresh'
          THEN trim(regexp_replace(regexp_extract(content, '(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*(.*)$', 1), '^[''"]|[''"]$', '', 'g')) END AS t FROM said),
whole AS (SELECT node, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'x://' || host || t WHEN starts_with(t, '?') THEN 'x://' || host || path || t
            WHEN t = '' OR starts_with(t, '#') THEN NULL ELSE 'x://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS t FROM aim WHERE t IS NOT NULL),
links AS (SELECT DISTINCT node AS a, {_node('t')} AS b FROM whole WHERE {_node('t')} IS NOT NULL),
"""
    + r"""both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
spots AS (SELECT node AS node, host, path FROM parts WHERE node IS NOT NULL UNION SELECT b, regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM both_ways),
ruled AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
          FROM (SELECT host, path FROM parts UNION SELECT host, path FROM spots) JOIN rules ON (host = domain OR suffix(host, '.' || domain)) AND prefix(path, start) GROUP BY host, path),
near AS (SELECT r.a AS node, bool_or(s.said = 'allow') AS allowed, bool_or(s.said = 'block') AS blocked FROM reach r JOIN spots n ON r.b = n.node JOIN ruled s USING (host, path) GROUP BY r.a)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN near.blocked AND NOT near.allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN ruled USING (host, path) LEFT JOIN near ON parts.node = near.node
"""
)

#: Part positions, then four rounds of (assignment, sums, floored means, next codebook), then the last assignment.
_ROUNDS = ",\n".join(
    f"""d{r} AS MATERIALIZED (SELECT x.rid, x.p, min((x.n - 2 * list_dot_product(x.q, c.q) + c.n)::BIGINT * 256 + c.i) AS v FROM x JOIN c{r} c ON x.p = c.p GROUP BY ALL),
m{r} AS (SELECT p, v % 256 AS i, k, sum(z)::BIGINT AS s, count(*) AS n FROM d{r} JOIN z USING (rid, p) GROUP BY ALL),
u{r} AS (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY k)::DOUBLE[] AS q FROM m{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT *, list_dot_product(q, q) AS n FROM (SELECT c.p, c.i, coalesce(u.q, c.q) AS q FROM c{r} c LEFT JOIN u{r} u ON u.p = c.p AND u.i = c.i))"""
    for r in range(4)
)
OP12 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT unnest([0, 1, 2, 3]) AS p),
x AS MATERIALIZED (SELECT *, list_dot_product(q, q) AS n FROM (SELECT rid, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS q FROM k, p)),
z AS MATERIALIZED (SELECT rid, p, unnest(q)::BIGINT AS z, generate_subscripts(q, 1) AS k FROM x),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS i, q, n FROM x WHERE rid <= 256),
{_ROUNDS},
d4 AS (SELECT x.rid, x.p, min((x.n - 2 * list_dot_product(x.q, c.q) + c.n)::BIGINT * 256 + c.i) AS v FROM x JOIN c4 c ON x.p = c.p GROUP BY ALL),
e AS (SELECT rid, string_agg(printf('%02x', v % 256), '' ORDER BY p) AS code, sum(v // 256)::BIGINT AS error FROM d4 GROUP BY rid),
h AS (SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY p, i, k)) AS codebooks_sha256 FROM (SELECT p, i, unnest(q) AS z, generate_subscripts(q, 1) AS k FROM c4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (rid), h
"""
