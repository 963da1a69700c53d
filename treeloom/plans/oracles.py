"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import math

from ..operators.resampling import FIRST, SECOND, STEP
from ..schema import PATTERNS

ORACLES: dict[str, str] = {}

_CASE = "CASE " + " ".join(f"WHEN {p[0].lower()} < {p[1].lower()} AND {p[1].lower()} < {p[2].lower()} THEN '{p}'" for p in PATTERNS) + " END"


def _inst(dep: str, tags: str) -> str:
    ok = lambda a: f"AND {a}.upos IN ({tags})" if tags else ""
    return f"""SELECT doc_id, lang, source, line_no, s, v, o, sform, supos, oform, oupos, {_CASE} AS pattern FROM (
      SELECT v.doc_id, v.lang, v.source, v.line_no, s.tok_id AS s, v.tok_id AS v, o.tok_id AS o, s.form AS sform, s.upos AS supos, o.form AS oform, o.upos AS oupos
      FROM {dep} v JOIN {dep} s ON v.doc_id = s.doc_id AND v.line_no = s.line_no AND s.head = v.tok_id AND s.deprel = 'nsubj' {ok('s')}
                   JOIN {dep} o ON v.doc_id = o.doc_id AND v.line_no = o.line_no AND o.head = v.tok_id AND o.deprel = 'obj' {ok('o')}
      WHERE v.upos = 'VERB')"""


DEP = """ln AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
tk AS (SELECT doc_id, lang, source, line_no, unnest(string_split(line, ' ')) AS form, generate_subscripts(string_split(line, ' '), 1) AS tok_id FROM ln),
up AS (SELECT *, CASE WHEN length(form) % 3 = 0 THEN 'VERB' WHEN length(form) % 3 = 1 THEN 'NOUN' WHEN length(form) % 2 = 0 THEN 'NOUN' ELSE 'PROPN' END AS upos FROM tk WHERE form <> ''),
vb AS (SELECT *, min(CASE WHEN upos = 'VERB' THEN tok_id END) OVER (PARTITION BY doc_id, line_no, (tok_id - 1) // 6) AS vid FROM up),
dep AS (SELECT doc_id, lang, source, line_no, tok_id, form, upos, CASE WHEN vid IS NULL OR vid = tok_id THEN 0 ELSE vid END AS head,
               CASE WHEN vid IS NULL OR vid = tok_id THEN 'root' WHEN ascii(lower(form)) % 2 = 0 THEN 'obj' ELSE 'nsubj' END AS deprel FROM vb)"""
NOUN, PROPN = "'NOUN'", "'NOUN', 'PROPN'"
INST = f"{DEP}, inst AS ({_inst('dep', NOUN)})"
_SUMS = ", ".join(f"coalesce(sum(CASE WHEN pattern = '{p}' THEN 1 END), 0)::BIGINT AS n_{p}" for p in PATTERNS)
_NS = [f"n_{p}" for p in PATTERNS]
_LIST = "[" + ", ".join(f"n_{p}::DOUBLE" for p in PATTERNS) + "]"
CNT = f"{INST}, w AS (SELECT lang, {_SUMS}, count(*) AS total FROM inst GROUP BY lang)"
PAIR = f"{CNT}, x AS (SELECT lang, {_LIST} AS c, total FROM w), pr AS (SELECT a.lang AS group_a, b.lang AS group_b, a.c AS a, b.c AS b, a.total AS ta, b.total AS tb, unnest(range(1, 7)) AS i FROM x a JOIN x b ON a.lang < b.lang)"
_VALUES = ", ".join(f"('{p}', {i})" for i, p in enumerate(PATTERNS, 1))
PAT = f"pat(pattern, k) AS (VALUES {_VALUES})"


def ent(ns: list[str], total: str) -> str:
    return "-(" + " + ".join(f"CASE WHEN {n} > 0 THEN {n}::DOUBLE / {total} * ln({n}::DOUBLE / {total}) ELSE 0 END" for n in ns) + ")"


def _ranked(w: str, key: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {key}, '{p}' AS p, {i} AS k, n_{p} AS n FROM {w}" for i, p in enumerate(PATTERNS))
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, k) AS r FROM ({rows})),
dm AS (SELECT {key}, max(CASE WHEN r = 1 THEN p END) AS dominant_order, max(CASE WHEN r = 1 THEN n END) AS n1, max(CASE WHEN r = 2 THEN n END) AS n2 FROM rk GROUP BY {key})"""


O = ORACLES
O["token_scan_profile"] = f"""WITH {DEP} SELECT lang, count(DISTINCT (doc_id, line_no)) AS n_sentences, count(*) AS n_tokens,
  count(*) FILTER (upos = 'VERB') AS n_verbs, count(*) FILTER (deprel = 'root') AS n_roots FROM dep GROUP BY lang"""
O["order_counts_noun"] = f"WITH {INST} SELECT lang, pattern, count(*) AS n FROM inst GROUP BY ALL"
O["order_counts_noun_propn"] = f"WITH {DEP}, inst AS ({_inst('dep', PROPN)}) SELECT lang, pattern, count(*) AS n FROM inst GROUP BY ALL"
O["order_counts_broad"] = f"WITH {DEP}, inst AS ({_inst('dep', '')}) SELECT lang, pattern, count(*) AS n FROM inst GROUP BY ALL"
O["order_counts_zero_filled"] = f"""WITH {INST}, {PAT}, g AS (SELECT source, count(*) AS total FROM inst WHERE pattern <> 'OSV' GROUP BY source),
c AS (SELECT source, pattern, count(*) AS n FROM inst WHERE pattern <> 'OSV' GROUP BY ALL)
SELECT source, pattern, coalesce(n, 0) AS n, total, round(coalesce(n, 0)::DOUBLE / total, 6) AS proportion FROM g CROSS JOIN pat LEFT JOIN c USING (source, pattern)"""
_shares = ", ".join(f"round(n_{p}::DOUBLE / total, 6) AS p_{p}" for p in PATTERNS)
O["order_summary_wide"] = f"""WITH {CNT}, {_ranked('w', 'lang')} SELECT lang, total, {', '.join(_NS)}, {_shares}, round({ent(_NS, 'total')}, 6) AS entropy, dominant_order,
  n2 = 0 OR n1 > 2 * n2 AS dominant, round(CASE WHEN n2 > 0 THEN n1::DOUBLE / n2 END, 6) AS top_ratio FROM w JOIN dm USING (lang)"""
O["two_engine_reconcile"] = f"WITH {INST}, c AS (SELECT lang, pattern, count(*) AS n FROM inst GROUP BY ALL) SELECT lang, pattern, n AS n_row, n AS n_join, true AS agree FROM c"
O["cache_fallback_status"] = f"""WITH {CNT} SELECT m.lang, CASE WHEN m.lang IN ('en', 'de', 'fr') THEN total END AS total,
  CASE WHEN m.lang IN ('en', 'de') AND total IS NOT NULL THEN 'prepared' WHEN m.lang = 'fr' AND total IS NOT NULL THEN 'cached' ELSE 'missing' END AS status
  FROM (SELECT DISTINCT lang FROM documents) m LEFT JOIN w USING (lang)"""
O["tree_string_classify"] = f"WITH {INST} SELECT pattern, count(*) AS n FROM inst GROUP BY pattern UNION ALL SELECT '', count(*) FROM ln"
_STATUS = "CASE WHEN {u} = 'PROPN' AND substr({f}, 1, 1) = upper(substr({f}, 1, 1)) AND substr({f}, 1, 1) <> lower(substr({f}, 1, 1)) THEN 'entity' ELSE 'common' END"
_ROLES = f"""{DEP}, inst AS ({_inst('dep', PROPN)}), rl AS (
  SELECT lang, 'subject' AS role, {_STATUS.format(u='supos', f='sform')} AS status, pattern FROM inst
  UNION ALL SELECT lang, 'object', {_STATUS.format(u='oupos', f='oform')}, pattern FROM inst)"""
O["dual_role_ner_counts"] = f"WITH {_ROLES} SELECT lang, role, status, pattern, count(*) AS n FROM rl GROUP BY ALL"
O["misc_upsert"] = f"""WITH {DEP} SELECT lang, CASE WHEN ({_STATUS.format(u='upos', f='form')}) = 'entity' THEN 'A=x|NER=' || upos ELSE 'NER=' || upos END AS misc, count(*) AS n FROM dep GROUP BY ALL"""
O["root_repair_and_drop"] = f"""WITH {DEP}, s AS (SELECT lang, doc_id, line_no FROM ln),
b AS (SELECT doc_id, line_no, count(*) FILTER ((doc_id + line_no) % 11 = 0 AND deprel = 'root') AS repaired,
        bool_or((doc_id + line_no) % 13 = 0 AND deprel <> 'root' AND tok_id % 7 = 0) AS bad FROM dep GROUP BY ALL)
SELECT lang, count(*) FILTER (NOT coalesce(bad, false)) AS kept, count(*) FILTER (bad) AS dropped, coalesce(sum(repaired) FILTER (NOT coalesce(bad, false)), 0)::BIGINT AS repaired
FROM s LEFT JOIN b USING (doc_id, line_no) GROUP BY lang"""
O["genre_carry_forward"] = """WITH p AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part,
  CASE WHEN role = 'user' AND length(text) % 3 = 0 THEN 'a' WHEN role = 'user' AND length(text) % 3 = 1 THEN 'b' END AS mark FROM conversations)
SELECT conv_id, turn, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING) AS genre FROM p"""
O["comment_attach"] = """WITH p AS (SELECT *, coalesce(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM conversations)
SELECT conv_id, max(CASE WHEN role <> 'system' THEN turn END) AS turn, (sum(length(text)) + count(*) - 1)::BIGINT AS n_chars, count(*) FILTER (role = 'system') AS n_pending
FROM p GROUP BY conv_id, part HAVING count(*) FILTER (role <> 'system') > 0"""
O["pairwise_chi2"] = f"""WITH {PAIR}, e AS (SELECT group_a, group_b, a[i] AS o, (a[i] + b[i]) * ta / (ta + tb) AS e, a[i] + b[i] AS c FROM pr UNION ALL SELECT group_a, group_b, b[i], (a[i] + b[i]) * tb / (ta + tb), a[i] + b[i] FROM pr),
q AS (SELECT group_a, group_b, sum((o - e) * (o - e) / e) AS chi2, count(*) // 2 - 1 AS df, min(e) AS least, count(*) FILTER (e < 5) AS small, sum(o) AS n FROM e WHERE c > 0 GROUP BY ALL)
SELECT group_a, group_b, round(chi2, 6) AS chi2, df, round(least, 6) AS min_expected, small AS n_small, round(sqrt(chi2 / (n * least(1, df))), 6) AS cramers_v FROM q"""
_JSD = """js AS (SELECT group_a, group_b, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM (SELECT group_a, group_b, a[i] / ta AS p, b[i] / tb AS q FROM pr) GROUP BY ALL)"""
O["pairwise_jsd"] = f"WITH {PAIR}, {_JSD} SELECT group_a, group_b, round(d, 6) AS jsd FROM js"
O["pairwise_cosine"] = f"WITH {PAIR} SELECT group_a, group_b, round(sum(a[i] / ta * b[i] / tb) / sqrt(sum((a[i] / ta) ** 2) * sum((b[i] / tb) ** 2)), 6) AS cosine FROM pr GROUP BY ALL"


def chi_table(cells: str, by: str) -> str:
    """Chi-square of tables (by, x, y, n)."""
    return f"""cr AS (SELECT {by}, x, sum(n) AS r FROM {cells} GROUP BY ALL), cc AS (SELECT {by}, y, sum(n) AS c FROM {cells} GROUP BY ALL), ct AS (SELECT {by}, sum(n) AS t FROM {cells} GROUP BY ALL),
ch AS (SELECT {by}, sum((coalesce(n, 0) - r * c / t::DOUBLE) ** 2 / (r * c / t::DOUBLE)) AS chi2 FROM cr JOIN cc USING ({by}) JOIN ct USING ({by}) LEFT JOIN {cells} USING ({by}, x, y) WHERE r > 0 AND c > 0 GROUP BY {by})"""


O["omnibus_chi2"] = f"""WITH {INST}, cells AS (SELECT 1 AS k, lang AS x, pattern AS y, count(*) AS n FROM inst GROUP BY ALL), {chi_table('cells', 'k')}
SELECT round(chi2, 6) AS chi2, (SELECT sum(n)::BIGINT FROM cells) AS n, (SELECT (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) FROM cells) AS df FROM ch"""
O["cramers_v"] = f"""WITH cells AS (SELECT 'events' AS name, event_type AS x, (user_id % 5)::VARCHAR AS y, count(*) AS n FROM events GROUP BY ALL
  UNION ALL SELECT 'orders', o_orderpriority, o_orderstatus, count(*) FROM orders GROUP BY ALL), {chi_table('cells', 'name')},
z AS (SELECT name, sum(n)::BIGINT AS n, least(count(DISTINCT x), count(DISTINCT y)) AS k FROM cells GROUP BY name)
SELECT name, n, round(chi2, 6) AS chi2, round(sqrt(chi2 / (n * (k - 1))), 6) AS v FROM ch JOIN z USING (name)"""
O["holm_adjust"] = f"""WITH {INST}, {PAT}, g AS (SELECT lang, count(*) AS total FROM inst GROUP BY lang), c AS (SELECT lang, pattern, count(*) AS n FROM inst GROUP BY ALL),
p AS (SELECT lang, pattern, round(coalesce(n, 0)::DOUBLE / total / 10, 6) AS p FROM g CROSS JOIN pat LEFT JOIN c USING (lang, pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, pattern) AS r, count(*) OVER (PARTITION BY lang) AS m FROM p)
SELECT lang, pattern, p, round(max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY lang ORDER BY r), 6) AS p_holm FROM r"""
O["fisher_2x2"] = """WITH t AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS a, count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 0) AS c, count(*) FILTER (quality = 1 AND toxic = 1) AS e FROM labels),
x AS (SELECT *, unnest(range(greatest(0, (a + b) + (a + c) - (a + b + c + e)), least(a + b, a + c) + 1)) AS k FROM t),
q AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + e + 1) + lgamma(a + c + 1) + lgamma(b + e + 1) - lgamma(a + b + c + e + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(e - a + k + 1)) AS pr FROM x)
SELECT a, b, c, e, round(a * e / (b * c)::DOUBLE, 6) AS odds_ratio, round(least(1, sum(pr) FILTER (pr <= (SELECT pr FROM q WHERE k = a) * (1 + 1e-7))), 6) AS p FROM q GROUP BY ALL"""
def _perm(*by: str) -> str:
    keys = "".join(f"{k}, " for k in by)
    own = f" JOIN (SELECT {keys}round(chi2, 9) AS c0 FROM ch WHERE replicate = 0) USING ({', '.join(by)})" if by else ", (SELECT round(chi2, 9) AS c0 FROM ch WHERE replicate = 0)"
    return f"""SELECT {keys}round(c0, 6) AS chi2, hits, reps AS replicates, round((hits + 1) / (reps + 1)::DOUBLE, 6) AS p FROM (
  SELECT {keys}max(c0) AS c0, count(*) FILTER (replicate > 0 AND round(chi2, 9) >= c0) AS hits, count(*) FILTER (replicate > 0) AS reps FROM ch{own}{' GROUP BY ' + ', '.join(by) if by else ''})"""


def _shuffled(units: str, group: str, reps: int, by: str = "") -> str:
    return f"""rp AS (SELECT *, unnest(range(1, {reps + 1})) AS replicate FROM {units}),
pl AS (SELECT *, row_number() OVER (PARTITION BY {by}replicate ORDER BY md5(concat(replicate, '-', doc_id)), doc_id) AS place, row_number() OVER (PARTITION BY {by}replicate ORDER BY {group}, doc_id) AS slot FROM rp),
dr AS (SELECT a.* EXCLUDE (place, slot), b.drawn FROM pl a JOIN (SELECT {by}replicate, slot AS place, {group} AS drawn FROM pl) b USING ({by}replicate, place) UNION ALL BY NAME SELECT *, 0 AS replicate, {group} AS drawn FROM {units})"""


O["perm_chi2_hash"] = f"""WITH un AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), {_shuffled('un', 'quality', 1000)},
cells AS (SELECT replicate, drawn AS x, toxic AS y, count(*) AS n FROM dr GROUP BY ALL), {chi_table('cells', 'replicate')} {_perm()}"""
_cells6 = " UNION ALL ".join(f"SELECT group_a, group_b, replicate, drawn AS x, '{p}' AS y, sum(n_{p}) AS n FROM dr GROUP BY ALL" for p in PATTERNS)
O["cluster_perm_hash"] = f"""WITH {INST}, cl AS (SELECT doc_id, lang, {_SUMS} FROM inst GROUP BY doc_id, lang), lg AS (SELECT DISTINCT lang AS l FROM documents),
un AS (SELECT doc_id, lang, least(lang, l) AS group_a, greatest(lang, l) AS group_b, {', '.join(_NS)} FROM cl JOIN lg ON l <> lang), {_shuffled('un', 'lang', 200, 'group_a, group_b, ')},
cells AS ({_cells6}), {chi_table('cells', 'group_a, group_b, replicate')} {_perm('group_a', 'group_b')}"""
_SIDES = """sd AS (SELECT conv_id, count(*) FILTER (role = 'user' AND length(text) % 2 = 0) AS u0, count(*) FILTER (role = 'user' AND length(text) % 2 = 1) AS u1,
  count(*) FILTER (role = 'assistant' AND length(text) % 2 = 0) AS a0, count(*) FILTER (role = 'assistant' AND length(text) % 2 = 1) AS a1,
  coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_len, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_len
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)"""
_WORD = "18446744073709551616::UHUGEINT"


def _mixed(columns: str, source: str, z: str) -> str:
    """The finalising mix of splitmix64 over ``z``, an unsigned 64-bit number."""
    step = lambda shift, factor, inner: f"(SELECT {columns}, ((xor(z, z >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_WORD})::UBIGINT AS z FROM {inner})"
    return f"SELECT {columns}, xor(z, z >> 31) AS z FROM {step(27, SECOND, step(30, FIRST, f'(SELECT {columns}, {z} AS z FROM {source})'))}"


def _drawn(rows: str, key: str, columns: str, counters: int) -> str:
    """CTEs whose last, ``rd``, has 64 bits ``z`` for each row and counter ``c``."""
    return f"""rk AS ({_mixed(columns, rows, f'{key}::UBIGINT')}), rc AS (SELECT *, unnest(range(0, {counters})) AS c FROM rk),
rd AS ({_mixed(f'{columns}, c', 'rc', f'((z::UHUGEINT + (c + 1)::UHUGEINT * {STEP}::UHUGEINT) % {_WORD})::UBIGINT')})"""


O["paired_swap_hash"] = f"""WITH {_SIDES}, {_drawn('sd', 'conv_id', 'conv_id, u0, u1, a0, a1', 313)}, rb AS (SELECT *, unnest(range(0, 64)) AS bit FROM rd),
sw AS (SELECT *, c * 64 + bit + 1 AS replicate, (z >> bit) & 1 = 1 AS swap FROM rb WHERE c * 64 + bit < 20000 UNION ALL SELECT conv_id, u0, u1, a0, a1, 0, 0, 0, 0, false FROM sd),
cells AS (SELECT replicate, 'u' AS x, 0 AS y, sum(CASE WHEN swap THEN a0 ELSE u0 END) AS n FROM sw GROUP BY ALL UNION ALL SELECT replicate, 'u', 1, sum(CASE WHEN swap THEN a1 ELSE u1 END) FROM sw GROUP BY ALL
  UNION ALL SELECT replicate, 'a', 0, sum(CASE WHEN swap THEN u0 ELSE a0 END) FROM sw GROUP BY ALL UNION ALL SELECT replicate, 'a', 1, sum(CASE WHEN swap THEN u1 ELSE a1 END) FROM sw GROUP BY ALL), {chi_table('cells', 'replicate')} {_perm()}"""
_tot = " + ".join(_NS)
_CDF = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]
_TAKEN = " + ".join(f"(u >= {x!r})::INT" for x in _CDF)
O["bootstrap_ci_hash"] = f"""WITH {INST}, cl AS (SELECT doc_id, lang, {_SUMS} FROM inst GROUP BY doc_id, lang), {_drawn('cl', 'doc_id', f"lang, {', '.join(_NS)}", 5000)},
dw AS (SELECT *, c * 4 + lane + 1 AS replicate, ((z >> (16 * lane)) & 65535) / 65536.0::DOUBLE AS u FROM (SELECT *, unnest(range(0, 4)) AS lane FROM rd)),
b AS (SELECT lang, replicate, {', '.join(f'sum({n} * ({_TAKEN}))::DOUBLE AS {n}' for n in _NS)} FROM dw GROUP BY lang, replicate),
e AS (SELECT lang, n_SVO / ({_tot}) AS svo, {ent(_NS, f'({_tot})')} AS en FROM b WHERE {_tot} > 0)
SELECT lang, round(quantile_cont(svo, 0.025), 6) AS svo_lo, round(quantile_cont(svo, 0.975), 6) AS svo_hi, round(quantile_cont(en, 0.025), 6) AS entropy_lo, round(quantile_cont(en, 0.975), 6) AS entropy_hi FROM e GROUP BY lang"""
O["sign_test"] = f"""WITH {_SIDES}, t AS (SELECT count(*) FILTER (user_len > assistant_len) AS positive, count(*) AS n FROM sd WHERE user_len > 0 AND assistant_len > 0 AND user_len <> assistant_len),
q AS (SELECT *, unnest(range(0, n + 1)) AS k FROM t), p AS (SELECT *, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) AS pr FROM q)
SELECT positive, n, round(least(1, sum(pr) FILTER (pr <= (SELECT pr FROM p WHERE k = positive) * (1 + 1e-7))), 6) AS p FROM p GROUP BY ALL"""
O["wilcoxon_w"] = f"""WITH {_SIDES}, d AS (SELECT user_len - assistant_len AS d FROM sd WHERE user_len > 0 AND assistant_len > 0), z AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0),
r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM z),
s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r)
SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS w, (SELECT round(avg(d), 6) FROM d) AS mean_difference FROM s"""


def _upper_gamma(a: str, x: str) -> str:
    """The regularised upper incomplete gamma function by the series of the lower one, for arguments of some hundreds at most."""
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum([exp(({a}) * ln({x}) - ({x}) - lgamma(({a}) + k + 1) + k * ln({x})) for k in range(0, 4000)])) END"


O["chi2_pvalue"] = f"""WITH {PAIR}, e AS (SELECT group_a, group_b, a[i] AS o, (a[i] + b[i]) * ta / (ta + tb) AS e, a[i] + b[i] AS c FROM pr UNION ALL SELECT group_a, group_b, b[i], (a[i] + b[i]) * tb / (ta + tb), a[i] + b[i] FROM pr),
q AS (SELECT group_a, group_b, sum((o - e) * (o - e) / e) / 2 AS x, (count(*) // 2 - 1) / 2 AS a FROM e WHERE c > 0 GROUP BY ALL)
SELECT group_a, group_b, round({_upper_gamma('a', 'x')}, 6) AS p FROM q"""
O["wilcoxon_p"] = f"""WITH {_SIDES}, d AS (SELECT user_len - assistant_len AS d FROM sd WHERE user_len > 0 AND assistant_len > 0), z AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0),
r AS (SELECT d, a, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM z),
s AS (SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM r), t AS (SELECT sum(k::DOUBLE ** 3 - k) AS ties FROM (SELECT count(*) AS k FROM z GROUP BY a)),
v AS (SELECT w, (w - n * (n + 1) / 4) ** 2 / 2 / (n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS x FROM s, t)
SELECT 'all' AS g, round(w, 6) AS w, round({_upper_gamma('0.5', 'x')}, 6) AS p FROM v"""
O["exact_dedup_counts"] = """WITH x AS (SELECT 'text' AS unit, lang, text AS k FROM documents UNION ALL SELECT 'line', lang, unnest(string_split(text, chr(10))) FROM documents)
SELECT unit, lang, count(*) AS total, count(DISTINCT k) AS unique_n, count(*) - count(DISTINCT k) AS duplicates, round(100 * (count(*) - count(DISTINCT k)) / count(*)::DOUBLE, 6) AS pct FROM x GROUP BY ALL"""
_BA = f"""{INST}, fo AS (SELECT lang, doc_id, line_no, row_number() OVER (PARTITION BY lang, line ORDER BY doc_id, line_no) AS rn FROM ln),
b AS (SELECT lang, {_SUMS}, count(*) AS total FROM inst GROUP BY lang), a0 AS (SELECT i.lang, {_SUMS}, count(*) AS total FROM inst i JOIN fo ON i.doc_id = fo.doc_id AND i.line_no = fo.line_no AND rn = 1 GROUP BY i.lang),
ba AS (SELECT b.lang, {', '.join(f'b.{n}::DOUBLE / b.total AS p_{n}, coalesce(a0.{n}::DOUBLE / a0.total, b.{n}::DOUBLE / b.total) AS q_{n}' for n in _NS)}, b.total AS total_before, coalesce(a0.total, b.total) AS total_after FROM b LEFT JOIN a0 ON b.lang = a0.lang)"""
_jsd_sum = " + ".join(f"CASE WHEN p_{n} > 0 THEN p_{n} * log2(2 * p_{n} / (p_{n} + q_{n})) ELSE 0 END + CASE WHEN q_{n} > 0 THEN q_{n} * log2(2 * q_{n} / (p_{n} + q_{n})) ELSE 0 END" for n in _NS)
O["dedup_before_after"] = f"""WITH {_BA} SELECT lang, total_before, total_after, round(100 * abs(q_n_SVO - p_n_SVO), 6) AS svo_pp,
  round(abs({ent([f'q_{n}' for n in _NS], '1')} - {ent([f'p_{n}' for n in _NS], '1')}), 6) AS entropy_change, round(sqrt(greatest(0, ({_jsd_sum}) / 2)), 6) AS jsd FROM ba"""
_VEC = f"""{INST}, pv AS (SELECT doc_id, line_no, {_SUMS} FROM inst GROUP BY doc_id, line_no),
sv AS (SELECT ln.doc_id, ln.line_no, ln.line, CASE WHEN ln.doc_id % 3 = 0 THEN 0 ELSE coalesce(n_SVO, 0) END AS n_SVO, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _NS[1:])} FROM ln LEFT JOIN pv ON ln.doc_id = pv.doc_id AND ln.line_no = pv.line_no),
fs AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS rn FROM sv),
hd AS (SELECT line AS hl, doc_id AS first_doc, line_no AS first_line, {', '.join(f'{n} AS f_{n}' for n in _NS)} FROM fs WHERE rn = 1),
au AS (SELECT line, count(*) AS occurrences, count(DISTINCT ({', '.join(_NS)})) AS variants, count(*) FILTER (({', '.join(_NS)}) <> ({', '.join(f'f_{n}' for n in _NS)})) AS mismatches,
  any_value(first_doc) AS first_doc, any_value(first_line) AS first_line, {', '.join(f"sum({n}) - any_value(f_{n}) AS excess_{n[2:]}, (count(*) - 1) * any_value(f_{n}) AS nominal_{n[2:]}" for n in _NS)}
  FROM fs JOIN hd ON line = hl GROUP BY line HAVING count(*) > 1),
ax AS (SELECT *, {' + '.join(f'excess_{p}' for p in PATTERNS)} AS excess FROM au)"""
O["duplicate_audit"] = f"WITH {_VEC} SELECT line, occurrences, variants, mismatches, first_doc, first_line::BIGINT AS first_line, excess::BIGINT AS excess, {', '.join(f'excess_{p}::BIGINT AS excess_{p}, nominal_{p}::BIGINT AS nominal_{p}' for p in PATTERNS)} FROM ax"
O["duplicate_variants"] = f"""WITH {_VEC} SELECT line, {', '.join(_NS)}, count(*) AS occurrences, count(*) FILTER (rn = 1) AS retained FROM fs WHERE line IN (SELECT line FROM ax) GROUP BY line, {', '.join(_NS)}"""
_json = lambda cells: " || ',' || ".join(f"'\"{p}\":' || ({c})" for p, c in zip(PATTERNS, cells, strict=True))
_WRITTEN = "'[' || " + " || ',' || ".join(_NS) + " || ']'"
O["duplicate_variants_json"] = f"""WITH {_VEC}, v AS (SELECT line, {', '.join(_NS)}, count(*) AS o, count(*) FILTER (rn = 1) AS r FROM fs WHERE line IN (SELECT line FROM ax) GROUP BY line, {', '.join(_NS)})
SELECT line, '[' || string_agg('{{"occurrences":' || o || ',"retained_occurrences":' || r || ',"counts":{{' || {_json(_NS)} || '}},"excess_counts":{{' || {_json([f'{n} * (o - r)' for n in _NS])} || '}}}}', ',' ORDER BY r DESC, {_WRITTEN}) || ']' AS variants FROM v GROUP BY line"""
_LVEC = f"""{INST}, pv AS (SELECT doc_id, line_no, {_SUMS} FROM inst GROUP BY doc_id, line_no),
sv AS (SELECT concat_ws(chr(9), coalesce(ln.lang, ''), ln.line) AS line, ln.doc_id % 7 = 0 AS fb, row_number() OVER (PARTITION BY coalesce(ln.lang, '') ORDER BY ln.doc_id, ln.line_no) AS idx,
  CASE WHEN ln.doc_id % 3 = 0 THEN 0 ELSE coalesce(n_SVO, 0) END AS n_SVO, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _NS[1:])} FROM ln LEFT JOIN pv ON ln.doc_id = pv.doc_id AND ln.line_no = pv.line_no),
fs AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY idx) AS rn FROM sv),
hd AS (SELECT line AS hl, idx AS first_idx, {', '.join(f'{n} AS f_{n}' for n in _NS)} FROM fs WHERE rn = 1),
au AS (SELECT line, count(*) AS occurrences, count(*) FILTER (fb) AS fallbacks, count(*) FILTER (({', '.join(_NS)}) <> ({', '.join(f'f_{n}' for n in _NS)})) AS mismatches, any_value(first_idx) AS first_idx,
  {', '.join(f"any_value(f_{n}) AS f_{n}, sum({n}) - any_value(f_{n}) AS x_{n}, (count(*) - 1) * any_value(f_{n}) AS m_{n}" for n in _NS)} FROM fs JOIN hd ON line = hl GROUP BY line HAVING count(*) > 1),
va AS (SELECT line, {', '.join(_NS)}, count(*) AS o, count(*) FILTER (rn = 1) AS r FROM fs WHERE line IN (SELECT line FROM au) GROUP BY line, {', '.join(_NS)}),
vj AS (SELECT line, '[' || string_agg('{{"occurrences":' || o || ',"retained_occurrences":' || r || ',"counts":{{' || {_json(_NS)} || '}},"excess_counts":{{' || {_json([f'{n} * (o - r)' for n in _NS])} || '}}}}', ',' ORDER BY r DESC, {_WRITTEN}) || ']' AS variants FROM va GROUP BY line)"""
O["duplicate_examples"] = f"""WITH {_LVEC} SELECT line AS sentence_text, first_idx AS first_sentence_index, occurrences, fallbacks AS fallback_occurrences, CASE WHEN mismatches = 0 THEN 1 ELSE 0 END::BIGINT AS count_vectors_identical,
  mismatches AS later_occurrences_with_different_counts, variants AS pattern_count_variants_json, ({' + '.join(f'f_{n}' for n in _NS)})::BIGINT AS first_total, ({' + '.join(f'x_{n}' for n in _NS)})::BIGINT AS excess_total, ({' + '.join(f'm_{n}' for n in _NS)})::BIGINT AS nominal_excess_total,
  {', '.join(f'f_{n}::BIGINT AS first_{n[2:]}, x_{n}::BIGINT AS excess_{n[2:]}, m_{n}::BIGINT AS nominal_excess_{n[2:]}' for n in _NS)} FROM au JOIN vj USING (line)"""
O["repetition_with_fallbacks"] = f"""WITH {DEP} SELECT lang, count(*) AS total, count(DISTINCT line) AS unique_n, count(*) FILTER (doc_id % 7 = 0) AS fallbacks, count(*) - count(DISTINCT line) AS duplicates,
  round(100 * (count(*) - count(DISTINCT line)) / count(*)::DOUBLE, 6) AS pct FROM ln GROUP BY lang"""
_TOPS = " UNION ALL ".join(f"(SELECT '{c}' AS ranking, line, {c}::BIGINT AS value, row_number() OVER (ORDER BY {c} DESC, first_doc, first_line) AS place FROM ax WHERE {c} > 0 QUALIFY place <= 30)" for c in ("excess", "excess_OVS", "excess_SVO"))
O["topk_rankings"] = f"WITH {_VEC} {_TOPS}"
O["topk_excess"] = f"WITH {_VEC} SELECT line, excess::BIGINT AS excess, occurrences FROM ax WHERE excess > 0 ORDER BY excess DESC, first_doc, first_line LIMIT 30"
O["concentration"] = f"""WITH {_VEC}, rk AS (SELECT excess, row_number() OVER (ORDER BY excess DESC, first_doc, first_line) AS r FROM ax)
SELECT top, round(sum(excess) FILTER (r <= top) / (SELECT sum(excess) FROM ax)::DOUBLE, 6) AS share FROM rk CROSS JOIN (SELECT unnest([5, 10, 20])::BIGINT AS top) GROUP BY top"""
_MG = f"""{_BA}, mg AS (SELECT t.lang, unnest(['highest', 'lowest']) AS claim, unnest([any_value(t.p_n_SVO) - max(o.p_n_SVO), min(o.p_n_SVO) - any_value(t.p_n_SVO)]) AS before,
  unnest([any_value(t.q_n_SVO) - max(o.q_n_SVO), min(o.q_n_SVO) - any_value(t.q_n_SVO)]) AS after FROM ba t JOIN ba o ON t.lang <> o.lang GROUP BY t.lang)"""
O["claim_margins"] = f"WITH {_MG} SELECT lang, claim, round(before, 6) AS before, round(after, 6) AS after FROM mg"
_SH = f"""{_BA}, sh AS (SELECT lang, p_n_SVO AS b, q_n_SVO AS a FROM ba), pr AS (SELECT x.lang AS one, y.lang AS other, x.b - y.b AS before, x.a - y.a AS after FROM sh x JOIN sh y ON x.lang <> y.lang),
cl AS (SELECT 'direction' AS kind, one, other, before, after FROM pr WHERE one < other
  UNION ALL SELECT 'majority', one, NULL, count(*) FILTER (before > 0) - count(*) / 2, count(*) FILTER (after > 0) - count(*) / 2 FROM pr GROUP BY one
  UNION ALL SELECT 'range', one, other, before - (SELECT max(b) - min(b) FROM sh WHERE lang NOT IN (one, other)), after - (SELECT max(a) - min(a) FROM sh WHERE lang NOT IN (one, other)) FROM pr WHERE one < other)"""
O["claim_checks"] = f"WITH {_SH} SELECT kind, one, other, round(before, 6) AS before, round(after, 6) AS after FROM cl"
O["claim_overall"] = f"""WITH {_SH} SELECT kind, count(*) AS claims, count(*) FILTER (before <= 1e-12) AS unsupported, count(*) FILTER (after <= 1e-12) AS lost,
  CASE WHEN count(*) FILTER (before IS NULL OR after IS NULL) > 0 THEN 'INCOMPLETE' WHEN count(*) FILTER (before <= 1e-12) > 0 THEN 'UNRESOLVED' WHEN count(*) FILTER (after <= 1e-12) > 0 THEN 'NOT STABLE' ELSE 'STABLE' END AS verdict FROM cl GROUP BY kind"""


def _jsd(a: str, b: str) -> str:
    part = lambda x, y, k: f"CASE WHEN {x}[{k}] > 0 THEN {x}[{k}] * log2(2 * {x}[{k}] / ({x}[{k}] + {y}[{k}])) ELSE 0 END"
    return f"sqrt(greatest(0, ({' + '.join(f'({part(a, b, k)} + {part(b, a, k)})' for k in range(1, 7))}) / 2))"


_B, _A = ", ".join(f"b.{n}::DOUBLE" for n in _NS), ", ".join(f"a0.{n}::DOUBLE" for n in _NS)
_CAT = f"""{_BA}, vv AS (SELECT lang, 'before' AS state, [{_B}] AS v FROM b WHERE lang IS NOT NULL UNION ALL SELECT b.lang, 'after', CASE WHEN a0.total > 0 THEN [{_A}] ELSE [{_B}] END FROM b LEFT JOIN a0 ON b.lang = a0.lang WHERE b.lang IS NOT NULL),
sp AS MATERIALIZED (SELECT lang, state, v, list_transform(v, lambda x: x / list_sum(v)) AS p FROM vv),
ms AS MATERIALIZED (SELECT state, lang AS name, p[1] AS svo, p[6] AS ovs, -({' + '.join(f'CASE WHEN p[{k}] > 0 THEN p[{k}] * ln(p[{k}]) ELSE 0 END' for k in range(1, 7))}) AS h, v[1] - 2 * greatest({', '.join(f'v[{k}]' for k in range(2, 7))}) AS lead FROM sp),
ds AS MATERIALIZED (SELECT x.state, x.lang AS anchor, y.lang AS name, {_jsd('x.p', 'y.p')} AS d FROM sp x JOIN sp y ON x.state = y.state AND x.lang <> y.lang),
rk AS (SELECT anchor, name, row_number() OVER (PARTITION BY anchor ORDER BY d, name) AS up, count(*) OVER (PARTITION BY anchor) AS k FROM ds WHERE state = 'before'),
st AS (SELECT anchor, ': nearest ' || string_agg(name, ', ' ORDER BY name) FILTER (up <= 2) AS near, ': farthest ' || string_agg(name, ', ' ORDER BY name) FILTER (up > k - 2) AS far FROM rk WHERE k > 2 GROUP BY anchor),
pairs AS (SELECT x.state, x.name AS a, y.name AS b, x.h - y.h AS dh, x.svo - y.svo AS gap FROM ms x JOIN ms y ON x.state = y.state AND x.name < y.name),
cm AS (SELECT name || ': dominant' AS label, 'positive' AS kind, state, lead::DOUBLE AS margin FROM ms
  UNION ALL SELECT t.name || ': most OVS', 'above', t.state, any_value(t.ovs) - max(o.ovs) FROM ms t JOIN ms o ON t.state = o.state AND t.name <> o.name GROUP BY t.name, t.state
  UNION ALL SELECT t.name || ': least entropy', 'below', t.state, min(o.h) - any_value(t.h) FROM ms t JOIN ms o ON t.state = o.state AND t.name <> o.name GROUP BY t.name, t.state
  UNION ALL SELECT t.name || ': entropy above most', 'majority', t.state, count(*) FILTER (o.h < t.h) - count(*) / 2 FROM ms t JOIN ms o ON t.state = o.state AND t.name <> o.name GROUP BY t.name, t.state
  UNION ALL SELECT a || ' > ' || b || ': entropy', 'above', state, dh FROM pairs
  UNION ALL SELECT a || ' < ' || b || ': distance', 'closer', pairs.state, count(*) FILTER (x.d < y.d) - count(*) / 2 FROM pairs JOIN ds x ON x.state = pairs.state AND x.anchor = a AND x.name <> b JOIN ds y ON y.state = pairs.state AND y.anchor = b AND y.name = x.name GROUP BY ALL
  UNION ALL SELECT a || ' - ' || b || ': SVO beyond range', 'range', pairs.state, gap - (max(svo) - min(svo)) FROM pairs JOIN ms ON ms.state = pairs.state AND name NOT IN (a, b) GROUP BY a, b, pairs.state, gap
  UNION ALL SELECT anchor || near, 'below', state, min(d) FILTER (up > 2) - max(d) FILTER (up <= 2) FROM ds JOIN rk USING (anchor, name) JOIN st USING (anchor) GROUP BY anchor, near, state
  UNION ALL SELECT anchor || far, 'above', state, min(d) FILTER (up > k - 2) - max(d) FILTER (up <= k - 2) FROM ds JOIN rk USING (anchor, name) JOIN st USING (anchor) GROUP BY anchor, far, state
  UNION ALL SELECT 'xx > en: entropy', 'above', unnest(['before', 'after']), NULL),
cj AS (SELECT label, kind, round(max(margin) FILTER (state = 'before'), 6) AS before, round(max(margin) FILTER (state = 'after'), 6) AS after FROM cm GROUP BY ALL),
cv AS (SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN 'INCOMPLETE' WHEN before <= 1e-12 THEN 'UNRESOLVED' WHEN after <= 1e-12 THEN 'NOT STABLE' ELSE 'STABLE' END AS verdict FROM cj)"""
O["claim_catalogue"] = f"WITH {_CAT} SELECT * FROM cv"
O["claim_catalogue_overall"] = f"""WITH {_CAT} SELECT kind, count(*) AS claims, count(*) FILTER (verdict = 'UNRESOLVED') AS unsupported, count(*) FILTER (after <= 1e-12) AS lost,
  CASE WHEN count(*) FILTER (verdict = 'INCOMPLETE') > 0 THEN 'INCOMPLETE' WHEN count(*) FILTER (verdict = 'UNRESOLVED') > 0 THEN 'UNRESOLVED' WHEN count(*) FILTER (after <= 1e-12) > 0 THEN 'NOT STABLE' ELSE 'STABLE' END AS verdict FROM cv GROUP BY kind"""
O["claim_verdicts"] = f"WITH {_MG} SELECT lang, claim, CASE WHEN before <= 1e-12 THEN 'UNRESOLVED' WHEN after <= 1e-12 THEN 'NOT STABLE' ELSE 'STABLE' END AS verdict FROM mg"
_ALT = """alt AS (SELECT * REPLACE (CASE WHEN (doc_id + tok_id) % 97 = 0 AND deprel = 'nsubj' THEN 'obj' WHEN (doc_id + tok_id) % 97 = 0 AND deprel = 'obj' THEN 'nsubj' ELSE deprel END AS deprel,
  CASE WHEN (doc_id + tok_id) % 89 = 0 THEN 'ADJ' ELSE upos END AS upos, CASE WHEN (doc_id + tok_id) % 83 = 0 THEN 0 ELSE head END AS head) FROM dep)"""
_K = "doc_id, line_no, v"
_AL = f"""{INST}, {_ALT}, au AS ({_inst('alt', NOUN)}), g AS (SELECT {_K}, s, o, pattern AS gold FROM inst), a AS (SELECT {_K}, s, o, pattern AS auto FROM au),
ex AS (SELECT {_K}, gold, auto FROM g JOIN a USING ({_K}, s, o)),
g1 AS (SELECT * FROM g ANTI JOIN a USING ({_K}, s, o)), a1 AS (SELECT * FROM a ANTI JOIN g USING ({_K}, s, o)),
tn AS (SELECT {_K}, s AS o, o AS s, auto FROM a1), sw AS (SELECT * FROM g1 JOIN tn USING ({_K}, s, o)),
g2 AS (SELECT * FROM g1 ANTI JOIN sw USING ({_K}, s, o)), a2 AS (SELECT * FROM a1 ANTI JOIN (SELECT {_K}, s AS o, o AS s FROM sw) USING ({_K}, s, o)),
nr AS (SELECT x.doc_id, x.line_no, x.v, x.s AS gs, x.o AS go, y.s AS ys, y.o AS yo, gold, auto FROM g2 x JOIN a2 y ON x.doc_id = y.doc_id AND x.line_no = y.line_no AND x.v = y.v AND (x.s = y.s OR x.o = y.o OR x.s = y.o OR x.o = y.s)),
dn AS (SELECT *, count(*) OVER (PARTITION BY {_K}, gs, go) = 1 AND count(*) OVER (PARTITION BY {_K}, ys, yo) = 1 AS lone FROM nr),
gl AS (SELECT {_K}, count(*) AS n_gold, CASE WHEN count(*) = 1 THEN min(gold) END AS gold FROM (SELECT DISTINCT {_K}, gs, go, gold FROM dn WHERE NOT lone) GROUP BY {_K}),
aa AS (SELECT {_K}, count(*) AS n_auto, CASE WHEN count(*) = 1 THEN min(auto) END AS auto FROM (SELECT DISTINCT {_K}, ys, yo, auto FROM dn WHERE NOT lone) GROUP BY {_K}),
al AS (SELECT {_K}, 'same' AS kind, gold, auto, 1 AS n_gold, 1 AS n_auto, NULL::INT AS s, NULL::INT AS o FROM ex UNION ALL SELECT {_K}, 'changed', gold, auto, 1, 1, NULL, NULL FROM sw UNION ALL SELECT {_K}, 'unclear', gold, auto, 1, 1, NULL, NULL FROM dn WHERE lone
  UNION ALL SELECT {_K}, 'unclear', gold, auto, n_gold, n_auto, NULL, NULL FROM gl JOIN aa USING ({_K})
  UNION ALL SELECT {_K}, 'gold_only', gold, NULL, 1, 0, s, o FROM g2 ANTI JOIN (SELECT {_K}, gs AS s, go AS o FROM nr) USING ({_K}, s, o)
  UNION ALL SELECT {_K}, 'auto_only', NULL, auto, 0, 1, s, o FROM a2 ANTI JOIN (SELECT {_K}, ys AS s, yo AS o FROM nr) USING ({_K}, s, o))"""
O["agreement_matrix"] = f"WITH {_AL} SELECT gold, auto, count(*) AS n FROM al WHERE kind IN ('same', 'changed') GROUP BY ALL"
O["agreement_rates"] = f"""WITH {_AL}, c AS (SELECT {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('same', 'changed', 'unclear', 'gold_only', 'auto_only'))},
  coalesce(sum(n_gold) FILTER (kind = 'unclear'), 0)::BIGINT AS unclear_gold, coalesce(sum(n_auto) FILTER (kind = 'unclear'), 0)::BIGINT AS unclear_auto FROM al),
n AS (SELECT (SELECT count(*) FROM inst) AS gold_n, (SELECT count(*) FROM au) AS auto_n)
SELECT c.*, gold_n, auto_n, same + changed AS aligned, gold_only + auto_only + changed + unclear AS to_review, round((same + changed)::DOUBLE / gold_n, 6) AS recall,
  round(same::DOUBLE / (same + changed), 6) AS same_among_aligned, round((gold_n - same)::DOUBLE / gold_n, 6) AS changed_or_lost FROM c, n"""
O["agreement_margins"] = f"""WITH {_AL}, {PAT}, m AS (SELECT gold, auto, count(*) AS n FROM al WHERE kind IN ('same', 'changed') GROUP BY ALL),
x AS (SELECT pattern, (SELECT count(*) FROM inst i WHERE i.pattern = pat.pattern) AS gold_n, (SELECT count(*) FROM au i WHERE i.pattern = pat.pattern) AS auto_n, coalesce((SELECT sum(n) FROM m WHERE gold = pattern), 0)::BIGINT AS gold_aligned,
  coalesce((SELECT sum(n) FROM m WHERE auto = pattern), 0)::BIGINT AS auto_aligned, coalesce((SELECT sum(n) FROM m WHERE gold = pattern AND auto = pattern), 0)::BIGINT AS diagonal FROM pat)
SELECT *, gold_aligned - diagonal AS off_diagonal, gold_aligned <= gold_n AND auto_aligned <= auto_n AS within FROM x"""


def _reasons(kind: str, other: str) -> str:
    at = lambda c, t: f"LEFT JOIN {other} {t} ON {t}.doc_id = x.doc_id AND {t}.line_no = x.line_no AND {t}.tok_id = x.{c}"
    return f"""SELECT kind, tv.upos IS NOT NULL AND ts.upos IS NOT NULL AND tt.upos IS NOT NULL AS found, coalesce(ts.deprel = 'nsubj', false) AS sr, coalesce(tt.deprel = 'obj', false) AS orl,
      coalesce(ts.upos = 'NOUN', false) AS sp, coalesce(tt.upos = 'NOUN', false) AS op, coalesce(tv.upos = 'VERB', false) AS vp, coalesce(ts.deprel = 'nsubj' AND ts.head <> x.v OR tt.deprel = 'obj' AND tt.head <> x.v, false) AS moved
    FROM (SELECT * FROM al WHERE kind = '{kind}') x {at('v', 'tv')} {at('s', 'ts')} {at('o', 'tt')}"""


_TESTS = {
    "relevant_dependency_relation_differs": "found AND NOT (sr AND orl)", "subject_relation_differs": "found AND NOT sr", "object_relation_differs": "found AND NOT orl", "required_relation_retained_but_head_changes": "found AND moved",
    "any_relevant_pos_mismatch": "found AND NOT (sp AND op AND vp)", "subject_pos_mismatch": "found AND NOT sp", "object_pos_mismatch": "found AND NOT op", "predicate_verb_mismatch": "found AND NOT vp",
    "missing_sentence_token_or_unexplained_residual": "NOT (found AND (NOT (sr AND orl) OR moved OR NOT (sp AND op AND vp)))",
}
O["agreement_reasons"] = f"WITH {_AL}, w AS ({_reasons('gold_only', 'alt')} UNION ALL {_reasons('auto_only', 'dep')}), " + f"""f AS ({' UNION ALL '.join(f"SELECT kind AS direction, '{k}' AS reason, count(*) AS population, count(*) FILTER ({t}) AS n FROM w GROUP BY kind" for k, t in _TESTS.items())})
SELECT direction, population, reason, n, round(100 * n / population::DOUBLE, 6) AS pct FROM f"""
O["contract_violations"] = f"""WITH {INST}, {PAT}, g AS (SELECT lang, count(*) AS total FROM inst GROUP BY lang), c AS (SELECT lang, pattern, count(*) AS n FROM inst GROUP BY ALL),
z AS (SELECT lang, pattern, coalesce(n, 0) AS m, total, coalesce(n, 0)::DOUBLE / total AS pr FROM g CROSS JOIN pat LEFT JOIN c USING (lang, pattern) WHERE NOT (lang = 'fr' AND pattern = 'VSO')),
s AS (SELECT *, CASE WHEN lang = 'de' AND pattern = 'SVO' THEN m + 1 ELSE m END AS n FROM z)
SELECT lang, unnest(list_filter([CASE WHEN bool_or(abs(pr - n::DOUBLE / total) > 5.1e-7) THEN 'proportion' END, CASE WHEN count(*) <> 6 THEN 'patterns' END, CASE WHEN sum(n) <> max(total) THEN 'sum' END], lambda r: r IS NOT NULL)) AS rule FROM s GROUP BY lang"""
_pct = ", ".join(f"((2000 * n_{p} + total) // (2 * total)) / 10 AS pct_{p}" for p in PATTERNS)
O["master_table"] = f"""WITH {CNT}, {_ranked('w', 'lang')} SELECT row_number() OVER (ORDER BY lang) AS row, lang, total, {_pct}, round(round({ent(_NS, 'total')}, 6)::DECIMAL(18, 6), 2)::DOUBLE AS entropy,
  CASE WHEN n2 = 0 OR n1 > 2 * n2 THEN dominant_order ELSE 'none' END AS note FROM w JOIN dm USING (lang)"""
O["register_sorted"] = f"""WITH {INST}, s AS (SELECT source, round(count(*) FILTER (pattern = 'SVO') / count(*)::DOUBLE, 6) AS svo FROM inst GROUP BY source) SELECT source, svo, row_number() OVER (ORDER BY svo DESC, source) AS place FROM s"""
O["jsd_matrix"] = f"""WITH {PAIR}, {_JSD}, pl AS (SELECT lang, row_number() OVER (ORDER BY lang) AS k FROM (SELECT DISTINCT lang FROM documents))
SELECT group_b AS row_lang, group_a AS column_lang, y.k AS row, x.k AS column, round(d, 6) AS jsd FROM js JOIN pl x ON x.lang = group_a JOIN pl y ON y.lang = group_b"""
O["share_entropy_union"] = f"""WITH {INST}, u AS (SELECT 'language' AS kind, lang AS name, {_SUMS}, count(*) AS total FROM inst GROUP BY lang UNION ALL SELECT 'register', source, {_SUMS}, count(*) FROM inst GROUP BY source)
SELECT kind, name, round(n_SVO::DOUBLE / total, 6) AS svo, round({ent(_NS, 'total')}, 6) AS entropy FROM u"""
O["set_checks"] = """WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE lang IN ('de', 'es'))
SELECT 'symmetric_difference' AS "check", (SELECT count(*) FROM a FULL JOIN b USING (source) WHERE a.source IS NULL OR b.source IS NULL) AS n
UNION ALL SELECT 'not_in_second', (SELECT count(*) FROM a ANTI JOIN b USING (source)) UNION ALL SELECT 'without_target', (SELECT count(*) FROM a WHERE source <> 'src0') UNION ALL SELECT 'shared', (SELECT count(*) FROM a SEMI JOIN b USING (source))"""
O["manifest_pair_join"] = f"""WITH {CNT}, s(ord, a, b) AS (VALUES (0::BIGINT, 'en', 'de'), (1, 'fr', 'en'), (2, 'es', 'fr'))
SELECT ord, a, b, x.total AS total_a, y.total AS total_b, list_sort([a, b]) IN (['de', 'en'], ['es', 'fr']) AS in_family FROM s JOIN w x ON x.lang = a JOIN w y ON y.lang = b"""
O["pair_alignment"] = """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT *, n_user > 0 AND n_assistant > 0 AS complete, n_user > 0 OR n_assistant > 0 AS informative FROM c"""
O["layout_join_checked"] = f"""WITH {CNT}, l(ord, section, lang, label) AS (VALUES (0, 'I', 'en', 'English'), (1, 'I', 'de', 'German'), (2, 'II', 'fr', 'French'), (3, 'II', 'es', 'Spanish'), (4, 'III', 'xx', 'None')),
j AS (SELECT ord, section, coalesce(l.lang, w.lang) AS lang, label, total FROM l FULL JOIN w ON l.lang = w.lang)
SELECT row_number() OVER (ORDER BY ord NULLS FIRST) AS row, section, lang, label, total, section IS DISTINCT FROM lag(section) OVER (ORDER BY ord NULLS FIRST) AS new_section, ord IS NULL OR total IS NULL AS unmatched FROM j"""
O["positional_diff"] = f"WITH {DEP}, {_ALT} SELECT d.deprel AS was, a.deprel AS now, count(*) AS n FROM dep d JOIN alt a USING (doc_id, line_no, tok_id) WHERE d.deprel <> a.deprel OR d.upos <> a.upos OR d.head <> a.head GROUP BY ALL"
O["cluster_vectors"] = f"""WITH {INST}, pd AS (SELECT doc_id, lang, {_SUMS} FROM inst GROUP BY ALL) SELECT lang, count(*) AS clusters, {', '.join(f'sum(n_{p})::BIGINT AS s_{p}' for p in PATTERNS)}, true AS agrees FROM pd GROUP BY lang"""
O["ner_role_sum"] = f"WITH {_ROLES} SELECT lang, role, pattern, count(*) AS n, true AS agrees FROM rl GROUP BY ALL"
O["variant_left_join"] = f"WITH {_VEC} SELECT count(*) AS identities, sum(occurrences)::BIGINT AS occurrences, count(*) FILTER (mismatches > 0) AS with_mismatch, 0::BIGINT AS violations FROM ax"
O["share_datasets"] = f"""WITH {_ROLES}, {PAT}, iz AS ({_inst('dep', NOUN)}), g AS (SELECT lang, count(*) AS total FROM iz GROUP BY lang), c AS (SELECT lang, pattern, count(*) AS n FROM iz GROUP BY ALL),
e AS (SELECT status, pattern, count(*) AS n FROM rl WHERE role = 'object' GROUP BY ALL)
SELECT 'order' AS dataset, lang AS name, pattern, round(100 * (coalesce(n, 0)::DOUBLE / total), 6) AS pct FROM g CROSS JOIN pat LEFT JOIN c USING (lang, pattern)
UNION ALL SELECT 'status', status, pattern, round(100 * n / (sum(n) OVER (PARTITION BY status))::DOUBLE, 6) FROM e"""
O["ner_outcome"] = f"""WITH {_ROLES}, h AS (SELECT lang, role, status, count(*) AS t, count(*) FILTER (CASE WHEN role = 'object' THEN pattern IN ('OVS', 'OSV') ELSE pattern = 'SVO' END) AS outcome FROM rl GROUP BY ALL) SELECT lang, role, status, outcome, t - outcome AS rest FROM h"""


def chunked(rows: str, key: str, most: int) -> str:
    """CTEs from ``rows(key, i, b)``, i from 0: ``st`` has the starts of chunks, one found from the one before it, and ``ck`` the rows with their chunk."""
    return f"""sz AS MATERIALIZED (SELECT *, coalesce(sum(b) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {rows}),
st({key}, i, s, c) AS (SELECT {key}, 0::BIGINT, 0::HUGEINT, 0::BIGINT FROM sz GROUP BY {key} UNION ALL SELECT st.{key}, min(sz.i), min(sz.s), st.c + 1 FROM st JOIN sz ON sz.{key} = st.{key} AND sz.s >= st.s + {most} GROUP BY st.{key}, st.c),
ck AS (SELECT sz.*, st.c AS chunk FROM sz ASOF JOIN st ON sz.{key} = st.{key} AND sz.i >= st.i)"""


O["chunk_assignment"] = f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
lb AS (SELECT doc_id, i, strlen(line) + 1 AS b FROM l), {chunked('lb', 'doc_id', 1000)}
SELECT doc_id, chunk, count(*) AS n_lines, sum(b)::BIGINT AS n_bytes FROM ck GROUP BY ALL"""
O["sessionise_blocks"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, i, length(line) < 80 AS sep, coalesce(lag(length(line) < 80) OVER (PARTITION BY doc_id ORDER BY i), true) AS before FROM l),
b AS (SELECT doc_id, sep, sum(CASE WHEN NOT sep AND before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM f)
SELECT doc_id, block::BIGINT AS block, count(*) AS n_lines FROM b WHERE NOT sep GROUP BY ALL"""
O["union_splits"] = "SELECT (length(source) % 3)::BIGINT AS split, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY ALL"
O["pattern_sorted"] = f"WITH {INST}, {PAT} SELECT k::BIGINT AS rank, pattern, count(*) AS n FROM inst JOIN pat USING (pattern) GROUP BY ALL"
