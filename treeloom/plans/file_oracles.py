"""DuckDB SQL for the queries over files: what their round trips should return."""

from __future__ import annotations

from ..schema import PATTERNS
from .oracles import _JSD, _NS, _STATUS, _SUMS, CNT, DEP, INST, ORACLES as O, PAIR, chunked, ent

#: Sentences of at least one token in a known language.
_SN = f"""{DEP}, ok AS (SELECT * FROM dep WHERE lang IS NOT NULL), sn AS (SELECT lang, doc_id, line_no, doc_id + line_no AS key, count(*) AS tokens, string_agg(form, ' ' ORDER BY tok_id) AS forms FROM ok GROUP BY ALL)"""
_MISC = f"CASE WHEN ({_STATUS.format(u='upos', f='form')}) = 'entity' THEN 'A=x|NER=' ELSE 'NER=' END"

O["conllu_roundtrip_counts"] = f"WITH {INST} SELECT lang, pattern, count(*) AS n FROM inst WHERE lang IS NOT NULL GROUP BY ALL"
O["conllu_plain_and_crlf"] = f"WITH {_SN} SELECT unnest(['plain', 'crlf']) AS reader, count(*) AS sentences, sum(tokens)::BIGINT AS tokens, 0::BIGINT AS fallbacks FROM sn"
O["conllu_fallback_text"] = f"""WITH {_SN}, t AS (SELECT sn.lang, sn.line_no % 2 = 1 AS is_fallback, CASE WHEN sn.line_no % 2 = 1 THEN forms ELSE line END AS text FROM sn JOIN ln ON ln.doc_id = sn.doc_id AND ln.line_no = sn.line_no)
SELECT lang, is_fallback, count(*) AS sentences, count(DISTINCT text) AS texts, sum(length(text))::BIGINT AS n_chars FROM t GROUP BY ALL"""
O["genre_partition_profile"] = f"""WITH {_SN} SELECT lang AS genre, count(*) AS blocks, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT AS ner_tokens FROM sn WHERE lang <> 'fr' GROUP BY lang
UNION ALL SELECT '(no genre)', count(*), NULL, NULL FROM sn WHERE lang = 'fr' HAVING count(*) > 0"""
O["genre_sentence_counts"] = f"""WITH {_SN} SELECT 'mapped' AS run, CASE WHEN key % 7 = 0 THEN '(no genre)' WHEN key % 5 = 0 THEN '(no syntax)' ELSE lang END AS genre, count(*) AS n FROM sn GROUP BY ALL
UNION ALL SELECT 'labelled', 'whole', count(*) FROM sn"""
O["term_genres"] = "SELECT CASE doc_id % 4 WHEN 0 THEN 'leposlovno' WHEN 1 THEN 'strokovno' WHEN 2 THEN 'publicisticno_splosno' END AS genre, count(*) AS n FROM documents GROUP BY ALL"
O["conllu_violations"] = f"""WITH {_SN} SELECT 'columns' AS rule, '3' AS token, count(*) AS n FROM ok WHERE (doc_id + line_no) % 11 = 0 AND tok_id = 3 HAVING count(*) > 0
UNION ALL SELECT 'head', '4', count(*) FROM ok WHERE (doc_id + line_no) % 13 = 0 AND tok_id = 4 HAVING count(*) > 0
UNION ALL SELECT 'text', NULL, count(*) FROM sn JOIN ln ON ln.doc_id = sn.doc_id AND ln.line_no = sn.line_no WHERE key % 17 = 0 AND line <> 'other' HAVING count(*) > 0"""
O["wide_rows_dropped"] = f"WITH {_SN} SELECT count(*) FILTER (key % 9 <> 0) AS kept, count(*) FILTER (key % 9 = 0) AS dropped FROM sn"
O["annotation_unchanged"] = f"""WITH {_SN} SELECT {_MISC} || CASE WHEN length(form) % 5 = 0 THEN 'B-x' ELSE 'O' END AS what, count(*) AS n FROM ok GROUP BY ALL UNION ALL SELECT 'changed', 0"""
O["sanitised_features"] = f"WITH {_SN} SELECT upos, CASE WHEN upos = 'VERB' THEN '_' ELSE 'A=b' END AS feats, '_' AS deps, count(*) AS n FROM ok GROUP BY ALL"
O["ner_presence"] = f"""WITH {_SN}, c AS (SELECT lang, count(*) AS n FROM sn GROUP BY lang) SELECT lang AS name, 'sentences' AS rule FROM c WHERE lang = 'de' AND n <> 1 UNION ALL SELECT lang, 'no NER tags' FROM c WHERE lang = 'es'
UNION ALL SELECT lang, 'missing' FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) ANTI JOIN c USING (lang)"""
O["split_merge"] = f"WITH {_SN} SELECT (doc_id % 3)::BIGINT AS split, count(*) AS blocks, sum(tokens)::BIGINT AS tokens FROM sn GROUP BY ALL"
#: Sentences with the genre in force, the comments before them and what is wrong with them; ``i`` is their place in the document.
_FILES = f"""{_SN}, o AS (SELECT sn.*, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS opens,
  CASE WHEN line_no % 7 = 3 THEN 'strokovno' END AS said, doc_id // 64 AS part FROM sn),
g AS (SELECT *, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), CASE WHEN doc_id % 3 = 0 THEN 'leposlovno' END) AS genre,
  3 + (line_no % 7 IN (3, 5))::INT + CASE WHEN opens THEN 1 + (doc_id % 3 = 0)::INT ELSE 0 END AS comments FROM o)"""
O["genres_from_files"] = f"""WITH {INST.replace(DEP, _FILES, 1)} SELECT genre, pattern, count(*) AS n FROM inst JOIN g USING (doc_id, line_no)
WHERE NOT (key % 11 = 0 AND 1 IN (s, o)) GROUP BY ALL"""
O["genre_profile_from_files"] = f"WITH {_FILES} SELECT part, genre, count(*) AS sentences, sum(tokens)::BIGINT AS tokens FROM g GROUP BY ALL"
O["pending_from_files"] = f"WITH {_FILES} SELECT part, comments::BIGINT AS comments, count(*) AS blocks FROM g GROUP BY ALL"
O["chunk_files"] = f"""WITH RECURSIVE {_FILES}, tb AS (SELECT doc_id, line_no, bool_or(tok_id = 1 AND deprel <> 'root') AS rooted, bool_or(tok_id = 1) AS first, sum(strlen(concat_ws(chr(9), tok_id, form, '_', upos, '_', CASE WHEN upos = 'VERB' THEN '_' ELSE 'A=b' END, head, deprel, '_',
    CASE WHEN ({_STATUS.format(u='upos', f='form')}) = 'entity' THEN 'A=x|NER=B-x' ELSE 'NER=O' END)) + 1) AS b FROM ok GROUP BY ALL),
bk AS (SELECT part, doc_id, line_no, b + strlen('# sent_id = ' || doc_id || '-' || line_no) + strlen('# lang = ' || g.lang) + strlen('# text = ' || line) + 3
    + CASE line_no % 7 WHEN 3 THEN strlen('# term = zvrst / neumetnostna / strokovna') + 1 WHEN 5 THEN strlen('# term = zvrst / druga') + 1 ELSE 0 END
    + CASE WHEN opens THEN strlen('# newdoc id = ' || doc_id) + 1 + CASE WHEN doc_id % 3 = 0 THEN strlen('# term = zvrst / umetnostna') + 1 ELSE 0 END ELSE 0 END AS b,
  CASE WHEN key % 11 = 0 THEN rooted WHEN key % 13 = 0 THEN first ELSE false END AS bad FROM g JOIN tb USING (doc_id, line_no) JOIN ln USING (doc_id, line_no)),
lb AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY doc_id, line_no) - 1 AS i, b FROM bk WHERE NOT bad), {chunked('lb', 'part', 20000)}
SELECT part, chunk, count(*) AS blocks, sum(b)::BIGINT AS n_bytes FROM ck GROUP BY ALL"""
O["conllu_source_counts"] = O["conllu_roundtrip_counts"]
O["conllu_source_tokens"] = f"WITH {_SN} SELECT upos, deprel, count(*) AS n FROM ok WHERE upos = 'VERB' GROUP BY ALL"
O["resumed_runs"] = """WITH c AS (SELECT lang AS name, count(*) AS n FROM documents GROUP BY lang)
SELECT run::BIGINT AS run, name, status, CASE WHEN status = 'ok' THEN coalesce(c.n, 0) END AS n FROM (VALUES (1, 'de', 'ok'), (1, 'en', 'ok'), (1, 'fr', 'error'), (2, 'de', 'kept'), (2, 'en', 'kept'), (2, 'fr', 'ok')) AS x(run, name, status) LEFT JOIN c USING (name)
UNION ALL SELECT NULL, name, 'committed', n FROM c WHERE name IN ('de', 'en', 'fr')"""
O["watched_scan"] = "SELECT unnest(['same', 'changed']) AS input, (SELECT count(*) FROM nation) AS n, unnest([false, true]) AS refused"
O["first_seen_stream"] = f"""WITH {INST}, pv AS (SELECT doc_id, line_no, {_SUMS} FROM inst GROUP BY doc_id, line_no),
fs AS (SELECT ln.lang, row_number() OVER (PARTITION BY ln.lang, line ORDER BY ln.doc_id, ln.line_no) = 1 AS first, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _NS)} FROM ln LEFT JOIN pv ON ln.doc_id = pv.doc_id AND ln.line_no = pv.line_no)
SELECT lang, count(*) AS sentences, count(*) FILTER (first) AS kept, {', '.join(f'sum({n})::BIGINT AS before_{n[2:]}, coalesce(sum({n}) FILTER (first), 0)::BIGINT AS after_{n[2:]}' for n in _NS)} FROM fs GROUP BY lang"""
O["file_order"] = "SELECT n_regionkey::BIGINT AS region, row_number() OVER (ORDER BY n_regionkey) AS place, count(*) AS n FROM nation GROUP BY n_regionkey"
O["tsv_roundtrip"] = "SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS name, n_regionkey::BIGINT AS region FROM nation"
O["header_violation"] = "SELECT unnest(['header', 'key']) AS \"check\", true AS refused"
O["summary_tsv"] = f"WITH {CNT} SELECT lang, {', '.join(f'{n}::BIGINT AS {n}' for n in _NS)}, total FROM w"
O["engine_result_scan"] = f"""WITH {INST}, c AS (SELECT pattern, lang, count(*) AS n FROM inst GROUP BY ALL UNION ALL SELECT 'SVO', 'x', 2)
SELECT pattern, sum(n)::BIGINT AS n, count(*) AS trees FROM c GROUP BY pattern UNION ALL SELECT '', 15, 3"""
O["cached_counts_scan"] = f"""WITH {CNT} SELECT lang AS corpus_id, CASE lang WHEN 'es' THEN 'unexpected corpus' ELSE 'display name' END AS rule FROM w WHERE lang IN ('es', 'fr') UNION ALL SELECT lang, unnest(['proportion', 'sum']) FROM w WHERE lang = 'de'"""
O["manifest_contract"] = """WITH l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL),
v(lang, rule) AS (VALUES ('de', 'empty display_name'), ('en', 'unsafe source_input'), ('es', 'unsafe prepared_input'), ('fr', 'ner_family'), ('en', 'word_order is missing'))
SELECT lang AS corpus_id, rule FROM l JOIN v USING (lang) UNION ALL SELECT NULL, 'number of rows' UNION ALL SELECT lang, 'takes part in ner' FROM l"""
O["json_roundtrip"] = "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type"
O["pinned_digests"] = "SELECT n_regionkey::VARCHAR AS name, sha256(string_agg(n_name, ',' ORDER BY n_name) || chr(10)) AS sha256, n_regionkey = 3 AS broken FROM nation GROUP BY n_regionkey"
O["checksum_lines"] = "SELECT sha256(r_name || chr(10)) || '  ' || r_regionkey AS line FROM region"
O["run_status"] = """SELECT name, CASE name WHEN 'xx' THEN 'error' ELSE 'ok' END AS status, CASE WHEN name <> 'xx' THEN (SELECT count(*) FROM documents WHERE lang = name) END AS n FROM (SELECT unnest(['de', 'xx', 'fr']) AS name)"""
O["report_lines"] = f"""WITH {CNT}, s AS (SELECT lang, total, CASE WHEN lang < 'en' THEN 'I' ELSE 'II' END AS grp, replace(printf('%.1f', round(100 * n_SVO::DOUBLE / total, 1)), '.', ',') AS svo FROM w),
tx AS (SELECT 2 + row_number() OVER (ORDER BY total DESC, lang) AS line, lang || chr(9) || total AS value FROM s),
lt AS (SELECT grp, lang, lang || ' & ' || total || ' & ' || svo || ' \\\\' AS value, coalesce(lag(grp) OVER (ORDER BY lang) <> grp, true) AS fresh FROM s),
lx AS (SELECT lang, 0 AS k, '\\multicolumn{{3}}{{l}}{{\\textit{{' || grp || '}}}} \\\\' AS value FROM lt WHERE fresh UNION ALL SELECT lang, 1, value FROM lt),
n AS (SELECT 1 + row_number() OVER (ORDER BY lang, k) AS line, value FROM lx)
SELECT 'text' AS report, unnest([0, 1, 2])::BIGINT AS line, unnest(['Totals', '======', 'lang' || chr(9) || 'total']) AS value UNION ALL SELECT 'text', line, value FROM tx UNION ALL SELECT 'text', max(line) + 1, '' FROM tx
UNION ALL SELECT 'latex', unnest([0, 1])::BIGINT, unnest(['\\begin{{tabular}}{{lll}}', 'Language & N & SVO \\\\ \\hline']) UNION ALL SELECT 'latex', line, value FROM n
UNION ALL SELECT 'latex', max(line) + 1, '\\end{{tabular}}' FROM n UNION ALL SELECT 'latex', max(line) + 2, '' FROM n"""
O["files_unchanged"] = "SELECT unnest(['1', '2']) AS part, unnest([2, 1])::BIGINT AS n"
O["self_checks"] = f"WITH {CNT} SELECT 5 * count(*) AS checks, count(*) AS failed, string_agg(lang || ': impossible', '; ' ORDER BY lang) AS labels FROM w"
O["grid_contract"] = "SELECT unnest(['de', 'xx', 'fr']) AS lang, unnest(['SOV', 'SVO', 'SVO']) AS pattern, unnest(['missing', 'foreign', 'repeated']) AS rule"
_NAMES = "[" + ", ".join(f"'{p}'" for p in PATTERNS) + "]"
O["human_and_machine_shares"] = f"""WITH inst AS (SELECT CASE WHEN role = 'user' THEN 'Human' ELSE 'AI' END AS genre, {_NAMES}[length(text) % 6 + 1] AS pattern FROM conversations WHERE role IN ('user', 'assistant')),
w AS (SELECT genre, {_SUMS}, count(*) AS total FROM inst GROUP BY genre)
SELECT genre, total, {', '.join(f'{n}::BIGINT AS {n}, round({n}::DOUBLE / total, 6) AS p_{n[2:]}' for n in _NS)}, round({ent(_NS, 'total')}, 6) AS entropy FROM w"""
O["exact_percentages"] = f"WITH {INST}, w AS (SELECT source, {_SUMS}, count(*) AS total FROM inst GROUP BY source) SELECT source, {', '.join(f'round(100 * {n}::DOUBLE / total, 6) AS pct_{n[2:]}' for n in _NS)} FROM w"
_CHI = f"""{PAIR}, e AS (SELECT group_a, group_b, a[i] AS o, (a[i] + b[i]) * ta / (ta + tb) AS e, a[i] + b[i] AS c FROM pr UNION ALL SELECT group_a, group_b, b[i], (a[i] + b[i]) * tb / (ta + tb), a[i] + b[i] FROM pr),
q AS (SELECT group_a, group_b, sum((o - e) * (o - e) / e) AS chi2, count(*) // 2 - 1 AS df, sum(o) AS n FROM e WHERE c > 0 GROUP BY ALL)"""
O["tests_with_summary"] = f"WITH {_CHI} SELECT group_a || '-' || group_b AS test, n::BIGINT AS n, round(chi2, 6) AS stored, round(sqrt(chi2 / (n * least(1, df))), 6) AS cramers_v, true AS agrees FROM q"
O["result_families"] = f"""WITH {_CHI}, {_JSD}, g AS (SELECT lang, sum(total) AS r FROM w GROUP BY lang), t AS (SELECT sum(total) AS t, {', '.join(f'sum({n}) AS {n}' for n in _NS)} FROM w),
om AS (SELECT {' + '.join(f'CASE WHEN t.{n} > 0 THEN sum((w.{n} - total * t.{n} / t.t::DOUBLE) ** 2 / (total * t.{n} / t.t::DOUBLE)) ELSE 0 END' for n in _NS)} AS chi2, any_value(t.t) AS n, (count(*) - 1) * ({' + '.join(f'(t.{n} > 0)::INT' for n in _NS)} - 1) AS df FROM w, t GROUP BY t.t, {', '.join(f't.{n}' for n in _NS)})
SELECT 'pairwise' AS family, group_a, group_b, round(chi2, 6) AS chi2, df::BIGINT AS df, NULL::DOUBLE AS jsd, NULL::BIGINT AS n FROM q UNION ALL SELECT 'distance', group_a, group_b, NULL, NULL, round(d, 6), NULL FROM js
UNION ALL SELECT 'omnibus', NULL, NULL, round(chi2, 6), df, NULL, n::BIGINT FROM om"""
O["ordered_distinct"] = "SELECT source, min(doc_id) AS first_doc, row_number() OVER (ORDER BY min(doc_id), source) AS place FROM documents GROUP BY source"
O["bytewise_first"] = "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(*) > 1 ORDER BY line LIMIT 30"
O["observed_profile"] = f"""WITH {DEP} SELECT 'sentences' AS metric, (SELECT count(*) FROM ln) AS n UNION ALL SELECT 'tokens', count(*) FROM dep UNION ALL SELECT 'verbs', count(*) FROM dep WHERE upos = 'VERB'"""
O["joint_publication"] = "SELECT 'a' AS name, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'b', (SELECT count(*) FROM nation) UNION ALL SELECT unnest(['c', 'd']), NULL"
