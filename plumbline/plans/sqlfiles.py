"""DuckDB SQL of queries over parsed files, references and pairs of documents; inline fixtures become VALUES."""

from __future__ import annotations

from plumbline.config import DEFAULT as CFG
from plumbline.functions import constants as C
from plumbline.plans import fixtures as X
from plumbline.plans.sqltext import SQL, sentences, strip, tokens, words


def quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(quoted, x)) + "]"
    return str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def values(rows, cols: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({cols}))"


FILES = values([("a.tex", "latex", X._TEX), ("b.bib", "bib", X._BIB), ("c.txt", "txt", X._TXT), ("d.txt", "txt", "No heading here, only one line of text.")], "path, format, raw")


def first(c: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"


def doi(c: str) -> str:
    return f"regexp_replace({first(c, r'10[.]\d{4,}/\S+')}, '[.,;)]+$', '')"


def year(c: str) -> str:
    return first(c, r"\b(19|20)\d{2}\b")


def clean_latex(c: str) -> str:
    env = "(?:equation|align|table|figure|tabular|array)[*]?"
    for pattern, new in (
        (r"%[^\n]*", ""), (r"\\(?:textbf|textit|emph|underline|texttt|textrm)\{([^}]*)\}", r"\1"), (r"\\(?:cite|ref|label|eqref)\{[^}]*\}", ""),
        (rf"(?s)\\begin\{{{env}\}}.*?\\end\{{{env}\}}", ""), (r"\\[a-zA-Z]+\*?\{([^}]*)\}", r"\1"), (r"\\[a-zA-Z]+\*?", ""), (r"[{}]", ""), (r"\s+", " "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return strip(c)


# ---- sections: a running count of headings over the lines


def _sections(src: str, key: str, col: str) -> str:
    head = r"^(?:\d+\.?\s+)?([A-Z][A-Z\s&:/\-]{3,60})$"
    return f"""src AS {src}, ln AS (SELECT {key}, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT {key}, string_split({col}, chr(10)) AS a FROM src)),
hd AS (SELECT *, regexp_matches({strip('line')}, '{head}') AND length({strip('line')}) < 80 AS head FROM ln),
rn AS (SELECT *, sum(length(line) + 1) OVER o AS e, sum(head::INT) OVER o AS block FROM hd WINDOW o AS (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING)),
per AS (SELECT {key}, block, max(CASE WHEN head THEN {strip('line')} END) AS title, min(e - length(line) - 1) AS s, max(e) AS e, count(*) FILTER (NOT head) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head) AS body FROM rn GROUP BY ALL),
made AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY block) AS section, coalesce(title, 'Introduction') AS title, {strip('body')} AS body, s, e FROM per WHERE n > 0),
secs AS (SELECT * FROM made UNION ALL SELECT {key}, 1, 'Body', {col}, 0, length({col}) FROM src WHERE {key} NOT IN (SELECT {key} FROM made))"""


SQL["document_sections"] = f"""WITH {_sections('(SELECT doc_id, text FROM documents)', 'doc_id', 'text')} SELECT doc_id, section, title, length(body) AS n, s::BIGINT AS start, e::BIGINT AS "end" FROM secs"""
SQL["parse_sections"] = f"""WITH {_sections(f"(SELECT path, raw FROM {FILES} WHERE format = 'txt')", 'path', 'raw')} SELECT path, section, title, body AS text, s::BIGINT AS start, e::BIGINT AS "end" FROM secs"""
_ABSTRACT = r"(?s)(?:Abstract|ABSTRACT)[:\s]*\n(.*?)(?:\n\n|\n[A-Z]{3,})"
_TITLE = f"list_filter((list_filter(list_transform(string_split(raw, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''))[1:10], lambda x: length(x) > 10 AND length(x) < 200 AND NOT starts_with(x, 'http'))[1]"
SQL["parse_abstract"] = f"SELECT path, CASE WHEN regexp_matches(raw, '{_ABSTRACT}') THEN {strip(f"regexp_extract(raw, '{_ABSTRACT}', 1)")} END AS abstract, {_TITLE} AS title FROM {FILES} WHERE format = 'txt'"
_BLOCK = first("raw", r"(?is)(?:References|Bibliography|REFERENCES)\s*\n(.*)", 1)
SQL["parse_refs"] = rf"""SELECT path, ref_idx, 'ref_' || ref_idx AS cite_key, raw, {doi('raw')} AS doi, {year('raw')} AS year FROM (SELECT path, unnest(range(len(a))) AS ref_idx, {strip('unnest(a)')} AS raw FROM (SELECT path, string_split_regex({_BLOCK}, '\n\s*(?:\[\d+\]|\(\d+\)|(?:\d+\.))\s+') AS a FROM {FILES} WHERE format = 'txt')) WHERE length(raw) >= 20"""

# ---- LaTeX and BibTeX
_TEXS = f"(SELECT path, raw FROM {FILES} WHERE format = 'latex')"
SQL["parse_tex"] = rf"""SELECT path, {clean_latex(strip(first('raw', r'\\title\{([^}]+)\}', 1)))} AS title, array_to_string(regexp_extract_all(raw, '\\author(?:\[.*?\])?\{{([^}}]+)\}}', 1), ';') AS authors,
{clean_latex(first('raw', r'(?s)\\begin\{abstract\}(.+?)\\end\{abstract\}', 1))} AS abstract, {clean_latex('raw')} AS full_text FROM {_TEXS}"""
_HEAD = r"\\(section|subsection|subsubsection)\*?\{([^}]+)\}"
SQL["parse_tex_sections"] = rf"""WITH part AS (SELECT path, unnest(range(len(a))) AS pos, unnest(a) AS part FROM (SELECT path, string_split(regexp_replace(raw, '({_HEAD})', chr(1) || '\1', 'g'), chr(1)) AS a FROM {_TEXS})),
done AS (SELECT *, sum(length(part)) OVER (PARTITION BY path ORDER BY pos) AS e, regexp_extract(part, '^{_HEAD}', 0) AS h FROM part)
SELECT path, pos - 1 AS pos, {clean_latex(f"regexp_extract(part, '^{_HEAD}', 2)")} AS title, (length(regexp_extract(part, '^{_HEAD}', 1)) - 7) // 3 + 1 AS level, {clean_latex('substring(part, length(h) + 1)')} AS text, (e - length(part) + length(h))::BIGINT AS start, e::BIGINT AS "end" FROM done WHERE pos > 0"""
SQL["parse_tex_refs"] = rf"""WITH item AS (SELECT path, unnest(range(len(a) - 1)) AS ref_idx, unnest(a[2:]) AS t FROM (SELECT path, string_split(split_part(raw, '\end{{thebibliography}}', 1), '\bibitem') AS a FROM {_TEXS})),
made AS (SELECT path, ref_idx, {strip(r"regexp_extract(t, '(?s)^(?:\[.*?\])?\{([^}]+)\}(.*)', 1)")} AS cite_key, {clean_latex(r"regexp_extract(t, '(?s)^(?:\[.*?\])?\{([^}]+)\}(.*)', 2)")} AS raw FROM item)
SELECT *, {doi('raw')} AS doi, {year('raw')} AS year FROM made"""


def _field(name: str) -> str:
    braces, quotes = rf"(?is){name}\s*=\s*\{{([^}}]*)\}}", rf'(?is){name}\s*=\s*"([^"]*)"'
    pick = lambda p: strip(f"regexp_extract(raw, '{p}', 1)")
    return f"CASE WHEN regexp_matches(raw, '{braces}') THEN {pick(braces)} WHEN regexp_matches(raw, '{quotes}') THEN {pick(quotes)} END"


SQL["parse_bib"] = rf"""WITH entry AS (SELECT path, unnest(range(len(k))) AS ref_idx, unnest(k) AS cite_key, unnest(b) AS raw FROM (SELECT path, regexp_extract_all(raw, '@\w+\{{(\w+),([^@]+)', 1) AS k, regexp_extract_all(raw, '@\w+\{{(\w+),([^@]+)', 2) AS b FROM {FILES} WHERE format = 'bib'))
SELECT path, ref_idx, cite_key, raw, {_field('title')} AS title, coalesce(array_to_string(list_transform(string_split(nullif({_field('author')}, ''), ' and '), lambda x: {strip('x')}), ';'), '') AS authors, {_field('year')} AS year, coalesce(nullif({_field('journal')}, ''), {_field('booktitle')}) AS journal, {_field('doi')} AS doi, {_field('url')} AS url FROM entry"""

# ---- sentences that abbreviations don't end
_SHIELD = rf"regexp_replace(regexp_replace(text, '{C.ABBREVIATIONS}', '\1' || chr(2), 'g'), '\b(e|i)\.(g|e)' || chr(2), '\1' || chr(2) || '\2' || chr(2), 'g')"
SQL["abbrev_sentences"] = rf"""WITH part AS (SELECT doc_id, unnest(range(len(a))) AS sent_idx, unnest(a) AS part FROM (SELECT doc_id, string_split(regexp_replace({_SHIELD}, '([.!?])(\s+)([A-Z])', '\1\2' || chr(1) || '\3', 'g'), chr(1)) AS a FROM documents)),
placed AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY sent_idx) - length(part) + length(part) - length(regexp_replace(part, '^\s+', '')) AS start, {strip("replace(part, chr(2), '.')")} AS sentence FROM part)
SELECT doc_id, sent_idx, sentence, start::BIGINT AS start FROM placed WHERE length(sentence) > 10"""

# ---- pairs of documents
_NGRAM3 = "list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])"
_CHAR5 = "list_transform(range(1, length(c) - 3), lambda i: substring(c, i, 5))"


def _sets(src: str, keep: str, col: str) -> str:
    return rf"SELECT {keep}, list_distinct({_NGRAM3}) AS w, list_distinct({_CHAR5}) AS ch FROM (SELECT {keep}, {tokens(col)} AS k, regexp_replace(lower({col}), '\s+', ' ', 'g') AS c FROM {src})"


_J = "CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_NEAR = f"""base AS ({_sets('documents', 'doc_id, source, text', 'text')}), sh AS (SELECT doc_id, source, unnest(w) AS h FROM base WHERE source IS NOT NULL),
common AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.h = y.h AND x.source = y.source AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT common.source, a, b FROM common JOIN base p ON p.doc_id = a JOIN base q ON q.doc_id = b WHERE c::DOUBLE / (len(p.w) + len(q.w) - c) >= 0.25),
ahead AS (SELECT source, doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
pairs AS (SELECT source, a, b FROM ahead WHERE b IS NOT NULL UNION SELECT * FROM near)"""
SQL["document_compare"] = f"""WITH {_NEAR}, j AS (SELECT pairs.source, a, b, {_J.format(a='p.w', b='q.w')} AS w, {_J.format(a='p.ch', b='q.ch')} AS c FROM pairs JOIN base p ON p.doc_id = a JOIN base q ON q.doc_id = b)
SELECT source, a, b, w AS word_jaccard, c AS char_jaccard, round(0.6 * w + 0.4 * c, 6) AS combined, w >= 0.25 AS flagged FROM j"""
_RISK = "CASE WHEN pct > 30.0 OR v > 5 THEN 'CRITICAL' WHEN pct > 15.0 THEN 'HIGH' WHEN pct > 5.0 THEN 'MEDIUM' ELSE 'LOW' END"
_SENT8 = f"list_filter({sentences('text')}, lambda x: len({words('x')}) >= 8)"
SQL["compare_documents"] = f"""WITH {_NEAR}, sent AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS sentence FROM (SELECT doc_id, {_SENT8} AS s FROM documents)), sets AS ({_sets('sent', 'doc_id, i', 'sentence')}),
scored AS (SELECT a, b, p.i, {_J.format(a='p.ch', b='q.ch')} AS c, {_J.format(a='p.w', b='q.w')} AS w FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b),
best AS (SELECT a, b, i, max({{s: greatest(c, w), c: c}}) AS m FROM scored WHERE greatest(c, w) >= {CFG.recycle_word} GROUP BY ALL),
hit AS (SELECT a, b, count(*) AS f, count(*) FILTER (m.c >= {CFG.recycle_char}) AS v FROM best GROUP BY ALL), n AS (SELECT doc_id AS a, count(*) AS n FROM sent GROUP BY ALL),
rec AS (SELECT source, a, b, coalesce(n, 0) AS sentences, coalesce(f, 0) AS flagged, coalesce(v, 0) AS v, 100.0::DOUBLE * coalesce(f, 0) / greatest(coalesce(n, 0), 1) AS pct FROM pairs LEFT JOIN n USING (a) LEFT JOIN hit USING (a, b))
SELECT source, a, b, sentences, flagged, v AS verbatim, pct AS overlap_pct, {_RISK} AS risk FROM rec"""
SQL["lsh_verified"] = f"""WITH base AS ({_sets('documents', 'doc_id', 'text')}), sh AS (SELECT doc_id, unnest(w) AS h FROM base), common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, c::DOUBLE / (len(p.w) + len(q.w) - c) AS jaccard FROM common JOIN base p ON p.doc_id = a JOIN base q ON q.doc_id = b WHERE c::DOUBLE / (len(p.w) + len(q.w) - c) >= 0.5"""
# every row against every other one, and the mean over all of these pairs
SQL["semantic_compare"] = """WITH dots AS (SELECT q.label, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)
SELECT label::BIGINT AS label, round(max(s), 9) AS max_cosine, round(avg(s), 9) AS mean_cosine FROM dots GROUP BY label"""

# ---- LCS of heading sequences: the table's cells in order of row and column
_HEADS = r"(?m)^#{1,3}\s+(.+)$|^([A-Z][A-Z\s]{3,60})$"
_SECTION_ROWS = values([(1, "# Start\nx\nMETHODS\ny\n## End"), (2, "# Start\nx\n## End"), (3, "no headings"), (4, "# End\n# Start")], "id, text")
SQL["section_sequence_lcs"] = rf"""WITH RECURSIVE h AS (SELECT id, list_filter(list_transform(list_zip(regexp_extract_all(text, '{_HEADS}', 1), regexp_extract_all(text, '{_HEADS}', 2)), lambda z: {strip("lower(CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END)")}), lambda x: x <> '') AS h FROM {_SECTION_ROWS}),
pr AS (SELECT p.id AS a, q.id AS b, p.h AS x, q.h AS y FROM h p JOIN h q ON p.id < q.id),
sub AS (SELECT a, b, x, y, []::VARCHAR[] AS s, 0 AS i, 0 AS j, 0 AS n FROM pr
  UNION SELECT sub.a, sub.b, x, y, []::VARCHAR[], p.i, p.j, n + 1 FROM sub, LATERAL (SELECT u.i, v.j FROM (SELECT unnest(range(1, len(x) + 1)) AS i) u, (SELECT unnest(range(1, len(y) + 1)) AS j) v WHERE u.i > sub.i AND v.j > sub.j AND x[u.i] = y[v.j]) p)
SELECT a, b, CASE WHEN max(len(x)) = 0 OR max(len(y)) = 0 THEN 0 ELSE 2.0 * max(n) / (max(len(x)) + max(len(y))) END::DOUBLE AS similarity FROM sub GROUP BY a, b"""

# ---- the ensemble with a language model, the scan's risk, lists of reports
SQL["ai_ensemble"] = f"""SELECT p.doc_id, round(0.40 * least(1.0, greatest(0.0, 1.0 - perplexity / {CFG.ppl_threshold})) + 0.30 * least(1.0, greatest(0.0, 1.0 - burstiness / {CFG.burstiness_threshold})) + 0.30 * style_score, 4) AS score
FROM ({SQL['lm_perplexity']}) p JOIN ({SQL['burstiness']}) b USING (doc_id) JOIN ({SQL['ai_style_score']}) s USING (doc_id)"""
_SCANS = values([(i, *c) for i, c in enumerate(X._SCAN)], "k, citation, rate, consistent, ai")
SQL["scan_risk_rules"] = f"""SELECT k::BIGINT AS "case", CASE WHEN citation = 'HIGH' OR NOT consistent OR rate > 0.3 THEN 'HIGH' WHEN citation = 'MEDIUM' OR ai > 0.50 OR rate > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM {_SCANS}"""
SQL["report_lists"] = f"""WITH m AS ({SQL['benchmark_paragraph_matches']}), p AS ({SQL['recycling_passages']}), b AS ({SQL['recycling_breakdown']}),
f AS (SELECT doc_id, source, overlap_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS r FROM p) WHERE r = 1)
SELECT d.doc_id, least(20, (SELECT count(*) FROM m WHERE m.doc_id = d.doc_id)) AS ngram_matches, least(30, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id)) AS recycled_passages, (SELECT count(*) FROM b WHERE b.doc_id = d.doc_id) AS source_breakdown, coalesce(f.source, -1) AS first_source, coalesce(f.overlap_type, '') AS first_type FROM documents d LEFT JOIN f USING (doc_id)"""

# ---- lexical diversity: the fold over words as a reduction with a state
_START = "{n: 0, size: 0, seen: []::VARCHAR[]}"


def _factors(w: str) -> str:
    seen = "list_distinct(list_concat(acc.seen, x.seen))"
    step = f"CASE WHEN len({seen})::DOUBLE / (acc.size + 1) <= 0.72 THEN {{n: acc.n + 1, size: 0, seen: []::VARCHAR[]}} ELSE {{n: acc.n, size: acc.size + 1, seen: {seen}}} END"
    return f"list_reduce(list_transform({w}, lambda y: {{n: 0, size: 0, seen: [y]}}), lambda acc, x: {step}, {_START})"


SQL["mtld"] = f"""WITH w AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents), f AS (SELECT doc_id, len(w) AS n, {_factors('w')} AS a, {_factors('list_reverse(w)')} AS b FROM w WHERE len(w) >= 50)
SELECT w.doc_id, round(coalesce((f.n::DOUBLE / (a.n + (a.size > 0)::INT) + f.n::DOUBLE / (b.n + (b.size > 0)::INT)) / 2, 0), 6) AS mtld FROM w LEFT JOIN f USING (doc_id)"""

# ---- references against the registry
_REFS = values([(d, i, raw, a, y, t, o, k) for d, i, raw, a, y, t, o, k in X._REFS], "doc_id, ref_idx, raw, authors, year, title, doi, cite_key")
_REGISTRY = values([(d, s, t, [f"{f} {g[:1]}" for f, g in a], y, j) for d, s, t, a, y, j, _ in X._REGISTRY], "doi, status, title, authors, year, journal")
_RAW_TITLE = rf"list_filter(list_transform((string_split_regex(raw, '\.\s+'))[2:3], lambda x: {strip('x')}), lambda x: length(x) > 10 AND length(x) < 200 AND NOT regexp_matches(x, '^(19|20)\d{{2}}'))[1]"


def _alike(a: str, b: str) -> str:
    x, y = f"list_distinct({tokens(a, 3)})", f"list_distinct({tokens(b, 3)})"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0 WHEN len({x}) + len({y}) = 0 THEN 1 ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


def _verdicts(offline: bool) -> str:
    doi_of = "NULL::VARCHAR" if offline else "nullif(doi, '')"
    hits = "SELECT doc_id, ref_idx, NULL::VARCHAR AS hit FROM ref WHERE false" if offline else f"""SELECT doc_id, ref_idx, hit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ref_idx ORDER BY sim DESC, hit) AS r FROM (
 SELECT doc_id, ref_idx, g.doi AS hit, {_alike('ref.claimed', 'g.title')} AS sim FROM ref JOIN reg g ON len(list_intersect({tokens('ref.claimed', 3)}, {tokens('g.title', 3)})) > 0 WHERE ref.doi IS NULL AND claimed IS NOT NULL AND g.status = 200 AND g.title IS NOT NULL) WHERE sim >= {CFG.min_title_similarity}) WHERE r = 1"""
    return rf"""ref AS (SELECT doc_id::BIGINT AS doc_id, ref_idx::BIGINT AS ref_idx, raw, authors::VARCHAR[] AS authors, year, {doi_of} AS doi, coalesce(CASE WHEN title <> '' THEN title END, {_RAW_TITLE}) AS claimed FROM {_REFS}),
reg AS (SELECT doi, status, title, authors::VARCHAR[] AS authors, year FROM {_REGISTRY}), hits AS ({hits}),
asked AS (SELECT ref.*, hit, coalesce(ref.doi, hit) AS asked FROM ref LEFT JOIN hits USING (doc_id, ref_idx)),
met AS (SELECT a.*, g.status, g.title AS r_title, g.authors AS r_authors, g.year AS r_year, CASE WHEN hit IS NOT NULL THEN g.title ELSE claimed END AS title FROM asked a LEFT JOIN reg g ON g.doi = a.asked),
off_ AS (SELECT *, coalesce(status = 200, false) AS ok, coalesce(status = 200 AND year <> '' AND year <> r_year, false) AS y, coalesce(status = 200 AND title <> '' AND r_title <> '' AND {_alike('lower(title)', 'lower(r_title)')} < {CFG.min_title_similarity}, false) AS t,
 coalesce(status = 200 AND NOT contains(string_split_regex(lower(r_authors[1]), '\s+')[1], list_filter(string_split_regex(lower(authors[1]), '\s+'), lambda x: x <> '')[-1]), false) AS a FROM met),
judged AS (SELECT *, (100 - 30 * y::INT - 35 * t::INT - 20 * a::INT) / 100.0::DOUBLE AS conf, asked IS NULL AS none, coalesce(status, 404) = 404 AS missing FROM off_),
verdicts AS (SELECT doc_id, ref_idx, CASE WHEN none THEN 'NO_DOI' WHEN missing THEN 'HALLUCINATED' WHEN NOT ok THEN 'UNRESOLVABLE' WHEN (y OR t OR a) AND conf < 0.3 THEN 'HALLUCINATED' WHEN y OR t OR a THEN 'MISMATCH' ELSE 'VALID' END AS verdict,
 CASE WHEN none AND {str(not offline).lower()} AND coalesce(claimed, '') <> '' THEN 0.4 WHEN none THEN 0.5 WHEN missing THEN 0.95 WHEN NOT ok THEN 0.0 ELSE conf END::DOUBLE AS confidence,
 concat_ws(';', CASE WHEN none THEN 'no_doi' END, CASE WHEN NOT none AND missing THEN 'not_in_registry' END, CASE WHEN NOT none AND NOT missing AND NOT ok THEN 'status' END, CASE WHEN y THEN 'year' END, CASE WHEN t THEN 'title' END, CASE WHEN a THEN 'first_author' END) AS issues,
 CASE WHEN NOT none THEN asked END AS doi, CASE WHEN ok THEN r_title END AS resolved_title FROM judged)"""


SQL["citation_verdicts"] = f"WITH {_verdicts(False)} SELECT * FROM verdicts"
SQL["citation_verdicts_offline"] = f"WITH {_verdicts(True)} SELECT doc_id, ref_idx, verdict, confidence FROM verdicts"
_COUNTS = ", ".join(f"count(*) FILTER (verdict = '{n}') AS {n.lower()}" for n in ("VALID", "MISMATCH", "HALLUCINATED", "UNRESOLVABLE", "NO_DOI"))
SQL["citation_summary"] = f"""WITH {_verdicts(False)}, c AS (SELECT doc_id, count(*) AS total, {_COUNTS} FROM verdicts GROUP BY doc_id)
SELECT *, 1.0 - (hallucinated + mismatch)::DOUBLE / total AS integrity, (hallucinated + mismatch + unresolvable)::DOUBLE / total AS issue_rate, CASE WHEN hallucinated > 0 THEN 'HIGH' WHEN mismatch > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c"""
