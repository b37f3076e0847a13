"""DuckDB SQL that replays the catalogue's queries on whole tables."""

from __future__ import annotations

from plumbline.config import DEFAULT as CFG
from plumbline.functions import constants as C


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def tokens(c: str, least: int = 2) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{{least},}}'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sentences(c: str) -> str:
    cut = rf"string_split(regexp_replace({c}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"


def sentences_any(c: str) -> str:
    return rf"list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')})"


def lines(c: str, least: int) -> str:
    """Paragraphs of a text whose line ends are doubled: its lines."""
    return rf"list_filter(list_transform(string_split_regex({c}, '\n+'), lambda x: {strip('x')}), lambda x: len({words('x')}) >= {least})"


def ngrams(a: str, n: int) -> str:
    parts = " || ' ' || ".join(f"{a}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({a}) - {n - 2}), lambda i: {parts})"


def count_any(c: str, parts) -> str:
    return " + ".join(f"((length({c}) - length(replace({c}, '{p}', ''))) // {len(p)})" for p in parts)


def count_phrases(c: str, parts) -> str:
    # a word character on either side rules a phrase out; RE2 has no look-behind, so phrases stand among marked edges
    marked = rf"regexp_replace({c}, '([^\p{{L}}\p{{N}}_])', chr(2) || '\1' || chr(2), 'g')"
    out = []
    for p in parts:
        inner = p.replace(" ", chr(2) + " " + chr(2))
        one = f"chr(2) || '{inner}' || chr(2)"
        out.append(f"((length(m) - length(replace(m, {one}, ''))) // {len(inner) + 2})")
    return f"list_transform([chr(2) || {marked} || chr(2)], lambda m: {' + '.join(out)})[1]"


def mean(a: str) -> str:
    return f"(list_sum({a})::DOUBLE / len({a}))"


def std(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: (x - list_sum({a})::DOUBLE / len({a})) * (x - list_sum({a})::DOUBLE / len({a})))) / len({a}))"


SQL: dict[str, str] = {}
D = "documents"

SQL["word_count"] = f"SELECT doc_id, len({words('text')}) AS n_words FROM documents"
SQL["alpha_tokens"] = f"SELECT doc_id, len(k) AS n_tokens, len(list_distinct(k)) AS n_distinct, md5(array_to_string(k, chr(1))) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS k FROM documents)"
SQL["sentence_split"] = f"SELECT doc_id, unnest(range(len(s))) AS sent_idx, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)"
SQL["sentence_split_any"] = f"SELECT doc_id, unnest(range(len(s))) AS sent_idx, unnest(s) AS sentence FROM (SELECT doc_id, list_filter({sentences_any('text')}, lambda x: length(x) > 10) AS s FROM documents)"
SQL["paragraph_split"] = f"SELECT doc_id, para_idx, len({words('para')}) AS n_words, md5(para) AS para_md5 FROM (SELECT doc_id, unnest(range(len(p))) AS para_idx, unnest(p) AS para FROM (SELECT doc_id, {lines('text', 15)} AS p FROM documents))"
_SEG = "list_filter(list_transform(range(0, len(w), 300), lambda i: array_to_string(w[i + 1:i + 300], ' ')), lambda x: len(string_split(x, ' ')) >= 150)"
SQL["word_segments_300"] = f"SELECT doc_id, seg_idx, len(string_split(seg, ' ')) AS n_words, md5(seg) AS seg_md5 FROM (SELECT doc_id, unnest(range(len(g))) AS seg_idx, unnest(g) AS seg FROM (SELECT doc_id, {_SEG} AS g FROM (SELECT doc_id, {words('text')} AS w FROM documents)))"
_CLEAN = "text"
for _p, _n in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "''"), (r"\r\n?", "chr(10)"), (r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', {_n}, 'g')"
SQL["clean_text"] = f"SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT doc_id, {strip(_CLEAN)} AS t FROM documents)"
SQL["title_heuristic"] = f"SELECT doc_id, list_filter((list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''))[1:10], lambda x: length(x) > 10 AND length(x) < 200 AND NOT starts_with(x, 'http'))[1] AS title FROM documents"
SQL["snippet"] = "SELECT doc_id, substring(text, 1, 200) AS snippet, replace(replace(replace(replace(substring(text, 1, 120), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM documents"
SQL["content_hash"] = "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents"
SQL["page_stem"] = r"SELECT page_id, regexp_extract(url, '([^/\\]+?)(\.[^./\\]*)?$', 1) AS stem, CASE lower(regexp_extract(url, '\.([^./\\]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'tex' THEN 'latex' WHEN 'bib' THEN 'bib' ELSE 'txt' END AS format FROM pages"
SQL["word_shingles"] = f"SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), chr(1))) AS shingles_md5 FROM (SELECT doc_id, list_distinct({ngrams('k', 3)}) AS s FROM (SELECT doc_id, {tokens('text')} AS k FROM documents))"
_CHARS = r"SELECT {key}, regexp_replace(lower({col}), '\s+', ' ', 'g') AS c FROM {src}"
SQL["char_shingles"] = f"SELECT doc_id, len(list_distinct(list_transform(range(1, length(c) - 3), lambda i: substring(c, i, 5)))) AS n_shingles FROM ({_CHARS.format(key='doc_id', col='text', src='documents')})"
SQL["ngram_list"] = f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(1))) AS list_md5 FROM (SELECT doc_id, {ngrams('k', 2)} AS s FROM (SELECT doc_id, {tokens('text')} AS k FROM documents))"
SQL["token_frequency"] = f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY token"
_RARE = rf"""pool AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS w FROM documents),
rare AS (SELECT p.doc_id, p.w FROM pool p JOIN (SELECT w FROM pool GROUP BY w HAVING count(*) <= greatest(1.0, 0.30 * (SELECT count(*) FROM documents)) AND length(w) > 4) r USING (w))"""
SQL["rare_vocab"] = f"WITH {_RARE} SELECT d.doc_id, count(r.w) AS n_rare FROM documents d LEFT JOIN rare r USING (doc_id) GROUP BY d.doc_id"
SQL["top_content_words"] = f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM documents) WHERE token NOT IN ({_in(C.CONTENT_STOPS)}) AND length(token) > 3 GROUP BY token ORDER BY n DESC, token LIMIT 20"
_FREQ = f"""tok AS (SELECT doc_id, unnest({tokens('text')}) AS w FROM documents),
cnt AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY ALL),
agg AS (SELECT doc_id, sum(c)::BIGINT AS n, count(*) AS v, sum((c = 1)::INT)::BIGINT AS hapax, sum(c * (c - 1))::BIGINT AS m2 FROM cnt GROUP BY doc_id)"""
SQL["vocabulary_richness"] = f"WITH {_FREQ} SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(v, 0) AS vocab, coalesce(v / n, 0) AS ttr, coalesce(hapax / v, 0) AS hapax_ratio, round(CASE WHEN n > 1 THEN 1e4 * m2 / (n::DOUBLE * (n - 1)) ELSE 0 END, 6) AS yule_k FROM documents d LEFT JOIN agg USING (doc_id)"
SQL["function_word_vector"] = f"WITH {_FREQ} SELECT a.doc_id, f.word, coalesce(c.c, 0) / a.n AS freq FROM agg a, (SELECT unnest([{_in(C.FUNCTION_WORDS)}]) AS word) f LEFT JOIN cnt c ON c.doc_id = a.doc_id AND c.w = f.word"

# ---- style: one long expression over cleaned text
_SUFFIX = "|".join(C.NOMINAL_SUFFIXES)
_SYLL = "greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - (x[-1] = 'e')::INT)"


def profile(src: str, key: str) -> str:
    """CTEs ending in ``prof``: key, word_count and the scalars of each row of ``src`` (key, text)."""
    fw = ", ".join(f"'{w}'" for w in C.FUNCTION_WORDS)
    return rf"""
p0 AS (SELECT {key}, {strip(r"regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '\[\d+\]', '', 'g'), '\s+', ' ', 'g')")} AS t FROM {src}),
p1 AS (SELECT {key}, lower(t) AS low, {tokens('t')} AS k, list_filter({sentences('t')}, lambda x: len({words('x')}) > 2) AS s FROM p0),
p2 AS (SELECT *, len(k) AS n, list_transform(s, lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+'))) AS l,
  map_values(list_histogram(k)) AS c, list_sum(list_transform(k, lambda x: {_SYLL})) AS syl FROM (SELECT *, (CASE WHEN len(k) > 0 THEN k END) AS kk FROM p1)),
p3 AS (SELECT *, coalesce({mean('l')}, 0) AS avg_l FROM p2),
prof AS (SELECT {key}, CASE WHEN n >= 20 THEN n ELSE 0 END AS word_count, list_transform([
  avg_l, CASE WHEN len(l) > 1 THEN {std('l')} ELSE 0 END, len(c) / n, len(list_filter(c, lambda x: x = 1)) / len(c),
  coalesce(list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '[,;:]')))) / len(s), 0), coalesce(len(list_filter(s, lambda x: regexp_matches(x, '(?i){C.PASSIVE}'))) / nullif(len(s), 0), 0),
  len(list_filter(k, lambda x: regexp_matches(x, '({_SUFFIX})$'))) / (n / 100.0), CASE WHEN len(s) > 0 THEN 0.39 * avg_l + 11.8 * (syl / n) - 15.59 ELSE 0 END,
  ({count_any('low', C.HEDGE_WORDS)}) / (n / 100.0), CASE WHEN n > 1 THEN 1e4 * list_sum(list_transform(c, lambda x: (x * (x - 1))::BIGINT))::BIGINT / (n::DOUBLE * (n - 1)) ELSE 0 END],
  lambda x: CASE WHEN n >= 20 THEN x ELSE 0 END) AS v,
  list_transform([{fw}], lambda w: CASE WHEN n >= 20 THEN coalesce(list_histogram(k)[w], 0) / n ELSE 0 END) AS fw FROM p3)"""


def vector(a: str) -> str:
    scales = (50.0, 30.0, 1.0, 1.0, 5.0, 1.0, 10.0, 20.0, 5.0, 100.0)
    return f"list_concat([{', '.join(f'{a}.v[{i + 1}] / {s}' for i, s in enumerate(scales))}], {a}.fw)"


_HIST = "list_histogram(k)"


def _fix(sql: str) -> str:
    """DuckDB names the histogram of a list by an aggregate over it."""
    return sql.replace("map_values(list_histogram(k))", "map_values(list_aggregate(k, 'histogram'))").replace("list_histogram(k)[w]", "list_aggregate(k, 'histogram')[w]")


_PROF = _fix(profile("documents", "doc_id"))
SQL["style_densities"] = f"WITH {_PROF} SELECT doc_id, word_count, round(v[5], 6) AS punct_density, round(v[6], 6) AS passive_ratio, round(v[7], 6) AS nominalization_density, round(v[9], 6) AS hedge_density FROM prof"
SQL["readability"] = f"WITH {_PROF} SELECT doc_id, round(v[8], 6) AS fk_grade FROM prof"
SQL["sentence_length_stats"] = f"WITH {_PROF} SELECT doc_id, round(v[1], 6) AS avg_len, round(v[2], 6) AS std_len FROM prof"
_NAMES = ("avg_sentence_len", "std_sentence_len", "ttr", "hapax_ratio", "punct_density", "passive_ratio", "nominalization_density", "fk_grade", "hedge_density", "yule_k")
SQL["style_profile"] = f"WITH {_PROF} SELECT doc_id, word_count, {', '.join(f'round(v[{i + 1}], 6) AS {n}' for i, n in enumerate(_NAMES))}, round(list_sum(fw), 6) AS function_share FROM prof"
_DELTA = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / 60"
_SEGS = f"segs AS (SELECT doc_id, {{doc_id: doc_id, i: unnest(range(len(g)))}} AS sid, unnest(g) AS text FROM (SELECT doc_id, {_SEG} AS g FROM (SELECT doc_id, {words('text')} AS w FROM documents)))"
_CHANGES = f"""WITH base AS (WITH {_PROF} SELECT doc_id, {vector('prof')} AS vec FROM prof), {_SEGS},
own AS (WITH {_fix(profile('segs', 'sid'))} SELECT sid, {vector('prof')} AS vec FROM prof),
changes AS (SELECT o.sid.doc_id AS doc_id, o.sid.i AS segment_index, {_DELTA.format(a='b.vec', b='o.vec')} AS delta FROM own o JOIN base b ON b.doc_id = o.sid.doc_id)"""
SQL["style_change_points"] = f"{_CHANGES} SELECT doc_id, segment_index, round(delta, 6) AS delta, delta > 0.40 AS flagged FROM changes"
SQL["style_consistency"] = f"{_CHANGES}, per AS (SELECT doc_id, count(*) AS n, sum((delta > 0.40)::INT)::BIGINT AS f FROM changes GROUP BY 1) SELECT d.doc_id, coalesce(n, 0) AS segments, coalesce(f, 0) AS flagged, 1.0::DOUBLE - coalesce(f, 0) / greatest(coalesce(n, 0), 1) AS consistency_score, 1.0::DOUBLE - coalesce(f, 0) / greatest(coalesce(n, 0), 1) >= 0.80 AS is_consistent FROM documents d LEFT JOIN per USING (doc_id)"
SQL["author_deviation"] = f"""WITH roles AS (SELECT role AS author, string_agg(text, ' ' ORDER BY conv_id, turn, text) AS text FROM conversations GROUP BY role),
turns AS (SELECT {{c: conv_id, t: turn, r: role}} AS id, text FROM conversations),
base AS (WITH {_fix(profile('roles', 'author'))} SELECT author, {vector('prof')} AS vec FROM prof),
own AS (WITH {_fix(profile('turns', 'id'))} SELECT id, {vector('prof')} AS vec FROM prof)
SELECT o.id.c AS conv_id, o.id.t AS turn, o.id.r AS author, round({_DELTA.format(a='b.vec', b='o.vec')}, 6) AS deviation FROM own o JOIN base b ON b.author = o.id.r"""

# ---- machine-written text
def _burst(c: str) -> str:
    l = rf"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len({words('x')})), lambda x: x > 3)"
    return f"list_transform([{l}], lambda l: CASE WHEN len(l) < 3 THEN 0.5 ELSE least({std('l')} / {mean('l')}, 1.0) END)[1]"


def _style(c: str) -> str:
    l = f"list_filter(list_transform({sentences_any(c)}, lambda x: len({words('x')})), lambda x: x > 3)"
    per = f"(greatest(len({words(c)}), 1) / 100.0)"
    ttr = f"list_transform([{tokens(c)}], lambda k: CASE WHEN len(k) > 0 THEN len(list_distinct(k)) / len(k) ELSE 0.5 END)[1]"
    first = rf"len(regexp_extract_all({c}, '\b[Ww]e\b|\b[Ii]\b'))"
    return f"""list_transform([{l}], lambda l: CASE WHEN len(l) = 0 THEN 0.5 ELSE ((1.0 - least({std('l')} / greatest({mean('l')}, 1.0) / 0.5, 1.0))
 + least(({count_any(f'lower({c})', C.HEDGE_PHRASES)}) / {per} / 5.0, 1.0) + greatest(0.0, 1.0 - ({ttr} - 0.30) / 0.30) + CASE WHEN {first} / {per} < 0.5 THEN 1.0 ELSE 0.0 END) / 4 END)[1]"""


SQL["burstiness"] = f"SELECT doc_id, round({_burst('text')}, 6) AS burstiness FROM documents"
SQL["ai_style_score"] = f"SELECT doc_id, round({_style('text')}, 6) AS style_score FROM documents"
_MULT = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.LANGUAGE_MULTIPLIERS.items()) + f" ELSE {C.OTHER_LANGUAGE} END"
_PARA = f"""para AS (SELECT doc_id, lang, source, unnest(range(len(p))) AS para_idx, unnest(p) AS para FROM (SELECT doc_id, lang, source, {lines('text', 40)} AS p FROM documents)),
scored AS (SELECT *, 0.5 * (1.0 - least({_burst('para')} / 0.35, 1.0)) + 0.5 * {_style('para')} AS score, 0.60::DOUBLE * ({_MULT})::DOUBLE AS t FROM para),
per AS (SELECT doc_id, count(*) AS n, avg(score) AS s, sum((score >= t)::INT) AS f FROM scored GROUP BY doc_id),
ai AS (SELECT d.doc_id, d.lang, d.source, coalesce(n, 0) AS paragraphs, coalesce(s, 0.5) AS ai_score, coalesce(f / n, 0) AS ai_fraction, 0.60::DOUBLE * ({_MULT})::DOUBLE AS threshold,
 CASE WHEN n IS NULL THEN 'UNCERTAIN' WHEN s < threshold * 0.5 THEN 'HUMAN' WHEN s < threshold THEN 'UNCERTAIN' WHEN s < threshold * 1.25 THEN 'AI_LIKELY' ELSE 'AI_DETECTED' END AS verdict FROM documents d LEFT JOIN per USING (doc_id))"""
SQL["ai_heuristic_paragraphs"] = f"WITH {_PARA} SELECT doc_id, para_idx, round(score, 6) AS score, score >= 0.55 AS flagged FROM scored"
SQL["ai_verdicts"] = f"WITH {_PARA} SELECT doc_id, paragraphs, round(ai_score, 6) AS ai_score, round(ai_fraction, 6) AS ai_fraction, round(threshold, 6) AS threshold, verdict FROM ai"
SQL["ai_by_quality"] = f"WITH {_PARA} SELECT quality::BIGINT AS quality, count(*) AS n, round(avg(ai_score), 6) AS mean_score, sum((verdict IN ('AI_LIKELY', 'AI_DETECTED'))::INT) / count(*) AS flagged_share FROM ai JOIN labels USING (doc_id) GROUP BY quality"
SQL["ai_by_source"] = f"WITH {_PARA} SELECT lang, source, count(*) AS n, round(avg(ai_score), 6) AS mean_score FROM ai GROUP BY ROLLUP (lang, source)"
SQL["ai_top_paragraphs"] = f"WITH {_PARA} SELECT doc_id, para_idx, round(sc, 6) AS score, r FROM (SELECT doc_id, para_idx, round(score, 9) AS sc, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, para_idx) AS r FROM scored) WHERE r <= 3"
_BI = f"SELECT {{key}} unnest(list_transform(range(1, len(k)), lambda i: {{{{x: k[i], y: k[i + 1]}}}})) AS g FROM (SELECT doc_id, {tokens('text').replace('{', '{{').replace('}', '}}')} AS k FROM documents {{where}})"
SQL["lm_perplexity"] = f"""WITH pairs AS (SELECT g.x AS x, g.y AS y, count(*) AS c FROM ({_BI.format(key='', where="WHERE lang = 'en'")}) GROUP BY ALL),
heads AS (SELECT x, sum(c) AS t FROM pairs GROUP BY x), vocab AS (SELECT count(DISTINCT w) AS v FROM (SELECT x AS w FROM pairs UNION ALL SELECT y FROM pairs)),
asked AS (SELECT doc_id, g.x AS x, g.y AS y, count(*) AS m FROM ({_BI.format(key='doc_id,', where='')}) GROUP BY ALL),
nll AS (SELECT doc_id, sum(m)::BIGINT AS n, sum(-ln((coalesce(c, 0) + 1) / (coalesce(t, 0) + v)) * m) AS s FROM asked LEFT JOIN pairs USING (x, y) LEFT JOIN heads USING (x), vocab GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN least(exp(s / n), 22026.0) ELSE 100.0 END, 3) AS perplexity FROM documents d LEFT JOIN nll USING (doc_id)"""

# ---- coherence
def _cv(c: str) -> str:
    l = f"list_transform(list_filter({sentences_any(strip(c))}, lambda x: length(x) > 10), lambda x: len({words('x')}))"
    return f"list_transform([{l}], lambda l: CASE WHEN len(l) < 3 OR {mean('l')} = 0 THEN 0.0 ELSE {std('l')} / {mean('l')} END)[1]"


def _dens(c: str, parts) -> str:
    return f"coalesce({count_phrases(f'lower({c})', parts)} / nullif(len({words(c)}), 0) * 100, 0)"


_HEAD = r"list_transform(regexp_extract_all(text, '(?m)^#{1,3}\s+.+$|^[A-Z][A-Z\s]+$'), lambda x: lower(regexp_replace(regexp_replace(x, '^#{1,3}\s+', ''), '^\s+|\s+$', '', 'g')))"
_TEMPL = f"list_transform([list_filter({_HEAD}, lambda x: x <> '')], lambda h: coalesce(len(list_filter(h, lambda x: {' OR '.join(f'contains(x, {chr(39)}{t}{chr(39)})' for t in C.TEMPLATE_SECTIONS)})) / nullif(len(h), 0), 0))[1]"
_COH = f"""coh0 AS (SELECT doc_id, {_dens('text', C.CONNECTORS)} AS conn, {_dens('text', C.COHERENCE_HEDGES)} AS hedge, {_cv('text')} AS cv, {_TEMPL} AS templ FROM documents),
coh AS (SELECT *, least(1.0, conn / (3.5 * 3)) * 0.30 + CASE WHEN cv > 0 THEN greatest(0.0, 1.0 - cv / 0.35) ELSE 0.5 END * 0.30 + least(1.0, hedge / (2.5 * 3)) * 0.20 + templ * 0.20 AS e FROM coh0)"""
SQL["coherence_scores"] = f"""WITH {_COH} SELECT doc_id, round(conn, 6) AS connector_density, round(hedge, 6) AS hedging_density, round(cv, 6) AS sentence_cv, round(templ, 6) AS template_match, round(e, 6) AS ensemble,
CASE WHEN e >= 0.60 THEN 'AI_POLISHED' WHEN e >= 0.40 THEN 'MIXED' ELSE 'HUMAN_LIKE' END AS verdict,
concat_ws(';', CASE WHEN conn > 3.5 THEN 'discourse_connector_density' END, CASE WHEN cv < 0.35 AND cv > 0 THEN 'sentence_length_uniformity' END, CASE WHEN hedge > 2.5 THEN 'hedging_density' END, CASE WHEN templ > 0.85 THEN 'section_template' END) AS flags FROM coh"""
SQL["coherence_paragraphs"] = rf"""WITH para AS (SELECT doc_id, unnest(range(len(p))) AS para_idx, unnest(p) AS para FROM (SELECT doc_id, (list_filter(list_transform(string_split_regex({strip('text')}, '\n\s*'), lambda x: {strip('x')}), lambda x: length(x) > 50))[1:20] AS p FROM documents))
SELECT doc_id, para_idx, substring(para, 1, 80) AS preview, round(least(1.0, least(1.0, {_dens('para', C.CONNECTORS)} / 10.5) * 0.4 + greatest(0.0, 1.0 - {_cv('para')} / 0.35) * 0.3 + least(1.0, {_dens('para', C.COHERENCE_HEDGES)} / 7.5) * 0.3), 6) AS score, round({_cv('para')}, 6) AS sentence_cv FROM para"""

# ---- token statistics
_TID = "((((((('0x' || substr(md5(w), 1, 8))::BIGINT % 50257) * (4294967296 % 50257) + ('0x' || substr(md5(w), 9, 8))::BIGINT) % 50257) * (4294967296 % 50257) + ('0x' || substr(md5(w), 17, 8))::BIGINT) % 50257) * (4294967296 % 50257) + ('0x' || substr(md5(w), 25, 8))::BIGINT) % 50257"
_IDS = rf"ids AS (SELECT doc_id, list_transform(list_filter({words('lower(text)')}, lambda x: regexp_full_match(x, '\p{{L}}+')), lambda w: {_TID}) AS i FROM documents)"
SQL["token_ids"] = f"WITH {_IDS} SELECT doc_id, len(i) AS n, md5(array_to_string(i, ',')) AS ids_md5 FROM ids"
SQL["token_screen"] = f"""WITH {_IDS},
a AS (SELECT doc_id, len(i) AS n, CASE WHEN len(i) > 1 THEN coalesce(list_sum(list_transform(range(2, len(i) + 1), lambda j: (('0x' || substr(md5(i[j - 1] || ':' || i[j]), 1, 5))::BIGINT < 262144)::INT)), 0) / (len(i) - 1) ELSE 0.25 END AS g, list_reverse_sort(map_values(list_aggregate(i, 'histogram'))) AS c FROM ids),
b AS (SELECT *, CASE WHEN n > 1 THEN (g - 0.25) / sqrt(0.1875 / (n - 1)) ELSE 0 END AS z, CASE WHEN len(c) > 1 THEN list_sum(list_transform(c, lambda x: -(x / n * ln(x / n)))) / ln(len(c)) ELSE 0 END AS e, CASE WHEN len(c) > 1 THEN list_sum(c[1:greatest(1, len(c) // 10)]) / n ELSE 0 END AS s FROM a),
d AS (SELECT *, z >= 2.5 OR (e < 0.45 AND s > 0.72) AS odd, 1 / (1 + 0.2316419 * abs(z)) AS t FROM b),
f AS (SELECT *, 0.3989422804014327 * exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM d)
SELECT doc_id, n AS tokens, CASE WHEN n >= 200 THEN round(g, 6) END AS green, CASE WHEN n >= 200 THEN round(z, 6) END AS z, CASE WHEN n >= 200 THEN round(e, 6) END AS entropy, CASE WHEN n >= 200 THEN round(s, 6) END AS skew,
CASE WHEN n >= 200 THEN round(CASE WHEN z >= 0 THEN tail ELSE 1 - tail END, 9) END AS p, CASE WHEN n < 200 THEN 'INSUFFICIENT_TEXT' WHEN odd THEN 'STATISTICAL_ANOMALY' ELSE 'NO_STATISTICAL_ANOMALY' END AS verdict,
round(CASE WHEN n >= 200 THEN least(CASE WHEN odd THEN 0.4 + least(0.55, greatest(0.0, z - 2.5) * 0.15) ELSE greatest(0.0, 1.0 - abs(z) / 4.0) END, 0.99) ELSE 0 END, 6) AS confidence, round(CASE WHEN n >= 200 THEN least(greatest(z / 4.0, 0.0), 1.0) ELSE 0 END, 6) AS score FROM f"""

# ---- similarity
_SH = f"sh AS (SELECT doc_id, unnest(list_distinct({ngrams('k', 3)})) AS s FROM (SELECT doc_id, {tokens('text')} AS k FROM documents)), sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL), jac AS (SELECT a, b, c / (p.n + q.n - c) AS jaccard FROM pr JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b)"
SQL["pairwise_jaccard"] = f"WITH {_SH} SELECT a, b, jaccard FROM jac WHERE jaccard >= 0.25"
SQL["jaccard_components"] = f"WITH RECURSIVE {_SH}, e AS (SELECT a, b FROM jac WHERE jaccard >= 0.5 UNION SELECT b, a FROM jac WHERE jaccard >= 0.5), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id AS doc_id, min(c) AS component FROM r GROUP BY id"


def _shingle_rows(name: str, src: str, key: str, col: str) -> str:
    """CTEs name_c and name_w: distinct character and word shingles of ``src`` rows, and their counts."""
    return rf"""{name}_c AS (SELECT DISTINCT {key}, unnest(list_transform(range(1, length(c) - 3), lambda i: substring(c, i, 5))) AS s FROM (SELECT {key}, regexp_replace(lower({col}), '\s+', ' ', 'g') AS c FROM {src})),
{name}_w AS (SELECT DISTINCT {key}, unnest({ngrams('k', 3)}) AS s FROM (SELECT {key}, {tokens(col)} AS k FROM {src})),
{name}_cn AS (SELECT {key}, count(*) AS n FROM {name}_c GROUP BY ALL), {name}_wn AS (SELECT {key}, count(*) AS n FROM {name}_w GROUP BY ALL)"""


def _jac(kind: str, l: str, r: str, lk: str, rk: str, out: str) -> str:
    on = f"{l}_{kind}"
    return f"{out} AS (SELECT {lk}, {rk}, x / (a.n + b.n - x) AS j FROM (SELECT l.{lk}, r.{rk}, count(*) AS x FROM {on} l JOIN {r}_{kind} r USING (s) GROUP BY ALL) JOIN {on}n a USING ({lk}) JOIN {r}_{kind}n b USING ({rk}))"


_REC = rf"""sub AS (SELECT {{d: doc_id, i: unnest(range(len(s)))}} AS l, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(flatten(list_transform(list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: {strip('x')}), lambda x: len({words('x')}) >= 15), lambda x: {sentences('x')})), lambda x: len({words('x')}) >= 8) AS s FROM documents)),
old AS (SELECT {{k: item_id, i: unnest(range(len(s)))}} AS r, unnest(s) AS sentence FROM (SELECT item_id, list_filter(flatten(list_transform(list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: {strip('x')}), lambda x: len({words('x')}) >= 15), lambda x: {sentences('x')})), lambda x: len({words('x')}) >= 8) AS s FROM benchmark)),
{_shingle_rows('l', 'sub', 'l', 'sentence')}, {_shingle_rows('r', 'old', 'r', 'sentence')},
{_jac('c', 'l', 'r', 'l', 'r', 'cj')}, {_jac('w', 'l', 'r', 'l', 'r', 'wj')},
both_ AS (SELECT l, r, coalesce(cj.j, 0) AS c, coalesce(wj.j, 0) AS w FROM cj FULL JOIN wj USING (l, r)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY greatest(c, w) DESC, r) AS n FROM both_ WHERE greatest(c, w) >= 0.25) WHERE n = 1)"""
SQL["recycling_passages"] = f"WITH {_REC} SELECT l.d AS doc_id, l.i AS sent_idx, r.k AS source, r.i AS source_idx, c AS char_jaccard, w AS word_jaccard, CASE WHEN c >= 0.35 THEN 'verbatim' ELSE 'near_verbatim' END AS overlap_type, CASE WHEN c >= 0.35 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM best"
_RISK = "CASE WHEN pct > 30.0 OR v > 5 THEN 'CRITICAL' WHEN pct > 15.0 THEN 'HIGH' WHEN pct > 5.0 THEN 'MEDIUM' ELSE 'LOW' END"
_RECSUM = f"""{_REC}, tot AS (SELECT l.d AS doc_id, count(*) AS n FROM sub GROUP BY ALL), hit AS (SELECT best.l.d AS doc_id, count(DISTINCT sentence) AS f, sum((c >= 0.35)::INT)::BIGINT AS v FROM best JOIN sub USING (l) GROUP BY ALL),
rec AS (SELECT d.doc_id, coalesce(n, 0) AS sentences, coalesce(f, 0) AS flagged, coalesce(v, 0) AS v, 100.0::DOUBLE * coalesce(f, 0) / greatest(coalesce(n, 0), 1) AS pct FROM documents d LEFT JOIN tot USING (doc_id) LEFT JOIN hit USING (doc_id))"""
SQL["benchmark_recycling"] = f"WITH {_RECSUM} SELECT doc_id, sentences, flagged, v AS verbatim, pct AS overlap_pct, {_RISK} AS risk FROM rec"
SQL["recycling_breakdown"] = f"WITH {_REC}, tot AS (SELECT l.d AS doc_id, count(*) AS n FROM sub GROUP BY ALL) SELECT doc_id, source, passages, 100.0::DOUBLE * passages / n AS pct FROM (SELECT l.d AS doc_id, r.k AS source, count(*) AS passages FROM best GROUP BY ALL) JOIN tot USING (doc_id)"
_MATCH = rf"""dp AS (SELECT {{d: doc_id, i: unnest(range(len(p)))}} AS l, unnest(p) AS para FROM (SELECT doc_id, {lines('text', 30)} AS p FROM documents)),
bp AS (SELECT {{k: item_id, i: unnest(range(len(p)))}} AS r, unnest(p) AS para FROM (SELECT item_id, {lines('text', 5)} AS p FROM benchmark)),
{_shingle_rows('dl', 'dp', 'l', 'para')}, {_shingle_rows('br', 'bp', 'r', 'para')}, {_jac('c', 'dl', 'br', 'l', 'r', 'pcj')}, {_jac('w', 'dl', 'br', 'l', 'r', 'pwj')},
match AS (SELECT l, r, j, 'word_ngram' AS match_type FROM pwj WHERE j >= 0.25 UNION ALL SELECT l, r, j, 'char_ngram' FROM pcj WHERE j >= 0.40 AND (l, r) NOT IN (SELECT (l, r) FROM pwj WHERE j >= 0.25))"""
SQL["benchmark_paragraph_matches"] = f"WITH {_MATCH} SELECT l.d AS doc_id, l.i AS para_idx, r.k AS item_id, r.i AS source_idx, j AS jaccard, match_type FROM match"
_KNN = "knn AS (SELECT q.vec_id AS q, c.vec_id AS c, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM knn)"
SQL["knn_top5"] = f"WITH {_KNN} SELECT q, c, round(s, 9) AS score, rank FROM ranked WHERE rank <= 5"
SQL["knn_threshold"] = f"WITH {_KNN} SELECT q, c, round(s, 9) AS score FROM ranked WHERE rank = 1 AND s >= 0.30"

# ---- cohorts (documents without headings: the section score is 0 where either side has none)
_BATCH = rf"""{_RARE}, bw AS (SELECT doc_id, {words(r"regexp_replace(lower(text), '[^a-z\s]', '', 'g')")} AS k FROM documents), bs AS (SELECT DISTINCT doc_id, unnest({ngrams('k', 3)}) AS s FROM bw),
bsn AS (SELECT doc_id, count(*) AS n FROM bs GROUP BY ALL), rn AS (SELECT doc_id, count(*) AS n FROM rare GROUP BY ALL),
g AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM bs x JOIN bs y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL), v AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rare x JOIN rare y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL),
gj AS (SELECT a, b, c / (p.n + q.n - c) AS j FROM g JOIN bsn p ON p.doc_id = a JOIN bsn q ON q.doc_id = b), vj AS (SELECT a, b, c / (p.n + q.n - c) AS j FROM v JOIN rn p ON p.doc_id = a JOIN rn q ON q.doc_id = b),
bp0 AS (SELECT a, b, coalesce(gj.j, 0) AS ngram, coalesce(vj.j, 0) AS vocab, 0.0::DOUBLE AS section FROM gj FULL JOIN vj USING (a, b)), bpairs AS (SELECT *, ngram * 0.50 + vocab * 0.30 + section * 0.20 AS combined FROM bp0 WHERE ngram * 0.50 + vocab * 0.30 + section * 0.20 >= 0.25)"""
SQL["batch_pairs"] = f"WITH {_BATCH} SELECT a, b, round(ngram, 9) AS ngram, round(vocab, 9) AS vocab, section, round(combined, 6) AS combined, coalesce(nullif(concat_ws('; ', CASE WHEN ngram >= 0.25 THEN 'ngram' END, CASE WHEN vocab >= 0.30 THEN 'vocabulary' END), ''), 'combined') AS reason FROM bpairs"
_CLUST = "e AS (SELECT a, b FROM bpairs UNION SELECT b, a FROM bpairs), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), clus AS (SELECT id AS doc_id, min(c) AS cluster FROM r GROUP BY id)"
SQL["batch_clusters"] = f"WITH RECURSIVE {_BATCH}, {_CLUST} SELECT doc_id, cluster FROM clus"
SQL["batch_summary"] = f"""WITH RECURSIVE {_BATCH}, {_CLUST}, {_PARA},
one AS (SELECT (SELECT count(*) FROM documents) AS submissions, (SELECT count(*) FROM bpairs) AS pairs, (SELECT count(DISTINCT cluster) FROM clus) AS clusters, (SELECT avg(ai_score) FROM ai) AS mean_ai, (SELECT stddev_pop(ai_score) FROM ai) AS std_ai, (SELECT count(*) FROM ai WHERE ai_score >= 0.60) AS high_ai)
SELECT submissions, pairs, clusters, round(mean_ai, 6) AS mean_ai, round(std_ai, 6) AS std_ai, high_ai,
CASE WHEN submissions < 2 THEN 'LOW' WHEN pairs >= 5 OR (high_ai >= 3 AND clusters > 0) THEN 'CRITICAL' WHEN pairs >= 2 OR high_ai >= 3 THEN 'HIGH' WHEN pairs >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
concat_ws(';', CASE WHEN pairs >= 5 THEN 'suspicious_pairs' END, CASE WHEN high_ai >= 3 THEN 'high_ai_cluster' END, CASE WHEN clusters > 0 THEN 'clusters' END) AS flags FROM one"""

# ---- reports
_WHOLE = _PARA.replace(lines("text", 40), rf"list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda x: {strip('x')}), lambda x: len({words('x')}) >= 40)")
SQL["overall_risk"] = f"""WITH {_WHOLE}, {_COH}, {_RECSUM}, {_MATCH}, sty AS ({SQL['style_consistency']}),
top AS (SELECT l.d AS doc_id, max(j) AS j FROM match GROUP BY ALL),
base AS (SELECT d.doc_id, coalesce(CASE WHEN top.j * 2.0 > 1.0 THEN 1.0::DOUBLE ELSE top.j * 2.0 END, 0) AS plagiarism, ai.ai_score AS ai, 1.0 - sty.consistency_score AS style, coh.e AS coherence, {_RISK.replace('pct', 'rec.pct').replace(' v >', ' rec.v >')} AS recycling_risk
 FROM documents d LEFT JOIN top USING (doc_id) JOIN ai USING (doc_id) JOIN sty USING (doc_id) JOIN coh USING (doc_id) JOIN rec USING (doc_id))
SELECT doc_id, round(plagiarism, 6) AS plagiarism, round(ai, 6) AS ai, round(style, 6) AS style, round(coherence, 6) AS coherence, recycling_risk,
CASE WHEN plagiarism > 0.70 OR recycling_risk = 'CRITICAL' THEN 'CRITICAL' WHEN plagiarism > 0.40 OR ai > 0.70 OR recycling_risk = 'HIGH' OR coherence > 0.75 THEN 'HIGH'
WHEN plagiarism > 0.20 OR ai > 0.50 OR recycling_risk = 'MEDIUM' OR style > 0.30 OR coherence > 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM base"""


def _values(rows: list[tuple], names: str) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def _fixture_sql() -> None:
    from plumbline.plans import fixtures as X

    raw = "(SELECT doc_id::BIGINT AS doc_id, ref_idx::BIGINT AS ref_idx, raw FROM " + _values([(d, i, r) for d, i, r, *_ in X._REFS], "doc_id, ref_idx, raw") + ") AS refs"
    rules = [(p, f"name:{i}") for i, p in enumerate(C.PREDATORY_NAMES)] + [(p, f"publisher:{i + len(C.PREDATORY_NAMES)}") for i, p in enumerate(C.PREDATORY_PUBLISHERS)]
    case = "CASE " + " ".join(f"WHEN regexp_matches(raw, '(?i){p}') THEN '{n}'" for p, n in rules) + " END"
    SQL["predatory_refs"] = f"SELECT doc_id, ref_idx, {case} AS reason FROM {raw} WHERE {case} IS NOT NULL"
    venue = f"substring(trim(coalesce(nullif(regexp_extract(raw, '{C.VENUES[0]}', 0), ''), nullif(regexp_extract(raw, '{C.VENUES[1]}', 0), ''))), 1, 80)"
    SQL["venue_hhi"] = f"SELECT doc_id, sum(c * c) / (sum(c) * sum(c)) AS hhi FROM (SELECT doc_id, venue, count(*) AS c FROM (SELECT doc_id, {venue} AS venue FROM {raw}) WHERE venue IS NOT NULL GROUP BY doc_id, venue) GROUP BY doc_id"
    SQL["year_cluster"] = rf"SELECT doc_id, year, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, year) AS r FROM (SELECT doc_id, year, count(*) AS n FROM (SELECT doc_id, nullif(regexp_extract(raw, '\b(19[89]\d|20[012]\d)\b', 0), '')::BIGINT AS year FROM {raw}) WHERE year IS NOT NULL GROUP BY doc_id, year)) WHERE r = 1"
    names = list(X._CASE)
    cases = _values([(i, *(X._CASE | c).values()) for i, c in enumerate(X._CASES)], "k, " + ", ".join(names))
    level = """CASE WHEN plagiarism > 0.70 OR hallucinated > 0 OR recycling_risk = 'CRITICAL' THEN 3 WHEN plagiarism > 0.40 OR ai > 0.70 OR recycling_risk = 'HIGH' OR citation > 0.30 OR network_risk = 'HIGH' OR coherence > 0.75 THEN 2
WHEN plagiarism > 0.20 OR ai > 0.50 OR recycling_risk = 'MEDIUM' OR citation > 0.10 OR style > 0.30 OR network_risk = 'MEDIUM' OR coherence > 0.50 THEN 1 ELSE 0 END"""
    SQL["risk_rules"] = f'SELECT k::BIGINT AS "case", [\'LOW\', \'MEDIUM\', \'HIGH\', \'CRITICAL\'][1 + least(3, {level} + verified_watermark::INT)] AS risk FROM {cases}'
    scores = _values([(0, None, None), (1, 0.3, None), (2, 0.9, None), (3, None, 0.9), (4, 0.3, 0.95), (5, 0.25, 0.85)], "k, j, c")
    SQL["plagiarism_score"] = f'SELECT k::BIGINT AS "case", round(coalesce((a + b) / 2, a, b, 0), 6) AS score FROM (SELECT k, CASE WHEN j * 2 > 1 THEN 1.0::DOUBLE ELSE j::DOUBLE * 2 END AS a, CASE WHEN c > 1 THEN 1.0::DOUBLE ELSE (c::DOUBLE - 0.80) / 0.20 END AS b FROM {scores})'


_fixture_sql()
