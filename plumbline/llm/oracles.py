"""DuckDB SQL of the queries here that SQL can express on whole tables."""

_OP7 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
tri AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM base),
named AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM tri),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM named) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
judged AS (
  SELECT doc_id, line,
         list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw,
         length(line) - length(regexp_replace(line, '[#*$%&<>{}=~^_\\]', '', 'g')) AS symbols,
         length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS marks,
         length(line) - length(regexp_replace(line, '[|»•·]', '', 'g')) AS links
  FROM (SELECT doc_id, unnest(l) AS line FROM base)),
verdict AS (
  SELECT doc_id, sum(CASE WHEN symbols >= 0.5 * len(lw) OR (marks >= 0.5 * len(lw) AND len(lw) >= 3)
           OR (links >= 3 AND (len(lw) - links) / (links + 1) <= 3.0)
           OR (len(lw) <= 40 AND length(line) - length(regexp_replace(line, '(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|we use cookies|enable javascript|javascript is disabled|click here|read more|sign (in|up)|log ?in|subscribe (now|to)|newsletter|share (this|on)|follow us|back to top|skip to (main )?content|lorem ipsum|page not found)\b|©|\b(tous droits r|mentions l.gales|politique de confidentialit|en savoir plus|lire la suite|se connecter|alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|mehr erfahren|jetzt anmelden|todos los derechos reservados|pol.tica de privacidad|iniciar sesi)', '', 'g')) >= 0.3 * length(line))
           OR (len(lw) <= 3 AND length(line) < 40 AND NOT regexp_matches(line, '[.!?…:;。！？][''\x22»”’)\]]*[\x20\x09-\x0D]*\z'))
           OR (len(lw) >= 10 AND len(list_distinct(lw)) < 0.15 * len(lw))
         THEN length(array_to_string(lw, '')) ELSE 0 END) AS lost
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(v.lost, 0) AS lost
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN verdict v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT lost > 0.5 * word_chars AS kept
FROM counted
"""

ORACLES: dict[str, str] = {"op7_quality": _OP7}
