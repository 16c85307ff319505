"""SQL counterparts of the queries that SQL can express, for DuckDB over whole tables."""

from __future__ import annotations

from ontide.llm import license_scan, quality_rules

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


_LINE_FAILS = f"""
  NOT regexp_matches(line, {quoted(quality_rules.SENTENCE_END)})
  OR (loud > 0 AND 100 * loud >= 30 * len(own))
  OR (bars > 0 AND 100 * bars >= 20 * len(own))
  OR regexp_matches(lower(line), {quoted(quality_rules.PHRASE)})
  OR (capitals > 1 AND capitals > small AND len(own) >= 5)"""

OP1 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w
  FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
judged AS (
  SELECT rid, line, {words('line')} AS own,
    len(list_filter({words('line')}, lambda x: regexp_matches(x, {quoted(quality_rules.LOUD_WORD)}))) AS loud,
    len(list_filter({words('line')}, lambda x: regexp_matches(x, {quoted(quality_rules.SEPARATOR_WORD)}))) AS bars,
    length(regexp_replace(line, '[^A-Z]', '', 'g')) AS capitals,
    length(regexp_replace(line, '[^a-z]', '', 'g')) AS small
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
by_doc AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dups,
    coalesce(sum(length(array_to_string(own, ''))) FILTER ({_LINE_FAILS}), 0) AS lost
  FROM judged GROUP BY rid),
grams AS (
  SELECT rid, i, w[i:i + 4] AS gram FROM docs, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5),
often AS (SELECT rid, gram FROM grams GROUP BY rid, gram HAVING count(*) > 1),
repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM grams JOIN often USING (rid, gram), unnest(range(5)) AS s(k)
  GROUP BY rid),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM docs LEFT JOIN by_doc USING (rid) LEFT JOIN repeated USING (rid)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept, lost_chars
FROM based
"""


def item_words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP3 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {item_words("coalesce(text, '')")} AS w FROM documents),
items AS (
  SELECT item_id, {item_words("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS gram
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT rid, i, size, w[i:i + size - 1] AS gram
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
found AS (SELECT rid, i, size, item_id FROM grams JOIN windows USING (size, gram)),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM found, unnest(range(size)) AS s(k) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

OP5 = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first_id FROM rows WHERE strlen(html) >= 100 GROUP BY digest)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END
    AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM rows LEFT JOIN firsts USING (digest)
"""

_PLAIN_WORDS = "regexp_extract_all(lower({}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEMPLATES = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in license_scan.TEMPLATES.items())

OP7 = f"""
WITH templates AS (
  SELECT license, {_PLAIN_WORDS.format('body')} AS w FROM (VALUES {_TEMPLATES}) AS t(license, body)),
own AS (
  SELECT DISTINCT license, w[i:i + 2] AS gram FROM templates, unnest(range(1, len(w) - 1)) AS t(i)),
sizes AS (SELECT license, count(*) AS size FROM own GROUP BY license),
docs AS (SELECT doc_id, {_PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents),
hits AS (
  SELECT doc_id, license, i - 1 AS pos, gram, n FROM (
    SELECT doc_id, i, w[i:i + 2] AS gram, len(w) - 2 AS n
    FROM docs, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3) JOIN own USING (gram)),
windows AS (
  SELECT DISTINCT doc_id, license, 4 * (pos // 4 - k) AS start FROM hits, unnest([0, 1]) AS s(k)
  WHERE pos // 4 - k >= 0 AND pos // 4 - k <= greatest(0, ceil((n - 8) / 4.0))),
shares AS (
  SELECT v.doc_id, v.license, v.start, count(DISTINCT h.gram) / any_value(size)::DOUBLE AS share
  FROM windows v JOIN sizes USING (license) JOIN hits h
    ON h.doc_id = v.doc_id AND h.license = v.license AND h.pos >= v.start - size AND h.pos < v.start + 8 + size
  GROUP BY ALL)
SELECT doc_id, license, max(share) AS containment FROM shares WHERE share >= 0.8 GROUP BY doc_id, license
"""

OP9 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {words(f"translate(coalesce(text, ''), {LETTERS})")} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, w[i:i + 2] AS gram
  FROM docs, unnest(range(1, greatest(2, len(w) - 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b USING (gram)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id, n
"""

OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {item_words("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT rid, doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM sizes),
tfs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest({item_words("coalesce(text, '')")}) AS term FROM benchmark),
impacts AS (
  SELECT rid, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // terms)) AS impact
  FROM tfs JOIN sizes USING (rid), totals),
scored AS (
  SELECT item_id, rid, CAST(sum(w * impact) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, rid),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
    doc_id, score
  FROM scored JOIN sizes USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# SQL has no CRC-32: its table of 256 remainders by the rule, then a byte at a time.
OP12 = f"""
WITH RECURSIVE remainders AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {LETTERS}) AS run
    FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
coded AS (
  SELECT run, n, flatten(list_transform(
    list_transform(regexp_extract_all(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '.'),
      lambda x: CAST(unicode(x) AS BIGINT)),
    lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS bytes
  FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, remainders),
slipped AS (
  SELECT n, CASE WHEN h % 199 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6
  GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS s(i)),
near AS (
  SELECT a.word AS word, b.word AS other FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, words.n AS other_n,
    row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, other) AS place
  FROM near JOIN words ON other = words.word),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form,
    CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word AND place = 1),
follow AS (
  SELECT word, word AS reached FROM formed
  UNION ALL SELECT follow.word, form FROM follow JOIN formed ON formed.word = reached WHERE form IS NOT NULL)
SELECT formed.word, formed.form, reached AS root, formed.n, CAST(formed.n_near AS BIGINT) AS n_near, formed.form_n
FROM formed JOIN follow ON follow.word = formed.word JOIN formed ends ON ends.word = reached AND ends.form IS NULL
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op3_decontaminate": OP3,
    "op5_warc": OP5,
    "op7_license_scan": OP7,
    "op9_jaccard_join": OP9,
    "op11_lexical_search": OP11,
    "op12_spelling_variants": OP12,
}
