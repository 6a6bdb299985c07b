"""DuckDB SQL of the queries whose whole result SQL can say."""

from __future__ import annotations

from newsgraph.llm.personal_data import ADDED, BASE, CONTEXT, IBAN_LENGTHS, words_pattern
from newsgraph.llm.warc_index import LEAST_REVISIT, SECONDS

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
per_doc AS (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM per_doc GROUP BY ALL HAVING count(*) >= 3),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
p AS (
  SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(o.total, 0) + l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM kept k JOIN langs l USING (lang) JOIN sources s USING (lang)
  LEFT JOIN own o USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every_pair
  UNION ALL
  SELECT lang, source, 'term', term, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term)
  FROM (SELECT lang, source, term, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

SPELLING_VARIANTS = rf"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
lowered AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, {LOWER.format("run")} AS run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS bytes FROM lowered),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(length(bytes) // 2), lambda i: (instr('0123456789ABCDEF', bytes[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', bytes[2 * i + 2]) - 1),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h
  FROM hashed, crc_table),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY ALL HAVING sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
links AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS n FROM links GROUP BY ALL),
forms AS MATERIALIZED (
  SELECT w.word, CASE WHEN b.n >= 5 * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN roots USING (word)
"""


WARC_INDEX = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, regexp_replace(regexp_replace(url, '(?s)^.*?://', ''), '(?s)#.*$', '') AS rest FROM pages),
d AS (SELECT *, sha1(payload) AS digest, strlen(payload) AS bytes, lower(regexp_extract(rest, '^[^/?]*')) AS host FROM p),
k AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_replace(rest, '(?s)^[^/?]*', '') AS url_key,
    CASE WHEN bytes >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY digest, bytes) END AS last,
    ((coalesce(page_id, 0) % {SECONDS}) + {SECONDS}) % {SECONDS} AS captured
  FROM d),
r AS (SELECT *, CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to FROM k)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url_key,
  row_number() OVER (ORDER BY url_key NULLS FIRST, captured, page_id NULLS FIRST) - 1 AS position,
  row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id NULLS FIRST) AS history_no
FROM r
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT d, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM docs),
tokens AS MATERIALIZED (SELECT d, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT a.d AS a, b.d AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.d < b.d
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.d, b.d, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(d, other) AS (SELECT d, d FROM docs UNION SELECT r.d, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reached r ON r.d = s.d JOIN sets o ON o.d = r.other GROUP BY s.d, s.doc_id, s.s
"""


def _personal_data() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN {digits}[length({digits}) - i + 1]::INT
           WHEN 2 * {digits}[length({digits}) - i + 1]::INT > 9 THEN 2 * {digits}[length({digits}) - i + 1]::INT - 9
           ELSE 2 * {digits}[length({digits}) - i + 1]::INT END)) % 10 = 0"""
    compact = "replace(m, ' ', '')"
    turned = f"(substr({compact}, 5) || left({compact}, 4))"
    mod97 = f"""list_reduce(list_transform(range(1, length({turned}) + 1), lambda i: ascii({turned}[i])),
      lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END, 0) = 1"""
    lengths = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items()) + "}"
    plain = {  # the base patterns as the contract has them
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE ('0' || ltrim(x, '0'))::INT END)) <= 255",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"CASE WHEN length({compact}) = coalesce({lengths}[left(m, 2)], 0) THEN {mod97} ELSE false END "
                "AND NOT regexp_matches(lft, '[A-Za-z0-9]$') AND NOT regexp_matches(rgt, '^[A-Za-z0-9]')",
        "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|0000$') AND NOT regexp_matches(lft, '[A-Za-z0-9-]$') "
               "AND NOT regexp_matches(rgt, '^[A-Za-z0-9-]')",
    }
    parts = []
    for number, kind in enumerate(BASE + ADDED):
        pattern = plain.get(kind.name, kind.pattern)
        against = f" - CASE WHEN regexp_matches(near, '{words_pattern(kind.against)}') THEN {kind.less} ELSE 0 END" if kind.against else ""
        parts.append(f"""
SELECT d, {number} AS kind_no, '{kind.name}' AS kind, start, start + length(m) AS "end", score FROM (
  SELECT *, greatest(0, least(100, {kind.score} + CASE WHEN regexp_matches(near, '{words_pattern(kind.words)}') THEN {kind.more} ELSE 0 END{against})) AS score
  FROM (
    SELECT d, m, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY d ORDER BY i) - length(m) AS start,
           CASE WHEN gap = '' AND i > 1 THEN '0' ELSE gap END AS lft,
           CASE WHEN following = '' AND i < k THEN '0' ELSE following END AS rgt,
           {LOWER.format(f"right(gap, {CONTEXT}) || chr(10) || left(following, {CONTEXT})")} AS near
    FROM (SELECT d, unnest(ms) AS m, unnest(gaps[1:k]) AS gap, unnest(gaps[2:k + 1]) AS following, unnest(range(1, k + 1)) AS i, k
          FROM (SELECT d, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps, len(ms) AS k FROM docs)
          WHERE k > 0))
  WHERE {valid[kind.name]})
WHERE score >= {kind.least}""")
    count = lambda kinds: ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in kinds)
    named = "kind || ':' || start::BIGINT || ':' || \"end\"::BIGINT"
    counts = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE + ADDED)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
per_doc AS (
  SELECT d, {count(BASE + ADDED)},
         string_agg({named}, ',' ORDER BY kind_no, start) FILTER (kind_no < {len(BASE)}) AS base,
         string_agg({named}, ',' ORDER BY kind_no, start) AS spans,
         string_agg(score::VARCHAR, ',' ORDER BY kind_no, start) AS scores
  FROM spans GROUP BY d)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM docs LEFT JOIN per_doc USING (d)
"""


PERSONAL_DATA = _personal_data()
