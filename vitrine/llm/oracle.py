"""DuckDB statements for the queries that SQL can express."""

URL_SQL = """
WITH rules(rule, host, path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(rule || chr(9) || verdict, length(rule)) FROM rules r
     WHERE (parts.host = r.host OR ends_with(parts.host, '.' || r.host)) AND starts_with(parts.path, r.path)) AS best
  FROM parts)
SELECT page_id, host, path, split_part(best, chr(9), 1) AS rule, coalesce(split_part(best, chr(9), 2), 'allow') AS verdict
FROM judged
"""

#: crc32 has no function in DuckDB: a table of 256 remainders, made from the
#: polynomial, and one step per byte of every distinct word.
IMPORTANCE_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
spelt AS (
  SELECT doc_id, rowid AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
asked AS (
  SELECT regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
held AS (SELECT r, unnest(ws) AS w FROM spelt),
wanted AS (SELECT unnest(ws) AS w FROM asked),
vocabulary AS (
  SELECT w, list_transform(range(0, length(hex(w)), 2), lambda i: ('0x' || substr(hex(w), i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT w FROM held UNION SELECT w FROM wanted)),
hashed AS (
  SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM vocabulary, steps),
s AS (SELECT bucket, count(*) AS s FROM held JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM held) AS s_all, (SELECT count(*) FROM wanted) AS t_all),
gains AS (
  SELECT w, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM hashed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, sum(gain)::BIGINT AS total FROM held JOIN gains USING (w) GROUP BY r),
weighed AS (
  SELECT doc_id, r, len(ws)::BIGINT AS n_features,
    CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM spelt LEFT JOIN sums USING (r)),
scored AS (
  SELECT doc_id, r, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (10 * n) // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


def _any_case(words: list[str]) -> str:
    """RE2 folds some non-ASCII letters too, so both cases are spelt out."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


#: kind: its pattern in RE2 (which has no lookbehind: leftmost runs of the
#: least length or more are whole runs) and whether group 1 is the secret.
_SECRETS = {
    "assign": (f"(?:{_any_case(['password', 'passwd', 'secret', 'token', 'api_key', 'apikey'])})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "regexp_extract(x, re, 1)"),
    "access": ("AKIA[A-Z0-9]{16,}", "x"),
    "hex": ("[0-9a-f]{24,}", "x"),
    "token": ("[A-Za-z0-9_-]{20,}", "x"),
    "key_block": ("-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x09-\\x0D\\x20]*(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?", "regexp_replace(x, '-----[A-Z0-9 ]+-----|[\\x09-\\x0D\\x20]', '', 'g')"),
    "url_password": ("[A-Za-z]{2,12}://[^\\x09-\\x0D\\x20/:@]+:([^\\x09-\\x0D\\x20/@]+)@", "regexp_extract(x, re, 1)"),
}

SECRET_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || chr(1) || coalesce(lang, '') AS repository
  FROM documents),
taken AS ({taken}),
each AS (SELECT r, ord, kind, unnest(m) AS x, unnest(p) AS gap, unnest(range(len(m))) AS i FROM (SELECT *, string_lists[1] AS m, string_lists[2][1:len(string_lists[1])] AS p FROM taken)),
placed AS (SELECT r, ord, kind, x, sum(length(gap) + length(x)) OVER (PARTITION BY r, ord ORDER BY i)::BIGINT AS stop FROM each),
valued AS (SELECT r, ord, kind, x, stop - length(x) AS start, stop, CASE {value} END AS v FROM placed),
measured AS (
  SELECT *, length(regexp_replace(v, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS letters,
    -list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))) AS bits
  FROM valued),
counted AS (
  SELECT *, sha256(v) AS secret,
    length(v) >= 8 AND digits > 0 AND coalesce(bits, 0) >= 2.5 AND NOT regexp_matches(v, '(?i)example|sample|change.?me|your[_-]|placeholder|dummy|x{{6}}|0{{8}}|123456|redacted') AS random
  FROM measured
  WHERE (kind <> 'assign' OR length(v) >= 6)
    AND (kind <> 'token' OR (digits >= 3 AND letters >= 3 AND bits >= 3.2 AND NOT regexp_matches(v, '^[0-9A-Fa-f]{{8}}(?:-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$')))),
owned AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM counted JOIN docs USING (r) GROUP BY secret),
judged AS (
  SELECT r, ord, kind, start, stop, CASE WHEN owners >= 3 AND repositories >= 3 THEN 'example' WHEN random THEN 'live' ELSE 'weak' END AS verdict
  FROM counted JOIN owned USING (secret)),
shown AS (
  SELECT *, kind || ':' || start || ':' || stop AS span FROM judged j
  WHERE ord < 3 OR (verdict = 'live' AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.r = j.r AND b.ord < 3 AND b.start < j.stop AND j.start < b.stop))),
listed AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example,
    string_agg(span, ',' ORDER BY start, ord) FILTER (verdict = 'live') AS live_spans
  FROM shown GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(live_spans, '') AS live_spans
FROM docs LEFT JOIN listed USING (r)
""".format(
    taken=" UNION ALL ".join(f"SELECT r, {i} AS ord, '{k}' AS kind, [regexp_extract_all(text, '{re}'), string_split_regex(text, '{re}')] AS string_lists FROM docs WHERE regexp_matches(text, '{re}')" for i, (k, (re, _)) in enumerate(_SECRETS.items())),
    value=" ".join(f"WHEN kind = '{k}' THEN {v.replace(', re,', f', {chr(39)}{re}{chr(39)},')}" for k, (re, v) in _SECRETS.items()),
)
