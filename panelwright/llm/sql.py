"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {
    "op2_url_automaton": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^([^/]*)', 1, 's')) + 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN ('.' || host) LIKE '%.adult-%' OR ('.' || host) LIKE '%.%-adult.%' OR ('.' || host) LIKE '%.porn%'
      OR ('.' || host) LIKE '%.xxx-%' OR ('.' || host) LIKE '%.casino%' OR ('.' || host) LIKE '%.%-casino.%'
      OR ('.' || host) LIKE '%.cheap-pills%' OR ('.' || host) LIKE '%.%-pills.%' OR ('.' || host) LIKE '%.viagra%'
      OR path LIKE '%/adult/%' OR path LIKE '%/casino/%' OR path LIKE '%.exe' OR path LIKE '%.zip' THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE
remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
marked AS (
  SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: ascii(CAST(doc_id AS VARCHAR)[i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM documents d, remainders),
copies AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered FROM marked),
heads AS (
  SELECT doc_id, source, text, altered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM copies),
digests AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS delivered FROM heads),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r FROM digests),
nodes(k, source, i, h) AS (
  SELECT 0, source, i, leaf FROM leaves
  UNION ALL
  SELECT k + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM nodes) WHERE c > 1 GROUP BY k, source, i // 3),
tall AS (SELECT *, max(k) OVER (PARTITION BY source) AS top FROM nodes),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM tall WHERE k = top),
crowns(k, i, h) AS (
  SELECT 0, i, subroot FROM subroots
  UNION ALL
  SELECT k + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM crowns) WHERE c > 1 GROUP BY k, i // 3),
above AS (SELECT *, max(k) OVER () AS top FROM crowns),
levels AS (
  SELECT l.r, n.k, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < l.i // CAST(3 ** n.k AS BIGINT)), '') AS lft,
    coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > l.i // CAST(3 ** n.k AS BIGINT)), '') AS rgt
  FROM leaves l JOIN tall n ON n.source IS NOT DISTINCT FROM l.source AND n.k < n.top AND n.i // 3 = l.i // CAST(3 ** (n.k + 1) AS BIGINT)
  GROUP BY l.r, n.k
  UNION ALL
  SELECT l.r, 1000 + n.k, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < s.i // CAST(3 ** n.k AS BIGINT)), ''),
    coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > s.i // CAST(3 ** n.k AS BIGINT)), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
    JOIN above n ON n.k < n.top AND n.i // 3 = s.i // CAST(3 ** (n.k + 1) AS BIGINT)
  GROUP BY l.r, n.k),
proofs AS (
  SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof, list(lft || '|' || rgt ORDER BY k) AS steps FROM levels GROUP BY r),
folded AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM above WHERE k = top) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(l.delivered, coalesce(p.steps, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN proofs p ON p.r = l.r)
SELECT *, folded_root = root AS verified FROM folded""",
    "op13_spelling_variants": r"""
WITH RECURSIVE
remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
spelled AS (SELECT *, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS bytes FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM spelled, remainders),
misspelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM misspelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, a.d FROM gaps a WHERE a.d IN (SELECT word FROM words)
  UNION SELECT a.d, a.word FROM gaps a WHERE a.d IN (SELECT word FROM words)),
ranked AS (
  SELECT near.word, near.other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, near.other) AS r
  FROM near JOIN words o ON o.word = near.other),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form,
    CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chains(word, root, k) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL
  SELECT c.word, f.form, k + 1 FROM chains c JOIN formed f ON f.word = c.root AND f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(root, k) AS root FROM chains GROUP BY word) c ON c.word = f.word""",
}
