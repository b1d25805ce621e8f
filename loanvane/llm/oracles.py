"""DuckDB counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

from loanvane.llm import line_cleaning as lc
from loanvane.llm import sharding
from loanvane.llm.license_scan import ACCEPTED, NAMED, template_pattern
from loanvane.llm.license_templates import PHRASES, TEMPLATES

SHARDS = f"""
WITH rows AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS row_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
nodes AS (
  SELECT doc_id, row_bytes, d, h >> (60 - d) AS prefix,
         sum(row_bytes) OVER (PARTITION BY d, h >> (60 - d)) AS shard_bytes,
         count(DISTINCT h) OVER (PARTITION BY d, h >> (60 - d)) AS keys
  FROM rows, range(0, 41) t(d)),
first AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM nodes
  WHERE shard_bytes <= {sharding.SHARD_BYTES} OR keys = 1)
SELECT doc_id, d || '-' || prefix || '-0' AS shard, CAST(d AS INT) AS shard_depth, row_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM first WHERE k = 1
"""

_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in lc.BOILERPLATE)

LINES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
lines AS (
  SELECT doc_id, line, CAST(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n,
         length(line) - length(replace(line, '|', '')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>]|[!?]{{2,}}')) AS marks
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
per_line AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
         CAST(coalesce(sum(n) FILTER (n > 0 AND (10 * bars > n OR 5 * marks > n OR {_PHRASES})), 0) AS BIGINT) AS lost_words
  FROM lines GROUP BY doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM places),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, n_dup_lines, lost_words,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words JOIN per_line USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < {lc.MIN_WORDS} OR 100 * n_repeat_words > {lc.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
       NOT base_failed AND 100 * lost_words <= {lc.MAX_LOST_PERCENT} * n_words AS kept
FROM judged
"""

WARC = """
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS last_id FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM sized s LEFT JOIN last ON s.payload_digest = last.payload_digest AND payload_bytes >= 1000
"""

BENCHMARK = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (
  SELECT doc_id, i, s.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM spots) s
  JOIN windows v ON s.gram = v.gram AND s.n = v.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_CHANGED = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))
# CRC-32 of the id's digits, bit by bit: DuckDB has no such function.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
       lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) for i in range(8)]),
                    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_CHANGED}) ELSE sha256({_LEAF}) END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
up AS (
  SELECT coalesce('v' || lang, '') AS tree, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY tree, level, place // 2, n),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 2, n),
walk AS (
  SELECT l.doc_id, coalesce('v' || l.lang, '') AS tree, l.leaf, l.place AS spot, l.n AS size, 0 AS step, FALSE AS top, '' AS proof, l.shown AS folded FROM leaves l
  UNION ALL
  SELECT doc_id, w.tree, leaf,
         CASE WHEN w.size > 1 THEN spot // 2 ELSE s.place END, CASE WHEN w.size > 1 THEN (w.size + 1) // 2 ELSE s.n END,
         CASE WHEN w.size > 1 THEN step + 1 ELSE 0 END, top OR w.size = 1,
         proof || coalesce(CASE WHEN w.size > 1 THEN coalesce(u.digest, h.digest) END, ''),
         CASE WHEN w.size > 1 THEN sha256(CASE WHEN spot % 2 = 1 THEN coalesce(u.digest, h.digest) || folded
                                               ELSE folded || coalesce(u.digest, h.digest, '') END) ELSE folded END
  FROM walk w
  LEFT JOIN up u ON NOT w.top AND u.tree = w.tree AND u.level = w.step AND u.place = xor(w.spot, 1)
  LEFT JOIN high h ON w.top AND h.level = w.step AND h.place = xor(w.spot, 1)
  JOIN subroots s ON s.tree = w.tree
  WHERE w.size > 1 OR NOT w.top)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM walk w JOIN subroots s USING (tree), (SELECT digest FROM high WHERE n = 1) r
WHERE w.top AND w.size = 1
"""

_LICENSE_HITS = ", ".join(f"CASE WHEN regexp_matches(joined, '{template_pattern(markup)}') THEN '{label}' END" for label, markup in TEMPLATES)
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, i - 1 AS spot FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}) WHERE "
    + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
    for words, label in ((p.split(" "), label) for p, label in PHRASES)
    for n in [len(words)]
)

LICENSES = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS ({_PLACES}),
base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS named FROM places GROUP BY doc_id),
hits AS (SELECT doc_id, list_filter([{_LICENSE_HITS}], lambda x: x IS NOT NULL) AS found
         FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM d))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(named), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), found))), ',') AS labels,
       CAST(CASE WHEN len(found) > 0 THEN {ACCEPTED} WHEN n_base > 0 THEN {NAMED} ELSE 0 END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) JOIN hits USING (doc_id)
"""

ORACLES = {
    "op1_extendible_shards": SHARDS, "op5_line_cleaning": LINES, "op8_zip_warc": WARC, "op9_positional_index": BENCHMARK,
    "op11_merkle_manifest": MANIFEST, "op12_license_scan": LICENSES,
}
