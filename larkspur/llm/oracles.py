"""SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from larkspur.plans.data import unescaped_sql

from .quality import BAD_RANGE, GOOD_RANGE, ITERATIONS, KEEP, MAX_REPEAT_PERCENT, MIN_WORDS, PRIOR_RANGE, RULES, START, WINDOW
from .warc import BREAKS, SILENT

_VALUE = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_VALUE, ["doc_id", "source", "lang", "n_chars", text])) + ")"
#: CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""
_UP = "SELECT g, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {t} WHERE n > 1 GROUP BY g, lvl, idx // 3, n"
_STEP = """SELECT d.doc_id, {k} + r.lvl AS k, coalesce(string_agg(r.h, '' ORDER BY r.idx) FILTER (r.idx < d.{i} // CAST(pow(3, r.lvl) AS BIGINT)), '') AS before, coalesce(string_agg(r.h, '' ORDER BY r.idx) FILTER (r.idx > d.{i} // CAST(pow(3, r.lvl) AS BIGINT)), '') AS after
  FROM placed d JOIN {t} r ON {on} r.n > 1 AND r.idx // 3 = d.{i} // CAST(pow(3, r.lvl + 1) AS BIGINT) GROUP BY d.doc_id, r.lvl"""

OP11 = f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_LEAF('text')} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF('text')} END AS given FROM documents),
 leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM docs),
 low(g, lvl, idx, n, h) AS (SELECT g, 0, idx, n, leaf FROM leaves UNION ALL {_UP.format(t='low')}),
 tops AS (SELECT g AS own, h, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
 high(g, lvl, idx, n, h) AS (SELECT '', 0, idx, n, h FROM tops UNION ALL {_UP.format(t='high')}),
 placed AS (SELECT l.*, t.idx AS top, t.h AS subroot FROM leaves l JOIN tops t ON l.g = t.own),
 steps AS ({_STEP.format(k=0, i='idx', t='low', on='r.g = d.g AND')} UNION ALL {_STEP.format(k=100, i='top', t='high', on='')}),
 path AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM steps),
 fold(doc_id, j, h) AS (SELECT doc_id, CAST(0 AS BIGINT), given FROM leaves UNION ALL SELECT f.doc_id, p.j, sha256(p.before || f.h || p.after) FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.j = f.j + 1),
 ends AS (SELECT doc_id, arg_max(h, j) AS folded_root FROM fold GROUP BY doc_id),
 proofs AS (SELECT doc_id, string_agg(before || after, '' ORDER BY j) AS proof FROM path GROUP BY doc_id)
 SELECT p.doc_id, p.leaf, p.subroot, r.h AS root, sha256(coalesce(f.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified FROM placed p JOIN ends e USING (doc_id) LEFT JOIN proofs f USING (doc_id), (SELECT h FROM high WHERE n = 1) r"""

_WIDTH, _ENTRIES, _ROUNDS = 8, 16, 6


def _assigned(r: int) -> str:
    far = " + ".join(f"(p.v[{i}] - b.v[{i}]) * (p.v[{i}] - b.v[{i}])" for i in range(1, _WIDTH + 1))
    return f"a{r} AS MATERIALIZED (SELECT p.row, p.s, any_value(p.v) AS v, min(({far}) * {_ENTRIES} + b.k) AS best FROM parts p JOIN b{r} b ON b.s = p.s GROUP BY p.row, p.s)"


def _moved(r: int) -> str:
    mean = ", ".join(f"CAST(floor(CAST(sum(v[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, _WIDTH + 1))
    return f"b{r + 1} AS MATERIALIZED (SELECT b.s, b.k, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT s, best % {_ENTRIES} AS k, [{mean}] AS v FROM a{r} GROUP BY ALL) m ON m.s = b.s AND m.k = b.k)"


#: A best value holds the squared distance and, behind it, the entry.
OP13 = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 parts AS (SELECT row, s, v[s * {_WIDTH} + 1 : (s + 1) * {_WIDTH}] AS v FROM kept, range(8) AS t(s)),
 b0 AS (SELECT s, row - 1 AS k, v FROM parts WHERE row <= {_ENTRIES}), {', '.join(f'{_assigned(r)}, {_moved(r)}' for r in range(_ROUNDS))}, {_assigned(_ROUNDS)},
 coded AS (SELECT k.row, any_value(k.vec_id) AS vec_id, any_value(k.label) AS label, string_agg(lpad(lower(to_hex(best % {_ENTRIES})), 2, '0'), '' ORDER BY s) AS code, CAST(sum(best // {_ENTRIES}) AS BIGINT) AS error FROM a{_ROUNDS} JOIN kept k USING (row) GROUP BY k.row)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY s, k)) FROM b{_ROUNDS}) AS codebooks_sha256 FROM coded"""


_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
#: The text of each page by the same rules: silent elements go, breaks are line ends, other tags go, references are decoded, white space is collapsed.
_BARE = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {_QUOTED(SILENT)}, '', 'g'), {_QUOTED(BREAKS)}, chr(10), 'g'), '<[^<>]*>', '', 'g')"
_TEXTS = f"""{unescaped_sql(_BARE)},
 texts AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\f\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS text FROM plain)"""
_UUID = lambda x: f"regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"
_LINE = lambda name, x: f"coalesce('{name}: ' || {x} || chr(13) || chr(10), '')"
_RECORD = lambda kind, other, mime, block: f"SELECT page_id, '{kind}' AS type, {kind} AS record_id, given AS refers_to, {other} AS concurrent_to, url AS target_uri, '2024-01-31T00:00:00Z' AS date, '{mime}' AS content_type, CAST(strlen({block}) AS BIGINT) AS content_length, status AS source_status, headers AS source_headers, payload_digest, 'sha1:' || sha1({block}) AS block_digest FROM parts"

OP7 = f"""WITH {_TEXTS},
 given AS (SELECT page_id, url, {_UUID("'response|' || coalesce(url, '') || '|' || sha1(coalesce(html, ''))")} AS given, 'sha1:' || sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS size, CASE WHEN html IS NOT NULL THEN '200' END AS status,
  CASE WHEN html IS NOT NULL THEN 'Content-Type: text/html; charset=utf-8; Content-Length: ' || strlen(html) END AS headers, t.text FROM pages JOIN texts t USING (page_id)),
 ided AS (SELECT *, {_UUID("'metadata|' || given || '|' || coalesce(url, '') || '|' || payload_digest")} AS metadata, {_UUID("'conversion|' || given || '|' || coalesce(url, '') || '|' || payload_digest")} AS conversion FROM given),
 parts AS (SELECT *, {_LINE('source-record', 'given')} || {_LINE('source-payload-digest', 'payload_digest')} || {_LINE('source-length', 'size')} || {_LINE('source-status', 'status')} || {_LINE('source-headers', 'headers')} || {_LINE('conversion', 'conversion')} AS lines FROM ided)
 {_RECORD('metadata', 'conversion', 'application/warc-fields', 'lines')} UNION ALL {_RECORD('conversion', 'metadata', 'text/plain; charset=utf-8', 'text')}"""

_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP9 = f"""WITH {_TEXTS},
 hosted AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, t.text FROM pages JOIN texts t USING (page_id)),
 split AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM hosted),
 keyed AS (SELECT *, nullif({_STRIPPED}, '') AS key FROM split),
 totals AS (SELECT host, count(*) AS host_pages FROM hosted GROUP BY host),
 common AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT page_id) AS n FROM keyed WHERE key IS NOT NULL GROUP BY ALL) JOIN totals USING (host) WHERE n >= 2 AND CAST(n AS DOUBLE) / host_pages > 0.1),
 marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON c.host = k.host AND c.key = k.key)
 SELECT page_id, host, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, greatest(CAST(count(*) FILTER (WHERE NOT gone) AS BIGINT), 1) AS n_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS text_sha256 FROM marked GROUP BY page_id, host"""

_R = range(1, len(RULES) + 1)
_VOTES = {
    "length": ("n_words >= 50", f"n_words < {MIN_WORDS}"), "word_length": ("word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"), "symbols": ("n_symbols * 50 <= n_words", "n_symbols * 5 > n_words"), "marks": ("n_marks * 50 <= n_words", "n_marks * 5 > n_words"),
    "dup_lines": ("n_dup_lines = 0", "n_dup_lines * 100 > n_lines * 30"), "repeats": ("n_repeat_words * 20 <= n_words", f"n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}"), "upper": ("n_upper * 5 <= n_letters", "n_upper * 2 > n_letters"), "vocabulary": ("n_distinct * 4 >= n_words", "n_distinct * 100 < n_words * 15"),
    "sentences": ("n_stops * 60 >= n_words AND n_stops * 2 <= n_words", "n_stops * 150 < n_words AND n_words >= 40"),
}
_CAST = ", ".join(f"CASE WHEN {_VOTES[r][1]} THEN 0 WHEN {_VOTES[r][0]} THEN 1 END" for r in RULES)
_ODDS = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE v[{i}] WHEN 1 THEN ln(good[{i}] / bad[{i}]) WHEN 0 THEN ln((1 - good[{i}]) / (1 - bad[{i}])) ELSE 0 END" for i in _R)


def _estimates(share: str, low: float, high: float) -> str:
    each = (f"least(greatest((1 + coalesce(sum(n * {share} * v[{i}]) FILTER (WHERE v[{i}] IS NOT NULL), 0)) / (2 + coalesce(sum(n * {share}) FILTER (WHERE v[{i}] IS NOT NULL), 0)), {low}), {high})" for i in _R)
    return f"[{', '.join(each)}]"


_SYMBOLS = "#*$%&|<>"
_BLANK = "[ \\t\\n\\x0b\\f\\r]"
#: Features by unnesting; expectation-maximisation as a recursion over the counts of vote patterns.
OP6 = f"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines FROM documents),
 windows AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - {WINDOW} + 2), lambda i: {{'i': i, 'g': hash(array_to_string(words[i:i + {WINDOW - 1}], ' '))}})) AS x FROM texts), grams AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS n FROM windows),
 covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, range({WINDOW}) AS r(k) WHERE n > 1 GROUP BY doc_id),
 counted AS (SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(translate(t, '{_SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(list_distinct(words)) AS n_distinct, len(regexp_extract_all(t || ' ', '[.!?]{_BLANK}')) AS n_stops, len(regexp_extract_all(t, '[{_SYMBOLS}]+')) AS n_marks FROM texts t LEFT JOIN covered c USING (doc_id)),
 voted AS MATERIALIZED (SELECT *, [{_CAST}] AS v FROM counted), patterns AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY v),
 em(k, prior, good, bad) AS (SELECT 0, CAST({START['prior']} AS DOUBLE), CAST([{', '.join(str(START['good']) for _ in _R)}] AS DOUBLE[]), CAST([{', '.join(str(START['bad']) for _ in _R)}] AS DOUBLE[])
  UNION ALL SELECT k + 1, least(greatest(sum(n * p) / sum(n), {PRIOR_RANGE[0]}), {PRIOR_RANGE[1]}), {_estimates('p', *GOOD_RANGE)}, {_estimates('(1 - p)', *BAD_RANGE)} FROM (SELECT k, v, n, 1 / (1 + exp(-({_ODDS}))) AS p FROM em, patterns WHERE k < {ITERATIONS}) GROUP BY k),
 judged AS (SELECT d.*, 1 / (1 + exp(-({_ODDS}))) AS quality FROM voted d, (SELECT * FROM em WHERE k = {ITERATIONS}) m),
 hard AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM judged)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, floor(quality * 1000000 + 0.5) / 1000000 AS quality, NOT base_failed AND quality >= {KEEP} AS kept FROM hard"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = lambda x: f"translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}')"

#: All pairs that share a shingle, those that are alike, and what can be reached over them.
OP4 = f"""WITH RECURSIVE texts AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLDED('text')}, '{_BLANK}+'), lambda w: w <> '') AS w FROM documents),
 shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM texts),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)), ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.node)
 SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.node) AS component_id, min(r.node) = r.doc_id AS kept FROM reach r LEFT JOIN sizes s USING (doc_id) GROUP BY r.doc_id"""

_WORDS_OF = lambda x: f"regexp_extract_all({_FOLDED(x)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_GRAMS = lambda size: f"unnest(list_transform(range(1, len(w) - {size} + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + {size} - 1], ' ')}}))"
#: Windows of items, of as many words as the item has but thirteen at most, joined to the windows of documents.
OP5 = f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_OF('text')} AS w FROM benchmark), sized AS (SELECT *, least(len(w), 13) AS size FROM items WHERE len(w) > 0),
 theirs AS MATERIALIZED (SELECT DISTINCT item, size, x.g AS g FROM (SELECT item, size, {_GRAMS('size')} AS x FROM sized)),
 docs AS MATERIALIZED (SELECT doc_id, {_WORDS_OF('text')} AS w FROM documents), ours AS (SELECT doc_id, size, {_GRAMS('size')} AS x FROM docs, (SELECT DISTINCT size FROM sized)),
 hits AS MATERIALIZED (SELECT o.doc_id, o.x.i AS i, o.size, t.item FROM ours o JOIN theirs t ON t.size = o.size AND t.g = o.x.g),
 marks AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated FROM docs d LEFT JOIN marks USING (doc_id) LEFT JOIN named USING (doc_id)"""
