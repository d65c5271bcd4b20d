"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from webledger.llm import chat, orchard, rules, spelling

_TAILS = chat._TAILS

OP4 = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*){_TAILS}', '\1\\\2\3', 'g')) AS text_len,
    length(regexp_replace(role, '([<\[])(\\*){_TAILS}', '\1\\\2\3', 'g')) AS role_len,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_len + CASE WHEN pos > 1 AND before = role THEN {len(chat.NEXT)}
    ELSE {len(chat.START) + len(chat.BODY) + len(chat.END)} + role_len END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

_DIRTY_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce({_DIRTY_WORDS}, []) AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT item_id, {_DIRTY_WORDS} AS w FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(rules.RULES.values()))

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tok AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
lined AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lined USING (doc_id)),
f AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {rules.mask(rules.BASE)}) <> 0 AS base_failed,
  (fail_bits & {rules.mask(rules.BASE) | rules.mask(rules.CURRENT)}) = 0 AS kept, fail_bits
FROM f
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# five hex digits are twenty bits, four letters of base32
_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', 1 + CAST((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31 AS INTEGER), 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w]
    ELSE [list_slice(w, i, i + 1) FOR i IN range(1, len(w))] END) AS g FROM d),
sizes AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM x JOIN x y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT r.a AS doc_id, any_value(n) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""

# crc32 by its table of 256 entries, which is worked out bit by bit
OP12 = rf"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {spelling.LETTERS} GROUP BY doc_id, run),
bytes AS (SELECT *, list_prepend(4294967295, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END
    FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')])) AS b FROM per_doc),
summed AS (SELECT run, n, xor(list_reduce([CAST(x AS BIGINT) FOR x IN b],
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
turned AS (SELECT CASE WHEN h % {spelling.EDITED} = 0
    THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM turned WHERE length(word) >= {spelling.LETTERS}
  GROUP BY word HAVING sum(n) >= {spelling.OFTEN}),
cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, i
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest
  UNION SELECT DISTINCT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n
  FROM pairs JOIN (SELECT word AS other, n FROM words) USING (other) GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling.RATIO} * w.n THEN best END AS form,
    CASE WHEN best_n >= {spelling.RATIO} * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed),
{"".join(f"chain{k} AS (SELECT c.word, coalesce(f.form, c.root) AS root FROM chain{k - 1 or ''} c LEFT JOIN formed f ON f.word = c.root)," for k in range(1, 9))}
ends AS (SELECT * FROM chain8)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


def _op13() -> str:
    parts, entries, rounds = orchard.PARTS, orchard.ENTRIES, orchard.ROUNDS
    nearest = """SELECT vec_id, part, arg_min(entry, (square, entry)) AS entry, min(square) AS square FROM (
      SELECT v.vec_id, v.part, b.entry, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, b.x)]) AS square
      FROM pieces v JOIN {book} b ON b.part = v.part) GROUP BY vec_id, part"""
    steps = []
    for k in range(rounds):
        steps.append(f"""near{k} AS ({nearest.format(book=f"book{k}")}),
mean{k} AS (SELECT part, entry, list(CAST(m AS BIGINT) ORDER BY i) AS x FROM (
    SELECT part, entry, i, (s - ((s % c) + c) % c) // c AS m FROM (
      SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS c
      FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM near{k} JOIN pieces USING (vec_id, part))
      GROUP BY part, entry, i)) GROUP BY part, entry),
book{k + 1} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor({orchard.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)),
pieces AS (SELECT vec_id, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS x
  FROM (SELECT vec_id, v, unnest(range({parts})) AS part FROM kept)),
book0 AS (SELECT part, entry, x FROM pieces JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {entries}),
{",".join(steps)},
last AS ({nearest.format(book=f"book{rounds}")}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(square) AS BIGINT) AS error FROM last GROUP BY vec_id),
told AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), told
"""


ORACLES: dict[str, str] = {
    "op4_chat_formatting": OP4,
    "op5_warc": OP5,
    "op6_decontamination": OP6,
    "op8_near_duplicates": OP8,
    "op9_quality_rules": OP9,
    "op12_spelling_variants": OP12,
    "op13_vector_codes": _op13(),
}
