"""SQL that gives the rows of the queries in another engine."""

from __future__ import annotations

from . import perspectives as seats
from . import quality_lines as lines

WORD = r"[^\x20\x09-\x0D]+"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS lines FROM d),
k AS (
  SELECT *, list_filter(lines, lambda l, i:
    NOT (
      (len(regexp_extract_all(l, {text(lines.NAVIGATION)})) >= {lines.SEPARATORS}
        OR length(regexp_replace(l, '{lines.NO_SYMBOLS}', '', 'g')) > CAST({lines.SYMBOL_SHARE} AS DOUBLE) * length(l)
        OR len(regexp_extract_all(l, {text(lines.SHOUT)})) >= {lines.SEPARATORS}
        OR regexp_matches(l, {text(lines.BOILERPLATE)}))
      OR (i < len(lines) AND NOT regexp_matches(l, {text(lines.CLOSED)})
        AND len(regexp_extract_all(l, '{WORD}')) >= {lines.SHORT_LINE})
      OR (list_position(lines, l) < i AND regexp_matches(l, '{lines.NOT_SPACE}'))
    )) AS passing
  FROM w
),
win AS (
  SELECT r, i, hash(w[i], w[i + 1], w[i + 2]) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM win) WHERE c > 1),
cover AS (
  SELECT r, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
),
m AS (
  SELECT k.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '{lines.NO_SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(lines, lambda l: regexp_matches(l, '{lines.NOT_SPACE}')))
      - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '{lines.NOT_SPACE}')))) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    CAST(length(array_to_string(regexp_extract_all(array_to_string(passing, chr(10)), '{WORD}'), '')) AS BIGINT) AS clean_chars
  FROM k LEFT JOIN cover ON k.r = cover.r
),
f AS (SELECT *, n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND clean_chars >= CAST({lines.KEEP_SHARE} AS DOUBLE) * word_chars AS kept, clean_chars
FROM f
"""

NARRATOR_LIST = ", ".join(text(name) for name in seats.NARRATORS)
PERSPECTIVES_SQL = f"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS what,
    CAST(floor(turn / {seats.PART_TURNS}) AS BIGINT) AS part
  FROM conversations
),
people AS (SELECT DISTINCT conv_id, role AS seat FROM said WHERE role IS NOT NULL AND role NOT IN ({NARRATOR_LIST})),
seen AS (
  SELECT said.*, seat, role IS NOT DISTINCT FROM seat AS own,
    '{seats.OPEN}' || CASE WHEN role = seat THEN 'assistant' WHEN role IN ({NARRATOR_LIST}) THEN role
      WHEN role IS NULL THEN 'user' ELSE 'user name=' || role END || chr(10) AS head,
    what || {text(seats.CLOSE.strip())} || chr(10) AS body,
    row_number() OVER (PARTITION BY said.conv_id, part, seat
      ORDER BY turn IS NULL, turn NULLS FIRST, role NULLS FIRST, what) AS k
  FROM said JOIN people ON said.conv_id IS NOT DISTINCT FROM people.conv_id
),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, seat ORDER BY k) - length(body) AS spot
  FROM seen
)
SELECT conv_id, seat AS participant, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(spot AS BIGINT) || ':' || CAST(spot + length(body) - 1 AS BIGINT), ',' ORDER BY k) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, part, seat
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, root FROM reach JOIN ways ON ways.a = reach.id AND root < ways.b
),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN comp ON comp.id = d.doc_id
"""

#: Rows that take part, each component scaled to a whole number, under a number ``r`` of their own.
VECTORS = """
SELECT row_number() OVER () AS r, *, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""
PRODUCT = "CAST(coalesce(list_sum(list_transform(range(1, 1 + least(len(a.q), len(b.q))), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT)"

TOP_SQL = f"""
WITH v AS ({VECTORS}),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, {PRODUCT} AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""

HARD_SQL = f"""
WITH v AS (
  SELECT * REPLACE (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label) FROM ({VECTORS}) WHERE label IS NOT NULL
),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS own, {PRODUCT} AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS n FROM s WHERE own) WHERE n <= 5
),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.vec_id NULLS LAST) AS n
  FROM p JOIN s ON p.r = s.r AND NOT s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 5
"""


def _repair_sql() -> str:
    """The cheapest repair by the states of the pattern, turn by turn: cost, audit and text of the best way to each state."""

    def way(state: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letter}, 't': {text}}}"

    def inserted(state: str, role: str) -> str:
        return way(state, "3", "'I'", f"'{role}:'")

    def put(state: str, letter: str, role: str) -> str:
        kept = f"x.i = '{letter}'"
        return way(state, f"CASE WHEN {kept} THEN x.late ELSE 3 + x.late END", f"CASE WHEN {kept} THEN 'K' ELSE 'R' END", f"CASE WHEN {kept} THEN x.role ELSE '{role}' END || ':' || x.text")

    def gone(state: str) -> str:
        return way(state, "4", "'D'", None)

    def let(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def never(value: str) -> str:
        return f"{{'c': CAST({value} AS BIGINT), 'a': '', 't': ''}}"

    asked = f"least(acc.s3, {inserted('acc.s0', 'user')}, {inserted('acc.s1', 'user')}, {inserted('acc.s2', 'user')})"
    answered = f"least(acc.s2, {inserted('c3', 'assistant')})"
    new = (
        f"{{'s0': {gone('acc.s0')},"
        f" 's1': CASE WHEN x.i = 's' THEN least({gone('acc.s1')}, {way('acc.s0', 'x.late', chr(39) + 'K' + chr(39), 'x.role || ' + repr(':') + ' || x.text')}) ELSE {gone('acc.s1')} END,"
        f" 's2': least({gone('c2')}, {put('c3', 'a', 'assistant')}),"
        f" 's3': least({gone('c3')}, {put('acc.s0', 'u', 'user')}, {put('acc.s1', 'u', 'user')}, {put('c2', 'u', 'user')})}}"
    )
    must = "{" + ", ".join(f"'s{k}': {gone(f'acc.s{k}')}" for k in range(4)) + "}"
    step = f"CASE WHEN x.gone THEN {must} ELSE {let(asked, 'c3', let(answered, 'c2', new))} END"
    begin = f"{{'s0': {never('0')}, 's1': {never('1000000000')}, 's2': {never('1000000000')}, 's3': {never('1000000000')}}}"
    closed = f"least(f.s0, f.s2, {inserted('f.s3', 'assistant')}, {let(inserted('f.s1', 'user'), 'y', inserted('y', 'assistant'))})"
    byte = "list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b))"
    codes = "list_transform(string_split(key, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"""
WITH k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
),
h AS (SELECT *, xor(list_reduce({codes}, lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE kind <> 0
),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM d),
e AS (
  SELECT *, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM o
),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'gone': fault IN ('blank', 'duplicate'), 'late': CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'i': i, 'role': role, 'text': text}} ORDER BY n) AS turns
  FROM e GROUP BY conv_id
),
f AS (SELECT *, list_reduce(turns, lambda acc, x: {step}, {begin}) AS f FROM c),
r AS (SELECT *, {closed} AS best FROM f)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id
"""


REPAIR_SQL = _repair_sql()
