"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in ``tests/llm``.

Parameters come from the operators, the way to the result does not.
"""

from __future__ import annotations

from pulsegate.llm import license_match, mixing, phrases, quality, secret_ledger
from pulsegate.llm.chat_format import ASSISTANT, CONTROL_TEXT
from pulsegate.llm.common import WORD
from pulsegate.llm.decontaminate import _SQL_WORD, SIZE


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _shapes() -> str:
    rows = [f"({i}, {w}::DOUBLE, {a * w}::DOUBLE, {b * w}::DOUBLE)" for i, (w, (a, b)) in enumerate(zip(mixing.WEIGHT_CYCLE, mixing.SHAPES))]
    return ", ".join(rows)


OP1 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_text(WORD)})), 0)::BIGINT AS size,
         coalesce(md5(text), '') AS content
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHT_CYCLE)} AS turn FROM s),
w AS (SELECT n.*, v.w, v.p, v.q FROM n JOIN (VALUES {_shapes()}) v(turn, w, p, q) USING (turn)),
total AS (SELECT sum(source_size) AS all_words FROM w),
-- Level of a target that is not stopped, tried with every set of sources stopped before.
r AS (
  SELECT w.*, {mixing.MAX_EPOCHS} * source_size AS cap, {mixing.MAX_EPOCHS} * source_size / w AS ratio, all_words
  FROM w, total),
lv AS (
  SELECT a.ratio AS ratio,
         (any_value(a.all_words) - coalesce(sum(b.cap) FILTER (WHERE b.ratio < a.ratio), 0))
         / sum(b.w) FILTER (WHERE b.ratio >= a.ratio) AS level
  FROM (SELECT DISTINCT ratio, all_words FROM r) a, r b GROUP BY a.ratio),
fit AS (SELECT ratio, level FROM lv WHERE level <= ratio ORDER BY ratio LIMIT 1),
t AS (
  SELECT r.*, CASE WHEN r.ratio >= (SELECT ratio FROM fit) THEN w * (SELECT level FROM fit) ELSE cap::DOUBLE END AS target
  FROM r),
o AS (
  SELECT d.*, t.source_size, t.target, t.w, t.p, t.q, round(t.target)::BIGINT AS wanted,
         coalesce(sum(d.size) OVER (PARTITION BY d.source
           ORDER BY md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, d.content)), d.doc_id, d.size, d.content
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, (SELECT coalesce(sum(greatest(0, least(size, wanted - x * source_size - begin))), 0)
             FROM range({mixing.MAX_EPOCHS}) g(x)) AS taken, begin / target * w AS rest
  FROM o)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN
         round(least(CASE WHEN rest > 0 THEN 2 * rest / (p + sqrt(p * p + 2 * (q - p) / 1.0::DOUBLE * rest)) ELSE 0.0::DOUBLE END, 1.0::DOUBLE), 6)
       END AS first_position
FROM k
"""

_SYMBOLS = f"[^{quality.SYMBOLS}]"
OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, {_text(WORD)}) AS words FROM documents),
l AS (
  SELECT r, line, len(regexp_extract_all(line, {_text(WORD)})) AS n,
         length(regexp_replace(line, {_text(_SYMBOLS)}, '', 'g')) AS symbols,
         length(regexp_replace(line, '[^!]', '', 'g')) AS marks,
         len(list_filter(regexp_extract_all(line, {_text(WORD)}), lambda x: x IN ('|', '>', '»', '›', '•', '·', '/', '-'))) AS separators
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)),
v AS (
  SELECT r, sum(n) FILTER (WHERE NOT (
      (n < {quality.SHORT_LINE} AND NOT regexp_matches(line, {_text(quality.TERMINAL)}))
      OR (2 * symbols > n AND symbols >= 3) OR (marks >= 3 AND 2 * marks > n)
      OR (separators >= 3 AND 3 * separators >= n)
      OR (n < {4 * quality.SHORT_LINE} AND regexp_matches(line, {_text('(?i)(' + quality.BOILERPLATE + ')')}))))::BIGINT AS kept_words,
      (count(*) - count(DISTINCT line))::BIGINT AS dup
  FROM l WHERE n > 0 GROUP BY r),
g AS (
  SELECT r, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM d WHERE len(words) >= {quality.WINDOW})),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS rep FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS p FROM h) GROUP BY r),
f AS (
  SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_words,
         coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         coalesce(length(regexp_replace(text, {_text(_SYMBOLS)}, '', 'g')), 0)::BIGINT AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM d LEFT JOIN v USING (r) LEFT JOIN c USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
       AND n_words - kept_words <= {quality.MAX_LOSS} * n_words AS kept
FROM f
"""


def _rule_rows() -> str:
    out = []
    for rank, r in enumerate(secret_ledger.RULES):
        pattern = _text(r.pattern)
        out.append(
            f"SELECT r, {rank} AS rank, '{r.name}' AS kind, text, regexp_extract_all(text, {pattern}, 0) AS m,"
            f" list_transform(regexp_extract_all(text, {pattern}, {r.group}), lambda x: length(x) >= {r.least}) AS fits FROM d"
        )
    return " UNION ALL ".join(out)


OP3 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({_rule_rows()}),
-- The first occurrence of a match at or after the end of the one before is the match itself.
p AS (
  SELECT r, rank, kind, text, m, fits, 0 AS i, 0 AS b, 0 AS e FROM a WHERE list_contains(fits, true)
  UNION ALL
  SELECT r, rank, kind, text, m, fits, i + 1,
         e + instr(substr(text, e + 1), m[i + 1]) - 1, e + instr(substr(text, e + 1), m[i + 1]) - 1 + length(m[i + 1])
  FROM p WHERE i < len(m)),
s AS (SELECT r, rank, kind, b, e FROM p WHERE i > 0 AND fits[i]),
g AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (WHERE rank < {len(secret_ledger.BASE)}) AS base,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

OP5 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS win
  FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
f AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
-- Starts less than or exactly one string apart remove one run of bytes.
g AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT doc_id, run, min(p) AS b, max(p) + 100 AS e FROM g GROUP BY ALL),
t AS (
  SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before,
         row_number() OVER (PARTITION BY doc_id ORDER BY b DESC) = 1 AS last FROM s),
k AS (
  SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (b - before)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY b) AS kept
  FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, {_text(_SQL_WORD)}), []) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_text(_SQL_WORD)}) AS words FROM benchmark WHERE text IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, len(words[i:i + size - 1]) AS size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM (SELECT *, least({SIZE}, len(words)) AS size FROM b WHERE len(words) > 0))),
x AS (
  SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM w) WHERE len(words) >= size)),
h AS (SELECT r, i, x.size, item_id FROM x JOIN w ON x.win = w.win AND x.size = w.size),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""


def _pairs(words: str) -> str:
    """Distinct pairs of neighbouring words, as a DuckDB list."""
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


_NORMAL = r"list_filter(string_split(regexp_replace(lower(part), '[\x00-/:-`{-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
_TEMPLATES = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in license_match.TEMPLATES.items())
_T = license_match.THRESHOLD
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT name, {_pairs('words')} AS known FROM (SELECT name, {_NORMAL} AS words FROM (VALUES {_TEMPLATES}) v(name, part))),
c AS (
  SELECT r, k, part FROM (SELECT r, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)
  UNION ALL SELECT r, 0, text FROM d WHERE contains(text, chr(10))),
b AS (SELECT r, k, {_pairs('words')} AS own FROM (SELECT r, k, {_NORMAL} AS words FROM c)),
s AS (
  SELECT r, k, name, 2.0::DOUBLE * len(list_intersect(own, known)) / (len(own) + len(known)) AS dice
  FROM b JOIN t ON len(own) >= {_T} / (2 - {_T}) * len(known) - 1e-9 AND len(known) >= {_T} / (2 - {_T}) * len(own) - 1e-9),
m AS (SELECT r, name, k, dice FROM s WHERE dice >= {_T}),
g AS (
  SELECT r, count(DISTINCT k)::BIGINT AS n, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice
  FROM m GROUP BY r)
SELECT doc_id, license, round(dice, 6) AS dice, coalesce(n, 0) AS n_matches FROM d LEFT JOIN g USING (r)
"""

_ESCAPED = f"(12 + length(role) + 2 * len(regexp_extract_all(role, '[%|\n]')) + 1 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + 11)"
OP11 = f"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations
  UNION ALL SELECT -1, r, {_text(CONTROL_TEXT)}, k FROM (VALUES ('user', 1), ('assistant', 2)) v(r, k))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = {_text(ASSISTANT)}), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = {_text(ASSISTANT)}), '')) AS loss_sha256,
       sum({_ESCAPED})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def _phrases(length: int) -> str:
    words = ", ".join(["word"] + [f"lead(word, {k}) OVER w AS w{k}" for k in range(1, length)])
    last = f"w{length - 1}" if length > 1 else "word"
    listed = " || ' ' || ".join(["word"] + [f"w{k}" for k in range(1, length)])
    return f"SELECT lang, {length} AS k, {listed} AS phrase, count(*) AS f FROM (SELECT lang, {words} FROM t WINDOW w AS (PARTITION BY r, piece ORDER BY pos)) WHERE {last} IS NOT NULL GROUP BY ALL"


OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT r, lang, unnest(pieces) AS body, generate_subscripts(pieces, 1) AS piece FROM d),
q AS (SELECT r, lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS words FROM p),
t AS (SELECT r, lang, piece, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM q),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f AS ({" UNION ALL ".join(_phrases(k) for k in range(1, phrases.LONGEST + 1))}),
a AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS words FROM f WHERE f >= {phrases.LEAST}),
-- All parts of all longer candidates, with how often the candidate occurs.
i AS (
  SELECT a.lang, array_to_string(a.words[b : b + m - 1], ' ') AS phrase, max(a.f) AS most
  FROM a, range(1, {phrases.LONGEST}) x(b), range(2, {phrases.LONGEST}) y(m)
  WHERE m < a.k AND b + m - 1 <= a.k GROUP BY ALL),
c AS (SELECT a.* FROM a LEFT JOIN i USING (lang, phrase) WHERE a.k > 1 AND (most IS NULL OR 100 * most < 100 * a.f)),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n.n AS n,
         ({phrases.SCALE}::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN range(1, {phrases.LONGEST}) z(j) ON j < c.k
  JOIN n ON n.lang = c.lang
  JOIN a l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:j], ' ')
  JOIN a r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[j + 1 : c.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= {phrases.TOP}
"""

SQL: dict[str, str] = {
    "op1_source_mix": OP1,
    "op2_line_quality": OP2,
    "op3_secret_ledger": OP3,
    "op5_repeated_strings": OP5,
    "op7_decontaminate": OP7,
    "op9_license_match": OP9,
    "op11_chat_format": OP11,
    "op12_phrases": OP12,
}
