"""DuckDB SQL that gives the rows of the text queries which SQL can express."""

from __future__ import annotations

from .decontaminate import WINDOW as ITEM_WINDOW
from .lines import MIN_SITES
from .quality import MAX_GRAM_CHARS, MAX_LINE_CHARS
from .substrings import WINDOW
from .vectorcodes import ENTRIES, PARTS, ROUNDS, SCALE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOWER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _gram_chars(n: int) -> str:
    return f"""
    g{n} AS (SELECT d, pos, size, count(*) OVER (PARTITION BY d, g) > 1 AND g IS NOT NULL AS dup FROM (SELECT d, pos, length(words[pos]) AS size, CASE WHEN pos + {n - 1} <= len(words) THEN array_to_string(words[pos:pos + {n - 1}], ' ') END AS g FROM u)),
    c{n} AS (SELECT d, sum(size) FILTER (hit) AS chars, count(*) FILTER (hit) AS words FROM (SELECT d, size, bool_or(dup) OVER (PARTITION BY d ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM g{n}) GROUP BY d)"""


_GRAMS = ",".join(map(_gram_chars, MAX_GRAM_CHARS))
_GRAM_COLS = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in MAX_GRAM_CHARS)
_GRAM_JOINS = " ".join(f"LEFT JOIN c{n} ON c{n}.d = t.d" for n in MAX_GRAM_CHARS)
_GRAM_RULES = " AND ".join(f"100 * dup_{n}gram_chars <= {most} * word_chars" for n, most in MAX_GRAM_CHARS.items())

OP3 = rf"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
u AS (SELECT d, words, unnest(generate_series(1, len(words))) AS pos FROM t),
{_GRAMS},
l AS (SELECT d, count(*) AS n, sum(chars) AS chars FROM (
  SELECT d, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY d, line) AS k
  FROM (SELECT d, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY d),
m AS (SELECT doc_id, len(t.words)::BIGINT AS n_words, length(array_to_string(t.words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
  coalesce(c5.words, 0)::BIGINT AS n_repeat_words, coalesce(l.chars, 0)::BIGINT AS dup_line_chars, {_GRAM_COLS}
  FROM t LEFT JOIN l ON l.d = t.d {_GRAM_JOINS})
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * dup_line_chars <= {MAX_LINE_CHARS} * word_chars AND {_GRAM_RULES} AS kept FROM m"""

OP4 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
root AS (SELECT a, least(a, min(b)) AS r FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root.r, t.doc_id) AS component_id, coalesce(root.r, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN root ON root.a = t.doc_id"""

OP6 = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, {ALNUM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {ITEM_WINDOW}) AS n, array_to_string(w[p:p + {ITEM_WINDOW - 1}], ' ') AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {ITEM_WINDOW - 1}))) AS p FROM i WHERE len(w) > 0)),
t AS (SELECT row_number() OVER () AS d, doc_id, {ALNUM_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
u AS (SELECT d, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT d, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM t JOIN sizes ON n <= len(w))),
hit AS (SELECT d, p, u.n, item FROM u JOIN win ON win.g = u.g AND win.n = u.n),
words AS (SELECT d, count(DISTINCT x) AS n FROM (SELECT d, unnest(generate_series(p, p + n - 1)) AS x FROM hit) GROUP BY d),
items AS (SELECT d, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT d, item FROM hit) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM t LEFT JOIN words ON words.d = t.d LEFT JOIN items ON items.d = t.d"""

OP8 = rf"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, {WORDS} AS w FROM documents),
u AS (SELECT d, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g FROM (SELECT d, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS p FROM t WHERE len(w) >= {WINDOW})),
dup AS (SELECT d, p FROM (SELECT d, p, count(*) OVER (PARTITION BY g) AS c FROM u) WHERE c > 1),
gone AS (SELECT DISTINCT d, unnest(generate_series(p, p + {WINDOW - 1})) AS p FROM dup),
n AS (SELECT d, count(*) AS n FROM gone GROUP BY d),
e AS (SELECT d, w, unnest(generate_series(1, len(w))) AS p FROM t),
k AS (SELECT e.d, string_agg(e.w[e.p], ' ' ORDER BY e.p) AS s FROM e LEFT JOIN gone ON gone.d = e.d AND gone.p = e.p WHERE gone.p IS NULL GROUP BY e.d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM t LEFT JOIN n ON n.d = t.d LEFT JOIN k ON k.d = t.d"""

OP10 = rf"""
WITH t AS (SELECT row_number() OVER () AS d, * FROM documents),
l AS (SELECT d, doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS p FROM t WHERE text IS NOT NULL),
x AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
b AS (SELECT line, min(struct_pack(i := doc_id, p := p)) AS first FROM x WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
f AS (SELECT x.d, x.p, x.raw, b.line IS NOT NULL AND NOT (x.doc_id = b.first.i AND x.p = b.first.p) AS gone FROM x LEFT JOIN b ON b.line = x.line),
g AS (SELECT d, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(raw, chr(10) ORDER BY p) FILTER (NOT gone) AS s FROM f GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN g ON g.d = t.d"""



def _codes_sql() -> str:
    """Six rounds of assignment and mean, unrolled."""
    near = """a{i} AS MATERIALIZED (SELECT r, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
      SELECT r, p.part, e, list_sum(list_transform(range(1, len(w) + 1), lambda k: (w[k] - cw[k]) * (w[k] - cw[k])))::BIGINT AS d FROM p JOIN c{i} c ON c.part = p.part) GROUP BY r, part)"""
    mean = """s{j} AS (SELECT part, e, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, e, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM a{i} a JOIN p ON p.r = a.r AND p.part = a.part) GROUP BY ALL),
    m{j} AS (SELECT part, e, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY k) AS cw FROM s{j} GROUP BY part, e),
    c{j} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.cw, c.cw) AS cw FROM c{i} c LEFT JOIN m{j} m ON m.part = c.part AND m.e = c.e)"""
    rounds = ",".join(near.format(i=i) + "," + mean.format(i=i, j=i + 1) for i in range(ROUNDS)) + "," + near.format(i=ROUNDS)
    return f"""
WITH q AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS w FROM q, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, w AS cw FROM p WHERE r <= {ENTRIES}), {rounds},
b AS (SELECT sha256(string_agg(array_to_string(cw, ','), ',' ORDER BY part, e)) AS h FROM c{ROUNDS}),
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN q ON q.r = f.r, b"""


OP12 = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
  100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text), regexp_matches(t.text, '[#$%&*|]'), coalesce(t.doc_id > first, false)] AS f
  FROM t JOIN e ON e.text = t.text LEFT JOIN l ON l.doc_id = t.doc_id),
g AS (SELECT part, f, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, 15 - a.i - b.i - c.i - d.i] AS p FROM x a, x b, x c, x d WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
s AS (SELECT array_to_string(list_transform(p, lambda k: substr('ABCDE', k::INT, 1)), '') AS filter_order, p, i AS step FROM o, x),
u AS (SELECT part, filter_order, step, p[step] AS own, f[p[step]] AS fails, len(list_filter(p[1:step - 1], lambda k: f[k])) AS before, len(list_filter(f, lambda y: y)) AS n_fails, n, good, toxic FROM g, s),
v AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (before = 0 AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (before = 0 AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (before > 0 AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (before = 0 AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (before = 0 AND fails AND toxic), 0)::BIGINT AS toxic_lost FROM u GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM v"""

ORACLES = {"op3_quality_rules": OP3, "op4_near_dedup": OP4, "op6_decontaminate": OP6, "op8_substring_dedup": OP8, "op10_line_dedup": OP10, "op11_vector_codes": _codes_sql(), "op12_filter_audit": OP12}
