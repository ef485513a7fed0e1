"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .license_rules import BASE, RULES as LICENSE_RULES, SURENESS, on_places
from .license_scan import LOWER_WORD
from .mixing import BITS, LEVELS
from .quality_rules import BASE_FAILED, RULES

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, n, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         max(n) OVER (PARTITION BY norm) AS most
  FROM d
)
SELECT doc_id::BIGINT AS doc_id, keep_id::BIGINT AS keep_id, group_size::BIGINT AS group_size,
       (doc_id IS NOT DISTINCT FROM keep_id AND n = most) AS kept, sha256(norm) AS text_sha256
FROM w
"""


def mixing_sql(documents: str, seed: int = 17) -> str:
    """CTEs ending in ``mixed``: documents with size, source_size, target, copies."""
    assert BITS * LEVELS == 60
    return rf"""
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u,
         ('0x' || substr(sha256('{seed}:' || coalesce(text, '')), 1, 15))::BIGINT AS t
  FROM {documents}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER o AS rank,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / weight, source COLLATE "C" NULLS LAST)
), v AS (SELECT arg_min(level, rank) AS level FROM l WHERE cap >= level * weight
), t AS (
  SELECT source, source_size, least(cap, v.level * weight) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, v.level * weight) / source_size) ELSE 0 END AS whole
  FROM l, v
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.t) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.u, d.t) AS peers
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT doc_id, size, source_size, target,
         least(2, whole + CASE WHEN upto <= rest THEN 1 WHEN upto - peers <= rest AND upto - rest < rest - (upto - peers) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM r
)"""


OP2 = f"""
WITH {mixing_sql("documents")}
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target, (size * copies)::BIGINT AS taken FROM mixed
"""

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w ELSE w[i:i + 1] END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (SELECT doc_id, n, shingle_id FROM (SELECT doc_id, dense_rank() OVER (ORDER BY shingle) AS shingle_id FROM s) JOIN n USING (doc_id)
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.shingle_id = b.shingle_id AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

_RULES = " AND ".join(f"coalesce({r.sql}, FALSE)" for r in RULES)

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), p AS (
  SELECT rid, i, w[i:i + 7] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), q AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM p) WHERE k > 1
), rep AS (
  SELECT rid, sum(least(8, coalesce(step, 8)))::BIGINT AS n FROM (SELECT rid, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS step FROM q) GROUP BY rid
), c AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
          - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
       (NOT ({BASE_FAILED}) AND {_RULES}) AS kept
FROM c
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""

#: Per part the sums of 32 masks, and the orders as all arrangements of the letters.
OP11 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), m AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END) AS mask
  FROM t
), g AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM m GROUP BY part, mask
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS own
), o(filter_order, used) AS (
  SELECT '', 0 UNION ALL SELECT filter_order || letter, used | own FROM o, f WHERE used & own = 0
), s AS (
  SELECT o.filter_order, b.used AS before, f.letter, f.own, length(b.filter_order) + 1 AS step
  FROM o JOIN o b ON length(o.filter_order) = 5 AND length(b.filter_order) < 5 AND starts_with(o.filter_order, b.filter_order) JOIN f ON f.letter = o.filter_order[length(b.filter_order) + 1]
), r AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""

_CLASSES = range(1, len(SURENESS) + 1)


def _placed_rules(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: All rules on all texts, without gates; containment by running extremes of each class.
OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LOWER_WORD}') AS w FROM documents
), p AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, array_to_string(list_transform(w, lambda x, i: ' ' || x || '#' || (i - 1)::VARCHAR), '') AS placed FROM d
), b AS (
  SELECT rid, label, regexp_extract(m, '#([0-9]+)', 1)::BIGINT AS place
  FROM (SELECT rid, label, unnest(regexp_extract_all(placed, pattern)) AS m FROM p, (VALUES {_placed_rules([(v, on_places(k)) for k, v in BASE.items()])}) v(label, pattern))
), bb AS (
  SELECT rid, count(*)::BIGINT AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base_labels FROM b GROUP BY rid
), s AS (
  SELECT rid, rank, label, regexp_extract(m, '#([0-9]+)', 1)::INT AS s, regexp_extract(m, '#([0-9]+)$', 1)::INT AS e
  FROM (SELECT rid, rank, label, unnest(regexp_extract_all(placed, pattern)) AS m FROM p, (VALUES {_placed_rules([(r.rank, r.label, on_places(r.pattern)) for r in LICENSE_RULES])}) v(rank, label, pattern))
), o AS (
  SELECT *, {", ".join(f"max(CASE WHEN rank = {c} THEN e END) OVER before AS most{c}, min(CASE WHEN rank = {c} THEN e END) OVER later AS least{c}" for c in _CLASSES)}
  FROM s WINDOW before AS (PARTITION BY rid ORDER BY s, e DESC, rank, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                later AS (PARTITION BY rid ORDER BY s, e DESC, rank, label ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), k AS (
  SELECT rid, min(rank) AS rank, list(DISTINCT label) AS own FROM o
  WHERE NOT ({" OR ".join(f"(rank >= {c} AND coalesce(most{c}, -1) >= e) OR (rank > {c} AND coalesce(least{c}, 2147483647) <= e)" for c in _CLASSES)})
  GROUP BY rid
)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(own, [])))), ','), '') AS labels,
       coalesce([{", ".join(map(str, SURENESS))}][rank], 0)::DOUBLE AS score
FROM p LEFT JOIN bb USING (rid) LEFT JOIN k USING (rid)
"""


def _crc_steps(k: int) -> int:
    """Four bits of the reflected CRC-32."""
    for _ in range(4):
        k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
    return k


#: CRC-32 by half bytes, low one first; near words by leaving out one letter of either.
OP13 = rf"""
WITH RECURSIVE d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), g AS (SELECT id, run, count(*) AS k FROM d WHERE length(run) >= 6 GROUP BY id, run
), x AS (SELECT run, k, hex(encode(id || ':' || run)) AS x FROM g
), b AS (
  SELECT run, k, list_transform(range(0, len(x)::BIGINT), lambda i: instr('0123456789ABCDEF', x[2 * (i // 2) + 2 - i % 2]) - 1) AS halves FROM x
), h AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, halves), lambda c, v: xor(c >> 4, [{", ".join(str(_crc_steps(k)) for k in range(16))}][(xor(c, v) & 15) + 1]))) AS h FROM b
), t AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h
), w AS (SELECT word, sum(k)::BIGINT AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), o AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT o.word, w.word AS near, w.n FROM o JOIN w ON o.rest = w.word UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.rest = w.word
  UNION SELECT a.word, b.word, b.n FROM o a JOIN o b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
), q AS (SELECT word, count(*)::BIGINT AS n_near, first(near ORDER BY n DESC, near) AS best, max(n) AS best_n FROM p GROUP BY word
), f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM w LEFT JOIN q USING (word)
), r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word JOIN f e ON r.at = e.word AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op2_mixing": OP2, "op3_minhash": OP3, "op5_quality_rules": OP5, "op6_line_dedup": OP6, "op11_filter_audit": OP11, "op12_license_scans": OP12, "op13_spelling_variants": OP13}
