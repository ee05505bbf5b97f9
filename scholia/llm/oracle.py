"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE_PHRASES
from .mix_sources import MAX_EPOCHS
from .quality_rules import RULES, STOP_WORDS

_WS = r"[\x20\x09-\x0D]"


def _rules() -> str:
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"{r.metric} >= {r.low}")
        if r.high is not None:
            tests.append(f"{r.metric} <= {r.high}")
    return " AND ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in sorted({x for s in STOP_WORDS.values() for x in s.split()}))

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM pos),
cnt AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM cnt WHERE c >= 2) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length,
             CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0 END AS stop_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
             (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {_rules()}) AS kept FROM r
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 't' || coalesce(text, ''))) AS key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS wt FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY ss * 6 // wt, source NULLS LAST) AS rk FROM s),
p AS (SELECT *, sum(ss) OVER () - coalesce({MAX_EPOCHS} * sum(ss) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(wt) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts FROM o),
c AS (SELECT *, coalesce((SELECT max(q.rk) FROM p q WHERE q.wt * q.lft > {MAX_EPOCHS} * q.ss * q.wts), 0) AS last_capped FROM p),
t AS (SELECT source, ss::BIGINT AS source_size,
             CASE WHEN rk <= last_capped THEN ({MAX_EPOCHS} * ss)::DOUBLE
                  ELSE wt::DOUBLE * (SELECT lft FROM c q WHERE q.rk = c.last_capped + 1)::DOUBLE
                       / (SELECT wts FROM c q WHERE q.rk = c.last_capped + 1)::DOUBLE END AS target FROM c),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(size, greatest(0, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)))::BIGINT AS taken
FROM j
"""

_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = " OR ".join(
    "(" + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(p.split(), 1)) + ")" for p in BASE_PHRASES
)
_LABELS = ", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{label}' END" for p, label in BASE_PHRASES.items())
#: The base columns of op3; the query's labels and score are held against a brute force in tests.
OP3_BASE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '{_CUT}'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM d),
p AS (SELECT doc_id, len(ws)::BIGINT AS n_words, list_filter(range(0, len(ws)), lambda i: coalesce({_HITS}, false)) AS places,
             list_sort(list_filter([{_LABELS}], lambda x: x IS NOT NULL)) AS ls FROM w)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(ls, ',') AS base_labels FROM p
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
tf AS (SELECT rid, w, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY w, n_docs),
m AS (SELECT rid, doc_id, 100 - 75 + (75 * len(ws)::BIGINT * n_docs) // total AS m FROM d, s WHERE len(ws) > 0),
q AS (SELECT item_id, w, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS w FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, rid, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
       FROM q JOIN tf USING (w) JOIN df USING (w) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rk FROM sc WHERE score > 0)
SELECT item_id, rk::INTEGER AS rank, doc_id, score FROM r WHERE rk <= 10
"""


def _coded(*fields: str) -> str:
    parts = [f"coalesce(octet_length(encode({f}::VARCHAR))::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
          lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)),
          4294967295::BIGINT), 4294967295::BIGINT)"""
_UP = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"
OP12 = rf"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_coded("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {_CRC} % 7 = 0
              THEN {_coded("doc_id", "source", "lang", "(n_chars + 1)", "text")} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
tree AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
         UNION ALL SELECT lang, level + 1, {_UP} FROM tree WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top_pos FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY top_pos) AS nodes FROM sub
        UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(nodes) > 1),
steps AS (SELECT rid, level, len(nodes) AS size, pos >> level AS here, nodes FROM p JOIN tree ON p.lang IS NOT DISTINCT FROM tree.lang WHERE len(nodes) > 1
          UNION ALL SELECT rid, height + top.level, len(nodes), top_pos >> top.level, nodes
          FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang, top WHERE len(nodes) > 1),
sib AS (SELECT rid, level, here % 2 = 1 AS is_left, CASE WHEN xor(here, 1) < size THEN nodes[xor(here, 1) + 1] END AS h FROM steps),
proof AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM p LEFT JOIN sib USING (rid) GROUP BY rid),
fold AS (SELECT rid, 0 AS level, coalesce(other, leaf) AS h FROM p
         UNION ALL SELECT f.rid, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.is_left THEN s.h || f.h ELSE f.h || s.h END)
         FROM fold f JOIN sib s ON f.rid = s.rid AND f.level = s.level)
SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, proof_sha256,
       arg_max(fold.h, fold.level) AS folded_root, arg_max(fold.h, fold.level) = (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS verified
FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang JOIN proof USING (rid) JOIN fold USING (rid)
GROUP BY p.rid, doc_id, leaf, subroot, proof_sha256
"""

SQL = {"op8_quality_rules": OP8, "op9_mix_sources": OP9, "op11_ranked_search": OP11, "op12_merkle_manifest": OP12}
