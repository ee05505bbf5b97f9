"""DuckDB SQL of the registered queries that SQL can express.

The values that define a result are written out here, apart from the engine's, so that a
wrong one on either side shows.
"""

from __future__ import annotations

_HASH = "sha256(text)"
_TOPICS = (
    "topics AS (SELECT item_id AS ord, text AS name FROM benchmark)"
)
_CHUNKS = (
    "chunks AS (SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS id, conv_id::VARCHAR AS document_id, text AS content FROM conversations)"
)
_DOCUMENT_CHUNKS = "chunks AS (SELECT doc_id::VARCHAR || '/0' AS id, doc_id::VARCHAR AS document_id, text AS content FROM documents)"
_KEYWORD = (
    "kw0 AS (SELECT ord, name, list_distinct(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda w: length(w) > 3)) AS ws FROM topics), "
    "kw AS (SELECT ord, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [lower(name)] END) AS k FROM kw0), "
    "byword AS (SELECT DISTINCT ord, id FROM kw JOIN chunks ON contains(lower(content), k))"
)
_KEYS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3))"
_ENTRY = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) >= 2))"
_WORDS3 = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: length(w) > 3))"
_SUFFIX = (
    "WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'doc' THEN 'docx' WHEN 'pptx' THEN 'pptx' WHEN 'ppt' THEN 'pptx' WHEN 'txt' THEN 'txt' "
    "WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' "
    "WHEN 'gif' THEN 'image' WHEN 'bmp' THEN 'image' WHEN 'tiff' THEN 'image' WHEN 'tif' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'svg' THEN 'image'"
)
_NAMED = (
    "contains(stem, 'syllabus') OR contains(stem, 'programma') OR contains(stem, 'program') OR contains(stem, 'course outline') "
    "OR contains(stem, 'piano di studi')"
)
_GARBAGE = (
    r"regexp_matches(html, '(?i)\bstartxref\b')::INT + contains(upper(html), '%%EOF')::INT + regexp_matches(html, '(?i)\b\d+\s+\d+\s+obj\b')::INT "
    r"+ regexp_matches(html, '(?i)\bendobj\b')::INT + regexp_matches(html, '(?i)\bstream\b')::INT + regexp_matches(html, '(?i)\bendstream\b')::INT "
    r"+ regexp_matches(html, '(?i)\bxref\b')::INT + regexp_matches(html, '(?i)\btrailer\b')::INT + regexp_matches(html, '(?i)/Type\s*/\w+')::INT"
)
_ENGLISH = (
    "'the','is','at','which','on','a','an','and','or','but','in','with','to','for','of','not','no','can','had','has','have','are','was','were','be',"
    "'been','will','would','could','should','may','might','this','that','these','those','it','its','from','by','as','if','than','then','so','do','did',"
    "'does','each','when','where','how','what','who','whom','there','their','they','them','we','our','he','she','his','her','my','your','all','any',"
    "'both','few','more','most','other','some','such','only','own','same','too','very','just','because','about','between','through','during','before',"
    "'after','above','below','up','down','out','off','over','under','again','further','here','once','also','into','using','used','use','based','see',"
    "'example','note','figure','table','chapter','section','page','many','areas','concept','concepts','important','material','described','called',"
    "'known','considered','particular','general','specific','different','given','well','two','three','first','second','new','one','like','even',"
    "'still','however','while','since','until','although','though','whether','without','within','along','across','behind','beneath','beside','beyond',"
    "'toward','upon','among','around','towards','including','related','form'"
)
_PDF_LINE = " OR ".join(f"regexp_matches(x, '{p}')" for p in (
    r"(?i)startxref", r"%%EOF", r"\d+\s+\d+\s+obj\b", r"\bendobj\b", r"(?i)^stream$", r"(?i)^endstream$", r"(?i)^xref$", r"(?i)\btrailer\b",
    r"<<\s*/Type\s*/\w+", r"/Subtype\s*/\w+", r"/Filter\s*/\w+", r"/Width\s+\d+", r"/Height\s+\d+", r"/Length\s+\d+", r"/Root\s+\d+\s+\d+\s+R",
    r"/Info\s+\d+\s+\d+\s+R", r"/Type\s*/Page\b", r"/Type\s*/Catalog\b", r"/Type\s*/Font\b", r"/Type\s*/XObject\b", r"^\d+\s+\d+\s+\w+$"))
_CLEAN = (
    "regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, "
    "'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[^\\S\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), "
    "lambda x: x = '' OR NOT (" + _PDF_LINE.replace("{", "{{").replace("}", "}}") + ")), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
)
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
_NTOPICS = (
    "t AS (SELECT n_nationkey AS ord, n_name AS name, 'About ' || n_name AS description, n_regionkey, n_nationkey % 4 AS subtopic_count, "
    "CASE WHEN n_nationkey % 3 > 0 THEN 100 - n_nationkey END AS syllabus_position, n_nationkey % 5 = 0 AS missing_from_notes, "
    "n_nationkey % 7 = 0 AS extra_in_notes FROM nation)"
)
_STATE = (
    "s AS (SELECT sha256(text) AS content_hash, source || '/' || (doc_id % 50) AS source_path, CASE WHEN doc_id % 4 > 0 THEN lang END AS model, "
    "CASE WHEN doc_id % 3 > 0 THEN doc_id::VARCHAR END AS topics_json, doc_id AS updated_at FROM documents)"
)
_EXISTING = (
    "e AS (SELECT DISTINCT o_custkey::INT - 1 AS idx FROM orders WHERE o_orderkey % 5 NOT IN (0, 1) AND o_custkey BETWEEN 1 AND 100)"
)

SQL = {
    "dedup_exact": f"""
        SELECT doc_id, source, lang, content_hash, first_ord, n_copies FROM (
          SELECT doc_id, source, lang, {_HASH} AS content_hash, min(doc_id) OVER p AS first_ord, count(*) OVER p AS n_copies,
                 row_number() OVER (PARTITION BY {_HASH} ORDER BY length(text) DESC, length(source) DESC, doc_id) AS n
          FROM documents WINDOW p AS (PARTITION BY {_HASH})) WHERE n = 1""",
    "dedup_by_language": f"""
        SELECT lang, count(*) AS n_kept, sum(c - 1)::BIGINT AS n_removed FROM (
          SELECT lang, count(*) OVER (PARTITION BY {_HASH}) AS c,
                 row_number() OVER (PARTITION BY {_HASH} ORDER BY length(text) DESC, length(source) DESC, doc_id) AS n FROM documents)
        WHERE n = 1 GROUP BY lang""",
    "dedup_near_pairs_bound": """
        SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.doc_id < b.doc_id
        WHERE 2 * least(length(a.text), length(b.text)) >= 0.92::DOUBLE * (length(a.text) + length(b.text))""",
    "pdf_garbage_flag": f"SELECT page_id, ({_GARBAGE}) >= 3 AS garbage FROM pages",
    "doc_type_syllabus": f"""
        WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
        q AS (SELECT page_id, regexp_extract(lower(u), '\\.([^./]+)$', 1) AS suffix,
                     lower(regexp_replace(regexp_extract(u, '([^/]*)/?$', 1), '(.)\\.[^.]*$', '\\1')) AS stem FROM p)
        SELECT page_id, CASE suffix {_SUFFIX} ELSE 'unknown' END AS file_type, ({_NAMED}) AS is_syllabus FROM q""",
    "paragraphs_sentences": r"""
        SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n{2,}'), lambda x: trim(x, E' \t\n\r') <> ''))::BIGINT AS n_paragraphs,
               len(list_filter(string_split(regexp_replace(text, '([.!?…])[\s]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r') <> ''))::BIGINT AS n_sentences
        FROM documents""",
    "keyword_chunks": f"WITH {_TOPICS}, {_CHUNKS}, {_KEYWORD} SELECT ord, id FROM byword",
    "tiered_chunks": f"""
        WITH {_TOPICS}, {_CHUNKS}, {_KEYWORD},
        t AS (SELECT ord, id, 1 AS tier FROM topics JOIN chunks ON ord % 3 = 0 AND id = ord::VARCHAR || '/0'
              UNION SELECT ord, id, 2 FROM topics JOIN chunks ON ord % 3 = 1 AND document_id = ord::VARCHAR
              UNION SELECT ord, id, 3 FROM byword)
        SELECT ord, id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY ord) AS first FROM t) WHERE tier = first""",
    "tiered_chunks_documents": f"""
        WITH {_TOPICS}, {_DOCUMENT_CHUNKS}, {_KEYWORD},
        t AS (SELECT ord, id, 1 AS tier FROM topics JOIN chunks ON ord % 3 = 0 AND id = ord::VARCHAR || '/0'
              UNION SELECT ord, id, 2 FROM topics JOIN chunks ON ord % 3 = 1 AND document_id = ord::VARCHAR
              UNION SELECT ord, id, 3 FROM byword)
        SELECT ord, id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY ord) AS first FROM t) WHERE tier = first""",
    "keyword_chunks_documents": f"WITH {_TOPICS}, {_DOCUMENT_CHUNKS}, {_KEYWORD} SELECT ord, id FROM byword",
    "best_match_entry": f"""
        WITH t AS (SELECT n_nationkey::BIGINT AS ord, n_name || ' region' AS a FROM nation),
        e AS (SELECT r_regionkey::BIGINT AS idx, 'region ' || r_name AS b FROM region),
        w AS (SELECT *, CASE WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) ELSE 0 END AS held,
              len(list_intersect({_ENTRY.format('a')}, {_ENTRY.format('b')}))::DOUBLE / greatest(len({_ENTRY.format('a')}), len({_ENTRY.format('b')})) AS shared FROM t, e),
        -- Entries are seen in turn: an equal name ends it, holding counts where it exceeds the best so far, else shared words do.
        f AS (SELECT ord, list_reduce(list({{'idx': idx, 'same': lower(a) = lower(b), 'held': held, 'shared': shared, 'score': 0.0::DOUBLE}} ORDER BY idx),
              lambda s, x: CASE WHEN s.score = 2 THEN s WHEN x.same THEN {{'idx': x.idx, 'same': true, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': 2.0::DOUBLE}}
                WHEN x.held > s.score THEN {{'idx': x.idx, 'same': false, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': x.held}}
                WHEN x.shared > s.score THEN {{'idx': x.idx, 'same': false, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': x.shared}} ELSE s END,
              {{'idx': -1::BIGINT, 'same': false, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': 0.0::DOUBLE}}) AS r FROM w GROUP BY ord)
        SELECT ord, r.idx AS idx, r.score AS score FROM f WHERE r.score >= 0.2""",
    "entry_match_in_turn": f"""
        WITH k AS (SELECT p_name AS n, lower(p_type) AS kind, min(p_partkey) AS key FROM part GROUP BY p_name, p_type),
        t AS (SELECT key AS ord, n || ' ' || kind AS a FROM k),
        e AS (SELECT key AS idx, CASE key % 4 WHEN 0 THEN kind || ' ' || n WHEN 1 THEN string_split(n, ' ')[1] WHEN 2 THEN n || ' ' || kind || ' basics' ELSE string_split(n, ' ')[-1] || '-' || kind END AS b FROM k),
        w AS (SELECT *, CASE WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) ELSE 0 END AS held,
              len(list_intersect({_ENTRY.format('a')}, {_ENTRY.format('b')}))::DOUBLE / greatest(len({_ENTRY.format('a')}), len({_ENTRY.format('b')})) AS shared FROM t, e),
        -- Entries are seen in turn: an equal name ends it, holding counts where it exceeds the best so far, else shared words do.
        f AS (SELECT ord, list_reduce(list({{'idx': idx, 'same': lower(a) = lower(b), 'held': held, 'shared': shared, 'score': 0.0::DOUBLE}} ORDER BY idx),
              lambda s, x: CASE WHEN s.score = 2 THEN s WHEN x.same THEN {{'idx': x.idx, 'same': true, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': 2.0::DOUBLE}}
                WHEN x.held > s.score THEN {{'idx': x.idx, 'same': false, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': x.held}}
                WHEN x.shared > s.score THEN {{'idx': x.idx, 'same': false, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': x.shared}} ELSE s END,
              {{'idx': -1::BIGINT, 'same': false, 'held': 0.0::DOUBLE, 'shared': 0.0::DOUBLE, 'score': 0.0::DOUBLE}}) AS r FROM w GROUP BY ord)
        SELECT ord, r.idx AS idx, r.score AS score FROM f WHERE r.score >= 0.2""",
    "prompt_material": r"""
        WITH d AS (SELECT source, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
        s AS (SELECT *, '--- Source ' || k || ' ---' AS head FROM d WHERE length(body) >= 20),
        -- 20000 characters at depth 3: 1.66 times as many.
        r AS (SELECT *, 33200 - sum(length(head) + length(body)) OVER (PARTITION BY source ORDER BY doc_id) + length(head) + length(body) AS room FROM s),
        p AS (SELECT source, doc_id, head || chr(10) || CASE WHEN room >= length(head) + length(body) THEN body WHEN room > 200 THEN body[:room - 20] || chr(10) || '...[truncated]' END AS part FROM r WHERE room >= 0)
        SELECT source, doc_id, length(part)::BIGINT AS n_chars, md5(part) AS part_md5 FROM p WHERE part IS NOT NULL""",
    "chunks": r"""
        WITH c AS (SELECT doc_id, source, """ + _CLEAN.format("text") + r""" AS c FROM documents),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY length(source) DESC, doc_id) AS k FROM c WHERE c <> '') WHERE k = 1),
        s AS (SELECT doc_id, CASE WHEN length(c) // 4 <= 1024 THEN [c] ELSE list_filter(string_split(regexp_replace(c, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') END AS ss FROM u),
        -- A sentence over 1024 tokens is packed by words, whose last ones within 64 tokens are handed on, unless that is all.
        x AS (SELECT doc_id, list_transform(ss, lambda x: {'n': length(x)::BIGINT, 'held': []::BIGINT[], 'done': []::BIGINT[], 'words': CASE WHEN length(x) // 4 > 1024
              THEN list_transform(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''), lambda y: length(y)::BIGINT) ELSE []::BIGINT[] END}) AS es FROM s),
        y AS (SELECT doc_id, list_transform(es, lambda e: {'n': e.n, 'held': e.held, 'done': e.done, 'parts': list_reduce(
                list_transform(e.words, lambda m: {'m': m, 'held': []::BIGINT[], 'total': 0::BIGINT, 'done': []::BIGINT[]}),
                lambda a, w: CASE WHEN len(a.held) > 0 AND a.total + greatest(1, (w.m + 1) // 4) > 1024
                  THEN {'m': 0::BIGINT, 'held': list_append(list_filter(a.held, lambda h, i: i > 1 AND list_sum(list_transform(a.held[i:], lambda g: greatest(1, (g + 1) // 4))) <= 64), w.m),
                        'total': greatest(1, (coalesce(list_sum(list_filter(a.held, lambda h, i: i > 1 AND list_sum(list_transform(a.held[i:], lambda g: greatest(1, (g + 1) // 4))) <= 64)), 0)
                                 + len(list_filter(a.held, lambda h, i: i > 1 AND list_sum(list_transform(a.held[i:], lambda g: greatest(1, (g + 1) // 4))) <= 64))) // 4)::BIGINT + greatest(1, (w.m + 1) // 4),
                        'done': list_append(a.done, list_sum(a.held)::BIGINT + len(a.held) - 1)}
                  ELSE {'m': 0::BIGINT, 'held': list_append(a.held, w.m), 'total': a.total + greatest(1, (w.m + 1) // 4), 'done': a.done} END,
                {'m': 0::BIGINT, 'held': []::BIGINT[], 'total': 0::BIGINT, 'done': []::BIGINT[]})}) AS es FROM x),
        z AS (SELECT doc_id, list_transform(es, lambda e: {'n': e.n, 'held': e.held, 'done': e.done,
              'parts': CASE WHEN len(e.parts.held) > 0 THEN list_append(e.parts.done, list_sum(e.parts.held)::BIGINT + len(e.parts.held) - 1) ELSE []::BIGINT[] END}) AS es FROM y),
        -- Sentences are packed while they fit in 1024 tokens; a full chunk hands on its last ones within 64, unless that is all of it.
        f AS (SELECT doc_id, list_reduce(es,
              lambda a, x: CASE WHEN len(x.parts) > 0
                THEN {'n': 0::BIGINT, 'held': []::BIGINT[], 'done': list_concat(CASE WHEN len(a.held) > 0 THEN list_append(a.done, list_sum(a.held)::BIGINT + 2 * (len(a.held) - 1)) ELSE a.done END, x.parts), 'parts': []::BIGINT[]}
                WHEN len(a.held) > 0 AND list_sum(list_transform(a.held, lambda h: greatest(1, h // 4))) + greatest(1, x.n // 4) > 1024
                THEN {'n': 0::BIGINT, 'held': list_append(list_filter(a.held, lambda h, i: i > 1 AND list_sum(list_transform(a.held[i:], lambda g: greatest(1, g // 4))) <= 64
                        AND list_sum(list_transform(a.held, lambda g: greatest(1, g // 4))) > 64), x.n),
                      'done': list_append(a.done, list_sum(a.held)::BIGINT + 2 * (len(a.held) - 1)), 'parts': []::BIGINT[]}
                ELSE {'n': 0::BIGINT, 'held': list_append(a.held, x.n), 'done': a.done, 'parts': []::BIGINT[]} END,
              {'n': 0::BIGINT, 'held': []::BIGINT[], 'done': []::BIGINT[], 'parts': []::BIGINT[]}) AS r FROM z),
        p AS (SELECT doc_id, CASE WHEN len(r.held) > 0 THEN list_append(r.done, list_sum(r.held)::BIGINT + 2 * (len(r.held) - 1)) ELSE r.done END AS sizes FROM f)
        SELECT doc_id::VARCHAR AS document_id, len(sizes)::BIGINT AS n_chunks, list_sum(list_transform(sizes, lambda x: greatest(1, x // 4)))::BIGINT AS n_tokens FROM p""",
    "chapter_topic_overlap": f"""
        WITH t AS (SELECT min(p_partkey) AS ord, {_WORDS3.format('p_type')} AS wt FROM part GROUP BY p_type),
        c AS (SELECT min(p_partkey) AS idx, {_WORDS3.format('p_name')} AS wc FROM part GROUP BY p_name),
        s AS (SELECT idx, ord, len(list_intersect(wc, wt))::BIGINT AS common, len(wt) AS n FROM c, t)
        SELECT idx, ord, common FROM s WHERE common >= 2 OR (common >= 1 AND n <= 3)""",
    "image_rank_topk": f"""
        WITH {_TOPICS},
        w AS (SELECT ord, unnest({_KEYS.format('name')}) AS w FROM topics),
        i AS (SELECT page_id AS id, unnest({_KEYS.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS w FROM pages),
        s AS (SELECT ord, id, count(*) AS score FROM w JOIN i USING (w) GROUP BY ord, id)
        SELECT ord, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""",
    "first_wins_distinct": """
        SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text, ' ')) ORDER BY conv_id * 10000 + turn) AS n FROM conversations) WHERE n = 1""",
    "anchors_unique": r"""
        WITH a AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part),
        n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM a)
        SELECT p_partkey, CASE WHEN k = 1 THEN s ELSE s || '-' || k END AS anchor FROM n""",
    "language_ratio": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents)
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN -1 ELSE len(list_filter(ws, lambda x: x IN ({_ENGLISH})))::DOUBLE / len(ws) END AS ratio FROM w""",
    "sentence_overlap_dups": """
        WITH s AS (SELECT doc_id AS k, list_distinct(regexp_extract_all(text, '[A-Z][^.!?]*[.!?]')) AS ss FROM documents),
        r AS (SELECT k, len(ss) AS n, unnest(ss) AS t FROM s),
        p AS (SELECT x.k AS a, y.k AS b, count(*) AS n_shared, min(x.n) AS na, min(y.n) AS nb FROM r x JOIN r y ON x.t = y.t AND x.k < y.k GROUP BY 1, 2)
        SELECT a, b, n_shared, n_shared::DOUBLE / least(na, nb) AS share FROM p WHERE n_shared::DOUBLE / least(na, nb) >= 0.8""",
    "split_sections": r"""
        WITH m AS (SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id),
        l AS (SELECT conv_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos FROM m),
        h AS (SELECT *, regexp_matches(line, '^#{2,3}\s+\S') AS head FROM l),
        s AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS section FROM h)
        SELECT conv_id, section::BIGINT AS section, max(CASE WHEN head THEN trim(regexp_replace(line, '^#{2,3}\s+', ''), E' \t\n\r') END) AS title,
               length(trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), ''), E' \t\n\r'))::BIGINT AS n_body
        FROM s WHERE section > 0 GROUP BY conv_id, section""",
    "order_violations": """
        SELECT o_custkey, o_orderkey, placed, previous FROM (
          SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT AS placed,
                 lag(epoch(o_orderdate)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)
        WHERE placed < previous""",
    "budget_prefix": """
        WITH r AS (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents),
        t AS (SELECT source, doc_id, running, running - n AS before, CASE WHEN running <= 20000 THEN n
                WHEN running - n <= 20000 AND 20000 - (running - n) > 200 THEN 20000 - (running - n) - 20 ELSE 0 END AS taken FROM r)
        SELECT source, doc_id, running::BIGINT AS running, taken::BIGINT AS taken FROM t WHERE taken > 0 AND before <= 20000""",
    "validation_rollup": """
        WITH s AS (SELECT CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'warning' ELSE 'pass' END AS s FROM labels)
        SELECT CASE WHEN bool_or(s = 'fail') THEN 'fail' WHEN bool_or(s = 'warning') THEN 'warning' ELSE 'pass' END AS overall, count(*) AS n_checks,
               count(*) FILTER (s = 'fail') AS n_fail, count(*) FILTER (s = 'warning') AS n_warning, count(*) FILTER (s = 'pass') AS n_pass FROM s""",
    "incremental_state": """
        SELECT doc_id::VARCHAR AS source_path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM documents""",
    "cache_probe": """
        WITH t AS (SELECT conv_id, turn, sha256(role || chr(10) || text) AS key, length(text)::VARCHAR AS n FROM conversations),
        c AS (SELECT DISTINCT key, n AS response FROM t WHERE turn % 2 = 0)
        SELECT conv_id, turn, key, response FROM t LEFT JOIN c USING (key)""",
    "cache_misses": """
        WITH t AS (SELECT role, turn, sha256(role || chr(10) || text) AS key FROM conversations)
        SELECT role AS model, count(*) AS n_misses FROM t WHERE key NOT IN (SELECT key FROM t WHERE turn % 2 = 0) GROUP BY role""",
    "upsert_latest": """
        SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS updated_at, min(event_id) AS created_at FROM events GROUP BY user_id""",
    "latest_hashes": f"SELECT source AS source_path, arg_max({_HASH}, doc_id) AS content_hash FROM documents GROUP BY source",
    "toc_render": r"""
        WITH n AS (SELECT n_regionkey, n_nationkey, n_nationkey % 2 + 1 AS level, n_name,
                          regexp_replace(regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM nation)
        SELECT n_regionkey, string_agg(repeat('  ', level - 1) || '- [' || n_name || '](#' || s || ')', chr(10) ORDER BY n_nationkey) AS toc FROM n GROUP BY n_regionkey""",
    "sources_block": """
        WITH f AS (SELECT o_custkey AS id, min(o_orderkey) AS first FROM orders GROUP BY o_custkey),
        j AS (SELECT row_number() OVER (ORDER BY first) AS n, c_name, c_mktsegment FROM f JOIN customer ON c_custkey = id WHERE c_custkey % 10 <> 0)
        SELECT coalesce(string_agg(n || '. ' || c_name || ' — `' || c_mktsegment || '`', chr(10) ORDER BY n), '') AS sources FROM j""",
    "json_props": r"SELECT event_id, CASE WHEN json_valid(props) THEN '\sum q' END AS tex FROM events",
    "image_refs_antijoin": """
        SELECT DISTINCT t AS target FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS t FROM pages)
        WHERE t NOT IN (SELECT unnest(string_split(text, ' ')) FROM benchmark)""",
    "plain_text_metrics": rf"""
        WITH m AS (SELECT conv_id, turn, text, '# Turn' || chr(10) || '- ![i](x.png) **' || role || '** [link](http://u)' || chr(10) || chr(10) || text AS md FROM conversations),
        a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
                     '(?m)^#{{1,6}}\s+', '', 'g'), '[*_`~]+', '', 'g') AS p FROM m),
        b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'),
                     '(?m)^-{{3,}}\s*$', '', 'g'), '^\s+|\s+$', '', 'g') AS q FROM a)
        SELECT conv_id, turn, len({_KEYS.format('q')})::BIGINT AS n_keywords, md5(q) AS plain_md5,
               len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x, E' \t\r'), '^$|^#{{1,6}}\s|^-{{3,}}$|^>|^\[Chunk |^\[\.\.\.\]$')))::BIGINT AS n_body
        FROM b""",
    "pdf_structure_lines": r"""
        WITH d AS (SELECT doc_id, ' a 1 0 obj' || chr(10) || '<< /Type /Page >> x' || chr(10) || 'keep stream words' || chr(10) || 'stream' || chr(10) || '12 34 word' || chr(10)
                          || 'not 12 34 word' || chr(10) || 'TRAILER end' || chr(10) || '/Width 5' || chr(10) || '/Widths 5' || chr(10) || regexp_replace(text, '[^\x20-\x7e\n]', '', 'g') AS t FROM documents)
        SELECT doc_id, md5(""" + _CLEAN.format("t") + r""") AS clean_md5 FROM d""",
    "normalize_metrics": r"""
        WITH c AS (SELECT doc_id, """ + _CLEAN.format("nfc_normalize(text)") + r""" AS c FROM documents)
        SELECT doc_id, length(c)::BIGINT AS char_count, len(""" + _WORDS.format("c") + r""")::BIGINT AS word_count,
               CASE WHEN c = '' THEN 0 ELSE len(string_split(c, chr(10))) END::BIGINT AS line_count, greatest(1, length(c) // 4)::BIGINT AS token_count FROM c""",
    "topic_focus": """
        WITH d AS (SELECT doc_id, (contains(lower(text), 'software')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'permission')::INT
                                   + contains(lower(text), 'notice')::INT) / 4.0::DOUBLE AS share FROM documents)
        SELECT doc_id, share, share < 0.02 AS rare FROM d""",
    "heading_alignment": """
        SELECT DISTINCT p_type AS title, '# ' || p_type || chr(10) || '## ' || p_type || chr(10) || '## Polished steel' || chr(10) || '## Notes' || chr(10) || '## Brushed copper' || chr(10) || 'text' AS md
        FROM part""",
    "decorative_headings": """
        SELECT r_regionkey, heading, decorative FROM region, (VALUES ('Notes', true), ('References & Resources', true), ('Appendix', true), ('Recap', true), ('Indice', true),
          ('Notes on networks', false), ('12', true), ('ℹ More', true), ('Key tips', false)) v(heading, decorative)""",
    "claimed_topics": "SELECT (row_number() OVER (ORDER BY t) - 1)::INT AS idx, (row_number() OVER (ORDER BY t) - 1)::INT AS ord FROM (SELECT DISTINCT p_type AS t FROM part)",
    "outline_chapters": "SELECT r_regionkey AS idx, upper(r_name[1]) || lower(r_name[2:]) AS title, (SELECT string_agg(n_nationkey, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS topics FROM region",
    "syllabus_outline": r"""
        WITH s AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: (CASE WHEN (j - 1) % 5 = 4 THEN chr(10) ELSE '' END) || CASE (j - 1 + doc_id) % 13
              WHEN 0 THEN '### Chapter ' || (j - 1) || ': ' || x WHEN 1 THEN '**module ' || (j - 1) || ' - ' || x WHEN 2 THEN (j - 1) || '. ' || x WHEN 3 THEN '  ' || (j - 1) || ') ' || x
              WHEN 4 THEN '1.' || (j - 1) || ' ' || x WHEN 5 THEN '    c) ' || x WHEN 6 THEN '- **' || x || '**' WHEN 7 THEN chr(9) || x WHEN 8 THEN '## IV. ' || x || '**'
              WHEN 9 THEN '(b) ' || x WHEN 10 THEN chr(8226) || ' ' || x WHEN 11 THEN '   ' || x || ' ' ELSE 'Uni 3 ' || x END), chr(10)) AS text FROM documents),
        -- A line end at the end of a text begins no other line.
        ls AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS ls FROM s),
        cut AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM ls),
        l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
        b AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare, length(line) - length(regexp_replace(line, '^\s+', '')) AS indent FROM l),
        w AS (SELECT *, coalesce(lead(indent) OVER (PARTITION BY doc_id ORDER BY pos) > indent, pos = n - 2) AS deeper FROM b WHERE bare <> ''),
        c AS (SELECT *, CASE
              WHEN regexp_matches(bare, '(?i)^\*{0,2}(#{1,3}\s+)?(Chapter|Capitolo|Module|Modulo|Unit|Uni[tà]|Topic|Tema|Section|Sezione|Lezione|Argomento|Parte|Part)\s+(\d+|[IVXLCDM]+)(\s*[:.\-]\s+|\s+)(.+?)\*{0,2}$')
              THEN regexp_extract(bare, '(?i)^\*{0,2}(?:#{1,3}\s+)?(?:Chapter|Capitolo|Module|Modulo|Unit|Uni[tà]|Topic|Tema|Section|Sezione|Lezione|Argomento|Parte|Part)\s+(?:\d+|[IVXLCDM]+)(?:\s*[:.\-]\s+|\s+)(.+?)\*{0,2}$', 1)
              WHEN deeper AND regexp_matches(bare, '^\d+[.)]\s+.+$') THEN regexp_extract(bare, '^\d+[.)]\s+(.+)$', 1)
              WHEN regexp_matches(bare, '^#{1,3}\s+(\d+|[IVXLCDM]+)[.)]\s+.+$') THEN regexp_extract(bare, '^#{1,3}\s+(?:\d+|[IVXLCDM]+)[.)]\s+(.+?)\*{0,2}$', 1) END AS title FROM w),
        i AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, CASE
              WHEN regexp_matches(bare, '^\d+(\.\d+)*[.)]?\s+.+$') THEN regexp_extract(bare, '^\d+(?:\.\d+)*[.)]?\s+\*?\*?(.+?)\*?\*?\s*$', 1)
              WHEN length(trim(regexp_extract(bare, '^\(?[a-zA-Z]\)?\.?\s+\*?\*?(.+?)\*?\*?\s*$', 1))) > 1 THEN regexp_extract(bare, '^\(?[a-zA-Z]\)?\.?\s+\*?\*?(.+?)\*?\*?\s*$', 1)
              WHEN regexp_matches(bare, '^[-•*]\s+.+$') THEN regexp_extract(bare, '^[-•*]\s+\*?\*?(.+?)\*?\*?\s*$', 1) END AS section FROM c)
        SELECT doc_id, idx::INTEGER AS idx, trim(max(title)) AS title, coalesce(string_agg(trim(section), '|' ORDER BY pos) FILTER (WHERE title IS NULL), '') AS sections
        FROM i WHERE idx >= 0 GROUP BY doc_id, idx""",
    "uncovered_topics": "SELECT n_nationkey AS ord, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT length(n_name) FROM nation WHERE n_regionkey < 3)",
    "closest_topics": """
        WITH c AS (SELECT min(p_partkey) AS idx, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: length(w) > 3))) AS w FROM part GROUP BY p_type),
        t AS (SELECT min(p_partkey) AS ord, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) > 3))) AS w FROM part GROUP BY p_name),
        n AS (SELECT idx, ord, count(*) AS common FROM c JOIN t USING (w) GROUP BY ALL)
        SELECT idx, ord, common FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY common DESC, ord) AS k FROM n) WHERE k = 1""",
    "outline_warnings": """
        SELECT 'cut' AS outline, 'missing' AS kind, n_nationkey AS ord, n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey % 5 <> 0
        UNION ALL SELECT * FROM (SELECT 'whole', 'order', n_nationkey, n_name FROM (SELECT *, lag(n_regionkey) OVER (ORDER BY n_nationkey) AS b FROM nation)
                                 WHERE n_regionkey < b ORDER BY n_nationkey LIMIT 1)""",
    "topic_order": f"WITH {_NTOPICS} SELECT name, row_number() OVER (ORDER BY extra_in_notes, coalesce(syllabus_position, 999), ord) - 1 AS place FROM t",
    "topics_block": f"""
        WITH {_NTOPICS}, n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY ord) AS k FROM t)
        SELECT n_regionkey, string_agg(k || '. ' || name || chr(10) || '   Description: ' || description
               || CASE WHEN subtopic_count > 0 THEN chr(10) || '   Subtopics: ' || subtopic_count ELSE '' END, chr(10) ORDER BY k) AS topics FROM n GROUP BY n_regionkey""",
    "chunk_ids_by_name": "SELECT event_type || (user_id % 10) AS name, arg_max(user_id::VARCHAR, event_id) AS chunk_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    "focus_subtopics": "SELECT 'software' AS name, count(*) AS subtopic_count FROM documents WHERE contains(lower(text), 'software')",
    "topic_coverage": f"WITH {_NTOPICS} SELECT bool_or(syllabus_position IS NOT NULL) AS has_syllabus, bool_or(extra_in_notes) AS has_extras, count(*) FILTER (missing_from_notes) AS n_missing FROM t",
    "chapter_selection": "SELECT r_regionkey AS idx, upper(r_name[1]) || lower(r_name[2:]) AS title FROM region WHERE r_regionkey IN (1, 3)",
    "record_violations": """
        SELECT * FROM (SELECT s_suppkey, concat_ws('; ', CASE WHEN s_suppkey % 6 = 0 THEN 'name is required' END, CASE WHEN floor(s_acctbal) < 0 THEN 'width must be >= 0' END) AS errors FROM supplier)
        WHERE errors <> ''""",
    "normalized_documents": r"""
        WITH c AS (SELECT page_id AS id, CASE WHEN page_id % 9 > 0 THEN """ + _CLEAN.format(r"regexp_replace(url, '/', ' ' || chr(9) || ' /', 'g')") + r""" END AS c FROM pages)
        SELECT id, coalesce(length(c), -1)::BIGINT AS char_count, coalesce(len(""" + _WORDS.format("c") + r"""), -1)::BIGINT AS word_count, coalesce(len(string_split(c, chr(10))), -1)::BIGINT AS line_count FROM c""",
    "inventory_json": """
        SELECT 'output/inventory.json' AS path, '{"syllabus_detected":true,"syllabus_document_id":"3","documents":[' || string_agg('{"id":"' || n_nationkey || '","title":"' || n_name || '","source_path":"'
               || lower(n_name) || '","file_type":"pdf"}', ',' ORDER BY n_nationkey) || ']}' AS content FROM nation""",
    "topics_json": f"""
        WITH {_NTOPICS} SELECT 'output/topics.json' AS path, '{{"topics":[' || string_agg('{{"name":"' || name || '","description":"' || description || '","related_documents":["' || n_regionkey
               || '"],"order_source":"syllabus","syllabus_position":' || coalesce(syllabus_position::VARCHAR, 'null') || ',"subtopic_count":' || subtopic_count || ',"missing_from_notes":' || missing_from_notes
               || ',"extra_in_notes":' || extra_in_notes || ',"order":' || ord || '}}', ',' ORDER BY ord) || ']}}' AS content FROM t""",
    "outline_md": r"""
        WITH e AS (SELECT r_regionkey AS idx, '' AS s, upper(r_name[1]) || lower(r_name[2:]) AS title, 1 AS level FROM region UNION ALL SELECT n_regionkey, n_name, n_name, 2 FROM nation),
        l AS (SELECT *, CASE WHEN level = 2 THEN '  ' ELSE '' END || '- [' || title || '](#' || replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), ' ', '-') || ')' || chr(10) AS line FROM e)
        SELECT 'output/outline.md' AS path, string_agg(line, '' ORDER BY idx, s) AS content FROM l""",
    "index_checklist": """
        WITH c AS (SELECT r_regionkey AS idx, '- [' || CASE WHEN r_regionkey % 2 = 0 THEN 'X' ELSE ' ' END || '] ' || (r_regionkey + 1) || '. ' || upper(r_name[1]) || lower(r_name[2:]) || chr(10)
                          || (SELECT string_agg('    - ' || n_name, chr(10) ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS part FROM region)
        SELECT 'output/indice.md' AS path, '# Indice del Manuale' || chr(10) || chr(10) || 'Capitoli generati sono contrassegnati con [X].' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY idx) || chr(10) AS content FROM c""",
    "chapter_files": r"""
        SELECT 'output/chapters/cap_' || c_custkey || '_' || regexp_replace(regexp_replace(lower(c_name || ' - ' || c_mktsegment), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g') || '.md' AS path,
               c_mktsegment AS content FROM customer""",
    "existing_chapters": f"WITH {_EXISTING} SELECT idx FROM e",
    "chapters_to_generate": f"WITH {_EXISTING} SELECT c_custkey::INT AS idx FROM customer WHERE c_custkey NOT IN (SELECT idx FROM e)",
    "validation_json": """
        SELECT 'output/validation.json' AS path, '{"overall":"warning","checks":[' || string_agg('{"check":"' || n_name || '","status":"' || CASE WHEN n_nationkey % 6 = 5 THEN 'warning","errors":["' || n_name || '"]}'
               ELSE 'pass","errors":[]}' END, ',' ORDER BY n_nationkey) || '],"summary":{"total_checks":' || count(*) || ',"passed":' || count(*) FILTER (n_nationkey % 6 <> 5) || ',"warnings":'
               || count(*) FILTER (n_nationkey % 6 = 5) || ',"failed":0}}' AS content FROM nation""",
    "scan_counters": f"""
        WITH p AS (SELECT page_id, CASE regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.([^./]+)$', 1) {_SUFFIX} ELSE 'unknown' END AS k FROM pages),
        j AS (SELECT k, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS c FROM p JOIN documents ON doc_id = page_id)
        SELECT count(*) AS n_found, count(*) FILTER (k = 'unknown') AS n_skipped, count(*) FILTER (c = 'new') AS n_new, count(*) FILTER (c = 'modified') AS n_modified,
               count(*) FILTER (c = 'unchanged') AS n_unchanged FROM j""",
    "syllabus_probe": "SELECT min(lower(n_name)) || ' syllabus.pdf' AS name FROM nation WHERE n_nationkey % 4 <> 0",
    "ocr_images": "SELECT n_nationkey, n_regionkey IN (0, 1, 4) AS readable FROM nation",
    "encoded_images": "SELECT conv_id, turn, base64(encode(text)) AS encoded FROM conversations",
    "depth_budget": """
        WITH d AS (SELECT n_nationkey, n_name, greatest(1, least(10, n_nationkey - 4)) AS d FROM nation),
        t AS (SELECT *, ([8192, 10240, 14336, 18432, 22528, 28672, 36864, 45056, 53248, 65536])[d] AS tokens FROM d)
        SELECT n_nationkey, tokens, (d + 1) // 2 AS band, greatest(8192, least(131072, length(n_name) * 4000 // 4 + tokens + 4096))::BIGINT AS context FROM t""",
    "invalidated_state": f"WITH {_STATE} SELECT count(*) FILTER (source_path IS NOT DISTINCT FROM 'src0/7') AS n_gone, count(*) FILTER (source_path IS DISTINCT FROM 'src0/7') AS n_left FROM s",
    "previous_models": f"WITH {_STATE} SELECT DISTINCT model FROM s WHERE model IS NOT NULL",
    "latest_topics": f"WITH {_STATE} SELECT arg_max(topics_json, updated_at) AS topics_json FROM s WHERE topics_json IS NOT NULL",
    "topics_update": f"WITH {_STATE} SELECT model, '[]' AS topics_json, count(*) AS n FROM s GROUP BY model",
    "state_lookup": "SELECT 'h' || c_custkey AS content_hash, c_name FROM customer WHERE c_custkey = 77",
    "document_deletion": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IS DISTINCT FROM 17 GROUP BY lang",
    "cache_without_model": "SELECT role AS model, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY role",
    "cache_upsert": """
        WITH r AS (SELECT conv_id, role, min(turn) AS a, max(turn) AS b, arg_min(text, turn) AS p FROM conversations GROUP BY ALL),
        u AS (SELECT *, CASE WHEN b % 2 = 0 THEN b ELSE a END AS t FROM r)
        SELECT conv_id || '/' || role AS key, 'old ' || p[1:20] AS prompt_preview, t::VARCHAR AS response, role AS model, t AS created_at FROM u""",
    "reused_chunks": "SELECT conv_id::VARCHAR AS content_hash, turn::INT AS position, md5(text) AS content_md5, (conv_id % 2)::INT AS fresh FROM conversations",
    "topic_images": "SELECT n_nationkey AS ord, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_regionkey GROUP BY n_nationkey",
    "meaningful_content": r"""
        SELECT conv_id, turn, 1 + len(list_filter(string_split(regexp_replace(text, '\. ', '.' || chr(10), 'g'), chr(10)),
               lambda x: NOT regexp_matches(trim(x, E' \t\r'), '^$|^#{1,6}\s|^-{3,}$|^>|^\[Chunk '))) >= 3 AS meaningful FROM conversations""",
    "invalid_names": "SELECT n_nationkey, n_nationkey % 10 NOT IN (7, 9) AS invalid FROM nation",
    "token_estimate": "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM documents",
    "chunk_positions": "SELECT conv_id || '/' || turn AS document_id, 1::BIGINT AS n_chunks, 0::BIGINT AS last FROM conversations",
    "latest_document": "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source",
}

_MARKDOWN = r"""m AS (SELECT doc_id, array_to_string(list_transform(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g')[:60]),
        lambda x, j: CASE ((j - 1) * (doc_id % 3 + 1) + doc_id) % 13 WHEN 0 THEN '# ' || x WHEN 1 THEN '- [' || x || '](#a)' WHEN 3 THEN '## ' || x WHEN 4 THEN '> ' || x WHEN 5 THEN '```' || x
          WHEN 6 THEN '  ### ' || x WHEN 8 THEN '### ' || x WHEN 9 THEN '---' WHEN 10 THEN '![i](' || x || ')' WHEN 11 THEN '[...]' WHEN 12 THEN '  - [x](#' || x || ')' ELSE x END), chr(10)) AS md FROM documents)"""
_NO_BODY = r"'^$|^#{1,6}\s|^-{3,}$|^>|^\[Chunk |^\[\.\.\.\]$'"
_MD_SECTIONS = r"""l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos FROM m),
        h AS (SELECT *, regexp_matches(line, '^#{2,3}\s+\S') AS head FROM l),
        s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
        b AS (SELECT doc_id, section::BIGINT AS section, trim(max(CASE WHEN head THEN regexp_replace(line, '^#{2,3}\s+', '') END)) AS title,
              regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS body FROM s WHERE section > 0 GROUP BY doc_id, section)"""
SQL |= {
    "markdown_heads": rf"""
        WITH {_MARKDOWN},
        l AS (SELECT doc_id, md, string_split(md, chr(10)) AS ls FROM m),
        -- Lines as letters: the list of links follows the title, blank lines among them.
        k AS (SELECT *, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^#\s+') THEN 'T' WHEN regexp_matches(x, '^##\s+') THEN 'S'
              WHEN regexp_matches(trim(x), '^-\s+\[') THEN 'L' WHEN trim(x) = '' THEN 'B' ELSE 'O' END), '') AS w FROM l),
        c AS (SELECT *, length(regexp_extract(w, '^[^TS]*T', 0)) AS a, length(regexp_extract(w, '^[^TS]*T((?:B*L)*)', 1)) AS n FROM k),
        t AS (SELECT *, trim(regexp_extract(md, '(?m)^#\s+(.+)', 1)) AS title FROM c)
        SELECT doc_id, CASE WHEN title <> '' THEN title ELSE 'Untitled' END AS title, array_to_string(list_transform(regexp_extract_all(md, '(?m)^#{{1,6}}\s+(.+)', 1), lambda x: trim(x)), '|') AS headings,
               md5(CASE WHEN n > 0 THEN array_to_string(ls[:a] || ls[a + n + 1:], chr(10)) ELSE md END) AS without_toc,
               md5(regexp_replace(md, '!\[([^\]]*)\]\(([^)]+)\)', '![\1](output/\2)', 'g')) AS image_paths,
               len(list_filter(ls, lambda x: NOT regexp_matches(trim(x), {_NO_BODY})))::BIGINT AS n_body,
               md5(array_to_string(list_filter(ls, lambda x: trim(x) <> '[...]'), chr(10))) AS clean FROM t""",
    "structure_errors": rf"""
        WITH {_MARKDOWN}, l AS (SELECT doc_id, string_split(md, chr(10)) AS ls FROM m)
        SELECT doc_id, array_to_string(list_concat(CASE WHEN len(list_filter(ls, lambda x: x[:3] = '```')) % 2 = 1 THEN ['unclosed code fence'] ELSE [] END,
               list_transform(list_filter(ls, lambda x: regexp_matches(x, '^ +#{{1,6}}\s')), lambda x: 'indented heading: ' || trim(x))), '|') AS errors FROM l""",
    "empty_and_hollow_sections": rf"""
        WITH {_MARKDOWN}, {_MD_SECTIONS}
        SELECT CASE WHEN body = '' THEN 'empty' ELSE 'hollow' END AS kind, doc_id, section, title FROM b
        WHERE body = '' OR len(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(trim(x), {_NO_BODY}))) = 0""",
    "toc_anchors": rf"""
        WITH {_MARKDOWN},
        l AS (SELECT doc_id, list_transform(string_split(md || chr(10) || '## a', chr(10)), lambda x: trim(x)) AS ls FROM m),
        k AS (SELECT *, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^-\s+\[[^\]]+\]\(#[^)]+\)') THEN 'L' WHEN x = '' OR x[1] = '-' THEN 'D' ELSE 'O' END), '') AS w FROM l),
        b AS (SELECT *, length(regexp_extract(w, '^[^L]*', 0)) AS a, length(regexp_extract(w, '^[^L]*(L[LD]*)', 1)) AS n FROM k),
        u AS (SELECT doc_id, ls, unnest(ls[a + 1:a + n]) AS line, unnest(range(n)) AS k FROM b),
        v AS (SELECT doc_id, ls, k, regexp_extract(line, '^-\s+\[([^\]]+)\]\(#([^)]+)\)', 2) AS anchor FROM u WHERE regexp_matches(line, '^-\s+\[[^\]]+\]\(#[^)]+\)')),
        g AS (SELECT DISTINCT doc_id, trim(regexp_replace(regexp_replace(lower(h), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-') AS anchor
              FROM (SELECT doc_id, unnest(list_filter(ls, lambda x: regexp_matches(x, '^#{{1,6}}\s+.'))) AS h0, regexp_replace(h0, '^#{{1,6}}\s+', '') AS h FROM l))
        SELECT v.doc_id, k::BIGINT AS at, v.anchor, g.anchor IS NULL AS broken FROM v LEFT JOIN g ON v.doc_id = g.doc_id AND v.anchor = g.anchor""",
    "syllabus_entries": SQL["syllabus_outline"].split("l AS (SELECT doc_id, len(ls)")[0] + r"""e AS (SELECT doc_id, list_filter(list_transform(ls, lambda x:
              trim(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^([-•*]|\d+[.)]|[ivxIVX]+[.)])\s+', ''))), lambda x: length(x) > 2) AS es FROM cut)
        SELECT doc_id, unnest(range(len(es)))::BIGINT AS at, unnest(es) AS entry FROM e""",
    "chapters_by_syllabus": rf"""
        WITH {_NTOPICS},
        c AS (SELECT n_nationkey AS ord, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM nation),
        p AS (SELECT c.ord, c.title, row_number() OVER (ORDER BY t.syllabus_position IS NULL, t.syllabus_position, c.ord) AS place FROM c LEFT JOIN t ON lower(t.name) = lower(c.title))
        SELECT ord, place::BIGINT AS place, 'intro' || chr(10) || '# ' || place || '. ' || title || chr(10) || '# x' AS md FROM p""",
    "cut_json": r"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z ]', '', 'g'))), lambda x: x <> '') AS ls FROM documents)
        SELECT doc_id, unnest(range(len(ls)))::BIGINT AS idx, unnest(ls) AS title, CASE WHEN doc_id % 2 = 0 THEN 's' ELSE 's|t' END AS sections FROM l WHERE len(ls) > 1""",
    "parsed_topics": """
        WITH r AS (SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS ord, p_brand AS description, greatest(0, p_size - 20)::BIGINT AS subtopic_count,
                   CASE WHEN p_partkey % 9 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE p_name END AS name FROM part),
        n AS (SELECT * REPLACE (coalesce(name, 'Topic ' || (ord + 1)) AS name) FROM r)
        SELECT p_type, ord, name, description, subtopic_count FROM (SELECT *, row_number() OVER (PARTITION BY p_type, lower(trim(name)) ORDER BY ord) AS k FROM n) WHERE k = 1""",
    "vision_candidates": """
        WITH r AS (SELECT conv_id, turn AS ord, length(text) % 2 = 0 AS relevant, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 3 <> 0, turn) AS rank FROM conversations),
        p AS (SELECT conv_id, ord, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS place FROM r WHERE relevant AND rank <= 4)
        SELECT r.conv_id, r.ord, r.rank, coalesce(p.place, 0) AS place FROM r LEFT JOIN p ON p.conv_id = r.conv_id AND p.ord = r.ord AND p.place <= 2 WHERE r.rank <= 4""",
    "heading_keys": r"""
        SELECT doc_id, md5(regexp_replace(regexp_replace(lower('12. ' || regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '', 'g'), '^\d+', '')) AS key_md5,
               replace(text[:200], chr(10), ' ') AS preview FROM documents""",
    "syllabus_coverage": f"""
        WITH {_CHUNKS},
        t AS (SELECT min(p_partkey) AS ord, p_name AS a FROM part WHERE p_partkey % 3 > 0 GROUP BY p_name),
        e AS (SELECT item_id AS idx, array_to_string(string_split(text, ' ')[:2], ' ') || CASE WHEN item_id % 4 = 0 THEN ' red widget' ELSE '' END AS b FROM benchmark),
""" + SQL["best_match_entry"].split("FROM region),\n")[1].split("        SELECT ord, r.idx")[0].rstrip().rstrip(",") + r""",
        g AS (SELECT ord, r.idx AS idx FROM f WHERE r.score >= 0.2),
        lost AS (SELECT idx, b FROM e WHERE idx NOT IN (SELECT idx FROM g)),
        ks AS (SELECT idx, list_distinct(list_filter(regexp_split_to_array(lower(b), '\s+'), lambda w: length(w) > 1)) AS ws, b FROM lost),
        kw AS (SELECT idx, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [lower(b)] END) AS k FROM ks),
        d AS (SELECT idx, count(DISTINCT document_id) AS n FROM kw JOIN chunks ON contains(lower(content), k) GROUP BY idx)
        SELECT t.ord, a AS name, coalesce(g.idx, -1) AS syllabus_position, false AS missing_from_notes, g.idx IS NULL AS extra_in_notes, 1::BIGINT AS n_documents FROM t LEFT JOIN g USING (ord)
        UNION ALL SELECT idx, b, idx, n IS NULL, false, coalesce(n, 0) FROM lost LEFT JOIN d USING (idx)""",
}
