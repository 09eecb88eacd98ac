"""DuckDB counterparts of the queries that SQL can express.

The others (tokenizer, fitted classifier, sampled model, keyed surrogates) are
held against brute force or round trips in the tests.
"""

_PLAIN = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
         r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"
_BLANK = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_decontaminate": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN} AS ws FROM benchmark),
win AS (SELECT item, array_to_string(ws[p : p + 9], ' ') AS phrase, len(ws[p : p + 9]) AS n
        FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS p FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS ws FROM documents),
span AS (SELECT rid, n, p, array_to_string(ws[p : p + n - 1], ' ') AS phrase
         FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, sizes WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT rid, span.n, p, item FROM span JOIN win ON span.phrase = win.phrase AND span.n = win.n),
covered AS (SELECT rid, count(DISTINCT p + k) AS n_hit
            FROM (SELECT rid, p, unnest(range(0, n)) AS k FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)""",
    "op4_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS p FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
         WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
same AS (SELECT g, count(*) AS n_copies, list(doc_id) AS docs
         FROM (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS g FROM s GROUP BY doc_id) GROUP BY g),
copies AS (SELECT unnest(docs) AS doc_id, n_copies FROM same)
SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id,
       CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies
FROM d LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM link GROUP BY a) n ON n.a = d.doc_id
LEFT JOIN copies c ON c.doc_id = d.doc_id""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_BLANK} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT rid, p, array_to_string(ws[p : p + 7], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM d WHERE len(ws) >= 8)),
rep AS (SELECT rid, count(DISTINCT p + k) AS n
        FROM (SELECT rid, p, unnest(range(0, 8)) AS k
              FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1) GROUP BY rid),
word AS (SELECT rid, max(c) AS top_word, count(*) AS n_distinct, max(strlen(w)) AS longest
         FROM (SELECT rid, w, count(*) AS c FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY rid, w) GROUP BY rid),
pos AS (SELECT rid, w, lag(w) OVER (PARTITION BY rid ORDER BY p) AS before
        FROM (SELECT rid, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d)),
near AS (SELECT rid, count(*) FILTER (WHERE w = before) AS n_stutter,
                count(*) FILTER (WHERE regexp_matches(w, '^([A-Za-z]|[^\x00-\x7F])')) AS n_alpha FROM pos GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(top_word, 0) AS top_word,
             coalesce(longest, 0) AS longest, coalesce(n_stutter, 0) AS n_stutter, coalesce(n_alpha, 0) AS n_alpha
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN word USING (rid) LEFT JOIN near USING (rid)),
b AS (SELECT *, CAST(n_words < 20 AS INT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS INT)
                + 4 * CAST(10 * n_symbols > 3 * n_words AS INT) + 8 * CAST(2 * n_dup_lines > n_lines AS INT)
                + 16 * CAST(word_chars < 2 * n_words OR word_chars > 25 * n_words AS INT)
                + 32 * CAST(2 * n_alpha < n_words AS INT) + 64 * CAST(n_words >= 50 AND 2 * top_word > n_words AS INT)
                + 128 * CAST(longest > 1000 AS INT) + 256 * CAST(2 * n_stutter > n_words AS INT) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
       CAST(bits AS BIGINT) AS fail_bits FROM b""",
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, p, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                                               unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents)
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT line, min((doc_id, p)) AS first, length(line) AS n FROM l GROUP BY line),
c AS (SELECT *, n // 3 AS k, n // 2 AS h FROM u WHERE n >= 10),
near AS (SELECT DISTINCT b.line FROM c a JOIN c b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.first < b.first
         AND least(a.n, b.n) >= 20
         AND (contains(a.line, b.line[1 : b.k]) OR contains(a.line, b.line[b.k + 1 : 2 * b.k])
              OR contains(a.line, b.line[2 * b.k + 1 : b.n]))
         WHERE levenshtein(a.line, b.line) <= 2
         UNION
         SELECT DISTINCT b.line FROM c a JOIN c b ON a.n BETWEEN b.n - 1 AND b.n + 1 AND a.first < b.first
         AND least(a.n, b.n) < 20 AND (contains(a.line, b.line[1 : b.h]) OR contains(a.line, b.line[b.h + 1 : b.n]))
         WHERE levenshtein(a.line, b.line) <= 1),
f AS (SELECT l.doc_id, l.p, (l.doc_id, l.p) = u.first AS is_first, l.line IN (SELECT line FROM near) AS is_near
      FROM l JOIN u ON l.line = u.line)
SELECT d.doc_id, count(p) AS n_lines, count(*) FILTER (WHERE p IS NOT NULL AND NOT is_first) AS n_exact,
       count(*) FILTER (WHERE is_first AND is_near) AS n_near,
       count(*) FILTER (WHERE is_first AND NOT is_near) AS n_kept,
       coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FILTER (WHERE is_first AND NOT is_near), '') AS kept_lines
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op12_chosen_path": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
                            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
                     FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[p : p + 3], ' ') AS g
      FROM (SELECT rid, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS p FROM d WHERE len(ws) > 0)),
size AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
both_ AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid
          GROUP BY a.rid, b.rid),
link AS (SELECT a, b FROM both_ JOIN size x ON x.rid = a JOIN size y ON y.rid = b
         WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(doc_id) AS least_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles,
       CASE WHEN low.a IS NULL THEN doc_id ELSE least_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN low.a IS NULL THEN doc_id ELSE least_id END AS kept
FROM d LEFT JOIN size USING (rid) LEFT JOIN low ON low.a = d.rid""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, r.id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM e WHERE id % 100 = 0) a, e r),
pos AS (SELECT anchor, id AS positive, score FROM s WHERE same AND id <> anchor
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
neg AS (SELECT p.anchor, p.positive, p.score AS positive_score, s.id AS negative, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id) AS rank
        FROM pos p JOIN s ON s.anchor = p.anchor AND NOT s.same
         AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id,
       positive_score, negative_score FROM neg WHERE rank <= 10""",
}
