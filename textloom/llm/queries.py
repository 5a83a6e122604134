"""The queries opN_<name> over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, html_extract, line_dedup, media, ngram_join, quality, sp_encode, substring_dedup, token_output, warc

WORDS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1,
        "op2_token_id_output": token_output.op2,
        "op3_html_extraction": html_extract.op3,
        "op4_line_dedup": line_dedup.op4,
        "op5_benchmark_decontamination": decontam.op5,
        "op6_quality_classifier": quality.op6,
        "op7_sentencepiece": sp_encode.op7,
        "op8_media_columns": media.op8,
        "op9_warc": warc.op9,
        "op10_substring_dedup": substring_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, '{WORDS}') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""",
        "op4_line_dedup": r"""
WITH l AS MATERIALIZED (SELECT doc_id, i - 1 AS line, parts[i] AS raw,
         list_distinct(list_filter(regexp_split_to_array(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w
       FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text <> ''))),
s AS MATERIALIZED (SELECT row_number() OVER () AS id, x.w, len(x.w) AS n, x.first FROM (SELECT list_sort(w) AS w, min({'d': doc_id, 'l': line}) AS first FROM l WHERE len(w) > 0 GROUP BY 1) x),
t AS MATERIALIZED (SELECT id, n, unnest(w) AS tok FROM s),
df AS MATERIALIZED (SELECT tok, count(*) AS c FROM t GROUP BY tok),
r AS MATERIALIZED (SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS p FROM t JOIN df USING (tok) WHERE c > 0),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM r a JOIN r b ON a.tok = b.tok AND a.id <> b.id
         WHERE a.p <= a.n - (80 * a.n + 99) // 100 + 1 AND b.p <= b.n - (80 * b.n + 99) // 100 + 1 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT cand.a, sb.first FROM cand JOIN s sa ON sa.id = cand.a JOIN s sb ON sb.id = cand.b
         WHERE 100 * len(list_intersect(sa.w, sb.w)) >= 80 * (sa.n + sb.n - len(list_intersect(sa.w, sb.w)))),
lim AS (SELECT s.w, least(s.first, coalesce(min(link.first), s.first)) AS lim FROM s LEFT JOIN link ON link.a = s.id GROUP BY s.id, s.w, s.first),
k AS (SELECT l.doc_id, l.line, l.raw, coalesce({'d': l.doc_id, 'l': l.line} > lim.lim, false) AS gone FROM l LEFT JOIN lim ON list_sort(l.w) = lim.w)
SELECT d.doc_id, CAST(count(k.line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (k.gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(k.raw, chr(10) ORDER BY k.line) FILTER (NOT k.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""",
        "op5_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT dw.doc_id, dw.i, dw.k, win.item FROM dw JOIN win ON dw.k = win.k AND dw.x = win.x),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
        "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h""",
        "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x),
lost AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN least_doc USING (x) WHERE m < doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    }
