"""DuckDB SQL for the queries that SQL can express."""

_OP1 = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS rid FROM documents),
grams AS (SELECT rid, i, list_slice(words, i, i + 7) AS g FROM w, unnest(generate_series(1, len(words) - 7)) AS t(i) WHERE len(words) >= 8),
again AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, generate_series(0, 7) AS s(k) GROUP BY rid),
base AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
                length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
                length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS upper_n, length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) AS lower_n
         FROM w LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR upper_n > lower_n) AS kept
FROM base
"""

_OP2 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""

_OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS rid FROM documents),
wins AS (SELECT rid, doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS g FROM w, unnest(generate_series(1, len(words) - 49)) AS t(i) WHERE len(words) >= 50),
again AS (SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS later FROM wins),
gone AS (SELECT DISTINCT rid, i + k AS at FROM again, generate_series(0, 49) AS s(k) WHERE later),
flat AS (SELECT rid, u.word AS word, u.at AS at FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w) u),
kept AS (SELECT f.rid, string_agg(f.word, ' ' ORDER BY f.at) AS t FROM flat f ANTI JOIN gone g ON f.rid = g.rid AND f.at = g.at GROUP BY f.rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS rid FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(words)) AS n, array_to_string(list_slice(words, i, i + least(13, len(words)) - 1), ' ') AS g FROM b, unnest(generate_series(1, greatest(1, len(words) - 12))) AS t(i) WHERE len(words) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS g FROM d, lens, unnest(generate_series(1, len(words) - n + 1)) AS t(i) WHERE len(words) >= n),
hit AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit), unnest(generate_series(0, n - 1)) AS s(k) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""

_DISTANCE = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
_OP12_ROUND = """
a{n} AS (SELECT v.rid, c.cluster, d FROM v, LATERAL (SELECT cluster, d FROM (SELECT c.cluster, {distance} AS d FROM c{n} c) ORDER BY d, cluster LIMIT 1) c),
s{n} AS (SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (rid), generate_series(1, 64) AS t(i) GROUP BY cluster, i),
m{n} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{n} GROUP BY cluster),
c{m} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (cluster)),"""
_OP12 = f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16),
{"".join(_OP12_ROUND.format(n=n, m=n + 1, distance=_DISTANCE) for n in range(3))}
f AS (SELECT v.vec_id, c.cluster, d FROM v, LATERAL (SELECT cluster, d FROM (SELECT c.cluster, {_DISTANCE} AS d FROM c3 c) ORDER BY d, cluster LIMIT 1) c)
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM f JOIN c3 USING (cluster)
"""

_OP13 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT lang, source, rid, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source FROM d GROUP BY lang, source),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
w AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(w.total, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN w ON w.lang = g.lang AND w.source = g.source),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
         ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term QUALIFY rank <= 50
"""

ORACLE_SQL = {"op1_quality_rules": _OP1, "op2_warc": _OP2, "op7_substring_dedup": _OP7, "op10_decontamination": _OP10, "op12_centroid_clustering": _OP12, "op13_source_divergence": _OP13}
