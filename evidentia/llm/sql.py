"""DuckDB SQL of the queries that SQL can express on whole tables."""

#: Fixed names: those of the query and of its columns.
ORACLES = {
    "op2_content_addressed_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
q AS (SELECT *, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS holder FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id <> holder AS again, chr(13) || chr(10) AS nl FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN holder END AS refers_to,
       true AS verified,
       sha1('WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
            || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g') || nl || 'WARC-Date: 2000-01-01T00:00:00Z' || nl || 'WARC-Payload-Digest: sha1:' || payload_digest || nl
            || CASE WHEN again THEN 'WARC-Refers-To: <urn:page:' || holder || '>' || nl || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl ELSE '' END
            || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE payload_bytes END || nl || nl
            || CASE WHEN again THEN '' ELSE payload END || nl || nl) AS record_sha1
FROM r
""",
    "op8_target_weights": """
WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- sources above three times their size stop there and what is over is shared again, until none is above
w(step, stopped, share) AS (
  SELECT 0, list_value()::VARCHAR[], (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM s)
  UNION ALL
  SELECT step + 1, n.stopped, n.share FROM w, LATERAL (
    SELECT list(coalesce('=' || source, '-')) FILTER (w.share * weight > 3 * source_size OR list_contains(w.stopped, coalesce('=' || source, '-'))) AS stopped,
           ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (w.share * weight > 3 * source_size OR list_contains(w.stopped, coalesce('=' || source, '-'))), 0))::DOUBLE
           / nullif(coalesce(sum(weight) FILTER (NOT (w.share * weight > 3 * source_size OR list_contains(w.stopped, coalesce('=' || source, '-')))), 0), 0) AS share
    FROM s) n
  WHERE step < 50 AND len(coalesce(n.stopped, [])) > len(w.stopped) AND n.share IS NOT NULL),
l AS (SELECT arg_max(stopped, step) AS stopped, arg_max(share, step) AS share FROM w),
t AS (SELECT source, source_size, CASE WHEN list_contains(l.stopped, coalesce('=' || source, '-')) THEN 3.0 * source_size ELSE least(l.share * weight, 3.0 * source_size) END AS target FROM s, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0 END AS rate,
             ('0x' || left(md5('20240601:' || coalesce(CAST(d.doc_id AS VARCHAR), md5(d.text), '')), 13))::BIGINT / 4503599627370496.0 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + (draw < rate - floor(rate))::INT) * size AS BIGINT) AS taken FROM r
""",
    "op13_toivonen_phrases": """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS c FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)
      GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND c >= 10),
cuts AS (SELECT q.*, cut, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM q, (VALUES (1), (2)) t(cut) WHERE cut < k),
s AS (SELECT cuts.lang, cuts.phrase, cuts.k, a, cut, l.c AS l, r.c AS r, 1000000 * a * a // (l.c * r.c) AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM q WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE coalesce(100 * longer < 50 * a, true)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT o.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
""",
}
