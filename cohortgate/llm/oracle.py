"""DuckDB SQL of the queries that SQL can express over whole tables."""

ORACLE: dict[str, str] = {}

ORACLE["op1_bit_sliced_top_k"] = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_RULES = """(VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))"""

ORACLE["op4_wildcard_url_filter"] = f"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), f AS (
  SELECT h.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM h JOIN {_RULES} AS r(host, path, verdict) ON (h.host = r.host OR suffix(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
  GROUP BY h.page_id
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (page_id)
"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, place: int, pattern: str, test: str = "TRUE") -> str:
    hits = f"regexp_extract_all(text, '{pattern}', 0)"
    gaps = f"string_split_regex(text, '{pattern}')"
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, start, start + length(hit) AS stop FROM (
    SELECT doc_id, hit, coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS start
    FROM (SELECT doc_id, unnest({hits}) AS hit, unnest(({gaps})[1:len({hits})]) AS gap, unnest(range(len({hits}))) AS i FROM d)
  ) WHERE {test}"""


ORACLE["op5_blob_ledger_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans('assign', 0, _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6")}
  UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 'length(hit) >= 20')}
  UNION ALL {_spans('hex', 2, '[0-9a-f]{24,}')}
  UNION ALL {_spans('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----')}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) FILTER (kind <> 'pem') AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

ORACLE["op7_digest_index_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), c AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN c USING (text_sha256)
"""

ORACLE["op8_sketch_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (
  SELECT md5(string_agg(g, chr(10) ORDER BY g)) AS k, doc_id FROM s GROUP BY doc_id
), r AS (SELECT k, min(doc_id) AS rep FROM k GROUP BY k),
rs AS (SELECT s.doc_id, s.g FROM s JOIN r ON s.doc_id = r.rep),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, low) AS (
  SELECT rep, rep FROM r UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.id AND c.low < e.b
), m AS (SELECT id, min(low) AS low FROM c GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, w.doc_id) AS component_id, coalesce(m.low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN r ON k.k = r.k LEFT JOIN m ON m.id = r.rep
"""

ORACLE["op9_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, 1 + place % 3 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (1 + place % 3)::DOUBLE AS ratio FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, place) AS turn,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), v AS (SELECT arg_min(level, turn) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, l.source_size, least(l.cap::DOUBLE, v.level * l.weight::DOUBLE) AS target FROM l, v),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate, digest,
    count(*) OVER (PARTITION BY doc_id, d.source, digest) AS n, row_number() OVER (PARTITION BY doc_id, d.source, digest) AS turn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, n::DOUBLE * (rate - floor(rate)) AS part,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || digest || ':7'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM r
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN turn <= floor(part) + CASE WHEN u < part - floor(part) THEN 1 ELSE 0 END THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""

ORACLE["op11_nra_ranked_search"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), d AS (SELECT doc_id, len(ws)::BIGINT AS n, ws FROM t WHERE len(ws) > 0),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY doc_id, term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term, n_docs
), s AS (
  SELECT q.item_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 90 + ((90 * d.n * g.n_docs) // g.n_terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN d ON d.doc_id = f.doc_id, g GROUP BY q.item_id, f.doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLE["op13_filter_audit"] = r"""
WITH RECURSIVE o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x) WHERE NOT contains(filter_order, x)
), p AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier
  FROM o, range(1, 6) AS s(step) WHERE length(filter_order) = 5
), t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), b AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS bad
  FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, bad, count(*)::BIGINT AS n, sum(coalesce(good, 0))::BIGINT AS good, sum(coalesce(toxic, 0))::BIGINT AS toxic
  FROM b LEFT JOIN l USING (doc_id) GROUP BY part, bad
), x AS (
  SELECT part, filter_order, step, own, n, good, toxic,
    contains(bad, own) AS fails, earlier <> '' AND regexp_matches(bad, '[' || earlier || 'z]') AS gone, bad = own AS only_own
  FROM c, p
), y AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM y
"""
