"""DuckDB SQL of the queries that SQL can express, row for row the contract's columns."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i
       FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS win FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k),
dw AS (SELECT rid, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS win FROM di),
hit AS (SELECT dw.rid, dw.i, dw.k, bw.item FROM dw JOIN bw ON bw.k = dw.k AND bw.win = dw.win),
nw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
       FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(nw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(nw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nw ON nw.rid = d.rid LEFT JOIN it ON it.rid = d.rid"""

PASSAGES = """WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
di AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50 AND doc_id IS NOT NULL),
dw AS (SELECT rid, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS win FROM di),
fw AS (SELECT win, min(doc_id) AS first_id FROM dw GROUP BY win),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p
         FROM (SELECT dw.rid, dw.i FROM dw JOIN fw ON fw.win = dw.win WHERE fw.first_id < dw.doc_id)),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT w.rid, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS s
         FROM w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = w.rid AND g.p = w.p) GROUP BY w.rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid"""

EMBEDDINGS = """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id,
       least(v.vec_id, coalesce(c.m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + least(5, len(ws)) - 1), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id),
links AS (SELECT i.a, i.b FROM inter i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b
          WHERE 100 * i.k >= 85 * (x.n + y.n - i.k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(c.m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""


def clusters(k: int = 40, rounds: int = 5) -> str:
    """Lloyd rounds written out: assignments a1, a2, ... and centroids c0, c1, ..."""
    def assigned(i: int, c: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT rid, min(d * 1000 + k) AS m FROM (
  SELECT v.rid, c.k, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
  FROM v CROSS JOIN c{c} c) GROUP BY rid)"""

    def moved(i: int) -> str:
        return f"""c{i} AS MATERIALIZED (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{i - 1} c LEFT JOIN (
  SELECT k, list(q ORDER BY p) AS e FROM (SELECT k, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS q FROM (
    SELECT a.m % 1000 AS k, unnest(v.e) AS x, unnest(range(1, 65)) AS p FROM a{i} a JOIN v ON v.rid = a.rid)
    GROUP BY k, p) GROUP BY k) n ON n.k = c.k)"""

    turns = [part for i in range(1, rounds + 1) for part in (assigned(i, i - 1), moved(i))]
    last = rounds + 1
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e
                    FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})),
{", ".join(turns)}, {assigned(last, rounds)},
r AS (SELECT v.vec_id, CAST(a.m % 1000 AS INTEGER) AS cluster, CAST(a.m // 1000 AS BIGINT) AS distance
      FROM a{last} a JOIN v ON v.rid = a.rid)
SELECT r.vec_id, r.cluster, r.distance, CAST(sum(r.distance) OVER (PARTITION BY r.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(r.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM r JOIN c{rounds} c ON c.k = r.cluster"""


CLUSTERS = clusters()

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, strlen(body) AS size, sha1(body) AS digest,
             CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS top FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to FROM m"""

FILTER_AUDIT = """WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             (len(d.ws) < 200) AS a, (100 * len(list_distinct(d.ws)) < 50 * len(d.ws)) AS b,
             (100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t)) AS c,
             regexp_matches(d.t, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY d.t), false) AS e
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
u AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END)
             || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
             || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM f),
s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM u GROUP BY part, fails),
o(w) AS (SELECT '' UNION ALL SELECT w || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE position(x IN w) = 0),
k AS (SELECT w, unnest(range(1, 6)) AS step FROM o WHERE length(w) = 5),
r AS (SELECT s.part, k.w, k.step, s.n, s.good, s.toxic, s.fails, substr(k.w, k.step, 1) AS x,
             length(translate(substr(k.w, 1, k.step - 1), s.fails, '')) < k.step - 1 AS gone FROM s CROSS JOIN k),
q AS (SELECT part, w, step, any_value(x) AS x,
             sum(CASE WHEN NOT gone AND position(x IN fails) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN NOT gone AND position(x IN fails) > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND position(x IN fails) > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND position(x IN fails) > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN NOT gone AND position(x IN fails) > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM r GROUP BY part, w, step)
SELECT part, w AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM q"""
