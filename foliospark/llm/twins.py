"""SQL twins of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_CONTENT = "CASE WHEN coalesce(source, '') <> '' AND starts_with(page_content, source || chr(10)) THEN substr(page_content, length(source) + 2) ELSE page_content END"
_CLEAN = f"clean AS (SELECT DISTINCT ON (chunk_id) chunk_id, {_CONTENT} AS content FROM chunks WHERE type = 'text' AND NOT coalesce(ocr, false) AND page_content IS NOT NULL)"

P1_FOUND = """WITH u AS (SELECT DISTINCT ON (chunk_id) chunk_id AS id, embeddings::DOUBLE[64] AS v FROM chunks WHERE embeddings IS NOT NULL AND len(embeddings) = 64),
g AS (SELECT id, v FROM u WHERE array_inner_product(v, v) > 0),
p AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.v, b.v) AS c FROM g a JOIN g b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.849),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM p)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE n <= 5 AND c >= 0.85"""

P1_NEAREST = """WITH u AS (SELECT DISTINCT ON (chunk_id) chunk_id AS id, embeddings::DOUBLE[64] AS v FROM chunks WHERE embeddings IS NOT NULL AND len(embeddings) = 64),
g AS (SELECT id, v FROM u WHERE array_inner_product(v, v) > 0),
p AS (SELECT a.id AS query_id, b.id AS neighbour, least(1, array_inner_product(a.v, b.v) / (sqrt(array_inner_product(a.v, a.v)) * sqrt(array_inner_product(b.v, b.v)))) AS c FROM g a JOIN g b ON a.id <> b.id WHERE a.id % 100 = 0),
r AS (SELECT query_id, neighbour, c, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, neighbour) AS place FROM p)
SELECT query_id, neighbour, round(c, 6) AS cosine, place FROM r WHERE place <= 5"""

P5_FOUND = f"""WITH {_CLEAN}, t AS (SELECT chunk_id, lower(regexp_replace(content, '[ \\t\\n\\r]', '', 'g')) AS t FROM clean),
l AS (SELECT chunk_id, t FROM t WHERE length(t) >= 120),
w AS (SELECT DISTINCT chunk_id, substr(t, i::INT, 20) AS w FROM (SELECT chunk_id, t, unnest(range(1, length(t) - 18)) AS i FROM l)),
n AS (SELECT chunk_id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS s FROM w a JOIN w b ON a.w = b.w AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM s JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE s / (x.n + y.n - s)::DOUBLE >= 0.6"""

P9_FOUND = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, regexp_extract_all(lower(question), '[\p{L}\p{M}\p{N}]+') AS t FROM eval_items WHERE question IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(t[i : i + 9], ' ') AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) - 8)) AS i FROM d)),
qw AS (SELECT DISTINCT item_id, array_to_string(t[i : i + 9], ' ') AS w FROM (SELECT item_id, t, unnest(range(1, len(t) - 8)) AS i FROM q))
SELECT DISTINCT doc_id, item_id FROM dw JOIN qw USING (w)"""


# The units are the fixed values of leakage.UNITS.
P9_TEMPLATES = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT * FROM (SELECT item_id, regexp_extract_all(lower(question), '[\p{L}\p{M}\p{N}]+') AS t FROM eval_items WHERE question IS NOT NULL) WHERE len(t) >= 10),
common AS (SELECT w FROM (SELECT DISTINCT item_id, unnest(t) AS w FROM q) GROUP BY w HAVING count(*) >= greatest(3, 0.02 * (SELECT count(*) FROM q))),
e AS (SELECT 0 AS side, doc_id AS id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS pos FROM d UNION ALL SELECT 1, item_id, unnest(t), unnest(range(1, len(t) + 1)) FROM q),
c AS (SELECT side, id, pos, e.w, CASE WHEN regexp_matches(e.w, '[\p{Nd}⁰¹²³⁴-⁹₀-₉]') THEN '<1>' WHEN list_contains(UNITS, e.w) THEN '<2>' WHEN common.w IS NOT NULL THEN e.w ELSE '<3>' END AS code FROM e LEFT JOIN common ON common.w = e.w),
l AS (SELECT side, id, list(w ORDER BY pos) AS t, list(code ORDER BY pos) AS c FROM c GROUP BY side, id),
v AS (SELECT side, id, array_to_string(c, ' ') AS form, t[i : i + 9] AS w, c[i : i + 9] AS k FROM (SELECT *, unnest(range(1, len(t) - 8)) AS i FROM l WHERE len(t) >= 10)),
m AS (SELECT x.id AS doc_id, y.id AS item_id, y.form, x.w AS a, y.w AS b FROM v x JOIN v y ON x.side = 0 AND y.side = 1 AND x.k = y.k WHERE len(list_filter(y.k, lambda z: z[1] <> '<')) >= 4)
SELECT doc_id, item_id FROM (SELECT doc_id, form, min(item_id) AS item_id FROM m WHERE a <> b AND list_transform(a, lambda z: list_position(a, z)) = list_transform(b, lambda z: list_position(b, z)) GROUP BY doc_id, form)"""

# Every pair behind P9_TEMPLATES.
P9_LINKS = P9_TEMPLATES.rsplit("\n", 1)[0] + "\nSELECT DISTINCT doc_id, item_id FROM m WHERE a <> b AND list_transform(a, lambda z: list_position(a, z)) = list_transform(b, lambda z: list_position(b, z))"
