"""DuckDB SQL of the registered queries."""

OP1 = r"""
WITH d AS (SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src, md5(coalesce(text, '')) AS h,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT nul, src, sum(size)::DOUBLE AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY nul, src) AS pos FROM s),
w AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, source_size * 2 AS cap FROM r),
c AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(source_size) OVER () * 1.5 AS goal
  FROM w WINDOW o AS (ORDER BY cap / w, pos)),
l AS (SELECT arg_min((goal - caps) / rest, (cap / w, pos)) AS level FROM c WHERE cap > (goal - caps) / rest * w),
t AS (SELECT nul, src, source_size::BIGINT AS source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM c, l),
k AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.nul, d.src ORDER BY size DESC, doc_id NULLS LAST, h) AS n,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('20240611:' || CASE WHEN d.nul THEN 'n' ELSE 's' END || d.src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.nul = t.nul AND d.src = t.src)
SELECT doc_id, size, source_size, target, ((floor(n * rate + u) - floor((n - 1) * rate + u)) * size)::BIGINT AS taken FROM k
"""

OP2 = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.m AS component_id, d.doc_id = m.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""

OP6 = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS m FROM r GROUP BY 1),
c AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.m AS component_id, v.vec_id = m.m AS kept
FROM v LEFT JOIN c ON c.x = v.vec_id LEFT JOIN m ON m.x = v.vec_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
s AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN length(translate(t, '#$%&*|', '')) < length(t) THEN 8 ELSE 0 END) + (CASE WHEN d.doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM d JOIN s USING (t) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
i AS (SELECT unnest(range(5)) AS i),
p AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM i a, i b, i c, i d, i e
  WHERE (1 << a.i) + (1 << b.i) + (1 << c.i) + (1 << d.i) + (1 << e.i) = 31 AND a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i
  AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
o AS (SELECT substr('ABCDE', a::INT + 1, 1) || substr('ABCDE', b::INT + 1, 1) || substr('ABCDE', c::INT + 1, 1) || substr('ABCDE', d::INT + 1, 1) || substr('ABCDE', e::INT + 1, 1) AS filter_order, [a, b, c, d, e] AS fs FROM p),
t AS (SELECT filter_order, k AS step, (1 << fs[k])::INT AS bit, CASE WHEN k > 1 THEN list_sum(list_transform(fs[1:k - 1], lambda x: 1 << x))::INT ELSE 0 END AS before
  FROM (SELECT filter_order, fs, unnest(range(1, 6))::INT AS k FROM o)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM m, t GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def _kneser_ney() -> str:
    """The definition, order by order: counts, discounts, context masses, and each probe n-gram's interpolated probability."""
    pad = " || ".join(["chr(2)"] * 4)
    at = f"substr({pad} || t, i, 5)"
    clean = "replace(text, chr(0), chr(65533))"
    out = [
        "good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)",
        "fold AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5 = 0 AS told FROM good)",
        f"d AS (SELECT doc_id, lang, coalesce({clean}, '') AS t FROM documents)",
        f"c5 AS (SELECT {at} AS g, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM d JOIN fold USING (doc_id) WHERE NOT told) GROUP BY 1)",
        *(f"c{k} AS (SELECT substr(g, 2) AS g, count(*) AS n FROM c{k + 1} GROUP BY 1)" for k in (4, 3, 2, 1)),
        f"u5 AS (SELECT DISTINCT {at} AS g FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM d))",
        *(f"u{k} AS (SELECT DISTINCT substr(g, 2) AS g FROM u{k + 1})" for k in (4, 3, 2, 1)),
    ]
    for k in range(1, 6):
        low = "(SELECT 1.0::DOUBLE / (count(*) + 1) FROM c1)" if k == 1 else "l.p"
        out += [
            f"s{k} AS (SELECT count(*) FILTER (n = 1)::DOUBLE AS a, count(*) FILTER (n = 2)::DOUBLE AS b, count(*) FILTER (n = 3)::DOUBLE AS c, count(*) FILTER (n = 4)::DOUBLE AS e FROM c{k})",
            f"y{k} AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN a / (a + 2 * b) ELSE 0.5 END AS y FROM s{k})",
            f"f{k} AS (SELECT least(greatest(CASE WHEN a > 0 THEN 1 - 2 * y * b / a ELSE 0.5 END, 1e-3), 1 - 1e-3) AS d1, least(greatest(CASE WHEN b > 0 THEN 2 - 3 * y * c / b ELSE 1.0 END, 1e-3), 2 - 1e-3) AS d2, least(greatest(CASE WHEN c > 0 THEN 3 - 4 * y * e / c ELSE 1.5 END, 1e-3), 3 - 1e-3) AS d3 FROM y{k})",
            f"o{k} AS (SELECT g, n, substr(g, 1, {k - 1}) AS x, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS off FROM c{k}, f{k})",
            f"x{k} AS (SELECT x, sum(n)::DOUBLE AS total, sum(off) AS lost FROM o{k} GROUP BY 1)",
            f"q{k} AS (SELECT u.g, coalesce((o.n - o.off) / x.total, 0) + coalesce(x.lost / x.total, 1) * {low} AS p FROM u{k} u LEFT JOIN o{k} o ON o.g = u.g LEFT JOIN x{k} x ON x.x = substr(u.g, 1, {k - 1})" + (f" JOIN q{k - 1} l ON l.g = substr(u.g, 2))" if k > 1 else ")"),
        ]
    out += [
        f"e AS (SELECT doc_id, {at} AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM d))",
        "z AS (SELECT doc_id, count(*) AS n, round(exp(-avg(ln(p))), 6) AS perplexity FROM e JOIN q5 USING (g) GROUP BY 1)",
        "h AS (SELECT d.lang, z.perplexity FROM z JOIN d USING (doc_id) JOIN fold USING (doc_id) WHERE told)",
        "w AS (SELECT lang, quantile_disc(perplexity, 0.99) AS own FROM h GROUP BY 1)",
        "v AS (SELECT d.doc_id, d.lang, coalesce(z.n, 0)::BIGINT AS n_scored, z.perplexity, coalesce(w.own, (SELECT quantile_disc(perplexity, 0.99) FROM h), 'inf'::DOUBLE) AS threshold FROM d LEFT JOIN z USING (doc_id) LEFT JOIN w ON w.lang IS NOT DISTINCT FROM d.lang)",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT *, coalesce(perplexity <= threshold, false) AS kept FROM v"


OP7 = _kneser_ney()
