"""Retrieval queries: lexical and vector arms, fusion, rerank windows, budgets, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.text import content_words, estimated_tokens, light_stem, term_overlap, tokens
from cairn.operators import retrieval as R
from cairn.operators.filters import recall_filter
from cairn.registry import query
from cairn.scratch import keep
from cairn.sources.tables import read

QUERY = "the ontion erth"
WORDS = QUERY.split()

#: tokens of two or more letters or digits, as the text functions give them
_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1)"
_HEAD = "split_part(text, chr(10), 1)"


def _bm25_sql(fields: dict[str, float], allowed: str = "true", table: str = "documents", key: str = "doc_id") -> str:
    tok = ", ".join(f"{_TOK.format(f'coalesce({sql}, chr(32))')} AS t{i}" for i, sql in enumerate(fields))
    count = lambda w: " + ".join(f"len(list_filter(t{i}, lambda t: t = '{w}'))::DOUBLE * {wt}" for i, wt in enumerate(fields.values()))
    one = " " + "  ".join(WORDS) + " "
    row = lambda i: f"(' ' || array_to_string(t{i}, '  ') || ' ')"
    phrase = " + ".join(f"(length({row(i)}) - length(replace({row(i)}, '{one}', '')))::DOUBLE / {len(one)} * {wt}" for i, wt in enumerate(fields.values()))
    size = " + ".join(f"len(t{i})::DOUBLE * {wt}" for i, wt in enumerate(fields.values()))
    tfs = [count(w) for w in WORDS] + [phrase]
    n = len(tfs)
    return f"""WITH _a AS (SELECT {key}, {tok} FROM {table}),
_b AS (SELECT {key}, {size} AS ln, {', '.join(f'{t} AS f{i}' for i, t in enumerate(tfs))} FROM _a),
_s AS (SELECT count(*)::DOUBLE AS n, avg(ln) AS av, {', '.join(f'count_if(f{i} > 0)::DOUBLE AS d{i}' for i in range(n))} FROM _b),
_c AS (SELECT {key}, round({' + '.join(f'greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * ln / av))' for i in range(n))}, 6) AS score
  FROM _b, _s WHERE {allowed} AND ({' OR '.join(f'f{i} > 0' for i in range(n))})),
bm AS (SELECT {key}, score, row_number() OVER (ORDER BY score DESC, {key})::INT AS rank FROM _c ORDER BY score DESC, {key} LIMIT 60)"""


_COS = "round(list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), q.e) / (sqrt(list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product(q.e, q.e))), 6)"
_VEC = f"""vq AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id = 0),
vt AS (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings v, vq q),
ve AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, greatest(0, least(1, score)) AS relevance FROM vt ORDER BY score DESC, doc_id LIMIT 60)"""
_BM = _bm25_sql({"text": 1.0})
_RRF = f"""{_BM}, {_VEC},
ar AS (SELECT doc_id, rank, NULL::DOUBLE AS relevance FROM bm UNION ALL SELECT doc_id, rank, relevance FROM ve),
fu AS (SELECT doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, max(relevance) AS relevance, count(*)::BIGINT AS arms FROM ar GROUP BY 1),
rr AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM fu)"""


def docs(spark, sf_dir, *cols):
    return read(spark, sf_dir, "documents", *(cols or ("doc_id", "text")))


def lexical(spark, sf_dir):
    return R.bm25(docs(spark, sf_dir), QUERY, {"text": 1.0}, "doc_id")


def vector(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    first = v.filter("vec_id = 0").first()  # the query vector
    return R.vector_top(v.withColumnRenamed("vec_id", "doc_id"), first["embedding"], "doc_id")


def hybrid(spark, sf_dir):
    return R.fuse([lexical(spark, sf_dir), vector(spark, sf_dir)], "doc_id")


@query("tokenize", f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("bm25_search", f"{_BM} SELECT doc_id, score, rank FROM bm")
def bm25_search(spark, sf_dir):
    return lexical(spark, sf_dir)


@query("bm25_heading_weight", f"{_bm25_sql({'text': 1.0, _HEAD: 2.0})} SELECT doc_id, score, rank FROM bm")
def bm25_heading_weight(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("heading", F.split_part("text", F.lit("\n"), F.lit(1)))
    return R.bm25(d, QUERY, {"text": 1.0, "heading": 2.0}, "doc_id")


_EN = "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


@query("bm25_filtered", f"{_bm25_sql({'text': 1.0}, _EN)} SELECT doc_id, score, rank FROM bm")
def bm25_filtered(spark, sf_dir):
    allowed = docs(spark, sf_dir, "doc_id", "lang").filter("lang = 'en'")
    return R.bm25(docs(spark, sf_dir), QUERY, {"text": 1.0}, "doc_id", allowed=allowed)


@query("term_stats", f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1")
def term_stats(spark, sf_dir):
    return R.term_stats(docs(spark, sf_dir))


@query("postings_search", f"""WITH p AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS av FROM p),
x AS (SELECT doc_id, len(t) AS ln, unnest(t) AS term FROM p), g AS (SELECT term, doc_id, count(*) AS tf, any_value(ln) AS ln FROM x WHERE term IN ('ontion', 'erth', 'thble') GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM g GROUP BY 1),
c AS (SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * g.ln / av))), 6) AS score FROM g JOIN d USING (term), s GROUP BY 1)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM c ORDER BY score DESC, doc_id LIMIT 60""")
def postings_search(spark, sf_dir):
    d = docs(spark, sf_dir)
    stats = d.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size(tokens(F.coalesce(F.col("text"), F.lit(""))))).alias("avg"))
    return R.search_postings(R.postings(d, "doc_id"), stats, ["ontion", "erth", "thble"], "doc_id")


@query("vector_topk", f"WITH {_VEC} SELECT doc_id, score, rank, relevance FROM ve")
def vector_topk(spark, sf_dir):
    return vector(spark, sf_dir)


@query("rrf_hybrid", f"{_RRF} SELECT doc_id, score, relevance, arms, rank FROM rr")
def rrf_hybrid(spark, sf_dir):
    return hybrid(spark, sf_dir)


@query("rrf_single_arm", f"{_BM} SELECT doc_id, score, rank FROM bm")
def rrf_single_arm(spark, sf_dir):
    return R.fuse([lexical(spark, sf_dir)], "doc_id", scores=True)


@query("rerank_window", f"""{_RRF}, fx AS (SELECT * FROM rr WHERE rank < 10), ed AS (SELECT * FROM rr WHERE rank BETWEEN 10 AND 20 ORDER BY relevance DESC NULLS LAST, rank LIMIT 1)
SELECT doc_id, score, relevance, arms, rank FROM fx UNION ALL SELECT doc_id, score, relevance, arms, rank FROM ed""")
def rerank_window(spark, sf_dir):
    return R.rerank_window(hybrid(spark, sf_dir), "doc_id", 10)


@query("score_normalize", f"{_BM} SELECT doc_id, round(score / max(score) OVER (), 6) AS score, rank FROM bm")
def score_normalize(spark, sf_dir):
    return R.normalise(lexical(spark, sf_dir)).withColumn("score", F.round("score", 6)).select("doc_id", "score", "rank")


@query("tail_rescale", f"""{_BM}, j AS (SELECT doc_id, 1.0::DOUBLE / (1 + rank) AS ns FROM bm WHERE rank <= 10), f AS (SELECT min(ns) AS fl FROM j),
t AS (SELECT doc_id, row_number() OVER (ORDER BY rank) - 1 AS i, count(*) OVER () AS n FROM bm WHERE rank > 10)
SELECT doc_id, round(ns, 9) AS score, true AS judged FROM j UNION ALL SELECT doc_id, round(fl * (n - i) / (n + 1), 9), false FROM t, f""")
def tail_rescale(spark, sf_dir):
    hits = keep(lexical(spark, sf_dir))  # few rows that are read several times
    judged = hits.filter("rank <= 10").select("doc_id", (F.lit(1.0) / (1 + F.col("rank"))).alias("new_score"))
    return R.tail_rescale(hits, judged, "doc_id").withColumn("score", F.round("score", 9))


@query("rerank_sigmoid", f"{_BM}, s AS (SELECT doc_id, 1 / (1 + exp(-(score - 1.5))) AS s FROM bm) SELECT doc_id, round(s, 6) AS score FROM s WHERE s >= 0.5")
def rerank_sigmoid(spark, sf_dir):
    out = R.sigmoid_scores(lexical(spark, sf_dir).select("doc_id", F.col("score").alias("logit")), 1.5)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("best_rank_merge", f"""{_BM}, {_VEC}, m AS (SELECT coalesce(b.doc_id, v.doc_id) AS doc_id, coalesce(b.rank, 1073741824) AS x, coalesce(v.rank, 1073741824) AS y FROM bm b FULL JOIN ve v ON b.doc_id = v.doc_id)
SELECT doc_id, row_number() OVER (ORDER BY least(x, y), greatest(x, y), x, doc_id)::INT AS rank, least(x, y)::INT AS best FROM m""")
def best_rank_merge(spark, sf_dir):
    return R.best_rank_merge(lexical(spark, sf_dir), vector(spark, sf_dir), "doc_id")


@query("recall_filter", "SELECT doc_id FROM documents WHERE source LIKE 'src1%' AND lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 5000")
def recall_filter_query(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source", "lang", "n_chars")
    return recall_filter(d, folder="src1", folder_col="source", types=["en", "de"], type_col="lang", ranges={"n_chars": (200, 5000)}).select("doc_id")


_ROLE = "CASE lang WHEN 'en' THEN 'knowledge' WHEN 'de' THEN 'source' WHEN 'fr' THEN 'inference' ELSE 'ignored' END"


@query("assemble_pages", f"""{_BM}, h AS (SELECT d.source, b.score, CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.85 WHEN 'fr' THEN 0.6 ELSE 1.0 END::DOUBLE AS f FROM bm b JOIN documents d USING (doc_id))
SELECT source, round(max(score * f), 6) AS score, max(score) AS raw, count(*)::BIGINT AS hits FROM h GROUP BY 1""")
def assemble_pages(spark, sf_dir):
    role = F.when(F.col("lang") == "en", "knowledge").when(F.col("lang") == "de", "source").when(F.col("lang") == "fr", "inference").otherwise("ignored")
    meta = docs(spark, sf_dir, "doc_id", "source", "lang").withColumn("role", role)
    out = R.group_hits(lexical(spark, sf_dir).join(meta, "doc_id"), "source")
    return out.withColumn("score", F.round("score", 6))


@query("budget_fill", f"""WITH RECURSIVE {_BM[5:]}, c AS (SELECT b.rank, b.doc_id, (ceil(length(text) / 4) + 24)::BIGINT AS cost FROM bm b JOIN documents USING (doc_id)),
r AS (SELECT rank, doc_id, cost AS used, true AS taken FROM c WHERE rank = 1 UNION ALL
 SELECT c.rank, c.doc_id, CASE WHEN r.used + c.cost <= 4000 THEN r.used + c.cost ELSE r.used END, r.used + c.cost <= 4000 FROM r JOIN c ON c.rank = r.rank + 1)
SELECT doc_id FROM r WHERE taken""")
def budget_fill(spark, sf_dir):
    cards = lexical(spark, sf_dir).join(docs(spark, sf_dir), "doc_id").select("rank", "doc_id", estimated_tokens(F.col("text")).alias("cost"))
    return R.fill_budget(cards, "doc_id", "cost", 4000)


@query("budget_stop", f"""{_BM}, c AS (SELECT b.rank, b.doc_id, (ceil(length(text) / 4) + 24)::BIGINT AS cost FROM bm b JOIN documents USING (doc_id)),
u AS (SELECT *, sum(cost) OVER (ORDER BY rank)::BIGINT AS used FROM c) SELECT doc_id, rank, cost, used FROM u WHERE used <= 6000 OR rank = 1""")
def budget_stop(spark, sf_dir):
    cards = lexical(spark, sf_dir).join(docs(spark, sf_dir), "doc_id").select("rank", "doc_id", estimated_tokens(F.col("text")).alias("cost"))
    return R.stop_budget(cards, "cost", 6000).select("doc_id", "rank", "cost", "used")


@query("coverage", f"""{_BM}, h AS (SELECT lower(text) AS t FROM bm JOIN documents USING (doc_id)), w AS (SELECT bool_or(contains(t, 'ontion')) AS a, bool_or(contains(t, 'thbl')) AS b, bool_or(contains(t, 'zzqx')) AS c FROM h)
SELECT 'ontion thbles' AS concept, a AND b AS covered FROM w UNION ALL SELECT 'zzqx ontion', c AND a FROM w""")
def coverage(spark, sf_dir):
    cards = lexical(spark, sf_dir).join(docs(spark, sf_dir), "doc_id")
    return R.coverage(cards, ["ontion thbles", "zzqx ontion", "of"], "text")


@query("light_stem", f"""WITH t AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS w FROM documents),
s AS (SELECT CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] WHEN length(w) > 3 AND w LIKE '%es' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS stem FROM t)
SELECT stem, count(*)::BIGINT AS words FROM s GROUP BY 1""")
def light_stem_query(spark, sf_dir):
    w = docs(spark, sf_dir).select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).distinct()
    return w.groupBy(light_stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("words"))


@query("content_overlap", """WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
 lambda x: length(x) > 2 AND x NOT IN ('the','and','for','with','are','was','were','been','has','have','had','this','that','these','those','its','from','usually','often','always','each','every','they','them','their','our','she','his','her','you','your','user','users'))) AS w FROM benchmark),
p AS (SELECT a.item_id AS x, b.item_id AS y, len(list_intersect(a.w, b.w)) AS s, least(len(a.w), len(b.w)) AS m FROM w a JOIN w b ON a.item_id < b.item_id)
SELECT x, y, round(s / m, 6) AS share FROM p WHERE m >= 3 AND s / m >= 0.25""")
def content_overlap(spark, sf_dir):
    """The stated benchmark items against each other, through their shared words."""
    w = read(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", content_words(F.col("text")).alias("w"))
    e = w.select("item_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    a, b = (e.select(F.col("item_id").alias(i), F.col("n").alias(f"n{i}"), "t") for i in ("x", "y"))
    shared = a.join(b, "t").filter("x < y").groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("s"))
    small = F.least("nx", "ny")
    return shared.filter((small >= 3) & (F.col("s") / small >= 0.25)).select("x", "y", F.round(F.col("s") / small, 6).alias("share"))


@query("mixed_order", f"""{_RRF}, t AS (SELECT rr.*, doc_id % 2 = 0 AS page FROM rr), k AS (SELECT * FROM t WHERE rank <= 8),
alt AS (SELECT * FROM t WHERE rank > 8 AND page <> (SELECT first(page) FROM k) AND coalesce(relevance, 1) >= 0.1 ORDER BY rank LIMIT 1), one AS (SELECT count(DISTINCT page) = 1 AND (SELECT count(*) FROM alt) = 1 AS sw FROM k)
SELECT doc_id, rank FROM k, one WHERE NOT sw OR rank < 8 UNION ALL SELECT doc_id, rank FROM alt, one WHERE sw""")
def mixed_order(spark, sf_dir):
    """The best of the other type takes the last slot where all slots hold one type."""
    hits = hybrid(spark, sf_dir).withColumn("page", F.col("doc_id") % 2 == 0)
    return R.mixed_order(hits, "page", least=0.1).select("doc_id", "rank")


@query("line_overlap", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), w AS (SELECT doc_id, list_distinct(list_transform({_TOK.format('t')}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] WHEN length(w) > 3 AND w LIKE '%es' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)) AS s FROM l)
SELECT doc_id, max(len(list_intersect(s, ['ontion', 'erth', 'thbl'])))::INT AS best FROM w GROUP BY 1""")
def line_overlap(spark, sf_dir):
    """Each document's line with most of the query's terms."""
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return lines.groupBy("doc_id").agg(F.max(term_overlap(F.col("t"), ["the ontion of erth", "thbles"])).alias("best"))


@query("activation", f"""{_RRF}, a AS (SELECT doc_id, rank, CASE WHEN doc_id % 50 = 0 AND relevance IS NOT NULL THEN 'exact' WHEN relevance * 2 >= 0.9 AND doc_id % 3 > 0 THEN 'strong' WHEN arms >= 2 AND relevance * 2 >= 0.85 THEN 'dual' WHEN relevance * 2 >= 0.5 THEN 'plausible' ELSE 'none' END AS signal FROM rr)
SELECT doc_id, rank, signal FROM a""")
def activation(spark, sf_dir):
    r = F.col("relevance") * 2
    signal = R.activation(r, (F.col("doc_id") % 3).cast("double"), F.col("arms"), (F.col("doc_id") % 50 == 0) & F.col("relevance").isNotNull())
    return hybrid(spark, sf_dir).select("doc_id", "rank", signal.alias("signal"))


@query("clip_lines", """WITH l AS (SELECT doc_id, i, string_split(text, chr(10)) AS s FROM documents, range(1, 400) t(i) WHERE i <= len(string_split(text, chr(10)))), e AS (SELECT doc_id, s, max(i) FILTER (length(array_to_string(s[1:i], chr(10))) <= 600) AS k FROM l GROUP BY 1, 2)
SELECT doc_id, CASE WHEN k IS NULL THEN '' ELSE array_to_string(s[1:k], chr(10)) END AS clipped FROM e""")
def clip_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.clip_lines(F.col("text"), F.lit(600)).alias("clipped"))
