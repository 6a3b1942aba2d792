"""Ranked retrieval: BM25, cosine, reciprocal rank fusion, rerank windows, budgets, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import light_stem_of, match_terms, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Limits of one arm, rank constant of the fusion, cards.
ARM_LIMIT, RRF_K, CARDS = 60, 60, 8
ROLE_FACTORS = {"knowledge": 1.0, "source": 0.85, "inference": 0.6}


def ranked(df: DataFrame, score: str, key: str, limit: int, name: str = "rank") -> DataFrame:
    """The ``limit`` best rows numbered from 1, ties by key. Only those rows meet in one task."""
    top = df.orderBy(F.col(score).desc(), F.col(key)).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))))


def bm25(docs: DataFrame, query: str, fields: dict[str, float], key: str, limit: int = ARM_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score, rank): Robertson BM25 of the query's terms and its phrase over weighted fields.

    Term counts come from the field's token array, in one scan without a shuffle of tokens;
    numbers of documents and lengths are one aggregation row. ``allowed`` keys restrict what is
    ranked before the limit, not the statistics. A query without terms matches nothing.
    """
    terms = match_terms(query)
    words = [w for t in terms for w in t.replace("'", " ").replace("-", " ").split() if len(w) > 1]
    if not words:
        return docs.limit(0).select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    uniq = list(dict.fromkeys(words))
    cols = {f: tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    held = docs.select(key, *(c.alias(f"_t_{f}") for f, c in cols.items()))
    count = lambda f, w: F.size(F.filter(f"_t_{f}", lambda t: t == w)).cast("double")

    def phrases(f):
        # blanks are doubled, so that an occurrence leaves its neighbours theirs
        row, one = F.concat(F.lit(" "), F.array_join(f"_t_{f}", "  "), F.lit(" ")), " " + "  ".join(words) + " "
        return (F.length(row) - F.length(F.replace(row, F.lit(one), F.lit("")))).cast("double") / len(one)

    weighted = lambda g: reduce(lambda x, y: x + y, (g(f) * wt for f, wt in fields.items()))
    tf = [weighted(lambda f, w=w: count(f, w)) for w in uniq]
    if len(words) > 1:
        tf.append(weighted(phrases))
    size = weighted(lambda f: F.size(f"_t_{f}").cast("double"))
    rows = held.select(key, size.alias("_len"), *(t.alias(f"_tf{i}") for i, t in enumerate(tf)))
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(tf))))
    idf = [F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(LEAST_IDF)) for i in range(len(tf))]
    part = [idf[i] * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))) for i in range(len(tf))]
    hit = rows.filter(reduce(lambda x, y: x | y, (F.col(f"_tf{i}") > 0 for i in range(len(tf)))))
    if allowed is not None:
        hit = hit.join(allowed.select(key), key, "left_semi")
    scored = hit.crossJoin(F.broadcast(stats)).select(key, F.round(reduce(lambda x, y: x + y, part), 6).alias("score"))  # stats: one row
    return ranked(scored, "score", key, limit)


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Inverted index: (term, key, tf, len), to be written bucketed by term and read per query term."""
    held = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    exploded = held.select(key, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return exploded.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def term_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, cf) over all documents: one pass over sorted tokens that marks each document's first of a term."""
    held = docs.select(F.array_sort(tokens(F.coalesce(F.col(text), F.lit("")))).alias("_t"))
    marked = F.transform("_t", lambda t, i: F.struct(t.alias("term"), F.when((i == 0) | (F.get("_t", i - 1) != t), 1).otherwise(0).alias("first")))
    return held.select(F.explode(marked).alias("x")).groupBy("x.term").agg(F.sum("x.first").cast("long").alias("df"), F.count(F.lit(1)).alias("cf"))


def search_postings(index: DataFrame, stats: DataFrame, query: Sequence[str], key: str, limit: int = ARM_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 over a written index: only the postings of the query's terms are read. stats: one row (n, avg).

    ``allowed`` keys restrict what is ranked before the limit, not the statistics.
    """
    some = index.filter(F.col("term").isin(*query))
    n = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as query terms
    held = some if allowed is None else some.join(allowed.select(key), key, "left_semi")
    scored = held.join(F.broadcast(n), "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return ranked(scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")), "score", key, limit)


def cosine(x: Column, y: Column) -> Column:
    """Cosine in double precision; a zero norm counts as 1."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(x, y) / (one(F.sqrt(dot(x, x))) * one(F.sqrt(dot(y, y))))


def vector_top(vectors: DataFrame, query: Sequence[float], key: str, vec: str = "embedding", limit: int = ARM_LIMIT) -> DataFrame:
    """(key, score, rank, relevance): exact cosine top-k of one query vector; other dimensions are skipped."""
    q = F.array(*(F.lit(float(v)) for v in query))
    same = vectors.filter(F.size(vec) == len(query)).select(key, F.round(cosine(F.col(vec), q), 6).alias("score"))
    return ranked(same, "score", key, limit).withColumn("relevance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def fuse(arms: Sequence[DataFrame], key: str, k: int = RRF_K, scores: bool = False) -> DataFrame:
    """Reciprocal rank fusion of (key, rank, ...) arms: score is the sum of 1 / (k + rank), relevance the largest.

    With at most one arm that holds rows the arm passes through with its own scores, which
    ``scores`` asks for where the caller knows that. Ties: key.
    """
    if scores and len(arms) == 1:
        return arms[0]
    every = reduce(DataFrame.unionByName, (a.select(key, "rank", (F.col("relevance") if "relevance" in a.columns else F.lit(None).cast("double")).alias("relevance"), F.lit(i).alias("arm")) for i, a in enumerate(arms)))
    out = every.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + k)), 9).alias("score"), F.max("relevance").alias("relevance"), F.count(F.lit(1)).alias("arms"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key))))


def rerank_window(hits: DataFrame, key: str, k: int) -> DataFrame:
    """Of ranked hits the first k - 1, and the most relevant of ranks k to 2k (the first of equals; the k-th where none tells)."""
    fixed = hits.filter(F.col("rank") < k)
    edge = hits.filter((F.col("rank") >= k) & (F.col("rank") <= 2 * k))
    best = edge.orderBy(F.col("relevance").desc_nulls_last(), "rank").limit(1)
    return fixed.unionByName(best)


def tail_rescale(hits: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Judged rows by their new score; the others after them, pressed below the least judged score: floor * (n - i) / (n + 1)."""
    low = judged.agg(F.min("new_score").alias("floor"))
    tail = hits.join(judged.select(key), key, "left_anti")
    order = Window.orderBy("rank")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    pressed = tail.crossJoin(F.broadcast(low)).select(key, (F.col("floor") * (n - (F.row_number().over(order) - 1)) / (n + 1)).alias("score"), F.lit(False).alias("judged"))
    return judged.select(key, F.col("new_score").alias("score"), F.lit(True).alias("judged")).unionByName(pressed)


def normalise(hits: DataFrame) -> DataFrame:
    """Scores over the best score, of a bounded list of hits."""
    return hits.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy()))


def sigmoid_scores(hits: DataFrame, offset: float = 0.0, least: float = 0.5) -> DataFrame:
    """Native rerank scores: sigmoid of logit less offset; those below ``least`` go."""
    return hits.withColumn("score", 1 / (1 + F.exp(-(F.col("logit") - offset)))).filter(F.col("score") >= least)


def best_rank_merge(text: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """(key, rank): the better of two ranks; ties by the other rank, then by the text's, then by key."""
    x, y = (d.select(key, F.col("rank").alias(n)) for d, n in ((text, "_x"), (fact, "_y")))
    far = F.lit(1 << 30)
    m = x.join(y, key, "full").select(key, F.coalesce("_x", far).alias("x"), F.coalesce("_y", far).alias("y"))
    order = Window.orderBy(F.least("x", "y"), F.greatest("x", "y"), "x", key)
    return m.select(key, F.row_number().over(order).alias("rank"), F.least("x", "y").alias("best"))


def group_hits(hits: DataFrame, owner: str, role: str = "role") -> DataFrame:
    """Hits by owner: best score and relevance, scaled by the role's factor (1 for other roles)."""
    factor = F.lit(1.0)
    for name, by in ROLE_FACTORS.items():
        factor = F.when(F.col(role) == name, by).otherwise(factor)
    return hits.groupBy(owner).agg(F.max(F.col("score") * factor).alias("score"), F.max("score").alias("raw"), F.count(F.lit(1)).alias("hits"))


def fill_budget(cards: DataFrame, key: str, cost: str, budget: int, group: Sequence[str] = ()) -> DataFrame:
    """Greedy budget in rank order: the first card always, an over-budget one is skipped and later ones may fit.

    A fold over each group's few cards in order; (group, key) of those admitted.
    """
    rows = cards.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("key"), F.col(cost).cast("long").alias("cost")))).alias("cards"))
    kind = f"struct<used:bigint,keys:array<{cards.schema[key].dataType.simpleString()}>>"
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().alias("keys")).cast(kind)

    def step(acc, c):
        fits = (F.size(acc["keys"]) == 0) | (acc["used"] + c["cost"] <= budget)
        return F.when(fits, F.struct((acc["used"] + c["cost"]).alias("used"), F.array_append(acc["keys"], c["key"]).alias("keys")).cast(kind)).otherwise(acc)

    return rows.select(*group, F.explode(F.aggregate("cards", zero, step, lambda a: a["keys"])).alias(key))


def stop_budget(cards: DataFrame, cost: str, budget: int, group: Sequence[str] = ()) -> DataFrame:
    """Cards in rank order until the first that goes over the budget; the first always."""
    run = F.sum(cost).over(Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return cards.withColumn("used", run).filter((F.col("used") <= budget) | (F.col("rank") == 1))


def coverage(cards: DataFrame, concepts: Sequence[str], text: str) -> DataFrame:
    """(concept, covered): whether every word of a concept, lightly stemmed, occurs somewhere in the cards."""
    words = {c: [light_stem_of(w) for w in c.lower().split() if len(w) > 2] for c in concepts}
    words = {c: w for c, w in words.items() if w}
    every = sorted({w for ws in words.values() for w in ws})
    low = F.lower(text)

    def held(w):
        cross = {"includ": "exclud", "exclud": "includ"}.get(w[:6])
        return low.contains(w) | low.contains(cross) if cross else low.contains(w)

    seen = cards.agg(*(F.coalesce(F.bool_or(held(w)), F.lit(False)).alias(f"w{i}") for i, w in enumerate(every)))
    pairs = F.array(*(F.struct(F.lit(c).alias("concept"), reduce(lambda x, y: x & y, (F.col(f"w{every.index(w)}") for w in ws)).alias("covered")) for c, ws in words.items()))
    return seen.select(F.explode(pairs).alias("x")).select("x.*")


#: Levels of activation: relevance and overlap of a strong hit, relevance of one that both arms found, of a plausible one.
STRONG, STRONG_OVERLAP, DUAL, PLAUSIBLE = 0.9, 0.5, 0.85, 0.5
#: Results that an automatic recall may add.
AUTOMATIC = 3


def activation(relevance: Column, overlap: Column, arms: Column, exact: Column) -> Column:
    """How surely a hit bears on a prompt: exact, strong, dual, plausible or none."""
    return (
        F.when(exact, "exact")
        .when((relevance >= STRONG) & (overlap >= STRONG_OVERLAP), "strong")
        .when((arms >= 2) & (relevance >= DUAL), "dual")
        .when(relevance >= PLAUSIBLE, "plausible")
        .otherwise("none")
    )


def automatic(hits: DataFrame, key: str, most: int = AUTOMATIC) -> DataFrame:
    """Of ranked hits with ``signal`` those that may be added unasked: exact ones if any, else strong and dual ones; at most ``most``."""
    fit = hits.withColumn("_exact", F.max((F.col("signal") == "exact").cast("int")).over(Window.partitionBy()))
    on = F.when(F.col("_exact") == 1, F.col("signal") == "exact").otherwise(F.col("signal").isin("strong", "dual"))
    return fit.filter(on).orderBy("rank", key).limit(most).drop("_exact")


def clip_lines(text: Column, budget: Column) -> Column:
    """The first whole lines that fit a budget of characters."""
    lines = F.split(text, "\n")
    kind = "struct<used:int,n:int>"
    zero = F.struct(F.lit(-1).alias("used"), F.lit(0).alias("n")).cast(kind)

    def step(acc, x):
        # past the first line that does not fit, used stays over the budget
        used = acc["used"] + F.length(x) + 1
        return F.struct(used.alias("used"), (acc["n"] + F.when(used <= budget, 1).otherwise(0)).alias("n")).cast(kind)

    return F.array_join(F.slice(lines, F.lit(1), F.aggregate(lines, zero, step, lambda a: a["n"])), "\n")


def mixed_order(hits: DataFrame, kind: str, limit: int = CARDS, least: float = 0.5) -> DataFrame:
    """The first ``limit`` ranked hits; where all are of one kind, the best fit hit of the other takes the last place.

    A hit is fit whose relevance reaches ``least`` or is unknown; both kinds need one, and the
    limit must be two or more. One scan gives a row for each kind, which decides.
    """
    if limit < 2:
        return hits.filter(F.col("rank") <= limit)
    fit = F.col("relevance").isNull() | (F.col("relevance") >= least)
    kinds = hits.groupBy(kind).agg(F.min(F.when(fit, F.col("rank"))).alias("_first"), F.count_if(F.col("rank") <= limit).alias("_in"))
    swap = kinds.agg((F.count_if(F.col("_in") > 0) == 1).alias("_one"), F.count("_first").alias("_fit"), F.min(F.when(F.col("_in") == 0, F.col("_first"))).alias("_rank"))
    swap = swap.select(F.when(F.col("_one") & (F.col("_fit") == 2), F.col("_rank")).alias("_alt"))  # one row
    kept = (F.col("rank") < limit) | ((F.col("rank") == limit) & F.col("_alt").isNull()) | F.coalesce(F.col("rank") == F.col("_alt"), F.lit(False))
    return hits.crossJoin(F.broadcast(swap)).filter(kept).drop("_alt")


def complete_rerank(entries: DataFrame, group: str, count: str) -> DataFrame:
    """(group, complete): whether a reranker gave every index from 0 to ``count`` - 1 once, with a finite score."""
    score = F.col("score").cast("double")
    good = F.coalesce((F.col("index") >= 0) & (F.col("index") < F.col(count)) & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf"))), F.lit(False))
    by = entries.groupBy(group).agg(F.max(count).alias("_n"), F.count(F.lit(1)).alias("_rows"), F.count_if(good).alias("_good"), F.count_distinct("index").alias("_ids"))
    return by.select(group, ((F.col("_rows") == F.col("_n")) & (F.col("_good") == F.col("_n")) & (F.col("_ids") == F.col("_n"))).alias("complete"))


def distinct_queries(queries: Sequence[str]) -> list[str]:
    """Queries in order, without blank ones and those that differ from an earlier one only by case or outer blanks."""
    first: dict[str, str] = {}
    for q in queries:
        if key := q.lower().strip():
            first.setdefault(key, q)
    return list(first.values())


def first_evidence(passes: Sequence, exact: str = "exact") -> tuple[int, DataFrame]:
    """The number and the hits of the first of several searches (functions without arguments) that finds exact evidence, else the last with hits.

    Meant for a view: eligible rows, the same rows as context, then the contextual rows. A
    later search is run only if it is needed.
    """
    best = None
    for i, search in enumerate(passes):
        hits = search()
        seen = hits.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(exact)).alias("k")).first()
        if seen["k"]:
            return i, hits
        if seen["n"] or best is None:
            best = (i, hits)
    return best
