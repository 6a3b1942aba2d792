"""Named operations: one result envelope each, over DataFrame plans. Only bounded lists come to the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import estimated_tokens, match_terms
from cairn.operators import graph as G
from cairn.operators import maintenance as M
from cairn.operators import retrieval as R
from cairn.operators import temporal as T
from cairn.operators.filters import recall_filter

#: Wording that tells what kind of answer a query wants.
EXPLORE = ("anything about", "everything about", "all about", "what do we know", "what do you know", "tell me about", "overview of", "summarize", "summarise", "remind me about")
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which", "whose", "whom", "is", "are", "was", "were", "do", "does", "did", "can", "could", "should", "would", "will", "have", "has", "am")
VIEW_WORDS = (
    ("reports", r"\b(said|says|told|reported|according to)\b"),
    ("questions", r"\b(open questions?|unanswered|what did .* ask)\b"),
    ("discussion", r"\b(considered|discussed|proposed|alternatives?|hypothe\w+)\b"),
    ("history", r"\b(used to|previously|formerly|history of|rejected|cancelled)\b"),
    ("planning", r"\b(plans?|planned|upcoming|scheduled|next steps?)\b"),
)


@dataclass
class Envelope:
    """status ok, empty, degraded or unavailable; degraded and unavailable carry reasons."""

    status: str
    rows: list[dict[str, Any]] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)
    info: dict[str, Any] = field(default_factory=dict)


def infer_mode(query: str) -> str:
    """lookup, question or explore, from a query's wording."""
    q = query.strip().lower()
    if any(m in q for m in EXPLORE):
        return "explore"
    words = q.rstrip("?!.").split()
    if q.endswith("?") or (words and words[0] in QUESTION_WORDS and len(words) >= 3):
        return "question"
    return "question" if re.match(r"(do|does|did|is|are|was|were|can|should|will)\s+(i|we|you|they|he|she|it|the)\b", q) else "lookup"


def infer_view(query: str) -> str:
    """The memory view a query's wording asks for; factual if none."""
    q = query.lower()
    return next((v for v, p in VIEW_WORDS if re.search(p, q)), "factual")


def split_parts(query: str, most: int = 3) -> list[str]:
    """Parts joined by and or &, if each has a word to search for."""
    parts = [p.strip() for p in re.split(r"\s+(?:and|&)\s+", query) if p.strip()]
    return parts if 1 < len(parts) <= most and all(match_terms(p) for p in parts) else [query]


def concepts(query: str, most: int = 5) -> list[str]:
    """Pairs of neighbouring content words."""
    words = [w for w in match_terms(query) if len(w) > 2]
    return [" ".join(words[i : i + 2]) for i in range(0, len(words), 2)][:most]


def recall(
    docs: DataFrame,
    query: str,
    key: str = "doc_id",
    text: str = "text",
    vectors: DataFrame | None = None,
    query_vector: Sequence[float] | None = None,
    filters: dict | None = None,
    limit: int = R.CARDS,
    budget: int = 4000,
    index: tuple[DataFrame, DataFrame] | None = None,
    arms: Sequence[DataFrame] = (),
    expand: Callable[[str], Sequence[str]] | None = None,
    judge: Callable[[str, DataFrame], DataFrame] | None = None,
    states: DataFrame | None = None,
    kind: str | None = None,
) -> Envelope:
    """Ranked evidence cards within a token budget: arms, view, fusion, rerank, kinds, budget, coverage.

    The lexical arm reads ``index``, a written (postings, statistics) pair, or else the texts.
    ``arms`` are further rankings (key, rank, relevance if known), such as fact_chunks() and
    graph_arm(). ``expand`` gives more wordings, ``judge`` new scores (key, new_score) of the
    rerank window's rows. With ``states`` (key, state) only eligible rows are searched, and the
    contextual ones where those have nothing. ``kind`` names the column of a row's type, of
    which the cards then hold both if both are fit.
    """
    mode = infer_mode(query)
    limit = limit * 2 if mode == "explore" else limit
    wordings = R.distinct_queries([*split_parts(query), *(expand(query) if expand else ())])
    some = recall_filter(docs, **filters) if filters else None
    reasons = ["no_vectors"] if query_vector is not None and vectors is None else []

    def hits_of(allowed: DataFrame | None) -> DataFrame:
        only = lambda df: df if allowed is None else df.join(allowed.select(key), key, "left_semi")
        if index is None:
            every = [R.bm25(docs, w, {text: 1.0}, key, allowed=allowed) for w in wordings]
        else:
            every = [R.search_postings(*index, match_terms(w), key, allowed=allowed) for w in wordings]
        if vectors is not None and query_vector is not None:
            every.append(R.vector_top(only(vectors), query_vector, key))
        every += [only(a) for a in arms]
        return R.fuse(every, key, scores=True)

    selection = None
    if states is None:
        hits = hits_of(some)
    else:
        base = docs.select(key) if some is None else some.select(key)
        for selection in ("eligible", "contextual"):
            hits = hits_of(base.join(states.filter(F.col("state") == selection).select(key), key, "left_semi"))
            if not hits.isEmpty():
                break
    if judge is not None:
        window = R.rerank_window(hits.withColumn("relevance", F.col("relevance") if "relevance" in hits.columns else F.lit(None).cast("double")), key, limit)
        judged = judge(query, window.join(docs.select(key, text), key))
        hits = R.ranked(R.tail_rescale(hits, judged, key), "score", key, R.ARM_LIMIT)
    if kind is not None:
        typed = hits.join(docs.select(key, kind), key)
        hits = R.mixed_order(typed if "relevance" in typed.columns else typed.withColumn("relevance", F.lit(None).cast("double")), kind, limit).drop(kind)
    hits = hits.orderBy("rank").limit(limit)
    cards = R.normalise(hits).join(docs.select(key, text), key).withColumn("cost", estimated_tokens(F.col(text)))
    kept = cards.join(R.fill_budget(cards, key, "cost", budget), key, "left_semi").orderBy("rank")
    rows = [r.asDict() for r in kept.collect()]  # at most ``limit`` cards
    wanted = concepts(query)
    covered = {c: all(R.light_stem_of(w) in " ".join(r[text].lower() for r in rows) for w in c.split()) for c in wanted}
    status = "degraded" if reasons else "ok" if rows else "empty"
    return Envelope(status, rows, reasons, {"mode": mode, "view": infer_view(query), "coverage": covered} | ({"selection": selection} if selection else {}))


def read(pages: DataFrame, key: str, value, links: DataFrame | None = None, from_line: int = 1, to_line: int | None = None) -> Envelope:
    """One page with its lines, links and backlinks."""
    rows = pages.filter(F.col(key) == value).limit(2).collect()
    if not rows:
        return Envelope("empty")
    if len(rows) > 1:
        return Envelope("unavailable", reasons=["duplicate_id"])
    page = rows[0].asDict()
    lines = str(page.get("text") or "").split("\n")[from_line - 1 : to_line]
    info: dict[str, Any] = {"lines": list(enumerate(lines, from_line))}
    if links is not None:
        info["links"] = [r.asDict() for r in links.filter(F.col("from_page") == value).limit(500).collect()]
        info["backlinks"] = [r[0] for r in links.filter(F.col("to_slug") == str(value)).select("from_page").distinct().limit(500).collect()]
    return Envelope("ok", [page], info=info)


def list_pages(pages: DataFrame, order: str = "slug", limit: int = 100, **filters) -> Envelope:
    """Pages by slug, or largest or latest first."""
    by = {"slug": [F.col("slug")], "bytes": [F.col("bytes").desc(), F.col("slug")], "updated": [F.col("updated_at").desc(), F.col("slug")]}[order]
    rows = [r.asDict() for r in recall_filter(pages, **filters).orderBy(*by).limit(limit).collect()]
    return Envelope("ok" if rows else "empty", rows)


def list_folders(pages: DataFrame, path: str, parent: str = "", limit: int = 500) -> Envelope:
    rows = [r.asDict() for r in M.folder_counts(pages, path, parent).orderBy("child").limit(limit).collect()]
    return Envelope("ok" if rows else "empty", rows)


def timeline(rows: DataFrame, as_of: str, since: str | None = None, until: str | None = None, order: str = "newest", limit: int = 100, scope: str | None = None, match: str | None = None) -> Envelope:
    """Entries of a range with their clock relation, facet counts over all that match, and one page of them."""
    at = F.lit(as_of).cast("timestamp")
    hit = rows.filter(T.overlaps(since, until)).withColumn("clock_relation", T.classify(at)).withColumn("source_kind", T.source_kind(F.col("relation")))
    scopes = {"future": ("future", "overdue"), "past": ("past",), "today": ("today", "current_period", "ongoing"), "undated": ("undated",)}
    if scope:
        hit = hit.filter(F.col("clock_relation").isin(*scopes[scope]))
    if match:
        hit = hit.filter(F.contains(F.lower("summary"), F.lit(match.lower())))
    counts = [r.asDict() for r in T.facets(hit, ["clock_relation", "source_kind"]).collect()]
    page = [r.asDict() for r in hit.orderBy(*T.sort_key(order, at)).limit(limit).collect()]
    return Envelope("ok" if page else "empty", page, info={"facets": counts})


def graph(edges: DataFrame, names: DataFrame, query: str, hops: int = 2, limit: int = G.PATHS) -> Envelope:
    """Bounded paths from the one entity that the query names exactly; an ambiguous name abstains."""
    mention = edges.sparkSession.createDataFrame([(query,)], "mention string")
    found = G.resolve(mention, names, "mention").first()
    if found["resolution"] != "exact":
        return Envelope("empty", reasons=[found["resolution"]])
    seed = edges.sparkSession.createDataFrame([(found["entity"],)], "seed string")
    rows = [r.asDict() for r in G.traverse(edges, seed, hops=hops, limit=limit).collect()]
    return Envelope("ok" if rows else "empty", rows, info={"truncated": len(rows) == limit})


def context(docs: DataFrame, query: str, pinned: Sequence = (), budget: int = 4000, key: str = "doc_id", text: str = "text") -> Envelope:
    """Pinned pages first, then recall with what is left of the budget."""
    pins = [r.asDict() for r in docs.filter(F.col(key).isin(*pinned)).select(key, text).collect()] if pinned else []
    used, kept = 0, []
    for p in pins:
        cost = -(-len(p[text]) // 4) + 24
        if not kept or used + cost <= budget:
            kept.append(p)
            used += cost
    more = recall(docs.filter(~F.col(key).isin(*pinned)) if pinned else docs, query, key, text, budget=max(0, budget - used))
    return Envelope("ok" if kept or more.rows else "empty", kept + more.rows, more.reasons, more.info | {"pinned": len(kept)})


def doctor(checks: dict) -> Envelope:
    """Health counters."""
    rows = [r.asDict() for r in M.health(checks).collect()]
    return Envelope("ok", rows)
