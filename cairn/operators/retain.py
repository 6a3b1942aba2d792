"""Retention: candidate memories of sources become memories with supports, holds and receipts, many sources in one job."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import attribute_value, numbers
from cairn.operators.evidence import replay

#: Fixed value: the most supports of one memory.
MOST_SUPPORTS = 8
#: Tasks that share the candidates of one memory.
SALTS = 32

#: Tables of the state, as a store keeps them.
SCHEMAS = {
    "receipts": "source_id string, revision string, request string, receipt string",
    "memories": "memory_id string, slug string, payload string, semantics string",
    "supports": "source_id string, revision string, receipt string, candidate string, proof_group string, memory_id string, retracted_by string",
    "holds": "kind string, source_id string, revision string, earlier string, deciding string",
}
_ID = ["source_id", "revision", "candidate"]
#: What becomes of a candidate that is not empty; the last that applies holds.
_MARKS = ["support_limit", "conflict", "relation", "support_added", "written"]


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(p, F.lit("\x01")) for p in parts)), 256)


def _proof_group() -> Column:
    return _hash(F.lit("proof"), F.coalesce("source_group", "source_id"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str], most: int, name: str) -> DataFrame:
    """The first ``most`` rows of each key with their number. A hot key is cut in SALTS tasks before its rows meet."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    few = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_n") <= most).drop("_n", "_salt")
    return few.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def retained_closure(plain: DataFrame, links: DataFrame, save) -> DataFrame:
    """Ids of those rows with links (ids, _to) whose related candidates of the same source all stay too.

    Rows without relations (plain: ids) stay; they meet the links once, and the rounds after that
    read open links only. A round adds those whose targets all stay. What is in a circle, or
    relates to nothing, never does. A round writes one table; rounds end when none adds a row.
    """
    to = ["source_id", "revision", "_to"]
    targets = lambda ids: ids.select("source_id", "revision", F.col("candidate").alias("_to"))
    met, out = targets(plain).join(links.select(*to).distinct().hint("shuffle_hash"), to, "left_semi"), []
    # structs, so that a relation to null stays open
    left = F.collect_list(F.when(F.col("_met").isNull(), F.struct("_to")))
    while True:
        step = save(links.join(met.withColumn("_met", F.lit(True)), to, "left").groupBy(*_ID).agg(left.alias("_left")))
        fresh = step.filter(F.size("_left") == 0).select(*_ID)
        out.append(fresh)
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, out)
        links, met = step.filter(F.size("_left") > 0).select(*_ID, F.inline("_left")), targets(fresh)


def _told(payload: Column) -> tuple[Column, Column]:
    """(attribute and value, its numbers) of a payload; the patterns are only tried where there is one of their signs."""
    value = lambda told: F.nullif(F.array_join(numbers(told["value"]), ","), F.lit(""))
    return F.when(payload.contains(":") | payload.contains("|"), attribute_value(payload)), value


def judge(state: Mapping[str, DataFrame], sources: DataFrame, candidates: DataFrame, save) -> dict[str, DataFrame]:
    """Outcome and reason of every candidate (``results``) as plan() states them, and the tables that plan() goes on from.

    Candidates are written once, with what their text tells. After that only those with relations
    or numbers, the first ones of each memory and those of corrections are dealt out or written.
    """
    # sources keep their columns through the replay; digests that only new rows need are made with these
    asked = replay(state["receipts"], sources, ["source_id", "revision"], "request", "at", ["source_group", "retracts"]).withColumnRenamed("outcome", "_asked")
    known = state["supports"].groupBy("source_id").agg(F.min("proof_group").alias("_known"))
    other = (F.col("_asked") == "accepted") & (F.col("_known") != _proof_group())
    src = save(asked.join(known, "source_id", "left").withColumn("_asked", F.when(other, "conflict").otherwise(F.col("_asked"))).drop("_known"))
    live = src.filter("_asked = 'accepted'")

    active = state["supports"].filter("retracted_by IS NULL")
    corrections = live.filter("retracts IS NOT NULL").select("source_id", F.col("revision").alias("_by"), F.col("retracts").alias("revision"))
    removed = save(active.join(corrections, ["source_id", "revision"]))

    # of a source and revision one request at most is accepted
    c = candidates.join(live.select("source_id", "revision", F.col("retracts").isNotNull().alias("_fixes")), ["source_id", "revision"])
    c = c.select(*_ID, "ord", "slug", "text", "semantics", "relations", "_fixes", F.row_number().over(Window.partitionBy(*_ID).orderBy("ord")).alias("_nth"))
    c = c.withColumn("payload", F.trim(F.regexp_replace("text", r"\s+", " "))).drop("text")
    told, value = _told(F.col("payload"))
    fit = F.coalesce((F.col("payload") != "") & (F.col("slug") != ""), F.lit(False))
    linked = F.size(F.coalesce("relations", F.array().cast("array<string>"))) > 0
    memory = F.concat(F.lit("mem_"), F.left(_hash(F.col("slug"), F.col("payload"), F.col("semantics")), F.lit(24)))
    c = c.withColumns({"memory_id": memory, "_told": told, "_ok": fit & (F.col("_nth") == 1), "_linked": linked})
    c = save(c.withColumns({"_a": F.col("_told.attribute"), "_v": value(F.col("_told"))}).drop("_told"))

    # rows that stay: those without relations as they are, of the others those whose relations stay
    cols = [*_ID, "ord", "memory_id", "_linked"]
    some, rest = save(c.filter("_linked OR _v IS NOT NULL").drop("payload", "semantics")), c.filter("NOT _linked AND _v IS NULL")
    links = some.filter("_ok AND _linked").select(*_ID, F.explode(F.array_distinct("relations")).alias("_to"))
    kept = retained_closure(c.filter("_ok AND NOT _linked").select(*_ID), links, save)
    stayed = save(some.filter("_ok AND _linked").select(*cols, "slug", "_a", "_v").join(kept, _ID))

    # one row for each page and attribute: the least and greatest number there, and the first candidate's
    m, v = _told(F.col("payload"))
    there = state["memories"].select("slug", m["attribute"].alias("_a"), v(m).alias("_v")).filter("_v IS NOT NULL").groupBy("slug", "_a").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    order = F.struct("source_id", "revision", "ord")
    valued = save(some.filter("_ok AND NOT _linked").select(*cols, "slug", "_a", "_v").unionByName(stayed.filter("_v IS NOT NULL")))
    facts = save(valued.groupBy("slug", "_a").agg(F.min_by("_v", order).alias("_first")).join(there, ["slug", "_a"], "left"))
    old_ids = state["memories"].select("memory_id", F.lit(True).alias("_there"))
    known = save(valued.select("memory_id").distinct().join(old_ids, "memory_id"))
    own = F.col("_v")
    other = F.col("_there").isNull() & ((F.coalesce(F.col("_lo"), own) != own) | (F.coalesce(F.col("_hi"), own) != own) | (F.coalesce(F.col("_lo"), F.col("_first")) != own))
    valued = save(valued.join(facts, ["slug", "_a"]).join(known, "memory_id", "left").select(*cols, other.alias("_other")))

    # the first ones of each memory, and which of them stay
    of = lambda rows, has: rows.select(*cols, F.lit(has).alias("_valued"))
    asking = of(rest.filter("_ok"), False).unionByName(of(stayed.filter("_v IS NULL"), False)).unionByName(of(valued.filter("NOT _other"), True))
    ranked = first_rows(asking, ["memory_id"], ["source_id", "revision", "ord"], MOST_SUPPORTS, "_rank").drop("ord")
    counts = active.groupBy("memory_id").agg(F.count(F.lit(1)).alias("_n0"))
    ranked = ranked.join(counts, "memory_id", "left").filter(F.col("_rank") + F.coalesce("_n0", F.lit(0)) <= MOST_SUPPORTS).drop("_n0")
    ranked = save(ranked.join(old_ids, "memory_id", "left"))
    single, tied = ranked.filter("NOT _linked"), ranked.filter("_linked")
    kept = retained_closure(single, links.join(tied.select(*_ID), _ID, "left_semi"), save).withColumn("_kept", F.lit(True))
    ranked = single.withColumn("_kept", F.lit(True)).unionByName(tied.join(kept, _ID, "left"))
    start = F.min(F.when(F.col("_kept") & F.col("_there").isNull(), F.col("_rank"))).over(Window.partitionBy("memory_id"))
    mark = F.when(F.col("_kept").isNull(), _MARKS.index("relation")).when(F.col("_rank") == F.col("_start"), _MARKS.index("written")).otherwise(_MARKS.index("support_added"))
    first = save(ranked.withColumn("_start", start).select(*_ID, "memory_id", "_there", "_linked", "_valued", mark.alias("_mark")))

    # every row with its mark: without relations and numbers only the first ones have another than the limit's
    marked = lambda rows, what: rows.select(*_ID, F.lit(_MARKS.index(what)).alias("_mark"))
    marks = marked(stayed, "support_limit").unionByName(marked(valued.filter("_other"), "conflict")).unionByName(first.filter("_linked OR _valued").select(*_ID, "_mark"))
    marks = save(marks.groupBy(*_ID).agg(F.max("_mark").alias("_mark")))
    mark = F.coalesce("_mark", F.when(F.col("_linked"), _MARKS.index("relation")).otherwise(_MARKS.index("support_limit")))
    word = F.when(F.col("_nth") > 1, "duplicate").when(~F.col("_ok"), "validation").otherwise(F.element_at(F.array(*map(F.lit, _MARKS)), mark + 1))
    made = F.col("_word").isin("duplicate", "written", "support_added")

    def outcomes(these):
        which = [*_ID, "ord", "memory_id", "_ok", "_nth", "_linked"]
        rows = rest.filter(these).select(*which).join(first.filter("NOT (_linked OR _valued)").select(*_ID, "_mark"), _ID, "left")
        rows = rows.unionByName(some.filter(these).select(*which).join(marks, _ID, "left")).select(*_ID, "ord", "memory_id", word.alias("_word"))
        return rows.select(*_ID, "ord", F.when(made, F.col("_word")).otherwise("held").alias("outcome"), F.when(~made, F.col("_word")).alias("reason"), "memory_id")

    # corrections: whole or not at all; only their candidates are judged before the results are read
    fixing = save(outcomes("_fixes"))
    found = removed.select("source_id", F.col("_by").alias("revision")).distinct().withColumn("_found", F.lit(True))
    sums = fixing.groupBy("source_id", "revision").agg(F.count_if(F.col("outcome") == "held").alias("_held"))
    whole = live.filter("retracts IS NOT NULL").select("source_id", "revision").join(found, ["source_id", "revision"], "left").join(sums, ["source_id", "revision"], "left")
    failed = save(whole.filter("_found IS NULL OR _held IS NULL OR _held > 0").select("source_id", "revision").withColumn("_failed", F.lit(True)))
    fixing = fixing.join(failed, ["source_id", "revision"], "left")
    fixing = fixing.withColumns({"reason": F.when(F.col("_failed") & (F.col("outcome") != "held"), "correction").otherwise(F.col("reason")), "outcome": F.when(F.col("_failed"), "held").otherwise(F.col("outcome"))}).drop("_failed")
    results = outcomes("NOT _fixes").unionByName(fixing)
    results = results.select("source_id", "revision", "candidate", "ord", "outcome", "reason", "memory_id")
    return {"results": results, "src": src, "removed": removed, "candidates": c, "first": first, "failed": failed}


def plan(state: Mapping[str, DataFrame], sources: DataFrame, candidates: DataFrame, save) -> dict[str, DataFrame]:
    """What retaining sources and their candidates does to a state: rows to append, supports retracted, and results.

    sources: source_id, revision, request (digest of the request), source_group, retracts (an
    earlier revision whose supports go, or null), at. candidates: source_id, revision, candidate,
    ord, slug, text, semantics, subject, relations (candidates of the same source).

    A source whose revision has a receipt is a replay, or a conflict where the request differs,
    and changes nothing; one whose group is not that of its earlier supports is a conflict. A
    candidate is held if it is empty or has no page (validation), relates to one that is not
    retained (relation), tells another number for an attribute of its page than a memory there
    or an earlier candidate (conflict), or comes after MOST_SUPPORTS of its memory (support_limit).
    Others are written, or add a support to the memory of the same page, payload and semantics.
    A correction is made whole or not at all: if nothing that it retracts is found, or any of its
    candidates is held, all are, and what it would retract is held until it is decided. A new
    memory that tells another number than an earlier one of its proof group on another page holds
    that one as deciding. Earlier means by (source_id, revision, ord); candidates that a
    correction holds keep their places in that order.

    ``save`` writes an intermediate table; the plan reads several of them more than once.
    Returns results, sources, and the rows to append to each table, with ``supports`` whole.
    """
    none = F.lit(None).cast("string")
    of = judge(state, sources, candidates, save)
    src, removed, failed = of["src"], of["removed"], of["failed"]
    src = src.withColumns({"receipt": _hash(F.lit("receipt"), F.col("source_id"), F.col("revision"), F.col("request")), "proof_group": _proof_group()})
    live = src.filter("_asked = 'accepted'")
    active = state["supports"].filter("retracted_by IS NULL")
    gone = removed.select("source_id", F.col("revision").alias("_old"), "candidate", F.col("_by")).distinct()

    # at most MOST_SUPPORTS of a memory
    done = of["first"].filter(F.col("_mark") >= _MARKS.index("support_added")).select(*_ID, "_there").join(failed, ["source_id", "revision"], "left_anti")
    done = of["candidates"].filter("_ok").select(*_ID, "slug", "payload", "semantics", "memory_id", "_a", "_v").join(done, _ID)
    done = save(done.join(live.select("source_id", "revision", "receipt", "proof_group").distinct(), ["source_id", "revision"]))

    supports = done.select("source_id", "revision", "receipt", "candidate", "proof_group", "memory_id", none.alias("retracted_by"))
    made = done.filter("_there IS NULL").groupBy("memory_id").agg(F.first("slug").alias("slug"), F.first("payload").alias("payload"), F.first("semantics").alias("semantics"))
    applied = gone.join(failed.select("source_id", F.col("revision").alias("_by")), ["source_id", "_by"], "left_anti").groupBy("source_id", F.col("_old").alias("revision"), "candidate").agg(F.min("_by").alias("_by"))
    old = state["supports"].join(applied, ["source_id", "revision", "candidate"], "left").withColumn("retracted_by", F.coalesce("retracted_by", "_by")).drop("_by")
    pending = removed.join(failed.select("source_id", F.col("revision").alias("_by")), ["source_id", "_by"]).select(F.lit("pending_correction").alias("kind"), "source_id", F.col("_by").alias("revision"), F.col("memory_id").alias("earlier"), none.alias("deciding"))
    earlier = active.join(applied.select("source_id", "revision", "candidate"), ["source_id", "revision", "candidate"], "left_anti").select("proof_group", "memory_id").distinct()
    m, v = _told(F.col("payload"))
    earlier = earlier.join(state["memories"].select("memory_id", F.col("slug").alias("_slug"), m["attribute"].alias("_a"), v(m).alias("_old")), "memory_id").filter("_old IS NOT NULL")
    fresh = done.filter("_v IS NOT NULL").select("proof_group", "_a", "_v", "slug", F.col("memory_id").alias("_new"), "source_id", "revision").distinct()
    met = earlier.join(fresh, ["proof_group", "_a"]).filter("_old <> _v AND _slug <> slug")
    deciding = met.groupBy("memory_id").agg(F.min(F.struct("source_id", "revision", "_new")).alias("_x")).select(F.lit("deciding").alias("kind"), "_x.source_id", "_x.revision", F.col("memory_id").alias("earlier"), F.col("_x._new").alias("deciding"))

    held, made_ = F.count_if(F.col("outcome") == "held"), F.count_if(F.col("outcome").isin("written", "support_added"))
    results = save(of["results"])
    sums = results.groupBy("source_id", "revision").agg(held.alias("_held"), made_.alias("_done"))
    verdict = src.join(sums, ["source_id", "revision"], "left").join(failed, ["source_id", "revision"], "left")
    state_of = F.when(F.col("_asked") != "accepted", F.col("_asked")).when(F.col("_failed"), "held").when(F.col("_done") > 0, "ok").when(F.col("_held") > 0, "held").otherwise("noop")
    verdict = save(verdict.select("source_id", "revision", "request", "receipt", "at", state_of.alias("outcome")))
    return {
        "results": results,
        "sources": verdict.select("source_id", "revision", "at", "outcome"),
        "receipts": verdict.filter("outcome IN ('ok', 'noop')").select("source_id", "revision", "request", "receipt"),
        "memories": made,
        "supports": old.select(*(x.split()[0] for x in SCHEMAS["supports"].split(", "))).unionByName(supports),
        "holds": pending.distinct().unionByName(deciding),
    }


def retain(store, sources: DataFrame, candidates: DataFrame, tries: int = 3) -> tuple[int, DataFrame]:
    """Plan against the store's newest version and commit all tables at once; (version, results). Planned anew where another commit came first."""
    from cairn.plans.store import Conflict

    for left in range(tries - 1, -1, -1):
        base = store.version()
        state = {name: store.table(name, base, schema) for name, schema in SCHEMAS.items()}
        new = plan(state, sources, candidates, store.keep)
        try:
            version = store.commit(base, replace={"supports": new["supports"]}, append={k: new[k] for k in ("receipts", "memories", "holds", "results", "sources")})
        except Conflict:
            if not left:
                raise
            continue
        return version, new["results"]
    raise AssertionError
