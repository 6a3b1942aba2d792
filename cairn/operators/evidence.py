"""Facts, snapshots, lineage: supersession, renames, conflicts, replay, restrictions, journals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import comparable, conflicts, numbers
from cairn.operators.pairs import BLOCK, PART, blocks, cells


def diff_snapshot(old: DataFrame, new: DataFrame, key: str, quick: Sequence[str], content: str) -> DataFrame:
    """(key, change): added, removed, changed, touched or same.

    Rows whose quick columns (size, time) agree are the same without a look at their content
    hash; equal hashes under other quick columns are only touched. Without quick columns the
    hash decides.
    """
    o = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in (*quick, content)), F.lit(True).alias("_old"))
    both = o.join(new.select(key, *quick, content, F.lit(True).alias("_new")), key, "full")
    same = F.lit(True)
    for c in quick or [content]:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "same").when(F.col(content).eqNullSafe(F.col(f"_o_{content}")), "touched").otherwise("changed")
    return both.select(key, change.alias("change"))


def renames(gone: DataFrame, come: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """(old, new): vanished rows against arrived ones of equal content, one to one, in key order."""
    order = Window.partitionBy(*content).orderBy(key)
    a, b = (d.select(*content, F.col(key).alias(n), F.row_number().over(order).alias("_n")) for d, n in ((gone, "old"), (come, "new")))
    return a.join(b, [*content, "_n"]).select("old", "new")


def duplicates(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """(content, copies, first): contents that more than one row has."""
    return rows.groupBy(content.alias("content")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first")).filter("copies > 1")


def quarantine(pages: DataFrame, page_id: str, sha: str) -> DataFrame:
    """(page_id, reason): ids on more than one file, with equal or different bytes."""
    by = pages.groupBy(page_id).agg(F.count(F.lit(1)).alias("files"), F.count_distinct(sha).alias("bodies")).filter("files > 1")
    return by.select(page_id, "files", F.when(F.col("bodies") == 1, "duplicate_same_bytes").otherwise("duplicate_different_bytes").alias("reason"))


def supersede(facts: DataFrame, fresh: DataFrame, lines: DataFrame, today: str) -> DataFrame:
    """Facts after an index pass, with ``action`` keep, refresh, close, delete or insert.

    facts (id, line_hash, claim, valid_to), fresh (id, line_hash, claim) and lines (line_hash)
    now. A fact found again is refreshed; one whose source line is gone is closed today; one
    whose line is still there under another claim was rephrased and is deleted; closed facts
    stay as they are.
    """
    now = fresh.select("id", F.lit(True).alias("_again"))
    have = lines.select("line_hash").distinct().withColumn("_line", F.lit(True))
    old = facts.join(now, "id", "left").join(have, "line_hash", "left")
    action = F.when(F.col("valid_to").isNotNull() & F.col("_again").isNull(), "keep").when(F.col("_again"), "refresh").when(F.col("_line").isNull(), "close").otherwise("delete")
    kept = old.select("id", "line_hash", "claim", action.alias("action"), F.when(action == "close", F.lit(today).cast("date")).when(action == "refresh", F.lit(None).cast("date")).otherwise(F.col("valid_to")).alias("valid_to"))
    new = fresh.join(facts.select("id"), "id", "left_anti").select("id", "line_hash", "claim", F.lit("insert").alias("action"), F.lit(None).cast("date").alias("valid_to"))
    return kept.unionByName(new)


def cross_page_conflicts(facts: DataFrame, key: str = "id", page: str = "page", block: int = BLOCK) -> DataFrame:
    """Pairs of facts of one (subject, attribute) on different pages whose values conflict; each pair once.

    Equal values of a page are merged first, so a subject with many pages that agree makes no pairs.
    A value's numbers and core are found once a fact. Facts of a block that share them are one
    class, and classes that conflict meet by cells of two blocks, a few facts of one at a time.
    Each of these facts gets the ids of the other class, without its own page's and its own, as
    one array, and pairs are made of that alone: none are held.
    """
    of = ["subject", "attribute"]
    f = facts.groupBy(*of, page, "value").agg(F.min(key).alias("id"))
    f = f.select(*of, F.col(page).alias("_page"), "id", comparable(F.col("value")).alias("_core"), F.array_join(numbers(F.col("value")), ",").alias("_told")).filter("_told <> '' AND id IS NOT NULL AND _page IS NOT NULL")
    several = f.groupBy(*of).agg(F.min("_told").alias("_v0"), F.max("_told").alias("_v1"), F.min("_page").alias("_p0"), F.max("_page").alias("_p1"), blocks(F.count(F.lit(1)), block).alias("_blocks")).filter("_v0 <> _v1 AND _p0 <> _p1")
    f = f.join(several.select(*of, "_blocks"), of).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    group = [*of, "_blocks", "_block", "_core", "_told"]
    classes = f.groupBy(*group).agg(F.collect_list(F.struct("id", "_page")).alias("_facts"))
    few = classes.select(*group, F.explode(F.transform(F.sequence(F.lit(1), F.size("_facts"), F.lit(PART)), lambda k: F.slice("_facts", k, PART))).alias("_facts"))
    met = cells(few, classes.select(*group, F.col("_facts.id").alias("_ids"), F.col("_facts._page").alias("_pages")), of)
    met = met.filter("_a_told <> _b_told AND _a_core <> _b_core AND (NOT _same OR _a_told < _b_told)")
    shared = F.arrays_overlap("_a_facts._page", "_b_pages") | F.arrays_overlap("_a_facts.id", "_b_ids")
    met = met.select(*of, "_a_facts", "_b_ids", F.when(shared, F.arrays_zip("_b_ids", "_b_pages")).alias("_b_facts"))
    ones = met.select(*of, F.inline("_a_facts").alias("_id", "_page"), "_b_ids", "_b_facts")
    others = F.transform(F.filter("_b_facts", lambda o: (o["_b_pages"] != F.col("_page")) & (o["_b_ids"] != F.col("_id"))), lambda o: o["_b_ids"])
    # outer: else Spark makes each array twice, to see first whether it is empty
    pairs = ones.select(*of, "_id", F.when(F.col("_b_facts").isNull(), F.col("_b_ids")).otherwise(others).alias("_ids")).select(*of, "_id", F.explode_outer("_ids").alias("_other")).filter("_other IS NOT NULL")
    return pairs.select(*of, F.least("_id", "_other").alias("id_a"), F.greatest("_id", "_other").alias("id_b"))


def inline_conflicts(incoming: DataFrame, facts: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, attribute): incoming values that a sure fact of the same page and attribute contradicts."""
    sure = facts.filter(F.col("confidence") >= least).select("page", "attribute", F.col("value").alias("_v"))
    hit = incoming.join(sure, ["page", "attribute"]).filter(conflicts(F.col("value"), F.col("_v")))
    return hit.select("id", "attribute").distinct()


def pending(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Facts without a vector of their present claim."""
    v = vectors.select("id", F.col("claim_hash").alias("_h"))
    return facts.join(v, "id", "left").filter(F.col("_h").isNull() | (F.col("_h") != F.col("claim_hash"))).drop("_h")


def facts_in_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fact, chunk): range join within a page, live facts only."""
    c = chunks.select("page", "chunk", "line_start", "line_end")
    return facts.filter("valid_to IS NULL").join(c, (facts["page"] == c["page"]) & facts["line"].between(c["line_start"], c["line_end"])).select("fact", "chunk")


def best_fact_per_line(facts: DataFrame, page: str = "page", line: str = "line", key: str = "fact") -> DataFrame:
    """(page, line, fact): the surest live fact, the least key on a tie."""
    best = facts.groupBy(page, line).agg(F.min_by(key, F.struct((-F.col("confidence")).alias("c"), F.col(key).alias("k"))).alias(key))
    return best


def replay(ledger: DataFrame, requests: DataFrame, keys: Sequence[str], digest: str, order: str, more: Sequence[str] = ()) -> DataFrame:
    """requests with ``outcome`` accepted, replay or conflict, against the ledger and each other.

    The first request of a key is accepted unless the ledger has the key; another with the same
    digest replays it, with a different one it conflicts. Keys never expire. Where ``more`` names
    columns of requests, these and the digest are returned too.
    """
    w = Window.partitionBy(*keys).orderBy("_then", order)
    void = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in (order, *more)]
    both = ledger.select(*keys, digest, *void, F.lit(0).alias("_then")).unionByName(requests.select(*keys, digest, order, *more, F.lit(1).alias("_then")))
    held = both.withColumn("_first", F.first(digest).over(w)).withColumn("_n", F.row_number().over(w))
    outcome = F.when(F.col("_n") == 1, "accepted").when(F.col(digest) == F.col("_first"), "replay").otherwise("conflict")
    return held.withColumn("outcome", outcome).filter("_then = 1").select(*keys, order, *([digest, *more] if more else []), "outcome")


def retract(supports: DataFrame, retractions: DataFrame) -> DataFrame:
    """supports with retracted_by, for the (source_id, revision) that a retraction addresses."""
    r = retractions.groupBy("source_id", "revision").agg(F.min("by").alias("_by"))
    return supports.join(r, ["source_id", "revision"], "left").withColumn("retracted_by", F.coalesce("retracted_by", "_by")).drop("_by")


def active_support(supports: DataFrame) -> DataFrame:
    """(memory, support): of what is neither retracted nor forgotten the oldest."""
    live = supports.filter("retracted_by IS NULL AND NOT forgotten")
    return live.groupBy("memory").agg(F.min_by("support", F.struct("created_at", "support")).alias("support"), F.count(F.lit(1)).alias("n"))


def restrictions(corrections: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory, restriction): what a correction keeps from being used as it stands.

    superseded: corrected, and no replacement is there; pending: its correction is not decided;
    deciding: it is the replacement in an undecided correction.
    """
    ids = memories.select(F.col("memory").alias("replacement"))
    done = corrections.filter("state = 'decided'").join(ids, "replacement", "left_anti").select(F.col("target").alias("memory"), F.lit("superseded").alias("restriction"))
    waiting = corrections.filter("state = 'pending'")
    held = waiting.select(F.col("target").alias("memory"), F.lit("pending").alias("restriction"))
    new = waiting.join(ids, "replacement", "left_semi").select(F.col("replacement").alias("memory"), F.lit("deciding").alias("restriction"))
    return done.unionByName(held).unionByName(new).distinct()


def proof_groups(evidence: DataFrame) -> DataFrame:
    """(observation, facts, proofs): independent proofs are distinct groups, or pages where there is none."""
    return evidence.groupBy("observation").agg(F.count_distinct("fact").alias("facts"), F.count_distinct(F.coalesce("proof_group", "page")).alias("proofs"))


def qualify_observations(evidence: DataFrame, least: int = 2) -> DataFrame:
    """(observation, state): the first failing reason of its evidence, or too few proofs, or qualified."""
    reason = F.when(F.col("fact").isNull(), "missing_fact").when(F.col("page").isNull(), "missing_page").when(F.col("status") != "eligible", "ineligible_fact")
    rows = evidence.withColumn("_r", reason)
    by = rows.groupBy("observation").agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("ord"))).alias("reason"), F.count_distinct(F.coalesce("proof_group", "page")).alias("proofs"))
    return by.select("observation", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("proofs") < least, "too_few_proofs").otherwise("qualified").alias("state"))


def transitions(journal: DataFrame, file: str) -> DataFrame:
    """Changes of each file in order: apply reads forward, undo backward. (file, seq, ord, before, after)."""
    at = F.when(F.col("kind") == "undo", -F.col("ord")).otherwise(F.col("ord"))
    turned = lambda c, d: F.when(F.col("kind") == "undo", F.col(d)).otherwise(F.col(c))
    w = Window.partitionBy(file).orderBy("seq", at, "before")
    return journal.select(file, "seq", "ord", "kind", turned("before", "after").alias("before"), turned("after", "before").alias("after"), F.row_number().over(w).alias("step"))


def journal_page(journal: DataFrame, cursor: int, limit: int = 500) -> DataFrame:
    """The next whole events after a cursor."""
    return journal.filter(F.col("seq") > cursor).orderBy("seq", "ord").limit(limit)


def journal_events(journal: DataFrame, cursor: int, limit: int = 500) -> DataFrame:
    """All rows of the next ``limit`` events after a cursor; an event is never cut."""
    after = journal.filter(F.col("seq") > cursor)
    return after.join(after.select("seq").distinct().orderBy("seq").limit(limit), "seq", "left_semi")


def undoable(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(change, valid): every file still has the bytes the change left."""
    now = files.select("path", F.col("hash").alias("_now"))
    return changes.join(now, "path", "left").groupBy("change").agg(F.bool_and(F.col("after").eqNullSafe(F.col("_now"))).alias("valid"))


def prune(evidence: DataFrame, references: DataFrame, before: str) -> DataFrame:
    """Evidence to delete: older than the grace day, and nothing refers to it."""
    return evidence.filter(F.col("created_at") < F.lit(before)).join(references, "id", "left_anti")


def parts(paths: DataFrame, path: str) -> DataFrame:
    """(path, group_key, part): name-2.pdf is part 2 of name.pdf where that exists; no leading zero, no digit or hyphen before the suffix."""
    pattern = r"^(.*[^\d-])-([1-9]\d*)(\.[^./]+)$"
    m = paths.select(path, F.regexp_extract(path, pattern, 1).alias("_s"), F.regexp_extract(path, pattern, 2).alias("_n"), F.regexp_extract(path, pattern, 3).alias("_e"))
    m = m.withColumn("_first", F.when((F.col("_n") != "") & (F.col("_n") != "1"), F.concat("_s", "_e")))
    have = paths.select(F.col(path).alias("_first")).distinct().withColumn("_ok", F.lit(True))
    out = m.join(have, "_first", "left")
    return out.select(path, F.when(F.col("_ok"), F.col("_first")).otherwise(F.col(path)).alias("group_key"), F.when(F.col("_ok"), F.col("_n").cast("int")).otherwise(1).alias("part"))


def renditions(paths: DataFrame, path: str, texts: Sequence[str] = ("txt", "md", "html")) -> DataFrame:
    """(path, rendition): x.pdf.txt, or else the one text file of the same stem."""
    p = paths.select(F.col(path).alias("p"), F.regexp_replace(path, r"\.[^./]+$", "").alias("stem"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("ext"))
    docs, plain = p.filter(~F.col("ext").isin(*texts)), p.filter(F.col("ext").isin(*texts))
    exact = plain.select(F.col("stem").alias("_path"), F.col("p").alias("_exact"))
    only = plain.groupBy("stem").agg(F.min("p").alias("_only"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    out = docs.join(exact, docs["p"] == exact["_path"], "left").join(only, "stem", "left")
    return out.select(F.col("p").alias(path), F.coalesce("_exact", "_only").alias("rendition")).filter("rendition IS NOT NULL")


def availability(rows: DataFrame, group: str) -> DataFrame:
    """(group, status, pages): available, partial or missing over a document's parts; pages sum over those known."""
    by = rows.groupBy(group).agg(F.count_if(F.col("present")).alias("here"), F.count(F.lit(1)).alias("parts"), F.sum("pages").alias("pages"), F.bool_or(F.coalesce(F.col("rendition"), F.lit(False))).alias("text"))
    status = F.when(F.col("here") == F.col("parts"), "available").when((F.col("here") > 0) | F.col("text"), "partial").otherwise("missing")
    return by.select(group, status.alias("status"), "pages")


def unindexed(files: DataFrame, pages: DataFrame, key: str, kind: str = "page") -> DataFrame:
    """Files of a kind that have no row among the pages."""
    return files.filter(F.col("kind") == kind).join(pages.select(key), key, "left_anti").select(key)


def relation_targets(relations: DataFrame, memories: DataFrame, key: str = "memory_id") -> DataFrame:
    """(memory, relation, targets): the ids in order that a memory relates to (memory, relation, target), of those that exist."""
    there = memories.select(F.col(key).alias("target")).distinct()
    return relations.join(there, "target", "left_semi").groupBy(key, "relation").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def same_envelope(x: str, y: str, fields: Sequence[str], subject: str = "subject") -> Column:
    """Whether two structs describe one event: every field equal, nulls too, and one subject, where unresolved fits any."""
    a, b = F.col(f"{x}.{subject}"), F.col(f"{y}.{subject}")
    on = a.eqNullSafe(b) | F.coalesce((a == "unresolved") | (b == "unresolved"), F.lit(False))
    for f in fields:
        on = on & F.col(f"{x}.{f}").eqNullSafe(F.col(f"{y}.{f}"))
    return on


#: An attachment that its name gives to a page: the page's name, eight hex digits and an ending.
OWNED_NAME = r"^(.+)-[0-9a-f]{8}\.[^.]+$"


def owners(files: DataFrame, pages: DataFrame, embeds: DataFrame) -> DataFrame:
    """(path, page) of attachments: by the hex form of their name, by their stem, or by an embed on a page of their folder; else null.

    files has path; pages page and slug; embeds (page, folder, target) where target is a file's
    name. Of several pages that embed it the least.
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    base = F.regexp_replace("path", "^.*/", "")
    at = lambda name: F.when(name != "", F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), name))
    named = files.select("path", at(F.regexp_extract(base, OWNED_NAME, 1)).alias("_a"), at(F.regexp_replace(base, r"\.[^.]+$", "")).alias("_b"), folder.alias("_f"), base.alias("_n"))
    slugs = lambda c, p: pages.groupBy(F.col("slug").alias(c)).agg(F.min("page").alias(p))
    seen = embeds.groupBy(F.col("folder").alias("_f"), F.col("target").alias("_n")).agg(F.min("page").alias("_z"))
    return named.join(slugs("_a", "_x"), "_a", "left").join(slugs("_b", "_y"), "_b", "left").join(seen, ["_f", "_n"], "left").select("path", F.coalesce("_x", "_y", "_z").alias("page"))


def expired(plans: DataFrame, today: str, at: str = "created_at", payload: int = 30, receipt: int = 180) -> DataFrame:
    """plans with what is left of them by age in days: payload, receipt or nothing."""
    age = F.date_diff(F.lit(today).cast("date"), F.col(at).cast("date"))
    return plans.withColumn("left", F.when(age <= payload, "payload").when(age <= receipt, "receipt").otherwise("nothing"))
