"""What has to be made again: fingerprints of rows, rules and versions, and caches of verdicts that hang on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.filters import apply_rules


def fingerprint(*parts: Column) -> Column:
    """A digest of values in order; null is a value of its own, and no two lists of values read alike."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-:")) for p in parts)), 256)


def policies(pages: DataFrame, rules: Sequence[dict], path: str, fields: Sequence[str]) -> DataFrame:
    """pages with ``policy``: a digest of the fields that the rules give to their path."""
    held = [f"_p{i}" for i in range(len(fields))]
    named = [{"glob": r["glob"], **{h: r[f] for h, f in zip(held, fields, strict=True) if r.get(f) is not None}} for r in rules]
    return apply_rules(pages, named, path, held).withColumn("policy", fingerprint(*map(F.col, held))).drop(*held)


def stale_pages(pages: DataFrame, rules: Sequence[dict], versions: Mapping[str, str], path: str = "path", fields: Sequence[str] = ("role", "type")) -> DataFrame:
    """(path, reasons) of the pages that have to be made again, by what their row says it was made with.

    pages: path, policy (as policies() gave it), holds (array: the projections that read
    something on the page), made_with (map: projection to version), indexed (whether it has
    rows; an ignored page has none). A page whose rules give it another policy than its row has
    is stale for ``rules``, indexed or not, so a rule that hid it can be taken back; one that
    holds what a projection reads and was made with another version of that is stale for the
    projection; a page with rows for no reason is left alone. Rules and versions are
    configuration; no page meets another.
    """
    now = policies(pages.withColumnRenamed("policy", "_was"), rules, path, fields)
    reasons = [F.when(~F.col("_was").eqNullSafe(F.col("policy")), F.lit("rules"))]
    for name, version in sorted(versions.items()):
        made = F.element_at("made_with", F.lit(name))
        reasons.append(F.when(F.col("indexed") & F.array_contains("holds", name) & ~made.eqNullSafe(F.lit(version)), F.lit(name)))
    return now.select(path, F.array_compact(F.array(*reasons)).alias("reasons")).filter(F.size("reasons") > 0)


def follow_facts(old: DataFrame, new: DataFrame, page: str = "page") -> DataFrame:
    """(key, change, old line, new line) of a page's facts after it was parsed again.

    A fact that has a marker is known by its id, whatever its words and line; others by the
    digest of their line, the n-th of equal lines on a page. changes: same, moved (another line),
    edited (a marked fact in other words), added, gone.
    """
    def keyed(df: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(page, "item_id", "line_hash").orderBy("line"))
        return df.withColumn("key", F.coalesce(F.concat(F.lit("item:"), "item_id"), F.concat(F.lit("line:"), "line_hash", F.lit(":"), nth.cast("string"))))

    a = keyed(old).select(page, "key", F.col("line").alias("old_line"), F.col("line_hash").alias("_a"))
    b = keyed(new).select(page, "key", F.col("line").alias("new_line"), F.col("line_hash").alias("_b"))
    change = F.when(F.col("new_line").isNull(), "gone").when(F.col("old_line").isNull(), "added").when(F.col("_a") != F.col("_b"), "edited").when(F.col("old_line") != F.col("new_line"), "moved").otherwise("same")
    return a.join(b, [page, "key"], "full").select(page, "key", change.alias("change"), "old_line", "new_line")


def usable_vectors(rows: DataFrame, vectors: DataFrame, key: str, model: str, dimensions: int, digest: str) -> tuple[DataFrame, DataFrame]:
    """(vectors that still hold, rows to embed): a vector holds for the same model, length and text digest.

    A change of model or dimensions leaves none; a changed text only its own. Of several vectors
    of a row the last made counts.
    """
    fit = vectors.filter((F.col("model") == model) & (F.size("embedding") == dimensions))
    last = fit.groupBy(key).agg(F.max_by(F.struct("embedding", F.col(digest).alias("_d")), "made_at").alias("_v"))
    met = rows.join(last, key, "left")
    held = met.filter(F.col("_v._d") == F.col(digest)).select(key, F.col("_v.embedding").alias("embedding"))
    return held, rows.join(held.select(key), key, "left_anti")


def embed_pending(pending: DataFrame, embed: Callable[[list[str]], list | None], key: str, text: str, size: int = 32) -> DataFrame:
    """(key, embedding) of pending rows, asked for in batches of ``size``; null where the model failed.

    After a batch that fails, by an error or no answer, a task asks no more in this run; its
    rows stay pending, and the next run takes them up. The function runs on the executors.
    """
    kind = pending.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        alive = True
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                found = None
                if alive:
                    try:
                        found = embed(part.column(1).to_pylist())
                    except Exception:  # any fault of the model means the same: try again later
                        found = None
                    alive = found is not None
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found or [None] * part.num_rows, pa.list_(pa.float32()))], [key, "embedding"])

    return pending.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def with_verdicts(candidates: DataFrame, cache: DataFrame, model: str, prompt: str) -> DataFrame:
    """candidates (fingerprint, ...) with the cached verdict, qualification and reason, or null: then they have to be judged.

    cache: fingerprint, model, prompt, verdict, qualification, reason, at. A verdict counts for
    the same fingerprint, model and prompt version; the last one of those; never ``unverified``,
    and ``qualified`` only with a qualification. A fingerprint covers all that a verdict hangs
    on, so a candidate that changed finds nothing.
    """
    fit = cache.filter((F.col("model") == model) & (F.col("prompt") == prompt))
    last = fit.groupBy("fingerprint").agg(F.max_by(F.struct("verdict", "qualification", "reason"), F.struct("at", "verdict")).alias("_v"))
    good = last.filter((F.col("_v.verdict") != "unverified") & ((F.col("_v.verdict") != "qualified") | F.coalesce(F.trim("_v.qualification") != "", F.lit(False))))
    return candidates.join(good, "fingerprint", "left").select(*candidates.columns, "_v.verdict", "_v.qualification", "_v.reason")
