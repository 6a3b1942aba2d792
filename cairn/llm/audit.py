"""Filter interaction audit: what each filter removes in every order of them, from a trie of survivors."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import drop, remove, save, scratch

#: White space between words.
BLANK = r"[\x20\x09-\x0D]+"
#: The most filters that audit() takes: the trie has 2 ** n states, the report n! * n rows a part.
MOST = 7
#: A text on over one row in FREQUENT is frequent; there are fewer than FREQUENT of them.
FREQUENT = 1000


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", few: int = 200, varied: int = 50, capitals: int = 2, symbols: str = "#$%&*|") -> DataFrame:
    """(doc_id, A, B, C, D, E) for each row and whether it fails each filter, with the row's other columns in ``_doc``.

    A: fewer than ``few`` words; B: under ``varied`` per cent of the words differ; C: over
    ``capitals`` per cent of the code points are A to Z; D: holds one of ``symbols``; E: equal to
    the text of a smaller doc_id, wherever that is. Null texts count as empty; a row without
    doc_id never fails E and no row fails E for it. Texts meet by SHA-256; those on very many
    rows bring their smallest doc_id along by broadcast.
    """
    c = lambda name: F.col(f"`{name}`")
    body = F.coalesce(c(text).cast("string"), F.lit(""))
    others = [x for x in docs.columns if x not in (text, doc_id)]
    split = docs.select(c(doc_id).cast("long").alias("doc_id"), F.struct(F.lit(0).alias("_"), *(c(x) for x in others)).alias("_doc"), body.alias("_t"), F.array_remove(F.split(body, BLANK), "").alias("_w"))
    upper = F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = {
        "A": F.size("_w") < few,
        "B": 100 * F.size(F.array_distinct("_w")) < varied * F.size("_w"),
        "C": 100 * upper.cast("long") > capitals * F.length("_t"),
        "D": F.length(F.translate("_t", symbols, "")) < F.length("_t"),
    }
    rows = save(split.select("doc_id", "_doc", *(f.alias(k) for k, f in flags.items()), F.unhex(F.sha2("_t", 256)).alias("_h")))
    groups = save(rows.groupBy("_h").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    total = rows.count()
    # fewer than FREQUENT texts can be that frequent: a proven bound
    often = groups.filter(F.col("_n") > total / FREQUENT).select("_h", F.col("_first").alias("_often"))
    seldom = groups.filter(F.col("_n") <= total / FREQUENT).select(F.col("_h").alias("_key"), F.col("_first").alias("_seldom"))
    met = rows.join(F.broadcast(often), "_h", "left")
    # rows of a frequent text are dealt out by doc_id, and meet nothing
    met = met.withColumn("_key", F.when(F.col("_often").isNull(), F.col("_h")).otherwise(F.encode(F.col("doc_id").cast("string"), "utf-8")))
    met = met.join(seldom, "_key", "left")
    late = F.col("doc_id") > F.coalesce("_often", "_seldom")
    out = save(met.select("doc_id", "_doc", *flags, F.coalesce(late, F.lit(False)).alias("E")))
    drop(rows, groups)
    return out


def trie(rows: DataFrame, part: Column, filters: Mapping[str, Column], marks: Mapping[str, Column]) -> DataFrame:
    """(part, state, filter, n, removed, and each mark's share of removed): the edges of the trie.

    ``filters`` are failure conditions of rows, ``marks`` conditions that are counted among the
    removed. From all rows down, depth first: a state is the survivors of a set of filters,
    persisted while its own subtree runs; one job over it counts what each further filter
    removes. Orders that share a prefix as a set share its state: 2 ** n - 1 states stand for all
    n! orders, at most n of them persisted at a time. ``state`` has bit i for the i-th filter;
    a part without survivors has no rows there. A lost block of survivors is filtered again from
    the written rows.
    """
    names = list(filters)
    if len(names) > MOST:
        raise ValueError(f"at most {MOST} filters")
    spark = rows.sparkSession
    flag = [F.col(f"_f{i}") for i in range(len(names))]
    slim = rows.select(part.alias("part"), *(F.coalesce(f, F.lit(False)).alias(f"_f{i}") for i, f in enumerate(filters.values())), *(F.coalesce(m, F.lit(False)).alias(f"_m{i}") for i, m in enumerate(marks.values())))
    slim = save(slim)
    path, seen = f"{scratch(spark)}/audit-{uuid.uuid4().hex}", set()

    def visit(now: DataFrame, state: int) -> None:
        seen.add(state)
        left = [i for i in range(len(names)) if not state >> i & 1]
        edge = lambda i: F.struct(F.lit(i).alias("filter"), F.count_if(flag[i]).alias("removed"), *(F.count_if(flag[i] & F.col(f"_m{j}")).alias(f"_m{j}") for j in range(len(marks))))
        now.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.array(*map(edge, left)).alias("edges")).write.parquet(f"{path}/state={state}")
        for i in left:
            if len(left) > 1 and (child := state | 1 << i) not in seen:
                survivors = now.filter(~flag[i]).persist()
                visit(survivors, child)
                survivors.unpersist()

    visit(slim, 0)
    drop(slim)
    lost = "".join(f", _m{j}: bigint" for j in range(len(marks)))
    counts = spark.read.schema(f"part string, n long, edges array<struct<filter: int, removed: bigint{lost}>>, state int").parquet(path)
    edges = save(counts.select("part", "state", "n", F.explode("edges").alias("_e")).select("part", "state", "_e.filter", "n", "_e.removed", *(F.col(f"_e._m{j}").alias(m) for j, m in enumerate(marks))))
    remove(spark, path)
    return edges


def report(edges: DataFrame, names: list[str], marks: list[str]) -> DataFrame:
    """One row for each part, order and step, from trie(): part, filter_order, step, kept, removed, redundant, unique_fails, each mark, shapley.

    kept and removed are those of the step; redundant rows fail its filter but were removed
    before; unique_fails fail it alone; shapley is what the filter removes, summed over all
    orders. At most n * 2 ** (n - 1) edges of a part meet in one row.
    """
    n = len(names)
    at = lambda state, i: state * n + i
    steps, full = [], (1 << n) - 1
    for order in permutations(range(n)):
        state = 0
        for k, i in enumerate(order):
            steps.append({"o": "".join(names[j] for j in order), "k": k + 1, "f": i, "at": at(state, i), "all": at(0, i), "alone": at(full ^ 1 << i, i)})
            state |= 1 << i
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), F.bit_count("state") + 1)
    values = F.struct("n", "removed", *marks)
    wide = edges.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("state") * n + F.col("filter")).alias("at"), values.alias("v")))).alias("_e"),
        F.array(*(F.coalesce(F.sum(F.when(F.col("filter") == i, F.col("removed") * weight)), F.lit(0)) for i in range(n))).alias("_s"),
    )
    told = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, k: int, f: int, at: int, all: int, alone: int>>"))
    rows = wide.select("part", "_e", "_s", told.alias("_o"))
    value = lambda which, field: F.coalesce(F.col("_e")[F.col(f"_o.{which}")][field], F.lit(0)).cast("long")
    removed = value("at", "removed")
    return rows.select(
        "part", F.col("_o.o").alias("filter_order"), F.col("_o.k").alias("step"), (value("at", "n") - removed).alias("kept"), removed.alias("removed"),
        (value("all", "removed") - removed).alias("redundant"), value("alone", "removed").alias("unique_fails"),
        *(value("at", m).alias(m) for m in marks), F.col("_s")[F.col("_o.f")].cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """report() of the filters of failures(), by source; good_lost and toxic_lost count removed documents of either label.

    A document is good or toxic if any row of its doc_id in labels says so. A null source is the
    part '', with empty ones; repeated rows are documents of their own; rows without doc_id have
    no labels; no rows give no rows; columns of docs may have any names.
    """
    judged = failures(docs, text, doc_id)
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    rows = judged.join(told, F.col("doc_id") == F.col("_id"), "left")
    filters, marks = list("ABCDE"), ["good_lost", "toxic_lost"]
    edges = trie(rows, F.coalesce(F.col(f"_doc.`{source}`").cast("string"), F.lit("")), {k: F.col(k) for k in filters}, dict(zip(marks, (F.col("_good"), F.col("_toxic")), strict=True)))
    drop(judged)
    return report(edges, filters, marks)
