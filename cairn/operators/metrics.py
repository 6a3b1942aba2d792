"""Ranking and decision metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking(runs: DataFrame, case: str = "case", k: int = 10) -> DataFrame:
    """Per case: nDCG@k, MRR@k (grade 3), success@1 and @3, precision@5 (grade 2 or more), inversions@k. Reads rank and grade."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = F.row_number().over(Window.partitionBy(case).orderBy(F.col("grade").desc(), "rank"))
    rows = runs.withColumn("_i", ideal)
    part = lambda r: gain / (F.log(F.col(r) + 1.0) / F.log(F.lit(2.0)))
    seen = F.max("grade").over(Window.partitionBy(case).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    low = F.min("grade").over(Window.partitionBy(case).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inv", F.when((F.col("rank") <= k) & (low < F.col("grade")), 1).otherwise(0)).withColumn("_seen", seen)
    out = rows.groupBy(case).agg(
        F.sum(F.when(F.col("rank") <= k, part("rank")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("_i") <= k, part("_i")).otherwise(0.0)).alias("ideal"),
        F.min(F.when((F.col("grade") == 3) & (F.col("rank") <= k), F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") >= 2), 1).otherwise(0)).alias("good5"),
        F.sum("_inv").alias("inversions"),
    )
    one = lambda n: F.coalesce((F.col("first") <= n).cast("int"), F.lit(0))
    return out.select(case, F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 6)).otherwise(0.0).alias("ndcg"), F.coalesce(F.round(1.0 / F.col("first"), 6), F.lit(0.0)).alias("mrr"), one(1).alias("success1"), one(3).alias("success3"), F.round(F.col("good5") / 5.0, 6).alias("precision5"), F.col("inversions").cast("long").alias("inversions"))


def qualification(rows: DataFrame, relevant: str, kept: str, group: Sequence[str] = ()) -> DataFrame:
    """Shares of relevant rows kept and of irrelevant ones rejected."""
    r, k = F.col(relevant), F.col(kept)
    share = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return rows.groupBy(*group).agg(share(r & k, r).alias("retention"), share(~r & ~k, ~r).alias("rejection"), F.count(F.lit(1)).alias("n"))


def top_overlap(runs: DataFrame, case: str, run: str, item: str, k: int = 3) -> DataFrame:
    """(case, overlap): median share of the top k that pairs of runs have in common; runs are few."""
    top = runs.filter(F.col("rank") <= k).groupBy(case, run).agg(F.collect_set(item).alias("s"))
    a, b = (top.select(case, F.col(run).alias(f"_{n}"), F.col("s").alias(n)) for n in ("x", "y"))
    pairs = a.join(b, case).filter("_x < _y").select(case, (F.size(F.array_intersect("x", "y")) / k).alias("o"))
    return pairs.groupBy(case).agg(F.round(F.median("o"), 6).alias("overlap"))


def threshold_sweep(pairs: DataFrame, score: str, expected: str, steps: Sequence[float]) -> DataFrame:
    """(threshold, recall, precision, false_positives) of pair scores, all thresholds in one pass."""
    t = F.explode(F.array(*(F.lit(float(s)) for s in steps)))
    rows = pairs.select(F.col(score).alias("s"), F.col(expected).alias("e"), t.alias("threshold"))
    on = F.col("s") >= F.col("threshold")
    by = rows.groupBy("threshold").agg(F.count_if(on & F.col("e")).alias("tp"), F.count_if(on & ~F.col("e")).alias("false_positives"), F.count_if(F.col("e")).alias("p"))
    return by.select("threshold", F.round(F.col("tp") / F.nullif(F.col("p"), F.lit(0)), 6).alias("recall"), F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("false_positives"), F.lit(0)), 6).alias("precision"), "false_positives")


def stability(runs: DataFrame, case: str, outcome: str) -> DataFrame:
    """(case, stable): every run of a case gave the same outcome."""
    return runs.groupBy(case).agg((F.count_distinct(outcome) == 1).alias("stable"))


def percentiles(rows: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Discrete p50 and p95, by groups whose members are few against the whole."""
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*group).agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


def calibration(samples: DataFrame, score: str, positive: str) -> DataFrame:
    """(boundary): midway between the weakest positive and the strongest negative below it; null if over half of the negatives reach the weakest positive."""
    low = samples.agg(F.min(F.when(F.col(positive), F.col(score))).alias("low"))
    rows = samples.crossJoin(F.broadcast(low))  # one row
    by = rows.agg(F.first("low").alias("low"), F.max(F.when(~F.col(positive) & (F.col(score) < F.col("low")), F.col(score))).alias("high"), F.count_if(~F.col(positive) & (F.col(score) >= F.col("low"))).alias("fp"), F.count_if(~F.col(positive)).alias("neg"))
    return by.select(F.when(F.col("fp") * 2 <= F.col("neg"), F.round((F.col("low") + F.col("high")) / 2, 6)).alias("boundary"))
