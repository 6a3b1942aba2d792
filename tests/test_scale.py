"""Queries that grew faster than their input: the same rows by blocks, at any size of block."""

import random

import pytest

from cairn.functions.text import conflicts
from pyspark.sql import functions as F


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_conflicts_of_a_hot_subject_by_blocks(spark, block):
    from cairn.operators.evidence import cross_page_conflicts

    rng = random.Random(3)
    values = ["about 1,000 units", "1000", "*1000*", "1,5", "15", "plain", "", None, "7 of 9", "7.", "9 of 7"]
    rows = [(i, f"p{rng.randrange(12)}", "hot" if i % 9 else "cold", "size", rng.choice(values)) for i in range(90)] + [(200 + i, f"q{i}", "agree", "size", "4") for i in range(40)] + [(300, "q0", None, "size", "4"), (301, "q1", None, "size", "5")]
    df = spark.createDataFrame(rows, "id long, page string, subject string, attribute string, value string")
    once = df.groupBy("subject", "attribute", "page", "value").agg(F.min("id").alias("id")).collect()
    tried = spark.createDataFrame([(a.subject, min(a.id, b.id), max(a.id, b.id), a.value, b.value) for a in once for b in once if a.id < b.id and a.subject and a.subject == b.subject and a.page != b.page], "s string, x long, y long, v string, w string")
    want = sorted((r.s, r.x, r.y) for r in tried.filter(conflicts(F.col("v"), F.col("w"))).collect())
    got = cross_page_conflicts(df, block=block).collect()
    assert want and sorted((r.subject, r.id_a, r.id_b) for r in got) == want


def test_conflicts_hold_one_facts_pairs_at_a_time(spark):
    from cairn.operators.evidence import cross_page_conflicts

    df = spark.range(800).selectExpr("id", "concat('p', id) page", "'hot' subject", "'size' attribute", "concat('about ', id % 2) value")
    five = cross_page_conflicts(df).limit(5)
    assert len(five.collect()) == 5
    node = five._jdf.queryExecution().executedPlan().executedPlan()
    while not node.nodeName().startswith("Generate"):
        node = node.plan() if "QueryStage" in node.nodeName() else node.children().head()
    assert node.metrics().apply("numOutputRows").value() <= 800  # of 160,000 in this cell


def test_conflicts_of_shared_pages_and_ids(spark):
    from cairn.operators.evidence import cross_page_conflicts

    # p has two values, and id 3 is on two pages; neither is in conflict with itself
    rows = [(1, "p", "s", "a", "1"), (2, "p", "s", "a", "2"), (3, "q", "s", "a", "1"), (3, "r", "s", "a", "2"), (4, None, "s", "a", "3"), (None, "t", "s", "a", "3"), (5, "u", None, "a", "1")]
    df = spark.createDataFrame(rows, "id long, page string, subject string, attribute string, value string")
    for block in (1, 2, 4096):
        assert sorted((r.id_a, r.id_b) for r in cross_page_conflicts(df, block=block).collect()) == [(1, 3), (2, 3)]


def test_shared_paths_in_tasks_by_rows(spark, monkeypatch):
    from cairn.operators import maintenance

    monkeypatch.setattr(maintenance, "parts", lambda rows: 37)
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(40)) for _ in range(300)] + [(None, 1), (2, None)] + [(1, 1)] * 5
    df = maintenance.shared_paths(spark.createDataFrame(rows, "item int, path int"), "item", "path")
    want = {}
    for p in range(40):
        held = sorted({i for i, q in rows if q == p and i is not None})
        for a in held:
            for b in held:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.paths for r in df.collect()} == want
    assert df.rdd.getNumPartitions() == 37  # small partitions are not put together


def test_clean_facts_in_tasks_by_rows(spark, monkeypatch):
    from cairn.operators import memory

    monkeypatch.setattr(memory, "parts", lambda rows: 37)
    c = spark.createDataFrame([(p, n, f" Claim {n % 3} ", n / 10) for p in range(20) for n in range(5)] * 2, "page long, line long, claim string, confidence double")
    lines = c.select("page", "line").withColumn("eligible", F.col("line") != 4)  # repeated lines
    df = memory.clean_facts(c, lines, 2)
    assert sorted((r.page, r.line) for r in df.collect()) == sorted((p, n) for p in range(20) for n in (2, 3))
    assert df.rdd.getNumPartitions() == 37


def test_tail_rescale_reads_the_documents_once(spark, data):
    from cairn.queries import QUERIES

    plan = QUERIES["tail_rescale"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan  # scores are read again, not made again


def test_degrees_of_built_edges_need_no_ids(spark):
    from cairn.operators import graph as G

    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("b", "c"), ("c", "z")], "f string, t string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = G.build([nodes], [G.edges_of(rows, F.col("f"), F.col("t"), "about")])[1]
    got = G.degrees(edges, built=True)
    assert {r.node: r.degree for r in got.collect()} == {r.node: r.degree for r in G.degrees(edges).collect()} == {"a": 2, "b": 2, "c": 1}
