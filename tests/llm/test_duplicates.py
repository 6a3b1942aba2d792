import random

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import components as links_of
from cairn.llm import hyperplanes, minhash
from cairn.llm.components import components
from tests.llm.helpers import awkward, empty, near_duplicates


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for e in edges if e[0] != e[1] for k in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def jobs_of(spark, make):
    """What make() gives, and the number of Spark jobs that it ran."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return make(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_take_few_jobs(spark):
    """Plans, threads and compiled code of every job stay in the driver's memory for a while."""
    edges = spark.createDataFrame([(i + j, i + j - 1) for i in range(0, 4000, 4) for j in (1, 2, 3)], "u long, v long").repartition(4)
    got, jobs = jobs_of(spark, lambda: components(edges))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(k, k - k % 4) for k in range(4000)}
    assert 0 < jobs <= 40


@pytest.mark.parametrize("chunk", [1, 3, 50, 1 << 18])
def test_forests_keep_components_over_chunks(monkeypatch, chunk):
    monkeypatch.setattr(links_of, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    x, y = rng.integers(0, 120, 400), rng.integers(0, 120, 400)
    links = sorted((int(max(a, b)), int(min(a, b))) for a, b in zip(x, y, strict=True))
    sides = [pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)]
    batches = [pa.RecordBatch.from_arrays([s.slice(i, 17) for s in sides], ["u", "v"]) for i in range(0, 400, 17)]
    out = [p for b in links_of._forests(iter([batches[0].slice(0, 0), *batches])) for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    assert len(out) <= len([p for p in links if p[0] != p[1]]) and all(u > v for u, v in out)
    whole = lambda pairs: dict(zip(*(a.tolist() for a in links_of.forest(*np.array(pairs).T)), strict=True))
    assert whole(out) == whole(links)
    root = {k: k for p in links for k in p}
    for _ in range(120):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert whole(links) == {k: r for k, r in root.items() if k != r}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(4000)}"
    texts = []
    for size, n, edits in ((40, 30, 4), (150, 60, 14), (9, 12, 2), (600, 6, 20)):
        texts += variants(rng, [word() for _ in range(size)], n, edits)
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(90)) + " " + passage for _ in range(40)]
    texts += ["Just FOUR words here", "just four WORDS here", "x", "x", "", "   ", "x y"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_duplicates(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash.blocks, "BLOCK", 8)
    rng = random.Random(9)
    rows = list(enumerate(variants(rng, [f"b{i}" for i in range(120)], 90, 16)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_duplicates(rows)


def test_near_duplicates_awkward_rows(spark):
    docs = awkward(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[0, 3]["component_id"] == by[1, 3]["component_id"] == by[None, 3]["component_id"] == 0
    assert by[2, 0]["component_id"] == 2 and by[2, 0]["kept"] and by[3, 0]["kept"] and by[None, 0]["kept"]
    assert by[6, 12701 if (6, 12701) in by else next(n for d, n in by if d == 6)]["component_id"] == 5
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 6 not in ids and {2, 3, 4, 5, 7, 8} <= set(ids)
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.deduplicate(empty(spark)).count() == 0


def brute_vectors(rows, least=0.9):
    fine = {}
    for k, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            fine[k] = x / np.linalg.norm(x)
    ids = sorted(fine)
    x = np.array([fine[k] for k in ids])
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    return ids, hit


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(32)
        rows += [centre + rng.standard_normal(32) * s for s in (0.0, 0.05, 0.1, 0.2, 0.2, 0.3)]
    rows += list(rng.standard_normal((300, 32)))
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    data += [(9000, data[0][1]), (9001, data[0][1]), (9002, None), (9003, [0.0] * 32), (9004, [float("nan")] * 32), (9005, [None] + [1.0] * 31), (9006, [float("inf")] * 32), (9007, []), (9008, [1.0, 0.0])]
    got = {r["vec_id"]: r for r in hyperplanes.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    ids, hit = brute_vectors([d for d in data if d[0] < 9002])
    true = {k: int(n) for k, n in zip(ids, hit.sum(axis=1), strict=True)}
    found = sum(min(got[k]["n_links"], true[k]) for k in true)
    assert all(got[k]["n_links"] <= true[k] for k in true)
    assert found >= 0.97 * sum(true.values())
    assert got[9000]["component_id"] == got[9001]["component_id"] == 0 and not got[9000]["kept"]
    for k in range(9002, 9009):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)


def test_near_vectors_awkward(spark):
    kind = "vec_id long, embedding array<float>, label int, n_links string"
    assert hyperplanes.near_vectors(spark.createDataFrame([], kind)).count() == 0
    assert hyperplanes.near_vectors(spark.createDataFrame([(None, None, None, None), (1, None, 2, "x")], kind)).count() == 2
    rows = [(None, [1.0, 2.0], 1, ""), (5, [2.0, 4.0], 1, ""), (5, [2.0, 4.0], 1, "")]
    got = hyperplanes.near_vectors(spark.createDataFrame(rows, kind)).collect()
    assert [r["n_links"] for r in got] == [2, 2, 2] and {r["component_id"] for r in got} == {5}


@pytest.mark.parametrize("n", [10, 1000, 10**6, 10**9])
def test_tables_reach_the_recall(n):
    bits, tables = hyperplanes.table_plan(n)
    p = (1 - np.arccos(0.9) / np.pi) ** bits
    assert 1 - (1 - p) ** tables >= 0.995
