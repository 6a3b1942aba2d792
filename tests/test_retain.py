import pytest

from cairn.operators import retain as RT
from cairn.plans.store import Conflict, Store
from cairn.scratch import keep

SOURCES = "source_id string, revision string, request string, source_group string, retracts string, at string"
CANDIDATES = "source_id string, revision string, candidate string, ord int, slug string, text string, semantics string, subject string, relations array<string>"


def sources(spark, *rows):
    return spark.createDataFrame([(s, r, q, None, old, "1") for s, r, q, old in rows], SOURCES)


def candidates(spark, *rows):
    return spark.createDataFrame([(s, r, c, i, slug, text, "x", "y", rel) for i, (s, r, c, slug, text, rel) in enumerate(rows)], CANDIDATES)


def outcomes(df):
    return {(r["source_id"], r["candidate"]): r["outcome"] if r["outcome"] != "held" else r["reason"] for r in df.collect()}


def rows(store, name):
    return sorted(map(tuple, store.table(name, schema=RT.SCHEMAS[name]).collect()), key=str)


def test_versions_appear_whole_and_in_order(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    df = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    got = lambda name, v=None: sorted(r["x"] for r in store.table(name, v, "x int").collect())
    assert store.version() == 0 and got("a") == []
    with pytest.raises(KeyError):
        store.table("a")
    assert store.commit(0, replace={"a": df(1), "b": df(2)}) == 1
    assert store.commit(1, append={"a": df(3)}) == 2
    assert (got("a"), got("b"), got("a", 1)) == ([1, 3], [2], [1])
    with pytest.raises(Conflict):
        store.commit(1, replace={"a": df(9)})
    with pytest.raises(Conflict):  # another commit came between the look and the rename
        store._publish({"a": []}, 2)
    assert got("a") == [1, 3]

    # a run that dies with its data written, and with part of its manifest written
    broken = Store(spark, store.root)
    broken._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        broken.commit(2, replace={"a": df(7), "b": df(7)})
    (tmp_path / "s" / "versions" / "_half").write_text("{")
    assert store.version() == 2 and (got("a"), got("b")) == ([1, 3], [2])
    assert store.compact("a") == 3 and len(store.manifest()["a"]) == 1
    assert store.commit(3, replace={"b": df(5)}) == 4
    assert len(store.sweep(keep=1)) == 5 and (got("a"), got("b")) == ([1, 3], [5])


def test_candidates_of_sources(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    c = candidates(
        spark, ("s1", "1", "a", "p", "Red  fox\nseen", None), ("s1", "1", "b", "p", "Rent: 100", ["a"]), ("s1", "1", "c", "p", " ", None), ("s1", "1", "d", "p", "Blue", ["c"]), ("s1", "1", "e", "p", "Green", ["f"]), ("s1", "1", "f", "p", "Grey", ["e"]),
        ("s1", "1", "g", None, "No page", None), ("s1", "1", "h", "q", "Rent: 300", ["a", "b"]), ("s2", "1", "a", "p", "Red fox seen", None), ("s2", "1", "b", "p", "Rent: 200", None), ("s2", "1", "b", "p", "Rent: 200", None), ("s3", "1", "z", "p", "Lost", ["other"]),
    )
    s = sources(spark, ("s1", "1", "q", None), ("s2", "1", "q", None), ("s3", "1", "q", None), ("s4", "1", "q", None))
    version, results = RT.retain(store, s, c)
    assert version == 1
    want = {"a": "written", "b": "written", "c": "validation", "d": "relation", "e": "relation", "f": "relation", "g": "validation", "h": "written"}
    got = [(r["source_id"], r["candidate"], r["outcome"] if r["outcome"] != "held" else r["reason"]) for r in store.table("results").collect()]
    assert {x[1]: x[2] for x in got if x[0] == "s1"} == want
    assert sorted(x[2] for x in got if x[:2] == ("s2", "b")) == ["conflict", "duplicate"] and ("s2", "a", "support_added") in got and ("s3", "z", "relation") in got
    assert {r["source_id"]: r["outcome"] for r in store.table("sources").collect()} == {"s1": "ok", "s2": "ok", "s3": "held", "s4": "noop"}
    assert len(rows(store, "supports")) == 4 and len(rows(store, "memories")) == 3 and {r[0] for r in rows(store, "receipts")} == {"s1", "s2", "s4"}

    # the same again changes nothing; another request under the same revision is a conflict
    before = {n: rows(store, n) for n in RT.SCHEMAS}
    RT.retain(store, s.filter("source_id <> 's3'"), c)
    RT.retain(store, sources(spark, ("s1", "1", "else", None)), c)
    assert {n: rows(store, n) for n in RT.SCHEMAS} == before
    asked = [(r["source_id"], r["outcome"]) for r in store.table("sources").collect()]
    assert asked.count(("s1", "replay")) == 1 and asked.count(("s1", "conflict")) == 1


def test_corrections_are_whole_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    RT.retain(store, sources(spark, ("s", "1", "q", None), ("t", "1", "q", None)), candidates(spark, ("s", "1", "a", "p", "Rent: 100", None), ("t", "1", "a", "p", "Rent: 100", None)))
    # a held candidate holds the whole correction, and what it would retract
    RT.retain(store, sources(spark, ("s", "2", "q", "1")), candidates(spark, ("s", "2", "a", "q", "Fee: 5", None), ("s", "2", "b", "q", "", None)))
    assert [r[-1] for r in rows(store, "supports")] == [None, None]
    assert [(r[0], r[1], r[2]) for r in rows(store, "holds")] == [("pending_correction", "s", "2")]
    # nothing to retract
    RT.retain(store, sources(spark, ("s", "3", "q", "none")), candidates(spark, ("s", "3", "a", "q", "Fee: 5", None)))
    assert len(rows(store, "supports")) == 2
    RT.retain(store, sources(spark, ("s", "4", "q", "1")), candidates(spark, ("s", "4", "a", "q", "Fee: 5", None)))
    assert {(r[0], r[1]): r[-1] for r in rows(store, "supports")} == {("s", "1"): "4", ("t", "1"): None, ("s", "4"): None}
    # another number on another page, out of the same group: the earlier memory waits for a decision
    RT.retain(store, sources(spark, ("t", "2", "q", None)), candidates(spark, ("t", "2", "a", "r", "Rent: 500", None)))
    held = [r for r in rows(store, "holds") if r[0] == "deciding"]
    assert len(held) == 1 and held[0][1:3] == ("t", "2") and held[0][3] != held[0][4]


def test_supports_of_a_hot_memory_are_limited(spark):
    state = {n: spark.createDataFrame([], s) for n, s in RT.SCHEMAS.items()}
    names = [(f"s{i:03d}", "1", "q", None) for i in range(60)]
    new = RT.plan(state, sources(spark, *names), candidates(spark, *((s, "1", "a", "p", "Same text", None) for s, *_ in names)), save=keep)
    got = outcomes(new["results"])
    assert [got[s, "a"] for s, *_ in names] == ["written"] + ["support_added"] * 7 + ["support_limit"] * 52
    assert new["memories"].count() == 1 and new["supports"].count() == 8


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    slow = Store(spark, store.root)
    first = slow.version
    calls = []

    def version():
        calls.append(1)
        if len(calls) == 2:  # the other writer commits after this one has planned
            RT.retain(store, sources(spark, ("s", "1", "q", None)), candidates(spark, ("s", "1", "a", "p", "Red", None)))
        return first()

    slow.version = version
    RT.retain(slow, sources(spark, ("t", "1", "q", None)), candidates(spark, ("t", "1", "a", "p", "Red", None)))
    assert store.version() == 2
    got = [(r["source_id"], r["outcome"]) for r in store.table("results").collect()]
    assert sorted(got) == [("s", "written"), ("t", "support_added")]


def test_only_candidates_with_relations_go_through_the_rounds(spark):
    state = {n: spark.createDataFrame([], s) for n, s in RT.SCHEMAS.items()}
    sizes = []

    def save(df):
        out = keep(df)
        sizes.append((out.count(), out.columns))
        return out

    n = 400
    chain = [("s", "1", f"r{i}", "p", f"Step {i}", [f"r{i - 1}", "plain1"] if i else ["plain0"]) for i in range(4)]
    circle = [("s", "1", "x", "p", "X", ["y"]), ("s", "1", "y", "p", "Y", ["x"]), ("s", "1", "z", "p", "Z", ["plain0", "x"])]
    plain = [("s", "1", f"plain{i}", f"p{i}", "Same", None if i % 2 else []) for i in range(n)]
    new = RT.plan(state, sources(spark, ("s", "1", "q", None)), candidates(spark, *plain, *chain, *circle), save=save)
    got = outcomes(new["results"])
    assert [got["s", c] for c in ("r0", "r1", "r2", "r3", "x", "y", "z")] == ["written"] * 4 + ["relation"] * 3
    assert all(got["s", f"plain{i}"] == "written" for i in range(n))
    whole = [c for rows, c in sizes if rows >= n]
    # candidates, first ones of each memory, placed, the least numbers, judged, done: none of the rounds
    assert len(whole) <= 6 and sum("receipt" in c for c in whole) <= 1


def test_candidates_are_dealt_out_and_written_once(spark):
    state = {n: spark.createDataFrame([], s) for n, s in RT.SCHEMAS.items()}
    sizes = []

    def save(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    n = 300
    plain = [("s", "1", f"plain{i}", "p", "Same", None) for i in range(n)]
    odd = [("s", "1", "null", "p", "N", [None]), ("s", "1", "both", "p", "B", ["plain0", None]), ("s", "1", "twice", "p", "Rent: 7", ["plain0", "plain0"]), ("s", "1", "row", "p", "| Rent | 8 |", ["plain1"]), ("s", "1", "late", "p", "L", ["plain9"])]
    odd += [("s", "1", "plain3", "p", "", None), ("t", "1", "lost", "p", "Other", ["plain0"])]
    new = RT.judge(state, sources(spark, ("s", "1", "q", None), ("t", "1", "q", "0")), candidates(spark, *plain, *odd), save)
    got = sorted((r["candidate"], r["reason"] or r["outcome"]) for r in new["results"].collect() if not r["candidate"].startswith("plain") or r["outcome"] == "duplicate")
    assert got == [("both", "relation"), ("late", "relation"), ("lost", "relation"), ("null", "relation"), ("plain3", "duplicate"), ("row", "conflict"), ("twice", "written")]
    assert new["results"].count() == n + len(odd)
    # only the candidates themselves; what is made of them is as small as the rows with relations or the first ones
    assert sum(x >= n for x in sizes) == 1


def test_a_chain_costs_one_table_a_round(spark):
    ids = spark.createDataFrame([("s", "1", "c0")], "source_id string, revision string, candidate string")
    links = spark.createDataFrame([("s", "1", f"c{i}", f"c{i - 1}") for i in range(1, 5)] + [("s", "1", "x", "y"), ("s", "1", "y", "x"), ("t", "1", "c1", "c0")], "source_id string, revision string, candidate string, _to string")
    saved = []
    got = RT.retained_closure(ids, links, lambda df: saved.append(1) or keep(df))
    assert sorted(r["candidate"] for r in got.collect()) == ["c1", "c2", "c3", "c4"] and len(saved) == 5
