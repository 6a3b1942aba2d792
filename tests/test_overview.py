import random

import pytest

from cairn.operators import conflicts as C
from cairn.operators import overview as O


def test_disagreement_by_classes_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, f"s{rng.randrange(6)}", f"a{rng.randrange(2)}", f"p{rng.randrange(3)}", rng.randrange(9), rng.choice(["10", "EUR 10", "1,000", "1000 eur", "7", "none", ""])) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, subject string, attribute string, page string, line int, value string")
    num = lambda v: "".join(c for c in v if c.isdigit())
    against = {a[0] for a in rows for b in rows if a[1:3] == b[1:3] and a[3] != b[3] and num(a[5]) and num(b[5]) and num(a[5]) != num(b[5])}
    assert {r["id"] for r in C.disagreeing(df).collect()} == against
    want = {}
    for r in sorted((r for r in rows if r[0] in against), key=lambda r: (r[3], r[4], r[0])):
        want.setdefault(r[1:3], r[0])
    assert {(r["subject"], r["attribute"]): r["anchor"] for r in C.anchors(df).collect()} == want
    classes = {(r["subject"], r["attribute"], r["class"]): r["facts"] for r in C.value_classes(df).collect()}
    assert set(want) == {k[:2] for k in classes} and all(n == sum(r[1:3] == k[:2] and num(r[5]) == k[2] for r in rows) for k, n in classes.items())
    assert C.anchors(df.limit(0)).count() == 0


SCOPES = "slug string, type string, declared boolean, folder string, types array<string>, exclude array<string>"


def test_overview_scopes_and_members(spark):
    bad = ["", "/a", "a/", "a//b", "a/../b", "./a", "a:b", "a\\b", "a*", "x" * 501]
    rows = [(f"bad{i}", "t", True, f, ["x"], None) for i, f in enumerate(bad)]
    rows += [("types0", "t", True, "a", [], None), ("types9", "t", True, "a", list("abcdefghi"), None), ("twice", "t", True, "a", ["x", "x"], None), ("blank", "t", True, "a", [" x"], None), ("none", "t", True, "a", None, None)]
    rows += [("out", "t", True, "a", ["x"], ["b/c"]), ("same", "t", True, "a", ["x"], ["a/b", "a/b"]), ("bare", "overview", False, None, None, None), ("plain", "t", False, None, None, None)]
    rows += [("a/me", "x", True, "a", ["x"], ["a/skip"]), ("few", "t", True, "a/b", ["x", "y"], None), ("empty", "t", True, "q", ["x"], None)]
    pages = [(f"a/p{i:02d}", "x", "knowledge") for i in range(40)] + [("a/skip", "x", "knowledge"), ("a/me", "x", "knowledge"), ("a/src", "x", "source"), ("A/z", "x", "knowledge"), ("ab/c", "x", "knowledge"), ("a/b/Two", "y", "knowledge"), ("a/b/one", "x", "knowledge"), ("a/b", "x", "knowledge")]
    members, coverage = O.overview_members(spark.createDataFrame(rows, SCOPES), spark.createDataFrame(pages, "slug string, type string, role string"))
    got = {r["overview"]: (r["status"], r["limit_reached"]) for r in coverage.collect()}
    assert all(v == ("invalid_scope", False) for k, v in got.items() if k not in ("bare", "a/me", "few", "empty")) and len(got) == len(rows) - 1
    assert got["bare"] == ("missing_scope", False) and got["a/me"] == ("partial", True) and got["few"] == got["empty"] == ("complete", False)
    held = {}
    for r in members.orderBy("rank").collect():
        held.setdefault(r["overview"], []).append(r["slug"])
    assert held["few"] == ["a/b/one", "a/b/Two"] and "empty" not in held
    assert held["a/me"] == ["a/b", "a/b/one", *(f"a/p{i:02d}" for i in range(28))]


@pytest.mark.parametrize(("left", "want"), [(1000, (1, 2, 2)), (149, (1, 2, 1)), (129, (1, 2, 0)), (109, (1, 1, 0)), (79, (1, 0, 0)), (59, (0, 0, 0)), (9, None)])
def test_whole_entries_are_cut_from_the_end(left, want):
    assert O._fit(left, 10, 50, [20, 30], [20, 25]) == want


def test_evidence_limits(spark, monkeypatch):
    monkeypatch.setattr(O, "LOOKED_AT", 6)
    monkeypatch.setattr(O, "TAKEN", 3)
    sources = spark.createDataFrame([(1, s, s, 10, 0) for s in ("b", "A", "c")] + [(2, "a", "a", 99, 0)], "subject int, source string, slug string, head int, summary int")
    rows = [(1, "A", "fact", i, 20, "stale" if i == 1 else None) for i in range(9)] + [(1, "b", "event", 1, 3000, None), (1, "b", "event", 2, 15, None), (1, "c", "fact", 1, 40, None), (1, "zz", "fact", 1, 1, None)]
    pages, kept, left = O.select_evidence(sources, spark.createDataFrame(rows, "subject int, source string, kind string, ord int, length int, issue string"), budget=98)
    assert {(r["subject"], r["source"]): (r["facts"], r["events"]) for r in pages.collect()} == {(1, "A"): (3, 0), (1, "b"): (0, 1)}
    assert sorted((r["source"], r["ord"]) for r in kept.collect()) == [("A", 0), ("A", 2), ("A", 3), ("b", 2)]
    got = {(r["subject"], r["source"], r["reason"]): 0 for r in left.collect()}
    for r in left.collect():
        got[r["subject"], r["source"], r["reason"]] += r["n"]
    assert got == {(1, "A", "stale"): 1, (1, "A", "fact_limit"): 3, (1, "b", "span_limit"): 1, (1, "c", "prompt_limit"): 2, (2, "a", "prompt_limit"): 1}
