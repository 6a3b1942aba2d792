"""Operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.functions import markdown as MD
from cairn.functions.confidence import confidence
from cairn.functions.text import attribute_value, conflicts, containment, content_words, identity_codes, light_stem, light_stem_of, match_terms, numbers, slug
from cairn.operators import evidence as E
from cairn.operators import filters as FI
from cairn.operators import graph as G
from cairn.operators import links as L
from cairn.operators import maintenance as M
from cairn.operators import metrics as ME
from cairn.operators import retrieval as R
from cairn.operators import temporal as T
from cairn.plans import ops


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark,
        n=numbers(lit("EUR 1,450.50 and 3")),
        same=conflicts(lit("€33"), lit("€33/month")),
        other=conflicts(lit("€33"), lit("€47")),
        unsure=conflicts(lit("yes"), lit("no 3")),
        kv=attribute_value(lit("- **Premium**: €33/month")),
        row=attribute_value(lit("| Premium | €33 | x |")),
        url=attribute_value(lit("See: https://a.example/1")),
        soft=attribute_value(lit("Name: plain words")),
        slug=slug(lit("Hello, World 2!")),
        codes=identity_codes(lit("AB-12, ab-12 and X9 QQ777")),
        words=content_words(lit("They saw [[page|x]] the Wicked film")),
    )
    assert r["n"] == ["1450.50", "3"]
    assert (r["same"], r["other"], r["unsure"]) == (False, True, False)
    assert tuple(r["kv"]) == ("premium", "€33/month") and tuple(r["row"]) == ("premium", "€33")
    assert r["url"] is None and r["soft"] is None
    assert r["slug"] == "hello-world-2" and r["codes"] == ["AB-12", "QQ777"] and set(r["words"]) == {"saw", "wicked", "film"}
    for w in ("policies", "ties", "boxes", "cats", "glass", "as"):
        assert one(spark, s=light_stem(F.lit(w)))["s"] == light_stem_of(w)
    a, b = F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "abc"))
    assert one(spark, c=containment(a, b), small=containment(F.slice(a, 1, 2), b)).asDict() == {"c": 1.0, "small": 0.0}
    assert match_terms("What's -the- X? ünï 'q' b-c") == ["what's", "the", "ünï", "b-c"]


def test_confidence_orders_claims(spark):
    rows = [("- **Premium:** 33 EUR per month", "Premium: 33 EUR per month", "policy", "premium"), ("Maybe it is 33?", "Maybe it is 33", None, None), ("UTILITIES", "UTILITIES", None, None)]
    df = spark.createDataFrame(rows, "s string, c string, subj string, attr string")
    keyed, hedged, label = (r[0] for r in df.select(confidence(F.col("s"), F.col("c"), F.col("subj"), F.col("attr"))).collect())
    assert 0.05 <= label < hedged < keyed <= 0.98


def arm(spark, rows):
    return spark.createDataFrame(rows, "id long, score double, rank int, relevance double")


def test_fusion_window_and_budget(spark):
    a = arm(spark, [(1, 9.0, 1, None), (2, 8.0, 2, None), (3, 7.0, 3, None)])
    b = arm(spark, [(3, 0.9, 1, 0.9), (4, 0.8, 2, 0.8), (1, 0.7, 3, 0.7)])
    f = {r["id"]: r for r in R.fuse([a, b], "id").collect()}
    assert f[1]["score"] == pytest.approx(1 / 61 + 1 / 63) and f[3]["rank"] == 2 and f[1]["rank"] == 1 and f[3]["relevance"] == 0.9
    assert R.fuse([a], "id", scores=True).collect() == a.collect()
    hits = arm(spark, [(i, 1.0 / i, i, {4: 0.2, 5: 0.9, 6: 0.9}.get(i)) for i in range(1, 9)])
    assert sorted(r["id"] for r in R.rerank_window(hits, "id", 3).collect()) == [1, 2, 5]
    cards = spark.createDataFrame([(1, 1, 900), (2, 2, 300), (3, 3, 90), (4, 4, 20)], "rank int, id long, cost long")
    assert sorted(r["id"] for r in R.fill_budget(cards, "id", "cost", 120).collect()) == [1]  # the first always, then all are over
    assert sorted(r["id"] for r in R.fill_budget(cards, "id", "cost", 1000).collect()) == [1, 3]
    assert sorted(r["id"] for r in R.stop_budget(cards, "cost", 1200).collect()) == [1, 2]
    m = {r["id"]: r["rank"] for r in R.best_rank_merge(a, b, "id").collect()}
    assert m == {1: 2, 3: 1, 2: 3, 4: 4} or m == {1: 1, 3: 2, 2: 3, 4: 4}


def test_bm25_against_plain_python(spark):
    import math

    docs = [(1, "red fox jumps"), (2, "red red fox"), (3, "blue whale sings low"), (4, None), (5, "fox red fox red fox")]
    got = {r["id"]: r["score"] for r in R.bm25(spark.createDataFrame(docs, "id long, text string"), "red fox", {"text": 1.0}, "id").collect()}
    toks = {i: (t or "").split() for i, t in docs}
    phrase = {i: sum(toks[i][k : k + 2] == ["red", "fox"] for k in range(len(toks[i]))) for i in toks}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    score = {}
    for f in (lambda i: toks[i].count("red"), lambda i: toks[i].count("fox"), lambda i: phrase[i]):
        df = sum(f(i) > 0 for i in toks)
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for i in toks:
            if f(i):
                score[i] = score.get(i, 0) + idf * f(i) * 2.2 / (f(i) + 1.2 * (0.25 + 0.75 * len(toks[i]) / avg))
    assert got == {i: pytest.approx(s, abs=1e-6) for i, s in score.items()}
    assert R.bm25(spark.createDataFrame(docs, "id long, text string"), "? !", {"text": 1.0}, "id").count() == 0


def test_traversal_is_bounded_and_first_discovery_wins(spark):
    e = [("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.7), ("a", "d", 0.9), ("d", "c", 0.99)] + [("hub", f"n{i:02}", 0.5) for i in range(60)] + [("c", "hub", 0.4)]
    edges = spark.createDataFrame([(f"{x}{y}", x, y, "r", s) for x, y, s in e], "id string, from_node string, to_node string, relation string, confidence double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {r["node"]: r for r in G.traverse(edges, seeds, hops=1).collect()}
    assert set(got) == {"b", "d", "c"}
    out = {r["node"]: r for r in G.traverse(edges, seeds, hops=2, direction="out").collect()}
    assert out["c"]["path"] == ["a", "b", "c"] and out["c"]["confidence"] == 0.72
    far = G.traverse(edges, spark.createDataFrame([("hub",)], "seed string"), hops=1, direction="out", limit=100).collect()
    assert len(far) == 50  # fan-out
    assert len(G.traverse(edges, seeds, hops=3, limit=5).collect()) == 5


def test_names_resolve_or_abstain(spark):
    t = spark.createDataFrame([("e1", "Ann Lee", "x"), ("e2", "ann-lee", "Bo"), ("e3", "Bo", "y")], "e string, title string, base string")
    names = G.names(t, "e", title="title", basename="base")
    got = {r["mention"]: (r["resolution"], r["entity"]) for r in G.resolve(spark.createDataFrame([("ANN  LEE",), ("bo",), ("zed",)], "mention string"), names, "mention").collect()}
    assert got == {"ANN  LEE": ("ambiguous", None), "bo": ("exact", "e3"), "zed": ("unresolved", None)}
    assert [r["name"] for r in G.collisions(names).collect()] == ["ann lee"]


def times(spark, rows):
    return spark.createDataFrame(rows, "id long, start string, until string, precision string, relation string, disposition string, timezone string, temporal_status string, type string, summary string")


def test_clock_relations(spark):
    base = dict(u=None, p="day", r="scheduled", d="active", tz=None)
    cases = [
        ("today", dict(s="2024-03-10")), ("future", dict(s="2024-03-11")), ("past", dict(s="2024-03-09")), ("overdue", dict(s="2024-03-09", r="due")),
        ("past", dict(s="2024-03-09", r="due", d="completed")), ("current_period", dict(s="2024-03", p="month")), ("future", dict(s="2025", p="year")),
        ("ongoing", dict(s="2024-03-01", u="2024-03-20")), ("ongoing", dict(s="2024-03-01", r="valid")), ("undated", dict(s=None)), ("undated", dict(s="2024", p="unknown")),
        ("today", dict(s="2024-03-10T01:00:00Z", p="instant")), ("future", dict(s="2024-03-11T01:00:00Z", p="instant")), ("today", dict(s="2024-03-11", tz="Asia/Tokyo")),
    ]
    rows = []
    for i, (_, c) in enumerate(cases):
        c = base | c
        rows.append((i, c["s"], c["u"], c["p"], c["r"], c["d"], c["tz"], "planned", "m", "x"))
    got = times(spark, rows).select("id", T.classify(F.lit("2024-03-10 20:00:00").cast("timestamp")).alias("k")).collect()
    assert {r["id"]: r["k"] for r in got} == {i: k for i, (k, _) in enumerate(cases)}


def test_recurrence_skips_days_that_are_missing(spark):
    kind = "id long, start string, frequency string, interval int, weekdays array<string>, series_until string"
    rows = [(1, "2024-01-31", "monthly", 1, None, None), (2, "2024-02-29", "yearly", 1, None, None), (3, "2024-01-03", "weekly", 2, ["mo", "we"], "2024-02-10"), (4, "2024-01-30", "daily", 3, None, None)]
    got = {}
    for r in T.expand(spark.createDataFrame(rows, kind), "2024-01-01", "2028-03-01").collect():
        got.setdefault(r["id"], []).append(str(r["occurrence"]))
    assert got[1][:3] == ["2024-01-31", "2024-03-31", "2024-05-31"]
    assert got[2] == ["2024-02-29", "2028-02-29"]
    assert got[3] == ["2024-01-03", "2024-01-08", "2024-01-17", "2024-01-22", "2024-01-31", "2024-02-05"]
    assert got[4][:2] == ["2024-01-30", "2024-02-02"]
    assert T.expand(spark.createDataFrame(rows, kind), "2024-01-01", "2028-03-01", limit=3).count() == 3


def test_dates_in_prose_and_partial_dates(spark):
    r = one(spark, d=T.dates_in(F.lit("From 2024-02-30 to 3 March 2024, march 5, 2024 and 2024-03-03; 1 May 1850")), e=FI.period_end(F.lit("2024-02")), y=FI.period_end(F.lit("2023")), s=FI.period_start(F.lit("2024-02")))
    assert [str(x) for x in r["d"]] == ["2024-03-03", "2024-03-05"] and (str(r["e"]), r["y"], r["s"]) == ("2024-02-29", "2023-12-31", "2024-02-01")


def test_supersession_and_replay(spark):
    facts = spark.createDataFrame([("a", "l1", "c", None), ("b", "l2", "c", None), ("c", "l3", "c", None)], "id string, line_hash string, claim string, valid_to date")
    fresh = spark.createDataFrame([("a", "l1", "c"), ("n", "l2", "new")], "id string, line_hash string, claim string")
    lines = spark.createDataFrame([("l1",), ("l2",)], "line_hash string")
    assert {r["id"]: r["action"] for r in E.supersede(facts, fresh, lines, "2024-01-01").collect()} == {"a": "refresh", "b": "delete", "c": "close", "n": "insert"}
    ledger = spark.createDataFrame([("k2", "d")], "key string, digest string")
    req = spark.createDataFrame([("k1", "x", 1), ("k1", "x", 2), ("k1", "y", 3), ("k2", "d", 4), ("k2", "e", 5)], "key string, digest string, at long")
    assert [r["outcome"] for r in E.replay(ledger, req, ["key"], "digest", "at").orderBy("at").collect()] == ["accepted", "replay", "conflict", "replay", "conflict"]


def test_renditions_links_and_rules(spark):
    p = spark.createDataFrame([("a.pdf",), ("a.pdf.txt",), ("b.pdf",), ("b.txt",), ("c.pdf",), ("c.txt",), ("c.md",)], "path string")
    assert {r["path"]: r["rendition"] for r in E.renditions(p, "path").collect()} == {"a.pdf": "a.pdf.txt", "b.pdf": "b.txt"}
    lines = spark.createDataFrame([("x/p", "x", 1, "See [[home]] and ![[pic.png]] [t](../y/q.md#s)"), ("x/p", "x", 2, "[[home|again]]")], "page string, folder string, line int, text string")
    got = {(r["to_slug"], r["kind"], r["line"]) for r in L.markdown_links(lines, "page", "folder").collect()}
    assert got == {("home", "wikilink", 1), ("pic.png", "embed", 1), ("y/q", "markdown", 1)}
    pages = spark.createDataFrame([("a/b/c.md",), ("a/x.md",)], "path string")
    rules = [{"glob": "**", "role": "knowledge"}, {"glob": "a/*.md", "role": "source", "kind": "k"}]
    assert [(r["role"], r["kind"]) for r in FI.apply_rules(pages, rules, "path", ["role", "kind"]).collect()] == [("knowledge", None), ("source", "k")]
    assert M.folder_counts(pages, "path").first().asDict() == {"child": "a", "direct": 1, "deep": 2, "folders": 1}


def test_metrics(spark):
    run = spark.createDataFrame([(1, 1, 3), (1, 2, 0), (1, 3, 2), (2, 1, 0), (2, 2, 0)], "case long, rank int, grade int")
    got = {r["case"]: r for r in ME.ranking(run).collect()}
    import math

    assert got[1]["ndcg"] == pytest.approx((7 + 3 / math.log2(4)) / (7 + 3 / math.log2(3)), abs=1e-6) and got[1]["mrr"] == 1.0 and got[1]["inversions"] == 1
    assert got[2]["ndcg"] == 0 and got[2]["mrr"] == 0
    s = spark.createDataFrame([(0.9, True), (0.6, True), (0.3, False), (0.5, False)], "s double, p boolean")
    assert ME.calibration(s, "s", "p").first()[0] == pytest.approx(0.55)


PAGE = """---
title: My page
tags: [a, B]
about:
  - x
---
# Head
Intro
- **2024-01-02** | Met [[ann]]
- **2024-01-02** | met [[ann]]
## One
<!-- memory id=1 -->
- payload
Line after
## Two
"""


def test_markdown_pages(spark, tmp_path):
    p = MD.parse_page("x/my-page.md", PAGE)
    assert (p.slug, p.title, p.fields["tags"], p.fields["about"]) == ("x/my-page", "My page", ["a", "B"], ["x"])
    assert [(e[0], e[2]) for e in p.events] == [("2024-01-02", "ann")]
    chunks = MD.chunk_page(p)
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert any(c[3].startswith("<!-- memory") and "payload" in c[3] and "after" not in c[3] for c in chunks)
    long_ = MD.parse_page("l.md", "# T\n## S\n" + "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(40)) + "\n" + "y" * 9000)
    pieces = MD.chunk_page(long_)
    assert all(len(c[3]) <= MD.LARGEST for c in pieces) and len(pieces) > 4
    assert all(f"Paragraph {i} " in "".join(c[3] for c in pieces) for i in range(40))
    assert MD.cut("One. Two three. Four", 16) == ["One. Two three.", "Four"]
    assert MD.merge_conflict("<<<<<<< a\nx\n=======\ny\n>>>>>>> b") and not MD.merge_conflict("```\n<<<<<<< a\n=======\n>>>>>>> b\n```")
    from cairn.sources import markdown as S

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "my-page.md").write_text(PAGE)
    (tmp_path / ".hidden.md").write_text("no")
    (tmp_path / "a.txt").write_text("plain")
    files = S.scan(spark, str(tmp_path))
    assert {r["rel_path"]: r["kind"] for r in files.collect()} == {"x/my-page.md": "page", "a.txt": "attachment"}
    parsed = S.pages(files)
    assert parsed.first()["slug"] == "x/my-page" and S.chunks(parsed).count() == len(chunks) and S.events(parsed).count() == 1


def test_streams(spark, tmp_path):
    from cairn.streaming.watch import index_batches, replay_stream, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(PAGE)
    for _ in range(2):  # the second run finds nothing new
        watch(spark, str(tmp_path / "in"), index_batches(str(tmp_path / "out")), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(MD.chunk_page(MD.parse_page("a.md", PAGE)))
    kind = "actor string, op string, key string, request long, digest string"
    spark.createDataFrame([("a", "w", "k", 1, "d"), ("a", "w", "k", 2, "d"), ("a", "w", "k", 3, "e")], kind).coalesce(1).write.parquet(str(tmp_path / "req"))
    q = replay_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "req"))).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r["outcome"] for r in spark.table("replayed").collect()) == ["accepted", "conflict", "replay"]


def test_operations(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    env = ops.recall(docs, "the ontion erth")
    assert env.status == "ok" and 0 < len(env.rows) <= 8 and env.info["mode"] == "lookup"
    assert ops.recall(docs, "zzzzqq").status == "empty"
    assert ops.recall(docs, "the", query_vector=[1.0]).reasons == ["no_vectors"]
    assert ops.context(docs, "the ontion", pinned=[3]).info["pinned"] == 1
    assert ops.read(docs, "doc_id", 5).status == "ok" and ops.read(docs, "doc_id", -1).status == "empty"
    assert ops.infer_mode("What is the plan?") == "question" and ops.infer_view("what did she say she said") == "reports"
    assert ops.split_parts("tea and coffee") == ["tea", "coffee"] and ops.concepts("red fox blue") == ["red fox", "blue"]
    rows = times(spark, [(1, "2024-01-01", None, "day", "occurred", "active", None, "actual", "m", "Met Ann"), (2, "2030", None, "year", "due", "active", None, "planned", "m", "Renew")])
    t = ops.timeline(rows, "2024-02-01 00:00:00", scope="future")
    assert [r["id"] for r in t.rows] == [2] and t.info["facets"]


def test_schema_guard(spark):
    df = spark.createDataFrame([], schemas.LINKS)
    assert schemas.validate(df, schemas.LINKS).columns == schemas.LINKS.fieldNames()
    with pytest.raises(ValueError, match="line"):
        schemas.validate(df.drop("line"), schemas.LINKS)
    assert schemas.outside(spark.createDataFrame([("knowledge",), ("bad",), (None,)], "role string"), "role", schemas.ROLES).count() == 1


def test_unicode_and_stems(spark):
    from cairn.functions.unicode import fold, fold_diacritics, nfkc, porter, porter_stems

    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll".split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]
    assert fold("Éǆ ﬁ ö") == "Edz fi o"
    r = spark.createDataFrame([("É ﬁ", ["cats", "ties", "cats"]), (None, None)], "t string, w array<string>").select(fold_diacritics(F.col("t")), nfkc(F.col("t")), porter_stems(F.col("w"))).collect()
    assert tuple(r[0]) == ("E fi", "É fi", ["cat", "ti", "cat"]) and tuple(r[1]) == (None, None, None)


def test_changes_to_files(spark):
    from cairn.operators import changes as C

    files = spark.createDataFrame([("a.md", "A [[x/old]] [[x/old|t]]"), ("x/old.md", "O"), ("x/old/pic.png", "P"), ("x/older.md", "Q")], "path string, text string")
    links = spark.createDataFrame([("a.md", "x/old")], "from_page string, to_slug string")
    moved = {r["path"]: r["text"] for r in C.move(files, links, "x/old.md", "y/new.md").collect()}
    assert moved == {"a.md": "A [[y/new]] [[y/new|t]]", "y/new.md": "O", "y/new/pic.png": "P", "x/older.md": "Q"}
    edits = spark.createDataFrame([("a.md", "append", "more"), ("n.md", "create", "N"), ("x/old.md", "create", "no"), ("zz.md", "append", "no")], "path string, mode string, text string")
    after, journal = C.apply(files, edits, "c")
    assert {r["path"] for r in journal.collect()} == {"a.md", "n.md"}
    assert sorted(map(tuple, C.undo(after, journal).collect())) == sorted(map(tuple, files.collect()))
    touched = after.withColumn("text", F.when(F.col("path") == "n.md", "changed").otherwise(F.col("text")))
    assert sorted(map(tuple, C.undo(touched, journal).collect())) == sorted(map(tuple, touched.collect()))  # no longer what the change left
    stay, gone = C.forget(files, spark.createDataFrame([("a.md",), ("none",)], "path string"), "path")
    assert stay.count() == 3 and [r["path"] for r in gone.collect()] == ["a.md"]
    d = spark.createDataFrame([(1, None, "s"), (2, None, "s"), (3, "p", "t"), (4, None, "taken")], "document int, page_id string, slug string")
    assert [tuple(r) for r in C.adopt(d, spark.createDataFrame([("taken",)], "slug string")).collect()] == [("s", 1)]


def test_index_again_equals_rebuild(spark, tmp_path):
    from cairn.plans import index as I

    root, out = tmp_path / "kb", str(tmp_path / "idx")
    (root / "n").mkdir(parents=True)
    (root / "a.md").write_text(PAGE + "\nSee [[b]] and [c](n/c.md)")
    (root / "b.md").write_text("# B\nback to [[a]]")
    (root / "n" / "c.md").write_text("# C")
    (root / "pic.png").write_bytes(b"x")
    I.index(spark, str(root), out, 1)
    (root / "b.md").write_text("# B\nnow to [[gone]] instead")
    (root / "n" / "c.md").rename(root / "n" / "d.md")
    change = {r["rel_path"]: r["change"] for r in I.index(spark, str(root), out, 2, before=1).collect()}
    assert change == {"a.md": "same", "b.md": "changed", "n/c.md": "removed", "n/d.md": "added", "pic.png": "same"}
    I.index(spark, str(root), out, 3)
    for name in I.TABLES:
        a, b = (sorted(map(str, I.table(spark, out, v, name).select(*sorted(I.table(spark, out, v, name).columns)).collect())) for v in (2, 3))
        assert a == b, name
    links = {(r["from_page"], r["to_slug"]): r["broken"] for r in I.table(spark, out, 2, "links").collect()}
    assert links == {("a", "ann"): True, ("a", "b"): False, ("a", "n/c"): True, ("b", "gone"): True}
    assert [tuple(r) for r in I.moved(spark, out, 1, 2).collect()] == [("n/c.md", "n/d.md")]


def test_scopes_orders_and_automatic_recall(spark):
    from cairn.operators.prose import discourse
    from cairn.plans.schedule import schedule

    text = "Plain.\n# Plans\nBuy milk\n## Open questions\nWhen\n# Notes\nMaybe so\n\nDone"
    got = {r["line"]: r["view"] for r in discourse(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id").filter("reason <> 'heading'").collect()}
    assert got == {1: "factual", 3: "planning", 5: "questions", 7: "discussion", 9: "factual"}
    assert schedule("abcd", {"a": "c", "c": "d"}) == ["b", "d", "c", "a"]
    with pytest.raises(ValueError, match="circle"):
        schedule("ab", {"a": "b", "b": "a"})
    rows = spark.createDataFrame([(1, 1, "plausible"), (2, 2, "strong"), (3, 3, "dual"), (4, 4, "strong"), (5, 5, "strong")], "id int, rank int, signal string")
    assert [r["id"] for r in R.automatic(rows, "id").collect()] == [2, 3, 4]
    assert [r["id"] for r in R.automatic(rows.withColumn("signal", F.when(F.col("id") == 5, "exact").otherwise(F.col("signal"))), "id").collect()] == [5]
    assert one(spark, c=R.clip_lines(F.lit("ab\ncd\nef"), F.lit(6)))["c"] == "ab\ncd"


def test_similar_pairs_meet_across_buckets(spark, monkeypatch):
    import random

    monkeypatch.setattr(M, "BUCKET", 8)
    rng = random.Random(5)
    rows = [(i, i % 3 if i % 11 else None, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)] + [(200, 0, None), (201, 0, [1.0, None, 0.0, 0.0]), (202, 0, [0.0] * 4), (203, 0, [1.0] * 3), (7, 1, [1.0, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 4)]
    v = spark.createDataFrame(rows, "id long, folder int, embedding array<double>")
    got = sorted((r["a"], r["b"], r["similarity"]) for r in M.similar_pairs(v, "id", "folder", least=0.2).collect())
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / ((sum(p * p for p in x) ** 0.5 or 1) * (sum(q * q for q in y) ** 0.5 or 1))
    full = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and None not in r[2]]
    want = sorted((x[0], y[0], round(cos(x[2], y[2]), 6)) for x in full for y in full if x[0] < y[0] and x[1] == y[1] and len(x[2]) == len(y[2]) and round(cos(x[2], y[2]), 6) >= 0.2)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert M.similar_pairs(v.limit(0), "id", "folder").count() == 0


def test_similar_pairs_of_a_whole_label(spark, data):
    from cairn.queries import QUERIES

    got = {(r["a"], r["b"]) for r in QUERIES["similar_pairs_label"](spark, data).collect()}
    part = {(r["a"], r["b"]) for r in QUERIES["similar_pairs_cosine"](spark, data).collect()}
    assert part < got and any((a - b) % 7 for a, b in got)


def test_follow_sees_changed_moved_and_removed_files(spark, tmp_path):
    from cairn.plans import index as I
    from cairn.streaming.watch import follow

    root, out = tmp_path / "in", str(tmp_path / "out")
    (root / "a").mkdir(parents=True)
    (root / "b").mkdir()
    (root / "a" / "x.md").write_text("# One")
    (root / "b" / "x.md").write_text("# Two")

    def tick():
        follow(spark, str(root), out, str(tmp_path / "cp"), once=True).awaitTermination(90)
        version = I.latest(spark, out)
        return version, {r["slug"]: r["title"] for r in I.table(spark, out, version, "pages").collect()}

    assert tick() == (1, {"a/x": "One", "b/x": "Two"})
    assert tick()[0] == 1  # nothing changed
    (root / "a" / "x.md").write_text("# Three, longer")
    (root / "b" / "x.md").rename(root / "b" / "y.md")
    assert tick() == (2, {"a/x": "Three, longer", "b/y": "Two"})
    assert [tuple(r) for r in I.moved(spark, out, 1, 2).collect()] == [("b/x.md", "b/y.md")]
    (root / "b" / "y.md").unlink()
    assert tick() == (3, {"a/x": "Three, longer"})


def test_replay_takes_requests_by_number(spark, tmp_path):
    from cairn.streaming.watch import replay_stream

    kind = "actor string, op string, key string, request long, digest string"
    spark.createDataFrame([("a", "w", "k", 9, "z"), ("a", "w", "k", 3, "d"), ("a", "w", "k", 5, "d")], kind).coalesce(1).write.parquet(str(tmp_path / "req"))
    q = replay_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "req"))).writeStream.format("memory").queryName("by_number").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r["request"]: r["outcome"] for r in spark.table("by_number").collect()} == {3: "accepted", 5: "replay", 9: "conflict"}


def test_recurrence_far_from_its_start(spark):
    """The index counts from the start of the series, wherever the range begins."""
    kind = "id long, start string, frequency string, interval int, weekdays array<string>, series_until string"
    rows = [(1, "1990-01-03", "daily", 3, None, None), (2, "1990-01-03", "weekly", 2, None, None), (3, "1990-01-03", "weekly", 2, ["mo", "we", "we"], None), (4, "1990-01-31", "monthly", 1, None, None), (5, "2030-01-01", "daily", 1, None, None), (6, "1990-01-01", "daily", 1, None, "1999-01-01")]
    df = spark.createDataFrame(rows, kind)
    every = {(r["id"], str(r["occurrence"])): r["index"] for r in T.expand(df, "1980-01-01", "2024-04-30").collect()}
    late = {(r["id"], str(r["occurrence"])): r["index"] for r in T.expand(df, "2024-03-01", "2024-04-30").collect()}
    assert late == {k: v for k, v in every.items() if k[1] >= "2024-03-01"} and {k[0] for k in late} == {1, 2, 3, 4}


def test_names_in_a_query_and_first_evidence(spark):
    names = spark.createDataFrame([("Red Fox", "red fox"), ("Fox", "fox"), ("Fox Hill", "fox hill"), ("red FOX", "red fox"), ("ox", "ox")], "name string, normalized string")
    assert G.names_in("Does the red fox, hill or a fox know?", names) == [("Fox Hill", 13, 21), ("Fox", 27, 30)]
    assert G.names_in("", names) == []
    assert R.distinct_queries(["Ann", " ann ", "", "Bob", "BOB"]) == ["Ann", "Bob"]
    hits = lambda *on: lambda: spark.createDataFrame([(i, x) for i, x in enumerate(on)], "id long, exact boolean")
    assert R.first_evidence([hits(False), hits(True), hits(True)])[0] == 1
    assert R.first_evidence([hits(), hits(False), hits()])[0] == 1


def test_rerank_marker_and_stop_words(spark):
    from cairn.functions.text import stop_words
    from cairn.operators.memory import marker

    rows = [(1, 0, 0.5, 2), (1, 1, 0.1, 2), (2, 0, 0.5, 2), (2, 0, 0.5, 2), (3, 0, float("nan"), 1), (4, 2, 1.0, 1), (5, 0, 1.0, 2)]
    got = R.complete_rerank(spark.createDataFrame(rows, "g long, index long, score double, n long"), "g", "n").collect()
    assert {r["g"]: r["complete"] for r in got} == {1: True, 2: False, 3: False, 4: False, 5: False}
    ok = "<!-- t:item ab-12 v=2 supports=s level=1 kind=plan subject=A%20b source-role=user reports=0 commitment=asserted disposition=active polarity=positive basis=direct -->"
    bad = [ok.replace("v=2", "v=1"), ok.replace("reports=0", "reports=1"), ok.replace("kind=plan ", ""), ok.replace("basis=direct", "basis=direct start=2024"), ok.replace("kind=plan", "kind=plan kind=plan"), ok.replace("kind=plan", "colour=red"), "plain", None]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate([ok, *bad])], "i int, x string")
    found = {r["i"]: r["m"] for r in lines.select("i", marker(F.col("x"), "t:item").alias("m")).collect()}
    assert found[0]["id"] == "ab-12" and found[0]["fields"]["subject"] == "A b" and [i for i, m in found.items() if m] == [0]
    p = stop_words(["Vulpine Mutual", " ", "c++"])
    texts = spark.createDataFrame([("x/vulpine-mutual",), ("Vulpine_ mutuals",), ("uses C++.",), (None,)], "t string")
    assert [r[0] for r in texts.select(F.col("t").rlike(p)).collect()] == [True, False, True, None] and stop_words([" "]) is None


def test_recall_with_all_arms(spark):
    rows = [(1, "red fox runs", "page"), (2, "blue fox", "page"), (3, "green hill", "document"), (4, "fox den", "page"), (5, "nothing", "document")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    ids = lambda env: [r["doc_id"] for r in env.rows]
    plain = ops.recall(docs, "fox")
    assert set(ids(plain)) == {1, 2, 4}
    index = R.postings(docs, "doc_id"), spark.createDataFrame([(5.0, 2.2)], "n double, avg double")
    assert set(ids(ops.recall(docs, "fox", index=index))) == {1, 2, 4}
    arm = spark.createDataFrame([(3, 1, 0.9)], "doc_id long, rank int, relevance double")
    assert set(ids(ops.recall(docs, "fox", arms=[arm]))) == {1, 2, 3, 4}
    assert 3 in ids(ops.recall(docs, "fox", arms=[arm.withColumn("rank", F.lit(60))], limit=2, kind="kind"))
    assert 3 in ids(ops.recall(docs, "fox", expand=lambda q: [q.upper(), "green hill"]))
    states = spark.createDataFrame([(1, "contextual"), (2, "eligible"), (5, "eligible")], "doc_id long, state string")
    env = ops.recall(docs, "fox", states=states)
    assert ids(env) == [2] and env.info["selection"] == "eligible"
    env = ops.recall(docs, "red", states=states)
    assert ids(env) == [1] and env.info["selection"] == "contextual"
    judged = ops.recall(docs, "fox", judge=lambda q, w: w.select("doc_id", F.when(F.col("doc_id") == 4, 0.9).otherwise(0.6).alias("new_score")))
    assert ids(judged)[0] == 4
