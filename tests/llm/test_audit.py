import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from cairn.llm import audit
from tests.llm.helpers import awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def fails(text, first):
    w = text.encode().split()
    out = {"A"} if len(w) < 200 else set()
    out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if first else set())


def plain(docs, labels):
    """The report by running every order over every document."""
    good, toxic = {r[0] for r in labels if r[0] is not None and r[1] == 1}, {r[0] for r in labels if r[0] is not None and r[2] == 1}
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    rows = [(k, s or "", fails(t or "", k is not None and k > least[t or ""])) for k, t, s in docs]
    parts = {s for _, s, _ in rows}
    out, total = {}, Counter()
    for order in permutations("ABCDE"):
        alive = defaultdict(list)
        for r in rows:
            alive[r[1]].append(r)
        for step, f in enumerate(order, 1):
            for p in parts:
                gone = [r for r in alive[p] if f in r[2]]
                alive[p] = [r for r in alive[p] if f not in r[2]]
                every = [r for r in rows if r[1] == p and f in r[2]]
                total[p, f] += len(gone)
                out[p, "".join(order), step] = (len(alive[p]), len(gone), len(every) - len(gone), sum(r[2] == {f} for r in every), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(docs, labels):
    rows = audit.audit(docs, labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_against_every_order(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    want = plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r[c] for c in ("doc_id", "quality", "toxic")) for r in labels.collect()])
    assert len(want) == 600 * docs.select("source").distinct().count()
    assert got(docs.repartition(5), labels) == want


def test_audit_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1)], LABELS)
    want = plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert got(docs, labels) == want
    for name in ("part", "_h", "_doc", "_f0", "A", "E", "a.b", "_key", "n"):
        docs = docs.withColumn(name, F.col("doc_id"))
    assert got(docs, labels) == want
    assert audit.audit(empty(spark), labels).count() == 0
    assert got(awkward(spark), labels.limit(0)).keys() == want.keys()


def test_a_text_on_most_rows(spark, monkeypatch):
    monkeypatch.setattr(audit, "FREQUENT", 4)
    rows = [(i, "same words again", f"s{i % 3}") for i in range(400)] + [(i, f"text {i // 2}", None) for i in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    flags = {r["doc_id"]: r["E"] for r in audit.failures(docs).collect()}
    assert {k for k, v in flags.items() if not v} == {0, *range(400, 500, 2)}


def test_trie_visits_each_set_of_filters_once(spark):
    rows = spark.createDataFrame([(i,) for i in range(64)], "x long")
    bit = lambda i: F.col("x").bitwiseAND(1 << i) != 0
    edges = audit.trie(rows, F.lit("p"), {f"f{i}": bit(i) for i in range(3)}, {"low": F.col("x") < 8}).collect()
    assert sorted((r["state"], r["filter"]) for r in edges) == [(s, i) for s in range(7) for i in range(3) if not s >> i & 1]
    for r in edges:
        left = 64 >> bin(r["state"]).count("1")
        assert (r["n"], r["removed"], r["low"]) == (left, left // 2, left // 16)
