import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import minhash, mixing, queries, sharding
from tests.llm.helpers import awkward, empty


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Plain re-sharing until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = goal - sum(full.values())
        got = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return full | got
        full |= {s: cap * sizes[s] for s in over}


def test_mix_targets_and_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.plan_mix(docs).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["__size"]
        taken[r["source"]] += r["__taken"]
        largest[r["source"]] = max(largest[r["source"]], r["__size"])
        assert 0 <= r["__taken"] <= 2 * r["__size"]
        assert r["__size"] == len((r["text"] or "").encode().split())
    want = targets(sizes)
    for r in rows:
        assert r["__target"] == pytest.approx(want[r["source"]])
        assert r["__source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["__taken"]) for r in rows) == Counter((r["doc_id"], r["__taken"]) for r in again)


def test_mix_emits_each_copy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = {r["doc_id"]: r["__copies"] for r in mixing.plan_mix(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({k: v for k, v in plan.items() if v})


def test_columns_with_internal_names(spark):
    names = "_src _null _hash __size _p _m _shift _doc _id _rank __copies __copy _row _h _piece _leaf _k _key _kept_key _kept_key_ _salt _w _text".split()
    docs = awkward(spark)
    for n in names:
        docs = docs.withColumn(n, F.col("doc_id"))
    plain = awkward(spark)
    count = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert mixing.mix(docs).columns == docs.columns and count(mixing.mix(docs)) == count(mixing.mix(plain))
    assert mixing.plan_mix(docs).count() == docs.count()
    assert minhash.deduplicate(docs).columns == docs.columns and count(minhash.deduplicate(docs)) == count(minhash.deduplicate(plain))
    assert sharding.shard(docs, n_shards=3).count() == docs.count()
    assert all(r["_shift"] == r["doc_id"] for r in mixing.mix(docs).collect())


def test_mix_awkward_rows(spark):
    docs = awkward(spark)
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["__size"] == 0 for r in rows if not (r["text"] or "").strip())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan_mix(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["__taken"] for r in mixing.plan_mix(blank).collect()} == {0}


def check_shards(rows, docs, n):
    text = {r["_row"] if "_row" in r else i: r for i, r in enumerate(rows)}
    assert len(text) == len(docs)
    total, largest_group = Counter(), defaultdict(int)
    groups = defaultdict(set)
    slots = defaultdict(list)
    for r in rows:
        total[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        largest_group[r["text_crc32"], r["size"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    leaf = sum(total.values()) / n
    assert all(0 <= s < n for s in total)
    for g, where in groups.items():
        if largest_group[g] <= leaf:
            assert len(where) == 1
    return total, leaf


def test_shards_are_even_and_keep_groups(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.shard(docs, n_shards=16).collect()
    total, leaf = check_shards(rows, docs.collect(), 16)
    biggest = max(r["size"] for r in rows)
    assert max(abs(total[s] - leaf) for s in range(16)) <= max(biggest, leaf / 4)
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert all(want[r["doc_id"]] == (r["size"], r["text_crc32"]) for r in rows)


def test_shards_by_target_bytes_and_hot_group(spark):
    rows = [(i, "same text", "en", "s") for i in range(600)] + [(1000 + i, f"text {i} " * 3, "de", "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = sum(len(r[1]) + 1 for r in rows)
    out = sharding.shard(docs, target_bytes=size // 7).collect()
    total, leaf = check_shards(out, rows, len({r["shard"] for r in out}))
    assert max(total.values()) <= 1.5 * leaf


def plain_tree(rows, leaves):
    """doc_id -> leaf by the definition, over (doc_id, text, lang, source) of different light texts."""
    import hashlib
    import math

    order = [{v: i for i, v in enumerate(sorted({r[c] or "" for r in rows}))} for c in (3, 2)]
    items = [(len(t.encode()) + 1, (float(i), math.log2(len(t.encode()) + 1), float(order[0][s or ""]), float(order[1][g or ""])), hashlib.md5(t.encode()).hexdigest(), i) for i, t, g, s in rows]
    span = [max(1e-9, max(x[1][d] for x in items) - min(x[1][d] for x in items)) for d in range(4)]
    out = {}

    def part(some, leaf, k):
        if k == 1:
            out.update({x[3]: leaf for x in some})
            return
        wide = [(max(x[1][d] for x in some) - min(x[1][d] for x in some)) / span[d] for d in range(4)]
        d = wide.index(max(wide))
        total, half, before, sides = sum(x[0] for x in some), -(-k // 2), 0, ([], [])
        for x in sorted(some, key=lambda x: (x[1][d], x[2])):
            sides[before + x[0] / 2 > total * half / k].append(x)
            before += x[0]
        part(sides[0], leaf, half)
        part(sides[1], leaf + half, k - half)

    part(items, 0, leaves)
    return out


@pytest.mark.parametrize("leaves", [1, 5, 16])
def test_shards_against_a_plain_tree(spark, leaves):
    import random

    rng = random.Random(7)
    rows = [(i, f"text {i} " * rng.randrange(1, 9), rng.choice(("en", "de", None)), rng.choice(("web_crawl_a", "web_crawl_b", "web_crawl_c", None))) for i in range(400)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), n_shards=leaves).collect()
    assert {r["doc_id"]: r["shard"] for r in out} == plain_tree(rows, leaves)


def test_groups_up_to_a_leaf_stay_whole(spark):
    rows = [(i, "a text that many share " * 4, "en", "s") for i in range(400)]
    rows += [(1000 + i, "another one that is as long " * 4, "en", "s") for i in range(200)]
    rows += [(2000 + i, f"own text number {i} and more " * 3, "de", "t") for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    group = 400 * (len(rows[0][1]) + 1)
    for leaves in (2, 3):  # of which the group is 0.6 and 0.9
        out = sharding.shard(docs, n_shards=leaves).collect()
        total, leaf = check_shards(out, rows, leaves)
        assert group <= leaf and len({r["shard"] for r in out if r["doc_id"] < 1000}) == 1
        assert max(abs(total[s] - leaf) for s in range(leaves)) <= 0.12 * leaf


def test_shard_awkward_rows(spark):
    docs = awkward(spark)
    out = sharding.shard(docs, n_shards=4).collect()
    check_shards(out, docs.collect(), 4)
    assert {r["text_crc32"] for r in out if r["size"] == 1} == {0}
    assert sharding.shard(empty(spark), n_shards=16).count() == 0
    same = spark.createDataFrame([(1, None, None, None)] * 5, "doc_id long, text string, lang string, source string")
    assert sharding.shard(same, n_shards=3).count() == 5


def test_queries_have_the_contract_columns(spark, data):
    assert queries.op1_mixing(spark, data).columns == ["doc_id", "size", "source_size", "target", "taken"]
    out = queries.op4_sharding(spark, data)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
