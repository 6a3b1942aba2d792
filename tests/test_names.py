import random
from collections import Counter

from cairn.operators import names as N


def plain_mentions(text, names):
    """Names by length, each at its first free place, position by position."""
    t, taken, out = f" {N.plain(text)} ", [], []
    for name in sorted((n for n in names if len(n) >= 3), key=lambda n: (-len(n), n)):
        for at in range(len(t)):
            if t.startswith(f" {name} ", at) and all(at + len(name) <= s or at >= e for s, e in taken):
                taken.append((at, at + len(name)))
                out.append((at, at + len(name), name))
                break
    return out


def test_mentions_against_every_place(spark):
    rng = random.Random(9)
    words = ["red", "fox", "hill", "a", "old", "sea", "Ärger", "ﬁne"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = N.normalized(spark.createDataFrame([(phrase(rng.randrange(1, 4)),) for _ in range(40)] + [("!",), (None,), ("Red",)], "name string")).collect()
    table = spark.createDataFrame(names)
    texts = [(i, phrase(rng.randrange(12)).replace(" ", rng.choice([" ", "-", ", "]))) for i in range(200)] + [(7, "Red FOX"), (None, "red fox"), (900, None), (901, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    keys = [r["normalized"] for r in names]
    want = Counter((k, *m) for k, t in texts for m in plain_mentions(t, keys))
    for shard in (N.SHARD, 60):
        got = Counter((r["id"], r["start"], r["end"], r["normalized"]) for r in N.mentions(df, "id", "text", table, shard=shard).collect())
        assert got == want
    every = Counter((r["id"], r["normalized"]) for r in N.mentions(df, "id", "text", table, every=True).collect())
    assert every == Counter((k, n) for k, t in texts for n in keys if len(n) >= 3 for at in range(len(N.plain(t))) if f" {N.plain(t)} ".startswith(f" {n} ", at))


def test_no_names_and_one_name(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "fox and hill"), (3, "the fox, the fox")], "id int, text string")
    none = spark.createDataFrame([], "normalized string, name string")
    assert N.mentions(df, "id", "text", none).count() == 0
    names = N.normalized(spark.createDataFrame([("Fox",), ("HILL",), ("fox",)], "name string"))
    assert {(r["id"], r["name"]) for r in N.only_name(df, "id", "text", names).collect()} == {(1, "Fox"), (3, "Fox")}
