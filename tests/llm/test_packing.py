import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairn.llm import packing
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def plain_best_fit(lengths, capacity):
    """The number of sequences of best fit, longest first, item by item."""
    free = []
    for l in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= l]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - l)
        else:
            free.append(capacity - l)
    return len(free)


def check(rows, want, most):
    """Pieces are those of the ids, and each sequence is filled from 0 without gaps or overlaps."""
    pieces = Counter()
    for doc_id, own in want:
        for piece, at in enumerate(range(0, len(own), most)):
            part = own[at : at + most]
            pieces[doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(held)


def test_ids_are_the_library_s(library, data, spark):
    made = packing.Words(PATH)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    texts += ["It's we'LL I'M 'S'T ''s", "ÀÉîß ÿŸ µ ª º × ÷ ²³ ½", "İstanbul ΣΑΣ straße ﬁ", "<|startoftext|>a <|endoftext|> <|end", "a b　c\x1cd\x85e", "é ́x", "漢字かな 한국어 \U0001f600", "tab\tnew\nline\x00nul", "x" * 5000, "9876 3.14 a1b2", "", " ", "don't 'tis"]
    rng = random.Random(5)
    odd = [*"aA'sStTrReE09 \n<|>-éÉ́ ’一ß", "'s", "'ll"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(made.ids(t), "<u4").tolist() == ids(library, t)[:-1], t


def test_packing_of_documents(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    want = [(r["doc_id"], ids(library, r["text"])) for r in docs.collect()]
    n = check(rows, want, 2048)
    lengths = [r["length"] for r in rows]
    assert -(-sum(lengths) // 2048) <= n <= plain_best_fit(lengths, 2048)
    again = packing.pack(docs.repartition(7), PATH).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_awkward_rows(spark, library):
    docs = awkward(spark)
    rows = packing.pack(docs.withColumns({c: F.lit(1) for c in ("piece", "length", "ids", "_rank", "a.b")}), PATH, 100).collect()
    check(rows, [(r["doc_id"], ids(library, r["text"])) for r in docs.collect()], 100)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_sequences_hold_the_ids(spark, library):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * (1 + i % 9)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(docs, PATH, 64, keep_ids=True)
    rows, by = packed.collect(), {}
    own = {r["doc_id"]: ids(library, r["text"]) for r in docs.collect()}
    for r in packing.sequences(packed).collect():
        by[r["sequence_id"]] = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(by[r["sequence_id"]]) == r["length"] <= 64
    for r in rows:
        at = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert by[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tolist() == at


def test_price_is_a_knapsack():
    lengths, values = np.array([3, 5, 7]), np.array([3.0, 6.0, 8.0])
    last = packing.price(values, lengths, 20)
    best = [0.0] * 21
    for c in range(1, 21):
        best[c] = max([best[c - 1], *(best[c - l] + v for l, v in zip(lengths, values, strict=True) if l <= c)])
    for c in range(21):
        at, worth = c, 0.0
        while at > 0:
            worth, at = (worth + values[list(lengths).index(last[at])], at - last[at]) if last[at] else (worth, at - 1)
        assert worth == best[c]


@pytest.mark.parametrize("kind", ["wide", "thirds", "halves", "many", "one"])
def test_configurations_use_up_the_demand(kind):
    rng = np.random.default_rng(3)
    items = {"wide": rng.integers(1, 257, 900), "thirds": np.r_[rng.integers(80, 120, 300), rng.integers(30, 60, 100)], "halves": np.repeat([128, 129, 127], 50), "many": np.repeat(rng.integers(20, 200, 300), 10_000), "one": np.array([256])}[kind]
    demand = np.bincount(items, minlength=257)
    plan = packing.configurations(demand, 256)
    used = np.zeros(257, np.int64)
    for config, n in plan:
        assert n > 0 and sum(l * k for l, k in config) <= 256
        for l, k in config:
            used[l] += n * k
    assert (used == demand).all()
    total, fit = sum(n for _, n in plan), sum(n for _, n in packing.best_fit(demand, 256))
    if kind != "many":
        assert fit == plain_best_fit(items.tolist(), 256)
    assert total <= fit * (1.001 if kind == "many" else 1)
    assert len(plan) < 30_000
