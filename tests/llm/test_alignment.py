import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairn.llm import alignment
from tests.llm.helpers import awkward, empty

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


@pytest.fixture(scope="module")
def made():
    return alignment.Aligner(*PATHS)


def tokens(made, text):
    """Ids of a whole text and their byte ranges, or nothing."""
    if not text:
        return [], []
    a, b = made.a.encode(" " + text, add_special_tokens=False).ids, made.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(made.a_bytes[i] for i in a) != raw or b"".join(made.b_bytes[i] for i in b) != raw:
        return [], []
    out = []
    for ids, known in ((a, made.a_bytes), (b, made.b_bytes)):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(known[i])))
            at += len(known[i])
        out.append(spans)
    return out


def plain(made, texts):
    """Every column by its definition, text by text."""
    rows, held = [], Counter()
    for t in texts:
        a, b = tokens(made, t)
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, s, e in a if c0 <= s and e <= c) + "|" + ",".join(str(i) for i, s, e in b if c0 <= s and e <= c) for c0, c in zip([0, *cuts], cuts, strict=False)] if len(a) < 4000 else None
        rows.append((a, b, cuts, links, groups))
        held.update(set(links))
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for a, b, cuts, links, groups in rows:
        text = ";".join(groups) if groups is not None else None
        out.append((len(a), len(b), len(cuts), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), None if text is None else hashlib.sha256(text.encode()).hexdigest() if a else "", text))
    return out


def compare(made, docs):
    want = Counter()
    rows = docs.select("doc_id", "text").collect()
    for r, w in zip(rows, plain(made, [r["text"] for r in rows]), strict=True):
        want[(r["doc_id"], *w)] += 1
    got = alignment.align(docs, *PATHS, keep_groups=True)
    assert got.columns == ["doc_id", *COLUMNS]
    long_ = {k[0] for k in want if k[-1] is None}
    have = Counter((r["doc_id"], *(None if c.startswith("groups") and c != "groups_sha256" and r["doc_id"] in long_ or c == "groups_sha256" and r["doc_id"] in long_ else r[c] for c in COLUMNS)) for r in got.collect())
    assert have == want


HARD = [
    "a  b\n\n c\t d ", " leading", "trailing   ", "\n", " ", "   ", "\t\ttabs\n \n", "x;\r\ny) \r z", "<s></s><|endoftext|> <unk>", "<0x41>", "a▁b", "nul\x00c", "é́ 漢字　かな\xa0x \x85y\x0b\x0cz",
    "\U0001f600\U0001f468‍\U0001f469", "don't we'll  'S", "12345 67,89", "x" * 300, None, "", "//  comment\n\treturn;\n\n\n}", "﻿bom", "\x1c\x1d a\x1fb",
]


def test_alignment_of_documents(spark, data, made, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 30_000)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(120)
    compare(made, docs)


def test_alignment_of_hard_texts(spark, made):
    rng = random.Random(8)
    odd = ["a", "b", "The", " ", "  ", "\n", "\t", "\r", "\xa0", "　", "é", "漢", "9", ";", ")", "'s", "▁", "\U0001f600", "\x00", " ́"]
    texts = HARD + ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    compare(made, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_segments_join_to_their_text(made):
    for t in [*HARD, "a b" * 50]:
        s = " " + (t or "")
        assert "".join(made.cut.findall(s)) == s
    assert made.cut.findall(" one two\nthree  four\tfive") == [" one", " two", "\nthree", "  four", "\tfive"]


def test_a_vocabulary_that_crosses_white_space_is_not_split_there():
    assert alignment.starts([b"a", b"a b", b" b"], ["▁a", "b"]) == "\n\t"
    assert alignment.starts([b"a", b" b"], ["a▁b", "b", ";\n", "▁\t"]) == ""
    assert alignment.starts([b"a", b" b", b" \n"], ["▁a", "▁▁", "b"]) == " \n\t"


def test_alignment_awkward_rows(spark, made):
    docs = awkward(spark, ["a b c d e f g", "", None, "one", "é ÈÉ ö", "  \t\n "])
    compare(made, docs)
    clash = docs.withColumns({c: F.lit(1) for c in ("block", "code", "seg", "body", "groups", "a.b", "_text")})
    compare(made, clash)
    assert alignment.align(empty(spark), *PATHS).count() == 0


def test_long_texts(spark, made, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(alignment, "COUNTED", 500)
    words = " ".join(f"w{i % 97} {'x' * (i % 5)}" for i in range(3000))
    compare(made, spark.createDataFrame([(1, words), (2, words + " tail"), (3, "short")], "doc_id long, text string"))
