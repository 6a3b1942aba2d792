import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import pages, queries, tokens
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "it's we'll they're 'l 'r '' l'l", "a   b  \n\n c", "x<|endoftext|>y <|endo <|endoftext|><|endoftext|>", "  　 \x1c\x85 z", "日本語 テキスト 12,3.4!!", "﻿\U0001f600 \U0001f600\U0001f600", "aaaa" * 50, "  ", "\t\t\tx", " '", "é" * 30 + "́", "'s'S 'LL", "a\r\n b c"]


@pytest.fixture(scope="module")
def both():
    return tokens.PrefixCounter(PATH), Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_against_the_library(both, spark, data):
    mine, library = both
    texts = [r[0][:300] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(10).collect()]
    rng = random.Random(0)
    texts += ["".join(rng.choice(" \n\t'abZé9.!日s<|>") for _ in range(80)) for _ in range(20)]
    for t in ODD + texts:
        assert mine.prefix(t) == [count(library, t[:p]) for p in range(len(t) + 1)]
        assert mine.total(t) == count(library, t)
        ends, counts = mine.table(t)
        assert (counts[-1] if counts else 0) == mine.total(t)
        assert not ends or ends[-1] == len(t)


def test_whole_texts_against_the_library(both, spark, data):
    _, library = both
    want = {r["doc_id"]: count(library, r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op8_token_counts(spark, data).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


def test_truncation_never_encodes_again(both, spark):
    _, library = both
    texts = [t for t in ODD if t] + ["word " * 50]
    made = tokens.prefix_tables(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    for r in tokens.truncate(made, 7).collect():
        best = max(p for p in range(len(r["text"]) + 1) if count(library, r["text"][:p]) <= 7)
        assert r["truncated"] == r["text"][:best]
    assert {r["doc_id"] for r in tokens.within_budget(made, 7).collect()} == {i for i, t in enumerate(texts) if count(library, t) <= 7}


def test_tokens_awkward_rows(both, spark):
    _, library = both
    docs = awkward(spark)
    got = tokens.count_tokens(docs, PATH).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(count(library, r["text"] or "") for r in docs.collect())
    assert sorted(r["n_bytes"] for r in got) == sorted(len((r["text"] or "").encode()) for r in docs.collect())
    assert tokens.count_tokens(empty(spark), PATH).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header">Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<aside>Side</aside><article><h1>Head &amp;&#32;line</h1><p>One  <b>bold</b>
text<br>more<p>Two &eacute; <i>it</i>.<ul><li>Item a<li>Item b</ul><div class="ad">Buy</div><form><p>Name</p></form>
<section class="comments"><article><p>Reader says</p></article></section></article><footer>&copy; x</footer></body></html>"""


def test_article_of_a_page():
    assert pages.extract(PAGE) == "Head & line\nOne bold text more\nTwo é it.\nItem a\nItem b"
    assert pages.extract(None) == pages.extract("") == ""
    assert pages.extract("<div><p>Only</p> tail") == "Only\ntail"
    assert pages.extract("plain &lt;text&gt;") == "plain <text>"
    wrapped = "<body><div class='page with-sidebar'><article><div class='post-header'><h1>T</h1></div><p>B</p><div class='share-bar'>S</div></article><div class='sidebar'>X</div></div></body>"
    assert pages.extract(wrapped) == "T\nB"
    assert pages.extract("<article><p>a</p><p hidden>b</p><div style='display: none'>c</div></article>") == "a"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert pages.extract(deep) == "x"


def test_supplied_pages_give_their_articles(spark, data):
    import html
    import re

    rows = {r["page_id"]: r for r in queries.op9_html_extraction(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        got = rows[r["page_id"]]
        assert got["text"] == "\n".join(b for b in blocks if b)
        assert (got["url"], got["n_chars"]) == (r["url"], len(got["text"]))


def test_style_tree_removes_what_a_host_repeats(spark):
    own = lambda i: f"<html><body><div class=top>Our shop since 1990</div><div class=main><div>Story number {i} about {i * 7}</div></div><div class=bottom>Call us now</div></body></html>"
    rows = [(i, "http://a.example/x", own(i)) for i in range(12)] + [(100, "http://b.example/x", own(0))]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} about {i * 7}" for i in range(12))
    assert "Our shop" in got[100]  # one page tells nothing of its host
    plain = {i: pages.extract(h) for i, _, h in rows}
    assert all("Our shop" in plain[i] and got[i] != plain[i] for i in range(12))  # the tree, not the lists, took it away


def plain_tree(rows):
    """Importances by the recursive definition: (host, style path) -> importance."""
    import math
    from collections import Counter, defaultdict

    styles, texts, sigs = defaultdict(set), defaultdict(set), defaultdict(set)
    kids = {}
    for host, html in rows:
        root = pages.parse(html)
        top = pages._article(root)
        sig = pages._longest(pages.runs(top or root, pages._furniture, top is not None))
        _, st, tx = pages.tree_rows(root)
        for (e, s), found in st.items():
            styles[host, e].add((sig, s))
            kids[host, e, s] = [c for c, _ in found]
        for e, t in tx:
            texts[host, e].add((sig, t))
            sigs[host, e].add(sig)

    def entropy(counts, base):
        n = sum(counts)
        return -sum(c / n * math.log(c / n, base) for c in counts)

    def of(host, e):
        if (host, e) in texts:
            m = len(sigs[host, e])
            k = Counter(t for _, t in texts[host, e]).values()
            return 1.0 if m == 1 else 1 - sum(c * math.log(c, m) for c in k) / sum(k)
        n = len(styles[host, e])
        if n == 1:
            return 1.0
        k = Counter(s for _, s in styles[host, e])
        below = sum(c / n * sum(of(host, x) for x in kids[host, e, s]) / len(kids[host, e, s]) for s, c in k.items())
        d = pages.DAMPING ** len(k)
        return (1 - d) * entropy(k.values(), n) + d * below

    return {(host, e): of(host, e) for host, e in [*styles, *texts]}


def test_importances_against_the_definition(spark):
    rng = random.Random(5)
    kinds = ["<p>{}</p>", "<div class=a><p>{}</p><ul><li>x</li><li>{}</li></ul></div>", "<section><h2>Part</h2>{}<p>{}</p></section>", "<div>{} <b>{}</b><br>y</div>"]
    rows = []
    for i in range(30):
        own = [rng.choice(kinds).format(*(f"{rng.choice('abcde')}{rng.randrange(1 + 9 * (i % 2))}" for _ in range(2))) for _ in range(rng.randrange(1, 6))]
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<body><div class=top>Shop</div><article>{''.join(own)}</article><div class=end>End {i % 2}</div></body>"))
    rows += rows[:4]  # repeated rows count once
    trees = pages.page_trees(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r["hk"], r["id"]): r["x"] for r in pages.importances(trees).collect()}
    hosts = {r["u"]: r["h"] for r in spark.createDataFrame([(f"h{i}.example",) for i in range(3)], "u string").selectExpr("u", "xxhash64(u) AS h").collect()}
    want = plain_tree([(hosts[u.split("/")[2]], h) for _, u, h in rows])
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_deep_pages_take_bounded_memory():
    import tracemalloc

    for tag in ("div", "div class=menu", "span"):
        deep = f"<{tag}>" * 60_000 + "x" + "</em></div>" * 60_000
        tracemalloc.start()
        assert pages.extract(deep) == "x" and pages.tree_rows(pages.parse(deep))[0] >= 1
        assert tracemalloc.get_traced_memory()[1] < 200_000_000
        tracemalloc.stop()


def test_repeated_headings_inside_articles_stay(spark):
    page = lambda i: f"<body><p class=top>Our shop</p><article><h1>Story {i}</h1>{'<p>word %d and more</p>' * (1 + i % 4) % tuple(i * 9 + j for j in range(1 + i % 4))}<h2>Sources</h2><p>Book {i}</p></article><div>Call us</div></body>"
    got = bodies(spark, [(i, "http://a.example/x", page(i)) for i in range(20)])
    assert all("Sources" in t and "Our shop" not in t and "Call us" not in t for t in got.values())


def test_equal_articles_of_a_host_stay(spark):
    page = "<html><body><nav>m</nav><article><h1>H</h1><p>Same body</p></article></body></html>"
    rows = [(i, "http://a.example/", page) for i in range(20)]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"H\nSame body"}


def test_furniture_that_wraps_the_page_stays():
    body = "<nav>Menu</nav><h1>Head</h1><p>A text that is long enough to be the page</p><aside>Side</aside>"
    want = "Head\nA text that is long enough to be the page"
    for wrap in ("<form>{}</form>", "<div><form action=x><div class='ad-free'>{}</div></form></div>", "<form><article>{}</article></form>", "<article class='post comments-open'>{}</article>", "<div class='category-sponsored'><article>{}</article></div>", "<div class='ad-free'>{}</div>", "<main class='promo'><div>{}</div></main>"):
        assert pages.extract(f"<body><header>Site</header>{wrap.format(body)}<footer>End</footer></body>") == want, wrap
    own = "<body><div class=text><p>Own words</p></div><div class=comments><p>Readers wrote very much more than the page itself</p></div></body>"
    assert pages.extract(own) == "Own words"


def bodies(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_of_classed_and_articleless_pages_stay(spark):
    prose = lambda i: f"Report {i} says that the {i * 7} mills of the valley were counted twice by hand"
    classed = lambda i, n: f"<body><div class=top>Our shop</div><article><p class=lead>Lead {i}</p><div class=text>{prose(i)}</div><section>End {i}</section></article><div class=bottom>Visit {n}</div></body>"
    bare = lambda i, n: f"<body><div class=top>Our shop</div><div class=page><div class=text><span>{prose(i)}</span></div><div class=more>More {i}</div></div><div class=bottom>Visit {n}</div></body>"
    for make, want in ((classed, lambda i: f"Lead {i}\n{prose(i)}\nEnd {i}"), (bare, lambda i: f"{prose(i)}\nMore {i}")):
        only = bodies(spark, [(n, "http://a.example/x", make(1, n)) for n in range(20)])  # copies alone
        assert all(want(1) in t for t in only.values())
        some = [(n, "http://a.example/x", make(n if n >= 20 else 1, n)) for n in range(60)]  # copies beside other pages
        got = bodies(spark, some)
        assert all(want(n if n >= 20 else 1) in t for n, t in got.items())
        assert not any("Our shop" in t for t in got.values())


def test_passages_that_articles_share_stay(spark):
    page = lambda i: f"<body><div class=top>Our shop</div><article><div class=text>Own words of page {i} and {i * 3} more</div>{'<div class=text>A passage that a third of the pages share</div>' if i % 3 == 0 else ''}</article></body>"
    got = bodies(spark, [(i, "http://a.example/x", page(i)) for i in range(30)])
    assert all(t == f"Own words of page {i} and {i * 3} more" + ("\nA passage that a third of the pages share" if i % 3 == 0 else "") for i, t in got.items())


def test_pages_awkward_rows(spark):
    kind = "page_id long, url string, html string, text string, host string, low int"
    rows = [(1, None, None, "x", "h", 1), (None, "http://a.example/", "", None, None, None), (2, "no url", PAGE, "y", "h", 2), (2, "no url", PAGE, "y", "h", 2), (3, "http://a.example/", "<p>" + "long " * 200_000, None, None, None)]
    got = pages.extract_pages(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 5 and sum(r["text"] == "" and r["n_chars"] == 0 for r in got) == 2
    assert pages.extract_pages(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("part", ['<section id="discussion">{}</section>', '<section class="related-work">{}</section>', '<div class="social-history">{}</div>', '<div id="respond">{}</div>', '<div class="search-engines"><h2>{}</h2></div>'])
def test_sections_of_an_article_stay_whatever_their_names(part):
    inner = part.format("Long prose of the article that stays here. " * 5)
    text = " ".join(["Long prose of the article that stays here."] * 5)
    assert pages.extract(f"<nav>menu</nav><article><h1>Title</h1>{inner}</article>") == f"Title\n{text}"
    assert pages.extract(f"<article>{inner}<p>End.</p></article><footer>x</footer>") == f"{text}\nEnd."


def test_marked_paragraphs_of_an_article_stay_and_its_boxes_go():
    page = '<article><h2 id="respond">How cells respond</h2><p class="copyright-law">Law.</p><p class="ad">Plain.</p><div class="ad-slot">Buy</div><div id="comments"><p>Me first</p></div><div class="related-posts"><a href="x">More</a></div><div class="share">on <a href="y">that site of ours</a></div><p>End.</p></article>'
    assert pages.extract(page) == "How cells respond\nLaw.\nPlain.\nEnd."
