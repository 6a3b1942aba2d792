"""HTML extraction with site style trees: branches of low importance go, the article stays."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches, drop, save

#: Elements whose content is never text of the page.
NEVER = frozenset("head title script style noscript template iframe object embed svg math canvas audio video map select option textarea button input datalist dialog".split())
#: Elements that hold a page's furniture.
FURNITURE = frozenset("nav footer aside form menu".split())
#: Elements that end a block.
BLOCK = frozenset("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr form fieldset details summary center hgroup search legend".split())
#: Elements of plain prose.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these, up to the given limits.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"}
#: Words in class, id or role that mark furniture, whatever is inside.
STRONG = re.compile(r"(^|[\s_-])(ad|ads|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|comment|comments|commentlist|disqus\w*|replies|respond|discussion|related|recommend\w*|newsletter|subscription|popup|modal|overlay|copyright)($|[\s_-])", re.I)
#: Words that mark it unless the article is inside.
WEAK = re.compile(r"(^|[\s_-])(notice\w*|alert|sidebar\w*|side-bar|menu\w*|nav|navbar|navigation|breadcrumb\w*|pager|pagination|footer|share|sharing|social\w*|subscribe|signup|login|search|widget\w*|complementary|contentinfo|toolbar|skip-link)($|[\s_-])", re.I)
#: Words that mark it outside an article only; within, they hold its own headline.
OUTSIDE = re.compile(r"(^|[\s_-])(header|masthead|topbar)($|[\s_-])", re.I)
#: What may follow such a word in the name of a box; other words make another meaning (related-work, copyright-law).
_BOX = r"(?:[-_](?:slot|box|unit|container|wrapper|wrap|list|section|area|block|inner|banner|form|thread|item|items|content|body|bar|panel|link|links|post|posts|buttons?|icons?|text|\d+))*$"
#: Inside an article a whole class, id or role has to say what an element is: adverts, notices, menus and reader comments whatever they hold,
INNER = re.compile(r"(ad|ads|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|comments?|commentlist|disqus\w*|replies|newsletter|subscription|popup|modal|overlay|notices?|alerts?|share|sharing|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pager|pagination|login|signup|toolbar|skip-link)" + _BOX, re.I)
#: and these if most of their text is links.
LINKED = re.compile(r"(related|recommend\w*|respond|discussion|copyright|footer|social\w*|subscribe|search|widget\w*|complementary|contentinfo)" + _BOX, re.I)
#: Damping of what lies below a presentation node; a leaf below LOW is noise, unless it is plain
#: prose in a branch of importance KEEP.
DAMPING, LOW, KEEP = 0.9, 0.3, 0.5
#: Copies of the small side of joins on keys that may be hot.
SALTS = 16


class Node:
    __slots__ = ("depth", "has", "hidden", "label", "links", "mark", "parent", "parts", "path", "size", "spared", "tag", "up")

    def __init__(self, tag: str, mark: str, label: str, parent: Node | None):
        self.tag, self.mark, self.label, self.parent, self.parts, self.hidden, self.spared = tag, mark, label, parent, [], False, False
        self.size, self.links, self.has = 0, 0, False
        # the nearest block around, and the style path of blocks as one hash: inline marks are no nodes of the style tree
        self.up = None if parent is None else parent if parent.parent is None or parent.tag in BLOCK else parent.up
        block = tag in BLOCK or parent is None
        self.depth = self.up.depth + 1 if self.up and block else self.up.depth if self.up else 0
        self.path = xxhash.xxh3_64_intdigest(label, self.up.path if self.up else 0) if block else self.up.path


class Dom(HTMLParser):
    """A forgiving tree of elements and texts."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", "", None)
        self.open: dict[str, int] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end({"p"}, BLOCK - {"p"})
        if tag in ENDS:
            names, limits = ENDS[tag]
            self._end(set(names.split()), limits)
        named = {k: v for k, v in attrs if v}
        node = Node(tag, " ".join(named[k] for k in ("class", "id", "role") if k in named).strip(), f"{tag}.{named.get('class', '').strip()}", self.at)
        node.hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self._leave(self.at)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._end({tag}, BLOCK - {tag} if tag not in BLOCK else {"article", "body", "html"} - {tag} if tag in {"p", "div", "section", "li"} else set())

    def handle_data(self, data):
        self.at.parts.append(data)

    def _leave(self, n: Node) -> None:
        """Close every element down to n."""
        while True:
            at = self.at
            self.open[at.tag] -= 1
            self.at = at.parent
            if at is n:
                return

    def _end(self, names: set, limits) -> None:
        """Leave the nearest open element of names, unless one of limits is nearer."""
        if not any(self.open.get(t) for t in names):
            return
        n = self.at
        while n.parent and n.tag not in names:
            if n.tag in limits:
                return
            n = n.parent
        if n.parent:
            self._leave(n)


def parse(html: str | None) -> Node:
    """The page's tree; each node knows the length of the text in it and whether an article or main element is inside."""
    root = Dom(html or "").root
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [x for x in n.parts if not isinstance(x, str) and not x.hidden and x.tag not in NEVER]
    for n in reversed(order):
        for x in n.parts:
            if isinstance(x, str):
                n.size += len(x.strip())
            elif not x.hidden and x.tag not in NEVER:
                n.size += x.size
                n.links += x.size if x.tag == "a" else x.links
                n.has = n.has or x.has or x.tag == "main" or (x.tag == "article" and not _named(x))
    return root


def _named(n: Node) -> bool:
    """Whether an article is marked as furniture."""
    return bool(n.mark and not n.spared and (STRONG.search(n.mark) or WEAK.search(n.mark) or OUTSIDE.search(n.mark)))


def _furniture(n: Node, inside: bool) -> bool:
    if n.hidden or n.tag in NEVER:
        return True
    if n.spared:
        return False
    if n.tag in FURNITURE or (n.tag == "header" and not inside):
        return True
    if not n.mark or n.tag in ("html", "body", "main"):
        return False
    if inside:  # a section of the article is never judged by part of its name, and a paragraph by none
        names = [] if n.tag in PROSE else n.mark.split()
        return any(map(INNER.match, names)) or (2 * n.links > n.size and any(map(LINKED.match, names)))
    if STRONG.search(n.mark):
        return True
    weak = WEAK.search(n.mark) or (not inside and OUTSIDE.search(n.mark))
    return bool(weak) and (n.tag == "article" or not n.has)


def runs(top: Node, skip, inside: bool = False) -> list[tuple[Node, str]]:
    """(element, text) of the blocks below top in page order, white space inside each as one space."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []

    def end(n):
        if text := " ".join("".join(held).split()):
            out.append((n if n.parent is None or n.tag in BLOCK else n.up, text))
        held.clear()

    # an explicit stack: pages may nest deeper than Python's calls
    todo: list = [(top, iter(top.parts), inside)]
    while todo:
        n, it, within = todo[-1]
        for x in it:
            if isinstance(x, str):
                held.append(x)
            elif x.tag in ("br", "wbr", "img"):
                held.append(" ")
            elif skip(x, within):
                if x.tag in BLOCK:
                    end(n)
            else:
                if x.tag in BLOCK:
                    end(n)
                todo.append((x, iter(x.parts), within or x.tag in ("article", "main")))
                break
        else:
            if n.tag in BLOCK or n is top:
                end(n)
            todo.pop()
    return out


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(text: str, seed: int = 0) -> int:
    return _long(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed))


def _leaf(n: Node) -> int:
    """The content node of an element's own text."""
    return _long(xxhash.xxh3_64_intdigest("#text", n.path))


def _longest(found: list[tuple[Node, str]]) -> str:
    return max((t for _, t in found), key=lambda t: (len(t), t), default="")


def _main(root: Node) -> Node | None:
    """The article: of the outermost article and main elements that are no furniture, the one with most text."""
    best, size, todo = None, 0, [root]
    while todo:
        n = todo.pop()
        for x in n.parts:
            if isinstance(x, str) or _furniture(x, False):
                continue
            if x.tag == "article" or (x.tag == "main" and not x.has) or "articlebody" in x.mark.lower():
                length = sum(len(t) for _, t in runs(x, _furniture, True))
                if length > size:
                    best, size = x, length
            else:
                todo.append(x)
    return best


def _article(root: Node) -> Node | None:
    """_main(), after sparing furniture that wraps the page.

    Where the lists leave no article, an element they name is spared if it holds over half of the
    page's text and is a form, is or holds an article or main element, or leaves nothing.
    """
    top = _main(root)
    if top is not None:
        return top
    nothing = not runs(root, _furniture)
    at, held, many = root, 0, 1
    while at := next((x for x in at.parts if not isinstance(x, str) and not x.hidden and x.tag not in NEVER and 2 * x.size > root.size), None):
        if _furniture(at, False) and (at.tag in ("form", "article", "main") or at.has or nothing):
            at.spared, held = True, held + 1
            up = at.parent
            while up is not None and not up.has and (at.has or at.tag in ("article", "main")):
                up.has, up = True, up.parent
        if held == many:  # wrappers inside wrappers are spared by ones, twos, fours: the page is not read once for each
            if (top := _main(root)) is not None:
                return top
            nothing = not runs(root, _furniture)
            held, many = 0, many * 2
    return _main(root) if held else None


def extract(html: str | None, low: frozenset = frozenset()) -> str:
    """The main text of a page. low: content nodes of its host's style tree that are noise."""
    root = parse(html)
    whole = runs(root, lambda x, _: x.hidden or x.tag in NEVER) if low else []
    kept = [(n, t) for n, t in whole if _leaf(n) not in low]
    cut = low if low and _longest(kept) == _longest(whole) else frozenset()  # a page without its longest block is none
    top = _article(root)
    found = runs(top or root, _furniture, top is not None)
    if cut:
        left = [(n, t) for n, t in found if _leaf(n) not in cut]
        if _longest(left) == _longest(found):
            found = left
    return "\n".join(t for _, t in found)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def tree_rows(root: Node) -> tuple[int, dict, set]:
    """What a page adds to its host's style tree: depth, children of each (element, style), and (content node, text).

    An element node is a style path (tags and classes of blocks from the root); the style of an
    element is the sequence of its children that hold text. A child is (node, whether it is the
    content of plain prose).
    """
    children: dict[Node, list[tuple[int, bool]]] = {}
    texts: set[tuple[int, int]] = set()
    depth = 0
    for n, text in runs(root, lambda x, _: x.hidden or x.tag in NEVER):
        leaf = _leaf(n)
        texts.add((leaf, _hash(text)))
        at = n
        chain = []
        while at is not None and at not in children:
            children[at] = []
            chain.append(at)
            at = at.up
        for x in reversed(chain):
            if x.up is not None:
                children[x.up].append((_long(x.path), False))
        children[n].append((leaf, n.tag in PROSE and n.label == f"{n.tag}."))
        depth = max(depth, n.depth + 1)
    return depth, {(_long(n.path), _hash(" ".join(str(c) for c, _ in found))): found for n, found in children.items()}, texts


_TREE = "_key long, hk long, sig long, depth int, st array<struct<e:long,s:long>>, tx array<struct<e:long,t:long>>, ch array<struct<e:long,s:long,c:long,q:boolean,x:double>>"


def _trees(batches):
    told: set[tuple[int, int, int]] = set()
    for batch in batches:
        rows = []
        for key, hk, html in zip(batch.column("_key").to_pylist(), batch.column("hk").to_pylist(), batch.column("_html"), strict=True):
            root = parse(html.as_py())
            depth, styles, texts = tree_rows(root)
            top = _article(root)
            # copies of a page have one longest block, whatever their furniture
            sig = _hash(_longest(runs(top or root, _furniture, top is not None)))
            ch = []
            for (e, s), found in styles.items():
                if (hk, e, s) not in told:  # a style's children are told once by a task that remembers
                    if len(told) >= 200_000:
                        told.clear()
                    told.add((hk, e, s))
                    n: dict[tuple[int, bool], int] = {}
                    for c in found:
                        n[c] = n.get(c, 0) + 1
                    ch += [{"e": e, "s": s, "c": c, "q": q, "x": k / len(found)} for (c, q), k in n.items()]
            rows.append({"_key": key, "hk": hk, "sig": sig, "depth": depth, "st": [{"e": e, "s": s} for e, s in styles], "tx": [{"e": e, "t": t} for e, t in texts], "ch": ch})
        yield pa.RecordBatch.from_pylist(rows, schema=_schema())


def _schema():
    n = pa.int64()
    return pa.schema([("_key", n), ("hk", n), ("sig", n), ("depth", pa.int32()), ("st", pa.list_(pa.struct([("e", n), ("s", n)]))), ("tx", pa.list_(pa.struct([("e", n), ("t", n)]))), ("ch", pa.list_(pa.struct([("e", n), ("s", n), ("c", n), ("q", pa.bool_()), ("x", pa.float64())])))])


def _keyed(pages: DataFrame, html: str, url: str) -> list:
    """Host and page as hashes; equal pages of a host are one."""
    host = host_of(F.col(url))
    return [F.xxhash64(host).alias("hk"), F.xxhash64(host, F.col(html)).alias("_key")]


def page_trees(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Every page's part of its host's style tree, written: tree_rows(), the page's key and its copy signature."""
    bound_batches(pages.sparkSession)
    return save(pages.select(*_keyed(pages, html, url), F.col(html).alias("_html")).mapInArrow(_trees, _TREE))


def importances(trees: DataFrame) -> DataFrame:
    """(hk, id, parent, x, q): composite importance x of every node of the hosts' merged style trees.

    Pages of one signature are copies and count once. With m pages, k of which hold a text, a
    content node's importance is 1 - sum(k ln k) / (sum(k) ln m): 1 where every page has its own
    text, 0 where all share theirs. An element seen in n styles with shares p has the
    presentation importance -sum(p log_n p); 1 for a node on one page. With l different styles
    its composite importance is (1 - d^l) times that plus d^l times the mean of its children,
    style by style (d = DAMPING). Sums over all nodes below follow from pointers that double
    their reach in each round, so a tree of any depth takes log2 of it; rows are dealt by node.
    """
    t = trees.select("hk", "sig", F.explode("tx").alias("r")).select("hk", "sig", "r.*").distinct()
    m = t.select("hk", "sig", "e").distinct().groupBy("hk", "e").agg(F.count(F.lit(1)).alias("m"))
    k = t.groupBy("hk", "e", "t").agg(F.count(F.lit(1)).cast("double").alias("k"))
    leaves = k.groupBy("hk", "e").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("l")).join(m, ["hk", "e"])
    leaves = leaves.select("hk", F.col("e").alias("id"), F.when(F.col("m") > 1, 1 - F.col("l") / (F.col("n") * F.log(F.col("m").cast("double")))).otherwise(1.0).alias("x"))
    s = save(trees.select("hk", "sig", F.explode("st").alias("r")).select("hk", "sig", "r.*").distinct().groupBy("hk", "e", "s").agg(F.count(F.lit(1)).cast("double").alias("k")))
    el = s.groupBy("hk", "e").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("l"), F.sum(F.col("k") * F.log("k")).alias("z"))
    el = save(el.select("hk", "e", "n", F.when(F.col("n") > 1, F.pow(F.lit(DAMPING), F.col("l"))).otherwise(0.0).alias("d"), F.when(F.col("n") > 1, 1 - F.col("z") / (F.col("n") * F.log("n"))).otherwise(1.0).alias("p")))
    ch = trees.select("hk", F.explode("ch").alias("r")).select("hk", "r.*").distinct()
    w = ch.join(s, ["hk", "e", "s"]).groupBy("hk", "e", "c", "q").agg(F.sum(F.col("k") * F.col("x")).alias("w"))
    w = w.join(el, ["hk", "e"]).select("hk", F.col("c").alias("id"), F.col("e").alias("parent"), "q", (F.col("d") * F.col("w") / F.col("n")).alias("w"))
    own = leaves.unionByName(el.select("hk", F.col("e").alias("id"), ((1 - F.col("d")) * F.col("p")).alias("x")))
    now = save(own.join(w, ["hk", "id"], "left").select("hk", "id", "parent", "q", "x", F.col("parent").alias("up"), "w"))
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    for _ in range(math.ceil(math.log2(deepest + 1))):
        below = now.filter("up IS NOT NULL").groupBy("hk", F.col("up").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("_add"))
        over = now.select("hk", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("w").alias("_w"))
        step = now.join(below, ["hk", "id"], "left").join(over, ["hk", "up"], "left")
        old, now = now, save(step.select("hk", "id", "parent", "q", (F.col("x") + F.coalesce("_add", F.lit(0.0))).alias("x"), F.col("_up").alias("up"), (F.col("w") * F.col("_w")).alias("w")))
        drop(old)
    drop(s, el)
    return now


def noise(trees: DataFrame, low: float = LOW, keep: float = KEEP) -> DataFrame:
    """(hk, e): content nodes that go from every page of their host.

    Those are the nodes of an importance under ``low``, but for plain prose (an unclassed p, h2,
    li, ...) whose element lies in a branch of importance ``keep`` or more: what is said in the
    same words in many articles is still part of them. A branch all of whose contents are noise goes as a whole.
    """
    x = importances(trees)
    few = x.filter(F.col("q").isNotNull() & (F.col("x") < low)).join(trees.select("hk", F.explode("tx.e").alias("id")).distinct(), ["hk", "id"], "left_semi")
    owner = x.select("hk", F.col("id").alias("parent"), F.col("parent").alias("_around"))
    around = x.select("hk", F.col("id").alias("_around"), F.col("x").alias("_x"))
    few = few.join(owner, ["hk", "parent"], "left").join(around, ["hk", "_around"], "left")
    return save(few.filter(~(F.col("q") & F.coalesce(F.col("_x") >= keep, F.lit(False)))).select("hk", F.col("id").alias("e")))


def _salted(df: DataFrame, salt) -> DataFrame:
    return df.withColumn("_salt", salt)


def low_of_pages(trees: DataFrame, gone: DataFrame) -> DataFrame:
    """(hk, _key, low): the noise on each page that has any; a page's list is no longer than the page."""
    many = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    on = _salted(trees.select("hk", "_key", F.explode(F.array_distinct("tx.e")).alias("e")), F.pmod("_key", F.lit(SALTS)).cast("int"))
    hit = on.join(_salted(gone, many), ["hk", "e", "_salt"])
    return hit.groupBy("hk", "_key").agg(F.collect_set("e").alias("_low"))


def _extractor(cols: list[str]):
    def run(batches):
        for batch in batches:
            out = [extract(html.as_py(), frozenset(f.as_py() or ())) for html, f in zip(batch.column("_html"), batch.column("_low"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*cols, "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) of each page, from its whole html and its host's style tree.

    The DOMs of a host are merged into one style tree (importances()); the branches whose
    importance is low go from each page (noise()), but never its longest block. What differs
    from page to page and still is no article is told by HTML's own elements (nav, aside, form,
    ...) and by class, id or role: adverts, reader comments and menus with other words on every
    page are as diverse as prose, and no entropy tells them apart. Those lists never take an
    element that wraps the page (_article()); of what is left the largest article or main
    element is the text, or else the body.

    Null html counts as empty and gives an empty text; pages without a host share one tree; a
    node on one page only is important; repeated rows count once in the tree and are extracted
    each; no rows give no rows; other columns are ignored.
    """
    trees = page_trees(pages, html, url)
    lists = low_of_pages(trees, noise(trees))
    # copies of a page may be many: its list goes to SALTS tasks
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    slim = _salted(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), *_keyed(pages, html, url), F.col(html).alias("_html")), salt)
    joined = slim.join(_salted(lists, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hk", "_key", "_salt"], "left")
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.select("page_id", "url", "_html", "_low").mapInArrow(_extractor(["page_id", "url"]), f"{kinds}, text string, n_chars long")
