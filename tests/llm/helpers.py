"""Hand-made tables and plain versions of the operators."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, shard int, score double"


def words(text):
    return (text or "").encode().lower().split()


def plain_words(text):
    """Lower-cased words of letters, digits and whatever is not ASCII."""
    return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower()).encode("utf-8", "surrogatepass").split(b" ")


def held_words(text):
    return [w for w in plain_words(text) if w]


def awkward(spark, texts=None):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    long_ = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    base = texts or ["a b c d e f g", "a b c d e f g", "", None, "one", long_, long_ + " tail", "é ÈÉ ö", "  \t\n "]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or ""), 7, "x", 3, 0.5) for i, t in enumerate(base)]
    rows += [rows[0], rows[0], (None, "a b c d e f g", "en", "s1", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_duplicates(rows, percent=75):
    """doc_id -> (set size, smallest reachable doc_id) by comparing all pairs."""
    sets = {k: shingle_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}
