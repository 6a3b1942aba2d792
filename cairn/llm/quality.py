"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import among, bound_batches, drop, save

#: Symbols to an n-gram: code points as they are, every one of Unicode's a symbol of its own.
ORDER = 5
#: What stands before a text; and for NUL, which ends numpy's strings.
PAD, NUL = "\x02", "�"
#: The commonest n-grams of each order, at most so many, go to every task; the others meet the requests of
#: blocks of text of about so many bytes in a join.
HEAD, BLOCK_BYTES = 1 << 19, 16 << 20
#: Symbols, and different n-grams, that are worked on at once.
PIECE, SLICE, GROUP = 1 << 18, 1 << 16, 1 << 21
#: Documents are kept up to this quantile of the perplexity of trusted documents in their
#: language; the trusted documents of one fold in FOLDS are left out of training and tell it.
QUANTILE, FOLDS = 0.99, 5


def chunks(texts):
    """(documents, symbols of each, code points, whether a text's own) of runs of texts; long texts come in pieces with their context."""
    who, sizes, parts, n = [], [], [], 0
    for k, text in enumerate(texts):
        text = text.replace("\0", NUL)
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            parts += [text[at - ORDER + 1 : at] if at else PAD * (ORDER - 1), piece]
            who.append(k)
            sizes.append(len(piece))
            n += len(piece)
            if n >= PIECE:
                yield _chunk(who, sizes, parts)
                who, sizes, parts, n = [], [], [], 0
    if who:
        yield _chunk(who, sizes, parts)


def _chunk(who, sizes, parts):
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.ones(len(codes), bool)
    starts = np.concatenate([[0], np.cumsum(np.array(sizes) + ORDER - 1)[:-1]])
    for j in range(ORDER - 1):
        own[starts + j] = False
    return who, np.array(sizes), codes, own[ORDER - 1 :]


def _fold(columns) -> np.ndarray:
    """A 64-bit hash of n-grams, given by columns of code points; shorter ones end in zeros."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def distinct(codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams that end in a text's own symbols, as rows of code points, and for each symbol the row of its n-gram."""
    n = len(codes) - ORDER + 1
    h = _fold([codes[i : i + n] for i in range(ORDER)])[own]
    at = pa.array(h).dictionary_encode().indices.to_numpy()
    first = np.zeros(int(at.max()) + 1, np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)[np.flatnonzero(own)[first]], at


def together(texts):
    """Runs of chunks() of about GROUP symbols: their different n-grams, and for each chunk the documents, symbols of each, and rows of the n-grams."""
    hashes, grams, runs, n = [], [], [], 0
    for who, sizes, codes, own in chunks(texts):
        g, at = distinct(codes, own)
        hashes.append(_fold(g.T))
        grams.append(g)
        runs.append((who, sizes, at.astype(np.int32)))
        n += len(at)
        if n >= GROUP:
            yield _together(hashes, grams, runs)
            hashes, grams, runs, n = [], [], [], 0
    if runs:
        yield _together(hashes, grams, runs)


def _together(hashes, grams, runs):
    _, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    back = np.split(back.astype(np.int32), np.cumsum([len(h) for h in hashes])[:-1])
    return np.concatenate(grams)[first], [(who, sizes, b[at]) for (who, sizes, at), b in zip(runs, back, strict=True)]


def strings(grams: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grams, "<u4").view(f"<U{ORDER}").ravel()


def _counter(batches):
    for batch in batches:
        for _, _, codes, own in chunks(t.as_py() or "" for t in batch.column("_text")):
            grams, at = distinct(codes, own)
            yield pa.RecordBatch.from_arrays([pa.array(strings(grams)), pa.array(np.bincount(at).astype(np.int64))], ["g", "n"])


def _level(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, own) and (ctx, gamma) of one order from its (g, n): discounted probabilities and each context's lost mass.

    The discounts of n-grams seen once, twice and more often come from the numbers of those seen
    one to four times (Chen and Goodman); a context's lost mass goes to the shorter order.
    """
    seen = {r["c"]: r["k"] for r in counts.groupBy(F.least("n", F.lit(5)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (float(seen.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [min(max(1e-3, x), i + 1 - 1e-3) for i, x in enumerate((1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    placed = counts.withColumns({"ctx": F.expr("substring(g, 1, length(g) - 1)"), "off": off})
    totals = placed.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("lost"))
    own = placed.join(totals, "ctx").select("g", "ctx", "n", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"), (F.col("lost") / F.col("total")).alias("gamma"))
    return own, totals.select("ctx", (F.col("lost") / F.col("total")).alias("gamma"))


def train(docs: DataFrame, good: DataFrame, doc_id: str = "doc_id", text: str = "_text", good_id: str = "_id") -> tuple[DataFrame, float]:
    """The model's written table (g, n, lp, bow) of the docs among good, and the log-probability of a symbol never seen.

    Each row is an n-gram of 1 to ORDER symbols with its count or number of different symbols
    before it, the log of its interpolated probability, and the log of the mass that it, as a
    context, leaves to shorter ones. Every text is counted, whole. Tasks sum their own counts
    before they are dealt out by n-gram; continuation counts, context totals and lower orders
    meet by sharded joins, so the table may grow with the corpus without bound.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    counts = [save(among(rows, good, "doc_id", good_id, _counter, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")))]
    for _ in range(ORDER - 1):  # how many different symbols precede the shorter n-gram
        counts.append(save(counts[-1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("n"))))
    counts.reverse()
    symbols = counts[0].count()
    if not symbols:
        return save(counts[0].select("g", "n", F.lit(0.0).alias("lp"), F.lit(0.0).alias("bow"))), 0.0
    levels = [_level(c) for c in counts]
    unseen = float(np.log(levels[0][1].first()["gamma"] / (symbols + 1)))
    below, models = None, []
    for k, (own, _) in enumerate(levels):
        rest = F.lit(1.0 / (symbols + 1))
        if below is not None:
            own = own.withColumn("_s", F.expr("substring(g, 2)")).join(below.select(F.col("g").alias("_s"), F.col("p").alias("_p")), "_s")
            rest = F.col("_p")
        below = save(own.select("g", "n", (F.col("own") + F.col("gamma") * rest).alias("p")))
        here = below.select("g", "n", F.log("p").alias("lp"))
        if k + 1 < ORDER:
            leaves = levels[k + 1][1].select(F.col("ctx").alias("g"), F.log("gamma").alias("bow"))
            here = here.join(leaves, "g", "full")  # contexts of padding alone are no n-grams
        else:
            here = here.withColumn("bow", F.lit(0.0))
        models.append((below, here.select("g", F.coalesce("n", F.lit(0)).alias("n"), "lp", F.coalesce("bow", F.lit(0.0)).alias("bow"))))
    out = models[0][1]
    for _, m in models[1:]:
        out = out.unionByName(m)
    out = save(out)
    drop(*counts, *(b for b, _ in models))
    return out, unseen


def head(model: DataFrame, most: int = HEAD) -> tuple[DataFrame, pa.Table]:
    """The model's other n-grams, and those at least as common as a count that at most ``most`` of their order reach."""
    size, step = F.length("g"), F.floor(F.log2(F.greatest("n", F.lit(1)).cast("double")) * 4)
    bins = model.groupBy(size.alias("k"), step.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()  # some 250 rows an order
    least = {}
    for k in range(1, ORDER + 1):
        n = 0
        least[k] = 1000
        for b, c in sorted(((r["b"], r["c"]) for r in bins if r["k"] == k), reverse=True):
            n += c
            if n > most:
                break
            least[k] = b
    common = step >= F.element_at(F.array(*(F.lit(least[k]) for k in range(1, ORDER + 1))), size)
    return model.filter(~common), model.filter(common).select("g", "lp", "bow").toArrow()  # at most ORDER * most rows


class Table:
    """N-grams by hash, with log-probability (NaN for contexts that are none) and back-off."""

    def __init__(self, parts: list, columns: tuple | None = None):
        if columns is not None:
            self.h, self.lp, self.bow = columns
            return
        columns = [[], [], []]
        for g, lp, bow in parts:
            if len(g):
                columns[0].append(_fold(np.asarray(g.to_pylist(), f"<U{ORDER}").view("<u4").reshape(-1, ORDER).T))
                columns[1].append(lp.to_numpy(zero_copy_only=False).astype(np.float64))
                columns[2].append(bow.to_numpy(zero_copy_only=False).astype(np.float64))
        h, lp, bow = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(columns, (np.uint64, float, float), strict=True))
        at = np.argsort(h)
        self.h, self.lp, self.bow = h[at], lp[at], bow[at]

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The place of each n-gram (a row of code points, zeros at its end), or -1."""
        if not len(self.h) or not len(grams):
            return np.full(len(grams), -1)
        h = _fold(grams.T)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def _part(grams: np.ndarray, start: int, stop: int) -> np.ndarray:
    out = np.zeros_like(grams)
    out[:, : stop - start] = grams[:, start:stop]
    return out


def logs(grams: np.ndarray, tables: list[Table], unseen: float) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(_logs(grams[i : i + SLICE], tables, unseen) for i in range(0, len(grams), SLICE))])


def _logs(grams: np.ndarray, tables: list[Table], unseen: float, wanted: list | None = None) -> np.ndarray:
    """Log-probability of the last symbol of each n-gram: that of the longest suffix that was seen, and the back-offs of the longer contexts.

    ``wanted`` takes the n-grams that no table holds and that might decide.
    """
    out, todo = np.zeros(len(grams)), np.arange(len(grams))
    for n in range(ORDER, 0, -1):
        part = _part(grams[todo], ORDER - n, ORDER)
        context = _part(grams[todo], ORDER - n, ORDER - 1)
        found, given = np.zeros(len(todo), bool), np.zeros(len(todo), bool)
        lp, bow = np.zeros(len(todo)), np.zeros(len(todo))
        for t in tables:
            at = t.find(part)
            on = np.flatnonzero(at >= 0)
            on = on[~np.isnan(t.lp[at[on]])]
            found[on], lp[on] = True, t.lp[at[on]]
            at = t.find(context)
            on = np.flatnonzero(at >= 0)
            given[on], bow[on] = True, t.bow[at[on]]
        out[todo[found]] += lp[found]
        left = ~found
        if wanted is not None:
            wanted.append(part[left])
            if n > 1:
                wanted.append(context[left & ~given])
        if n > 1:
            out[todo[left]] += bow[left]
        todo = todo[left]
    out[todo] += unseen
    return out


def _packer(limit: int):
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=12)
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "body"])

        for batch in batches:
            at = 0
            ends = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("_text")])
            while at < batch.num_rows:
                # rows up to the limit, or one that is over it
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit - size, "right")))
                part = batch.slice(at, stop - at)
                held.append(part)
                size += int(ends[stop - 1] - (ends[at - 1] if at else 0))
                at = stop
                if size >= limit or at < batch.num_rows:
                    yield packed()
                    number, held, size = number + 1, [], 0
        if held:
            yield packed()

    return run


def _unpack(body: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()


def _asker(shared):
    def run(batches):
        tables = [Table([], shared.value)]
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                found = [np.zeros(0, f"<U{ORDER}")]
                for grams, _ in together(t.as_py() or "" for t in _unpack(body.as_py()).column("_text")):
                    for i in range(0, len(grams), SLICE):
                        wanted = []
                        _logs(grams[i : i + SLICE], tables, 0.0, wanted)
                        found.append(np.unique(strings(np.concatenate(wanted))))
                g = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(g)], ["block", "g"])

    return run


def _scorer(shared, unseen: float):
    def run(batches):
        common = Table([], shared.value)
        at, held = None, []
        for batch in batches:
            # answers of a block, and then the block
            block, last = batch.column("block").to_numpy(), batch.column("last").to_numpy(zero_copy_only=False)
            start = 0
            for stop in [*np.flatnonzero(last), batch.num_rows]:
                if stop > start:
                    if at != block[start]:
                        at, held = block[start], []
                    held.append(tuple(batch.column(c).slice(start, stop - start) for c in ("g", "lp", "bow")))
                if stop < batch.num_rows:
                    yield _score(_unpack(batch.column("body")[stop].as_py()), [common, Table(held if at == block[stop] else [])], unseen)
                    held = []
                start = stop + 1

    return run


def _score(rows: pa.Table, tables: list[Table], unseen: float) -> pa.RecordBatch:
    total, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
    for grams, runs in together(t.as_py() or "" for t in rows.column("_text")):
        all_ = logs(grams, tables, unseen)
        for who, sizes, at in runs:
            np.add.at(total, who, np.add.reduceat(all_[at], np.concatenate([[0], np.cumsum(sizes)[:-1]])))
            np.add.at(n, who, sizes)
    value = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
    return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in ("doc_id", "lang")), pa.array(n), value], ["doc_id", "lang", "n_scored", "perplexity"])


def perplexities(slim: DataFrame, model: DataFrame, unseen: float) -> DataFrame:
    """(doc_id, lang, n_scored, perplexity) of rows (doc_id, lang, _text).

    Texts are packed into blocks of about BLOCK_BYTES; each block asks once for every n-gram that
    it needs and that is not among the commonest, the requests meet the model's table in a join
    by n-gram, and the answers meet their block. No n-gram is asked for twice by a block, and
    texts are dealt out once, compressed.
    """
    spark = slim.sparkSession
    rare, most = head(model)
    table = Table([tuple(most.column(c).combine_chunks() for c in ("g", "lp", "bow"))])
    shared = spark.sparkContext.broadcast((table.h, table.lp, table.bow))  # at most ORDER * HEAD rows
    blocks = save(slim.mapInArrow(_packer(BLOCK_BYTES), "block long, body binary"))
    answers = blocks.mapInArrow(_asker(shared), "block long, g string").join(rare.select("g", "lp", "bow"), "g")
    rows = answers.select("block", F.lit(False).alias("last"), "g", "lp", "bow", F.lit(None).cast("binary").alias("body"))
    rows = rows.unionByName(blocks.select("block", F.lit(True).alias("last"), F.lit(None).cast("string").alias("g"), F.lit(0.0).alias("lp"), F.lit(0.0).alias("bow"), "body"))
    out = save(rows.repartition("block").sortWithinPartitions("block", "last").mapInArrow(_scorer(shared, unseen), "doc_id long, lang string, n_scored long, perplexity double"))
    drop(blocks)
    return out


def _fold_of(c):
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % FOLDS


def score(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_scored, perplexity, threshold, kept) of each row of docs.

    The model learns the whole texts of the documents whose label ``quality`` is 1, but for one
    fold of them by hash of doc_id, and scores every code point of every document. A document is
    kept if its perplexity, to six decimals, is at most the ``quantile`` of that fold's in its
    language (of the whole fold where the language has none): documents that the model has not
    seen tell what good ones look like to it.

    Null and empty texts have no perplexity and are not kept; a null lang is a language of its
    own; repeated rows score alike; without trusted documents everything that has text is kept;
    no rows give no rows; NUL counts as U+FFFD, and a text's own U+0002 looks like its beginning.
    """
    bound_batches(docs.sparkSession)
    good = labels.filter("quality = 1").select(F.col(doc_id).cast("long").alias("_id")).filter("_id IS NOT NULL").distinct()
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("_text"))
    model, unseen = train(slim, good.filter(_fold_of(F.col("_id")) != 0))
    scored = perplexities(slim, model, unseen).withColumn("perplexity", F.round("perplexity", 6))
    drop(model)
    told = scored.join(good.filter(_fold_of(F.col("_id")) == 0), F.col("doc_id") == F.col("_id"), "left_semi").filter("perplexity IS NOT NULL")
    by = told.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("_own"))
    top = told.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    out = scored.join(by.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    limit = F.coalesce("_own", F.lit(float("inf") if top is None else top))
    return out.select("doc_id", "lang", "n_scored", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))
