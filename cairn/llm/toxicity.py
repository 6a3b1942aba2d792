"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches, drop, save

GRAMS = (3, 4, 5, 6)
BITS = 18
#: Bound of training: labelled rows, by hash of their doc_id. Every n-gram of theirs is a feature.
MAX_ROWS = 12_000
SMOOTH, RIDGE, ROUNDS = 1.0, 3e-3, 24
#: One in so many training rows, by hash, is left for calibration; the pull of its slope to 1.
CALIBRATE, PULL = 5, 1e-3
#: Tasks that find the features of training rows, and steps that L-BFGS remembers.
FEATURE_TASKS, REMEMBERED = 8, 4
#: Rows of more buckets than this are kept as bitmaps, so that no row takes over 2**BITS / 8 bytes and a little.
DENSE = 1 << (BITS - 4)
#: Buckets of training rows that are unpacked at a time.
TOGETHER = 1 << 20


@dataclass
class Model:
    """Hash buckets with a weight, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float64)
        out[self.buckets] = self.weights
        return out


def grams(text: str | None) -> np.ndarray:
    """Hash buckets of all character n-grams of the whole lower-cased text, padded by spaces; may repeat."""
    body = " " + " ".join((text or "").lower().split()) + " "
    c = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, np.uint64(n))
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + c[i : len(c) - n + 1 + i]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _pack(buckets: np.ndarray) -> bytes:
    """Sorted different buckets as compressed differences, many as a compressed bitmap: they are read once for every step of the fit."""
    import zstandard

    if len(buckets) > DENSE:
        bits = np.zeros(1 << BITS, bool)
        bits[buckets] = True
        plain = b"b" + np.packbits(bits).tobytes()
    else:
        plain = b"d" + np.diff(buckets, prepend=0).astype("<i4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(plain)


def _unpack(packed: bytes, press) -> np.ndarray:
    plain = press.decompress(packed)
    if plain[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(plain, np.uint8, offset=1)))
    return np.cumsum(np.frombuffer(plain, "<i4", offset=1), dtype=np.int64)


def _featured(batches):
    for batch in batches:
        f = [_pack(np.unique(grams(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("c"), pa.array(f, pa.binary())], ["y", "c", "f"])


def _runs(rows: list[bytes]):
    """(place of the first row, buckets of each) of runs of rows that hold about TOGETHER buckets."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    held, n, at = [], 0, 0
    for f in rows:
        held.append(_unpack(f, press))
        n += len(held[-1])
        if n >= TOGETHER:
            yield at, held
            held, n, at = [], 0, at + len(held)
    if held:
        yield at, held


def _margins(rows: list[np.ndarray], v: np.ndarray) -> np.ndarray:
    idx = np.concatenate([*rows, np.empty(0, np.int64)])
    return np.bincount(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), weights=v[idx], minlength=len(rows)) + v[-1]


def fit(rows: list[bytes], y: np.ndarray, left: list[bytes], left_y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the intercept, learnt from packed rows with both labels and calibrated on those left."""
    n = np.zeros((2, 1 << BITS))
    for at, held in _runs(rows):
        for label in (0, 1):
            of = [r for r, x in zip(held, y[at : at + len(held)], strict=True) if x == label]
            n[label] += np.bincount(np.concatenate([*of, np.empty(0, np.int64)]), minlength=1 << BITS)
    total = [int((y == label).sum()) for label in (0, 1)]
    ratio = np.where(n.any(axis=0), np.log((n[1] + SMOOTH) / (total[1] + 2 * SMOOTH)) - np.log((n[0] + SMOOTH) / (total[0] + 2 * SMOOTH)), 0.0)

    def loss(w):
        v = np.append(w[:-1] * ratio, w[-1])
        grad, value = np.zeros(len(w)), 0.0
        for at, held in _runs(rows):
            z, own = _margins(held, v), y[at : at + len(held)]
            g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - own
            value += float((np.logaddexp(0, z) - own * z).sum())
            grad[:-1] += np.bincount(np.concatenate(held), weights=np.repeat(g, [len(r) for r in held]), minlength=1 << BITS)
            grad[-1] += g.sum()
        grad[:-1] *= ratio
        grad /= len(y)
        grad[:-1] += RIDGE * w[:-1]
        return value / len(y) + RIDGE / 2 * (w[:-1] @ w[:-1]), grad

    w = minimise(loss, (1 << BITS) + 1)
    v = np.append(w[:-1] * ratio, w[-1])
    slope, shift = calibrate(np.concatenate([*(_margins(held, v) for _, held in _runs(left)), np.empty(0)]), left_y)
    return slope * v[:-1], float(slope * v[-1] + shift)


def _fitted(batches):
    """One row: the weights of all buckets (none without both labels) and the intercept."""
    y, c, f = [], [], []
    for batch in batches:
        y += batch.column("y").to_pylist()
        c += batch.column("c").to_pylist()
        f += batch.column("f").to_pylist()
    y, c = np.array(y, float), np.array(c, bool)
    if len(set(y[~c])) == 2:
        part = lambda on: [x for x, k in zip(f, on, strict=True) if k]
        weights, bias = fit(part(~c), y[~c], part(c), y[c])
        at = np.flatnonzero(weights)
    else:
        weights, bias, at = np.empty(0), 20.0 if len(y) and y.all() else -20.0, np.empty(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at, weights[at])] + [pa.array([bias])], ["buckets", "weights", "bias"])


def minimise(loss, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """The least point of a smooth convex function, given with its gradient, from 0 by L-BFGS."""
    w = np.zeros(n)
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q = grad.copy()
        kept = []
        for s, d in reversed(pairs):
            a = (s @ q) / (s @ d)
            q -= a * d
            kept.append(a)
        if pairs:
            s, d = pairs[-1]
            q *= (s @ d) / (d @ d)
        for (s, d), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        step = 1.0
        while step > 1e-8:
            new = w - step * q
            v2, g2 = loss(new)
            if v2 <= value - 1e-4 * step * (grad @ q):
                break
            step /= 2
        else:
            break
        s, d = new - w, g2 - grad
        done = value - v2 < 1e-6 * abs(value)
        w, value, grad = new, v2, g2
        if s @ d > 1e-12:
            pairs = [*pairs[1 - REMEMBERED :], (s, d)]
        if done:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows of docs; labels are learnt only where crc32(doc_id as text) mod 5 is not 0.

    At most ``max_rows`` labelled documents take part, chosen by hash of doc_id, with their
    whole texts. Their n-grams, hashed to 2**BITS buckets, are all features and are found in
    FEATURE_TASKS tasks. One task then counts how many documents of each label hold a bucket,
    scales it by its log-count ratio and weighs the scaled features by a ridge logistic
    regression: a packed row takes at most 2**BITS / 8 bytes (32 kB) and a little, so the task
    holds at most about 400 MB at MAX_ROWS rows, however long the texts, and the driver gets
    nothing but the model. One training
    row in CALIBRATE is kept from this; on these a line through the margins makes the score a
    share, as margins of rows learnt from are too sure of themselves. Rows
    without an id, a text or a label of 0 or 1 are not learnt from; of several labels of one id
    the largest holds, of several texts the least. Without both labels the score is the share of the one there is, or 0.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col(doc_id).cast("string")) % 5 != 0)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(known, "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))
    rows = rows.select("text", "y", (F.crc32(F.concat(F.lit("c"), F.col("_id").cast("string"))) % CALIBRATE == 0).alias("c"))
    featured = save(rows.repartition(FEATURE_TASKS).mapInArrow(_featured, "y int, c boolean, f binary"))
    got = featured.coalesce(1).mapInArrow(_fitted, "buckets binary, weights binary, bias double").first()  # one row of a bounded size
    drop(featured)
    if got is None:
        return Model(np.empty(0, np.int64), np.empty(0), -20.0)
    return Model(np.frombuffer(got["buckets"], np.int64), np.frombuffer(got["weights"], np.float64), got["bias"])


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The line a * z + b whose logistic is nearest to y; no line without both labels."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0

    def loss(u):
        x = np.clip((u[0] + 1) * z + u[1], -500, 500)
        g = (1 / (1 + np.exp(-x)) - y) / len(y)
        return (np.logaddexp(0, x) - y * x).mean() + PULL / 2 * u[0] ** 2, np.array([(g * z).sum() + PULL * u[0], g.sum()])

    a, b = minimise(loss, 2, 200)
    return max(1e-3, float(a) + 1), float(b)


def _margin(model: Model):
    """text -> sum of the weights of its different buckets."""
    table, seen = model.table(), np.zeros(1 << BITS, bool)

    def of(text):
        seen[grams(text)] = True
        b = np.flatnonzero(seen)
        seen[b] = False
        return table[b].sum() + model.bias

    return of


def _scorer(model: Model):
    def run(batches):
        of = _margin(model)
        for batch in batches:
            out = [1 / (1 + np.exp(-np.clip(of(text.as_py()), -500, 500))) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_text"), pa.array(out, pa.float64())], [*(c for c in batch.schema.names if c != "_text"), "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text is scored.

    Null and empty texts hold no n-gram but the padding's and get the intercept's score; a null
    doc_id is not held out; repeated rows score alike; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = slim.mapInArrow(_scorer(model), f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def _keeper(model: Model, text: str):
    def run(batches):
        of = _margin(model)
        for batch in batches:
            yield batch.filter(pa.array([bool(of(t.as_py()) < 0) for t in batch.column(text)], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that score() predicts as toxic."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_keeper(model, text), docs.schema)
