"""MinHash near-duplicates: universal hash minima, bands, signature and full-set checks, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import blocks
from cairn.llm.common import bound_batches, drop, likely, packed, save
from cairn.llm.components import components

#: Words to a shingle, least similarity in percent.
WIDTH, PERCENT = 5, 75
#: Minima to a band, bands (a power of two at most 64). A pair at 0.75 shares no band with probability 4e-6, at 0.8 with 4e-9.
ROWS, BANDS = 6, 64
#: Bands whose larger buckets are tried against their least node before all pairs are.
STAR_BANDS = 16
#: Two bits of each minimum make the sketch; links are estimated from it, and checked on full
#: sets unless the estimate lies this many standard deviations below the threshold.
SIGMAS = 5.5
SEED = 7
#: Tasks that share the rows of a bucket.
SALTS = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The document's set as sorted 64-bit hashes: distinct runs of ``width`` words, or the whole shorter sequence."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(width, len(words))
    h = np.full(len(words) - take + 1, np.uint64(take))
    for i in range(take):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(words) - take + 1 + i]
    return np.unique(_mix(h))


def _coefficients(rows: int, bands: int):
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**64, rows * bands, np.uint64) | np.uint64(1)
    return a[:, None], rng.integers(0, 2**64, rows * bands, np.uint64)[:, None]


def signature(s: np.ndarray, coefficients, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the sketch of a set. Each minimum is over a*x+b of the top 32 bits, in 64-bit arithmetic."""
    a, b = coefficients
    least = np.full(rows * bands, np.uint64(2**64 - 1))
    x = s >> np.uint64(32)
    for i in range(0, len(x), 512):
        np.minimum(least, (a * x[None, i : i + 512] + b).min(axis=1), out=least)
    mixed = _mix(least >> np.uint64(32))
    key = np.zeros(bands, np.uint64)
    for i in range(rows):
        key = _mix(key * np.uint64(31) + mixed[i::rows])
    key = key << np.uint64(6) | np.arange(bands, dtype=np.uint64)  # the low bits tell the band
    two = (mixed & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return key.view(np.int64), two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6


def _list(values: np.ndarray, kind: pa.DataType, offsets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _signer(width: int, rows: int, bands: int):
    def run(batches):
        coefficients = _coefficients(rows, bands)
        for batch in batches:
            n, c1, c2, keys, sketches, at = [], [], [], [], [], [0]
            for text in batch.column("_text"):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                if len(s):
                    k, sk = signature(s, coefficients, rows, bands)
                    keys.append(k)
                    sketches.append(sk.tobytes())
                    c1.append(np.bitwise_xor.reduce(s).view(np.int64))
                    c2.append(_mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))
                else:
                    sketches.append(b"")
                    c1.append(np.int64(0))
                    c2.append(np.int64(0))
                at.append(at[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), batch.column("_key"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), _list(flat, pa.int64(), at), pa.array(sketches, pa.binary())], ["_row", "doc_id", "_key", "n", "c1", "c2", "bands", "sketch"])

    return run


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shares of equal two-bit fields between sketches, row against row."""
    d = x ^ y
    d = (d | d >> np.uint8(1)) & np.uint8(0x55)
    return 1 - np.bitwise_count(d).sum(axis=-1, dtype=np.int64) / (x.shape[-1] * 4)


def least_agreement(percent: int, fields: int) -> float:
    p = percent / 100 + (1 - percent / 100) / 4
    return p - SIGMAS * (p * (1 - p) / fields) ** 0.5


def _sketched(percent: int, fields: int):
    def run(batches):
        least = least_agreement(percent, fields)
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
            on = pa.array(_agreement(x, y) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["u", "v"]).filter(on)

    return run


def _verifier(width: int, percent: int):
    def run(batches):
        last, held = None, None
        for batch in batches:
            on = []
            for v, tx, ty in zip(batch.column("v").to_pylist(), batch.column("tx"), batch.column("ty"), strict=True):
                if v != last:
                    last, held = v, shingles(ty.as_py(), width)
                s = shingles(tx.as_py(), width)
                both = len(np.intersect1d(s, held, assume_unique=True))
                on.append(100 * both >= percent * (len(s) + len(held) - both))
            yield batch.select(["u", "v"]).filter(pa.array(on, pa.bool_()))

    return run


def _across(width: int, percent: int, fields: int):
    """Links that join different components in one block pair, as a spanning forest: sketches first, then full sets."""

    def run(batches):
        least = least_agreement(percent, fields)
        for t in blocks.groups(batches, ["k", "_i", "_j"]):
            node, comp, b, n = (t.column(c).to_numpy() for c in ("node", "comp", "_b", "n"))
            comp = comp.copy()  # of what the block has joined so far
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
            rows, cols = np.flatnonzero(b == i), np.flatnonzero(b == j)
            sets: dict[int, np.ndarray] = {}

            def of(x, t=t, sets=sets):
                if x not in sets:
                    sets[x] = shingles(t.column("_text")[x].as_py(), width)
                return sets[x]

            us, vs = [], []
            for r in rows:
                c = cols[(comp[cols] != comp[r]) & ((node[cols] > node[r]) if i == j else True)]
                c = c[(100 * np.minimum(n[c], n[r]) >= percent * np.maximum(n[c], n[r])) & (_agreement(sk[r], sk[c]) >= least)]
                if not len(c):
                    continue
                own, flat = of(r), np.concatenate([of(x) for x in c])
                at = np.searchsorted(own, flat)
                hit = own[np.minimum(at, len(own) - 1)] == flat
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n[c])[:-1]]), dtype=np.int64)
                c = c[100 * both >= percent * (n[c] + n[r] - both)]
                if not len(c):
                    continue
                # one link to each component it meets joins them; any other would say the same again
                met, first = np.unique(comp[c], return_index=True)
                c = c[first]
                us.append(np.maximum(node[c], node[r]))
                vs.append(np.minimum(node[c], node[r]))
                comp[np.isin(comp, met)] = comp[r]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, _key, n_shingles, component_id, kept) for each row of docs.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id that links reach, and kept says whether it is the row's
    own. _key is the text's MD5.

    1. Each text gives its set's minima under rows*bands universal hashes, as bands and as a
       sketch of two bits each. Equal sets become one node.
    2. The two nodes of a bucket (nodes that share a band) of two, and in the first bands every
       node and the least of its bucket, are tried: by sketch, then on full sets. The links
       found give components.
    3. In buckets of three or more that still hold two components, all pairs of different
       components are tried the same way inside blocks of bounded size, so that no connection is
       lost; pairs already connected are never tried, and of the links found in a block only a
       spanning forest leaves it, fewer than it has rows.
       Components are then taken over all links.

    Null texts and texts without words have no shingles and link with nothing, whatever else
    is equal; null doc_ids take part in links, and alone they have a null component and are
    kept; repeated rows have one component; no rows give no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    fields = rows * bands
    slim = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.md5(text).alias("_key"), F.col(text).cast("string").alias("_text"))
    signed = save(slim.mapInArrow(_signer(width, rows, bands), "_row long, doc_id long, _key string, n long, c1 long, c2 long, bands array<long>, sketch binary"))
    # equal sets have equal bands and sketches, so any row's will do
    nodes = save(signed.filter("n > 0").groupBy("n", "c1", "c2").agg(F.min("_row").alias("node"), F.min("doc_id").alias("low"), F.first("_key").alias("_key"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    placed = nodes.select("node", F.explode("bands").alias("k"))
    buckets = save(placed.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    members = save(placed.join(buckets.filter("c > 2"), "k"))
    stars = buckets.filter("c = 2").select(F.col("b").alias("u"), F.col("a").alias("v"))
    led = members.filter((F.col("node") != F.col("a")) & (F.col("k").bitwiseAND(63) < STAR_BANDS))
    stars = save(stars.unionByName(led.select(F.col("node").alias("u"), F.col("a").alias("v"))).distinct())
    some = stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).unionByName(members.select("node")).distinct()
    wanted = save(nodes.join(some, "node", "left_semi").select("node", "_key"))
    # copies of a text are one row for each task before they are dealt out
    once = likely(slim.filter("_key IS NOT NULL").select("_key", "_text"), wanted, "_key", "_key").groupBy("_key").agg(F.first("_text").alias("_text"))
    texts = save(once.join(wanted, "_key").select("node", "_text"))
    sketches = nodes.select("node", "sketch")

    x, y = (sketches.select(F.col("node").alias(n), F.col("sketch").alias(s)) for n, s in (("u", "sx"), ("v", "sy")))
    tried = stars.join(x, "u").join(y, "v").mapInArrow(_sketched(percent, fields), "u long, v long")
    x, y = (texts.select(F.col("node").alias(n), F.col("_text").alias(t)) for n, t in (("u", "tx"), ("v", "ty")))
    links = save(tried.join(x, "u").join(y, "v").select("u", "v", "tx", "ty").mapInArrow(_verifier(width, percent), "u long, v long"))
    found = save(components(links))
    # buckets of two have had their pair tried
    apart = members.join(found, "node", "left").select("k", "c", "node", F.coalesce("component", "node").alias("comp"))
    mixed = apart.groupBy("k").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter("_x < _y").select("k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    held = nodes.select("node", "n", "sketch").join(texts, "node")
    # a bucket may hold very many nodes: its rows go to SALTS tasks
    open_rows = apart.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(mixed, ["k", "_salt"]).drop("_salt").join(held, "node")
    dealt = blocks.deal(open_rows, "k", "c", "node").select("k", "_i", "_j", "_b", "node", "comp", "n", "sketch", "_text")
    late = save(dealt.mapInArrow(_across(width, percent, fields), "u long, v long").distinct())
    if not late.isEmpty():
        stars_now = found.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        old, found = found, save(components(stars_now.unionByName(late)))
        drop(old)
    classes = nodes.select("n", "c1", "c2", "node", "low").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = classes.groupBy("component").agg(F.min("low").alias("_low"))
    classes = classes.join(lows, "component").select("n", "c1", "c2", "_low")
    out = signed.select("doc_id", "_key", "n", "c1", "c2").join(classes, ["n", "c1", "c2"], "left")
    least = F.when(F.col("n") > 0, F.col("_low")).otherwise(F.col("doc_id"))
    out = save(out.select("doc_id", "_key", F.col("n").alias("n_shingles"), least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept")))
    drop(buckets, members, texts, wanted, stars, links, late, found, nodes, signed)
    return out


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of every component the document that it is named after, once."""
    text, doc_id = options.get("text", "text"), options.get("doc_id", "doc_id")
    found = near_duplicates(docs, **options)
    kept = save(found.filter("kept").groupBy(F.col("doc_id").alias("_k"), F.col("_key").alias("_kk")).agg(F.count(F.lit(1)).alias("_n")))
    drop(found)
    rows = docs.select(packed(docs).alias("_doc"), F.col(f"`{doc_id}`").cast("long").alias("_id"), F.md5(F.col(f"`{text}`").cast("string")).alias("_key"))
    out = rows.join(kept, F.col("_id").eqNullSafe(F.col("_k")) & F.col("_key").eqNullSafe(F.col("_kk")), "left_semi")
    if not kept.filter("_n > 1").isEmpty():
        out = out.dropDuplicates(["_id", "_key"])
    return out.select("_doc.*")
