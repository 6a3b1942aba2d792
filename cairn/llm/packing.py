"""Best-fit packing of documents into sequences: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches, drop, kept, number_rows, save

#: Words remembered by a Python worker; past that many it forgets them and goes on.
REMEMBERED = 1 << 19
#: What follows each document.
END = 0
#: How the vocabulary's pre-tokenisation cuts a lower-cased word of ASCII and Latin-1 letters,
#: and words that it cuts so. All others go through the whole of the library's encoding.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"

#: Rounds of one program, and programs on what the last one left.
ROUNDS, PHASES = 120, 4
#: Lengths priced together in a round, and configurations taken from one pricing.
PRICED, TAKEN = 384, 96
#: Roundings that are tried: the part of a share that is used, and the share from which on a configuration counts as one.
SHARES = ((0.1, 1e9), (0.3, 1e9), (1.0, 1.0), (1.0, 0.5), (1.0, 0.2), (1.0, 0.05))
#: Share of a length's demand that one step, and that one round, covers at most.
STEP, ROOM = 0.1, 0.2
#: How fast a length's weight falls as it is covered; how much dearer long ones are from the start.
ETA, LONG = 4.0, 0.05


class Words:
    """Ids of whole texts as the vocabulary's library gives them, word by word.

    The vocabulary drops white space, and no step of its encoding looks across ASCII white space,
    so a text's ids are those of its words in a row. Each different word is encoded once and
    remembered.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        from cairn.llm.tokens import _byte_symbols

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.cuts: dict[str, bytes] = {}
        self.cut, self.plain = re.compile(CUT).findall, re.compile(PLAIN).fullmatch
        self.symbol = {b: c for c, b in _byte_symbols().items()}

    def _cut(self, part: str) -> bytes:
        if (found := self.cuts.get(part)) is None:
            if len(self.cuts) >= REMEMBERED:
                self.cuts.clear()
            text = part if part.isascii() else "".join(self.symbol[b] for b in part.encode())
            found = self.cuts[part] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if len(text) < 64 and "<|" not in text and self.plain(text):
            ids = b"".join([self._cut(p) for p in self.cut(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(word) < 64:
            self.words[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit integers, low byte first."""
        words, one = self.words, self._word
        return b"".join([words.get(w) or one(w) for w in text.encode("utf-8", "surrogatepass").split()])


def _cutter(path: str, most: int, keep: bool):
    def run(batches):
        made = kept(("words", path), lambda: Words(path))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column("doc_id"), ([], [], [], [], [], [])
            for k, text in enumerate(batch.column("_text")):
                body = made.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(body), 4 * most)):
                    part = body[at : at + 4 * most]
                    for column, value in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep else None), strict=True):
                        column.append(value)
            who, piece, start, length, crc, own = rows
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, path: str, most: int = 2048, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of each document's ids and a final END, cut after every ``most`` ids.

    ``ids`` holds a piece's unsigned 32-bit ids, low byte first, if kept, else null. ``path`` is
    the vocabulary file on the executors.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return slim.mapInArrow(_cutter(path, most, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: for each capacity the length put in last by a best filling, 0 where one unit stays free."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            worth = best[c - lengths[:k]] + values[:k]
            j = worth.argmax()
            if worth[j] > best[c]:
                best[c], last[c] = worth[j], lengths[j]
    return last


def program(demand: np.ndarray, capacity: int, rng: np.random.Generator, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations and how often each is used, fractionally, so that every length's demand is nearly covered.

    Covering program by multiplicative weights: a length's weight falls by the exponential of the
    share of its demand that is covered, so that its price per item rises against the others
    while it lags. Each round prices a random part of the open lengths, those that lag first
    among them, by one knapsack table; the best configurations that hold one lagging length each
    are used for a step that covers at most STEP of any of their lengths.
    """
    all_ = np.arange(capacity + 1)
    active, covered, used = np.flatnonzero(demand), np.zeros(capacity + 1), {}
    weight = (demand * all_).astype(float)
    for _ in range(rounds):
        mean = float((covered * weight).sum() / weight.sum())
        open_ = active[covered[active] < 1 - 1e-9]
        if not len(open_) or mean > 0.99:
            break
        lag = open_[np.lexsort((-open_, np.floor(covered[open_] * 20)))]
        chosen = lag[:TAKEN]
        if len(lag) > TAKEN:
            chosen = np.concatenate([chosen, rng.choice(lag[TAKEN:], min(len(lag) - TAKEN, PRICED - TAKEN), replace=False)])
        chosen = np.sort(chosen)
        value = chosen * (1 + LONG * chosen / capacity) * np.exp(-ETA * (covered[chosen] - mean)) * (1 + 0.02 * rng.random(len(chosen)))
        last = price(value, chosen, capacity)
        room = np.minimum(1, np.maximum(covered, mean) + ROOM)
        for first in lag[:TAKEN].tolist():
            config, at = {first: 1}, capacity - first
            while at > 0:
                if not (l := int(last[at])):
                    at -= 1
                    continue
                config[l] = config.get(l, 0) + 1
                at -= l
            if any(k > demand[l] for l, k in config.items()):
                config = {l: min(k, int(demand[l])) for l, k in config.items()}
            step = min(min(STEP, room[l] - covered[l]) * demand[l] / k for l, k in config.items())
            if step > 1e-12:
                key = tuple(sorted(config.items(), reverse=True))
                used[key] = used.get(key, 0.0) + step
                for l, k in config.items():
                    covered[l] += step * k / demand[l]
    return used


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Configurations with counts that hold the whole demand, longest first, each into the fullest sequence that it fits, many at a time."""
    groups: list[list] = [[] for _ in range(capacity + 1)]  # by free room: [configuration, how many]
    some = np.zeros(capacity + 1, bool)

    def put(free, config, n):
        groups[free].append((config, n))
        some[free] = True

    for l in np.flatnonzero(demand)[::-1].tolist():
        n = int(demand[l])
        while n:
            at = int(some[l:].argmax()) + l
            if not some[at]:
                per = capacity // l
                if n >= per:
                    put(capacity - per * l, ((l, per),), n // per)
                if n % per:
                    put(capacity - n % per * l, ((l, n % per),), 1)
                break
            config, m = groups[at].pop()
            some[at] = bool(groups[at])
            if m > n:
                put(at, config, m - n)
                m = n
            config = (*config[:-1], (l, config[-1][1] + 1)) if config[-1][0] == l else (*config, (l, 1))
            put(at - l, config, m)
            n -= m
    return [(c, n) for g in groups for c, n in g]


def configurations(demand: np.ndarray, capacity: int, seed: int = 7) -> list[tuple[tuple, int]]:
    """Configurations ((length, how many), ...) with counts that use up ``demand`` (by length, from 0).

    program() is solved and full configurations are used as often as their shares say, or a part of
    that, rounded down; a share under one counts as one from some bound on, while there is demand
    for it (SHARES).
    best_fit() takes the rest. What the last share leaves is solved again, PHASES times, and of
    all these roundings the one with the fewest sequences stays. Their number depends on the
    capacity, not on the number of items.
    """
    rng, left = np.random.default_rng(seed), demand.astype(np.int64)
    out = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    found = None
    for _ in range(PHASES):
        if not left.any():
            break
        used = sorted(program(left, capacity, rng).items(), key=lambda x: (-x[0][0][0], -x[1], x[0]))
        used = [x for x in used if sum(l * k for l, k in x[0]) == capacity]
        for part, least in SHARES:
            new, after = _rounded(used, left, part, least)
            rest = best_fit(after, capacity)
            total = sum(n for _, n in out + new + rest)
            if found is None or total < found[0]:
                found = (total, out + new + rest)
        if not new:
            break
        out, left = out + new, after
    return out if found is None else found[1]


def _rounded(used: list, left: np.ndarray, part: float, least: float) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    out, left = [], left.copy()
    for config, share in used:
        n = min(max(int(share * part + 1e-9), int(share >= least)), *(int(left[l]) // k for l, k in config))
        if n:
            out.append((config, n))
            for l, k in config:
                left[l] -= n * k
    return out, left


def _places(plan: list[tuple[tuple, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For runs of ranks within a length, in order: length and first rank in one number, items to a sequence, first sequence, offset."""
    next_rank, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for config, n in plan:
        offset = 0
        for l, k in config:
            rows.append((l << 44 | int(next_rank[l]), k, sequence, offset))
            next_rank[l] += n * k
            offset += l * k
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(4))


def _placer(shared):
    def run(batches):
        key, per, first, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            place, nth = np.divmod(rank - (key[at] & (1 << 44) - 1), per[at])
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[at] + place), pa.array(offset[at] + nth * length), batch.column("ids")], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, path: str, most: int = 2048, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """pieces() with the sequence_id and the offset there of each, in few sequences of at most ``most`` ids.

    The driver sees only the histogram of lengths, at most ``most`` rows, and plans
    configurations for it; the plan, whose size does not depend on the corpus, goes to every
    task. Pieces are numbered within their length by range-partitioned prefix counts, and a
    piece's number tells its sequence and offset. Null and empty texts are documents of one id;
    repeated rows are documents of their own; ties go by doc_id, null last, piece and checksum;
    no rows give no rows. Reruns give each piece of a document the same place unless rows repeat.
    """
    cut = save(pieces(docs, path, most, keep_ids, text, doc_id))
    demand = np.zeros(most + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        demand[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(_places(configurations(demand, most), most))
    ranked = number_rows(cut, ["length"], [F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32"], "_n")
    out = ranked.withColumn("_rank", F.col("_n") - 1).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "_rank")
    drop(cut)
    return out.mapInArrow(_placer(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the ids of each sequence in order, from pack() with kept ids. A sequence holds ``most`` ids at most."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"))
