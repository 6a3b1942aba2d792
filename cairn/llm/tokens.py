"""Token counts of byte-pair encodings at every prefix, by dynamic programming."""

from __future__ import annotations

import json
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches


#: Fixed values of byte-level pre-tokenisation: the pattern, with Unicode white space spelled out.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces remembered by a task; past that many it forgets them and goes on.
REMEMBERED = 300_000


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes of a text, for a byte-level BPE vocabulary file.

    Within a piece of the pre-tokenisation, the encoding of a prefix ends in the one token that
    is a suffix of it and may follow the last token of what stands before: two tokens may follow
    each other if their bytes, encoded together, give those two. So the last token and the count
    of each prefix come from those of shorter prefixes, and counts of pieces add up.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        symbol = _byte_symbols()
        as_bytes = lambda s: bytes(symbol[c] for c in s)
        self.vocab = {as_bytes(s) for s in data["model"]["vocab"]}
        merges = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.ranks = {(as_bytes(x), as_bytes(y)): i for i, (x, y) in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        self.special = [t["content"] for t in data["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PATTERN, regex.V0)
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.totals: dict[str, int] = {}

    def merge(self, b: bytes) -> list[bytes]:
        """Plain encoding of a few bytes: the lowest-ranked pair is merged, again and again."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, x: bytes, y: bytes) -> bool:
        """Whether token y may come after token x, or first if x is empty."""
        if (found := self.follows.get((x, y))) is None:
            if len(self.follows) >= 4 * REMEMBERED:
                self.follows.clear()
            found = self.follows[x, y] = self.merge(x + y) == ([x, y] if x else [y])
        return found

    def piece(self, b: bytes) -> list[int]:
        """Token counts of b's prefixes, by bytes from 0 to len(b)."""
        vocab, follows, n = self.vocab, self.follows, len(b)
        last: list[bytes] = [b""] * (n + 1)
        count = [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):  # one suffix at most fits; short ones are likelier
                t = b[start:end]
                if t in vocab:
                    pair = (last[start], t)
                    if follows[pair] if pair in follows else self.may_follow(*pair):
                        last[end], count[end] = t, count[start] + 1
                        break
            else:
                raise ValueError(f"the vocabulary cannot encode {b[:end]!r}")
        return count

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last count of each piece, added up."""
        n, known = 0, self.totals
        parts = self.split_special.split(text) if self.split_special else [text]
        for part in parts:
            for p in self.pieces.findall(part):
                c = known.get(p)
                if c is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    c = known[p] = self.piece(p.encode("utf-8", "surrogatepass"))[-1]
                n += c
        return n + len(parts) - 1

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the pieces in code points, and tokens up to each: what prefix() needs of the whole text."""
        ends, counts, at, n = [], [], 0, 0
        specials = [*self.split_special.finditer(text)] if self.split_special else []
        bounds = [(m.start(), m.end()) for m in specials] + [(len(text), len(text))]
        for start, end in bounds:
            for m in self.pieces.finditer(text[at:start]):
                n += self.piece(m[0].encode("utf-8", "surrogatepass"))[-1]
                ends.append(at + m.end())
                counts.append(n)
            if end > start:
                n += 1
                ends.append(end)
                counts.append(n)
            at = end
        return ends, counts

    def prefix(self, text: str) -> list[int]:
        """Tokens of text[:p] for every p from 0 to len(text), each as if that prefix were encoded alone."""
        out, base = [0], 0
        specials = [*self.split_special.finditer(text)] if self.split_special else []
        at = 0
        for start, end in [(m.start(), m.end()) for m in specials] + [(len(text), len(text))]:
            part = text[at : max(start, end - 1)]  # cuts inside a special string see it as text
            out += [base + c for c in self._segment(part)[1:]]
            base = out[start] if start < len(out) else out[-1]
            if end > start:
                base += 1
                out.append(base)
            at = end
        return out

    def _segment(self, text: str) -> list[int]:
        out, space = [0], frozenset(" \t\n\r\x0b\x0c\x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
        n = 0
        run = (0, 0, [], [])  # the run of white space at hand: its bounds, tokens by bytes, bytes by code points
        for m in self.pieces.finditer(text):
            s, e = m.span()
            steps = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in m[0])]
            counts = self.piece(m[0].encode("utf-8", "surrogatepass"))
            for p in range(s + 1, e + 1):
                if text[p - 1] in space:  # the run of white space before the cut is one piece
                    if not run[0] < p <= run[1]:
                        w = end = p - 1
                        while w and text[w - 1] in space:
                            w -= 1
                        while end < len(text) and text[end] in space:
                            end += 1
                        run = (w, end, self.piece(text[w:end].encode()), [0, *accumulate(len(c.encode()) for c in text[w:end])])
                    out.append(out[run[0]] + run[2][run[3][p - run[0]]])
                elif m[0][0] == "'" and p < e:  # a contraction cut short is no contraction
                    out.append(n + sum(self.piece(x.encode())[-1] for x in self.pieces.findall(text[s:p])))
                else:
                    out.append(n + counts[steps[p - s]])
            n += counts[-1]
        return out


def _counter(path: str):
    def run(batches):
        made = PrefixCounter(path)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("_text")]
            n = [made.total(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _slim(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, str]:
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return slim, slim.schema["doc_id"].dataType.simpleString()


def count_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of whole texts: what the last entry of each prefix table would be; only totals are kept.

    Null texts count as empty: 0 bytes, 0 tokens; special strings of the vocabulary are one
    token each; repeated rows count each; no rows give no rows. ``path`` is the vocabulary file
    on the executors.
    """
    slim, kind = _slim(docs, text, doc_id)
    return slim.mapInArrow(_counter(path), f"doc_id {kind}, n_bytes long, n_tokens long")


def prefix_tables(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, prefix_tokens): the exact token count of every prefix, by code points from 0."""
    slim, kind = _slim(docs, text, doc_id)

    def run(batches):
        made = PrefixCounter(path)
        for batch in batches:
            rows = [made.prefix(x.as_py() or "") for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "text", "prefix_tokens"])

    return slim.mapInArrow(run, f"doc_id {kind}, text string, prefix_tokens array<int>")


def truncate(tables: DataFrame, budget: int) -> DataFrame:
    """prefix_tables() with ``truncated``: the longest prefix of at most ``budget`` tokens; nothing is encoded again."""
    fits = F.array_max(F.transform("prefix_tokens", lambda n, p: F.when(n <= budget, p).otherwise(0)))
    return tables.withColumn("truncated", F.substring("text", F.lit(1), fits))


def within_budget(tables: DataFrame, budget: int) -> DataFrame:
    """prefix_tables() rows whose whole text is at most ``budget`` tokens."""
    return tables.filter(F.element_at("prefix_tokens", -1) <= budget)
