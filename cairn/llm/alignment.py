"""Alignment of two tokenizers over a corpus: distinct segments of texts are tokenised and aligned once."""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound_batches, kept, parts, save
from cairn.llm.tokens import SPACE, _byte_symbols

#: Bytes of text in a block; every block asks once for each of its different segments.
BLOCK_BYTES = 12 << 20
#: Requests that are answered at once; segments encoded at once; segments of documents whose pairs are counted at once.
ANSWERED, ENCODED, COUNTED = 1 << 17, 1 << 14, 1 << 19
#: The most shards of segments, and alignments that a task remembers of one; past that many it forgets them and goes on.
MOST_SHARDS, REMEMBERED = 1024, 1 << 20
#: Characters before which texts may be split, where the vocabularies allow it.
STARTS = " \n\t"
#: What sentencepiece writes for a space.
MARK = "▁"


class Codes(dict):
    """Numbers its keys from 0 as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _crosses(tokens, start: str) -> bool:
    """Whether a token holds ``start`` behind something that is not white space."""
    blank = {chr(c) for c in range(0x10000) if chr(c).isspace()} | {MARK}
    return any(start in t and any(c == start and i and t[i - 1] not in blank for i, c in enumerate(t)) for t in tokens)


def starts(a_tokens: list[bytes], b_pieces: list[str]) -> str:
    """Those of STARTS before which a run of white space begins a segment: no token of either vocabulary crosses there.

    A merge makes tokens of the vocabulary only, so where none holds the two characters side by
    side nothing merges across, and both sides are encoded as if they stood alone. Nor may a
    piece hold the space that the second library adds in front together with such a character.
    """
    a = [t.decode("utf-8", "replace") for t in a_tokens]
    b = [p.replace(MARK, " ") for p in b_pieces]
    return "".join(c for c in STARTS if not _crosses(a, c) and not _crosses(b, c) and (c == " " or not any(f" {c}" in p for p in b)))


class Aligner:
    """Two vocabularies: a byte-level one of the library tokenizers, and one of sentencepiece that adds a space in front."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        symbol = _byte_symbols()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_bytes[i] = bytes(symbol[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array([len(b) for b in self.a_bytes]), np.array([len(b) for b in self.b_bytes])
        self.mark = self.b.piece_to_id(MARK)
        go = starts(self.a_bytes, [p for i, p in enumerate(pieces) if not self.b.is_byte(i)])
        # a segment: white space and what follows it, up to the next run of white space that may begin one
        stay = "".join(f"[{SPACE}&&[^{go}]]") if go else f"[{SPACE}]"
        self.cut = regex.compile(rf"(?:[{SPACE}]*[^{SPACE}]+|[{SPACE}]+)(?:{stay}[{SPACE}]*[^{SPACE}]*)*", regex.V1)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments, of which each begins with a space or another of starts()."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                b[i] = [self.mark]
            elif s[0] != " ":
                b[i] = b[i][1:] if b[i][0] == self.mark else []  # without the space that the library adds
        return a, b

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each segment (tokens of A, of B, groups, links), A's -1 if the bytes differ; the links of all in order, as A's id << 32 | B's; and groups as text.

        Between two neighbouring token ends, of whichever vocabulary, lies the overlap of exactly
        one pair of tokens, so a segment has a link for each different end.
        """
        a, b = self.encode(segments)
        ab, bb = self.a_bytes, self.b_bytes
        ok = []
        for s, x, y in zip(segments, a, b, strict=True):
            raw = s.encode()
            ok.append(b"".join([ab[i] for i in x]) == raw == b"".join([bb[i] for i in y]))
        counts = np.zeros((len(segments), 4), np.int32)
        counts[:, 0] = -1
        good = np.flatnonzero(ok)
        groups = [""] * len(segments)
        if not len(good):
            return counts, np.zeros(0, np.int64), groups
        na, nb = np.array([len(a[i]) for i in good]), np.array([len(b[i]) for i in good])
        ida = np.fromiter((t for i in good for t in a[i]), np.int64, na.sum())
        idb = np.fromiter((t for i in good for t in b[i]), np.int64, nb.sum())
        enda, endb = np.cumsum(self.a_size[ida]), np.cumsum(self.b_size[idb])
        ends = np.union1d(enda, endb)
        at_a, at_b = np.searchsorted(enda, ends), np.searchsorted(endb, ends)
        both = np.flatnonzero((enda[at_a] == ends) & (endb[at_b] == ends))
        last = enda[np.cumsum(na) - 1]  # of each segment
        links, cuts = np.searchsorted(ends, last, "right"), np.searchsorted(ends[both], last, "right")
        counts[good, 0], counts[good, 1] = na, nb
        counts[good, 2], counts[good, 3] = np.diff(cuts, prepend=0), np.diff(links, prepend=0)
        to_a, to_b = (at_a[both] + 1).tolist(), (at_b[both] + 1).tolist()
        sa, sb = list(map(str, ida.tolist())), list(map(str, idb.tolist()))
        texts = [",".join(sa[i:j]) + "|" + ",".join(sb[k:m]) for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        for i, start, stop in zip(good.tolist(), [0, *cuts.tolist()], cuts.tolist(), strict=False):
            groups[i] = ";".join(texts[start:stop])
        return counts, ida[at_a] << 32 | idb[at_b], groups


def _made(paths) -> Aligner:
    return kept(("aligner", *paths), lambda: Aligner(*paths))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _press(arrays: list[np.ndarray], text: bytes = b"") -> bytes:
    """Unsigned 32-bit numbers, byte by byte so that high ones go together, and a text, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(np.asarray(a).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes) + text)


def _released(body: bytes, sizes: list[int]) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out, raw[at:]


def _packer(paths, limit: int, shards: int):
    """Blocks of documents: the different segments of each, by shard with their codes in the block, and the block itself, texts as codes."""

    def run(batches):
        from pyspark import TaskContext

        cut = _made(paths).cut
        number, codes, ids, texts, size = TaskContext.get().partitionId() << 33, Codes(), [], [], 0

        def flush():
            segments = pa.array(list(codes), pa.string())
            shard = np.fromiter((zlib.crc32(s.encode()) % shards for s in codes), np.int64, len(codes))
            order = pc.sort_indices(segments).to_numpy()
            order = order[np.argsort(shard[order], kind="stable")]
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[k] : edges[k + 1]]
                part = segments.take(pa.array(own))
                offsets = np.frombuffer(part.buffers()[1], np.int32, len(own) + 1)
                body = _press([np.diff(offsets), own], part.buffers()[2].to_pybytes()[: offsets[-1]])
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([k], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([body]), pa.nulls(1, pa.binary())], ["block", "shard", "n", "body", "docs"])
            sizes = np.array([len(t) for t in texts], np.int32)
            docs = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes)], ["doc_id", "size"])
            body = _press([np.concatenate([np.zeros(0, np.int32), *texts])])
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int32()), pa.array([int(sizes.sum())], pa.int32()), pa.array([body]), pa.array([_packed(docs)])], ["block", "shard", "n", "body", "docs"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text"), strict=True):
                text = text.as_py() or ""
                if size and size + len(text) > limit:
                    yield from flush()
                    number, codes, ids, texts, size = number + 1, Codes(), [], [], 0
                found = (m[0] for m in cut.finditer(" " + text)) if len(text) > limit else cut.findall(" " + text)
                texts.append(np.fromiter(map(codes.__getitem__, found), np.int32) if text else np.zeros(0, np.int32))
                ids.append(doc_id)
                size += len(text) + 1
        if ids:
            yield from flush()

    return run


class _Known:
    """Alignments of the segments of a shard."""

    def __init__(self):
        self.at = Codes()
        self.counts, self.links, self.groups = [np.zeros((0, 4), np.int32)], [np.zeros(0, np.int64)], []

    def add(self, segments: list[str], made: Aligner):
        """Place of each segment; new ones are tokenised and aligned."""
        n = len(self.groups)
        place = np.fromiter(map(self.at.__getitem__, segments), np.int64, len(segments))
        fresh = [segments[i] for i in np.flatnonzero(place >= n)]
        for i in range(0, len(fresh), ENCODED):
            counts, links, groups = made.align(fresh[i : i + ENCODED])
            self.counts.append(counts)
            self.links.append(links)
            self.groups += groups
        return place

    def tables(self):
        if len(self.counts) > 64:
            self.counts, self.links = [np.concatenate(self.counts)], [np.concatenate(self.links)]
        return np.concatenate(self.counts), np.concatenate(self.links)


def _answerer(paths):
    """Requests (block, shard, n, body), shard after shard: each different segment is tokenised and aligned once, and each block told."""

    def run(batches):
        made, shard, known, waiting = _made(paths), None, _Known(), []

        def told():
            counts, links = known.tables()
            after = np.cumsum(counts[:, 3])
            for block, codes, place in waiting:
                n = counts[place, 3]
                own = links[_spread(after[place] - n, n)]
                text = "\n".join([known.groups[i] for i in place.tolist()]).encode()
                body = _press([codes, *(counts[place] + 1).T, own >> 32, own & 0xFFFFFFFF], text)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(codes)], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([body])], ["block", "n", "links", "body"])
            waiting.clear()

        held = 0
        for batch in batches:
            for block, own, n, body in zip(*(batch.column(c).to_pylist() for c in ("block", "shard", "n", "body")), strict=True):
                if own != shard or held >= ANSWERED:
                    yield from told()
                    held = 0
                if own != shard or len(known.groups) > REMEMBERED:
                    shard, known = own, _Known()
                (sizes, codes), text = _released(body, [n, n])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                segments = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text)).to_pylist()
                waiting.append((block, codes, known.add(segments, made)))
                held += n
        yield from told()

    return run


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return run[ends] - run[ends - sizes]


def _spread(starts_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of runs of ``sizes`` from ``starts_``, one after another."""
    return np.repeat(starts_ - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _composer(keep: bool):
    """A block's answers and the block: its documents but for what needs the counts of pairs, and in how many of them each pair is."""

    def composed(block: int, rows: list, docs: pa.Table, codes: np.ndarray):
        sizes = docs.column("size").to_numpy().astype(np.int64)
        code = np.concatenate([np.zeros(0, np.int64), *(r[0][0] for r in rows)])
        counts = np.concatenate([np.zeros((0, 4), np.int64), *(np.array(r[0][1:5]).T.astype(np.int64) - 1 for r in rows)])
        links = np.concatenate([np.zeros(0, np.int64), *(r[0][5].astype(np.int64) << 32 | r[0][6] for r in rows)])
        texts = [t for r in rows for t in r[1].decode().split("\n")]
        back = np.argsort(code)  # every code has one answer
        from_ = (np.cumsum(counts[:, 3]) - counts[:, 3])[back]
        counts, texts = counts[back], np.array(texts, object)[back] if len(back) else np.zeros(0, object)
        pairs, pair = np.unique(links, return_inverse=True)
        of_code = pair[_spread(from_, counts[:, 3])].astype(np.int32)
        first = np.cumsum(counts[:, 3]) - counts[:, 3]
        ok = (_sums((counts[:, 0] < 0)[codes], sizes) == 0) & (sizes > 0)
        totals = [np.where(ok, _sums(counts[:, i][codes], sizes), 0) for i in range(4)]
        held, ends = np.zeros(len(pairs), np.int64), np.cumsum(sizes)
        start = 0
        while start < len(sizes):  # some documents at a time, or one that is long
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start] - sizes[start]) + COUNTED, "right")))
            own = np.repeat(np.arange(stop - start), sizes[start:stop])
            seen = np.unique(own[ok[start:stop][own]] << 32 | codes[ends[start] - sizes[start] : ends[stop - 1]][ok[start:stop][own]])
            n = counts[seen & 0xFFFFFFFF, 3]
            who = np.repeat(seen >> 32, n) << 32 | of_code[_spread(first[seen & 0xFFFFFFFF], n)]
            held += np.bincount(np.unique(who) & 0xFFFFFFFF, minlength=len(pairs))
            start = stop
        groups = [";".join(texts[codes[e - n : e]].tolist()) if good else "" for e, n, good in zip(ends.tolist(), sizes.tolist(), ok.tolist(), strict=True)]
        sha = [hashlib.sha256(g.encode()).hexdigest() if good else "" for g, good in zip(groups, ok.tolist(), strict=True)]
        told = pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(ok), *map(pa.array, totals), pa.array(sha), pa.array(groups if keep else [None] * len(groups), pa.string())], ["doc_id", "ok", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"])
        per = pa.RecordBatch.from_arrays([_lists(of_code, counts[:, 3])], ["pairs"])
        on = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), block)), pa.array(pairs[on]), pa.array(held[on]), pa.nulls(len(on), pa.binary()), pa.nulls(len(on), pa.binary()), pa.nulls(len(on), pa.binary())], ["block", "pair", "n", "docs", "segments", "pairs"])
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([_packed(told)]), pa.array([_packed(per)]), pa.array([_packed(pa.RecordBatch.from_arrays([pa.array(pairs)], ["pair"]))])], ["block", "pair", "n", "docs", "segments", "pairs"])

    def run(batches):
        at, rows = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("block", "n", "links", "body", "docs"))
            for block, n, links, body, docs in zip(*columns, strict=True):
                if at != block:
                    at, rows = block, []
                if docs is None:
                    rows.append(_released(body, [n] * 5 + [links] * 2))
                else:
                    yield from composed(block, rows, _unpacked(docs), _released(body, [n])[0][0].astype(np.int64))
                    rows = []

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _finisher(batches):
    """A block's pairs with their counts in the corpus, and the block: its whole documents."""
    at, told, body = None, [], None
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (kinds > 0) | (np.diff(kinds, prepend=0) != 0))
        for start, stop in zip(np.concatenate([[0], edges]).astype(int).tolist(), np.concatenate([edges, [batch.num_rows]]).astype(int).tolist(), strict=True):
            if start == stop:
                continue
            if at != blocks[start]:
                at, told, body = blocks[start], [], None
            if kinds[start] == 0:
                told.append(tuple(batch.column(c).slice(start, stop - start).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")))
            elif kinds[start] == 1:
                body = tuple(batch.column(c)[start].as_py() for c in ("docs", "segments", "pairs"))
            else:
                yield _finished(told, body, *(batch.column(c)[start].as_py() for c in ("docs", "segments", "n")))


def _finished(told: list, body: tuple, own: bytes, codes: bytes, n: int) -> pa.RecordBatch:
    docs, per, pairs = map(_unpacked, body)
    pairs, sizes = pairs.column("pair").to_numpy(), _unpacked(own).column("size").to_numpy().astype(np.int64)
    codes = _released(codes, [n])[0][0].astype(np.int64)
    of_code, n = per.column("pairs").combine_chunks().flatten().to_numpy(), pc.list_value_length(per.column("pairs")).to_numpy()
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for pair, c, b in told:
        at = np.searchsorted(pairs, pair)
        count[at], best[at] = c, b
    ok = docs.column("ok").to_numpy()
    last = [np.where(ok, _sums(_sums(x[of_code], n)[codes], sizes), 0) for x in (best, count)]
    held = lambda *names: [docs.column(c).combine_chunks() for c in names]
    return pa.RecordBatch.from_arrays([*held("doc_id", "n_a", "n_b", "n_groups", "n_links"), *map(pa.array, last), *held("groups_sha256", "groups")], [f.split(" ")[0] for f in _OUT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    A space and the text, encoded by both vocabularies without special tokens, is split at byte
    offsets where tokens of both end into groups ``a1,a2|b1;a3|b2,b3`` (kept if ``keep_groups``,
    else null). Two tokens are linked if their bytes overlap. A pair of ids counts the documents
    that hold it linked; n_best is the number of links whose pair no other pair of the same A id
    outnumbers, count_sum the sum of the counts over all links.

    Texts split before runs of white space where no token of either vocabulary crosses
    (starts()), so segments are encoded as in their text, and no group crosses them. Texts are
    packed into blocks as codes of segments. A block asks for each different segment once; the
    requests of all blocks meet by shard of segments, so each different one is tokenised and
    aligned once (or again after REMEMBERED others of its shard), and its alignment goes back to
    every block that asked. Blocks then compose their documents and ask for the counts of their pairs of ids
    in the same way. No segment and no pair is asked for twice by a block, so none is a hot key.

    Null and empty texts, and those whose bytes one of the vocabularies changes, have no tokens:
    zeros and ''. Rows are documents, repeated ones too; no rows give no rows. The paths are the
    vocabulary files on the executors.
    """
    bound_batches(docs.sparkSession)
    paths = (a_path, b_path)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    # a shard of a block has some hundred segments or more, whatever the size of the corpus
    shards = min(MOST_SHARDS, 4 * parts(docs.sparkSession))
    blocks = save(slim.mapInArrow(_packer(paths, BLOCK_BYTES, shards), "block long, shard int, n int, body binary, docs binary"))
    asked = blocks.filter("docs IS NULL").select("shard", "block", "n", "body").repartition("shard").sortWithinPartitions("shard")
    answers = asked.mapInArrow(_answerer(paths), "block long, n int, links int, body binary")
    bodies = blocks.filter("docs IS NOT NULL").select("block", "n", "body", "docs")
    parted = answers.withColumns({"docs": F.lit(None).cast("binary"), "_last": F.lit(False)}).unionByName(bodies.withColumn("_last", F.lit(True)), allowMissingColumns=True)
    composed = save(parted.repartition("block").sortWithinPartitions("block", "_last").mapInArrow(_composer(keep_groups), "block long, pair long, n long, docs binary, segments binary, pairs binary"))
    pairs = composed.filter("docs IS NULL").select("block", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("_a", F.shiftright("pair", 32))
    most = counts.groupBy("_a").agg(F.max("count").alias("_most"))  # a row for each id of A at most
    stats = counts.join(F.broadcast(most), "_a").select("pair", "count", (F.col("count") == F.col("_most")).cast("int").alias("best"))
    told = pairs.drop("n").join(stats, "pair").withColumn("kind", F.lit(0))
    told = told.unionByName(composed.filter("docs IS NOT NULL").select("block", "docs", "segments", "pairs", F.lit(1).alias("kind")), allowMissingColumns=True)
    told = told.unionByName(bodies.select("block", "n", "docs", F.col("body").alias("segments"), F.lit(2).alias("kind")), allowMissingColumns=True)
    return told.repartition("block").sortWithinPartitions("block", "kind", "pair").mapInArrow(_finisher, _OUT)
