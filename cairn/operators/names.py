"""Entity names inside texts, by automata that every task holds a bounded part of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of names in one automaton, which a task holds; more names make more automata, one pass each.
SHARD = 16 << 20
#: Shorter names are not looked for.
LEAST = 3


def plain(text: str | None) -> str:
    """Text for comparison of names: NFKC, lower case, runs of what is no letter or digit as one space."""
    import unicodedata

    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", unicodedata.normalize("NFKC", text or "").lower()).strip()


def normalized(names: DataFrame, name: str = "name") -> DataFrame:
    """(normalized, name) of the names, the least name of each normal form; empty ones go."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([plain(x) for x in b.column(0).to_pylist()], pa.string()), b.column(0)], ["normalized", "name"])

    rows = names.select(F.col(name).cast("string").alias("name")).filter("name IS NOT NULL").mapInArrow(run, "normalized string, name string")
    return rows.filter("normalized <> ''").groupBy("normalized").agg(F.min("name").alias("name"))


def longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of (start, end, name) those that stay: longer names first, each at its first free place, none over another; in order of place."""
    taken: list[tuple[int, int]] = []
    held: set[str] = set()
    out = []
    for start, end, name in sorted(found, key=lambda x: (x[0] - x[1], x[2], x[0])):
        if name not in held and all(end <= s or start >= e for s, e in taken):
            held.add(name)
            taken.append((start, end))
            out.append((start, end, name))
    return sorted(out)


def _finder(shared, resolve: bool):
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        tree = ahocorasick.Automaton()
        for name in shared.value:
            tree.add_word(f" {name} ", name)
        if shared.value:
            tree.make_automaton()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                # a name stands between spaces, so its end is that of the space behind it
                found = [(end - len(name) - 1, end - 1, name) for end, name in tree.iter(f" {plain(text)} ")] if shared.value and text else []
                found = longest(found) if resolve else sorted(found)
                at += [i] * len(found)
                rows += found
            start, end, name = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string())], [batch.schema.names[0], "start", "end", "normalized"])

    return run


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, every: bool = False, shard: int = SHARD, least: int = LEAST) -> DataFrame:
    """(key, start, end, normalized, name) of the names (normalized, name) that texts hold as whole words.

    Longer names come first, each once and none over another; with ``every``, all places of all
    names. Places count characters of the normal form of the text, the end exclusive. Names of
    under ``least`` characters are not looked for; null texts hold none; rows are texts of their
    own, and so repeated keys repeat theirs.

    The names go to every task as an automaton, if they have at most ``shard`` characters; else
    they are dealt into as many automata as that takes, with one pass over the texts each, and the
    places of a text, which are at most its own characters, meet again to be resolved. No text
    meets names by words that both have.
    """
    usable = names.filter(F.length("normalized") >= least).select("normalized", "name")
    size = usable.agg(F.sum(F.length("normalized") + 2)).first()[0] or 0
    n = max(1, -(-int(size) // shard))
    kind = texts.schema[key].dataType.simpleString()
    slim = texts.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    if n > 1:
        slim = slim.select(F.struct("_key", F.monotonically_increasing_id().alias("_row")).alias("_key"), "_text")
    own = slim.schema["_key"].dataType.simpleString()
    found = None
    for i in range(n):
        part = [r["normalized"] for r in usable.filter(F.pmod(F.xxhash64("normalized"), F.lit(n)) == i).select("normalized").toLocalIterator()]  # about ``shard`` characters
        rows = slim.mapInArrow(_finder(texts.sparkSession.sparkContext.broadcast(part), n == 1 and not every), f"_key {own}, start int, end int, normalized string")
        found = rows if found is None else found.unionByName(rows)
    if n > 1 and not every:

        def resolve(batches):
            import pyarrow as pa

            for b in batches:
                at, rows = [], []
                for i, cell in enumerate(b.column(1).to_pylist()):
                    kept = longest([(r["start"], r["end"], r["normalized"]) for r in cell])
                    at += [i] * len(kept)
                    rows += kept
                start, end, name = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string())], ["_key", "start", "end", "normalized"])

        found = found.groupBy("_key").agg(F.collect_list(F.struct("start", "end", "normalized")).alias("_all")).mapInArrow(resolve, f"_key {own}, start int, end int, normalized string")
    k = F.col("_key._key") if n > 1 else F.col("_key")
    return found.select(k.cast(kind).alias(key), "start", "end", "normalized").join(usable, "normalized")


def only_name(subjects: DataFrame, key: str, subject: str, names: DataFrame) -> DataFrame:
    """(key, name): subjects that hold exactly one of the names, in whole words, wherever and however often."""
    return mentions(subjects, key, subject, names, every=True).groupBy(key).agg(F.min("name").alias("name"), F.count_distinct("normalized").alias("_n")).filter("_n = 1").drop("_n")
