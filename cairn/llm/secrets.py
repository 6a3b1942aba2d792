"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

DataFrame functions only: each text is read once, positions come from the lengths of what lies
between matches, and the tests are expressions over the few tokens that are long enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import save

#: Fixed patterns, as the contract gives them.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")
#: A token that is tested: a whole run of at least 20 characters of the usual encodings.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Symbols of the inferred encodings, in the order of their values.
HEX_SYMBOLS = "0123456789abcdef"
BASE32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64_SYMBOLS = BASE62_SYMBOLS + "+/"
URL_SYMBOLS = BASE62_SYMBOLS + "-_"
#: Under the null hypothesis a token is language or a number: the chance that two of its symbols
#: are equal, and that neighbours are of different classes (upper, lower, digit, other).
LIKE_LANGUAGE, CHANGE = 0.066, 0.10
LIKE_NUMBER = 0.10
FALSE_DISCOVERIES = 0.001
#: Randomness itself must not be rejected at these levels.
NOT_UNIFORM, NOT_SERIAL, NOT_RUNS = 1e-4, 1e-4, 1e-4
#: Lengths from which a new stratum of the false-discovery control begins.
STRATA = (20, 28, 40, 64)
BINS = 300
#: Matches of a text that are placed together.
STEPS = 64


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to one per cent of itself."""
    a = F.abs(z)
    up = F.exp(-a * a / 2) / (a * 1.64 + F.sqrt(a * a * 0.76 + 4.0))
    return F.when(z >= 0, up).otherwise(F.lit(1.0) - up)


def _spans(text: str, matches: str, pattern: str) -> Column:
    """(start, end, s) of all matches in code points, from the matches and what split() leaves between them.

    Matches are worked off by STEPS, each beginning where the lengths of those before add up to,
    so that the array that grows match by match is never long.
    """
    between = F.split(F.col(text), pattern, -1)
    item = "struct<start:int,end:int,s:string>"
    kind = f"struct<pos:int,out:array<{item}>>"
    empty = F.array().cast(f"array<{item}>")

    def step(acc, x):
        at = acc["pos"] + x["b"]
        end = at + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("s")))).alias("out")).cast(kind)

    zipped = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(matches)), F.length).alias("b"), F.col(matches).alias("m"))
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / STEPS).cast("int")), lambda k: F.slice(zipped, k * STEPS + 1, F.lit(STEPS)))
    sized = F.transform(steps, lambda s: F.struct(s.alias("s"), F.aggregate(s, F.lit(0), lambda acc, x: acc + x["b"] + F.length(x["m"])).alias("n")))

    def of(all_):
        before = lambda k: F.aggregate(F.slice(all_, F.lit(1), k), F.lit(0), lambda acc, x: acc + x["n"])
        return F.flatten(F.transform(all_, lambda x, k: F.aggregate(x["s"], F.struct(before(k).alias("pos"), empty.alias("out")).cast(kind), step, lambda acc: acc["out"])))

    # the steps are bound once by a transform over a list of one
    return F.when(F.size(matches) > 0, F.flatten(F.transform(F.array(sized), of))).otherwise(empty)


def _encoded(t: Column) -> Column:
    """The token without padding, and the symbols of its inferred encoding."""
    s = t["s"]
    body = F.regexp_replace(s, "=+$", "")
    symbols = (
        F.when(body.rlike("^[0-9a-f]+$") | body.rlike("^[0-9A-F]+$"), F.lit(HEX_SYMBOLS))
        .when(body.rlike("^[A-Z2-7]+$"), F.lit(BASE32_SYMBOLS))
        .when(body.rlike("^[A-Za-z0-9]+$"), F.lit(BASE62_SYMBOLS))
        .when(body.rlike("^[A-Za-z0-9+/]+$"), F.lit(BASE64_SYMBOLS))
        .otherwise(F.lit(URL_SYMBOLS))
    )
    text = F.when(symbols == HEX_SYMBOLS, F.lower(body)).otherwise(body)
    return F.struct(t["start"].alias("start"), t["end"].alias("end"), text.alias("x"), symbols.alias("a"))


def _measure(t: Column) -> Column:
    """Counts that the tests need."""
    x, a = t["x"], t["a"]
    n, k = F.length(x).cast("double"), F.length(a).cast("double")
    chars = F.split(x, "(?<=.)(?=.)")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(x) - F.length(F.replace(x, c, F.lit("")))).cast("double"), F.lit(2.0)))
    values = F.transform(chars, lambda c: F.position(c, a).cast("double"))
    return F.struct(t["start"].alias("start"), t["end"].alias("end"), n.alias("n"), k.alias("k"), squares.alias("sq"), values.alias("v"), F.regexp_count(x, F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")).cast("double").alias("classes"))


def _judge(t: Column) -> Column:
    """The battery for one token: its significance bin, its stratum and whether randomness holds."""
    n, k, v = t["n"], t["k"], t["v"]
    chi = t["sq"] * k / n - n
    # against uniformity: the cube-root normal form of chi squared
    d = k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / d, F.lit(1 / 3)) - (1 - F.lit(2.0) / (d * 9))) / F.sqrt(F.lit(2.0) / (d * 9))
    high = F.transform(v, lambda x: F.when(x > k / 2, 1.0).otherwise(0.0))
    ups = F.aggregate(high, F.lit(0.0), lambda acc, x: acc + x)
    downs = n - ups
    changes = F.aggregate(F.zip_with(F.slice(high, F.lit(2), F.size(high)), high, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)), F.lit(1.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    expect = ups * downs * 2 / n + 1
    spread = (expect - 1) * (expect - 2) / F.greatest(n - 1, F.lit(1.0))
    z_runs = F.when(spread > 0, (changes - expect) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(99.0))
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    cov = F.aggregate(F.zip_with(F.slice(v, F.lit(2), F.size(v)), v, lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    z_serial = F.when(var > 0, (cov / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    random = (_tail(z_chi) > NOT_UNIFORM) & (_tail(F.abs(z_runs)) * 2 > NOT_RUNS) & (_tail(F.abs(z_serial)) * 2 > NOT_SERIAL)
    # against language and numbers: too even, and of too many changes of class, for its length
    like = F.when(k == len(HEX_SYMBOLS), LIKE_NUMBER).otherwise(LIKE_LANGUAGE)
    extra = n * (k * like - 1)
    z_even = (d + extra - chi) / F.sqrt(d * 2 + extra * 4)
    z_class = (t["classes"] - 1 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))
    z = (z_even + z_class) / math.sqrt(2)
    size = F.floor(F.least(-F.log10(F.greatest(_tail(z), F.lit(1e-40))), F.lit(BINS / 10 - 0.05)) * 10).cast("int")
    stratum = F.lit(0)
    for at in STRATA[1:]:
        stratum = stratum + F.when(n >= at, 1).otherwise(0)
    return F.struct(t["start"].alias("start"), t["end"].alias("end"), F.greatest(size, F.lit(0)).alias("bin"), stratum.alias("stratum"), random.alias("random"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, base, found): for each row the spans (start, kind, end) of fixed patterns and of random tokens.

    Base spans are leftmost matches without overlap of each kind: an assignment whose value has
    six characters or more, an access key, a hex run. Every other token of 20 or more characters
    of an encoding's alphabet is tested. Its encoding is inferred (hex, base32, base62, base64,
    URL-safe base64); chi squared against a uniform alphabet, the runs test about the middle of
    the alphabet and lag-one serial correlation must not reject randomness; and its evenness and
    changes of character class give a p-value against language and numbers, whose null spread
    depends on the length. Within strata of length the Benjamini-Hochberg step-up procedure
    holds the expected share of false discoveries, over the counts of all tokens of all rows
    by significance in steps of a tenth of a decade, so no ranking is gathered anywhere.

    Null texts count as empty; they and texts without secrets have no spans; positions are
    code points; repeated rows are scanned each and count each; no rows give no rows.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    low = F.lower("t")
    none = F.array().cast("array<string>")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    found = t.select(
        "*",
        F.when(named, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(0))).otherwise(none).alias("m_assign"),
        F.when(F.col("t").contains("AKIA"), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0))).otherwise(none).alias("m_access"),
        F.regexp_extract_all("t", F.lit(HEX), F.lit(0)).alias("m_hex"),
        F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("m_token"),
    )
    placed = found.select(
        "doc_id",
        F.filter(_spans("t", "m_assign", ASSIGN), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 6).alias("assign"),
        _spans("t", "m_access", ACCESS).alias("access"),
        _spans("t", "m_hex", HEX).alias("hex"),
        _spans("t", "m_token", TOKEN).alias("token"),
    )
    base = F.concat(_of_kind(F.col("assign"), 0), _of_kind(F.col("access"), 1), _of_kind(F.col("hex"), 2))
    tokens = F.transform(F.col("token"), _encoded)
    rows = placed.select("doc_id", base.alias("base"), tokens.alias("token"))
    fresh = F.filter("token", lambda x: (F.length(x["x"]) >= STRATA[0]) & ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    rows = rows.select("doc_id", "base", F.transform(fresh, _measure).alias("token"))
    rows = save(rows.select("doc_id", "base", F.transform("token", _judge).alias("token")))
    # at most len(STRATA) * BINS rows
    tests = rows.select(F.explode("token").alias("x")).select("x.*").groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("all"), F.count_if("random").alias("random"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = tests.withColumns({"hits": F.sum("random").over(down), "m": F.sum("all").over(Window.partitionBy("stratum"))})
    held = step.filter(F.pow(F.lit(10.0), -F.col("bin") / 10.0) * F.col("m") <= F.col("hits") * F.lit(false_discoveries)).groupBy("stratum").agg(F.min("bin").alias("bin"))
    least = {r["stratum"]: r["bin"] for r in held.collect()}
    levels = F.array(*(F.lit(least.get(i, BINS + 1)) for i in range(len(STRATA))))
    random = F.filter("token", lambda x: x["random"] & (x["bin"] >= F.element_at(levels, x["stratum"] + 1)))
    return rows.select("doc_id", "base", F.concat("base", _of_kind(random, 3)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from scan()'s spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))

