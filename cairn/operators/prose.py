"""What kind of discourse a line of prose is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word families, tried in this order.
FAMILIES = (
    ("discussion", r"(?i)\b(?:if|suppose|assuming|hypothetical|counterfactual|what if|would have)\b|(?:^|[^\p{L}])(?:если|предположим|допустим|гипотез\p{L}*|гипотетическ\p{L}*|контрфактическ\p{L}*)(?:$|[^\p{L}])"),
    ("history", r"(?i)\b(?:rejected|cancelled|canceled|not decided|not accepted|did not choose)\b|(?:отклон\p{L}*|отмен\p{L}*|не решено|не выбрал\p{L}*|решение не принято)"),
    ("discussion", r"(?i)\b(?:might|maybe|perhaps|possibly|probably|suspect|uncertain|tentative|would|could)\b|(?:^|[^\p{L}])(?:возможно|вероятно|может быть|подозрева\p{L}*|не уверен\p{L}*)(?:$|[^\p{L}])"),
    ("reports", r"(?i)^\s*(?:[-*]\s*)?(?:\*\*)?(?:user|assistant|system|external|пользователь|ассистент|система)(?:\*\*)?\s*:"),
    ("reports", r"(?i)\b(?:said|says|reported|reports|according to|quoted|quotation)\b|(?:^|[^\p{L}])(?:сказал\p{L}*|сообщил\p{L}*|по словам|цитат\p{L}*)(?:$|[^\p{L}])"),
    ("reports", r"^\s*[>\"“«]"),
    ("planning", r"(?i)\b(?:plan(?:s|ned|ning)? to|propos(?:e|ed|al)|intend(?:s)? to)\b|(?:планиру\p{L}*|намерева\p{L}*|предлага\p{L}*)"),
    ("planning", r"^\s*[-*]\s*\[ \]"),
    ("questions", r"\?\s*$"),
)


def classify_line(line: Column) -> Column:
    """The view a line belongs to: of the first family that matches, else factual."""
    out = None
    for view, pattern in FAMILIES:
        on = line.rlike(pattern)
        out = F.when(on, view) if out is None else out.when(on, view)
    return out.otherwise("factual")


def prose_eligible(view: Column, wanted: str) -> Column:
    """Whether a line of a view answers a wanted view; all takes everything."""
    return F.lit(True) if wanted == "all" else view == wanted


#: Lines, about, that the rows of pages are handed on together by.
TOGETHER = 4096


def discourse(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, status, view, reason, frame, source_hash) of each line that says something, by functions.discourse.scopes().

    A header between --- lines is skipped. ``frame`` has the lines whose words decide the view,
    none for a factual one; where they are too many the status is unresolved. Null texts have no
    rows. Pages are read whole, one after another, in Arrow batches of bounded size; no page
    meets another, so nothing is shuffled.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        from cairn.functions.discourse import scopes
        from cairn.functions.markdown import front_matter

        names = [key, "line", "status", "view", "reason", "frame", "source_hash"]
        types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            at: list[int] = []
            held: list[list] = [[] for _ in types]

            def made(batch, at, held):
                own = batch.column(0).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(held, types, strict=True))], names)

            for i, page in enumerate(batch.column(1)):
                if (body := page.as_py()) is None:
                    continue
                if not (rows := scopes(body, front_matter(body)[1])):
                    continue
                sha = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()
                at += [i] * len(rows)
                for c, more in zip(held, [*zip(*rows, strict=True), [sha] * len(rows)], strict=True):
                    c.extend(more)
                if len(at) >= TOGETHER:
                    yield made(batch, at, held)
                    at, held = [], [[] for _ in types]
            if at:
                yield made(batch, at, held)

    return pages.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, line int, status string, view string, reason string, frame array<int>, source_hash string")


def answers(status: Column, view: Column, wanted: str) -> Column:
    """Whether a line of discourse() answers a view: what is qualified and factual any, what is qualified its own, and all takes everything."""
    if wanted == "all":
        return F.lit(True)
    return (status == "qualified") & view.isin("factual", wanted)


#: Lines that a card leaves out: headings and comments, and embeds that stand alone.
BARE_LINE = r"^\s*(#{1,6}\s+\S|<!--)"
EMBED_LINE = r"^\s*(!\[\[[^\]]+\]\]|!\[[^\]]*\]\([^)]+\))\s*$"


def card_line(line: Column) -> Column:
    """Whether a line may stand on a card: not blank, no heading, comment or lone embed."""
    return line.rlike(r"\S") & ~line.rlike(BARE_LINE) & ~line.rlike(EMBED_LINE)


def line_selected(selection: str, view: str) -> Column:
    """Whether a line belongs to the eligible or the contextual selection of a view.

    Reads has_memory, hold, status and memory_eligible of the line's memory, and prose_reason
    (null: no prose) and prose_eligible of its prose. A pending correction is always shown;
    headings and comments only in the view all; a plain line is eligible.
    """
    wanted = lambda on: on if selection == "eligible" else ~on
    prose = F.when(F.col("prose_reason").isin("heading", "comment"), F.lit(view == "all")).otherwise(wanted(F.coalesce("prose_eligible", F.lit(False))))
    memory = F.when(F.col("status") != "qualified", F.lit(selection == "contextual")).otherwise(wanted(F.coalesce("memory_eligible", F.lit(False))))
    by_memory = F.when(F.coalesce(F.col("hold") == "pending_correction", F.lit(False)), F.lit(True)).otherwise(memory)
    return F.when(F.col("has_memory"), by_memory).when(F.col("prose_reason").isNotNull(), prose).otherwise(F.lit(selection == "eligible"))


def prose_chunks(chunks: DataFrame, entries: DataFrame, view: str) -> DataFrame:
    """(id, eligible) of chunks (id, page, start, end) that hold prose entries (page, line, view, eligible).

    A chunk is eligible if one of its entries is, and is factual or of the wanted view; the view
    all takes any. Joined on the page, where the lines then decide.
    """
    e = entries.select("page", "line", F.coalesce(F.col("eligible") & (F.lit(view == "all") | F.col("view").isin("factual", view)), F.lit(False)).alias("_on"))
    return chunks.join(e, "page").filter(F.col("line").between(F.col("start"), F.col("end"))).groupBy("id").agg(F.bool_or("_on").alias("eligible"))
