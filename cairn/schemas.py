"""Schemas of the engine's tables, their allowed values, and a guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return _schema(text[7:-1].replace(":", ""))
    return _SIMPLE[text]


def _schema(ddl: str) -> T.StructType:
    """A schema from ``name type, ...`` without a session."""
    fields, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            fields.append(T.StructField(name, _type(kind)))
            start = i + 1
    return T.StructType(fields)


PAGES = _schema("id string, slug string, rel_path string, title string, type string, tags array<string>, role string, frontmatter string, body_hash string, summary string, aliases array<string>, about array<string>, source_fence_line int, body_line int, line_count int, bytes long, created_at timestamp, updated_at timestamp")
DOCUMENTS = _schema("id string, page_id string, rel_path string, mime string, sha256 string, label string, text string, page_count int, group_key string, part int, page_offset int, renders string, extract_via string, confidence double, availability string, missing_since timestamp")
CHUNKS = _schema("id long, page_id string, document_id string, ord int, kind string, heading_path string, text string, line_start int, line_end int, doc_page int")
FACTS = _schema("id string, page_id string, claim string, subject string, attribute string, value string, line_start int, line_end int, source_line_hash string, confidence double, valid_from date, valid_to date, item_id string")
EVENTS = _schema("id string, date string, summary string, target_slug string, source_slug string, line int")
LINKS = _schema("from_page string, to_slug string, to_page string, kind string, line int, broken boolean")
GRAPH_NODES = _schema("id string, kind string, source_id string")
GRAPH_EDGES = _schema("id string, from_node string, to_node string, relation string, predicate string, confidence double, valid_from string, valid_to string")
TEMPORAL = _schema("memory_id string, source_slug string, line int, summary string, kind string, subject string, relation string, temporal_status string, disposition string, precision string, start string, until string, timezone string, mentioned_at string, recurrence struct<frequency: string, interval: int, weekdays: array<string>, until: string>, evidence array<string>, answer_eligible boolean")

#: Allowed values of enumerated columns.
ROLES = ("knowledge", "source", "inference", "ignored")
MODES = ("lookup", "question", "explore")
VIEWS = ("factual", "reports", "planning", "questions", "discussion", "history", "all")
STATUSES = ("ok", "empty", "degraded", "unavailable")
PRECISIONS = ("instant", "day", "month", "year", "unknown")
TEMPORAL_RELATIONS = ("occurred", "scheduled", "due", "valid")
CLOCK_RELATIONS = ("undated", "overdue", "future", "past", "current_period", "today", "ongoing")


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns in order, or an error that names what is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')} is not {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("; ".join(str(w) for w in wrong))
    return df.select(*schema.fieldNames())


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is none of those allowed: the issues of a projection."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
