"""Queries over chunks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.registry import query
from cairn.sources.markdown import document_chunks
from cairn.sources.tables import read


@query("chunk_lines", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS ord, length(t)::INT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS o FROM documents) WHERE trim(t) <> ''")
def chunk_lines(spark, sf_dir):
    """The simple splitter: every line that is not blank."""
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(lines).alias("ord", "t")).select("doc_id", "ord", F.length("t").alias("n"))


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    """The full document chunker."""
    c = document_chunks(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return c.select("doc_id", "ord", "page", F.length("text").alias("n"), F.sha2("text", 256).alias("sha256"))
