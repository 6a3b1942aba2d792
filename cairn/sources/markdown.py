"""A folder of Markdown pages and attachments as tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import markdown as M

SCAN = "path string, rel_path string, kind string, size long, modified timestamp, sha256 string, content binary"
PAGE = "slug string, rel_path string, title string, type string, role string, tags array<string>, body_hash string, body_line int, source_fence_line int, line_count int, quarantined boolean, text string"
CHUNK = "slug string, ord int, kind string, heading_path string, text string, line_start int, line_end int"
EVENT = "slug string, date string, summary string, target_slug string, line int"


def below(root: str) -> Column:
    """The part of a file's path below root."""
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/") + "/"
    return F.substring("path", F.locate(base, F.col("path")) + len(base), F.length("path"))


def scan(spark: SparkSession, root: str, largest: int = 16_000_000) -> DataFrame:
    """Files below root: pages (.md) and attachments, without dot files and pages over a size, with content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select("path", below(root).alias("rel_path"), F.when(F.lower("path").endswith(".md"), "page").otherwise("attachment").alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")
    return out.filter(~F.col("rel_path").rlike(r"(^|/)\.") & ((F.col("kind") != "page") | (F.col("size") <= largest)))


def _rows(fn):
    def run(batches):
        for b in batches:
            yield fn(b)

    return run


def pages(files: DataFrame) -> DataFrame:
    """Parsed pages; one with a merge conflict inside is quarantined."""

    def parse(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rel, content in zip(b["rel_path"], b["content"], strict=True):
            text = bytes(content).decode("utf-8", "replace")
            p = M.parse_page(rel, text)
            tags = p.fields.get("tags") or []
            out.append((p.slug, rel, p.title, p.fields.get("type"), p.fields.get("role") or "knowledge", tags if isinstance(tags, list) else [tags], p.body_hash, p.body_line, p.source_fence_line, len(p.lines), M.merge_conflict(text), text))
        cols = [f.split()[0] for f in PAGE.split(", ")]
        made = pd.DataFrame(out, columns=cols)
        made["source_fence_line"] = made["source_fence_line"].astype("Int32")
        return made

    return files.filter("kind = 'page'").select("rel_path", "content").mapInPandas(_rows(parse), PAGE)


def chunks(parsed: DataFrame) -> DataFrame:
    """Chunks of pages that are not quarantined."""

    def one(b: pd.DataFrame) -> pd.DataFrame:
        out = [(slug, *c) for rel, slug, text in zip(b["rel_path"], b["slug"], b["text"], strict=True) for c in M.chunk_page(M.parse_page(rel, text))]
        return pd.DataFrame(out, columns=[f.split()[0] for f in CHUNK.split(", ")])

    return parsed.filter("NOT quarantined").select("rel_path", "slug", "text").mapInPandas(_rows(one), CHUNK)


def events(parsed: DataFrame) -> DataFrame:
    def one(b: pd.DataFrame) -> pd.DataFrame:
        out = [(slug, d, s, t, n) for rel, slug, text in zip(b["rel_path"], b["slug"], b["text"], strict=True) for d, s, t, n in M.parse_page(rel, text).events]
        return pd.DataFrame(out, columns=[f.split()[0] for f in EVENT.split(", ")])

    return parsed.select("rel_path", "slug", "text").mapInPandas(_rows(one), EVENT)


def document_chunks(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, page, text) of extracted document texts."""
    kind = documents.schema[key].dataType.simpleString()

    def one(b: pd.DataFrame) -> pd.DataFrame:
        out = [(k, *c) for k, t in zip(b[key], b[text], strict=True) for c in M.chunk_document(t or "")]
        return pd.DataFrame(out, columns=[key, "ord", "page", "text"])

    return documents.select(key, text).mapInPandas(_rows(one), f"{key} {kind}, ord int, page int, text string")
