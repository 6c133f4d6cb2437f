"""Chunks: page slices of bounded size that overlap and know their offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Where paragraphs and sentences end.
_PARAGRAPH_END = re.compile(r"\n\s*\n")
_SENTENCE_END = re.compile(r"(?<=[.;:!?])\s+(?=[A-Z0-9(\"'])")
# End of fixed values.


def _pieces(text: str, size: int) -> Iterator[str]:
    """Paragraphs; longer ones as runs of whole sentences, joined by a space; longer sentences in cuts of size."""
    for paragraph in map(str.strip, _PARAGRAPH_END.split(text)):
        if len(paragraph) <= size:
            if paragraph:
                yield paragraph
            continue
        held = ""
        for sentence in [*_SENTENCE_END.split(paragraph), None]:
            joined = sentence if not held or sentence is None else f"{held} {sentence}".strip()
            if sentence is not None and (not held or len(joined) <= size):
                held = joined
                continue
            for at in range(0, len(held), size):
                yield held[at : at + size]
            held = sentence or ""


def _packed(text: str, size: int) -> list[list[int]]:
    """Spans of successive pieces that together fit size.  A piece that is not found as it is counts from where the last ended."""
    spans: list[list[int]] = []
    end = 0
    for piece in _pieces(text, size):
        start = text.find(piece, end)
        start = end if start < 0 else start
        end = start + len(piece)
        if spans and end - spans[-1][0] <= size:
            spans[-1][1] = end
        else:
            spans.append([start, end])
    return spans


def page_chunks(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(index in page, start, end) of a page's chunks."""
    out = []
    spans = _packed(text, size)
    for k, (start, end) in enumerate(spans):
        if k and overlap:
            # back over the overlap, not to where the span before begins, and on to the next word
            start_at = max(spans[k - 1][0] + 1, start - overlap)
            blank = text.find(" ", start_at, start)
            start = start_at if blank < 0 else blank + 1
        body = text[start:end]
        start, end = start + len(body) - len(body.lstrip()), end - (len(body) - len(body.rstrip()))
        if start < end:
            out.append((k, start, end))
    return out


_SCHEMA = "document_id string, page int, index_in_page int, text string, start_offset int, end_offset int"


def chunked(pages: DataFrame, *, chunk_size: int = 1200, overlap: int = 200) -> DataFrame:
    """pages (document_id, page, text) as chunks; chunk ids count from 0 over a document's pages."""
    if overlap >= chunk_size:
        raise ValueError("overlap must be smaller than chunk_size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, p, k, t[s:e], s, e) for d, p, t in zip(pdf["document_id"], pdf["page"], pdf["text"], strict=True) if t for k, s, e in page_chunks(t, chunk_size, overlap)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")])

    cut = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("int").alias("page"), "text").mapInPandas(run, _SCHEMA)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "index_in_page")) - 1
    return cut.withColumn("chunk_ordinal", number).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("chunk_ordinal").cast("string")))


def with_document_offsets(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """chunks with their offsets in the whole document; pages without a known start count from 0."""
    base = F.coalesce("base", F.lit(0))
    out = chunks.join(spans.select("document_id", "page", F.col("start").alias("base")), ["document_id", "page"], "left")
    return out.withColumn("doc_start_offset", base + F.col("start_offset")).withColumn("doc_end_offset", base + F.col("end_offset")).drop("base")
