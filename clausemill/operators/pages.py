"""Pages of documents: splitting, cleaning, running headers and footers, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_ENDS, cleaned_page, is_blank, stripped

#: Lines at a page's head and tail that may be running ones, the share of pages such a line
#: stands on, and its longest length.  Fixed values.
ZONE, SHARE, LONGEST = 3, 0.6, 120


def pages_of(docs: DataFrame, *, separator: str = "\f", text_col: str = "text") -> DataFrame:
    """document_id, page (from 1), text: a row for each part between separators."""
    parts = F.posexplode(F.split(F.col(text_col), separator, -1)).alias("at", "text")
    return docs.select("document_id", parts).select("document_id", (F.col("at") + 1).alias("page"), "text")


def cleaned(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", cleaned_page(F.col("text")))


def lines_of(text: Column) -> Column:
    """A text's lines; a line end at the end opens no further line, an empty text has none."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _zoned(pages: DataFrame) -> DataFrame:
    listed = pages.select("document_id", "page", lines_of(F.col("text")).alias("lines"))
    out = listed.select("document_id", "page", F.size("lines").alias("n"), F.posexplode_outer("lines").alias("at", "line"))
    return out.withColumn("in_zone", (F.col("at") < ZONE) | (F.col("at") >= F.col("n") - ZONE)).withColumn("bare", stripped(F.col("line")))


def running_lines(pages: DataFrame) -> DataFrame:
    """document_id, bare, pages: lines that stand in the head or tail zone of most pages of a document."""
    zone = _zoned(pages).where("in_zone and bare <> ''").where(F.length("bare") <= LONGEST)
    seen = zone.select("document_id", "page", "bare").distinct().groupBy("document_id", "bare").agg(F.count("*").alias("pages"))
    total = pages.groupBy("document_id").agg(F.count("*").alias("total"))
    needed = F.greatest(F.lit(3), F.floor(F.col("total") * SHARE))
    return seen.join(total, "document_id").where((F.col("total") >= 3) & (F.col("pages") >= needed)).select("document_id", "bare", "pages")


def without_running_lines(pages: DataFrame) -> DataFrame:
    """The pages without them; pages of documents that have none stay as they are."""
    running = running_lines(pages)
    touched = running.select("document_id").distinct()
    keyed = _zoned(pages.join(touched, "document_id", "left_semi")).join(running.select("document_id", "bare", F.lit(True).alias("running")), ["document_id", "bare"], "left")
    kept = F.when(~(F.coalesce("running", F.lit(False)) & F.col("in_zone")), F.struct("at", "line"))
    rebuilt = keyed.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(kept)).alias("lines"))
    rebuilt = rebuilt.select("document_id", "page", stripped(F.array_join(F.col("lines.line"), "\n")).alias("text"))
    return rebuilt.unionByName(pages.join(touched, "document_id", "left_anti").select("document_id", "page", "text"))


def rejected_documents(pages: DataFrame) -> DataFrame:
    """document_id, reason of documents none of whose pages has any text."""
    full = pages.groupBy("document_id").agg(F.max(~is_blank(F.col("text"))).alias("any"))
    return full.where(~F.col("any")).select("document_id", F.lit("no_extractable_text").alias("reason"))


def counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("page_count"), F.sum(F.length("text")).alias("total_chars"))


def page_spans(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """document_id, page, start, end: pages given by their starts (char_start) in a document's whole text."""
    order = Window.partitionBy("document_id").orderBy("char_start", "page")
    out = pages.join(docs.select("document_id", F.length("text").alias("total")), "document_id")
    end = F.coalesce(F.lead("char_start").over(order), F.col("total"))
    return out.select("document_id", "page", F.col("char_start").alias("start"), F.greatest(F.col("char_start"), end).alias("end"))


def sliced(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """document_id, page, start, text: the spans' text cut from whole documents."""
    text = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.join(docs.select("document_id", "text"), "document_id").select("document_id", "page", "start", text.alias("text"))
