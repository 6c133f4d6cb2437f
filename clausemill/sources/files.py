"""Files as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators import pages as P

TEXT_SUFFIXES, PDF_SUFFIXES = ("txt", "md", "text"), ("pdf",)


def files(spark: SparkSession, path: str) -> DataFrame:
    """document_id (by content), filename, path, suffix, content, sha256, reason: reason is why a file is rejected, or null.

    Spark lists no files of zero bytes, so they do not appear.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classified(raw.select("path", "content"))


def classified(raw: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    is_text = suffix.isin(*TEXT_SUFFIXES)
    reason = (
        F.when(~suffix.isin(*TEXT_SUFFIXES, *PDF_SUFFIXES), F.concat(F.lit("unsupported_file_type: "), F.when(suffix == "", "(none)").otherwise(F.concat(F.lit("."), suffix))))
        .when(F.length("content") == 0, "empty_file")
        .when(is_text & ~F.is_valid_utf8(F.col("content").cast("string")), "not_valid_utf8")
        .when(suffix.isin(*PDF_SUFFIXES) & (F.substring("content", 1, 1024).cast("string").contains("%PDF-") == F.lit(False)), "not_a_pdf")
    )
    return raw.select(content_id(F.col("content")).alias("document_id"), name.alias("filename"), "path", suffix.alias("suffix"), "content", F.sha2("content", 256).alias("sha256"), reason.alias("reason"))


def _accepted(found: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    return found.where("reason is null").where(F.col("suffix").isin(*suffixes)).dropDuplicates(["document_id"])


def _finished(pages: DataFrame, strip_furniture: bool) -> DataFrame:
    out = P.cleaned(pages)
    return P.without_running_lines(out) if strip_furniture else out


def text_pages(found: DataFrame, *, strip_furniture: bool = True) -> DataFrame:
    """document_id, page, text of the text files: pages end at form feeds; cleaned, running lines out."""
    texts = _accepted(found, TEXT_SUFFIXES).select("document_id", F.col("content").cast("string").alias("text"))
    return _finished(P.pages_of(texts), strip_furniture)


def raw_pdf_pages(found: DataFrame) -> DataFrame:
    """document_id, page, text, error of the PDF files; a file that cannot be read has one row, with error."""

    def run(batches):
        import pandas as pd

        from .pdf import page_texts

        for pdf in batches:
            rows = []
            for d, c in zip(pdf["document_id"], pdf["content"], strict=True):
                try:
                    rows += [(d, k, t, None) for k, t in enumerate(page_texts(c), 1)] or [(d, 1, "", None)]
                except Exception as e:  # a file's faults must not end the job
                    rows.append((d, None, None, f"unreadable_pdf: {e}"))
            out = pd.DataFrame(rows, columns=["document_id", "page", "text", "error"])
            out["page"] = out["page"].astype("Int32")
            yield out

    return _accepted(found, PDF_SUFFIXES).select("document_id", "content").mapInPandas(run, "document_id string, page int, text string, error string")


def pdf_pages(raw: DataFrame, *, strip_furniture: bool = True) -> DataFrame:
    """document_id, page, text of raw_pdf_pages(): cleaned, running lines out."""
    return _finished(raw.where("error is null").select("document_id", "page", "text"), strip_furniture)


def rejects(found: DataFrame, pages: DataFrame, raw_pdf: DataFrame | None = None) -> DataFrame:
    """filename, reason of files that were not taken, unreadable ones included."""
    named = found.select("document_id", "filename")
    bad = found.where("reason is not null").select("filename", "reason")
    blank = P.rejected_documents(pages).join(named, "document_id").select("filename", "reason")
    out = bad.unionByName(blank)
    if raw_pdf is not None:
        out = out.unionByName(raw_pdf.where("error is not null").select("document_id", F.col("error").alias("reason")).join(named, "document_id").select("filename", "reason"))
    return out
