"""One object for what a service would offer: ingest, list, search, extract, verify, compute."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.dates import deadline
from .functions.values import contract_number
from .functions.vectors import encoder, query_encoder
from .operators import chunks as C
from .operators import evidence, ledger, pages, proposals, search
from .plans.extraction import Extraction, extracted
from .schemas import DEADLINE_OPERATIONS
from .sources import files
from .sources.staging import staged
from .sources.store import Store

HYBRID, LEXICAL = "hybrid_bm25_vector_rrf", "bm25_only"
_PASSAGES = "query_id string, rank int, contract_id long, page int, char_start int, char_end int, text string, score double"
_log = logging.getLogger(__name__)


def _checked(rows: DataFrame, wrong: Column, message: str) -> None:
    if not rows.where(F.coalesce(wrong, F.lit(False))).isEmpty():
        raise ValueError(message)


class Engine:
    """Works on whole tables; a point lookup is a filter on its results.

    An index is built at the first search and kept until a document changes.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, Store(spark, path), settings or Settings.from_environment()
        self._indexes: dict[bool, search.Index] = {}

    def status(self) -> dict:
        return {"documents": self.store.count(), "retrieval": self.retrieval_mode(), "proposer": "rules" if self.settings.use_fake_llm else self.settings.llm_model}

    def retrieval_mode(self) -> str:
        """Vectors count only if there is an encoder and every chunk has one: else some of the corpus would rank at zero."""
        return HYBRID if encoder(self.settings) and self._all_have_vectors() else LEXICAL

    def _all_have_vectors(self) -> bool:
        key = ["document_id", "chunk_id"]
        have = self.store.read("vectors").where("embedding is not null").select(*key)
        return self.store.read("chunks").select(*key).join(have, key, "left_anti").isEmpty()

    def ingest(self, path: str) -> DataFrame:
        """Takes in the text and PDF files under path; gives filename, reason of those rejected."""
        return self.take(files.files(self.spark, path))

    def take(self, found: DataFrame) -> DataFrame:
        """Takes in classified files; gives filename, reason of those rejected."""
        found = staged(found, "files")
        pdf, strip = staged(files.raw_pdf_pages(found), "pdf"), self.settings.strip_page_furniture
        text = staged(files.text_pages(found, strip_furniture=strip).unionByName(files.pdf_pages(pdf, strip_furniture=strip)), "pages")
        readable = text.join(pages.rejected_documents(text), "document_id", "left_anti")
        meta = found.where("reason is null").dropDuplicates(["document_id"]).select("document_id", "filename", "sha256", F.col("path").alias("stored_path"), F.current_timestamp().alias("uploaded_at"))
        self.put(meta, readable)
        return files.rejects(found, text, pdf)

    def put(self, documents: DataFrame, page_texts: DataFrame, spans: DataFrame | None = None) -> None:
        """Documents and their pages in place of what was stored under their ids, obligations and vectors included.

        spans (document_id, page, start) place pages in whole texts.  The row of
        documents is written last: it is there only if all else is.
        """
        page_texts = staged(page_texts, "pages")
        keys = page_texts.select("document_id").distinct()
        cut = C.chunked(page_texts, chunk_size=self.settings.chunk_size_chars, overlap=self.settings.chunk_overlap_chars)
        cut = staged(C.with_document_offsets(cut, spans) if spans is not None else cut, "chunks")
        n = page_texts.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count")).join(cut.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count")), "document_id", "left")
        self._indexes.clear()
        self.store.delete(keys, "obligations", "vectors")
        if make := encoder(self.settings):
            self.store.put("vectors", cut.select("document_id", "chunk_id", make(F.col("text")).alias("embedding")), keys)
        self.store.put("doc_pages", page_texts, keys)
        self.store.put("chunks", cut, keys)
        self.store.put("documents", documents.join(n.fillna(0), "document_id"), keys)

    def put_whole(self, docs: DataFrame, starts: DataFrame, *, suffix: str = "txt") -> None:
        """Documents given as one text (document_id, text) with page starts (document_id, page, char_start); nothing is cleaned."""
        spans = staged(pages.page_spans(starts, docs), "spans")
        texts = pages.sliced(spans, docs).select("document_id", "page", "text")
        self.put(docs.select("document_id", F.concat(F.lit("contract_"), "document_id", F.lit(f".{suffix}")).alias("filename"), F.current_timestamp().alias("uploaded_at")), texts, spans)

    def documents(self) -> DataFrame:
        return self.store.documents()

    def pages(self, document_id: str) -> DataFrame:
        return self.store.of_document("doc_pages", document_id)

    def delete(self, ids: DataFrame) -> None:
        self._indexes.clear()
        self.store.delete(ids)

    def _chunks(self) -> DataFrame:
        rows = self.store.read("chunks").withColumn("chunk_ordinal", F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int"))
        if self.retrieval_mode() == HYBRID:
            rows = rows.join(self.store.read("vectors"), ["document_id", "chunk_id"], "left")
        return rows

    def _index(self, corpus: bool) -> search.Index:
        if corpus not in self._indexes:
            # the kept index must not read tables that a later change rewrites
            self._indexes[corpus] = search.built(staged(self._chunks().withColumn("ordinal", F.col("chunk_ordinal")), "indexed"), corpus=corpus)
        return self._indexes[corpus]

    def search(self, queries: DataFrame, *, top_k: int = 5, corpus: bool = True) -> DataFrame:
        """queries: query_id, query, and document_id where corpus is false.  Hits have retrieval_mode."""
        _checked(queries, F.length(F.coalesce("query", F.lit(""))) < 1, "query must not be empty")
        index, make = self._index(corpus), query_encoder(self.settings)
        hybrid = "embedding" in index.chunks.columns
        asked = queries.withColumn("vector", make(F.col("query"))) if make and hybrid else queries
        hits = search.search(index, asked, top_k=top_k, pool=self.settings.candidate_pool, rrf_k=self.settings.rrf_k)
        return hits.withColumn("retrieval_mode", F.lit(HYBRID if hybrid else LEXICAL))

    def passages(self, queries: DataFrame, *, k: int = 8) -> DataFrame:
        """query_id, rank, contract_id, page, char_start, char_end, text, score of the best passages of numbered documents.

        queries: query_id, query, and document_id if each is to be asked of one
        document.  Documents without a number are left out after the best k are
        found, so there may be fewer.  Never raises: what fails gives no rows.
        """
        try:
            hits = self.search(queries, top_k=k, corpus="document_id" not in queries.columns)
            out = hits.select(F.col("query_id").cast("string").alias("query_id"), "rank", contract_number(F.col("document_id")).alias("contract_id"), "page", "char_start", "char_end", "text", F.col("fused_score").alias("score"))
            return staged(out.where("contract_id is not null"), "passages")
        except Exception:
            _log.exception("search for passages failed")
            return self.spark.createDataFrame([], _PASSAGES)

    def extract(self, *, types: list[str] | None = None, proposer=None, documents: DataFrame | None = None) -> Extraction:
        """Obligations of all documents, or of those given, stored in place of their earlier ones."""
        if proposer is None and not self.settings.use_fake_llm:
            answer = proposals.chat_answer(self.settings)
            proposer = lambda context, kinds: proposals.proposed_by(context, answer, kinds)
        held, texts, keys = self._chunks(), self.store.read("doc_pages"), self.store.read("documents").select("document_id")
        if documents is not None:
            keys = documents.select("document_id").distinct()
            held, texts = held.join(keys, "document_id", "left_semi"), texts.join(keys, "document_id", "left_semi")
        out = extracted(held, texts, types=types, settings=self.settings, proposer=proposer)
        out = Extraction(staged(out.obligations, "obligations"), out.failures, out.approvals)
        self.store.put("obligations", out.obligations, keys)
        return out

    def extract_whole(self, docs: DataFrame, starts: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
        """Obligations in the caller's terms, and the verdicts, of documents given as put_whole() takes them.

        The first table has contract_id, field, value, status, quote, page,
        char_start, char_end (in the whole text), reason, formula, inputs; the
        second contract_id, can_approve, failures (texts).  Documents that are not
        stored are taken in first.  Never raises: what fails gives no obligations,
        and a failure extraction_crashed for each document.
        """
        number = contract_number(F.col("document_id")).alias("contract_id")
        try:
            stored = self.store.read("documents").select("document_id")
            fresh = staged(docs.join(stored, "document_id", "left_anti"), "fresh")
            if not fresh.isEmpty():
                self.put_whole(fresh, starts.join(fresh.select("document_id"), "document_id", "left_semi"))
            asked = docs.select("document_id").distinct()
            out = self.extract(documents=asked, **options)
            base = pages.page_spans(starts, docs).select("document_id", "page", F.col("start").alias("base"))
            rows = out.obligations.join(base, ["document_id", "page"], "left")
            place = lambda c: F.coalesce("base", F.lit(0)) + F.col(c)
            obligations = staged(rows.select(
                number, F.col("obligation_type").alias("field"), F.col("normalized_value").alias("value"), "status", "quote", "page", place("start_offset").alias("char_start"), place("end_offset").alias("char_end"),
                F.col("verification_reason").alias("reason"), F.col("computation_formula").alias("formula"), F.col("computation_inputs").alias("inputs"),
            ), "caller")
            said = out.failures.groupBy("document_id").agg(F.sort_array(F.collect_list(ledger.failure_text(F.col("reason"), F.col("detail")))).alias("failures"))
            verdicts = asked.join(out.approvals, "document_id", "left").join(said, "document_id", "left")
            verdicts = verdicts.select(number, F.coalesce("can_approve", F.lit(False)).alias("can_approve"), F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))
            return obligations, staged(verdicts, "verdicts")
        except Exception:
            _log.exception("extraction failed")
            none = self.spark.createDataFrame([], "contract_id long, field string, value string, status string, quote string, page int, char_start int, char_end int, reason string, formula string, inputs string")
            return none, docs.select(number, F.lit(False).alias("can_approve"), F.array(F.lit("extraction_crashed")).alias("failures")).distinct()

    def obligations(self, document_id: str | None = None) -> DataFrame:
        """Stored obligations in their order: quote null where it is empty, inputs as a value of JSON."""
        rows = self.store.read("obligations", document_id)
        return rows.withColumn("quote", F.when(F.col("quote") != "", F.col("quote"))).withColumn("computation_inputs", F.try_parse_json("computation_inputs")).orderBy("document_id", "ordinal")

    def last_extraction(self) -> DataFrame:
        """document_id, n_obligations, can_approve of every document, from its stored obligations."""
        return ledger.approvals(self.store.read("obligations"), self.store.read("documents"))

    def verify(self, quotes: DataFrame) -> DataFrame:
        """quotes: document_id, ordinal, quote, page (may be null)."""
        _checked(quotes, (F.length(F.coalesce("quote", F.lit(""))) < 1) | (F.col("page") < 1), "quote must not be empty, page must be 1 or more")
        return evidence.verified(quotes.withColumn("value", F.lit(None).cast("string")), self.store.read("doc_pages"), self.settings).drop("value")

    @staticmethod
    def deadlines(rows: DataFrame) -> DataFrame:
        """rows: operation, anchor, period; with computation (result, formula, error, inputs as JSON)."""
        out = F.lit(None).cast("struct<result:date,formula:string,error:string,inputs:string>")
        for operation in DEADLINE_OPERATIONS:
            c = deadline(operation, F.col("anchor"), F.col("period"))
            out = F.when(F.col("operation") == operation, F.struct(c["result"].alias("result"), c["formula"].alias("formula"), c["error"].alias("error"), F.to_json(c["inputs"]).alias("inputs"))).otherwise(out)
        return rows.withColumn("computation", out)
