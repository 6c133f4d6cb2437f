"""The whole extraction: retrieval, proposals, verification, deadlines, approval."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import query_encoder
from ..operators import ledger, proposals, search
from ..schemas import COMPUTED_ONLY, OBLIGATION_TYPES
from ..sources.staging import staged

# What is searched for each type; the ranking, and so the result, hangs on the words.
QUERIES = {
    "contract_start_date": "effective date commencement date this agreement commences begins term start",
    "contract_end_date": "initial term expires expiration end of term shall continue until termination date",
    "automatic_renewal": "automatically renew automatic renewal successive renewal terms unless terminated",
    "renewal_duration": "renewal term successive periods of twelve months renew for additional term",
    "termination_notice_period": "written notice of termination prior written notice days notice to terminate non-renewal",
    "notice_deadline": "notice must be given no later than deadline to provide notice of non-renewal",
    "renewal_option_notice": "option to renew shall be exercised by providing written notice given not less than days prior to the termination date lapse and expire",
    "renewal_option_deadline": "last day to exercise the option to renew before it lapses",
    "payment_obligation": "fees payable payment terms invoice net days annual fee amount due customer shall pay",
    "fee_escalation": "fees increase annually escalation percent uplift price adjustment CPI",
    "indemnification": "indemnify defend hold harmless third party claims indemnification",
    "liability_cap": "limitation of liability aggregate liability shall not exceed cap damages",
    "governing_law": "governed by the laws of jurisdiction venue exclusive courts governing law",
}
# End of fixed values.


@dataclass(frozen=True)
class Extraction:
    obligations: DataFrame
    failures: DataFrame
    approvals: DataFrame


def context_of(chunks: DataFrame, types: list[str], settings: Settings) -> DataFrame:
    """The chunks that a proposer reads: the best of one search for each type, in one pass over documents.

    Chunks with vectors (embedding) are searched by them too, if settings name an encoder.
    """
    asked, vectors = [QUERIES.get(t, t.replace("_", " ")) for t in types], None
    make = query_encoder(settings) if "embedding" in chunks.columns else None
    if make is not None:
        rows = chunks.sparkSession.createDataFrame(list(enumerate(asked)), "k int, query string").select("k", make(F.col("query")).alias("v")).collect()  # a row for each type
        vectors = [list(r["v"]) for r in sorted(rows)]
    return search.document_contexts(
        chunks.withColumn("ordinal", F.col("chunk_ordinal")), asked, vectors=vectors, top_k=settings.default_top_k, pool=settings.candidate_pool, rrf_k=settings.rrf_k, most=settings.max_context_chunks,
    )


def extracted(chunks: DataFrame, pages: DataFrame, *, types: list[str] | None = None, settings: Settings | None = None, proposer: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> Extraction:
    """Obligations, failures and approvals of all documents of chunks and pages.

    proposer(context, types) gives proposals; without one, rules propose.
    """
    settings, requested = settings or Settings(), list(types or OBLIGATION_TYPES)
    askable = [t for t in requested if t not in COMPUTED_ONLY]
    read = staged(context_of(chunks, askable or requested, settings), "context")
    offered = staged((proposer or proposals.proposed)(read, askable), "proposals")
    kept, failures = ledger.sorted_out(offered.where("obligation_type is not null"), requested)
    down = offered.where("obligation_type is null").select("document_id", F.lit(None).cast("string").alias("obligation_type"), F.lit("llm_unavailable").alias("reason"), F.col("quote").alias("detail"))
    found = staged(ledger.candidates(kept, pages, chunks, settings), "candidates")
    answered = read.select("document_id").distinct().join(down.select("document_id"), "document_id", "left_anti")
    computed, more = ledger.derived(found, requested, answered)
    everything = found.unionByName(computed)
    documents = pages.select("document_id").distinct()
    silent = documents.join(read.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(None).cast("string").alias("obligation_type"), F.lit("no_context_retrieved").alias("reason"), F.lit("retrieval returned nothing").alias("detail"))
    failures = failures.unionByName(more).unionByName(silent).unionByName(down)
    return Extraction(everything, failures, ledger.approvals(everything, documents))
