"""Vocabularies and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Names that users' data and answers hold.
OBLIGATION_TYPES = (
    "contract_start_date",
    "contract_end_date",
    "automatic_renewal",
    "renewal_duration",
    "termination_notice_period",
    "notice_deadline",
    "renewal_option_notice",
    "renewal_option_deadline",
    "payment_obligation",
    "fee_escalation",
    "indemnification",
    "liability_cap",
    "governing_law",
)
TYPE_ALIASES = {
    "term_start": "contract_start_date",
    "start_date": "contract_start_date",
    "term_end": "contract_end_date",
    "end_date": "contract_end_date",
    "termination_notice": "termination_notice_period",
    "notice": "termination_notice_period",
    "notice_period": "termination_notice_period",
    "deadline": "notice_deadline",
    "renewal_notice": "renewal_option_notice",
    "notice_of_renewal": "renewal_option_notice",
    "option_to_renew_notice": "renewal_option_notice",
    "renewal_deadline": "renewal_option_deadline",
    "renewal_term": "renewal_duration",
    "auto_renewal": "automatic_renewal",
    "payment": "payment_obligation",
    "fee_increase": "fee_escalation",
    "indemnity": "indemnification",
    "indemnity_cap": "liability_cap",
    "liability": "liability_cap",
    "law": "governing_law",
}
STATUSES = ("proposed", "verified", "computed", "failed", "human_verified")
APPROVABLE = ("verified", "computed", "human_verified")
METHODS = ("normalized_exact_match", "fuzzy_match", "deterministic_computation", "none")
DEADLINE_OPERATIONS = ("notice_deadline", "renewal_option_deadline", "renewal_date")
COMPUTED_ONLY = ("notice_deadline", "renewal_option_deadline")
DATE_TYPES = ("contract_start_date", "contract_end_date")
DURATION_TYPES = ("termination_notice_period", "renewal_duration", "renewal_option_notice")
MONEY_TYPES = ("payment_obligation", "liability_cap")
#: derived type, notice type it is computed from
DERIVED = (("notice_deadline", "termination_notice_period"), ("renewal_option_deadline", "renewal_option_notice"))
# End of fixed values.


def _s(ddl: str) -> T.StructType:
    out = T.StructType()
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        out.add(name, {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType())}[kind])
    return out


DOCUMENTS = _s("document_id string, filename string, stored_path string, page_count int, chunk_count int, uploaded_at timestamp, sha256 string")
DOC_PAGES = _s("document_id string, page int, text string")
CHUNKS = _s("document_id string, chunk_id string, page int, index_in_page int, text string, start_offset int, end_offset int, doc_start_offset int, doc_end_offset int")
VECTORS = _s("document_id string, chunk_id string, embedding vector")
PROPOSALS = _s("document_id string, ordinal int, obligation_type string, raw_value string, quote string, page int")
OBLIGATIONS = _s(
    "document_id string, id string, ordinal int, obligation_type string, raw_value string, normalized_value string, quote string, page int, chunk_id string, start_offset int, end_offset int, status string, verification_method string, verification_reason string, computation_formula string, computation_inputs string"
)
FAILURES = _s("document_id string, obligation_type string, reason string, detail string")
TABLES = {"documents": DOCUMENTS, "doc_pages": DOC_PAGES, "chunks": CHUNKS, "vectors": VECTORS, "obligations": OBLIGATIONS}
