"""From proposals to candidate obligations, derived deadlines, failures and approval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.dates import bound, deadline, parsed_date, parsed_duration
from ..functions.values import canonical_type, is_without_figure, normalized_value
from ..schemas import APPROVABLE, COMPUTED_ONLY, DERIVED
from ..sources.staging import staged
from .evidence import homes, verified


def sorted_out(proposals: DataFrame, requested: list[str]) -> tuple[DataFrame, DataFrame]:
    """Proposals of known, asked types, the first of each; and failures for unknown and computed types."""
    typed = proposals.withColumn("canonical", canonical_type(F.col("obligation_type")))
    unknown = typed.where("canonical is null").select("document_id", F.lit(None).cast("string").alias("obligation_type"), F.lit("unknown_obligation_type").alias("reason"), F.col("obligation_type").alias("detail"))
    computed = typed.where(F.col("canonical").isin(*COMPUTED_ONLY)).select(
        "document_id", F.col("canonical").alias("obligation_type"), F.lit("model_proposed_computed_field_ignored").alias("reason"), F.concat("canonical", F.lit(" is computed by deterministic code; the model's proposal was discarded")).alias("detail")
    )
    asked = typed.where(F.col("canonical").isin(*requested) & ~F.col("canonical").isin(*COMPUTED_ONLY)).withColumn("obligation_type", F.col("canonical")).drop("canonical")
    first = Window.partitionBy("document_id", "obligation_type").orderBy("ordinal")
    return asked.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"), unknown.unionByName(computed)


def candidates(proposals: DataFrame, pages: DataFrame, chunks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Obligations of proposals: quote verified, value normalised, status and reason set."""
    out = staged(verified(proposals.withColumn("value", F.col("raw_value")), pages, settings).drop("value"), "verified")
    home = homes(out.where("verified").select("document_id", "ordinal", "page", "start_offset", "end_offset"), chunks)
    out = out.join(home, ["document_id", "ordinal"], "left")
    quote = F.coalesce("matched_text", "quote")
    value = F.when(F.col("verified"), normalized_value(F.col("obligation_type"), F.col("raw_value"), quote))
    out = out.withColumn("normalized_value", value).withColumn("quote", quote)
    unusable = F.concat(F.lit("value_not_normalizable: quote verified but '"), F.col("raw_value"), F.lit("' could not be parsed as "), F.col("obligation_type"))
    in_words = "non_numeric_amount: the clause states a cap or obligation without a figure; the value is the clause text and needs human reading"
    good = F.col("verified") & F.col("normalized_value").isNotNull()
    reason = F.when(~F.col("verified"), F.coalesce("reason", F.lit("quote_not_verified"))).when(F.col("normalized_value").isNull(), unusable).when(is_without_figure(F.col("obligation_type"), F.col("normalized_value")), in_words).otherwise(F.col("reason"))
    return out.select(
        "document_id", F.concat_ws(":", "document_id", "obligation_type").alias("id"), "ordinal", "obligation_type", "raw_value", "normalized_value", "quote", "page", "chunk_id", "start_offset", "end_offset",
        F.when(good, "verified").otherwise("failed").alias("status"), F.col("method").alias("verification_method"), reason.alias("verification_reason"), F.lit(None).cast("string").alias("computation_formula"), F.lit(None).cast("string").alias("computation_inputs"),
    )


def _usable(kind: str) -> Column:
    return F.max(F.when((F.col("obligation_type") == kind) & F.col("status").isin(*APPROVABLE), F.struct("normalized_value", "id")))


def derived(obligations: DataFrame, requested: list[str] | None = None, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Deadlines computed from usable end dates and notices, and failures where an input is missing.

    A missing end date is reported where its notice exists; a document with
    neither result nor report gets one report for the first deadline, if that is
    requested.  documents: ids that must not go unreported though they have no obligation.
    """
    wanted = [(kind, notice) for kind, notice in DERIVED if requested is None or kind in requested]
    inputs = obligations.groupBy("document_id").agg(_usable("contract_end_date").alias("end"), *(_usable(notice).alias(notice) for _, notice in DERIVED))
    if documents is not None:
        inputs = documents.select("document_id").distinct().join(inputs, "document_id", "left")
    # parsed once, as columns: the computation names them many times
    inputs = inputs.withColumns({"_end": parsed_date(F.col("end.normalized_value"))} | {f"_{notice}": parsed_duration(F.col(f"{notice}.normalized_value")) for _, notice in wanted})
    rows, lacks = [], []
    for kind, notice in wanted:
        made = deadline(kind, F.col("end.normalized_value"), F.col(f"{notice}.normalized_value"), F.col("_end"), F.col(f"_{notice}"))
        sources = F.array(F.col("end.id"), F.col(f"{notice}.id"))
        row = bound(made, lambda m: F.struct(F.lit(kind).alias("kind"), m["result"].alias("result"), m["formula"].alias("formula"), m["error"].alias("error"), F.to_json(m["inputs"].withField("source_obligation_ids", sources)).alias("inputs")))  # noqa: B023
        rows.append(F.when(F.col("end").isNotNull() & F.col(notice).isNotNull(), row))
        lacks.append(F.when(F.col("end").isNull() & F.col(notice).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit("contract_end_date").alias("missing"))))
    results = F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<kind:string,result:date,formula:string,error:string,inputs:string>>")
    lack = F.array_compact(F.array(*lacks)) if lacks else F.array().cast("array<struct<kind:string,missing:string>>")
    both = inputs.withColumn("results", results).withColumn("lacks", lack)
    first_kind, first_notice = DERIVED[0]
    missing = F.concat_ws(", ", F.when(F.col("end").isNull(), "contract_end_date"), F.when(F.col(first_notice).isNull(), first_notice))
    if any(kind == first_kind for kind, _ in wanted):
        # neither result nor lack: no notice of a wanted kind
        neither = reduce(lambda a, b: a & b, (F.col(notice).isNull() for _, notice in wanted))
        both = both.withColumn("lacks", F.when(neither & (missing != ""), F.array(F.struct(F.lit(first_kind).alias("kind"), missing.alias("missing")))).otherwise(F.col("lacks")))
    # written, as several results read it and the computation costs more than the table
    both = staged(both.select("document_id", "results", "lacks"), "deadlines")
    exploded = both.select("document_id", F.explode("results").alias("r"))
    day = F.date_format("r.result", "yyyy-MM-dd")
    null = lambda kind: F.lit(None).cast(kind)
    order = F.array_position(F.array(*(F.lit(k) for k, _ in DERIVED)), F.col("r.kind"))
    made = exploded.where("r.error is null").select(
        "document_id", F.concat_ws(":", "document_id", "r.kind").alias("id"), (order + 1000).cast("int").alias("ordinal"), F.col("r.kind").alias("obligation_type"), day.alias("raw_value"), day.alias("normalized_value"), null("string").alias("quote"), null("int").alias("page"), null("string").alias("chunk_id"),
        null("int").alias("start_offset"), null("int").alias("end_offset"), F.lit("computed").alias("status"), F.lit("deterministic_computation").alias("verification_method"), F.lit("calculated in code, not model output").alias("verification_reason"), F.col("r.formula").alias("computation_formula"), F.col("r.inputs").alias("computation_inputs"),
    )
    broken = exploded.where("r.error is not null").select("document_id", F.col("r.kind").alias("obligation_type"), F.lit("computation_failed").alias("reason"), F.col("r.error").alias("detail"))
    said = F.concat(F.col("l.kind"), F.lit(" was not computed because these verified inputs are missing: "), F.col("l.missing"))
    gone = both.select("document_id", F.explode("lacks").alias("l")).select("document_id", F.col("l.kind").alias("obligation_type"), F.lit("missing_verified_inputs").alias("reason"), said.alias("detail"))
    return made, broken.unionByName(gone)


def approvals(obligations: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """document_id, n_obligations, can_approve: whether there are obligations and all of them are usable."""
    out = obligations.groupBy("document_id").agg(F.count("*").alias("n_obligations"), F.bool_and(F.col("status").isin(*APPROVABLE)).alias("can_approve"))
    if documents is None:
        return out
    return documents.select("document_id").distinct().join(out, "document_id", "left").select("document_id", F.coalesce("n_obligations", F.lit(0)).alias("n_obligations"), F.coalesce("can_approve", F.lit(False)).alias("can_approve"))


def failure_text(reason: Column, detail: Column) -> Column:
    """'reason: detail'; the colon stays where there is no detail."""
    return F.trim(F.concat(reason, F.lit(": "), F.coalesce(detail, F.lit(""))))
