"""Rule-based proposals: clauses in context chunks that state a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bound, find_dates_udf, find_durations_udf, for_anchor
from ..functions.text import WS, stripped

# Where sentences end, and the words that a clause of each kind has.
PARAGRAPH_END = rf"\n{WS}*\n"
SENTENCE_END = rf"""(?<=[.;]){WS}+(?=[A-Z0-9("'])"""
MONEY = rf"(?i)(?:USD|EUR|GBP|\$|€|£){WS}?[\d,]+(?:\.\d{{2}})?"
PERCENT = rf"(?i)\b\d{{1,3}}(?:\.\d+)?{WS}?(?:%|percent)"
LAW = rf"laws of (?:the )?(?:State of |Commonwealth of )?([A-Z][A-Za-z ]+?)(?=[,.]|{WS}+without)"
LEAST_CLAUSE, QUOTED = 60, 180
BEGINS = ("commence", "effective date", "begins on", "start date", "effective as of")
ENDS = ("expire", "expires", "expiration", "end date", "ending", "terminate on", "termination date", "through ", "until")
AUTOMATIC = ("automatic", "automatically", "auto-renew")
OPTION = ("option to renew", "exercised by providing", "notice of renewal")
NOTICE_SHAPE = ("not less than", "prior to", "no later than", "at least")
OTHER_CLAUSE = ("cure", "default", "breach", "casualty", "damaged", "destroyed", "condemn", "eminent domain")
TERMINATES = ("terminat", "cancel", "non-renew", "not to renew")
PAYS = ("pay", "fee", "invoice", "amount due")
RAISES = ("increase", "escalat", "adjust", "uplift")
# End of fixed values.


def sentences_of(text: Column) -> Column:
    """Paragraphs' sentences, stripped, without empty ones."""
    cut = F.flatten(F.transform(F.split(text, PARAGRAPH_END), lambda p: F.split(p, SENTENCE_END)))
    return F.filter(F.transform(cut, stripped), lambda s: s != "")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def clause_matches(sentences: DataFrame) -> DataFrame:
    """sentences (with sentence) and matches: array of obligation_type, raw_value, in the order of the rules."""
    s, low = F.col("sentence"), F.lower(F.col("sentence"))
    out = sentences.withColumn("_low", low)
    low = F.col("_low")
    # only what a rule can ask of a sentence is looked for in it
    dated, spanned = _any(low, BEGINS + ENDS), _any(low, AUTOMATIC + OPTION) | F.contains(low, F.lit("notice"))
    out = out.withColumn("_dates", find_dates_udf()(F.when(dated, s))).withColumn("_spans", find_durations_udf()(F.when(spanned, s)))
    # places count from 0; no occurrence: null
    place = lambda found: F.when(found > 0, found - 1)
    notice_at = place(F.instr(low, "notice"))
    # 'non-renewal' is about notice, not about the term
    renew_at = place(F.when(F.contains(low, F.lit("renew")), F.regexp_instr(low, F.lit("(?<!non-)(?<!non )renew"))))
    out = out.withColumns({
        "_first": F.try_element_at("_spans", F.lit(1))["iso"],
        "_notice": for_anchor(F.col("_spans"), notice_at),
        "_renewal": for_anchor(F.col("_spans"), renew_at),
        "_begin": F.try_element_at("_dates", F.lit(1))["iso"],
        "_end": F.try_element_at("_dates", F.lit(-1))["iso"],
        "_money": F.when(_any(low, (*PAYS, "liabilit")), F.nullif(F.regexp_extract(s, MONEY, 0), F.lit(""))),
        "_percent": F.when(_any(low, RAISES), F.nullif(F.regexp_extract(s, PERCENT, 0), F.lit(""))),
        "_law": F.when(F.contains(s, F.lit("laws of")), F.nullif(F.trim(F.regexp_extract(s, LAW, 1)), F.lit(""))),
        "_clause": F.length(s) >= LEAST_CLAUSE,
    })
    nonzero = lambda d: d.isNotNull() & (d != "P0D")
    first = F.col("_first")
    noticed = F.contains(low, F.lit("notice"))
    automatic = F.contains(low, F.lit("renew")) & F.col("_clause") & _any(low, AUTOMATIC)
    option = nonzero(first) & _any(low, OPTION) & noticed & _any(low, NOTICE_SHAPE)
    renewal = F.col("_renewal")
    rules = [
        ("contract_start_date", F.col("_begin"), _any(low, BEGINS)),
        ("contract_end_date", F.col("_end"), _any(low, ENDS)),
        ("automatic_renewal", F.lit("true"), automatic),
        ("renewal_duration", renewal, automatic & nonzero(renewal)),
        ("renewal_option_notice", F.col("_notice"), option),
        ("renewal_duration", renewal, ~option & nonzero(renewal) & _any(low, OPTION) & F.contains(low, F.lit("term"))),
        ("termination_notice_period", F.col("_notice"), nonzero(first) & ~option & ~_any(low, OTHER_CLAUSE) & noticed & _any(low, TERMINATES)),
        ("payment_obligation", F.col("_money"), _any(low, PAYS)),
        ("fee_escalation", F.col("_percent"), _any(low, RAISES)),
        ("indemnification", F.substring(s, 1, QUOTED), F.contains(low, F.lit("indemnif")) & F.col("_clause")),
        ("liability_cap", F.coalesce(F.col("_money"), F.substring(s, 1, QUOTED)), F.contains(low, F.lit("liabilit")) & (F.col("_money").isNotNull() | (F.contains(low, F.lit("exceed")) & F.col("_clause")))),
        ("governing_law", F.col("_law"), F.lit(True)),
    ]
    found = F.array(*(F.when(F.coalesce(when, F.lit(False)) & value.isNotNull(), F.struct(F.lit(k).alias("obligation_type"), value.alias("raw_value"), F.lit(i).alias("rule"))) for i, (k, value, when) in enumerate(rules)))
    return out.select(*sentences.columns, F.array_compact(found).alias("matches"))


def worth_reading(sentence: Column) -> Column:
    """Whether a sentence has a word that some rule needs."""
    words = BEGINS + ENDS + AUTOMATIC + OPTION + ("notice", "indemnif", "liabilit", "laws of") + PAYS + RAISES
    return bound(F.lower(sentence), lambda low: _any(low, words))


def invented(context: DataFrame) -> DataFrame:
    """For each document one confident proposal whose quote stands nowhere in it: what verification must catch."""
    first = context.groupBy("document_id").agg(F.min_by("page", "position").alias("page"))
    quote = "The parties have settled that all rights and duties under this instrument cease on December 31, 2029 at the latest."
    return first.select("document_id", F.lit(1).alias("ordinal"), F.lit("contract_end_date").alias("obligation_type"), F.lit("December 31, 2029").alias("raw_value"), F.lit(quote).alias("quote"), "page")


def proposed(context: DataFrame, types: list[str] | None = None) -> DataFrame:
    """document_id, ordinal, obligation_type, raw_value, quote, page: the first match of each type in reading order.

    context: document_id, position, page, text.  ordinal follows the order of types.
    """
    from ..schemas import COMPUTED_ONLY, OBLIGATION_TYPES

    types = [t for t in (types or OBLIGATION_TYPES) if t not in COMPUTED_ONLY]
    flat = context.select("document_id", "position", "page", F.posexplode(sentences_of(F.col("text"))).alias("at", "sentence")).where(worth_reading(F.col("sentence")))
    # not explode: a filter on what it explodes would compute all rules a second time
    hits = clause_matches(flat).select("document_id", "position", "page", "at", "sentence", F.explode_outer("matches").alias("m")).where("m is not null")
    hits = hits.select("document_id", "position", "page", "at", F.col("sentence").alias("quote"), F.col("m.obligation_type").alias("obligation_type"), F.col("m.raw_value").alias("raw_value"), F.col("m.rule").alias("rule"))
    first = Window.partitionBy("document_id", "obligation_type").orderBy("position", "at", "rule")
    kept = hits.where(F.col("obligation_type").isin(types)).withColumn("r", F.row_number().over(first)).where("r = 1")
    return kept.select("document_id", F.array_position(F.array(*map(F.lit, types)), F.col("obligation_type")).cast("int").alias("ordinal"), "obligation_type", "raw_value", "quote", "page")


def proposed_by(context: DataFrame, answer, types: list[str]) -> DataFrame:
    """Proposals of a model: answer(types, excerpts) -> text, one call for each document, JSON repaired and checked.

    An answer that raises gives a failure row instead: obligation_type null, raw_value null, quote the error.
    """
    import json

    import pandas as pd

    from ..functions.jsons import first_object

    listed = context.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("position", "page", "text"))).alias("excerpts"))

    def run(batches):
        for pdf in batches:
            rows = []
            for document_id, excerpts in zip(pdf["document_id"], pdf["excerpts"], strict=True):
                try:
                    raw = answer(types, [(e["page"], e["text"]) for e in excerpts])
                    body, error = first_object(raw)
                    if error:
                        raise ValueError(error)
                    for k, o in enumerate(json.loads(body).get("obligations", []), 1):
                        rows.append((document_id, k, str(o["obligation_type"]), str(o["raw_value"]), str(o["quote"]), int(o["page"])))
                except Exception as e:  # a document's failure must not end the job
                    rows.append((document_id, 0, None, None, str(e), None))
            out = pd.DataFrame(rows, columns=["document_id", "ordinal", "obligation_type", "raw_value", "quote", "page"])
            out["page"] = out["page"].astype("Int32")
            yield out

    return listed.mapInPandas(run, "document_id string, ordinal int, obligation_type string, raw_value string, quote string, page int")


def prompt(types: list[str], excerpts: list[tuple[int, str]]) -> str:
    """What a model is asked."""
    wanted = "\n".join(f"- {t}" for t in types)
    shown = "\n\n".join(f"[excerpt {k} | page {page}]\n{text}" for k, (page, text) in enumerate(excerpts, 1))
    return f"Obligation types to look for:\n{wanted}\n\nContract excerpts:\n\n{shown}\n\nReturn the JSON object now."


def chat_answer(settings):
    """answer() for proposed_by() from an OpenAI-compatible server: temperature 0, JSON mode, then without."""
    import json
    import urllib.error
    import urllib.request

    def ask(types, excerpts) -> str:
        body = {"model": settings.llm_model, "temperature": 0, "max_tokens": settings.llm_max_output_tokens, "messages": [{"role": "system", "content": "Answer with one JSON object: {\"obligations\": [{\"obligation_type\", \"raw_value\", \"quote\", \"page\"}]}. Quote verbatim."}, {"role": "user", "content": prompt(types, excerpts)}]}
        for extra in ({"response_format": {"type": "json_object"}}, {}):
            request = urllib.request.Request(f"{settings.llm_base_url}/chat/completions", json.dumps(body | extra).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {settings.llm_api_key}"})
            try:
                with urllib.request.urlopen(request, timeout=settings.llm_timeout_seconds) as got:
                    return json.load(got)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError:
                if not extra:
                    raise
        raise RuntimeError("unreachable")

    return ask
