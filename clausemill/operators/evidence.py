"""Whether a quote stands on the page it is claimed for, and where."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.checkbox import UNCHECKED, unchecked_reason
from ..functions.dates import bound
from ..functions.text import is_ascii, normalized, normalized_ascii, normalized_with_offsets
from ..sources.staging import staged

_OUTCOME = "verified boolean, method string, reason string, matched_text string, start_offset int, end_offset int, similarity double, value_at int"


def _span(offsets: list[int], start: int, end: int) -> tuple[int, int]:
    end = min(end, len(offsets))
    return (offsets[start], offsets[end - 1] + 1) if start < end else (0, 0)


def _value_place(text: str, start: int, end: int, value: str | None) -> int:
    """Where the value stands inside the span; the span's start if it does not."""
    wanted = normalized(value or "")
    span, offsets = normalized_with_offsets(text[start:end]) if wanted else ("", [])
    at = span.find(wanted) if wanted else -1
    return start + offsets[at] if at >= 0 else start


#: A page's quotes follow each other; its form is made once for them.
_page_form = functools.lru_cache(maxsize=1)(normalized_with_offsets)


def matched(quote: str, text: str, value: str | None, s: Settings, *, exact: bool = False) -> tuple:
    """(verified, method, reason, matched text, start, end, similarity, place of the value) of a quote on a page, boxes aside.

    exact: what is only similar to the quote does not count.
    """
    nothing = (None, None, None)
    q = normalized(quote)
    if len(q) < s.min_quote_chars:
        return (False, "none", f"quote_too_short: {len(q)} < {s.min_quote_chars} characters", *nothing, None, None)
    page, offsets = _page_form(text)
    if not page:
        return (False, "none", "page_has_no_text", *nothing, None, None)
    at = page.find(q)
    if at >= 0:
        start, end = _span(offsets, at, at + len(q))
        return (True, "normalized_exact_match", None, text[start:end], start, end, 1.0, _value_place(text, start, end, value))
    if exact:
        return (False, "none", "quote_not_found_on_page", *nothing, None, None)
    # one window, where the longest common block says the quote would begin
    block = SequenceMatcher(None, page, q, autojunk=False).find_longest_match()
    if not block.size:
        return (False, "none", "quote_not_found_on_page", *nothing, 0.0, None)
    left = max(0, block.a - block.b)
    window = page[left : left + int(len(q) * s.fuzzy_max_length_ratio) + 1]
    blocks = [b for b in SequenceMatcher(None, window, q, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return (False, "none", "quote_not_found_on_page", *nothing, 0.0, None)
    lo, hi = left + blocks[0].a, left + blocks[-1].a + blocks[-1].size
    likeness = SequenceMatcher(None, page[lo:hi], q, autojunk=False).ratio()
    if likeness < s.fuzzy_match_threshold or hi - lo > len(q) * s.fuzzy_max_length_ratio:
        return (False, "none", f"quote_not_found_on_page (best similarity {likeness:.3f})", *nothing, likeness, None)
    start, end = _span(offsets, lo, hi)
    return (True, "fuzzy_match", f"fuzzy_match similarity={likeness:.3f}", text[start:end], start, end, likeness, _value_place(text, start, end, value))


def _as_it_stands(pairs: DataFrame, s: Settings) -> DataFrame:
    """pairs with _at: where the quote's first match on its page begins, if that match is the quote letter by letter.

    Both are ASCII there, and no earlier place matches after normalisation, so
    nothing is left to compare; _at is null for all other pairs.
    """
    quote, page = F.col("quote"), F.col("page_text")
    at = F.instr(page, quote)
    whole = ~quote.rlike(r"^[\x09-\x0d\x1c-\x20]|[\x09-\x0d\x1c-\x20]$")
    sure = (at > 0) & is_ascii(quote) & is_ascii(page) & whole
    # the page up to the match's end ends with the quote after normalisation too
    forms = F.struct(normalized_ascii(F.substring(page, F.lit(1), at - 1 + F.length(quote))).alias("t"), normalized_ascii(quote).alias("q"))
    first = bound(forms, lambda x: (F.length(x["q"]) >= s.min_quote_chars) & (F.instr(x["t"], x["q"]) + F.length(x["q"]) == F.length(x["t"]) + 1))
    return pairs.withColumn("_at", F.when(sure, F.when(first, at - 1)))


def on_page(pairs: DataFrame, settings: Settings | None = None, *, exact: bool = False) -> DataFrame:
    """pairs (quote, page_text, value and further columns) with the outcome of comparing them, box rule included.

    Quotes that stand on an ASCII page letter by letter are found by built-in
    functions; the rest goes through Python.
    """
    s = settings or Settings()
    return _outcomes(_as_it_stands(pairs, s), s, exact=exact)


def _outcomes(looked: DataFrame, s: Settings, *, exact: bool) -> DataFrame:
    """on_page() of pairs that have _at; they are read twice, so what is costly to make should be written before."""
    pairs = looked.drop("_at")
    names = [x.split()[0] for x in _OUTCOME.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # where the value stands matters on pages with a box that is not ticked
            found = [matched(q or "", t or "", v if UNCHECKED in (t or "") else None, s, exact=exact) for q, t, v in zip(pdf["quote"], pdf["page_text"], pdf["value"], strict=True)]
            out = pd.DataFrame(found, columns=names, index=pdf.index)
            for c in ("start_offset", "end_offset", "value_at"):
                out[c] = out[c].astype("Int32")
            yield pd.concat([pdf, out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    null = lambda kind: F.lit(None).cast(kind)
    # a page without a box: it matters to no one where the value stands in the span
    certain = looked.where("_at is not null").select(
        *pairs.columns, F.lit(True).alias("verified"), F.lit("normalized_exact_match").alias("method"), null("string").alias("reason"), F.col("quote").alias("matched_text"), F.col("_at").cast("int").alias("start_offset"),
        (F.col("_at") + F.length("quote")).cast("int").alias("end_offset"), F.lit(1.0).alias("similarity"), null("int").alias("value_at"),
    )
    out = looked.where("_at is null").drop("_at").mapInPandas(run, f"{fields}, {_OUTCOME}")
    if s.reject_unchecked_options:
        why = F.when(F.col("verified") & F.contains("page_text", F.lit(UNCHECKED)), unchecked_reason(F.col("page_text"), F.col("value_at")))
        out = out.withColumn("_why", why)
        out = out.withColumn("verified", F.col("verified") & F.col("_why").isNull()).withColumn("method", F.when(F.col("_why").isNull(), F.col("method")).otherwise("none")).withColumn("reason", F.coalesce("_why", "reason")).drop("_why")
    return out.unionByName(certain).drop("value_at")


def verified(proposals: DataFrame, pages: DataFrame, settings: Settings | None = None, *, exact: bool = False) -> DataFrame:
    """proposals (document_id, ordinal, quote, page, value and more) with outcome columns and found_page.

    Only the claimed page can verify a quote; if it stands on another page of the
    document, the first such is named in the reason.  Without a claim the first
    page that verifies it counts.  With exact, similar passages verify nothing, on any
    page.  What compares texts is computed once.
    """
    texts = pages.select(F.col("document_id").alias("_doc"), F.col("page").alias("on"), F.col("text").alias("page_text"))
    kinds = dict(proposals.dtypes)
    same = F.col("document_id") == F.col("_doc")
    # a claim for a page that there is not keeps no text, and is not compared; nor is a quote without a claim
    joined = proposals.join(texts, same & (F.col("page") == F.col("on")), "left").drop("_doc")
    s = settings or Settings()
    joined = staged(_as_it_stands(joined.withColumn("_there", F.col("on").isNotNull()), s), "claims")
    claimed = staged(_outcomes(joined.where("_there").drop("on", "_there"), s, exact=exact).drop("page_text"), "claimed")
    absent = joined.where("page is not null and not _there").select(*proposals.columns)
    loose = joined.where("page is null").select(*proposals.columns)
    # other pages are looked at only for what its own page does not verify
    asked = ["document_id", "ordinal", "quote", "page", "value"]
    open_ = claimed.where("not verified").select(*asked).unionByName(loose.select(*asked))
    others = on_page(open_.join(texts, same).drop("_doc").where("page is null or on <> page"), settings, exact=exact).where("verified").drop("page_text")
    first = staged(others.withColumn("r", F.row_number().over(Window.partitionBy("document_id", "ordinal").orderBy("on"))).where("r = 1"), "elsewhere")
    outcome = ["verified", "method", "reason", "matched_text", "start_offset", "end_offset", "similarity"]
    elsewhere = first.select("document_id", "ordinal", F.col("on").alias("elsewhere"))
    wrong = F.concat(F.lit("wrong_page: quote claimed on page "), F.col("page").cast("string"), F.lit(" but found on page "), F.col("elsewhere").cast("string"))
    a = claimed.join(elsewhere, ["document_id", "ordinal"], "left")
    a = a.withColumn("reason", F.when(~F.col("verified") & F.col("elsewhere").isNotNull(), wrong).otherwise(F.col("reason"))).withColumn("found_page", F.col("page")).drop("elsewhere")
    none = lambda df, reason: df.select("*", F.lit(False).alias("verified"), F.lit("none").alias("method"), reason.alias("reason"), F.lit(None).cast("string").alias("matched_text"), F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"), F.lit(None).cast("double").alias("similarity"))
    b = none(absent, F.concat(F.lit("page_out_of_range: page "), F.col("page").cast("string"), F.lit(" does not exist"))).withColumn("found_page", F.col("page"))
    hits = first.select("document_id", "ordinal", F.col("on").alias("found_page"), *outcome)
    c = loose.join(hits, ["document_id", "ordinal"])
    d = none(loose.join(hits.select("document_id", "ordinal"), ["document_id", "ordinal"], "left_anti"), F.lit("quote_not_found_in_document")).withColumn("found_page", F.lit(None).cast(kinds["page"]))
    return a.unionByName(b).unionByName(c).unionByName(d)


def located(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """spans (document_id, ordinal, page, start_offset, end_offset) with chunk_id: the first chunk of the page that holds the span.

    A span without offsets takes the page's first chunk; one that no chunk holds, null.
    """
    return spans.join(homes(spans, chunks), ["document_id", "ordinal"], "left")


def homes(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, ordinal, chunk_id of the spans that have a chunk, as located() has it."""
    c = chunks.select("document_id", "page", "chunk_id", "chunk_ordinal", F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi"))
    inside = F.col("start_offset").isNull() | F.col("end_offset").isNull() | ((F.col("lo") <= F.col("start_offset")) & (F.col("end_offset") <= F.col("hi")))
    return spans.join(c, ["document_id", "page"]).where(inside).groupBy("document_id", "ordinal").agg(F.min_by("chunk_id", "chunk_ordinal").alias("chunk_id"))


def _words_hash(words, start):
    return F.xxhash64(F.array_join(F.slice(words, start, F.lit(5)), " "))


def containing(quotes: DataFrame, texts: DataFrame, *, quote_id: str = "quote_id", text_id: str = "text_id") -> DataFrame:
    """quote_id, text_id of every text that contains a quote, both folded; a quote need not begin or end with a word.

    quotes: quote_id, quote; texts: text_id, text.  Of a quote of seven words or
    more one 5-word run that no cut can touch is looked up among the texts' runs,
    then the whole quote is searched for in what remains.  Shorter quotes are looked
    up by one of their letter triples in the same way.
    """
    from ..functions.text import folded

    q = quotes.select(F.col(quote_id), folded(F.col("quote")).alias("q")).where("q <> ''").withColumn("w", F.split("q", " "))
    t = texts.select(F.col(text_id), folded(F.col("text")).alias("t"))
    inner = F.transform(F.sequence(F.lit(2), F.size("w") - 5), lambda i: _words_hash(F.col("w"), i))
    long_ = q.where(F.size("w") >= 7).select(quote_id, "q", F.array_min(inner).alias("h"))
    runs = t.withColumn("w", F.split("t", " ")).where(F.size("w") >= 5).select(text_id, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: _words_hash(F.col("w"), i)))).alias("h"))
    met = runs.join(long_, "h").select(quote_id, text_id, "q")
    hits = met.join(t, text_id).where(F.contains("t", "q")).select(quote_id, text_id)
    short = q.where(F.size("w") < 7).select(quote_id, "q")
    few, tiny = (x or 0 for x in short.agg(F.count_if(F.length("q") >= 3), F.count_if(F.length("q") < 3)).first())
    if few:
        # what a text must have to hold a short quote: the quote's letter triple of least hash
        triples = lambda text: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))
        least = F.array_min(F.transform(triples(F.col("q")), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))["x"]
        keyed = short.where(F.length("q") >= 3).withColumn("g", least)
        posted = t.select(text_id, F.explode(triples(F.col("t"))).alias("g")).join(keyed, "g").select(quote_id, text_id, "q")
        hits = hits.unionByName(posted.join(t, text_id).where(F.contains("t", "q")).select(quote_id, text_id))
    if tiny:  # one or two letters stand in nearly every text: all pairs are nearly the result
        hits = hits.unionByName(t.join(short.where(F.length("q") < 3), F.contains("t", "q")).select(quote_id, text_id))
    return hits
