"""Money, percentages, flags: the canonical form of a proposed value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DATE_TYPES, DURATION_TYPES, MONEY_TYPES, OBLIGATION_TYPES, TYPE_ALIASES
from .dates import bound, is_zero, iso_duration, parsed_date, parsed_duration
from .text import WS, collapsed, stripped

# What counts as an amount, a percentage, a cap in words and a renewal that is not automatic.
_CURRENCY = r"USD|EUR|GBP|CHF|CAD|AUD|\$|€|£"
_AMOUNT = r"\d[\d,]*(?:\.\d+)?"
_SCALE = "million|billion|thousand"
MONEY_BEFORE = rf"(?i)({_CURRENCY}){WS}?({_AMOUNT})(?:{WS}*({_SCALE}))?\b"
MONEY_AFTER = rf"(?i)({_AMOUNT})(?:{WS}*({_SCALE}))?{WS}*(dollars|euros|pounds|USD|EUR|GBP)\b"
CODES = {"$": "USD", "€": "EUR", "£": "GBP", "DOLLARS": "USD", "EUROS": "EUR", "POUNDS": "GBP"}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
PERCENT = rf"(?i)(\d{{1,3}}(?:\.\d+)?){WS}*(?:%|percent)"
QUALITATIVE = r"(?i)\bexceed\b|\blimited to\b|\bcapped at\b|\bno greater than\b|\bshall pay\b|\bpayable\b"
NUMERIC_AMOUNT = r"^[A-Z]{3} \d"
NOT_AUTOMATIC = (
    "not automatically renew",
    "shall not renew",
    "no automatic renewal",
    "may not be renewed",
    "may be renewed",
    "option to renew",
    "shall have the option",
    "at tenant's option",
    "at its option",
)
# End of fixed values.


def contract_number(document_id: Column) -> Column:
    """The number that a document of a caller has as its id, or null for documents of other origin."""
    return F.when(document_id.rlike("^[0-9]+$"), document_id.try_cast("long"))


def canonical_type(name: Column) -> Column:
    """The obligation type a name or alias means, or null."""
    key = F.translate(F.lower(stripped(name)), " -", "__")
    known = {t: t for t in OBLIGATION_TYPES} | TYPE_ALIASES
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[key]


def money(text: Column) -> Column:
    """'USD 120000.00', or null where no currency is named."""

    def made(pattern: str, symbol: int, amount: int, scale: int) -> Column:
        code = F.upper(F.regexp_extract(text, pattern, symbol))
        named = F.coalesce(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))[code], code)
        times = F.coalesce(F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair))[F.lower(F.regexp_extract(text, pattern, scale))], F.lit(1))
        value = F.translate(F.regexp_extract(text, pattern, amount), ",", "").try_cast("double") * times
        return F.concat(named, F.lit(" "), F.translate(F.format_number(value, 2), ",", ""))

    return F.when(text.rlike(MONEY_BEFORE), made(MONEY_BEFORE, 1, 2, 3)).when(text.rlike(MONEY_AFTER), made(MONEY_AFTER, 3, 1, 2))


def percent(text: Column) -> Column:
    """'4.5%', without trailing zeros; six significant digits."""
    value = F.regexp_extract(text, PERCENT, 1)
    whole = F.length(F.regexp_extract(value, r"^0*(\d*)", 1))
    # 3 digits before the point leave 3 after it
    number = value.cast("decimal(20,12)")
    rounded = F.when(whole >= 3, F.bround(number, 3)).when(whole == 2, F.bround(number, 4)).when(whole == 1, F.bround(number, 5)).otherwise(F.bround(number, 6))
    plain = F.regexp_replace(F.regexp_replace(rounded.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike(PERCENT), F.concat(plain, F.lit("%")))


def renewal_flag(raw: Column, quote: Column) -> Column:
    """'true', 'false' or null: whether renewal is automatic."""
    both = F.lower(F.concat_ws(" ", raw, quote))
    low = F.lower(raw)
    negative = reduce(lambda a, b: a | b, (F.contains(both, F.lit(p)) for p in NOT_AUTOMATIC))
    return F.when(negative | F.contains(low, F.lit("false")) | (stripped(low) == "no"), "false").when(F.contains(both, F.lit("renew")) | F.contains(low, F.lit("true")), "true")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[ .,;]+|[ .,;]+$", "")


def normalized_value(kind: Column, raw: Column, quote: Column) -> Column:
    """The canonical form of a value of an obligation type; the quote helps out where the value says too little."""
    each = lambda f: F.coalesce(f(raw), f(quote))

    def period(text: Column) -> Column:
        return bound(parsed_duration(text), lambda d: F.when(~is_zero(d), iso_duration(d)))

    in_words = F.when(F.coalesce(raw, F.lit("")).rlike(QUALITATIVE), _trimmed(raw)).when(F.coalesce(quote, F.lit("")).rlike(QUALITATIVE), _trimmed(quote))
    return (
        F.when(kind.isin(*DATE_TYPES), F.date_format(each(parsed_date), "yyyy-MM-dd"))
        .when(kind.isin(*DURATION_TYPES), each(period))
        .when(kind == "automatic_renewal", renewal_flag(raw, quote))
        .when(kind.isin(*MONEY_TYPES), F.coalesce(each(money), in_words))
        .when(kind == "fee_escalation", each(percent))
        .when(kind == "governing_law", F.nullif(_trimmed(raw), F.lit("")))
        .otherwise(F.nullif(collapsed(raw), F.lit("")))
    )


def is_without_figure(kind: Column, value: Column) -> Column:
    """Whether a money type's value is a clause rather than an amount."""
    return kind.isin(*MONEY_TYPES) & ~value.rlike(NUMERIC_AMOUNT)
