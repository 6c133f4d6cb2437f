"""Dates and durations as contracts write them, and arithmetic on them."""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BLANK, WS, stripped

# Month and number words, and the patterns that count as a date or duration.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
NUMBERS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80,
    "ninety": 90, "hundred": 100,
}
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_NUMBER = "|".join(NUMBERS)
ISO_DATE = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
MONTH_FIRST = rf"(?i)\b({_MONTH})\.?{WS}+(\d{{1,2}})(?:st|nd|rd|th)?{WS}*,?{WS}*(\d{{4}})\b"
DAY_FIRST = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?{WS}+(?:day{WS}+of{WS}+)?({_MONTH})\.?{WS}*,?{WS}*(\d{{4}})\b"
SLASHED = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
ISO_DURATION = r"(?i)^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?$"
IN_BRACKETS = rf"(?i)\((\d{{1,4}})\){WS}*(?:calendar{WS}+)?(day|week|month|year)s?"
IN_DIGITS = rf"(?i)\b(\d{{1,4}}){WS}*(?:calendar{WS}+)?(day|week|month|year)s?\b"
IN_WORDS = rf"(?i)\b((?:{_NUMBER})(?:[{BLANK}-]+(?:{_NUMBER}))*){WS}*(?:calendar{WS}+)?(day|week|month|year)s?\b"
# End of fixed values.

DATE_PATTERNS = (ISO_DATE, MONTH_FIRST, DAY_FIRST, SLASHED)
DURATION_PATTERNS = (IN_BRACKETS, IN_DIGITS, IN_WORDS)
DURATION = "struct<years:int,months:int,days:int>"
FOUND = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("iso", T.StringType())]))


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is none such."""
    return F.when(year.cast("int") > 0, F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "y-M-d"))


def parsed_date(text: Column) -> Column:
    """The date in a text.  The first kind of pattern that occurs decides, even if its date does not exist."""
    t = F.coalesce(text, F.lit(""))
    part = lambda pattern, n: F.regexp_extract(t, pattern, n)
    month = lambda pattern, n: _lookup(MONTHS, F.lower(part(pattern, n)))
    return (
        F.when(t.rlike(ISO_DATE), _ymd(part(ISO_DATE, 1), part(ISO_DATE, 2), part(ISO_DATE, 3)))
        .when(t.rlike(MONTH_FIRST), _ymd(part(MONTH_FIRST, 3), month(MONTH_FIRST, 1), part(MONTH_FIRST, 2)))
        .when(t.rlike(DAY_FIRST), _ymd(part(DAY_FIRST, 3), month(DAY_FIRST, 2), part(DAY_FIRST, 1)))
        .when(t.rlike(SLASHED), F.coalesce(_ymd(part(SLASHED, 3), part(SLASHED, 1), part(SLASHED, 2)), _ymd(part(SLASHED, 3), part(SLASHED, 2), part(SLASHED, 1))))
    )


def duration(years: Column, months: Column, days: Column) -> Column:
    return F.struct(years.cast("int").alias("years"), months.cast("int").alias("months"), days.cast("int").alias("days"))


def _whole(d: Column) -> Column:
    """d, or null if one of its parts is."""
    return F.when(d["years"].isNotNull() & d["months"].isNotNull() & d["days"].isNotNull(), d)


def _of_unit(amount: Column, unit: Column) -> Column:
    unit, zero = F.lower(unit), F.lit(0)
    return F.when(
        amount.isNotNull(),
        duration(F.when(unit == "year", amount).otherwise(zero), F.when(unit == "month", amount).otherwise(zero), F.when(unit == "day", amount).when(unit == "week", amount * 7).otherwise(zero)),
    )


def number_of_words(words: Column) -> Column:
    """'one hundred twenty' -> 120; the words add up, hundred multiplies what came before."""
    numbers = F.transform(F.split(F.lower(F.trim(words)), f"[{BLANK}-]+"), lambda w: _lookup(NUMBERS, w))
    return F.aggregate(numbers, F.lit(0), lambda total, n: F.when(n == 100, F.greatest(total, F.lit(1)) * 100).otherwise(total + n))


def parsed_duration(text: Column) -> Column:
    """struct(years, months, days) of a text, or null: ISO 8601, else (90) days, else 90 days, else ninety days; weeks as days."""
    t = stripped(F.coalesce(text, F.lit("")))
    compact = F.replace(t, F.lit(" "), F.lit(""))
    # a figure beyond all calendars is none
    iso = lambda n: F.when(F.regexp_extract(compact, ISO_DURATION, n) == "", 0).otherwise(F.regexp_extract(compact, ISO_DURATION, n).try_cast("int"))
    part = lambda pattern, n: F.regexp_extract(t, pattern, n)
    return (
        F.when(compact.rlike(ISO_DURATION) & (F.length(compact) > 1), bound(duration(iso(1), iso(2), (iso(4).cast("long") + iso(3).cast("long") * 7).try_cast("int")), _whole))
        .when(t.rlike(IN_BRACKETS), _of_unit(part(IN_BRACKETS, 1).try_cast("int"), part(IN_BRACKETS, 2)))
        .when(t.rlike(IN_DIGITS), _of_unit(part(IN_DIGITS, 1).try_cast("int"), part(IN_DIGITS, 2)))
        .when(t.rlike(IN_WORDS), _of_unit(number_of_words(part(IN_WORDS, 1)), part(IN_WORDS, 2)))
    )


def is_zero(d: Column) -> Column:
    return (d["years"] == 0) & (d["months"] == 0) & (d["days"] == 0)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def iso_duration(d: Column) -> Column:
    """P1Y6M; P0D for none; null for null."""
    return bound(d, _iso)


def _iso(d: Column) -> Column:
    part = lambda n, unit: F.when(d[n] != 0, F.concat(d[n].cast("string"), F.lit(unit))).otherwise("")
    return F.when(d.isNotNull(), F.when(is_zero(d), F.lit("P0D")).otherwise(F.concat(F.lit("P"), part("years", "Y"), part("months", "M"), part("days", "D"))))


def spoken_duration(d: Column) -> Column:
    """1 year 6 months; 0 days for none."""
    part = lambda n: F.when(d[n] != 0, F.concat(d[n].cast("string"), F.lit(f" {n[:-1]}"), F.when(d[n] != 1, "s").otherwise("")))
    return F.when(d.isNotNull(), F.when(is_zero(d), F.lit("0 days")).otherwise(F.concat_ws(" ", part("years"), part("months"), part("days"))))


def shifted(anchor: Column, d: Column, sign: int = 1) -> Column:
    """anchor plus or minus a duration: months first (the day clamps to the month's end), then days.

    Null where the result is outside the years 1 to 9999.
    """
    months, days = (d["years"].cast("long") * 12 + d["months"]) * sign, d["days"].cast("long") * sign
    # more than all those years would not fit the arithmetic either
    span = F.struct(anchor.alias("a"), F.when(F.abs(months) <= 120_000, months).cast("int").alias("m"), F.when(F.abs(days) <= 4_000_000, days).cast("int").alias("d"))
    return bound(span, lambda x: bound(F.date_add(F.add_months(x["a"], x["m"]), x["d"]), lambda out: F.when(F.year(out).between(1, 9999), out)))


def days_until(target: Column, reference: Column | None = None) -> Column:
    return F.datediff(target, F.current_date() if reference is None else reference)


#: operation -> names of its two inputs, sign, consequence
_OPERATIONS = {
    "notice_deadline": ("contract_end_date", "termination_notice_period", -1, None),
    "renewal_option_deadline": ("contract_end_date", "renewal_option_notice", -1, "the renewal option lapses after this date"),
    "renewal_date": ("contract_end_date", "renewal_duration", 1, None),
}


def deadline(operation: str, anchor: Column, period: Column, d: Column | None = None, p: Column | None = None) -> Column:
    """struct(result, formula, error, inputs) of an operation on a date and a duration given as texts.

    d, p: the parsed texts, if there are columns of them already.
    """
    first, second, sign, consequence = _OPERATIONS[operation]

    def made(d: Column, p: Column, result: Column) -> Column:
        ok = result.isNotNull()
        said = lambda name, value: F.concat(F.lit(f"unparseable_{name}: '"), F.coalesce(value, F.lit("")), F.lit("'"))
        day = lambda x: F.date_format(x, "yyyy-MM-dd")
        mark = "-" if sign < 0 else "+"
        moved = F.concat(day(d), F.lit(f" {mark} "), spoken_duration(p))
        inputs = F.struct(
            anchor.alias(first), period.alias(second), F.when(ok, day(d)).alias(f"{first}_iso"), F.when(ok, iso_duration(p)).alias(f"{second}_iso"), F.when(ok, F.lit("subtract" if sign < 0 else "add")).alias("operation"),
            F.when(ok, F.lit(consequence).cast("string")).alias("consequence"), F.when(ok, F.concat(moved, F.lit(" = "), day(result))).alias("evaluated"),
        )
        error = F.when(d.isNull(), said("date", anchor)).when(p.isNull(), said("duration", period)).when(~ok, F.concat(F.lit("date_out_of_range: "), moved))
        return F.struct(result.alias("result"), F.lit(f"{operation} = {first} {mark} {second}").alias("formula"), error.alias("error"), inputs.alias("inputs"))

    read = F.struct((parsed_date(anchor) if d is None else d).alias("d"), (parsed_duration(period) if p is None else p).alias("p"))
    # each step is computed once, however often the next one names it
    return bound(read, lambda x: bound(F.struct(x["d"].alias("d"), x["p"].alias("p"), shifted(x["d"], x["p"], sign).alias("r")), lambda y: made(y["d"], y["p"], y["r"])))


def _date_of(kind: int, m: re.Match) -> str | None:
    """The ISO date of a match of DATE_PATTERNS[kind], or None if there is none such."""
    a, b, c = (MONTHS.get(g.lower()) or int(g) for g in m.groups())
    tries = {0: [(a, b, c)], 1: [(c, a, b)], 2: [(c, b, a)], 3: [(c, a, b), (c, b, a)]}[kind]
    for year, month, day in tries:
        try:
            return datetime.date(year, month, day).isoformat()
        except ValueError:
            continue
    return None


def _duration_of(kind: int, m: re.Match) -> str | None:
    """The ISO duration of a match of DURATION_PATTERNS[kind]."""
    n = 0
    for word in re.split(f"[{BLANK}-]+", m[1].lower()):
        value = int(word) if kind < 2 else NUMBERS[word]
        n = max(n, 1) * 100 if kind == 2 and value == 100 else n + value
    unit = m[2].lower()
    if unit == "week":
        n, unit = n * 7, "day"
    return f"P{n}{unit[0].upper()}" if n else "P0D"


def found(text: str, patterns: tuple[re.Pattern, ...], value: Callable[[int, re.Match], str | None]) -> list[tuple[int, str, str]]:
    """Place, wording and value of matches that have one and overlap none of an earlier pattern; left to right."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in enumerate(patterns):
        for m in pattern.finditer(text):
            iso = value(kind, m)
            if iso is not None and all(m.end() <= s or e <= m.start() for s, e, _ in taken):
                taken.append((*m.span(), iso))
    return [(s, text[s:e], iso) for s, e, iso in sorted(taken)]


def _finder(patterns: tuple[str, ...], value: Callable[[int, re.Match], str | None]):
    compiled = tuple(map(re.compile, patterns))

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: found(t or "", compiled, value))

    return run


@functools.cache
def find_dates_udf():
    """All dates of a text that exist: array of place, wording and ISO date."""
    return _finder(DATE_PATTERNS, _date_of)


@functools.cache
def find_durations_udf():
    """All durations of a text: array of place, wording and ISO duration."""
    return _finder(DURATION_PATTERNS, _duration_of)


def for_anchor(spans: Column, anchor: Column) -> Column:
    """The ISO value at or after a place (null: the first); if all come before it, the nearest."""
    after = F.try_element_at(F.filter(spans, lambda x: x["at"] >= anchor), F.lit(1))["iso"]
    nearest = F.array_min(F.transform(spans, lambda x: F.struct(F.abs(x["at"] - anchor).alias("far"), x["at"].alias("at"), x["iso"].alias("iso"))))["iso"]
    first = F.try_element_at(spans, F.lit(1))["iso"]
    return F.when(anchor.isNull(), first).otherwise(F.coalesce(after, nearest))
