"""Column builders against tables of inputs and answers."""

import pytest
from pyspark.sql import functions as F

from clausemill.functions import checkbox, dates, jsons, text, values, vectors


def column(spark, rows, build, kinds="a string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {kinds}")
    made = df.select("i", build(*(F.col(c) for c in df.columns[1:])).alias("x")).collect()
    return [r.x for r in sorted(made, key=lambda r: r.i)]


def test_dates(spark):
    cases = {
        "2026-03-31": "2026-03-31", "ends 2026/3/1.": "2026-03-01", "March 31, 2026": "2026-03-31", "on Sept. 5th 2024": "2024-09-05", "the 31st day of March, 2026": "2026-03-31", "1 Jan 2030": "2030-01-01",
        "03/04/2026": "2026-03-04", "13/01/2026": "2026-01-13", "": None, "soon": None, "2026-02-30": None, "2026-13-01, that is March 1, 2026": None, None: None, "February 29, 2025": None,
    }
    got = column(spark, list(cases), lambda a: F.date_format(dates.parsed_date(a), "yyyy-MM-dd"))
    assert dict(zip(cases, got, strict=True)) == cases


def test_durations(spark):
    cases = {
        "P60D": "P60D", "P1Y6M": "P1Y6M", "p2w": "P14D", "P": None, "P0D": "P0D", "60 days": "P60D", "60days": "P60D", "sixty (60) days' notice": "P60D", "three (3) months": "P3M", "one hundred eighty days": "P180D", "two years": "P2Y",
        "ninety calendar days": "P90D", "two hundred and seventy days": "P70D", "thirty-six months": "P36M", "a week": "P7D", "promptly": None, "": None, None: None, "twelve (12) months or 30 days": "P12M", "99999 days": None,
    }
    got = column(spark, list(cases), lambda a: dates.iso_duration(dates.parsed_duration(a)))
    assert dict(zip(cases, got, strict=True)) == cases


@pytest.mark.parametrize(
    ("operation", "anchor", "period", "want"),
    [
        ("notice_deadline", "2026-03-31", "P60D", "2026-01-30"),
        ("notice_deadline", "March 31, 2024", "P1M", "2024-02-29"),
        ("notice_deadline", "2024-05-31", "3 months", "2024-02-29"),
        ("renewal_option_deadline", "2031-01-31", "90 days", "2030-11-02"),
        ("renewal_date", "2024-01-31", "P1M1D", "2024-03-01"),
        ("renewal_date", "2024-02-29", "P1Y", "2025-02-28"),
    ],
)
def test_deadlines(spark, operation, anchor, period, want):
    r = spark.range(1).select(dates.deadline(operation, F.lit(anchor), F.lit(period)).alias("c")).first().c
    assert r.result.isoformat() == want and r.error is None and r.inputs["evaluated"].endswith(f"= {want}") and r.formula.startswith(operation)


def test_deadline_errors_and_days(spark):
    r = spark.range(1).select(dates.deadline("notice_deadline", F.lit("soon"), F.lit("P1D")).alias("a"), dates.deadline("notice_deadline", F.lit("2024-01-01"), F.lit("soon")).alias("b"), dates.days_until(F.lit("2024-03-01").cast("date"), F.lit("2024-02-28").cast("date")).alias("d")).first()
    assert r.a.error == "unparseable_date: 'soon'" and r.b.error == "unparseable_duration: 'soon'" and r.a.result is None and r.d == 2


def test_all_dates_and_durations_of_a_clause(spark):
    clause = "commence on February 1, 2026, not 2026-02-30, and end on 31 January 2031; terms of sixty (60) months unless notice of non-renewal two hundred and seventy (270) days before"
    df = spark.createDataFrame([(clause,)], "t string")
    r = df.select(dates.find_dates_udf()("t").alias("d"), dates.find_durations_udf()("t").alias("p")).first()
    assert [x.iso for x in r.d] == ["2026-02-01", "2031-01-31"] and [x.iso for x in r.p] == ["P60M", "P270D"]
    assert all(clause[x.at :].startswith(x.text) for x in [*r.d, *r.p])
    pick = lambda word: spark.createDataFrame([(clause,)], "t string").select(dates.for_anchor(dates.find_durations_udf()("t"), F.lit(clause.index(word)) if word else F.lit(None).cast("int")).alias("x")).first().x
    assert (pick("terms"), pick("notice"), pick("before"), pick(None)) == ("P60M", "P270D", "P270D", "P60M")


def test_money_and_percent(spark):
    cases = {
        "USD 120,000.00": "USD 120000.00", "$1.5 million": "USD 1500000.00", "€ 20": "EUR 20.00", "5,000 dollars": "USD 5000.00", "2 thousand pounds": "GBP 2000.00", "CHF 12": "CHF 12.00",
        "within 30 days": None, "the preceding 12 months": None, "": None, "usd 3": "USD 3.00", "£1,234,567.891": "GBP 1234567.89",
    }
    assert dict(zip(cases, column(spark, list(cases), values.money), strict=True)) == cases
    cases = {"4%": "4%", "3.50 percent": "3.5%", "10 %": "10%", "by 0.25%": "0.25%", "100%": "100%", "none": None, "12.345678%": "12.3457%", "007%": "7%"}
    assert dict(zip(cases, column(spark, list(cases), values.percent), strict=True)) == cases


def test_normalized_values(spark):
    rows = [
        ("contract_end_date", "the end", "until March 31, 2026"),
        ("termination_notice_period", "P0D", "sixty (60) days"),
        ("renewal_duration", "one year", ""),
        ("automatic_renewal", "true", "shall automatically renew"),
        ("automatic_renewal", "true", "This Lease may be renewed"),
        ("automatic_renewal", "no", ""),
        ("automatic_renewal", "x", "y"),
        ("liability_cap", "", "shall not exceed the fees received."),
        ("payment_obligation", "$5", ""),
        ("payment_obligation", "soon", "later"),
        ("fee_escalation", "x", "by 4 percent"),
        ("governing_law", "  Delaware ,", ""),
        ("indemnification", " a\n b ", ""),
        ("indemnification", "  ", ""),
    ]
    want = ["2026-03-31", "P60D", "P1Y", "true", "false", "false", None, "shall not exceed the fees received", "USD 5.00", None, "4%", "Delaware", "a b", None]
    assert column(spark, rows, values.normalized_value, "a string, b string, c string") == want


def test_types(spark):
    cases = {"Term Start": "contract_start_date", "indemnity-cap": "liability_cap", "governing_law": "governing_law", "colour": None, " LAW ": "governing_law"}
    assert dict(zip(cases, column(spark, list(cases), values.canonical_type), strict=True)) == cases


def test_text(spark):
    assert column(spark, ["a\r\nb\rc", "termi-\nnation", "x  \ny", "a\n\n\n\nb", "  z  "], text.cleaned_page) == ["a\nb\nc", "termination", "x\ny", "a\n\nb", "z"]
    assert column(spark, ["Net 60 Days, 2026!", "é1", ""], text.tokens) == [["net", "60", "days", "2026"], ["1"], []]
    for raw, want in {"  “Quoted” text…  ": '"quoted" text...', "ﬁne Straße": "fine strasse", "a­b​c": "abc", "– —": "- -", "": "", "\n\t": ""}.items():
        norm, offsets = text.normalized_with_offsets(raw)
        assert norm == want == text.normalized(raw) and len(offsets) == len(norm) and offsets == sorted(offsets)
    assert column(spark, ["Straße  X", None], text.normalize_udf()) == ["strasse x", None]


def test_boxes(spark):
    form = "☐ 1% a year\n☒ 3% each term\nplain line"
    at = [(form, form.index("1%")), (form, 0), (form, form.index("3%")), (form, form.index("plain")), (form, form.index("term")), ("☐", 0)]
    assert column(spark, at, checkbox.governing_box, "a string, b int") == ["☐", "☐", "☒", None, "☒", "☐"]
    assert [x is not None for x in column(spark, at, checkbox.unchecked_reason, "a string, b int")] == [True, True, False, False, False, True]


def test_json_objects(spark):
    cases = ['```json\n{"a": "}"}\n``` bye', 'so {"a": {"b": "\\"}"}} and {', "none", '{"a": 1', None]
    got = column(spark, cases, jsons.first_object_udf())
    assert [g.json for g in got] == ['{"a": "}"}', '{"a": {"b": "\\"}"}}', None, None, None]
    assert got[2].error.startswith("model_returned_no_json") and got[3].error.startswith("model_returned_truncated_json")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.unit(F.col("a")).alias("u")).collect()
    assert r[0].c == pytest.approx(0.96) and r[1].c == 0 and r[0].u == pytest.approx([0.6, 0.8]) and r[1].u == [0, 0]
    e = spark.createDataFrame([("rent rent due",), ("RENT due",), ("",), (None,)], "t string").select(vectors.hashing_encoder(32)(F.col("t")).alias("e")).collect()
    assert sum(x * x for x in e[0].e) == pytest.approx(1) and not any(e[2].e) and len(e[1].e) == 32


def test_offsets_of_letters_that_stay_single_equal_those_of_the_general_way():
    for raw in ["", " ", "  a  B\t c  ", "’x – Y", "a" * 5 + " \n", "Été \ud800 z"]:
        short, long = text.normalized_with_offsets(raw), text.normalized_with_offsets(raw + "…")  # three points for one
        assert short[0] == text.normalized(raw) and long[0] == text.normalized(raw + "…")
        assert long[0][: len(short[0])] == short[0] and long[1][: len(short[1])] == short[1]
        assert all(isinstance(i, int) for i in short[1])
