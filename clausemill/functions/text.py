"""Cleaning, tokens and normalisation of text."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Line ends besides \n: what text split into lines is split on.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: White space, as the inside of a character class; in Java's patterns (whose \s is ASCII only) and Python's alike.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{BLANK}]"

# Characters that take another form before quotes are compared.
PUNCTUATION = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "ʼ": "'", "´": "'", "`": "'",
    "“": '"', "”": '"', "„": '"', "″": '"',
    "–": "-", "—": "-", "―": "-", "−": "-", "‐": "-", "‑": "-",
    "…": "...",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ", "\u2028": " ", "\u2029": " ",
    "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
    "•": "*", "·": "*",
}
# End of fixed values.


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def preview(quote: Column, most: int = 60) -> Column:
    """A quote on one line, in quotation marks, cut after so many characters."""
    flat = collapsed(quote)
    return F.concat(F.lit('"'), F.substring(flat, 1, most), F.when(F.length(flat) > most, F.lit('…"')).otherwise(F.lit('"')))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def cleaned_page(raw: Column) -> Column:
    """Line ends to \\n, words hyphenated over a line end joined, trailing blanks and extra blank lines out."""
    out = F.regexp_replace(raw, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return stripped(out)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """What comparison of quotes amounts to for text whose only unusual letter is sharp s: built-in functions only."""
    return F.replace(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), F.lit("ß"), F.lit("ss"))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def normalized_ascii(text: Column) -> Column:
    """normalized() for text that is_ascii(): built-in functions only."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("`"), F.lit("'")), r"[\x09-\x0d\x1c-\x20]+", " "))


@functools.cache
def folding_table() -> dict[int, str]:
    """Code point -> what it becomes: punctuation, white space, else compatibility form and case fold."""
    out = {}
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        form = PUNCTUATION[c] if c in PUNCTUATION else " " if c.isspace() else unicodedata.normalize("NFKC", c).casefold()
        if form != c:
            out[point] = form
    return out


def normalized(text: str) -> str:
    """The form in which quotes are compared."""
    return _squeezed(text.translate(folding_table()))


def _squeezed(text: str) -> str:
    return " ".join(x for x in text.split(" ") if x)


def normalized_with_offsets(text: str) -> tuple[str, list[int]]:
    """normalized(text), and for each of its characters the place in text that it came from."""
    table = folding_table()
    if all(len(table.get(ord(c), c)) == 1 for c in set(text)):
        points = np.frombuffer(text.translate(table).encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = points == 32
        kept = np.flatnonzero(~(blank & np.concatenate(([True], blank[:-1])))) if len(points) else points
        kept = kept[:-1] if len(kept) and blank[kept[-1]] else kept
        return points[kept].tobytes().decode("utf-32-le", "surrogatepass"), kept.tolist()
    out: list[str] = []
    offsets: list[int] = []
    for i, c in enumerate(text):
        for made in table.get(ord(c), c):
            if made == " " and (not out or out[-1] == " "):
                continue
            out.append(made)
            offsets.append(i)
    if out and out[-1] == " ":
        out.pop()
        offsets.pop()
    return "".join(out), offsets


@functools.cache
def normalize_udf():
    """normalized() as a vectorised function, for text that folded() does not cover."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else normalized(t))

    return run


def content_id(content: Column, given: Column | None = None) -> Column:
    """given, or 'contract_' and the first 12 hex digits of the content's SHA-256."""
    own = F.concat(F.lit("contract_"), F.substring(F.sha2(content, 256), 1, 12))
    return own if given is None else F.coalesce(given, own)
