"""Form options: which box governs a place in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHECKED, UNCHECKED = "☒☑", "☐"


def governing_box(text: Column, position: Column) -> Column:
    """The last box on the position's line at or before the character after it, or null.  position counts from 0."""
    line = F.substring_index(F.substring(text, F.lit(1), position), "\n", -1)
    # a box that opens the span itself, or stands right before what follows, counts: two more characters
    near = F.concat(line, F.substring(text, position + 1, F.lit(2)))
    return F.nullif(F.regexp_extract(near, rf"(?s).*([{CHECKED}{UNCHECKED}])", 1), F.lit(""))


def unchecked_reason(text: Column, position: Column) -> Column:
    box = governing_box(text, position)
    return F.when(
        F.contains(F.lit(UNCHECKED), box),
        F.concat(F.lit("unchecked_option: the quote is a form option that was NOT selected ("), box, F.lit("); the value does not apply to this contract")),
    )
