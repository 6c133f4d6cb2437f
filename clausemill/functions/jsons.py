"""JSON out of a model's answer."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])


def first_object(raw: str) -> tuple[str | None, str | None]:
    """The first balanced {...} of a text, strings and escapes heeded, or what is wrong."""
    start = raw.find("{")
    if start < 0:
        return None, f"model_returned_no_json: {raw[:200]!r}"
    depth, quoted, at = 0, False, start
    while at < len(raw):
        c = raw[at]
        if quoted and c == "\\":
            at += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return raw[start : at + 1], None
        at += 1
    return None, f"model_returned_truncated_json: {raw[:200]!r}"


@functools.cache
def first_object_udf():
    @F.pandas_udf(RESULT)
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if r is None else first_object(r) for r in raw], columns=["json", "error"])

    return run
