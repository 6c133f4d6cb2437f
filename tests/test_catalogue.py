"""Every registered query of this package against its SQL in DuckDB, on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from clausemill.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(pdf):
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        want = sql.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_entry_works_without_what_only_the_training_data_operators_need():
    code = "import sys, warnings; sys.modules['regex'] = None; sys.modules['tiktoken'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; assert 'obligations_e2e' in e.queries() and not any(k.startswith('op') and k[2:3].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_claims_are_verified_as_their_sql_says_where_another_page_resembles_the_quote(spark, tmp_path):
    half = "The tenant keeps the roof, the walls and every window of the house in good repair at all times"
    page = f"{half}, {'and so on ' * 5}"
    text = page + page.replace("window", "windov") + page  # three equal thirds; the second has another letter
    docs = spark.createDataFrame([(i, text, "x") for i in range(1, 300, 3)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["verify_claimed_page"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(SQL["verify_claimed_page"]).df())
    assert got["reason"].str.startswith("wrong_page").any()


def test_the_context_of_a_corpus_writes_no_table_larger_than_its_vocabulary(spark, monkeypatch):
    from clausemill.operators import search

    kept, staged = [], search.staged
    monkeypatch.setattr(search, "staged", lambda df, name: kept.append(staged(df, name)) or kept[-1])
    assert entry.queries()["context_union"](spark, SF).count()
    terms = entry.queries()["term_idf"](spark, SF).count()
    assert max(t.count() for t in kept) <= terms + 1
