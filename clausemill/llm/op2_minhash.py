"""Near-duplicate documents by min-max hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .neardup import clustered, sets_of, signed
from .scratch import discarded, written

#: 24 bands of 5 rows: a pair at similarity 0.85 shares a band but for 8 in ten million.
BANDS, ROWS = 24, 5


def _document_sets(batch: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    data, offsets = K.flat(batch.column("text"))
    starts, ends, bounds = K.word_spans(data, offsets)
    values, cut = K.distinct(*K.shingles(K.hash_words(data, starts, ends), bounds))
    return [batch.column("doc_id"), batch.column("row")], values, cut


def _grouped(source: DataFrame, num: int, den: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of source (doc_id, row, text): each row's doc_id, row, n and cid; and each class's home:
    cid, and the least (no_id, doc_id, row) of its component, as rep.

    row tells rows of one id apart; a null id counts as greater than any other.
    """
    names = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType())])
    units = written(signed(source, "text", _document_sets, names, bands, rows), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = written(units.where("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), first.alias("rep")), "classes")
    found = written(clustered(classes.select("cid", "n", "bands", "sig"), lambda wanted: sets_of(source, "text", _document_sets, wanted), num, den), "clustered")
    linked = classes.select("cid", "rep").join(found, "cid", "left")
    least = linked.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    home = written(linked.join(least, "comp", "left").select("cid", F.coalesce("least", "rep").alias("rep")), "home")
    discarded(classes, found)
    return units.select("doc_id", "row", "n", "cid"), home


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A document's set is its distinct 5-word shingles, A-Z lower-cased; two
    documents are linked when den * intersection >= num * union, confirmed on
    full sets (of 64-bit shingle hashes).  component_id is the least id reachable
    by links, kept whether it is the row's own.

    Null and empty texts, and texts of white space, have n_shingles 0, no link
    and themselves as component.  A text of fewer than five words is one shingle.
    Repeated rows fall into one component; if they also repeat the least id, all
    of them have kept = true.  Rows of one id with different texts are documents
    of their own: each has the component of its text.  A null id never is a
    component's least id unless all are null; then component_id is null and kept
    true.  Other columns are ignored.  An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col(text_col).alias("text"))
    units, home = _grouped(source, num, den, bands, rows)
    out = units.join(home.select("cid", F.col("rep.doc_id").alias("component_id")), "cid", "left")
    out = out.withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row for each component; the columns stay.

    The row that stays is the one of least id, a null id counting as greater than
    any other; among rows of that id the one whose columns' hash is least, so
    rows that repeat an id with other texts are told apart and no text is lost.
    Of rows equal in all columns one stays.  Rows whose text is null or has no
    word are copies of nothing and all stay, repeated ones too.  An empty table
    gives an empty result.
    """
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row, ident = F.xxhash64(*hashable), F.col(f"`{id_col}`").cast("long")
    worded = F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    units, home = _grouped(docs.where(worded).select(ident.alias("doc_id"), row.alias("row"), F.col(f"`{text_col}`").alias("text")), num, den, bands, rows)
    kept = written(home.select("rep.*").distinct().select(F.coalesce("doc_id", F.lit(0)).alias("_kept_id"), F.col("no_id").alias("_kept_null"), F.col("row").alias("_kept_row")), "kept")
    # plain keys, so that join and repeats share one shuffle of the texts
    named = docs.where(worded).select("*", F.coalesce(ident, F.lit(0)).alias("_of_id"), ident.isNull().alias("_of_null"), row.alias("_of_row"))
    same = (F.col("_of_id") == F.col("_kept_id")) & (F.col("_of_null") == F.col("_kept_null")) & (F.col("_of_row") == F.col("_kept_row"))
    named = named.join(kept, same, "left_semi").dropDuplicates(["_of_id", "_of_null", "_of_row"])
    return named.drop("_of_id", "_of_null", "_of_row").unionByName(docs.where(~worded))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
