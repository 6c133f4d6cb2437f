"""The Parquet store: tables keyed by document, replaced and deleted by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES

BUCKETS = 64
#: Files that a bucket is written as, so that no task writes a whole one.
BUCKET_FILES = 8


def replaced(old: DataFrame, new: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """old without the documents of keys (those of new), and new."""
    keys = (new if keys is None else keys).select("document_id").distinct()
    return old.join(keys, "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.select("document_id").distinct(), "document_id", "left_anti")


class Store:
    """Tables under a path, partitioned by a hash bucket of document_id: a change rewrites the buckets it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, document_id="document_id"):
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def read(self, table: str, document_id: str | None = None) -> DataFrame:
        """The table, or a document's rows, for which only its bucket is read; empty before the first write.

        Columns added to the schema since are null.
        """
        schema = TABLES[table]
        try:
            found = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        if document_id is not None:
            found = found.where(F.col("bucket") == self._bucket(F.lit(document_id))).where(F.col("document_id") == document_id)
        return found.select(*((F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def _rewrite(self, table: str, keys: DataFrame, new: DataFrame | None) -> None:
        schema = TABLES[table]
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if new is None and not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return
        touched = keys.select(self._bucket().alias("bucket")).distinct()
        old = self.read(table).withColumn("bucket", self._bucket()).join(F.broadcast(touched), "bucket", "left_semi")
        out = old.join(keys.select("document_id").distinct(), "document_id", "left_anti")
        if new is not None:
            out = out.unionByName(new.withColumn("bucket", self._bucket()), allowMissingColumns=True)
        out = out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema), "bucket")
        # read and written paths are one: the new buckets are staged first
        staged = f"{self.path}/_staged_{table}"
        out.write.mode("overwrite").parquet(staged)
        gone = [r[0] for r in touched.join(self.spark.read.parquet(staged).select("bucket").distinct(), "bucket", "left_anti").collect()]
        self.spark.read.parquet(staged).repartition("bucket", F.pmod(F.hash("document_id"), F.lit(BUCKET_FILES))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{table}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in [staged, *(f"{self.path}/{table}/bucket={b}" for b in gone)]:  # at most as many as buckets
            p = hadoop(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def put(self, table: str, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Replaces all rows of the documents of keys (those of rows) by rows."""
        self._rewrite(table, rows if keys is None else keys, rows)

    def delete(self, keys: DataFrame, *tables: str) -> None:
        """Deletes documents from the tables named, or from all."""
        for table in tables or TABLES:
            self._rewrite(table, keys, None)

    def documents(self) -> DataFrame:
        return self.read("documents").orderBy(F.desc("uploaded_at"), "document_id")

    def of_document(self, table: str, document_id: str) -> DataFrame:
        order = {"doc_pages": ["page"], "chunks": ["page", "index_in_page"], "obligations": ["ordinal"]}.get(table, ["document_id"])
        return self.read(table, document_id).orderBy(*order)

    def count(self) -> int:
        return self.read("documents").count()
