"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset and all of Spark runs in
    this process (tests), a temporary folder, which is then set as the session's own; on
    a cluster that would be a folder of one machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="clausemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df computed once, as Parquet in the shared folder, and read back.

    Cuts the lineage: a lost executor costs no recomputation of what came before,
    and what is read twice is the same twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/clausemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
