"""A watched folder: new files are ingested as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources import files


def watched(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)


def ingesting(engine: Engine, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """New files' documents, pages, chunks and vectors replace those of the same content; a batch that is run again changes nothing."""

    def batch(raw: DataFrame, _: int) -> None:
        engine.take(files.classified(raw.select("path", "content")))

    writer = watched(engine.spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
