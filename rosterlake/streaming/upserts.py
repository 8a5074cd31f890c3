"""Batches that arrive as files, put into all tables as a stream.

Each file holds numbered batches. Structured Streaming keeps track of the files;
each micro-batch is one commit of all tables, their log and the lines that could
not be read. A batch that comes again changes nothing, and one that comes late
overwrites nothing that a later one has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans import ingest
from ..sources import documents


def start(spark: SparkSession, source: str, database: str, checkpoint: str, at: str, files_per_batch: int = 100, once: bool = False) -> StreamingQuery:
    """A running query into a database (see ingest.database); at is the time that its log gives. With once it takes what is there and ends."""
    db = ingest.database(spark, database)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    writer = lines.writeStream.foreachBatch(lambda batch, _: ingest.apply(db, documents.from_lines(batch, schemas.BATCH), at) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of a stream (or table) of events; rows later than late are dropped by a stream."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
