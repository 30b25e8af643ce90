"""The extraction over files as they arrive: the batch operators unchanged, and a report by window.

Nulls, empty and very long texts, repeated rows and other columns count as in the batch operators; a
file is read once, whatever arrives later. Records are kept up over batches, also of documents without a doc_id (as one). Events without a time are let go; values that are null
or not finite count as events and add nothing; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.functions.patterns import FIELDS
from fieldloom.operators import extract
from fieldloom.sources.tables import TEXT_SCHEMA, stream


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived so far to a Parquet folder, each input file once, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def candidates_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, fields: dict[str, str] | None = None) -> DataFrame:
    """Candidates of the documents files of a folder, written to path; returns what is there now."""
    found = extract.candidates(stream(spark, folder, "documents*.parquet", TEXT_SCHEMA), fields)
    run_available(found, path, checkpoint)
    return spark.read.schema(found.schema).parquet(path)


def segments_stream(spark: SparkSession, folder: str, path: str, checkpoint: str) -> DataFrame:
    found = extract.segment(stream(spark, folder, "documents*.parquet", TEXT_SCHEMA))
    run_available(found, path, checkpoint)
    return spark.read.schema(found.schema).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of an event stream or table; rows later than `late` are let go.

    Values are added as decimals of 4 places, so that totals don't depend on the order of rows.
    """
    marked = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    # an infinite value is none of these decimals, and the cast gives null
    sums = marked.groupBy(F.window("at", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").try_cast("decimal(28,4)")).cast("double").alias("total"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def live_records(found: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A record a document as record(resolve()) makes it, as one aggregate by doc_id: over a stream, its state is each document's best match of each field so far."""
    fields = list(FIELDS) if fields is None else fields
    best = [F.min(F.when(F.col("field") == f, F.struct("n", "value"))).alias(f) for f in fields]
    return found.where(F.col("field").isin(fields)).groupBy("doc_id").agg(*best).select("doc_id", *[F.col(f"{f}.value").alias(f) for f in fields])


def upsert_records(found: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, fields: list[str] | None = None) -> StreamingQuery:
    """Hand the whole records of the documents that each micro-batch touches to an idempotent sink, with the batch's number.

    What earlier batches held of a document is in the stream's state, so that a record is the same
    whether its document comes in one batch or in many. State grows with the documents that have
    a field; it is kept as the session's state store keeps it.
    """
    return live_records(found, fields).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, files_per_batch: int = 1000, fields: dict[str, str] | None = None) -> DataFrame:
    """Records of the documents files of a folder, upserted into path; returns each document's last version.

    A batch's records are a folder of their own, written over if the batch is run again.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    found = extract.candidates(stream(spark, folder, "documents*.parquet", TEXT_SCHEMA, files_per_batch), fields)
    upsert_records(found, write, checkpoint, fields and list(fields)).awaitTermination()
    names = list(FIELDS if fields is None else fields)
    schema = ", ".join(["doc_id long", *[f"{f} string" for f in names], "batch long"])
    versions = spark.read.schema(schema).parquet(path)
    last = versions.groupBy("doc_id").agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return last.select("doc_id", *[F.col(f"r.{f}").alias(f) for f in names])
