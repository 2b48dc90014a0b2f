"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talliflow.session import shared_path, table
from talliflow.sources.sinks import split_sink


def table_stream(spark: SparkSession, d: str, name: str, files: int = 1000) -> DataFrame:
    """A table's files as a stream, ``files`` of them in a batch."""
    schema = table(spark, d, name).schema
    # a table is a file or a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result as a table in the shared folder."""
    spark = stream.sparkSession
    base = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/rows")
    else:  # each batch replaces the result
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def first_messages(stream: DataFrame) -> DataFrame:
    """One row per message ever seen: saves that repeat one are dropped by state."""
    return stream.where("input is not null").dropDuplicates(["input"]).select("input")


def daily_counts(stream: DataFrame, late: str = "180 days") -> DataFrame:
    """Conversations and outputs per day of arrival; rows later than ``late`` are no longer counted."""
    rows = stream.withWatermark("ingested_at", late)
    return rows.groupBy(F.window("ingested_at", "1 day").alias("w")).agg(
        F.count("*").alias("conversations"), F.sum(F.coalesce(F.size("outputs"), F.lit(0))).alias("outputs")
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "conversations", "outputs")


def validated(stream: DataFrame, valid: str, good: str, bad: str, state: str, seconds: int = 5) -> StreamingQuery:
    """Batches of generated rows, valid ones appended to one place and others to another, at most one batch in so many seconds."""
    return (
        stream.writeStream.foreachBatch(lambda df, _: split_sink(df, valid, good, bad))
        .option("checkpointLocation", state)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )
