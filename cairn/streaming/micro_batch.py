"""Batch plans over a file stream, one micro-batch at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import shared_root


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """The folder's files, so many a micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def each_file(spark: SparkSession, folder: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet", files_per_trigger: int = 1) -> StreamingQuery:
    """Calls sink on each micro-batch of so many files until the folder is exhausted; then the query ends by itself."""
    stream = file_stream(spark, folder, schema, fmt, files_per_trigger)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Enough(Exception):
    """Ends a stream before its next batch."""


def until(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, batches: int | None = None, mode: str = "append") -> int:
    """Runs the stream until it is exhausted, or until so many micro-batches have ended; gives how many have.

    The stop comes when the batch after the last asks for its sink: those before it are committed by then, and it has done
    nothing, so it runs, under its number, when the stream goes on from its checkpoint. sink must overwrite by that number."""
    done = []

    def counted(df: DataFrame, batch: int) -> None:
        if batches is not None and len(done) >= batches:
            raise _Enough
        sink(df, batch)
        done.append(batch)

    query = stream.writeStream.outputMode(mode).foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if batches is None or len(done) < batches:
            raise
    return len(done)


def run_batches(spark: SparkSession, folder: str, schema, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """The batch plan on each micro-batch; a batch that runs again overwrites its own folder, so results are exactly once."""

    def sink(df: DataFrame, batch: int) -> None:
        plan(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    each_file(spark, folder, schema, sink, checkpoint, fmt).awaitTermination()
    return spark.read.parquet(out)


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/cairn-stream-{uuid.uuid4().hex}"


def replayed(spark: SparkSession, rows: DataFrame, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows written as files, then streamed through the plan file by file."""
    root = shared_folder(spark)
    rows.repartition(3).write.parquet(f"{root}/in")
    return run_batches(spark, f"{root}/in", rows.schema, plan, f"{root}/out", f"{root}/checkpoint").drop("batch")
