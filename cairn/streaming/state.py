"""Counters that live on between micro-batches, and after a restart, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import micro_batch

#: The store that keeps state on disk, not on the heap (a fixed value).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tallied(stream: DataFrame, keys: list[str], value: Column, spread: Column, salts: int = 8) -> DataFrame:
    """(keys, salt, n, total): standings of counters over all batches so far, for what this batch touched.

    A streaming aggregate: a batch's rows are added up before the shuffle, and counters never leave the JVM. Each key has
    ``salts`` counters, so a key with a third of the rows is counted by that many tasks; ``totals`` adds them up. value:
    whole numbers, null counts as 0. Nulls among the keys are keys like others."""
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int").alias("salt")
    rows = stream.select(*keys, salt, F.coalesce(value.cast("long"), F.lit(0)).cast("long").alias("value"))
    return rows.groupBy(*keys, "salt").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def totals(standings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, total) of written standings (with their batch): the last of each counter, added up."""
    last = standings.groupBy(*keys, "salt").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.groupBy(*keys).agg(F.sum("s.n").alias("n"), F.sum("s.total").alias("total"))


def count_files(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], value: Column, spread: Column, out: str, checkpoint: str, batches: int | None = None, salts: int = 8) -> DataFrame:
    """Counts a folder's files, one a micro-batch, into out, and gives ``totals`` so far.

    Ends after so many batches, or when no file is left; called again, it goes on where it was, with the counters that it
    had. A batch that runs twice overwrites what it wrote, and state belongs to its batch, so nothing is counted twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = micro_batch.file_stream(spark, folder, schema)
    micro_batch.until(tallied(stream, keys, value, spread, salts), sink, checkpoint, batches, "update")
    return totals(spark.read.parquet(out), keys)
