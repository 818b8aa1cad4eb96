"""What the operators of this subpackage share: reading tables, written intermediate tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: By application, the folder of this machine where none is named.
_LOCAL: dict[str, str] = {}


#: A table below this may be one row group, which one task reads alone; its rows are dealt to all cores.
SMALL_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of this machine only where all runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is unset; with master {master} it must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL[app] = _LOCAL.get(app) or f"file://{tempfile.mkdtemp(prefix='cairn-')}"
    return root.rstrip("/")


def stored(df: DataFrame, label: str, row_group: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here, and a lost executor costs no recomputation.

    row_group: bytes of a row group, for tables of long rows. Give it back with ``discard`` when no later plan reads it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cairn-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def bucketed(df: DataFrame, buckets: int, key: str, label: str) -> DataFrame:
    """As ``stored``, dealt by key into buckets, so that what is grouped or joined by the key time and again isn't shuffled again."""
    spark = df.sparkSession
    name = f"cairn_{label}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.read.table(name)
    out._cairn_path, out._cairn_table = path, name
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` or ``bucketed`` wrote."""
    if name := getattr(df, "_cairn_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path := getattr(df, "_cairn_path", None):
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n)).cast("int")


#: Bytes of an Arrow batch between an executor and a worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has the session hand rows to workers in batches of BATCH_BYTES, where the engine's own are 16 times as large.

    A batch lies in the executor, outside its heap, and in the worker, for each task; operators cut it into slices anyway."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, at: int) -> list[str]:
    """The texts of a column; a null text counts as the empty one."""
    return [x or "" for x in batch.column(at).to_pylist()]


def bytes_of(batch: pa.RecordBatch, at: int) -> list[bytes]:
    """The UTF-8 bytes of a column of texts; a null text counts as the empty one."""
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def looked_up(left: DataFrame, right: DataFrame, key: str, hot: Column, spread: Column) -> DataFrame:
    """left with right's columns by the string column ``key``, one row of right a key; null where right has none.

    hot: a condition on right's rows which the caller has proved to hold for few (say, keys that a thousandth of all rows
    share, of which there are a thousand at most). Those are broadcast, and left's rows that they serve are then dealt by
    ``spread`` instead of by their key, so that no key's rows meet in one task."""
    more = [c for c in right.columns if c != key]
    packed = right.select(F.col(key).alias("k_"), F.struct(*more).alias("v_"), hot.alias("hot_"))
    few = packed.where("hot_").select(F.col("k_").alias("hot_k_"), F.col("v_").alias("hot_v_"))
    half = left.join(F.broadcast(few), left[key] == F.col("hot_k_"), "left")
    served = F.col("hot_k_").isNotNull() | F.col(key).isNull()
    half = half.withColumns({"served_": served, "at_": F.when(served, F.hex(F.xxhash64(spread))).otherwise(F.col(key))})
    rest = packed.where(~F.col("hot_")).select(F.lit(False).alias("not_served_"), "k_", "v_")
    both = half.join(rest, (F.col("served_") == F.col("not_served_")) & (F.col("at_") == F.col("k_")), "left")
    found = F.coalesce("hot_v_", "v_")
    return both.select(*[F.col(c) for c in left.columns], *[found[c].alias(c) for c in more])
