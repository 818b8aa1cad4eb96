"""Studies, series and instances: filters, copies of a position, first rows and counts of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import checkpointing

#: The class of directory records, which are no images (a fixed value).
IGNORED_CLASSES = ("1.2.840.10008.1.3.10",)


def usable_instances(instances: DataFrame, uid: str = "sop_uid", kind: str = "sop_class_uid", ignored: tuple[str, ...] = IGNORED_CLASSES) -> DataFrame:
    return instances.where(F.col(uid).isNotNull() & F.col(kind).isNotNull() & ~F.col(kind).isin(*ignored))


def latest_of_position(instances: DataFrame, keys: list[str], position: Column, version: Column, ties: list[Column]) -> DataFrame:
    """One row for each key and position: the highest version (absent counts as -1), then the first by ties. Rows without a position all stay.

    Rows without a position never enter the window's shuffle as one key: they are dealt by their ties."""
    w = Window.partitionBy(*keys, position, F.when(position.isNull(), F.xxhash64(*ties))).orderBy(F.coalesce(version, F.lit(-1)).desc(), *ties)
    return instances.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") == 1) | position.isNull()).drop("_rank")


def first_of_group(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The given columns of each group's first row, by an aggregate that combines before the shuffle."""
    first = F.min_by(F.struct(*columns), order).alias("f")
    return rows.groupBy(*keys).agg(first).select(*keys, "f.*")


def group_counts(rows: DataFrame, keys: list[str], name: str = "n_instances") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def gated_mean(rows: DataFrame, keys: list[str], order: Column, tag: str, digits: int = 3, absent: str = "Tag Absent") -> DataFrame:
    """The tag's mean, rounded, where the group's first row has it; otherwise the given text."""
    agg = rows.groupBy(*keys).agg(F.min_by(F.struct(tag), order).alias("f"), F.avg(tag).alias("m"))
    return agg.select(*keys, F.when(F.col(f"f.{tag}").isNotNull(), F.round("m", digits).cast("string")).otherwise(F.lit(absent)).alias(f"mean_{tag}"))


def numbered(rows: DataFrame, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """rows with their place in the order (from 0) and, if named, how many there are; no task gets them all.

    Rows are sorted by range, and each range's places begin where the ranges before it end."""
    checkpointing(rows.sparkSession)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # ranges come from a sample, so they are fixed by a checkpoint before they are counted
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}).checkpoint()
    sizes = held.groupBy("_part").count()  # one row a partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_total"))
    out = held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_part", "_at", "_before", "_total")
