"""Measurements: volumes of labels, ensembles of models, parts of graphs."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import PlanError


def label_volumes(counts: DataFrame, n: str, voxel_mm3: Column, digits: int = 0, truncate: bool = False) -> DataFrame:
    """counts with volume_ml: voxels times their size over 1000, rounded half to even (or rounded, then cut to whole)."""
    ml = F.bround(F.col(n) * F.abs(voxel_mm3) / 1000.0, 2 if truncate else digits)
    return counts.withColumn("volume_ml", ml.cast("long"))


def softmax(v: Column, keys: list[str]) -> Column:
    """exp(v) over its group's sum, shifted by the group's largest value."""
    w = Window.partitionBy(*keys)
    e = F.exp(v - F.max(v).over(w))
    return e / F.sum(e).over(w)


def softmax_of(values: Column) -> Column:
    """The same within an array."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.element_at(F.transform(F.array(e), lambda x: F.transform(x, lambda y: y / F.aggregate(x, F.lit(0.0), lambda a, z: a + z))), 1)


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def ensemble(predictions: DataFrame, item: list[str], klass: str, prob: str) -> DataFrame:
    """(item, class, prob): the class of largest mean probability over models; ties go to the smaller class."""
    mean = predictions.groupBy(*item, klass).agg(F.avg(prob).alias("_p"))
    best = F.max_by(F.struct(klass, "_p"), F.struct(F.col("_p"), (-F.col(klass)).alias("_t"))).alias("b")
    return mean.groupBy(*item).agg(best).select(*item, F.col(f"b.{klass}").alias(klass), F.col("b._p").alias(prob))


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine only where all runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise PlanError(f"spark.checkpoint.dir is unset; with master {master} it must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cairn-')}"
    return root.rstrip("/")


def checkpointing(spark: SparkSession) -> None:
    """Sees that checkpoints have a folder: the cluster's shared one, a local one only where none is named."""
    root = shared_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)


def connected(edges: DataFrame, most_rounds: int = 60, within: str | None = None) -> DataFrame:
    """(a, b): for each vertex that isn't its part's smallest, that smallest. Stars by turns; each round is checkpointed in the shared folder.

    within: a column that is never null (a struct of columns that may be) and whose values have vertices of their own."""
    checkpointing(edges.sparkSession)
    of = [within] if within else []
    now = edges.where("a <> b").select(*of, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64(*of, "a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now
        seen = mark
        both = now.unionByName(now.select(*of, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*of, "a").agg(F.least("a", F.min("b")).alias("m"))
        up = both.join(low, [*of, "a"]).where("b > a").select(*of, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = up.groupBy(*of, "a").agg(F.min("b").alias("m"))
        now = up.join(low, [*of, "a"]).where("b <> m").select(*of, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(*of, "a", F.col("m").alias("b"))).distinct().checkpoint()
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
