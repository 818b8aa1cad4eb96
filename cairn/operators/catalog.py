"""A catalogue of models: lists, filters and look-ups with a fall-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(lists: list[DataFrame]) -> DataFrame:
    """All lists one after the other; repeats stay."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def detailed(models: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """models with the given columns taken from details where it has the key, else their own."""
    d = details.select(key, F.struct(*columns).alias("_d"))
    joined = models.join(d, key, "left")
    return joined.withColumns({c: F.when(F.col("_d").isNotNull(), F.col(f"_d.{c}")).otherwise(F.col(c)) for c in columns}).drop("_d")


def first_config(models: DataFrame, configs: DataFrame, key: str, order: str) -> DataFrame:
    """models with the first configuration of their key, if any."""
    w = Window.partitionBy(key).orderBy(order)
    return models.join(configs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), key, "left")


def tested(models: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    return models.join(verified.select(key).distinct(), key, "left_semi")


def summary(models: DataFrame, bundle: Column, verified: Column) -> DataFrame:
    return models.agg(F.count("*").alias("total"), F.count_if(bundle).alias("bundles"), F.count_if(verified).alias("verified"))


def preferred_file(files: DataFrame, keys: list[str], path: str, patterns: list[str]) -> DataFrame:
    """Of each group the file that the earliest pattern matches, then the first by path; groups without a match go."""
    place = F.coalesce(*[F.when(F.col(path).rlike(p), F.lit(k)) for k, p in enumerate(patterns)])
    return files.withColumn("_p", place).where("_p IS NOT NULL").groupBy(*keys).agg(F.min_by(path, F.struct("_p", path)).alias(path))
