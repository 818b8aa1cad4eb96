"""Detections: boxes against ordered places, bands of probability, suppression of overlapping boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, boxes: DataFrame, keys: list[str], at: str, low: str, high: str, width: float, most_buckets: int = 100_000) -> DataFrame:
    """points ⋈ boxes on keys and low <= at <= high, as an equi-join on buckets of the given width.

    A box stands in each bucket that it touches and a point in one, so no pair is made twice and none is lost; the work
    follows the matches, and a hot key is spread over its buckets. A box of more than most_buckets raises: the width is
    far too small for it."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    too_wide = F.raise_error(F.concat(F.lit(f"a box touches too many buckets of width {width}: "), F.col(low).cast("string"), F.lit(" to "), F.col(high).cast("string")))
    ends = F.when(bucket(high) - bucket(low) > most_buckets, too_wide.cast("long")).otherwise(bucket(high))
    spread = boxes.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), ends)))
    return points.withColumn("_bucket", bucket(at)).join(spread, [*keys, "_bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


def orphans(boxes: DataFrame, matched: DataFrame, box_key: list[str]) -> DataFrame:
    """Boxes that met no place."""
    return boxes.join(matched.select(*box_key).distinct(), box_key, "left_anti")


def band(percent: Column) -> Column:
    return F.when(percent > 80, "present").when(percent > 15, "indeterminate").otherwise("absent")


def best(detections: DataFrame, keys: list[str], score: str = "score", least: float = 0.1, k: int = 1000, ties: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *(ties or []))
    return detections.where(F.col(score) >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suppressed(boxes: np.ndarray, order: np.ndarray, overlap: float, most: int) -> list[int]:
    """Greedy choice in the given order: a box stays unless it overlaps one that stayed. boxes: (n, 2d), lows then highs."""
    d = boxes.shape[1] // 2
    low, high = boxes[:, :d], boxes[:, d:]
    size = np.prod(np.maximum(high - low, 0), axis=1)
    kept: list[int] = []
    alive = np.ones(len(boxes), bool)
    for i in order:
        if not alive[i]:
            continue
        kept.append(int(i))
        if len(kept) == most:
            break
        inner = np.prod(np.maximum(np.minimum(high, high[i]) - np.maximum(low, low[i]), 0), axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            alive &= ~(np.nan_to_num(inner / (size + size[i] - inner)) > overlap)
    return kept


def non_maximum(detections: DataFrame, image: str = "image_id", box: str = "box", score: str = "score", overlap: float = 0.22, least: float = 0.1, candidates: int = 1000, most: int = 100, ties: list[str] | None = None) -> DataFrame:
    """At most `most` boxes an image by greedy suppression over its best candidates. Groups are bounded by `candidates`.

    Of equal scores the smaller box counts first, of equal boxes that which comes first by ties: name columns that tell rows
    apart, or which of two such rows stays depends on how rows arrive."""
    top = best(detections, [image], score, least, candidates, [F.col(box), *map(F.col, ties or [])])

    def run(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
        rows = groups.sort_values("rank", kind="stable")
        return rows.iloc[suppressed(np.array(rows[box].tolist(), float), np.arange(len(rows)), overlap, most)]

    return top.groupBy(image).applyInPandas(run, top.schema)


def findings_of(boxes: DataFrame, slices: DataFrame, keys: list[str], id_: str = "box_id", box: str = "box", score: str = "score", z: str = "z") -> DataFrame:
    """(keys, findings): for each key its boxes (x0, y0, z0, x1, y1, z1) by id, each with its score and the places of the slices that it touches."""
    ends = boxes.select(*keys, id_, box, score, F.element_at(box, 3).alias("_low"), F.element_at(box, 6).alias("_high"))
    # a box's own depth is the bucket, so a box touches two or three buckets whatever the units are
    depth = ends.agg(F.percentile_approx(F.col("_high") - F.col("_low"), 0.5)).first()[0]
    met = range_join(slices.select(*keys, z), ends, keys, z, "_low", "_high", max(1.0, float(depth or 1.0)))
    touched = met.groupBy(*keys, id_).agg(F.array_sort(F.collect_list(F.col(z).cast("int"))).alias("slices"))
    each = boxes.select(*keys, id_, box, score).join(touched, [*keys, id_], "left")
    shaped = F.struct(F.col(id_).alias("id"), F.col(box).alias("box"), F.col(score).alias("score"), F.coalesce("slices", F.array().cast("array<int>")).alias("slices"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(shaped)).alias("findings"))


def observations(found: DataFrame, keys: list[str], what: str = "Finding") -> DataFrame:
    """(keys, id, z, percent, qualifier, note): one for each finding and slice that it touches."""
    each = found.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.id", F.explode("f.slices").alias("z"), F.bround(F.col("f.score") * 100, 2).alias("percent"))
    return each.select("*", band(F.col("percent")).alias("qualifier"), F.concat(F.lit(f"{what} present with probability "), F.col("percent").cast("string"), F.lit("%")).alias("note"))


def diagnostics(found: DataFrame, keys: list[str], what: str = "Finding") -> DataFrame:
    """(keys, report): a JSON document with a conclusion and the observations of each key, those without any included."""
    seen = observations(found, keys, what)
    row = F.struct("id", "z", F.col("percent").alias("probability"), "qualifier", "note")
    lists = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("observations"))
    ended = F.concat(F.lit(f"{what}s are "), F.when(F.size("findings") == 0, "not present.").otherwise("present."))
    report = F.to_json(F.struct(ended.alias("conclusion"), F.coalesce("observations", F.array().cast(lists.schema["observations"].dataType)).alias("observations")))
    return found.join(lists, keys, "left").select(*keys, report.alias("report"))


def _solved(matrix: Column, point: list[Column]) -> list[Column]:
    """The grid place of a patient place, by the affine's inverse: ratios of determinants; null where it has none."""
    m = [[F.get(F.get(matrix, F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)]
    off = [p - F.get(F.get(matrix, F.lit(i)), F.lit(3)) for i, p in enumerate(point)]
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    swap = lambda j: [[off[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]
    return [F.try_divide(det(*swap(j)), det(*m)) for j in range(3)]


def to_grid(box: Column, matrix: Column) -> Column:
    """The least box of the grid that holds a box (x0, y0, z0, x1, y1, z1) of patient places, for any affine that can be inverted."""
    end = lambda k: F.get(box, F.lit(k))
    corners = [_solved(matrix, [end(3 * (n >> i & 1) + i) for i in range(3)]) for n in range(8)]
    return F.array(*[F.least(*[c[i] for c in corners]) for i in range(3)], *[F.greatest(*[c[i] for c in corners]) for i in range(3)])


def to_patient(box: Column, matrix: Column) -> Column:
    """The least box of patient places that holds a box of the grid, for any affine."""
    end = lambda k: F.get(box, F.lit(k))
    cell = lambda i, j: F.get(F.get(matrix, F.lit(i)), F.lit(j))
    corners = [[sum((cell(i, j) * end(3 * (n >> j & 1) + j) for j in range(3)), cell(i, 3)) for i in range(3)] for n in range(8)]
    return F.array(*[F.least(*[c[i] for c in corners]) for i in range(3)], *[F.greatest(*[c[i] for c in corners]) for i in range(3)])


def clipped(box: Column, size: Column) -> Column:
    """A box cut to the grid 0 ... size; size: array of three."""
    return F.transform(box, lambda x, k: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.get(size, (k % 3).cast("int")).cast("double")))
