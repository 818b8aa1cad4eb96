"""Masks as runs of equal voxels, and their connected parts, however large a mask is.

A run is a row (keys, block, label, z, y, x0, x1): voxels of one label that stand side by side on a line, ends included,
within one block of a chunked volume. Runs of neighbouring lines that overlap, and runs that meet at a block's edge, are
the edges of a graph; its parts come from alternating stars over runs. Face neighbours count; nothing is exploded by voxel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import rows_by_bytes
from .aggregate import checkpointing, connected
from .chunks import _box, _size

_INTS = ("label", "z", "y", "x0", "x1")


def line_runs(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """(label, z, y, x0, x1) of all runs above zero of an array, in order of place."""
    flat = a.reshape(-1, a.shape[-1])
    change = np.ones((len(flat), a.shape[-1] + 1), bool)
    change[:, 1:-1] = flat[:, 1:] != flat[:, :-1]
    row, x = np.nonzero(change)
    start = x < a.shape[-1]  # each start's run ends before the next change of its line
    ends = np.append(x[1:], 0)[start] - 1
    row, x = row[start], x[start]
    label = flat[row, x]
    on = label > 0
    z, y = np.divmod(row[on], a.shape[1])
    return label[on].astype(np.int32), z, y, x[on], ends[on]


def runs_of(labels: DataFrame, keys: list[str], size: tuple[int, int, int]) -> DataFrame:
    """The runs of chunked labels (keys, shape, block, data), a byte a voxel; places count within the volume."""
    schema = T.StructType([*(labels.schema[k] for k in keys), labels.schema["shape"], labels.schema["block"], *(T.StructField(n, T.IntegerType()) for n in _INTS)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows_by_bytes(batches, "data"):
            found, sources = [], []
            for i, (shape, place, data) in enumerate(zip(pdf["shape"], pdf["block"], pdf["data"])):
                box = _box(tuple(place), size, tuple(shape))
                own = line_runs(np.frombuffer(data, np.uint8).reshape(_size(box)))
                shift = (0, box[0][0], box[1][0], box[2][0], box[2][0])
                found.append(np.stack([(x + s).astype(np.int32) for x, s in zip(own, shift)]))
                sources.append(np.full(len(own[0]), i))
            at = np.concatenate(sources)
            if len(at):
                yield pdf[[*keys, "shape", "block"]].iloc[at].assign(**dict(zip(_INTS, np.concatenate(found, axis=1))))

    return labels.select(*keys, "shape", "block", "data").mapInPandas(run, schema)


def _place(z: Column, y: Column, x: Column) -> Column:
    """A voxel's number in its volume, in order of place."""
    at = lambda k: F.get("shape", k).cast("long")
    return (z.cast("long") * at(1) + y) * at(2) + x


def edges_of(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(volume, a, b): pairs of runs of a label that touch, by their first voxels' numbers; volume is the struct of the keys.

    One equality join on (volume, label, line): a run offers itself to the lines after its own, so what meets is at most the
    runs of two neighbouring lines; and each run to the place right after it, where a block may go on."""
    own = runs.select(F.struct(*keys).alias("volume"), "label", "z", "y", "x0", "x1", _place(F.col("z"), F.col("y"), F.col("x0")).alias("id"))
    steps = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dz, dy, dx in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]))
    offer = own.select("volume", "label", F.col("id").alias("a"), "z", "y", F.col("x0").alias("low"), F.col("x1").alias("high"), steps.alias("s"))
    # the place after a run only; else the whole of it
    offer = offer.select("volume", "label", "a", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), F.when(F.col("s.dx") == 1, F.col("high") + 1).otherwise(F.col("low")).alias("low"), F.when(F.col("s.dx") == 1, F.col("high") + 1).otherwise(F.col("high")).alias("high"))
    met = offer.join(own.withColumnRenamed("id", "b"), ["volume", "label", "z", "y"]).where("x0 <= high AND x1 >= low")
    return met.select("volume", "a", "b")


def parts_of(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs with part: the number of the part's first voxel in order of place."""
    names = [c for c in runs.columns]
    checkpointing(runs.sparkSession)
    runs = runs.checkpoint()  # read three times: by both sides of the edges' join, and below
    roots = connected(edges_of(runs, keys), within="volume").select(F.col("volume").alias("volume_"), F.col("a").alias("a_"), F.col("b").alias("b_"))
    own = runs.withColumns({"volume": F.struct(*keys), "id": _place(F.col("z"), F.col("y"), F.col("x0"))})
    joined = own.join(roots, (F.col("volume") == F.col("volume_")) & (F.col("id") == F.col("a_")), "left")
    return joined.select(*names, F.coalesce("b_", "id").alias("part"))


def part_sizes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, part, voxels)."""
    return parts.groupBy(*keys, "label", "part").agg(F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("voxels"))


def labels_of(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, voxels, parts, largest, first): each label that a volume has, its largest part, and that part's first voxel.

    Of equal parts the one met first counts."""
    sizes = part_sizes(parts, keys)
    best = F.max_by(F.struct("voxels", "part"), F.struct("voxels", -F.col("part")))
    return sizes.groupBy(*keys, "label").agg(F.sum("voxels").alias("voxels"), F.count("*").alias("parts"), best.alias("b")).select(*keys, "label", "voxels", "parts", F.col("b.voxels").alias("largest"), F.col("b.part").alias("first"))


def largest_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of each label's largest part."""
    best = labels_of(parts, keys).select(F.struct(*keys, "label").alias("which_"), F.col("first").alias("first_"))
    names = parts.columns
    return parts.withColumn("which", F.struct(*keys, "label")).join(best, (F.col("which") == F.col("which_")) & (F.col("part") == F.col("first_"))).select(*names)


def painted(labels: DataFrame, runs: DataFrame, keys: list[str], size: tuple[int, int, int]) -> DataFrame:
    """Chunked labels with zeros wherever no given run lies; a block meets its own runs only."""

    def run(_: tuple, blocks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for shape, place in zip(blocks["shape"], blocks["block"]):
            box = _box(tuple(place), size, tuple(shape))
            a = np.zeros(_size(box), np.uint8)
            for label, z, y, x0, x1 in own[list(_INTS)].itertuples(index=False):
                a[z - box[0][0], y - box[1][0], x0 - box[2][0] : x1 - box[2][0] + 1] = label
            out.append(a.tobytes())
        return blocks.assign(data=out)

    return labels.groupBy(*keys, "block").cogroup(runs.groupBy(*keys, "block")).applyInPandas(run, labels.schema)
