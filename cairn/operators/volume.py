"""Volumes: as voxel rows (z, y, x, value) for relational steps, or packed slices for kernels in Arrow workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intensity windows of known models (fixed values).
WINDOWS = {"abdomen": (-250.0, 400.0), "liver": (-21.0, 189.0), "organs": (-175.0, 250.0), "spleen": (-57.0, 164.0), "lung": (-1024.0, 300.0)}


def rescaled(v: Column, slope: Column, intercept: Column) -> Column:
    return v * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0))


def windowed(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def narrowest_type(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, dtype): the first of uint8, uint16, int16 and float32 that holds every value of the group exactly, else float64.

    The unsigned types are for groups whose values are all positive."""
    v = F.col(value).cast("double")
    whole = lambda lo, hi: F.bool_and((v == F.floor(v)) & v.between(lo, hi))
    agg = rows.groupBy(*keys).agg(F.bool_and(v > 0).alias("p"), whole(0, 255).alias("u8"), whole(0, 65535).alias("u16"), whole(-32768, 32767).alias("i16"), F.bool_and(v.cast("float").cast("double") == v).alias("f32"))
    kind = F.when(F.col("p") & F.col("u8"), "uint8").when(F.col("p") & F.col("u16"), "uint16").when(F.col("i16"), "int16").when(F.col("f32"), "float32").otherwise("float64")
    return agg.select(*keys, kind.alias("dtype"))


def lines(df: DataFrame, ids: list[str], values: str, at: str = "x", name: str = "v") -> DataFrame:
    """A row for each element of an array column."""
    return df.select(*ids, F.posexplode(values).alias(at, name))


def tile_starts(n: Column, size: int, overlap: float = 0.25) -> Column:
    """Starts of sliding windows over n places: steps of size * (1 - overlap), the last window ends at n."""
    step = max(1, int(size * (1 - overlap)))
    last = F.greatest(n - size, F.lit(0)).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def blended(image: Column, mask: Column, colour: float, alpha: float = 0.4, threshold: float = 0.5) -> Column:
    """image where the mask is at most the threshold, else mixed with the colour."""
    return F.when(mask > threshold, (1 - alpha) * image + alpha * colour).otherwise(image)


def minmax(v: Column, keys: list[str]) -> Column:
    """Value on a scale of 0 to 1 within its group; 0 for a constant group."""
    w = Window.partitionBy(*keys)
    return F.coalesce(F.try_divide(v - F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w)), F.lit(0.0))


def minmax_of(values: Column) -> Column:
    """The same within an array."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)))


def zscore(v: Column, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return F.try_divide(v - F.avg(v).over(w), F.stddev_pop(v).over(w))


def stacked(slices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shape, dtype, data): packed slices of a series (z, rows, cols, dtype, pixels) put together in order of z.

    Size and type are those of the first slice. The parts are joined in one step, as text of a byte a character."""
    first = F.min_by(F.struct("rows", "cols", "dtype"), "z").alias("_first")
    agg = slices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("z", "pixels"))).alias("_slices"), first)
    data = F.encode(F.array_join(F.transform("_slices", lambda x: F.decode(x["pixels"], "ISO-8859-1")), ""), "ISO-8859-1")
    return agg.select(*keys, F.array(F.size("_slices"), F.col("_first.rows"), F.col("_first.cols")).alias("shape"), F.col("_first.dtype").alias("dtype"), data.alias("data"))


def packed_arrays(rows: DataFrame, keys: list[str], values: str, shape: tuple[int, ...], dtype: str = "float32") -> DataFrame:
    """(keys, shape, dtype, data) of an array column whose elements lie in the given shape."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches):
        for pdf in batches:
            data = [np.asarray(x, np.dtype(dtype).newbyteorder("<")).reshape(shape).tobytes() for x in pdf[values]]
            yield pdf[keys].assign(shape=[list(shape)] * len(pdf), dtype=dtype, data=data)

    return rows.select(*keys, values).mapInPandas(run, f"{kinds}, shape array<int>, dtype string, data binary")


def unpacked(row_shape: list[int], dtype: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(dtype).newbyteorder("<")).reshape(row_shape)


def per_volume(volumes: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """volumes with each array replaced by kernel(array), in Arrow workers; one volume at a time."""

    def run(batches):
        for pdf in batches:
            out = [kernel(unpacked(list(s), t, d)) for s, t, d in zip(pdf["shape"], pdf["dtype"], pdf["data"])]
            yield pdf.assign(shape=[list(x.shape) for x in out], dtype=[x.dtype.name for x in out], data=[np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes() for x in out])

    return volumes.mapInPandas(run, volumes.schema)


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The mask's largest part of face-neighbours (of equal ones the first met), by union of runs of neighbours."""
    on = np.asarray(mask) > 0
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        new = label.copy()
        for axis in range(on.ndim):
            a, b = [slice(None)] * on.ndim, [slice(None)] * on.ndim
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            both = on[tuple(a)] & on[tuple(b)]
            low = np.minimum(new[tuple(a)], new[tuple(b)])
            new[tuple(a)] = np.where(both, low, new[tuple(a)])
            new[tuple(b)] = np.where(both, np.minimum(low, new[tuple(b)]), new[tuple(b)])
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(on, flat[new], 0)  # jump to the label of the place that the label names
        if np.array_equal(new, label):
            break
        label = new
    if not on.any():
        return np.zeros_like(mask)
    ids, n = np.unique(label[on], return_counts=True)
    return np.where(label == ids[n.argmax()], mask, 0)


def resampled(volume: np.ndarray, spacing: tuple[float, ...], to: float) -> np.ndarray:
    """Linear resampling to an equal spacing along each axis."""
    out = np.asarray(volume, float)
    for axis, s in enumerate(spacing):
        n = max(1, int(round(out.shape[axis] * s / to)))
        at = np.linspace(0, out.shape[axis] - 1, n)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, out.shape[axis] - 1)
        f = (at - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        out = np.take(out, low, axis) * (1 - f) + np.take(out, high, axis) * f
    return out


def foreground_bounds(voxels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The least box that holds all values above zero."""
    return voxels.where(F.col(value) > 0).groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in ("z", "y", "x") for n, f in (("min", F.min), ("max", F.max))])


def predicted(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """df through a model: load() once for each task, then one call for each Arrow batch."""

    def run(batches):
        model = load()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)
