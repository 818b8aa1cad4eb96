"""Volumes as rows of blocks, and models that see them through overlapping windows, with no task ever holding a volume.

A chunked volume is a table (keys, shape, block, data): the volume's size, the block's place in the grid of blocks, and its
voxels as float32 in order of z, y, x; blocks at the far ends are cut to the volume. Windows slide over all three axes; each
window is put together from the parts that blocks give it, goes through the model in batches, and its scores are cut up
again by block, where they are added with their weights. Both shuffles move about as much as the windows cover; their keys
are (volume, window) and (volume, block), so one large volume is as well spread as many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..sources.files import rows_by_bytes

Box = tuple[tuple[int, int], ...]
_PLACE = T.ArrayType(T.IntegerType())


@dataclass(frozen=True)
class Tiling:
    """Windows of size roi (0 or less: the whole axis), overlapping by a share for all axes or each.

    batch: windows that the model gets at once. gaussian: weights fall off from the middle, by sigma times the size;
    otherwise all voxels of a window weigh the same. A volume smaller than a window is padded with zeros on both sides."""

    roi: tuple[int, int, int]
    overlap: float | tuple[float, float, float] = 0.25
    batch: int = 4
    gaussian: bool = False
    sigma: float = 0.125

    def __post_init__(self) -> None:
        each = self.overlap if isinstance(self.overlap, (tuple, list)) else (self.overlap,) * 3
        if len(self.roi) != 3 or len(each) != 3 or not all(0 <= x < 1 for x in each):
            raise PlanError(f"three sizes and overlaps in [0, 1) are needed: {self.roi}, {self.overlap}")
        if self.batch < 1:
            raise PlanError(f"a batch has a window at least: {self.batch}")
        object.__setattr__(self, "overlap", tuple(each))

    def sizes(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(int(r) if r > 0 else int(n) for r, n in zip(self.roi, shape))

    def starts(self, shape: tuple[int, ...]) -> list[list[int]]:
        """By axis; the last window ends with the volume, and a volume within one window lies in its middle."""
        out = []
        for n, size, overlap in zip(shape, self.sizes(shape), self.overlap):
            if n <= size:
                out.append([-((size - n) // 2)])
                continue
            step = max(1, int(size * (1 - overlap)))
            out.append(sorted({*range(0, n - size, step), n - size}))
        return out

    def weights(self, sizes: tuple[int, ...]) -> np.ndarray:
        out = np.ones(sizes)
        if self.gaussian:
            for axis, n in enumerate(sizes):
                bell = np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / (self.sigma * n)) ** 2)
                out = out * np.maximum(bell, 1e-3).reshape([-1 if i == axis else 1 for i in range(3)])
        return out


def _meet(a: Box, b: Box) -> Box | None:
    both = tuple((max(p[0], q[0]), min(p[1], q[1])) for p, q in zip(a, b))
    return both if all(lo < hi for lo, hi in both) else None


def _within(box: Box, outer: Box) -> tuple[slice, ...]:
    return tuple(slice(lo - o[0], hi - o[0]) for (lo, hi), o in zip(box, outer))


def _box(place: tuple[int, ...], size: tuple[int, ...], shape: tuple[int, ...]) -> Box:
    return tuple((p * s, min((p + 1) * s, n)) for p, s, n in zip(place, size, shape))


def _size(box: Box) -> tuple[int, ...]:
    return tuple(hi - lo for lo, hi in box)


def _blocks_under(box: Box, size: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    return product(*[range(lo // s, (hi - 1) // s + 1) for (lo, hi), s in zip(box, size)])


def _array(data: bytes, sizes: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(data, "<f4").reshape(sizes)


def _packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<f4").tobytes()


def _schema(df: DataFrame, keys: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t in more)])


def blocks_of(slices: DataFrame, keys: list[str], size: tuple[int, int, int]) -> DataFrame:
    """A chunked volume from packed slices (keys, z, rows, cols, dtype, pixels), z from 0 without gaps.

    A slice is cut where it lies, and a block gets size[0] cuts at most. The join with the volumes' sizes (a row each) has
    their key; a volume of very many blocks is then split by the adaptive plan. Nulls among the keys are a key."""
    depth = slices.groupBy(*keys).agg((F.max("z") + 1).cast("int").alias("depth"), F.max("rows").cast("int").alias("rows_"), F.max("cols").cast("int").alias("cols_"))
    schema = _schema(slices, keys, ("block", _PLACE), ("z", T.IntegerType()), ("data", T.BinaryType()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows_by_bytes(batches, "pixels"):
            found, sources = [], []
            for i, (z, rows, cols, dtype, pixels) in enumerate(zip(*(pdf[c].tolist() for c in ("z", "rows", "cols", "dtype", "pixels")))):
                a = np.frombuffer(pixels, np.dtype(dtype).newbyteorder("<")).reshape(rows, cols).astype("<f4")
                shape = (1, *a.shape)
                for place in _blocks_under(tuple((0, n) for n in shape), (1, *size[1:])):
                    box = _box(place, (1, *size[1:]), shape)
                    found.append(([z // size[0], *place[1:]], int(z), _packed(a[_within(box[1:], ((0, 0), (0, 0)))])))
                    sources.append(i)
            if found:
                yield pdf[keys].iloc[sources].assign(**dict(zip(("block", "z", "data"), map(list, zip(*found)))))

    cuts = slices.select(*keys, "z", "rows", "cols", "dtype", "pixels").mapInPandas(cut, schema)
    # a cut is some rows of a slice, so a block's bytes are its cuts' one after the other, joined as text of a byte a character
    parts = cuts.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("z", F.decode("data", "ISO-8859-1").alias("d")))).alias("parts"))
    data = F.encode(F.array_join(F.transform("parts", lambda x: x["d"]), ""), "ISO-8859-1")
    own = depth.select(*[F.col(k).alias(f"{k}_") for k in keys], F.array("depth", "rows_", "cols_").alias("shape"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    return parts.select(*keys, "block", data.alias("data")).join(own, same).select(*keys, "shape", "block", "data")


def windows_of(volume: DataFrame, keys: list[str], size: tuple[int, int, int], tiling: Tiling) -> DataFrame:
    """(keys, shape, window, data): each window's start and voxels, zeros outside the volume."""
    schema = _schema(volume, keys, ("shape", _PLACE), ("window", _PLACE), ("block", _PLACE), ("data", T.BinaryType()))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in pdf.to_dict("records"):
                shape = tuple(int(n) for n in own["shape"])
                box = _box(tuple(own["block"]), size, shape)
                a, sizes = _array(own["data"], _size(box)), tiling.sizes(shape)
                near = [[s for s in starts if s < hi and s + n > lo] for starts, n, (lo, hi) in zip(tiling.starts(shape), sizes, box)]
                found = []
                for start in product(*near):
                    part = _meet(box, tuple((s, s + n) for s, n in zip(start, sizes)))
                    found.append((list(start), _packed(a[_within(part, box)])))
                yield pd.DataFrame({**{k: [own[k]] * len(found) for k in keys}, "shape": [list(shape)] * len(found), "window": [x for x, _ in found], "block": [list(own["block"])] * len(found), "data": [x for _, x in found]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        shape, start = tuple(int(n) for n in group["shape"].iloc[0]), tuple(int(s) for s in group["window"].iloc[0])
        sizes = tiling.sizes(shape)
        outer = tuple((s, s + n) for s, n in zip(start, sizes))
        out = np.zeros(sizes, "<f4")
        for place, data in zip(group["block"], group["data"]):
            part = _meet(_box(tuple(place), size, shape), outer)
            out[_within(part, outer)] = _array(data, _size(part))
        return group[[*keys, "shape", "window"]].iloc[:1].assign(data=[_packed(out)])

    parts = volume.select(*keys, "shape", "block", "data").mapInPandas(deal, schema)
    return parts.groupBy(*keys, "window").applyInPandas(join, _schema(volume, keys, ("shape", _PLACE), ("window", _PLACE), ("data", T.BinaryType())))


def scored(windows: DataFrame, keys: list[str], tiling: Tiling, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """windows with channels and the model's scores in place of the voxels: load() once a task, then model(n, z, y, x) -> (n, channels, z, y, x).

    Windows of one size go together, tiling.batch at most; a task's last batches may be smaller."""
    schema = _schema(windows, keys, ("shape", _PLACE), ("window", _PLACE), ("channels", T.IntegerType()), ("data", T.BinaryType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, waiting = load(), {}

        def through(sizes: tuple[int, ...]) -> pd.DataFrame:
            rows = waiting.pop(sizes)
            scores = np.asarray(model(np.stack([_array(r["data"], sizes) for r in rows])))
            if scores.ndim != 5 or scores.shape[0] != len(rows) or scores.shape[2:] != sizes:
                raise PlanError(f"the model gave {scores.shape} for {len(rows)} windows of {sizes}")
            return pd.DataFrame([{**{k: r[k] for k in keys}, "shape": r["shape"], "window": r["window"], "channels": scores.shape[1], "data": _packed(s)} for r, s in zip(rows, scores)])

        for pdf in batches:
            for own in pdf.to_dict("records"):
                sizes = tiling.sizes(tuple(int(n) for n in own["shape"]))
                waiting.setdefault(sizes, []).append(own)
                if len(waiting[sizes]) >= tiling.batch:
                    yield through(sizes)
        for sizes in list(waiting):
            yield through(sizes)

    return windows.select(*keys, "shape", "window", "data").mapInPandas(run, schema)


def added(scores: DataFrame, keys: list[str], size: tuple[int, int, int], tiling: Tiling) -> DataFrame:
    """(keys, shape, block, channels, data): the windows' weighted mean scores by block, channels first.

    A block adds its windows in order of their starts, so sums don't depend on how blocks are cut or tasks run."""
    schema = _schema(scores, keys, ("shape", _PLACE), ("window", _PLACE), ("channels", T.IntegerType()), ("block", _PLACE), ("data", T.BinaryType()))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in pdf.to_dict("records"):
                shape = tuple(int(n) for n in own["shape"])
                sizes, channels = tiling.sizes(shape), int(own["channels"])
                a = _array(own["data"], (channels, *sizes))
                outer = tuple((int(s), int(s) + n) for s, n in zip(own["window"], sizes))
                inside = _meet(outer, tuple((0, n) for n in shape))
                found = []
                for place in _blocks_under(inside, size):
                    part = _meet(inside, _box(place, size, shape))
                    found.append((list(place), _packed(a[(slice(None), *_within(part, outer))])))
                yield pd.DataFrame({**{k: [own[k]] * len(found) for k in keys}, "shape": [list(shape)] * len(found), "window": [list(own["window"])] * len(found), "channels": channels, "block": [x for x, _ in found], "data": [x for _, x in found]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        shape, place = tuple(int(n) for n in group["shape"].iloc[0]), tuple(int(p) for p in group["block"].iloc[0])
        sizes, channels = tiling.sizes(shape), int(group["channels"].iloc[0])
        box, weight = _box(place, size, shape), tiling.weights(sizes)
        total, seen = np.zeros((channels, *_size(box))), np.zeros(_size(box))
        for start, data in sorted(zip(map(tuple, group["window"]), group["data"])):
            outer = tuple((s, s + n) for s, n in zip(start, sizes))
            part = _meet(outer, box)
            w, at = weight[_within(part, outer)], _within(part, box)
            total[(slice(None), *at)] += _array(data, (channels, *_size(part))) * w
            seen[at] += w
        return group[[*keys, "shape", "block", "channels"]].iloc[:1].assign(data=[_packed(total / seen)])

    parts = scores.mapInPandas(deal, schema)
    return parts.groupBy(*keys, "block").applyInPandas(add, _schema(scores, keys, ("shape", _PLACE), ("block", _PLACE), ("channels", T.IntegerType()), ("data", T.BinaryType())))


def inferred(volume: DataFrame, keys: list[str], size: tuple[int, int, int], tiling: Tiling, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """A chunked volume through a model by sliding windows: (keys, shape, block, channels, data)."""
    return added(scored(windows_of(volume, keys, size, tiling), keys, tiling, load), keys, size, tiling)


def labelled(scores: DataFrame, keys: list[str], size: tuple[int, int, int]) -> DataFrame:
    """(keys, shape, block, data): scores as labels of a byte a voxel: the first largest channel, or of one channel whether it is above one half."""
    schema = _schema(scores, keys, ("shape", _PLACE), ("block", _PLACE), ("data", T.BinaryType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for shape, place, n, data in zip(pdf["shape"], pdf["block"], pdf["channels"], pdf["data"]):
                a = _array(data, (int(n), *_size(_box(tuple(place), size, tuple(shape)))))
                out.append((a.argmax(0) if n > 1 else a[0] > 0.5).astype(np.uint8).tobytes())
            yield pdf[[*keys, "shape", "block"]].assign(data=out)

    return scores.mapInPandas(run, schema)


def as_labels(volume: DataFrame, keys: list[str]) -> DataFrame:
    """A chunked volume of whole numbers from 0 to 255 as chunked labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[np.frombuffer(x, "<f4").astype(np.uint8).tobytes() for x in pdf["data"]])

    held = volume.select(*keys, "shape", "block", "data")
    return held.mapInPandas(run, held.schema)


def label_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, n): voxels of each label, 0 included. A block's bytes are counted where it lies, before any shuffle."""
    schema = _schema(labels, keys, ("label", T.IntegerType()), ("n", T.LongType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in pdf.to_dict("records"):
                found, n = np.unique(np.frombuffer(own["data"], np.uint8), return_counts=True)
                yield pd.DataFrame({**{k: [own[k]] * len(found) for k in keys}, "label": found.astype("int32"), "n": n})

    return labels.select(*keys, "data").mapInPandas(run, schema).groupBy(*keys, "label").agg(F.sum("n").alias("n"))
