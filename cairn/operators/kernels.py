"""Kernels on whole arrays of any number of axes. ``on_arrays`` runs one on array columns, ``volume.per_volume`` on packed volumes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Knots of the jet colour map: (place, value) of red, green and blue (fixed values).
JET = (
    ((0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)),
    ((0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)),
    ((0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)),
)


def on_arrays(values: Column, shape: tuple[int, ...], kernel: Callable[[np.ndarray], np.ndarray]) -> Column:
    """kernel(array) of an array column whose elements lie in the given shape, row by row of an Arrow batch; null stays null."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else np.asarray(kernel(np.asarray(x, float).reshape(shape)), float).ravel())

    return run(values)


def as_real(a: np.ndarray) -> np.ndarray:
    """Whole numbers as shares of their type's largest value; real numbers as they are."""
    return a / np.iinfo(a.dtype).max if np.issubdtype(a.dtype, np.integer) else a.astype(float, copy=False)


def weighted(a: np.ndarray, weights: Iterable[float], axis: int) -> np.ndarray:
    """Sum of an axis' neighbours by weights (of odd number); borders repeat."""
    weights = list(weights)
    r = len(weights) // 2
    wide = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
    return sum(w * np.take(wide, range(k, k + a.shape[axis]), axis) for k, w in enumerate(weights) if w)


def sobel(a: np.ndarray) -> np.ndarray:
    """Size of the gradient: differences along each axis, smoothed along all others; the root of their mean square."""
    a = as_real(a)
    total = np.zeros(a.shape)
    for axis in range(a.ndim):
        g = weighted(a, (1.0, 0.0, -1.0), axis)
        for other in set(range(a.ndim)) - {axis}:
            g = weighted(g, (0.25, 0.5, 0.25), other)
        total += g * g
    return np.sqrt(total / a.ndim)


def median(a: np.ndarray) -> np.ndarray:
    """The middle of the cell and all its neighbours, corners included; borders repeat."""
    wide = np.pad(a, 1, mode="edge")
    near = [wide[tuple(slice(d, d + n) for d, n in zip(at, a.shape))] for at in product(range(3), repeat=a.ndim)]
    return np.sort(np.stack(near), axis=0)[len(near) // 2]


def gaussian(a: np.ndarray, sigma: float = 0.2, channel_axis: int | None = None) -> np.ndarray:
    """Smoothing by a bell curve cut at four sigma, along all axes but that of the channels."""
    a = as_real(a)
    if sigma <= 0:
        return a
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    skip = None if channel_axis is None else channel_axis % a.ndim
    for axis in range(a.ndim):
        if axis != skip:
            a = weighted(a, w / w.sum(), axis)
    return a


def picture(a: np.ndarray) -> np.ndarray:
    """An array as a picture: what lies within one is scaled to 255."""
    return (a * 255).astype(np.uint8) if a.max(initial=0) <= 1 else a.astype(np.uint8)


def contours(labels: np.ndarray, wanted: Iterable[int] | None = None) -> np.ndarray:
    """Labels where one of the eight neighbours within the slice (outside counts as other) isn't of the same label, else 0.

    The last two axes are the slice's; wanted: the labels that are drawn, all if not given."""
    flat = labels.reshape(-1, *labels.shape[-2:])
    wide = np.pad(flat, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
    rows, cols = flat.shape[1:]
    inner = np.ones(flat.shape, bool)
    for dy, dx in product(range(3), repeat=2):
        inner &= wide[:, dy : dy + rows, dx : dx + cols] == flat
    drawn = flat != 0 if wanted is None else np.isin(flat, [x for x in wanted if x])
    return np.where(drawn & ~inner, flat, 0).reshape(labels.shape)


def jet(n: int = 256) -> np.ndarray:
    """The jet colour map as n colours, 0 to 1."""
    at = np.linspace(0, 1, n)
    return np.stack([np.interp(at, *zip(*knots)) for knots in JET], axis=1)


def coloured(labels: np.ndarray) -> np.ndarray:
    """Labels as colours (…, 3) of the jet map, by their share of the largest label."""
    top = labels.max(initial=0)
    level = (labels / top * 255.0).astype(np.uint8) if top else np.zeros(labels.shape, np.uint8)
    return (jet()[level] * 255).astype(np.uint8)


def grey(a: np.ndarray) -> np.ndarray:
    """Values as grey colours (…, 3) between the least and the largest; a constant array is black."""
    low, high = float(a.min(initial=np.inf)), float(a.max(initial=-np.inf))
    v = (a - low) / (high - low) if high > low else np.zeros(a.shape)
    return np.repeat((v * 255).astype(np.uint8)[..., None], 3, axis=-1)


def overlay(image: np.ndarray, labels: np.ndarray, alpha: float = 0.7) -> np.ndarray:
    """The image in grey with labels above zero mixed in by their colours; channels last."""
    out = grey(image)
    on = labels > 0
    out[on] = (alpha * coloured(labels)[on] + (1 - alpha) * out[on]).astype(np.uint8)
    return out


def axes_to(matrix: np.ndarray, codes: str = "RAS") -> list[tuple[int, int]]:
    """For each axis of the wanted orientation the array axis that runs along it and its sign, by the largest direction cosines."""
    unit = matrix[:3, :3] / np.maximum(np.sqrt((matrix[:3, :3] ** 2).sum(0)), 1e-300)
    left, out = [0, 1, 2], {}
    for world in sorted(range(3), key=lambda w: -np.abs(unit[w]).max()):
        own = max(left, key=lambda k: abs(unit[world, k]))
        left.remove(own)
        out[world] = (own, 1 if unit[world, own] >= 0 else -1)
    place = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}
    return [(out[w][0], out[w][1] * sign) for w, sign in (place[c] for c in codes.upper())]


def reoriented(a: np.ndarray, matrix: np.ndarray, codes: str = "RAS") -> tuple[np.ndarray, np.ndarray]:
    """The array with axes (x, y, z) turned to the wanted orientation, and its matrix of places."""
    turn = axes_to(np.asarray(matrix, float), codes)
    out, change = a.transpose([k for k, _ in turn]), np.zeros((4, 4))
    change[3, 3] = 1
    for new, (old, sign) in enumerate(turn):
        if sign < 0:
            out = np.flip(out, new)
        change[old, new] = sign
        change[old, 3] = a.shape[old] - 1 if sign < 0 else 0
    return np.ascontiguousarray(out), np.asarray(matrix, float) @ change


def sampled(a: np.ndarray, matrix: np.ndarray, to_shape: tuple[int, ...], to_matrix: np.ndarray, nearest: bool = False) -> np.ndarray:
    """The array's values at another grid's places: linear or of the nearest cell; places outside take the border's value."""
    grid = np.stack(np.meshgrid(*map(np.arange, to_shape), indexing="ij")).reshape(3, -1)
    move = np.linalg.inv(np.asarray(matrix, float)) @ np.asarray(to_matrix, float)
    at = move[:3, :3] @ grid + move[:3, 3:]
    limit = np.array(a.shape)[:, None] - 1
    at = np.clip(at, 0, limit)
    if nearest:
        return a[tuple(np.floor(at + 0.5).astype(int).clip(0, limit))].reshape(to_shape)
    low = np.floor(at).astype(int)
    out = np.zeros(grid.shape[1])
    for corner in product((0, 1), repeat=3):
        c = np.array(corner)[:, None]
        w = np.where(c, at - low, 1 - (at - low)).prod(0)
        out += w * a[tuple(np.minimum(low + c, limit))]
    return out.reshape(to_shape)


def respaced(a: np.ndarray, matrix: np.ndarray, spacing: tuple[float, float, float], nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The array on a grid of the wanted spacing along its own axes, and that grid's matrix. ``sampled`` inverts it."""
    matrix = np.asarray(matrix, float)
    own = np.sqrt((matrix[:3, :3] ** 2).sum(0))
    shape = tuple(max(1, int(np.ceil(n * s / t - 1e-9))) for n, s, t in zip(a.shape, own, spacing))
    to = matrix.copy()
    to[:3, :3] = matrix[:3, :3] / own * np.asarray(spacing, float)
    return sampled(a, matrix, shape, to, nearest), to


def check_alike(matrices: list[np.ndarray], shapes: list[tuple[int, ...]], tolerance: float = 1e-3) -> None:
    """Raises if arrays that are to be stacked lie on different grids."""
    if any(tuple(s) != tuple(shapes[0]) for s in shapes):
        raise ValueError(f"arrays of different shapes: {sorted(set(map(tuple, shapes)))}")
    if any(not np.allclose(m, matrices[0], atol=tolerance) for m in matrices[1:]):
        raise ValueError("arrays on different grids")
