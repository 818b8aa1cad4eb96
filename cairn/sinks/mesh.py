"""Surfaces of volumes as STL meshes.

The surface is found by marching tetrahedra: each cube of eight voxels is six tetrahedra around its diagonal, and a
tetrahedron is cut in one triangle or two. That needs no table of cases and leaves no holes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.volume import largest_component, resampled, unpacked
from ..sources.files import parts


def surface(volume: np.ndarray, level: float = 0.5, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(points in index space z, y, x; triangles as three points' places), normals outwards. Every step-th voxel counts."""
    v = np.pad(np.asarray(volume, float)[::step, ::step, ::step], 1, constant_values=min(0.0, level - 1))
    flat, strides = v.ravel(), (v.shape[1] * v.shape[2], v.shape[2], 1)
    at = lambda b: slice(1, None) if b else slice(None, -1)
    corners = [v[at(a), at(b), at(c)] > level for a, b, c in itertools.product((0, 1), repeat=3)]
    cut = np.logical_or.reduce(corners) & ~np.logical_and.reduce(corners)
    base = np.stack(np.nonzero(cut), 1) @ np.array(strides)
    triangles, sides = [], []
    for a, b, c in itertools.permutations(strides):
        idx = base[:, None] + np.array([0, a, a + b, a + b + c])
        inside = flat[idx] > level
        idx = np.take_along_axis(idx, np.argsort(~inside, 1, kind="stable"), 1)  # those within come first
        for k, cuts in ((1, [(0, 1, 0, 2, 0, 3)]), (2, [(0, 2, 0, 3, 1, 3), (0, 2, 1, 3, 1, 2)]), (3, [(0, 3, 1, 3, 2, 3)])):
            own = idx[inside.sum(1) == k]
            for edges in cuts:
                triangles.append(own[:, edges].reshape(-1, 3, 2))
                sides.append(np.stack([own[:, 0], own[:, 3]], 1))  # one within, one without
    edges, side = np.concatenate(triangles), np.concatenate(sides)
    keys = edges.min(2) * np.int64(flat.size) + edges.max(2)
    unique, faces = np.unique(keys, return_inverse=True)
    faces = faces.reshape(-1, 3)
    lo, hi = unique // flat.size, unique % flat.size
    place = lambda i: np.stack(np.unravel_index(i, v.shape), 1).astype(float)
    share = (level - flat[lo]) / (flat[hi] - flat[lo])
    points = place(lo) + share[:, None] * (place(hi) - place(lo))
    corner = points[faces]
    normal = np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0])
    # the vector from the point within to the triangle's plane tells which way is out
    turned = ((corner[:, 0] - place(side[:, 0])) * normal).sum(1) < 0
    faces[turned] = faces[turned][:, ::-1]
    return (points - 1) * step, faces


def smoothed(points: np.ndarray, faces: np.ndarray, rounds: int = 20, shrink: float = 0.5, grow: float = -0.53) -> np.ndarray:
    """Taubin smoothing: each round moves points towards their neighbours' mean, then a little further back."""
    pairs = np.unique(np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), 1), axis=0)
    a, b = np.concatenate([pairs, pairs[:, ::-1]]).T
    n = np.maximum(np.bincount(a, minlength=len(points)), 1)[:, None]
    for factor in [shrink, grow] * rounds:
        mean = np.stack([np.bincount(a, points[b, k], len(points)) for k in range(3)], 1) / n
        points = points + factor * (mean - points)
    return points


def stl(points: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary STL file."""
    corner = points[faces].astype("<f4")
    normal = np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0])
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    rows = np.zeros(len(faces), np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("attribute", "<u2")]))
    rows["normal"], rows["corner"] = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0), corner
    return b"\0" * 80 + len(faces).to_bytes(4, "little") + rows.tobytes()


def mask_mesh(mask: np.ndarray, affine: np.ndarray, label: int | None = None, largest: bool = True, smooth: bool = True, step: int = 1, spacing: float | None = None) -> bytes:
    """STL of a mask (z, y, x), in the space of the affine (which takes x, y, z). spacing: resample to it first.

    An empty mask gives a mesh without triangles."""
    on = (mask == label if label is not None else mask > 0).astype(float)
    if largest:
        on = largest_component(on)
    affine = np.asarray(affine, float)
    scale = np.ones(3)
    if spacing:
        own = np.linalg.norm(affine[:3, :3], axis=0)[::-1]
        shape = np.array(on.shape)
        on = resampled(on, tuple(own), spacing)
        scale = (shape - 1) / np.maximum(np.array(on.shape) - 1, 1)
    points, faces = surface(on, 0.5, step)
    if smooth and len(faces):
        points = smoothed(points, faces)
    space = (points * scale)[:, ::-1] @ affine[:3, :3].T + affine[:3, 3]
    return stl(space, faces[:, ::-1] if np.linalg.det(affine[:3, :3]) > 0 else faces)  # z, y, x to x, y, z mirrors once


def meshes(volumes: DataFrame, key: str, **options: object) -> DataFrame:
    """(name, content): <key>.stl for each packed mask (shape, dtype, data, affine). options: those of mask_mesh."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            made = [mask_mesh(unpacked(list(s), t, d), np.array([list(r) for r in m]), **options) for s, t, d, m in zip(pdf["shape"], pdf["dtype"], pdf["data"], pdf["affine"])]
            yield pd.DataFrame({"name": pdf[key].astype(str) + ".stl", "content": made})

    return volumes.select(key, "shape", "dtype", "data", "affine").mapInPandas(run, "name string, content binary")
