"""Slices and overlays as PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.volume import unpacked


def png(picture: np.ndarray) -> bytes:
    """An 8-bit picture: (rows, cols) grey or (rows, cols, 3) colours."""
    a = np.ascontiguousarray(picture, np.uint8)
    if a.ndim not in (2, 3) or (a.ndim == 3 and a.shape[2] != 3):
        raise ValueError(f"no picture of shape {a.shape}")
    lines = np.hstack([np.zeros((len(a), 1), np.uint8), a.reshape(len(a), -1)]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">2I5B", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def grey(a: np.ndarray) -> np.ndarray:
    """Values on a scale of 0 to 255; a constant picture is black."""
    low, high = float(np.min(a)), float(np.max(a))
    return np.zeros(a.shape, np.uint8) if high <= low else np.round((a - low) / (high - low) * 255).astype(np.uint8)


def overlaid(picture: np.ndarray, mask: np.ndarray, alpha: float = 0.4, colour: tuple[int, int, int] = (255, 0, 0), threshold: float = 0.5) -> np.ndarray:
    """The picture in grey with the colour mixed in where the mask is above the threshold."""
    base = np.repeat(grey(picture)[..., None], 3, -1).astype(float)
    return np.where((mask > threshold)[..., None], (1 - alpha) * base + alpha * np.array(colour), base).astype(np.uint8)


def _frames(made: Iterable[tuple[str, bytes]], most_bytes: int = 1 << 20, most_rows: int = 512) -> Iterator[pd.DataFrame]:
    """(name, content) of so many bytes or rows together, or of a single picture of more."""
    held, n = [], 0
    for name, content in made:
        if held and (n + len(content) > most_bytes or len(held) == most_rows):
            yield pd.DataFrame(held, columns=["name", "content"])
            held, n = [], 0
        held.append((name, content))
        n += len(content)
    if held:
        yield pd.DataFrame(held, columns=["name", "content"])


def slice_pictures(volumes: DataFrame, key: str) -> DataFrame:
    """(name, content): a colour PNG <key>/<z>.png for each slice of packed volumes (shape, dtype, data)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        for pdf in batches:
            for k, s, t, d in zip(pdf[key], pdf["shape"], pdf["dtype"], pdf["data"]):
                for z, a in enumerate(unpacked(list(s), t, d)):
                    flat = a if a.dtype == np.uint8 else grey(a)
                    yield f"{k}/{z}.png", png(np.repeat(flat[..., None], 3, -1))

    return volumes.select(key, "shape", "dtype", "data").mapInPandas(lambda batches: _frames(made(batches)), "name string, content binary")


def overlays(pairs: DataFrame, name: str, alpha: float = 0.4, colour: tuple[int, int, int] = (255, 0, 0), threshold: float = 0.5) -> DataFrame:
    """(name, content): <name>_overlay.png of rows with a picture (shape, dtype, data) and a mask of its shape (mask_dtype, mask)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        for pdf in batches:
            for k, s, t, d, mt, m in zip(pdf[name].astype(str), pdf["shape"], pdf["dtype"], pdf["data"], pdf["mask_dtype"], pdf["mask"]):
                yield f"{k}_overlay.png", png(overlaid(unpacked(list(s), t, d), unpacked(list(s), mt, m), alpha, colour, threshold))

    return pairs.select(name, "shape", "dtype", "data", "mask_dtype", "mask").mapInPandas(lambda batches: _frames(made(batches)), "name string, content binary")
