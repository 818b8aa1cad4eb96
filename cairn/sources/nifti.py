"""Volumes of NIfTI-1 files (.nii, .nii.gz), read and encoded."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.volume import unpacked
from .files import contents, with_extension

#: Numbers of the format's value types (fixed values).
TYPES = {2: "uint8", 4: "int16", 8: "int32", 16: "float32", 64: "float64", 256: "int8", 512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64"}
VOLUME = "path string, ok boolean, error string, shape array<int>, dtype string, data binary, affine array<array<double>>"


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(array in the file's axis order x, y, z, ...; 4 x 4 affine). Stored slope and intercept are applied."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < 348:
        raise ValueError("shorter than a header")
    o = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(f"{o}i", data)[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack_from(f"{o}8h", data, 40)
    kind = TYPES.get(struct.unpack_from(f"{o}h", data, 70)[0])
    if kind is None or not 1 <= dims[0] <= 7:
        raise ValueError(f"unsupported type or dimensions {dims[0]}")
    shape, spacing = dims[1 : dims[0] + 1], struct.unpack_from(f"{o}8f", data, 76)
    offset, slope, inter = struct.unpack_from(f"{o}3f", data, 108)
    n = int(np.prod(shape, dtype=np.int64))
    array = np.frombuffer(data, np.dtype(kind).newbyteorder(o), n, int(offset)).reshape(shape, order="F").astype(kind)
    if slope not in (0.0, 1.0) or (slope and inter):
        array = array * float(slope) + float(inter)
    q_code, s_code = struct.unpack_from(f"{o}2h", data, 252)
    affine = np.eye(4)
    if s_code > 0:
        affine[:3] = np.array(struct.unpack_from(f"{o}12f", data, 280)).reshape(3, 4)
    elif q_code > 0:
        b, c, d, x, y, z = struct.unpack_from(f"{o}6f", data, 256)
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * np.array([spacing[1], spacing[2], spacing[3] * (-1 if spacing[0] < 0 else 1)])
        affine[:3, 3] = x, y, z
    else:
        affine[:3, :3] = np.diag(spacing[1:4])
    return array, affine


def encoded(array: np.ndarray, affine: np.ndarray | None = None, zipped: bool = True) -> bytes:
    """A single file of float32 values (x, y, z, ...), as the engine's writers store volumes; the same array gives the same bytes."""
    array = np.asarray(array, np.float32)
    affine = np.eye(4) if affine is None else np.asarray(affine, float)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, array.ndim, *array.shape, *[1] * (7 - array.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *np.linalg.norm(affine[:3, :3], axis=0), *[1.0] * 4)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    out = bytes(head) + array.tobytes(order="F")
    return gzip.compress(out, 6, mtime=0) if zipped else out


def volumes(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, ok, error, shape, dtype, data, affine) of each file: axes in reverse order (z, y, x), a fourth (time or vector) axis last.

    A file that can't be read has ok false and the reason."""
    files = with_extension(contents(spark, folder, recursive), (".nii", ".nii.gz")).select("path", "content")
    arrow = pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("data", pa.binary()), ("affine", pa.list_(pa.list_(pa.float64())))])

    def row(path: str, data: bytes) -> dict[str, object]:
        try:
            array, affine = decoded(data)
            array = array.transpose(*reversed(range(min(3, array.ndim))), *range(3, array.ndim))
            little = array.astype(array.dtype.newbyteorder("<"))
            return {"path": path, "ok": True, "shape": list(array.shape), "dtype": array.dtype.name, "data": np.ascontiguousarray(little).tobytes(), "affine": affine.tolist()}
        except Exception as e:  # a bad file is a row of its own
            return {"path": path, "ok": False, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):  # one volume at a time
                yield pa.RecordBatch.from_pylist([row(path.as_py(), data.as_py() or b"")], schema=arrow)

    return files.mapInArrow(run, VOLUME)


def files_of(packed: DataFrame, key: str, postfix: str = "seg", extension: str = ".nii.gz") -> DataFrame:
    """(name, content): <key>_<postfix><extension> for each packed volume (shape [z, y, x] or with axes of length one before it, dtype, data, affine).

    A null affine is the identity; a postfix that names a transform by @ becomes trans."""
    tail = f"_{'trans' if postfix.startswith('@') else postfix}{extension}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, s, t, d, m in zip(pdf[key], pdf["shape"], pdf["dtype"], pdf["data"], pdf["affine"]):
                array = unpacked(list(s), t, d)
                while array.ndim > 3 and array.shape[0] == 1:
                    array = array[0]
                affine = None if m is None else np.array([list(r) for r in m])
                yield pd.DataFrame({"name": [f"{k}{tail}"], "content": [encoded(array.transpose(*reversed(range(array.ndim))), affine, extension.endswith(".gz"))]})

    return packed.select(key, "shape", "dtype", "data", "affine").mapInPandas(run, "name string, content binary")
