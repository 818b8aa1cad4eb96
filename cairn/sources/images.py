"""Picture files as float arrays: folders decoded in the JVM by Spark's image source, PNG files of known names in Arrow workers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import stem
from .files import with_extension

#: Kinds of picture that are read (fixed values).
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif")


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, n_channels, data): bytes row by row, channels in the order blue, green, red. Files that can't be read go."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select("image.*")
    return with_extension(read.withColumn("path", F.col("origin")), EXTENSIONS).select("path", "height", "width", F.col("nChannels").alias("n_channels"), "data")


def rgb(spark: SparkSession, folder: str, channel_first: bool = True) -> DataFrame:
    """(path, filename, original_shape, source_format, shape, values array<float>): red, green, blue; grey ones repeated, transparency dropped."""
    p = pictures(spark, folder)
    px, n, c = F.col("height") * F.col("width"), F.col("n_channels"), F.lit(3)
    # the hexadecimal text is the way to single bytes that stays within expressions
    byte = lambda at: F.conv(F.substring(F.col("hex_"), 2 * at + 1, F.lit(2)), 16, 10).cast("float")
    channel = lambda i: F.when(n == 1, F.lit(0)).otherwise(2 - i)
    pixel, colour = (lambda k: k % px, lambda k: (k / px).cast("int")) if channel_first else (lambda k: (k / c).cast("int"), lambda k: k % c)
    places = F.when(px > 0, F.sequence(F.lit(0), px * 3 - 1)).otherwise(F.array().cast("array<int>"))
    shape = F.array(F.lit(3), "height", "width") if channel_first else F.array("height", "width", F.lit(3))
    name = F.element_at(F.split("path", "/"), -1)
    return p.withColumn("hex_", F.hex("data")).select(
        "path", stem(name).alias("filename"), F.array("height", "width", n).alias("original_shape"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("source_format"),
        shape.alias("shape"), F.transform(places, lambda k: byte(pixel(k) * n + channel(colour(k)))).alias("values"),
    )


def png_pixels(data: bytes) -> np.ndarray:
    """(rows, cols, channels) of a PNG of 8 bits a sample, grey or in colours, with transparency or without; palettes, other depths and interlaced ones raise."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, kind, head, packed = 8, b"", b"", []
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("a PNG that ends early")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a damaged PNG")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    cols, rows, depth, colour, _, _, interlaced = struct.unpack(">2I5B", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError(f"a PNG of kind {colour}, {depth} bits{', interlaced' if interlaced else ''}")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, 1 + cols * channels)
    filters, out = lines[:, 0], lines[:, 1:].reshape(rows, cols, channels)
    return _unfiltered(filters.tolist(), out) if filters.any() else out


def _unfiltered(filters: list[int], lines: np.ndarray) -> np.ndarray:
    """Samples of lines that hold differences from the left (1), from above (2), from both's mean (3) or from the nearest of three (4)."""
    out = np.zeros((lines.shape[0] + 1, lines.shape[1] + 1, lines.shape[2]), np.uint8)  # nothing above and to the left
    for y, (kind, line) in enumerate(zip(filters, lines), 1):
        if kind == 0:
            out[y, 1:] = line
        elif kind == 1:
            out[y, 1:] = np.cumsum(line, 0, dtype=np.uint8)
        elif kind == 2:
            out[y, 1:] = line + out[y - 1, 1:]
        elif kind in (3, 4):
            for x, v in enumerate(line, 1):
                a, b, c = (p.astype(int) for p in (out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]))
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                out[y, x] = (v + guess) % 256
        else:
            raise ValueError(f"a PNG with filter {kind}")
    return out[1:, 1:]


def rgb_of(found: DataFrame, channel_first: bool = True, most_bytes: int = 1 << 20) -> DataFrame:
    """found with shape and values as ``rgb`` gives them, of its PNG files' content. What ``png_pixels`` doesn't know raises.

    Pictures are handed on so many bytes of values together, or a single one of more."""
    kept = [f for f in found.schema.fields if f.name != "content"]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])

    def given(b: pa.RecordBatch, start: int, made: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [a.size for a in made], dtype=np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a.ravel() for a in made]).astype(np.float32)))
        shapes = pa.array([list(a.shape) for a in made], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*b.slice(start, len(made)).columns[:-1], shapes, values], names=[*names, "shape", "values"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, held, made = 0, 0, []
            for data in b.column(len(names)):
                a = png_pixels(data.as_py())
                a = a[..., :3] if a.shape[2] > 2 else np.repeat(a[..., :1], 3, -1)
                if made and held + 4 * a.size > most_bytes:
                    yield given(b, start, made)
                    start, held, made = start + len(made), 0, []
                made.append(np.moveaxis(a, -1, 0) if channel_first else a)
                held += 4 * a.size
            if made:
                yield given(b, start, made)

    return found.select(*names, "content").mapInArrow(run, schema)


def first_grey(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, values array<double>) of the first picture by path, in grey by the usual weights of red, green and blue."""
    one = rgb(spark, folder, False).orderBy("path").limit(1)
    h, w = F.col("shape")[0], F.col("shape")[1]
    at = lambda k, i: F.get("values", 3 * k + i).cast("double")
    grey = F.transform(F.sequence(F.lit(0), h * w - 1), lambda k: F.floor((at(k, 0) * 299 + at(k, 1) * 587 + at(k, 2) * 114) / 1000).cast("double"))
    return one.select("path", h.alias("height"), w.alias("width"), grey.alias("values"))
