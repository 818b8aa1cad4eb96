"""Volumes as pairs of files: a text header (.mhd) and the raw file that it names.

Headers are read and parsed as columns; raw files are met by path only and opened, one by one, by the tasks that decode
them. A half without its other, or a pair that doesn't fit, is a row with its reason.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import contents, contents_of, with_extension

#: Types of elements by name (fixed values).
KINDS = {"MET_UCHAR": "uint8", "MET_CHAR": "int8", "MET_USHORT": "uint16", "MET_SHORT": "int16", "MET_UINT": "uint32", "MET_INT": "int32", "MET_FLOAT": "float32", "MET_DOUBLE": "float64"}
RAW = (".raw", ".zraw")
_NUMBERS = T.ArrayType(T.DoubleType())


def fields_of(text: Column) -> Column:
    """A header's "name = value" lines as a map; the last of a name counts."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"])))


def _numbers(text: Column) -> Column:
    return F.when(text.isNotNull(), F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double")))


def _yes(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1"), F.lit(False))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw_path, dims, dtype, spacing, origin, direction, compressed, big, channels, reason) of each header."""
    text = with_extension(contents(spark, folder), (".mhd",)).select("path", fields_of(F.decode("content", "UTF-8")).alias("f"))
    f = lambda *names: F.coalesce(*[F.col("f")[n] for n in names])
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), f("ElementType"))
    dims = _numbers(f("DimSize"))
    bad_dims = dims.isNull() | F.exists(dims, lambda x: x.isNull() | (x < 1) | (x != F.floor(x))) | (F.size(dims) != f("NDims").try_cast("int"))
    name = f("ElementDataFile")
    reason = F.when(F.coalesce(bad_dims, F.lit(True)), "no sizes").when(kind.isNull(), "unknown type").when(name.isNull() | (name == ""), "no data file is named").when(name.isin("LOCAL", "LIST"), "data file of another form")
    folder_of = F.regexp_replace("path", "[^/]*$", "")
    return text.select(
        "path", F.when(reason.isNull(), F.concat(folder_of, name)).alias("raw_path"), dims.cast("array<int>").alias("dims"), kind.alias("dtype"), _numbers(f("ElementSpacing", "ElementSize")).alias("spacing"),
        _numbers(f("Offset", "Position", "Origin")).alias("origin"), _numbers(f("TransformMatrix", "Orientation", "Rotation")).alias("direction"), _yes(f("CompressedData")).alias("compressed"),
        _yes(f("BinaryDataByteOrderMSB", "ElementByteOrderMSB")).alias("big"), F.coalesce(f("ElementNumberOfChannels").try_cast("int"), F.lit(1)).alias("channels"), reason.alias("reason"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """headers, each with its raw file if there is one; and a row with a reason for each raw file that no header names."""
    raws = with_extension(contents(spark, folder).select("path"), RAW).select(F.col("path").alias("found"))
    named = headers(spark, folder)
    both = named.join(raws, F.col("raw_path") == F.col("found"), "full_outer")
    why = F.coalesce("reason", F.when(F.col("path").isNull(), "no header names it").when(F.col("found").isNull(), "its data file is not there"))
    return both.select(F.coalesce("path", "found").alias("path"), F.col("found").alias("raw_path"), *[c for c in named.columns if c not in ("path", "raw_path", "reason")], why.alias("reason"))


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, shape, dtype, data, spacing, origin, direction, reason): packed volumes, slowest axis first (channels last, if several); null shape and data with a reason."""
    found = pairs(spark, folder)
    keep = ["path", "spacing", "origin", "direction"]
    whole = found.where("reason IS NULL").withColumnsRenamed({"path": "header", "raw_path": "path"})
    opened = contents_of(whole.select("header", "path", "dims", "dtype", "compressed", "big", "channels", *keep[1:]), folder)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("dtype", T.StringType()), T.StructField("data", T.BinaryType()), *(T.StructField(c, _NUMBERS) for c in keep[1:]), T.StructField("reason", T.StringType())])

    def volume(own: dict) -> tuple[bytes | None, str | None]:
        kind = np.dtype(own["dtype"])
        try:
            data = zlib.decompress(own["content"]) if own["compressed"] else own["content"]
        except zlib.error as e:
            return None, f"compressed data that can't be read: {e}"
        need = int(np.prod(own["dims"])) * own["channels"] * kind.itemsize
        if len(data) != need:
            return None, f"{len(data)} bytes where {need} were due"
        return (np.frombuffer(data, kind.newbyteorder(">")).astype(kind.newbyteorder("<")).tobytes() if own["big"] else data), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in pdf.to_dict("records"):
                data, reason = volume(own)
                shape = [int(n) for n in own["dims"]][::-1] + [own["channels"]] * (own["channels"] > 1)
                yield pd.DataFrame([{"path": own["header"], "shape": shape if data is not None else None, "dtype": own["dtype"], "data": data, **{c: own[c] for c in keep[1:]}, "reason": reason}])

    good = opened.mapInPandas(run, schema)
    none = lambda c: F.lit(None).cast(schema[c].dataType).alias(c)
    lost = found.where("reason IS NOT NULL").select("path", none("shape"), "dtype", none("data"), *keep[1:], "reason")
    return good.unionByName(lost)
