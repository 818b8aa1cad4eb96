"""Folders of files as tables: sorted listings, contents by extension."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MissingError, PlanError
from ..functions.scalars import stem
from ..operators.hierarchy import numbered


def contents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of each file; content is read only where a plan asks for it. Spark's reader passes over empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)


def contents_of(paths: DataFrame, folder: str, most_bytes: int = 1 << 20, most_rows: int = 512) -> DataFrame:
    """paths with the content of each file: tasks open the files themselves, so what isn't listed isn't read.

    folder: the URI (or absolute path) whose store the paths, URIs or places in that store, lie in. A file that has gone raises.
    Files are handed on so many bytes or rows together, or a single one of more."""
    schema = T.StructType([*paths.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder)
        for b in batches:
            start, held, read = 0, 0, []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                if path.startswith("file:"):
                    path = "/" + path[len("file:") :].lstrip("/")
                elif scheme and path.startswith(scheme[0]):
                    path = store.from_uri(path)[1]
                with store.open_input_file(path) as f:
                    if read and (held + f.size() > most_bytes or len(read) == most_rows):
                        yield _with_contents(b.slice(start, len(read)), read)
                        start, held, read = start + len(read), 0, []
                    read.append(f.read())
                held += len(read[-1])
            if read:
                yield _with_contents(b.slice(start), read)

    return paths.mapInArrow(run, schema)


def _with_contents(batch: pa.RecordBatch, read: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(read, pa.binary())], names=[*batch.schema.names, "content"])


def dealt(df: DataFrame, small: int = 32 << 20) -> DataFrame:
    """A table of less than a split, which may be one row group that one task reads alone, dealt to all cores; for work in workers."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df


def parts(batches: Iterable[pd.DataFrame], rows: int = 128) -> Iterator[pd.DataFrame]:
    """Small slices of pandas batches, so that what is made of them, files and the like, exists for few rows at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def rows_by_bytes(batches: Iterable[pd.DataFrame], column: str, most_bytes: int = 1 << 20, most_rows: int = 128) -> Iterator[pd.DataFrame]:
    """Slices of pandas batches whose contents have so many bytes together, or a single row of more."""
    for pdf in batches:
        start = held = 0
        for k, data in enumerate(pdf[column]):
            n = len(data or b"")
            if k > start and (held + n > most_bytes or k - start == most_rows):
                yield pdf.iloc[start:k]
                start, held = k, 0
            held += n
        if start < len(pdf):
            yield pdf.iloc[start:]


def by_bytes(batch: pa.RecordBatch, at: int, most_bytes: int = 1 << 20, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch whose contents (the column ``at``) have so many bytes together, or a single file of more."""
    sizes, start, held = [n or 0 for n in pc.binary_length(batch.column(at)).to_pylist()], 0, 0
    for k, n in enumerate(sizes):
        if k > start and (held + n > most_bytes or k - start == most_rows):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def with_extension(rows: DataFrame, extensions: tuple[str, ...], case_sensitive: bool = False) -> DataFrame:
    """Files of the extensions (with or without the dot, compound ones too); hidden files go."""
    name = F.element_at(F.split("path", "/"), -1)
    shown = name if case_sensitive else F.lower(name)
    ends = [e if e.startswith(".") else f".{e}" for e in extensions]
    hit = F.lit(False)
    for e in ends:
        hit = hit | F.endswith(shown, F.lit(e if case_sensitive else e.lower()))
    return rows.where(hit & ~F.startswith(name, F.lit(".")))


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = True, case_sensitive: bool = False) -> DataFrame:
    """(file_path, filename, file_index, total_files, size), numbered by path."""
    found = with_extension(contents(spark, folder, recursive).select("path", "length"), extensions, case_sensitive)
    named = found.select(F.col("path").alias("file_path"), stem(F.element_at(F.split("path", "/"), -1)).alias("filename"), F.col("length").alias("size"))
    return numbered(named, ["file_path"], "file_index", "total_files").select("file_path", "filename", "file_index", "total_files", "size")


def others(found: DataFrame, *known: DataFrame, path: str = "path") -> DataFrame:
    """The files that none of the known lists has."""
    for k in known:
        found = found.join(k.select(path), path, "left_anti")
    return found


def first_file(found: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """The first file by path that has one of the extensions; raises if there is none."""
    out = with_extension(found, extensions).orderBy("path").limit(1)
    if out.isEmpty():
        raise MissingError(f"no file ending with {', '.join(extensions)}")
    return out


def only_file(found: DataFrame) -> DataFrame:
    """The one file there is; raises if there are none or more."""
    n = len(found.select("path").limit(2).collect())
    if n != 1:
        raise PlanError(f"{'no' if not n else 'more than one'} file")
    return found


def arrays(files: DataFrame) -> DataFrame:
    """(path, shape, dtype, data) of .npy files, packed as volumes are. Object arrays, which would run code, raise."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                a = np.load(io.BytesIO(data.as_py() or b""), allow_pickle=False)
                raw = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes()
                yield pa.record_batch([pa.array([path]), pa.array([list(a.shape)], pa.list_(pa.int32())), pa.array([a.dtype.name]), pa.array([raw], pa.binary())], names=["path", "shape", "dtype", "data"])

    return files.select("path", "content").mapInArrow(run, "path string, shape array<int>, dtype string, data binary")


def validated(listed: DataFrame, path: str = "file_path") -> DataFrame:
    """(ok, message): whether there are results at all, and how many of which kind."""
    n = kinds(listed, path)
    names = {"json": "JSON files", "nifti": "NIfTI files", "image": "image files", "other": "other files"}
    told = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {what}"))) for k, what in names.items()]))
    return n.select((F.size(told) > 0).alias("ok"), F.when(F.size(told) > 0, F.concat(F.lit("Generated "), F.array_join(told, ", "))).otherwise("No result files generated").alias("message"))


def kinds(listed: DataFrame, path: str = "file_path") -> DataFrame:
    """Counts of JSON, NIfTI, image and other files."""
    p = F.lower(F.col(path))
    json_, nifti, image = F.endswith(p, F.lit(".json")), p.rlike(r"\.(nii|gz)$"), p.rlike(r"\.(png|jpe?g|tiff)$")
    return listed.agg(F.count_if(json_).alias("json"), F.count_if(nifti).alias("nifti"), F.count_if(image).alias("image"), F.count_if(~json_ & ~nifti & ~image).alias("other"))


def digests(rows: DataFrame) -> DataFrame:
    """(path, sha256) of each file."""
    return rows.select("path", F.sha2("content", 256).alias("sha256"))


def folder_digests(spark: SparkSession, folder: str, whole: int = 256 << 20) -> DataFrame:
    """(path, sha256) of each file below a folder, of any length.

    Files of up to ``whole`` bytes come through Spark's reader, which holds a file in memory and refuses 2 GB and more.
    Longer ones are opened by their tasks, one file a task, and read in steps; a digest is one sequence, so a file is read by one task."""
    found = contents(spark, folder)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                digest = hashlib.sha256()
                with _opened(path) as f:
                    while step := f.read(8 << 20):
                        digest.update(step)
                yield pa.record_batch([pa.array([path]), pa.array([digest.hexdigest()])], names=["path", "sha256"])

    long_ = found.where(F.col("length") > whole).select("path")
    return digests(found.where(F.col("length") <= whole)).unionByName(long_.repartition("path").mapInArrow(run, schema))


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_stream(at)


def tree_digest(rows: DataFrame) -> DataFrame:
    """(sha256) of a tree: of its files' digests in order of their paths; no content leaves its task."""
    each = digests(rows).agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("d"))
    return each.select(F.sha2(F.array_join(F.transform("d", lambda x: x["sha256"]), ""), 256).alias("sha256"))
