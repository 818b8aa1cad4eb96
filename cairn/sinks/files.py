"""Rows of (name, content) as files of a folder that all executors reach."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _safe(name: str) -> str:
    clean = posixpath.normpath(name.replace("\\", "/"))
    if clean.startswith(("/", "..")) or clean in (".", ""):
        raise ValueError(f"{name!r} leaves the folder")
    return clean


def saved(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's content and gives the number of files.

    Each file is written under a name of its own and then moved, so a task that runs twice leaves one whole file. Names
    must be unique and stay below the folder (a URI that pyarrow's file systems know, or an absolute path). Null contents
    give empty files; rows of a null name are passed over."""
    return _written(rows, folder, name, content).count()


def indexed(rows: DataFrame, folder: str, index: str, name: str = "name", content: str = "content") -> DataFrame:
    """As ``saved``, and gives (name, path) of the files: a table at ``index``, a folder that isn't there yet, from the tasks that wrote them.

    ``sources.files.contents_of`` reads them back by it, so that no machine lists the folder and holds all its files' names."""
    _written(rows, folder, name, content).write.parquet(index)
    return rows.sparkSession.read.schema("name string, path string").parquet(index)


def _written(rows: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """(name, path): each row's file, its path a place in the folder's store; written whenever this is computed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made = None
        for b in batches:
            paths = []
            for key, data in zip(b.column(0), b.column(1)):
                at = posixpath.join(root, _safe(key.as_py()))
                if made != (parent := posixpath.dirname(at)):  # files of one folder mostly come one after another
                    store.create_dir(parent, recursive=True)
                    made = parent
                part = f"{at}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(data.as_py() or b"")
                store.move(part, at)
                paths.append(at)
            yield pa.record_batch([b.column(0), pa.array(paths, pa.string())], names=["name", "path"])

    named = rows.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    return named.mapInArrow(run, "name string, path string")
