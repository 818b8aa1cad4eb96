"""A store of JSON documents in a shared folder: appended to exactly once, read with the last of each id.

Format ``cairn_documents``: rows (collection, id, document). A task writes its rows to a file of its own that nobody reads
yet; when all tasks have ended, the driver publishes the batch by one small file that names those of the tasks that counted.
A task that died or ran twice leaves a file that no batch names; a batch that is written again under its name changes
nothing. Options: path (a URI or an absolute path) and batch, a text that orders batches (none: the time). Within and
between batches an id has one document, that of the last batch (of one batch the greatest text).
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError

FORMAT = "cairn_documents"
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("collection", "id", "document")])
#: Folders of the store.
DATA, BATCHES = "data", "batches"


@dataclass
class Written(D.WriterCommitMessage):
    """A task's file, relative to the store, and its number of documents; no file where it had none."""

    file: str | None
    documents: int


class Writer(D.DataSourceArrowWriter):
    def __init__(self, folder: str, batch: str, overwrite: bool):
        self.folder, self.batch, self.overwrite = folder, batch, overwrite

    def _store(self) -> tuple[object, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        store, root = self._store()
        name, n, out = f"{DATA}/{self.batch}/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for rows in iterator:
                if rows.column(rows.schema.get_field_index("id")).null_count:
                    raise ValueError("a document without an id")
                if rows.num_rows and out is None:
                    store.create_dir(posixpath.dirname(posixpath.join(root, name)), recursive=True)
                    out = pq.ParquetWriter(posixpath.join(root, name), rows.schema, filesystem=store, compression="zstd")
                if rows.num_rows:
                    out.write_batch(rows)
                    n += rows.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        at = posixpath.join(root, BATCHES, f"{self.batch}.json")
        if store.get_file_info(at).is_file:  # published before: this run's files are of no use
            self.abort(messages)
            return
        kept = [m for m in messages if m is not None and m.file]
        store.create_dir(posixpath.dirname(at), recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            f.write(json.dumps({"replaces": self.overwrite, "files": sorted(m.file for m in kept), "documents": sum(m.documents for m in kept)}).encode())
        store.move(part, at)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        for m in messages:
            if m is not None and m.file:
                store.delete_file(posixpath.join(root, m.file))


class Documents(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        own = {k.lower(): v for k, v in self.options.items()}
        if not own.get("path"):
            raise PlanError("the option path names the store")
        if [f.name for f in schema] != SCHEMA.names:
            raise PlanError(f"documents are rows of {', '.join(SCHEMA.names)}, not of {', '.join(f.name for f in schema)}")
        batch = own.get("batch") or f"{time.time_ns():020d}"
        if "/" in batch or batch.startswith("."):
            raise PlanError(f"no name of a batch: {batch!r}")
        return Writer(own["path"], batch, overwrite)


def document_id(*keys: str) -> Column:
    """24 hexadecimal digits made of key columns: the same whenever a row is made again. Nulls are a key."""
    return F.substring(F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256), 1, 24)


def append(documents: DataFrame, folder: str, batch: str | int | None = None, overwrite: bool = False) -> None:
    """Writes (collection, id, document) to the store; whole numbers order batches by size. overwrite: the batch hides all before it."""
    documents.sparkSession.dataSource.register(Documents)
    writer = documents.select(*SCHEMA.names).write.format(FORMAT).option("path", folder)
    name = f"{batch:020d}" if isinstance(batch, int) else batch
    (writer.option("batch", name) if name is not None else writer).mode("overwrite" if overwrite else "append").save()


def batches(spark: SparkSession, folder: str) -> list[tuple[str, dict]]:
    """The published batches in order, each with its files; those that a later one hides are left out."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    listed = store.get_file_info(fs.FileSelector(posixpath.join(root, BATCHES), allow_not_found=True))
    found = []
    for x in sorted(x.path for x in listed if x.is_file and x.path.endswith(".json")):
        with store.open_input_stream(x) as f:
            found.append((posixpath.basename(x)[: -len(".json")], json.loads(f.read())))
    last = max((k for k, (_, b) in enumerate(found) if b["replaces"]), default=0)
    return found[last:]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(collection, id, document): each document once, as its last batch has it."""
    paths = [f"{folder.rstrip('/')}/{name}" for _, b in batches(spark, folder) for name in b["files"]]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*paths)
    batch = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    last = rows.select("collection", "id", F.struct(batch.alias("batch"), "document").alias("d")).groupBy("collection", "id").agg(F.max("d").alias("d"))
    return last.select("collection", "id", "d.document")
