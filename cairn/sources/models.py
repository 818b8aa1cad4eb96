"""Model files: which kind they are, named repositories, configurations within folders and archives."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError

#: A served model's folder has this file; configurations have these suffixes, best first (fixed values).
SERVED = "config.pbtxt"
SUFFIXES = (".json", ".yaml", ".yml")


def archives(files: DataFrame) -> DataFrame:
    """(path, entries): names within each (path, content) that is a zip archive, in its order; null for other files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    entries = zipfile.ZipFile(io.BytesIO(data.as_py() or b"")).namelist()
                except zipfile.BadZipFile:
                    entries = None
                yield pa.record_batch([pa.array([path]), pa.array([entries], pa.list_(pa.string()))], names=["path", "entries"])

    return files.select("path", "content").mapInArrow(run, "path string, entries array<string>")


def is_script(entries: Column) -> Column:
    """Whether an archive is a saved script module: data, code and constants below its top folder. Never null."""
    first = F.get(entries, F.lit(0))
    top = F.when(F.contains(first, F.lit("/")), F.concat(F.substring_index(first, "/", 1), F.lit("/"))).otherwise(F.lit(""))
    below = lambda name: F.exists(entries, lambda e: F.startswith(e, F.concat(top, F.lit(name))))
    whole = lambda name: F.array_contains(entries, F.concat(top, F.lit(name)))
    return F.coalesce(whole("data.pkl") & below("code/") & (whole("constants.pkl") | below("constants/")), F.lit(False))


def repository(found: DataFrame, root: str) -> DataFrame:
    """(model, path, kind) of a repository of named models: found has (path, entries) of all files below the root.

    A repository holds folders only, each with one file or folder, or with the file that tells how it is served;
    anything else is no repository and gives no rows. Folders whose model is of no known kind go."""
    rel = F.substring(F.col("path"), F.length(F.lit(root.rstrip("/"))) + 2, F.length("path"))
    parts = F.split(rel, "/")
    rows = found.where(F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/"))).select("path", "entries", parts.alias("parts"), F.size(parts).alias("depth"))
    folders = rows.where("depth > 1").groupBy(F.get("parts", F.lit(0)).alias("model")).agg(
        F.count_distinct(F.get("parts", F.lit(1))).alias("n"), F.bool_or((F.col("depth") == 2) & (F.get("parts", F.lit(1)) == SERVED)).alias("served"),
        F.min("path").alias("file"), F.bool_or(is_script(F.col("entries")) & (F.col("depth") == 2)).alias("script"),
    )
    against = rows.where("depth = 1").select("path").union(folders.where("n <> 1 AND NOT served").select("model"))
    good = folders if against.isEmpty() else folders.where(F.lit(False))
    kind = F.when(F.col("served"), "served").when(F.col("script"), "script")
    return good.select("model", F.when(F.col("served"), F.concat(F.lit(root.rstrip("/") + "/"), "model")).otherwise(F.col("file")).alias("path"), kind.alias("kind")).where("kind IS NOT NULL")


def kinds(found: DataFrame) -> DataFrame:
    """(path, kind): script for saved script modules, else generic."""
    return found.select("path", F.when(is_script(F.col("entries")), "script").otherwise("generic").alias("kind"))


def chosen(models: DataFrame, name: str = "") -> DataFrame:
    """The model of the name; without a name the only one there is. Raises if that isn't one model."""
    out = models.where(F.col("model") == name) if name else models
    n = len(out.select("model").limit(2).collect())
    if n > 1 or (name and not n):
        raise PlanError(f"{'no' if not n else 'more than one'} model {name}".strip())
    return out


def members(files: DataFrame, pattern: str) -> DataFrame:
    """(path, member, content) of the archives' files whose name matches the pattern, case aside. Names that leave the archive raise."""
    import re

    wanted = re.compile(pattern, re.IGNORECASE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                for name in archive.namelist():
                    if name.startswith("/") or ".." in posixpath.normpath(name).split("/"):
                        raise ValueError(f"{path}: {name!r} leaves the archive")
                    if wanted.search(name) and not name.endswith("/"):
                        yield pa.record_batch([pa.array([path]), pa.array([name]), pa.array([archive.read(name)], pa.binary())], names=["path", "member", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def configs(found: DataFrame, names: list[str]) -> DataFrame:
    """(path, name, member, config): for each bundle and name the best (path, member, content): suffix order, spelling as given before other spellings, then by member."""
    file = F.element_at(F.split("member", "/"), -1)
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("k"), F.lit(n + s).alias("file")) for n in names for k, s in enumerate(SUFFIXES)]))
    hits = found.select("*", file.alias("own"), wanted.alias("w")).where(F.lower("own") == F.lower("w.file"))
    order = F.struct((F.col("own") != F.col("w.file")).alias("other"), F.col("w.k").alias("k"), "member")
    best = hits.groupBy("path", F.col("w.name").alias("name")).agg(F.min_by(F.struct("member", F.decode("content", "UTF-8").alias("config")), order).alias("b"))
    return best.select("path", "name", "b.*")
