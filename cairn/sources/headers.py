"""Headers of part-10 files as a data source: pixels are never read, and filters on attributes and paths go to the scan.

A schema names what is wanted: path, length, bytes_read, parse_ok, parse_error, any attribute by its keyword, as a text, a
number, or an array of these, and tags, a map of all attributes' texts. Files are listed once and dealt in groups; a task opens its files one by one and
reads each from its beginning in doubling steps until the pixels begin. Filters on path and length are tested before a file
is opened. Any store that pyarrow's file systems know will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import MissingError, PlanError
from ..operators.hierarchy import usable_instances
from .dicom import PATIENT_TAGS, SERIES_TAGS, STUDY_TAGS, _text
from .dicom_format import TAG_OF, FormatError, decoded_head

FORMAT = "cairn_headers"
#: Columns that are no attributes.
OWN = {"path": T.StringType(), "length": T.LongType(), "bytes_read": T.LongType(), "parse_ok": T.BooleanType(), "parse_error": T.StringType()}
#: The column of all attributes as texts by keyword.
ALL = {"tags": T.MapType(T.StringType(), T.StringType())}
_UIDS = ("StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "SOPClassUID")
DEFAULT = T.StructType([*(T.StructField(k, t) for k, t in OWN.items()), *(T.StructField(k, T.StringType()) for k in (*_UIDS, *SERIES_TAGS, *STUDY_TAGS, *PATIENT_TAGS)), T.StructField("Rows", T.IntegerType()), T.StructField("Columns", T.IntegerType())])


def _as(kind: T.DataType) -> Callable[[object], object]:
    """What an attribute's value is in a column of the kind; null where it can't be that."""
    if isinstance(kind, T.ArrayType):
        one = _as(kind.elementType)
        return lambda v: None if v is None or v == "" else [one(x) for x in (v if isinstance(v, list) else [v])]
    if isinstance(kind, T.StringType):
        return lambda v: None if v is None or isinstance(v, bytes) or (isinstance(v, list) and v and isinstance(v[0], dict)) else "\\".join(map(str, v)) if isinstance(v, list) else str(v)
    if isinstance(kind, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType)):
        whole = isinstance(kind, (T.IntegerType, T.LongType))

        def number(v: object) -> float | int | None:
            try:
                x = float(v[0] if isinstance(v, list) else v)
                return int(x) if whole else x
            except (TypeError, ValueError, IndexError, OverflowError):
                return None

        return number
    raise PlanError(f"no attribute comes as {kind.simpleString()}")


#: What each kind of filter asks of a value that isn't null.
_TESTS: dict[type, Callable[[object, D.Filter], bool]] = {
    D.EqualTo: lambda v, f: v == f.value, D.In: lambda v, f: v in f.value,
    D.GreaterThan: lambda v, f: v > f.value, D.GreaterThanOrEqual: lambda v, f: v >= f.value, D.LessThan: lambda v, f: v < f.value, D.LessThanOrEqual: lambda v, f: v <= f.value,
    D.StringStartsWith: lambda v, f: v.startswith(f.value), D.StringEndsWith: lambda v, f: v.endswith(f.value), D.StringContains: lambda v, f: f.value in v,
}


def passes(f: D.Filter, row: dict[str, object]) -> bool:
    """Whether the row stays; a comparison with null is no reason to stay."""
    v = row[f.attribute[0]]
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return (v is None) == isinstance(f, D.IsNull)
    if isinstance(f, D.EqualNullSafe):
        return v == f.value
    return v is not None and _TESTS[type(f)](v, f)


@dataclass
class Group(D.InputPartition):
    """Files that one task reads: (path, length)."""

    files: list[tuple[str, int]]


class Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.folder = options.get("path")
        if not self.folder:
            raise PlanError("the option path names the folder")
        self.per_task, self.first = int(options.get("filespertask", 2000)), int(options.get("firstbytes", 16384))
        unknown = [f.name for f in schema if f.name not in OWN | ALL | TAG_OF]
        if unknown:
            raise MissingError(f"no attribute {', '.join(unknown)}")
        for f in schema:
            if f.name not in OWN | ALL:
                _as(f.dataType)
        self.pushed: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            known = isinstance(f, (*_TESTS, D.IsNull, D.IsNotNull, D.EqualNullSafe)) and len(f.attribute) == 1
            if known and not isinstance(kinds[f.attribute[0]], (T.ArrayType, T.MapType)):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[Group]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_")))
        early = [f for f in self.pushed if f.attribute[0] in ("path", "length")]
        found = [x for x in found if all(passes(f, {"path": x[0], "length": x[1]}) for f in early)]
        return [Group(found[at : at + self.per_task]) for at in range(0, len(found), self.per_task)] or [Group([])]

    def row(self, store: object, path: str, length: int, reads: dict[str, Callable], with_all: bool) -> dict[str, object]:
        row = {"path": path, "length": length, "bytes_read": 0, "parse_ok": True, "parse_error": None} | dict.fromkeys(reads)
        try:
            with store.open_input_file(path) as f:
                data = f.read(max(132, self.first))
                while True:
                    row["bytes_read"] = len(data)
                    try:
                        values, _, reached = decoded_head(data)
                        if reached or len(data) >= length:
                            break
                    except FormatError:
                        if len(data) >= length or data[128:132] != b"DICM":
                            raise
                    more = f.read(len(data))
                    if not more:
                        break
                    data += more
            row |= {k: read(values.get(k)) for k, read in reads.items()}
            if with_all:
                row["tags"] = [(k, t) for k, x in values.items() if (t := _text(x)) is not None]
        except Exception as e:  # one bad file never ends the scan: its reason is its row
            row |= {"parse_ok": False, "parse_error": f"{type(e).__name__}: {e}"}
        return row

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        shape = to_arrow_schema(self.schema)
        wanted = {f.name for f in self.schema} | {f.attribute[0] for f in self.pushed}
        kinds = {f.name: f.dataType for f in self.schema}
        reads, with_all = {k: _as(kinds[k]) for k in sorted(wanted - set(OWN | ALL))}, bool(wanted & set(ALL))
        held = []
        for path, length in partition.files:
            row = self.row(store, path, length, reads, with_all)
            if all(passes(f, row) for f in self.pushed):
                held.append({k: row.get(k) for k in shape.names})
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, shape)


class Headers(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return DEFAULT

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, {k.lower(): v for k, v in self.options.items()})


def headers(spark: SparkSession, folder: str, schema: T.StructType | str | None = None, files_per_task: int = 2000, first_bytes: int = 16384) -> DataFrame:
    """The headers below a folder (a URI or an absolute path), with the attributes that the schema names."""
    spark.dataSource.register(Headers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("filesPerTask", files_per_task).option("firstBytes", first_bytes)
    return (reader.schema(schema) if schema else reader).load(folder)


def instances(spark: SparkSession, folder: str) -> DataFrame:
    """Usable instances as ``dicom.loaded`` gives them, by their headers alone: what selection rules need, and path."""
    kind = "path string, parse_ok boolean, StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, SOPClassUID string, ImageOrientationPatient array<double>, tags map<string,string>"
    named = {"StudyInstanceUID": "study_uid", "SeriesInstanceUID": "series_uid", "SOPInstanceUID": "sop_uid", "SOPClassUID": "sop_class_uid", "ImageOrientationPatient": "orientation"}
    return usable_instances(headers(spark, folder, kind).where("parse_ok").withColumnsRenamed(named))
