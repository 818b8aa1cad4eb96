"""Folders of part-10 files as instances, series and studies.

Files are read by Spark's own reader, so any store will do, and parsed in Arrow workers a batch at a time. A file that
can't be parsed gives a row with parse_ok false and the reason; only empty files, which Spark's reader passes over, give none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..operators.hierarchy import usable_instances
from .dicom_format import PLAIN, decoded
from .files import by_bytes, contents

#: Columns of an instance.
INSTANCE = (
    "path string, parse_ok boolean, parse_error string, study_uid string, series_uid string, sop_uid string, sop_class_uid string, position array<double>, acquisition_number int, "
    "orientation array<double>, pixel_spacing array<double>, rows int, cols int, dtype string, slope double, intercept double, photometric string, pixels binary, tags map<string,string>"
)
#: Attributes of a series' and of a study's first instance that its row has (fixed values).
SERIES_TAGS = ("SeriesDate", "SeriesTime", "Modality", "SeriesDescription", "BodyPartExamined", "PatientPosition", "Laterality", "SeriesNumber")
STUDY_TAGS = ("StudyID", "StudyDate", "StudyTime", "StudyDescription", "AccessionNumber")
PATIENT_TAGS = ("PatientID", "PatientName", "PatientBirthDate", "PatientSex")


def _numbers(v: object, n: int) -> list[float] | None:
    if not isinstance(v, list) or len(v) != n:
        return None
    return [float(x) for x in v]


def _number(v: object, kind: type) -> float | int | None:
    v = v[0] if isinstance(v, list) and v else v
    return None if v in (None, "", []) else kind(float(v))


def _text(v: object) -> str | None:
    """Lists as "[a, b]", strings within them quoted unless they are numbers."""
    if isinstance(v, list):
        if v and isinstance(v[0], dict):
            return None
        try:
            return "[" + ", ".join(str(x) for x in v if x == "" or float(x) is not None) + "]"
        except (TypeError, ValueError):
            return "[" + ", ".join(f"'{x}'" for x in v) + "]"
    return None if v is None or isinstance(v, bytes) else str(v)


def instance(path: str, data: bytes, with_pixels: bool = True) -> dict[str, object]:
    """The row of a file's bytes."""
    try:
        v, syntax = decoded(data)
        bits, signed = _number(v.get("BitsAllocated"), int), _number(v.get("PixelRepresentation"), int)
        pixels = v.get("PixelData") if with_pixels and syntax in PLAIN else None
        uid = lambda k: v.get(k) or None
        return {
            "path": path, "parse_ok": True, "parse_error": None if syntax in PLAIN or not with_pixels else f"pixels are compressed ({syntax})",
            "study_uid": uid("StudyInstanceUID"), "series_uid": uid("SeriesInstanceUID"), "sop_uid": uid("SOPInstanceUID"), "sop_class_uid": uid("SOPClassUID"),
            "position": _numbers(v.get("ImagePositionPatient"), 3), "acquisition_number": _number(v.get("AcquisitionNumber"), int),
            "orientation": _numbers(v.get("ImageOrientationPatient"), 6), "pixel_spacing": _numbers(v.get("PixelSpacing"), 2) or _numbers(v.get("ImagerPixelSpacing"), 2),
            "rows": _number(v.get("Rows"), int), "cols": _number(v.get("Columns"), int), "dtype": bits and ("int" if signed else "uint") + str(bits),
            "slope": _number(v.get("RescaleSlope"), float), "intercept": _number(v.get("RescaleIntercept"), float), "photometric": v.get("PhotometricInterpretation"),
            "pixels": pixels, "tags": {k: t for k, x in v.items() if (t := _text(x)) is not None},
        }
    except Exception as e:  # one bad file never ends the load: its reason is its row
        return {"path": path, "parse_ok": False, "parse_error": f"{type(e).__name__}: {e}"}


def parsed(files: DataFrame, with_pixels: bool = True) -> DataFrame:
    """Instances of (path, content)."""
    kinds = files.sparkSession.createDataFrame([], INSTANCE).schema
    arrow = pa.schema([("path", pa.string()), ("parse_ok", pa.bool_()), ("parse_error", pa.string()), *((k, pa.string()) for k in ("study_uid", "series_uid", "sop_uid", "sop_class_uid")),
                       ("position", pa.list_(pa.float64())), ("acquisition_number", pa.int32()), ("orientation", pa.list_(pa.float64())), ("pixel_spacing", pa.list_(pa.float64())), ("rows", pa.int32()), ("cols", pa.int32()),
                       ("dtype", pa.string()), ("slope", pa.float64()), ("intercept", pa.float64()), ("photometric", pa.string()), ("pixels", pa.binary()), ("tags", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 1):  # pixels of few files at a time
                rows = [instance(p, d or b"", with_pixels) for p, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                rows = [r | {"tags": list(r["tags"].items()) if r.get("tags") is not None else None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, kinds)


def instances(spark: SparkSession, folder: str, with_pixels: bool = True) -> DataFrame:
    """A row for each file below the folder, bad ones included (parse_ok false)."""
    return parsed(contents(spark, folder), with_pixels)


def loaded(spark: SparkSession, folder: str, must_load: bool = True, with_pixels: bool = True) -> DataFrame:
    """The usable instances: parsed, with ids, of an image class. Raises if there are none and must_load is set."""
    out = usable_instances(instances(spark, folder, with_pixels).where("parse_ok"))
    if must_load and out.select("sop_uid").isEmpty():
        raise PlanError(f"no instances below {folder}")
    return out


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, parse_error) of the files that gave no instance."""
    return instances(spark, folder, False).where("NOT parse_ok").select("path", "parse_error")


def _firsts(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """(keys, path, n_instances, columns): of each group its size and what its first instance by path has; one aggregate."""
    return rows.groupBy(*keys).agg(F.min("path").alias("path"), F.count("*").alias("n_instances"), F.min_by(F.struct(*[c.alias(k) for k, c in columns.items()]), "path").alias("first"))


def _tags(names: tuple[str, ...], of: str = "first.tags") -> list[Column]:
    return [F.col(of)[t].alias(t) if t != "SeriesNumber" else F.col(of)[t].try_cast("int").alias(t) for t in names]


def series_of(rows: DataFrame) -> DataFrame:
    """(study_uid, series_uid, what the first instance by path says of the series, n_instances)."""
    keys = ["study_uid", "series_uid"]
    return _firsts(rows, keys, tags=F.col("tags")).dropna(subset=keys).select(*keys, *_tags(SERIES_TAGS), "n_instances")


def studies_of(rows: DataFrame) -> DataFrame:
    """(study_uid, what the first instance by path says of study and patient, n_instances)."""
    return _firsts(rows, ["study_uid"], tags=F.col("tags")).dropna(subset=["study_uid"]).select("study_uid", *_tags(STUDY_TAGS + PATIENT_TAGS), "n_instances")


def attributes_of(rows: DataFrame) -> DataFrame:
    """What rules ask of a series: as series_of, with its study's attributes and, for all others, its first instance's tags and orientation.

    A study's attribute counts before a series' own of that name. One aggregate over instances, by series; a study's first
    instance is that of its first series, found among the study's series."""
    keys = ["study_uid", "series_uid"]
    series = _firsts(rows, keys, tags=F.col("tags"), orientation=F.col("orientation")).dropna(subset=keys)
    of_study = F.first(F.col("first.tags")).over(Window.partitionBy("study_uid").orderBy("path"))
    return series.withColumn("study_tags", of_study).select("study_uid", "series_uid", *_tags(SERIES_TAGS), "n_instances", "first.tags", "first.orientation", *_tags(STUDY_TAGS + PATIENT_TAGS, "study_tags"))


def _found(values: object, path: list[str]) -> Iterator[object]:
    """The values at the path, through all items of the sequences on it, in order."""
    if isinstance(values, list):
        for item in values:
            yield from _found(item, path)
    elif isinstance(values, dict) and path[0] in values:
        if len(path) == 1:
            yield values[path[0]]
        else:
            yield from _found(values[path[0]], path[1:])


def nested(objects: DataFrame, paths: dict[str, str], name: str = "name") -> DataFrame:
    """(name, parse_error, and for each path an array<string>) of objects (name, content).

    A path is keywords joined by dots, such as SegmentSequence.SegmentLabel; the values of all items come in order, lists
    as ``tags`` has them, bytes in hexadecimal digits. An object that can't be read has a reason and nulls."""
    kinds = f"{name} string, parse_error string, " + ", ".join(f"{k} array<string>" for k in paths)
    shown = lambda v: v.hex().upper() if isinstance(v, bytes) else _text(v)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(name, pa.string()), ("parse_error", pa.string()), *((k, pa.list_(pa.string())) for k in paths)])
        for b in batches:
            for part in by_bytes(b, 1):
                rows = []
                for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        values, _ = decoded(data or b"")
                        rows.append({name: key, "parse_error": None} | {k: [shown(v) for v in _found(values, p.split("."))] for k, p in paths.items()})
                    except Exception as e:  # one bad object never ends the load: its reason is its row
                        rows.append({name: key, "parse_error": f"{type(e).__name__}: {e}"} | dict.fromkeys(paths))
                yield pa.RecordBatch.from_pylist(rows, shape)

    return objects.select(name, "content").mapInArrow(run, kinds)
