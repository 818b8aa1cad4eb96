"""Standard objects made from rows: text reports, encapsulated PDFs, secondary captures, segmentations.

Each takes rows with a key and `tags`, the attributes of the source series' first instance (null: none are copied), and
gives (name, content); sinks.files.saved writes them. New ids are made of the key, so a task that runs again after a
loss gives the same file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..operators.volume import unpacked
from ..sources.dicom_format import TAG_OF, encoded

#: Classes of the objects (fixed values).
TEXT_REPORT, PDF, CAPTURE, SEGMENTATION = "1.2.840.10008.5.1.4.1.1.88.11", "1.2.840.10008.5.1.4.1.1.104.1", "1.2.840.10008.5.1.4.1.1.7", "1.2.840.10008.5.1.4.1.1.66.4"
PRESENTATION = "1.2.840.10008.5.1.4.1.1.11.1"
#: Attributes of patient and study that an object takes from its source (fixed values).
COPIED = ("PatientName", "PatientID", "PatientBirthDate", "PatientSex", "PatientAge", "StudyInstanceUID", "StudyDate", "StudyTime", "StudyID", "StudyDescription", "AccessionNumber", "ReferringPhysicianName")
#: The longest software version that is kept.
VERSION_CHARS = 15

OUT = "name string, content binary"
#: Objects are handed on when they have so many bytes together.
BATCH_BYTES = 1 << 22


def _uuid(name: str) -> int:
    """uuid.uuid5 of the name, as a number, without its object."""
    n = int.from_bytes(hashlib.sha1(uuid.NAMESPACE_OID.bytes + name.encode(), usedforsecurity=False).digest()[:16])
    return n & ~(0xF000 << 64 | 0xC000 << 48) | 5 << 76 | 0x8000 << 48


def uid_of(*parts: object) -> str:
    return f"2.25.{_uuid(chr(0).join(map(str, parts)))}"


def common(kind: str, modality: str, key: object, tags: dict[str, str] | None, equipment: dict[str, str], custom: dict[str, str]) -> dict[str, object]:
    """Attributes that all objects have."""
    source = tags or {}
    out: dict[str, object] = {k: source.get(k) or "" for k in COPIED}
    out |= {
        "StudyInstanceUID": source.get("StudyInstanceUID") or uid_of(key, "study"), "SeriesInstanceUID": uid_of(kind, key, "series"), "SOPInstanceUID": uid_of(kind, key, "instance"), "SOPClassUID": kind,
        "Modality": modality, "SpecificCharacterSet": "ISO_IR 192", "InstanceNumber": 1, "SeriesNumber": _uuid(str(key)) % 9000 + 1000,
        "SeriesDate": source.get("StudyDate") or "", "SeriesTime": source.get("StudyTime") or "", "ContentDate": source.get("StudyDate") or "", "ContentTime": source.get("StudyTime") or "",
        "Manufacturer": equipment.get("Manufacturer", ""), "ManufacturerModelName": equipment.get("ManufacturerModelName", ""), "DeviceSerialNumber": equipment.get("DeviceSerialNumber", ""),
        "SoftwareVersions": equipment.get("SoftwareVersions", "")[:VERSION_CHARS],
    }
    return out | custom


def _objects(rows: DataFrame, columns: list[str], make: Callable[[dict], dict[str, object]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, contents, size = [], [], 0
        for pdf in batches:
            for r in pdf.to_dict("records"):
                tags = r.get("tags")
                made = make(r | {"tags": dict(tags) if tags is not None else None})
                names.append(f"{made['SOPInstanceUID']}.dcm")
                contents.append(encoded(made))
                size += len(contents[-1])
                if size >= BATCH_BYTES:
                    yield pd.DataFrame({"name": names, "content": contents})
                    names, contents, size = [], [], 0
        if names:
            yield pd.DataFrame({"name": names, "content": contents})

    return rows.select(*columns).mapInPandas(run, OUT)


def _known(custom: dict[str, str] | None) -> dict[str, str]:
    if unknown := set(custom or {}) - set(TAG_OF):
        raise PlanError(f"unknown attributes: {sorted(unknown)}")
    return custom or {}


def _code(value: str, scheme: str, meaning: str) -> list[dict[str, str]]:
    return [{"CodeValue": value, "CodingSchemeDesignator": scheme, "CodeMeaning": meaning}]


def text_reports(rows: DataFrame, key: str, text: str = "text", equipment: dict[str, str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """Basic text reports. A blank or null text raises when it is met."""
    extra, tools = _known(custom), equipment or {}
    stripped = F.trim(F.coalesce(F.col(text), F.lit("")))
    checked = rows.select(F.col(key).cast("string").alias("key"), F.when(stripped == "", F.raise_error(F.lit("a report needs a text"))).otherwise(stripped).alias("text"), "tags")

    def make(r: dict) -> dict[str, object]:
        finding = {"RelationshipType": "CONTAINS", "ValueType": "TEXT", "ConceptNameCodeSequence": _code("111412", "DCM", "Narrative Summary"), "TextValue": r["text"]}
        body = {"ValueType": "CONTAINER", "ConceptNameCodeSequence": _code("18748-4", "LN", "Diagnostic Imaging Report"), "ContinuityOfContent": "SEPARATE", "CompletionFlag": "COMPLETE", "VerificationFlag": "UNVERIFIED", "ContentSequence": [finding]}
        return common(TEXT_REPORT, "SR", r["key"], r["tags"], tools, {}) | body | extra

    return _objects(checked, ["key", "text", "tags"], make)


def pdfs(rows: DataFrame, key: str, content: str = "content", title: str = "", equipment: dict[str, str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """Encapsulated PDFs. Bytes that don't begin as a PDF raise when they are met."""
    extra, tools = _known(custom), equipment or {}
    good = F.coalesce(F.substring(F.col(content), 1, 5) == F.lit(b"%PDF-"), F.lit(False))
    checked = rows.select(F.col(key).cast("string").alias("key"), F.when(~good, F.raise_error(F.lit("not a PDF"))).otherwise(F.col(content)).alias("content"), "tags")

    def make(r: dict) -> dict[str, object]:
        body = {"DocumentTitle": title, "BurnedInAnnotation": "YES", "ConversionType": "SD", "MIMETypeOfEncapsulatedDocument": "application/pdf", "EncapsulatedDocument": bytes(r["content"]), "ConceptNameCodeSequence": []}
        return common(PDF, "OT", r["key"], r["tags"], tools, {}) | body | extra

    return _objects(checked, ["key", "content", "tags"], make)


def captures(rows: DataFrame, key: str, equipment: dict[str, str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """Secondary captures of pictures (shape [rows, cols] or [rows, cols, 3], data of 8-bit values)."""
    extra, tools = _known(custom), equipment or {}

    def make(r: dict) -> dict[str, object]:
        shape = list(r["shape"])
        colour = len(shape) == 3
        body = {"ConversionType": "WSD", "SamplesPerPixel": 3 if colour else 1, "PhotometricInterpretation": "RGB" if colour else "MONOCHROME2", "Rows": int(shape[0]), "Columns": int(shape[1]), "BitsAllocated": 8, "BitsStored": 8, "HighBit": 7, "PixelRepresentation": 0, "PixelData": bytes(r["data"])}
        return common(CAPTURE, "OT", r["key"], r["tags"], tools, {}) | body | ({"PlanarConfiguration": 0} if colour else {}) | extra

    return _objects(rows.select(F.col(key).cast("string").alias("key"), "shape", "data", "tags"), ["key", "shape", "data", "tags"], make)


def segmentations(rows: DataFrame, key: str, segments: list[dict], omit_empty: bool = True, equipment: dict[str, str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """Binary segmentations of label volumes (shape [z, y, x], dtype, data) with the slices' sop_uids, class and positions.

    segments: {label, value, name, category: (code, scheme, meaning), type: (code, scheme, meaning), algorithm}. Rows:
    key, shape, dtype, data, sop_uids array<string>, sop_class_uid, positions array<array<double>>, tags. Frames without
    a voxel are left out if omit_empty is set; a volume without any voxel raises then."""
    extra, tools = _known(custom), equipment or {}
    columns = ["key", "shape", "dtype", "data", "sop_uids", "sop_class_uid", "positions", "tags"]

    def make(r: dict) -> dict[str, object]:
        labels = unpacked(list(r["shape"]), r["dtype"], r["data"])
        bits, frames = [], []
        for number, s in enumerate(segments, 1):
            on = labels == s["value"]
            for z in range(len(on)):
                if omit_empty and not on[z].any():
                    continue
                bits.append(on[z].ravel())
                frames.append({"FrameContentSequence": [{"DimensionIndexValues": [number, z + 1]}], "PlanePositionSequence": [{"ImagePositionPatient": [float(x) for x in r["positions"][z]]}],
                               "SegmentIdentificationSequence": [{"ReferencedSegmentNumber": number}], "SourceImageSequence": [{"ReferencedSOPClassUID": r["sop_class_uid"], "ReferencedSOPInstanceUID": r["sop_uids"][z]}]})
        if not frames:
            raise ValueError(f"{r['key']}: no voxel belongs to a segment")
        described = [
            {"SegmentNumber": n, "SegmentLabel": s["label"], "SegmentAlgorithmType": "AUTOMATIC", "SegmentAlgorithmName": s.get("algorithm", ""), "SegmentedPropertyCategoryCodeSequence": _code(*s["category"]),
             "SegmentedPropertyTypeCodeSequence": _code(*s["type"]), "TrackingID": s.get("name", s["label"]), "TrackingUID": uid_of(r["key"], "segment", n)}
            for n, s in enumerate(segments, 1)
        ]
        body = {"ImageType": ["DERIVED", "PRIMARY"], "SegmentationType": "BINARY", "SegmentSequence": described, "PerFrameFunctionalGroupsSequence": frames, "NumberOfFrames": len(frames), "Rows": labels.shape[1], "Columns": labels.shape[2],
                "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "BitsAllocated": 1, "BitsStored": 1, "HighBit": 0, "PixelRepresentation": 0, "LossyImageCompression": "00",
                "PixelData": np.packbits(np.concatenate(bits), bitorder="little").tobytes()}
        return common(SEGMENTATION, "SEG", r["key"], r["tags"], tools, {}) | body | extra

    return _objects(rows.withColumn("key", F.col(key).cast("string")), columns, make)


def presentation_states(rows: DataFrame, key: str, layer: str = "FINDINGS", description: str = "", window: tuple[float, float] = (-550.0, 1350.0), equipment: dict[str, str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """Greyscale presentation states: for each finding its box as a closed line, its score as a text, over the slices it touches.

    Rows: key, sop_uids array<string> (all slices in order), sop_class_uid, findings array<struct<box: array<double>
    (x0, y0, z0, x1, y1, z1), score: double, slices: array<int>>>, tags. Findings that touch no slice are left out."""
    extra, tools = _known(custom), equipment or {}
    columns = ["key", "sop_uids", "sop_class_uid", "findings", "tags"]

    def make(r: dict) -> dict[str, object]:
        of = lambda places: [{"ReferencedSOPClassUID": r["sop_class_uid"], "ReferencedSOPInstanceUID": r["sop_uids"][z]} for z in places]
        drawn = []
        for n, f in enumerate(r["findings"]):
            if not len(f["slices"]):
                continue
            x0, y0, _, x1, y1, _ = (float(x) for x in f["box"])
            names = {"TrackingID": f"{(r['tags'] or {}).get('AccessionNumber') or r['key']}_{n}", "TrackingUID": uid_of(r["key"], "finding", n)}
            line = {"GraphicAnnotationUnits": "PIXEL", "GraphicDimensions": 2, "NumberOfGraphicPoints": 5, "GraphicData": [x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], "GraphicType": "POLYLINE", "GraphicFilled": "N"} | names
            text = {"BoundingBoxAnnotationUnits": "PIXEL", "UnformattedTextValue": f"{f['score']:.2f}", "BoundingBoxTopLeftHandCorner": [x0, y0], "BoundingBoxBottomRightHandCorner": [x1, y1], "BoundingBoxTextHorizontalJustification": "CENTER"} | names
            drawn.append({"ReferencedImageSequence": of(f["slices"]), "GraphicLayer": layer, "TextObjectSequence": [text], "GraphicObjectSequence": [line]})
        source = r["tags"] or {}
        series = [{"SeriesInstanceUID": source.get("SeriesInstanceUID") or "", "ReferencedImageSequence": of(range(len(r["sop_uids"])))}]
        body = {"ContentLabel": "ANNOTATIONS", "PresentationCreationDate": source.get("StudyDate") or "", "PresentationCreationTime": source.get("StudyTime") or "", "ReferencedSeriesSequence": series,
                "GraphicLayerSequence": [{"GraphicLayer": layer, "GraphicLayerOrder": 1, "GraphicLayerDescription": description}], "GraphicAnnotationSequence": drawn,
                "SoftcopyVOILUTSequence": [{"WindowCenter": window[0], "WindowWidth": window[1]}], "PresentationLUTShape": "IDENTITY"}
        return common(PRESENTATION, "PR", r["key"], r["tags"], tools, {}) | body | extra

    return _objects(rows.withColumn("key", F.col(key).cast("string")), columns, make)
