"""Applications end to end, from hand-made instance files to objects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.errors import MissingError, PlanError
from cairn.plans import applications as apps
from cairn.plans import presets
from cairn.sources import dicom, dicom_format

CT = {"SOPClassUID": "1.2.840.10008.5.1.4.1.1.2", "StudyInstanceUID": "1.5", "Modality": "CT", "Rows": 4, "Columns": 3, "BitsAllocated": 16, "PixelRepresentation": 1, "RescaleSlope": 2.0, "RescaleIntercept": -10.0, "PhotometricInterpretation": "MONOCHROME2", "ImageOrientationPatient": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "PixelSpacing": [0.5, 0.25]}
SEGMENTS = [{"label": "spleen", "value": 1, "category": ("1", "SCT", "Organ"), "type": ("2", "SCT", "Spleen")}, {"label": "liver", "value": 2, "category": ("1", "SCT", "Organ"), "type": ("3", "SCT", "Liver")}]
RULES = {"selections": [{"name": "ct", "conditions": {"Modality": "CT"}}]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("study")
    for z in range(5):
        pixels = np.full((4, 3), 5, "<i2")
        pixels[1:3, 1] = 100 if z in (1, 2, 3) else 5
        pixels[3, 0] = 200
        own = CT | {"SeriesInstanceUID": "1.6", "SOPInstanceUID": f"1.6.{z}", "ImagePositionPatient": [1.0, 2.0, 30.0 - 3 * z], "PixelData": pixels.tobytes()}
        (at / f"{z}.dcm").write_bytes(dicom_format.encoded(own))
        if z == 2:  # an older acquisition at the same place
            (at / "old.dcm").write_bytes(dicom_format.encoded(own | {"SOPInstanceUID": "1.6.9", "PixelData": np.zeros((4, 3), "<i2").tobytes(), "AcquisitionNumber": -5}))
    (at / "other.dcm").write_bytes(dicom_format.encoded(CT | {"Modality": "MR", "SeriesInstanceUID": "1.7", "SOPInstanceUID": "1.7.1", "ImagePositionPatient": [0.0, 0.0, 0.0], "PixelData": b"\0" * 24}))
    (at / "odd.dcm").write_bytes(dicom_format.encoded(CT | {"SeriesInstanceUID": "1.6", "SOPInstanceUID": "1.6.8", "ImagePositionPatient": [0.0, 0.0, 90.0], "Rows": 2, "PixelData": b"\0" * 12}))
    (at / "zz.txt").write_bytes(b"nothing")
    return str(at)


by_value = lambda: lambda v: np.where(v > 300, 2, np.where(v > 100, 1, 0))  # noqa: E731 - workers can't import this file, and a lambda goes to them by value


def test_volumes(spark, folder):
    rows = {r.series_uid: r for r in apps.volumes(dicom.loaded(spark, folder)).collect()}
    r = rows["1.6"]
    v = np.frombuffer(r.data, "<f4").reshape(r.shape)
    assert list(r.shape) == [5, 4, 3] and r.sop_uids == [f"1.6.{z}" for z in (4, 3, 2, 1, 0)] and r.tags["Modality"] == "CT"
    assert v[0, 3, 0] == 390 and v[0, 1, 1] == 0 and v[2, 1, 1] == 190
    assert np.allclose(r.affine, [[-0.25, 0, 0, -1], [0, -0.5, 0, -2], [0, 0, 3, 18], [0, 0, 0, 1]])
    assert rows["1.7"].affine is None and list(rows["1.7"].shape) == [1, 4, 3]


def test_segmentation(spark, folder):
    out = apps.segmentation_app(dicom.loaded(spark, folder), RULES, by_value, SEGMENTS, report=True)
    (seg,) = out["segmentations"].collect()
    back, _ = dicom_format.decoded(bytes(seg.content))
    assert back["Modality"] == "SEG" and int(back["NumberOfFrames"]) == 3 + 5
    (surface,) = out["surfaces"].collect()
    assert surface.name.endswith(".stl") and len(surface.content) > 84
    (report,) = out["reports"].collect()
    text = dicom_format.decoded(bytes(report.content))[0]["ContentSequence"][0]["TextValue"]
    assert text.split("\n") == ["Spleen Volume: 0 mL", "Liver Volume: 0 mL"]
    labels = apps.segmented(apps.volumes(apps.selected(dicom.loaded(spark, folder), RULES)), by_value)
    assert sorted((r.label, r.n, r.voxel_mm3) for r in apps.label_counts(labels).collect()) == [(1, 6, 0.375), (2, 5, 0.375)]


def test_pictures_and_classes(spark, folder):
    rows = dicom.loaded(spark, folder)
    assert sorted(r.name.rsplit("/", 1)[1] for r in apps.series_pictures(rows, RULES).collect()) == [f"{z}.png" for z in range(5)]
    assert apps.series_pictures(rows, None).count() == 6
    (r,) = apps.classification_app(rows, RULES, lambda: lambda v: [0.25, 0.75], ("a", "b")).collect()
    assert dicom_format.decoded(bytes(r.content))[0]["ContentSequence"][0]["TextValue"].split("\n") == ["a: 0.2500", "b: 0.7500"]
    assert apps.segmented(apps.volumes(rows.limit(0)), by_value).count() == 0


def test_windows_slide():
    v = np.random.default_rng(0).random((7, 5, 9))
    model = lambda x: np.stack([x, 1 - x])
    assert np.allclose(apps.tiled(v, model, (4, 8, 3), 0.5), model(v))
    with pytest.raises(PlanError):
        apps.tiled(v, model, (4, 4, 4), 1.0)


@pytest.mark.parametrize("name", sorted(presets.PRESETS))
def test_presets_run_on_files(spark, folder, name):
    """Each preset's rules, window, model and objects; the model's label is what lies above the window's middle."""
    own = presets.preset(name, roi=(4, 4, 4), spacing=(0.25, 0.5, 3.0))
    instances = dicom.loaded(spark, folder).withColumns({"tags": F.map_concat(F.map_filter("tags", lambda k, v: k != "ImageType"), F.create_map(F.lit("ImageType"), F.lit("['ORIGINAL', 'PRIMARY']")))})
    low, high = own.window
    above = (np.arange(-10, 400) > (low + high) / 2).argmax() - 10
    load = lambda: lambda v: np.concatenate([np.full(v.shape, 0.5), v])
    out = presets.run(own, instances, load, store=False)
    assert set(out) == {"segmentations"} | ({"surfaces"} if own.surfaces else set())
    (seg,) = out["segmentations"].collect()
    back, _ = dicom_format.decoded(bytes(seg.content))
    assert [s["SegmentLabel"] for s in back["SegmentSequence"]] == [s["label"] for s in own.segments] and above < 190
    frames = back["PerFrameFunctionalGroupsSequence"]
    first = [f["SegmentIdentificationSequence"][0]["ReferencedSegmentNumber"] for f in frames]
    bits = np.unpackbits(np.frombuffer(back["PixelData"], np.uint8), bitorder="little")[: len(frames) * 12]
    assert set(first) == {1} and len(frames) == 5 and int(bits.sum()) == 6 + 5  # 190 and 390 lie above, 0 below


def test_presets_are_checked():
    with pytest.raises(MissingError):
        presets.preset("other")
    assert presets.preset("multi_organ").bundle.windows.roi == (96, 96, 96) and len(presets.preset("multi_organ").segments) == 13
    assert presets.preset("liver_tumour").bundle.windows.tiling.overlap == (0.6, 0.6, 0.6)


def test_small_volumes_are_padded():
    v = np.ones((2, 3, 1))
    seen = []

    def model(x):
        seen.append(x.shape)
        return x[None] * 2

    assert np.array_equal(apps.tiled(v, model, (4, 3, 4), (0.5, 0.0, 0.25), gaussian=True), v[None] * 2) and set(seen) == {(4, 3, 4)}
