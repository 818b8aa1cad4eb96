"""Flows, bundles, contexts, kernels and the applications with several models, sinks or detections."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import session
from cairn.errors import ExistsError, KindError, MissingError, PlanError, PortError, RuleError, UnsupportedError
from cairn.functions import metadata
from cairn.operators import detect, hierarchy, kernels, volume
from cairn.plans import applications as apps
from cairn.plans import bundles, rules
from cairn.plans.flow import Flow, Step
from cairn.sources import dicom, dicom_format, files, prompts

CT = {"SOPClassUID": "1.2.840.10008.5.1.4.1.1.2", "StudyInstanceUID": "1.5", "Modality": "CT", "AccessionNumber": "A1", "PatientID": "P1", "Rows": 4, "Columns": 3, "BitsAllocated": 16, "PixelRepresentation": 1,
      "PhotometricInterpretation": "MONOCHROME2", "ImageOrientationPatient": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "PixelSpacing": [10.0, 10.0], "PatientPosition": "HFS", "StudyDescription": "Spleen CT", "ImageType": ["ORIGINAL", "PRIMARY", "AXIAL"], "SliceThickness": 4.0}
SEGMENTS = [{"label": "spleen", "value": 1, "category": ("1", "SCT", "Organ"), "type": ("2", "SCT", "Spleen")}]


def written(folder, series="1.6", slices=3, **own):
    for z in range(slices):
        pixels = np.full((4, 3), 5, "<i2")
        pixels[1:3, 1] = 100
        row = CT | {"SeriesInstanceUID": series, "SOPInstanceUID": f"{series}.{z}", "ImagePositionPatient": [0.0, 0.0, 10.0 * z], "PixelData": pixels.tobytes()} | own
        (folder / f"{series}-{z}.dcm").write_bytes(dicom_format.encoded({k: v for k, v in row.items() if v is not None}))


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    at = tmp_path_factory.mktemp("study")
    written(at)
    written(at, "1.7", 5)
    written(at, "1.8", 2, Modality="MR", ImageType="DERIVED", SliceThickness=None)
    return str(at)


def found(spark, folder, conditions):
    got = apps.selected(dicom.loaded(spark, folder), {"selections": [{"name": "s", "conditions": conditions}]}, True)
    return sorted({r.series_uid for r in got.collect()})


@pytest.mark.parametrize(
    "conditions, want",
    [
        ({"StudyDescription": "(.*?)", "Modality": "(?i)CT", "ImageType": ["PRIMARY", "ORIGINAL"]}, ["1.6", "1.7"]),
        ({"StudyDescription": "(?i)^Spleen", "Modality": "(?i)CT", "SeriesDescription": "(.*?)"}, []),
        ({"StudyDescription": "(.*?)", "ImageType": ["PRIMARY", "ORIGINAL", "AXIAL"], "SliceThickness": [3, 5]}, ["1.6", "1.7"]),
        ({"ImageOrientationPatient": "Axial", "SliceThickness": [2, ">"]}, ["1.6", "1.7"]),
        ({"ImageOrientationPatient": "Sagittal"}, []),
        ({"ImageType": "!axial"}, []),
        ({"ImageType": "DERIVED"}, ["1.8"]),
        ({"SliceThickness": "^(4(\\.0+)?|4)$"}, ["1.6", "1.7"]),
        ({"SliceThickness": 4}, ["1.6", "1.7"]),
        ({"PatientID": "p1", "Modality": "MR"}, ["1.8"]),
        ({"NoSuchTag": "x"}, []),
    ],
)
def test_rules_on_instance_files(spark, study, conditions, want):
    assert found(spark, study, conditions) == want


def test_an_orientation_needs_a_patient_position(spark, tmp_path):
    written(tmp_path, "1.6", 1, PatientPosition=None)
    with pytest.raises(Exception, match="patient position"):
        found(spark, str(tmp_path), {"ImageOrientationPatient": "Axial"})
    assert found(spark, str(tmp_path), {"Modality": "MR", "ImageOrientationPatient": "Axial"}) == []  # the test before doesn't hold
    with pytest.raises(RuleError):
        rules.parsed({"selections": "none"})


def test_own_filter(spark, study):
    got = apps.selected(dicom.loaded(spark, study), None, True, lambda s: F.col("Modality") == "MR")
    assert {r.series_uid for r in got.collect()} == {"1.8"}


# flows


def test_flow(spark):
    one = Step("one", lambda limit: spark.range(limit), params={"limit": 3}, given={})
    two = Step("two", lambda a, b: {"sum": a.agg(F.sum("id").alias("s")), "same": a if b is None else b}, ("a", "b"), ("sum", "same"), optional=("b",))
    stored = []
    flow = Flow({"one": {"limit": 5}}, store=lambda df: stored.append(1) or df).connect(one, two, [("out", "a")])
    out = flow.run()
    assert out["two"]["sum"].first().s == 10 and out["two"]["same"].count() == 5 and not stored
    three = Step("three", lambda x: x, ("x",))
    flow.connect(one, three)
    flow.run()
    assert stored == [1]
    assert Step("s", lambda: None, params={"p": 1}, given={"p": 2}).param("p", {"p": 3}) == 2
    with pytest.raises(MissingError):
        one.param("none", {})
    with pytest.raises(ExistsError):
        flow.add(Step("one", lambda: None))
    with pytest.raises(PortError, match="taken"):
        flow.connect(three, two, [("out", "a")])
    with pytest.raises(PortError, match="lacks"):
        Flow().add(two).run()
    a, b = Step("a", lambda x: x, ("x",)), Step("b", lambda x: x, ("x",))
    with pytest.raises(PortError, match="circle"):
        Flow().connect(a, b).connect(b, a).run()
    with pytest.raises(PortError, match="no ports"):
        Flow().connect(one, two, [("nothing", "a")])
    with pytest.raises(PortError, match="gave no"):
        Flow().add(Step("x", lambda: {"y": None}, outputs=("z",))).run()


def test_context(tmp_path, monkeypatch):
    monkeypatch.setenv("CAIRN_INPUT", "from-env")
    c = session.Context.of()
    assert (c.input, c.output, c.model, c.server) == ("from-env", "output", "models", "")
    c = session.context_of(["-i", str(tmp_path), "-o", str(tmp_path / "out"), "-s", "host:8000"])
    assert (c.input, c.output, c.server) == (str(tmp_path), str(tmp_path / "out"), "host:8000") and (tmp_path / "out").is_dir()
    assert c.updated(input="other").updated(output="").input == "other" and c.updated(output="").output == c.output
    assert session.environment({"model": ("NO_SUCH_VARIABLE", "own")})["model"] == "own"
    with pytest.raises(SystemExit):
        session.parsed_args(["-i", str(tmp_path / "none")])
    assert session.parsed_args(["-l", "debug"]).log_level == "DEBUG" and session.parsed_args([]).log_level is None


def test_store():
    s = session.store_of()
    s.put("a", 1)
    assert "a" in s and s.get("a") == 1 and s.get("b", 7) == 7 and len(s) == 1 and s.keys() == ["a"]
    s.delete("a")
    assert not len(s)
    with pytest.raises(KindError):
        session.store_of("other")


# kernels


def test_kernels_on_colours_and_volumes():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (5, 6, 3)).astype(np.uint8)
    assert kernels.sobel(a).max() <= 1.5 and np.allclose(kernels.sobel(np.full((4, 4), 7.0)), 0)
    ramp = np.tile(np.arange(5.0), (5, 1))
    assert np.allclose(kernels.sobel(ramp)[2, 2], 2 / np.sqrt(2))
    m = kernels.median(a)
    assert m.shape == a.shape and m[2, 2, 1] == np.sort(a[1:4, 1:4].ravel())[13]
    g = kernels.gaussian(a, 0.8, channel_axis=2)
    assert np.allclose(g[..., 0], kernels.gaussian(a[..., 0], 0.8)) and np.allclose(kernels.gaussian(np.ones((4, 4)), 0.8), 1)
    assert kernels.picture(np.array([0.0, 0.5, 1.0])).tolist() == [0, 127, 255] and kernels.picture(np.array([3.0, 200.0])).tolist() == [3, 200]
    labels = np.zeros((2, 6, 6), np.uint8)
    labels[0, 1:5, 1:5] = 2
    labels[0, 2, 2] = 1
    drawn = kernels.contours(labels, (2,))
    assert drawn[0, 1, 1] == 2 and drawn[0, 2, 2] == 0 and drawn[0, 3, 3] == 2 and not drawn[1].any()
    assert kernels.contours(np.full((3, 3), 1))[1, 1] == 0 and kernels.contours(np.full((3, 3), 1)).sum() == 8
    over = kernels.overlay(np.arange(4.0).reshape(2, 2), np.array([[0, 1], [0, 0]]))
    assert over.shape == (2, 2, 3) and over[0, 0].tolist() == [0, 0, 0] and over[0, 1, 0] > over[0, 1, 1]
    assert np.allclose(kernels.jet(3)[[0, 2]], [[0, 0, 0.5], [0.5, 0, 0]])


def test_orientation_and_spacing_invert():
    rng = np.random.default_rng(1)
    a = rng.random((4, 5, 6))
    m = np.array([[0, -2.0, 0, 10], [-1.0, 0, 0, 20], [0, 0, 3.0, 30], [0, 0, 0, 1]])
    turned, to = kernels.reoriented(a, m, "RAS")
    assert turned.shape == (5, 4, 6) and np.allclose(np.diag(to)[:3], [2, 1, 3])
    for i in ((0, 0, 0), (3, 4, 5), (1, 2, 3)):
        place = m @ [*i, 1]
        at = np.linalg.inv(to) @ place
        assert a[i] == turned[tuple(np.round(at[:3]).astype(int))]
    back, again = kernels.reoriented(turned, to, "PLS")
    assert np.allclose(np.abs(again[:3, :3]), np.abs(m[:3, :3])) and back.shape == a.shape
    fine, grid = kernels.respaced(a, np.diag([2.0, 2, 2, 1]), (1.0, 1.0, 1.0))
    assert fine.shape == (8, 10, 12) and np.allclose(fine[::2, ::2, ::2], a)
    assert np.allclose(kernels.sampled(fine, grid, a.shape, np.diag([2.0, 2, 2, 1])), a)
    labels = (a > 0.5).astype(int)
    coarse, grid = kernels.respaced(labels, np.eye(4), (1.0, 1.0, 1.0), nearest=True)
    assert np.array_equal(coarse, labels)
    kernels.check_alike([m, m], [(1, 2), (1, 2)])
    with pytest.raises(ValueError, match="shapes"):
        kernels.check_alike([m, m], [(1, 2), (2, 1)])
    with pytest.raises(ValueError, match="grids"):
        kernels.check_alike([m, m + 1], [(1, 2), (1, 2)])


# bundles


def config(**own):
    spec = {
        "preprocessing": {"transforms": [{"_target_": "LoadImaged", "keys": "image"}, {"_target_": "EnsureChannelFirstd", "keys": "image"}, {"_target_": "Orientationd", "keys": "image", "axcodes": "RAS"}, {"_target_": "Spacingd", "keys": "image", "pixdim": [1.0, 1.0, 1.0]}]},
        "inferer": {"_target_": "SimpleInferer"},
        "postprocessing": {"transforms": [{"_target_": "Invertd", "keys": "pred", "orig_keys": "image"}, {"_target_": "AsDiscreted", "keys": "pred", "threshold": 0.5}, {"_target_": "KeepLargestConnectedComponentd", "keys": "pred", "applied_labels": [1]}]},
        "_meta_": {"network_data_format": {"inputs": {"image": {"num_channels": 1, "spatial_shape": [8, 8, 8]}}, "outputs": {"pred": {}}}},
    }
    return json.dumps(spec | own)


def test_a_bundle_brings_labels_back_to_its_own_grid():
    a = np.zeros((6, 5, 4), np.float32)
    a[1:4, 1:3, 1:3] = 1
    a[5, 4, 3] = 1
    m = np.diag([-2.0, -2.0, 2.0, 1.0])
    got = bundles.applied(a, m, bundles.bundle_of({"inference": config()}), lambda x: x)
    want = a.copy()
    want[5, 4, 3] = 0
    assert got.dtype == np.uint8 and np.array_equal(got[0], want)


def test_bundles_refuse_what_they_do_not_know():
    for own, error in (
        ({"inferer": {"_target_": "PatchInferer"}}, UnsupportedError),
        ({"inferer": {"_target_": "SlidingWindowInferer", "roi_size": [2, 2, 2], "overlap": 1.0}}, PlanError),
        ({"preprocessing": {"transforms": [{"_target_": "MyTransformd", "keys": "image"}]}}, UnsupportedError),
        ({"preprocessing": {"transforms": [{"_target_": "Spacingd", "keys": "image", "pixdim": "$1+1"}]}}, UnsupportedError),
        ({"preprocessing": {"transforms": [{"_target_": "Spacingd", "keys": "image", "pixdim": "@nowhere"}]}}, PlanError),
        ({"preprocessing": {"transforms": [{"_target_": "Spacing", "pixdim": [1, 1, 1]}]}}, UnsupportedError),
        ({"preprocessing": {"transforms": [{"_target_": "ScaleIntensityRanged", "keys": "image", "a_min": 0, "a_max": 1, "b_mean": 0}]}}, UnsupportedError),
        ({"inferer": {"_target_": "SlidingWindowInferer", "roi_size": [2, 2, 2], "mode": "other"}}, UnsupportedError),
        ({"inferer": {"_target_": "SlidingWindowInferer", "roi_size": [2, 2, 2], "padding_mode": "reflect"}}, UnsupportedError),
        ({"inferer": {"_target_": "SlidingWindowInferer", "roi_size": [2, 2, 2], "odd": 1}}, UnsupportedError),
        ({"inferer": {"_target_": "SlidingWindowInferer", "roi_size": [2, 2]}}, PlanError),
        ({"inferer": {"_target_": "SlidingWindowInferer", "roi_size": [2, 2, 2], "overlap": [0.5, 0.5, 1.0]}}, PlanError),
        ({"_meta_": {"network_data_format": {"inputs": {"image": {}, "more": {}}, "outputs": {"pred": {}}}}}, UnsupportedError),
        ({"_meta_": {"network_data_format": {"inputs": {"image": {}}, "outputs": {"pred": {}, "more": {}}}}}, UnsupportedError),
    ):
        with pytest.raises(error):
            bundles.bundle_of({"inference": config(**own)})
    each = bundles.bundle_of({"inference": config(inferer={"_target_": "SlidingWindowInferer", "roi_size": [2, 2, 2], "overlap": [0.5, 0.0, 0.25], "mode": "gaussian", "sw_batch_size": 3})}).windows
    assert each.overlap == (0.5, 0.0, 0.25) and each.gaussian and each.tiling.batch == 3
    with pytest.raises(PlanError):
        bundles.bundle_of({}, names=bundles.Names(configs="other"))
    with pytest.raises(PlanError):
        bundles.Names(configs=())
    assert bundles.Names(configs="one").configs == ("one",)
    two = bundles.bundle_of({"a": config(), "b": json.dumps({"postprocessing": {"transforms": []}})}, names=bundles.Names(configs=("a", "b")))
    assert two.after == [] and len(two.before) == 3 and bundles.listed(config())[0] == "LoadImaged"
    with pytest.raises(PlanError, match="channels"):
        bundles.applied(np.zeros((2, 2, 2, 2)), np.eye(4), bundles.bundle_of({"inference": config()}), lambda x: x)


def test_windows_are_checked():
    assert bundles.inferer_of(" Sliding_Window ") is bundles.Inferer.SLIDING_WINDOW and bundles.inferer_of(bundles.Inferer.SIMPLE) is bundles.Inferer.SIMPLE
    for bad in ("other", 3):
        with pytest.raises(PlanError):
            bundles.inferer_of(bad)
    for own in ({"overlap": -0.1}, {"overlap": "0.2"}, {"overlap": (0.5, 1.0)}, {"batch": -1}, {"batch": 1.5}, {"kind": bundles.Inferer.SLIDING_WINDOW}):
        with pytest.raises(PlanError):
            bundles.Windows(**own)


@pytest.mark.parametrize(
    "meta, want",
    [({"spatial_dims": 3}, 3), ({"ndim": 5, "size": [1, 2]}, 2), ({"format": "Image2D"}, 2), ({"net_3d": 1}, 3), ({"description": "a unet_2d model"}, 2), ({"description": "about 2dots"}, None), ({}, None), (None, None), ({"ndim": "3", "format": ["a", "3D"]}, 3), ({"ndim": 3.0, "spatial_size": [1, 2, 3, 4], "input_shape": [96, 96, 96]}, 3), ({"ndim": True, "x": 1}, None),
     ({"network": "Net 2D now", "ndim": None}, 2), ({"description": "3d", "architecture": "b-3D"}, 3), ({"b2d3d": 0}, 2), ([1, 2], None), ({"format": None, "size": "12"}, None)],
)
def test_dimensions(spark, meta, want):
    assert spark.range(1).select(metadata.spatial_dims(F.lit(json.dumps(meta)))).first()[0] == want


# applications


def model():
    return lambda v: np.where(v > 50, 1, 0)


def scores(high):
    return lambda: lambda v: np.stack([np.full(v.shape, 0.5), np.where(v > 50, high, 0.0)])


def test_one_volume_two_models(spark, study):
    rule = {"selections": [{"name": "ct", "conditions": {"Modality": "CT"}}]}
    one, none = (lambda: lambda v: np.where(v > 50, 1, 0)), (lambda: lambda v: np.where(v > 1, 1, 0))
    out = apps.multi_model_app(dicom.loaded(spark, study), rule, {"a": (one, SEGMENTS, {}), "b": (none, SEGMENTS, {})})
    read = {n: dicom_format.decoded(bytes(o["segmentations"].first().content))[0] for n, o in out.items()}
    bits = {n: np.unpackbits(np.frombuffer(r["PixelData"], np.uint8)).sum() for n, r in read.items()}
    assert bits == {"a": 6, "b": 36} and read["a"]["SOPInstanceUID"] != read["b"]["SOPInstanceUID"]
    assert out["a"]["surfaces"].count() == 1


def test_four_sinks(spark, study):
    rule = {"selections": [{"name": "ct", "conditions": {"Modality": "CT"}}]}
    out = apps.segmentation_app(dicom.loaded(spark, study), rule, lambda: lambda v: np.where(v > 50, 1, 0), SEGMENTS, surfaces=False, report=True, captures=True, documents="found")
    assert set(out) == {"segmentations", "reports", "captures", "documents"}
    assert out["segmentations"].count() == 1 and out["reports"].count() == 1
    shots = [dicom_format.decoded(bytes(r.content))[0] for r in out["captures"].collect()]
    assert len(shots) == 3 and all(s["PhotometricInterpretation"] == "RGB" and len(s["PixelData"]) == 36 for s in shots)
    (doc,) = [json.loads(r.document) for r in out["documents"].collect()]
    assert doc["volumes"] == {"SpleenVolume": "6 mL"} and doc["source"]["PatientID"] == "P1"


def test_ensemble_of_the_largest_match(spark, study):
    rule = {"selections": [{"name": "ct", "conditions": {"Modality": "CT"}}]}
    high = lambda h: lambda: lambda v: np.stack([np.full(v.shape, 0.5), np.where(v > 50, h, 0.0)])
    out = apps.ensemble_app(dicom.loaded(spark, study), rule, [high(0.9), high(0.4)], SEGMENTS)
    (seg,) = [dicom_format.decoded(bytes(r.content))[0] for r in out["segmentations"].collect()]
    assert int(seg["NumberOfFrames"]) == 5  # 1.7 has more slices than 1.6
    assert out["captures"].count() == 5 and out["reports"].count() == 1


def test_detections(spark, study):
    rule = {"selections": [{"name": "ct", "conditions": {"Modality": "CT"}}]}

    def load():
        import numpy

        return lambda v: (numpy.array([[0, 0, 0, 2, 2, 1], [0.2, 0, 0, 2, 2, 1], [1, 1, 9, 2, 2, 12], [1, 1, 1, 9, 9, 1]]), numpy.array([0.9, 0.8, 0.5, 0.12]))

    out = apps.detection_app(dicom.loaded(spark, study), rule, load, what="Nodule")
    (state,) = [dicom_format.decoded(bytes(r.content))[0] for r in out["presentations"].collect()]
    drawn = state["GraphicAnnotationSequence"]
    assert state["Modality"] == "PR" and [len(a["ReferencedImageSequence"]) for a in drawn][0] == 2
    assert drawn[0]["TextObjectSequence"][0]["UnformattedTextValue"] == "0.90" and drawn[0]["GraphicObjectSequence"][0]["GraphicData"] == [0, 0, 2, 0, 2, 2, 0, 2, 0, 0]
    report = json.loads(out["diagnostics"].first().report)
    assert report["conclusion"] == "Nodules are present." and {o["qualifier"] for o in report["observations"]} <= {"present", "indeterminate", "absent"}
    assert [o["note"] for o in report["observations"]][0] == "Nodule present with probability 90.0%"
    none = apps.detection_app(dicom.loaded(spark, study), rule, lambda: lambda v: (np.zeros((0, 6)), np.zeros(0)))
    assert json.loads(none["diagnostics"].first().report) == {"conclusion": "Findings are not present.", "observations": []}


def test_boxes_in_the_grid(spark):
    df = spark.createDataFrame([([10.0, 4.0, 9.0, 6.0, 8.0, 3.0], [[-2.0, 0.0, 0.0, 10.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 3.0, 0.0], [0.0, 0.0, 0.0, 1.0]])], "box array<double>, m array<array<double>>")
    assert df.select(detect.to_grid(F.col("box"), F.col("m")).alias("b")).first().b == [0.0, 2.0, 1.0, 2.0, 4.0, 3.0]
    assert df.select(detect.clipped(F.col("box"), F.array(F.lit(5), F.lit(5), F.lit(5))).alias("b")).first().b == [5.0, 4.0, 5.0, 5.0, 5.0, 3.0]


# sources


def test_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=">i4").reshape(2, 3))
    (tmp_path / "b.nii.gz").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"y")
    at = files.contents(spark, str(tmp_path))
    (r,) = files.arrays(files.only_file(files.with_extension(at, ("npy",)))).collect()
    assert volume.unpacked(r.shape, r.dtype, r.data).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert files.first_file(at.select("path", "length"), (".nii", ".nii.gz", ".mhd")).first().path.endswith("b.nii.gz")
    assert files.others(at.select("path"), files.with_extension(at, ("npy",)), files.with_extension(at, ("txt",))).count() == 1
    with pytest.raises(PlanError):
        files.only_file(at)
    with pytest.raises(MissingError):
        files.first_file(at.select("path"), (".mhd",))
    told = files.validated(at.select(F.col("path").alias("file_path"))).first()
    assert told.ok and told.message == "Generated 1 NIfTI files, 2 other files"
    assert not files.validated(at.limit(0).select(F.col("path").alias("file_path"))).first().ok
    assert len(files.tree_digest(at).first().sha256) == 64 and files.digests(at).count() == 3


def test_prompts(spark, tmp_path):
    spec = {"defaults": {"temperature": 0.2, "max_new_tokens": 64}, "prompts": [{"prompt": "a", "image": "x.png", "temperature": 0.9}, {"prompt": "b", "image": "lost.png"}, {"prompt": "c", "image": "x.png", "output": "image"}]}
    asked = prompts.requests(spark, json.dumps(spec))
    pictures = spark.createDataFrame([("file:/in/x.png",)], "path string")
    got = {r.prompt: (r.temperature, r.max_new_tokens, r.output_type) for r in prompts.with_pictures(asked, pictures).collect()}
    assert got == {"a": (0.9, 64, "json"), "c": (0.2, 64, "image")} and prompts.without_pictures(asked, pictures).count() == 1


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = hierarchy.numbered(df, ["k"], "at", "total").collect()
    assert all(r.k == r["at"] and r.total == 1000 for r in got) and len(got) == 1000


def test_volumes_leave_a_bundle_by_bytes_not_one_at_a_time(monkeypatch, spark):
    """Many small volumes are one frame; large ones are still frames of their own."""
    import pandas as pd

    plan = bundles.bundle_of({"inference": json.dumps({})})
    packed = spark.createDataFrame([(1, [1, 1, 2], "float32", bytearray(8), [[1.0]])], "k long, shape array<int>, dtype string, data binary, affine array<array<double>>")
    taken = []
    monkeypatch.setattr(type(packed), "mapInPandas", lambda self, run, schema: taken.append(run) or self)
    bundles.inferred(packed, plan, lambda: lambda x: x)

    def frames(n, side):
        data = np.arange(side**3, dtype="<f4").tobytes()
        return list(taken[0](iter([pd.DataFrame({"k": range(n), "shape": [[side] * 3] * n, "dtype": "float32", "data": [data] * n, "affine": [None] * n})])))

    small = frames(100, 2)
    assert len(small) == 1 and small[0]["k"].tolist() == list(range(100)) and set(small[0]["data"]) == {np.arange(8, dtype="<f4").tobytes()}
    assert [len(f) for f in frames(3, 64)] == [1, 1, 1]
