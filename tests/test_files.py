"""Files in and out: standard objects, volumes, pictures, meshes, prompts and results, by round trips and hand-built cases."""

import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.errors import PlanError
from cairn.sinks import dicom_objects, files, mesh, pictures, results
from cairn.sources import dicom, dicom_format, images, models, nifti, prompts
from cairn.sources import files as sources

IMAGE = {"SOPClassUID": "1.2.840.10008.5.1.4.1.1.2", "StudyInstanceUID": "1.5", "SeriesInstanceUID": "1.6", "Modality": "CT", "SeriesNumber": 3, "ImageType": ["ORIGINAL", "PRIMARY"], "PatientName": "Ä^B", "Rows": 2, "Columns": 2, "BitsAllocated": 16, "PixelRepresentation": 1}


def image(uid, z, **more):
    pixels = np.arange(4, dtype="<i2").tobytes()
    return dicom_format.encoded(IMAGE | {"SOPInstanceUID": uid, "ImagePositionPatient": [0.0, 0.5, z], "PixelSpacing": [0.5, 1 / 3], "ImageOrientationPatient": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "PixelData": pixels} | more)


def put(folder, **contents):
    for name, data in contents.items():
        (folder / name.replace("__", ".")).write_bytes(data)
    return str(folder)


def test_format_round_trip():
    values = IMAGE | {"SOPInstanceUID": "1.7", "SourceImageSequence": [{"ReferencedSOPInstanceUID": "1.8", "ContentSequence": [{"TextValue": "odd"}]}, {}], "PixelData": b"abc", "DimensionIndexValues": [1, 2]}
    back, syntax = dicom_format.decoded(dicom_format.encoded(values))
    assert syntax == dicom_format.EXPLICIT
    assert back == values | {"SeriesNumber": "3", "PixelData": b"abc\0"}


def test_format_other_syntaxes():
    def meta(syntax):
        raw = syntax.encode() + b"\0" * (len(syntax) % 2)
        return b"\0" * 128 + b"DICM" + struct.pack("<HH2sH", 2, 0x10, b"UI", len(raw)) + raw

    implicit = struct.pack("<HHI", 8, 0x60, 2) + b"MR" + struct.pack("<HHI", 0x28, 0x10, 2) + struct.pack("<H", 7)
    assert dicom_format.decoded(meta(dicom_format.IMPLICIT) + implicit)[0] == {"Modality": "MR", "Rows": 7}
    big = struct.pack(">HH2sH", 0x28, 0x10, b"US", 2) + struct.pack(">H", 7)
    assert dicom_format.decoded(meta(dicom_format.BIG) + big)[0] == {"Rows": 7}
    pack = zlib.compressobj(wbits=-15)
    little = struct.pack("<HH2sH", 0x28, 0x10, b"US", 2) + struct.pack("<H", 7)
    assert dicom_format.decoded(meta(dicom_format.DEFLATED) + pack.compress(little) + pack.flush())[0] == {"Rows": 7}
    # a sequence and an item of open length, then encapsulated pixels
    open_ = struct.pack("<HH2sHI", 8, 0x2112, b"SQ", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + little + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    parts = struct.pack("<HH2sHI", 0x7FE0, 0x10, b"OB", 0, 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 4) + b"abcd" + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    assert dicom_format.decoded(meta("1.2.840.10008.1.2.4.50") + open_ + parts)[0] == {"SourceImageSequence": [{"Rows": 7}], "PixelData": None}
    for bad in (b"", b"x" * 200, meta(dicom_format.EXPLICIT) + little[:-1], meta(dicom_format.EXPLICIT) + open_[:-8]):
        with pytest.raises(dicom_format.FormatError):
            dicom_format.decoded(bad)


def test_instances(spark, tmp_path):
    sub = tmp_path / "deep"
    sub.mkdir()
    put(sub, a__dcm=image("1.7.1", 1.0, AcquisitionNumber=2), b__dcm=image("1.7.2", 2.0))
    put(tmp_path, noise=b"nothing", short=b"x", dir__dcm=image("1.7.3", 3.0, SOPClassUID="1.2.840.10008.1.3.10"))
    folder = str(tmp_path)
    rows = {r.sop_uid: r for r in dicom.loaded(spark, folder).collect()}
    assert set(rows) == {"1.7.1", "1.7.2"}
    r = rows["1.7.1"]
    assert (r.position, r.acquisition_number, r.dtype, r.rows, r.pixels) == ([0.0, 0.5, 1.0], 2, "int16", 2, np.arange(4, dtype="<i2").tobytes())
    assert r.tags["ImageType"] == "['ORIGINAL', 'PRIMARY']" and r.tags["ImagePositionPatient"] == "[0, 0.5, 1]" and r.tags["PatientName"] == "Ä^B"
    assert rows["1.7.2"].acquisition_number is None
    assert sorted(r.path.rsplit("/", 1)[1] for r in dicom.failures(spark, folder).collect()) == ["noise", "short"]
    s = dicom.series_of(dicom.loaded(spark, folder)).first()
    assert (s.series_uid, s.Modality, s.SeriesNumber, s.n_instances, s.BodyPartExamined) == ("1.6", "CT", 3, 2, None)
    assert dicom.studies_of(dicom.loaded(spark, folder)).first().n_instances == 2


def test_no_instances(spark, tmp_path):
    put(tmp_path, noise=b"nothing")
    with pytest.raises(PlanError):
        dicom.loaded(spark, str(tmp_path))
    assert dicom.loaded(spark, str(tmp_path), must_load=False).count() == 0


def test_nifti(spark, tmp_path):
    a, affine = np.arange(24, dtype=np.float32).reshape(2, 3, 4), np.array([[2.0, 0, 0, 5], [0, 3, 0, 6], [0, 0, 4, 7], [0, 0, 0, 1]])
    put(tmp_path, a__nii__gz=nifti.encoded(a, affine), b__nii=nifti.encoded(a, zipped=False), bad__nii=b"no", other__txt=b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in nifti.volumes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.nii.gz", "b.nii", "bad.nii"} and not rows["bad.nii"].ok and "header" in rows["bad.nii"].error
    r = rows["a.nii.gz"]
    assert r.shape == [4, 3, 2] and r.affine == affine.tolist()
    assert (np.frombuffer(r.data, r.dtype).reshape(r.shape) == a.transpose(2, 1, 0)).all()
    raw = bytearray(nifti.encoded(a, zipped=False))
    struct.pack_into("<2f", raw, 112, 2.0, 1.0)
    assert (nifti.decoded(gzip.compress(bytes(raw)))[0] == 2 * a + 1).all()


def volumes(spark, a, **more):
    row = {"key": "v", "shape": list(a.shape), "dtype": a.dtype.name, "data": a.tobytes()} | more
    kinds = {"tags": "map<string,string>", "sop_uids": "array<string>", "sop_class_uid": "string", "positions": "array<array<double>>", "affine": "array<array<double>>"}
    return spark.createDataFrame([tuple(row.values())], "key string, shape array<int>, dtype string, data binary" + "".join(f", {k} {kinds[k]}" for k in more))


def test_nifti_files(spark, tmp_path):
    a, affine = np.arange(24, dtype=np.int16).reshape(1, 2, 3, 4), np.diag([2.0, 3, 4, 1]).tolist()
    rows = volumes(spark, a, affine=affine)
    assert files.saved(nifti.files_of(rows, "key"), str(tmp_path)) == 1
    back = nifti.volumes(spark, str(tmp_path)).first()
    assert back.path.endswith("/v_seg.nii.gz") and back.shape == [2, 3, 4] and back.affine == affine
    assert (np.frombuffer(back.data, back.dtype) == a.ravel()).all()
    (r,) = nifti.files_of(rows.withColumn("affine", F.lit(None).cast("array<array<double>>")), "key", "@x", ".nii").collect()
    assert r.name == "v_trans.nii" and (nifti.decoded(r.content)[1] == np.eye(4)).all()


def test_segmentation(spark):
    a = np.zeros((3, 2, 5), np.uint8)
    a[1, 0, 1], a[1, 1, 4], a[2, 0, 0] = 1, 1, 2
    part = lambda v: {"label": f"part{v}", "value": v, "category": ("1", "SCT", "c"), "type": ("2", "SCT", "t")}
    rows = volumes(spark, a, tags={"PatientID": "p", "StudyInstanceUID": "1.5"}, sop_uids=["1.1", "1.2", "1.3"], sop_class_uid="1.9", positions=[[0.0, 0.0, float(z)] for z in range(3)])
    got = dicom_objects.segmentations(rows, "key", [part(1), part(2)], custom={"SeriesDescription": "mine"}).first()
    v, _ = dicom_format.decoded(got.content)
    assert got.name == v["SOPInstanceUID"] + ".dcm" and v["NumberOfFrames"] == "2" and v["SeriesDescription"] == "mine" and v["PatientID"] == "p"
    bits = np.unpackbits(np.frombuffer(v["PixelData"], np.uint8), bitorder="little")[:20].reshape(2, 2, 5)
    assert (bits == [a[1] == 1, a[2] == 2]).all()
    assert [f["SourceImageSequence"][0]["ReferencedSOPInstanceUID"] for f in v["PerFrameFunctionalGroupsSequence"]] == ["1.2", "1.3"]
    everything, _ = dicom_format.decoded(dicom_objects.segmentations(rows, "key", [part(1), part(2)], omit_empty=False).first().content)
    assert everything["NumberOfFrames"] == "6"
    with pytest.raises(Exception, match="no voxel"):
        dicom_objects.segmentations(rows, "key", [part(9)]).collect()
    with pytest.raises(PlanError):
        dicom_objects.segmentations(rows, "key", [part(1)], custom={"Nonsense": "x"})


def test_reports_pdfs_captures(spark):
    rows = spark.createDataFrame([("k", " two\nlines ", b"%PDF-1", {"AccessionNumber": "7"}, [1, 2, 3], bytes(range(6))), ("l", "x", b"%PDF-2", None, [1, 6], bytes(6))], "key string, text string, content binary, tags map<string,string>, shape array<int>, data binary")
    tools = {"SoftwareVersions": "a version of many characters"}
    k, n = sorted((dicom_format.decoded(r.content)[0] for r in dicom_objects.text_reports(rows, "key", equipment=tools).collect()), key=lambda v: v["AccessionNumber"], reverse=True)
    assert k["ContentSequence"][0]["TextValue"] == "two\nlines" and k["AccessionNumber"] == "7" and k["SoftwareVersions"] == "a version of ma" and n["AccessionNumber"] == ""
    assert dicom_objects.text_reports(rows, "key").select("name").collect() == dicom_objects.text_reports(rows, "key").select("name").collect()
    assert {dicom_format.decoded(r.content)[0]["EncapsulatedDocument"] for r in dicom_objects.pdfs(rows, "key").collect()} == {b"%PDF-1", b"%PDF-2"}
    assert {dicom_format.decoded(r.content)[0]["PhotometricInterpretation"] for r in dicom_objects.captures(rows, "key").collect()} == {"RGB", "MONOCHROME2"}
    with pytest.raises(Exception, match="needs a text"):
        dicom_objects.text_reports(rows.withColumn("text", F.lit("  ")), "key").collect()
    with pytest.raises(Exception, match="not a PDF"):
        dicom_objects.pdfs(rows.withColumn("content", F.lit(None).cast("binary")), "key").collect()


def test_saved(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"1"), ("c", None), (None, b"z")], "name string, content binary")
    for _ in range(2):  # once more changes nothing
        assert files.saved(rows, str(tmp_path / "out")) == 2
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/a/b.txt", "out/c"]
    assert files.saved(rows.limit(0), str(tmp_path / "out")) == 0
    with pytest.raises(Exception, match="leaves the folder"):
        files.saved(rows.withColumn("name", F.lit("../x")), str(tmp_path / "out"))


def test_pictures(spark, tmp_path):
    a = np.array([[[255, 0, 10], [1, 2, 3]]], np.uint8)
    put(tmp_path, x__png=pictures.png(a), grey__png=pictures.png(np.array([[7, 9]])), bad__png=b"no")
    got = {r.filename: r for r in images.rgb(spark, str(tmp_path)).collect()}
    assert set(got) == {"x", "grey"} and got["x"].shape == [3, 1, 2] and got["x"].values == [255, 1, 0, 2, 10, 3] and got["grey"].values == [7, 9] * 3
    assert {r.filename: r["values"] for r in images.rgb(spark, str(tmp_path), False).collect()}["x"] == [255, 0, 10, 1, 2, 3]
    assert images.first_grey(spark, str(tmp_path)).first()["values"] == [7, 9]
    assert (pictures.overlaid(np.array([[0, 5]]), np.array([[0, 1]])) == [[[0, 0, 0], [255, 153, 153]]]).all()
    names = [r.name for r in pictures.slice_pictures(volumes(spark, np.zeros((2, 3, 3), np.uint8)), "key").collect()]
    assert names == ["v/0.png", "v/1.png"]


def filtered(a, kinds):
    """A PNG of the picture whose lines have the given filters, written from the format's own definition."""
    rows, cols, channels = a.shape
    at = lambda y, x, c: int(a[y, x, c]) if x >= 0 and y >= 0 else 0
    lines = b""
    for y, kind in zip(range(rows), kinds):
        lines += bytes([kind])
        for x in range(cols):
            for c in range(channels):
                left, up, both = at(y, x - 1, c), at(y - 1, x, c), at(y - 1, x - 1, c)
                nearest = min((left, up, both), key=lambda v: abs(left + up - both - v))
                lines += bytes([(at(y, x, c) - (0, left, up, (left + up) // 2, nearest)[kind]) % 256])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(lines)
    head = struct.pack(">2I5B", cols, rows, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channel_first", [True, False])
def test_pictures_of_known_names(spark, tmp_path, channel_first):
    """Files found by their index and decoded in workers are what Spark's listing and its reader give."""
    rng = np.random.default_rng(1)
    made = {f"{n}/{k}.png": filtered(rng.integers(0, 256, (6, 5, n), np.uint8), rng.permutation([0, 1, 2, 3, 4, 4])) for n in (1, 3, 4) for k in range(4)} | {"x.png": pictures.png(np.array([[7, 9]]))}
    written = files.indexed(spark.createDataFrame([*made.items(), (None, b"no")], "name string, content binary"), f"file://{tmp_path}/out", f"file://{tmp_path}/index")
    got = {r.name: (r.shape, r["values"]) for r in images.rgb_of(sources.contents_of(written, f"file://{tmp_path}/out"), channel_first).collect()}
    want = {r.path.split("/out/")[1]: (r["shape"], r["values"]) for r in images.rgb(spark, f"{tmp_path}/out", channel_first).collect()}
    assert set(got) == set(made) and got == want


def test_pictures_that_are_not_known():
    a = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    good = filtered(a, [4, 3])
    assert (images.png_pixels(good) == a).all()
    assert images.png_pixels(filtered(a[..., :2], [1, 2])).tolist() == a[..., :2].tolist()
    deep = struct.pack(">2I5B", 1, 1, 16, 0, 0, 0, 0)
    chunk = struct.pack(">I", len(deep)) + b"IHDR" + deep + struct.pack(">I", zlib.crc32(b"IHDR" + deep))
    for data, said in ((b"GIF", "no PNG"), (good[:-12], "ends early"), (good[:50] + b"?" + good[51:], "damaged"), (good[:8] + chunk + good[-12:], "16 bits")):
        with pytest.raises(ValueError, match=said):
            images.png_pixels(data)


def test_pictures_leave_by_bytes_not_one_at_a_time(monkeypatch, spark, tmp_path):
    """Many small slices are one frame, many small files one batch; large ones are still handed on one by one."""
    import pandas as pd
    import pyarrow as pa

    rows, taken = volumes(spark, np.zeros((1, 1, 1), np.uint8)), []
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, run, schema: taken.append(run) or self)
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: taken.append(run) or self)
    pictures.slice_pictures(rows, "key")

    def frames(n, side):
        a = np.random.default_rng(1).integers(0, 256, (2, side, side), np.uint8)
        return list(taken[0](iter([pd.DataFrame({"key": range(n), "shape": [list(a.shape)] * n, "dtype": "uint8", "data": [a.tobytes()] * n})])))

    small = frames(50, 2)
    assert len(small) == 1 and small[0]["name"].tolist() == [f"{k}/{z}.png" for k in range(50) for z in range(2)]
    assert [len(f) for f in frames(2, 800)] == [1, 1, 1, 1]

    contents = [b"a"] * 700 + [b"b" * (1 << 20)] * 2 + [b""]
    for k, data in enumerate(contents):
        (tmp_path / str(k)).write_bytes(data)
    sources.contents_of(spark.createDataFrame([("p",)], "path string"), str(tmp_path))
    read = list(taken[1](iter([pa.record_batch([pa.array([f"{tmp_path}/{k}" for k in range(len(contents))])], names=["path"])])))
    assert [b.num_rows for b in read] == [512, 188, 1, 2] and [c for b in read for c in b.column(1).to_pylist()] == contents
    assert [p for b in read for p in b.column(0).to_pylist()] == [f"{tmp_path}/{k}" for k in range(len(contents))]


@pytest.mark.parametrize("name", ["slice_pictures", "overlay_pictures"])
def test_pictures_are_read_back_without_a_listing(spark, name):
    """Spark's picture source lists the folder into the driver and makes a task of each 32 files."""
    from cairn.plans import fixture_queries as q

    plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "FileScan image" not in plan._jdf.queryExecution().toString()


def test_pictures_of_one_row_group_are_made_by_all_tasks(spark, tmp_path):
    """Over 32 MB in one row group, which one task of a scan reads alone."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from cairn.plans import fixture_queries as q

    n = 140000
    values = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(np.random.default_rng(1).random(64 * n, np.float32)))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": values}), tmp_path / "embeddings.parquet", row_group_size=n)
    assert (tmp_path / "embeddings.parquet").stat().st_size > 32 << 20
    held = [r["count"] for r in q._volumes(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == n and max(held) < n / 2


def enclosed(raw):
    c = np.frombuffer(raw[84:], np.dtype([("n", "<f4", 3), ("c", "<f4", (3, 3)), ("a", "<u2")]))["c"].astype(float)
    return (c[:, 0] * np.cross(c[:, 1], c[:, 2])).sum() / 6


def test_mesh(spark):
    a = np.zeros((12, 12, 12), np.uint8)
    a[3:9, 3:9, 3:9], a[0, 0, 0] = 1, 1
    points, faces = mesh.surface(a == 1)
    edges, n = np.unique(np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), 1), axis=0, return_counts=True)
    assert set(n) == {2} and len(points) - len(edges) + len(faces) == 4  # two closed surfaces without handles
    for affine in (np.diag([1.0, 1, 2, 1]), np.diag([-1.0, 1, 2, 1])):
        rows = volumes(spark, a, affine=affine.tolist())
        assert enclosed(mesh.meshes(rows, "key", smooth=False).first().content) == pytest.approx(423.5)
    assert enclosed(mesh.mask_mesh(a, np.diag([1.0, 1, 2, 1]))) == pytest.approx(423.5, rel=0.05)
    assert len(mesh.mask_mesh(a * 0, np.eye(4))) == 84


def test_prompts(spark):
    text = "defaults: {max_new_tokens: 8, top_p: 0.5}\nprompts:\n- {prompt: p, image: a.png, top_p: 1}\n- {prompt: q, image: b.png, output: image}\n"
    asked = prompts.requests(spark, text)
    there = spark.createDataFrame([("/x/a.png",), ("/y/a.png",)], "path string")
    (r,) = prompts.with_pictures(asked, there).collect()
    assert (r.prompt, r.output_type, r.max_new_tokens, r.temperature, r.top_p, r.path) == ("p", "json", 8, None, 1.0, "/x/a.png")
    assert [r.prompt for r in prompts.without_pictures(asked, there).collect()] == ["q"]
    assert prompts.requests(spark, '{"prompts": []}').count() == 0
    with pytest.raises(PlanError):
        prompts.requests(spark, "[1]")


def test_results(spark):
    rows = spark.createDataFrame([("f", [0.1, 0.2, 0.6, 0.1]), (None, [0.5, 0.5]), ("e", None)], "f string, p array<double>")
    got = [json.loads(bytes(r.content)) for r in results.json_results(rows, "f", "p").collect()]
    assert [g["prediction"].get("predicted_class") for g in got] == ["C", "class_0", None]
    answers = spark.createDataFrame([(1, "json", "t", None, None), (2, "image", "t", b"png", None), (3, "image_overlay", "t", None, None), (4, "odd", "t", None, None), (5, "json", "t", None, "bad")], "request_id int, output_type string, text string, picture binary, error string")
    assert [r.name for r in results.routed(answers).collect()] == ["1.json", "2.png", "3_error.json", "4.json", "5_error.json"]
    assert spark.range(1).select(results.filled("{a}-{b}", {"a": F.lit(1), "b": F.lit("x")}).alias("x")).first().x == "1-x"
    paths = spark.createDataFrame([("b_seg.nii.gz",), ("a.nii.gz",), ("c.txt",)], "path string")
    assert tuple(results.mask_and_density(paths).first()) == ("b_seg.nii.gz", "a.nii.gz")


def zipped(**names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in names.items():
            z.writestr(name, text)
    return out.getvalue()


def test_models(spark):
    script = zipped(**{"m/data.pkl": "", "m/code/a.py": "", "m/constants.pkl": ""})
    newer = zipped(**{"data.pkl": "", "code/a.py": "", "constants/0": ""})
    other = zipped(**{"m/data.pkl": "", "m/code/a.py": ""})

    def found(**files):
        return models.archives(spark.createDataFrame([(p, d) for p, d in files.items()], "path string, content binary"))

    assert [r.kind for r in models.kinds(found(a=script, b=newer, c=other, d=b"no", e=None)).collect()] == ["script", "script", "generic", "generic", "generic"]
    good = {"/r/x/m.ts": script, "/r/y/1/m.ts": script, "/r/y/config.pbtxt": b"", "/r/z/m.ts": other}
    named = models.repository(found(**good), "/r")
    assert sorted(map(tuple, named.collect())) == [("x", "/r/x/m.ts", "script"), ("y", "/r/y", "served")]
    assert models.repository(found(**good, **{"/r/loose": b""}), "/r").count() == 0
    assert models.repository(found(**good, **{"/r/x/more": b""}), "/r").count() == 0
    assert models.chosen(named, "x").first().kind == "script"
    for name in ("", "q"):
        with pytest.raises(PlanError):
            models.chosen(named, name)
    assert models.chosen(named.limit(1)).count() == 1


def test_bundle_configs(spark):
    one = zipped(**{"b/configs/Inference.JSON": "1", "b/configs/inference.yaml": "2", "b/metadata.json": "3", "b/metadata.yml": "4", "b/readme": "5"})
    files_ = spark.createDataFrame([("p", one), ("q", b"no zip")], "path string, content binary")
    got = models.configs(models.members(files_, r"[.](json|ya?ml)$"), ["inference", "metadata", "train"]).collect()
    assert {(r.path, r.name, r.config) for r in got} == {("p", "inference", "2"), ("p", "metadata", "3")}
    bad = spark.createDataFrame([("p", zipped(**{"a/../../x.json": ""}))], "path string, content binary")
    with pytest.raises(Exception, match="leaves the archive"):
        models.members(bad, "json").collect()


@pytest.mark.parametrize(
    "term, encoding, name",
    [("ISO_IR 100", "latin-1", "Müller^Äneas"), ("ISO_IR 144", "iso8859_5", "Люкceмбypг"), ("ISO_IR 126", "iso8859_7", "Διονυσιος"), ("GB18030", "gb18030", "王^小东"), ("ISO_IR 13", "shift_jis", "ﾔﾏﾀﾞ^ﾀﾛｳ"), (["", "ISO 2022 IR 149"], "euc_kr", "홍^길동"), (["", "ISO 2022 IR 87"], "iso2022_jp", "Yamada^Tarou=山田^太郎"), ("ISO_IR 192", "utf-8", "Ω"), ("ODD", "utf-8", "é"), (None, "utf-8", "é")],
)
def test_texts_are_read_by_their_character_set(term, encoding, name):
    values = {"SOPClassUID": "1.2", "SOPInstanceUID": "1.3", "PatientName": "@NAME@", "ContentSequence": [{"TextValue": "@NAME@"}], "Modality": "CT"} | ({"SpecificCharacterSet": term} if term else {})
    data, raw = dicom_format.encoded(values), name.encode(encoding)
    raw += b" " * (len(raw) % 2)
    for head in (b"PN", b"UT"):
        at = data.index(b"@NAME@", data.index(head))
        size = 2 if head == b"PN" else 4
        data = data[: at - size] + len(raw).to_bytes(size, "little") + raw + data[at + 6 :]
    # the sequence and its item hold another number of bytes now
    sq = data.index(b"SQ")
    item = len(raw) + 12
    data = data[: sq + 4] + (item + 8).to_bytes(4, "little") + data[sq + 8 : sq + 12] + item.to_bytes(4, "little") + data[sq + 16 :]
    got, _ = dicom_format.decoded(data)
    assert got["PatientName"] == name and got["ContentSequence"][0]["TextValue"] == name and got["Modality"] == "CT"


def test_pairs_of_keys_beyond_two_bytes(spark, tmp_path):
    """keys from 32,757 on didn't fit the elements, and the job ended with an OverflowError."""
    from cairn.plans import fixture_queries

    keys = [1, 2, 5, 7, 11, 32_757, 40_009, 65_531, 65_537, 400_003, 400_004]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.k: (r.file, r.reason, r.total) for r in fixture_queries.paired_files(spark, str(tmp_path)).collect()}
    assert len(got) == len(keys)
    for k in keys:
        reason = "no header names it" if k % 7 == 0 else "its data file is not there" if k % 5 == 0 else "23 bytes where 24 were due" if k % 11 == 0 else None
        assert got[k] == ("lost.raw" if k % 7 == 0 else "v.mhd", reason, None if reason else 12 * k + 66)


def test_what_is_made_of_a_batch_comes_in_small_parts(spark):
    """all files or surfaces of a batch of 10,000 rows stood in a worker at once."""
    import pandas as pd

    from cairn.sources import files as small

    assert [len(p) for p in small.parts([pd.DataFrame({"a": range(300)}), pd.DataFrame({"a": range(2)})])] == [128, 128, 44, 2]
    eye = np.eye(4).tolist()
    rows = spark.range(0, 300, 1, 1).selectExpr("id", "array(1, 1, 1) shape", "'uint8' dtype", "unhex('01') data").toPandas().assign(affine=[eye] * 300)
    seen = []
    given = type("Rows", (), {"select": lambda self, *_: self, "mapInPandas": lambda self, run, _: seen.extend(len(x) for x in run(iter([rows])))})()
    mesh.meshes(given, "id", smooth=False)
    assert sum(seen) == 300 and max(seen) <= 128


def test_digests_of_long_files_are_read_in_steps(spark, tmp_path):
    """each file was one value in memory, and a file of 2 GB or more ended the job."""
    import hashlib

    from cairn.sources import files as sources

    want = {}
    for name, n in (("a.bin", 3), ("b c.bin", 9 << 20), ("d.bin", 17 << 20)):
        data = bytes(range(1, 252)) * (n // 251 + 1)
        (tmp_path / name).write_bytes(data[:n])
        want[name] = hashlib.sha256(data[:n]).hexdigest()
    got = sources.folder_digests(spark, f"file://{tmp_path}", whole=1 << 20).collect()
    assert {r.path.rsplit("/", 1)[1].replace("%20", " "): r.sha256 for r in got} == want


def test_contents_are_cut_by_their_bytes_and_ids_are_uuids():
    """instances were parsed and handed on sixteen at a time, whatever their size."""
    import uuid

    import pyarrow as pa

    from cairn.sources import files as sources

    batch = pa.record_batch([pa.array(list("abcdef")), pa.array([b"x" * n for n in (1, 1, 9, 30, 1, 0)], pa.binary())], names=["path", "content"])
    assert [p.column(0).to_pylist() for p in sources.by_bytes(batch, 1, 10, 3)] == [["a", "b"], ["c"], ["d"], ["e", "f"]]
    assert [p.num_rows for p in sources.by_bytes(batch, 1, 1000, 4)] == [4, 2]
    assert all(dicom_objects._uuid(x) == uuid.uuid5(uuid.NAMESPACE_OID, x).int for x in ("", "1", "a\0b", "é"))
