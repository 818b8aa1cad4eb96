"""Headers as a data source, files in pairs, the document store, checks with reasons, table functions."""

import json
import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.errors import MissingError, PlanError
from cairn.functions import table_functions
from cairn.operators import checks
from cairn.plans import applications as apps
from cairn.sinks import store
from cairn.sources import dicom, dicom_format, files, headers, metaimage

ROOT = str(Path(__file__).resolve().parent.parent)


def encoded(k, pixels=50_000, **more):
    values = {"SOPClassUID": "1.2.840.10008.5.1.4.1.1.2", "SOPInstanceUID": f"1.4.{k}", "StudyInstanceUID": "1.2.1", "SeriesInstanceUID": f"1.3.{k % 2}", "Modality": "CT" if k % 2 else "MR", "ImageType": ["ORIGINAL", "PRIMARY"],
              "PatientName": "Ä b", "SliceThickness": float(k), "ImagePositionPatient": [0.0, 0.0, float(k)], "ImageOrientationPatient": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "Rows": 2, "Columns": pixels // 4, "BitsAllocated": 16, "PixelRepresentation": 0, "PixelData": b"\1\0" * (pixels // 2)}
    return dicom_format.encoded(values | more)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    (root / "sub dir").mkdir(parents=True)
    for k in range(6):
        (root / ("sub dir" if k > 3 else ".") / f"{k}.dcm").write_bytes(encoded(k))
    (root / "long.dcm").write_bytes(encoded(6, 100, StudyDescription="x" * 9000))
    (root / "bad.dcm").write_bytes(b"no header" * 100)
    (root / "cut.dcm").write_bytes(encoded(8)[:300])
    (root / "empty.dcm").write_bytes(b"")
    return str(root)


SCHEMA = "path string, length long, bytes_read long, parse_ok boolean, parse_error string, Modality string, SliceThickness double, ImageType array<string>, ImagePositionPatient array<double>, PatientName string, Rows int, tags map<string,string>"


def test_headers_are_those_of_whole_files(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: r for r in headers.headers(spark, folder, SCHEMA, files_per_task=3, first_bytes=1024).collect()}
    want = {r.path.rsplit("/", 1)[-1]: r for r in dicom.instances(spark, f"file://{folder}", False).collect()}
    assert set(got) == set(want) | {"empty.dcm"}
    for name, r in want.items():
        g = got[name]
        assert g.parse_ok == r.parse_ok and (not r.parse_ok or {k: v for k, v in r.tags.items() if k != "PixelData"} == g.tags), name
    assert not got["empty.dcm"].parse_ok and "DICM" in got["bad.dcm"].parse_error and got["bad.dcm"].bytes_read <= 1024
    one = got["3.dcm"]
    assert (one.Modality, one.SliceThickness, one.ImageType, one.ImagePositionPatient, one.PatientName, one.Rows) == ("CT", 3.0, ["ORIGINAL", "PRIMARY"], [0.0, 0.0, 3.0], "Ä b", 2)
    assert one.length > 50_000 and one.bytes_read == 1024 and got["long.dcm"].bytes_read >= 9000  # doubling steps


def test_filters_reach_the_scan(spark, folder):
    rows = headers.headers(spark, folder, SCHEMA)
    plan = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    ct = rows.where("Modality = 'CT' AND SliceThickness >= 3.0 AND path LIKE '%.dcm'")
    assert "EqualTo(Modality,CT)" in plan(ct) and names(ct) == ["3.dcm", "5.dcm"]
    assert names(rows.where("Modality IN ('MR', 'XX') AND SliceThickness < 3")) == ["0.dcm", "2.dcm"]
    assert names(rows.where("Modality IS NULL AND NOT parse_ok")) == ["bad.dcm", "cut.dcm", "empty.dcm"]
    assert names(rows.where("Modality <=> 'MR' AND length > 1000 AND SliceThickness > 3")) == ["4.dcm", "long.dcm"]
    assert names(rows.where("Modality LIKE 'C%' AND (SliceThickness = 1 OR Rows = 7)")) == ["1.dcm"]  # what can't be pushed is tested after
    assert names(rows.where(F.array_contains("ImageType", "PRIMARY") & (F.col("SliceThickness") == 1))) == ["1.dcm"]
    assert headers.headers(spark, folder, "path string").where("length(path) < 3").count() == 0


def test_header_schemas_are_checked(spark, folder, tmp_path):
    with pytest.raises(Exception, match="no attribute Nothing"):
        headers.headers(spark, folder, "Nothing string").collect()
    with pytest.raises(Exception, match="no attribute comes as"):
        headers.headers(spark, folder, "Rows date").collect()
    (tmp_path / "none").mkdir()
    assert headers.headers(spark, str(tmp_path / "none")).collect() == []


def test_only_chosen_files_are_read_whole(spark, folder):
    rules = {"selections": [{"name": "ct", "conditions": {"Modality": "CT"}}, {"name": "any", "conditions": {"PatientName": "Ä"}}]}
    got = apps.selected_files(spark, folder, rules, True)
    want = apps.selected(dicom.loaded(spark, f"file://{folder}"), rules, True)
    shown = lambda df: sorted((r.path.rsplit("/", 1)[-1], r.selection_name, r.match_rank, bytes(r.pixels), r.rows) for r in df.collect())
    assert shown(got) == shown(want) and len(shown(got)) == 10


def test_a_study_has_its_first_instances_attributes(spark, folder):
    rows = dicom.loaded(spark, f"file://{folder}", with_pixels=False)
    got = {r.series_uid: r for r in dicom.attributes_of(rows).collect()}
    assert got["1.3.0"].n_instances == 4 and got["1.3.1"].n_instances == 3 and {r.PatientName for r in got.values()} == {"Ä b"}
    assert dicom.attributes_of(rows)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


# pairs


def test_pairs_of_files(spark, tmp_path):
    root = tmp_path / "with blank"
    root.mkdir()
    a = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    head = "ObjectType = Image\nNDims = 3\nDimSize = 4 3 2\nElementType = MET_FLOAT\nElementSpacing = 1 2 3\nOffset = 5 6 7\nTransformMatrix = 1 0 0 0 1 0 0 0 1\n"
    (root / "a.mhd").write_text(head + "ElementDataFile = a.raw\n")
    (root / "a.raw").write_bytes(a.tobytes())
    (root / "z.mhd").write_text(head + "CompressedData = True\nElementDataFile = z.zraw\r\n")
    (root / "z.zraw").write_bytes(zlib.compress(a.tobytes()))
    (root / "broken.mhd").write_text(head + "CompressedData = True\nElementDataFile = broken.zraw\n")
    (root / "broken.zraw").write_bytes(b"not zlib")
    (root / "half.mhd").write_text(head + "ElementDataFile = gone.raw\n")
    (root / "alone.raw").write_bytes(b"1234")
    (root / "odd.mhd").write_text(head.replace("4 3 2", "4 x 2") + "ElementDataFile = a.raw\n")
    (root / "type.mhd").write_text(head.replace("MET_FLOAT", "MET_ODD") + "ElementDataFile = a.raw\n")
    (root / "local.mhd").write_text(head + "ElementDataFile = LOCAL\n")
    (root / "rgb.mhd").write_text("NDims = 2\nDimSize = 2 1\nElementType = MET_UCHAR\nElementNumberOfChannels = 3\nElementDataFile = rgb.raw\n")
    (root / "rgb.raw").write_bytes(bytes(range(6)))
    got = {r.path.rsplit("/", 1)[-1]: r for r in metaimage.volumes(spark, str(root)).collect()}
    for name in ("a.mhd", "z.mhd"):
        assert np.array_equal(np.frombuffer(bytes(got[name].data), "<f4").reshape(got[name].shape), a) and got[name].spacing == [1.0, 2.0, 3.0] and got[name].origin == [5.0, 6.0, 7.0]
    assert got["rgb.mhd"].shape == [1, 2, 3] and bytes(got["rgb.mhd"].data) == bytes(range(6))
    reasons = {k: r.reason for k, r in got.items() if r.reason}
    assert reasons.pop("broken.mhd").startswith("compressed data that can't be read")
    assert reasons == {"half.mhd": "its data file is not there", "alone.raw": "no header names it", "odd.mhd": "no sizes", "type.mhd": "unknown type", "local.mhd": "data file of another form"}
    assert all(r.data is None for r in got.values() if r.reason)


# store


def documents(spark, rows):
    return spark.createDataFrame(rows, "collection string, id string, document string")


def shown(spark, folder):
    return sorted((r.collection, r.id, r.document) for r in store.read(spark, folder).collect())


def test_batches_are_published_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert shown(spark, folder) == []
    store.append(documents(spark, [("c", "1", "a"), ("c", "2", "b"), ("d", "1", "x")]), folder, 1)
    store.append(documents(spark, [("c", "2", "B"), ("c", "3", "C"), ("c", "3", "D")]), folder, 2)
    want = [("c", "1", "a"), ("c", "2", "B"), ("c", "3", "D"), ("d", "1", "x")]
    assert shown(spark, folder) == want
    store.append(documents(spark, [("c", "9", "never")]), folder, 2)  # replayed: the batch is what it was
    assert shown(spark, folder) == want
    assert sorted(b["documents"] for _, b in store.batches(spark, folder)) == [3, 3]
    files_there = sum(len(f) for d, _, f in os.walk(f"{folder}/data"))
    assert files_there == sum(len(b["files"]) for _, b in store.batches(spark, folder))
    store.append(documents(spark, [("c", "7", "new")]), folder, 3, overwrite=True)
    assert shown(spark, folder) == [("c", "7", "new")]
    store.append(documents(spark, []), folder, 4)
    assert shown(spark, folder) == [("c", "7", "new")]


def test_a_failed_batch_leaves_nothing_to_read(spark, tmp_path):
    folder = str(tmp_path / "store")
    bad = documents(spark, [("c", "1", "a"), ("c", None, "b")]).repartition(2)
    with pytest.raises(Exception, match="without an id"):
        store.append(bad, folder, 1)
    assert shown(spark, folder) == []
    store.append(documents(spark, [("c", "1", "again")]), folder, 1)
    assert shown(spark, folder) == [("c", "1", "again")]
    with pytest.raises(Exception, match="documents are rows of"):
        spark.range(1).write.format(store.FORMAT).option("path", folder).mode("append").save()
    with pytest.raises(Exception, match="no name of a batch"):
        store.append(documents(spark, []), folder, "../x")


def test_only_attempts_that_count_are_published(tmp_path):
    import pyarrow as pa

    folder, rows = str(tmp_path / "store"), pa.RecordBatch.from_pylist([{"collection": "c", "id": "1", "document": "d"}])
    writer = store.Writer(folder, "1", False)
    lost, counted = writer.write(iter([rows])), writer.write(iter([rows]))
    writer.commit([counted, None, writer.write(iter([]))])
    with open(f"{folder}/batches/1.json") as f:
        assert json.load(f)["files"] == [counted.file] and lost.file != counted.file


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from cairn.sinks import store
folder = sys.argv[1]
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def once(batches):
    for b in batches:
        yield b
    mark = folder + "/killed"
    if not os.path.exists(mark):
        open(mark, "w").close()
        os._exit(9)
rows = spark.range(0, 40, 1, 4).selectExpr("'c' AS collection", "cast(id AS string) AS id", "concat('d', id) AS document").mapInArrow(once, store.SCHEMA)
store.append(rows, folder, 1)
store.append(rows, folder, 1)
got = [tuple(r) for r in store.read(spark, folder).collect()]
assert os.path.exists(folder + "/killed") and sorted(got) == sorted(("c", str(k), f"d{k}") for k in range(40)), got
print("WHOLE")
"""


def test_a_killed_task_writes_no_document_twice(tmp_path):
    import pyspark

    (tmp_path / "store").mkdir()
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": os.path.dirname(pyspark.__file__), "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(env["SPARK_HOME"]).iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    run = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path / "store")], env=env | {"SPARK_HOME": str(home)}, capture_output=True, text=True, timeout=180, cwd=tmp_path)
    assert "WHOLE" in run.stdout, run.stderr[-2000:]


def test_ids_come_of_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("a", 1)], "x string, y int")
    got = [r.id for r in rows.select(store.document_id("x", "y").alias("id")).collect()]
    assert len(set(got)) == 3 and got[0] == got[3] and all(len(x) == 24 for x in got)


# checks


def slices(spark, **changes):
    base = {"series": "s", "path": "a", "sop_uid": "1", "position": [0.0, 0.0, 0.0], "orientation": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], "dtype": "uint16", "rows": 2, "cols": 2, "pixels": bytearray(8)}
    kinds = "series string, path string, sop_uid string, position array<double>, orientation array<double>, dtype string, rows int, cols int, pixels binary"
    rows = [base | {"path": f"{k:02d}"} | c for k, c in enumerate(changes.get("rows", []))]
    return spark.createDataFrame([tuple(r[n.split()[0]] for n in kinds.split(", ")) for r in rows], kinds)


def test_each_refusal_has_its_reason(spark):
    tilted = [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    cases = [({}, None), ({"position": None}, "no position"), ({"position": [0.0, float("nan"), 0.0]}, "no position"), ({"orientation": [1.0]}, "no orientation"), ({"pixels": None}, "no pixels"), ({"dtype": "float16"}, "unknown type"), ({"rows": 0}, "no size"),
             ({"pixels": bytearray(7)}, "too few pixels"), ({"rows": 1}, "another rows"), ({"cols": 1}, "another cols"), ({"orientation": tilted}, "another orientation"), ({"orientation": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0005]}, None), ({"position": None, "rows": 9}, "no position")]
    seen, watch = checks.counted(checks.checked_slices(slices(spark, rows=[c for c, _ in cases]), ["series"]), checks.SLICE_REASONS)
    got = {r.path: r.reason for r in seen.collect()}
    assert [got[f"{k:02d}"] for k in range(len(cases))] == [r for _, r in cases]
    counts = watch.get
    assert counts["seen"] == 13 and counts["refused"] == 11 and counts["no position"] == 3 and counts["another cols"] == 1
    assert checks.passed(seen).count() == 2
    with pytest.raises(Exception, match="09: another cols"):
        checks.required(checks.checked_slices(slices(spark, rows=[c for k, (c, r) in enumerate(cases) if not r] + [{"path": "09", "cols": 1}]), ["series"]), F.col("path")).collect()
    assert checks.required(checks.checked_slices(slices(spark, rows=[{}, {}]), ["series"]), F.col("path")).count() == 2


def test_texts_become_types_or_reasons(spark):
    rows = spark.createDataFrame([({"a": "1.5", "n": "7", "t": "x"},), ({"a": "x", "n": "7.5"},), ({"a": "", "n": None},)], "tags map<string,string>")
    columns, refused = checks.coerced(F.col("tags"), {"a": "double", "n": "int", "t": "string"})
    got = rows.select(*columns, checks.reason_of(refused).alias("reason")).collect()
    assert [tuple(r) for r in got] == [(1.5, 7, "x", None), (None, None, None, "a is no double"), (None, None, None, None)]


# table functions


def test_detections(spark):
    table_functions.register(spark)
    rows = [("i", 0, 0.9, [0.0, 0.0, 10.0, 10.0]), ("i", 0, 0.8, [1.0, 1.0, 11.0, 11.0]), ("i", 1, 0.7, [1.0, 1.0, 11.0, 11.0]), ("i", 0, 0.6, [20.0, 20.0, 30.0, 30.0]), ("i", 0, 0.05, [50.0, 50.0, 60.0, 60.0]), (None, 0, 0.5, [0.0, 0.0, 1.0, 1.0]), ("j", 0, None, [0.0, 0.0, 1.0, 1.0]), ("j", 0, float("nan"), None)]
    df = spark.createDataFrame([(k, lab, s, a, [0.0] * 4, "extra") for k, lab, s, a in rows], "image string, label int, score double, anchor array<double>, delta array<double>, more string").repartition(3)
    got = sorted((r.image or "", r.rank, r.label, r.score) for r in table_functions.detections(df, ["image"], 0.1, 0.22).collect())
    assert got == [("", 1, 0, 0.5), ("i", 1, 0, 0.9), ("i", 2, 1, 0.7), ("i", 3, 0, 0.6)]
    assert sorted((r.image or "", r.rank) for r in spark.sql("SELECT image, rank FROM cairn_detections(TABLE({df}), keys => 'image', most => 2)", df=df).collect()) == [("", 1), ("i", 1), ("i", 2)]
    assert {r.image for r in table_functions.detections(df, ["image"], candidates=1).collect()} == {"i", None}
    moved = table_functions.decoded(np.array([0.0, 0.0, 10.0, 20.0]), np.array([0.1, -0.5, np.log(2.0), 50.0]))
    assert np.allclose(moved, [-4.0, -10 * 62.5, 16.0, 10 * 62.5])


@pytest.mark.parametrize("call", ["cairn_detections(TABLE({df}), keys => 'nothing')", "cairn_detections(TABLE({df}), keys => '')", "cairn_detections(TABLE({df}), keys => 'image', overlap => 2)", "cairn_detections(1, keys => 'image')", "cairn_detections(TABLE({odd}), keys => 'image')"])
def test_calls_are_checked_while_planning(spark, call):
    table_functions.register(spark)
    df = spark.createDataFrame([], "image string, label int, score double, anchor array<double>, delta array<double>")
    with pytest.raises(Exception, match="that lack|parted by commas|out of range|is a table"):
        spark.sql(f"SELECT * FROM {call}", df=df, odd=df.withColumn("score", F.lit("x")))


def test_what_is_missing_raises():
    with pytest.raises(PlanError):
        headers.Reader(headers.DEFAULT, {})
    with pytest.raises(MissingError):
        headers.Reader(headers.DEFAULT.add("Odd", "string"), {"path": "/x"})
    assert files.contents_of is not None
