"""Rules, geometry, hierarchy and scalars on hand-built rows, edge cases included."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.errors import RuleError, UnsupportedError
from cairn.functions import scalars
from cairn.operators import aggregate, detect, geometry, hierarchy, volume
from cairn.plans import rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


SERIES = "study string, series string, Modality string, SeriesNumber int, ImageType array<string>, orientation array<double>, tags map<string,string>, n int"


@pytest.fixture(scope="module")
def series(spark):
    axial, coronal = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    return spark.createDataFrame(
        [
            ("a", "1", "CT", 5, ["ORIGINAL", "PRIMARY"], axial, {"Laterality": "L"}, 3),
            ("a", "2", "PCT", 0, ["DERIVED"], coronal, {}, 9),
            ("a", "3", None, None, None, None, None, 1),
            ("b", "4", "", 12, [], axial, {"SeriesNumber": "12.0"}, 2),
            ("b", "5", "ct", 7, ["ORIGINAL", "LOCALIZER"], axial, None, 2),
        ],
        SERIES,
    )


@pytest.mark.parametrize(
    "conditions, want",
    [
        ({"Modality": "ct"}, "125"),  # equal, or found anywhere
        ({"Modality": "^ct$"}, "15"),
        ({"Modality": "(.*?)"}, "125"),  # null and empty never match
        ({"SeriesNumber": [0, ">="]}, "145"),  # zero counts as missing
        ({"SeriesNumber": [5, 7]}, "15"),
        ({"SeriesNumber": [5, "!="]}, "45"),
        ({"SeriesNumber": 7}, "5"),
        ({"SeriesNumber": "1.*"}, "4"),
        ({"SeriesNumber": "12"}, ""),  # the file's own spelling is tested in full
        ({"ImageType": ["original", "!localizer"]}, "1"),
        ({"ImageType": "!derived"}, "15"),
        ({"orientation": "Axial"}, "145"),
        ({"orientation": "coronal"}, "2"),
        ({"Laterality": "l"}, "1"),
        ({"Modality": "", "SeriesNumber": 7}, "5"),  # an empty test is no condition
    ],
)
def test_conditions(series, conditions, want):
    got = rules.select_series(series, {"selections": [{"name": "x", "conditions": conditions}]}, ["study"], ["series"], all_matched=True)
    assert "".join(sorted(r.series for r in got.collect())) == want


def test_selection_forms(series):
    both = json.dumps({"selections": [{"name": "x", "conditions": {"Modality": "ct"}}, {"name": "y", "conditions": {"SeriesNumber": [1, 9]}}, {"name": "z", "conditions": {}}]})
    first = {(r.study, r.selection_name): r.series for r in rules.select_series(series, both, ["study"], ["series"]).collect()}
    assert first == {("a", "x"): "1", ("b", "x"): "5", ("a", "y"): "1", ("b", "y"): "5"}
    ranked = rules.select_series(series, both, ["study"], ["series"], all_matched=True, count="n").where("selection_name = 'x' AND study = 'a'")
    assert [r.series for r in ranked.orderBy("match_rank").collect()] == ["2", "1"]
    assert rules.select_series(series, " ", ["study"], ["series"]).count() == 5
    assert rules.select_series(series, {"selections": []}, ["study"], ["series"]).count() == 0


@pytest.mark.parametrize("bad, error", [({"x": 1}, RuleError), ({"selections": [{"conditions": {"Modality": 3}}]}, RuleError), ({"selections": [{"conditions": {"SeriesNumber": [1, "~"]}}]}, UnsupportedError), ({"selections": [{"conditions": {"SeriesNumber": [1]}}]}, RuleError), ({"selections": [{"conditions": {"ImageType": 3}}]}, RuleError)])
def test_bad_rules_fail_early(series, bad, error):
    with pytest.raises(error):
        rules.select_series(series, bad, ["study"], ["series"])


def test_planes_and_positions(spark):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert [one(spark, geometry.plane(lit(v))) for v in ([1, 0, 0, 0, 1, 0], [1, 0, 0, 0, 0, -1], [0, 1, 0, 0, 0, -1])] == ["Axial", "Coronal", "Sagittal"]
    assert one(spark, geometry.plane(lit([1, 0, 0]))) is None
    assert one(spark, geometry.plane(lit([1, 0, 0, 0, 1, 0]), F.lit("HFS"))) == "Axial"
    with pytest.raises(Exception, match="unknown patient position"):
        one(spark, geometry.plane(lit([1, 0, 0, 0, 1, 0]), F.lit("XYZ")))


def test_latest_of_position(spark):
    rows = spark.createDataFrame([(1, "p", 1), (2, "p", 3), (3, "p", 3), (4, "p", None), (5, None, 1), (6, None, 1), (7, "q", None)], "seq int, pos string, acq int").withColumn("s", F.lit(1))
    got = hierarchy.latest_of_position(rows, ["s"], F.col("pos"), F.col("acq"), [F.col("seq")])
    assert sorted(r.seq for r in got.collect()) == [2, 5, 6, 7]


def test_gated_mean(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 4.0), ("b", 1, 1.0), ("b", 2, None), ("b", 3, 2.0)], "k string, seq int, v double")
    assert {r.k: r.mean_v for r in hierarchy.gated_mean(rows, ["k"], F.col("seq"), "v").collect()} == {"a": "Tag Absent", "b": "1.5"}


def test_slices_of_short_series(spark):
    axial, at = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], lambda z: [0.0, 0.0, float(z)]
    rows = spark.createDataFrame([("a", 1, axial, at(5)), ("b", 1, None, at(0)), ("c", 2, axial, at(7)), ("c", 1, axial, at(4))], "s string, seq int, orientation array<double>, position array<double>")
    got = {(r.s, r.seq): (r.z, r.depth_spacing) for r in geometry.ordered_slices(rows, ["s"], "seq").collect()}
    assert got == {("a", 1): (0, 1.0), ("c", 1): (0, 3.0), ("c", 2): (1, 3.0)}


@pytest.mark.parametrize("text, want", [("1024", 1024), ("2kb", 2000), (" 2 KiB  ", 2048), ("2.3jb", None), ("-2.3Gb", None), ("-1", None), ("1.5 Mi", 1572864), ("3yb", 3 * 10**24), ("1048576", 2**20), ("1073741824", 2**30), ("1000000000000000", 10**15), ("2000000b", 2 * 10**6),
                                        ("1234567kb", 1234567000), ("0.3 Gib", 322122547), ("007", None), ("1e3", None), ("1.", None), (".5", None), ("1.2.3", None), ("5kibs", None), ("", None), ("kb", None), ("9 mb x", None), ("0", 0)])
def test_sizes(spark, text, want):
    assert one(spark, scalars.size_bytes(F.lit(text))) == want


@pytest.mark.parametrize("size, unit, want", [(2**30, "Mi", "1024Mi"), (216, "kib", "0.2kib"), (1024, "b", "1024")])
def test_size_text(spark, size, unit, want):
    assert one(spark, scalars.size_text(F.lit(size), unit)) == want


@pytest.mark.parametrize("name, want", [("name-with-dashes", "name_with_dashes"), ("123name", "_123name"), ("", "app"), ("name!@#valid", "name___valid")])
def test_identifier(spark, name, want):
    assert one(spark, scalars.identifier(F.lit(name))) == want


def test_names(spark):
    assert one(spark, scalars.title_name(F.lit("ORG/test_model"))) == "TestModel"
    assert one(spark, scalars.display_name(F.lit(""), F.lit("ORG/spleen_ct_segmentation"))) == "Spleen Ct Segmentation"
    assert [one(spark, scalars.valid_model_id(F.lit(x))) for x in ("a/b-1", "a;rm", "", "a//b", "a..b", "/a", "org/model_v1.2", "_private/model", "org/model_", "a-", "a/", None, "a b")] == [True, *[False] * 6, True, True, True, False, False, False]
    assert one(spark, scalars.stem(F.lit("a.nii.gz"))) == "a.nii"
    assert one(spark, scalars.wrapped(F.lit("aa bb verylongword c"), 5)) == ["aa bb", "verylongword", "c"]


def test_report_text(spark):
    assert one(spark, scalars.report_line(F.lit("liver"), F.lit(12))) == "Liver Volume: 12 mL"
    assert one(spark, scalars.report_map(F.lit("Liver Volume: 12 mL\nnothing\nA b: c: d "))) == {"LiverVolume": "12 mL", "Ab": "c: d"}
    assert one(spark, scalars.report_map(F.lit("a: 1\nb: 2\na : 3\nb:"))) == {"a": "3", "b": ""} and one(spark, scalars.report_map(F.lit("none"))) == {}


def test_maps_merge_with_the_last_value(spark):
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}, None), (None, {"x": "y"}, {"x": None})], "p map<string,string>, q map<string,string>, r map<string,string>")
    got = [r.m for r in maps.select(scalars.merged(F.col("p"), F.col("q"), F.col("r")).alias("m")).collect()]
    assert got == [{"a": "1", "b": "3", "c": None}, {"x": None}]


def test_rounding_of_volumes(spark):
    rows = spark.createDataFrame([(2500,), (3500,), (1999,)], "n long")
    assert [r.volume_ml for r in aggregate.label_volumes(rows, "n", F.lit(1.0)).orderBy("n").collect()] == [2, 2, 4]
    assert [r.volume_ml for r in aggregate.label_volumes(rows, "n", F.lit(1.0), truncate=True).orderBy("n").collect()] == [2, 2, 3]


def test_components_and_ties(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (7, 7), (6, 5)], "a long, b long")
    assert {(r.a, r.b) for r in aggregate.connected(edges).collect()} == {(2, 1), (3, 1), (5, 4), (6, 4)}
    m = np.array([[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 0]])
    assert volume.largest_component(m).tolist() == [[1, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    p = spark.createDataFrame([("i", 0, 0.5), ("i", 1, 0.5)], "i string, c int, p double")
    assert aggregate.ensemble(p, ["i"], "c", "p").first().c == 0


def test_suppression():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30], [0, 0, 0, 0]], float)
    assert detect.suppressed(boxes, np.arange(4), 0.22, 10) == [0, 2, 3]
    assert detect.suppressed(boxes, np.arange(4), 0.22, 1) == [0]


def test_range_join_is_exact(spark):
    points = spark.range(50).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("z"))
    boxes = spark.createDataFrame([(1, 2.5, 7.0), (1, 9.0, 9.0), (1, 8.0, 3.0), (1, -5.0, 100.0)], "k int, lo double, hi double")
    got = detect.range_join(points, boxes, ["k"], "z", "lo", "hi", 4.0)
    assert got.count() == 5 + 1 + 0 + 50


def test_packed_volumes(spark):
    rows = spark.createDataFrame([("a", z, 2, 3, "int16", bytearray(np.full((2, 3), z, "<i2").tobytes())) for z in (1, 0)], "s string, z int, rows int, cols int, dtype string, pixels binary")
    doubled = volume.per_volume(volume.stacked(rows, ["s"]), lambda a: (a * 2).astype("int16")).first()
    assert doubled["shape"] == [2, 2, 3] and volume.unpacked(doubled["shape"], doubled["dtype"], bytes(doubled["data"]))[1].sum() == 12
    assert volume.resampled(np.array([0.0, 2.0]), (1.0,), 0.5).shape == (4,)


def test_equal_boxes_of_equal_scores_stay_by_their_ties(spark):
    """which of two such rows stayed depended on how rows arrived."""
    rows = [("a", k, [0.0, 0.0, 10.0, 10.0], 0.5) for k in range(400)]
    for turned in (rows, rows[::-1]):
        d = spark.createDataFrame(turned, "image_id string, event_id long, box array<double>, score double").repartition(7, "event_id")
        assert [r.event_id for r in detect.non_maximum(d, ties=["event_id"]).collect()] == [0]
