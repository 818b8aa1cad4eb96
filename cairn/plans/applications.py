"""Applications: folders of instance files to finished objects, each one lazy plan of sources, operators and sinks.

A model is whatever ``load()`` returns: a function from a float volume (z, y, x) to label values of its shape, or to
class scores (classes, z, y, x). It is loaded once for each task and runs on one volume at a time. Results are
(name, content) rows that ``sinks.files.saved`` writes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.scalars import report_line, report_map
from ..operators import checks, chunks, detect, kernels
from ..operators.aggregate import label_volumes
from ..operators.geometry import affine, det3, ordered_slices
from ..operators.hierarchy import latest_of_position
from ..operators.volume import WINDOWS, stacked, unpacked
from ..sinks import dicom_objects, mesh, pictures, results
from ..sources import dicom, files, headers
from ..streaming.micro_batch import shared_folder
from .flow import Flow, Step
from .rules import select_series

SERIES = ["study_uid", "series_uid"]
Model = Callable[[np.ndarray], np.ndarray]


def selected(instances: DataFrame, rules: str | dict | None, all_matched: bool = False, keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Instances of the selected series, with selection_name and match_rank. The join is on series, of which there are few."""
    return instances.join(selected_series(instances, rules, all_matched, keep), SERIES)


def selected_series(instances: DataFrame, rules: str | dict | None, all_matched: bool = False, keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(study_uid, series_uid, selection_name, match_rank): the selected series by themselves, by one pass over the instances."""
    found = select_series(dicom.attributes_of(instances), rules, ["study_uid"], ["series_uid"], F.col("series_uid"), all_matched, "n_instances", keep)
    return found.select(*SERIES, "selection_name", "match_rank")


def selected_files(spark: SparkSession, folder: str, rules: str | dict | None, all_matched: bool = False) -> DataFrame:
    """Instances of the selected series, as ``selected`` gives them: headers are scanned without pixels, then only chosen files are read whole.

    The chosen files' paths are stored in between, so headers are scanned once."""
    held = stored_once(headers.instances(spark, folder))
    chosen = held.select(*SERIES, "path").join(selected_series(held, rules, all_matched), SERIES)
    # a file may be chosen by several selections; it is read once
    whole = dicom.parsed(files.contents_of(chosen.select("path").distinct(), folder))
    return whole.join(chosen.select("path", "selection_name", "match_rank"), "path")


def real_values(slices: DataFrame) -> DataFrame:
    """Packed slices with their pixels as float32: rescaled, MONOCHROME1 turned over by each slice's own maximum.

    Slices whose pixels don't fill rows and columns, or are compressed, get null pixels."""

    def real(pixels, rows, cols, dtype, slope, intercept, photometric) -> bytes | None:
        if pixels is None or dtype not in ("uint8", "int8", "uint16", "int16", "uint32", "int32"):
            return None
        kind = np.dtype(dtype).newbyteorder("<")
        n = int(rows or 0) * int(cols or 0)
        if not n or len(pixels) < n * kind.itemsize:
            return None
        v = np.frombuffer(pixels, kind, n).astype("<f8")
        v = v * (1.0 if pd.isna(slope) else slope) + (0.0 if pd.isna(intercept) else intercept)
        return (v.max() - v if photometric == "MONOCHROME1" else v).astype("<f4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("pixels", "rows", "cols", "dtype", "slope", "intercept", "photometric")))
            yield pdf.assign(pixels=[real(*x) for x in cells], dtype="float32")

    return slices.mapInPandas(run, slices.schema)


def volumes(instances: DataFrame, keys: list[str] | None = None, ras: bool = True) -> DataFrame:
    """(keys, shape, dtype, data, affine, sop_uids, sop_class_uid, positions, tags) of each series.

    Of instances at the same position the latest acquisition counts; slices that ``checks.checked_slices`` refuses go before
    any worker starts. A series of one slice has no affine. tags are those of the first slice."""
    keys = keys or SERIES
    once = latest_of_position(instances, keys, F.col("position"), F.col("acquisition_number"), [F.col("path"), F.col("sop_uid")])
    plain = [*keys, "path", "sop_uid", "sop_class_uid", "position", "orientation", "pixel_spacing", "rows", "cols", "dtype", "slope", "intercept", "photometric", "pixels"]
    even = checks.passed(checks.checked_slices(once.select(*plain), keys))
    placed = ordered_slices(real_values(even), keys, "path")
    packed = stacked(placed, keys)
    facts = placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("z", "position", "sop_uid"))).alias("_s"),
        F.min_by(F.struct("orientation", F.coalesce("pixel_spacing", F.array(F.lit(1.0), F.lit(1.0))).alias("spacing"), "sop_class_uid"), "z").alias("_f"),
    )
    tags = instances.groupBy(*keys).agg(F.min_by("tags", F.struct("path", "sop_uid")).alias("tags"))
    at = lambda i: F.element_at("_s", i)["position"]
    gap = lambda i: F.get(F.col("_f.spacing"), F.lit(i))
    matrix = affine(F.col("_f.orientation"), gap(1), gap(0), at(1), at(-1), F.size("_s"), ras)
    named = facts.select(*keys, matrix.alias("affine"), F.transform("_s", lambda s: s["sop_uid"]).alias("sop_uids"), F.transform("_s", lambda s: s["position"]).alias("positions"), F.col("_f.sop_class_uid").alias("sop_class_uid"))
    return packed.join(named, keys).join(tags, keys)


def tiled(volume: np.ndarray, model: Model, roi: tuple[int, ...], overlap: float | tuple[float, ...] = 0.25, gaussian: bool = False) -> np.ndarray:
    """The mean of the model's class scores over windows that slide along each axis; a volume smaller than the roi lies in the middle of zeros.

    One task holds the volume, and the model gets one window at a time; ``operators.chunks`` spreads windows over tasks."""
    tiling = chunks.Tiling(tuple(roi), overlap, gaussian=gaussian)
    sizes, weights = tiling.sizes(volume.shape), tiling.weights(tiling.sizes(volume.shape))
    before = [max(0, (s - n) // 2) for s, n in zip(sizes, volume.shape)]
    padded = np.pad(volume, [(lo, max(0, s - n) - lo) for s, n, lo in zip(sizes, volume.shape, before)])
    total, seen = None, np.zeros(padded.shape)
    for corner in product(*tiling.starts(volume.shape)):
        place = tuple(slice(a + lo, a + lo + size) for a, lo, size in zip(corner, before, sizes))
        scores = model(padded[place])
        if total is None:
            total = np.zeros((len(scores), *padded.shape))
        total[(slice(None), *place)] += scores * weights
        seen[place] += weights
    return (total / seen)[(slice(None), *[slice(lo, lo + n) for lo, n in zip(before, volume.shape)])]


def segmented(packed: DataFrame, load: Callable[[], Model], window: tuple[float, float] | str | None = None, roi: tuple[int, ...] | None = None, overlap: float = 0.25) -> DataFrame:
    """packed volumes with label volumes (uint8) in their place. Scores of a model become labels by their first largest class.

    window: an intensity window (or the name of a known one) that values are scaled and clipped to first."""
    low_high = WINDOWS[window] if isinstance(window, str) else window
    columns = [c for c in packed.columns if c != "tags"]  # maps don't pass pandas

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            out = []
            for s, t, d in zip(pdf["shape"], pdf["dtype"], pdf["data"]):
                v = unpacked(list(s), t, d).astype(np.float32)
                if low_high:
                    v = np.clip((v - low_high[0]) / (low_high[1] - low_high[0]), 0, 1)
                got = np.asarray(tiled(v, model, roi, overlap) if roi else model(v))
                out.append((got.argmax(0) if got.ndim == v.ndim + 1 else got).astype(np.uint8))
            yield pdf.assign(shape=[list(x.shape) for x in out], dtype="uint8", data=[x.tobytes() for x in out])

    keys = [c for c in SERIES if c in columns]
    labels = packed.select(*columns).mapInPandas(run, packed.select(*columns).schema)
    return labels.join(packed.select(*keys, "tags"), keys) if "tags" in packed.columns else labels


def label_counts(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, n, voxel_mm3) of packed label volumes, the background left out; counted in the workers."""
    keys = keys or SERIES
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in labels.select(*keys, "affine").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, (t, d) in enumerate(zip(pdf["dtype"], pdf["data"])):
                found, n = np.unique(np.frombuffer(d, t), return_counts=True)
                own = pd.DataFrame({"label": found.astype(np.int64), "n": n.astype(np.int64)})
                for c in [*keys, "affine"]:
                    own[c] = [pdf[c].iloc[at]] * len(own)
                yield own[own["label"] != 0][[*keys, "affine", "label", "n"]]

    rows = labels.select(*keys, "affine", "dtype", "data").mapInPandas(run, f"{kinds}, label long, n long")
    return rows.select(*keys, "label", "n", F.abs(det3(F.col("affine"))).alias("voxel_mm3"))


def organ_texts(labels: DataFrame, names: dict[str, int], keys: list[str] | None = None) -> DataFrame:
    """(keys, text): a line with the volume of each named label that occurs, by label; names: label values by organ."""
    keys = keys or SERIES
    name = F.create_map(*[F.lit(x) for organ, value in names.items() for x in (value, organ)])
    sized = label_volumes(label_counts(labels, keys), "n", F.col("voxel_mm3")).withColumn("name", F.try_element_at(name, F.col("label").cast("int"))).where(F.col("name").isNotNull() & F.col("volume_ml").isNotNull())
    lines = F.array_sort(F.collect_list(F.struct("label", report_line(F.col("name"), F.col("volume_ml")).alias("line"))))
    return sized.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def _key(keys: list[str]) -> Column:
    return F.concat_ws("/", *keys)


def series_pictures(instances: DataFrame, rules: str | dict | None = None) -> DataFrame:
    """Every slice of the selected series as a PNG."""
    return pictures.slice_pictures(volumes(selected(instances, rules, True).drop("selection_name", "match_rank").dropDuplicates(["path"])).withColumn("key", _key(SERIES)), "key")


def stored_once(df: DataFrame, label: str = "labels") -> DataFrame:
    """df in the shared folder, so that what made it runs once however many sinks read it."""
    path = f"{shared_folder(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segmentation_app(
    instances: DataFrame, rules: str | dict | None, load: Callable[[], Model], segments: list[dict], window: tuple[float, float] | str | None = None, roi: tuple[int, ...] | None = None, overlap: float = 0.25,
    surfaces: bool = True, report: bool = False, captures: bool = False, documents: str | None = None, store: bool = True,
) -> dict[str, DataFrame]:
    """Select, stack, segment; then a segmentation object, and if asked a surface, a text report, a secondary capture of
    each slice's overlay and a document (of the named collection) of each series.

    The label volumes are what all sinks share; they are stored once, unless store is off."""
    chosen = selected(instances, rules).drop("selection_name", "match_rank").dropDuplicates(["path"])
    packed = volumes(chosen)
    labels = segmented(packed, load, window, roi, overlap).withColumn("key", _key(SERIES))
    return sinks_of(packed, stored_once(labels) if store else labels, segments, surfaces, report, captures, documents)


def sinks_of(packed: DataFrame, labels: DataFrame, segments: list[dict], surfaces: bool = True, report: bool = False, captures: bool = False, documents: str | None = None) -> dict[str, DataFrame]:
    """What is made of label volumes with a key."""
    out = {"segmentations": dicom_objects.segmentations(labels, "key", segments)}
    if surfaces:
        out["surfaces"] = mesh.meshes(labels.where(F.col("affine").isNotNull()), "key")
    if captures:
        out["captures"] = dicom_objects.captures(overlay_slices(packed, labels, [s["value"] for s in segments]), "key")
    if report or documents:
        texts = organ_texts(labels, {s["label"]: s["value"] for s in segments}).join(labels.select(*SERIES, "key", "tags"), SERIES)
        if report:
            out["reports"] = dicom_objects.text_reports(texts, "key")
        if documents:
            out["documents"] = results.documents(texts.select(*SERIES, report_map(F.col("text")).alias("volumes"), F.map_filter("tags", lambda k, v: k.isin(*dicom.PATIENT_TAGS, *dicom.STUDY_TAGS)).alias("source")), documents)
    return out


def overlay_slices(packed: DataFrame, labels: DataFrame, values: list[int], alpha: float = 0.7) -> DataFrame:
    """(key, shape, data, tags): each slice in grey with the contours of its labels in colour, one row a slice."""
    both = packed.select(*SERIES, "shape", "dtype", "data").join(labels.select(*SERIES, "key", F.col("dtype").alias("label_dtype"), F.col("data").alias("label_data")), SERIES)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*SERIES).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                image, mask = unpacked(list(r.shape), r.dtype, r.data), unpacked(list(r.shape), r.label_dtype, r.label_data)
                drawn = kernels.overlay(image, kernels.contours(mask, values), alpha)
                for z, a in enumerate(drawn):
                    yield pd.DataFrame({**{k: [getattr(r, k)] for k in SERIES}, "key": [f"{r.key}/{z}"], "shape": [list(a.shape)], "data": [a.tobytes()]})

    made = both.mapInPandas(run, f"{kinds}, key string, shape array<int>, data binary")
    return made.join(labels.select(*SERIES, "tags"), SERIES)


def multi_model_app(instances: DataFrame, rules: str | dict | None, models: dict[str, tuple[Callable[[], Model], list[dict], dict]], store: bool = True) -> dict[str, dict[str, DataFrame]]:
    """One volume of each selected series through several models, each with its own sinks. models: name to (load, segments,
    options of ``segmented``). The volumes are stored once, so slices are read and stacked once."""
    flow = Flow(store=stored_once if store else None)
    source = Step("volumes", lambda: volumes(selected(instances, rules).drop("selection_name", "match_rank").dropDuplicates(["path"])))
    flow.add(source)
    for name, (load, segments, options) in models.items():

        def run(volumes: DataFrame, load=load, segments=segments, options=options, name=name) -> dict[str, DataFrame]:
            labels = segmented(volumes, load, **options).withColumn("key", F.concat_ws("/", *SERIES, F.lit(name)))
            return sinks_of(volumes, stored_once(labels) if store else labels, segments)

        flow.connect(source, Step(name, run, ("volumes",), ("segmentations", "surfaces")))
    made = flow.run()
    return {name: made[name] for name in models}


def ensemble_app(instances: DataFrame, rules: str | dict | None, models: list[Callable[[], Model]], segments: list[dict], window: tuple[float, float] | str | None = None, roi: tuple[int, ...] | None = None, overlap: float = 0.25) -> dict[str, DataFrame]:
    """All matching series, the largest first; of each study's selection the largest through all models, whose scores are
    averaged before the largest class counts; then segmentation, report and captures."""
    ranked = selected(instances, rules, True)
    chosen = ranked.where("match_rank = 1").drop("selection_name", "match_rank").dropDuplicates(["path"])

    def load() -> Model:
        loaded = [m() for m in models]

        def mean(v: np.ndarray) -> np.ndarray:
            total = None
            for m in loaded:  # one model's scores at a time
                scores = np.asarray(m(v), float)
                total = scores if total is None else total + scores
            return total / len(loaded)

        return mean

    packed = volumes(chosen)
    labels = segmented(packed, load, window, roi, overlap).withColumn("key", _key(SERIES))
    return sinks_of(packed, stored_once(labels), segments, False, True, True)


def detection_app(instances: DataFrame, rules: str | dict | None, load: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]], layer: str = "FINDINGS", what: str = "Finding", least: float = 0.1, overlap: float = 0.22, most: int = 100) -> dict[str, DataFrame]:
    """Select, stack, detect; then a presentation state and a diagnostics document of each series.

    The model gives (boxes (n, 6) as x0, y0, z0, x1, y1, z1 in cells, scores (n,)) of a volume."""
    packed = stored_once(volumes(selected(instances, rules).drop("selection_name", "match_rank").dropDuplicates(["path"])), "volumes")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.select(*SERIES).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                boxes, scores = model(unpacked(list(r.shape), r.dtype, r.data))
                if len(boxes):
                    yield pd.DataFrame({**{k: [getattr(r, k)] * len(boxes) for k in SERIES}, "box": [list(map(float, b)) for b in boxes], "score": np.asarray(scores, float)})

    found = packed.select(*SERIES, "shape", "dtype", "data").mapInPandas(run, f"{kinds}, box array<double>, score double")
    inside = found.join(packed.select(*SERIES, F.reverse("shape").alias("_size")), SERIES).withColumn("box", detect.clipped(F.col("box"), F.col("_size"))).withColumn("image_id", _key(SERIES)).drop("_size")
    kept = stored_once(detect.non_maximum(inside, overlap=overlap, least=least, most=most), "boxes").withColumn("box_id", F.col("rank"))
    slices = packed.select(*SERIES, F.explode(F.sequence(F.lit(0), F.element_at("shape", 1) - 1)).alias("z"))
    listed = detect.findings_of(kept, slices, SERIES)
    facts = packed.select(*SERIES, _key(SERIES).alias("key"), "sop_uids", "sop_class_uid", "tags").join(listed, SERIES, "left")
    full = facts.withColumn("findings", F.coalesce("findings", F.array().cast(listed.schema["findings"].dataType)))
    return {"presentations": dicom_objects.presentation_states(full, "key", layer), "diagnostics": detect.diagnostics(full, [*SERIES, "key"], what), "detections": kept.drop("image_id")}


def classification_app(instances: DataFrame, rules: str | dict | None, load: Callable[[], Model], classes: tuple[str, ...]) -> DataFrame:
    """Select, stack, classify; then a text report of the probabilities, one line a class, for each series. The model gives one vector a volume."""
    chosen = volumes(selected(instances, rules).drop("selection_name", "match_rank").dropDuplicates(["path"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            scores = [np.asarray(model(unpacked(list(s), t, d))).ravel() for s, t, d in zip(pdf["shape"], pdf["dtype"], pdf["data"])]
            yield pdf[SERIES].assign(text=["\n".join(f"{c}: {p:.4f}" for c, p in zip(classes, x)) for x in scores])

    texts = chosen.select(*SERIES, "shape", "dtype", "data").mapInPandas(run, "study_uid string, series_uid string, text string")
    return dicom_objects.text_reports(texts.join(chosen.select(*SERIES, "tags"), SERIES).withColumn("key", _key(SERIES)), "key")
