"""Ready-made applications: selection rules, the steps around a model, its windows, and the segments that its labels become.

A preset is run with a model of the caller's own: ``run("liver_tumour", instances, load)`` gives the sinks' tables. What a
preset holds are the published settings of such applications; other ones are made by ``replace``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MissingError
from . import applications, bundles

_CT = {"Modality": "(?i)CT", "ImageType": ["PRIMARY", "ORIGINAL"], "PhotometricInterpretation": "MONOCHROME2"}


@dataclass(frozen=True)
class Preset:
    conditions: dict
    spacing: tuple[float, float, float]
    window: tuple[float, float]
    roi: tuple[int, int, int]
    overlap: float
    segments: tuple[dict, ...]
    turned: bool = False
    surfaces: bool = True

    @property
    def rules(self) -> dict:
        return {"selections": [{"name": "CT Series", "conditions": self.conditions}]}

    @property
    def bundle(self) -> bundles.Bundle:
        """Resampled, scaled, cropped; windows; softmax, labels, and back to the grid that came in."""
        low, high = self.window
        before = [
            {"_target_": "EnsureChannelFirstd", "keys": "image"},
            {"_target_": "Spacingd", "keys": "image", "pixdim": list(self.spacing), "mode": "bilinear"},
            *([{"_target_": "Orientationd", "keys": "image", "axcodes": "RAS"}] if self.turned else []),
            {"_target_": "ScaleIntensityRanged", "keys": "image", "a_min": low, "a_max": high, "b_min": 0.0, "b_max": 1.0, "clip": True},
            {"_target_": "CropForegroundd", "keys": "image", "source_key": "image"},
        ]
        after = [{"_target_": "Activationsd", "keys": "pred", "softmax": True}, {"_target_": "AsDiscreted", "keys": "pred", "argmax": True}, {"_target_": "Invertd", "keys": "pred", "orig_keys": "image", "nearest_interp": True}]
        inferer = {"_target_": "SlidingWindowInferer", "roi_size": list(self.roi), "overlap": self.overlap, "sw_batch_size": 4}
        return bundles.bundle_of({"inference": json.dumps({"preprocessing": {"transforms": before}, "inferer": inferer, "postprocessing": {"transforms": after}})})


def _segments(category: tuple[str, str, str], *named: tuple[str, str, str], algorithm: str = "") -> tuple[dict, ...]:
    """(label, code, meaning) of each label from 1 on."""
    return tuple({"label": label, "value": n, "category": category, "type": (code, "SCT", meaning), "algorithm": algorithm} for n, (label, code, meaning) in enumerate(named, 1))


#: Codes of categories, and the organs of the multi-organ model in order of their labels.
ORGAN, TUMOUR = ("113343008", "SCT", "Organ"), ("108369006", "SCT", "Tumor")
ORGANS = (
    ("Spleen", "78961009", "Spleen"), ("Right Kidney", "64033007", "Kidney"), ("Left Kidney", "64033007", "Kidney"), ("Gallbladder", "28231008", "Gallbladder"), ("Esophagus", "32849002", "Esophagus"),
    ("Liver", "10200004", "Liver"), ("Stomach", "69695003", "Stomach"), ("Aorta", "15825003", "Aorta"), ("Inferior vena cava", "64131007", "Inferior vena cava"), ("Portal and Splenic Veins", "35819009", "Splenic vein"),
    ("Pancreas", "15776009", "Pancreas"), ("Right adrenal gland", "23451007", "Adrenal gland"), ("Left adrenal gland", "23451007", "Adrenal gland"),
)


def _with_tumour(organ: tuple[str, str, str], algorithm: str) -> tuple[dict, ...]:
    (first,) = _segments(ORGAN, organ, algorithm=algorithm)
    return first, {"label": "Tumor", "value": 2, "category": TUMOUR, "type": TUMOUR, "algorithm": algorithm}


#: Spacings in mm, intensity windows, window sizes and overlaps.
PRESETS = {
    "liver_tumour": Preset(_CT, (1.0, 1.0, 1.0), (-21.0, 189.0), (160, 160, 160), 0.6, _with_tumour(("Liver", "10200004", "Liver"), "3D segmentation of the liver and tumor from CT image")),
    "multi_organ": Preset(_CT, (1.5, 1.5, 2.0), (-175.0, 250.0), (96, 96, 96), 0.5, _segments(ORGAN, *ORGANS, algorithm="3D multi-organ segmentation from CT image"), turned=True),
    "pancreas": Preset(_CT, (1.0, 1.0, 1.0), (-87.0, 199.0), (96, 96, 96), 0.625, _with_tumour(("Pancreas", "15776009", "Pancreas"), "Pancreas CT DiNTS segmentation from CT image"), turned=True, surfaces=False),
    "spleen": Preset(_CT, (1.5, 1.5, 2.9), (-57.0, 164.0), (96, 96, 96), 0.6, _segments(ORGAN, ("Spleen", "78961009", "Spleen"), algorithm="3D segmentation of the spleen from CT image")),
}


def preset(name: str, **own: object) -> Preset:
    """A preset by name, with settings of the caller's own."""
    if name not in PRESETS:
        raise MissingError(f"no preset {name!r}: {', '.join(PRESETS)}")
    return replace(PRESETS[name], **own)


def labels(packed: DataFrame, chosen: Preset, load: Callable[[], bundles.Model]) -> DataFrame:
    """Label volumes of packed volumes (shape, dtype, data, affine), on the grid that came in."""
    return bundles.inferred(packed, chosen.bundle, load)


def run(name: str | Preset, instances: DataFrame, load: Callable[[], bundles.Model], store: bool = True) -> dict[str, DataFrame]:
    """Selection, volumes, model and sinks of a preset: segmentations and, where it has them, surfaces."""
    chosen = preset(name) if isinstance(name, str) else name
    packed = applications.volumes(applications.selected(instances, chosen.rules).drop("selection_name", "match_rank").dropDuplicates(["path"]))
    made = labels(packed, chosen, load).withColumn("key", F.concat_ws("/", *applications.SERIES))
    return applications.sinks_of(packed, applications.stored_once(made) if store else made, list(chosen.segments), chosen.surfaces)
