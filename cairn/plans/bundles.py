"""Inference as a bundle's own configuration tells: named steps before and after, an inferer, inputs and outputs.

A configuration is JSON with the steps under ``preprocessing`` and ``postprocessing`` (``{"transforms": [{"_target_":
name, "keys": ..., ...}]}``), an ``inferer`` and, under ``_meta_`` or in its own file, ``network_data_format``. Steps run
on one volume at a time in Arrow workers, on dicts of arrays by key, channels first; readers and writers of files are
left out, as the engine has sources and sinks of its own. A step that the engine doesn't know raises while the plan is
built. Names such as ``@image_key`` are looked up in the configuration; expressions ($...) are refused.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError, UnsupportedError
from ..operators import kernels
from ..operators.chunks import Tiling
from ..operators.volume import largest_component, unpacked
from ..sources.files import rows_by_bytes
from .applications import tiled

Model = Callable[[np.ndarray], np.ndarray]
#: Steps that are left out: by parts of their names.
FILE_STEPS = ("LoadImage", "SaveImage")


class Inferer(Enum):
    SIMPLE = "simple"
    SLIDING_WINDOW = "sliding_window"


def inferer_of(kind: Inferer | str) -> Inferer:
    if isinstance(kind, Inferer):
        return kind
    if not isinstance(kind, str):
        raise PlanError(f"an inferer's name is needed: {kind!r}")
    try:
        return Inferer(kind.strip().lower())
    except ValueError:
        raise PlanError(f"no inferer {kind!r}: {', '.join(x.value for x in Inferer)}") from None


@dataclass(frozen=True)
class Windows:
    """How a model meets a volume: whole, or in windows that slide.

    batch: windows at once where windows are spread over tasks (``tiling``); a model of one volume gets one at a time."""

    kind: Inferer = Inferer.SIMPLE
    roi: tuple[int, ...] | None = None
    overlap: float | tuple[float, ...] = 0.25
    batch: int = 4
    gaussian: bool = False

    def __post_init__(self) -> None:
        each = self.overlap if isinstance(self.overlap, tuple) else (self.overlap,)
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x < 1 for x in each):
            raise PlanError(f"overlap must be in [0, 1): {self.overlap!r}")
        if not isinstance(self.batch, int) or isinstance(self.batch, bool) or self.batch < 0:
            raise PlanError(f"a batch of windows is a whole number from 0 on: {self.batch!r}")
        if self.kind is Inferer.SLIDING_WINDOW and not self.roi:
            raise PlanError("sliding windows need a size")

    @property
    def tiling(self) -> Tiling:
        """The same windows for chunked volumes."""
        return Tiling(self.roi or (0, 0, 0), self.overlap, max(1, self.batch), self.gaussian)


@dataclass(frozen=True)
class Names:
    """What the items of a configuration are called."""

    preprocessing: str = "preprocessing"
    postprocessing: str = "postprocessing"
    inferer: str = "inferer"
    configs: tuple[str, ...] = ("inference",)

    def __post_init__(self) -> None:
        if isinstance(self.configs, str):
            object.__setattr__(self, "configs", (self.configs,))
        if not self.configs:
            raise PlanError("a configuration's name is needed")


def _axes_first(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 4 else a[None]


def _each(f: Callable[..., np.ndarray]) -> Callable[..., None]:
    """A step that changes each key's array by itself."""

    def run(item: dict, keys: list[str], **options) -> None:
        for k in keys:
            item[k] = f(item[k], **options)

    run.options = set(list(inspect.signature(f).parameters)[1:])
    return run


def _scaled(a: np.ndarray, a_min: float, a_max: float, b_min: float = 0.0, b_max: float = 1.0, clip: bool = False) -> np.ndarray:
    out = (a - a_min) / (a_max - a_min) * (b_max - b_min) + b_min
    return np.clip(out, b_min, b_max) if clip else out


def _normalized(a: np.ndarray, nonzero: bool = False, channel_wise: bool = False) -> np.ndarray:
    out = a.astype(float)
    for part in out if channel_wise else [out]:
        on = part != 0 if nonzero else np.ones(part.shape, bool)
        if on.any():
            sd = part[on].std()
            part[on] = (part[on] - part[on].mean()) / (sd or 1.0)
    return out


def _activated(a: np.ndarray, softmax: bool = False, sigmoid: bool = False) -> np.ndarray:
    if sigmoid:
        a = 1 / (1 + np.exp(-a))
    if softmax:
        e = np.exp(a - a.max(0, keepdims=True))
        a = e / e.sum(0, keepdims=True)
    return a


def _discrete(a: np.ndarray, argmax: bool = False, threshold: float | None = None) -> np.ndarray:
    a = a.argmax(0)[None] if argmax else a
    return (a >= threshold).astype(np.uint8) if threshold is not None else a


def _kept(a: np.ndarray, applied_labels: list[int] | int | None = None) -> np.ndarray:
    out = a.copy()
    wanted = [x for x in np.unique(a) if x] if applied_labels is None else np.atleast_1d(applied_labels)
    for label in wanted:
        for c in range(len(a)):
            out[c][(a[c] == label) & (largest_component(a[c] == label) == 0)] = 0
    return out


def _turned(item: dict, keys: list[str], axcodes: str = "RAS") -> None:
    for k in keys:
        parts = [kernels.reoriented(c, item[f"{k}_affine"], axcodes) for c in item[k]]
        item[k], item[f"{k}_affine"] = np.stack([p for p, _ in parts]), parts[0][1]


def _spaced(item: dict, keys: list[str], pixdim: list[float], mode: str | list[str] = "bilinear") -> None:
    modes = mode if isinstance(mode, list) else [mode] * len(keys)
    for k, m in zip(keys, modes):
        parts = [kernels.respaced(c, item[f"{k}_affine"], tuple(pixdim), m == "nearest") for c in item[k]]
        item[k], item[f"{k}_affine"] = np.stack([p for p, _ in parts]), parts[0][1]


def _cropped(item: dict, keys: list[str], source_key: str, margin: int = 0) -> None:
    on = np.argwhere((item[source_key] > 0).any(0))
    if not len(on):
        return
    low = np.maximum(on.min(0) - margin, 0)
    high = np.minimum(on.max(0) + 1 + margin, item[source_key].shape[1:])
    for k in keys:
        item[k] = item[k][(slice(None), *map(slice, low, high))]
        item[f"{k}_affine"] = item[f"{k}_affine"].copy()
        item[f"{k}_affine"][:3, 3] += item[f"{k}_affine"][:3, :3] @ low


def _inverted(item: dict, keys: list[str], orig_keys: str | list[str], nearest_interp: bool = True) -> None:
    """Brings keys from the grid that the model saw back to the one that came in."""
    for k, of in zip(keys, [orig_keys] * len(keys) if isinstance(orig_keys, str) else orig_keys):
        shape, matrix = item[f"{of}_first"]
        item[k] = np.stack([kernels.sampled(c, item[f"{of}_affine"], shape, matrix, nearest_interp) for c in item[k]])
        item[f"{k}_affine"] = matrix


#: The steps that the engine knows, by name without the ending of keyed ones.
STEPS: dict[str, Callable[..., None]] = {
    "EnsureChannelFirst": _each(lambda a, channel_dim=None: _axes_first(a)),
    "EnsureType": _each(lambda a, data_type=None: a),
    "CastToType": _each(lambda a, dtype="float32": a.astype(np.dtype(dtype))),
    "Orientation": _turned,
    "Spacing": _spaced,
    "ScaleIntensityRange": _each(_scaled),
    "ScaleIntensity": _each(lambda a, minv=0.0, maxv=1.0: minv + (a - a.min()) / (np.ptp(a) or 1.0) * (maxv - minv)),
    "NormalizeIntensity": _each(_normalized),
    "CropForeground": _cropped,
    "Activations": _each(_activated),
    "AsDiscrete": _each(_discrete),
    "KeepLargestConnectedComponent": _each(_kept),
    "Invert": _inverted,
}


def _resolved(value: object, config: dict) -> object:
    """@name and @group::name looked up; expressions are refused, as they would run what a file says."""
    if isinstance(value, str) and value.startswith("@"):
        found: object = config
        for part in value[1:].split("::"):
            if isinstance(found, list):
                found = found[int(part)]
            elif isinstance(found, dict) and part in found:
                found = found[part]
            else:
                raise PlanError(f"{value!r} names nothing")
        return _resolved(found, config)
    if isinstance(value, str) and value.startswith("$"):
        raise UnsupportedError(f"expressions aren't run: {value!r}")
    if isinstance(value, list):
        return [_resolved(x, config) for x in value]
    if isinstance(value, dict):
        return {k: _resolved(v, config) for k, v in value.items()}
    return value


def steps_of(item: dict | list | None, config: dict, without: tuple[str, ...] = FILE_STEPS) -> list[tuple[str, list[str], dict]]:
    """(step, keys, options) of a configuration's item, those that read or write files left out."""
    listed = item.get("transforms", []) if isinstance(item, dict) else item or []
    out = []
    for t in (_resolved(x, config) if isinstance(x, str) else x for x in listed):
        name = str(t["_target_"]).rsplit(".", 1)[-1]
        if any(x in name for x in without) or t.get("_disabled_") is True:
            continue
        plain = name.removesuffix("d") if name not in STEPS else name
        if plain not in STEPS:
            raise UnsupportedError(f"no step {name!r}")
        options = _resolved({k: v for k, v in t.items() if not k.startswith("_") and k not in ("meta_keys", "device", "transform", "allow_missing_keys")}, config)
        keys = options.pop("keys", None)
        if keys is None:
            raise UnsupportedError(f"{name} has no keys: only keyed steps are run")
        known = getattr(STEPS[plain], "options", None) or set(list(inspect.signature(STEPS[plain]).parameters)[2:])
        if unknown := set(options) - known:
            raise UnsupportedError(f"{name} has no option {', '.join(sorted(unknown))}")
        out.append((plain, [keys] if isinstance(keys, str) else list(keys), options))
    return out


@dataclass(frozen=True)
class Bundle:
    before: list[tuple[str, list[str], dict]]
    after: list[tuple[str, list[str], dict]]
    windows: Windows
    inputs: dict[str, dict]
    outputs: dict[str, dict]
    names: Names = field(default_factory=Names)


def bundle_of(texts: dict[str, str], meta: str | dict | None = None, names: Names = Names()) -> Bundle:
    """A bundle from its configurations' texts by name; later ones count before earlier ones."""
    config: dict = {}
    for name in names.configs:
        if name not in texts:
            raise PlanError(f"no configuration {name!r}")
        config |= json.loads(texts[name])
    described = meta if isinstance(meta, dict) else json.loads(meta) if meta else config.get("_meta_", {})
    form = described.get("network_data_format", {})
    own = _resolved(config.get(names.inferer) or {"_target_": "SimpleInferer"}, config)
    kind = str(own.get("_target_", "")).rsplit(".", 1)[-1]
    if kind not in ("SimpleInferer", "SlidingWindowInferer"):
        raise UnsupportedError(f"no inferer {kind!r}")
    windows = Windows() if kind == "SimpleInferer" else _windows(own)
    inputs, outputs = form.get("inputs") or {"image": {}}, form.get("outputs") or {"pred": {}}
    if len(inputs) > 1 or len(outputs) > 1:
        raise UnsupportedError(f"one input and one output are run, not {', '.join(inputs)} to {', '.join(outputs)}")
    return Bundle(steps_of(config.get(names.preprocessing), config), steps_of(config.get(names.postprocessing), config), windows, inputs, outputs, names)


#: What a configuration says of windows; devices and progress bars change no result.
_WINDOW_OPTIONS = {"roi_size", "overlap", "sw_batch_size", "mode", "device", "sw_device", "progress", "cache_roi_weight_map", "padding_mode"}


def _windows(own: dict) -> Windows:
    """Sliding windows of a configuration; what isn't done is refused."""
    if unknown := {k for k in own if not k.startswith("_")} - _WINDOW_OPTIONS:
        raise UnsupportedError(f"windows have no option {', '.join(sorted(unknown))}")
    overlap, mode = own.get("overlap", 0.25), str(own.get("mode", "constant")).lower()
    if mode not in ("constant", "gaussian") or own.get("padding_mode", "constant") != "constant":
        raise UnsupportedError(f"no windows of mode {mode!r}, padded by {own.get('padding_mode', 'constant')!r}")
    roi = own.get("roi_size")
    if not isinstance(roi, (list, tuple)) or len(roi) != 3:
        raise PlanError(f"windows need three sizes: {roi!r}")
    return Windows(Inferer.SLIDING_WINDOW, tuple(roi), tuple(overlap) if isinstance(overlap, list) else overlap, own.get("sw_batch_size", 1), mode == "gaussian")


def applied(volume: np.ndarray, matrix: np.ndarray, bundle: Bundle, model: Model) -> np.ndarray:
    """One volume (x, y, z) through a bundle; the first output, channels first."""
    key, out = next(iter(bundle.inputs)), next(iter(bundle.outputs))
    item: dict = {key: _axes_first(np.asarray(volume)), f"{key}_affine": np.asarray(matrix, float)}
    item[f"{key}_first"] = (item[key].shape[1:], item[f"{key}_affine"])
    wanted = bundle.inputs[key].get("num_channels")
    for name, keys, options in bundle.before:
        STEPS[name](item, keys, **options)
    if wanted is not None and len(item[key]) != wanted:
        raise PlanError(f"{key} has {len(item[key])} channels, the model takes {wanted}")
    w = bundle.windows
    if w.kind is Inferer.SIMPLE:
        scores = np.asarray(model(item[key]))
    else:
        if len(item[key]) != 1:
            raise UnsupportedError("windows slide over one channel")
        roi = tuple(n if r <= 0 else r for r, n in zip(w.roi, item[key].shape[1:]))
        scores = tiled(item[key][0], lambda x: np.asarray(model(x[None])), roi, w.overlap, w.gaussian)
    item[out] = scores
    for name, keys, options in bundle.after:
        STEPS[name](item, [k for k in keys if k in item], **options)
    return item[out]


def inferred(packed: DataFrame, bundle: Bundle, load: Callable[[], Model]) -> DataFrame:
    """packed volumes (shape, dtype, data, affine) with the bundle's first output in their place: labels if it has one channel.

    The model is loaded once for each task. A volume without an affine lies on the unit grid. Volumes of float64 stay in
    double precision, others are brought to float32."""
    columns = [c for c in packed.columns if c != "tags"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in rows_by_bytes(batches, "data"):
            made = []
            for s, t, d, m in zip(pdf["shape"], pdf["dtype"], pdf["data"], pdf["affine"]):
                v = unpacked(list(s), t, d).astype(np.float64 if t == "float64" else np.float32).transpose(2, 1, 0)  # stored as z, y, x
                got = applied(v, np.eye(4) if m is None else np.array([list(r) for r in m]), bundle, model)
                got = got[0] if len(got) == 1 else got
                got = got.transpose(*range(got.ndim - 3), got.ndim - 1, got.ndim - 2, got.ndim - 3)
                kind = np.uint8 if np.issubdtype(got.dtype, np.integer) else np.float32
                made.append((list(got.shape), np.dtype(kind).name, np.ascontiguousarray(got, kind).tobytes()))
            yield pdf.assign(**dict(zip(("shape", "dtype", "data"), map(list, zip(*made)))))

    out = packed.select(*columns).mapInPandas(run, packed.select(*columns).schema)
    keys = [c for c in ("study_uid", "series_uid") if c in columns]
    return out.join(packed.select(*keys, "tags"), keys) if "tags" in packed.columns and keys else out


def listed(config: str) -> list[str]:
    """The names of a configuration's steps, those that are left out included; for reports."""
    spec = json.loads(config)
    return [str(t["_target_"]).rsplit(".", 1)[-1] for part in ("preprocessing", "postprocessing") for t in (spec.get(part) or {}).get("transforms", [])]


def configs_of(found: DataFrame) -> dict[str, str]:
    """{name: text} of one bundle's configurations, as ``sources.models.configs`` gives them."""
    rows = found.select("path", "name", "config").collect()  # a bundle has a handful
    if len({r.path for r in rows}) > 1:
        raise PlanError("configurations of more than one bundle")
    return {r.name: r.config for r in rows}


def channel_first(input_type: Column | str, task: Column | str, override: Column | None = None) -> Column:
    """Whether pictures reach the model channels first: as the configuration says, else all but pictures of tasks that don't classify."""
    kind, what = F.lower(F.col(input_type) if isinstance(input_type, str) else input_type), F.lower(F.col(task) if isinstance(task, str) else task)
    rule = (kind != "image") | F.contains(what, F.lit("classification"))
    return F.coalesce(F.lit(None).cast("boolean") if override is None else override, rule)
