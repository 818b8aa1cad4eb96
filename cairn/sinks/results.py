"""Predictions and answers as JSON rows, routed to files by kind."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of four classes, and what a result of each kind becomes (fixed values).
LETTERS = ("A", "B", "C", "D")
SUFFIX = {"json": ".json", "image": ".png", "image_overlay": "_overlay.png"}


def best_class(probs: Column, names: tuple[str, ...] | None = None) -> Column:
    """(predicted_class, confidence): the first largest probability; classes without a name are called class_<k>."""
    top = F.array_max(probs)
    k = F.array_position(probs, top).cast("int") - 1
    table = F.array(*[F.lit(x) for x in (names or ())]) if names else F.when(F.size(probs) == len(LETTERS), F.array(*[F.lit(x) for x in LETTERS])).otherwise(F.array().cast("array<string>"))
    return F.struct(F.coalesce(F.get(table, k), F.concat(F.lit("class_"), k.cast("string"))).alias("predicted_class"), top.alias("confidence"))


def json_results(rows: DataFrame, filename: str, probs: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(name, content): <filename>_results.json with the probabilities, the best class and its probability.

    Rows without a filename are named by their content's digest; null or empty probabilities give a null class."""
    shaped = F.to_json(F.struct(F.col(filename).alias("filename"), F.col(probs).alias("probabilities"), best_class(F.col(probs), names).alias("prediction")))
    named = F.coalesce(F.nullif(F.col(filename), F.lit("")), F.substring(F.sha2(shaped, 256), 1, 16))
    return rows.select(F.concat(named, F.lit("_results.json")).alias("name"), shaped.cast("binary").alias("content"))


def routed(rows: DataFrame, request_id: str = "request_id", output_type: str = "output_type", text: str = "text", picture: str = "picture", error: str = "error") -> DataFrame:
    """(name, content): JSON, picture or overlay of each answer by its kind; unknown kinds are JSON, errors and pictures that lack go to <id>_error.json."""
    kind = F.when(F.col(output_type).isin(*SUFFIX), F.col(output_type)).otherwise("json")
    is_picture = kind != "json"
    failed = F.col(error).isNotNull() | (is_picture & F.col(picture).isNull())
    reason = F.to_json(F.struct(F.col(request_id).alias("request_id"), F.coalesce(F.col(error), F.lit("no picture")).alias("error"))).cast("binary")
    answer = F.to_json(F.struct(F.col(request_id).alias("request_id"), F.col(text).alias("response"))).cast("binary")
    suffix = F.when(failed, "_error.json")
    for k, s in SUFFIX.items():
        suffix = suffix.when(kind == k, s)
    return rows.select(F.concat(F.col(request_id).cast("string"), suffix).alias("name"), F.when(failed, reason).when(is_picture, F.col(picture)).otherwise(answer).alias("content"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A text template with each {name} replaced."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def mask_and_density(files: DataFrame, path: str = "path", keys: list[str] | None = None) -> DataFrame:
    """(keys, mask, density): the first segmentation file and the first other volume file by path, of all or of each group."""
    mask, volume = F.endswith(F.col(path), F.lit("_seg.nii.gz")), F.endswith(F.col(path), F.lit(".nii.gz"))
    return files.groupBy(*(keys or [])).agg(F.min(F.when(mask, F.col(path))).alias("mask"), F.min(F.when(volume & ~mask, F.col(path))).alias("density"))


def documents(rows: DataFrame, collection: str) -> DataFrame:
    """(collection, document): each row as one JSON document, ready for an append to any document store."""
    return rows.select(F.lit(collection).alias("collection"), F.to_json(F.struct(*rows.columns)).alias("document"))


def pretty(text: str) -> str:
    return json.dumps(json.loads(text), indent=2)
