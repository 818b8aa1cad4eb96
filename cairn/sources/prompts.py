"""Prompt lists: defaults merged under what each prompt says, matched with the pictures there are."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError

#: What a prompt may override (fixed values).
PARAMETERS = {"max_new_tokens": "int", "temperature": "double", "top_p": "double"}


def read(text: str) -> dict:
    """The list's text, YAML or JSON."""
    try:
        out = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise PlanError("YAML prompts need the yaml library") from None
        out = yaml.safe_load(text)
    if not isinstance(out, dict) or not isinstance(out.get("prompts", []), list):
        raise PlanError("a prompt list has defaults and prompts")
    return out


def requests(spark: SparkSession, text: str) -> DataFrame:
    """(place, prompt, image, output_type, max_new_tokens, temperature, top_p): a list is a document that a person wrote, so it is read on the driver."""
    spec = read(text)
    defaults = spec.get("defaults") or {}
    rows = []
    for k, p in enumerate(spec.get("prompts") or []):
        merged = {n: p.get(n, defaults.get(n)) for n in PARAMETERS}
        rows.append((k, p.get("prompt"), p.get("image"), p.get("output") or "json", *[None if v is None else int(v) if n == "max_new_tokens" else float(v) for n, v in merged.items()]))
    return spark.createDataFrame(rows, "place int, prompt string, image string, output_type string, " + ", ".join(f"{n} {t}" for n, t in PARAMETERS.items()))


def with_pictures(asked: DataFrame, pictures: DataFrame) -> DataFrame:
    """The requests whose picture is among the paths, with its path and an id of their own; all others go (see without_pictures)."""
    found = pictures.select(F.element_at(F.split("path", "/"), -1).alias("image"), "path").groupBy("image").agg(F.min("path").alias("path"))
    return asked.join(found, "image").withColumn("request_id", F.sha2(F.concat_ws("\0", F.col("place").cast("string"), "prompt", "image"), 256))


def without_pictures(asked: DataFrame, pictures: DataFrame) -> DataFrame:
    return asked.join(pictures.select(F.element_at(F.split("path", "/"), -1).alias("image")), "image", "left_anti")
