"""Table functions for SQL: ``register(spark)`` makes them known.

cairn_detections(TABLE(anchors), keys => 'image', least => 0.1, overlap => 0.22, candidates => 1000, most => 100)
    Anchor boxes with what a detector says of them become the boxes that stay, several rows a volume.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, SkipRestOfInputTableException, udtf

#: A size grows at most by this power of e (a fixed value of such detectors).
MOST_GROWTH = math.log(1000.0 / 16)
_NEEDED = {"label": T.IntegralType, "score": T.FractionalType, "anchor": T.ArrayType, "delta": T.ArrayType}


def decoded(anchor: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """A box (lows, highs) from an anchor's (lows, highs) and its deltas: the middle's shift in sizes, the sizes' logarithms."""
    d = len(anchor) // 2
    size = anchor[d:] - anchor[:d]
    middle = anchor[:d] + size / 2 + delta[:d] * size
    half = size * np.exp(np.minimum(delta[d:], MOST_GROWTH)) / 2
    return np.concatenate([middle - half, middle + half])


def _overlap(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The shared part of box and each of boxes, of what they cover together."""
    d = len(box) // 2
    size = lambda b: np.prod(np.maximum(b[..., d:] - b[..., :d], 0), -1)
    inner = np.prod(np.maximum(np.minimum(boxes[:, d:], box[d:]) - np.maximum(boxes[:, :d], box[:d]), 0), -1)
    whole = size(boxes) + size(box) - inner
    return np.divide(inner, whole, out=np.zeros(len(boxes)), where=whole > 0)


class Detections:
    """Greedy suppression by label, as rows come in order of their scores: only boxes that stay are held, ``most`` at most."""

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, least: AnalyzeArgument = None, overlap: AnalyzeArgument = None, candidates: AnalyzeArgument = None, most: AnalyzeArgument = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument is a table: TABLE(name)")
        if not isinstance(keys.value, str) or not keys.value.strip():
            raise ValueError("keys is a text of column names, parted by commas")
        given = {f.name: f.dataType for f in table.dataType}
        names = [k.strip() for k in keys.value.split(",")]
        lacking = [k for k in [*names, *_NEEDED] if k not in given]
        odd = [k for k, kind in _NEEDED.items() if k in given and not isinstance(given[k], kind)]
        if lacking or odd:
            raise ValueError(f"columns that lack: {lacking}; of another type than they must be: {odd}")
        for name, arg, low, high in (("least", least, 0, None), ("overlap", overlap, 0, 1), ("candidates", candidates, 1, None), ("most", most, 1, None)):
            if arg is not None and (arg.value is None or arg.value < low or (high is not None and arg.value > high)):
                raise ValueError(f"{name} is out of range: {arg.value}")
        schema = T.StructType([*(T.StructField(k, given[k]) for k in names), T.StructField("rank", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("box", T.ArrayType(T.DoubleType()))])
        return AnalyzeResult(
            schema, partitionBy=[PartitioningColumn(f"`{k}`") for k in names], orderBy=[OrderingColumn("score", ascending=False), OrderingColumn("label"), OrderingColumn("anchor")],
            select=[SelectedColumn(f"`{k}`") for k in [*names, *_NEEDED]],
        )

    def __init__(self) -> None:
        self.seen, self.kept = 0, 0
        self.boxes: dict[int, list[np.ndarray]] = {}

    def eval(self, row: Row, keys: str, least: float = 0.1, overlap: float = 0.22, candidates: int = 1000, most: int = 100) -> Iterator[tuple]:
        if row["score"] is None or math.isnan(row["score"]) or row["anchor"] is None or row["delta"] is None:
            return
        if row["score"] < least or self.seen >= candidates or self.kept >= most:
            raise SkipRestOfInputTableException("no later row can stay")
        self.seen += 1
        box = decoded(np.array(row["anchor"], float), np.array(row["delta"], float))
        own = self.boxes.setdefault(row["label"], [])
        if own and (_overlap(np.array(own), box) > float(overlap)).any():
            return
        own.append(box)
        self.kept += 1
        yield (*[row[k.strip()] for k in keys.split(",")], self.kept, row["label"], float(row["score"]), box.tolist())


def register(spark: SparkSession) -> None:
    spark.udtf.register("cairn_detections", udtf(Detections))


def detections(anchors: DataFrame, keys: list[str], least: float = 0.1, overlap: float = 0.22, candidates: int = 1000, most: int = 100) -> DataFrame:
    """(keys, rank, label, score, box): anchors (keys, label, score, anchor, delta) decoded and thinned out, group by group.

    A group's rows come sorted, and reading ends when none can stay, so a hot group costs a sort and no memory. Null or NaN
    scores and null boxes are passed over; ties of the score go to the smaller label, then anchor. Groups without a box of
    ``least`` give no row."""
    rows = anchors.select(*keys, F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"), F.col("anchor").cast("array<double>").alias("anchor"), F.col("delta").cast("array<double>").alias("delta"))
    return udtf(Detections)(rows.where("score IS NOT NULL AND NOT isnan(score)").asTable(), F.lit(",".join(keys)), F.lit(float(least)), F.lit(float(overlap)), F.lit(candidates), F.lit(most))
