"""Checks of rows and groups as columns: what is refused is told apart by reason, and counted, before any worker starts.

A check is a reason and a condition under which a row is refused; a row has the first reason that holds, or none. Null
conditions don't refuse. Refused rows can be dropped, counted by an Observation while the plan runs, or raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Checks = dict[str, Column]

#: Bytes of a pixel by its type; the types that slices may have.
PIXEL_BYTES = {"uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4}


def reason_of(checks: Checks) -> Column:
    """The first reason whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for reason, refuses in reversed(checks.items()):
        out = F.when(F.coalesce(refuses, F.lit(False)), reason).otherwise(out)
    return out


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether two arrays of numbers have one size and agree place by place; null and null agree."""
    each = F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.coalesce(F.abs(x["a"] - x["b"]) <= absolute + relative * F.abs(x["b"]), F.lit(False)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & each)


def slice_checks() -> Checks:
    """What a slice must have by itself to be part of a volume."""
    numbers = lambda c, n: F.col(c).isNull() | (F.size(c) != n) | F.exists(c, lambda x: x.isNull() | F.isnan(x))
    width = F.try_element_at(F.create_map(*[F.lit(x) for kv in PIXEL_BYTES.items() for x in kv]), F.col("dtype"))
    return {
        "no position": numbers("position", 3), "no orientation": numbers("orientation", 6), "no pixels": F.col("pixels").isNull(),
        "unknown type": F.col("dtype").isNull() | ~F.col("dtype").isin(*PIXEL_BYTES), "no size": F.coalesce(F.col("rows") * F.col("cols"), F.lit(0)) <= 0,
        "too few pixels": F.length("pixels") < F.col("rows").cast("long") * F.col("cols") * width,
    }


def against_first(rows: DataFrame, keys: list[str], order: Column, sizes: list[str], grids: list[str]) -> DataFrame:
    """rows, of which those without a reason yet are compared with their group's first such row: another size, type or grid.

    rows has a column reason. sizes must be equal, grids (arrays of numbers) close. One aggregate by group and a join."""
    first = rows.where("reason IS NULL").groupBy(*keys).agg(F.min_by(F.struct(*sizes, *grids), order).alias("first_"))
    both = rows.join(first, keys, "left")
    checks = {f"another {c}": ~F.col(c).eqNullSafe(F.col(f"first_.{c}")) for c in sizes} | {f"another {c}": ~close(F.col(c), F.col(f"first_.{c}"), absolute=1e-3) for c in grids}
    return both.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("first_").isNotNull(), reason_of(checks))).select(*rows.columns)


def counted(rows: DataFrame, reasons: list[str], name: str | None = None) -> tuple[DataFrame, Observation]:
    """rows as they are, and an Observation: after an action its ``get`` has rows seen, refused, and each reason's number."""
    watch = Observation(name) if name else Observation()
    each = [F.count_if(F.col("reason") == r).alias(r) for r in reasons]
    return rows.observe(watch, F.count("*").alias("seen"), F.count("reason").alias("refused"), *each), watch


def passed(rows: DataFrame) -> DataFrame:
    """The rows without a reason, and no column of it."""
    return rows.where("reason IS NULL").drop("reason")


def required(rows: DataFrame, what: Column) -> DataFrame:
    """As ``passed`` where no row is refused; the first refused row that a task meets raises, with ``what`` and its reason."""
    told = F.raise_error(F.concat(F.coalesce(what.cast("string"), F.lit("a row")), F.lit(": "), F.col("reason")))
    return rows.where(F.when(F.col("reason").isNull(), True).otherwise(told.cast("boolean"))).drop("reason")


def coerced(tags: Column, kinds: dict[str, str]) -> tuple[list[Column], Checks]:
    """Columns of a map of texts in the given types, null where the text can't be that; and checks that tell which couldn't."""
    read = {k: tags[k].try_cast(kind) if kind != "string" else tags[k] for k, kind in kinds.items()}
    return [v.alias(k) for k, v in read.items()], {f"{k} is no {kinds[k]}": tags[k].isNotNull() & (F.trim(tags[k]) != "") & v.isNull() for k, v in read.items()}


def checked_slices(instances: DataFrame, keys: list[str]) -> DataFrame:
    """instances with reason: why a slice can't be in its series' volume. Catalyst alone finds it; pixels aren't opened."""
    own = instances.withColumn("reason", reason_of(slice_checks()))
    return against_first(own, keys, F.struct("path", "sop_uid"), ["rows", "cols"], ["orientation"])


#: All reasons of ``checked_slices``.
SLICE_REASONS = [*("no position", "no orientation", "no pixels", "unknown type", "no size", "too few pixels"), "another rows", "another cols", "another orientation"]
