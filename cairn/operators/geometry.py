"""Vectors, planes and affines of ordered slices, as expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The eight codes of how a patient lies (fixed values).
POSITIONS = ("HFP", "HFS", "HFDR", "HFDL", "FFDR", "FFDL", "FFP", "FFS")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a divided by its length; null elements for a zero vector."""
    return F.transform(a, lambda x: F.try_divide(x, norm(a)))


def cross(a: Column, b: Column) -> Column:
    at = lambda v, i: F.get(v, F.lit(i)).cast("double")
    return F.array(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def argmax(a: Column) -> Column:
    """Place of the (first) largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def normal(orientation: Column) -> Column:
    """Row direction times column direction."""
    return cross(F.slice(orientation, 1, 3), F.slice(orientation, 4, 3))


def plane(orientation: Column, position: Column | None = None) -> Column:
    """Sagittal, Coronal or Axial by the normal's largest component; an unknown patient position raises when met."""
    names = F.array(F.lit("Sagittal"), F.lit("Coronal"), F.lit("Axial"))
    out = F.when(F.size(orientation) == 6, F.get(names, argmax(F.transform(normal(orientation), F.abs))))
    if position is None:
        return out
    return F.when(position.isNull() | position.isin(*POSITIONS), out).otherwise(F.raise_error(F.concat(F.lit("unknown patient position: "), position)))


def det3(m: Column) -> Column:
    e = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    return e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))


def matmul4(a: Column, b: Column) -> Column:
    e = lambda m, i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    return F.array(*[F.array(*[sum((e(a, i, k) * e(b, k, j) for k in range(1, 4)), e(a, i, 0) * e(b, 0, j)) for j in range(4)]) for i in range(4)])


def affine(orientation: Column, row_spacing: Column, col_spacing: Column, first: Column, last: Column, n: Column, ras: bool = False) -> Column:
    """4 x 4 matrix from indices to patient space; null for fewer than two slices. ras negates the first two rows."""
    rows = []
    for i in range(3):
        sign = -1.0 if ras and i < 2 else 1.0
        step = F.try_divide(F.get(last, F.lit(i)) - F.get(first, F.lit(i)), n - 1)
        parts = (F.get(orientation, F.lit(i)) * row_spacing, F.get(orientation, F.lit(i + 3)) * col_spacing, step, F.get(first, F.lit(i)))
        rows.append(F.array(*[x.cast("double") * sign for x in parts]))
    bottom = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    return F.when(n > 1, F.array(*rows, bottom))


def spacing_of(m: Column) -> Column:
    """Lengths of the affine's first three columns."""
    return F.array(*[F.sqrt(sum((F.pow(F.get(F.get(m, F.lit(i)), F.lit(j)), 2) for i in range(1, 3)), F.pow(F.get(F.get(m, F.lit(0)), F.lit(j)), 2))) for j in range(3)])


def directions_of(m: Column) -> Column:
    """Unit columns of the affine, rounded to 6 places."""
    s = spacing_of(m)
    return F.array(*[F.array(*[F.round(F.try_divide(F.get(F.get(m, F.lit(i)), F.lit(j)), F.get(s, F.lit(j))), 6) for i in range(3)]) for j in range(3)])


def axis_order(m: Column) -> Column:
    """(permutation, flips): for each patient axis the index axis that moves most along it, and whether it runs backwards."""
    rows = [F.slice(F.get(m, F.lit(i)), 1, 3) for i in range(3)]
    perm = [argmax(F.transform(r, F.abs)) for r in rows]
    return F.struct(F.array(*perm).alias("permutation"), F.array(*[F.get(r, p) < 0 for r, p in zip(rows, perm)]).alias("flips"))


def ordered_slices(instances: DataFrame, series: list[str], seq: str, orientation: str = "orientation", position: str = "position") -> DataFrame:
    """instances with z (place along the normal), distance, depth_spacing (first gap) and n_slices; rows that lack orientation or position go."""
    d = dot(normal(F.col(orientation)), F.transform(position, lambda x: x.cast("double")))
    kept = instances.where(F.col(orientation).isNotNull() & F.col(position).isNotNull()).withColumn("distance", d)
    w = Window.partitionBy(*series).orderBy("distance", seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = kept.withColumns({"z": (F.row_number().over(w) - 1).cast("int"), "n_slices": F.count("*").over(whole), "d0": F.nth_value("distance", 1).over(whole), "d1": F.nth_value("distance", 2).over(whole)})
    return placed.withColumn("depth_spacing", F.coalesce(F.col("d1") - F.col("d0"), F.lit(1.0))).drop("d0", "d1")
