"""What models' descriptions say, as column expressions over their JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The attributes that tell an input's dimensions, in order of trust, and how each tells them.
NUMBERS = ("spatial_dims", "spatial_ndim", "num_spatial_dims", "ndim")
SIZES = ("spatial_size", "input_shape", "size")
FORMATS = ("format", "data_format", "input_format", "model_type")
TEXTS = ("description", "model_name", "architecture", "network")
#: Signs of which one must stand beside "2d" or "3d" within a text, before or after it.
BESIDE = ("_", "-")


def _named(text: Column) -> Column:
    """2 or 3 by the first of "2d" and "3d" that the text has at all."""
    return F.when(F.contains(text, F.lit("2d")), 2).when(F.contains(text, F.lit("3d")), 3)


def _standing(text: Column) -> Column:
    """The same for words that stand by themselves or by an underscore or hyphen."""
    stands = lambda n: text.rlike(f"[{''.join(BESIDE)}]{n}d|{n}d[{''.join(BESIDE)}]| {n}d ")
    return F.when(stands(2), 2).when(stands(3), 3)


def _probe(read: Callable[[str], Column], told: Callable[[Column], Column]) -> Callable[[str], Column]:
    return lambda name: told(read(name))


def spatial_dims(meta: Column) -> Column:
    """2 or 3, as the description (JSON text of an object) of an input says; null where it doesn't say or isn't an object.

    Each place is a probe; the first that tells anything counts. Whole numbers and lists count as such only, not as text."""
    tree = F.try_parse_json(meta)
    at = lambda name: F.try_variant_get(tree, f"$.{name}", "variant")
    text = lambda name: F.lower(F.to_json(F.named_struct(F.lit("v"), at(name))).substr(F.lit(6), F.lit(1 << 30)))
    kind = lambda v: F.schema_of_variant(v)
    two_or_three = lambda n: F.when(n.isin(2, 3), n)
    said = lambda name: F.lower(F.coalesce(F.when(kind(at(name)) == "STRING", F.try_variant_get(tree, f"$.{name}", "string")), text(name)))
    plan = (
        (NUMBERS, lambda name: two_or_three(F.when(kind(at(name)) == "BIGINT", F.try_variant_get(tree, f"$.{name}", "long").cast("int")))),
        (SIZES, lambda name: two_or_three(F.size(F.try_variant_get(tree, f"$.{name}", "array<variant>")))),
        (FORMATS, _probe(said, _named)),
        ((None,), lambda _: F.get(F.filter(F.transform(F.json_object_keys(meta), lambda k: _named(F.lower(k))), lambda n: n.isNotNull()), 0)),
        (TEXTS, _probe(said, _standing)),
    )
    return F.coalesce(*[probe(name) for names, probe in plan for name in names])
