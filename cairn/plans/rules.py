"""JSON selection rules compiled to one Catalyst column each.

``{"selections": [{"name": ..., "conditions": {attribute: test}}]}``. Within a selection all conditions must hold; a
row may satisfy several selections. Tests by the attribute's type:

- text: equal without regard to case, or else a regular expression found anywhere in it, also without regard to case;
- number: a number (equal), ``[value, op]`` with op one of > >= < <= !=, ``[low, high]`` (inclusive), or a pattern
  that the number's text matches in full;
- list of texts: a term or a list of terms that the list's text contains, ``!term`` for terms it must not contain;
- orientation (an array of six numbers under that name): axial, coronal or sagittal; where rows have a patient position,
  an unknown one raises when the test is met.

Attributes that aren't columns are looked up in a map of tags, where the standard's representation tells numbers from
texts and brackets tell lists. The tests of a selection are asked in their order. A missing, empty or zero attribute never matches; an empty test is no condition. What doesn't fit raises while the plan
is built, before any job.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleError, UnsupportedError
from ..operators.geometry import POSITIONS, plane
from ..sources.dicom_format import NUMERIC, TAG_OF

OPERATORS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "!=": "__ne__"}
ORIENTATION = "ImageOrientationPatient"
ORIENTATIONS = frozenset({ORIENTATION.lower(), "orientation"})


def parsed(rules: str | dict | None) -> list[tuple[str, dict]] | None:
    """(name, conditions) of each selection that has conditions; None where there are no rules at all."""
    if isinstance(rules, str):
        rules = json.loads(rules) if rules.strip() else None
    if not rules:
        return None
    if not isinstance(rules, dict) or not isinstance(rules.get("selections"), list):
        raise RuleError('rules need a list under "selections"')
    out = []
    for k, s in enumerate(rules["selections"]):
        conditions = {a: t for a, t in (s.get("conditions") or {}).items() if t not in (None, "", 0, [])}
        if s.get("conditions"):
            out.append((str(s.get("name") or f"selection_{k}"), conditions))
    return out


def _number(test: object) -> float:
    try:
        return float(test)  # type: ignore[arg-type]
    except (TypeError, ValueError) as e:
        raise RuleError(f"not a number: {test!r}") from e


def text_test(c: Column, test: object) -> Column:
    if not isinstance(test, str):
        raise RuleError(f"a text attribute can't be tested by {test!r}")
    return (c != "") & ((F.lower(c) == test.lower()) | c.rlike(f"(?i){test}"))


def number_test(c: Column, test: object, text: Column | None = None) -> Column:
    present = c != 0
    if isinstance(test, list):
        if len(test) != 2:
            raise RuleError(f"two values are needed: {test!r}")
        if isinstance(test[1], str):
            if test[1] not in OPERATORS:
                raise UnsupportedError(f"no such operator: {test[1]!r}")
            return present & getattr(c, OPERATORS[test[1]])(F.lit(_number(test[0])))
        return present & c.between(_number(test[0]), _number(test[1]))
    if isinstance(test, str):
        return present & (c.cast("string") if text is None else text).rlike(rf"\A(?:{test})\z")
    return present & (c == F.lit(_number(test)))


def terms_test(c: Column, test: object) -> Column:
    if isinstance(test, str):
        test = [test]
    if not isinstance(test, list) or not all(isinstance(t, str) for t in test):
        raise RuleError(f"terms are needed: {test!r}")
    shown = F.lower(F.array_join(c, ", "))
    found = [~F.contains(shown, F.lit(t[1:].lower())) if t.startswith("!") else F.contains(shown, F.lit(t.lower())) for t in test]
    return reduce(lambda a, b: a & b, found, F.size(c) > 0)


def tag_test(tags: Column, attribute: str, test: object) -> Column:
    """The test of an attribute of instance files, as its own representation tells: a list of texts, a number or a text."""
    raw = F.element_at(tags, F.lit(attribute))
    several = F.startswith(raw, F.lit("["))
    tests = test if isinstance(test, list) else [test]
    shown = F.lower(raw)
    found = [~F.contains(shown, F.lit(str(t)[1:].lower())) if str(t).startswith("!") else F.contains(shown, F.lit(str(t).lower())) for t in tests]
    terms = reduce(lambda a, b: a & b, found, F.lit(True))
    if TAG_OF.get(attribute, (0, ""))[1] in NUMERIC:
        one = number_test(raw.try_cast("double"), test, raw)
    elif isinstance(test, str):
        one = text_test(raw, test)
    else:
        one = F.lit(False)  # a single text is never tested by a list or a number
    return F.when(several, terms).otherwise(one)


def condition(df: DataFrame, attribute: str, test: object) -> Column:
    """The test as a column that is never null. Attributes that aren't columns are looked up in a tags map."""
    by_name = {f.name.lower(): f for f in df.schema}
    own = by_name.get("orientation" if attribute == ORIENTATION and ORIENTATION.lower() not in by_name else attribute.lower())
    if own is None:
        if "tags" not in by_name:
            raise RuleError(f"no attribute {attribute!r}")
        return F.coalesce(tag_test(F.col("tags"), attribute, test), F.lit(False))
    f, c = own, F.col(f"`{own.name}`")
    raw = F.element_at("tags", F.lit(attribute)) if "tags" in by_name and attribute.lower() in by_name else None
    if attribute.lower() in ORIENTATIONS and isinstance(f.dataType, T.ArrayType):
        if not isinstance(test, str):
            raise RuleError(f"an orientation is needed: {test!r}")
        out = plane(c) == test.strip().capitalize()
        if "patientposition" in by_name:
            lies = F.col(f"`{by_name['patientposition'].name}`")
            why = F.concat(F.lit("an orientation needs a known patient position, not "), F.coalesce(lies, F.lit("none")))
            out = F.when(c.isNull(), F.lit(False)).when(lies.isin(*POSITIONS), out).otherwise(F.raise_error(why))
    elif isinstance(f.dataType, T.StringType):
        out = text_test(c, test)
    elif isinstance(f.dataType, T.NumericType):
        out = number_test(c, test, None if raw is None else F.coalesce(raw, c.cast("string")))
    elif isinstance(f.dataType, T.ArrayType):
        out = terms_test(F.transform(c, lambda x: x.cast("string")), test)
    else:
        raise RuleError(f"attribute {attribute!r} has type {f.dataType.simpleString()}, which rules can't test")
    return F.coalesce(out, F.lit(False))


def _all(tests: list[Column]) -> Column:
    """Whether all hold, asked in their order: a later test, which may raise, is asked only where those before it hold."""
    return reduce(lambda after, t: F.when(t, after).otherwise(F.lit(False)), reversed(tests), F.lit(True))


def compiled(df: DataFrame, rules: str | dict) -> list[tuple[str, Column]]:
    """(name, column that says whether a row matches) of each selection."""
    return [(name, _all([condition(df, a, t) for a, t in tests.items()])) for name, tests in parsed(rules) or []]


def select_series(series: DataFrame, rules: str | dict | None, study: list[str], order: list[str], default_name: Column | None = None, all_matched: bool = False, count: str | None = None, keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """series with selection_name and match_rank: for each study and selection the first match by order, or all.

    With all matches and a count column, they are ranked by descending count. Without rules every row is selected under
    default_name. One pass over series; the rank is a window by study and selection. keep: a test of the caller's own, asked first."""
    if keep:
        series = series.where(F.coalesce(keep(series), F.lit(False)))
    found = parsed(rules)
    if found is None:
        named = series.withColumn("selection_name", F.lit("all") if default_name is None else default_name)
        all_matched = True
    else:
        hits = [F.when(c, F.lit(n)) for n, c in compiled(series, rules)]
        if not hits:
            return series.limit(0).withColumns({"selection_name": F.lit(""), "match_rank": F.lit(0)})
        any_hit = reduce(lambda a, b: a | b, [h.isNotNull() for h in hits])
        named = series.where(any_hit).withColumn("selection_name", F.explode(F.array_compact(F.array(*hits))))
    by = ([F.desc(count)] if all_matched and count else []) + [F.col(c) for c in order]
    ranked = named.withColumn("match_rank", F.row_number().over(Window.partitionBy(*study, "selection_name").orderBy(*by)))
    return ranked if all_matched else ranked.where("match_rank = 1")
