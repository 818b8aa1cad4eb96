"""Functions of names, sizes, dates and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of size units: b, then by thousands and by 1,024 from k to y.
UNITS = {"b": 1} | {f"{p}{s}": base**n for n, p in enumerate("kmgtpezy", 1) for s, base in (("b", 1000), ("i", 1024), ("ib", 1024))}


def size_bytes(text: Column) -> Column:
    """Bytes of a size such as "2 KiB", as decimal(38, 0), parts of a byte cut off.

    What stands before the trailing letters must be a plain number without sign, exponent or needless zeros in front; the
    letters must be a unit (none: bytes). Null for anything else. Exact to 22 whole digits and six places."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    number = F.regexp_replace(trimmed, r"\s*[A-Za-z]*$", "")
    unit = F.lower(F.regexp_extract(trimmed, r"[A-Za-z]*$", 0))
    whole, places = F.substring_index(number, ".", 1), F.split(number, r"\.")
    digits = F.forall(places, lambda x: x.rlike("^[0-9]+$")) & (F.size(places) <= 2)
    plain = digits & ((F.length(whole) == 1) | ~F.startswith(whole, F.lit("0")))
    table = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(str(v)))])
    factor = F.try_element_at(table, F.when(unit == "", F.lit("b")).otherwise(unit)).cast("decimal(25,0)")
    return F.when(plain, F.floor(number.try_cast("decimal(28,6)") * factor).cast("decimal(38,0)"))


def size_text(size: Column, unit: str) -> Column:
    """Size in a unit with one place, cut not rounded; no place when it is whole. In bytes the number alone."""
    if unit.lower() == "b":
        return size.cast("decimal(38,0)").cast("string")
    tenths = F.floor(size.cast("decimal(28,0)") * 10 / F.lit(str(UNITS[unit.lower()])).cast("decimal(25,0)")).cast("decimal(38,0)")
    whole = F.floor(tenths / 10)
    return F.concat(whole.cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("int").cast("string"))).otherwise(F.lit("")), F.lit(unit))


def timestamp_name(prefix: str, at: Column, suffix: str = "") -> Column:
    """A file name for a time: <prefix>20240131_235959<suffix>."""
    return F.concat(F.lit(prefix), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(suffix))


def digits_of(key: Column, n: int) -> Column:
    """A number of n digits (1 to 32) as text, never with a leading zero, made of a key: the same after a task runs again."""
    if not 1 <= n <= 32:
        raise ValueError(f"1 to 32 digits: {n}")
    deals = [F.pmod(F.xxhash64(key.cast("string"), F.lit(k)), F.lit(9 if k == 0 else 10)) + (1 if k == 0 else 0) for k in range(n)]
    return F.concat(*[d.cast("string") for d in deals])


def extensions_of(names: Column, known: tuple[str, ...]) -> Column:
    """The known extensions that the file names end with, in order of first meeting, each once."""
    each = F.transform(names, lambda n: F.filter(F.array(*[F.lit(e) for e in known]), lambda e: F.endswith(n, e)))
    return F.array_distinct(F.flatten(each))


def answer_of(prompt: Column, answers: dict[str, str], other: Column) -> Column:
    """The answer of the first phrase that the prompt contains, case aside, in the table's order."""
    out = other
    for phrase, answer in reversed(answers.items()):
        out = F.when(F.contains(F.lower(prompt), F.lit(phrase.lower())), F.lit(answer)).otherwise(out)
    return out


def percent(share: Column, places: int = 2) -> Column:
    """0.1234 as 12.34%."""
    return F.format_string(f"%.{places}f%%", share.cast("double") * 100)


def padded(n: Column, width: int) -> Column:
    """A whole number with zeros in front."""
    return F.format_string(f"%0{width}d", n.cast("long"))


def identifier(name: Column) -> Column:
    """Letters, digits and underscores; no underscores at the ends; never begins with a digit; never empty."""
    s = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), "^_+|_+$", "")
    return F.when(s == "", "app").when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def title_name(name: Column) -> Column:
    """test_model -> TestModel, from the last part of a path."""
    return F.regexp_replace(F.initcap(F.regexp_replace(F.element_at(F.split(name, "/"), -1), "[_-]+", " ")), " ", "")


def display_name(name: Column, model_id: Column) -> Column:
    words = F.initcap(F.regexp_replace(F.element_at(F.split(model_id, "/"), -1), "[_-]+", " "))
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(words)


def valid_model_id(model_id: Column) -> Column:
    """Whether it is parts of letters, digits, underscores and hyphens, one slash between two parts."""
    return F.coalesce(F.forall(F.split(model_id, "/", -1), lambda part: part.rlike("^[A-Za-z0-9_-]+$")), F.lit(False))


def stem(filename: Column) -> Column:
    """Without the last suffix only."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def first_keyword(text: Column, table: dict[str, str], other: str) -> Column:
    """The value of the first keyword that the text contains, in the table's order."""
    out = F.lit(other)
    for k, v in reversed(table.items()):
        out = F.when(F.contains(F.lower(text), F.lit(k)), F.lit(v)).otherwise(out)
    return out


def dependency_name(spec: Column) -> Column:
    return F.regexp_extract(spec, r"^\s*([^<>=!~\s\[]+)", 1)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, words kept whole, by one pass over the words."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(a: Column, w: Column) -> Column:
        joined = F.when(a["line"] == "", w).otherwise(F.concat(a["line"], F.lit(" "), w))
        fits = F.length(joined) <= width
        done = F.when(fits | (a["line"] == ""), a["done"]).otherwise(F.array_append(a["done"], a["line"]))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(w).alias("line"))

    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.aggregate(words, zero, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.array_append(a["done"], a["line"])))


def numbers(text: Column) -> Column:
    """"[a, b]" as numbers; null for what isn't one."""
    return F.transform(F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), ","), lambda x: F.trim(x).try_cast("double"))


def report_line(name: Column, ml: Column) -> Column:
    return F.format_string("%s Volume: %d mL", F.concat(F.upper(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name))), ml)


def report_map(text: Column) -> Column:
    """Lines "key: value" as a map: keys without spaces, values trimmed; other lines are passed over, the last of a key's counts."""
    entries = F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.replace(F.substring_index(x, ":", 1), F.lit(" "), F.lit("")).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def merged(first: Column, *more: Column) -> Column:
    """Maps as one; of a key that comes again the last map's value counts, null values included. A null map counts as empty."""
    plain = lambda m: F.coalesce(m, F.create_map().cast("map<string,string>"))
    if not more:
        return plain(first)
    last = plain(more[-1])
    return F.map_concat(F.map_filter(merged(first, *more[:-1]), lambda k, v: ~F.map_contains_key(last, k)), last)
