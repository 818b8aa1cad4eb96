"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document by one boolean expression over its words and text. On a sample, each rule's time and its
share of rejected rows are measured; the rules then stand in one CASE expression by rejections per time, so a row runs
rules only until the first that rejects it. The order changes what is computed, never the verdict. The sample is drawn
row by row from SAMPLE_FILES of the table's files (from all rows of a table that isn't read from files, or from few); it is
measured where it is read, and no text is moved. So texts are read once, but for those few files.

Defined results: a null text has no words (and fails the base rules); an empty table gives an empty result and keeps
the written order; rules of equal rank keep the written order; repeated rows are judged each by itself; a very long text
is judged whole, by sorts of its own words; columns other than the text never matter and may have any names: the filter
gives back all columns under their own names.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Rows on which rules are timed, about. The sample only sets the order.
SAMPLE_ROWS = 2000
#: Files that they are drawn from.
SAMPLE_FILES = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.concat_ws("", words)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _met_again(sorted_: Column, field: str) -> Column:
    """Of structs sorted by field, those that have a neighbour of the same value."""
    same = lambda i, x: F.coalesce(F.get(sorted_, i)[field] == x[field], F.lit(False))
    return F.filter(sorted_, lambda x, i: same(i - 1, x) | same(i + 1, x))


def n_repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, each word once. Sorts, no pairs.

    Windows are compared by hash first; where hashes meet, by their words, so a chance meeting changes nothing."""
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(again: Column) -> Column:
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"].cast("long")

    def by_words(met: Column) -> Column:
        named = F.sort_array(F.transform(met, lambda x: F.struct(F.concat_ws(" ", F.get(words, x["i"]), F.get(words, x["i"] + 1), F.get(words, x["i"] + 2)).alias("w"), x["i"].alias("i"))))
        return let(named, lambda x: covered(_met_again(x, "w")))

    return let(
        hashes,
        lambda hs: F.when(F.size(hs) == F.size(F.array_distinct(hs)), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda x: by_words(_met_again(x, "h")))
        ),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column, Column], Column]  # (text, words) -> boolean, never null


def capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}"))


#: The base rules of the contract, and the engine's own.
BASE = (
    Rule("few_words", lambda t, w: F.size(w) < 50),
    Rule("repeats", lambda t, w: 100 * n_repeat_words(w) > 50 * F.size(w)),
)
OWN = (
    Rule("symbols", lambda t, w: 10 * n_symbols(t) > F.size(w)),
    Rule("capitals", lambda t, w: 2 * capitals(t) > word_chars(w)),
    Rule("word_length", lambda t, w: (word_chars(w) < 2 * F.size(w)) | (word_chars(w) > 20 * F.size(w))),
    Rule("dup_lines", lambda t, w: let(lines_of(t), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x))),
    Rule("letterless", lambda t, w: 10 * F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))) > 3 * F.size(w)),
)


def _with_words(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs under plain names c0, c1, ..., then the text never null and its words."""
    names = docs.schema.names
    held = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return held.select("*", F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit("")).alias("t_")).select("*", words_of(F.col("t_")).alias("w_")), names


def some_files(docs: DataFrame, most: int = SAMPLE_FILES) -> DataFrame:
    """docs of some files only, by the hash of their names, where docs is a plain read of more; else docs."""
    files = docs.inputFiles()
    if len(files) <= most:
        return docs
    chosen = [posixpath.basename(f) for f in sorted(files, key=lambda f: hashlib.md5(f.encode()).digest())[:most]]
    try:
        return docs.where(F.col("_metadata.file_name").isin(*chosen, *map(unquote, chosen)))  # prunes the other files from the scan
    except AnalysisException:  # docs is more than a read, and its files can't be told apart
        return docs


def measured(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, nanoseconds a row, share rejected) on a random sample of about sample_rows rows, best rejections per time first.

    One pass: the clock is read before and after each rule within the row, and only sums leave a task."""
    docs = some_files(docs)
    n = docs.count()
    few = docs.select(text_col).sample(min(1.0, sample_rows / max(1, n)), seed=7)
    held = _with_words(few, text_col)[0]
    now = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    ticks = [now] + [x for r in rules for x in (r.rejects(F.col("t_"), F.col("w_")).cast("long"), now)]
    run = held.select(F.array(*ticks).alias("x"))  # evaluated from left to right
    spent = [F.sum(F.get("x", 2 * k + 2) - F.get("x", 2 * k)).alias(f"s{k}") for k in range(len(rules))]
    hits = [F.sum(F.get("x", 2 * k + 1)).alias(f"h{k}") for k in range(len(rules))]
    got = run.agg(F.count("*").alias("n"), *spent, *hits).first()
    if not got["n"]:
        return [(r, 1.0, 0.0) for r in rules]
    found = [(r, max(1.0, got[f"s{k}"] / got["n"]), got[f"h{k}"] / got["n"]) for k, r in enumerate(rules)]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule], text: Column, words: Column) -> Column:
    """True for rows that no rule rejects; a rule is run only if those before it don't reject."""
    out = F.when(rules[0].rejects(text, words), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.rejects(text, words), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: tuple[Rule, ...] = OWN) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    order = [r for r, _, _ in measured(docs, own, text_col)]
    held, names = _with_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    t, w = F.col("t_"), F.col("w_")
    figures = held.select(
        F.col("c0").alias(id_col), "t_", "w_",
        F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return figures.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(cascade(order, t, w)).alias("kept"))


def kept(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + OWN) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    order = [r for r, _, _ in measured(docs, rules, text_col)]
    # a filter is moved below the projection of the words, so the words are bound within the expression
    text = F.coalesce(F.col(f"c{docs.schema.names.index(text_col)}").cast("string"), F.lit(""))
    held = docs.toDF(*[f"c{i}" for i in range(len(docs.schema.names))])
    return held.where(let(words_of(text), lambda w: cascade(order, text, w))).toDF(*docs.schema.names)


#: The verdict of ``judged`` in DuckDB's SQL.
JUDGED_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
m AS (SELECT doc_id, t, w, l, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM d),
e AS (SELECT rid, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id AS rid, g FROM m)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM e),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
f AS (SELECT doc_id, t, w, l, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN c ON doc_id = rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_dup_lines > 3 * len(l) OR 10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) > 3 * n_words) AS kept
FROM b
"""
