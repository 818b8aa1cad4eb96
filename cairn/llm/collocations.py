"""Phrase collocations: counts of all short runs of words by sorted suffixes, scores by the weakest cut, longest phrases kept.

Texts are cut into pieces and words; each word begins a suffix of at most max_n words of its piece. Suffixes are shuffled
by ranges of (first word, language, further words), sorted backwards, and counted for all their prefixes with one stack:
as equal prefixes stand together, a count is whole when its prefix leaves the stack, and rare ones are let go there. Ranges
keep a first word together unless it is so frequent that its range must be cut, at its second or third word; only prefixes
at a range's two ends can then be split, and their parts are added up afterwards. So no frequent word or pair meets in one
task, whatever share of the rows it has. Equal suffixes are counted within a task before they move. Where ranges end is
taken from a sample of texts; it decides where rows go, never what is counted.

Counts of a phrase's parts are joined to it afterwards by (language, part): parts with a thousandth of all words or more
(a thousand of each length at most) by broadcast, all others by shuffle.

Defined results: a null text is empty, a null language is NO_LANG (and counts with it where it is given); empty tables give
no rows; repeated rows count each; a very long text is read whole, in steps of bounded size; ties of the score are ordered
as stated; columns other than text and language don't matter. Words are compared by their UTF-8 bytes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, discard, looked_up, slices, stored, texts_of

MAX_N, MIN_COUNT, TOP = 3, 10, 2000
#: A phrase goes where a longer one that holds it has at least this percentage of its count.
HELD_PERCENT = 50
NO_LANG = "und"
#: Parts with more than 1/HOT of all words are broadcast.
HOT = 1000
#: Suffixes that a task counts at once before it hands them on.
COUNTED = 100_000
#: Texts (about) that ranges are cut by, and of whose suffixes each so-many-th.
CUT_TEXTS, CUT_EVERY = 20_000, 29
#: Words of a piece that are taken at once.
STEP = 50_000

_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARKS = bytes(10 if x in _ENDS else 32 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece that has any. Byte 0, which parts words in keys, stands as a tab, which no word has."""
    for piece in text.translate(_MARKS).replace(b"\0", b"\t").split(b"\n"):
        words = [w for w in piece.split(b" ") if w] if b"\t" in piece else piece.split()
        if words:
            yield words


def lang_key(lang: str) -> bytes:
    return lang.replace("%", "%25").replace("\0", "%00").encode()


def suffixes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, cuts: list[str] | None = None, every: int = 1) -> DataFrame:
    """(key, n): suffixes of at most max_n words, as first word, language, further words parted by byte 0; counted in part.

    cuts: with them a column range, the number of cuts that are at most the key. every: of a task's suffixes only each
    so-many-th, for a sample."""
    ordered = [c.encode() for c in cuts or ()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        names = ["key", "n"] + ["range"] * (cuts is not None)

        def out() -> pa.RecordBatch:
            counts = Counter(held[::every])
            keys = pa.array(list(counts), pa.binary())
            columns = [keys.view(pa.string()), pa.array(counts.values(), pa.int32())]
            if cuts is not None:
                columns.append(pa.array([bisect_right(ordered, k) for k in counts], pa.int32()))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches):
            for text, lang in zip(bytes_of(batch, 0), texts_of(batch, 1)):
                own = lang_key(lang)
                for words in pieces(text):
                    for at in range(0, len(words), STEP):
                        w = words[at : at + STEP + max_n - 1]
                        whole = max(0, len(w) - max_n + 1)
                        held += map(b"\0".join, zip(w[:whole], repeat(own), *[w[k : whole + k] for k in range(1, max_n)]))
                        if at + STEP >= len(words):  # the suffixes that the piece's end cuts short
                            held += [b"\0".join((w[k], own, *w[k + 1 :])) for k in range(whole, len(w))]
                        if len(held) >= COUNTED:
                            yield out()
        if held:
            yield out()

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG))
    schema = "key string, n int" + ", range int" * (cuts is not None)
    return docs.select(F.col(text_col).cast("string"), lang.alias("lang")).mapInArrow(run, schema)


def range_cuts(docs: DataFrame, text_col: str, lang_col: str, max_n: int, ranges: int) -> list[str]:
    """Keys that part suffixes in ranges of about equal size, by a sample of texts; counts don't depend on them."""
    rows = docs.count()
    some = docs.sample(min(1.0, CUT_TEXTS / max(1, rows)), seed=7)
    keys = stored(suffixes(some, text_col, lang_col, max_n, every=CUT_EVERY).select("key"), "cuts")
    lows = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("low")).collect()  # a row a range
    discard(keys)
    return sorted(r.low for r in lows)[1:]


class Stack:
    """The prefixes of sorted suffixes that are open, each with its count so far; a batch of suffixes at a time.

    A prefix leaves the stack when a suffix comes that doesn't have it, or ends before it. Its count is whole then, unless it
    was open at the range's first or last suffix: such prefixes may go on in another range, and are handed on whatever
    their count."""

    def __init__(self, least: int):
        self.least = least
        self.open: list[bytes] = []  # first word, language, further words
        self.sums: list[int] = []  # of each depth
        self.whole: list[bool] = []
        self.words_of: Counter[bytes] = Counter()  # of each language
        self.found: list[tuple[bytes, bytes, int]] = []  # language, words, count

    def give(self, key: list[bytes], depth: int, n: int) -> None:
        self.found.append((key[1], b" ".join([key[0], *key[2 : depth + 2]]), n))

    def pop(self, depth: int) -> None:
        """Ends the open prefix of a depth, if there is one."""
        if len(self.sums) > depth and (self.sums[depth] >= self.least or not self.whole[depth]):
            self.give(self.open, depth, self.sums[depth])

    def push(self, keys: pa.Array, n: np.ndarray) -> None:
        parts = pc.split_pattern(keys, "\0")
        words, begin = parts.values, parts.offsets.to_numpy()
        size, begin = np.diff(begin) - 1, begin[:-1]
        langs = words.take(pa.array(begin + 1)).dictionary_encode()
        codes = langs.indices.to_numpy()
        for lang, total in zip(langs.dictionary.to_pylist(), np.bincount(codes, n, len(langs.dictionary))):
            self.words_of[lang.encode()] += int(total)
        first_key, last_key = (keys[k].as_py().encode().split(b"\0") for k in (0, -1))
        fresh = not self.open
        same = np.zeros(len(keys), bool)  # as the row before, in all words so far
        same[1:] = codes[1:] == codes[:-1]
        sums, whole = [], []
        for depth in range(max(len(self.sums), int(size.max()))):
            rows = np.flatnonzero(size > depth)
            begins = size[0] > depth and not fresh and len(self.sums) > depth and first_key[: depth + 2] == self.open[: depth + 2]
            if not begins:
                self.pop(depth)
            if not len(rows):
                continue
            own = words.take(pa.array(begin[rows] + (depth + 1 if depth else 0)))
            now = np.zeros(len(keys), bool)
            now[rows[1:]] = same[rows[1:]] & (rows[1:] == rows[:-1] + 1) & pc.equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
            same = now
            heads = np.flatnonzero(~same[rows])
            counts = np.add.reduceat(n[rows], heads)
            heads = rows[heads]
            if begins:
                counts[0] += self.sums[depth]
            partial = (begins and not self.whole[depth]) or (fresh and size[0] > depth)
            goes_on = size[-1] > depth
            ended = len(heads) - goes_on
            for k in np.flatnonzero(counts[:ended] >= self.least).tolist():
                self.give(keys[int(heads[k])].as_py().encode().split(b"\0"), depth, int(counts[k]))
            if partial and ended and counts[0] < self.least:
                self.give(first_key, depth, int(counts[0]))
            if goes_on:
                sums.append(int(counts[-1]))
                whole.append(not (partial and len(heads) == 1))
        self.open, self.sums, self.whole = last_key, sums, whole

    def end(self) -> None:
        self.whole = [False] * len(self.whole)
        for depth in range(len(self.sums)):
            self.pop(depth)
        self.open, self.sums, self.whole = [], [], []


def prefix_counts(sorted_suffixes: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, words, n) of prefixes of suffixes that lie sorted in ranges; an empty ``words`` has the language's words.

    Counts of prefixes that two ranges share come in parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(least)

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*stack.found), (pa.binary(), pa.binary(), pa.int64()))]
            stack.found = []
            return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "n"])

        for batch in batches:
            if batch.num_rows:
                stack.push(batch.column(0), batch.column(1).to_numpy().astype(np.int64))
            if len(stack.found) > 10_000:
                yield out()
        stack.end()
        stack.found += [(lang, b"", n) for lang, n in stack.words_of.items()]
        if stack.found:
            yield out()

    raw = sorted_suffixes.select("key", "n").mapInArrow(run, "lang binary, words binary, n long")
    lang = F.replace(F.replace(F.col("lang").cast("string"), F.lit("%00"), F.lit("\0")), F.lit("%25"), F.lit("%"))
    return raw.select(lang.alias("lang"), F.replace(F.col("words").cast("string"), F.lit("\t"), F.lit("\0")).alias("words"), "n")


def grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = MIN_COUNT) -> DataFrame:
    """(lang, words, n): every run of at most max_n words that occurs ``least`` times or more, and, as the empty run, each
    language's number of words."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = range_cuts(docs, text_col, lang_col, max_n, ranges)
    parts = suffixes(docs, text_col, lang_col, max_n, cuts).repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions(F.desc("key"))
    return prefix_counts(parts, least).groupBy("lang", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == ""))


def _key(lang: Column, words: Column) -> Column:
    """Unambiguous, as words hold no line feed."""
    return F.concat(lang, F.lit("\n"), words)


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = MIN_COUNT, top: int = TOP, held_percent: int = HELD_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to max_n words.

    score is floor(10^6 a a / (l r)) at the cut where that is least, by exact integers."""
    known = stored(grams(docs, text_col, lang_col, max_n, least), "grams")
    total = known.where("words = ''").agg(F.sum("n")).first()[0] or 0
    size = F.size(F.split("words", " "))
    found = known.where("words <> ''").select("lang", F.col("words").alias("phrase"), F.col("n").alias("a"), size.alias("size"))
    some = found.where("size > 1")

    w = F.split("phrase", " ")
    run = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: run(i, n)))))
    holders = some.where("size > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = some.join(holders, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < held_percent * F.col("a"), F.lit(True)))

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = kept.select("lang", "phrase", "a", "size", cut.alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _key(F.col("lang"), run(F.lit(1), F.col("k"))).alias("first"), _key(F.col("lang"), run(F.col("k") + 1, F.col("size") - F.col("k"))).alias("rest"))
    parts = known.where("words <> ''").select(_key(F.col("lang"), F.col("words")).alias("part"), "n")
    hot = lambda x: F.col(x) * HOT > total
    with_l = looked_up(cuts, parts.select(F.col("part").alias("first"), F.col("n").alias("l")), "first", hot("l"), F.col("phrase"))
    with_r = looked_up(with_l, parts.select(F.col("part").alias("rest"), F.col("n").alias("r")), "rest", hot("r"), F.col("phrase"))

    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    weakest = with_r.select("lang", "phrase", F.struct(score.alias("score"), "k", "a", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))
    scored = weakest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within shares of a language, then of what they leave
    some_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = scored.withColumn("place", F.row_number().over(some_of)).where(F.col("place") <= top).drop("place")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = known.where("words = ''").select(F.col("lang").alias("of"), F.col("n"))
    return ranked.join(words, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The registered query in DuckDB's SQL.
PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 4) AS r(m) WHERE len(w) >= m),
g AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM f GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND a >= 10),
h AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
k AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM h GROUP BY ALL) USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
u AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM k, range(1, 3) AS r(j) WHERE j < m),
s AS (SELECT u.lang, u.phrase, u.a, gx.a AS l, gy.a AS r, j, ((1000000::HUGEINT * u.a * u.a) // (gx.a::HUGEINT * gy.a))::BIGINT AS score
      FROM u JOIN g gx ON gx.lang = u.lang AND gx.phrase = x JOIN g gy ON gy.lang = u.lang AND gy.phrase = y
      QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang)
QUALIFY rank <= 2000
"""
