"""Importance resampling towards a target distribution, over a stored sparse matrix of documents by hashed buckets.

Features are runs of one and two words, hashed into BUCKETS. The documents' counts are written once as blocks of
compressed sparse rows (ids, row starts, buckets, counts). Sums of columns give the corpus' distribution, those of the
target's blocks the target's; a bucket's gain is the floored thousandfold log ratio of the two; the matrix times the gains
gives each document's weight. Gumbel noise of a hash of the id makes the highest scores a draw without replacement.

Texts are read once; blocks are bounded by rows and by numbers, so a task holds one block. The driver gets the column
sums, a row a bucket, and sends the gains back. Ranks need no global sort: whole scores are counted (their number is
bounded by the range of gains and noise, some ten thousands, however many rows), and only drawn rows are ordered within
their score, of which noise keeps a few thousandths of all rows at most.

Defined results: a null or wordless text has no features, weight 0 and, below MIN_WORDS, no rank; an empty target has
every t = 0; an empty table gives no rows; repeated rows are drawn each by itself; equal ids have equal noise, and their
ties go to the smaller id (null last), then weight and features; very long texts are counted whole. Columns other than id
and text don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, discard, slices, stored

BUCKETS = 10_000
#: Words of a text that may be drawn.
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: A block ends at so many rows, or after the row with which it has so many numbers.
BLOCK_ROWS, BLOCK_NUMBERS = 256, 1 << 17
#: Bytes of a row group of the stored matrix; Spark's reader decodes one at a time.
ROW_GROUP = 8 << 20

#: A-Z lower-cased; all that parts words becomes a space.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def bucket_counts(text: bytes, max_n: int = 2, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, distinct buckets in order, their counts) of all runs of 1 to max_n words."""
    words = text.translate(_LETTERS).split()
    crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    all_ = [crcs]
    for n in range(2, max_n + 1):
        if len(words) < n:
            break
        # a run's checksum goes on from that of the run without its last word
        spaced = [zlib.crc32(b" ", x) for x in crcs[: len(words) - n + 1].tolist()]
        crcs = np.fromiter(map(zlib.crc32, words[n - 1 :], spaced), np.uint32, len(spaced))
        all_.append(crcs)
    at, counts = np.unique(np.concatenate(all_) % np.uint32(buckets), return_counts=True)
    return len(words), at, counts


def _narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def _numbers(data: pa.Scalar, n: int) -> np.ndarray:
    """What _narrow made of n numbers."""
    raw = data.as_buffer()
    return np.frombuffer(raw, f"<u{raw.size // n}") if n else np.zeros(0, np.uint8)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(ids, words, starts, buckets, counts): blocks of compressed sparse rows of the documents' bucket counts.

    buckets and counts are bytes: whole numbers of one, two or four bytes each, as the block's largest needs."""
    id_type = docs.schema[id_col].dataType
    ids = T.ArrayType(id_type)
    schema = T.StructType([T.StructField(n, t) for n, t in (("ids", ids), ("words", T.ArrayType(T.IntegerType())), ("starts", T.ArrayType(T.IntegerType())), ("buckets", T.BinaryType()), ("counts", T.BinaryType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, at, counts, held = [], [], [], [], 0

        def block(kind: pa.DataType) -> pa.RecordBatch:
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            starts = np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32)
            flat = [pa.array([_narrow(np.concatenate(x)).tobytes()], pa.binary()) for x in (at, counts)]
            return pa.RecordBatch.from_arrays([one(pa.concat_arrays(rows), kind), one(words, pa.int32()), one(starts, pa.int32()), *flat], names=schema.names)

        kind = None
        for batch in slices(batches):
            kind = batch.column(0).type
            for k, text in enumerate(bytes_of(batch, 1)):
                n, b, c = bucket_counts(text, max_n, buckets)
                rows.append(batch.column(0).slice(k, 1)), words.append(n), at.append(b), counts.append(c)
                held += len(b)
                if len(rows) >= BLOCK_ROWS or held >= BLOCK_NUMBERS:
                    yield block(kind)
                    rows, words, at, counts, held = [], [], [], [], 0
        if rows:
            yield block(kind)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts of each bucket over all blocks: summed by task, then by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for starts, at, counts in zip(*batch.columns):
                n = starts.values[-1].as_py()
                np.add.at(sums, _numbers(at, n), _numbers(counts, n).astype(np.int64))
        some = np.flatnonzero(sums)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in matrix.select("starts", "buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the target's add-one share to the corpus')."""
    s, t, b = int(own.sum()), int(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(own.tolist(), target.tolist())], np.int64)


def products(matrix: DataFrame, by_bucket: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, n_features, weight): each row of the matrix times the gains, by its number of features, floored."""
    schema = T.StructType([T.StructField(id_col, matrix.schema["ids"].dataType.elementType), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, starts = (batch.column(c).slice(k, 1).flatten() for c in range(3))
                starts = starts.to_numpy(zero_copy_only=False)
                at, counts = (_numbers(batch.column(c)[k], int(starts[-1])) for c in (3, 4))
                total = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[starts[1:]] - c[starts[:-1]]
                features = total(counts)
                weight = np.where(features > 0, total(by_bucket[at] * counts) // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, words.cast(pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], names=schema.names)

    return matrix.select("ids", "words", "starts", "buckets", "counts").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel number of the id), by the first 32 bits of a hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, id_col: str, percent: int, min_words: int) -> DataFrame:
    """scored (id_col, n_words, n_features, weight, score) with rank among the drawn, null for others."""
    may = F.col("n_words") >= min_words
    down = Window.orderBy(F.desc("score"))  # one row a whole score: bounded, see above
    scores = scored.where(may).groupBy("score").agg(F.count("*").alias("rows"))
    scores = scores.select("score", (F.sum("rows").over(down) - F.col("rows")).alias("before"), F.expr(f"({percent} * sum(rows) over ()) div 100").alias("drawn"))
    scores = scores.where("before < drawn").select(F.col("score").alias("s_"), "before", "drawn")
    within = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "weight", "n_features")
    place = F.col("before") + F.row_number().over(within)
    held = scored.withColumn("s_", F.when(may, F.col("score")))
    first = held.join(F.broadcast(scores), "s_").select(id_col, "n_words", "n_features", "weight", "score", F.when(place <= F.col("drawn"), place).alias("rank"))
    others = held.join(F.broadcast(scores), "s_", "left_anti").select(id_col, "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return first.unionAll(others)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, max_n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank): all documents; of those with min_words, percent are drawn."""
    if id_col in ("n_words", "n_features", "weight", "score", "rank"):
        docs = docs.select(F.col(id_col).alias("id"), text_col)
        return resampled(docs, target, "id", text_col, target_col, percent, min_words, seed, max_n, buckets).toDF(id_col, *("n_words", "n_features", "weight", "score", "rank"))
    matrix = stored(blocks(docs, id_col, text_col, max_n, buckets), "matrix", ROW_GROUP)
    wanted = blocks(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id", "text", max_n, buckets)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    rows = products(matrix, gain, id_col)
    scored = stored(rows.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)), "scored")
    discard(matrix)
    return ranked(scored, id_col, percent, min_words)


#: The registered query in DuckDB's SQL; checksums are worked out byte by byte, once a distinct feature.
RESAMPLED_SQL = r"""
WITH RECURSIVE tab(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM tab WHERE k < 8),
lut AS MATERIALIZED (SELECT list(c ORDER BY i) AS l FROM tab WHERE k = 8),
src AS (SELECT 0 AS kind, doc_id, coalesce(text, '') AS x FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
tok AS (SELECT row_number() OVER () AS rid, kind, doc_id, list_filter(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM src),
feats AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM tok),
cnt AS (SELECT rid, f, count(*) AS n FROM feats GROUP BY ALL),
crc AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(f)), lambda i: ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT)),
                               lambda a, b: xor(a // 256, l[xor(a % 256, b) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM cnt), lut),
byb AS (SELECT kind, b, sum(n)::BIGINT AS n FROM cnt JOIN crc USING (f) JOIN tok USING (rid) GROUP BY ALL),
tot AS (SELECT coalesce(sum(n) FILTER (kind = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 1), 0)::BIGINT AS t FROM byb),
gain AS (SELECT b, floor(1000 * ln((coalesce(max(n) FILTER (kind = 1), 0) + 1)::DOUBLE * (any_value(s) + 10000) / ((coalesce(max(n) FILTER (kind = 0), 0) + 1)::DOUBLE * (any_value(t) + 10000))))::BIGINT AS g FROM byb, tot GROUP BY b),
w AS (SELECT rid, sum(n)::BIGINT AS nf, sum(n * g)::BIGINT AS total FROM cnt JOIN crc USING (f) JOIN gain USING (b) GROUP BY rid),
d AS (SELECT doc_id, len(w) AS nw, coalesce(nf, 0) AS n_features, CASE WHEN nf IS NULL THEN 0 ELSE floor(total::DOUBLE / nf)::BIGINT END AS weight,
             ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM tok LEFT JOIN w USING (rid) WHERE kind = 0),
s AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM d),
r AS (SELECT *, CASE WHEN nw >= 20 THEN row_number() OVER (PARTITION BY nw >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (nw >= 20) OVER () AS may FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * may // 100 THEN place END AS rank FROM r
"""
