"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits. Each bit position gets a vector of three bits (never zero), and table v of seven keeps the
bits whose vector has an odd product with v. Two positions are two linear conditions on v, so some v keeps neither:
every pair within two differing bits meets in some table. No pair within the radius is missed, whatever the data.

Buckets are of distinct fingerprints. A bucket that holds many is dealt again by a second family of seven masks over
the bits that its first mask leaves free; such a bucket differs in at most 12 bits, so it holds at most 4,096
fingerprints: no group grows with the data. Within a bucket, a breadth-first walk finds the linked fingerprints and
gives one edge a fingerprint, never all pairs; connected components are found by alternating stars over these edges.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; a
null id never is a component's smallest id unless all are null (then the component is null); repeated rows each get a
row; an empty table gives no rows; a very long text is hashed in blocks of words, all of them; columns other than the id
and the text are ignored, whatever their names (``one_of_each`` gives all columns back).
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, slices, stored

SEED = 42
RADIUS = 2
SHINGLE = 3
#: A bucket with more fingerprints is dealt again by the masks of the second level.
DEAL_AGAIN = 256

_ALL = (1 << 64) - 1
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_LANES = (np.arange(8, dtype=np.uint16) * 256)[None, :]


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED, block: int = 1 << 16) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number. Works through the words in blocks."""
    words = data.lower().split()
    if not words:
        return 0
    shingle = min(shingle, len(words))
    total = len(words) - shingle + 1
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, total, block):
        part = words[at : at + block + shingle - 1]
        columns = [part[k:] for k in range(shingle)]
        digests = b"".join([xxhash.xxh64_digest(b" ".join(s), seed) for s in zip(*columns)])
        lanes = np.frombuffer(digests, np.uint8).reshape(-1, 8) + _LANES
        ones += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * ones > total).ravel()).tobytes(), "big")


def _masks(positions: list[int], seed: int) -> list[int]:
    """Seven masks over the given bit positions such that any two positions are both left out by some mask."""
    dealt = positions[:]
    random.Random(seed).shuffle(dealt)
    vector = {p: 1 + k % 7 for k, p in enumerate(dealt)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, 8)]


MASKS = _masks(list(range(64)), SEED)
#: By first mask: its own bits with those of each mask over the rest.
SUBMASKS = [[m | s for s in _masks([p for p in range(64) if not m >> p & 1], SEED + 1)] for m in MASKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): a row for each input row; fp has the fingerprint's bits as a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(x, shingle) for x in bytes_of(b, 1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _walk(fps: list[int]) -> Iterator[tuple[int, int]]:
    """(fingerprint, smallest fingerprint it reaches), for those that reach a smaller one; fps are distinct signed longs, compared as 64 bits."""
    if len(fps) <= 24:
        left = sorted(fps)
        while left:
            root, reach = left[0], [left.pop(0)]
            while reach and left:
                x = reach.pop()
                if near := [y for y in left if ((x ^ y) & _ALL).bit_count() <= RADIUS]:
                    left = [y for y in left if ((x ^ y) & _ALL).bit_count() > RADIUS]
                    reach += near
                    for y in near:
                        yield y, root
        return
    rest = np.sort(np.array(fps, np.int64))
    while len(rest):
        root, reach, rest = rest[0], [rest[0]], rest[1:]
        while reach and len(rest):
            close = np.bitwise_count((rest ^ reach.pop()).view(np.uint64)) <= RADIUS
            if close.any():
                near, rest = rest[close], rest[~close]
                reach.extend(near)
                for y in near.tolist():
                    yield y, int(root)


def _edges_of_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (t, key, fp) sorted by t and key; groups may go over batch ends."""
    kept_t, kept_key, kept_fp = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def edges(t, key, fp, ends) -> pa.RecordBatch:
        starts = np.concatenate([[0], ends[:-1]])
        found = [e for a, z in zip(starts, ends) if z - a > 1 for e in _walk((fp[a:z]).tolist())]
        return pa.record_batch([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        t, key, fp = (np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate((kept_t, kept_key, kept_fp)))
        if not len(fp):
            continue
        ends = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        last = ends[-1] if len(ends) else 0
        if len(ends):
            yield edges(t[:last], key[:last], fp[:last], ends)
        kept_t, kept_key, kept_fp = t[last:], key[last:], fp[last:]
    if len(kept_fp) > 1:
        yield edges(kept_t, kept_key, kept_fp, np.array([len(kept_fp)]))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), b < a: edges that connect what links of at most two bits connect. distinct: fp, each once."""
    first = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(MASKS)])
    dealt = distinct.select("fp", F.inline(first))
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.join(sizes, ["t", "key"])
    again = F.lit(None)
    for v in reversed(range(7)):
        own = F.array(*[F.struct(F.lit(100 + 10 * v + u).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for u, m in enumerate(SUBMASKS[v])])
        again = F.when(F.col("t") == v, own).otherwise(again)
    cells = met.select("fp", F.explode(F.when(F.col("n") > DEAL_AGAIN, again).otherwise(F.array(F.struct("t", "key")))).alias("c")).select("c.t", "c.key", "fp")
    return cells.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_edges_of_sorted, "a long, b long").distinct()


def components(edges: DataFrame, label: str = "stars", most_rounds: int = 60) -> DataFrame:
    """(a, b): b is the smallest vertex of a's component, for each a that isn't it. edges: (a, b) longs, each way or one way.

    Alternating large and small stars; each round is written to the shared folder. Raises if the rounds don't suffice."""
    now, seen = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        then = stored(small, label)
        discard(now)
        now = then
    raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, fp) of each row, (fp, root, component_id, n) of each distinct fingerprint); both in the shared folder.

    root is the component's smallest fingerprint: its key, as component_id is shared where ids are null or repeated."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "distinct")
    stars = components(links(distinct.select("fp")))
    member = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    joined = member.join(distinct, "fp")
    smallest = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled = member.join(smallest, "root").select("fp", "root", "component_id")
    named = distinct.join(labelled, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"), "n")
    out = stored(named, "components")
    discard(distinct)
    discard(stars)
    return rows, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id): a row for each input row."""
    rows, named = classes(docs, id_col, text_col)
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with all their columns, one for each component: that of the smallest id (of repeated rows any one).

    Unlinked texts stay even if their ids are null or the same."""
    rows, named = classes(docs, id_col, text_col)
    stay = rows.join(named, "fp").where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("fp"), F.min("component_id").alias("component_id"))
    plain = docs.schema.names
    number = {c: f"c{i}" for i, c in enumerate(plain)}
    at = number[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plain.index(text_col)
        for b in slices(batches):
            fp = np.array([fingerprint(x) for x in bytes_of(b, where)], np.uint64).view(np.int64)
            yield pa.record_batch([*b.columns, pa.array(fp)], names=[*b.schema.names, "fp"])

    held = docs.toDF(*number.values())
    marked = held.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in held.schema), "fp long"]))
    kept = marked.alias("d").join(stay.alias("s"), (F.col(f"d.{at}").eqNullSafe(F.col("s.component_id"))) & (F.col("d.fp") == F.col("s.fp")), "left_semi")
    return kept.dropDuplicates([at, "fp"]).drop("fp").toDF(*plain)
