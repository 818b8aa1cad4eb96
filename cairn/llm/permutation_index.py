"""Approximate nearest neighbours by a permutation index.

A vector's direction from the middle of all (which changes no query's ranking) is stood for by the order of its nearest
pivots. Pivot inverted files: each vector is posted in the files of its POSTS nearest pivots, long vectors in more (they
are likelier to have large inner products), and a query opens only the files of its own nearest pivots. Of what stands in
an open file, the footrule distance between the two orders, scaled by the vector's length, gives the rank; what ranks
within a limit is ranked again by the inner product itself, and the best k of all files are the answer. A vector that stands
in several open files is looked at in the first only.

How many files a query opens, and the limit, are measured: TRIALS queries are answered exactly against all rows, and both
are set so that RECALL of those answers would be met (with a margin, see ``calibrated``). Where orders tell nothing, all
files are opened and all is ranked again, which is exact. The number of pivots grows with the root
of the table's rows up to MOST_PIVOTS, that is for 7 million rows; beyond, files grow with the table, and so does what a
query touches. Files are dealt into blocks of bounded size, one task each; a file larger than that is split, and its
queries go to every part.

Equal vectors answer alike, so only the k + 1 smallest ids of each distinct vector are indexed (a further copy can
never be among anyone's k nearest, ties going to smaller ids), and each distinct query vector is searched once.

Bounded samples, of smallest hash: the pivots (at most MOST_PIVOTS distinct vectors) and TRIALS queries. Everything else
covers all rows.

Defined results: null or zero vectors and those that hold null or non-finite components take no part; a null id takes
no part; of repeated ids the first vector (by its components) counts; ties go to smaller ids; with fewer candidates than
k all are returned; an empty table gives no rows; vectors of different lengths raise; columns
other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: Pivots: so many times the root of the rows, within these bounds.
PIVOTS_A_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 1.5, 64, 4096
#: How many of its nearest pivots stand for a vector.
NAMED = 48
#: Files in which a vector of median length is posted, and any vector at most.
POSTS, MOST_POSTS = 3, 12
#: Queries on which files and the limit are measured, and the recall that is aimed at.
TRIALS, RECALL = 64, 0.97
#: A query opens LEAST_OPENED * pivots ** (2 / 3) files at least.
LEAST_OPENED = 0.5
#: Rows and bytes of vectors of a block, at most.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 16 << 20


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths_of(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths; components are brought near one first, so that no square over- or underflows."""
    big = np.abs(x).max(1, initial=0)
    some = np.where(big > 0, big, 1)
    return big * np.sqrt(((x / some[:, None]) ** 2).sum(1))


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors over their lengths, zero vectors as they are."""
    big = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(big > 0, big, 1)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def order_of(x: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """For each vector its nearest pivots, nearest first."""
    return np.argsort(-(directions(x) @ pivots.T), axis=1, kind="stable")[:, :most]


def posts_of(lengths: np.ndarray, median: float, posts: int = POSTS, most: int = MOST_POSTS) -> np.ndarray:
    """In how many files vectors are posted: more with the square of their length."""
    with np.errstate(over="ignore"):
        return np.clip(np.round(posts * (lengths / (median or 1.0)) ** 2), 1, most).astype(int)


def opened_files(pivots: int, opened: float = LEAST_OPENED) -> int:
    return min(pivots, math.ceil(opened * pivots ** (2 / 3)))


def footrules(orders: np.ndarray, place: np.ndarray, named: int) -> np.ndarray:
    """Footrule distances of orders (rows of named pivots) to the order in which place[p] is pivot p's rank; ranks end at ``named``."""
    there = np.minimum(place[orders[:, :named]], named).astype(np.int64)
    own = np.arange(named)
    met = np.where(there < named, np.abs(there - own) - (named - own) - (named - there), 0).sum(1)
    return met + named * (named + 1)


def calibrated(truth: list[list[int]], vectors: dict[int, np.ndarray], asked: np.ndarray, pivots: np.ndarray, centre: np.ndarray, median: float, named: int, recall: float = RECALL) -> tuple[int, float]:
    """(files to open, limit of the scaled footrule) that give the recall on trial queries, half of the loss each, and a tenth more files.

    truth: each trial's nearest ids; vectors: theirs."""
    n_pivots, loss = len(pivots), (1 - recall) / 2
    chance = named * (named + 1) * (1 - named / n_pivots / 2)
    first, far = [], []
    for q, ids in zip(asked, truth):
        place = np.empty(n_pivots, np.int64)
        place[order_of(q[None], pivots, n_pivots)[0]] = np.arange(n_pivots)
        y = np.stack([vectors[i] for i in ids]) - centre
        near, length = order_of(y, pivots, named), lengths_of(y)
        posts = np.minimum(named, posts_of(length, median))
        first.append(np.where(np.arange(near.shape[1]) < posts[:, None], place[near], n_pivots).min(1))
        far.append((footrules(near, place, named) - chance) * length)
    files = math.ceil(1.1 * (int(np.quantile(np.concatenate(first), 1 - loss, method="higher")) + 1))
    return min(n_pivots, max(opened_files(n_pivots), files)), float(np.quantile(np.concatenate(far), 1 - loss, method="higher"))


class File:
    """A pivot's inverted file, or a part of it: by pivot, the ranks at which its vectors name it."""

    def __init__(self, pivot: int, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, posts: np.ndarray, n_pivots: int, centre: np.ndarray):
        self.pivot, self.ids, self.vectors, self.named = pivot, ids, vectors, near.shape[1]
        self.lengths = lengths_of(vectors - centre)
        self.ranks = np.full((n_pivots, len(ids)), self.named, np.uint8)
        self.ranks[near, np.arange(len(ids))[:, None]] = np.arange(self.named, dtype=np.uint8)
        wide = int(posts.max(initial=1))
        self.posted = np.ascontiguousarray(np.where(np.arange(wide) < posts[:, None], near[:, :wide], n_pivots).T)
        # what two orders have on average that share pivots by chance
        self.chance = self.named * (self.named + 1) * (1 - self.named / n_pivots / 2)

    def footrule(self, own: np.ndarray, here: np.ndarray | None = None) -> np.ndarray:
        """Footrule distances of the vectors' orders (or of those here) to a query's."""
        r = np.arange(self.named, dtype=np.uint8)
        ranks = np.take(self.ranks, own[: self.named], axis=0)
        late = np.maximum(ranks if here is None else ranks[:, here], r[:, None]).sum(0, dtype=np.uint16).astype(np.int32) - int(r.sum())
        return self.named * (self.named + 1) // 2 + int(r.sum()) - self.named * self.named + 2 * late

    def search(self, query: np.ndarray, own: np.ndarray, place: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(places in the file, inner products) of the best k. place: rank of each pivot in the query's order."""
        here = np.flatnonzero(np.take(place, self.posted).min(0) == place[self.pivot])
        if k < len(here) and limit < np.inf:
            far = (self.footrule(own, here) - self.chance) * self.lengths[here]
            keep = max(k, int((far <= limit).sum()))
            if keep < len(here):
                here = here[np.argpartition(far, keep - 1)[:keep]]
        scores = (np.take(self.vectors, here, axis=0) * query).sum(1)
        best = np.lexsort((self.ids[here], -scores))[:k]
        return here[best], scores[best]


def fewest(df: DataFrame, by: Column, wanted: int, rows: int) -> list:
    """The wanted distinct rows of smallest hash, or all if there are fewer; only a share of the hashes is sorted."""
    share, low = 8 * wanted / rows, -(1 << 63)
    while True:
        some = df.withColumn("h_", by)
        some = some.where(F.col("h_") < F.lit(int(low + share * (1 << 64)))) if share < 1 else some
        got = some.distinct().orderBy("h_", *df.columns).limit(wanted).collect()
        if len(got) == wanted or share >= 1:
            return got
        share *= 16


def middle(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """The mean vector; zero where it can't be told."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                total += b.column(0).flatten().to_numpy().reshape(b.num_rows, size).sum(0)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "total"])

    sums = dict(map(tuple, rows.select("v").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total")).collect()))  # a row a component
    out = np.array([sums[i] for i in range(size)]) / n
    return out if np.isfinite(out).all() else np.zeros(size)


def _lengths(centre: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(lengths_of(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) - centre))], names=["length"])

    return run


def exact(rows: DataFrame, asked: np.ndarray, k: int) -> list[list[int]]:
    """The ids of the k largest inner products of each asked vector, over all rows; a task holds its best k so far."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))
        for b in slices(batches, 4096):
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            ids = np.hstack([ids, np.broadcast_to(b.column(0).to_numpy(), (len(asked), b.num_rows))])
            scores = np.hstack([scores, asked @ x.T])
            best = np.argsort(-scores, 1, kind="stable")[:, :k]
            ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        t = np.repeat(np.arange(len(asked), dtype=np.int32), ids.shape[1])
        yield pa.record_batch([pa.array(t), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["t", "id", "score"])

    top = rows.select("id", "v").mapInArrow(run, "t int, id long, score double").withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k)
    out: list[list[int]] = [[] for _ in asked]
    for t, i in top.select("t", "id").collect():  # TRIALS * k rows
        out[t].append(i)
    return out


def trial(rows: DataFrame, queries: DataFrame, pivots: np.ndarray, centre: np.ndarray, median: float, named: int, k: int) -> tuple[int, float]:
    """``calibrated`` on TRIALS queries; all files and no limit where there is no query."""
    asked = np.array([r.v for r in queries.orderBy(F.xxhash64("v"), "v").limit(TRIALS).collect()])
    if not len(asked):
        return len(pivots), math.inf
    truth = exact(rows, asked, k + 1)
    ids = rows.sparkSession.createDataFrame([(i,) for i in sorted({i for t in truth for i in t})], "id long")
    vectors = {r.id: np.array(r.v) for r in rows.join(F.broadcast(ids), "id").select("id", "v").collect()}
    return calibrated(truth, vectors, asked, pivots, centre, median, named)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", named: int = NAMED, opened: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score): k nearest by inner product in double precision, for each row where is_query holds."""
    spark = vectors.sparkSession
    asked = F.coalesce(is_query, F.lit(False))
    good = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double") + 0.0).alias("v"), asked.alias("q"))
    rows = stored(good.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")

    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if least != most:
        raise ValueError(f"vectors of different lengths: {least} to {most}")
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, math.ceil(PIVOTS_A_ROOT * math.sqrt(n))))
    centre = middle(rows, n, least)
    chosen = np.array([r.v for r in fewest(rows.select("v"), F.xxhash64("v"), wanted, n)])
    if not np.any(chosen - centre):
        centre = np.zeros(least)
    table = chosen - centre
    table = directions(table[table.any(1)])
    shared = spark.sparkContext.broadcast((table, centre))  # at most MOST_PIVOTS vectors
    n_pivots = len(table)
    named = min(named, n_pivots)
    median = rows.select("v").mapInArrow(_lengths(centre), "length double").agg(F.percentile_approx("length", 0.5)).first()[0]
    # copies: the smallest k + 1 ids of each vector by pairwise merging, so no task ever holds a vector's whole group
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "v")
    queries = stored(rows.where("q").groupBy("v").agg(F.min("id").alias("key")), "queries")
    files, limit = trial(rows, queries, table, centre, median, named, k) if opened is None else (opened_files(n_pivots, opened), math.inf)

    def placed(df: DataFrame, own: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int, centred: bool) -> DataFrame:
        """(id, v, near, files): the order of the nearest pivots as 16-bit numbers, and in how many of these files a row belongs."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1024):
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                pivots, centre = shared.value
                y = x - centre if centred else x  # a query ranks all by its inner product with what they are from the middle
                near = order_of(y, pivots, most)
                files = own(y, near)
                near = near.astype("<u2")
                kept = [r[: max(named, m)].tobytes() for r, m in zip(near, files)]
                yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(kept, pa.binary()), pa.array([r[:m].astype(np.int32) for r, m in zip(near, files)], pa.list_(pa.int32()))], names=["id", "v", "near", "files"])

        return stored(df.mapInArrow(run, "id long, v binary, near binary, files array<int>"), "orders")

    def size(df: DataFrame) -> dict[int, int]:  # at most MOST_PIVOTS rows
        return {r.file: r["count"] for r in df.select(F.explode("files").alias("file")).groupBy("file").count().collect()}

    def posts(x: np.ndarray, near: np.ndarray) -> np.ndarray:
        return np.minimum(named, posts_of(lengths_of(x), median))

    posted = placed(first, posts, named, True)
    of_vectors = size(posted)
    sizes = np.array([of_vectors.get(f, 0) for f in range(n_pivots)])

    def opens(x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Where the nearest files hold few vectors, more are opened, until they hold k + 1 different ones."""
        enough = np.cumsum(sizes[near], axis=1) >= MOST_POSTS * (k + 1)
        return np.maximum(files, np.where(enough.any(1), enough.argmax(1) + 1, n_pivots))

    probes = placed(queries.select(F.col("key").alias("id"), "v"), opens, n_pivots, False)
    of_queries = size(probes)
    block_rows = max(16, min(block_rows, BLOCK_BYTES // (8 * least)))
    deal, block, held, asks = [], 0, 0, 0
    for file in range(n_pivots):
        nv, nq = of_vectors.get(file, 0), of_queries.get(file, 0)
        parts, ask_parts = max(1, -(-nv // block_rows)), max(1, -(-nq // block_rows))
        if held + nv > block_rows or asks + nq > block_rows:
            block, held, asks = block + 1, 0, 0
        deal.append((file, block, parts, ask_parts))
        held, asks = held + nv, asks + nq
        if parts * ask_parts > 1:
            block, held, asks = block + parts * ask_parts, 0, 0
    dealt = F.broadcast(spark.createDataFrame(deal, "file int, block int, parts int, asks int"))
    part, ask = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id"), F.col("asks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("e")
    left = posted.select(F.explode("files").alias("file"), F.size("files").alias("posts"), "id", "v", "near").join(dealt, "file").select("*", every("asks")).select((F.col("block") + part * F.col("asks") + F.col("e")).alias("block"), "file", F.lit(False).alias("asked"), "posts", "id", "v", "near")
    right = probes.select(F.explode("files").alias("file"), F.lit(0).alias("posts"), "id", "v", "near").join(dealt, "file").select("*", every("parts")).select((F.col("block") + F.col("e") * F.col("asks") + ask).alias("block"), "file", F.lit(True).alias("asked"), "posts", "id", "v", "near")

    def run(table: pa.Table) -> pa.Table:
        file, posts, ids = (table[c].to_numpy() for c in ("file", "posts", "id"))
        asked = table["asked"].to_numpy(zero_copy_only=False)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for f in np.unique(file):
            own, asks = np.flatnonzero((file == f) & ~asked), np.flatnonzero((file == f) & asked)
            if not len(own) or not len(asks):
                continue
            array = lambda c, at, kind: np.frombuffer(b"".join(table[c].take(pa.array(at)).to_pylist()), kind).reshape(len(at), -1)
            here = File(int(f), ids[own], array("v", own, "<f8"), array("near", own, "<u2").astype(np.int64), posts[own], n_pivots, centre)
            place = np.full(n_pivots + 1, 1 << 14, np.int16)
            orders = (np.frombuffer(x, "<u2").astype(np.int64) for x in table["near"].take(pa.array(asks)).to_pylist())
            for q, v, near in zip(ids[asks], array("v", asks, "<f8"), orders):
                place[near] = np.arange(len(near))
                at, scores = here.search(v, near, place, k + 1, limit)
                parts.append((np.full(len(at), q), here.ids[at], scores))
                place[near] = 1 << 14
        key, got, scores = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        best = np.lexsort((got, -scores, key))
        key, got, scores = key[best], got[best], scores[best]
        new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        top = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key)))) <= k
        return pa.table([pa.array(key[top]), pa.array(got[top]), pa.array(scores[top])], names=["key", "id", "score"])

    hits = left.unionByName(right).groupBy("block").applyInArrow(run, "key long, id long, score double")
    top = hits.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    best = stored(top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("hits")), "hits")
    answers = rows.where("q").select("id", "v").join(queries, "v").select(F.col("id").alias("query_id"), "key").join(best, "key")
    own = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    out = stored(answers.select("query_id", F.posexplode(own).alias("p", "h")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("h.id").alias(id_col), (-F.col("h.s")).alias("score")), "answers")
    for x in (rows, queries, posted, probes, best):
        discard(x)
    return out
