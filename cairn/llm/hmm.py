"""A hidden Markov language model over words.

Texts are read once: each task turns its texts into chunks of bounded size, one row a chunk, that hold the texts as
numbers of the chunk's own distinct words. Words are dealt by hash into buckets, and what chunks and buckets tell each
other are blocks of numbers, one row for a chunk and a bucket: counts first, then in each round emissions one way and
expected counts the other way. So no vocabulary is ever sent to all workers or to the driver; there are as many buckets
as keep each to a bounded size, and what is kept by word grows with the corpus.

Every word that occurs MIN_COUNT times or more in training has emissions of its own, however many words that are. Rarer
words share one symbol, within which a word has its add-one share (with one place for words never seen). A round of
Baum-Welch runs over every training text whole: each chunk gives the expected counts of its words and of the states'
moves, they are summed by word across chunks in the words' buckets, and those sums are the next parameters. A text's score is the exact
likelihood by the scaled forward recursion over all its words and the end symbol.

Emissions are worked with as ratios to the words' own shares, which keeps the recursions within range; a share SHARE of
each state's emissions is the words' own share, so every state gives every word.

Defined results: a null text counts as empty (the end symbol only); repeated rows each get a row and each count in
training; a null id falls in fold zero of the empty text; a null in `learn` is no; with no training rows every word is
unseen, N and V are zero; an empty table gives no rows; a very long text is a chunk by itself, its recursion is carried
on in slabs of bounded memory; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, bytes_of, discard, slices, stored

STATES = 8
#: Words that occur so often in training have emissions of their own.
MIN_COUNT = 10
ROUNDS = 5
#: The part of each state's emissions that is the words' own share, and of its moves that is even.
SHARE, EVEN = 0.02, 0.001
#: Bytes of text of a chunk, at most about, unless one text is longer.
CHUNK_BYTES = 16 << 20
#: (chunk, word) pairs of a bucket, about: what bounds a task that sums by word.
BUCKET_PAIRS = 500_000
#: Tokens that are worked on at a time within a chunk.
TOKENS = 1 << 19
#: Steps between two scalings. A step's factor is between SHARE and a state's largest ratio.
SCALE_EVERY = 4


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def planes(x: np.ndarray) -> bytes:
    """int32 numbers by byte planes, which compress well where numbers are small."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Numbers(dict):
    """Numbers of words, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def chunked(docs: DataFrame, kind: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, lengths, learn, tokens, words, own) from (id, text, learn): own are the words' counts in training texts.

    lengths and tokens (numbers in `words`, text after text) are int32 planes, learn is a byte a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        numbers, ids, learn, texts, size = _Numbers(), [], [], [], 0

        def out() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int32)
            tokens, own = np.concatenate(texts), np.concatenate(learn)
            counts = np.bincount(tokens[np.repeat(own, lengths)], minlength=len(numbers))
            row = [chunk, None, planes(lengths), own.tobytes(), planes(tokens), list(numbers), counts]
            return pa.record_batch(
                [pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)) if k == 1 else pa.array([x], t) for k, (x, t) in enumerate(zip(row, types))],
                names=["chunk", "ids", "lengths", "learn", "tokens", "words", "own"],
            )

        types = [pa.int64(), None, pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        for b in slices(batches, 64):
            begun, flags = 0, b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for k, x in enumerate(bytes_of(b, 1)):
                ws = words_of(x)
                texts.append(np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)))
                size += len(x) + 1
                if size >= chunk_bytes or k == b.num_rows - 1:
                    ids.append(b.column(0).slice(begun, k + 1 - begun))
                    learn.append(flags[begun : k + 1])
                    begun = k + 1
                if size >= chunk_bytes:
                    yield out()
                    chunk, numbers, ids, learn, texts, size = chunk + 1, _Numbers(), [], [], [], 0
        if texts:
            yield out()

    return docs.mapInArrow(run, f"chunk long, ids array<{kind}>, lengths binary, learn binary, tokens binary, words array<binary>, own array<long>")


@dataclass(frozen=True)
class Shares:
    """Sums over the training tokens: all, ends, distinct words, words with emissions, and the rest's tokens."""

    total: int
    ends: int
    kinds: int
    named: int
    rest: int

    @property
    def places(self) -> float:
        return self.total + 0.5 * (self.named + 2)

    def share(self, n):
        """The share of a symbol that occurs n times; over all words with emissions, the rest and the end it adds up to one."""
        return (n + 0.5) / self.places


def _ints(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(data, kind)


def counted(raw: DataFrame, buckets: int, least: int, states: int) -> DataFrame:
    """Counts of all words, by bucket: (bucket, chunk, pos, n, idx, first, stats).

    For each chunk that has words of the bucket, a row with their places in the chunk, their counts over all chunks and
    their numbers among the bucket's words with emissions (-1 for rarer ones). For the bucket itself (chunk -1), a row with
    the counts of its words with emissions, the factors that the first round begins with, and sums: (tokens, words, words
    with emissions, tokens of rarer words)."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            words, own = b.column(1).flatten(), b.column(2).flatten().to_numpy()
            bucket = np.fromiter((crc32(w) % buckets for w in words.to_pylist()), np.int32, len(words))
            order = np.argsort(bucket, kind="stable").astype(np.int32)
            found, first = np.unique(bucket[order], return_index=True)
            ends = np.append(first, len(order))
            parts = [order[x:y] for x, y in zip(ends, ends[1:])]
            yield pa.record_batch(
                [pa.array(found, pa.int32()), pa.array([b.column(0)[0].as_py()] * len(found), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(order))), pa.array([own[x].tobytes() for x in parts], pa.binary())],
                names=["bucket", "chunk", "pos", "words", "own"],
            )

    def count(t: pa.Table) -> pa.Table:
        words = t["words"].combine_chunks().flatten().dictionary_encode()
        code, own = words.indices.to_numpy(), np.concatenate([_ints(x, "<i8") for x in t["own"].to_pylist()])
        n = np.zeros(len(words.dictionary), np.int64)
        np.add.at(n, code, own)
        named = n >= least
        idx = np.where(named, np.cumsum(named) - 1, -1).astype("<i4")
        ends = np.cumsum([len(x) // 4 for x in t["pos"].to_pylist()])
        spans = list(zip(np.append(0, ends[:-1]), ends))
        key = np.array([crc32(w) for w in words.dictionary.filter(pa.array(named)).to_pylist()], np.uint64)
        factor = np.stack([-np.log(_uniform(key, z)) for z in range(states)], axis=1)
        met = n > 0
        stats = [int(n.sum()), int(met.sum()), int(named.sum()), int(n[~named].sum())]
        m = len(spans)
        return pa.table(
            [pa.array([t["bucket"][0].as_py()] * (m + 1), pa.int32()), pa.concat_arrays([t["chunk"].combine_chunks(), pa.array([-1], pa.int64())]), pa.array([*t["pos"].to_pylist(), None], pa.binary()),
             pa.array([*(n[code[x:y]].tobytes() for x, y in spans), n[named].tobytes()], pa.binary()), pa.array([*(idx[code[x:y]].tobytes() for x, y in spans), None], pa.binary()),
             pa.array([None] * m + [(n[named][:, None] * factor).astype("<f8").tobytes()], pa.binary()), pa.array([None] * m + [stats], pa.list_(pa.int64()))],
            names=["bucket", "chunk", "pos", "n", "idx", "first", "stats"],
        )

    dealt = raw.select("chunk", "words", "own").mapInArrow(deal, "bucket int, chunk long, pos binary, words array<binary>, own binary")
    return dealt.groupBy("bucket").applyInArrow(count, "bucket int, chunk long, pos binary, n binary, idx binary, first binary, stats array<long>")


def _uniform(key: np.ndarray, z: int) -> np.ndarray:
    """Numbers between zero and one that hang on key and z only."""
    x = key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((z + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def numbered(raw: DataFrame, counts: DataFrame, shares: Shares, kind: str) -> DataFrame:
    """The chunks with symbols (0 the end, 1 a rare word, then the chunk's words with emissions, bucket by bucket) and each text's sums.

    (chunk, ids, lengths, learn, symbols, buckets, sizes, known, base, fixed): lengths with the end; how many of the
    words with emissions each bucket has; known: tokens met in training; base: the base score; fixed: the log10 of what
    in the score doesn't hang on states."""
    named = counts.where("chunk >= 0").select(F.col("chunk").alias("to"), "bucket", "pos", "n", "idx")
    schema = f"chunk long, ids array<{kind}>, lengths binary, learn binary, symbols binary, buckets array<int>, sizes array<int>, known array<long>, base array<double>, fixed array<double>"
    base_unit = math.log10(shares.total + shares.kinds + 1)
    rest_unit = math.log10(shares.rest + shares.kinds - shares.named - (shares.ends > 0) + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths, tokens, learn = (left[c][0].as_py() for c in ("lengths", "tokens", "learn"))
        lengths, tokens, size = unplanes(lengths), unplanes(tokens), left["size"][0].as_py()
        n, symbol, next_ = np.zeros(size, np.int64), np.ones(size, np.int32), 2
        buckets, sizes = [], []
        for _, r in sorted((r["bucket"], r) for r in right.to_pylist()):
            pos, idx = _ints(r["pos"]), _ints(r["idx"])
            n[pos] = _ints(r["n"], "<i8")
            own = pos[idx >= 0]
            symbol[own] = np.arange(next_, next_ + len(own))
            next_ += len(own)
            buckets.append(r["bucket"])
            sizes.append(len(own))
        logs = np.log10(n + 1.0)
        fixed = np.where(symbol == 1, logs - rest_unit + math.log10(shares.share(shares.rest)), np.log10(shares.share(n)))
        ends = np.cumsum(lengths + 1) - 1
        seq = np.zeros(len(tokens) + len(lengths), np.int32)
        inner = np.ones(len(seq), bool)
        inner[ends] = False
        seq[inner] = symbol[tokens]

        def per_text(of_word: np.ndarray, of_end: float) -> np.ndarray:
            x = np.empty(len(seq))
            x[inner], x[ends] = of_word[tokens], of_end
            return np.add.reduceat(x, ends - lengths)

        known = per_text((n > 0).astype(float), float(shares.ends > 0))
        base = per_text(logs - base_unit, math.log10(shares.ends + 1) - base_unit)
        logs = per_text(fixed, math.log10(shares.share(shares.ends)))
        cells = [planes(lengths + 1), learn, planes(seq)]
        lists = [(buckets, pa.int32()), (sizes, pa.int32()), (np.round(known).astype(np.int64), pa.int64()), (base, pa.float64()), (logs, pa.float64())]
        return pa.table(
            [left["chunk"], left["ids"], *[pa.array([x], pa.binary()) for x in cells], *[pa.array([x], pa.list_(t)) for x, t in lists]],
            names=["chunk", "ids", "lengths", "learn", "symbols", "buckets", "sizes", "known", "base", "fixed"],
        )

    chunks = raw.select("chunk", "ids", "lengths", "learn", "tokens", F.size("words").alias("size"))
    return chunks.groupBy("chunk").cogroup(named.groupBy("to")).applyInArrow(run, schema)


@dataclass(frozen=True)
class Moves:
    """What of the model doesn't grow: begins, moves, the sums of the states, and the ratios of the end and of rare words."""

    start: np.ndarray
    move: np.ndarray
    total: np.ndarray
    end: np.ndarray
    rare: np.ndarray


def ratio(g, total, share):
    """A state's emission over the symbol's own share, from its expected count g and the state's sum."""
    return (1 - SHARE) * (g / share + 1) / (total + 1) + SHARE


class Batch:
    """Sequences laid out step by step, longest first, with the recursions over them."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, n: np.ndarray, ratios: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.flat, self.begin, self.n = flat, begin, n
        self.ratios, self.start, self.move = ratios.astype(np.float32), start.astype(np.float32), move.astype(np.float32)
        self.live = np.searchsorted(-n, -np.arange(n[0] + 1), side="left")  # how many are longer than t
        cuts, size = [0], 0
        sums = np.concatenate([[0], np.cumsum(self.live)])
        while cuts[-1] < n[0]:
            size = int(np.searchsorted(sums, sums[cuts[-1]] + TOKENS, side="right")) - 1
            cuts.append(min(int(n[0]), max(cuts[-1] + 1, size)))
        self.slabs = list(zip(cuts, cuts[1:]))

    def _places(self, t0: int, t1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first row of each step, live of each step, symbols) of a slab."""
        m = self.live[t0:t1]
        off = np.concatenate([[0], np.cumsum(m)])
        doc = np.arange(off[-1]) - np.repeat(off[:-1], m)
        return off, m, np.take(self.flat, self.begin[doc] + np.repeat(np.arange(t0, t1), m))

    def _forward(self, t0: int, t1: int, off: np.ndarray, m: np.ndarray, emit: np.ndarray, a: np.ndarray | None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Scaled alphas of a slab that begins with those of the step before; the scales of the steps that have one."""
        out, scales = np.empty_like(emit), {}
        move, ones = self.move, np.ones(len(self.move), np.float32)
        for t, o, k in zip(range(t0, t1), off.tolist(), m.tolist()):
            now = out[o : o + k]
            if a is None:
                now[:] = self.start
            else:
                np.matmul(a[:k], move, out=now)
            now *= emit[o : o + k]
            if t % SCALE_EVERY == SCALE_EVERY - 1:
                c = scales[t] = now @ ones
                now /= c[:, None]
            a = now
        return out, scales

    def likely(self) -> np.ndarray:
        """Log10 of each sequence's likelihood over that of its symbols' own shares."""
        logs, a = np.zeros(len(self.n)), None
        for t0, t1 in self.slabs:
            off, m, symbols = self._places(t0, t1)
            alphas, scales = self._forward(t0, t1, off, m, np.take(self.ratios, symbols, axis=0), a)
            for c in scales.values():
                logs[: len(c)] += np.log10(c)
            done = np.arange(self.live[t1], self.live[t0])  # those that end within the slab
            logs[done] += np.log10(alphas[off[self.n[done] - 1 - t0] + done].sum(1, dtype=np.float64))
            a = alphas[off[-2] :].copy()
        return logs

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts: of the states at the begin, of moves, of each symbol by state."""
        k, s = len(self.move), len(self.ratios)
        start, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((s, k))
        befores, a = [], None
        for t0, t1 in self.slabs:  # where there are several, each is worked out once more on the way back
            befores.append(a)
            if len(self.slabs) > 1:
                off, m, symbols = self._places(t0, t1)
                a = self._forward(t0, t1, off, m, np.take(self.ratios, symbols, axis=0), a)[0][off[-2] :].copy()
        after = None
        for (t0, t1), a in zip(reversed(self.slabs), reversed(befores)):
            off, m, symbols = self._places(t0, t1)
            x = np.take(self.ratios, symbols, axis=0)  # emissions, then emissions times betas over scales
            alphas, scales = self._forward(t0, t1, off, m, x, a)
            betas, back = np.ones_like(x), np.ascontiguousarray(self.move.T)
            if after is not None:
                betas[off[-2] : off[-2] + len(after[0])] = after[0] @ back
                moved += alphas[off[-2] : off[-2] + len(after[1])].T @ after[1]
            places = list(zip(range(t0, t1), off.tolist(), m.tolist()))
            for j in reversed(range(len(places))):
                t, o, n = places[j]
                now = x[o : o + n]
                now *= betas[o : o + n]
                if t in scales:
                    now /= scales[t][:, None]
                if j:
                    np.matmul(now, back, out=betas[places[j - 1][1] : places[j - 1][1] + n])
            betas *= alphas
            norm = (1 / (betas @ np.ones(k, np.float32)))[:, None]
            betas *= norm
            first = x[: m[0]].copy()
            x *= norm
            if len(m) > 1:
                before = np.arange(off[1], off[-1]) - np.repeat(m[:-1], m[1:])
                moved += np.take(alphas, before, axis=0).T @ x[off[1] :]
            after = (first, x[: m[0]].copy())
            if t0 == 0:
                start += betas[: m[0]].sum(0)
            for z, g in enumerate(betas.T.astype(float)):
                emitted[:, z] += np.bincount(symbols, weights=g, minlength=s)
        return start, moved * self.move, emitted


def batches_of(lengths: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
    """Places of sequences, longest first, of about TOKENS tokens together."""
    order = which[np.argsort(-lengths[which], kind="stable")]
    cut = np.flatnonzero(np.diff(np.cumsum(lengths[order]) // TOKENS, prepend=0)) if len(order) else []
    yield from (x for x in np.split(order, cut) if len(x))


def _opened(left: pa.Table, right: pa.Table, model: Moves) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, lengths, begins, ratios by symbol) of a chunk. right: (bucket, ratios), in any order."""
    flat, lengths = unplanes(left["symbols"][0].as_py()), unplanes(left["lengths"][0].as_py())
    k = len(model.start)
    blocks = [x for _, x in sorted(zip(right["bucket"].to_pylist(), right["ratios"].to_pylist()))]
    ratios = np.vstack([model.end, model.rare, np.frombuffer(b"".join(blocks), "<f4").reshape(-1, k)]).astype(np.float32)
    return flat, lengths, np.cumsum(lengths) - lengths, ratios


def emissions(slots: DataFrame, sums: DataFrame, model: Moves, shares: Shares) -> DataFrame:
    """(to, bucket, ratios): for each chunk and bucket the emission ratios of its words. slots: (bucket, chunk, idx, n); sums: (part, g)."""
    k = len(model.start)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        to, out, bucket = [], [], -1
        rows = left.to_pylist()
        if rows:
            bucket = rows[0]["bucket"]
            n = next(_ints(r["n"], "<i8") for r in rows if r["chunk"] < 0)
            table = ratio(np.frombuffer(right["g"][0].as_py(), "<f8").reshape(-1, k), model.total, shares.share(n)[:, None]).astype("<f4")
            for r in rows:
                if r["chunk"] >= 0:
                    idx = _ints(r["idx"])
                    to.append(r["chunk"])
                    out.append(table[idx[idx >= 0]].tobytes())
        return pa.table([pa.array(to, pa.int64()), pa.array([bucket] * len(to), pa.int32()), pa.array(out, pa.binary())], names=["to", "bucket", "ratios"])

    return slots.groupBy("bucket").cogroup(sums.where("part >= 0").groupBy("part")).applyInArrow(run, "to long, bucket int, ratios binary")


#: The sums of chunks that don't go by word are added up in so many groups.
SPREAD = 64


def improved(held: DataFrame, slots: DataFrame, vectors: DataFrame, model: Moves) -> DataFrame:
    """(part, g): expected counts over all training texts. part: a bucket, with its words' sums by state; below zero, groups
    of the other sums (begins, ends, rare words, each state's sum, moves)."""
    k = len(model.start)

    def expect(left: pa.Table, right: pa.Table) -> pa.Table:
        part, chunk, out = [], [], []
        learn = np.frombuffer(left["learn"][0].as_py(), bool) if left.num_rows else np.zeros(0, bool)
        if learn.any():
            flat, lengths, begin, ratios = _opened(left, right, model)
            start, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((len(ratios), k))
            for own in batches_of(lengths, np.flatnonzero(learn)):
                s, m, e = Batch(flat, begin[own], lengths[own], ratios, model.start, model.move).expected()
                start, moved, emitted = start + s, moved + m, emitted + e
            part, sizes = left["buckets"][0].as_py(), left["sizes"][0].as_py()
            at = 2 + np.cumsum([0, *sizes])
            out = [emitted[x:y].astype("<f4").tobytes() for x, y in zip(at, at[1:])]
            number = left["chunk"][0].as_py()
            part = [*part, -1 - number % SPREAD]
            out.append(np.vstack([start, emitted[0], emitted[1], emitted.sum(0), moved]).astype("<f8").tobytes())
            chunk = [number] * len(part)
        return pa.table([pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.array(out, pa.binary())], names=["part", "chunk", "g"])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if rows:
            part = rows[0]["bucket"]
            total = np.zeros((next(len(r["n"]) // 8 for r in rows if r["chunk"] < 0), k))
            found = dict(zip(right["chunk"].to_pylist(), right["g"].to_pylist()))
            for r in rows:
                if r["chunk"] in found:
                    idx = _ints(r["idx"])
                    total[idx[idx >= 0]] += np.frombuffer(found[r["chunk"]], "<f4").reshape(-1, k)  # a word is in a chunk once
        else:
            part = right["part"][0].as_py()
            total = sum(np.frombuffer(x, "<f8") for x in right["g"].to_pylist())
        return pa.table([pa.array([part], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part", "g"])

    found = held.select("chunk", "lengths", "learn", "symbols", "buckets", "sizes").groupBy("chunk").cogroup(vectors.groupBy("to")).applyInArrow(expect, "part int, chunk long, g binary")
    return slots.groupBy("bucket").cogroup(found.groupBy("part")).applyInArrow(add, "part int, g binary")


def moves_of(sums: DataFrame, shares: Shares, states: int) -> Moves:
    """The part of the model that doesn't grow: from at most SPREAD rows of sums."""
    rows = [np.frombuffer(bytes(r.g), "<f8").reshape(-1, states) for r in sums.where("part < 0").collect()]
    start, end, rare, total, *move = sum(rows)
    move = np.array(move) + 1e-9
    return Moves((start + 1) / (start + 1).sum(), (1 - EVEN) * move / move.sum(1, keepdims=True) + EVEN / states, total, ratio(end, total, shares.share(shares.ends)), ratio(rare, total, shares.share(shares.rest)))


def first_moves(firsts: DataFrame, shares: Shares, states: int) -> Moves:
    """What the first round begins with: states that stay; sums of the words' counts times their factors."""

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(states)
        for b in slices(batches, 8):
            for x in b.column(0).to_pylist():
                sums += np.frombuffer(x, "<f8").reshape(-1, states).sum(0)
        yield pa.record_batch([pa.array([sums], pa.list_(pa.float64()))], names=["t"])

    got = firsts.select("g").mapInArrow(total, "t array<double>").agg(*[F.coalesce(F.sum(F.get("t", F.lit(z))), F.lit(0.0)) for z in range(states)]).first()
    own = np.array(got, float) + shares.ends + shares.rest
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even, ones = np.full(states, 1 / states), np.ones(states)
    return Moves(even, move, own, ratio(shares.ends * ones, own, shares.share(shares.ends)), ratio(shares.rest * ones, own, shares.share(shares.rest)))


def released(spark) -> None:
    """Lets the driver drop plans that are done with, and so the shuffle files that they own."""
    gc.collect()
    spark._jvm.System.gc()


def scored(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, least: int = MIN_COUNT, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score); learn: which rows to learn from."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    raw = stored(chunked(rows, kind, chunk_bytes), "chunks")
    # a training text is a byte of one in `learn`
    ones = F.length(F.replace(F.hex("learn"), F.lit("00"), F.lit(""))) / 2
    chunks, pairs, ends = raw.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.sum(ones), F.lit(0)).cast("long")).first()
    buckets = max(1, min(1 << 20, -(-pairs // bucket_pairs)))
    counts = stored(counted(raw, buckets, least, states), "counts")
    n, kinds, named, rest = counts.where("chunk < 0").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(4)]).first()
    shares = Shares(n + ends, ends, kinds + (ends > 0), named, rest)
    spread = max(1, min(20_000, chunks))
    held = bucketed(numbered(raw, counts, shares, kind), spread, "chunk", "held")
    discard(raw)
    slots = bucketed(counts.select("bucket", "chunk", "idx", F.when(F.col("chunk") < 0, F.col("n")).alias("n")), max(1, min(20_000, buckets)), "bucket", "slots")
    sums = stored(counts.where("chunk < 0").select(F.col("bucket").alias("part"), F.col("first").alias("g")), "sums")
    discard(counts)
    model = first_moves(sums, shares, states)
    for _ in range(rounds if ends else 0):
        then = stored(improved(held, slots, emissions(slots, sums, model, shares), model), "sums")
        model = moves_of(then, shares, states)
        discard(sums)
        sums = then
        released(spark)
    vectors = emissions(slots, sums, model, shares)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, lengths, begin, ratios = _opened(left, right, model)
        likely = np.zeros(len(lengths))
        for own in batches_of(lengths, np.arange(len(lengths))):
            likely[own] = Batch(flat, begin[own], lengths[own], ratios, model.start, model.move).likely()
        flat_of = lambda c: left[c].combine_chunks().flatten()
        return pa.table([flat_of("ids"), pa.array(lengths.astype(np.int64)), flat_of("known"), flat_of("base"), pa.array(flat_of("fixed").to_numpy() + likely)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    texts = held.select("chunk", "ids", "lengths", "symbols", "known", "base", "fixed").groupBy("chunk").cogroup(vectors.groupBy("to"))
    out = stored(texts.applyInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double"), "scored")
    for x in (held, slots, sums):
        discard(x)
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(shares.total).cast("long").alias("train_tokens"), "base_score", "score")
