"""Exact byte-level BPE token counts at every prefix of a text, by dynamic programming.

A sequence of tokens is what BPE gives for its bytes exactly when each neighbouring pair is what BPE gives for the
pair's bytes. So the last token of each prefix's encoding is the one token that ends there and fits the last token of
what stands before it, and the prefix's count is one more than the count there. One pass over a piece of text gives
the counts of all its prefixes: how many tokens a truncation leaves, or how much text a budget holds, need no encoding.

Pieces are those of the vocabulary's own split pattern, so that only equal pieces are ever worked out once more; a
worker keeps a table of those it has met, emptied when full.

Defined results: a null text counts as empty (no tokens); special strings inside texts are the single tokens that the
library makes of them; repeated rows each get a row; an empty table gives no rows; very long texts are counted whole, in
time linear in their length; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: How many chunks and pairs a worker keeps before it empties its tables.
KEPT_CHUNKS = 400_000
KEPT_PAIRS = 1_000_000

#: The pattern by which byte-level vocabularies of this family split text (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The pattern's alternatives that are more than a mark and one letter.
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))

#: Cutting at single spaces is safe unless one of these occurs.
_UNSAFE = re.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for the vocabulary in a tokenizers file (byte-level BPE, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: byte-level BPE without normalizer is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options are not supported")
        to_byte = _byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        #: Tokens that BPE ever gives, and the automaton that finds all of them that end at each byte.
        self.tokens = [t for t in vocab if self._merge(t) == [t]]
        self.ending = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            self.ending.add_word(t.decode("latin-1"), (len(t), k))
        self.ending.make_automaton()
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.pattern = regex.compile(PATTERN)
        self.fits: dict[int, bool] = {}
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain BPE; used on single tokens and pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: int, b: int) -> bool:
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        x, y = self.tokens[a], self.tokens[b]
        got = self.fits[a << 32 | b] = self._merge(x + y) == [x, y]
        return got

    def piece_counts(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1], ..., data, for one piece of the split pattern."""
        counts, last, fits = [0] * (len(data) + 1), [0] * (len(data) + 1), self.fits
        for end, (n, token) in self.ending.iter(data.decode("latin-1")):
            end += 1
            if not counts[end]:
                start = end - n
                if start:
                    fit = fits.get(last[start] << 32 | token)
                    if fit is None:
                        fit = self._fit(last[start], token)
                    if not fit:
                        continue
                counts[end] = counts[start] + 1
                last[end] = token
        if not all(counts[1:]):
            raise ValueError(f"the vocabulary lacks a byte of {data[:50]!r}")
        return counts

    def _segments(self, text: str) -> Iterator[str | None]:
        """The stretches between special strings; None for each special string."""
        if not any(s in text for s in self.special):
            yield text
            return
        for k, part in enumerate(re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)):
            yield None if k % 2 else part

    def _chunk(self, chunk: str) -> int:
        got = self.chunks.get(chunk)
        if got is None:
            got = sum(map(self._piece, self.pattern.findall(chunk)))
            if len(self.chunks) >= KEPT_CHUNKS:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = got
        return got

    def _piece(self, piece: str) -> int:
        got = self.pieces.get(piece)
        if got is None:
            got = self.piece_counts(piece.encode())[-1]
            if len(self.pieces) >= KEPT_CHUNKS:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = got
        return got

    def count(self, text: str) -> int:
        """The count of the whole text: that of its last prefix, summed over chunks that no token crosses."""
        total, known = 0, self.chunks
        for part in self._segments(text):
            if part is None:
                total += 1
            elif _UNSAFE.search(part):
                for p in self.pattern.findall(part):
                    got = known.get(p)
                    total += self._chunk(p) if got is None else got
            elif part:
                head, *rest = part.split(" ")
                total += self._chunk(head)
                for p in rest:
                    p = " " + p
                    got = known.get(p)
                    total += self._chunk(p) if got is None else got
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[k] is the token count of text[:k], for k from 0 to len(text)."""
        out, base, last, start = [0], 0, "", 0
        for part in self._segments(text):
            if part is None:
                special = next(s for s in self.special if text.startswith(s, len(out) - 1))
                # cut short, a special string is ordinary text that goes on from the last piece before it
                out += [start + self.count(last + special[:k]) for k in range(1, len(special))]
                out.append(base := base + 1)
                last, start = "", base
                continue
            for m in self.pattern.finditer(part):
                last, start = m[0], base
                counts = self.piece_counts(last.encode())
                ends = np.cumsum([len(c.encode()) for c in last])
                at = [counts[e] for e in ends]
                if last in CONTRACTIONS:  # cut short, it falls into the mark and letters
                    at[:-1] = [self.piece_counts(b"'")[-1] + (self.piece_counts(last[1:k].encode())[-1] if k > 1 else 0) for k in range(1, len(last))]
                out += [base + x for x in at]
                base += counts[-1]
            # a run of space that single pieces end with is one piece while it is the end
            for m in regex.finditer(r"\s{2,}(?=\S)", part):
                offset = len(out) - len(part) - 1
                lead = out[offset + m.start()]
                run = self.piece_counts(m[0].encode())
                ends = np.cumsum([len(c.encode()) for c in m[0]])
                for k, e in zip(range(m.start() + 1, m.end() + 1), ends):
                    out[offset + k] = lead + run[e]
        return np.array(out, np.int64)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit): the count at the last prefix of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in slices(batches):
            texts = texts_of(b, 1)
            n = np.array([own.count(x) for x in texts], np.int64)
            size = np.array([len(x.encode()) for x in texts], np.int64)
            yield pa.record_batch([b.column(0), pa.array(size), pa.array(n), pa.array(n > budget)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, counts): counts[k] is the token count of the text's first k characters. Ask it with tokens_at and longest_within."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in slices(batches, 64):
            counts = [own.prefix_counts(x).astype(np.int32) for x in texts_of(b, 1)]
            yield pa.record_batch([b.column(0), pa.array(counts, pa.list_(pa.int32()))], names=["id", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, counts array<int>").withColumnRenamed("id", id_col)


def tokens_at(counts: Column, chars: Column) -> Column:
    """The token count of the first chars characters (of the whole text, if it is shorter)."""
    return F.element_at(counts, F.least(chars + 1, F.size(counts)).cast("int"))


def longest_within(counts: Column, budget: int) -> Column:
    """The most characters whose tokens keep within the budget."""
    return F.array_max(F.transform(counts, lambda c, k: F.when(c <= budget, k))).cast("int")
