"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs n + n * n / window (linear work and attention within the piece). Documents are dealt in
descending order, each to the sequence of lowest cost that still has room for all of it. A batch has a spare window for each
PADDED that its tokens fill (two at most), so from PADDED windows on what fits a window is hardly ever cut. What no window
has room for is cut: it fills rooms, largest first, until no more than the spare is padded, and then sequences of descending
powers of two, which need no padding; all together these hold less than a window. A batch of fewer windows has none to
spare, as one would be more than a hundredth of it; it is packed by the same steps, without padding, and cuts more.

Documents become ids first and are then dealt to tasks evenly by a hash of id and ids, whatever their source or order, so
that each task sees the corpus's own mix of lengths; a task sorts what it gets by that hash and packs it in batches of
bounded tokens. Sequence ids carry the partition's number and don't clash. So neither input partitions nor the order in
which rows arrive changes sequences, and a task that runs again after a loss makes the same.

Defined results: a null or empty text has its end id alone; repeated rows are packed each; equal lengths go by that hash; a text longer than a batch is a batch by itself, cut at windows; an empty table gives no rows; columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices, texts_of

WINDOW = 4096
END_ID = 2
#: Tokens that a task packs at a time, at least, if it has so many; at most twice that and one document.
BATCH_TOKENS = 1 << 22
#: So many full windows have a spare one; a batch has less than two windows of padding in any case.
PADDED = 128
#: Entries of each of a worker's two tables of words; a full one is emptied.
KEPT_WORDS = 400_000
#: Pieces that a task hands on at a time: 4 MB of ids at most, of which a worker and its executor hold a few copies.
HANDED_ON = 256

#: The split pattern of this vocabulary's family (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of these characters are in normal form already and lower-case letter by letter.
_SIMPLE = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]+\Z")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")


class WordIds:
    """Ids of the library for a word-end BPE that drops white space, by a table of distinct words.

    No token crosses white space, so each distinct word is encoded once. Words of simple letters are split by the
    vocabulary's pattern and merged by tiktoken, the word end written as a byte that UTF-8 never has; the library
    encodes all others, and whole texts that hold special strings."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.kept = kept
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.end = model["end_of_word_suffix"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or not self.end or steps != ["NFC", "Replace", "Lowercase"] or split[:1] != [PATTERN] or any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: a lower-casing word-end BPE is needed")
        from .token_counts import _byte_alphabet

        to_byte, ranks = _byte_alphabet(), {}
        for token, i in model["vocab"].items():
            ended = token.endswith(self.end)
            ranks[bytes(to_byte[c] for c in token.removesuffix(self.end)) + b"\xff" * ended] = i
        ranks.setdefault(b"\xff", max(ranks.values()) + 1)  # never kept: a merge takes it up first
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= self.kept:
                self.parts.clear()
            got = np.array(self.merge(part.encode() + b"\xff"), "<u4").tobytes()
            if len(part) <= 64:
                self.parts[part] = got
        return got

    def _word(self, word: str) -> bytes:
        if _SIMPLE.match(word):
            got = b"".join([self._part(p) for p in self.pattern.findall(word.lower())])
        else:
            got = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) >= self.kept:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.special) or _ODD_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, get = text.split(), self.words.get
        return b"".join([get(w) or self._word(w) for w in words])


_IDS: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, kept: int = KEPT_WORDS) -> WordIds:
    if (path, kept) not in _IDS:
        _IDS[path, kept] = WordIds(path, kept)
    return _IDS[path, kept]


def cost(tokens: int, window: int = WINDOW) -> float:
    return tokens + tokens * tokens / window


def deal(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    total = sum(lengths)
    spare = min(total // (PADDED * window) * window, 2 * window - 1)
    full = (total + spare) // window
    room, used, spent = [window] * full, [0] * full, [0.0] * full
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        room[seq] -= n
        spent[seq] += cost(n, window)

    # what is longer than a window fills whole sequences first
    nxt, left = 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= window and nxt < full:
            put(doc, start, window, nxt)
            start, nxt = start + window, nxt + 1
        if n > start:
            left.append((n - start, doc, start))
    left.sort(key=lambda x: (-x[0], x[1]))
    cheap = [(0.0, s) for s in range(nxt, full)]
    tight: list[tuple[int, int]] = []  # (-room, sequence): met when it had too little room for what came
    over: list[tuple[int, int, int]] = []  # what no sequence has room for
    for n, doc, start in left:
        while tight and -tight[0][0] >= n:
            seq = heapq.heappop(tight)[1]
            heapq.heappush(cheap, (spent[seq], seq))
        while cheap and room[cheap[0][1]] < n:
            seq = heapq.heappop(cheap)[1]
            if room[seq]:
                heapq.heappush(tight, (-room[seq], seq))
        if cheap:
            seq = cheap[0][1]
            put(doc, start, n, seq)
            heapq.heapreplace(cheap, (spent[seq], seq))
        else:
            over.append((n, doc, start))
    over.reverse()  # the longest is cut first
    free = sum(room)
    rooms = sorted((s for s in range(full) if room[s]), key=lambda s: (room[s], -s))
    while over and free > spare:
        n, doc, start = over.pop()
        seq = rooms[-1]
        k = min(n, room[seq])
        put(doc, start, k, seq)
        free -= k
        if not room[seq]:
            rooms.pop()
        else:
            rooms.sort(key=lambda s: (room[s], -s))
        if n > k:
            over.append((n - k, doc, start + k))
    rest = sum(n for n, _, _ in over)
    for power in reversed(range(rest.bit_length())):
        if rest >> power & 1:
            room.append(1 << power), used.append(0), spent.append(0.0)
            while room[-1]:
                n, doc, start = over.pop()
                k = min(n, room[-1])
                put(doc, start, k, len(room) - 1)
                if n > k:
                    over.append((n - k, doc, start + k))
    return pieces


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT_WORDS) -> DataFrame:
    """(id, ids): each text's ids and the end id, as little-endian 32-bit numbers; 16-bit ones if the vocabulary allows it."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = number_type(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path, kept)
        for b in slices(batches, 256):
            made = [np.frombuffer(own.ids(text) + end, "<u4").astype(narrow).tobytes() for text in texts_of(b, 1)]
            yield pa.record_batch([b.column(0), pa.array(made, pa.binary())], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids binary")


@functools.cache
def number_type(path: str) -> str:
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def handed_on(own: list[np.ndarray], ids: pa.Array, first: int, names: list[str], window: int = WINDOW, rows: int = HANDED_ON) -> Iterator[pa.RecordBatch]:
    """The pieces of documents (their ids own, their names ids), so many rows at a time; first is the number of the first sequence."""
    lengths = [len(x) for x in own]
    found = sorted(deal(lengths, window))
    for at in range(0, len(found), rows):
        doc, start, n, seq, offset = (np.array(x, np.int64) for x in zip(*found[at : at + rows]))
        parts = [own[d][s : s + k].astype("<u4") for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist())]
        columns = [ids.take(pa.array(doc)), start, n, np.array([zlib.crc32(p.tobytes()) for p in parts], np.int64), np.array([lengths[d] for d in doc.tolist()], np.int64), seq + first, offset]
        if "ids" in names:
            columns.append(pa.array([p.view("<i4") for p in parts], pa.list_(pa.int32())))
        yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, kept: int = KEPT_WORDS) -> DataFrame:
    """A row for each piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), with_ids also ids array<int>.

    kept: entries of a worker's tables of words, which decide on time and memory only."""
    kind, number = docs.schema[id_col].dataType.simpleString(), number_type(path)
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        size, half = 0, None  # half: how many documents and arrays of ids make up the first batch of those held

        def out(docs_n: int, names_n: int) -> Iterator[pa.RecordBatch]:
            nonlocal first
            last = first
            for b in handed_on(held[:docs_n], pa.concat_arrays(names[:names_n]), first, columns, window):
                last = max(last, pc.max(b.column(5)).as_py() + 1)
                yield b
            first = last
            del held[:docs_n], names[:names_n]

        for b in slices(batches, 256):
            at = 0
            for k, data in enumerate(b.column(1).to_pylist()):
                held.append(np.frombuffer(data, number))
                size += len(held[-1])
                if size >= batch_tokens * (1 if half is None else 2):
                    names.append(b.column(0).slice(at, k + 1 - at))
                    at = k + 1
                    if half is not None:
                        yield from out(*half)
                    half, size = (len(held), len(names)), sum(map(len, held))
            if at < b.num_rows:
                names.append(b.column(0).slice(at))
        if held:
            yield from out(len(held), len(names))

    # rows without an id may be very many copies of one text, so they are told apart by their place
    spread = F.xxhash64("id", "ids", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    dealt = tokenized(docs, path, end_id, id_col, text_col, kept).withColumn("h", spread).repartition("h").sortWithinPartitions("h")
    return dealt.select("id", "ids").mapInArrow(run, schema).withColumnRenamed("id", id_col)
