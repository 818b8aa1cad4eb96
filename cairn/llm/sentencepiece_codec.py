"""SentencePiece ids and texts by a table of distinct chunks.

Where no piece has a whitespace marker after another character, a merge never crosses from a word to the next marker:
a text is cut before each run of markers, each distinct chunk of a batch is encoded once by the library, and the ids
are joined back by position. The table lives in the worker and is emptied when full; nothing is shuffled, so the plan
is one pass whatever the corpus holds. The model is checked for that property; without it whole texts are encoded.

Defined results: a null text counts as empty (no ids, empty decoded text); repeated rows each get a row; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

MARK = "▁"
KEPT_CHUNKS = 400_000
#: Chunks longer than this are encoded, but not kept.
LONGEST_KEPT = 64

_CHUNK = re.compile(r"[ ▁]+[^ ▁]*")


class ChunkCodec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        norm, kinds = spec.normalizer_spec, {1, 2, 3, 6}
        #: Whether texts may be cut before markers: BPE, texts left as they are but for one marker in front, no piece across a marker.
        self.cuts = (
            spec.trainer_spec.model_type == spec.trainer_spec.BPE
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and all(p.type in kinds and MARK not in p.piece.lstrip(MARK) for p in spec.pieces)
        )
        self.table: dict[str, tuple[int, ...]] = {}
        self.lone = (self.model.piece_to_id(MARK),)

    def chunks(self, text: str) -> list[str]:
        """Each begins with a space or marker; together they are the text with the model's own mark in front."""
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return [" " + w for w in text.split(" ")]
        return _CHUNK.findall(" " + text)

    def _learn(self, texts: list[list[str]]) -> None:
        new = list(dict.fromkeys(c for t in texts for c in t if c not in self.table))
        if len(self.table) + len(new) > KEPT_CHUNKS:
            self.table.clear()
            new = list(dict.fromkeys(c for t in texts for c in t))
        # the library puts one marker in front of each, so each goes in without its first
        self.table.update(zip(new, map(tuple, self.model.encode([c[1:] for c in new], num_threads=1))))
        self.table.update((c, self.lone) for c in (" ", MARK) if c in self.table)  # nothing is left of these for the library
        self.long = [c for c in new if len(c) > LONGEST_KEPT]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Exactly the library's ids, without begin or end."""
        if not self.cuts:
            return self.model.encode(texts, num_threads=1)
        cut = [self.chunks(t) if t else [] for t in texts]
        self._learn(cut)
        get = self.table.__getitem__
        out = [[i for ids in map(get, t) for i in ids] for t in cut]
        for c in self.long:
            self.table.pop(c, None)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


_CODECS: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            yield pa.record_batch([b.column(0), pa.array(codec(path).encode(texts_of(b, 1)), pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) from ids; null ids count as none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            yield pa.record_batch([b.column(0), pa.array(codec(path).decode([x or [] for x in b.column(1).to_pylist()]), pa.string())], names=["id", "text"])

    kind = ids.schema[id_col].dataType.simpleString()
    return ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without the ids between."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(path), lambda s: hashlib.sha256(s).hexdigest()
        for b in slices(batches, 512):
            ids = own.encode(texts_of(b, 1))
            back = own.decode(ids)
            yield pa.record_batch(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(str, x)).encode()) for x in ids]), pa.array([sha(x.encode()) for x in back])],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("id", id_col)
    )
