"""What a worker and its executor hold at a time, beside the results."""

import numpy as np
import pyarrow as pa
import public_tokenizers

import corpus_pipeline
from cairn.llm import common, packing

NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def test_pieces_are_handed_on_for_few_rows_at_a_time():
    own = [np.arange(1 + k % 7, dtype="<u2") for k in range(1000)]
    got = list(packing.handed_on(own, pa.array(range(1000)), 5, NAMES, 16))
    assert len(got) > 1 and max(b.num_rows for b in got) <= packing.HANDED_ON
    whole = pa.Table.from_batches(got)
    pieces = sorted(packing.deal([len(x) for x in own], 16))
    assert whole["id"].to_pylist() == [d for d, *_ in pieces]
    assert whole["sequence_id"].to_pylist() == [5 + p[3] for p in pieces]
    assert whole["ids"].to_pylist() == [own[d][s : s + n].tolist() for d, s, n, _, _ in pieces]


def test_rows_reach_workers_in_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    try:
        for stage in (corpus_pipeline.toxicity_filter, corpus_pipeline.near_dedup, corpus_pipeline.pack):
            spark.conf.set(key, before)
            stage(spark, docs.limit(10), str(tmp_path))
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(found) < 2 * common.BATCH_BYTES and sum(found) > 25_000_000
    finally:
        spark.conf.set(key, before)


def test_tables_of_words_stay_small():
    ids = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"), corpus_pipeline.KEPT_WORDS)
    text = " ".join(f"w{k}x" for k in range(70_000))
    assert ids.ids(text) == np.array(ids.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(len(ids.words), len(ids.parts)) <= 1 << 16
