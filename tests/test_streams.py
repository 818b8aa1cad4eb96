"""Micro-batches: stops after a number of batches, restarts, keyed counters."""

import pytest
from pyspark.sql import functions as F

from cairn.streaming import micro_batch, state


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    for part in range(5):
        rows.where(F.col("id") % 5 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def test_counters_live_through_stops_and_failures(spark, folder):
    schema = spark.read.parquet(f"{folder}/in").schema
    given = schema, ["k"], F.col("v"), F.col("id"), f"{folder}/out", f"{folder}/checkpoint"
    want = {}
    for i in range(300):
        n, total = want.get(i % 3 or None, (0, 0))
        want[i % 3 or None] = n + 1, total + (i if i % 7 else 0)

    some = state.count_files(spark, f"{folder}/in", *given, batches=2, salts=2)
    assert sum(r.n for r in some.collect()) == 120
    # a batch that fails in its sink is replayed under its number, with the counters as they were before it
    stream = state.tallied(micro_batch.file_stream(spark, f"{folder}/in", schema), ["k"], F.col("v"), F.col("id"), 2)

    def fails(df, batch):
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        micro_batch.until(stream, fails, f"{folder}/checkpoint", mode="update")
    got = state.count_files(spark, f"{folder}/in", *given, salts=2)
    assert {r.k: (r.n, r.total) for r in got.collect()} == want
    assert {r.k: (r.n, r.total) for r in state.count_files(spark, f"{folder}/in", *given, salts=2).collect()} == want  # nothing is left


def test_a_stop_counts_whole_batches(spark, folder):
    stream = micro_batch.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    seen = []

    def sink(df, batch):
        seen.append((batch, df.count()))

    assert micro_batch.until(stream, sink, f"{folder}/c", 2) == 2 and seen == [(0, 60), (1, 60)]
    assert micro_batch.until(stream, sink, f"{folder}/c", 9) == 3 and [b for b, _ in seen] == [0, 1, 2, 3, 4]
    assert micro_batch.until(stream, sink, f"{folder}/c") == 0


def test_counters_stay_in_the_jvm(spark, folder):
    """a call into Python for each counter of each batch took longer than the job may; nulls are keys in every column."""
    stream = micro_batch.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    standing = state.tallied(stream.withColumn("j", F.when(F.col("id") % 2 > 0, F.lit("odd"))), ["k", "j"], F.col("v"), F.col("id"), 2)
    assert standing.columns == ["k", "j", "salt", "n", "total"]
    assert "Python" not in standing._jdf.queryExecution().analyzed().toString() and "Pandas" not in standing._jdf.queryExecution().analyzed().toString()
    last = {}

    def sink(df, batch):
        for r in df.collect():
            last[r.k, r.j, r.salt] = r.n, r.total

    micro_batch.until(standing, sink, f"{folder}/c", mode="update")
    got = {}
    for (k, j, _), (n, total) in last.items():
        got[k, j] = got.get((k, j), (0, 0))[0] + n, got.get((k, j), (0, 0))[1] + total
    want = {}
    for i in range(300):
        key = i % 3 or None, "odd" if i % 2 else None
        n, total = want.get(key, (0, 0))
        want[key] = n + 1, total + (i if i % 7 else 0)
    assert got == want
