"""Chunked volumes, windows over blocks, masks as runs, against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.errors import PlanError
from cairn.operators import chunks, runs, volume

KEYS = ["series"]


def slices(spark, volumes, dtype="float32"):
    rows = [(k, z, a.shape[1], a.shape[2], dtype, bytearray(np.ascontiguousarray(a[z], dtype).tobytes())) for k, a in volumes.items() for z in range(len(a))]
    return spark.createDataFrame(rows, "series string, z int, rows int, cols int, dtype string, pixels binary").repartition(3)


def whole(rows, size, kind="<f4", channels=None):
    """{series: array} of collected blocks."""
    out = {}
    for r in rows:
        lead = () if channels is None else (r.channels,)
        a = out.setdefault(r.series, np.full((*lead, *r.shape), 99, np.dtype(kind)))
        box = chunks._box(tuple(r.block), size, tuple(r.shape))
        a[(..., *[slice(lo, hi) for lo, hi in box])] = np.frombuffer(bytes(r.data), kind).reshape(*lead, *chunks._size(box))
    return out


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(1)
    return {"a": rng.normal(size=(9, 7, 8)).astype("f4"), None: rng.normal(size=(3, 4, 5)).astype("f4"), "one": np.ones((1, 1, 1), "f4")}


@pytest.mark.parametrize("size", [(2, 3, 4), (64, 64, 64), (1, 1, 1)])
def test_blocks_hold_the_volume(spark, volumes, size):
    got = whole(chunks.blocks_of(slices(spark, volumes), KEYS, size).collect(), size)
    assert set(got) == set(volumes) and all(np.array_equal(got[k], v) for k, v in volumes.items())


def plain(a, tiling, model):
    """The same in one array: pad, slide, add up."""
    sizes = tiling.sizes(a.shape)
    low = [max(0, (s - n) // 2) for s, n in zip(sizes, a.shape)]
    high = [max(0, s - n) - lo for s, n, lo in zip(sizes, a.shape, low)]
    padded = np.pad(a, list(zip(low, high)))
    starts = [[0] if n <= s else sorted({*range(0, n - s, max(1, int(s * (1 - o)))), n - s}) for n, s, o in zip(a.shape, sizes, tiling.overlap)]
    total, seen, w = None, np.zeros(padded.shape), tiling.weights(sizes)
    for z in starts[0]:
        for y in starts[1]:
            for x in starts[2]:
                at = (slice(z, z + sizes[0]), slice(y, y + sizes[1]), slice(x, x + sizes[2]))
                scores = model(padded[at][None])[0].astype("f4")
                total = np.zeros((len(scores), *padded.shape)) if total is None else total
                total[(slice(None), *at)] += scores * w
                seen[at] += w
    out = (total / seen).astype("f4")
    return out[(slice(None), *[slice(lo, lo + n) for lo, n in zip(low, a.shape)])]


def made_model():
    def model(a):
        return np.stack([a * 2, a - a.mean((1, 2, 3), keepdims=True), np.cumsum(a, 3)], 1)

    return model  # workers don't know this module, so it goes by value


@pytest.mark.parametrize("tiling", [chunks.Tiling((4, 4, 4), 0.5, batch=3), chunks.Tiling((5, 0, 3), (0.0, 0.5, 0.7), batch=1, gaussian=True), chunks.Tiling((16, 16, 16), 0.25, batch=8)])
def test_windows_over_blocks_are_windows_over_arrays(spark, volumes, tiling):
    given, by_size, model = slices(spark, volumes), [], made_model()
    for size in ((2, 3, 4), (64, 64, 64)):
        rows = chunks.inferred(chunks.blocks_of(given, KEYS, size), KEYS, size, tiling, lambda: model).collect()
        by_size.append(whole(rows, size, channels=3))
    for k, v in volumes.items():
        assert np.allclose(by_size[0][k], plain(v, tiling, model), atol=1e-5)
        assert np.array_equal(by_size[0][k], by_size[1][k])  # the same bits for few blocks and for many


def test_batches_are_of_the_stated_size(spark, volumes):
    tiling, size = chunks.Tiling((4, 4, 4), 0.5, batch=3), (4, 4, 4)
    windows = chunks.windows_of(chunks.blocks_of(slices(spark, {"a": volumes["a"]}), KEYS, size), KEYS, size, tiling).coalesce(1)
    n = windows.count()
    seen = chunks.scored(windows, KEYS, tiling, lambda: lambda a: np.full((len(a), 1, *a.shape[1:]), len(a))).collect()
    sizes = [int(np.frombuffer(bytes(r.data), "<f4")[0]) for r in seen]
    assert n == 4 * 3 * 3 and set(sizes) == {3} and len(sizes) == n


def test_tilings_are_checked(spark):
    for bad in ({"roi": (4, 4)}, {"roi": (4, 4, 4), "overlap": 1.0}, {"roi": (4, 4, 4), "overlap": (0.1, 0.2)}, {"roi": (4, 4, 4), "batch": 0}):
        with pytest.raises(PlanError):
            chunks.Tiling(**bad)
    tiling = chunks.Tiling((2, 2, 2), batch=2)
    rows = chunks.blocks_of(slices(spark, {"a": np.zeros((2, 2, 2), "f4")}), KEYS, (2, 2, 2))
    with pytest.raises(Exception, match="the model gave"):
        chunks.inferred(rows, KEYS, (2, 2, 2), tiling, lambda: lambda a: a).collect()


# runs


def masks():
    rng = np.random.default_rng(4)
    spiral = np.zeros((1, 9, 9), np.uint8)
    spiral[0, ::2, :] = 1
    spiral[0, 1, 8] = spiral[0, 3, 0] = spiral[0, 5, 8] = spiral[0, 7, 0] = 1
    return {"rand": rng.integers(0, 3, (6, 7, 8)).astype(np.uint8), "full": np.full((4, 4, 4), 7, np.uint8), "none": np.zeros((3, 3, 3), np.uint8), "spiral": spiral, None: (rng.random((5, 5, 5)) < 0.4).astype(np.uint8) * 255}


def flood(a):
    """{first voxel: (label, voxels)} of each part."""
    seen, out = np.zeros(a.shape, bool), {}
    for start in np.argwhere(a > 0):
        if seen[tuple(start)]:
            continue
        todo, part = [tuple(start)], []
        seen[tuple(start)] = True
        while todo:
            p = todo.pop()
            part.append(p)
            for axis in range(3):
                for step in (-1, 1):
                    q = tuple(c + step * (i == axis) for i, c in enumerate(p))
                    if all(0 <= c < n for c, n in zip(q, a.shape)) and not seen[q] and a[q] == a[p]:
                        seen[q] = True
                        todo.append(q)
        out[int(np.ravel_multi_index(tuple(start), a.shape))] = (int(a[tuple(start)]), part)
    return out


@pytest.mark.parametrize("size", [(2, 3, 4), (64, 64, 64)])
def test_parts_are_those_of_a_flood(spark, size):
    given = masks()
    labels = chunks.as_labels(chunks.blocks_of(slices(spark, given, "uint8"), KEYS, size), KEYS)
    parts = runs.parts_of(runs.runs_of(labels, KEYS, size), KEYS).checkpoint()
    want = {(k, first): (label, len(part)) for k, a in given.items() for first, (label, part) in flood(a).items()}
    assert {(r.series, r.part): (r.label, r.voxels) for r in runs.part_sizes(parts, KEYS).collect()} == want
    listed = {(r.series, r.label): (r.voxels, r.parts, r.largest, r.first) for r in runs.labels_of(parts, KEYS).collect()}
    best = {}
    for (k, first), (label, n) in want.items():
        own = best.setdefault((k, label), [0, 0, 0, 0])
        own[0] += n
        own[1] += 1
        if (n, -first) > (own[2], -own[3]):
            own[2:] = n, first
    assert listed == {k: tuple(v) for k, v in best.items()}
    back = whole(runs.painted(labels, runs.largest_parts(parts, KEYS), KEYS, size).collect(), size, "u1")
    for k, a in given.items():
        kept = np.zeros(a.shape, np.uint8)
        for (s, label), (_, _, _, first) in best.items():
            if s == k:
                for p in flood(a)[first][1]:
                    kept[p] = label
        assert np.array_equal(back[k], kept)


def test_runs_of_lines():
    a = np.array([[[1, 1, 0, 2, 2, 2], [0, 0, 0, 0, 0, 3]]], np.uint8)
    assert [list(map(int, x)) for x in runs.line_runs(a)] == [[1, 2, 3], [0, 0, 0], [0, 0, 1], [0, 3, 5], [1, 5, 5]]
    assert all(len(x) == 0 for x in runs.line_runs(np.zeros((2, 2, 2), np.uint8)))


def test_label_counts(spark):
    given = masks()
    labels = chunks.as_labels(chunks.blocks_of(slices(spark, given, "uint8"), KEYS, (2, 2, 2)), KEYS)
    got = {(r.series, r.label): r.n for r in chunks.label_counts(labels, KEYS).collect()}
    assert got == {(k, int(v)): int(n) for k, a in given.items() for v, n in zip(*np.unique(a, return_counts=True))}


def test_predictions_load_once_a_task(spark):
    def load():
        state = {"n": 0}

        def run(pdf):
            state["n"] += 1
            return pdf.assign(calls=state["n"], v=pdf["v"] * 2)

        return run

    rows = spark.range(10, numPartitions=1).select(F.col("id").alias("v"))
    got = volume.predicted(rows, load, "v long, calls long").collect()
    assert [r.v for r in got] == [2 * k for k in range(10)] and got[0].calls == 1
    assert volume.predicted(rows.limit(0), load, "v long, calls long").collect() == []


def test_parts_read_the_runs_once(spark):
    """Work in Python before the parts isn't done again for each side of a join."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    labels = spark.createDataFrame([(k, [2, 2, 2], [0, 0, 0], bytearray([1, 1, 0, 0, 0, 0, 0, 1])) for k in range(10)], "k long, shape array<int>, block array<int>, data binary")
    found = runs.runs_of(labels.mapInPandas(told, labels.schema), ["k"], (2, 2, 2))
    got = runs.labels_of(runs.parts_of(found, ["k"]), ["k"]).collect()
    assert sorted(r.k for r in got) == list(range(10)) and {(r.voxels, r.parts, r.largest, r.first) for r in got} == {(3, 2, 2, 0)}
    assert seen.value == 10
