"""The ten operators on small fixtures: brute force, the libraries' own results, round trips, and edge cases."""

import math
import random
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import common, hmm, licenses, packing, permutation_index, quality, queries, sentencepiece_codec, simhash, token_counts, toxicity, warc

D = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b\n\n c's 're \t x", "a\x1cb c", "<|endoftext|> x <|endoftext|>y", "ΑΣ Σ İx ǅ é é 日本 😀", "a b c", "I'll 'r 've''s  x  ", "▁x y▁", " lead", "trail ", "a\n\n foo\n \nb", "x" * 3000, "don't １２٣", "\x00a", "ab " * 400]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    """Edge rows: null text, null id, repeated rows and ids, columns whose names clash with results."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (None, "no id at all"), (3, "again"), (3, "again"), (200, ODD[3])]
    return spark.createDataFrame([(k, t, "en", None, 1, 0.5, "clash") for k, t in rows], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# 1


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair_of_bits():
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1 or m >> j & 1) for m in simhash.MASKS)
            for v, m in enumerate(simhash.MASKS):
                if not (m >> i & 1 or m >> j & 1):
                    assert any(not (s >> i & 1 or s >> j & 1) for s in simhash.SUBMASKS[v])
    assert all(64 - s.bit_count() <= 13 for row in simhash.SUBMASKS for s in row)


def brute_components(rows):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_simhash_is_brute_force(spark, which, request):
    df = request.getfixturevalue(which)
    got = pairs(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id")
    assert got == brute_components([(d, brute_fingerprint(t)) for d, t in texts(df)])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_of_dense_buckets(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    hot = rng.getrandbits(64)
    free = [b for b in range(64) if not simhash.MASKS[0] >> b & 1]
    fps |= {hot ^ sum(1 << b for b in rng.sample(free, rng.randint(0, 5))) for _ in range(1500)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    stars = {(r.a, r.b) for r in simhash.components(simhash.links(df)).collect()}
    label = dict(stars)
    want = brute_components([(simhash._signed(f), f) for f in fps])
    by = {}
    for f, _, c in want:
        by.setdefault(c, set()).add(f)
    got = {}
    for f in fps:
        s = simhash._signed(f)
        got.setdefault(label.get(s, s), set()).add(s)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, got.values()))


def test_one_of_each(spark, docs):
    got = simhash.one_of_each(docs)
    assert got.schema == docs.schema
    fps = {brute_fingerprint(t) for _, t in texts(docs)}
    root = {f: c for f, _, c in brute_components([(f, f) for f in fps])}
    least = {}
    for d, t in texts(docs):
        least.setdefault(root[brute_fingerprint(t)], []).append(d)
    want = [min((d for d in own if d is not None), default=None) for own in least.values()]
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(want, key=str)


def test_one_of_each_keeps_unlinked_texts(spark):
    """A row for each component, also where ids are null or repeated."""
    apart = ["red apples fall far from here", "nine boats sail north at dawn", "old maps show no such road", "we never met the new mayor"]
    df = spark.createDataFrame([(None, apart[0]), (None, apart[1]), (None, apart[1]), (5, apart[2]), (5, apart[3]), (5, apart[3]), (6, apart[3])], "doc_id long, text string")
    assert len(brute_components([(k, brute_fingerprint(t)) for k, t in enumerate(apart)])) == 4
    assert pairs(simhash.one_of_each(df), "doc_id", "text") == sorted([(None, apart[0]), (None, apart[1]), (5, apart[2]), (5, apart[3])], key=str)


# 2


def test_prefix_counts_are_the_librarys(real):
    own, lib = token_counts.counter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in [*(t[:200] for t in ODD), *(t[:150] for _, t in texts(real.limit(6)))]:
        assert own.prefix_counts(text).tolist() == [len(lib.encode(text[:k], add_special_tokens=False)) for k in range(len(text) + 1)]


@pytest.mark.parametrize("which", ["docs", "real"])
def test_token_counts(which, request):
    df, lib = request.getfixturevalue(which), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(d, len(t.encode()), n, n > 300) for d, t in texts(df) for n in [len(lib.encode(t, add_special_tokens=False))]]
    assert pairs(token_counts.token_counts(df, P.path("byte_bpe_50k.json"), 300), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


def test_prefix_table_answers(real):
    t = token_counts.prefix_table(real.where("doc_id < 3"), P.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    full = dict(texts(real))
    for r in t.select("doc_id", token_counts.tokens_at(F.col("counts"), F.lit(50)).alias("n"), token_counts.longest_within(F.col("counts"), 20).alias("k")).collect():
        assert r.n == len(lib.encode(full[r.doc_id][:50], add_special_tokens=False))
        assert len(lib.encode(full[r.doc_id][: r.k], add_special_tokens=False)) <= 20


# 3


def test_patience_alignment():
    assert licenses.increasing([3, 1, 2, 5, 4]) == [1, 2, 4] and licenses.increasing([]) == []
    a, b = "x the cat sat on the mat y".split(), "the cat sat at the mat".split()
    assert [a[i] for i, _ in licenses.align(a, b)] == "the cat sat the mat".split()
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        m = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_license_scan(spark):
    mit = licenses.TEMPLATES[1][2]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 10)
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "Released under the MIT License.\n" * 3), (3, f"begin {cut} end"), (4, "the mit of license under"), (5, None), (6, ""), (7, mit.upper()), (8, "x " * 5000 + "Licensed under CC BY-NC 4.0.")]
    got = pairs(licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "license", "kind")
    assert got == [(1, "MIT", "notice")] + [(2, "MIT", "notice")] * 3 + [(3, "MIT", "text"), (7, "MIT", "text"), (8, "CC-BY-NC-4.0", "notice")]
    span = licenses.scanned(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert rows[0][1][span.start_char : span.end_char] == "Released under the MIT License"


def test_license_lines_in_the_corpus(real):
    line = {"mit license.": "MIT", "apache license, version 2.0.": "Apache-2.0", "general public license, version 3.": "GPL-3.0", "cc by-nc 4.0.": "CC-BY-NC-4.0"}
    want = {(d, v) for d, t in texts(real) for k, v in line.items() if any(x.lower().endswith(k) and "licens" in x.lower() for x in t.split("\n"))}
    assert {(r.doc_id, r.license) for r in licenses.scanned(real).collect()} == want


# 4


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang='fr'><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<br>two</p><script>x()</script><a href='/x?a=1&amp;b=2'>l</a><!-- <a href='/no'>n</a> --></body></html>"
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nServer: s\r\n"
    record = warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://e/"), ("WARC-Date", "2020-01-01T00:00:00Z")], head.encode() + b"\r\n" + page.encode("latin-1"))
    (tmp_path / "a.warc.gz").write_bytes(record * 2)
    (tmp_path / "bad.warc").write_bytes(b"nothing")
    read = warc.read_warc(spark, str(tmp_path))
    assert read.where("error IS NOT NULL").count() == 1
    out = warc.derivatives(read.where("error IS NULL")).collect()
    assert len(out) == 4 and {r.refers_to for r in out} == {"<urn:uuid:1>"} and {r.refers_to_date for r in out} == {"2020-01-01T00:00:00Z"}
    text = next(r for r in out if r.type == "conversion")
    assert text.block == "One\ntwo\nl" and text.block_digest == warc.digest(text.block.encode()) and text.source_payload_digest == warc.digest(page.encode("latin-1"))
    meta = next(r for r in out if r.type == "metadata").block.split("\r\n")
    assert meta[:3] == ["title: A & B", "language: fr", "outlink: /x?a=1&b=2"] and "source-header: Server: s" in meta
    again = [h for r in warc.as_records(warc.derivatives(read.where("error IS NULL"))).collect() for h in warc.parse(bytes(r.record))]
    assert {h["warc-type"] for h, _ in again} == {"metadata", "conversion"} and all(int(h["content-length"]) == len(b) for h, b in again)


def test_text_after_an_unclosed_head():
    assert warc.plain_text("<html><head><title>a</title><body><p>real text</p></body></html>") == "real text"
    assert warc.plain_text("<head><title>a</title><meta x><script>'<p>'</script>bare text") == "bare text"
    assert warc.plain_text("<head><style>p{}</style></head><p>one<svg/> two <template/>three<svg><text>no</text></svg>") == "one two three"
    assert warc.plain_text("<p>one<script>never ends <p>two") == "one"


def test_warc_edges(spark):
    rows = [(1, "u", None), (None, None, ""), (1, "u", None)]
    out = warc.derivatives(warc.responses_of(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(out) == 6 and sum(r.record_id is None for r in out) == 2 and {r.block for r in out if r.type == "conversion"} == {""}


# 5


def brute_recursions(start, move, ratios, seq):
    """(log10 likelihood, begins, moves, emissions) by plain forward and backward recursions without scaling."""
    alphas, betas = [start * ratios[seq[0]]], [np.ones(len(start))]
    for x in seq[1:]:
        alphas.append((alphas[-1] @ move) * ratios[x])
    for x in reversed(seq[1:]):
        betas.append(move @ (ratios[x] * betas[-1]))
    betas, total = betas[::-1], alphas[-1].sum()
    moved, emitted = np.zeros_like(move), np.zeros_like(ratios)
    for t, x in enumerate(seq):
        emitted[x] += alphas[t] * betas[t] / total
        if t:
            moved += np.outer(alphas[t - 1], ratios[x] * betas[t]) * move / total
    return math.log10(total), alphas[0] * betas[0] / total, moved, emitted


@pytest.mark.parametrize("tokens", [1 << 20, 50, 7])
def test_recursions_are_brute_force(monkeypatch, tokens):
    """Texts longer than a slab, of equal length and of one token; slabs that are worked out again on the way back."""
    monkeypatch.setattr(hmm, "TOKENS", tokens)
    rng = np.random.default_rng(0)
    share = lambda x: x / x.sum(-1, keepdims=True)
    start, move, ratios = share(rng.random(3)), share(rng.random((3, 3))), rng.random((6, 3)) * 2 + 0.05
    seqs = [rng.integers(0, 6, n) for n in (70, 1, 5, 130, 64, 65, 2, 130, 9)]
    n, flat = np.array([len(s) for s in seqs]), np.concatenate(seqs).astype(np.int32)
    begin, likely, sums = np.cumsum(n) - n, np.zeros(len(n)), [0, 0, 0]
    for own in hmm.batches_of(n, np.arange(len(n))):
        b = hmm.Batch(flat, begin[own], n[own], ratios, start, move)
        likely[own] = b.likely()
        sums = [x + y for x, y in zip(sums, b.expected())]
    want = [brute_recursions(start, move, ratios, s) for s in seqs]
    assert likely == pytest.approx([w[0] for w in want], abs=1e-5)
    for k, got in enumerate(sums):
        assert got == pytest.approx(sum(w[k + 1] for w in want), abs=1e-3)
    paths = sum(start[p[0]] * ratios[seqs[6][0], p[0]] * move[p[0], p[1]] * ratios[seqs[6][1], p[1]] for p in np.ndindex(3, 3))
    assert likely[6] == pytest.approx(math.log10(paths), abs=1e-5)


def brute_training(rows, learn, states, least, rounds):
    """{id: score}: the whole model in plain Python over all words, by the operator's definitions."""
    texts_ = {d: t.encode().lower().split() for d, t in rows}
    c = Counter(w for d, ws in texts_.items() if learn(d) for w in ws)
    ends = sum(map(learn, texts_))
    names = [w for w, n in c.items() if n >= least]
    total, rest = sum(c.values()) + ends, sum(n for n in c.values() if n < least)
    shares = hmm.Shares(total, ends, len(c) + 1, len(names), rest)
    number = {w: k + 2 for k, w in enumerate(names)}
    n = np.array([ends, rest, *(c[w] for w in names)], float)
    p = shares.share(n)
    assert p.sum() == pytest.approx(1)
    seqs = {d: np.array([*(number.get(w, 1) for w in ws), 0]) for d, ws in texts_.items()}
    return c, names, n, p, shares, seqs, rest, len(c) - len(names)


@pytest.mark.parametrize("chunk_bytes, pairs", [(1 << 25, 500_000), (300, 40)])
def test_training_is_brute_force(spark, real, chunk_bytes, pairs):
    """All rounds over all training texts, whatever the chunks and buckets: the same scores as plain Python over whole texts."""
    rows = [(d, t[:1500]) for d, t in texts(real.where("doc_id < 25"))]
    learn = lambda d: d % 3 != 1
    c, names, n, p, shares, seqs, rest, rest_kinds = brute_training(rows, learn, 3, 4, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    factor = -np.log(np.stack([hmm._uniform(np.array([crc32(w) for w in names], np.uint64), z) for z in range(3)], axis=1))
    g = np.vstack([[n[0]] * 3, [n[1]] * 3, n[2:, None] * factor])
    start, move, total = np.full(3, 1 / 3), np.full((3, 3), 0.05) + np.eye(3) * 0.85, g.sum(0)
    for _ in range(3):
        ratios = hmm.ratio(g, total, p[:, None])
        assert (ratios * p[:, None]).sum(0) == pytest.approx(np.ones(3))  # each state gives all words together one
        sums = [brute_recursions(start, move, ratios, q) for d, q in seqs.items() if learn(d)]
        start, move, g = (sum(x[k] for x in sums) for k in (1, 2, 3))
        start, move, total = (start + 1) / (start + 1).sum(), (1 - hmm.EVEN) * (move + 1e-9) / (move + 1e-9).sum(1, keepdims=True) + hmm.EVEN / 3, g.sum(0)
    ratios = hmm.ratio(g, total, p[:, None])
    rare = lambda d, ws: sum(math.log10((c[w] + 1) / (rest + rest_kinds + 1)) for w in ws if c[w] < 4)
    want = {d: brute_recursions(start, move, ratios, q)[0] + np.log10(p[q]).sum() + rare(d, t.encode().lower().split()) for (d, t), q in zip(rows, seqs.values())}
    out = hmm.scored(df, F.col("doc_id") % 3 != 1, states=3, least=4, rounds=3, chunk_bytes=chunk_bytes, bucket_pairs=pairs)
    assert {r.doc_id: r.score for r in out.collect()} == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_language_scores(which, request):
    df = request.getfixturevalue(which)
    held = lambda d: crc32(("" if d is None else str(d)).encode()) % 7 == 2
    rows = [(d, [*t.encode().lower().split(), None]) for d, t in texts(df)]
    c = Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in rows)
    out = hmm.scored(df, queries.fold(F.col("doc_id"), 7) != 2, least=3, rounds=6).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    if which == "real":
        away = [r for r in out if held(r.doc_id)]
        assert sum(r.score for r in away) > sum(r.base_score for r in away)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_language_scores_without_training(spark, docs):
    out = hmm.scored(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in out} == {0} and {r.base_score for r in out} == {0.0}


def test_every_round_reads_all_texts(spark, monkeypatch):
    """Copies and chunks change nothing: each round's expected counts add up to all training tokens."""
    seen, whole = [], hmm.improved
    def counted(*given):
        out = whole(*given)
        seen.append(sum(np.frombuffer(bytes(r.g), "<f8").reshape(-1, 8)[3].sum() for r in out.where("part < 0").collect()))
        return out

    monkeypatch.setattr(hmm, "improved", counted)
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), F.format_string("word%d of text %d", F.col("id") % 150, F.col("id") % 150).alias("text"))
    hmm.scored(df, F.lit(True), rounds=3, chunk_bytes=5_000)
    assert seen == pytest.approx([30_000] * 3, rel=1e-4)


def test_no_texts_to_score(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, score long, chunk int")
    assert hmm.scored(empty, F.lit(True)).count() == 0 and hmm.scored(empty, F.lit(True)).schema["doc_id"].dataType.simpleString() == "string"


def test_what_is_written_is_deleted(spark, tmp_path, monkeypatch):
    """Nothing but the result stays in the shared folder."""
    monkeypatch.setattr(common, "scratch_root", lambda spark: f"file://{tmp_path}")
    hmm.scored(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"), F.lit(True), rounds=2).collect()
    permutation_index.nearest(spark.createDataFrame([(k, [1.0, float(k)]) for k in range(50)], "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["answers", "scored"] and not [t for t in spark.catalog.listTables() if t.name.startswith("cairn_")]


# 6


@pytest.mark.parametrize("which", ["docs", "real"])
def test_sentencepiece(which, request):
    df, path = request.getfixturevalue(which), P.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    all_texts = [t for _, t in texts(df)]
    assert own.cuts and own.encode(all_texts) == lib.encode(all_texts)
    ids = sentencepiece_codec.encoded(df, path)
    assert sorted(r.text for r in sentencepiece_codec.decoded(ids, path).collect()) == sorted(lib.decode(lib.encode(t)) for t in all_texts)
    assert sentencepiece_codec.round_trip(df, path).agg(F.sum("n_tokens")).first()[0] == sum(map(len, lib.encode(all_texts)))


# 7


def test_toxicity(spark, real, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    bad = ["scum", "moron", "idiot"]
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) + (f" {rng.choice(bad)}" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(900)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(made, made.select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.scored(made, model).collect()}
    away = [(got[k], y) for k, _, y in rows if crc32(str(k).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in away]) > 0.97
    assert {r.doc_id for r in toxicity.clean(made, model).collect()} == {k for k, p in got.items() if not p}
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.clean(docs, model).schema == docs.schema
    again = made.unionByName(made.where("doc_id = 1")).unionByName(made.where("doc_id = 4"))
    assert toxicity.fit(again, made.select("doc_id", "toxic")) == model
    assert toxicity.fit(made, labels.limit(0)) == {} and {r.score for r in toxicity.scored(docs, {}).collect()} == {0.0}


# 8


@pytest.mark.parametrize("n", [0, 7, 900])
def test_nearest(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    rows = [(k, x[k % max(1, n - 40)].tolist()) for k in range(n)] + [(10_000, None), (10_020, [0.0] * 16), (10_040, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = permutation_index.nearest(df, F.col("vec_id") % 20 == 0).collect()
    good = {k: np.array(v, np.float32).astype(float) for k, v in rows if k is not None and k < 10_000}
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in (k for k in good if k % 20 == 0):
        want = sorted((-float((good[q] * v).sum()), k) for k, v in good.items() if k != q)[:20]
        got = sorted(found.get(q, []))
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
        assert [(-s, k) for _, k, s in got] == sorted((-s, k) for _, k, s in got)
        assert all(s == pytest.approx(float((good[q] * good[k]).sum())) for _, k, s in got)
        hit += len({k for _, k, _ in got} & {k for _, k in want})
        total += len(want)
    assert hit >= 0.9 * total


def test_ties_and_copies(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(60)] + [(60, [0.5, 0.5])], "vec_id long, embedding array<float>")
    out = permutation_index.nearest(df, F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [k for k in range(21) if k != 20]


def test_recall_where_all_vectors_have_copies(spark):
    """Hundreds of copies of each vector don't use up the pivots."""
    x = np.random.default_rng(4).normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "base long, embedding array<double>")
    df = base.crossJoin(spark.range(200).withColumnRenamed("id", "copy")).select((F.col("copy") * 400 + F.col("base")).alias("vec_id"), "embedding")
    out = permutation_index.nearest(df, (F.col("vec_id") < 400) & (F.col("vec_id") % 8 == 0)).collect()
    want = {(q, q + 400 * c) for q in range(0, 400, 8) for c in range(1, 21)}
    assert len({(r.query_id, r.vec_id) for r in out} & want) >= 0.9 * len(want)


# 9


@pytest.mark.parametrize("which", ["docs", "real"])
def test_quality(spark, which, request):
    df = request.getfixturevalue(which)
    con = duckdb.connect()
    rows = df.select("doc_id", "text").toPandas() if which == "real" else df.where("doc_id IS NOT NULL AND doc_id NOT IN (3)").select("doc_id", "text").toPandas()
    con.register("documents", rows)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = {r[0]: r for r in con.execute(f"SELECT {', '.join(cols)} FROM ({quality.JUDGED_SQL})").fetchall()}
    got = quality.judged(df).select(*cols).collect()
    assert len(got) == df.count()
    assert all(tuple(r) == want[r.doc_id] for r in got if r.doc_id in want)
    assert quality.kept(df).schema == df.schema and quality.kept(df.limit(0)).count() == 0
    assert quality.kept(df).count() == sum(r.kept for r in got)


# 10


def brute_pieces(lib, rows):
    return {d: [*lib.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}


@pytest.mark.parametrize("which", ["docs", "real"])
def test_packing(which, request):
    df, path = request.getfixturevalue(which), P.path("word_bpe_49k.json")
    if which == "docs":
        df = df.where("doc_id IS NOT NULL AND doc_id <> 3")
    ids = brute_pieces(Tokenizer.from_file(path), texts(df))
    out = packing.packed(df, path, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids == ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, own in by_doc.items():
        assert sum(n for _, n in own) == len(ids[d])
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert set(by_doc) == set(ids)


def test_dealing_balances_cost():
    rng = random.Random(0)
    lengths = [rng.randint(1, 2000) for _ in range(600)] + [9000]
    pieces = packing.deal(lengths)
    spent = Counter()
    for _, _, n, seq, _ in pieces:
        spent[seq] += packing.cost(n)
    full = [c for s, c in spent.items() if sum(n for _, _, n, q, _ in pieces if q == s) == 4096]
    assert np.std(full) / np.mean(full) < 0.2 and len(pieces) < len(lengths) + 2 * len(spent)
    assert packing.deal([]) == [] and packing.deal([1]) == [(0, 0, 1, 0, 0)]


# pipeline


def test_pipeline_is_its_stages(spark, real):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash", "packing"]
    out = corpus_pipeline.run(spark, D)
    keep = {r.doc_id for r in quality.judged(real).where("kept").collect()}
    model = toxicity.fit(real, spark.read.parquet(f"{D}/labels.parquet"))
    keep &= {r.doc_id for r in toxicity.scored(real, model).where("predicted = 0").collect()}
    left = [(d, brute_fingerprint(t)) for d, t in texts(real) if d in keep]
    keep = {c for _, _, c in brute_components(left)}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts(real) if d in keep}
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
