"""Cases beyond the fixtures: single bits and pairs of bits, odd marks, hostile pages, samples, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import html
import math
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import common, licenses, packing, permutation_index, quality, sentencepiece_codec, simhash, token_counts, toxicity, warc

D = "/root/testdata/sf0.001"


# 1


def centres(rng, base, free, n, taken=()):
    """n fingerprints that differ from base in free bits only, and from each other in seven or more."""
    out = list(taken)
    while len(out) < n:
        x = base ^ sum(1 << b for b in free if rng.random() < 0.5)
        if all((x ^ y).bit_count() >= 7 for y in out):
            out.append(x)
    return out


@pytest.mark.parametrize("size", [2, 24, 25, 300])
def test_every_bit_and_pair_of_bits_links(spark, size):
    rng = random.Random(size)
    flips = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    want, fps = set(), set()
    for v, m in enumerate(simhash.MASKS):
        own = [f for f in flips if not m & f and not any(not simhash.MASKS[u] & f for u in range(v))]
        free = [b for b in range(64) if not m >> b & 1]
        per = max(1, size // 3)
        for at in range(0, len(own), per):
            part = own[at : at + per]
            places = centres(rng, rng.getrandbits(64), free, size - len(part))
            pairs = [(c, c ^ f) for c, f in zip(places, part)]
            fps.update(places, (y for _, y in pairs))
            want.update(tuple(sorted(map(simhash._signed, p), reverse=True)) for p in pairs)
    assert len(want) == 2080
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    linked = {}
    for a, b in got:
        linked.setdefault(a, set()).add(b)
        linked.setdefault(b, set()).add(a)
    near = {(a, b) for a, b in got if ((a ^ b) & simhash._ALL).bit_count() <= 2}
    assert want <= near
    assert all(any(((a ^ c) & simhash._ALL).bit_count() <= 2 for c in linked[a]) for a, _ in got)


# 2


def test_prefixes_of_texts_with_marks():
    own, lib = token_counts.counter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = ["'", "'", "re", "s", "ll", "ve", " ", "  ", "\n", "<|endoftext|>", ">", "<", "a", "Z", "é", "1", "日", "😀", "\t", "the", "'re", "_", "\x1c"]
    for _ in range(10_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 7)))
        want = [len(e) for e in lib.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert own.prefix_counts(text).tolist() == want, text


def test_prefixes_of_long_texts():
    own, lib = token_counts.counter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = "a b's <|endoftext|>" * 50_000
    began = time.perf_counter()
    counts = own.prefix_counts(text)
    assert time.perf_counter() - began < 60 and counts[-1] == len(lib.encode(text, add_special_tokens=False)) == own.count(text)


def test_counts_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, id string, counts long")
    path = P.path("byte_bpe_50k.json")
    assert token_counts.token_counts(empty, path).count() == 0 and token_counts.prefix_table(empty, path).count() == 0


# 3


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_against_the_exhaustive_best():
    """Never more than the longest common subsequence, and close to it for edited notices."""
    rng = random.Random(2)
    for name, kind, text in licenses.TEMPLATES:
        words = licenses.tokens(text)[0]
        assert len(licenses.align(words, words)) == len(words)
        for _ in range(20):
            edited = [w for w in words if rng.random() > 0.08]
            for _ in range(len(words) // 12):
                edited.insert(rng.randint(0, len(edited)), rng.choice(["foo", "bar", *words]))
            got, best = len(licenses.align(edited, words)), longest_common(edited, words)
            assert 0.9 * best <= got <= best


def test_notices_that_the_exhaustive_best_covers_are_found():
    rng = random.Random(4)
    scan = licenses.Scanner().scan
    prose = "once upon a time there lived seven sailors near some harbour town".split()
    for name, kind, text in licenses.TEMPLATES:
        words = text.split()
        for _ in range(10):
            cut = [w for w in words if rng.random() > 0.06]
            around = " ".join(rng.choice(prose) for _ in range(30))
            found = list(scan(f"{around} {' '.join(cut)} {around}"))
            template = licenses.tokens(text)[0]
            if longest_common(licenses.tokens(" ".join(cut))[0], template) >= 0.86 * len(template):
                assert any(n == name for n, *_ in found), (name, kind, cut)


def test_notices_with_foreign_words_between_are_found():
    """As many foreign words as the template has, in one place or in many."""
    rng = random.Random(6)
    scan, prose = licenses.Scanner().scan, "once upon a time there lived seven sailors near some harbour town".split()
    for name, kind, text in licenses.TEMPLATES:
        words, n = text.split(), len(licenses.tokens(text)[0])
        for extra in sorted({1, n // 4, n // 2, n}):
            for places in (1, 3, extra):
                out = list(words)
                at = [rng.randint(1, len(words) - 1) for _ in range(places)] if places > 1 else [len(words) // 2]
                for k in range(extra):
                    out.insert(at[k % len(at)], rng.choice(prose))
                around = " ".join(rng.choice(prose) for _ in range(40))
                assert any(m == name for m, *_ in scan(f"{around} {' '.join(out)} {around}")), (name, kind, extra, places)
    assert any(m == "MIT" for m, *_ in scan("Released under the terms and conditions of the MIT License."))
    far = licenses.TEMPLATES[1][2].split()
    assert not list(scan(" ".join(far[:40] + prose * 30 + far[40:])))  # farther apart than a notice may be


def test_many_notices_take_linear_time():
    scan, line = licenses.Scanner().scan, "Released under the MIT License.\n"
    for text, n in ((line * 20_000, 20_000), ("mit license under " * 60_000, 0), ((line + "word " * 40) * 4000, 4000)):
        began = time.perf_counter()
        assert sum(k == "notice" for _, k, *_ in scan(text)) >= n
        assert time.perf_counter() - began < 30


def test_scan_of_an_empty_table(spark):
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string, license int")).count() == 0


# 4


@pytest.mark.parametrize("name", ["hex", "base64", "rot13", "idna", "undefined", "utf-7", "punycode", "unicode_escape", "nope", "utf-16", "utf-8-sig"])
def test_any_charset_is_read(name):
    rows = warc.derived_records("<urn:uuid:1>", "u", "d", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n", b"<p>caf\xc3\xa9 +2AA- \xff &#xD800;</p>")
    text = rows[1][-1]
    text.encode()
    if name not in ("utf-16", "utf-8-sig"):
        assert text == "café +2AA- � �"


@pytest.mark.parametrize("bad", ["<a ", "<title>", "<svg>", "<svg <svg>", "<script>", "<!--", '<a href="', "<a href='x\"", "<head>", "</a", "<template><title>", "<html lang", "href     "])
def test_hostile_pages_take_linear_time(bad):
    began = time.perf_counter()
    page = warc.Page(bad * (1_000_000 // len(bad)))
    page.text(), page.fields()
    assert time.perf_counter() - began < 5


class Reader(HTMLParser):
    """An independent reading of a page: the standard library's."""

    SKIP = {"script", "style", "noscript", "template", "svg", "head"}
    BREAK = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav main aside blockquote pre hr title form dl dt dd body".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.title, self.depth, self.in_title = [], [], None, [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (at := next((v for k, v in attrs if k == "href"), None)):  # a name's first value counts
            self.links.append(at.strip())
        if tag == "title" and self.title is None:
            self.title, self.in_title = "", True
        if tag in self.SKIP:
            self.depth.append(tag)
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        if tag in self.depth:
            self.depth.remove(tag)
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.depth:
            self.out.append(data)


def test_every_page_is_an_independent_parsers(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    got = {}
    for r in warc.derivatives(warc.responses_of(pages)).collect():
        got.setdefault(r.target_uri, {})[r.type] = r
    rows = pages.collect()
    assert len(rows) and len({r.url for r in rows}) == len(rows)
    for row in rows:
        page = row.html or ""
        own = Reader(page)
        lines = [" ".join(x.split()) for x in "".join(own.out).split("\n")]
        meta, conv = got[row.url]["metadata"], got[row.url]["conversion"]
        assert conv.block == "\n".join(x for x in lines if x)
        fields = dict.fromkeys(x.split(": ", 1)[1] for x in meta.block.split("\r\n") if x.startswith("outlink: "))
        assert list(fields) == list(dict.fromkeys(x for x in own.links if x and "\n" not in x))
        assert own.title is None or f"title: {' '.join(own.title.split())}\r\n" in meta.block
        source = "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
        for r in (meta, conv):
            data = r.block.encode()
            assert r.source_payload_digest == source and r.content_length == len(data) and r.refers_to == meta.refers_to and r.refers_to_target_uri == row.url
            assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def random_page(rng):
    """Tags with quoted, bare, repeated and odd attributes; no markup that ends nowhere."""
    value = lambda: rng.choice(['"a > b"', "'c > d'", '"e\'f"', "'g\"h'", "bare", "x/y", '""', '"&amp;"', '"<p>"'])
    out = []
    for _ in range(rng.randrange(1, 30)):
        name = rng.choice(["a", "p", "div", "b", "li", "A", "x-y", "h1"])
        own = "".join(rng.choice([" ", "  ", "\n"]) + rng.choice(["href", "data-href", "HREF", "title", "id", "x:href"]) + rng.choice(["", "=" + value(), " = " + value()]) for _ in range(rng.randrange(4)))
        out.append(f"<{name}{own}{rng.choice(['', '', ' ', ' /'])}>" + rng.choice(["one two", " ", "&lt;b&gt;", "3 < 4", ""]) + rng.choice([f"</{name}>", f"</{name} >", ""]))
    return "".join(out)


def test_random_pages_are_an_independent_parsers():
    rng = random.Random(8)
    for _ in range(1500):
        page = random_page(rng)
        own, got = Reader(page), warc.Page(page)
        lines = [" ".join(x.split()) for x in "".join(own.out).split("\n")]
        assert got.text() == "\n".join(x for x in lines if x), page
        assert [html.unescape(x).strip() for x in got.links if x.strip()] == [x for x in own.links if x], page


def test_attributes_are_whole_names_and_quotes_hold():
    page = warc.Page('<a title="a > b" href="x">link</a><a data-href="wrong" href="right">two</a><a href=bare>3</a><a href = \'q\' href=no>4</a><html xml:lang="xx" lang=\'pt-BR\'>')
    assert page.links == ["x", "right", "bare", "q"] and page.text() == "linktwo34" and page.language == "pt-BR"
    assert warc.plain_text("<a href='never closed>one</a><p>two") in ("one\ntwo", "two")


def response(body, *headers):
    return [(r[1], r[12], r[10]) for r in warc.derived_records("<urn:uuid:1>", "u", "d", "HTTP/1.1 200 OK\r\n" + "".join(h + "\r\n" for h in headers), body)]


def test_codings_types_and_charsets():
    page = "<head><title>é</title></head><p>Grüße".encode()
    zipped, chunks = gzip.compress(page), lambda data: b"".join(b"%x;ext=1\r\n%s\r\n" % (len(data[k : k + 7]), data[k : k + 7]) for k in range(0, len(data), 7)) + b"0\r\nTrailer: x\r\n\r\n"
    raw = zlib.compress(page)[2:-4]
    for body, headers in [(page, []), (zipped, ["Content-Encoding: gzip"]), (zipped + zipped[:0], ["content-encoding:  GZIP "]), (zlib.compress(page), ["Content-Encoding: deflate"]), (raw, ["Content-Encoding: deflate"]),
                          (chunks(page), ["Transfer-Encoding: chunked"]), (chunks(zipped), ["Transfer-Encoding: chunked", "Content-Encoding: gzip"]), (gzip.compress(zlib.compress(page)), ["Content-Encoding: deflate, gzip"]), (page, ["Content-Encoding: gzip"])]:
        (meta, text) = response(body, "Content-Type: text/html", *headers)
        assert text[1] == "Grüße" and meta[1].startswith("title: é\r\n") and meta[2] == text[2] == warc.digest(body), headers
    assert response(zipped[: len(zipped) - 12], "Content-Encoding: gzip")[1][1].startswith("Gr")  # cut short
    assert response(chunks(page)[:-9], "Transfer-Encoding: chunked")[1][1] == "Grüße"
    for headers, why in [(["Content-Type: image/png"], "content type image/png"), (["Content-Encoding: br"], "content coding br")]:
        (meta,) = response(b"\x89PNG", *headers)
        assert meta[1].startswith(f"not-converted: {why}\r\n")
    assert response(b"a <b>\n\n c  d", "Content-Type: text/plain")[1][1] == "a <b>\nc d"
    latin = "<meta charset='iso-8859-1'><p>Grüße".encode("latin-1")
    assert response(latin)[1][1] == "Grüße" and response(latin, "Content-Type: text/html; charset=utf-8")[1][1] == "Gr\ufffd\ufffde"
    assert response('<meta http-equiv="Content-Type" content="text/html; charset=cp1251"><p>да'.encode("cp1251"))[1][1] == "да"
    assert response(b"\xff\xfe" + "<p>ж".encode("utf-16-le"), "Content-Type: text/html; charset=latin-1")[1][1] == "ж"


def test_records_carry_the_payloads_digest(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://e/{k}", f"<p>page {k}</p>") for k in range(5)], "page_id long, url string, html string")
    derived = warc.derivatives(warc.responses_of(pages))
    want = {r.record_id: r.source_payload_digest for r in derived.collect()}
    heads = {h["warc-record-id"]: h["warc-payload-digest"] for r in warc.as_records(derived).collect() for h, _ in warc.parse(bytes(r.record))}
    assert heads == want and len(want) == 10


def test_files_are_read_as_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    one = lambda k: warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>")], b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 300, compress=k % 2 == 0)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(one(2 * k) for k in range(40)))
    (tmp_path / "b.warc").write_bytes(b"".join(one(2 * k + 1) for k in range(40)) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert {r.record_id for r in got if r.error is None} == {f"<{k}>" for k in range(80)} and [r.error for r in got if r.error] == ["a record is cut short"]
    assert {len(r.payload) for r in got if r.error is None} == {300}


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, block long")
    assert warc.derivatives(warc.responses_of(empty)).count() == 0


# 9


@pytest.mark.parametrize("parts", [8, 64])
def test_the_sample_moves_no_texts(spark, parts):
    """What leaves a task is one row of sums, however many partitions and rows there are."""
    df = spark.range(64_000).repartition(parts).select(F.concat_ws(" ", F.lit("some words and"), F.col("id")).alias("text"))
    order = quality.measured(df, quality.BASE + quality.OWN)
    assert {r.name for r, _, _ in order} == {r.name for r in quality.BASE + quality.OWN} and dict((r.name, h) for r, _, h in order)["few_words"] == 1.0
    assert order[0][0].name == "few_words"
    assert quality.kept(df).count() == 0


def test_the_sample_reads_some_files_only(spark, tmp_path):
    path = str(tmp_path / "many files")
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(40).write.parquet(path)
    docs = spark.read.parquet(path)
    some = quality.some_files(docs)
    assert 0 < some.count() < 400 and len({r[0] for r in some.select("_metadata.file_path").collect()}) == 16
    rows = lambda df: (df.collect(), int(df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()))[1]
    assert rows(some.select("text")) == 16
    assert quality.some_files(docs.repartition(3)).count() == some.count()
    assert quality.some_files(docs.groupBy("text").agg(F.min("doc_id"))).count() == 400 == quality.some_files(spark.range(400)).count()
    assert quality.measured(docs, quality.OWN, "text")[0][1] > 0


def test_empty_and_long_texts_are_judged(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert quality.judged(empty).count() == 0 and quality.kept(empty).schema == empty.schema
    long = " ".join(f"word{k}" for k in range(120_000))
    rows = [(1, long), (2, long + " word1 word2 word3"), (3, "#" * 1_000_000), (4, None)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (120_000, 0, True)
    assert (got[2].n_words, got[2].n_repeat_words, got[3].n_symbols, got[4].n_words) == (120_003, 6, 1_000_000, 0)


def test_windows_that_only_share_a_hash_are_no_repeats(spark, monkeypatch):
    """Where hashes meet, words decide."""
    from pyspark.sql import functions

    df = spark.createDataFrame([("a b c d a b c e f g",), ("a b c d e f g h",)], "t string").select(quality.words_of(F.col("t")).alias("w"))
    true = [r[0] for r in df.select(quality.n_repeat_words(F.col("w"))).collect()]
    monkeypatch.setattr(functions, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert [r[0] for r in df.select(quality.n_repeat_words(F.col("w"))).collect()] == true == [6, 0]


# shared


def test_a_cluster_must_name_its_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())


# 1 and 9


def test_long_and_clashing_rows(spark):
    long = " ".join(f"w{k}" for k in range(150_000))
    df = spark.createDataFrame([(1, long, "a", 0), (2, long + " w0", "b", 1), (3, None, "c", 2)], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert got[3].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 1
    assert simhash.one_of_each(df).columns == df.columns and {r.fp for r in simhash.one_of_each(df).collect()} == {"a", "c"}


# 6


def test_sentencepiece_digests_row_by_row(spark):
    """op6's columns are the library's for each row."""
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()] + [(-1, ""), (-2, "a  b\t▁c 😀 x" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.round_trip(df, path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in rows:
        ids = lib.encode(t)
        assert got[d] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))), d
    assert sentencepiece_codec.round_trip(df.limit(0), path).count() == 0


# 7


def test_training_is_plain_ftrl():
    """Weights and scores against FTRL-proximal written out place by place."""
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        y = rng.random() < 0.4
        at = sorted({rng.randrange(40) for _ in range(6)} | ({3, 7} if y else {11}))
        rows.append((np.array(at, np.int32), int(y)))
    z, n = [0.0] * 64, [0.0] * 64
    pos = sum(y for _, y in rows)
    bias, bias_n = math.log((pos + 0.5) / (len(rows) - pos + 0.5)), 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(30):
        for at, y in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + math.sqrt(bias_n))
    got = toxicity.trained(rows, bits=6, epochs=30)
    assert got.pop(-1) == pytest.approx(bias) and got == pytest.approx({i: weight(i) for i in range(64) if weight(i)}) and got


def test_toxicity_of_odd_texts(spark):
    model = {-1: -1.0, 5: 2.0}
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 500_000), (None, "y")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert got[1] == got[2] == pytest.approx(1 / (1 + math.e)) and 0 <= got[3] <= 1
    assert toxicity.scored(df.limit(0), model).count() == 0 and toxicity.clean(df, model).columns == df.columns


# 8


@pytest.mark.parametrize("n, d, kind", [(1500, 32, "equal"), (1500, 32, "long tail"), (6000, 32, "wide"), (6000, 64, "shifted"), (6000, 256, "equal"), (3000, 256, "clustered")])
def test_recall(spark, n, d, kind):
    """0.9 of the nearest are found whatever the vectors' lengths, middle, groups and dimensions."""
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d))
    if kind == "clustered":
        x = rng.normal(size=(60, d))[rng.integers(0, 60, n)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= {"wide": rng.uniform(0.2, 3, (n, 1)), "long tail": np.exp(0.5 * rng.normal(size=(n, 1)))}.get(kind, 1.0)
    x += 0.3 * (kind == "shifted")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    ask = F.col("vec_id") % 20 == 0
    out = permutation_index.nearest(df, ask, block_rows=500).collect()  # files are split and share blocks
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]))
    hit = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(found[q]) == 20 == len(set(found[q])) and q not in found[q]
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(found[q]))
    assert hit >= 0.9 * 20 * len(found)


def test_trial_answers_are_exact(spark):
    x = np.random.default_rng(0).integers(-2, 3, (300, 4)).astype(float)  # many ties
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(5)
    asked = x[:3]
    assert permutation_index.exact(rows, asked, 7) == [sorted(range(300), key=lambda k: (-float(x[k] @ q), k))[:7] for q in asked]


def test_vectors_that_are_all_the_middle(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(30)], "vec_id long, embedding array<double>")
    out = permutation_index.nearest(df, F.col("vec_id") == 3).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [k for k in range(21) if k != 3]
    huge = spark.createDataFrame([(k, [1e308 * (1 - k % 3), 1e300 * k]) for k in range(1, 40)], "vec_id long, embedding array<double>")
    assert permutation_index.nearest(huge, F.col("vec_id") == 0).collect() == []


def test_a_query_opens_a_falling_share_of_files():
    pivots = [max(permutation_index.LEAST_PIVOTS, math.ceil(permutation_index.PIVOTS_A_ROOT * math.sqrt(n))) for n in (2_000, 50_000, 1_000_000)]
    share = [permutation_index.opened_files(p) / p for p in pivots]
    assert share[0] > share[1] > share[2] and share[2] < 0.2


# 10


def test_what_fits_is_hardly_cut(spark):
    """In batches with a spare sequence nothing that fits a window is cut, and little is padded."""
    rng = random.Random(3)
    lengths = [min(9000, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(4000)]
    pieces = packing.deal(lengths)
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in pieces:
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    assert sum(lengths) // 4096 >= 256
    assert not [d for d, p in by_doc.items() if len(p) > 1 and lengths[d] <= 4096]
    for d, p in by_doc.items():
        assert sorted(p)[0][0] == 0 and sum(n for _, n in p) == lengths[d]
    for p in by_seq.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by_seq) * 4096 - sum(lengths) < 2 * 4096


@pytest.mark.parametrize("windows, most_cut", [(0.5, 12), (20, 30), (130, 30), (254, 0), (256, 0), (1000, 0)])
def test_one_rule_for_every_size(windows, most_cut):
    """Padding stays below one in a hundred tokens and two windows; what fits is cut in small batches only."""
    rng = random.Random(5)
    lengths = []
    while sum(lengths) < windows * 4096:
        lengths.append(min(9000, int(rng.lognormvariate(5.5, 1.3)) + 1))
    pieces, by_doc, by_seq = packing.deal(lengths), {}, {}
    for d, s, n, q, _ in pieces:
        by_doc.setdefault(d, []).append((s, n))
        by_seq[q] = by_seq.get(q, 0) + n
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in by_seq.values())
    assert max(by_seq.values()) <= 4096 and padding <= min(sum(lengths) / 100, 2 * 4096)
    for d, p in by_doc.items():
        at = 0
        for s, n in sorted(p):
            assert s == at
            at += n
        assert at == lengths[d]
    assert sum(len(p) > 1 and lengths[d] <= 4096 for d, p in by_doc.items()) <= most_cut


def test_sequences_do_not_depend_on_input_partitions(spark):
    docs, path = spark.read.parquet(f"{D}/documents.parquet"), P.path("word_bpe_49k.json")
    one, seven = (sorted(map(tuple, packing.packed(docs.repartition(n), path).collect())) for n in (1, 7))
    assert one == seven


def test_batches_of_a_task(spark):
    """Batches hold all documents once, whatever their bound; ids are those of the library."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").repartition(3)
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    for bound in (500, 20_000):
        got = {}
        for r in packing.packed(docs, path, batch_tokens=bound, with_ids=True).collect():
            got.setdefault(r.doc_id, []).append((r.start, r.ids))
        assert {d: [i for _, x in sorted(p) for i in x] for d, p in got.items()} == want
    assert packing.packed(docs.limit(0), path).count() == 0
