"""Importance resampling, phrase collocations and host reputations against brute force, on odd and skewed rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import collocations, common, importance, queries, reputation

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_importance", "op12_collocations", "op13_reputation"])
def test_same_as_sql(spark, con, name):
    df = queries.queries()[name](spark, D)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cur.fetchall())
    assert want and sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want


# 11


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def features(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or "")) if x]
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_resampled(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, x in docs:
        n, fs = features(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = percent * len(may) // 100
    return sorted((tuple(r) + (k + 1 if k < drawn else None,) for k, r in enumerate(may)), key=str), [tuple(r) + (None,) for r in out if r[1] < least]


def odd_docs():
    rng = random.Random(3)
    words = ["Äpfel", "the", "THE", "x1", "naïve", "don't", "a_b", "日本", "of", "and"] + [f"w{k}" for k in range(60)]
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 19, 20, 25, 60])))) for k in range(150)]
    long_ = " ".join(rng.choice(words) for _ in range(40_000))
    out += [(200, None), (201, ""), (202, "\x00 \x7f -"), (203, long_), (None, "one two " * 12), (None, "one two " * 12), (5, "repeated id " * 15), (7, out[7][1]), (-4, "the " * 30)]
    return out + [(300 + k, "same words here " * 10) for k in range(80)]


@pytest.mark.parametrize("parts", [1, 7])
def test_resampling_is_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(importance, "BLOCK_ROWS", 16)
    rows = odd_docs()
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, score int, rank int").repartition(parts)
    target = ["the apples of x1", None, "", "日本 don't " * 9]
    got = importance.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    ranked, rest = brute_resampled(rows, target)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(ranked + rest, key=str)


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none).collect() == []
    few = spark.createDataFrame([("b", "one two " * 20), ("a", "three"), ("c", "one two " * 20)], "rank string, text string")
    got = importance.resampled(few, none, id_col="rank", percent=100).toDF("id", "n_words", "n_features", "weight", "score", "place").collect()
    assert {r.id: r.place is None for r in got} == {"a": True, "b": False, "c": False} and {r.id: r.n_features for r in got} == {"a": 1, "b": 79, "c": 79}


def test_blocks_are_the_matrix(spark):
    rows = [(k, x) for k, x in enumerate(["a b a", "", None, "c " * 5000])]
    got = importance.blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == 1 and got[0].ids == [0, 1, 2, 3] and got[0].words == [3, 0, 0, 5000]
    b = lambda f: zlib.crc32(f.encode()) % 10000
    assert got[0].starts == [0, 4, 4, 4, 6]
    buckets, counts = importance._numbers(pa.scalar(bytes(got[0].buckets)), 6).tolist(), importance._numbers(pa.scalar(bytes(got[0].counts)), 6).tolist()
    assert len(got[0].buckets) == 12 and len(got[0].counts) == 12  # 5,000 needs two bytes
    assert dict(zip(buckets[:4], counts[:4])) == {b("a"): 2, b("b"): 1, b("a b"): 1, b("b a"): 1}
    assert dict(zip(buckets[4:], counts[4:])) == {b("c"): 5000, b("c c"): 4999}


# 12


def brute_phrases(rows, max_n=3, least=10, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_n + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    some = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    longer = Counter()
    for k, a in some.items():
        w = k[1:]
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                at = (k[0], *w[i : i + m])
                longer[at] = max(longer[at], a)
    out = {}
    for k, a in some.items():
        if k in longer and 100 * longer[k] >= 50 * a:
            continue
        w = k[1:]
        cuts = [(10**6 * a * a // (f[(k[0], *w[:c])] * f[(k[0], *w[c:])]), c) for c in range(1, len(w))]
        score, c = min(cuts)
        out.setdefault(k[0], []).append((score, a, " ".join(w), f[(k[0], *w[:c])], f[(k[0], *w[c:])]))
    got = []
    for lang, x in out.items():
        x.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        got += [(lang, k + 1, p, a, l, r, n[lang], s) for k, (s, a, p, l, r) in enumerate(x[:top])]
    return sorted(got)


def phrase_rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "a\x01", "a", "\x00z", "z\x00", "日本", "é", "%25", "x\x1f"] + [f"w{k}" for k in range(12)]
    marks = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\x0b", "! "]
    out = [("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 90))), rng.choice(["en", "de", None, "und", "", "a%\x00b"])) for _ in range(500)]
    out += [(None, "en"), ("", None), ("one", "en"), ("the of the of " * 20_000, "en"), ("the of the of", None)]
    return out + [("the same passage of many copies, every time.", "en")] * 300


@pytest.mark.parametrize("parts,max_n,top", [(1, 3, 2000), (9, 3, 25), (5, 4, 2000)])
def test_phrases_are_brute_force(spark, monkeypatch, parts, max_n, top):
    monkeypatch.setattr(collocations, "COUNTED", 997)
    monkeypatch.setattr(collocations, "STEP", 1000)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, n int, rank int").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", 4 * parts)
    try:
        got = collocations.phrases(df, max_n=max_n, top=top)
        assert sorted(map(tuple, got.collect())) == brute_phrases(rows, max_n, top=top)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_counts_are_whole_wherever_ranges_are_cut(spark):
    """Each cut of the sorted suffixes in two gives the same sums."""
    suffixes = sorted([b"a\0en", b"a\0en\0b", b"a\0en\0b\0c", b"a\0en\0b\0d", b"a\0de\0b\0c", b"b\0en\0a", b"c\0en"], reverse=True)
    want = Counter({("en", "a"): 12, ("en", "a b"): 9, ("en", "a b c"): 3, ("en", "a b d"): 3, ("de", "a"): 3, ("de", "a b"): 3, ("de", "a b c"): 3, ("en", "b"): 3, ("en", "b a"): 3, ("en", "c"): 3, ("en", ""): 18, ("de", ""): 3})
    for at in range(0, len(suffixes) + 1):
        df = spark.sparkContext.parallelize([suffixes[:at], suffixes[at:]], 2).flatMap(lambda x: [(k.decode(), 3) for k in x]).toDF("key string, n int")
        got = Counter()
        for lang, words, n in collocations.prefix_counts(df, 4).collect():
            got[lang, words] += n
        assert got.items() <= want.items() and all(got[k] == v for k, v in want.items() if v >= 4)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 1000])
def test_the_stack_goes_on_between_batches(size):
    rng = random.Random(size)
    rows = Counter(b"\0".join([rng.choice([b"a", b"b", b"ab"]), rng.choice([b"de", b"en"]), *[rng.choice([b"a", b"b", b"ba"]) for _ in range(rng.randrange(3))]]) for _ in range(400))
    keys = sorted(rows, reverse=True)
    want = Counter()
    for k in keys:
        first, lang, *more = k.split(b"\0")
        for d in range(len(more) + 1):
            want[lang, b" ".join([first, *more[:d]])] += rows[k]
    stack = collocations.Stack(10)
    for at in range(0, len(keys), size):
        part = keys[at : at + size]
        stack.push(pa.array([k.decode() for k in part]), np.array([rows[k] for k in part], np.int64))
    stack.end()
    got = {(lang, words): n for lang, words, n in stack.found}
    edges = {(lang, b" ".join([first, *more[:d]])) for first, lang, *more in (keys[0].split(b"\0"), keys[-1].split(b"\0")) for d in range(len(more) + 1)}
    assert len(got) == len(stack.found) and got.items() <= want.items()
    assert set(got) == {k for k, n in want.items() if n >= 10} | edges
    assert stack.words_of == Counter({lang: sum(n for k, n in rows.items() if k.split(b"\0")[1] == lang) for lang in (b"de", b"en")})


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = [("en", "", 9 * 10**14), ("en", "a", 3 * 10**14 + 1), ("en", "b", 2 * 10**14 + 3), ("en", "a b", 10**14 + 7)]
    monkeypatch.setattr(collocations, "grams", lambda *a: spark.createDataFrame(big, "lang string, words string, n long"))
    (row,) = collocations.phrases(spark.createDataFrame([], "text string, lang string")).collect()
    assert row.score == 10**6 * (10**14 + 7) ** 2 // ((3 * 10**14 + 1) * (2 * 10**14 + 3)) and row.n == 9 * 10**14


def test_no_phrases(spark):
    assert collocations.phrases(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.phrases(spark.createDataFrame([(None, None), ("a b c", "en")], "text string, lang string")).collect() == []


# 13


URLS = [None, "", "no scheme", "http://", "https://COM/", "http://a.com", "http://a.com?x=/en/", "http://A.Example.COM/en/1?q#f", "http://www.example.com/en/", "http://x.www.example.com/en/a", "http://www.example.com/de/", "http://notexample.com/en/",
        "http://a.net/es/1", "http://a.net/fr", "http://net/fr/", "https://u:p@b.net:8080/fr/#x", "http://b.net:8080/de/", "ftp://x.co.uk/a", "http://y.x.co.uk/a://b/c", "a://b://c/d", "http://10.0.0.1/x", "http://a.org/ES/", "http://É.Org/ü?z", "http://net.a/es/", "http://line\nbreak.net/es/\nx"]


def brute_page(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lowered(host)
    fit = [r for r in reputation.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def brute_shares(pages):
    """Posterior mean and bound of each host."""
    unit = {}
    for host, bad in pages:
        u = unit.setdefault(host, [0, 0])
        if bad is not None:
            u[0] += 1
            u[1] += bad
    name = {h: re.sub(r"^.*@|:[0-9]*$", "", h) for h in unit}
    labels = {h: name[h].split(".") for h in unit}
    deep = {h: 2 if ".".join(labels[h][-2:]) in reputation.SUFFIXES else 1 for h in unit}
    number = {h: bool(re.match(r"[0-9.]+$", name[h])) for h in unit}
    up = {h: (name[h], name[h]) if number[h] else (".".join(labels[h][-deep[h] - 1 :]), ".".join(labels[h][-deep[h] :])) for h in unit}
    mean = {None: 0.5}
    for level in (1, 0, None):
        own, parent = {}, {}
        for h, u in unit.items():
            key = h if level is None else ("d" if level == 0 else "s") + up[h][level]
            parent[key] = None if level == 1 else "s" + up[h][1] if level == 0 else "d" + up[h][0]
            x = own.setdefault(key, [0, 0])
            x[0] += u[0]
            x[1] += u[1]
        m = {k: mean[parent[k]] for k in own}
        over = sum((b - c * m[k]) ** 2 - c * m[k] * (1 - m[k]) for k, (c, b) in own.items())
        most = sum(c * (c - 1) * m[k] * (1 - m[k]) for k, (c, b) in own.items())
        r = 1 / 3 if level == 1 else min(0.5, max(0.001, over / most if most else 0.0))
        mean |= {k: (m[k] * (1 - r) / r + b) / (c + (1 - r) / r) for k, (c, b) in own.items()}
    return {h: (mean[h], mean[h] - 1.645 * math.sqrt(mean[h] * (1 - mean[h]) / (unit[h][0] + (1 - r) / r + 1))) for h in unit}


@pytest.mark.parametrize("hot", [3, 1000])
def test_pages_are_judged_as_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(reputation, "HOT", hot)
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice(['', 'm.', 'www.'])}h{rng.randrange(9)}.{rng.choice(['example', 'other', 'd3'])}.{rng.choice(['net', 'com', 'org', 'co.uk'])}{rng.choice(['/en/', '/es/', '/fr/x', '/de/', ''])}" for _ in range(900)]
    urls += ["http://hot.example.net/de/"] * 500 + ["http://hot.example.net/es/"] * 400
    df = spark.createDataFrame([(k if k != 11 else None, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {(r.page_id, *r[1:4]): r for r in reputation.judged(df, reputation.RULES).collect()}
    pages = [brute_page(u) for u in urls]
    assert set(got) == {(k if k != 11 else None, *p[:3]) for k, p in enumerate(pages)}
    shares = brute_shares([(p[0], None if p[3] is None else int(p[3] == "block")) for p in pages])
    for k, p in enumerate(pages):
        r = got[(k if k != 11 else None, *p[:3])]
        mean, bound = shares[p[0]]
        assert abs(r.mean - mean) < 1e-9 and abs(r.bound - bound) < 1e-9
        assert r.verdict == (p[3] or ("block" if bound > 0.5 else "allow"))
    assert got[next(k for k in got if k[1] == "hot.example.net" and k[2] == "/de/")].verdict == "block"


def test_outcomes_of_the_callers_own(spark):
    """Few outcomes are shrunk to the domain's, many speak for themselves."""
    rows = [(f"http://{h}.good.net/", o) for h, os in {"a": [0] * 400, "b": [0] * 300, "c": [1], "d": [1] * 300}.items() for o in os] + [(f"http://h{k}.good.net/", 0) for k in range(50) for _ in range(20)] + [("http://e.good.net/", None)]
    df = spark.createDataFrame([(k, u, o) for k, (u, o) in enumerate(rows)], "page_id long, url string, bad int")
    known = {r.page_id: r.bad for r in df.where("bad is not null").collect()}
    outcome = F.when(F.col("id") < len(rows) - 1, F.col("url").startswith("http://c.") | F.col("url").startswith("http://d."))
    got = {r.host: r for r in reputation.judged(df, (), outcome=outcome).collect()}
    assert len(known) == len(rows) - 1 and {h: got[h].verdict for h in ("a.good.net", "c.good.net", "d.good.net", "e.good.net")} == {"a.good.net": "allow", "c.good.net": "allow", "d.good.net": "block", "e.good.net": "allow"}


def test_no_pages_no_outcomes(spark):
    assert reputation.judged(spark.createDataFrame([], "page_id long, url string"), reputation.RULES).collect() == []
    got = reputation.judged(spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string"), reputation.RULES).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    with pytest.raises(ValueError):
        reputation.rule("deny", "com/")


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(3000)] + [(None, -1)], "key string, v int")
    right = spark.createDataFrame([("hot", 2000, "h")] + [(f"k{k}", 1, f"x{k}") for k in range(0, 2000, 3)], "key string, rows int, name string")
    got = common.looked_up(left, right, "key", F.col("rows") > 100, F.col("v"))
    want = {r.key: r.name for r in right.collect()}
    rows = got.collect()
    assert len(rows) == 3001 and all(r.name == want.get(r.key) for r in rows)
