"""Phrase mining, URL filters and centroid clustering against brute force."""

import collections
import hashlib
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from batchtally.llm import centroids, phrases, url_filter

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Occurrences of all n-grams by (lang, words)."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    return f, n


def mined(rows, least, shown):
    f, n = counted(rows)
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        longer = [(x, c) for (g, x), c in f.items() if g == lang and len(x) > len(w) and c >= least]
        if any(x[i : i + len(w)] == w and 100 * c >= 80 * a for x, c in longer for i in range(len(x) - len(w) + 1)):
            continue
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right, n[lang]))
    out.sort()
    rank, kept = collections.Counter(), []
    for lang, score, a, w, left, right, total in out:
        rank[lang] += 1
        if rank[lang] <= shown:
            kept.append((lang, rank[lang], w.decode(), -a, left, right, total, -score))
    return kept


TEXTS = [
    ("en", "New York is big. New York is old, new  york\tis far; the new york Times\nnew york"),
    ("en", "a a a a a a a a b"),
    ("en", "É é É é Ünder ÜNDER a. b a: b a; b a"),
    (None, "no lang here no lang here no lang"),
    ("und", "no lang here"),
    ("fr", None),
    ("fr", ""),
    ("de", " \t\x0b.,;"),
    ("xx", "same same"),
] + [("rep", "one two three four five")] * 3


def test_phrases(spark):
    frame = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(TEXTS)], "doc_id int, text string, lang string, rank string")
    for least, shown in ((2, 2000), (3, 4)):
        got = [tuple(r) for r in phrases.collocations(frame.repartition(3), least=least, shown=shown).collect()]
        assert sorted(got) == sorted(mined(TEXTS, least, shown))
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_ngrams_of_cut_texts(monkeypatch):
    """Blocks shorter than a text count every n-gram once."""
    texts = [*TEXTS, ("en", "w1 w2  w3. w4 w5 w6 w7 w8 w9, w10 w11 " * 5)]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in texts]), pa.array([x[1] for x in texts])], ["lang", "text"])
    for size in (1, 2, 3, 5, 1 << 20):
        monkeypatch.setattr(phrases, "BLOCK", size)
        monkeypatch.setattr(phrases, "VOCABULARY", 4)
        found = collections.Counter()
        for block in phrases.blocks(iter([batch])):
            for n, at, h in block.grams():
                place, count = phrases._exact(block, n, at, h)
                for p, c in zip(place, count, strict=True):
                    found[block.names[block.langs[p]], tuple(block.words.words[i].decode() for i in block.ids[p : p + n])] += int(c)
        assert found == counted(texts)[0]


def test_equal_hashes_are_told_apart():
    words = phrases.Words()
    ids = np.array([words[w] for w in (b"a", b"b", b"a", b"c")] + [0])
    block = phrases.Block(ids, np.zeros(5, dtype=np.int64), ["en"], words, ids == 0)
    place, count = phrases._exact(block, 1, np.arange(4), np.zeros(4, dtype=np.uint64))
    found = collections.Counter()
    for p, c in zip(place, count, strict=True):
        found[words.words[ids[p]]] += int(c)
    assert found == {b"a": 2, b"b": 1, b"c": 1}


def test_misra_gries_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    keys = (rng.zipf(1.3, 200_000) % 60_000).astype(np.uint32)
    summary = phrases.MisraGries(len(keys), 50)
    for at in range(0, len(keys), 7000):  # summaries of parts, merged as they come
        k, n = np.unique(keys[at : at + 7000], return_counts=True)
        summary.add(k, n)
        summary.merge()
        assert len(summary.keys) <= summary.capacity == 4001
    assert 0 < summary.error < 50
    k, n = np.unique(keys, return_counts=True)
    assert set(k[n >= 50]) <= set(summary.survivors())


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    slots = 64
    for most in (64, 1 << 20):  # also where a slot's share is used up
        bits = {}
        for s in range(1, slots):
            rest = (h[h >> np.uint64(58) == s] << np.uint64(6) >> np.uint64(32)).astype(np.uint32)
            bits[s] = phrases.slot_filter(rest, most).tobytes()
        found = phrases.Filter(slots, bits)
        assert found.passes(h[h >> np.uint64(58) > 0]).all() and not found.passes(h[h >> np.uint64(58) == 0]).any()
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert found.passes(other).mean() < 0.02


URLS = [
    None, "", "no scheme/es/", "http://", "http://example.org", "http://example.org/es/x", "https://a.EXAMPLE.org/en/12?x", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a#b", "http://x.com/FR/", "ftp://a?b://c.org/", "http://org/", "http://a.org./es/",
    "http://a.b.casino-win.net/p", "http://casino.org/", "http://casinos.net/", "http://u@x.com:80/de/", "http://x.com?/de/", "a://b://example.org/es/",
    "http://x.com/de/a#b", "http://Ü.org/é/", "http://" + "a." * 300 + "com/de/" + "x" * 5000,
]


def by_hand(url, rules, words):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(A_Z)
    fits = [(-len(h + p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, min(fits)[2], min(fits)[3]
    return host, path, None, "block" if set(re.split("[^a-z0-9]+", host)) & set(words) else "allow"


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id int, url string, verdict string, host string")
    rules = [*url_filter.RULES, ("com", "/de/", "block"), ("x.com", "/fr/", "block"), ("x.com", "/fr/", "allow"), ("net", "", "allow"), ("x.com:80", "/", "block")]
    frame = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "allow")], url_filter.RULE_SCHEMA)
    for most in (url_filter.MAX_BITS, 1):  # the cascade, and the join beyond its bound
        for given, words in ((rules, url_filter.HOST_WORDS), ([], [])):
            found = url_filter.judged(pages, frame if given else frame.limit(0), words, max_bits=most)
            got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
            assert got == {i: by_hand(u, given, words) for i, u in enumerate(URLS)}
    kept = url_filter.kept_pages(pages, frame, url_filter.HOST_WORDS)
    assert kept.columns == pages.columns
    assert {r["page_id"] for r in kept.collect()} == {i for i, u in enumerate(URLS) if by_hand(u, rules, url_filter.HOST_WORDS)[3] == "allow"}
    assert url_filter.judged(pages.limit(0), frame).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(6000).selectExpr("cast(id as string) as key")
    listed = spark.range(0, 9000, 7).selectExpr("cast(id as string) as key")  # some stand in no URL
    cascade = url_filter.build_cascade(universe, listed)
    assert len(cascade.levels) > 2 and sum(bits for _, bits, _ in cascade.levels) < 6000 * 3
    found = {r["key"] for r in universe.filter(cascade.member(universe["key"])).collect()}
    assert found == {str(i) for i in range(0, 6000, 7)}


def lloyd(rows, k, rounds, seed=2):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), *v, nearest(v)[1]) for i, v in kept), c


@pytest.mark.parametrize("spread", [0.02, 1.0, 30_000.0])  # many ties; ordinary; beyond what doubles hold exactly
def test_clusters(spark, spread):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(6, 4)) * spread * 4
    rows = [(i, (middles[i % 6] + rng.normal(size=4) * spread).tolist()) for i in range(300)]
    rows += [(300 + i % 3, rows[0][1]) for i in range(60)]  # repeated vectors and ids
    rows += [(None, rows[5][1]), (400, None), (401, [1.0, None, 1.0, 1.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (404, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id int, embedding array<double>, c string").repartition(3)
    for k, rounds in ((8, 5), (3, 1)):
        found, c = centroids.clustered(frame, size=4, k=k, rounds=rounds)
        want, middle = lloyd(rows, k, rounds)
        assert c.tolist() == middle
        assert sorted((str(r["vec_id"]), *r["v"], r["c"]) for r in found.collect()) == want


def test_clusters_of_few_rows(spark):
    frame = spark.createDataFrame([(1, [0.5] * 4), (1, [0.5] * 4), (2, [-0.5] * 4)], "vec_id int, embedding array<float>")
    found, c = centroids.clustered(frame, size=4, k=40)
    assert len(c) == 3 and found.count() == 3
    assert centroids.clustered(frame.limit(0), size=4)[0].count() == 0
    with pytest.raises(Exception, match="are not clustered"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 4)], "vec_id int, embedding array<float>"), size=4)


def test_drift_is_tightened_and_bounds_hold():
    rng = np.random.default_rng(0)
    tighter = []
    for _ in range(150):
        dim = int(rng.integers(2, 6))
        old = rng.normal(size=(4, dim)) * 10
        new = old + rng.normal(size=(4, dim)) * rng.choice([0.1, 1, 5])
        radius = np.abs(rng.normal(size=4)) * rng.choice([0.3, 3, 10])
        bound, drift = centroids.gain_bound(radius, old, old, new), np.linalg.norm(new - old, axis=1)
        for i in range(4):
            x = rng.normal(size=(500, dim))
            x = old[i] + x / np.linalg.norm(x, axis=1)[:, None] * radius[i] * rng.choice([1, 0.99, 0.5], size=(500, 1))
            gain = np.linalg.norm(x[:, None] - old[None], axis=2) - np.linalg.norm(x[:, None] - new[None], axis=2)
            assert (gain.max(axis=0) <= bound[i]).all()
        tighter.append((bound < 0.9 * drift[None, :]).mean())
    assert np.mean(tighter) > 0.3


def test_settled_vectors_are_not_scanned():
    rng = np.random.default_rng(1)
    old = rng.integers(-1000, 1000, (10, 8))
    v = (old[rng.integers(0, 10, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    a, upper, lower = centroids.scan(v, old)
    new = old + rng.integers(-5, 6, old.shape)
    o, n = old.astype(float), new.astype(float)
    radius = np.zeros(10)
    np.maximum.at(radius, a, upper)
    gains = centroids.gain_bound(radius, o, o, n)
    np.fill_diagonal(gains, -np.inf)
    found, _, _, scanned = centroids.settle(v, a, upper, lower, new, np.linalg.norm(n - o, axis=1), gains.max(axis=1), np.zeros(10))
    assert (found == centroids.squared(v, new).argmin(axis=1)).all() and scanned < 300


class _Task:
    """Stands for a table; gives the function a task runs."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_a_task_of_phrases_holds_little():
    words = np.random.default_rng(1).integers(0, 30_000, 1_100_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(f"w{x}" for x in words)])], ["lang", "text"])
    tracemalloc.start()
    mass = sum(sum(b.column("mass").to_pylist()) for b in phrases.summaries(_Task(), 64)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert mass == 4 * len(words) - 6
    assert peak < 150e6  # 239 MB with a million words at once and all n-grams together
