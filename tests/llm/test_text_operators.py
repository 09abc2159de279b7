"""SimHash (7), secrets (4), quality (5), mixing (8), languages (9): brute force, odd rows, accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import language_id, mixture, quality, secret_scan, simhash
from paperloom.llm.components import connected_components
from tests.llm.conftest import DOCS, lorem

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = ([" ".join(w)] if w else []) if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for t in (None, "", "One", "a b c", "A b\tc\x0bd e", lorem(4, 300), "É é É é É", "x " * 70_000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 3, 4, 6])
def test_forest_equals_brute_force(radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(150):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 8)):
            x ^= 1 << b
        prints.append(x)
    n = len(prints)
    a, b = simhash.forest(np.array(prints, dtype=np.uint64), np.arange(1, n + 1), np.full(n, n), radius)
    label = list(range(n))
    for i, j in zip(a, b):
        label[i] = j
    assert label == plain_components(prints, radius)


@pytest.mark.parametrize("tile", [4096, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    """Also with groups cut into tiny tiles, and with other numbers of blocks."""
    monkeypatch.setattr(simhash, "TILE", tile)
    if tile == 7:
        monkeypatch.setattr(simhash, "blocks_for", lambda n, radius: radius + 2)
    rng = random.Random(9)
    texts = [lorem(s, 100) for s in range(30)]
    for s in range(60):
        w = texts[s % 10].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(df).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i] for i in range(len(texts))] == [(format(p, "016x"), c) for p, c in zip(prints, plain_components(prints, 4))]


def test_near_duplicate_rows(spark, odd_docs, clashing, monkeypatch):
    got = simhash.near_duplicates(clashing)
    assert got.columns == ["doc_id", "fp", "root_fp", "component_id"] and got.count() == odd_docs.count()
    assert simhash.query(odd_docs.limit(0)).count() == 0
    monkeypatch.setattr(simhash, "HOT", 2)  # copies by broadcast
    hot = simhash.near_duplicates(odd_docs)
    assert sorted(map(str, hot.collect())) == sorted(map(str, got.collect()))


@pytest.mark.parametrize("radius", [0, 7, 28, 29, 40])
def test_two_word_fingerprints(radius):
    """Lanes within any radius, of fingerprints of 128 bits, against counting."""
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(90)]
    prints += [x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 60))) for x in prints]
    limbs = np.array([[x & (1 << 64) - 1, x >> 64] for x in prints], dtype=np.uint64)
    planes, words = simhash.bit_planes(limbs), -(-len(prints) // 64)
    row, word = np.repeat(np.arange(len(prints)), words), np.tile(np.arange(words), len(prints))
    lanes = np.full(len(row), ~np.uint64(0))
    lanes[word == words - 1] = np.uint64((1 << len(prints) % 64) - 1)
    at, alive = simhash.close_lanes(planes, limbs[row], word, lanes, radius)
    got = {(int(row[k]), int(word[k]) * 64 + b) for k, x in zip(at, alive) for b in range(64) if int(x) >> b & 1}
    assert got == {(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints) if (x ^ y).bit_count() <= radius}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(5, 5), (None, 3), (130, 129), (7, 6)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 131), 100)}


def plain_spans(text):
    found = []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, p, least, group in ((0, assign, 8, 2), (1, re.compile("AKIA[A-Z0-9]+"), 16, 0), (2, re.compile("[0-9a-f]+"), 32, 0)):
        found += [(kind, m.start(), m.end()) for m in p.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_brute_force():
    rng = random.Random(3)
    parts = ["password", "ToKeN", "ſecret", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef" * 2, "deadbeef", "x.y/z=", "é", "\n", "abcdefgh"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secret_scan.base_spans(t) == plain_spans(t), t


def test_markov_model_on_held_out_strings():
    words = {w for s in range(20) for w in secret_scan.ordinary_words(lorem(s, 200))}
    model = secret_scan.MarkovRatio.train(*secret_scan.labelled_strings(words, n=4000))
    ordinary, secret = secret_scan.labelled_strings(words, seed=99, n=2000)
    assert sum(map(model.is_secret, ordinary)) / 2000 < 0.01
    assert sum(map(model.is_secret, secret)) / 2000 > 0.9
    assert sum(model.is_secret(s[:16]) for s in ordinary) / 2000 < 0.01
    assert sum(model.is_secret(s[:18]) for s in secret) / 2000 > 0.7
    beside = "0123456789abcdef" * 2 + "/Zk8qPx2LvW9tRb4NcYh7Qd"  # what the hex match leaves of a run
    assert secret_scan.shown(secret_scan.all_spans(beside, model)[1]) == "hex:0:32,markov:32:55"
    text = "see Zk8qPx2LvW9tRb4NcYh7Qd in therenorthquaylightsmorning"
    assert secret_scan.shown(secret_scan.all_spans(text, model)[1]) == "markov:4:26"


def test_scan_and_redact_rows(odd_docs, clashing):
    rows = {r["doc_id"]: r for r in secret_scan.query(odd_docs).collect()}
    assert (rows[9]["n_assign"], rows[9]["n_access"], rows[9]["n_hex"]) == (1, 1, 0) and rows[9]["spans"].startswith("assign:0:21,access:26:46")
    out = secret_scan.redact(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[9] == "password = [SECRET] and [SECRET]" and texts[4] is None and texts[5] == ""
    assert secret_scan.query(odd_docs.limit(0)).count() == 0
    assert secret_scan.redacted("abcdef", [(2, 1, 3), (2, 2, 4)]) == "a[SECRET]ef"


def plain_counts(t):
    w = WORD.findall(t or "")
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(three)
    inside = {k for i, x in enumerate(three) if c[x] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "x " * 500, " \n\t\n", "a\n\na\n a", "é#*|<> b", lorem(5, 3000)]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "c ", "\x0b", "\r", "#", "\x1c"]) for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[s] for s in quality.STATS) for r in quality.with_counts(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_counts(t), t


@pytest.fixture(scope="module")
def judged_docs(spark):
    """Clean prose in two groups, one with a third of other texts, and two kinds of junk."""
    rows = [(i, lorem(i, 60 + i % 200), "en", "big" if i % 3 else "small", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in lorem(i, 100).split()), "en", "big", 1) for i in range(40)]
    rows += [(2000 + i, "1234567890" * 3 + " " + " ".join("x" * 30 + str(k) for k in range(100)), "en", "small", 1) for i in range(10)]
    return spark.createDataFrame(rows, DOCS)


def test_quality_verdicts(judged_docs):
    got = {r["doc_id"]: r for r in quality.query(judged_docs).collect()}
    clean = [got[i] for i in range(400) if not got[i]["base_failed"]]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.995
    assert not any(got[i]["kept"] for i in (*range(1000, 1040), *range(2000, 2010)))
    assert all(not r["kept"] for r in got.values() if r["base_failed"])


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.D)) @ rng.normal(size=(quality.D, quality.D))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{n} double" for n in quality.X))
    factors = quality._cholesky(quality._moments(df))
    got = np.array([r["d2"] for r in quality._distance(df.coalesce(1), factors).collect()])
    cov = np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOOR))
    d = x - x.mean(axis=0)
    assert np.allclose(np.sort(got), np.sort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)), rtol=1e-3)


def test_small_groups_are_judged_by_larger_ones(spark):
    """Junk of a rare source, a rare language and no language, each beside a clean document of its kind."""
    rows = [(i, lorem(i, 60 + i % 200), "en", "big", 1) for i in range(150)]
    kinds = [("en", "rare"), ("en", None), ("xx", "big"), (None, "rare")]
    rows += [(1000 + k, " ".join(w + "###" for w in lorem(k, 100).split()), *kind, 1) for k, kind in enumerate(kinds)]
    rows += [(2000 + k, lorem(500 + k, 100), *kind, 1) for k, kind in enumerate(kinds) if k != 1]
    got = {r["doc_id"]: r["kept"] for r in quality.query(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[1000 + k] for k in range(4)) and all(got[2000 + k] for k in (0, 2, 3))


def plain_mcd(x):
    """(mean, covariance with floors) of a group by the module's rules, in numpy: three starts, the least determinant, to the end."""
    floor = np.array(quality.FLOOR)
    grid = lambda v: (np.sort(np.minimum(np.floor(v * 1024), 1 << 14), axis=0)[(len(v) - 1) // 2] + 0.5) / 1024
    bins = lambda d: np.floor(np.log2(np.clip(d, 1e-6, 1e6)) * quality.BINS)

    def nearest(d, share):
        b = bins(d)
        return x[b <= np.sort(b)[int(np.ceil(share * len(b))) - 1]]

    def fit(y):
        m = y.mean(axis=0)
        return m, (y - m).T @ (y - m) / len(y) + np.diag(floor**2)

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    a = np.abs(x - grid(x))
    z = (a / np.maximum(1.4826 * grid(a), floor)) ** 2
    starts = []
    for d in (z.sum(axis=1), ((a / floor) ** 2).sum(axis=1), z.max(axis=1)):
        f = fit(nearest(d, 0.5))
        for _ in range(quality.FIRST):
            f = fit(nearest(distance(*f), quality.COVERED))
        starts.append(f)
    volume = lambda f: np.log(np.linalg.det(f[1])) / 2
    best = min(starts, key=volume)
    for _ in range(quality.MOST_STEPS):
        new = fit(nearest(distance(*best), quality.COVERED))
        if volume(new) >= volume(best) - quality.LEAST_GAIN:
            break
        best = new
    return distance(*best)


def test_verdicts_equal_a_plain_mcd(spark):
    """Per language and source, and a tiny source by its whole large language."""
    rng = random.Random(3)
    junk = lambda t, k: " ".join(w + "#" * rng.randint(0, k) for w in t.split())
    rows = [(i, junk(lorem(i, 60 + i % 90), i % 23 // 20), "en", "ab"[i % 2], 1) for i in range(240)]
    rows += [(1000 + i, junk(lorem(i, 80), 4), "en", "tiny" if i < 5 else "a", 1) for i in range(25)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in quality.query(docs).collect()}
    vectors = quality.with_counts(docs).select("doc_id", "lang", "source", *[v.alias(x) for v, x in zip(quality._vector(), quality.X)])
    fine = [r for r in vectors.collect() if not got[r["doc_id"]]["base_failed"]]
    for source, members in (("a", "a"), ("b", "b"), ("tiny", None)):
        group = [r for r in fine if members in (None, r["source"])]
        d2 = plain_mcd(np.array([[r[x] for x in quality.X] for r in group]))
        for r, d in zip(group, d2):
            if r["source"] == source and abs(d - quality.CUTOFF) > 1e-3:
                assert got[r["doc_id"]]["kept"] == (d <= quality.CUTOFF), (r, d)
    assert not any(got[1000 + i]["kept"] for i in range(25))


def test_quality_rows(odd_docs, clashing):
    out = quality.query(odd_docs)
    assert out.count() == odd_docs.count()
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and kept.where("text is null").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert quality.query(odd_docs.limit(0)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: most * sizes[s] for s in over}


def test_targets_equal_brute_force(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 12):
        sizes = {f"s{k}": rng.choice([0, 1, 10, 1000, 50_000]) + 1 for k in range(n)} | {None: 77}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixture.targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mix_rows(spark, odd_docs, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, lorem(i, 5 + i % 40), "en", "abc"[min(i % 7, 2)], 1) for i in range(900)] + [(3, "x", "en", None, 1)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    got = mixture.mix(docs, labels).collect()
    assert len(got) == len(rows)
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6
    again = sorted((r["doc_id"], r["taken"]) for r in mixture.mix(docs.repartition(7), labels).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in got)
    out = mixture.apply_mix(docs, labels)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in _passes(got).items() if n})
    assert mixture.mix(odd_docs.limit(0), labels).count() == 0
    odd = mixture.apply_mix(clashing, labels)
    assert odd.columns == clashing.columns and odd.where("text is null or text = ''").count() == 0


def _passes(got):
    n = Counter()
    for r in got:
        n[r["doc_id"]] += r["passes"]
    return n


def test_language_id(spark, odd_docs):
    texts = {"en": "the ships were moored near the old quay and their lights stayed on", "de": "die schiffe lagen am alten kai und ihre lichter blieben an",
             "fr": "les navires étaient amarrés près du vieux quai et leurs feux restaient allumés"}
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lang = list(texts)[i % 3]
        w = texts[lang].split()
        rows.append((i, " ".join(rng.choice(w) for _ in range(25)), lang, "a", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language_id.query(docs).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i, r in sorted(got.items()) if r["held_out"]] == held
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r for r in language_id.query(odd_docs).collect()}
    assert odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[6]["lang_pred"] == "und" and odd[1]["lang_pred"] in ("en", "fr")
    assert language_id.query(odd_docs.limit(0)).count() == 0
    space = language_id.space()
    codes, counts = space.trigrams("Ab, ab")
    direct = sum(int(n) * space.vectors(np.array([c]))[0].astype(int) for c, n in zip(codes, counts))
    assert np.array_equal(space.bundle(codes, counts), direct)


def test_no_languages(spark, odd_docs):
    out = language_id.query(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in out.collect()} == {"und"}


def test_languages_in_blocks(spark, odd_docs, clashing, monkeypatch):
    protos = {f"l{k}": list(np.random.default_rng(k).normal(size=language_id.DIMENSIONS)) for k in range(7)} | {"l0copy": None}
    protos["l0copy"] = protos["l0"]
    one = [tuple(r) for r in language_id.predict(odd_docs, protos, keep=["doc_id"]).collect()]
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 2)
    again = [tuple(r) for r in language_id.predict(odd_docs, protos, keep=["doc_id"]).collect()]
    assert [r[:2] for r in again] == [r[:2] for r in one] and [r[2] for r in again] == pytest.approx([r[2] for r in one])
    out = language_id.predict(clashing, protos)
    assert out.columns.count("lang_pred") == 1 and [r["lang_pred"] for r in out.collect()] == [r[1] for r in one]
