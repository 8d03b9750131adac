"""Importance resampling, language profiles and whitening against plain Python and numpy."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import feast, importance, language, whitening


def plain_resample(rows, target, percent, least, seed, buckets, lowest, highest):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(lowest, highest + 1) for i in range(len(w) - n + 1)]
    place = lambda f: crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in grams(words(x)):
            s[place(f)] += 1
    for x in target:
        for f in grams(words(x)):
            t[place(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        g = [gain[place(f)] for f in grams(words(x))]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    best = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(best[: len(best) * percent // 100]):
        r[4] = k + 1
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted((tuple(r[:5]) for r in out), key=key)


@pytest.mark.parametrize("lowest,highest,piece", [(1, 1, 1 << 20), (1, 3, 1 << 20), (2, 3, 40)])
def test_resample_equals_plain_python(spark, monkeypatch, lowest, highest, piece):
    monkeypatch.setattr(importance, "PIECE_CHARS", piece)
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma9", "éa", "日本語", "X", "y", "zeta", "foo_bar", "it's", "A.B", "😀x"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "alpha beta " * 30), (500, None), (501, ""), (502, " .\x00"), (503, "w" * 5000), (7, rows[7][1]), (8, "Beta " * 40), (8, "Beta " * 40)]
    target = ["alpha beta gamma9", None, "", "alpha alpha"]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, score long, kept string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, keep=["score", "kept"], percent=25, least_words=10, buckets=50, lowest=lowest, highest=highest)
    assert got.columns == ["doc_id", "kept", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.drop("kept").collect()), key=key) == plain_resample(rows, target, 25, 10, 2024, 50, lowest, highest)


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.resample(none, docs).count() == 0
    assert [tuple(r) for r in importance.resample(docs, none, percent=100).select("n_features", "rank").collect()] == [(60, 1)]
    assert [r.rank for r in importance.resample(docs, docs, percent=0).collect()] == [None]


def test_hypervectors_equal_their_definition():
    space = language.Hypervectors(dims=64, gram=3, seed=5)
    texts = ["Abc ab!", "", None, "12 .", "éà" * 5, "x"]
    got, has = space.vectors(texts)
    for text, v, letter in zip(texts, got, has):
        plain = "".join(c.lower() if c.isalpha() else " " for c in text or "")
        line = " " + " ".join(plain.split()) + " " if plain.split() else ""
        want = np.zeros(64)
        for i in range(len(line) - 2):
            want += np.roll(space.letter(ord(line[i])), 2) * np.roll(space.letter(ord(line[i + 1])), 1) * space.letter(ord(line[i + 2]))
        assert letter == any(c.isalpha() for c in text or "") and (v == want).all()


def test_parts_and_blocks_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de.") for _ in range(rng.randint(0, 400))) for _ in range(20)]
    whole, _ = language.Hypervectors(dims=32).vectors(texts)
    monkeypatch.setattr(language, "PIECE_CHARS", 7)
    monkeypatch.setattr(language, "BLOCK_GRAMS", 5)
    assert (language.Hypervectors(dims=32).vectors(texts)[0] == whole).all()


def test_languages_of_held_out_rows(spark):
    rng = random.Random(2)
    words = {"aa": "kala toma pilu sena mika".split(), "bb": "strong thick blunt grasp twelve".split(), "cc": "ñandú œuvre être déjà août".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 40))), lang, 0.5) for i in range(300) for lang in [rng.choice(list(words))]]
    rows += [(900, None, "aa", 0.5), (901, "", "bb", 0.5), (902, "12 34!", "cc", 0.5), (903, "kala toma", None, 0.5), (None, "strong", "bb", 0.5), (904, "kala " * 300_000, "aa", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.fit(docs)
    assert model.languages == ("aa", "bb", "cc")
    got = language.identify(docs, model, score="score").collect()
    assert docs.columns[:3] + ["lang_pred", "score"] == list(got[0].asDict())
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.lang:
            assert r.lang_pred == r.lang
    assert language.identify(docs.limit(0), model).count() == 0
    blank = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, blank).collect()} == {"und"}
    again = language.fit(docs.repartition(7))
    assert (again.vectors == model.vectors).all()


def test_learning_never_sees_held_out_rows(spark):
    rows = [(i, "only here" if crc32(str(i).encode()) % 5 == 0 else "or there", "xx" if crc32(str(i).encode()) % 5 == 0 else "yy") for i in range(200)]
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ("yy",)


def test_inertia_and_contours():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 60):
        b = rng.standard_normal((n, n))
        s = (b + b.T) / 2
        for shift in (-1.0, 0.0, 0.7):
            assert feast.above(s, shift) == (np.linalg.eigvalsh(s) > shift).sum()
    cases = [np.cov(rng.standard_normal((64, 900))), np.diag([5.0] * 10 + [1.0] * 2), np.diag(10.0 ** np.arange(-3, 5)), np.diag([1 + 1e-9 * i for i in range(40)] + [0.5]), np.array([[4.0]])]
    for a in cases:
        for k in (1, 8, len(a)):
            values, q = feast.largest(a, k)
            assert len(values) == min(k, len(a))
            assert np.abs(values - np.linalg.eigvalsh(a)[::-1][: len(values)]).max() <= 1e-12 * values[0]
            assert np.abs(a @ q - q * values).max() <= 1e-12 * values[0] and np.abs(q.T @ q - np.eye(len(values))).max() < 1e-12
    assert len(feast.largest(np.zeros((3, 3)), 2)[0]) == 0 and len(feast.largest(np.ones((6, 6)), 4)[0]) == 1


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 12)) * np.arange(1, 13)
    rows = [(i, [float(c) for c in v], 3) for i, v in enumerate(x)]
    odd = [(900, None, 3), (901, [1.0, None] + [0.0] * 10, 3), (902, [float("nan")] + [0.0] * 11, 3), (903, [float("inf")] + [0.0] * 11, 3), (904, [], 3), (905, [1.0], 3)]
    twice = [rows[3], (None, rows[4][1], 3)]
    df = spark.createDataFrame(rows + odd + twice, "vec_id long, embedding array<double>, n long")
    got = whitening.whiten(df, keep=["vec_id", "n"], components=5).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ints = np.floor(1024 * np.vstack([x, x[3:5]])).astype(np.int64) + 100_000
    n, sums = len(ints), ints.sum(axis=0)
    y = (n * ints - sums) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 5 * n and set(got.n) == {n} and got.identity_error.max() < 1e-12
    for c in range(5):
        mine = got[(got.component == c + 1)].drop_duplicates().dropna(subset="vec_id").sort_values("vec_id")
        want = (y @ q[:, c] / np.sqrt(e[c]))[:500]
        sign = np.sign(want @ mine.whitened.to_numpy())
        assert np.abs(mine.whitened.to_numpy() - sign * want).max() < 1e-9
        assert np.allclose(mine.explained, e[c] / np.trace(v), rtol=1e-12)
        assert mine.deviation.tolist() == ((n * ints - sums) ** 2).sum(axis=1)[:500].tolist()


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(10)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_deviation_is_exact_beyond_64_bits():
    model = whitening.Whitening(3, (0, 0), np.ones(1), np.ones((2, 1)), 1.0)
    d = np.array([[1 << 40, 3], [5, 7]], np.int64)
    assert model.deviation(d) == [(1 << 80) + 9, 74]
