"""The classifier's parts against plain versions, whole texts, and held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import quality


def of(text):
    rows, cols = quality.features(pa.array([text]))
    return set(cols.tolist())


def plain_shape(word):
    out = ""
    for c in word:
        out += "A" if c.isupper() else "a" if c.islower() else "0" if c.isdecimal() else "o" if c.isalpha() else c
    for run, put in (("a", "a"), ("A", "B"), ("o", "o"), ("0", "0")):
        out = re.sub(run + "{2,}", put, out)
    return out + ("+" if len(word) > 24 else "")


def test_shapes():
    words = ["the", "The", "NASA", "A", "iPhone12", "日本語x", "", "--", "élan", "a1b22c", "x" * 30, "don't"]
    assert quality.shapes(words) == [plain_shape(w) for w in words]
    assert quality.shapes([]) == []


def test_every_character_counts():
    x = "x" * 64
    assert of(x + "!!!") != of(x + "999") and of("日" * 500 + "。" * 3) != of("日" * 500 + "本1本")
    assert of("a\tb") == of("a b") == of("a　b") and of("a\nb") != of("a b")
    assert of("") != of("a") and of("the") != of("of")


def test_rows_do_not_mix():
    texts = ["", "one two three", "x" * 200 + " y", "one two three", "a\n\nb  c", "one"]
    rows, cols = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert set(cols[rows == k].tolist()) == of(t)


def test_ratio_is_that_of_plain_counts():
    docs = [([1, 2], 1), ([1, 3], 1), ([1, 4], -1), ([2, 4], -1), ([4, 5], -1)]
    indptr = np.cumsum([0, *(len(d) for d, _ in docs)])
    got = quality.log_count_ratio(indptr, np.array([c for d, _ in docs for c in d]), np.array([y for _, y in docs]))
    n = {s: Counter(c for d, y in docs for c in d if y == s) for s in (1, -1)}
    total = {s: sum(n[s].values()) + quality.DIMENSIONS for s in n}
    for c in range(7):
        often = n[1][c] + n[-1][c]
        want = math.log((n[1][c] + 1) / total[1]) - math.log((n[-1][c] + 1) / total[-1]) if often >= 2 else 0
        assert got[c] == pytest.approx(want)


def test_solver_finds_the_optimum():
    """Against projected gradient ascent of the same dual, on dense rows."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 6)), np.where(rng.random(40) < 0.4, 1, -1)
    x[y > 0, 0] += 1.0
    cost = np.where(y > 0, 40 / (2 * (y > 0).sum()), 40 / (2 * (y < 0).sum()))
    full = np.hstack([x, np.ones((40, 1))]) * y[:, None]
    gram, alpha = full @ full.T, np.zeros(40)
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, cost)
    want = full.T @ alpha
    w, bias = quality.dual_coordinate_descent(np.arange(0, 241, 6), np.tile(np.arange(6), 40), x.ravel(), y, rounds=3000, tolerance=1e-9)
    assert np.allclose([*w[:6], bias], want, atol=1e-4)


def test_logistic_is_calibrated():
    rng = np.random.default_rng(3)
    margins = rng.normal(size=20_000)
    y = np.where(rng.random(20_000) < 1 / (1 + np.exp(-(1.7 * margins - 0.4))), 1, -1)
    slope, offset = quality.logistic(margins, y)
    assert slope == pytest.approx(1.7, abs=0.1) and offset == pytest.approx(-0.4, abs=0.1)


def test_query_on_held_out_rows(spark):
    from orrery.llm.queries import op5_quality

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = op5_quality(spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    got = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id) and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.predicted == got.quality).mean() > 0.99
    rank = got.score.rank()
    n = (got.quality == 1).sum()
    assert (rank[got.quality == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n)) > 0.995


def test_rows_learnt_are_bounded(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * (1 + k % 3), k) for k in range(400)] + [(7, "other text", 1)] * 50, "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(7, 0)] * 50, "doc_id bigint, quality int")
    whole, some = quality.train(docs, labels), quality.train(docs, labels, most_rows=60)
    assert np.isfinite(whole.weights).all() and np.isfinite(some.weights).all()
    few = quality.train(docs, labels, most_features=500)
    assert len(np.flatnonzero(few.weights)) <= len(np.flatnonzero(whole.weights))
    again = quality.train(docs.repartition(7), labels.repartition(3))
    assert (again.weights == whole.weights).all() and again.bias == whole.bias


def test_awkward_rows(spark):
    long = "word " * 200_000
    rows = [(None, None, 1.0, "x"), (1, "", None, None), (1, "", 2.0, "y"), (2, long, 3.0, "z"), (3, "日" * 100_000, 1.0, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, held_out string")
    model = quality.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id bigint, quality int"))
    got = sorted((tuple(r)[:2] for r in quality.score(docs, model).collect()), key=repr)
    assert got == sorted([(None, False), (1, False), (1, False), (2, zlib.crc32(b"2") % 5 == 0), (3, zlib.crc32(b"3") % 5 == 0)], key=repr)
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.schema == docs.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
    assert quality.keep_good(docs, model, threshold=1.1).count() == 0 and quality.score(docs.limit(0), model).count() == 0
    swapped = docs.select("held_out", "text", "score", "doc_id")
    assert quality.keep_good(swapped, model, threshold=0.0).columns == swapped.columns
