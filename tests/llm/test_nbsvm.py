"""Quality scores: n-grams, ratios and descent against plain versions, and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelake.llm import nbsvm, plans

WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def shape(word):
    signs = "".join("a" if c >= "\x80" or c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", signs)


def test_shapes_and_repeats():
    texts = ["Hello, WORLD!! 12a\n\n%%% été x", "", None, "a b c d e f a b c d e f", " aa  aa", "日本"]
    got = nbsvm.shaped(pa.array(texts)).to_pylist()
    assert [WORD.findall(t) for t in got] == [[shape(w) for w in WORD.findall(t or "")] for t in texts]
    words = nbsvm.Words(pa.array(texts))
    again = nbsvm.repeated_runs(words, words.hashes())
    expected = []
    for t in texts:
        ws, seen = WORD.findall(t or ""), set()
        for i in range(len(ws)):
            run = tuple(ws[i : i + 5])
            expected.append(len(run) == 5 and run in seen)
            seen.add(run)
    assert again.tolist() == expected and any(expected)


def test_same_grams_wherever_a_text_stands():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "Bb", "c!", "%", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    doc, bucket = nbsvm.grams(pa.array(texts))
    for i, t in enumerate(texts):
        alone = nbsvm.grams(pa.array([t]))[1]
        assert sorted(bucket[doc == i].tolist()) == sorted(alone.tolist())
        n = len(WORD.findall(t))
        assert len(alone) == 2 * n + 2 * max(0, n - 1) + max(0, n - 2)


def test_indicators_are_distinct_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    doc, feature = rng.integers(0, 50, 4000), rng.integers(0, 30, 4000)
    want = sorted(set(zip(doc.tolist(), feature.tolist(), strict=True)))
    for cells in (1, 100, 10_000):
        monkeypatch.setattr(nbsvm, "CELLS", cells)
        got = [x for a, f in nbsvm.indicators(doc, feature, 50, 30) for x in zip(a.tolist(), f.tolist(), strict=True)]
        assert got == want


def test_ratios():
    index, y = np.array([0, 0, 1, 2, 2, 2]), np.array([1, -1, 1, -1, -1, -1])
    up, down = np.array([2, 2, 1]) / 5, np.array([2, 1, 4]) / 7
    assert np.allclose(nbsvm.log_count_ratios(index, y, 3), np.log(up / down))


def test_descent_reaches_the_minimum():
    """The primal objective by plain gradient descent has the same minimum."""
    rng = np.random.default_rng(0)
    n, size = 60, 8
    x = (rng.random((n, size)) < 0.4) * rng.normal(size=(n, size))
    y = np.where(x @ rng.normal(size=size) + 0.5 * rng.normal(size=n) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.3, 0.7)
    rows = [np.flatnonzero(r) for r in x]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    index = np.concatenate(rows)
    w = nbsvm.dual_coordinate_descent(starts, index, np.concatenate([x[i, r] for i, r in enumerate(rows)]), y, size, cost, epochs=2000, tolerance=1e-10)
    whole = np.column_stack([x, np.ones(n)])
    objective = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (whole @ v)) ** 2).sum()
    v = np.zeros(size + 1)
    for _ in range(20_000):
        v -= 0.005 * (v - 2 * whole.T @ (cost * y * np.maximum(0, 1 - y * (whole @ v))))
    assert abs(objective(w) - objective(v)) < 1e-6 and np.allclose(w, v, atol=1e-3)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = plans.QUERIES["op12_nb_support_vectors"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == 10_000 and len(rows) > 500
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    for q in (0, 1):
        assert np.mean([r.predicted == q for r in rows if r.quality == q]) >= 0.97


def test_learns_nothing_from_held_out_rows(spark, make_docs):
    rows = [(i, ("good words here " if i % 2 else "%% BAD ## ") * 3) for i in range(200)]
    docs = make_docs(*rows)
    right = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id bigint, quality int, label int")
    wrong = right.withColumn("quality", F.when(nbsvm.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(tuple(r) for r in nbsvm.score(docs, nbsvm.train(docs, x)).collect()) for x in (right, wrong))
    assert one == two
    assert all((s > 0.8) == bool(i % 2) for i, _, s, _ in one)


def test_odd_rows(spark, make_docs):
    docs = make_docs((1, None), (2, ""), (3, " \n "), (None, "text"), (4, "again"), (4, "again"), (5, "long words " * 300_000))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = nbsvm.score(docs, nbsvm.train(docs, none)).collect()
    assert len(got) == 7 and {round(r.score, 6) for r in got} == {0.5}
    one_class = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(None, 0), (2, None)], "doc_id bigint, quality int")
    got = nbsvm.score(docs, nbsvm.train(docs, one_class)).collect()
    assert len({r.score for r in got}) == 1 and got[0].score > 0.5
    mixed = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1)], "doc_id bigint, quality int")
    got = nbsvm.score(docs, nbsvm.train(docs, mixed, min_texts=1))
    assert got.count() == 7 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert nbsvm.score(make_docs(), nbsvm.train(make_docs(), none)).count() == 0


@pytest.mark.parametrize("labels", [[1.0] * 5, [-1.0] * 5, []])
def test_one_class_gives_the_base_rate(labels):
    y = np.array(labels)
    w, slope, shift = nbsvm.fit_calibrated(np.arange(len(y) + 1), np.zeros(len(y), np.int64), y, np.zeros(len(y)), 1, 0.1)
    assert not w.any() and slope == 0 and np.isclose(1 / (1 + np.exp(-shift)), ((y > 0).sum() + 0.5) / (len(y) + 1))
