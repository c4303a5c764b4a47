import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelake.llm import neardup
from changelake.llm.classes import connected_classes


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(out)), n):
        out[i] = "changed" + str(rng.random())
    return out


def shingle_weights(text, idf):
    w = (text or "").lower().split()
    grams = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    return Counter(grams)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    rows, truth = [], {}
    for group in range(25):
        base = words(rng, 200)
        for k in range(4):
            doc = len(rows)
            text = " ".join(base if k < 2 else edited(rng, base, k - 1))
            rows.append((doc, text))
            truth[doc] = group * 4
    for _ in range(60):
        truth[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(words(rng, 150))))
    return rows, truth


def test_planted_groups(make_docs, planted):
    rows, truth = planted
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make_docs(*rows)).collect()}
    assert got == truth


def test_one_of_each(make_docs, planted):
    rows, truth = planted
    kept = neardup.one_of_each(make_docs(*rows))
    assert kept.columns == make_docs().columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(truth.values()))


def test_shared_passage_is_no_copy(make_docs):
    rng = random.Random(6)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 100) + passage + words(rng, 60))) for i in range(120)]
    got = neardup.near_duplicates(make_docs(*rows)).collect()
    assert all(r.doc_id == r.class_id for r in got)


def test_large_group_needs_no_pairs(make_docs):
    rng = random.Random(7)
    base = words(rng, 150)
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(150)] + [(500, " ".join(base))]
    got = neardup.near_duplicates(make_docs(*rows)).collect()
    assert Counter(r.class_id for r in got).most_common(1)[0][1] >= 150


def test_second_hand_copies_of_a_hub_against_brute_force(make_docs):
    rng = random.Random(10)
    texts = []
    for _ in range(40):
        base = words(rng, 220)
        first_hand = [edited(rng, base, 1) for _ in range(6)]
        texts += [" ".join(x) for x in [base, *first_hand, edited(rng, first_hand[0], 4)]]
    rows = list(enumerate(texts))
    s = neardup.Settings()
    sampler = neardup.Sampler(neardup.document_frequency(make_docs(*rows).select("text"), s), s)
    truth = {i: i for i, _ in rows}
    second_hand = 0
    for at in range(0, len(texts), 8):
        pairs = [(i, j) for i in range(at, at + 8) for j in range(i) if j >= at]
        similar = sampler.similarity(pa.array([texts[i] for i, _ in pairs]), pa.array([texts[j] for _, j in pairs])) >= s.threshold
        links = [p for p, x in zip(pairs, similar) if x]
        second_hand += (at + 7, at + 1) in links and (at + 7, at) not in links
        for i, j in links * 8:
            truth[i] = truth[j] = min(truth[i], truth[j])
    assert second_hand > 20
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make_docs(*rows)).collect()}
    assert got == truth


def test_blocks_hold_every_pair_of_different_classes(monkeypatch, spark):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 3)
    labels = [i % 4 if i < 12 else i for i in range(20)] + [0] * 10
    members = spark.createDataFrame([(0, 1, bytes([i]), 10, bytes([x])) for i, x in enumerate(labels)] + [(1, 1, b"a", 10, b"a"), (1, 1, b"b", 10, b"a")],
                                    "band int, value long, key binary, bytes int, label binary")
    blocks = neardup._blocks(members).collect()
    assert {r.band for r in blocks} == {0}
    met = {(a.key, b.key) for a in blocks if a.on_left for b in blocks if not b.on_left and (a.row, a.col) == (b.row, b.col)}
    assert all((bytes([i]), bytes([j])) in met or (bytes([j]), bytes([i])) in met for i, x in enumerate(labels) for j, y in enumerate(labels) if x != y)


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One TWO"), (None, "one two"), (7, "x y z " * 30000), (8, "x y z " * 30000), (8, "x y z " * 30000)]
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(make_docs(*rows)).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (3, 3): 1, (4, 4): 1, (5, 4): 1, (None, 4): 1, (7, 7): 1, (8, 7): 2})
    assert neardup.near_duplicates(make_docs()).count() == 0
    assert neardup.near_duplicates(make_docs((None, "a b c"), (None, "a b c"))).collect() == [(None, None), (None, None)]
    kept = neardup.one_of_each(make_docs(*rows, (None, "alone")))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 7, None])


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = random.Random(8)
    idf = np.random.default_rng(1).uniform(1, 2, neardup.DF_BUCKETS).astype(np.float32)
    s = neardup.Settings(bands=600, rows=1)
    sampler = neardup.Sampler(idf, s)
    for changed in (2, 6, 15):
        base = words(rng, 300)
        pair = [" ".join(base), " ".join(edited(rng, base, changed))]
        keys = sampler.bands(pa.array(pair))
        exact = sampler.similarity(pa.array(pair[:1]), pa.array(pair[1:]))[0]
        assert abs((keys[0] == keys[1]).mean() - exact) < 0.09
        one, other = (shingle_weights(t, idf) for t in pair)
        plain = sum((one & other).values()) / sum((one | other).values())
        assert abs(exact - plain) < 0.1


def test_connected_classes_against_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_classes(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.node: r.label for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert connected_classes(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_texts_that_meet_none_are_left_where_they_are_read(spark):
    """Of rows whose key is not known nearly none is sent on; of the known ones none is lost, also where keys repeat."""
    key = F.unhex(F.md5(F.col("id").cast("string"))).alias("key")
    rows = spark.range(20_000).select(key, F.col("id").alias("text"))
    known = spark.range(0, 20_000, 10).select(key)
    kept = neardup._may_be_in(rows.unionAll(rows), known)
    assert kept.columns == ["key", "text"]
    assert kept.where("text % 10 = 0").count() == 2 * 2_000
    assert kept.where("text % 10 <> 0").count() < 50
    assert neardup._may_be_in(rows, known.limit(0)).count() == 0


def test_pairs_are_compared_in_bounded_memory():
    """However many texts a batch holds and whichever side is long, and with the answers of a comparison row by row."""
    rng = random.Random(9)
    sampler = neardup.Sampler(np.ones(neardup.DF_BUCKETS, np.float32), neardup.Settings())
    base = words(rng, 300)
    long = " ".join(base) + " "
    one = [" ".join(base) if i % 3 else " ".join(edited(rng, base, 1)) for i in range(4_000)] + [" ".join(words(rng, 300)), "", "a b"] + ["a b c"] * 4
    other = [" ".join(base)] * 4_000 + [" ".join(base), "", "a b"] + [long * 400] * 4
    one, other = pa.array(one), pa.array(other)
    tracemalloc.start()
    got = sampler.similar(one, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = [*range(0, 4_000, 500), *range(3_998, len(one))]
    assert [bool(got[i]) for i in some] == [bool(sampler.similarity(one.slice(i, 1), other.slice(i, 1))[0] >= 0.8) for i in some]
    assert got[:4_000].all() and not got[4_000] and got[4_001] and got[4_002] and not got[4_003:].any()
    assert peak < 80e6
    assert len(sampler.similar(one.slice(0, 0), other.slice(0, 0))) == 0
