import random
import re

import numpy as np

from changelake.llm import decontam


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "item_id long, text string, key string, score string")


def brute_score(item, passage, s=decontam.Settings()):
    best, row = 0, [0] * (len(passage) + 1)
    for w in item:
        new = [0]
        for j, p in enumerate(passage, 1):
            new.append(max(0, row[j - 1] + (s.match if w == p else -s.differ), row[j] - s.gap, new[-1] - s.gap))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 25))] for _ in range(2))
        assert decontam.align(np.array(a, np.uint64), np.array(b, np.uint64), decontam.Settings()) == brute_score(a, b)


def test_edited_copies_against_brute_force(spark, make_docs):
    rng = random.Random(2)
    items = [(i, words(rng, rng.randint(12, 50))) for i in range(12)]
    docs = []
    for i, item in items:
        for rate in (0.0, 0.1, 0.2):
            out = []
            for w in item:
                x = rng.random()
                out += [] if x < rate / 3 else [w, "added"] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
            host = words(rng, 300)
            at = rng.randrange(300)
            docs.append((len(docs), " ".join(host[:at] + [w.upper() + "," for w in out] + host[at:])))
    docs += [(len(docs) + k, " ".join(words(rng, 200))) for k in range(30)]
    texts = [(i, " ".join(t)) for i, t in items]
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(make_docs(*docs), items_of(spark, texts)).collect()}
    norm = lambda t: re.findall(r"[a-z]+", t.lower())
    expected = {}
    for d, t in docs:
        for i, item in items:
            score = brute_score(item, norm(t)) / (2 * len(item))
            if score >= 0.5:
                expected[(d, i)] = score
    assert got == expected and len(expected) >= 30


def test_short_items_with_many_replaced_words_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    items = [(i, words(rng, rng.choice((15, 20)))) for i in range(120)]
    docs = []
    for i, item in items:
        fourth = [w if k % 4 != 3 else "other" for k, w in enumerate(item)]
        for copy in (fourth, *([w if rng.random() >= rate else "other" for w in item] for rate in (0.2, 0.25, 0.3))):
            docs.append((len(docs), " ".join(words(rng, 60) + copy + words(rng, 60))))
    expected = {(d, d // 4) for d, text in docs if brute_score(items[d // 4][1], text.split()) >= len(items[d // 4][1])}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make_docs(*docs), items_of(spark, [(i, " ".join(t)) for i, t in items])).collect()}
    print(len(got & expected), "of", len(expected))
    assert {(4 * i, i) for i, _ in items} <= got <= expected
    assert len(got) >= 0.995 * len(expected)


def test_passage_in_many_documents(spark, make_docs):
    rng = random.Random(3)
    item = words(rng, 25)
    docs = [(i, " ".join(words(rng, 40) + item + words(rng, 40))) for i in range(200)] + [(900, " ".join(words(rng, 80)))]
    got = decontam.contaminated(make_docs(*docs), items_of(spark, [(1, " ".join(item)), (2, " ".join(item))])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i in range(200) for k in (1, 2)}
    left = decontam.without_contaminated(make_docs(*docs), items_of(spark, [(1, " ".join(item))]))
    assert [r.doc_id for r in left.collect()] == [900] and left.columns == make_docs().columns


def test_odd_rows(spark, make_docs):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (None, item), (4, item), (4, item), (5, "filler " * 40000 + item + " filler" * 40000), (6, "short words here"), (7, "Short, words")]
    items = items_of(spark, [(1, item), (2, None), (3, ""), (None, item), (5, "short words"), (6, "words nowhere")])
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in decontam.contaminated(make_docs(*rows), items).collect())
    assert got == [(0, 0), (0, 1), (4, 0), (4, 1), (5, 0), (5, 1), (7, 5)]
    assert decontam.contaminated(make_docs(), items).count() == 0
    assert decontam.contaminated(make_docs(*rows), items_of(spark, [])).count() == 0
