import random

import pyarrow as pa
import pytest

from changelake.llm import toxicity

CLEAN = "river stone garden window market letter morning teacher bread winter paper silver".split()
BAD = {"insult": ["idiot", "moron"], "contempt": ["worthless", "stupid"], "other": ["lowerei", "lowerung", "lowerchen"]}


def text_of(rng, kind=None):
    words = [rng.choice(CLEAN) for _ in range(rng.randint(20, 60))]
    for _ in range(3 if kind else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD[kind]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    kinds = [None, None, None, "insult", "contempt", "other"]
    return [(i, text_of(rng, k := rng.choice(kinds)), int(k is not None)) for i in range(900)]


@pytest.fixture(scope="module")
def chain(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus[:500]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus[:500]], "doc_id long, toxic int")
    return toxicity.default_chain(docs, labels)


def test_held_out_accuracy(spark, corpus, chain):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus[500:]], "doc_id long, text string")
    got = {r.doc_id: r.toxic for r in toxicity.score_chain(docs, chain).collect()}
    truth = {i: bool(y) for i, _, y in corpus[500:]}
    assert sum(got[i] == truth[i] for i in truth) >= 0.98 * len(truth)


def test_later_models_use_earlier_probabilities(chain):
    assert [len(w) - len(chain.features) for w in chain.weights] == [1, 2, 3]
    assert chain.categories == ("insult", "contempt", "toxic")
    assert chain.weights[2][len(chain.features)] > 0


def test_unseen_form_of_a_known_stem(spark, chain):
    docs = spark.createDataFrame([(1, "river stone lowerschaft lowerheit lowerkeit garden"), (2, "river stone garden")], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in toxicity.score_chain(docs, chain).collect()} == {1: True, 2: False}


def test_rare_telling_words_among_many_common_ones(spark):
    telling = ["zzaa", "zzbb", "zzcc", "zzdd"]
    rows = [(i, " ".join([*CLEAN, telling[i % 4]] if i < 60 else CLEAN), int(i < 60)) for i in range(120)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.train_chain(labelled, ["toxic"], max_features=4)
    assert set(chain.features) == set(toxicity.text_features(pa.array([" ".join(telling)]))[1])


def test_odd_rows(make_docs, chain):
    rows = [(1, None), (2, ""), (None, "idiot moron idiot moron"), (4, "river " * 30000), (4, "river " * 30000)]
    got = toxicity.score_chain(make_docs(*rows), chain).collect()
    assert sorted((r.doc_id or 0, r.toxic) for r in got) == [(0, True), (1, False), (2, False), (4, False), (4, False)]
    kept = toxicity.score_chain(make_docs(*rows), chain, keep=True)
    assert kept.columns == make_docs().columns and kept.count() == 4
    assert toxicity.score_chain(make_docs(), chain).count() == 0


def test_labels_with_nulls_and_one_class_only(spark, make_docs):
    docs = make_docs((1, "a b c"), (2, None), (3, "d e f"), (3, "d e f"))
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    chain = toxicity.default_chain(docs, labels)
    assert not any(r.toxic for r in toxicity.score_chain(docs, chain).collect())
    assert not any(r.toxic for r in toxicity.score_chain(docs, toxicity.default_chain(make_docs(), labels)).collect())
