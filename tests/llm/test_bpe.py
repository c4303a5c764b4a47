import hashlib
import random
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from changelake.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_equals_the_library(make_docs, encoding):
    rng = random.Random(3)
    texts = [None, "", "a", "  \n\n x  ", "日本語テキスト。" * 40, "\x00\x1c\x85 　z", "it's we'll 123!!!???", "a" * 700, "🙂 👨‍👩‍👧 ½ Ⅷ ٣", " \t\r\n" * 60, "ba" * 150]
    texts += ["".join(rng.choice("abcdeéß 12\n.日") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "twice"), (3, "twice")]
    got = bpe.digests(make_docs(*rows), PATH, public_tokenizers.PATTERN).collect()

    def expected(i, t):
        ids = encoding.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(expected(i, t)) for i, t in rows)


def test_ids_and_decoding(spark, make_docs, encoding):
    got = bpe.encode(make_docs((1, "Hello wörld")), PATH, public_tokenizers.PATTERN)
    assert got.first().ids == encoding.encode_ordinary("Hello wörld")
    lists = spark.createDataFrame([([72, 0],), ([],), (None,), ([10**6],), ([-1],)], "ids array<int>")
    out = [r[0] for r in lists.select(bpe.decode(F.col("ids"), PATH)).collect()]
    pieces = {v: k for k, v in bpe.read_ranks(PATH).items()}
    assert out == [bytearray(pieces[72] + pieces[0]), bytearray(), None, None, None]


def test_long_text_and_empty_table(make_docs, encoding):
    text = " ".join(str(i) for i in range(40000))
    got = bpe.digests(make_docs((1, text)), PATH, public_tokenizers.PATTERN).first()
    assert got.n_tokens == len(encoding.encode_ordinary(text))
    assert bpe.digests(make_docs(), PATH, public_tokenizers.PATTERN).count() == 0


def test_every_token_is_reached_by_merges(spark, encoding):
    """The bytes of a token, cut anywhere, are merged again: the fold needs no table of merges besides the ranks."""
    some = sorted(bpe.read_ranks(PATH).items(), key=lambda x: x[1])[::97]
    frame = spark.createDataFrame([([bytearray(k) for k, _ in some],)], "words array<binary>")
    assert frame.select(bpe.encode_words(F.col("words"), PATH)).first()[0] == [[v] for _, v in some]


def test_words_common_to_many_blocks(make_docs, encoding):
    """Each partition makes a block of its own, so the words of the first list are folded once for all and the others by their block."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 40)))
    common = [word() for _ in range(50)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.7 else word() for _ in range(60)) for _ in range(80)]
    docs = make_docs(*enumerate(texts)).repartition(6, "doc_id")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}


def test_memory_of_a_task_goes_back(spark, monkeypatch):
    """A worker is used again, so Arrow gives back what it kept, once the last batch of a task is out."""
    done = []
    pool = SimpleNamespace(release_unused=lambda: done.append("released"))
    monkeypatch.setattr(common, "pa", SimpleNamespace(default_memory_pool=lambda: pool, RecordBatch=object))
    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda function, schema: function)
    task = common.arrow_map(frame, lambda batches: (2 * x for x in batches), "n bigint")
    for out in task(iter([1, 2])):
        done.append(out)
    assert done == [2, 4, "released"]


def test_plans_do_not_hold_the_ranks(make_docs):
    """The descriptions of a plan go to the driver's listeners again and again; they are short, whatever the number of ranks."""
    plan = bpe.encode(make_docs((1, "some text")), PATH, public_tokenizers.PATTERN)._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_freed_arrays_of_a_task_go_back(spark):
    """NumPy's arrays too, which the C library keeps when they are freed below one that stays."""
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    kept = []

    def work(batches):
        arrays = [np.ones(12_000) for _ in range(1_500)]
        kept.append(np.ones(12_000))
        yield sum(len(a) for a in arrays)

    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda function, schema: function)
    task = common.arrow_map(frame, work, "n bigint")
    before = held()
    assert list(task(iter([]))) == [18_000_000]
    assert held() < before + 40
    assert len(kept[0]) == 12_000


def test_written_frames_have_no_mark_of_a_finished_write(spark):
    """The driver would start two processes for each, which for a moment count with all of its memory."""
    frame = common.stored(spark.range(5), "unmarked")
    assert frame.count() == 5
    folder = Path(frame.inputFiles()[0].removeprefix("file://")).parent
    assert not list(folder.glob("*_SUCCESS*"))
