"""Aligned tokens against a plain version that works text by text."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from changelake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def bytes_to_unicode():
    bs = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    cs, n = bs[:], 0
    for b in range(256):
        if b not in bs:
            bs.append(b)
            cs.append(256 + n)
            n += 1
    return {chr(c): b for b, c in zip(bs, cs)}


@pytest.fixture(scope="module")
def tools():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B), bytes_to_unicode()


def tokens(text, tools):
    t, sp, table = tools
    e = t.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(table[c] for c in p)) for i, p in zip(e.ids, e.tokens)]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return [], []
    return a, b


def brute(rows, tools):
    per, counts = [], Counter()
    for i, text in rows:
        a, b = tokens(text or "", tools)
        ends = []
        for side in (a, b):
            at, out = 0, {}
            for k, (_, x) in enumerate(side):
                at += len(x)
                out[at] = k
            ends.append(out)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(a[ends[0][c]][0], b[ends[1][c]][0]) for c in cuts]
        groups, la, lb = [], 0, 0
        for c in cuts:
            na, nb = ends[0][c] + 1, ends[1][c] + 1
            groups.append(",".join(str(x) for x, _ in a[la:na]) + "|" + ",".join(str(x) for x, _ in b[lb:nb]))
            la, lb = na, nb
        counts.update(links)
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((i, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, na, nb, g, ls, sha in per), key=str)


def check(docs, rows, tools):
    got = alignment.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, tools)


def test_equals_the_plain_version(make_docs, tools):
    rng = random.Random(8)
    texts = [None, "", " ", "a", "<|endoftext|> and </s> <s> <unk> <0x41>", "Hello  world\n\n\ttabs", "x▁y", "naïve 日本語 🙂 👨‍👩‍👧 \x00\x01", "é" * 300, "a" * 3000, "  \n ", "　全角"]
    words = ["the", "tokenization", "Schifffahrt", "ungewöhnlich", "don't", "12345", "été", "😀", "x=y;", "日本", "\n", "  "]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(80)]
    texts += ["".join(rng.choice("abcdeéß 12\n.日🙂") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "twice"), (3, "twice")]
    check(make_docs(*rows).repartition(5), rows, tools)


def test_long_text_and_no_rows(make_docs, tools):
    rows = [(1, "long text of many words, " * 60_000), (2, "short"), (3, None)]
    check(make_docs(*rows), rows, tools)
    assert alignment.align(make_docs(), A, B).count() == 0
    check(make_docs((1, None), (2, "")), [(1, None), (2, "")], tools)


def test_ranks_give_the_ids_of_the_library(tmp_path, tools):
    """Words are cut by classes of characters: every character of the first 12,288, and a sample of the others, in several contexts."""
    vocab = alignment.ByteLevel(A)
    points = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}.{c} {c}{c}  {c}\n{c}a {c}. {c}1" for c in map(chr, points)] + ["<|endoftext|>", "", "a" * 5000]
    expected = [e.ids for e in tools[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert vocab.encode(texts) == expected and type(vocab.tool).__module__.startswith("tiktoken")


def test_other_files_go_to_the_library(tmp_path, tools):
    """A file that is no plain list of ranks: here the last merge is missing, so its token is never made."""
    file = json.loads(open(A, encoding="utf-8").read())
    file["model"]["merges"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    vocab = alignment.ByteLevel(str(path))
    assert type(vocab.tool).__module__ == "tokenizers"
    assert vocab.encode(["Hello 世界"]) == [tools[0].encode(" Hello 世界", add_special_tokens=False).ids]


def test_pointers_against_cuts():
    """Groups found by doubling are the stretches between bytes where tokens of both sides end."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        sides = [np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)) if n > 1 else np.zeros(0, int) for _ in range(2)]
        a, b = (np.append(s, n) for s in sides)
        a_label, b_label = alignment.labels(a, b)
        cuts = np.intersect1d(a, b)
        assert (b[a_label] == cuts[np.searchsorted(cuts, a)]).all()
        assert (b[b_label] == cuts[np.searchsorted(cuts, b)]).all()


def test_longest_chain():
    """One group over everything: tokens that never end together but at the end."""
    a, b = np.arange(2, 20_001, 2), np.append(np.arange(1, 20_000, 2), 20_000)
    a_label, b_label = alignment.labels(a, b)
    assert set(a_label) == set(b_label) == {len(b) - 1}
