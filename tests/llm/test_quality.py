import random
import re
from collections import Counter

import zstandard

from changelake.llm.quality import Bands, compression_bands

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if found[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    data = text.encode()
    squeeze = zstandard.ZstdCompressor(level=3)
    ratio = len(squeeze.compress(data)) / len(data) if data else 1.0
    bands = Bands()
    chunks = [data[i : i + 2048] for i in range(0, len(data) // 2048 * 2048, 2048)]
    bad = sum(not 0.2 <= len(squeeze.compress(c)) / len(c) <= 0.8 for c in chunks)
    low, high = bands.limits(len(data))
    kept = not failed and low <= ratio <= high and bad <= 0.4 * len(chunks)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, kept


def test_equals_brute_force(spark, make_docs):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e a\n\na b c d e a\n", "x y\nx y\n x y\n", "日本 語\x85 \x1c#|<>", "w " * 5000]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/ABCDEFGHIJKLMNOP QRSTUVWXYZ") for _ in range(9000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "a")]
    got = compression_bands(make_docs(*rows)).collect()
    assert len(got) == len(rows)
    expected = Counter((i, *brute(t)) for i, t in rows)
    assert expected == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)


def test_bands_tell_prose_from_junk(spark, make_docs):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice(["the", "an", "er", "in", "on", "st", "re", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(600))
    noise = " ".join("".join(chr(rng.randint(33, 0x2FF)) for _ in range(12)) for _ in range(400))
    phrase = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(3)) for _ in range(3)]
    dull = " ".join(rng.choice(phrase) for _ in range(700))
    got = {r.doc_id: r.verdict for r in compression_bands(make_docs((1, prose), (2, noise), (3, dull))).collect()}
    assert got[1] == "kept" and got[2] == "incompressible" and got[3] in ("base", "repetitive")


def test_empty_table(make_docs):
    assert compression_bands(make_docs()).count() == 0
