"""Secret scan: known patterns, and strings whose sliding-window Shannon entropy is that of random text of their character class.

The entropy of each window follows from the one before: the counts of the character that leaves and of the one that enters
change, and with them the sum of c * log2(c). Strings on the allow-list are no secrets. Built-in functions only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from changelake.llm.common import narrowed, text_or_empty

# Kinds that every scan looks for, in their order; group: what has to have so many characters. For access and hex the
# least length stands in the pattern: their matches are whole runs, so a match that is too short hides no other one.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)

#: Strings that look random but are none; a candidate that matches one as a whole is passed over.
ALLOWED = (
    r"[0-9]+",  # plain numbers
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # universally unique identifiers
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T_.:-]*Z?",  # dates and times
    r".*(?i:example|sample|dummy|placeholder|abcdefgh|01234567|x{8}).*",
    r"[A-Za-z]+([_-][A-Za-z0-9]{1,12})+",  # names of several words
)


@dataclass(frozen=True)
class Classes:
    """window: characters of a window. least: bits per character, by character class, that a window of random text exceeds.

    A candidate is a run of `alphabet` of at least `window` characters with a digit and a letter; its class is the first
    pattern that matches it as a whole.
    """

    window: int = 20
    alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
    least: tuple[tuple[str, str, float], ...] = (
        ("hex", r"[0-9a-f]+|[0-9A-F]+", 3.0),
        ("alnum", r"[0-9a-z]+|[0-9A-Z]+", 3.4),
        ("mixed", r".+", 3.6),
    )


#: Parts that one running sum goes over; an even number, so that matches stand at odd places of every block.
BLOCK = 256


def _between(text: Column, pattern: str) -> Column:
    """Text between matches and matches by turns: the odd entries (from 1: the even ones) are the leftmost, non-overlapping matches.

    The marks around a match are characters that the text no longer has: those in it were replaced one for one, and no pattern
    here holds control characters.
    """
    return F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x02"), "[\x01\x02]")


def _matches(parts: Column) -> Column:
    """(start, stop, found) of the matches in the list made by `_between`, in code points.

    Places are running sums of lengths, made block by block: a list that a fold appends to is copied at every step, so none gets longer
    than a block, or than there are blocks.
    """
    spans = F.array().cast("array<struct<start:int,stop:int,found:string>>")

    def add(state: Column, part: Column) -> Column:
        stop = state["stop"] + F.char_length(part)
        span = F.struct(state["stop"].alias("start"), stop.alias("stop"), part.alias("found"))
        return F.struct(
            stop.alias("stop"), (~state["odd"]).alias("odd"), F.when(state["odd"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    def within(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("stop"), F.lit(False).alias("odd"), spans.alias("spans"))
        return F.aggregate(block, start, add, lambda s: s["spans"])

    last = F.call_function("div", F.size(parts) - 1, F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, part: n + F.char_length(part)))
    begins = F.aggregate(lengths, F.array(F.lit(0)), lambda list_, n: F.array_append(list_, F.element_at(list_, -1) + n))
    each = F.filter(F.zip_with(blocks, begins, within), lambda spans_: spans_.isNotNull())  # begins has one more than blocks
    return F.when(F.size(parts) == 1, spans).otherwise(F.flatten(each))


def peak_entropy(text: Column, c: Classes) -> Column:
    """Largest entropy, in bits per character, of any window of a string of `alphabet`, by incremental counts."""
    size = len(c.alphabet)
    index = lambda i: F.instr(F.lit(c.alphabet), F.substring(text, i, F.lit(1)))  # noqa: E731  from 1

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def moved(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda n, k: F.when(k == at - 1, n + by).otherwise(n))

    def change(state: Column, at: Column, by: int) -> Column:
        """Count one character more or less; the sum changes by the terms of that character only."""
        n = F.get(state["counts"], at - 1)
        return F.struct(
            moved(state["counts"], at, by).alias("counts"), (state["total"] - term(n) + term(n + by)).alias("total"), state["least"].alias("least"),
        )

    def step(state: Column, i: Column) -> Column:
        # a fold over the character that enters and the one that leaves, then the least sum so far
        entered = F.aggregate(F.array(index(i)), state, lambda s, at: change(s, at, 1))
        left = F.aggregate(F.when(i > c.window, F.array(index(i - c.window))).otherwise(F.array().cast("array<int>")), entered, lambda s, at: change(s, at, -1))
        return F.aggregate(
            F.array(i), left, lambda s, k: F.struct(
                s["counts"].alias("counts"), s["total"].alias("total"), F.when(k >= c.window, F.least(s["least"], s["total"])).otherwise(s["least"]).alias("least"),
            ),
        )

    most = c.window * math.log2(c.window)
    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(most).alias("least"))
    # the entropy of a window is log2(window) - total / window: least total, most entropy
    return F.aggregate(F.sequence(F.lit(1), F.char_length(text)), start, step, lambda s: math.log2(c.window) - s["least"] / c.window)


def scan(docs: DataFrame, c: Classes = Classes(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    Returns one row per input row: doc_id; n_assign, n_access and n_hex (long); base_sha256 (of the base spans as kind:start:stop,
    joined by commas, by start, then kind as listed); spans (those and the 'entropy' spans, joined likewise). Places are code points.
    An entropy span is a candidate string outside the base spans, not on the allow-list, with a window above the limit of its class.

    Null and empty texts have no spans. Repeated rows and null ids come back as they are; extra columns are ignored. A text
    is searched whole; the work grows with its length and with the number of its matches (times its logarithm), not with the square.
    """
    named = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.translate(text_or_empty(), "\x01\x02", "\x03\x03").alias("text")
    )
    run = "[" + re.escape(c.alphabet) + "]{" + str(c.window) + ",}"
    split = named.select(
        "doc_id", *[_between(F.col("text"), _outer(pattern)).alias(kind) for kind, pattern, _, _ in BASE], _between(F.col("text"), run).alias("entropy")
    )
    base = []
    for place, (kind, pattern, group, least) in enumerate(BASE):
        base.append(_kept(_matches(F.col(kind)), place, kind, pattern, group, least))
    kinds = [kind for kind, *_ in BASE]
    found = split.select("doc_id", *[b.alias(kind) for b, kind in zip(base, kinds, strict=True)], _matches(F.col("entropy")).alias("runs"))
    found = found.select("doc_id", *kinds, F.concat(*kinds).alias("base"), "runs")
    random = F.filter("runs", lambda r: _candidate(r, [F.col(kind) for kind in kinds]) & _random(r["found"], c))
    spans = F.transform(random, lambda r: F.struct(r["start"].alias("start"), F.lit(len(BASE)).alias("place"), r["stop"].alias("stop"), F.lit("entropy").alias("kind")))
    sorted_ = found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat(F.col("base"), spans)).alias("all"))
    listed = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return sorted_.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))


def _outer(pattern: str) -> str:
    """The pattern without groups of its own, so that it can stand in one group."""
    return pattern.replace("((?i:", "(?:(?i:").replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+")


def _kept(matches: Column, place: int, kind: str, pattern: str, group: int, least: int) -> Column:
    def long_enough(m: Column) -> Column:
        return F.char_length(F.regexp_extract(m["found"], pattern, group)) >= least if group else m["stop"] - m["start"] >= least

    def span(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), F.lit(place).alias("place"), m["stop"].alias("stop"), F.lit(kind).alias("kind"))

    return F.transform(F.filter(matches, long_enough), span)


def _meets(spans: Column, run: Column) -> Column:
    """Whether a run overlaps one of a list of spans, which are disjoint and rise: the first that ends after the run's start is found by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.call_function("div", s["low"] + s["high"], F.lit(2)).cast("int")
        after = F.get(spans, middle)["stop"] > run["start"]
        return (
            F.when(s["low"] >= s["high"], s)
            .when(after, F.struct(s["low"].alias("low"), middle.alias("high")))
            .otherwise(F.struct((middle + 1).alias("low"), s["high"].alias("high")))
        )

    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    first = F.aggregate(steps, start, halve, lambda s: s["low"])
    return F.when(F.size(spans) == 0, False).otherwise(F.coalesce(F.get(spans, first)["start"] < run["stop"], F.lit(False)))


def _candidate(run: Column, base: list[Column]) -> Column:
    text = run["found"]
    shape = text.rlike("[0-9]") & text.rlike("[A-Za-z]") & ~text.rlike("^(?:" + "|".join(f"(?:{p})" for p in ALLOWED) + ")$")
    for spans in base:
        shape = shape & ~_meets(spans, run)
    return shape


def _random(text: Column, c: Classes) -> Column:
    limit = F.lit(0.0)
    for _, pattern, least in reversed(c.least):
        limit = F.when(text.rlike(f"^(?:{pattern})$"), least).otherwise(limit)
    return peak_entropy(text, c) >= limit
