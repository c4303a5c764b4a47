"""Benchmark decontamination: rare n-gram seeds propose passages, Smith-Waterman alignment scores them.

Word n-grams of the test items that are rare in the corpus, of four, three and two words, are looked for in all documents. Around every hit a passage long enough for the whole item is aligned locally, word by word, with the
item, so that copies with changed, added or left-out words are found too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from changelake.llm.common import arrow_map, narrowed, packed, stored, text_or_empty
from changelake.llm.texthash import Words, slices, windows

#: Bits of the table that tells most other n-grams from those of the items: a fixed size, whatever the items.
BITS = 25
#: Bytes that are no part of a word: ASCII other than letters and digits.
_APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Settings:
    """n: words of a seed; items of `short` words or more have seeds of the sizes in `smaller` too. threshold: least score / best possible score of an item, where a word that agrees scores `match`, one
    that differs costs `differ` and one that is added or left out costs `gap`. An item of fewer than `short` words is
    only found as it is: by chance a few words agree anywhere."""

    n: int = 4
    smaller: tuple[int, ...] = (3, 2)
    threshold: float = 0.5
    match: int = 2
    differ: int = 1
    gap: int = 1
    short: int = 8


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(pc.fill_null(texts, "")), _APART)


def align(item: np.ndarray, passage: np.ndarray, s: Settings) -> int:
    """Best local alignment score of two sequences of word hashes."""
    best = 0
    steps = np.arange(len(passage) + 1) * s.gap
    row = np.zeros(len(passage) + 1, np.int64)
    for word in item:
        new = np.zeros(len(row), np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, s.match, -s.differ), row[1:] - s.gap)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps  # words of the passage that the item lacks
        best = max(best, int(row.max()))
    return best


def _bit_table(grams: DataFrame) -> np.ndarray:
    """Which high bits of `gram` occur, eight to a byte. Built by Spark; the driver gets 2 ** BITS bits in pieces of 4 KB."""
    bit = F.shiftrightunsigned("gram", 64 - BITS) + 1  # buckets of bits count from 1
    pieces = grams.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for row in pieces.toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        table[(row["piece"] - 1) * len(bits) : row["piece"] * len(bits)] = bits
    return table


def _hits(w: Words, table: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all sizes in the texts that the table lets through, in order, and the index of their first words."""
    hashes = w.hashes()
    grams, places = [], []
    for n in (s.n, *s.smaller):
        gram, first = windows(w, hashes, n, short=n == s.n)
        bit = (gram >> np.uint64(64 - BITS)).astype(np.int64)
        hit = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        grams.append(gram[hit])
        places.append(first[hit])
    first = np.concatenate(places)
    order = np.argsort(first, kind="stable")
    return np.concatenate(grams)[order].view(np.int64), first[order]


def _item_grams(items: DataFrame, s: Settings) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _words(batch.column(1))
            hashes, counts = w.hashes(), w.counts()
            for n in (s.n, *s.smaller):
                gram, at = windows(w, hashes, n, short=n == s.n)
                if n != s.n:
                    long = counts[w.doc[at]] >= s.short
                    gram, at = gram[long], at[long]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(w.doc[at])), pa.array(gram.view(np.int64)), pa.array(counts[w.doc[at]]), pa.array(np.full(len(at), n, np.int32))],
                    names=["item_key", "gram", "n_words", "size"],
                )

    return arrow_map(items.select("item_key", "item"), split, "item_key binary, gram bigint, n_words bigint, size int")


def contaminated(docs: DataFrame, items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold a copy, edited or not, of a test item.

    Returns one row per pair found: doc_id, item_id, score (0 to 1; 1 is a whole copy) and text_key (md5 of the text, which tells the
    documents apart when ids are null or repeated). Case and punctuation do not count. Null texts count as empty and match
    nothing, and so do items without words; an item of fewer than `n` words is only found in a document of just these words; items of equal text are all reported; a repeated document gives one row for each item.
    Empty documents or items give an empty result. Extra columns are ignored. Documents are read whole, however long.
    """
    docs = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.unhex(F.md5(text_or_empty())).alias("text_key")
    )
    named = narrowed(items, item_id=item_col, item=item_text_col).select(
        "item_id", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.unhex(F.md5(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("item_key")
    )
    texts = stored(named.select("item_key", "item").distinct(), "decontam-items")
    grams = stored(_item_grams(texts, s), "decontam-grams")
    longest = grams.agg(F.max("n_words")).first()[0] or 0
    seeds = stored(_rare_seeds(docs, grams, s), "decontam-seeds")
    passages = stored(_passages(docs, _bit_table(seeds), longest + longest // 4 + s.n, s), "decontam-passages")
    apart = passages.groupBy("key").agg(F.first("passage").alias("passage"), F.first("grams").alias("grams"))
    apart = stored(apart, "decontam-apart")
    pairs = apart.select("key", F.explode("grams").alias("gram")).join(seeds.select("gram", "item_key"), "gram").select("key", "item_key").distinct()
    pairs = stored(pairs, "decontam-pairs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch))
            one, other = _words(batch.column(2)), _words(batch.column(3))
            h1, h2 = one.hashes(), other.hashes()
            cut1, cut2 = np.searchsorted(one.doc, np.arange(len(batch) + 1)), np.searchsorted(other.doc, np.arange(len(batch) + 1))
            for i in range(len(batch)):
                item, passage = h2[cut2[i] : cut2[i + 1]], h1[cut1[i] : cut1[i + 1]]
                if len(item):
                    out[i] = align(item, passage, s) / (s.match * len(item))
                    if len(item) < s.short and out[i] < 1:
                        out[i] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["key", "item_key", "score"])

    met = pairs.join(apart.select("key", "passage"), "key").join(texts, "item_key").select("key", "item_key", "passage", "item")
    scored = arrow_map(met, score, "key binary, item_key binary, score double").where(F.col("score") >= s.threshold)
    scored = stored(scored, "decontam-scored")
    hits = passages.select("doc_id", "text_key", "key").join(scored, "key").groupBy("doc_id", "text_key", "item_key").agg(F.max("score").alias("score"))
    return hits.join(named.select("item_id", "item_key").distinct(), "item_key").select("doc_id", "item_id", "score", "text_key")


def _rare_seeds(docs: DataFrame, grams: DataFrame, s: Settings) -> DataFrame:
    """(gram, item_key): the n-grams of each item that are rare in the documents.

    Rare is what at most one document in a thousand holds (or ten), or what is no more than four times as frequent as the item's middle
    n-gram: all n-grams of an item that was copied into a third of the documents are frequent, and then they are what tells it. Two words
    are rare if at most one document in ten thousand holds them (or ten): unlike longer runs they meet by chance.
    """
    table = _bit_table(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(0)):
                w = _words(batch.column(0).slice(at, to - at))
                gram, first = _hits(w, table, s)
                pairs = np.unique(np.stack([w.doc[first].astype(np.int64), gram]), axis=1)
                found, n = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["gram", "n"])

    counted = arrow_map(docs.select("text"), count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("df"))
    of_items = grams.select("gram", "item_key", "size").distinct()
    known = stored(of_items.join(counted, "gram", "left").select("gram", "item_key", "size", F.coalesce("df", F.lit(0)).alias("df")), "decontam-df")
    middle = known.where(F.col("size") == s.n).groupBy("item_key").agg(F.expr("percentile_disc(0.5) within group (order by df)").alias("middle"))
    n_docs = docs.count()
    limit = F.when(F.col("size") == 2, max(10, n_docs // 10_000)).otherwise(F.greatest(F.lit(max(10, n_docs // 1000)), 4 * F.col("middle")))
    return known.join(middle, "item_key").where(F.col("df") <= limit).select("gram", "item_key")


def _passages(docs: DataFrame, table: np.ndarray, reach: int, s: Settings) -> DataFrame:
    """Runs of words around the hits: `reach` words before the first and after the last of hits that lie close together.

    Hits further than 4 * reach from a passage's first one begin another, so a passage is never longer than 6 * reach words
    and every hit has the words that its item can need.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                w = _words(part.column(1))
                gram, first = _hits(w, table, s)
                doc = w.doc[first]
                limits = np.searchsorted(w.doc, np.arange(len(part) + 1))
                rows, texts, found = [], [], []
                at = 0
                while at < len(first):
                    to = at + 1
                    while to < len(first) and doc[to] == doc[at] and first[to] - first[to - 1] <= 2 * reach and first[to] - first[at] <= 4 * reach:
                        to += 1
                    d = doc[at]
                    begin, end = max(limits[d], first[at] - reach), min(limits[d + 1], first[to - 1] + s.n + reach)
                    rows.append(d)
                    texts.append(b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(begin, end)).decode())
                    found.append(np.unique(gram[at:to]))
                    at = to
                if rows:
                    take = pa.array(np.array(rows, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(2).take(take), pa.array(texts), pa.array(found, pa.list_(pa.int64()))],
                        names=["doc_id", "text_key", "passage", "grams"],
                    )

    cut_out = arrow_map(docs.select("doc_id", "text", "text_key"), cut, "doc_id bigint, text_key binary, passage string, grams array<bigint>")
    return cut_out.withColumn("key", F.unhex(F.md5("passage")))


def without_contaminated(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) whose text holds no test item.

    Null and empty texts stay, and so do repeated rows; other columns come back as they are, whatever their names. Without
    items all rows stay; an empty table stays empty.
    """
    bad = stored(contaminated(docs, items, s).select("text_key").distinct(), "decontam-bad")
    return packed(docs, text_key=F.unhex(F.md5(text_or_empty()))).join(bad, "text_key", "left_anti").select("row.*")
