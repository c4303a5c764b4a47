"""Byte-level BPE: encoding by folding ranked merges over the bytes of distinct words, decoding by joining binary pieces.

An Arrow function splits a block of documents into the pattern's words and keeps each distinct one once; the blocks are written.
Spark's higher-order functions fold the merges over distinct words: the fold's state is the list of byte runs with the rank of every
adjacent pair, and each step merges the leftmost pair of lowest rank. The ranks are one row that is copied to every task; as a look-up in a
Spark map scans its entries, it holds an array of small maps, picked by the hash of the bytes. Words that stand in most blocks
are folded once and shipped, COMMON of them at most; each block folds its other words. A last Arrow function puts the ids in document order.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changelake.llm.common import arrow_map, give_back, narrowed, stored
from changelake.llm.texthash import slices

#: Small maps that the ranks are dealt over.
MAPS = 1 << 16
#: Characters of text that share one list of distinct words; a longer text comes alone.
BLOCK = 8 << 20
#: No pair of these bytes is a token; above every rank.
_NO_RANK = 2**31 - 1
#: Words that are folded once for all blocks, and their bytes, at most; both bound what is shipped, neither changes a result.
COMMON = 1 << 19
COMMON_BYTES = 32
#: Runs of a word up to which a position is found by counting.
SHORT_LIST = 256
#: Places within a word take 32 bits; Spark's binaries are shorter.
_STARTS = 1 << 32


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines "base64 rank". Read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _spark_hash(keys: list[bytes]) -> np.ndarray:
    """Spark's hash() (Murmur3, 32 bits, seed 42) of binaries."""
    out = np.empty(len(keys), np.int64)
    for i, key in enumerate(keys):
        h = 42
        whole = len(key) // 4 * 4
        words = list(np.frombuffer(key[:whole], "<i4").tolist()) + [b if b < 128 else b - 256 for b in key[whole:]]
        for k in words:
            k = (k * 0xCC9E2D51) & 0xFFFFFFFF
            k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
            h ^= (k * 0x1B873593) & 0xFFFFFFFF
            h = ((h << 13) | (h >> 19)) & 0xFFFFFFFF
            h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= len(key)
        h = ((h ^ (h >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
        h = ((h ^ (h >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
        h ^= h >> 16
        out[i] = h - (1 << 32) if h >= 1 << 31 else h
    return out


@lru_cache(maxsize=4)
def _rank_maps(path: str) -> list[dict[bytes, int]]:
    """The ranks dealt over MAPS small maps by Spark's hash of the bytes."""
    ranks = read_ranks(path)
    maps: list[dict[bytes, int]] = [{} for _ in range(MAPS)]
    for token, at in zip(ranks, (_spark_hash(list(ranks)) % MAPS).tolist(), strict=True):
        maps[at][token] = ranks[token]
    return maps


def _rank_json(path: str) -> str:
    return json.dumps([{token.hex(): rank for token, rank in m.items()} for m in _rank_maps(path)], separators=(",", ":"))


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """One row, one column, rank_maps: the small maps, to be joined to few rows. As a literal they would stand in every description of a
    plan, some MB each time, and be parsed for each row."""
    kind = pa.list_(pa.map_(pa.binary(), pa.int32()))
    row = pa.table({"rank_maps": pa.array([[list(m.items()) for m in _rank_maps(path)]], kind)})
    return stored(spark.createDataFrame(row), "bpe-ranks")


def _rank_of(table: Column, run: Column) -> Column:
    """Rank of a run of bytes, or null. A map's absent key gives null."""
    return F.element_at(F.get(table, F.pmod(F.hash(run), F.lit(MAPS))), run)


def encode_word(word: Column, table: Column, longest: int) -> Column:
    """Ids of one word, a binary, as array<int>; longest is the number of bytes of the longest token.

    The fold's state is one number for each run of bytes: the rank of the pair it forms with the next run, then where it starts.
    So the least number is the leftmost pair of lowest rank. A step puts the list together from the parts before and after that
    pair, which are copied as they are, and looks up the two pairs that are new. The steps are as many as the bytes.
    """
    size = F.length(word)
    start_of = lambda code: code.bitwiseAND(_STARTS - 1).cast("int")
    run = lambda begin, until: F.substring(word, begin, until - begin)
    end = size + 1
    no_pair = F.lit(_NO_RANK * _STARTS)

    def code(begin: Column, until: Column) -> Column:
        known = F.when(until - begin <= longest, _rank_of(table, run(begin, until)))
        return F.coalesce(known, F.lit(_NO_RANK)).cast("bigint") * _STARTS + begin

    def merged(state: Column, i: Column) -> Column:
        """Merge the run at i (from 0) with the next one."""
        start = lambda k: start_of(F.get(state, k))
        last = F.size(state) == i + 2
        third = F.coalesce(start(i + 2), end)

        def changed(old: Column, k: Column) -> Column:
            with_next = F.when(last, no_pair + start_of(old)).otherwise(code(start_of(old), F.coalesce(start(i + 3), end)))
            return F.when((k > i + 1) | (k < i - 1), old).when(k == i, with_next).when(k < i, code(start_of(old), third))

        return F.array_compact(F.transform(state, changed))

    def place(state: Column, lowest: Column) -> Column:
        """Position (from 0) of a number of the state. The list is in order of the starts, so in a short one those before it are
        counted; what this saves over array_position was not measured by itself."""
        before = lambda code: code.bitwiseAND(_STARTS - 1) < lowest.bitwiseAND(_STARTS - 1)
        found = (F.array_position(state, lowest) - 1).cast("int")
        return F.when(F.size(state) > SHORT_LIST, found).otherwise(F.size(F.filter(state, before)))

    def step(state: Column, _: Column) -> Column:
        # a fold over one element gives a value a name, so that it is found once
        merge = lambda s, lowest: F.aggregate(F.array(place(s, lowest)), s, merged)
        return F.aggregate(F.array(F.array_min(state)), state, lambda s, lowest: F.when(lowest < no_pair, merge(s, lowest)).otherwise(s))

    state = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i + 1 < end, code(i, i + 2)).otherwise(no_pair + i))
    ids = lambda s: F.transform(s, lambda v, k: _rank_of(table, run(start_of(v), F.coalesce(start_of(F.get(s, k + 1)), end))))
    whole = _rank_of(table, word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.aggregate(F.sequence(F.lit(2), size), state, step, ids))


def encode_words(words: Column, ranks: str, maps: Column | None = None) -> Column:
    """Ids of each word of a list of binaries, as array<array<int>>; ranks is the path of the rank file, maps the column of its rank_table.

    Without maps they are a literal that holds the tokens in hex, as JSON has no bytes. Either way they become objects
    once for each list of words, so that a look-up copies no map.
    """
    if maps is None:
        literal = F.from_json(F.lit(_rank_json(ranks)), "array<map<string,int>>")
        table = F.transform(literal, lambda tokens: F.transform_keys(tokens, lambda token, _: F.unhex(token)))
    else:
        table = F.transform(maps, lambda tokens: F.transform_keys(tokens, lambda token, _: token))
    longest = max(map(len, read_ranks(ranks)), default=0)
    none = F.array().cast("array<array<int>>")
    # a fold over one element names the table, so that it is made once
    return F.aggregate(F.array(table), none, lambda _, named: F.transform(words, lambda word: encode_word(word, named, longest)))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array of int), ids_sha256 (of the ids as little-endian 32-bit numbers).

    ranks: path of the rank file, read on the driver. pattern: a regular expression whose matches are encoded one by one; text
    between matches is left out, as the usual patterns match everything. No special tokens. One row per input row, in any
    order; null and empty texts have no ids. Repeated rows, null ids and extra columns do no harm. Every block of text is
    ended by the document that fills BLOCK characters. The blocks are written under the checkpoint folder.
    """
    find = regex.compile(pattern).findall

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes: list[int] = []
        index: list[np.ndarray] = []
        known: dict[str, int] = {}
        held = 0

        def block() -> pa.RecordBatch:
            order = np.concatenate(index) if index else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([order.tobytes()], pa.binary()),
                 pa.array([[k.encode() for k in known]], pa.list_(pa.binary()))],
                names=["ids", "sizes", "word_index", "words"],
            )

        for batch in batches:
            for low, high in slices(batch.column(1)):
                for key, text in zip(batch.column(0)[low:high].to_pylist(), batch.column(1)[low:high].to_pylist(), strict=True):
                    words = find(text or "")
                    numbers = np.fromiter((known.setdefault(word, len(known)) for word in words), np.int32, len(words))
                    ids.append(key)
                    sizes.append(len(words))
                    index.append(numbers)
                    held += len(text or "")
                    if held >= BLOCK:
                        yield block()
                        ids, sizes, index, known, held = [], [], [], {}, 0
                        give_back()
        if ids:
            yield block()

    narrow = narrowed(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    blocks = stored(arrow_map(narrow, split, "ids array<bigint>, sizes array<int>, word_index binary, words array<binary>"), "bpe-blocks", "zstd")
    table = rank_table(docs.sparkSession, ranks)
    common = common_words(blocks.select("words"), ranks, table)
    shared_cuts, shared_ids = common.column("ids").offsets.to_numpy(), common.column("ids").values.to_numpy(zero_copy_only=False)
    shared_words = common.column("word")

    def leave_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                words = batch.column(3)[row].values
                place = pc.fill_null(pc.index_in(words, value_set=shared_words), -1).to_numpy().astype(np.int32)
                rest = words.filter(pa.array(place < 0))
                lists = pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest)
                columns = [c.slice(row, 1) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([place.tobytes()], pa.binary()), lists], names=["ids", "sizes", "word_index", "place", "words"])
                give_back()  # the words are folded before the next block comes

    def documents(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
        keys, sizes = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy()
        index, place = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in (2, 3))
        coded = batch.column(4)[row].values
        cuts = coded.offsets.to_numpy()
        flat = np.concatenate([shared_ids, coded.values.to_numpy(zero_copy_only=False)])
        begin, size = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        own = place < 0
        begin[~own], size[~own] = shared_cuts[place[~own]], np.diff(shared_cuts)[place[~own]]
        begin[own], size[own] = cuts[:-1] + len(shared_ids), np.diff(cuts)
        ends = np.cumsum(sizes)
        for low in range(0, len(sizes), 256):
            high = min(low + 256, len(sizes))
            part = index[ends[low] - sizes[low] : ends[high - 1]]
            lengths = size[part]
            total = np.concatenate([[0], np.cumsum(lengths)])
            tokens = flat[np.repeat(begin[part] - total[:-1], lengths) + np.arange(total[-1])].astype("<i4")
            bounds = total[np.concatenate([[0], np.cumsum(sizes[low:high])])].astype(np.int32)
            digests = [hashlib.sha256(tokens[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(tokens, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys[low:high], lists, pa.array(digests)], names=["doc_id", "ids", "ids_sha256"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                yield from documents(batch, row)
                give_back()  # the next block's words are folded before it comes

    others = arrow_map(blocks, leave_common, "ids array<bigint>, sizes array<int>, word_index binary, place binary, words array<binary>")
    coded = others.crossJoin(F.broadcast(table)).select(
        "ids", "sizes", "word_index", "place", encode_words(F.col("words"), ranks, F.col("rank_maps")).alias("coded")
    )
    return arrow_map(coded, join, "doc_id bigint, ids array<int>, ids_sha256 string")


def common_words(blocks: DataFrame, ranks: str, table: DataFrame) -> pa.RecordBatch:
    """Words that stand in most blocks (one column, words: a list of distinct ones per block) with their ids: word, ids.

    Words of more than one block and of COMMON_BYTES bytes at most, counted over all blocks; those above a count that leaves COMMON words
    or fewer. The cut comes from a histogram of the counts, some hundred rows. No blocks give no rows.
    """
    word = blocks.select(F.explode("words").alias("word")).where(F.length("word") <= COMMON_BYTES)
    steps = F.floor(F.log2("n") * 8).cast("int").alias("step")
    counted = stored(word.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word", steps), "bpe-words")
    kept, cut = 0, None
    for step, n in sorted(counted.groupBy("step").count().toLocalIterator(), reverse=True):
        kept += n
        if kept > COMMON:
            break
        cut = step
    chosen = counted.where(F.col("step") >= cut) if cut is not None else counted.limit(0)
    lists = chosen.groupBy(F.pmod(F.hash("word"), F.lit(48)).alias("part")).agg(F.sort_array(F.collect_list("word")).alias("words"))
    lists = lists.repartition(48, "part").crossJoin(F.broadcast(table))
    lists = lists.select("words", encode_words(F.col("words"), ranks, F.col("rank_maps")).alias("ids"))
    pairs = lists.select(F.explode(F.arrays_zip("words", "ids")).alias("pair"))
    got = stored(pairs.select("pair.words", "pair.ids"), "bpe-common").toArrow().combine_chunks()
    types = (pa.binary(), pa.list_(pa.int32()))
    columns = [pa.concat_arrays(c.chunks).cast(t) if c.num_chunks else pa.array([], t) for c, t in zip(got.columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "ids"])


def decode(ids: Column, ranks: str) -> Column:
    """Bytes of a list of ids: their binary pieces one after the other. Null for a null list or an unknown id."""
    pieces: list[str] = [""] * (max(read_ranks(ranks).values(), default=-1) + 1)
    for token, rank in read_ranks(ranks).items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    known = (F.size(ids) == 0) | ((F.array_min(ids) >= 0) & (F.array_max(ids) < len(pieces)))
    return F.when(known, F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")))


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode every document and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, ranks, pattern).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids_sha256", F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256")
    )
