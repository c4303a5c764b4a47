"""Alignment of two tokenizers over the same bytes, and the corpus-wide counts of the token pairs that end together.

Tokens are nodes; each points to its farthest-right overlapping token: a token of the one tokenizer to the token of the other
that covers its last byte. Where tokens of both end at one byte, the second tokenizer's points to itself and is the terminal token of
its group. Doubling the pointers (each takes its successor's) until nothing changes brings every token to its terminal, which labels its
group. A block of documents is laid out in one line of bytes and labelled at once.

Counting pairs takes a second step, as a link's count is known only when all texts are read. A block holds each of its
pairs once, with the number of times it stands there, and its links as positions in that list; so the counts travel per
block and pair, not per link, and texts are neither shuffled nor tokenized again.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from changelake.llm.common import arrow_map, narrowed, stored
from changelake.llm.texthash import slices

#: Bytes of text whose tokens are laid out and labelled at once; a longer text comes alone.
SLICE = 512 << 10
#: Bytes of text that share one list of pairs.
BLOCK = 8 << 20
#: Fixed value: how byte-level files cut a text into words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs are numbers: id of the first tokenizer times this, plus id of the second.
_PAIR = 1 << 32


class Vocabulary:
    """One tokenizer: ids of texts, and the bytes of each id's token."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        #: An id's decimal digits with each of the marks that may follow it.
        self.named = [[f"{i}{mark}".encode() for i in range(len(pieces))] for mark in ",|;"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(Vocabulary):
    """A byte-level BPE file of the tokenizers library; texts get a space in front. Special tokens' strings are plain text.

    If the file is a plain byte-level BPE whose merges are numbered like its tokens, its ids are those of the same vocabulary as ranks, and
    tiktoken gives them at a quarter of the cost; else the tokenizers library encodes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        # byte-level files write bytes as characters: printable Latin-1 as itself, the rest from U+0100 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = file["model"]["vocab"]
        names = {v: k for k, v in vocab.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        super().__init__([bytes(byte_of.get(c, 0) for c in names.get(i, "")) for i in range(max(names, default=-1) + 1)])
        added = {t["id"] for t in file["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        split = file["pre_tokenizer"] or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        as_ranks = (
            file["normalizer"] is None and file["post_processor"] is None and file["model"]["type"] == "BPE" and not any(file["model"].get(x) for x in options)
            and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
            and all(t["special"] for t in file["added_tokens"])
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab.keys() - {t["content"] for t in file["added_tokens"]}) == 256 + len(merges)
        )
        if as_ranks:
            import tiktoken

            ranks = {p: i for i, p in enumerate(self.pieces) if i not in added}
            self.tool = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.run = lambda texts: [self.tool.encode_ordinary(t) for t in texts]
        else:
            self.tool = library(path)
            self.run = lambda texts: [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.run([" " + t for t in texts])


def library(path: str):  # noqa: ANN201
    """The file as the tokenizers library reads it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    tool.no_padding()
    tool.no_truncation()
    return tool


class Pieces(Vocabulary):
    """A SentencePiece model that puts a space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.tool.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tool.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The tokenizer of a file, by its ending; loaded once a process."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def successors(ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Position, among the rising `other` ends, of the token that covers the last byte of each token."""
    return np.searchsorted(other, ends, "left")


def labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terminal token of each A and B token, as its position in B. Both lists rise, and end at the same byte.

    Nodes are A tokens, then B tokens. The number of rounds grows with the logarithm of the longest group.
    """
    n = len(a_ends)
    to_b, to_a = successors(a_ends, b_ends), successors(b_ends, a_ends)
    own = np.arange(len(b_ends))
    ends_here = a_ends[to_a] == b_ends if len(b_ends) else np.zeros(0, bool)
    at = np.concatenate([n + to_b, np.where(ends_here, n + own, to_a)])
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at[:n] - n, at[n:] - n
        at = further


class _Line:
    """Tokens of some texts on one line of bytes: what the results of each text need."""

    def __init__(self, texts: list[str], first: Vocabulary, second: Vocabulary):
        ids = [first.encode(texts), second.encode(texts)]
        for i, text in enumerate(texts):
            want = (" " + text).encode()
            whole = text and all(b"".join(map(v.pieces.__getitem__, x[i])) == want for v, x in zip((first, second), ids, strict=True))
            if not whole:
                ids[0][i], ids[1][i] = [], []
        self.n = [np.array([len(x) for x in side], np.int64) for side in ids]
        a, b = (np.array([t for x in side for t in x], np.int64) for side in ids)
        a_ends, b_ends = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
        a_label, b_label = labels(a_ends, b_ends)
        last = np.flatnonzero(b_label == np.arange(len(b)))  # terminal B tokens, one for each group
        #: Distinct pairs, and the place of each link's pair among them.
        self.pairs, self.links = np.unique(a[np.searchsorted(a_ends, b_ends[last])] * _PAIR + b[last], return_inverse=True)
        of_b = np.repeat(np.arange(len(texts)), self.n[1])
        self.groups = np.bincount(of_b[last], minlength=len(texts))
        self.digests = self._digests(a, b, np.searchsorted(last, a_label), np.searchsorted(last, b_label), first, second)

    def _digests(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, first: Vocabulary, second: Vocabulary) -> list[str]:
        """Hash of each text's groups, written `a1,a2|b1;a3|b2,b3`."""
        written = [np.empty(len(a), object), np.empty(len(b), object)]
        for out, side, group, vocab, close in zip(written, (a, b), (a_group, b_group), (first, second), (1, 2), strict=True):
            closing = np.ones(len(side), bool)
            closing[:-1] = group[1:] != group[:-1]
            mark = np.where(closing, close, 0)
            out[:] = [vocab.named[m][i] for m, i in zip(mark.tolist(), side.tolist(), strict=True)]
        # a group's A tokens, then its B tokens: a token's place is its own number plus that of the other side's tokens before it
        line = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = written[0]
        line[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = written[1]
        ends = np.cumsum(self.n[0] + self.n[1])
        tokens = line.tolist()
        return [hashlib.sha256(b"".join(tokens[e - n : e])[:-1]).hexdigest() if n else "" for e, n in zip(ends.tolist(), (self.n[0] + self.n[1]).tolist(), strict=True)]


def _ship(docs: DataFrame, path: str) -> str:
    """Hand a vocabulary file to all executors, also to later ones; returns its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed: all their lowest bytes first, then all second ones, and so on."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def token_blocks(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in blocks of about 8 MB of text: block, docs (one struct each), links (positions in pairs, in order,
    packed), pairs (distinct) and times (how often each stands in the block)."""
    first, second = _ship(docs, first), _ship(docs, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabs = vocabulary(SparkFiles.get(first)), vocabulary(SparkFiles.get(second))
        rows: list[dict] = []
        lines: list[tuple[np.ndarray, np.ndarray]] = []
        held = made = 0
        task = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            known = np.unique(np.concatenate([p for p, _ in lines]))
            at = np.concatenate([np.searchsorted(known, p).astype("<u4")[links] for p, links in lines])
            times = np.bincount(at, minlength=len(known))
            order = np.argsort(-times, kind="stable")  # frequent pairs get small numbers, which pack well
            place = np.empty(len(known), "<u4")
            place[order] = np.arange(len(known))
            at, known, times = place[at], known[order], times[order]
            name = f"{task}-{made}"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([rows], pa.list_(_DOC)), pa.array([packed(at)], pa.binary()),
                 pa.array([known], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))],
                names=["block", "docs", "links", "pairs", "times"],
            )

        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                texts = [t or "" for t in batch.column(1)[low:high].to_pylist()]
                line = _Line(texts, *vocabs)
                for i, key in enumerate(batch.column(0)[low:high].to_pylist()):
                    groups = int(line.groups[i])
                    rows.append({"doc_id": key, "n_a": int(line.n[0][i]), "n_b": int(line.n[1][i]), "n_groups": groups, "groups_sha256": line.digests[i]})
                lines.append((line.pairs, line.links))
                held += sum(map(len, texts))
                if held >= BLOCK:
                    yield block()
                    rows, lines, held, made = [], [], 0, made + 1
        if rows:
            yield block()

    narrow = narrowed(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    schema = "block string, docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string>>, links binary, pairs array<bigint>, times array<bigint>"
    return arrow_map(narrow, run, schema)


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n: how many links of all blocks hold it. Added up in every task before the shuffle."""
    rows = blocks.select(F.arrays_zip("pairs", "times").alias("z")).select(F.inline("z"))
    return rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links of every whole text under two tokenizers, and how common its links are in the corpus.

    first: path of a byte-level BPE file of the tokenizers library, second: of a SentencePiece model; both are read where they lie on the
    driver and handed to the executors. Returns one row per row of `docs`: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links
    whose count is their B id's highest, ties included), count_sum (counts added over links), groups_sha256. A text that is null or
    empty, or that one of the tokenizers does not give back byte for byte, has zeros and ''. Repeated rows count
    and return as often as they stand there, a null id is a row like others, extra columns are left alone, and an empty table gives no rows.
    """
    blocks = stored(token_blocks(docs, first, second, id_col, text_col), "aligned-blocks")
    counts = stored(pair_counts(blocks), "aligned-counts")
    # one row for each id of the second vocabulary
    best = counts.groupBy((F.col("pair") % _PAIR).alias("b")).agg(F.max("n").alias("most"))
    judged = counts.join(best, F.col("pair") % _PAIR == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    places = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    known = places.join(judged, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("known"))
    both = blocks.select("block", "docs", "links").join(known, "block", "left").select("docs", "links", F.col("known.n").alias("n"), F.col("known.best").alias("best"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = batch.column(0)[i].values
                groups = rows.field("n_groups").to_numpy()
                links = unpacked(batch.column(1)[i].as_py(), int(groups.sum()))
                ends = np.concatenate([[0], np.cumsum(groups)])
                n, best = (batch.column(j)[i].values for j in (2, 3))
                n = n.to_numpy() if n is not None else np.zeros(0, np.int64)
                best = best.to_numpy(zero_copy_only=False).astype(np.int64) if best is not None else np.zeros(0, np.int64)
                upto = [np.concatenate([[0], np.cumsum(x[links])])[ends] for x in (best, n)]
                out = [rows.field("doc_id"), rows.field("n_a"), rows.field("n_b"), rows.field("n_groups"), rows.field("n_groups"), *[pa.array(np.diff(x)) for x in upto], rows.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return arrow_map(both, finish, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
