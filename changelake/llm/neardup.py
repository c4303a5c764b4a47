"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Every text becomes a weighted set of five-word shingles. Consistent weighted samples agree between two texts with the
probability of their weighted Jaccard similarity; bands of samples propose pairs, and each proposed pair is verified
on the whole texts. Verified links are closed into classes.

How links are sought inside a band's bucket: every member is compared with one centre, the member that meets most texts in all
its buckets, such as the original of many edited copies. Links of all bands are closed into classes. Then every two members of a
bucket that are in different classes are compared, in blocks of both sides, settled or not: the members outside the bucket's largest
class meet all members. Each pair is compared in the first band it shares only. After that every pair that shares a bucket was
compared or is in one class. So a bucket of n copies of one text costs n comparisons, and m members outside its largest class cost m * n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from changelake.llm.classes import connected_classes
from changelake.llm.common import arrow_map, packed, stored, text_or_empty
from changelake.llm.texthash import SMALL_SLICE, Words, mix, slices, windows

#: Document frequencies are counted by this many hash buckets: a fixed size, whatever the corpus.
DF_BUCKETS = 1 << 18
#: Rows of the table of random numbers that a shingle's hash picks from.
RANDOM_ROWS = 1 << 14
#: Members of a bucket on one side of a block, and bytes of their texts; a longer text comes alone or with few others.
BLOCK_MEMBERS = 512
BLOCK_BYTES = 4 << 20
#: Bits of the table of texts that meet another one, 4 MB. The more texts meet one, the more of the others are sent along.
MET_BITS = 1 << 25
#: Sums of weights differ by less than this with the order of their terms.
ROUNDING = 1e-6


@dataclass(frozen=True)
class Settings:
    """bands x rows samples: a pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands, that is
    0.995 at 0.8 for 17 x 6."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 17
    rows: int = 6
    seed: int = 7
    #: Weight of a shingle no other text has, over that of one all texts have, less 1. Common shingles of a large family of copies
    #: are frequent for that reason; with a small spread these do not pull the similarity of its members below the threshold.
    idf_spread: float = 0.25


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) pairs, sorted, and how often each occurs. Lower case; short texts give one shingle."""
    w = Words(pc.utf8_lower(pc.fill_null(texts, "")))
    found, at = windows(w, w.hashes(), n, short=True)
    doc = w.doc[at]
    order = np.argsort(found, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(new)
    return doc[first], found[first], np.diff(np.append(first, len(doc)))


def document_frequency(texts: DataFrame, s: Settings) -> np.ndarray:
    """Inverse document frequency per hash bucket, between 1 and 1 + idf_spread, over all rows of `texts` (one column, text).

    A bucket counts the texts that hold any of its shingles, an upper bound of a shingle's own count that exceeds it by the
    mean number of shingles a text / DF_BUCKETS: shingles of widespread passages stand out, all others weigh much the same.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            n += len(batch)
            for at, to in slices(batch.column(0), SMALL_SLICE):
                _, found, _ = shingles(batch.column(0).slice(at, to - at), s.words)
                total += np.bincount((found & np.uint64(DF_BUCKETS - 1)).astype(np.int64), minlength=DF_BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], names=["bucket", "n"])

    counted = arrow_map(texts, count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # DF_BUCKETS + 1 rows at most
    buckets, n = got["bucket"].to_numpy(), got["n"].to_numpy().astype(np.float64)
    size = float(n[buckets == -1].sum())
    df = np.zeros(DF_BUCKETS)
    df[buckets[buckets >= 0]] = n[buckets >= 0]
    return (1 + s.idf_spread * np.log((1 + size) / (1 + np.minimum(df, size))) / np.log(2 + size)).astype(np.float32)


@dataclass(frozen=True)
class Side:
    """Members of a bucket; key and label are arrays of bytes, bands one row a member, rest: not in the bucket's largest class,
    weight: of all shingles of the text. Texts are there only for the comparison itself."""

    key: np.ndarray
    label: np.ndarray
    rest: np.ndarray
    bands: np.ndarray
    weight: np.ndarray
    texts: pa.Array | None


@lru_cache(maxsize=1)
def _random_tables(seed: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, log c, beta and the mark of each of k samples. Made from the seed where they are used, so that 20 MB of them are never sent."""
    draw = np.random.Generator(np.random.PCG64(seed))
    shape = (RANDOM_ROWS, k)
    r = draw.gamma(2.0, 1.0, shape).astype(np.float32)
    log_c = np.log(draw.gamma(2.0, 1.0, shape)).astype(np.float32)
    return r, log_c, draw.random(shape, np.float32), mix(np.arange(1, k + 1, dtype=np.uint64))


class Sampler:
    """Improved consistent weighted sampling; the random numbers of a shingle are a row of fixed tables, picked by its hash."""

    def __init__(self, idf: np.ndarray, s: Settings):
        self.idf, self.s = idf, s

    def weights(self, found: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times * self.idf[(found & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]

    def bands(self, texts: pa.Array) -> np.ndarray:
        """A key for each text and band; texts without words are left to the caller."""
        return self.signed(texts)[0]

    def signed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and the total weight of each text."""
        s = self.s
        doc, found, times = shingles(texts, s.words)
        table_r, table_log_c, table_beta, column = _random_tables(s.seed, s.bands * s.rows)
        weight = self.weights(found, times)
        log_w = np.log(weight).astype(np.float32)
        pick = (mix(found) >> np.uint64(64 - 14)).astype(np.int64)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        samples = np.zeros((len(texts), s.bands * s.rows), np.uint64)
        for i in range(len(texts)):
            best = None
            for low in range(cuts[i], cuts[i + 1], 4_096):  # bounds the memory for very long texts
                high = min(low + 4_096, cuts[i + 1])
                at = pick[low:high]
                r, beta = table_r[at], table_beta[at]
                t = np.floor(log_w[low:high, None] / r + beta)
                log_a = table_log_c[at] - r * (t - beta) - r
                arg = np.argmin(log_a, axis=0)
                columns = np.arange(len(arg))
                value = log_a[arg, columns]
                sample = mix(found[low:high][arg]) + mix((t[arg, columns]).astype(np.int64).view(np.uint64) + column)
                if best is None:
                    best, samples[i] = value, sample
                else:
                    less = value < best
                    best = np.where(less, value, best)
                    samples[i] = np.where(less, sample, samples[i])
        out = np.zeros((len(texts), s.bands), np.uint64)
        for j in range(s.rows):
            out = mix(out * np.uint64(31) + samples[:, j :: s.rows])
        return out, np.bincount(doc, weight, len(texts))

    def open_pairs(self, band: int, left: Side, right: Side) -> np.ndarray:
        """Which pairs are to be compared: one row for each text on the left, one column for each on the right.

        A pair that shares an earlier band too is left to that; of two texts that stand on both sides one order is enough.
        """
        open_ = left.label[:, None] != right.label[None, :]
        open_ &= ~right.rest[None, :] | (left.key[:, None] < right.key[None, :])
        for j in range(band):
            open_ &= left.bands[:, None, j] != right.bands[None, :, j]
        less, more = np.minimum(left.weight[:, None], right.weight[None, :]), np.maximum(left.weight[:, None], right.weight[None, :])
        return open_ & (less >= (self.s.threshold - ROUNDING) * more)

    def links(self, band: int, left: Side, right: Side) -> tuple[np.ndarray, np.ndarray]:
        """Rows of similar texts in different classes, one for each text on the left and class on the right."""
        open_ = self.open_pairs(band, left, right)
        doc, found, times = shingles(right.texts, self.s.words)
        names, at = np.unique(found, return_inverse=True)
        w = self.weights(found, times)
        total = np.bincount(doc, w, len(right.texts))
        doc_l, found_l, times_l = shingles(left.texts, self.s.words)
        w_l = self.weights(found_l, times_l)
        cuts = np.searchsorted(doc_l, np.arange(len(left.texts) + 1))
        place = np.searchsorted(names, found_l)
        known = place < len(names)
        known[known] = names[place[known]] == found_l[known]
        mine = np.zeros(len(names))
        rows, others = [], []
        for i in np.flatnonzero(open_.any(axis=1)):
            part = slice(cuts[i], cuts[i + 1])
            here = place[part][known[part]]
            mine[here] = w_l[part][known[part]]
            both = np.bincount(doc, np.minimum(mine[at], w), len(right.texts))
            mine[here] = 0
            either = w_l[part].sum() + total - both
            hits = np.flatnonzero(open_[i] & (both >= self.s.threshold * either))
            hits = hits[np.unique(right.label[hits], return_index=True)[1]]
            rows.append(np.full(len(hits), i))
            others.append(hits)
        return (np.concatenate(rows), np.concatenate(others)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def similarity(self, one: pa.Array, other: pa.Array) -> np.ndarray:
        """Weighted Jaccard similarity of the texts in the same row of both columns."""
        n = len(one)
        doc, found, w = [], [], []
        for texts in (one, other):
            d, f, times = shingles(texts, self.s.words)
            doc.append(d)
            found.append(f)
            w.append(self.weights(f, times))
        d, f, x = np.concatenate(doc), np.concatenate(found), np.concatenate(w)
        order = np.argsort(f, kind="stable")
        order = order[np.argsort(d[order], kind="stable")]
        d, f, x = d[order], f[order], x[order]
        same = np.flatnonzero((d[1:] == d[:-1]) & (f[1:] == f[:-1]))
        both = np.bincount(d[same], np.minimum(x[same], x[same + 1]), n)
        either = np.bincount(d, x, n) - both
        return np.divide(both, either, out=np.ones(n), where=either > 0)

    def similar(self, one: pa.Array, other: pa.Array) -> np.ndarray:
        """Whether the texts in the same row of both columns are similar, found a small slice of either column at a time."""
        out = np.zeros(len(one), bool)
        for at, to in slices(one, SMALL_SLICE):
            for low, high in slices(other.slice(at, to - at), SMALL_SLICE):
                rows = slice(at + low, at + high)
                out[rows] = self.similarity(one.slice(rows.start, high - low), other.slice(rows.start, high - low)) >= self.s.threshold
        return out


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of near-duplicates of every row.

    Returns one row per input row: doc_id and class_id, the smallest id in its class (a row like no other has its own).
    Rows of equal text always share a class; a null text counts as empty, and texts without any word are alike only if
    they are equal. Texts of 1 to 4 words have one shingle, all their words. Null ids are kept; a class of null ids only has
    a null class_id. Extra columns are ignored. An empty table gives an empty result.
    """
    labelled = _labelled(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), s)
    # the smallest id of each class
    smallest = stored(labelled.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "neardup-ids")
    return labelled.join(smallest, "class_key").select("doc_id", "class_id")


def _labelled(named: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, key, class_key): of every row the key of its text and the key that names its class."""
    keyed = named.withColumn("text", text_or_empty()).withColumn("key", F.unhex(F.md5("text")))
    classes = similar_texts(keyed.select("key", "text"), s).select(F.col("node").alias("key"), F.col("label").alias("class_key"))
    joined = keyed.select("doc_id", "key").join(classes, "key", "left")
    return stored(joined.select("doc_id", "key", F.coalesce("class_key", "key").alias("class_key")), "neardup-labels")


def similar_texts(keyed: DataFrame, s: Settings) -> DataFrame:
    """Classes (node, label) of texts with a verified link to another; keyed has key and text, equal keys for equal texts."""
    idf = document_frequency(keyed.select("text"), s)
    sampler = Sampler(idf, s)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1), SMALL_SLICE):
                part = batch.slice(at, to - at)
                some = pa.array(Words(part.column(1)).counts() > 0)
                part = part.filter(some)
                if len(part):
                    keys, weight = sampler.signed(part.column(1))
                    cuts = pa.array(np.arange(len(part) + 1, dtype=np.int32) * s.bands)
                    lists = pa.ListArray.from_arrays(cuts, pa.array(keys.view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(weight)], names=["key", "bands", "weight"])
        _random_tables.cache_clear()  # a worker stays for later tasks

    signed = arrow_map(keyed, sign, "key binary, bands array<bigint>, weight double")
    signed = stored(signed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("weight").alias("weight")), "neardup-bands")
    members = signed.select("key", F.posexplode("bands").alias("band", "value"))
    shared = members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(stored(shared, "neardup-shared"), ["band", "value"]), "neardup-met")
    # how many others a text meets: the original of many edited copies meets more of them than each of these
    popular = stored(members.groupBy("key").agg(F.sum("n").alias("popular")), "neardup-popular")
    sent = _may_be_in(keyed.select("key", "text"), popular)
    texts = stored(sent.groupBy("key").agg(F.min("text").alias("text")).join(popular.select("key"), "key", "left_semi"), "neardup-texts")
    sizes = texts.select("key", F.octet_length("text").alias("bytes"))
    popular = stored(popular.join(sizes, "key").join(signed.select("key", "weight"), "key"), "neardup-sizes")
    everyone = stored(members.select("band", "value", "key").join(popular, "key"), "neardup-members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = pa.array(sampler.similar(batch.column(2), batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), similar], names=["a", "b", "similar"])

    centre = F.max_by(F.struct("key", "weight"), F.struct("popular", F.xxhash64("key", "band"))).alias("centre")
    centres = everyone.groupBy("band", "value").agg(centre).select("band", "value", F.col("centre.key").alias("centre"), F.col("centre.weight").alias("centre_weight"))
    near = F.least("weight", "centre_weight") >= (s.threshold - ROUNDING) * F.greatest("weight", "centre_weight")
    met = everyone.join(stored(centres, "neardup-centres"), ["band", "value"]).where("key != centre").where(near)
    pairs = met.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    with_texts = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b"
    )
    found = arrow_map(with_texts.select("a", "b", "text_a", "text_b"), compare, "a binary, b binary, similar boolean")
    links = stored(found.where("similar").select("a", "b"), "neardup-pairs")
    classes = stored(connected_classes(links, "a", "b"), "neardup-classes")

    def sides_of(table: pa.Table) -> tuple[pa.Table, pa.Table, Side, Side]:
        parts = [table.filter(table.column("on_left")).combine_chunks(), table.filter(pc.invert(table.column("on_left"))).combine_chunks()]
        sides = []
        for part in parts:
            binary = lambda c: np.array(part.column(c).to_pylist(), dtype=object)  # noqa: B023, E731
            bands = np.array(part.column("bands").to_pylist(), np.int64).reshape(len(part), s.bands)
            texts = pa.array(part.column("text").to_pylist(), pa.string()) if "text" in part.column_names else None
            sides.append(Side(binary("key"), binary("label"), part.column("rest").to_numpy(), bands, part.column("weight").to_numpy(), texts))
        return *parts, *sides

    def with_partner(block: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The members of a block that have someone to be compared with."""
        one, other, left, right = sides_of(table)
        open_ = sampler.open_pairs(block[0].as_py(), left, right) if len(one) and len(other) else np.zeros((len(one), len(other)), bool)
        return pa.concat_tables([one.filter(pa.array(open_.any(axis=1))), other.filter(pa.array(open_.any(axis=0)))])

    def compare_block(block: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, left, right = sides_of(table)
        rows, others = sampler.links(block[0].as_py(), left, right) if len(left.key) and len(right.key) else ([], [])
        return pa.table({"a": pa.array(left.key[rows] if len(rows) else [], pa.binary()), "b": pa.array(right.key[others] if len(rows) else [], pa.binary())})

    block = ("band", "value", "row", "col")
    members = _blocks(stored(_labels(everyone, classes), "neardup-now")).join(signed, "key").select(*block, "on_left", "rest", "key", "label", "bands", "weight")
    wanted = stored(members.groupBy(*block).applyInArrow(with_partner, members.schema), "neardup-wanted").join(texts, "key")
    more = stored(wanted.groupBy(*block).applyInArrow(compare_block, "a binary, b binary"), "neardup-links")
    if more.isEmpty():
        return classes
    return stored(connected_classes(links.unionByName(more), "a", "b"), "neardup-classes")


def _may_be_in(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose key is in `known`, all of them, and of the others about as many as `known` has rows a bit of MET_BITS.

    The bits are copied to every task, MET_BITS of them whatever the size of `known`, so most other rows are left where they are read.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(MET_BITS)) + 1
    part, bit = F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").cast("int").alias("bit")
    bits = known.select(place.alias("place")).select(part, bit).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = rows.withColumn("place", place).select(*rows.columns, part, bit)
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, bit % 8) & 1 = 1")
    met = placed.join(F.broadcast(bits), "part").withColumn("byte", byte).where(is_set)
    return met.select(*rows.columns)


def _blocks(members: DataFrame) -> DataFrame:
    """Members of each block of comparisons (band, value, row, col, on_left, rest, key, label), of buckets with more than one class.

    On the left stand the members outside the largest class of their bucket, on the right all; a row meets every column.
    """
    size = (F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    kinds = stored(members.groupBy("band", "value", "label").agg(*size), "neardup-kinds")
    buckets = kinds.groupBy("band", "value").agg(
        F.count("*").alias("kinds"), F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )
    many = lambda n, size: F.ceil(F.greatest(n / BLOCK_MEMBERS, size / BLOCK_BYTES, F.lit(1)))
    buckets = buckets.where("kinds > 1").select(
        "band", "value", F.col("main.label").alias("main"),
        many(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("rows"), many(F.col("n"), F.col("bytes")).alias("cols"),
    )
    met = stored(members.join(stored(buckets, "neardup-open"), ["band", "value"]).withColumn("rest", F.col("label") != F.col("main")), "neardup-left")
    row, col = (F.pmod(F.xxhash64("key", F.lit(c)), c) for c in ("rows", "cols"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    left = met.where("rest").select("band", "value", row.alias("row"), every("cols").alias("col"), F.lit(True).alias("on_left"), "rest", "key", "label")
    right = met.select("band", "value", every("rows").alias("row"), col.alias("col"), F.lit(False).alias("on_left"), "rest", "key", "label")
    return left.unionByName(right)


def _labels(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes, F.col("key") == F.col("node"), "left").select("band", "value", "key", "bytes", F.coalesce("label", "key").alias("label"))


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) without near-duplicates: of each class the row of smallest id stays.

    Rows without an id go if their class has an id, else one of them stays; of equal rows one stays. A null text counts as empty, and
    rows without text are one class. Other columns come back as they are, whatever their names. An empty table stays empty.
    """
    labelled = _labelled(docs.select("doc_id", F.col("text").cast("string").alias("text")), s)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    keepers = stored(labelled.groupBy("class_key").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("key")), "neardup-keepers")
    keyed = packed(docs, text_key=F.unhex(F.md5(text_or_empty())), doc_id=F.col("doc_id"))
    kept = keyed.join(keepers, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return kept.dropDuplicates(["text_key"]).select("row.*")
