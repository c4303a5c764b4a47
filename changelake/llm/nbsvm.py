"""Quality by naive Bayes support vectors: n-gram indicators, scaled by how much more often they occur in texts of one class than of the
other, and a linear model of least squared hinge loss on top, fitted by dual coordinate descent.

The n-grams are of words (one and two) and of word shapes (one to three). A shape is the word with letters, capitals and digits
reduced to one sign for each run, so that decoration, capitals and table bars are seen whatever the words are; it also says whether
the run of five words that starts there stood in the text before. N-grams fall into 2^18 hash buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from changelake.llm.common import arrow_map, narrowed, stored
from changelake.llm.texthash import Words, mix, slices, windows

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Words of a run that may stand in a text twice.
RUN = 5
#: Cells of the table of texts and features that is filled at once.
CELLS = 16 << 20

# What a byte counts as in a shape: a for letters (and all bytes beyond ASCII), A for capitals, 0 for digits, others themselves.
_SHAPE = np.array([ord("a") if chr(b).islower() or b >= 0x80 else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b for b in range(256)], np.uint8)
_KIND = mix(np.arange(1, 9, dtype=np.uint64))


def shaped(texts: pa.Array) -> pa.Array:
    """Texts with every word reduced to its shape; words keep their number and order."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    signs = _SHAPE[whole[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    keep = np.ones(len(signs), bool)
    keep[1:] = signs[1:] != signs[:-1]
    keep[bounds[:-1][bounds[:-1] < len(signs)]] = True  # the first byte of each text
    before = np.concatenate([[0], np.cumsum(keep)])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(before[bounds].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(signs[keep])))


def repeated_runs(words: Words, hashes: np.ndarray) -> np.ndarray:
    """For each word whether the run of five words from it on stood earlier in its text."""
    found, at = windows(words, hashes, RUN)
    keys = found ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")  # equal runs stay in order, so all but the first are repeats
    again = np.zeros(len(keys), bool)
    again[1:] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(words.starts), bool)
    out[at[order[again]]] = True
    return out


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, bucket) of all n-grams of some texts; a pair may come several times."""
    words = Words(texts)
    hashes = words.hashes()
    shapes = Words(shaped(texts)).hashes()
    shapes = mix(shapes + _KIND[6] * repeated_runs(words, hashes).astype(np.uint64))
    docs, codes = [words.doc], [mix(hashes ^ _KIND[0])]
    for kind, (of, n) in enumerate(((hashes, 2), (shapes, 1), (shapes, 2), (shapes, 3)), 1):
        found, at = windows(words, of, n)
        docs.append(words.doc[at])
        codes.append(mix(found ^ _KIND[kind]))
    return np.concatenate(docs), (np.concatenate(codes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def indicators(doc: np.ndarray, feature: np.ndarray, n: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of n texts and `size` features, in order of the texts, some texts at a time."""
    step = max(1, CELLS // max(1, size))
    if n > step:
        order = np.argsort(doc, kind="stable")
        doc, feature = doc[order], feature[order]
    for low in range(0, n, step):
        part = slice(None) if n <= step else slice(*np.searchsorted(doc, [low, low + step]))
        table = np.zeros((min(step, n - low), size), bool)
        table[doc[part] - low, feature[part]] = True
        at, found = np.nonzero(table)
        yield at + low, found


def dual_coordinate_descent(
    starts: np.ndarray, index: np.ndarray, values: np.ndarray, y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 30, tolerance: float = 1e-3, seed: int = 0
) -> np.ndarray:
    """Weights w of least ||w||^2 / 2 + sum of cost * max(0, 1 - y w x)^2; the last weight is the constant's.

    Row i holds the features index[starts[i]:starts[i + 1]] with the given values and a constant 1. y is -1 or 1. One dual variable
    is optimised at a time, in an order drawn anew each epoch, until no projected gradient exceeds the tolerance.
    """
    n = len(y)
    w = np.zeros(size + 1)
    a = np.zeros(n)
    ridge = 0.5 / cost
    squares = np.concatenate([[0.0], np.cumsum(values**2)])
    q = squares[starts[1:]] - squares[starts[:-1]] + 1.0 + ridge
    rows = [(index[s:e], values[s:e]) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n).tolist():
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[size]) - 1 + ridge[i] * a[i]
            worst = max(worst, abs(min(gradient, 0.0) if a[i] == 0 else gradient))
            new = max(a[i] - gradient / q[i], 0.0)
            if new != a[i]:
                change = (new - a[i]) * y[i]
                w[at] += change * v
                w[size] += change
                a[i] = new
        if worst < tolerance:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the probability of y = 1 given a margin, by Newton steps on smoothed targets."""
    up, down = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    slope, constant = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + constant, -30, 30)))
        e, h = p - target, np.maximum(p * (1 - p), 1e-12)
        g = np.array([e @ margin + 1e-6 * slope, e.sum()])
        m = np.array([[h @ margin**2 + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        slope, constant = slope - step[0], constant - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 0.0), constant


def log_count_ratios(index: np.ndarray, y: np.ndarray, size: int, smoothing: float = 1.0) -> np.ndarray:
    """Log of each feature's share of the features of positive texts over its share of those of negative ones.

    index, y: feature and label of every pair (text, feature).
    """
    up = np.bincount(index[y > 0], minlength=size) + smoothing
    down = np.bincount(index[y <= 0], minlength=size) + smoothing
    return np.log(up / up.sum()) - np.log(down / down.sum())


def fit(starts: np.ndarray, index: np.ndarray, y: np.ndarray, size: int, c: float) -> np.ndarray:
    """Weights of the indicators (log-count ratio times fitted weight), then the constant. Both classes weigh the same in all."""
    ratio = log_count_ratios(index, np.repeat(y, np.diff(starts)), size)
    share = (y > 0).mean()
    cost = np.where(y > 0, c / (2 * share), c / (2 - 2 * share))
    w = dual_coordinate_descent(starts, index, ratio[index], y, size, cost)
    return np.append(w[:size] * ratio, w[size])


def _rows(starts: np.ndarray, index: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a list of lists."""
    parts = [index[starts[i] : starts[i + 1]] for i in which.tolist()]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate([*parts, np.zeros(0, np.int64)])


def fit_calibrated(starts: np.ndarray, index: np.ndarray, y: np.ndarray, fold: np.ndarray, size: int, c: float) -> tuple[np.ndarray, float, float]:
    """Weights with the constant, and slope and shift of the sigmoid, which is fitted on margins of texts that the weights had not seen."""
    n = len(y)
    if n == 0 or y.min() == y.max():  # nothing to tell apart: the smoothed base rate
        rate = ((y > 0).sum() + 0.5) / (n + 1.0)
        return np.zeros(size + 1), 0.0, float(np.log(rate / (1 - rate)))
    margin = np.zeros(n)
    for k in np.unique(fold):
        rest, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(rest) == 0 or y[rest].min() == y[rest].max():
            continue
        w = fit(*_rows(starts, index, rest), y[rest], size, c)
        cuts, found = _rows(starts, index, out)
        margin[out] = np.bincount(np.repeat(np.arange(len(out)), np.diff(cuts)), w[found], len(out)) + w[size]
    return fit(starts, index, y, size, c), *sigmoid_fit(margin, y)


@dataclass(frozen=True)
class Model:
    """buckets: the chosen ones, rising; weights: theirs and the constant; slope, shift: of the sigmoid over the margin."""

    buckets: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        place = np.full(BUCKETS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        size = len(self.buckets)

        def scores(texts: pa.Array) -> np.ndarray:
            margin = np.full(len(texts), self.weights[size])
            for at, found in indicators(*_chosen(texts, place), len(texts), size):
                margin += np.bincount(at, self.weights[found], len(texts))
            return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

        return scores


def _chosen(texts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc, bucket = grams(texts)
    at = place[bucket]
    known = np.flatnonzero(at >= 0)
    return doc[known], at[known]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: 5 divides the CRC-32 of the id as text. False for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, label_col: str, folds: int) -> DataFrame:
    """text, y (1 or -1) and fold of at most `max_rows` labelled texts that are not held out, picked by a hash of their id.

    Labels other than 1 and 0 and null ones are ignored; several labels of an id count as 1 if all are 1; several texts of
    an id give one row.
    """
    chosen = (
        narrowed(labels, doc_id="doc_id", label=label_col)
        .where(~held_out() & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # max_rows rows of two numbers at most
    joined = narrowed(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
    rows = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return rows.select(
        F.col("text").cast("string").alias("text"),
        F.when(F.col("label") == 1, 1).otherwise(-1).alias("y"),
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(folds)).cast("int").alias("fold"),
    )


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_features: int = 8_192, min_texts: int = 3, c: float = 0.1, folds: int = 3, label_col: str = "quality"
) -> Model:
    """Fit on at most `max_rows` labelled texts, the operator's only bound: it limits what is learned from, not what is judged.

    Spark counts every bucket over the sample and the `max_features` that tell the classes apart best (number of texts times absolute log-count
    ratio, in `min_texts` texts at least) are kept. The descent itself is sequential and runs in one task over the sample's chosen
    indicators: at most max_rows * max_features numbers of two bytes, in practice a few hundred a text.
    """
    sample = stored(training_rows(docs, labels, max_rows, label_col, folds), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            y = (batch.column(1).to_numpy() > 0).astype(np.int64)
            for low, high in slices(batch.column(0)):
                doc, bucket = grams(batch.column(0)[low:high])
                for at, found in indicators(doc, bucket, high - low, BUCKETS):
                    both += np.bincount(y[low + at] * BUCKETS + found, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        seen = np.flatnonzero(both.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(both[1, seen]), pa.array(both[0, seen])], names=["bucket", "up", "down"])

    counts = arrow_map(sample, count, "bucket bigint, up bigint, down bigint").groupBy("bucket").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    counts = stored(counts, "quality-counts")  # as many rows as there are buckets at most
    totals = counts.agg(F.sum("up"), F.sum("down")).first()
    ratio = F.log((F.col("up") + 1) / (F.lit(float(totals[0] or 0)) + BUCKETS)) - F.log((F.col("down") + 1) / (F.lit(float(totals[1] or 0)) + BUCKETS))
    gain = (F.col("up") + F.col("down")) * F.abs(ratio)
    ranked = counts.where(F.col("up") + F.col("down") >= min_texts).select("bucket", gain.alias("gain")).orderBy(F.desc("gain"), "bucket")
    buckets = np.sort(np.array([r["bucket"] for r in ranked.limit(max_features).collect()], np.int64))
    size = len(buckets)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(size)
        for batch in batches:
            for low, high in slices(batch.column(0)):
                part = batch.slice(low, high - low)
                pairs = list(indicators(*_chosen(part.column(0), place), len(part), size)) if size else []
                at = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in pairs]])
                found = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in pairs]]).astype("<u2")
                cuts = np.searchsorted(at, np.arange(len(part) + 1))
                lists = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(lists, pa.binary())], names=["y", "fold", "features"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((fold, y, features) for b in batches for y, fold, features in zip(*[x.to_pylist() for x in b.columns], strict=True))
        lists = [np.frombuffer(f, "<u2").astype(np.int64) for _, _, f in rows]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        index = np.concatenate([np.zeros(0, np.int64), *lists])
        fold, y = (np.array([r[i] for r in rows], float) for i in (0, 1))
        weights, slope, shift = fit_calibrated(starts, index, y, fold, size, c)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([slope]), pa.array([shift])], names=["weights", "slope", "shift"])

    if max_features > 1 << 16:
        raise ValueError("places of features are two bytes wide")
    indicated = arrow_map(sample, chosen, "y int, fold int, features binary")
    found = arrow_map(indicated.repartition(1), descend, "weights array<double>, slope double, shift double").collect()
    return Model(buckets, np.array(found[0]["weights"]), found[0]["slope"], found[0]["shift"])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: doc_id, held_out, score (0 to 1), predicted (1 if the score is `threshold` or more).

    One row per row of `docs`. Only the text enters the score. A null or empty text, or one of blanks, has no n-grams and gets the score of
    the constant alone; repeated rows get equal scores; a null id is not held out; extra columns are left alone; an
    empty table gives no rows. Without labelled rows, or with one class only, every score is the smoothed base rate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                s = scores(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    narrow = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return arrow_map(narrow, run, "doc_id bigint, held_out boolean, score double, predicted int")
