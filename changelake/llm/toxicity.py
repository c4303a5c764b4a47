"""Toxicity by a classifier chain: one linear model per category, each fed the probabilities of the categories before it.

A later model is trained with out-of-fold probabilities of the earlier ones, so that it learns how far they can be
trusted on unseen texts. Features are words and word beginnings (inflected and compound forms share those), picked by
their lift over the labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from changelake.llm.common import arrow_map, narrowed, stored
from changelake.llm.texthash import SMALL_SLICE, Words, mix, slices

#: Lengths in bytes of the word beginnings used as features.
BEGINNINGS = (4, 5, 6, 7)
#: Bytes that are no part of a word: ASCII other than letters and digits.
_APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_FILTER_BITS = 22


@dataclass(frozen=True)
class Chain:
    """categories in chain order; features: sorted hashes; weights: per category a row of feature weights, then one weight
    for each earlier category's probability, then the constant."""

    categories: tuple[str, ...]
    features: np.ndarray
    weights: tuple[np.ndarray, ...]

    def probabilities(self, doc: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
        """Of n texts whose features are the pairs (doc, feature)."""
        earlier: list[np.ndarray] = []
        size = len(self.features)
        for w in self.weights:
            score = np.bincount(doc, w[:size][feature], n) + w[-1]
            for p, v in zip(earlier, w[size:-1], strict=True):
                score = score + v * p
            earlier.append(1 / (1 + np.exp(-np.clip(score, -30, 30))))
        return earlier


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, feature hash)."""
    w = Words(pc.utf8_lower(pc.fill_null(texts, "")), _APART)
    docs, found = [w.doc], [w.hashes()]
    for k in BEGINNINGS:
        long = np.flatnonzero(w.ends - w.starts > k)
        if len(long):
            cut = w.hashes(np.minimum(w.starts + k, w.ends))[long]
            docs.append(w.doc[long])
            found.append(mix(cut + np.uint64(k)))
    doc, feature = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(feature + mix(doc.astype(np.uint64)))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


class _Known:
    """Finds the positions of known hashes: a bit table first, then binary search among what passes."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.bits: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"features": self.features, "bits": None}  # the table is made where it is used

    def find(self, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.bits is None:
            self.bits = np.zeros(1 << _FILTER_BITS, bool)
            self.bits[(self.features >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        passed = np.flatnonzero(self.bits[(feature >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        doc, feature = doc[passed], feature[passed]
        at = np.searchsorted(self.features, feature)
        hit = at < len(self.features)
        hit[hit] = self.features[at[hit]] == feature[hit]
        return doc[hit], at[hit]


# Without any labelled text the rate is a quarter, so that nothing is called toxic.
def _fit(doc: np.ndarray, feature: np.ndarray, n: int, size: int, extra: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    """Logistic regression by L-BFGS; returns feature weights, weights of the extra columns, constant."""
    if n == 0 or y.min() == y.max():  # nothing to tell apart: the smoothed base rate
        rate = (y.sum() + 0.5) / (n + 2.0)
        return np.concatenate([np.zeros(size + extra.shape[1]), [np.log(rate / (1 - rate))]])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(doc, w[:size][feature], n) + extra @ w[size:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = (p - y) / n
        value = np.mean(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (w[:-1] @ w[:-1])
        grad = np.concatenate([np.bincount(feature, e[doc], size), extra.T @ e, [e.sum()]])
        grad[:-1] += l2 * w[:-1]
        return value, grad

    w = np.zeros(size + extra.shape[1] + 1)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(60):
        q, kept = grad.copy(), []
        for s, v in reversed(past):
            a = s @ q / (s @ v)
            q -= a * v
            kept.append(a)
        if past:
            s, v = past[-1]
            q *= s @ v / (v @ v)
        for (s, v), a in zip(past, reversed(kept), strict=True):
            q += s * (a - v @ q / (s @ v))
        step, slope = 1.0, grad @ q
        while step > 1e-10:
            new_value, new_grad = loss(w - step * q)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, v = -step * q, new_grad - grad
        if s @ v > 1e-14:
            past = [*past[-7:], (s, v)]
        done = value - new_value < 1e-8
        w, value, grad = w + s, new_value, new_grad
        if done:
            break
    return w


def train_chain(
    labelled: DataFrame,
    categories: list[str],
    text_col: str = "text",
    id_col: str = "doc_id",
    folds: int = 5,
    max_features: int = 4_096,
    min_lift: float = 4.0,
    l2: float = 2e-4,
) -> Chain:
    """Fit a chain on labelled texts: one row per text, one 0/1 column per category, in chain order.

    Null labels count as 0 and null texts as empty. Feature counts are aggregated over all rows by Spark; the
    driver gets at most `max_features` hashes and, per row, the few of them it holds, so pass a bounded sample (see
    `labelled_sample`). A category without both labels becomes a constant. Folds go by a hash of the id.
    """
    c = len(categories)
    sample = labelled.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(folds)).cast("int").alias("fold"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.coalesce(F.col(f"`{name}`").cast("int"), F.lit(0)).alias(f"y{i}") for i, name in enumerate(categories)],
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = np.stack([batch.column(2 + i).to_numpy() for i in range(c)])
            for at, to in slices(batch.column(1), SMALL_SLICE):
                doc, feature = text_features(batch.column(1).slice(at, to - at))
                keys, index = np.unique(feature, return_inverse=True)
                by = [np.bincount(index, y[at:to][doc], len(keys)).astype(np.int64) for y in ys]
                n = np.bincount(index, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(n), *[pa.array(b) for b in by]], names=["feature", "n", *[f"n{i}" for i in range(c)]]
                )

    names = ["n", *[f"n{i}" for i in range(c)]]
    schema = "feature bigint, " + ", ".join(f"{name} bigint" for name in names)
    totals = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"y{i}"), F.lit(0)).alias(f"y{i}") for i in range(c)]).first()
    counted = arrow_map(sample, count, schema).groupBy("feature").agg(*[F.sum(name).alias(name) for name in names])
    best = F.lit(0.0)
    for i in range(c):
        pos, neg = totals[f"y{i}"], totals["n"] - totals[f"y{i}"]
        p1, p0 = (F.col(f"n{i}") + 0.1) / (pos + 1), (F.col("n") - F.col(f"n{i}") + 0.1) / (neg + 1)
        best = F.greatest(best, F.when(p1 >= min_lift * p0, F.col(f"n{i}") * F.log(p1 / p0)).otherwise(0.0))
    often = F.greatest(*[F.col(f"n{i}") for i in range(c)], F.lit(0))
    ranked = counted.where(often >= 2).select("feature", best.alias("best")).where("best > 0").orderBy(F.desc("best"), "feature")
    features = np.array([r["feature"] for r in ranked.limit(max_features).collect()], np.int64).view(np.uint64)
    known = _Known(np.sort(features))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1), SMALL_SLICE):
                part = batch.slice(at, to - at)
                doc, index = known.find(*text_features(part.column(1)))
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(index[order], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, *[part.column(2 + i) for i in range(c)]], names=["fold", "at", *[f"y{i}" for i in range(c)]]
                )

    schema = "fold int, at array<int>, " + ", ".join(f"y{i} int" for i in range(c))
    got = arrow_map(sample, rows_of, schema).toArrow().combine_chunks()  # as columns: no object for each number
    n, size = len(got), len(features)
    lists = pc.list_value_length(got["at"]).to_numpy()
    doc = np.repeat(np.arange(n), lists).astype(np.int64)
    feature = pc.list_flatten(got["at"]).to_numpy().astype(np.int64)
    fold = got["fold"].to_numpy().astype(np.int64)
    earlier = np.zeros((n, 0))
    weights = []
    for i in range(c):
        y = got[f"y{i}"].to_numpy().astype(float)
        held_out = np.zeros(n)
        for k in range(folds):
            rows_in, rows_out = fold != k, fold == k
            number = np.cumsum(rows_in) - 1
            use = rows_in[doc]
            w = _fit(number[doc[use]], feature[use], int(rows_in.sum()), size, earlier[rows_in], y[rows_in], l2)
            z = np.bincount(doc, w[:size][feature], n) + earlier @ w[size:-1] + w[-1]
            held_out[rows_out] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[rows_out]
        weights.append(_fit(doc, feature, n, size, earlier, y, l2))
        earlier = np.column_stack([earlier, held_out])
    return Chain(tuple(categories), known.features, tuple(weights))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, label_col: str = "toxic") -> DataFrame:
    """At most `max_rows` labelled texts, picked by a hash of their id: doc_id, text and the label.

    This bound is the only one of the operator: it limits what the classifier is fitted on, not what it judges.
    Repeated labels of an id count as toxic if one says so; repeated documents of an id give one row.
    """
    chosen = (
        narrowed(labels, doc_id="doc_id", label=label_col)
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows rows of two numbers: small by the limit above
    joined = narrowed(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias(label_col))


def score_chain(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Probability of every category and the verdict for every text, read whole.

    Returns one row per input row: doc_id, p_<category>..., toxic (the last category's probability is at least
    `threshold`). keep: return the rows of `docs` that are not toxic instead, with their columns. A null or empty text
    has no features and so the constant's low probability; repeated rows get equal results.
    """
    known = _Known(chain.features)
    c = len(chain.categories)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col) if keep else 1)
            for at, to in slices(texts, SMALL_SLICE):
                doc, index = known.find(*text_features(texts.slice(at, to - at)))
                p = chain.probabilities(doc, index, to - at)
                toxic = p[-1] >= threshold
                part = batch.slice(at, to - at)
                if keep:
                    yield part.filter(pa.array(~toxic))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *[pa.array(x) for x in p], pa.array(toxic)],
                        names=["doc_id", *[f"p_{x}" for x in chain.categories], "toxic"],
                    )

    if keep:
        return arrow_map(docs, score, docs.schema)
    narrow = narrowed(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return arrow_map(narrow, score, "doc_id bigint, " + "".join(f"p_{x} double, " for x in chain.categories[:c]) + "toxic boolean")


#: Words that tell two kinds of abuse apart among texts labelled toxic.
KINDS = {
    "insult": ("idiot", "moron", "clown", "loser", "scum", "trash"),
    "contempt": ("stupid", "pathetic", "worthless", "disgusting"),
}


def default_chain(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Chain:
    """Chain insult -> contempt -> toxic. The first two are toxic texts with a word of `KINDS`; the last is the given label."""
    sample = labelled_sample(docs, labels, max_rows)
    for name, words in KINDS.items():
        named = F.lower("text").rlike(r"\b(" + "|".join(words) + r")\b")
        sample = sample.withColumn(name, F.when((F.col("toxic") == 1) & named, 1).otherwise(0))
    return train_chain(stored(sample, "toxicity-sample"), [*KINDS, "toxic"])
