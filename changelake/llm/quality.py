"""Quality rules by compression: zstandard ratios over whole texts and fixed chunks, with bands by length.

Repetitive text compresses far below the usual ratio of prose of its length, random text hardly at all. Short texts
compress worse than long ones, so each length class has a band of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from changelake.llm.common import arrow_map, narrowed
from changelake.llm.texthash import SPACE, Words, mix, slices, windows


@dataclass(frozen=True)
class Bands:
    """Limits on compressed bytes / bytes.

    whole   (bytes below, lowest, highest) by rising length; the last one is for all longer texts
    chunk   lowest and highest ratio of a whole chunk
    share   a text with more than this share of its chunks outside `chunk` is rejected
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 9.0),
        (512, 0.30, 1.05),
        (1_536, 0.28, 0.85),
        (4_096, 0.25, 0.75),
        (16_384, 0.22, 0.70),
        (65_536, 0.20, 0.65),
        (float("inf"), 0.18, 0.65),
    )
    chunk: tuple[float, float] = (0.20, 0.80)
    chunk_bytes: int = 2_048
    share: float = 0.4
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for below, low, high in self.whole if size < below)


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, verdict string, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_FEED = np.zeros(256, bool)
_LINE_FEED[0x0A] = True


def _per_text(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def _sum_over(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _equal_pairs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of items next to each other among the equal ones of a text; n equal items give n - 1 pairs."""
    key = key + mix(doc.astype(np.uint64))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return order[same], order[same + 1]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The plain counts of each text; the columns are described at `compression_bands`."""
    w = Words(texts)
    n = len(w.bounds) - 1
    starts_char = (w.data & 0xC0) != 0x80
    lines = Words(texts, _LINE_FEED)  # a line is a "word" between line feeds; empty ones have no word anyway
    has_word = np.flatnonzero(np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts))
    _, again = _equal_pairs(lines.doc[has_word], lines.hashes()[has_word])
    found, at = windows(w, w.hashes(), 5)
    one, other = _equal_pairs(w.doc[at], found)
    often = np.zeros(len(w.starts) + 5, bool)
    often[at[one]] = often[at[other]] = True
    repeated = often[:-5].copy()
    for back in range(1, 5):
        repeated[back:] |= often[: len(repeated) - back]
    return {
        "n_words": _per_text(w.doc, n),
        "word_chars": _sum_over(starts_char & ~SPACE[w.data], w.bounds),
        "n_symbols": _sum_over(_SYMBOL[w.data], w.bounds),
        "n_dup_lines": _per_text(lines.doc[has_word[again]], n),
        "n_repeat_words": _per_text(w.doc[repeated], n),
    }


def compression_bands(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every text by its counts and by how it compresses.

    Returns one row per input row: doc_id; n_words (runs without ASCII white space); word_chars (code points in them);
    n_symbols (characters of #*$%&|<>); n_dup_lines (lines with a word that equal an earlier line); n_repeat_words
    (words in 5-word windows found twice or more); base_failed (fewer than 10 words, or over a fifth in repeated
    windows); ratio of the whole text; chunks of `chunk_bytes` (a shorter tail is left to the whole ratio) and those outside
    their band; verdict ('kept', 'base', 'repetitive', 'incompressible', 'chunks'); kept.

    A null or empty text has 0 words, ratio 1 and fails the base rules. A text longer than any limit is read whole, by
    one task, in chunks. Repeated rows and null ids come back as they are; extra columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        low_chunk, high_chunk = bands.chunk
        for batch in batches:
            ids, column = batch.column(0), pc.fill_null(batch.column(1), "")
            for at, to in slices(column):
                part = column.slice(at, to - at)
                counts = base_counts(part)
                n_words, repeat = counts["n_words"], counts["n_repeat_words"]
                failed = (n_words < 10) | (100 * repeat > 20 * n_words)
                ratios, chunks, bad, verdicts = [], [], [], []
                for i, text in enumerate(part):
                    data = memoryview(text.as_buffer())
                    size = len(data)
                    ratio = len(squeeze.compress(data)) / size if size else 1.0
                    whole = size // bands.chunk_bytes
                    outside = 0
                    for k in range(whole):
                        piece = data[k * bands.chunk_bytes : (k + 1) * bands.chunk_bytes]
                        outside += not low_chunk <= len(squeeze.compress(piece)) / len(piece) <= high_chunk
                    low, high = bands.limits(size)
                    verdict = "base" if failed[i] else "repetitive" if ratio < low else "incompressible" if ratio > high else (
                        "chunks" if outside > bands.share * whole else "kept"
                    )
                    ratios.append(ratio)
                    chunks.append(whole)
                    bad.append(outside)
                    verdicts.append(verdict)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), *[pa.array(c) for c in counts.values()], pa.array(failed), pa.array(ratios, pa.float64()),
                     pa.array(chunks, pa.int64()), pa.array(bad, pa.int64()), pa.array(verdicts, pa.string()),
                     pa.array([v == "kept" for v in verdicts], pa.bool_())],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    narrow = narrowed(docs, doc_id=id_col, text=text_col)
    return arrow_map(narrow.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), judge, SCHEMA)
