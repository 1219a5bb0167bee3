"""Quality of whole documents: boosted trees over document statistics.

The statistics are computed for a slice of texts at once on Arrow's buffers. The trees
(``tidemark.llm.trees``) are fitted on at most ``SAMPLE`` labelled documents, those with the
least hashes of their ids, and walk flattened arrays; texts are neither shuffled nor
joined, the scoring pass reads them once.

Null and empty texts have all statistics zero and are scored like any other text. Labels
that are null, or rows that repeat an id in the labels, count once by their largest
value. Rows that repeat an id are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import document_rows, remainder
from tidemark.llm.trees import Forest, fit_forest
from tidemark.llm.words import buffers, slices, word_hashes, word_spans

#: At most this many labelled documents are used to fit.
SAMPLE = 20_000
THRESHOLD = 0.3

STATISTICS = (
    "bytes", "words", "bytes_per_word", "upper_share", "digit_share", "mark_share", "symbol_share",
    "pipe_share", "bang_share", "other_script_share", "lines_per_word", "symbol_ends", "upper_words",
    "repeated_next", "distinct_words", "distinct_pairs", "commonest_word", "longest_word", "short_words", "stop_ends",
)

_KIND = {
    "upper": (range(65, 91),),
    "digit": (range(48, 58),),
    "mark": (range(33, 48), range(58, 65), range(91, 97), range(123, 127)),
    "symbol": ([ord(c) for c in "#$%&*@^~<>{}[]\\=+_"],),
    "pipe": ([ord("|")],),
    "bang": ([ord(c) for c in "!?"],),
    "other": (range(128, 256),),
    "line": ([10],),
    "stop": ([ord(c) for c in ".,;:"],),
}


def _mask(name: str) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    for part in _KIND[name]:
        mask[list(part)] = True
    return mask


_MASKS = {name: _mask(name) for name in _KIND}


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a slice."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    hashes, first = word_hashes(raw, offsets)
    starts, ends, _ = word_spans(raw, offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n)

    counted = {name: per_text(mask[raw]) for name, mask in _MASKS.items()}
    length = (ends - starts + 1).astype(float)
    uppers = np.concatenate([[0], np.cumsum(_MASKS["upper"][raw])])
    shout = (uppers[ends + 1] - uppers[starts]) * 2 > length if len(length) else length > 0
    last = raw[ends]
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = hashes * np.uint64(0x9E3779B97F4A7C15)
    pairs[:-1] ^= hashes[1:]
    distinct, distinct_pairs, commonest, longest = (np.zeros(n) for _ in range(4))
    for text in np.flatnonzero(words):
        a, b = first[text], first[text + 1]
        _, count = np.unique(hashes[a:b], return_counts=True)
        distinct[text], commonest[text] = len(count), count.max()
        distinct_pairs[text] = len(np.unique(pairs[a : b - 1])) if b - a > 1 else 1
        longest[text] = length[a:b].max()
    some, per = np.maximum(words, 1), np.maximum(size, 1)
    return np.column_stack(
        [
            size, words, (size - counted["line"]) / some,
            *[counted[k] / per for k in ("upper", "digit", "mark", "symbol", "pipe", "bang", "other")],
            counted["line"] / some,
            per_word((_MASKS["symbol"] | _MASKS["bang"])[last]) / some,
            per_word(shout & (length > 1)) / some,
            per_word(again) / some, distinct / some, distinct_pairs / np.maximum(words - 1, 1),
            commonest / some, longest, per_word(length <= 2) / some, per_word(_MASKS["stop"][last]) / some,
        ]
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = statistics(*buffers(part.column("text")))
            columns = [part.column("label"), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["label", *STATISTICS])


def labelled_ids(labels: DataFrame, label: str, folds: int, held_out: int, sample: int) -> DataFrame:
    """At most ``sample`` rows ``doc_id, label``, never from the held-out fold."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(remainder("doc_id", folds) != held_out)
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit the trees on a bounded sample of the labelled documents outside the held-out fold."""
    # The sample is broadcast, as its size is bounded.
    chosen = docs.join(F.broadcast(labelled_ids(labels, "quality", 5, 0, sample)), "doc_id")
    kinds = ", ".join(f"{name} double" for name in STATISTICS)
    # The bound of the sample bounds what comes to the driver: 20 numbers a row.
    rows = chosen.select("label", "text").mapInArrow(_measured, f"label int, {kinds}").toPandas()
    table = rows[list(STATISTICS)].to_numpy()
    order = np.lexsort([*table.T, rows["label"].to_numpy()])
    return fit_forest(table[order], rows["label"].to_numpy(dtype=float)[order])


def _with_score(forest: Forest, text: str, name: str):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                score = forest.score(statistics(*buffers(part.column(text))))
                yield pa.RecordBatch.from_arrays(
                    [c for n, c in zip(part.schema.names, part.columns) if n != text] + [pa.array(score)],
                    names=[n for n in part.schema.names if n != text] + [name],
                )

    return scored


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    rows = document_rows(docs, id_col, text_col)
    forest = fit_quality(rows, labels, sample)
    scored = rows.mapInArrow(_with_score(forest, "text", "score"), "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        (F.coalesce(remainder("doc_id", 5), F.lit(-1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged, in one pass."""
    forest = fit_quality(document_rows(docs, id_col, text_col), labels, sample)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                score = forest.score(statistics(*buffers(part.column(text_col))))
                yield part.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
