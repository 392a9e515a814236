"""Quality rules: base statistics and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed words and hashed byte
n-grams. It is fitted on a bounded sample of labelled rows (``max_rows``), its
probability is calibrated on rows that the fit did not see, and every document
is scored in Arrow batches against a fixed threshold.

Words are runs without ``[\\x20\\x09-\\x0D]``. NULL and empty texts have no words
and fail the base rule. Without labels of both kinds there is no model, and the
base rule decides alone. Repeated rows are judged row by row; other columns
are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import arrow_rows, free_name, mixed, word_hashes

#: Labelled rows of each kind that the fit may use.
MAX_ROWS = 1500
#: Hashed features: the first half holds words, the second half byte n-grams.
WIDTH = 1 << 18
#: Documents whose calibrated probability of low quality is above this go.
REJECT_ABOVE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("p_bad", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features, and the calibration of their score."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, score: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30))))


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text, with repeats: words, and runs of four bytes."""
    half = np.uint64(WIDTH // 2 - 1)
    words = (word_hashes(data)[0] & half).astype(np.int32)
    n = len(data) - 3
    if n <= 0:
        return words, np.zeros(0, np.int32)
    grams = np.ndarray((n,), "<u4", buffer=data, strides=(1,)).astype(np.uint64)
    grams = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
    return words, grams.astype(np.int32) + WIDTH // 2


def score(model: Model, data: bytes) -> float:
    """Mean weight of the words plus mean weight of the n-grams."""
    return sum(float(model.weights[x].mean()) for x in features(data) if len(x))


def repeat_words(keys: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(keys) < 4:
        return 0
    a = np.uint64(0x9E3779B97F4A7C15)
    windows = mixed(mixed(keys[:-2] * a + keys[1:-1]) * a + keys[2:])
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    again = order[np.r_[False, same] | np.r_[same, False]]
    covered = np.zeros(len(keys), bool)
    for i in range(3):
        covered[again + i] = True
    return int(covered.sum())


def base_statistics(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = data.split()
    blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    keys = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (
        len(words),
        len(text) - blank,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(keys),
    )


def judge(model: Model | None, text: str | None) -> tuple:
    """The RESULT of one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    found = base_statistics(text, data)
    failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEAT_PERCENT * found[0]
    p = model.probability(score(model, data)) if model else None
    return (*found, failed, p, not failed and (p is None or p <= REJECT_ABOVE))


def judged(docs: DataFrame, model: Model | None, result: str = "result") -> DataFrame:
    """``docs`` with a struct column ``result`` that holds the RESULT of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights: a fixed size

    @F.pandas_udf(RESULT)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [judge(shared.value, text) for text in texts]
            frame = pd.DataFrame(rows, columns=RESULT.names)
            frame["p_bad"] = frame["p_bad"].astype("float64")
            yield frame

    return docs.withColumn(result, verdict(F.col("text").cast("string")))


def _examples(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame | None, dict[int, int]]:
    """Feature counts of at most ``max_rows`` labelled rows of each kind, and their places; all labels counted."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None, counts
    parts = [
        known.filter(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        for kind in (0, 1)
    ]
    chosen = parts[0].union(parts[1])  # at most 2 * max_rows rows of two numbers

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            found = [np.unique(x, return_counts=True) for x in features(data)]
            index = np.concatenate([x for x, _ in found]).astype("<i4")
            share = np.concatenate([n / max(1, n.sum()) for _, n in found]).astype("<f4")
            out.append(index.tobytes() + share.tobytes())
        return pd.Series(out)

    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .filter("text IS NOT NULL AND text <> ''")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", packed("text").alias("features"), F.monotonically_increasing_id().alias("place"))
    )
    return rows, counts


class _Sample:
    """Features of the sampled rows and their shares, one row after the other.

    Passes go over parts of about PART features, so that little is held but eight bytes a feature.
    """

    PART = 1 << 16

    def __init__(self, packed: list[memoryview]):
        self.sizes = np.array([len(x) // 8 for x in packed], np.int64)
        self.index = np.concatenate([np.frombuffer(x, "<i4", n) for x, n in zip(packed, self.sizes)])
        self.share = np.concatenate([np.frombuffer(x, "<f4", n, 4 * n) for x, n in zip(packed, self.sizes)])

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows, and the row of each of their features, counted from the first; the features; the shares."""
        ends = np.cumsum(self.sizes)
        low = 0
        while low < len(ends):
            start = ends[low] - self.sizes[low]
            high = max(low + 1, int(np.searchsorted(ends, start + self.PART, side="right")))
            sizes, at = self.sizes[low:high], slice(start, ends[high - 1])
            yield slice(low, high), np.repeat(np.arange(len(sizes)), sizes), self.index[at].astype(np.intp), self.share[at]
            low = high

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        for rows, row, index, share in self.parts():
            out[rows] = np.bincount(row, weights[index] * share, rows.stop - rows.start)
        return out

    def slope(self, error: np.ndarray) -> np.ndarray:
        """Of the loss by each weight; the sums run in order of the features, whatever the parts."""
        out = np.zeros(WIDTH)
        for rows, row, index, share in self.parts():
            np.add.at(out, index, error[rows][row] * share)
        return out


def _fitted_model(rows: pa.Table, counts: dict[int, int]) -> Model | None:
    """The model of a sample; of rows with one doc_id the last stands for it."""
    last = {r[0]: r[2] for r in sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "place")), range(len(rows))))}
    chosen = [last[doc_id] for doc_id in sorted(last)]
    quality = rows["quality"].to_pylist()
    bad = np.array([quality[i] == 0 for i in chosen], float)
    if not 0 < bad.sum() < len(bad):
        return None
    sample = _Sample([rows["features"][i].as_buffer() for i in chosen])
    held = np.arange(len(bad)) % 3 == 2
    if len({*bad[~held]}) < 2 or len({*bad[held]}) < 2:
        held[:] = False
    weights = _fitted(sample, bad, ~held)
    scores = sample.scores(weights)
    rest = held if held.any() else ~held
    slope, shift = _platt(scores[rest], bad[rest])
    odds = counts[0] / counts[1] / (bad[rest].sum() / (1 - bad[rest]).sum())
    return Model(weights.astype(np.float32), slope, shift + float(np.log(odds)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """A calibrated model of low quality; None where the labels are all of one kind.

    Two thirds of the sample fit the weights, the rest calibrates: a line is
    fitted to their scores (Platt), then moved to the share of low quality
    among all labels, since the sample holds both kinds alike. A task fits; the driver gets the model only.
    """
    rows, counts = _examples(docs, labels, max_rows)
    if rows is None:
        return None

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # at most 2 * max_rows rows, but for repeated doc_ids
        model = _fitted_model(pa.Table.from_batches(held), counts) if held else None
        if model:
            yield arrow_rows([(model.weights.tobytes(), model.slope, model.shift)], schema)

    schema = "weights binary, slope double, shift double"
    found = rows.repartition(1).mapInArrow(fitted, schema).first()
    return Model(np.frombuffer(found["weights"], np.float32), found["slope"], found["shift"]) if found else None


def _fitted(sample: _Sample, bad: np.ndarray, used: np.ndarray, rounds: int = 80, rate: float = 0.3) -> np.ndarray:
    """Weights after full-batch Adam on the log loss, both kinds weighing the same; rows not ``used`` weigh nothing."""
    importance = np.where(bad > 0, 0.5 / bad[used].sum(), 0.5 / (1 - bad)[used].sum()) * used
    weights, first, second = np.zeros((3, WIDTH))
    for step in range(1, rounds + 1):
        z = sample.scores(weights)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad) * importance
        slope = sample.slope(error)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return weights


def _platt(scores: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic line through the scores, by Newton's method."""
    n1, n0 = bad.sum(), (1 - bad).sum()
    target = np.where(bad > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, line = np.stack([scores, np.ones_like(scores)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(line @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        line = line - np.clip(step, -2, 2)
    return float(line[0]), float(line[1])


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    result = free_name(docs, "quality_result")
    return judged(docs, fit(docs, labels, max_rows), result).filter(F.col(f"{result}.kept")).drop(result)
