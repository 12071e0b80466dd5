"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(w . x - t_k) with thresholds t_0 < t_1 < ... and one weight vector for all of them. x are hashed words and
word pairs of the text (binary, scaled to length one) and a few hashed shape features (share of capitals, of repeated words, of
punctuation, of digits, length). The expected grade and the tail probability P(grade >= cut) serve for selection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import arrow_schema, short_batches, stored

#: Labelled rows that the model is fitted on, at most; the rows with the smallest hashes of their doc_id.
MAX_TRAIN = 4_000
BUCKETS, SHAPES, STEPS = 1 << 16, 64, 150
SEPARATORS = tb.byte_set((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def shapes(data: np.ndarray, words: tb.Words) -> list[int]:
    """Numbers of the shape features of one text, below SHAPES: one of eight steps for each measure."""
    n, n_words = max(1, len(data)), max(1, len(words.hash))
    letters = max(1, int((data >= 0x41).sum()))
    measures = (
        np.count_nonzero((data >= 0x41) & (data <= 0x5A)) / letters,
        1 - len(np.unique(words.hash)) / n_words,
        np.count_nonzero(np.isin(data, np.frombuffer(b"!?#*|=_~<>{}[]", np.uint8))) / n * 4,
        np.count_nonzero((data >= 0x30) & (data <= 0x39)) / n * 4,
        np.count_nonzero(data == 0x0A) / n * 20,
        np.log2(1 + len(words.hash)) / 14,
        n / n_words / 16,
        np.count_nonzero(words.hash[1:] == words.hash[:-1]) / n_words * 2,
    )
    return [8 * i + min(7, int(8 * m)) for i, m in enumerate(measures)]


def features(data: np.ndarray, words: tb.Words) -> np.ndarray:
    """Distinct feature numbers of one text: shapes first, then hashed words and pairs."""
    h = words.hash
    pairs = tb.window_hashes(h, 2)
    hashed = np.unique(np.concatenate([h, pairs]) % np.uint64(BUCKETS - SHAPES)).astype(np.int64) + SHAPES
    return np.concatenate([np.array(shapes(data, words)), hashed])


def values(x: np.ndarray) -> np.ndarray:
    """The shape features count one each, the hashed ones have length one together."""
    return np.where(x < SHAPES, 1.0, 1 / np.sqrt(max(1, np.count_nonzero(x >= SHAPES))))


def of_column(column: pa.Array):
    """Feature numbers of each text of a string column; null counts as empty."""
    for _, data, offsets in tb.blocks(column):
        words = tb.words(data, offsets, SEPARATORS)
        for i in range(len(offsets) - 1):
            a, b = words.first[i], words.first[i + 1]
            yield features(data[offsets[i] : offsets[i + 1]], tb.Words(words.start[a:b], words.end[a:b], words.hash[a:b], words.first[:0]))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # increasing, one less than there are grades

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, rows by text."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(margin)[:, None] - self.thresholds, -30, 30)))

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x] @ values(x))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, ridge: float = 1e-5) -> Ordinal:
    """Maximum likelihood by Adam over all rows; thresholds are a first one and positive steps. grades: 0, 1, ..."""
    n_grades = max(2, int(grades.max(initial=0)) + 1)
    share = np.array([(np.sum(grades > k) + 0.5) / (len(grades) + 1) for k in range(n_grades - 1)])
    start = -np.log(share / (1 - share))
    if not rows:
        return Ordinal(np.zeros(BUCKETS), start)
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    edge = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    value, row = np.concatenate([values(r) for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    steps_up = np.maximum(np.diff(start), 1e-3)
    theta = np.concatenate([np.zeros(BUCKETS), start[:1], np.log(steps_up)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, gaps = theta[:BUCKETS], np.exp(theta[BUCKETS + 1 :])
        cut = theta[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)])
        margin = np.add.reduceat(w[flat] * value, edge)
        above = 1 / (1 + np.exp(-np.clip(margin[:, None] - cut, -30, 30)))
        # P(grade) = P(> grade - 1) - P(> grade)
        full = np.column_stack([np.ones(len(rows)), above, np.zeros(len(rows))])
        i = np.arange(len(rows))
        p = np.maximum(full[i, grades] - full[i, grades + 1], 1e-9)
        slope = full * (1 - full)
        d_margin = -(slope[i, grades] - slope[i, grades + 1]) / p / len(rows)
        d_cut = np.zeros((len(rows), n_grades + 1))
        d_cut[i, grades] += slope[i, grades] / p / len(rows)
        d_cut[i, grades + 1] -= slope[i, grades + 1] / p / len(rows)
        d_cut = d_cut.sum(axis=0)[1:-1]
        gradient = np.concatenate([np.bincount(flat, value * d_margin[row], BUCKETS) + ridge * w, [d_cut.sum()], np.cumsum(d_cut[::-1])[::-1][1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Ordinal(theta[:BUCKETS].astype(np.float32), theta[BUCKETS] + np.concatenate([[0], np.cumsum(np.exp(theta[BUCKETS + 1 :]))]))


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, ratings: DataFrame, most: int = MAX_TRAIN) -> Ordinal:
    """ratings: doc_id, grade (0, 1, ...); held-out and null rows are not used. Only feature numbers of at most `most` rows reach
    the driver."""
    short_batches(docs.sparkSession)
    picked = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "grade").repartition(12), "quality-train")

    def run(batches):
        for batch in batches:
            found = [x.astype(np.int32).tobytes() for x in of_column(batch.column(0))]
            yield pa.record_batch({"x": pa.array(found, pa.binary()), "grade": batch.column(1)})

    xs, grades = [], []
    for r in rows.mapInArrow(run, "x binary, grade int").toLocalIterator():
        xs.append(np.frombuffer(r.x, np.int32))
        grades.append(r.grade)
    return fit_ordinal(xs, np.array(grades, int))


def select(docs: DataFrame, ratings: DataFrame, cut: int = 1, least: float = 0.5, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (P(grade >= cut)), keep (tail >= least) for each row of docs (doc_id, text).

    Null text counts as empty. A null doc_id is scored and counts as not held out; repeated rows give repeated rows; without ratings
    all weights are zero; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, ratings, most)
    schema = "doc_id long, expected_grade double, tail double"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            tails = model.tails(np.array([model.margin(x) for x in of_column(batch.column(1))]))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(tails.sum(axis=1), pa.float64()), pa.array(tails[:, cut - 1], pa.float64())], schema=out)

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= least).alias("keep"))
