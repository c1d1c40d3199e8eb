"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades 0 < 1 < ... < K-1 share one weight per hashed feature; ordered thresholds cut the score:
P(grade > j) = sigmoid(score - threshold_j). The model gives an expected grade and the tail probability of the top grades.
It is fitted on a bounded sample of rated documents, with weights only for features that tell grades apart; scoring reads
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import fresh
from tesserae.llm.textops import U, mix, per_row
from tesserae.runtime import ship

BITS = 18
#: At most so many rated documents are read to fit the model.
FIT_ROWS = 6000
SHAPES = 16
PRESENT = 0.3
#: A word's weight is fitted if its share in some grade differs from the rest by so many standard errors, in so many documents.
MIN_Z = 6.0
MIN_ROWS = 8
#: A document is kept if its top grade has at least this probability.
TAIL = 0.3


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row: distinct hashed features and their values. A null or empty text has none.

    Every distinct word of the whole text (letters and digits, lower case) is present with one value, so one telling word
    counts the same in a long text as in a short one. Two more features tell the share of distinct words and the length.
    """
    size = U(1 << bits)
    for words in per_row(column, fold=True):
        if len(words) == 0:
            yield np.zeros(0, dtype=np.int64), np.zeros(0)
            continue
        index = np.unique((mix(np.unique(words)) % size).astype(np.int64))
        share = min(SHAPES - 1, int(SHAPES * len(index) / len(words)))
        length = min(SHAPES - 1, len(words).bit_length())
        extra = np.array([(1 << bits) + share, (1 << bits) + SHAPES + length], dtype=np.int64)
        yield np.concatenate([index, extra]), np.concatenate([np.full(len(index), PRESENT), [0.5, 0.5]])


def character_features(texts: list[str | None]) -> np.ndarray:
    """Shares of symbols, digits, capitals, bars and exclamation marks per character, as square roots; whole texts."""
    out = np.zeros((len(texts), 5))
    kinds = np.full(256, 5, dtype=np.int64)
    for k, chars in enumerate((b"#*$%&<>@^~=+{}[]\\", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"|", b"!")):
        kinds[list(chars)] = k
    for i, t in enumerate(texts):
        if t:
            raw = np.frombuffer(t.encode(), dtype=np.uint8)
            out[i] = np.sqrt(np.bincount(kinds[raw], minlength=6)[:5] / len(raw))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """``weights`` has one entry per hashed feature, then the shape features, then the character shares."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for j = 0 .. K-2, one row per score."""
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


class _Rows:
    """Sparse rows as (row, column, value) triples plus dense character shares."""

    def __init__(self, feats: list[tuple[np.ndarray, np.ndarray]], chars: np.ndarray) -> None:
        self.n = len(feats)
        self.rows = np.repeat(np.arange(self.n), [len(i) for i, _ in feats])
        self.cols = np.concatenate([i for i, _ in feats]) if feats else np.zeros(0, np.int64)
        self.vals = np.concatenate([v for _, v in feats]) if feats else np.zeros(0)
        self.chars = chars

    def only(self, chosen: np.ndarray) -> _Rows:
        out = _Rows([], self.chars)
        on = chosen[self.cols]
        out.n, out.rows, out.cols, out.vals = self.n, self.rows[on], self.cols[on], self.vals[on]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        k = self.chars.shape[1]
        return np.bincount(self.rows, self.vals * w[self.cols], minlength=self.n).astype(float) + self.chars @ w[-k:]

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.cols, self.vals * g[self.rows], minlength=size).astype(float)
        out[-self.chars.shape[1] :] += self.chars.T @ g
        return out


def telling(rows: _Rows, grades: np.ndarray, classes: int, bits: int) -> np.ndarray:
    """Which features are fitted: those whose presence depends on the grade, and all shape and character features."""
    size = (1 << bits) + 2 * SHAPES + rows.chars.shape[1]
    total = np.bincount(rows.cols, minlength=size).astype(float)
    out = np.arange(size) >= 1 << bits
    for c in range(classes):
        n = float((grades == c).sum())
        if 0 < n < rows.n:
            inside = np.bincount(rows.cols, (grades[rows.rows] == c).astype(float), minlength=size)
            p = total / rows.n
            error = np.sqrt(p * (1 - p) * (1 / n + 1 / (rows.n - n))) + 1e-12
            out |= (np.abs(inside / n - (total - inside) / (rows.n - n)) >= MIN_Z * error) & (total >= MIN_ROWS)
    return out


def cuts_of(first: float, gaps: np.ndarray) -> np.ndarray:
    """Thresholds as a first value plus positive gaps, so that they stay ordered."""
    return first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def loss_and_gradient(rows: _Rows, grades: np.ndarray, weight: np.ndarray, w: np.ndarray, first: float, gaps: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Negative weighted log-likelihood plus l2 / 2 * |w|^2, and its gradient by (w, first, gaps)."""
    p = 1.0 / (1.0 + np.exp(-np.clip(rows.dot(w)[:, None] - cuts_of(first, gaps)[None, :], -30, 30)))
    # P(grade = y) = upper - lower with upper = P(grade > y - 1), lower = P(grade > y).
    wide = np.concatenate([np.ones((rows.n, 1)), p, np.zeros((rows.n, 1))], 1)
    slope = wide * (1.0 - wide)
    at = np.arange(rows.n)
    chance = np.maximum(wide[at, grades] - wide[at, grades + 1], 1e-9)
    d_upper, d_lower = slope[at, grades] / chance, slope[at, grades + 1] / chance
    d_score = -(d_upper - d_lower) * weight
    d_cuts = np.zeros(len(gaps) + 3)
    np.add.at(d_cuts, grades, d_upper * weight)
    np.add.at(d_cuts, grades + 1, -d_lower * weight)
    tail = np.cumsum(d_cuts[1:-1][::-1])[::-1]
    loss = float(-(np.log(chance) * weight).sum() + l2 / 2 * (w**2).sum())
    return loss, np.concatenate([rows.back(d_score, len(w)) + l2 * w, [tail[0]], tail[1:] * np.exp(gaps)])


def fit_ordinal(rows: _Rows, grades: np.ndarray, classes: int, bits: int = BITS, l2: float = 1e-5, steps: int = 250, rate: float = 0.25) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by Adam on the full sample; grades weigh equally in total."""
    size = (1 << bits) + 2 * SHAPES + rows.chars.shape[1]
    rows = rows.only(telling(rows, grades, classes, bits))
    w, first, gaps = np.zeros(size), -1.0, np.zeros(max(0, classes - 2))
    share = np.bincount(grades, minlength=classes).astype(float)
    weight = (rows.n / (classes * np.maximum(share, 1)))[grades] / max(1, rows.n)
    m, v = np.zeros(size + classes - 1), np.zeros(size + classes - 1)
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(rows, grades, weight, w, first, gaps, l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, first, gaps = w - step[:size], first - step[size], gaps - step[size + 1 :]
    return OrdinalModel(w, cuts_of(first, gaps), bits)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from doc_id, quality and toxic: 0 toxic, 1 poor, 2 good. Rows without a label or id are left out.

    A document that is rated more than once takes its lowest grade.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, classes: int = 3, rows: int = FIT_ROWS, bits: int = BITS) -> OrdinalModel:
    """Fit on at most ``rows`` rated documents, chosen by a hash of their ids, balanced over the grades as far as they go.

    Only hashed features leave the executors. Of rows that repeat a doc_id the least text stands for all, so at most ``rows`` rows
    are gathered. Null ids have no rating. Without a rated document every score is 0.
    """
    ship(docs.sparkSession)
    wanted = rows // classes
    picks = None
    for g in range(classes):
        part = ratings.filter(F.col("grade") == g).orderBy(F.xxhash64(F.lit(5), "doc_id")).limit(wanted)
        picks = part if picks is None else picks.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feats = list(features(b.column(1), bits))
            chars = character_features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([i.astype("<i4").tobytes() for i, _ in feats], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in feats], pa.binary()), pa.array(list(chars), pa.list_(pa.float64()))],
                names=["grade", "idx", "val", "chars"],
            )

    # The picks number at most ``rows``, so they may be broadcast.
    joined = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    got = joined.mapInArrow(run, "grade int, idx binary, val binary, chars array<double>").toArrow()
    if got.num_rows == 0:
        return OrdinalModel(np.zeros((1 << bits) + 2 * SHAPES + 5), np.arange(classes - 1, dtype=float), bits)
    feats = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(got["idx"].to_pylist(), got["val"].to_pylist(), strict=True)]
    grades = np.array(got["grade"].to_pylist(), dtype=np.int64)
    chars = np.array(got["chars"].to_pylist()).reshape(len(feats), -1)
    order = np.lexsort((np.array([f[1].sum() for f in feats]), np.array([len(f[0]) for f in feats]), grades))
    return fit_ordinal(_Rows([feats[i] for i in order], chars[order]), grades[order], classes, bits)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", to: str = "rating") -> DataFrame:
    """``docs`` with a struct ``to`` of expected_grade, tail_probability (of the top grade) and at_least (of grade 1 or more).

    A text without a word (null, empty, blank, only signs) says nothing for itself: all three are 0, so it is never kept. Whole
    texts of any length are read; rows stand alone, so repeats agree, and an empty table gives an empty result. An existing
    column ``to`` is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.bits))

    @F.pandas_udf("expected_grade double, tail_probability double, at_least double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, thresholds, bits = shared.value
        m = OrdinalModel(weights.astype(np.float64), thresholds, bits)
        for t in texts:
            values, parts = t.tolist(), []
            for k in range(0, len(values), 1000):
                some = values[k : k + 1000]
                feats = list(features(pa.array(some, pa.string(), from_pandas=True), bits))
                rows = _Rows(feats, character_features(some))
                parts.append(m.tails(rows.dot(m.weights)) * np.array([len(i) > 0 for i, _ in feats])[:, None])
            p = np.concatenate(parts) if parts else np.zeros((0, len(thresholds)))
            yield pd.DataFrame({"expected_grade": p.sum(1), "tail_probability": p[:, -1], "at_least": p[:, 0]})

    return docs.withColumn(to, rate(F.col(text)))


def select_good(docs: DataFrame, model: OrdinalModel, tail: float = TAIL) -> DataFrame:
    """The rows whose top-grade probability reaches ``tail``, with the columns of ``docs``."""
    to = fresh(docs, "__rating")
    return score(docs, model, to=to).filter(F.col(to)["tail_probability"] >= tail).select(*[F.col(f"`{c}`") for c in docs.columns])
