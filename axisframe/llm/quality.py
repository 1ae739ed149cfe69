"""Quality scores from a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textkernel import Words, slices, tidy

#: Share of the pooled covariance in that of a class, and of its diagonal in the result.
POOLED = 0.3
DIAGONAL = 0.1
#: Bins of the log-density difference over which the score is calibrated.
BINS = 512
REACH = 64.0
_CLASSES = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [9, 10, 11, 12, 13, 32],
    "line": [10],
    "stop": [ord(c) for c in ".,;:?"],
    "shout": [ord("!")],
    "noise": [ord(c) for c in "#$%&*|@=<>{}[]\\^~_/+"],
}
NAMES = (
    "log_words", "log_length", "word_length", "log_line_words", "distinct", "commonest", "repeated_pairs", "wordless", "long_words",
    *(f"share_{k}" for k in _CLASSES),
)
_TABLE = np.zeros((len(_CLASSES), 256), bool)
for _k, _codes in enumerate(_CLASSES.values()):
    _TABLE[_k, _codes] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics (NAMES) per text: counts as logarithms, shares as square roots; zeros if empty."""
    w = Words(texts)
    n, words = np.diff(w.off), w.count
    out = np.zeros((w.rows, len(NAMES)))
    if not len(w.buf):
        return out
    some, full = np.maximum(n, 1), np.maximum(words, 1)
    shares = np.empty((len(_CLASSES), w.rows))
    for k in range(len(_CLASSES)):
        c = np.concatenate([[0], np.cumsum(_TABLE[k][w.buf])])
        shares[k] = (c[w.off[1:]] - c[w.off[:-1]]) / some
        if k == 0:
            lettered = c[w.end] > c[w.start]
    lines = shares[4] * n + 1
    length = w.end - w.start
    summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[w.first])
    h = w.hashes()
    distinct, commonest, pairs = np.zeros(w.rows), np.zeros(w.rows), np.zeros(w.rows)
    for r in np.flatnonzero(words > 0).tolist():
        a, b = w.first[r], w.first[r + 1]
        x = np.sort(h[a:b])
        edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        distinct[r], commonest[r] = len(edge) - 1, np.diff(edge).max()
        if b - a > 1:
            p = np.sort(h[a : b - 1] * np.uint64(3) + h[a + 1 : b])
            pairs[r] = np.count_nonzero(p[1:] == p[:-1]) / (b - a - 1)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(words), np.log1p(n), np.log1p(summed(length) / full)
    out[:, 3] = np.log1p(words / lines)
    out[:, 4], out[:, 5], out[:, 6] = np.sqrt(distinct / full), np.sqrt(commonest / full), np.sqrt(pairs)
    out[:, 7] = np.sqrt(np.maximum(0, 1 - summed(lettered) / full)) * (words > 0)
    out[:, 8] = np.sqrt(summed(length > 20) / full)
    out[:, 9:] = np.sqrt(shares).T
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text; null counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = statistics(batch.column(1))
                at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Discriminant:
    """Per class the mean, the inverse Cholesky factor of the shrunken covariance and its log determinant."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        d = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            d.append(-0.5 * (z * z).sum(1) - self.logs[k])
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        t = self.slope * np.clip(self.difference(x), -REACH, REACH) + self.offset
        return 1 / (1 + np.exp(-t))


def _moments(train: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products per class, added up in the tasks and then by (class, place)."""

    @tidy
    def run(batches):
        held: dict[int, np.ndarray] = {}
        p = len(NAMES)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, p)
            y = batch.column(0).to_numpy()
            for c in np.unique(y):
                z = np.column_stack([np.ones(int((y == c).sum())), x[y == c]])
                held[int(c)] = held.get(int(c), 0) + z.T @ z
        for c, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], names=["y", "place", "value"])

    parts = train.select("quality", "stats").mapInArrow(run, "y int, place int, value double")
    side = len(NAMES) + 1
    found: dict[int, np.ndarray] = {}
    for y, place, value in parts.groupBy("y", "place").agg(F.sum("value")).collect():  # at most 2 * side ** 2 rows
        found.setdefault(y, np.zeros(side * side))[place] = value
    out = {}
    for y, m in found.items():
        m = m.reshape(side, side)
        out[y] = m[0, 0], m[0, 1:], m[1:, 1:]
    return out


def fit(train: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """The discriminant of (quality 0/1, stats), from sums over all rows, and its calibration over a histogram.

    With one class only, scores are constant (0 or 1); without any row they are 0.5.
    """
    m = {y: v for y, v in _moments(train).items() if y in (0, 1)}
    if len(m) < 2:
        empty = np.zeros((2, len(NAMES)))
        return Discriminant(empty, np.zeros((2, len(NAMES), len(NAMES))), np.zeros(2), constant=float(next(iter(m))) if m else 0.5)
    means = np.array([m[y][1] / m[y][0] for y in (0, 1)])
    own = [m[y][2] / m[y][0] - np.outer(means[y], means[y]) for y in (0, 1)]
    n = [m[y][0] for y in (0, 1)]
    common = (own[0] * n[0] + own[1] * n[1]) / sum(n)
    factors, logs = [], []
    for y in (0, 1):
        s = ((1 - pooled) * n[y] * own[y] + pooled * sum(n) * common) / ((1 - pooled) * n[y] + pooled * sum(n))
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logs.append(np.log(np.diag(low)).sum())
    model = Discriminant(means, np.array(factors), np.array(logs))

    @tidy
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            d = np.clip(model.difference(x), -REACH, REACH)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(np.minimum((d + REACH) / (2 * REACH) * BINS, BINS - 1).astype(np.int32))], names=["y", "bin"])

    bins = train.select("quality", "stats").mapInArrow(run, "y int, bin int").groupBy("y", "bin").count().collect()  # at most 2 * BINS rows
    t = np.array([(b + 0.5) / BINS * 2 * REACH - REACH for _, b, _ in bins])
    y = np.array([r[0] for r in bins], float)
    weight = np.array([r[2] for r in bins], float)
    a = np.array([0.1, np.log(n[1] / n[0])])
    z = np.column_stack([t, np.ones(len(t))])
    for _ in range(50):  # Newton steps of a logistic fit, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (weight * (y - p)) - 1e-3 * a
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a = a + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(a[0]), float(a[1])
    return model


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` with score instead of the statistics; the model is a few kilobytes and travels with the task."""
    at = stats.columns.index("stats")
    keep = [c for c in stats.columns if c != "stats"]
    schema = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)

    @tidy
    def run(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(model.score(x))], names=[*keep, "score"])

    return stats.mapInArrow(run, f"{schema}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out=None, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score in (0, 1) and predicted (1 if score >= ``threshold``).

    ``held_out`` is a condition on doc_id (default: crc32 of its text modulo 4 is 2); such rows teach nothing. Only
    labels 0 and 1 count; a document labelled more than once has the largest label. Null texts score as
    empty ones, null ids are never held out or learned from, repeated rows get equal scores, an empty
    table gives no rows; other columns are not read.
    """
    rule = held_out if held_out is not None else F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    stats = cut(measured(docs).withColumn("held_out", F.coalesce(rule, F.lit(False))), "stats")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("known_id")).agg(F.max("quality").cast("int").alias("quality"))
    train = cut(stats.where("NOT held_out").join(known, F.col("doc_id") == F.col("known_id")).select("quality", "stats"), "train")
    out = score(stats, fit(train))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "held_out", "score", "predicted")
